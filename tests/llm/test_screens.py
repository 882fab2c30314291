"""What is tried first, because it is quick, has to give what the whole work gives."""

from collections import Counter
from types import SimpleNamespace

import numpy as np

from quillspark.llm import encodings, scans
from quillspark.llm.language import Language


def test_quick_tests_before_slow_ones_change_nothing():
    reader = scans.Reader(Language(np.ones(1 << 20, dtype=np.float32), np.ones(1 << 16, dtype=np.float32), np.ones(1 << 18, dtype=np.float32), None, np.ones(1 << 20, dtype=np.float32)), [], [])
    marks = lambda text: scans.repair(text, {"第一章", "书名"}, reader)
    assert marks("第一章 · 12\n正文。") == (scans.HEADING, "正文。") and marks("第 一 章\x1c\n正文。") == (scans.HEADING, "正文。")
    assert marks("第一章第３页\n正文。") == (scans.HEADING, "正文。") and marks("第一章三\n正文。") == (0, "第一章三\n正文。")
    assert marks("正文~正文。") == (scans.STRAY, "正文正文。") and marks("正·文") == (scans.STRAY, "正文") and marks("abc~ def") == (0, "abc~ def")
    assert marks("正 文 的 字。")[0] == scans.GAPS and marks("正 文 的。") == (0, "正 文 的。")
    assert marks("an exam-\nple of it.") == (scans.BROKEN, "an example of it.") and marks("a1-\nb2") == (0, "a1-\nb2")
    assert [scans._width(x) for x in ("", "a⺀", "a⺁字\ud800", "𠀀")] == [0, 2, 7, 2]


def test_few_searches_for_usual_text(monkeypatch):
    """Widths, headings and decoding are worked out only where something can come of them."""
    counts = Counter()
    for name in ("_width", "_TRAILING_PAGE", "_STRAY", "_GAP", "_HYPHEN"):
        own = getattr(scans, name)
        if callable(own):
            monkeypatch.setattr(scans, name, lambda *a, own=own, name=name: counts.update([name]) or own(*a))
        else:
            monkeypatch.setattr(scans, name, SimpleNamespace(**{m: lambda *a, f=getattr(own, m), name=name: counts.update([name]) or f(*a) for m in ("sub", "search", "findall")}))
    reader = scans.Reader(Language(np.ones(1 << 20, dtype=np.float32), np.ones(1 << 16, dtype=np.float32), np.ones(1 << 18, dtype=np.float32), None, np.ones(1 << 20, dtype=np.float32)), [], [])
    assert scans.repair("他走了。\n她说：“是。”\n\n天黑了。", {"第一章"}, reader) == (0, "他走了。\n她说：“是。”\n\n天黑了。") and not counts


def test_bytes_of_a_page_are_those_of_its_characters():
    text = "甲ä字a\n가ｱ\U00020000\ud800͸🙂。"
    for page in encodings.DOUBLE:
        parts = [encodings._written(c, page) for c in text]
        raw, places = encodings._as_bytes(text, page)
        assert raw == b"".join(parts) and places.tolist() == [sum(map(len, parts[:k])) for k in range(len(parts) + 1)]
        assert encodings._as_bytes("", page)[0] == b""


def test_rare_runs_are_found_for_a_whole_batch():
    random = np.random.default_rng(4)
    for _ in range(30):
        texts = ["x" * n for n in random.integers(0, 30, 12)]
        own = np.where(random.random(sum(map(len, texts)) + len(texts) - 1) < 0.75, -20.0, -5.0)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        want = {k for k, t in enumerate(texts) if encodings._rare_spans(own[starts[k] : starts[k] + len(t)], -10.0)}
        assert encodings._with_rare_runs(own >= -10.0, texts) == want


def test_stretches_of_a_text_are_scored_at_once(monkeypatch):
    random = np.random.default_rng(7)
    language = Language(random.random(1 << 20).astype(np.float32), random.random(1 << 16).astype(np.float32), np.ones(1, dtype=np.float32))
    scored, calls = language.log_pair, []
    monkeypatch.setattr(language, "log_pair", lambda *a: calls.append(len(a[0])) or scored(*a))
    text = "".join(w + "，" for w in ("石匣", "渡口", "结冰", "据说", "听见了")).encode().decode("latin-1") + "完"
    own = np.full(len(text), -15.0, dtype=np.float32)
    monkeypatch.setattr(encodings, "WORST", -30.0)
    places = [k for k, c in enumerate(text) if ord(c) < 256][::3]
    stretches = [(a, a + 3, text[a : a + 3].encode("latin-1").decode()) for a in places]
    kept = encodings._gains(text, stretches, "gb18030", True, language, own)
    assert len(calls) == 1 and len(kept) > 3
    for start, end, said, gain in kept:
        line = encodings.same_digits(encodings.codes_of((text[start - 1 : start] or "\n") + said + text[end : end + 1]))
        assert abs(gain - (scored(line[:-1], line[1:]).mean() + 15) * (len(line) - 1)) < 1e-3
    assert encodings._gains(text, [], "utf-8", True, language, own) == []
