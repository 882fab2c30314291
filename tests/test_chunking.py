from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators import chunking as K
from quillspark.operators import index as I
from quillspark.operators import splitters as P


def lengths(pieces):
    return [b - a for a, b in pieces]


def test_specs():
    assert P.Spec.of() == P.Spec() and P.Spec.of().tokens() == (150, 400, 480)
    s = P.Spec.of(512, 50, 999, 9)
    assert (s.max_chars, s.target_chars, s.overlap_ratio) == (512, 512, 0.5)
    s = P.Spec.of(512, 50, 10, -1)
    assert (s.target_chars, s.overlap_ratio) == (210, 0.0)
    assert [P.Spec.of(c).max_chars for c in (800, 100, None, 210, "x")] == [672] * 5 and P.Spec.of(500, -3).overlap_chars == 0


def test_recursive_without_signs():
    assert lengths(P.recursive("啊" * 1300, 200, 512, 50)) == [512, 512, 376]


def test_recursive_near_target():
    text = "啊" * 250 + "。" + "呀" * 90 + "？" + "嘿" * 400
    assert P.recursive(text, 200, 512, 50, 250)[0] == (0, 251) and P.recursive(text, 200, 512, 50, 400)[0] == (0, 342)


def test_recursive_is_linear():
    import time

    began = time.time()
    assert len(P.recursive("汉" * 1_000_000)) > 1000 and time.time() - began < 10


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 。，！\n“”汉字", max_size=1500))
def test_splitters_lose_nothing(text):
    whole = "".join(text[a:b] for a, b in P.oversized(text, 100, 20))
    assert whole.strip() == text.strip() or set(text) - set(whole) <= set(" \n")
    assert all(b - a <= 101 or text[b - 1].isspace() for a, b in P.oversized(text, 100, 20))
    covered = set()
    for a, b in P.recursive(text, 50, 160, 20):
        covered |= set(range(a, b))
    assert all(text[i].isspace() for i in set(range(len(text))) - covered)
    spec = P.Spec(50, 100, 160, 10, 0.1, 20)
    ends = [b for _, b in P.Cutter(text, spec).chunks()]
    assert ends == sorted(ends)


def test_tokenwise_prefers_paragraphs():
    text = ("甲" * 99 + "。") * 3 + "\n" + ("乙" * 99 + "。") * 5
    assert P.Cutter(text, P.Spec(100, 300, 400, 20, 0.1, 40)).chunks()[0] == (0, 301)


def test_parents_greedy(spark):
    def brute(sizes):
        groups, cur, total = [], [], 0
        for s in sizes:
            if cur and (len(cur) >= 4 or total + s > 1500 or (total >= 800 and len(cur) >= 2)):
                groups.append(cur)
                cur, total = [], 0
            cur.append(s)
            total += s
        if cur:
            groups.append(cur)
        if len(groups) > 1 and len(groups[-1]) + len(groups[-2]) <= 4 and sum(groups[-1]) + sum(groups[-2]) <= 1500:
            groups[-2:] = [groups[-2] + groups[-1]]
        return [len(g) for g in groups]

    import random

    rnd = random.Random(5)
    cases = [[rnd.choice((50, 300, 400, 700, 1600)) for _ in range(rnd.randint(0, 14))] for _ in range(120)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c array<int>").select("i", K.parent_sizes("c").alias("s"))
    assert {r.i: list(r.s) for r in df.collect()} == {i: brute(c) for i, c in enumerate(cases)}


def test_build_chunks_links(spark):
    text = "第一章 a\n" + ("甲" * 60 + "。\n") * 20 + "第二章 b\n" + "乙" * 90 + "。"
    rows = K.build_chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == list(range(1, len(rows) + 1)) and rows[0].prev_chunk_id is None and rows[0].next_chunk_id == 2
    assert rows[-1].chapter == "第二章 b" and rows[-1].prev_chunk_id is None and all(r.chunk_length <= 702 for r in rows)


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (5, 1, 3, 3)] + [("b", 7), ("c", None)], "k string, v int")
    got = {r.k: (r.n, r.least, r.median, r.most) for r in I.upper_median(df, "k", "v").collect()}
    assert got == {"a": (4, 1, 3, 5), "b": (1, 7, 7, 7)}
