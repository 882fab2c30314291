import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import tokens as T

PATH = T.vocabulary_path()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab' re.12\n \t汉字，。é👍‍־<|endoftext|>", max_size=200), st.integers(1, 20))
def test_tree_equals_whole(text, leaf):
    assert T.encode_tree(text, PATH, leaf).tolist() == T.encode_plain(text, PATH).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_joining_is_associative_and_decodes(parts):
    nodes = [(p, T.encode_plain(p, PATH)) for p in parts]
    whole = "".join(parts)
    right = T.reduce_nodes(nodes, PATH)
    left = ("", np.empty(0, dtype=np.int32))
    for node in nodes:
        left = T.join(left, node, PATH)
    assert left[1].tolist() == right.tolist() == T.encode_plain(whole, PATH).tolist()
    assert T.encoder(PATH).decode(right.tolist()) == whole


def test_table(spark):
    long = "很长的一段。Words don't end, 12 34\n\n" * 40
    rows = [(1, "汉字 and"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, long), (5, long), (6, " " * 300), (7, "x" * 900)]
    df = spark.createDataFrame([(*r, [1]) for r in rows], "doc_id long, text string, ids array<int>")
    want = sorted((d, T.encode_plain(t or "", PATH).tolist()) for d, t in rows)
    for size in (65536, 200):
        assert sorted((r.doc_id, list(r.ids)) for r in T.encode_documents(df, segment=size, leaf=64).collect()) == want
    assert 50256 not in dict(want)[4]
    assert T.encode_documents(df.limit(0)).count() == 0
