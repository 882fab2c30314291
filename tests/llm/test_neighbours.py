import numpy as np

from quillspark.llm.neighbours import _fit, _placed, nearest, similar


def brute(ids, rows, k):
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    cosine = np.round(unit @ unit.T, 12)
    np.fill_diagonal(cosine, -9)
    return {int(i): [int(ids[j]) for j in np.lexsort((ids, -c))[:k]] for i, c in zip(ids, cosine)}


def test_recall_copies_and_bad_vectors(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.standard_normal((30, 16))
    rows = (centres[rnd.integers(0, 30, 900)] + 0.3 * rnd.standard_normal((900, 16))).astype(np.float32)
    rows[100:140] = rows[100]
    rows[200:203] = rows[200]
    ids = np.arange(900)
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [1.0] * 15), (2003, [float("nan")] * 16), (2004, [None] * 16), (2005, [float("inf")] * 16)]
    df = spark.createDataFrame([(int(i), r.tolist(), 7) for i, r in zip(ids, rows)] + [(i, v, 7) for i, v in bad], "vec_id long, embeddings array<float>, id long")
    truth = brute(ids, rows.astype(np.float64), 5)
    for options in ({"leaf_rows": 64, "trees": 5, "probes": 16}, {"leaf_rows": 128, "trees": 4, "probes": 10, "block_rows": 40}):
        got: dict[int, set] = {}
        for r in similar(df, 5, 16, **options).collect():
            got.setdefault(r.vec_id, set()).add(r.id)
        assert set(got) == set(truth) and all(len(v) == 5 for v in got.values())
        assert sum(len(got[i] & set(truth[i])) for i in truth) / (5 * len(truth)) > 0.95
        assert all(got[i] == set(truth[i]) for i in range(100, 140))


def test_one_direction(spark):
    """A third of the rows have one direction and so one leaf; no task gets many more of them than a block."""
    rnd = np.random.default_rng(2)
    rows = rnd.standard_normal((3000, 16)).astype(np.float32)
    rows[:1000] = rows[0] * rnd.uniform(0.5, 2, (1000, 1)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embeddings array<float>")
    forest = _fit(df, 3000, 16, 1024, 3, 64)
    placed = _placed(df, spark.sparkContext.broadcast(forest), 3000, 16, 8, 100)
    sizes = placed.groupBy("leaf", "block", "part").agg({"role": "count"}).collect()
    stored = placed.where("role <> 1").groupBy("leaf", "block", "part").count().collect()
    assert max(r["count"] for r in stored) <= 150 and max(r[3] for r in sizes) <= 700
    got = {r.vec_id: [x.id for x in r.near] for r in nearest(df, 5, 16, 1024, 3, 64, 8, 100).collect()}
    assert len(got) == 3000 and all(len(v) == 5 for v in got.values())
    assert all(set(got[i]) <= set(range(1000)) for i in range(1000))


def test_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embeddings array<float>")
    assert sorted((r.vec_id, r.id) for r in similar(df, 5, 2).collect()) == [(1, 2), (2, 1)]
    assert similar(df.limit(0), 5, 2).count() == 0 and similar(df.limit(1), 5, 2).count() == 0
