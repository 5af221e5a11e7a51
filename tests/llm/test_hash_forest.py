import numpy as np
from pyspark.sql import functions as F

from billweave.llm import hash_forest as h

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, k):
    ok = {}
    for i, v, _ in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0):
            ok[i] = np.array(v, np.float32).astype(np.float64)
    out = {}
    for q in (i for i in ok if i % 20 == 0):
        near = sorted((-float(np.cumsum(ok[q] * v)[-1]), i) for i, v in ok.items() if i != q)
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(df, **more):
    got = {}
    for r in h.nearest(df, F.col("vec_id") % 20 == 0, **more).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


def recall(got, expected):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in e}) / len(e) for q, e in expected.items() if e])


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(h, "BLOCK", 400)
    monkeypatch.setattr(h, "QUERY_BLOCK", 30)
    r = np.random.default_rng(4)
    centers = r.normal(size=(30, 24))
    vectors = (centers[r.integers(30, size=1500)] + 0.2 * r.normal(size=(1500, 24))) * r.uniform(0.5, 2, (1500, 1))
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("x"), "ids": F.lit("y")})
    got, expected = found(df), brute_force(rows, 20)
    assert set(got) == set(expected) and all(len(x) == 20 for x in got.values())
    assert recall(got, expected) >= 0.9
    exact = {i: np.array(v) for i, v, _ in rows}
    assert all(s == np.cumsum(exact[q] * exact[i])[-1] for q, x in got.items() for i, s in x)


def test_copies_ties_and_rows_that_take_no_part(spark):
    one, two = [1.0, 0.0, 0.5], [0.5, 0.5, 0.0]
    rows = [(i, one, 0) for i in range(70)] + [(i, two, 0) for i in range(100, 130)] + [
        (200, None, 0), (201, [], 0), (202, [0.0, 0.0, 0.0], 0), (203, [1.0, None, 2.0], 0), (204, [1.0, float("nan"), 2.0], 0),
        (205, [1.0, float("inf"), 2.0], 0), (None, one, 0), (220, [-1.0, 0.0, 0.0], 0)]
    got = found(spark.createDataFrame([*rows, rows[0], rows[100]], SCHEMA))
    assert got == brute_force(rows, 20)
    assert [i for i, _ in got[20]] == [i for i in range(21) if i != 20]


def test_few_rows_other_lengths_and_none(spark):
    rows = [(0, [1.0, 2.0], 0), (1, [2.0, 1.0], 0), (3, [-1.0, 0.0], 0), (20, [1.0], 0)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert got == {0: [(1, 4.0), (3, -1.0)]}
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    assert found(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)) == {}


def test_ascent_goes_on_until_enough_are_found():
    r = np.random.default_rng(1)
    vectors = r.normal(size=(500, 16))
    forest = h.Forest(vectors, float(np.linalg.norm(vectors, axis=1).max()))
    sizes = [len(forest.candidates(vectors[:5], n)[0]) for n in (1, 50, 200, float("inf"))]
    assert sizes == sorted(sizes) and sizes[0] >= 1 and sizes[-1] == 500
