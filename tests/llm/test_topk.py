import numpy as np

from chunkloom.llm import balltree
from chunkloom.llm.balltree import top_k


def plain(rows, queries, k):
    good = [(i, np.floor(np.array(v, float) * 64).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q in {i for i, _ in queries}:
        for i, v in good:
            if i == q:
                best = sorted(((-int(v @ w), j) for j, w in good if j != q))[:k]
                out[q] = [(j, -s) for s, j in best]
    return out


def frames(spark, *tables):
    shape = "vec_id long, embedding array<float>, score string"
    return [spark.createDataFrame([(i, v, "x") for i, v in x], shape) for x in tables]


def run(spark, rows, queries, k, **more):
    out = {}
    for r in top_k(*frames(spark, rows, queries), k, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(5, 8))
    rows = [(i, [float(x) for x in np.float32(centres[i % 5] + 0.3 * rng.normal(size=8))]) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, rows[1][1])]
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    want = plain(rows, queries, 20)
    assert run(spark, rows, queries, 20) == want
    assert run(spark, rows, queries, 20, query_block=7, shard_rows=100) == want


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, -2.0])]
    assert run(spark, rows, rows, 20) == {0: [(1, -12288)], 1: [(0, -12288)]}
    mixed = [*rows, (2, [1.0]), (3, [2.0]), (4, []), (5, [])]
    assert run(spark, mixed, mixed, 20) == {0: [(1, -12288)], 1: [(0, -12288)], 2: [(3, 8192)], 3: [(2, 8192)], 4: [(5, 0)], 5: [(4, 0)]}
    assert run(spark, [], [], 5) == {}
    assert run(spark, rows, [], 5) == {}


def test_large_numbers_stay_exact():
    a = np.array([[2**31, 3], [-(2**31), 5]], np.int64)
    assert balltree.dot(a, a).tolist() == [[2**62 + 9, -(2**62) + 15], [-(2**62) + 15, 2**62 + 25]]


def test_unusable_rows_hide_no_query(spark):
    """Of the rows of a query's id the usable ones count, and of these the least."""
    rows = [(20, None), (20, [1.0, 2.0]), (20, [float("nan"), 0.0]), (1, [1.0, 1.0]), (40, [3.0, 0.0]), (40, [-3.0, 9.0])]
    got = run(spark, rows, rows, 2)
    assert got[20] == [(40, 64 * 64 * 15), (1, 64 * 64 * 3)] and got[40][0] == (20, 64 * 64 * 15)


def test_clusters_are_pruned(spark, monkeypatch):
    """With vectors in tight clusters most pairs are never scored, by shards and waves too;
    the hits are those of all pairs."""
    monkeypatch.setattr(balltree, "FIRST_WAVE", 4)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(60, 16)) * 2
    rows = [(i, [float(x) for x in np.float32(centres[i * 7 % 60] + 0.02 * rng.normal(size=16))]) for i in range(4000)]
    queries = [r for r in rows if r[0] % 50 == 0]
    scored = []
    got = run(spark, rows, queries, 5, scored=scored, query_block=40, shard_rows=256)
    assert len(scored) > 1  # waves
    assert got == plain(rows, queries, 5)
    assert 0 < sum(scored) < 0.35 * len(rows) * len(queries)


def test_a_hot_place_is_many_shards(spark):
    """A third of all vectors in one place go to several shards."""
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float(x) for x in rng.normal(size=3)]) for i in range(1500)]
    candidates = balltree.usable(*frames(spark, rows), "vec_id", "embedding")
    sizes = [int(r["shard"].rsplit("-", 1)[1]) for r in balltree.sharded(candidates, 1500, 64).mapInPandas(balltree._builder(64), "dims int, shard string, root binary, tree binary").collect()]
    assert sum(sizes) == 1500 and max(sizes) <= 64
    queries = [r for r in rows if r[0] % 100 == 0]
    assert run(spark, rows, queries, 20, shard_rows=64) == plain(rows, queries, 20)
