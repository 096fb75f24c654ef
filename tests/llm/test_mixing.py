import hashlib

import pytest

from chunkloom.llm.mixing import SCHEDULES, mix, mixed_documents

from .odd import ROWS, docs


def plain_targets(sizes):
    """Sources by code point, null last: give, cap, share the rest anew."""
    order = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    total, free = sum(sizes.values()), set(order)
    while True:
        rest = total - sum(3 * sizes[k] for k in order if k not in free)
        share = {k: rest * weight[k] / sum(weight[j] for j in free) for k in free}
        over = {k for k in free if share[k] > 3 * sizes[k]}
        if not over:
            return {k: share.get(k, 3.0 * sizes[k]) for k in order}
        free -= over


def test_skewed_sources(spark):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{0 if i % 3 else i % 11:02d}", 0, "x") for i in range(600)]
    rows += [(i, "w " * 5, "en", None, 0, "x") for i in range(600, 640)]
    got = mix(docs(spark, rows)).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    want, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    assert len(got) == len(rows)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        assert (r["position"] is not None) == (r["taken"] > 0)
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[k] - want[k]) <= 0.5 for k in want)
    assert [r["position"] for r in got if r["position"] is not None] == sorted(r["position"] for r in got if r["position"] is not None)
    assert {(r["doc_id"], r["taken"]) for r in mix(docs(spark, rows).repartition(7)).collect()} == {(r["doc_id"], r["taken"]) for r in got}


def test_order_within_a_source_and_positions(spark):
    rows = [(i, "a b c", "en", "s", 0, "x") for i in range(50)]
    got = {r["doc_id"]: r for r in mix(docs(spark, rows)).collect()}
    before = 0
    for i in sorted(range(50), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
        share = before / 150
        (_, r0), (_, r1) = SCHEDULES[0]
        t = 2 * share / (r0 + (r0 * r0 + 2 * (r1 - r0) * share) ** 0.5)
        assert got[i]["position"] == pytest.approx(t, abs=1e-8) and got[i]["taken"] == 3
        before += 3


def test_odd_rows(spark):
    got = mix(docs(spark)).collect()
    assert len(got) == len(ROWS)
    assert all(r["size"] == 0 and r["taken"] == 0 for r in got if r["doc_id"] in (3, 4, 5))
    assert mix(docs(spark, [])).count() == 0
    assert mix(docs(spark, [(1, "", "en", "a", 0, "x")])).collect()[0]["taken"] == 0
    out = mixed_documents(docs(spark))
    assert out.columns == docs(spark).columns
    assert out.count() == sum(len(r["positions"]) for r in got)
