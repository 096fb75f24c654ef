import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from chunkloom.llm.components import connected_components
from chunkloom.llm.exact_dedup import DigestIndex, distinct_documents, exact_dedup
from chunkloom.llm.simhash import fingerprint, near_duplicates, near_links, similar_groups, without_near_duplicates

from .odd import ROWS, docs


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_odd_rows(spark):
    got = exact_dedup(docs(spark)).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for r in ROWS:
        groups.setdefault(norm(r[1]), []).append(r[0])
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in groups[text] if i is not None]
        assert r["group_size"] == len(groups[text])
        assert r["keep_id"] == (min(ids) if ids else None)
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup(docs(spark, [])).count() == 0


def test_index_remembers_batches(spark, tmp_path):
    """Opened again by its path alone, an index knows what came before, and its buckets."""
    path = f"file://{tmp_path}/index"
    index = DigestIndex(spark, path, buckets=2)
    index.dedup(docs(spark, [(5, "old text", "en", "a", 1, "x")]))
    spark.sql(f"DROP TABLE {index.name}")  # as a session that never saw it
    again = DigestIndex(spark, path, expected=10**9)
    assert again.buckets == 2
    got = {(r["doc_id"], r["keep_id"], r["kept"]) for r in again.dedup(docs(spark, [(1, "old  text", "en", "a", 1, "x"), (2, "new", "en", "a", 1, "x")])).collect()}
    assert got == {(1, 5, False), (2, 2, True)}
    assert again.table().count() == 2
    assert DigestIndex(spark, f"file://{tmp_path}/large", expected=10_500_000).buckets == 11
    again.drop()
    assert not (tmp_path / "index").exists()


def test_a_batch_that_is_tried_again(spark, tmp_path):
    """The same batch after a failure keeps the same rows and appends nothing."""
    path, one = f"file://{tmp_path}/index", docs(spark).repartition(3)
    exact_dedup(docs(spark, ROWS[:1]), index=path, batch_id="first")
    judged = [sorted(map(repr, exact_dedup(one, row_col="score", index=path, batch_id="second").collect())) for _ in range(2)]
    assert judged[0] == judged[1]
    table = DigestIndex(spark, path).table()
    assert table.count() == table.select("digest").distinct().count() == len({norm(r[1]) for r in ROWS})
    assert exact_dedup(one, index=path, batch_id="third").where("kept").count() == 0


def test_new_rows_meet_the_index_by_sort_merge(spark, tmp_path):
    """Of an anti-join's two sides only the batch is shuffled, an empty index included."""
    index = DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    batch = spark.range(9).selectExpr("unhex(sha2(string(id), 256)) AS digest")
    plan = index.unseen(batch, "now")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [digest" in plan and "LeftAnti" in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = index.unseen(batch, "now")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert index.unseen(batch, "now").count() == 9


def test_distinct_documents_keep_columns(spark):
    got = distinct_documents(docs(spark))
    assert got.columns == docs(spark).columns
    assert got.count() == len({norm(r[1]) for r in ROWS})


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", " ", "One", "A b", "A B c", "É ß\x0bx\x1cy z"] + [" ".join(rng.choice("ab cd EF ÄÖ".split()) for _ in range(rng.randrange(80))) for _ in range(40)]
    assert [fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def plain_components(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("hot", [64, 3, 0])
def test_links_of_planted_fingerprints(spark, hot):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, 12)
    fps = {int(b) for b in base} | {0, -1, 1, 3, 7, 15}
    for b in base[:6]:
        for _ in range(30):
            flips = rng.integers(0, 64, rng.integers(1, 4))
            v = int(b) & (2**64 - 1)
            for f in flips:
                v ^= 1 << int(f)
            fps.add(v - 2**64 if v >= 2**63 else v)
    fps = sorted(fps)
    want = plain_components([(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2], fps)
    links = [(r["a"], r["b"]) for r in near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), hot).collect()]
    assert plain_components(links, fps) == want
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in fps} == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000), (None, 3), (7001, 7000), (7000, 7001)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}, 7000: 7000, 7001: 7000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_odd_rows(spark):
    got = near_duplicates(docs(spark)).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert by[2]["component_id"] == 1 and by[3]["fingerprint"] == "0" * 16
    assert by[4]["component_id"] == by[5]["component_id"] == 3
    assert sum(r["first"] for r in got) == len({r["component_id"] for r in got if r["component_id"] is not None}) + sum(r["component_id"] is None for r in got)
    kept = without_near_duplicates(docs(spark))
    assert kept.columns == docs(spark).columns and kept.count() == sum(r["first"] for r in got)
    assert near_duplicates(docs(spark, [])).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    """The query's rows over whole texts, against fingerprints counted bit by bit and all pairs."""
    from chunkloom.llm import queries

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(100_000 + i, f"{t} more") for i, t in rows[:20]] + [(200_000 + i, t.upper()) for i, t in rows[:5]] + [(300_000, None), (300_001, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    prints = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    roots = plain_components([(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2], ids)
    got = queries.op3_simhash_near_dedup(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, f"{prints[i]:016x}", roots[i]) for i in ids]
    assert len(set(roots.values())) < len(ids) - 20


def jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_near_copies_of_similarity(spark):
    """Every pair of at least 0.8 is linked, no pair below; checked against all pairs."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(1, 2 + len(base) // 35)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i], texts[j]) >= 0.8]
    assert len(pairs) > 20
    want = plain_components(pairs, range(len(texts)))
    rows = [(i, t, "en", "a", 1, "x") for i, t in enumerate(texts)]
    got = {r["doc_id"] for r in without_near_duplicates(docs(spark, rows)).collect()}
    assert got == set(want.values())


@pytest.mark.parametrize("block_rows", [3, 7, 25])
def test_large_groups_go_in_blocks(spark, block_rows):
    """Groups of many blocks give what all pairs give: a large cluster, chains whose ends are
    far apart, and texts that are candidates but no copies."""
    rng = random.Random(block_rows)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(30):  # near the first one
        copy = list(base)
        copy[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(copy))
    link = list(base)
    for _ in range(14):  # each near the one before, the last far from the first
        link = list(link)
        for _ in range(2):
            link[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(link))
    for _ in range(20):  # about half of the first one
        texts.append(" ".join(base[:66] + [rng.choice(words) for _ in range(54)]))
    texts += [" ".join(rng.choice(words) for _ in range(80)) for _ in range(5)] + ["", None, " "]
    order = list(range(len(texts)))
    rng.shuffle(order)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i] or "", texts[j] or "") >= 0.8]
    want = plain_components([(order[i], order[j]) for i, j in pairs], order)
    rows = [(order[i], t, "en", "a", 1, "x") for i, t in enumerate(texts)]
    got = sorted(r["doc_id"] for r in without_near_duplicates(docs(spark, rows), block_rows=block_rows).collect())
    assert got == sorted(set(want.values()))


def test_labels_link_from_the_beginning():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3], [7, 8, 9], [1, 2, 3], [20, 21], [7, 8, 9])]
    assert similar_groups(sets, 0.8) == [0, 1, 0, 3, 1]
    assert similar_groups(sets, 0.8, [5, 5, 6, 7, 7]) == [0, 0, 0, 0, 0]
    assert similar_groups(sets, 0.8, [1, 2, 3, 3, 5]) == [0, 1, 0, 0, 1]
