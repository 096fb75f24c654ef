"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32. Two that differ in at most
two bits differ in at most one bit of some segment, so each fingerprint looks its
segment values up together with the ball of radius one around them, and complete
distances are verified. Of two values one bit apart, only the one with that bit set
probes; a pair is met once a segment.

Segment values that very many fingerprints share (large groups of near copies) would
give all pairs within the group. There the fingerprints are linked through keys
instead: each emits its whole ball of radius one (65 keys), and two meet in a key
exactly if they differ in at most two bits. A key has at most 65 members, so this is
linear in the group and loses nothing.

Removal of near copies is by similarity (``without_near_duplicates``): texts with a
Jaccard similarity of their word shingles of at least 0.8. Such pairs differ in some ten
bits of 64 and in up to about twenty, a radius at which segments of 64 bits select
nothing. So candidates are the links above and the texts that share a band of MinHash
values, and all candidates are held against each other by their whole shingle sets, in
blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh_name, numbered, sieved, takes_turn, without_rows, written
from .components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Of the removal of near copies: words of a shingle and least Jaccard similarity.
NEAR_WORDS = 5
NEAR_SIMILARITY = 0.8
#: Bands and MinHash values of a band; a pair of similarity 0.8 shares none with a
#: probability of (1 - 0.8^5)^24 = 0.00007.
BANDS, BAND_ROWS = 24, 5
#: Rows and characters of a block of candidates that are held against each other at once.
BLOCK_ROWS, BLOCK_CHARS = 4000, 32_000_000
#: A segment value with more fingerprints is linked through balls.
HOT_BUCKET = 64
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 15
_SHIFTS = np.arange(64, dtype=np.uint64)


def shingle_hashes(text: str | None, shingle_words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles in text order, in blocks; none where there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return
    k = min(shingle_words, n)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= k:
        yield np.array([digest(joined, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total = n - k + 1
    begin, end = starts[:total].tolist(), ends[k - 1 :].tolist()
    for i in range(0, total, _BLOCK):
        yield np.fromiter((digest(joined[p:q], SEED) for p, q in zip(begin[i : i + _BLOCK], end[i : i + _BLOCK])), np.uint64, min(_BLOCK, total - i))


def _simhash(blocks: Iterable[np.ndarray]) -> int:
    counts, total = np.zeros(64, np.int64), 0
    for h in blocks:
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(h)
    return int(((counts * 2 > total).astype(np.uint64) << _SHIFTS).sum(dtype=np.uint64))


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text, unsigned; 0 where there are no words."""
    return _simhash(shingle_hashes(text, shingle_words))


def shingle_set(text: str | None, shingle_words: int = NEAR_WORDS) -> np.ndarray:
    """Distinct shingle hashes, ascending; texts without words share one of their own."""
    blocks = list(shingle_hashes(text, shingle_words))
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(1, np.uint64)


_rng = np.random.default_rng(SEED)
_FLIPS, _FACTORS = (_rng.integers(0, 2**64, (BANDS * BAND_ROWS, 1), np.uint64) for _ in range(2))
_FACTORS |= np.uint64(1)


def band_keys(shingles: np.ndarray) -> list[int]:
    """A signed key for each band of the set's MinHash values."""
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 4096):
        np.minimum(least, ((shingles[None, i : i + 4096] ^ _FLIPS) * _FACTORS).min(axis=1), out=least)
    raw = least.astype("<u8").reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), j) for j, r in enumerate(raw)], np.uint64).view(np.int64).tolist()


def _fingerprints(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    takes_turn("simhash")
    for pdf in batches:
        fp = np.array([fingerprint(t) for t in pdf["text"]], np.uint64).view(np.int64)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "row_id": pdf["row_id"], "fp": fp})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``(doc_id, row_id, fp)``, fp as a signed long with the fingerprint's bits."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row_id"),
        F.col(text_col).alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(_fingerprints, f"doc_id {kind}, row_id long, fp long")


def _bit(i):
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def near_links(nodes: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that join all pairs of at
    most two differing bits (pairs within hot buckets through their smallest key mate)."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    segment = F.explode(F.array(F.struct(F.lit(0).alias("seg"), low.alias("value")), F.struct(F.lit(1).alias("seg"), high.alias("value"))))
    table = nodes.select("fp", segment.alias("s")).select("s.seg", "s.value", "fp")
    hot = written(table.groupBy("seg", "value").agg(F.count("*").alias("n")).where(F.col("n") > hot_bucket).drop("n"), "hot")
    any_hot = not hot.isEmpty()
    cool = table.join(hot, ["seg", "value"], "left_anti") if any_hot else table
    bits = F.sequence(F.lit(0), F.lit(31))
    cleared = F.transform(
        F.filter(bits, lambda i: F.col("value").bitwiseAND(_bit(i)) != 0), lambda i: F.col("value").bitwiseXOR(_bit(i))
    )
    probes = cool.select("seg", F.explode(F.concat(F.array("value"), cleared)).alias("probe"), F.col("fp").alias("a"), "value")
    met = probes.withColumnRenamed("value", "own").join(
        cool.select("seg", F.col("value").alias("probe"), F.col("fp").alias("b")), ["seg", "probe"]
    )
    verified = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    links = met.where(verified & ((F.col("own") != F.col("probe")) | (F.col("a") < F.col("b")))).select("a", "b")
    if not any_hot:
        return links
    ball = F.transform(bits, lambda i: F.col("value").bitwiseXOR(_bit(i)))
    near = table.select("seg", F.explode(F.concat(F.array("value"), ball)).alias("value"), "fp")
    touched = near.join(hot, ["seg", "value"], "left_semi").select("fp").distinct()
    keys = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(_bit(i))))
    from pyspark.sql import Window as W

    mates = touched.select("fp", F.explode(keys).alias("key"))
    least = mates.select("fp", F.min("fp").over(W.partitionBy("key")).alias("least"))
    return links.union(least.where("least <> fp").select(F.col("fp").alias("a"), F.col("least").alias("b")))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    hot_bucket: int = HOT_BUCKET,
) -> DataFrame:
    """A row for every input row: ``doc_id, fingerprint, component_id, row_id, first``.

    Fingerprints that differ in at most two bits are linked; ``component_id`` is the
    smallest id reachable, ``first`` is true for one row of each component (the
    smallest id; of repeated ids the first row). Null and empty texts have fingerprint
    zero, which links like any other; rows with a null id take part, but never name
    their component unless all its ids are null. Other columns are ignored; an empty
    table gives no rows.
    """
    marks, saved = written(fingerprints(docs, id_col, text_col, row_col), "fingerprints"), Scratch(docs.sparkSession)
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_id"))
    nodes = saved(marks.groupBy("fp").agg(F.min(least).alias("least")), "nodes")
    roots = saved(connected_components(near_links(nodes.select("fp"), hot_bucket)), "components")
    owner = roots.join(nodes, roots["node"] == nodes["fp"]).select("node", "root", "least")
    best = owner.groupBy("root").agg(F.min("least").alias("best"))
    linked = roots.join(best, "root").select(F.col("node").alias("fp"), "best")
    # written, so that both sides of the last join are shuffled and AQE can split the rows
    # of a fingerprint that very many documents share
    named = written(nodes.join(linked, "fp", "left").select("fp", F.coalesce("best", "least").alias("best")), "named")
    saved.drop()
    return marks.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("best.doc_id").alias("component_id"),
        "row_id",
        (F.col("row_id") == F.col("best.row_id")).alias("first"),
    )


def similar_groups(sets: Iterable[np.ndarray], similarity: float, labels: Sequence[int] | None = None) -> list[int]:
    """For each of the sets (ascending, not empty), the place of the first one of its
    component; sets with at least this Jaccard similarity are linked, and those of one of
    ``labels`` (a list that may grow along with the sets) are linked from the beginning.

    Sets are compared that share a hash among their least, as any two so similar must;
    those already in one component aren't compared again.
    """
    named: dict[int, int] = {}
    held: list[np.ndarray] = []
    root: list[int] = []
    index: dict[int, dict[int, list[int]]] = {}  # shingle: component: members

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x, s in enumerate(sets):
        held.append(s)
        root.append(x)
        if labels is not None and (y := named.setdefault(labels[x], x)) != x:
            root[x] = find(y)
        n = len(s)
        prefix = s[: n - math.ceil(similarity * n - 1e-9) + 1].tolist()
        tried: set[int] = set()
        for key in prefix:
            there = index.setdefault(key, {})
            for r in list(there):
                if (now := find(r)) != r:
                    there.setdefault(now, []).extend(there.pop(r))
            for r, members in list(there.items()):
                if find(r) == find(x):
                    continue
                for at, y in enumerate(members):
                    if y in tried:
                        continue
                    tried.add(y)
                    t = held[y]
                    m = len(t)
                    if min(n, m) < similarity * max(n, m) - 1e-9:
                        continue
                    common = int((t[np.minimum(np.searchsorted(t, s), m - 1)] == s).sum())
                    if common >= similarity * (n + m - common) - 1e-9:
                        members[0], members[at] = y, members[0]  # likely the next one's match
                        p, q = find(x), find(y)
                        root[max(p, q)] = min(p, q)
                        break
        for key in prefix:
            index[key].setdefault(find(x), []).append(x)
    return [find(i) for i in range(len(held))]


def _walk(similarity: float, shingle_words: int):
    """Components within each part (rows come part by part): a row's ``owner`` is the label
    of the first row of its component."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        takes_turn("simhash")
        rows = (r for pdf in batches for r in zip(pdf["part"], pdf["row_id"], pdf["label"], pdf["text"]))
        for _, part in groupby(rows, key=lambda r: r[0]):
            ids: list[int] = []
            labels: list[int] = []

            def sets(part=part, ids=ids, labels=labels):
                for _, row, label, text in part:
                    ids.append(row)
                    labels.append(label)
                    yield shingle_set(text, shingle_words)

            firsts = similar_groups(sets(), similarity, labels)
            yield pd.DataFrame({"row_id": ids, "label": labels, "owner": [labels[f] for f in firsts]})

    return run


def _walked(rows: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """``row_id, label, owner`` of rows ``part, first, label, text``, where ``first`` is the
    order in which they stay."""
    rows = rows.repartition("part").sortWithinPartitions("part", "first")
    return rows.select("part", F.col("first.row_id").alias("row_id"), "label", "text").mapInPandas(_walk(similarity, shingle_words), "row_id long, label long, owner long")


def _relabelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with the label that theirs is linked to."""
    told = written(connected_components(links, "label", "owner"), "labels").select(F.col("node").alias("label"), F.col("root").alias("_to"))
    return rows.join(told, "label", "left").withColumn("label", F.coalesce("_to", "label")).drop("_to")


def _blocks(rows: DataFrame, by: list[str], most: int, chars: int) -> DataFrame:
    """Add ``block``, by a hash of the row, so that those of equal ``by`` have at most about
    ``most`` rows and ``chars`` characters a block."""
    size = rows.groupBy(*by).agg(F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("chars") / chars)).alias("_n"))
    size = size.where("_n > 1")
    block = F.pmod(F.xxhash64("first.row_id"), F.coalesce(F.col("_n"), F.lit(1)))
    return rows.join(size, by, "left").withColumn("block", block).withColumn("big", F.col("_n").isNotNull()).drop("_n")


def _across(rows: DataFrame, texts: DataFrame, similarity: float, shingle_words: int, most: int, chars: int) -> DataFrame:
    """Links ``label, owner`` between rows ``root, first, label, chars`` of one root that lie
    in different blocks: each pair of blocks is one part, but for those of one label.

    Blocks are of one label as far as labels have so many rows; what has fewer shares
    blocks. So rows that are known to be copies of one another are never compared again.
    """
    size = rows.groupBy("root", "label").agg(F.greatest(F.count("*") / most, F.sum("chars") / chars).alias("_fill"))
    placed = rows.join(size, ["root", "label"])
    large = placed.where("_fill > 0.5").withColumn("at", F.concat_ws("-", "label", F.pmod(F.xxhash64("first.row_id"), F.ceil("_fill"))))
    small = _blocks(placed.where("_fill <= 0.5").drop("_fill"), ["root"], most, chars)
    # rows of one small label stay together
    count = small.groupBy("root").agg((F.max("block") + 1).alias("_n"))
    small = small.join(count, "root").withColumn("at", F.concat(F.lit("s"), F.pmod(F.xxhash64("label"), F.col("_n")).cast("string")))
    shape = ["root", "first", "label", "at"]
    placed = written(large.select(*shape).union(small.select(*shape)), "placed")
    blocks = placed.groupBy("root", "at").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    one, other = blocks.toDF("root", "a", "low_a", "high_a"), blocks.toDF("root", "b", "low_b", "high_b")
    # blocks, of some thousand rows each; a small block meets itself too
    pairs = one.join(other, "root").where("a <= b and not (low_a = high_a and low_b = high_b and low_a = low_b)")
    pairs = pairs.select("root", F.concat_ws("/", F.col("root").cast("string"), "a", "b").alias("part"), F.explode(F.array_distinct(F.array("a", "b"))).alias("at"))
    rows = placed.join(pairs, ["root", "at"]).join(texts, F.col("first.row_id") == texts["row_id"]).drop("row_id")
    found = _walked(rows.select("part", "first", "label", "text"), similarity, shingle_words)
    return found.select("label", "owner").where("label <> owner").distinct()


def without_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = NEAR_WORDS,
    max_bits: int = MAX_BITS,
    similarity: float = NEAR_SIMILARITY,
    block_rows: int = BLOCK_ROWS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row of each component of near copies, with the columns of ``docs`` and no others.

    Rows are linked whose sets of ``shingle_words`` words have a Jaccard similarity of
    ``similarity`` or more; texts without words are equal. Candidates share a band of
    MinHash values or have fingerprints of at most ``max_bits`` (0 to 2) differing bits;
    groups of candidates are held against each other exactly. The row with the smallest id
    stays (null ids last, of repeated ids the first row).

    A task holds at most two blocks of about ``block_rows`` rows and ``block_chars``
    characters. A group of more is compared within its blocks, then by one row of each
    component found, then block against block where rows aren't known to be linked; what
    is found is the same.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits is 0 to {MAX_BITS}: two segments find no more")
    row = fresh_name(docs, "row")
    marked, saved = numbered(docs, row), Scratch(docs.sparkSession)

    def marks_of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            takes_turn("simhash")
            fps, keys = [], []
            for t in pdf["text"]:
                blocks = list(shingle_hashes(t, shingle_words))
                fps.append(_simhash(blocks))
                keys.append(band_keys(np.unique(np.concatenate(blocks))) if blocks else [])
            yield pd.DataFrame({"row_id": pdf["row_id"], "fp": np.array(fps, np.uint64).view(np.int64), "keys": keys})

    plain = marked.select(F.col(row).alias("row_id"), F.col(text_col).alias("text"))
    marks = saved(plain.mapInPandas(marks_of, "row_id long, fp long, keys array<long>"), "marks")
    nodes = saved(marks.groupBy("fp").agg(F.min("row_id").alias("owner"), F.count("*").alias("n")), "nodes")
    ends = near_links(nodes.select("fp")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    owners = nodes.select("fp", "owner")
    ends = ends.join(owners.toDF("a", "x"), "a").join(owners.toDF("b", "y"), "b").select("x", "y")
    same = marks.select("row_id", "fp").join(nodes.where("n > 1"), "fp").select("row_id", "owner")
    keyed = marks.select("row_id", F.explode("keys").alias("key"))
    shared = saved(keyed.groupBy("key").agg(F.min("row_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    links = ends.union(same).union(keyed.join(shared, "key").select("row_id", "owner"))
    groups = saved(connected_components(links, "x", "y"), "groups").select(F.col("node").alias("row_id"), "root")

    first = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("doc_id"), F.col(row).alias("row_id"))
    told = marked.select(F.col(row).alias("row_id"), first.alias("first"), F.coalesce(F.length(F.col(text_col)), F.lit(0)).alias("chars"))
    told = _blocks(told.join(groups, "row_id").drop("row_id"), ["root"], block_rows, block_chars)
    told = saved(told.withColumn("label", F.col("first.row_id")), "told")
    part = F.concat_ws("/", F.col("root").cast("string"), F.col("block").cast("string"))
    texts = sieved(plain, "row_id", groups.select("row_id"))[0].join(groups.select("row_id"), "row_id", "left_semi")
    inside = told.select(part.alias("part"), "first", "label", "first.row_id").join(texts, "row_id").drop("row_id")
    found = saved(_walked(inside, similarity, shingle_words), "found")
    gone = found.select("row_id").where("owner <> row_id")
    big = told.where("big").select("root", "first", "label", "chars")
    if not big.isEmpty():
        # one row of each component of a block, then all rows, block against block
        known = big.drop("label").join(found.select("row_id", F.col("owner").alias("label")), F.col("first.row_id") == F.col("row_id")).drop("row_id")
        heads = _blocks(known.where("label = first.row_id"), ["root"], block_rows, block_chars).withColumn("part", part)
        heads = heads.select("part", "first", "label", "first.row_id").join(texts, "row_id").drop("row_id")
        near = _walked(heads, similarity, shingle_words).select("label", "owner").where("label <> owner")
        known = written(_relabelled(known, near), "known")
        known = _relabelled(known, _across(known, texts, similarity, shingle_words, block_rows, block_chars))
        best = written(known, "known").groupBy("label").agg(F.min("first").alias("first"))
        stay = best.select("first.row_id")
        gone = gone.join(big.select("first.row_id"), "row_id", "left_anti").union(big.select("first.row_id").join(stay, "row_id", "left_anti"))
    gone = written(gone, "gone")
    saved.drop()
    return without_rows(marked, row, gone).select(*[f"`{c}`" for c in docs.columns])
