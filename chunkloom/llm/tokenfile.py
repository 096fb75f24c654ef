"""Token-id files: an adaptive context-mixing range coder in independent blocks.

A file is a folder of Parquet parts in ascending document order; each row is a chunk of
whole documents, its bytes in the format below. Ids are any 32-bit numbers.

Chunk, little-endian: magic ``TIC3``, uint32 counts of documents, ids and blocks, uint32
size and zlib stream of int64 document lengths, then the blocks one after another. Document
ids stand in a column of their own.

Block: uint32 ids, uint32 crc32 of these ids as 32-bit numbers, uint32 distinct ids, uint32
bytes of its dictionary, uint32 code words; then the dictionary (its distinct ids ascending,
as differences, byte planes in zlib) and the 32-bit code words. A block holds BLOCK ids (the
last one of a chunk fewer) and can be decoded by itself, as ``read_block`` does: nothing is
carried from one to another.

An id is coded as its place in the block's dictionary, in two symbols: its upper and its
lower half of bits. Each of these steps is predicted by adaptive counts: of what came at
this node of the tree in the whole block (order 0) and after the id before (order 1), and
of how often the id that is told after the two ids before (order 2) came again. The three
distributions are mixed into one, with weights that stand by how much orders 1 and 2 have
seen here and that learn, at every step, from how well each order predicted; the mixture
drives a carryless range coder with 64-bit state and 32-bit words. Counts and weights begin
anew in each block. A symbol's share begins where its orders' counts of lesser symbols, each
by its scale, add up to; all this is in whole numbers (weights learn by IEEE doubles, one
operation at a time), so that any machine mixes alike.

The coder is here twice, with the same bytes: in ``TokenCoder.java``, which Spark's JVM runs
for whole tables, and in numpy, in lock-step with one lane a block, for use without Spark.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch_path, takes_turn
from .jvm import has_compiler, java_function
from .tokens import default_path, encoder

MAGIC = b"TIC3"
BLOCK = 16384
#: Blocks that numpy codes at once, times the width of a symbol. A step costs as much as some
#: 250 of its lanes, so these are to be many.
LANES = 32768
#: Ids of a chunk, whole documents (a longer document is a chunk alone): 16 MB on their way to
#: the JVM.
CHUNK_IDS = 4_000_000
#: Characters of text that a task takes (about, by a sum over all texts).
TASK_CHARS = 32_000_000
END_ID = 2
_HEAD = struct.Struct("<5I")
_ROWS = 1 << 12  # rows of counts of order 1, and ids of order 2, of a lane
_FULL = 250  # a row of the others that has counted so many is halved
_ONE = 1 << 20  # a weight of 1
_RATE, _LEAST_WEIGHT = 21, 2097  # of 1024, of _ONE
U64 = np.uint64
_WORD, _LEAST, _UNIT = U64(32), U64(1 << 32), U64(16)


class Corrupt(ValueError):
    """A chunk or block that doesn't match its checksum or format."""


def _first_weights() -> np.ndarray:
    """Weights of orders 0, 1 and 2 at a block's beginning, by step and by how much orders
    1 and 2 have seen: what has seen more counts for more."""
    seen = np.array([0, 1, 2, 3.5, 6, 11, 24, 80])
    two = np.broadcast_to(np.array([0, 0.35, 0.6, 0.75, 0.85, 0.9, 0.94, 0.97]), (8, 8))
    one = ((1 - two) * (seen / (seen + 6))[:, None] * _ONE).astype(np.int64).reshape(-1)
    two = (two * _ONE).astype(np.int64).reshape(-1)
    return np.tile(np.stack((_ONE - one - two, one, two)), 2)


class _Model:
    """Counts and weights of all lanes, as they stand after the ids so far.

    Order 0 has a row of counts for each node of the tree. Order 1 has a hash table of such
    rows with a tag, of whose row it is; a row that is met with another tag begins anew. Rows
    are summed up: of each symbol the counts of lesser ones, and last all it counted. Order 2
    has a hash table of ids: the one that came after the two ids before, how often it came
    again (a byte; halved when another comes, which takes its place at the end), and a tag.
    """

    def __init__(self, lanes: int, bits: int):
        self.bits, self.width, tree = bits, 1 << bits, 1 + (1 << bits)
        self.zero = np.zeros((lanes * tree, self.width + 1), np.uint16)
        self.rows = np.zeros((lanes * _ROWS, self.width + 1), np.uint8)
        self.tags = np.zeros(lanes * _ROWS, np.uint8)
        self.told = np.zeros(lanes * _ROWS, np.uint32)
        every = np.arange(lanes, dtype=np.int64)
        self.zero_base, self.base = every * tree, every * _ROWS
        steps = np.array([0, 1, 2, 3, 3, 4, 4, 4, *[5] * 8, *[6] * 16, *[7] * 224])
        self.seen1, self.seen2 = steps * 8, steps
        self.weights = np.tile(_first_weights(), lanes)
        self.own = every * 128
        # a count's share of a row, of 65000 << 20; order 0 counts in quarters, from one on
        self.share0 = (65000 << 20) // (4 * np.arange(BLOCK + 1, dtype=np.int64) + self.width)
        self.share1 = np.zeros(256, np.int64)
        self.share1[1:] = (65000 << 20) // np.arange(1, 256)
        self.symbols = np.arange(self.width + 1)
        self.after = np.triu(np.ones((self.width, self.width + 1), np.uint8), 1)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def begin(self, n: int) -> None:
        """An id begins in the first n lanes."""
        self.context = (self.last[:n] + 1) * 0x9E3779B1
        key = (self.context + (self.before[:n] + 1) * 0x85EBCA77) * 0x165667B1
        self.slot = (key >> 15 & (_ROWS - 1)) + self.base[:n]
        told = self.told.take(self.slot)
        self.slot_tag = (key >> 16 & 0xFF000000).astype(np.uint32)
        self.sure = (told >> 16 & 0xFF).astype(np.int64)
        self.sure[(told ^ self.slot_tag) > 0xFFFFFF] = 0
        self.guess = (told & 0xFFFF).astype(np.int64)
        self.trust = self.sure

    def node(self, n: int, node: np.ndarray) -> None:
        """A symbol begins; ``node`` is 0 at the first step, then 1 and the first symbol."""
        second = int(node[0]) > 0
        if second:  # the id that order 2 tells is out if it began otherwise
            self.trust = self.sure * (self.guess >> self.bits == node - 1)
            self.expected = self.guess & (self.width - 1)
        else:
            self.expected = self.guess >> self.bits
        self.zero_at = self.zero_base[:n] + node
        key = (self.context ^ node * 0x2545F491) * 0x27D4EB2F
        self.at = (key >> 15 & (_ROWS - 1)) + self.base[:n]
        tag = (key >> 40 & 0xFF).astype(np.uint8)
        others = np.flatnonzero(self.tags.take(self.at) != tag)
        if len(others):
            self.rows[self.at.take(others)] = 0
            self.tags[self.at.take(others)] = tag.take(others)
        seen = self.rows[self.at, self.width]
        self.kind = self.seen1.take(seen) + self.seen2.take(self.trust) + self.own[:n] + 64 * second
        self.weight = self.weights.take(self.kind, axis=1)
        self.scale = np.empty((3, n), np.int64)
        self.scale[0] = self.weight[0] * self.share0.take(self.zero[self.zero_at, self.width]) >> 12
        self.scale[1] = self.weight[1] * self.share1.take(seen) >> 12
        self.scale[2] = self.weight[2] * (65000 << 8) * (self.trust > 0)

    def begins(self, sym: np.ndarray) -> np.ndarray:
        """Where a symbol's share of 65536 begins in each lane; the width's is the end of all."""
        self.zeros = self.zero[self.zero_at, sym].astype(np.int64) * 4 + sym
        self.ones = self.rows[self.at, sym].astype(np.int64)
        mixed = self.scale[0] * self.zeros + self.scale[1] * self.ones + self.scale[2] * (sym > self.expected)
        return (mixed >> 28) + sym

    def all_begin(self) -> np.ndarray:
        """The same for all symbols, by lane and symbol."""
        mixed = self.zero.take(self.zero_at, axis=0) * np.int64(4) + self.symbols
        mixed *= self.scale[0][:, None]
        mixed += self.rows.take(self.at, axis=0) * self.scale[1][:, None]
        mixed += (self.symbols > self.expected[:, None]) * self.scale[2][:, None]
        mixed >>= 28
        mixed += self.symbols
        return mixed

    def taken(self, n: int, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the share of ``sym``, which came; weights and counts learn it."""
        begin, zeros, ones = self.begins(sym), self.zeros, self.ones
        end = self.begins(sym + 1)
        good0 = (self.scale[0] * (self.zeros - zeros)).astype(np.float64)
        good1 = (self.scale[1] * (self.ones - ones)).astype(np.float64)
        good2 = (self.scale[2] * (self.expected == sym)).astype(np.float64)
        share = _ONE / (good0 + good1 + good2)
        good = np.empty((3, n), np.int64)
        good[1], good[2] = good1 * share, good2 * share
        good[0] = _ONE - good[1] - good[2]
        good -= self.weight
        good *= _RATE
        good >>= 10
        good += self.weight
        self.weights[:, self.kind] = np.maximum(good, _LEAST_WEIGHT)
        more = self.after.take(sym, axis=0)
        self.zero[self.zero_at] += more
        rows = self.rows.take(self.at, axis=0) + more
        for i in np.flatnonzero(rows[:, -1] >= _FULL):
            rows[i, 1:] = np.cumsum(np.diff(rows[i]) >> 1)
        self.rows[self.at] = rows
        return begin.astype(U64), end.astype(U64)

    def end(self, n: int, place: np.ndarray) -> None:
        came = self.guess == place
        sure = np.where(came, np.minimum(self.sure + 1, 255), self.sure >> 1)
        fresh = sure == 0
        sure[fresh] = 1
        told = np.where(fresh, place, self.guess) | sure << 16
        self.told[self.slot] = told.astype(np.uint32) | self.slot_tag
        self.before[:n] = self.last[:n]
        self.last[:n] = place


def _narrow(low, span) -> np.ndarray:
    """Lanes that must put out a word. Where their range spans a word's edge it ends there,
    so that the word is settled; a range is never empty."""
    todo = np.flatnonzero(span < _LEAST)
    if len(todo):
        a, b = low[todo], span[todo]
        span[todo] = np.where((a ^ (a + b)) >> _WORD, (~a + U64(1)) & (_LEAST - U64(1)), b) << _WORD
    return todo


def _bits(distinct: int) -> int:
    """Bits of a symbol, of which two tell so many places."""
    return max(5, (distinct.bit_length() + 1) // 2)


def encode_places(grid: np.ndarray, sizes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Code words of each lane; ``grid`` is places by (step, lane), ``sizes`` don't grow."""
    steps, lanes = grid.shape
    model = _Model(lanes, bits)
    low, span = np.zeros(lanes, U64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U64)
    # room for the most words; pages that none reach are never touched
    out, used = np.zeros((lanes, 2 * steps + 2), np.uint32), np.zeros(lanes, np.int64)
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left")
    for step in range(steps):
        n = alive[step]
        place, lo, sp = grid[step, :n].astype(np.int64), low[:n], span[:n]
        first, second = place >> bits, place & (model.width - 1)
        model.begin(n)
        for node, sym in ((np.zeros(n, np.int64), first), (first + 1, second)):
            model.node(n, node)
            begin, ends = model.taken(n, sym)
            unit = sp >> _UNIT
            np.multiply(unit, ends - begin, out=sp)
            unit *= begin
            lo += unit
            todo = _narrow(lo, sp)
            if len(todo):
                out[todo, used[todo]] = lo[todo] >> _WORD
                lo[todo] <<= _WORD
                used[todo] += 1
        model.end(n, place)
    every = np.arange(lanes)
    for half in (low >> _WORD, low & (_LEAST - U64(1))):
        out[every, used] = half
        used += 1
    return [out[i, : used[i]].astype("<u4") for i in range(lanes)]


def decode_places(words: list[np.ndarray], sizes: np.ndarray, bits: int) -> np.ndarray:
    """The grid (step, lane) again."""
    lanes, steps = len(sizes), int(sizes[0])
    pad = np.zeros(2 * steps + 8, np.uint32)  # a damaged block may read on
    flat = np.concatenate([*words, pad])
    at = np.cumsum([0, *map(len, words)])[:-1].astype(np.int64)
    model = _Model(lanes, bits)
    low, span = np.zeros(lanes, U64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U64)
    code = flat[at].astype(U64) << _WORD | flat[at + 1]
    at += 2
    grid = np.zeros((steps, lanes), np.uint16)
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left")
    for step in range(steps):
        n = alive[step]
        lo, sp, co = low[:n], span[:n], code[:n]
        place = node = np.zeros(n, np.int64)
        model.begin(n)
        for _ in range(2):
            model.node(n, node)
            unit = sp >> _UNIT
            value = ((co - lo) // unit).astype(np.int64)  # below 65536, or the block is damaged
            sym = (model.all_begin()[:, 1:] <= value[:, None]).sum(axis=1, dtype=np.int64)
            np.minimum(sym, model.width - 1, out=sym)
            begin, ends = model.taken(n, sym)
            np.multiply(unit, ends - begin, out=sp)
            unit *= begin
            lo += unit
            todo = _narrow(lo, sp)
            if len(todo):
                lo[todo] <<= _WORD
                co[todo] = co[todo] << _WORD | flat[at[todo]]
                at[todo] += 1
            place, node = place << bits | sym, sym + 1
        model.end(n, place)
        grid[step, :n] = place
    return grid


def write_blocks(ids: np.ndarray) -> Iterator[bytes]:
    """The blocks of ids, in order."""
    parts = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    told = [(known, at.astype(np.uint16)) for known, at in (np.unique(p, return_inverse=True) for p in parts)]
    words: list = [None] * len(parts)
    groups: dict[int, list[int]] = {}
    for i, (known, _) in enumerate(told):
        groups.setdefault(_bits(len(known)), []).append(i)
    for bits, members in groups.items():
        for k in range(0, len(members), LANES >> bits):
            lanes = members[k : k + (LANES >> bits)]  # only the last block of all is smaller
            sizes = np.array([len(parts[i]) for i in lanes])
            grid = np.zeros((int(sizes[0]), len(lanes)), np.uint16)
            for lane, i in enumerate(lanes):
                grid[: len(parts[i]), lane] = told[i][1]
            for i, coded in zip(lanes, encode_places(grid, sizes, bits)):
                words[i] = coded
    for part, (known, _), coded in zip(parts, told, words):
        gaps = np.diff(known.astype(np.int64), prepend=0).astype("<u4")
        known_bytes = zlib.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 6)
        yield _HEAD.pack(len(part), zlib.crc32(part.tobytes()), len(known), len(known_bytes), len(coded)) + known_bytes + coded.tobytes()


def _parsed(data: bytes, at: int) -> tuple[int, int, np.ndarray, np.ndarray, int]:
    """Size, checksum, dictionary and code words of the block at a place, and where it ends."""
    try:
        size, crc, distinct, packed, words = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        end = at + packed + 4 * words
        if not 0 < distinct <= size <= BLOCK or words < 2 or end > len(data):
            raise Corrupt("a block's head is damaged")
        gaps = np.frombuffer(zlib.decompress(data[at : at + packed]), np.uint8)
        if len(gaps) != 4 * distinct:
            raise Corrupt("a block's dictionary is damaged")
    except (zlib.error, struct.error) as e:
        raise Corrupt("a block's head is damaged") from e
    known = np.cumsum(np.ascontiguousarray(gaps.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)).astype("<u4")
    return size, crc, known, np.frombuffer(data[at + packed : end], "<u4"), end


def _decoded(blocks: list[tuple]) -> list[bytes]:
    """Ids of parsed blocks, as bytes; raises Corrupt where a checksum doesn't hold."""
    out: list = [None] * len(blocks)
    groups: dict[int, list[int]] = {}
    for i, (size, _, known, *_) in sorted(enumerate(blocks), key=lambda x: -x[1][0]):
        groups.setdefault(_bits(len(known)), []).append(i)
    for bits, members in groups.items():
        for k in range(0, len(members), LANES >> bits):
            lanes = members[k : k + (LANES >> bits)]
            grid = decode_places([blocks[i][3] for i in lanes], np.array([blocks[i][0] for i in lanes]), bits)
            for lane, i in enumerate(lanes):
                size, crc, known = blocks[i][:3]
                out[i] = known.take(grid[:size, lane], mode="clip").tobytes()
                if zlib.crc32(out[i]) != crc:
                    raise Corrupt(f"block {i} doesn't match its checksum")
    return out


def read_block(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """Ids of the one block at a place, with nothing else read, and where it ends."""
    block = _parsed(data, at)
    return _decoded([block])[0], block[-1]


def write_chunk(docs: list[bytes]) -> bytes:
    """Bytes of a chunk of documents, each its ids as little-endian 32-bit numbers."""
    lengths = np.array([len(x) // 4 for x in docs], "<i8")
    ids = np.frombuffer(b"".join(docs), "<u4")
    packed = zlib.compress(lengths.tobytes(), 6)
    blocks = list(write_blocks(ids))
    return b"".join([MAGIC, struct.pack("<4I", len(docs), len(ids), len(blocks), len(packed)), packed, *blocks])


def read_chunk(data: bytes) -> list[bytes]:
    """The documents of a chunk; raises Corrupt where a checksum doesn't hold."""
    if data[:4] != MAGIC or len(data) < 20:
        raise Corrupt("not a chunk of token ids")
    docs, n, count, packed = struct.unpack_from("<4I", data, 4)
    at = 20 + packed
    try:
        lengths = np.frombuffer(zlib.decompress(data[20:at]), "<i8")
    except (zlib.error, ValueError) as e:
        raise Corrupt("document lengths are damaged") from e
    if len(lengths) != docs or lengths.sum() != n or (lengths < 0).any():
        raise Corrupt("document lengths don't match the ids")
    blocks = []
    for _ in range(count):
        blocks.append(_parsed(data, at))
        at = blocks[-1][-1]
    if at != len(data) or sum(b[0] for b in blocks) != n:
        raise Corrupt("blocks are missing")
    flat = memoryview(b"".join(_decoded(blocks)))
    ends = (np.cumsum(lengths) * 4).tolist()
    return [bytes(flat[a:b]) for a, b in zip([0, *ends], ends)]


def _writer(path: str, end_id: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(path).encode, np.array([end_id], "<u4").tobytes()
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        names: list = []
        count = 0

        def flush() -> pd.DataFrame:
            nonlocal ids, names, count, seq, before
            lengths = np.array([len(x) // 4 for x in ids], "<i8").tobytes()
            row = {"part": part, "seq": seq, "n_ids": count, "before": before, "doc_ids": names, "lengths": lengths, "ids": b"".join(ids)}
            seq, before, ids, names, count = seq + 1, before + count, [], [], 0
            return pd.DataFrame({k: [v] for k, v in row.items()})

        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            first, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= CHUNK_IDS or i == len(texts) - 1:
                    for d, x in zip(pdf["doc_id"].iloc[first : i + 1], encode(texts[first : i + 1])):
                        names.append(None if pd.isna(d) else d)
                        ids.append(x + end)
                        count += len(x) // 4 + 1
                        if count >= CHUNK_IDS:
                            yield flush()
                    first, size = i + 1, 0
        if count:
            yield flush()

    return run


def _write_coded(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of plain ids, coded by numpy."""
    for pdf in batches:
        docs = (np.split(np.frombuffer(x, "<u4"), np.cumsum(np.frombuffer(n, "<i8"))[:-1]) for n, x in zip(pdf.pop("lengths"), pdf.pop("ids")))
        yield pdf.assign(data=[write_chunk([d.tobytes() for d in x]) for x in docs])


def _reader(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of coded chunks, by numpy."""
    takes_turn("token files")
    for pdf in batches:
        for part, before, names, data in zip(pdf["part"], pdf["before"], pdf["doc_ids"], pdf["data"]):
            docs = read_chunk(data)
            sizes = np.array([len(x) // 4 for x in docs], np.int64)
            yield pd.DataFrame({"doc_id": pd.Series(list(names), dtype=object), "part": part, "start": before + np.cumsum(sizes) - sizes, "n_tokens": sizes, "ids_crc32": [zlib.crc32(x) for x in docs]})


def _tasks(docs: DataFrame, text_col: str) -> int:
    """So many that each has some TASK_CHARS characters; of a small table as many as there
    are cores, while each still fills a hundred blocks or so."""
    chars = docs.agg(F.sum(F.length(F.col(text_col)))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return max(-(-chars // TASK_CHARS), min(cores, -(-chars // (TASK_CHARS // 8))), 1)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, in_jvm: bool | None = None) -> None:
    """Write all documents' ids, each with ``end_id`` after it, in ascending id order.

    Null ids come first; rows of one id are in the order of their texts, and may go to
    several tasks; null and empty texts are just ``end_id``; repeated rows are written each.
    Other columns are ignored. Spark's JVM codes, or numpy where ``in_jvm`` is false (by
    default, where the session can't compile Java); files are the same.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # the text's beginning too, so that an id that very many rows have is split
    rows = rows.repartitionByRange(_tasks(docs, text_col), "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    shape = f"part int, seq int, n_ids long, before long, doc_ids array<{kind}>"
    chunks = rows.mapInPandas(_writer(tokenizer or default_path(), end_id), f"{shape}, lengths binary, ids binary")
    if has_compiler(spark) if in_jvm is None else in_jvm:
        code = java_function(spark, "TokenCoder", "Write", "binary")
        chunks = chunks.withColumn("data", code("lengths", "ids", F.lit(BLOCK))).drop("lengths", "ids")
    else:
        chunks = chunks.mapInPandas(_write_coded, f"{shape}, data binary")
    chunks.write.parquet(path)


def read_tokens(spark: SparkSession, path: str, in_jvm: bool | None = None) -> DataFrame:
    """A row for each document of the files: ``doc_id, start, n_tokens, ids_crc32``.

    Fails the job, by an exception named Corrupt, where a block doesn't match its checksum.
    """
    chunks = spark.read.parquet(path)
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row a part file
    offsets = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("ahead"))
    if has_compiler(spark) if in_jvm is None else in_jvm:
        decode = java_function(spark, "TokenCoder", "Read", "array<struct<start:long,ids:binary>>")
        docs = F.arrays_zip("doc_ids", decode("data", F.lit(BLOCK)).alias("held"))
        read = chunks.select("part", "before", F.explode(docs).alias("doc"))
        ids = F.col("doc.held.ids")
        start, size = F.col("before") + F.col("doc.held.start"), (F.octet_length(ids) / 4).cast("long")
        read = read.select(F.col("doc.doc_ids").alias("doc_id"), "part", start.alias("start"), size.alias("n_tokens"), F.crc32(ids).alias("ids_crc32"))
    else:
        read = chunks.select("part", "before", "doc_ids", "data").mapInPandas(_reader, f"doc_id {kind}, part int, start long, n_tokens long, ids_crc32 long")
    return read.join(offsets, "part").select("doc_id", (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, in_jvm: bool | None = None) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read them back."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, id_col, text_col, tokenizer, in_jvm=in_jvm)
    return read_tokens(spark, path, in_jvm)
