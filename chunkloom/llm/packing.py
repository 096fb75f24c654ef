"""Packing documents into training sequences by non-negative least squares.

Each task packs blocks of its documents by itself, with no shuffle. A document's full
windows are sequences of their own; what is left of it has a length below the window.
All combinations of two or three such lengths that fill a window exactly are enumerated
(lengths repeat, whatever their number: at most some 350,000 combinations of a window of
2048), their repeat counts are solved against the block's length histogram by non-negative
least squares and rounded to what the histogram holds. The pieces left over are packed
greedily one after another and cut where a window ends; the last window is cut into
powers of two, which need no padding.

The least squares are solved by multiplicative updates, which keep counts non-negative and
never raise the error; they end after STEPS, or when the error falls by less than a
thousandth a step. Rounding decides by the order of the counts, for which that is enough.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE_BITS
from .tokens import default_path, encoder

WINDOW = 2048
END_ID = 1
#: Ids of a block, so that a task's memory is bounded (a longer document is a block alone).
BLOCK_IDS = 4_000_000
STEPS = 60
#: What rounding leaves is solved anew so often before the greedy rest.
ROUNDS = 3
SHAPE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(counts: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to the window, of all lengths that occur."""
    window = len(counts)
    have = np.flatnonzero(counts)
    have = have[have > 0]
    held = counts > 0
    small = have[have * 2 <= window]
    out = [np.stack((small, window - small, np.zeros_like(small)), axis=1)[held[window - small]]]
    for a in have[have * 3 <= window].tolist():
        b = have[np.searchsorted(have, a) : np.searchsorted(have, (window - a) // 2, side="right")]
        c = window - a - b
        fits = held[c]
        out.append(np.stack((np.full(int(fits.sum()), a), b[fits], c[fits]), axis=1))
    return np.concatenate(out)


def repeat_counts(combos: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """x >= 0 that brings the combinations' lengths nearest to the counts (squares),
    by multiplicative updates."""
    goal = counts.astype(np.float64)
    goal[0] = 0
    a, b, c = (np.ascontiguousarray(combos[:, i]) for i in range(3))
    gather = lambda of: of.take(a) + of.take(b) + of.take(c)
    x, up, error = np.ones(len(combos)), gather(goal), np.inf
    for _ in range(STEPS):
        made = sum(np.bincount(part, x, len(counts)) for part in (a, b, c))
        made[0] = 0
        before, error = error, float(((made - goal) ** 2).sum())
        if before - error < 1e-3 * error:
            break
        x *= up / np.maximum(gather(made), 1e-12)
    return x


def rounded(combos: np.ndarray, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whole repeat counts, the largest x first, within what the counts still hold."""
    left, out = counts.copy(), np.zeros(len(combos), np.int64)
    left[0] = len(combos)  # no length is always there
    order = np.argsort(-x, kind="stable")
    for i in range(0, len(order), 2048):
        some = order[i : i + 2048]
        some = some[(left[combos[some]] > 0).all(axis=1)]  # most are used up by then
        for at, (a, b, c), want in zip(some.tolist(), combos[some].tolist(), x[some].tolist()):
            n = max(1, int(want + 0.5))
            need: dict[int, int] = {}
            for k in (a, b, c):
                if k:
                    need[k] = need.get(k, 0) + 1
            n = min(n, *(int(left[k]) // m for k, m in need.items()))
            if n > 0:
                out[at] = n
                for k, m in need.items():
                    left[k] -= m * n
    return out


def plan(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Pieces (document, start, length, sequence, offset) of a block, and how many sequences."""
    full, rest = lengths // window, lengths % window
    doc = np.repeat(np.arange(len(lengths)), full)
    first = np.repeat(np.cumsum(full) - full, full)
    start = (np.arange(len(doc)) - first) * window
    out = [(doc, start, np.full(len(doc), window), np.arange(len(doc)), np.zeros(len(doc), np.int64))]
    sequences = len(doc)
    left = np.flatnonzero(rest)
    order = left[np.argsort(rest[left], kind="stable")]
    counts = np.bincount(rest[left], minlength=window)
    at = (np.cumsum(counts) - counts).tolist()  # the next unused document of each length
    ends = np.cumsum(counts).tolist()
    for _ in range(ROUNDS):
        combos = combinations(counts)
        if not len(combos):
            break
        times = rounded(combos, repeat_counts(combos, counts), counts)
        counts = counts - np.bincount(combos.ravel(), np.repeat(times, 3), window).astype(np.int64)
        counts[0] = 0
        for row, n in zip(combos[times > 0].tolist(), times[times > 0].tolist()):
            offset, ids = 0, np.arange(sequences, sequences + n)
            for k in filter(None, row):
                docs = order[at[k] : at[k] + n]
                at[k] += n
                out.append((docs, full[docs] * window, np.full(n, k), ids, np.full(n, offset)))
                offset += k
            sequences += n
    rest_docs = np.concatenate([np.zeros(0, np.int64), *(order[a:e] for a, e in zip(at, ends) if a < e)])
    if len(rest_docs):
        size = rest[rest_docs]
        begin = np.cumsum(size) - size
        total = int(size.sum())
        bounds = list(range(window, total, window))
        tail = total - (bounds[-1] if bounds else 0)
        edge = total - tail
        for bit in range(tail.bit_length() - 1, -1, -1):
            if tail >> bit & 1:
                edge += 1 << bit
                bounds.append(edge)
        edges = np.array(sorted({0, *bounds, total}))
        # every piece is cut at the edges inside it
        cuts = np.unique(np.concatenate((begin, edges[:-1])))
        owner = np.searchsorted(begin, cuts, side="right") - 1
        seq = np.searchsorted(edges, cuts, side="right") - 1
        stop = np.append(cuts[1:], total)
        out.append((rest_docs[owner], full[rest_docs[owner]] * window + cuts - begin[owner], stop - cuts, sequences + seq, cuts - edges[seq]))
        sequences += len(edges) - 1
    return (*(np.concatenate([np.asarray(x[i], np.int64) for x in out]) for i in range(5)), sequences)


def _packer(path: str, window: int, end_id: int, ordered: bool):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode
        end = np.array([end_id], "<u4").tobytes()
        docs: list = []
        places: list = []
        ids: list[bytes] = []
        count, sequence = 0, TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal docs, places, ids, count, sequence
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            doc, start, length, seq, offset, n = plan(lengths, window)
            crc = [zlib.crc32(memoryview(ids[d])[4 * s : 4 * (s + k)]) for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist())]
            order = {"position": np.array(places, np.int64)[doc]} if ordered else {}
            yield pd.DataFrame({"doc_id": pd.Series(docs, dtype=object).take(doc).reset_index(drop=True), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": lengths[doc], "sequence_id": seq + sequence, "offset": offset} | order)
            sequence += n
            docs, places, ids, count = [], [], [], 0

        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            part, size = 0, 0
            for i, t in enumerate(texts):  # a batch of long texts is encoded in parts
                size += len(t)
                if size >= BLOCK_IDS or i == len(texts) - 1:
                    got = encode(texts[part : i + 1])
                    where = pdf["position"].iloc[part : i + 1].tolist() if ordered else [0] * len(got)
                    for d, x, p in zip(pdf["doc_id"].iloc[part : i + 1], got, where):
                        if places and not 0 <= p - places[-1] <= 1 << FILE_BITS - 1:
                            yield from flush()  # another file: elsewhere in the order
                        places.append(p)
                        docs.append(None if pd.isna(d) else d)
                        ids.append(x + end)
                        count += len(x) // 4 + 1
                        if count >= BLOCK_IDS:
                            yield from flush()
                    part, size = i + 1, 0
        if count:
            yield from flush()

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    order_col: str | None = None,
) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and ``end_id``; null and empty texts are just that id. Every
    id lies in one piece; the pieces of a sequence lie without gaps from offset 0.
    Repeated rows and null ids are packed like others; other columns are ignored; an
    empty table gives no rows. Sequence ids are unique over the result and the same in a
    rerun over the same partitions.

    ``order_col`` is a row's place in an order in which partitions hold runs of rows, as
    ``file_order`` gives it: then only rows of one run share a sequence, and the place
    comes as ``position``, by which sequences can be put in that order again.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.col(order_col).alias("position")] if order_col else []))
    shape = f"doc_id {kind}, {SHAPE}" + (", position long" if order_col else "")
    return rows.mapInPandas(_packer(tokenizer or default_path(), window, end_id, bool(order_col)), shape)
