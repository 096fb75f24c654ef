"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text accepts exactly the substrings of
that text. A document is parsed greedily into longest matches; the fewer phrases a
language needs, the closer it is. Counts are normalised to bits a letter, phrases times
log2 of the training length.

All of a batch is parsed in lock-step, every language at once. Long texts are cut into
segments that are parsed from the root at the same time; where the parse of the segment
before comes in within a phrase, it is followed on until it stands where the other one
stands, and the counts are set right, so that phrases are those of the whole text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, fresh_name, takes_turn

#: Letters of training text a language, at most.
TRAIN_CHARS = 40_000
#: Characters of a document that train, from its first letter on (all of it is judged).
TRAIN_DOC_CHARS = 8_000
#: Expected documents of the sample a language, before it is cut to TRAIN_CHARS.
TRAIN_DOCS = 64
SEGMENT = 1024
#: Rounds of setting segments right at the same time; what is left goes text by text.
ROUNDS = 4
#: Given where no language can be told.
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """By code point: the lower-case letter, 32 for anything else."""
    out = np.full(0x11000, 32, np.uint32)
    for c in range(len(out)):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: list[np.ndarray] = []


def folded(text: str) -> np.ndarray:
    """Code points of a text, letters in lower case, each run of others one space;
    empty where there is no letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    table = _TABLE[0]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = points >= len(table)
    out = table[np.where(high, 0, points)]
    for i in np.flatnonzero(high):
        if chr(points[i]).isalpha():
            out[i] = points[i]
    blank = out == 32
    if blank.all():
        return out[:0]
    return out[~(blank & np.concatenate(([True], blank[:-1])))]


def suffix_automaton(codes: Sequence[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all substrings; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


class CrossParser:
    """Automata of several languages; ``bits`` counts what a text costs in each.

    All automata lie in one sparse table: a state's transition by a letter is at its base
    plus the letter's code, if ``owner`` there is the state. States lie where their letters
    meet no other's, so that the table has a few places for each transition whatever the
    size of the alphabet. Only roots have a place for every letter; one that the language
    lacks leads back to the root. Letters of no language at all share the last code.
    """

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        texts = [folded(samples[k]) for k in self.langs]
        self.known = np.unique(np.concatenate([*texts, np.zeros(0, np.uint32)]))
        width = len(self.known) + 1
        self.price = np.array([math.log2(max(2, len(t))) for t in texts])
        automata = [suffix_automaton(self.codes(t).tolist()) for t in texts]
        edges = sum(len(moves) for states in automata for moves in states)
        room = 1 << (2 * edges + 16).bit_length()
        roots = len(texts) * width
        self.owner = np.full(roots + room + width, -1, np.int32)
        self.to = np.zeros(len(self.owner), np.int32)
        self.roots = np.zeros(len(texts), np.int32)
        # letters that a language lacks, each a phrase by itself
        self.lacks = np.ones((len(texts), width), bool)
        bases, first = [], 0
        taken = bytearray(len(self.owner))
        for j, states in enumerate(automata):
            base = np.zeros(len(states), np.int64)
            base[0] = j * width
            self.roots[j] = first
            self.owner[j * width : (j + 1) * width] = first
            self.to[j * width : (j + 1) * width] = first
            # states of many transitions first, while there is much room
            place = 0x9E3779B1 * (j + 1)
            for s in sorted(range(1, len(states)), key=lambda s: -len(states[s])):
                letters = list(states[s])
                at = roots + place % room
                while any(taken[at + c] for c in letters):
                    place = place * 6364136223846793005 + 1442695040888963407 & (1 << 63) - 1
                    at = roots + (place >> 20) % room
                for c in letters:
                    taken[at + c] = 1
                base[s] = at
            moves = np.array([(s, c, t) for s, m in enumerate(states) for c, t in m.items()], np.int64).reshape(-1, 3)
            at = base[moves[:, 0]] + moves[:, 1]
            self.owner[at], self.to[at] = moves[:, 0] + first, moves[:, 2] + first
            self.lacks[j, list(states[0])] = False
            bases.append(base)
            first += len(states)
        self.base = np.concatenate([*bases, np.zeros(0, np.int64)]).astype(np.int32)

    def codes(self, points: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, points)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == points if len(self.known) else False, at, len(self.known)).astype(np.int32)

    def _step(self, states: np.ndarray, roots: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a letter leads, and whether a phrase ended before it."""
        at = self.base.take(states)
        at += letters
        ends = self.owner.take(at) != states
        out = self.to.take(at)
        if len(gone := np.flatnonzero(ends)):
            # the root goes on with this letter
            again = roots.reshape(-1).take(gone) if roots.shape == states.shape else np.broadcast_to(roots, states.shape).reshape(-1).take(gone)
            same = letters.reshape(-1).take(gone) if letters.shape == states.shape else np.broadcast_to(letters, states.shape).reshape(-1).take(gone)
            out.reshape(-1)[gone] = self.to.take(self.base.take(again) + same)
        return out, ends

    def phrases(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Phrases (language, text) of texts whose segments, in order, are given: codes, where
        each begins, how long it is, and whose it is."""
        n, langs = len(start), len(self.langs)
        order = np.argsort(-length, kind="stable")
        begin, size = start[order], length[order]
        roots = self.roots[:, None]
        state = np.repeat(roots, n, axis=1)
        count = np.zeros((langs, n), np.int64)
        for step in range(int(size[0])):
            live = int(np.searchsorted(-size, -step, side="left"))
            state[:, :live], ends = self._step(state[:, :live], roots, flat.take(begin[:live] + step)[None])
            count[:, :live] += ends
        final, counts = np.empty_like(state), np.empty_like(count)
        final[:, order], counts[:, order] = state, count
        # parse on from the state that the segment before ends in
        follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        entry = np.repeat(roots, n, axis=1)
        todo = np.ones((langs, len(follows)), bool)
        for rounds in range(ROUNDS):
            at = np.nonzero(todo & (final[:, follows - 1] != entry[:, follows]))
            if not len(at[0]):
                break
            lang, seg = at[0].astype(np.int64), follows[at[1]]
            came = final[lang, seg - 1]
            self._follow(flat, start, length, lang, seg, came, entry, final, counts)
        else:
            self._in_turn(flat, start, length, follows, entry, final, counts)
        phrases = np.zeros((langs, int(owner[-1]) + 1), np.int64)
        last = np.append(owner[1:] != owner[:-1], True)
        open_ends = np.where(last, final != roots, False)
        for j in range(langs):
            phrases[j] = np.bincount(owner, counts[j] + open_ends[j], phrases.shape[1])
        return phrases

    def _follow(self, flat, start, length, lang, seg, came, entry, final, counts) -> None:
        """Parse segments again from the states ``came``, beside the parse from the states
        in ``entry``, until both stand in the same state or the segment ends."""
        a, b = came.astype(np.int32), entry[lang, seg]
        roots = self.roots[lang]
        entry[lang, seg] = came
        more, step = np.zeros(len(seg), np.int64), 0
        live = np.arange(len(seg))
        where, left = start[seg], length[seg]
        while len(live):
            letters = flat.take(where[live] + step)
            a[live], ends = self._step(a[live], roots[live], letters)
            more[live] += ends
            b[live], ends = self._step(b[live], roots[live], letters)
            more[live] -= ends
            step += 1
            over = step >= left[live]
            done = over | (a[live] == b[live])
            if done.any():
                through = live[over]
                final[lang[through], seg[through]] = a[through]
                live = live[~done]
        counts[lang, seg] += more

    def _in_turn(self, flat, start, length, follows, entry, final, counts) -> None:
        """What some rounds leave (texts in which parses never meet): segments in order,
        those of different texts and languages at once."""
        n = len(start)
        heads = np.setdiff1d(np.arange(n), follows)
        nth = np.arange(n) - heads[np.searchsorted(heads, np.arange(n), side="right") - 1]
        order = follows[np.argsort(nth[follows], kind="stable")]
        for segs in np.split(order, np.flatnonzero(np.diff(nth[order])) + 1):
            lang, at = np.nonzero(final[:, segs - 1] != entry[:, segs])
            if len(lang):
                seg = segs[at]
                self._follow(flat, start, length, lang, seg, final[lang, seg - 1], entry, final, counts)

    def bits(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        """Bits a letter of each text (rows) in each language (columns)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        parts = -(-sizes // SEGMENT)
        some = np.flatnonzero(parts)
        out = np.zeros((len(texts), len(self.langs)))
        if not len(some) or not self.langs:
            return out
        sizes, parts = sizes[some], parts[some]
        owner = np.repeat(np.arange(len(some)), parts)
        flat = self.codes(np.concatenate(texts))
        base = np.cumsum(sizes) - sizes
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = base[owner] + nth * SEGMENT
        length = np.minimum(SEGMENT, sizes[owner] - nth * SEGMENT)
        phrases = self.phrases(flat, start, length, owner)
        for j in range(len(self.langs)):
            lacking = np.concatenate(([0], np.cumsum(self.lacks[j].take(flat))))
            phrases[j] += lacking[base + sizes] - lacking[base]
        out[some] = (phrases * self.price[:, None] / sizes).T
        return out


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, str]:
    """Labelled text of every language, at most TRAIN_CHARS letters of each.

    Bounds: of a document the first TRAIN_DOC_CHARS characters from a letter on; documents
    are picked by a hash of their id so that about TRAIN_DOCS of a language come to the
    driver. Languages are counted over all allowed rows, however long their documents are;
    one of which chance picks no letter is learned from one document of it.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_of_id(F.col(id_col)) % 4 != 2))
    begun = F.regexp_extract(F.col(text_col), rf"(?s)\p{{L}}.{{0,{TRAIN_DOC_CHARS - 1}}}", 0)
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("whole"), begun.alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    out: dict[str, str] = {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, TRAIN_DOCS / n))])
    luck = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    got = rows.where(luck < F.try_element_at(share, F.col("lang"))).select("id", "lang", "text").collect()
    for r in sorted(got, key=lambda r: (hashlib.md5(str(r["id"]).encode()).hexdigest(), r["text"])):
        sofar = out.get(r["lang"], "")
        if len(sofar) + len(r["text"]) <= TRAIN_CHARS:
            out[r["lang"]] = f"{sofar} {r['text']}"
    out = {k: v for k, v in out.items() if len(folded(v))}
    if lacking := sorted(counts.keys() - out.keys()):
        rest = rows.where(F.col("lang").isin(lacking) & F.col("whole").rlike(r"\p{L}"))
        for r in rest.groupBy("lang").agg(F.min_by("text", "id").alias("text")).collect():
            out[r["lang"]] = r["text"]
    return {k: v for k, v in out.items() if len(folded(v))}


_parsers: dict[str, CrossParser] = {}


def _parser(samples: dict[str, str]) -> CrossParser:
    takes_turn("langid", _parsers)
    key = hashlib.sha256(repr(sorted(samples.items())).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(samples)
    return _parsers[key]


def predict(samples: dict[str, str], texts: Sequence[str | None], budget: int = 2_000_000) -> tuple[list[str], list[float]]:
    """Language and score of each text; ``budget`` letters are parsed at once."""
    parser = _parser(samples)
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    held, at, size = [], [], 0

    def flush():
        nonlocal held, at, size
        if held:
            bits = parser.bits(held)
            best = bits.argmin(axis=1)
            rest = np.sort(bits, axis=1)
            ratio = rest[:, 0] / rest[:, 1] if bits.shape[1] > 1 else np.zeros(len(held))
            for i, b, r in zip(at, best, ratio):
                langs[i], scores[i] = parser.langs[b], float(1 - r)
        held, at, size = [], [], 0

    for i, t in enumerate(texts):
        points = folded(t) if t else np.zeros(0, np.uint32)
        if not len(points) or not parser.langs:
            continue
        held.append(points)
        at.append(i)
        size += len(points)
        if size >= budget:
            flush()
    flush()
    return langs, scores


def judged(
    docs: DataFrame,
    name: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    samples: dict[str, str] | None = None,
) -> DataFrame:
    """``docs`` with a struct ``name`` of ``lang_pred`` and ``score``; see ``identify``."""
    samples = training_sample(docs, id_col, text_col, lang_col) if samples is None else samples
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # TRAIN_CHARS letters a language

    @F.pandas_udf("lang_pred string, score double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            langs, scores = predict(shared.value, [t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn(name, judge(F.col(f"`{text_col}`")))


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    samples: dict[str, str] | None = None,
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (columns of these names are replaced).

    ``score`` (0 to 1) is one minus the ratio of the best language's bits to the next
    best's; 0 where only one language is known. ``und`` with score 0 is given to null
    and empty texts, to those without a letter, and to all where nothing could be
    learned. Rows, repeated ones too, stay as they are. ``samples`` (language: text)
    replaces the sample drawn from the table. Ties go to the smaller language name.
    """
    name = fresh_name(docs, "judged")
    out = judged(docs, name, id_col, text_col, lang_col, samples)
    taken = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return out.select(*[f"`{c}`" for c in taken], f"{name}.lang_pred", f"{name}.score")
