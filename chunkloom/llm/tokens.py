"""Token ids of whole texts, by a public tokenizer, a word at a time where its kind allows it.

``word_bpe_49k.json`` normalises by NFC, white space to one space and lower case, then
encodes each run of letters, digit or run of marks on its own and drops white space.
No run crosses a space, so the ids of a text are those of its space-separated words in
turn, and a word met before need not be encoded again. Of a word of Latin-1 letters
with stops or commas after it, the two parts are encoded apart, as the tokenizer cuts there
itself; the letters go, in lower case, to its model at once. A file of any other kind, of which
this need not hold, encodes whole texts.
"""

from __future__ import annotations

import gc
import json
import os
from array import array
from collections.abc import Sequence

from .common import takes_turn

#: Words held by a worker (about 200 bytes each). Beyond, words not held are encoded each
#: time; after as many of them the memory starts anew, as the texts have changed.
WORDS_HELD = 700_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """How byte-level tokenizers spell the two UTF-8 bytes of Latin-1 characters: visible
    bytes stand for themselves, the others follow one another from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    spelt = {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return {c: "".join(spelt[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}


class _Words(dict):
    """Ids of words as little-endian 32-bit numbers; a word not held is encoded."""

    def __init__(self, tokenizer, limit: int):
        super().__init__({"": b""})
        self.limit, self.passed = limit, 0
        self.whole, self.model, self.spelt = tokenizer.encode, tokenizer.model.tokenize, byte_letters()

    def __missing__(self, word: str) -> bytes:
        base = word.rstrip(".,")
        plain = base.isascii()
        if not base.isalpha() or not plain and max(base) > "ÿ":
            ids = array("I", self.whole(word, add_special_tokens=False).ids).tobytes()
        elif word == (low := base.lower()):
            # letters are one run, which goes to the model as its bytes are spelt
            ids = array("I", [t.id for t in self.model(low if plain else low.translate(self.spelt))]).tobytes()
        else:
            ids = self[low] + self[word[len(base) :]]
        if len(self) < self.limit:
            self[word] = ids
        else:
            self.passed += 1
        return ids


#: What a file must say for its ids to be those of the words in turn.
_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BY_WORDS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _RUNS}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def by_words(path: str) -> bool:
    """Whether a tokenizer file is of the kind whose texts are encoded word by word."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model = told.get("model") or {}
    plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("ignore_merges")
    return plain and all(told.get(k) == v for k, v in _BY_WORDS.items())


class WordEncoder:
    """Encodes texts to little-endian 32-bit ids, without special tokens added."""

    def __init__(self, path: str, words_held: int = WORDS_HELD):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.words_held = Tokenizer.from_file(path), words_held
        self.held = _Words(self.tokenizer, words_held) if by_words(path) else None

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        out = []
        if self.held is None:
            return [array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and a collection walks all words held
        try:
            for t in texts:
                if self.held.passed > self.words_held:
                    self.held = _Words(self.tokenizer, self.words_held)
                out.append(b"".join(map(self.held.__getitem__, t.replace("\n", " ").split(" "))))
        finally:
            if collects:
                gc.enable()
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder, whose memory serves all its tasks."""
    takes_turn("tokens", _encoders)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
