"""Token counts and sentence vectors, of a local model or its stand-in.

The stand-in counts a quarter of the characters and gives all sentences one vector, so
that similarity never parts them. A model is a local folder with ``tokenizer.json`` and
``onnx/model.onnx`` (or ``model.onnx``); executors never fetch one.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from . import values as V
from .models import local_model
from .text import fallback_tokens


class Embedder:
    """The stand-in."""

    available = False

    def count(self, text: str) -> int:
        return fallback_tokens(text)

    def sentences(self, texts: Sequence[str]) -> np.ndarray:
        return np.full((max(1, len(texts)), V.DIMENSIONS), 1 / np.sqrt(V.DIMENSIONS), np.float32)

    def sentence(self, text: str) -> np.ndarray:
        return self.sentences([text])[0]


class ModelEmbedder(Embedder):
    available = True

    def __init__(self, folder: str):
        import onnxruntime
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.session = onnxruntime.InferenceSession(model_file(folder), providers=["CPUExecutionProvider"])
        self.inputs = {x.name for x in self.session.get_inputs()}

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def sentences(self, texts: Sequence[str]) -> np.ndarray:
        ids = [e.ids for e in self.tokenizer.encode_batch(list(texts))]
        ids = [x if len(x) <= V.MAX_SENTENCE_TOKENS else x[: V.MAX_SENTENCE_TOKENS - 1] + x[-1:] for x in ids]
        if not ids:
            return np.zeros((0, V.DIMENSIONS), np.float32)
        width = max(map(len, ids))
        mask = np.array([[1] * len(x) + [0] * (width - len(x)) for x in ids], np.int64)
        feeds = {"input_ids": np.array([x + [0] * (width - len(x)) for x in ids], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
        states = self.session.run(None, {k: v for k, v in feeds.items() if k in self.inputs})[0]
        weight = mask[:, :, None].astype(np.float32)
        mean = (states * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
        return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def model_file(folder: str) -> str:
    for name in ("onnx/model.onnx", "model.onnx"):
        if os.path.exists(path := os.path.join(folder, name)):
            return path
    raise FileNotFoundError(f"no model.onnx in {folder}")


@lru_cache(maxsize=2)
def embedder(folder: str | None = None) -> Embedder:
    """One to a worker and model: a folder, or the id of one in this machine's model cache;
    None gives the stand-in."""
    if not folder:
        return Embedder()
    if not os.path.isdir(folder) and not (there := local_model(folder)):
        raise FileNotFoundError(f"no folder and no complete model of the cache: {folder}")
    return ModelEmbedder(folder if os.path.isdir(folder) else there)


def release() -> None:
    embedder.cache_clear()


def cosine(a, b) -> float:
    """0.5 where a vector is missing, 0 where one has no length."""
    if a is None or b is None:
        return 0.5
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(np.dot(a, b)) / size if size else 0.0
