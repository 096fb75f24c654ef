"""Where a model's files lie on this machine. Nothing is fetched."""

from __future__ import annotations

import os
import re

_ID = re.compile(r"[\w-][\w.-]*(?:/[\w-][\w.-]*)?")


def folder_name(model_id: str) -> str:
    """``org/name`` as one folder's name; ValueError for ids that could leave it."""
    if not _ID.fullmatch(model_id) or ".." in model_id:
        raise ValueError(f"not a model id: {model_id!r}")
    return model_id.replace("/", "--")


def model_id(folder: str) -> str:
    """The id whose folder this is."""
    return folder.replace("--", "/", 1)


def cache_root() -> str:
    """``MODEL_CACHE_DIR``, else the user's cache folder."""
    return os.environ.get("MODEL_CACHE_DIR") or os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache")


def local_model(model: str) -> str | None:
    """The folder of a model that is here and complete (its marker file says so)."""
    folder = os.path.join(cache_root(), folder_name(model))
    return folder if os.path.exists(os.path.join(folder, ".download_complete")) else None
