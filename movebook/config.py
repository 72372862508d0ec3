"""Settings from a TOML file: where dumps and the book lie, where the list of dumps is."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Config:
    downloads: str = "data"
    book: str = ""
    list_url: str = ""
    served_book: str = ""
    path: str = field(default="", compare=False)

    @property
    def book_path(self) -> str:
        """The book that everything is folded into; beside the dumps where nothing else is said."""
        return self.book or f"{self.downloads}/known.book"

    @property
    def serving_path(self) -> str:
        return self.served_book or self.book_path

    def manifest_path(self, output: str | None = None) -> str:
        """Beside the book that is written, with a suffix."""
        return (output or self.book_path) + ".sources"


def discovered(start: str | None = None) -> str | None:
    """The nearest config.toml from a folder upwards."""
    at = Path(start or os.getcwd()).resolve()
    return next((str(p / "config.toml") for p in (at, *at.parents) if (p / "config.toml").is_file()), None)


def load(explicit: str | None = None, start: str | None = None) -> Config:
    """From the given file, else the one that MOVEBOOK_CONFIG names, else the nearest config.toml.

    No file at all is an error, and so is a [storage] part without ``downloads``.
    """
    path = explicit or os.environ.get("MOVEBOOK_CONFIG") or discovered(start)
    if not path:
        raise FileNotFoundError("no config.toml")
    with open(path, "rb") as f:
        found = tomllib.load(f)
    storage = found.get("storage")
    if storage is not None and "downloads" not in storage:
        raise ValueError(f"{path}: [storage] needs downloads")
    storage = storage or {"downloads": Config.downloads}
    return Config(storage["downloads"], storage.get("book", ""), found.get("source", {}).get("list_url", ""), found.get("server", {}).get("book", ""), path)
