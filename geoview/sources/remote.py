"""Remote file trees: the interface of a store, and reads through it.

A store lists, reads and writes items by path or id.  Failures of one item do
not end a scan: reads return null bytes and the error after ``retries``.  No store is built in
except a local folder; a client for a remote one implements ``Store``.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

MESH_SUFFIXES = (".glb", ".gltf")
CHUNK_BYTES = 5 << 20


@dataclass(frozen=True)
class Item:
    id: str
    path: str
    is_folder: bool
    size: int


class Store(Protocol):
    def children(self, path: str) -> list[Item]: ...
    def item(self, path: str) -> Item | None: ...
    def read(self, path: str) -> bytes: ...
    def write(self, path: str, data: Iterator[bytes], overwrite: bool) -> bool: ...
    def rename(self, path: str, name: str) -> bool: ...


class FolderStore:
    """A store over a folder that all machines share."""

    def __init__(self, root: str) -> None:
        self.root = Path(root)

    def _item(self, p: Path) -> Item:
        at = str(p.relative_to(self.root))
        return Item(at, at, p.is_dir(), 0 if p.is_dir() else p.stat().st_size)

    def children(self, path: str) -> list[Item]:
        return [self._item(p) for p in sorted((self.root / path).iterdir())]

    def item(self, path: str) -> Item | None:
        p = self.root / path
        return self._item(p) if p.exists() else None

    def read(self, path: str) -> bytes:
        return (self.root / path).read_bytes()

    def write(self, path: str, data: Iterator[bytes], overwrite: bool = False) -> bool:
        p = self.root / path
        if p.exists() and not overwrite:
            return False
        p.parent.mkdir(parents=True, exist_ok=True)
        with p.open("wb") as f:
            for chunk in data:
                f.write(chunk)
        return True

    def rename(self, path: str, name: str) -> bool:
        p = self.root / path
        if not p.exists():
            return False
        os.replace(p, p.with_name(name))
        return True


def exists(store: Store, path: str) -> bool:
    try:
        return store.item(path) is not None
    except Exception:
        return False


def walk(store: Store, path: str = "", depth: int | None = None) -> Iterator[Item]:
    """Items under a path, to a depth."""
    for item in store.children(path):
        yield item
        if item.is_folder and (depth is None or depth > 1):
            yield from walk(store, item.path, None if depth is None else depth - 1)


def upload(store: Store, path: str, data: bytes, overwrite: bool = False, progress: Callable[[int], None] | None = None) -> bool:
    """Writes in chunks; an existing file stays unless ``overwrite``."""

    def parts() -> Iterator[bytes]:
        for at in range(0, len(data), CHUNK_BYTES):
            yield data[at : at + CHUNK_BYTES]
            if progress:
                progress(min(at + CHUNK_BYTES, len(data)))

    return store.write(path, parts(), overwrite)


def read_remote(paths: DataFrame, make_store: Callable[[], Store], path_col: str = "path", retries: int = 3, suffixes: tuple[str, ...] | None = None, default: bytes | None = None) -> DataFrame:
    """(path, content, error) for every path; each task opens its own store.  After
    ``retries`` failures the content is ``default`` and the error says why."""

    def one(store: Store, path: str | None) -> tuple[bytes | None, str | None]:
        error = None
        for _ in range(retries):
            try:
                return store.read(path), None
            except Exception as e:  # whatever a client raises is a failure of this item
                error = f"{type(e).__name__}: {e}"
        return default, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = make_store()
        for b in batches:
            for path in b.column(0).to_pylist():
                if path is not None and suffixes and not path.lower().endswith(suffixes):
                    raise ValueError(f"{path} has none of the endings {suffixes}")
                content, error = one(store, path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["path", "content", "error"])

    return paths.select(path_col).toDF("path").mapInArrow(run, "path string, content binary, error string")
