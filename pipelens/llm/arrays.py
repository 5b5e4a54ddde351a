"""Sorted arrays in the shared folder, written by tasks and memory-mapped by
workers. A file is written under a passing name and renamed, so a repeated task
replaces it with the same content. Where the shared folder is not a mounted
file system, a worker fetches the file into its own temporary folder once and
removes it at exit."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyarrow import fs


def _open_root(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def save(root: str, name: str, values: np.ndarray) -> None:
    system, base = _open_root(root)
    system.create_dir(base, recursive=True)
    passing = f"{base}/_{uuid.uuid4().hex}"
    with system.open_output_stream(passing) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    system.move(passing, f"{base}/{name}")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="arrays-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


@lru_cache(maxsize=8192)
def load(root: str, name: str, dtype: str) -> np.ndarray:
    """The array, memory-mapped; empty where no task wrote it."""
    system, base = _open_root(root)
    info = system.get_file_info(f"{base}/{name}")
    if info.type == fs.FileType.NotFound or not info.size:
        return np.zeros(0, dtype)
    path = info.path
    if not isinstance(system, fs.LocalFileSystem):
        path = os.path.join(_own_folder(), f"{uuid.uuid4().hex}-{name}")
        with system.open_input_stream(info.path) as come, open(path, "wb") as out:
            shutil.copyfileobj(come, out)
    return np.memmap(path, dtype, "r")


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` (sorted) in sorted ``keys``, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)
