"""Arrays in the shared folder: written by tasks, memory-mapped by workers.

A map of a local path is the file itself, of which the system keeps the pages in use. From a remote store a file is copied to
the worker's temporary folder and its name is removed as soon as it is mapped, so that its space is free again when the map
goes; at most ``KEPT`` maps of a worker are held.
"""

from __future__ import annotations

import os
import tempfile
from functools import lru_cache

import numpy as np

from skyloom.llm.common import file_system

KEPT = 512


class Writer:
    """An array written piece by piece; it has its name only once closed, and a task may run twice."""

    def __init__(self, uri: str):
        self.system, self.path = file_system(uri)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.spare = f"{self.path}.{os.getpid()}-{os.urandom(4).hex()}"
        self.out = self.system.open_output_stream(self.spare)

    def write(self, values: np.ndarray) -> None:
        self.out.write(np.ascontiguousarray(values).tobytes())

    def close(self) -> None:
        self.out.close()
        self.system.move(self.spare, self.path)


@lru_cache(maxsize=KEPT)
def mapped(uri: str, kind: str) -> np.ndarray:
    """A read-only map of an array."""
    from pyarrow import fs

    system, path = file_system(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with tempfile.NamedTemporaryFile(prefix="shard-") as held:
        fs.copy_files(path, held.name, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
        return np.memmap(held.name, kind, "r") if os.path.getsize(held.name) else np.zeros(0, kind)
