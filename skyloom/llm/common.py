"""What the corpus operators share: shared folders, stashed tables, small joins and word hashing.

Words are runs of anything but the ASCII white space characters (space, tab to carriage
return). ``bytes.split()`` and ``bytes.lower()`` work on exactly those, and on A-Z only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
U64 = np.uint64
ODD = U64(0x9E3779B97F4A7C15)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "skyloom-shared")
    return root.rstrip("/")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A path nothing has used yet, below the shared folder."""
    return f"{shared_root(spark)}/skyloom/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(pyarrow file system, path) for a URI of the shared folder."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")).cast("long")


#: Rows up to which a keyed table is sent to every executor; beyond it the join is salted.
BROADCAST_ROWS = 50_000
SALTS = 32


def join_small(big: DataFrame, small: DataFrame, keys: list[str], rows: int, how: str = "left") -> DataFrame:
    """Equi-join (nulls equal) with a keyed table of ``rows`` rows: broadcast when few, else salted against hot keys."""
    renamed = small.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    match = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    if rows <= BROADCAST_ROWS:
        joined = big.join(F.broadcast(renamed), match, how)
    else:
        # A hash of the row, not a random number: a task run again deals its rows as before.
        salted = big.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in big.dtypes if "map<" not in kind]), F.lit(SALTS)).cast("int"))
        copies = renamed.withColumn("__s", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        joined = salted.join(copies, [*match, F.col("__salt") == F.col("__s")], how).drop("__salt", "__s")
    return joined.drop(*[f"__k_{k}" for k in keys])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    base = pow(0x9E3779B97F4A7C15, 1, 2**64)
    inverse = pow(base, -1, 2**64)
    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 1 << 17)
            ones = np.full(n, cls.base, U64)
            ones[0] = 1
            cls.up = np.multiply.accumulate(ones)
            ones[1:] = cls.inverse
            cls.down = np.multiply.accumulate(ones)
        return cls.up, cls.down


_BYTE_CODE = mix64(np.arange(1, 257, dtype=U64) * ODD)
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_IS_WHITE[data]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if solid[0]:
        edge = np.concatenate(([0], edge))
    if solid[-1]:
        edge = np.concatenate((edge, [len(data)]))
    return edge[0::2], edge[1::2]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: prefix sums of coded bytes times powers, moved to a common origin."""
    up, down = _Powers.get(len(data) + 1)
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(U64) * ODD)


def word_hashes(data: np.ndarray) -> np.ndarray:
    return span_hashes(data, *word_spans(data))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words, in order."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, U64)
    total = np.zeros(count, U64)
    for k in range(size):
        total = (total ^ words[k : k + count]) * ODD + U64(k + 1)
        total ^= total >> U64(29)
    return mix64(total)


def set_arrow_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the memory of a batch of texts in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
