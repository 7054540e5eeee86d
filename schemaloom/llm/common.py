"""Helpers shared by the operators: tables, shared storage, byte-level words."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

WORDS_AT_ONCE = 2 << 20  # bytes of text that one numpy pass takes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts the lineage
    (a lost executor re-reads files) and fixes what several readers see."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def thinned(rows: DataFrame, key: str, h: Column, most: int) -> DataFrame:
    """Rows that may be among the ``most`` smallest ``h`` (a 64-bit hash) of
    their ``key``: about twice as many of each, found by a threshold on the
    hash, so that ranking them needs no large group. Keys with few rows keep
    all. ``rows`` gets the column _h."""
    rows = rows.withColumn("_h", F.pmod(h, F.lit(1 << 40)))
    count = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    limit = (2.0 * most / F.col("_n") + 64 / F.col("_n")) * (1 << 40)
    return rows.join(F.broadcast(count), key).where(F.col("_h") < limit).drop("_n")


def uri_of(path: str) -> str:
    """``path`` as a URI that pyarrow's file systems take."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path.removeprefix("file:")
    return "file://" + path if path.startswith("/") else path


def open_folder(uri: str, create: bool = False) -> tuple[pafs.FileSystem, str]:
    """File system and folder of a shared URI; opened anew in every task."""
    files, folder = pafs.FileSystem.from_uri(uri_of(uri))
    if create:
        files.create_dir(folder, recursive=True)
    return files, folder


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is text ''."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as strings, null as ''."""
    return [x or "" for x in batch.column(name).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], name: str,
           most: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of column ``name``.

    A single longer row is a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(name)
        size = np.frombuffer(
            pa.compute.binary_length(col).fill_null(0).cast(pa.int64()).buffers()[1],
            np.int64, count=batch.num_rows)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def unassigned(words) -> set[str]:
    """Words with code points that Python's Unicode tables don't know; other
    libraries may know them as letters or digits."""
    odd = {c for c in set("".join(words)) if unicodedata.category(c) == "Cn"}
    return {w for w in words if not odd.isdisjoint(w)} if odd else set()


def crc32_text(value: str) -> int:
    return zlib.crc32(value.encode())


# ---- hashing -------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer (xor-shift and multiply), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of words: 0-9, a-z and every byte of a non-ASCII character.
_ALNUM = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
#: Bytes that white space does not separate.
_INK = np.array([c not in (32, 9, 10, 11, 12, 13) for c in range(256)])


class Words:
    """Words of many texts as flat arrays.

    ``start``/``end`` are byte positions in ``data`` (the lower-cased texts),
    ``hash`` a 64-bit hash of each word, ``first`` the number of words before
    each text (len(texts) + 1 entries), ``doc`` the text of each word.
    """

    def __init__(self, values: list[str], spaces: bool = False):
        raw = [v.encode("utf-8", "surrogatepass") for v in values]
        self.data = b"\n".join(raw).translate(_LOWER) + b"\n"
        buf = np.frombuffer(self.data, np.uint8)
        ink = (_INK if spaces else _ALNUM)[buf]
        edge = np.flatnonzero(ink[1:] != ink[:-1]) + 1
        if ink[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]
        ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.first))
        up, down = Powers.upto(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].decode("utf-8", "replace")

    def grams(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-grams inside one text, and their first words."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.full(n, np.uint64(salt * 2 + 1), np.uint64)
        step = 1
        for j in range(k):
            step = step * 0xD1342543DE82EF95 % (1 << 64)
            total += self.hash[j:j + n] * np.uint64(step)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        return mix(total[at]), at
