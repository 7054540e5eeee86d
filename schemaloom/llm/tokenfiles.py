"""Token-ID files: flat unsigned integers and 64-bit document offsets.

Documents are range-partitioned by id (sampled bounds, so a repeated id is
split too) and sorted inside each partition. Each task encodes its rows and
streams three files: ``.bin`` (token ids, uint16 or uint32, little endian),
``.off`` (int64 offsets of documents in this file, one more than documents)
and ``.doc`` (int64 document ids). The manifest has one row per file set;
prefix sums over it give each file's base, so the global offset of a document
is base + local offset. Readers map the files into memory.
"""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import Powers, chunks, mix, open_folder, saved, texts

SLICE = 2 << 20
CACHE = 1_000_000  # distinct pieces that a worker remembers (about 45 bytes each)
TOGETHER = 2000  # distinct words per call of the library

#: White space, and the endings that byte-level BPE splits off
#: after an apostrophe. The pieces are: an ending with its apostrophe; a run of
#: letters, of numbers, or of other characters, each with one blank before it;
#: white space, of which the last character stands alone before another piece.
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
          0x205F, 0x3000]
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

_LETTER, _NUMBER, _OTHER, _SPACE, _GAP, _UNKNOWN = range(6)
_GAP_CODE = 0x110000  # stands between texts


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point; unassigned ones are unknown."""
    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.array([_UNKNOWN if c == "Cn" else kind.get(c[0], _OTHER) for c in
                    map(unicodedata.category, map(chr, range(_GAP_CODE)))] + [_GAP], np.uint8)
    out[SPACES] = _SPACE
    return out


class Pieces:
    """Pieces of many texts as flat arrays: start, end (places in ``code``),
    text, 64-bit hash; ``unknown``: texts with unassigned code points."""

    def __init__(self, values: list[str]):
        size = np.array([len(v) for v in values], np.int64)
        code = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.insert(code, np.cumsum(size), _GAP_CODE)
        code = np.concatenate([code, np.full(3, _GAP_CODE, np.uint32)])
        kind = _classes()[code]
        odd = kind == _UNKNOWN
        text = np.cumsum(kind == _GAP)
        self.unknown = np.unique(text[odd])
        kind[odd] = _OTHER

        first = np.concatenate([[True], kind[1:] != kind[:-1]])
        after = np.flatnonzero(first & (kind < _SPACE))
        after = after[after > 0]
        after = after[kind[after - 1] == _SPACE]
        first[after - 1] = True
        first[after] = code[after - 1] != 32
        mark = np.flatnonzero((code == 39) & first)
        mark = mark[kind[mark + 1] == _LETTER]
        for ending in ENDINGS:
            own = mark
            for j, c in enumerate(ending, 1):
                own = own[code[own + j] == ord(c)]
            first[own + 1] = False
            first[own + 1 + len(ending)] = True

        start = np.flatnonzero(first)
        end = np.append(start[1:], len(code))
        own = kind[start] != _GAP
        self.code, self.start, self.end = code, start[own], end[own]
        self.text = text[self.start]
        up, down = Powers.upto(len(code) + 1)
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])

    def pieces(self, at: np.ndarray) -> list[str]:
        """The pieces of these numbers as strings."""
        n = self.end[at] - self.start[at]
        cut = np.cumsum(n)
        code = self.code[np.repeat(self.start[at] - (cut - n), n) + np.arange(n.sum())]
        text = code.tobytes().decode("utf-32-le", "surrogatepass")
        return [text[i:j] for i, j in zip((cut - n).tolist(), cut.tolist())]


class LibraryEncoder:
    """Byte-level BPE of the tokenizers library, each distinct piece once.

    Byte-level BPE merges only inside pieces, so the ids of a text are the ids
    of its pieces in order. Texts with a special token or with code points
    unknown to Python go to the library whole. Pieces are told apart by their
    64-bit hashes; about CACHE of them are remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.number = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.count = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        # pieces of a blank and letters split at the blank in a longer text too
        run = np.array([p[0] == " " and p[1:].isalpha() for p in pieces], bool)
        order = np.concatenate([np.flatnonzero(run), np.flatnonzero(~run)])
        joined = int(run.sum())
        ids, count = [self.flat], [self.count]
        for at in range(0, len(order), TOGETHER):
            part = [pieces[i] for i in order[at:min(at + TOGETHER, joined)].tolist()]
            if part:
                e = self.lib.encode_batch(["".join(part)], add_special_tokens=False)[0]
                word = np.array(e.word_ids, np.int64)
                n = np.bincount(word, minlength=len(part))
                if len(n) == len(part) and (n > 0).all():
                    ids.append(np.array(e.ids, np.uint32))
                    count.append(n)
                else:  # split otherwise by the library: one by one
                    self._each(part, ids, count)
            rest = order[max(at, joined):at + TOGETHER].tolist()
            self._each([pieces[i] for i in rest], ids, count)
        number = np.empty(len(order), np.int64)
        number[order] = len(self.count) + np.arange(len(order))
        place = np.searchsorted(self.keys, keys)  # both are sorted
        self.keys = np.insert(self.keys, place, keys)
        self.number = np.insert(self.number, place, number)
        self.flat, self.count = np.concatenate(ids), np.concatenate(count)
        self.start = np.cumsum(self.count) - self.count

    def _each(self, part: list[str], ids: list, count: list) -> None:
        found = [e.ids for e in self.lib.encode_batch_fast(part, add_special_tokens=False)]
        ids.append(np.array([i for x in found for i in x], np.uint32))
        count.append(np.array([len(x) for x in found], np.int64))

    def encode(self, values: list[str]) -> Iterator[np.ndarray]:
        if len(self.keys) > CACHE:
            self.forget()
        whole = [any(s in v for s in self.special) for v in values]
        p = Pieces(["" if w else v for v, w in zip(values, whole)])
        for i in p.unknown.tolist():
            whole[i] = True
        keys, first, where = np.unique(p.hash, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            self.learn(keys[new], p.pieces(first[new]))
            at = np.searchsorted(self.keys, keys)
        no = self.number[at][where] if len(keys) else where
        n = self.count[no]
        place = np.repeat(self.start[no] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        flat = self.flat[place]
        cut = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(p.text, np.arange(len(values) + 1))]
        for i, value in enumerate(values):
            if whole[i]:
                yield np.array(self.lib.encode(value, add_special_tokens=False).ids, np.uint32)
            else:
                yield flat[cut[i]:cut[i + 1]]

    @classmethod
    @functools.cache
    def of(cls, path: str) -> LibraryEncoder:
        """One per worker process: tasks that follow reuse what it remembers."""
        return cls(path)

    @property
    def dtype(self) -> str:
        return "<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4"


def write(docs: DataFrame, path: str, root: str, end_id: int = 0,
          partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) with the tokenizer file ``path`` and write
    token files below ``root`` in ascending doc_id order; null ids come first,
    repeated ids in order of text size and crc32.

    Null texts are empty; every document ends with ``end_id``. Returns the
    manifest: part, name, dtype, docs, nulls, tokens, base (tokens of all files
    before). Other columns are ignored.
    """
    spark = docs.sparkSession
    open_folder(root, create=True)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, folder = open_folder(root)
        coder = LibraryEncoder.of(path)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        end = np.array([end_id], coder.dtype)
        docs = nulls = tokens = 0
        outs = {}
        for batch in chunks(batches, "text", SLICE):
            if not outs:
                outs = {k: files.open_output_stream(f"{folder}/{name}.{k}")
                        for k in ("bin", "off", "doc")}
                outs["off"].write(np.zeros(1, "<i8").tobytes())
            parts, sizes = [], []
            for ids in coder.encode(texts(batch)):
                parts += [ids.astype(coder.dtype), end]
                sizes.append(len(ids) + 1)
            ends = tokens + np.cumsum(sizes)
            outs["bin"].write(np.concatenate(parts).tobytes())
            outs["off"].write(ends.astype("<i8").tobytes())
            own = batch.column("doc_id").cast(pa.int64())
            outs["doc"].write(own.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            docs, nulls, tokens = docs + len(sizes), nulls + own.null_count, int(ends[-1])
        for out in outs.values():
            out.close()
        if docs:
            yield pa.RecordBatch.from_pylist(
                [{"part": task.partitionId(), "name": name, "dtype": coder.dtype, "docs": docs,
                  "nulls": nulls, "tokens": tokens}],
                schema=pa.schema([("part", pa.int32()), ("name", pa.string()),
                                  ("dtype", pa.string()), ("docs", pa.int64()),
                                  ("nulls", pa.int64()), ("tokens", pa.int64())]))
    order = ["doc_id", "_size", "_crc"]
    ranged = (docs.select("doc_id", "text", F.octet_length("text").alias("_size"),
                          F.crc32(F.encode("text", "UTF-8")).alias("_crc"))
              .repartitionByRange(n, *order).sortWithinPartitions(*order)
              .select("doc_id", "text"))
    parts = saved(ranged.mapInArrow(run, "part int, name string, dtype string, docs long, "
                                         "nulls long, tokens long"), "token_parts")
    # one row per partition: the prefix sums are control data
    rows, base = [], 0
    for r in parts.orderBy("part").collect():
        rows.append((*r, base))
        base += r.tokens
    manifest = spark.createDataFrame(rows, parts.schema.add("base", "long"))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest.parquet")
    return spark.read.schema(manifest.schema).parquet(f"{root}/manifest.parquet")


def _mapped(files: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """The file as an array: mapped if it is local, else read."""
    if isinstance(files, pafs.LocalFileSystem) or path.startswith("/") and files.type_name == "local":
        return np.memmap(path, dtype, "r")
    with files.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype)


def read(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids_crc32 (of
    the ids as little-endian 32-bit integers), ids, from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = open_folder(root)
        for part in (row for batch in batches for row in batch.to_pylist()):
            at = f"{folder}/{part['name']}"
            tokens = _mapped(files, f"{at}.bin", part["dtype"])
            off = _mapped(files, f"{at}.off", "<i8")
            ids = _mapped(files, f"{at}.doc", "<i8")
            i = 0
            while i < part["docs"]:
                to = int(np.searchsorted(off, off[i] + (1 << 19), "right")) - 1
                to = min(max(to, i + 1), part["docs"])
                flat = np.asarray(tokens[off[i]:off[to]]).astype("<u4")
                cut = np.asarray(off[i:to + 1]) - off[i]
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(cut[:-1], cut[1:])]
                missing = np.arange(i, to) < part["nulls"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(ids[i:to]), mask=missing),
                     pa.array(np.asarray(off[i:to]) + part["base"]), pa.array(np.diff(cut)),
                     pa.array(crc, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)),
                                              pa.array(flat.astype(np.int32)))], schema=schema)
                i = to
    manifest = spark.read.parquet(f"{root}/manifest.parquet")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "part").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write below the shared folder and read back."""
    spark = docs.sparkSession
    root = scratch_path(spark, "tokens")
    write(docs, path, root)
    return read(spark, root)
