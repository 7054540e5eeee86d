"""Definition files (S3, S4): folders of DDL text files, one file per saved
definition, read in parallel as whole texts.

Two layouts are understood, both giving db and table from the path:

* ``<root>/<db>/<table>/Last_<dd_MM_yyyy_HH_mm_ss>.hql`` plus a
  ``History/`` folder of older files (the saved-file store);
* ``<root>/db=<db>/tbl=<table>/age=<Last or History>/v=<n>/part-….txt`` as
  written by ``write_definition_files``.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import batched
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_stamp
from ..session import scratch_path
from ..sinks.commits import AppendLog

# db / table / optional History or Last / optional v=<n> / file name
PATH_RE = r"/(?:db=)?([^/=]+)/(?:tbl=)?([^/=]+)/(?:(?:age=)?(History|Last)/)?(?:v=(\d+)/)?([^/]+)$"
STAMP_RE = r"(\d{2}_\d{2}_\d{4}_\d{2}_\d{2}_\d{2})"


def scan_definition_files(spark: SparkSession, root: str, glob: str = "*.hql") -> DataFrame:
    """S3: path, db, tbl, is_history, v, captured_at, ddl — one row per file."""
    return _parsed(spark.read.format("text").option("wholetext", True)
                   .option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root))


def _parsed(files: DataFrame) -> DataFrame:
    return _fields(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("ddl")))


def _fields(raw: DataFrame) -> DataFrame:
    p = F.col("path")
    return raw.select(
        "path",
        F.lower(F.regexp_extract(p, PATH_RE, 1)).alias("db"),
        F.lower(F.regexp_extract(p, PATH_RE, 2)).alias("tbl"),
        (F.regexp_extract(p, PATH_RE, 3) == "History").alias("is_history"),
        F.nullif(F.regexp_extract(p, PATH_RE, 4), F.lit("")).try_cast("int").alias("v"),
        parse_stamp(F.nullif(F.regexp_extract(F.regexp_extract(p, PATH_RE, 5), STAMP_RE, 1),
                             F.lit(""))).alias("captured_at"),
        F.regexp_replace("ddl", r"\s+$", "").alias("ddl"),
    )


class DefinitionFiles:
    """S3 again and again: only files that are new or changed since are read.

    A manifest (an ``AppendLog``) keeps path, size and time of every file that
    was taken. ``pending`` lists the tree and leaves those out, ``texts`` reads
    the rest, ``taken`` commits them once their rows are in use; a scan that
    died before that finds them pending again.
    """

    LISTED = "path string, size long, time timestamp, run_id string, attempt string"

    def __init__(self, spark: SparkSession, root: str, manifest: str, glob: str = "*.hql"):
        self.spark, self.root, self.glob = spark, root, glob
        self.log = AppendLog(spark, manifest)

    def pending(self) -> DataFrame:
        """path, size, time of new and changed files; no content is read. The
        tree is listed by tasks, as it is when this is called."""
        # told to shuffle: a manifest of millions of like paths is a small file
        taken = self.log.read(self.LISTED).drop("run_id", "attempt").hint("merge")
        return list_files(self.spark, self.root, self.glob).join(
            taken, ["path", "size", "time"], "left_anti")

    def texts(self, pending: DataFrame) -> DataFrame:
        """Rows as of ``scan_definition_files``; tasks open the files by their
        paths, none goes by the driver."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return _fields(pending.select("path").repartition(n, "path")
                       .mapInArrow(_read_files, "path string, raw binary")
                       .select("path", F.col("raw").cast("string").alias("ddl")))

    def taken(self, pending: DataFrame, run_id: str) -> bool:
        return self.log.append(run_id, lambda folder: pending.write.parquet(folder))


#: Folders below one that was given which the task lists itself in a round.
FOLDERS_AT_ONCE = 1000


def list_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, size, time of the files below ``root`` whose names match ``glob``:
    those that Spark's file sources would list, which hold all of them at the
    driver. Here tasks list folders, round by round, and store what they find;
    what a round leaves over (a task lists FOLDERS_AT_ONCE folders below each
    that it is given) is spread over the tasks of the next. Times are in
    milliseconds, or coarser where pyarrow's file system gives no more."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = "path string, size long, us long"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    tops = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not tops:
        spark.read.format("binaryFile").load(root)  # says that there is nothing
    files = [(t.getPath().toString(), t.getLen(), t.getModificationTime() * 1000)
             for t in tops if t.isFile() and t.getLen()]
    left = spark.createDataFrame([(t.getPath().toString(),) for t in tops if t.isDirectory()],
                                 "path string")
    rounds = []
    while not rounds or not left.isEmpty():
        rounds.append(scratch_path(spark, "listed"))
        left.repartition(n, "path").mapInArrow(_list_folders, found).write.parquet(rounds[-1])
        left = spark.read.schema(found).parquet(rounds[-1]).where("size IS NULL").select("path")
    rows = spark.read.schema(found).parquet(*rounds).where("size IS NOT NULL")
    name = F.substring_index("path", "/", -1)
    like = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    return (rows.unionByName(spark.createDataFrame(files, found))
            .where(name.rlike(rf"(?s)\A(?:{like})\z") & ~name.rlike(r"\A(?:_[^=]*\z|\.)"))
            .select("path", "size", F.timestamp_micros("us").alias("time")))


def _hidden(name: str) -> bool:
    """Names that Spark passes over when it lists."""
    return (name.startswith(".") or name.endswith("._COPYING_")
            or name.startswith("_") and "=" not in name
            and not name.startswith(("_metadata", "_common_metadata")))


def _listed(folders: Iterable[str]) -> Iterator[tuple[str, int | None, int | None]]:
    """path, size, time of the files below; no size: a folder that was left."""
    for top in folders:
        walk, more = deque([top]), FOLDERS_AT_ONCE
        while walk:
            folder = walk.popleft()
            files, at = _opened(folder)
            for x in files.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
                path = f"{folder.rstrip('/')}/{x.base_name}"
                if _hidden(x.base_name):
                    continue
                if x.type == pafs.FileType.File and x.size:
                    yield path, x.size, (x.mtime_ns or 0) // 1_000_000 * 1000
                elif x.type == pafs.FileType.Directory and more:
                    more -= 1
                    walk.append(path)
                elif x.type == pafs.FileType.Directory:
                    yield path, None, None


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    folders = (path for batch in batches for path in batch.column("path").to_pylist())
    for rows in batched(_listed(folders), 4096):
        path, size, us = zip(*rows)
        yield pa.record_batch([pa.array(path, pa.string()), pa.array(size, pa.int64()),
                               pa.array(us, pa.int64())], ["path", "size", "us"])


def drop_history_paths(df: DataFrame) -> DataFrame:
    """Keep the "last" file of each table only."""
    return df.filter(~F.col("is_history"))


_SAFE = "/=:@!$&'()*+,;~"  # what a URI's path may hold as it is


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a Hadoop path, which is not URL-encoded."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(quote(path, safe=_SAFE))


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path (as a URI), raw of the files of ``path``."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            uris, raw = [], []
            for path in batch.column("path").slice(at, 256).to_pylist():
                files, name = _opened(path)
                with files.open_input_stream(name) as f:
                    raw.append(f.read())
                local = isinstance(files, pafs.LocalFileSystem)
                uris.append(quote(f"file://{name}" if local else path, safe=_SAFE))
            yield pa.record_batch([pa.array(uris, pa.string()), pa.array(raw, pa.binary())],
                                  ["path", "raw"])


_ESCAPED = re.compile("[\x00-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")


def _folder(name: str, value) -> str:
    """The folder of a partition value, spelt as Spark spells it."""
    text = "" if value is None else str(value)
    text = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", text) or "__HIVE_DEFAULT_PARTITION__"
    return f"{name}={text}"


def _write_files(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _opened(root)
        for batch in batches:
            for row in batch.to_pylist():
                text = (row["ddl"] or "").encode() + b"\n"
                folder = "/".join([top, *[_folder(c, row[c]) for c in ("db", "tbl", "age", "v")]])
                files.create_dir(folder, recursive=True)
                name = f"part-{hashlib.sha256(text).hexdigest()[:16]}.txt"
                with files.open_output_stream(f"{folder}/{name}") as f:
                    f.write(text)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])
    return write


def write_definition_files(corpus: DataFrame, root: str, history: int = 1) -> None:
    """The newest definition of every table as a "last" file and up to
    ``history`` versions before it below History. One file per definition is
    what this layout is; the whole history belongs into the corpus table.

    Tasks write the files in place, named by their text: a task that runs again
    writes the same files. No committer renames them one by one at the driver,
    so a job that failed may leave some behind."""
    top = corpus.groupBy("db", "tbl").agg(F.max("v").alias("_top"))
    (corpus.select("db", "tbl", "v", "ddl").join(top, ["db", "tbl"])
     .where(F.col("v") >= F.col("_top") - history)
     .withColumn("age", F.when(F.col("v") == F.col("_top"), "Last").otherwise("History"))
     .select("db", "tbl", "age", "v", "ddl")
     .mapInArrow(_write_files(root), "n long").write.format("noop").mode("overwrite").save())
