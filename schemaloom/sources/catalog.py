"""Catalog sources.

Listing a catalog and printing ``SHOW CREATE TABLE`` are metastore calls the
driver has to make; everything after them is distributed. Names are taken and texts written
batch by batch, so the driver never holds more than one batch of definitions.
A text that can't be read is a row with its error: a failed capture is not a
dropped table.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.history import drop_database
from ..sinks.commits import AppendLog

INVENTORY_SCHEMA = T.StructType([
    T.StructField("db", T.StringType()), T.StructField("tbl", T.StringType())])
CAPTURE_SCHEMA = T.StructType([
    T.StructField("db", T.StringType()), T.StructField("tbl", T.StringType()),
    T.StructField("ddl", T.StringType()), T.StructField("error", T.StringType())])

CAPTURED_SCHEMA = T.StructType([*CAPTURE_SCHEMA.fields,
                                T.StructField("captured_at", T.TimestampNTZType())])


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def scan_inventory(spark: SparkSession, exclude: Iterable[str] = ()) -> DataFrame:
    """Every (db, tbl) of the session catalog, views included, session
    temp views excluded; one exclusion list (H8) for every step."""
    out = []
    for (db,) in spark.sql("SHOW DATABASES").collect():
        for r in spark.sql(f"SHOW TABLES IN {_quote(db)}").collect():
            if not r.isTemporary:
                out.append((db, r.tableName.lower()))
    return drop_database(spark.createDataFrame(out, INVENTORY_SCHEMA), exclude)


def _show_create(spark: SparkSession, name: tuple[str, str]) -> tuple[str, str, str | None, str | None]:
    db, tbl = name
    try:
        return db, tbl, spark.sql(f"SHOW CREATE TABLE {_quote(db)}.{_quote(tbl)}").first()[0], None
    except Exception as e:  # noqa: BLE001 - becomes the row's error
        return db, tbl, None, str(e) or type(e).__name__


def capture_definitions(spark: SparkSession, inventory: DataFrame, out_path: str,
                        run_id: str | None = None, batch: int = 1000, threads: int = 8) -> DataFrame:
    """Current DDL text of every table in ``inventory`` (db, tbl).

    Metastore calls run in a small thread pool, ``batch`` tables at a time;
    each batch is written (Parquet, below the run's attempt) before the next is
    begun, and the run is committed last: one that died half-way or is repeated
    under its id adds no row twice.
    Returns db, tbl, ddl, error, captured_at of the run; ddl is NULL where the
    call failed."""
    run_id = run_id or uuid.uuid4().hex
    captured_at = spark.sql("SELECT localtimestamp() AS t").first()[0]
    log = AppendLog(spark, out_path)

    def write(folder: str) -> None:
        names = ((r[0], r[1]) for r in inventory.select("db", "tbl").toLocalIterator())
        with ThreadPoolExecutor(max_workers=threads) as pool:
            while part := list(itertools.islice(names, batch)):
                rows = list(pool.map(lambda n: _show_create(spark, n), part))
                (spark.createDataFrame(rows, CAPTURE_SCHEMA)
                 .withColumn("captured_at", F.lit(captured_at).cast("timestamp_ntz"))
                 .write.mode("append").parquet(folder))
        # a run without a table has a folder, too
        (spark.createDataFrame([], CAPTURED_SCHEMA).write.mode("append").parquet(folder))
    log.append(run_id, write)
    return log.read(CAPTURED_SCHEMA, [run_id])


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    """Whole-table scan."""
    return spark.table(name)


def scan_query(spark: SparkSession, select_sql: str) -> DataFrame:
    """A user SELECT as a source."""
    return spark.sql(select_sql)
