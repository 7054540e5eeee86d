"""Table migration (M1-M10, K4): move a table to a new definition safely.

Order of steps; whatever stops them, the live name holds a complete table:

0. take the table's lease; while a run holds it, another one is refused;
1. check the new (and the saved) definition by creating it empty in a scratch
   schema (M1), and that its location touches no table involved;
2. back the live table up into a LIKE-twin without a user location (M3/M4);
3. reconcile backup and source (M5/M6): fingerprints, whole rows only to
   explain a difference;
4. build the new table *beside* the live one and load it through the user
   SELECT (M7);
5. verify the load against the SELECT itself; where files of the sources
   changed meanwhile, rows that came late are found by a hash tree and loaded
   too, until the two agree;
6. swap names with two renames (M8). Between them the files of the renamed
   table are compared with those verified: if some came in, the first rename
   is undone and step 5 goes on. Writers that commit under the old folder
   after that are beyond what renames can see;
7. drop the old table and the backup (M9).

Working tables carry the run's own suffix. A step that fails drops what the
run made and returns a result row with the full error. A run that is killed
leaves its working tables and its lease, whose properties tell the stages it
came to; when the lease has run out (or ``recover`` breaks it), the next run
finishes or undoes it from the tables that exist: the renames happen only
after verification, so a live name beside an old one means the swap was done,
and an old one alone that it must be undone.

Names are always spliced at the position the grammar found, never by
replacing text. Data moves only through Spark SQL / DataFrame writes.
"""

from __future__ import annotations

import posixpath
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..sources.catalog import scan_query, scan_table

RESULT_SCHEMA = T.StructType([
    T.StructField("tbl", T.StringType()), T.StructField("stage", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("n_source", T.LongType()),
    T.StructField("n_backup", T.LongType()), T.StructField("n_new", T.LongType()),
    T.StructField("error", T.StringType())])

STAGES = ["check", "backup", "reconcile", "load", "verify", "swap", "cleanup", "done"]

_TEXT = r"'((?:[^'\\]|\\.|'')*)'"
_LOCATION = re.compile(rf"(?is)\blocation\s+{_TEXT}")
_PATH_OPTION = re.compile(rf"(?is)[(,]\s*['\"`]?path['\"`]?\s*=?\s*{_TEXT}")
_WORK = r"__sl_(new|old|backup)_[0-9a-f]{8}$"

#: Leaves of the hash tree: 16 children a node, four levels below the root.
#: Fixed, so their sums are small enough for a broadcast whatever the tables.
TREE_LEVELS = 4
TREE_BITS = 4
#: Times that late rows are loaded before a run gives up.
CATCH_UPS = 5
#: A lease is renewed at every stage; it must outlast the longest one.
LEASE_SECONDS = 6 * 3600


def _q(name: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in name.split("."))


def _split(ddl: str) -> tuple[re.Match, str, str]:
    """Head match, text through the column list, and the clauses after it."""
    m = re.match(P.TABLE_HEAD, ddl)
    if not m:
        raise ValueError("not a CREATE TABLE statement")
    after = ddl[m.end(2):]
    body = re.match(P.BODY_AFTER, after)
    cut = body.end() if body else 0
    return m, after[:cut], after[cut:]


def with_name(ddl: str, new_name: str, drop_location: bool = True) -> str:
    """M2: the same CREATE TABLE text under ``new_name``. With
    ``drop_location`` a twin never shares the source folder: LOCATION is
    removed from the clauses after the column list, and with it EXTERNAL."""
    m, body, rest = _split(ddl)
    head = ddl[:m.start(2)]
    if drop_location:
        rest = _LOCATION.sub("", rest)
        if (m.group(1) or "").lower() == "external":
            head = ddl[:m.start(1)] + ddl[m.end(1):m.start(2)].lstrip()
    return head + _q(new_name) + body + rest


def ddl_location(ddl: str) -> str | None:
    """The folder a definition names (LOCATION or the path option), if any."""
    rest = _split(ddl)[2]
    m = _LOCATION.search(rest) or _PATH_OPTION.search(rest)
    return m.group(1).replace("''", "'") if m else None


def _folder(location: str) -> tuple[str, str, str]:
    u = urlparse(location)
    return u.scheme or "file", u.netloc, posixpath.normpath("/" + u.path.strip("/")) + "/"


def overlaps(a: str, b: str) -> bool:
    """Is one folder the other, above it or below it?"""
    (sa, na, pa), (sb, nb, pb) = _folder(a), _folder(b)
    return (sa, na) == (sb, nb) and (pa.startswith(pb) or pb.startswith(pa))


def table_location(spark: SparkSession, table: str) -> str | None:
    """Location of a catalog table (None for a view)."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {_q(table)}").where("col_name = 'Location'").collect()
    return rows[0].data_type if rows else None


def sources_read(spark: SparkSession, select_sql: str) -> dict[str, str | None]:
    """What a SELECT reads -> its location if it has one: the relations of the
    analysed plan, those behind views and CTEs and in subqueries too. Names
    carry their catalog unless it is the session's; files read by path are
    named by it."""
    plan = spark.sql(select_sql)._jdf.queryExecution().analyzed()
    nested = plan.subqueriesAll()
    out: dict[str, str | None] = {}
    for p in [plan, *[nested.apply(i) for i in range(nested.size())]]:
        leaves = p.collectLeaves()
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            kind = leaf.getClass().getSimpleName()
            if kind == "DataSourceV2Relation":
                out[leaf.name()] = leaf.table().properties().get("location")
                continue
            known = leaf.catalogTable() if kind == "LogicalRelation" else None
            if kind == "HiveTableRelation" or (known is not None and known.isDefined()):
                meta = leaf.tableMeta() if kind == "HiveTableRelation" else known.get()
                uri = meta.storage().locationUri()
                name = meta.identifier().unquotedString().removeprefix("spark_catalog.")
                out[name] = uri.get().toString() if uri.isDefined() else None
            elif kind == "LogicalRelation" and hasattr(leaf.relation(), "location"):
                try:
                    roots = leaf.relation().location().rootPaths()
                except Exception:  # noqa: BLE001 - a relation without files
                    continue
                out |= {x: x for x in (roots.apply(i).toString() for i in range(roots.size()))}
    return out


def tables_read(spark: SparkSession, select_sql: str) -> list[str]:
    """Names of what a SELECT reads."""
    return sorted(sources_read(spark, select_sql))


def files_of(spark: SparkSession, table: str) -> tuple:
    """Number, rows and a hash of the files (name, size) that a table has now;
    no column is read. Tables without files: rows and a hash of their rows."""
    spark.catalog.refreshTable(_q(table))
    df = spark.table(_q(table))
    try:
        files = df.groupBy("_metadata.file_name", "_metadata.file_size").agg(
            F.count(F.lit(1)).alias("n"))
    except AnalysisException:
        return tuple(_signed_sums(df, df.limit(0)).first())
    return tuple(files.agg(F.count(F.lit(1)), F.sum("n"), F.sum(
        F.xxhash64("file_name", "file_size").cast("decimal(38,0)"))).first())


def check_definition(spark: SparkSession, ddl: str, scratch_db: str) -> str | None:
    """M1: can ``ddl`` be created? Creates it empty under a scratch name in
    ``scratch_db`` and always drops it. Returns the error text or None."""
    name = f"{scratch_db}.check_{uuid.uuid4().hex[:10]}"
    try:
        spark.sql(with_name(ddl, name))
        return None
    except Exception as e:  # noqa: BLE001 - reported to the caller
        return str(e) or type(e).__name__
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {_q(name)}")


def create_backup(spark: SparkSession, table: str, backup: str) -> None:
    """M3: empty twin (schema, partitioning, format) with no user location."""
    spark.sql(f"CREATE TABLE {_q(backup)} LIKE {_q(table)}")


def insert_into(spark: SparkSession, df: DataFrame, table: str) -> None:
    """K4: append ``df`` into an existing table matching columns BY NAME,
    after checking that the column sets agree."""
    target = [f.name.lower() for f in spark.table(table).schema.fields]
    source = [c.lower() for c in df.columns]
    if sorted(target) != sorted(source):
        raise ValueError(f"columns differ: source {source} target {target}")
    view = f"_sl_src_{uuid.uuid4().hex[:10]}"
    df.createOrReplaceTempView(view)
    try:
        spark.sql(f"INSERT INTO {_q(table)} BY NAME SELECT * FROM {view}")
    finally:
        spark.catalog.dropTempView(view)


def backup_copy(spark: SparkSession, table: str, backup: str) -> None:
    """M4: full copy of the live table into the backup."""
    insert_into(spark, scan_table(spark, table), backup)


def reconcile_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """M5: n_source, n_backup, equal — one aggregate over both inputs."""
    u = a.select(F.lit(1).alias("_s")).unionByName(b.select(F.lit(2).alias("_s")))
    return u.agg(F.count(F.when(F.col("_s") == 1, 1)).alias("n_source"),
                 F.count(F.when(F.col("_s") == 2, 1)).alias("n_backup")
                 ).withColumn("equal", F.col("n_source") == F.col("n_backup"))


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _has_map(t.elementType)
    if isinstance(t, T.StructType):
        return any(_has_map(f.dataType) for f in t.fields)
    return isinstance(t, T.MapType)


def _canonical(c: Column, t: T.DataType) -> Column:
    """The value without maps: their entries as an array sorted by key."""
    if not _has_map(t):
        return c
    if isinstance(t, T.MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(
            e["key"].alias("key"), _canonical(e["value"], t.valueType).alias("value"))))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _canonical(x, t.elementType))
    return F.when(c.isNotNull(), F.struct(*[_canonical(c[f.name], f.dataType).alias(f.name)
                                            for f in t.fields]))


def _comparable(df: DataFrame) -> list[Column]:
    """Columns usable as grouping and hashing keys."""
    return [_canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]


def _hashed(df: DataFrame, cols: list[str], sign: int) -> DataFrame:
    """The rows with _h1, _h2 (independent hashes), _leaf and _s (sign)."""
    own = df.select(*[F.col(f"`{c}`") for c in cols])
    keys = _comparable(own)
    return own.select("*", *[F.xxhash64(F.lit(seed), *keys).alias(f"_h{seed}") for seed in (1, 2)],
                      F.lit(sign).alias("_s")).withColumn(
        "_leaf", F.pmod("_h1", F.lit(1 << TREE_BITS * TREE_LEVELS)).cast("int"))


def _sums() -> list[Column]:
    return [F.sum("_s").alias("n"), *[
        F.sum(F.col(h).cast("decimal(38,0)") * F.col("_s")).alias(h.strip("_")) for h in ("_h1", "_h2")]]


def _signed_sums(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """n, h1, h2: count and sums of row hashes of ``a`` less those of ``b``."""
    cols = a.columns
    both = _hashed(a, cols, 1).unionByName(_hashed(b, cols, -1)).select("_s", "_h1", "_h2", *by)
    return both.groupBy(*by).agg(*_sums())


def hash_tree(a: DataFrame, b: DataFrame) -> DataFrame:
    """level, bucket, n, h1, h2: the buckets in which two tables differ, by
    level, root (0) first. Every task passes on one row a leaf at most."""
    top = TREE_BITS * TREE_LEVELS
    leaves = _signed_sums(a, b, "_leaf")
    nodes = leaves.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("level"),
                 F.shiftright("_leaf", top - TREE_BITS * k).alias("bucket"))
        for k in range(TREE_LEVELS + 1)])).alias("at"), "n", "h1", "h2")
    return (nodes.groupBy("at.level", "at.bucket")
            .agg(*[F.sum(c).alias(c) for c in ("n", "h1", "h2")]).where("n <> 0 OR h1 <> 0 OR h2 <> 0"))


def rows_apart(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of both sides in leaves of the hash tree that differ, with _s
    (1: of ``a``, -1: of ``b``). Only these are shuffled by what follows."""
    cols = a.columns
    apart = (_signed_sums(a, b, "_leaf").where("n <> 0 OR h1 <> 0 OR h2 <> 0").select("_leaf"))
    return (_hashed(a, cols, 1).unionByName(_hashed(b, cols, -1))
            .join(F.broadcast(apart), "_leaf", "left_semi"))  # one row a leaf


def reconcile_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """M6: n_missing (rows of ``a`` not in ``b``) and n_extra, as multisets.

    Sums of row hashes say which leaves of a hash tree differ; only rows in
    these are grouped, by the whole row with a +1/-1 count: copies of one row
    collapse in the map-side partial aggregate, so a hot row is never one big
    task. Where nothing differs, no row is shuffled."""
    near = rows_apart(a, b)
    keys = _comparable(near.select(*a.columns))
    d = near.select(*keys, "_s").groupBy(*a.columns).agg(F.sum("_s").alias("_d"))
    return d.agg(
        F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(0)).cast("bigint").alias("n_missing"),
        F.coalesce(F.sum(F.when(F.col("_d") < 0, -F.col("_d"))), F.lit(0)).cast("bigint").alias("n_extra"))


def rows_missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that ``b`` lacks, each as often as it lacks it."""
    row = F.struct(*[F.col(f"`{c}`") for c in a.columns])
    d = rows_apart(a, b).groupBy("_h1", "_h2").agg(
        F.sum("_s").cast("int").alias("_d"),
        F.first(F.when(F.col("_s") == 1, row), ignorenulls=True).alias("_r"))
    return d.where("_d > 0").select(F.explode(F.array_repeat("_r", F.col("_d"))).alias("_r")).select("_r.*")


def reconcile_fingerprint(a: DataFrame, b: DataFrame) -> DataFrame:
    """n_a, n_b, equal in one pass without a shuffle of rows: counts and
    order-free sums of two independent 64-bit row hashes of both sides."""
    cols = a.columns

    def tagged(df: DataFrame, tag: int) -> DataFrame:
        own = _comparable(df.select(*cols))
        return df.select(F.lit(tag).alias("_s"), *[
            F.xxhash64(F.lit(seed), *own).cast("decimal(38,0)").alias(f"_h{seed}") for seed in (1, 2)])
    u = tagged(a, 1).unionByName(tagged(b, 2))
    side = lambda t, c: F.when(F.col("_s") == t, c)
    out = u.agg(F.count(side(1, 1)).alias("n_a"), F.count(side(2, 1)).alias("n_b"),
                *[F.sum(side(t, F.col(f"_h{h}"))).alias(f"h{h}_{t}") for h in (1, 2) for t in (1, 2)])
    return out.select("n_a", "n_b", (
        (F.col("n_a") == F.col("n_b")) & F.col("h1_1").eqNullSafe(F.col("h1_2"))
        & F.col("h2_1").eqNullSafe(F.col("h2_2"))).alias("equal"))


def reload_source(spark: SparkSession, select_sql: str, target: str) -> DataFrame:
    """The user SELECT cast to the target's columns; a column that either side
    lacks is an error, never dropped."""
    src = scan_query(spark, select_sql)
    schema = {f.name.lower(): f.dataType for f in spark.table(target).schema.fields}
    names = [c.lower() for c in src.columns]
    extra, missing = sorted(set(names) - set(schema)), sorted(set(schema) - set(names))
    if extra or missing or len(set(names)) < len(names):
        raise ValueError(f"the SELECT doesn't fit {target}: not in the table {extra}, "
                         f"not in the SELECT {missing}, given {names}")
    return src.select(*[F.col(f"`{c}`").cast(schema[c.lower()]).alias(c.lower())
                        for c in src.columns])


def reload_select(spark: SparkSession, select_sql: str, target: str) -> DataFrame:
    """M7: load the user SELECT into the target. Returns the loaded target."""
    insert_into(spark, reload_source(spark, select_sql, target), target)
    return spark.table(target)


def swap_in(spark: SparkSession, table: str, new_table: str, old_table: str,
            verified: tuple | None = None) -> bool:
    """M8: put ``new_table`` in service under ``table``; the previous one is
    kept as ``old_table`` until the caller drops it. With ``verified`` (its
    ``files_of`` when the new table was verified) the swap is undone, and False
    returned, if files came in since."""
    spark.sql(f"ALTER TABLE {_q(table)} RENAME TO {_q(old_table)}")
    try:
        done = verified is None or files_of(spark, old_table) == verified
        if done:
            spark.sql(f"ALTER TABLE {_q(new_table)} RENAME TO {_q(table)}")
    except Exception:
        spark.sql(f"ALTER TABLE {_q(old_table)} RENAME TO {_q(table)}")  # undo
        raise
    if not done:
        spark.sql(f"ALTER TABLE {_q(old_table)} RENAME TO {_q(table)}")
    return done


def drop_backup(spark: SparkSession, backup: str) -> None:
    """M9: remove a backup (call only after reconciliation passed)."""
    spark.sql(f"DROP TABLE IF EXISTS {_q(backup)}")


@dataclass
class MigrationResult:
    tbl: str
    stage: str
    status: str
    n_source: int | None = None
    n_backup: int | None = None
    n_new: int | None = None
    error: str | None = None


def working_tables(spark: SparkSession, table: str) -> dict[str, list[str]]:
    """Tables that runs for ``table`` have made and not removed, by kind."""
    pre, _, short = table.rpartition(".")
    where = f" IN {_q(pre)}" if pre else ""
    out: dict[str, list[str]] = {"new": [], "old": [], "backup": []}
    for r in spark.sql(f"SHOW TABLES{where} LIKE '{short}__sl_*'").collect():
        m = re.fullmatch(re.escape(short.lower()) + _WORK, r.tableName.lower())
        if m:
            out[m.group(1)].append(f"{pre}.{r.tableName}" if pre else r.tableName)
    return out


# ---- lease and journal -------------------------------------------------------

def _lease(table: str) -> str:
    return f"{table}__sl_lease"


def journal(spark: SparkSession, table: str) -> dict[str, str]:
    """The lease of a table: run, until (epoch seconds), stage, and at.<stage>
    for every stage the run began. Empty without a lease."""
    try:
        rows = spark.sql(f"SHOW TBLPROPERTIES {_q(_lease(table))}").collect()
    except AnalysisException:
        return {}
    return {r.key.removeprefix("sl."): r.value for r in rows if r.key.startswith("sl.")}


def _held(entry: dict[str, str]) -> bool:
    return float(entry.get("until", 0)) > time.time()


def take_lease(spark: SparkSession, table: str, run: str,
               seconds: float = LEASE_SECONDS) -> dict[str, str]:
    """Take the table's lease for ``run``; returns the entry of whoever holds it
    now. A lease is a table: the catalog lets one run only create it, or rename
    one that has run out."""
    for _ in range(3):
        try:
            spark.sql(f"CREATE TABLE {_q(_lease(table))} (run STRING) USING parquet TBLPROPERTIES "
                      f"('sl.run'='{run}', 'sl.until'='{time.time() + seconds}')")
            return journal(spark, table)
        except AnalysisException:
            entry = journal(spark, table)
            if not entry and spark.catalog.tableExists(_q(_lease(table))):
                raise
            if entry and _held(entry):
                return entry
            if entry:
                _drop_lease(spark, table, entry["run"])
    return journal(spark, table)


def _drop_lease(spark: SparkSession, table: str, run: str) -> None:
    """Remove the lease of ``run``, not one that another run took meanwhile."""
    gone = f"{table}__sl_gone_{uuid.uuid4().hex[:8]}"
    try:
        spark.sql(f"ALTER TABLE {_q(_lease(table))} RENAME TO {_q(gone)}")
    except AnalysisException:
        return  # another run was faster
    own = spark.sql(f"SHOW TBLPROPERTIES {_q(gone)} ('sl.run')").first().value == run
    spark.sql(f"DROP TABLE {_q(gone)}" if own
              else f"ALTER TABLE {_q(gone)} RENAME TO {_q(_lease(table))}")


def recover(spark: SparkSession, table: str, keep_backup: bool = False,
            break_lease: bool = False) -> str:
    """Finish or undo a run that was killed: 'clean', 'undone' (the live name
    was missing and got the old table back) or 'removed' (left-overs dropped).
    While a run holds the table's lease nothing is touched ('held'), unless the
    caller knows that it is dead and breaks it."""
    entry = journal(spark, table)
    if entry and _held(entry) and not break_lease:
        return "held"
    did = _clear(spark, table, keep_backup)
    if entry:
        _drop_lease(spark, table, entry["run"])
    return did


def _clear(spark: SparkSession, table: str, keep_backup: bool = False) -> str:
    left = working_tables(spark, table)
    did = "clean"
    if not spark.catalog.tableExists(table):
        if not left["old"]:
            raise ValueError(f"{table} doesn't exist, nor a table to restore it from")
        spark.sql(f"ALTER TABLE {_q(left['old'].pop())} RENAME TO {_q(table)}")
        did = "undone"
    for name in left["new"] + left["old"] + ([] if keep_backup else left["backup"]):
        spark.sql(f"DROP TABLE IF EXISTS {_q(name)}")
        did = "removed" if did == "clean" else did
    return did


def catch_up(spark: SparkSession, select_sql: str, new_table: str) -> None:
    """Bring a loaded table up to what the SELECT gives now: rows it lacks are
    appended; if it holds others (rows went or changed), it is loaded anew."""
    source, loaded = reload_source(spark, select_sql, new_table), spark.table(new_table)
    if reconcile_content(source, loaded).first().n_extra == 0:
        insert_into(spark, rows_missing(source, loaded), new_table)
    else:
        spark.sql(f"TRUNCATE TABLE {_q(new_table)}")
        reload_select(spark, select_sql, new_table)


def migrate_table(spark: SparkSession, table: str, new_ddl: str, select_sql: str,
                  scratch_db: str, exact: bool = True, keep_backup: bool = False,
                  saved_ddl: str | None = None,
                  on_stage: Callable[[str], None] | None = None,
                  lease_seconds: float = LEASE_SECONDS) -> MigrationResult:
    """Check -> backup -> reconcile -> load -> verify -> swap -> cleanup.

    ``select_sql`` reads the live table by its name; ``saved_ddl``, the last
    saved definition, is checked as well if given. Left-overs of a killed run
    are cleared first. Always returns a result: status 'ok', 'refused' (another
    run holds the lease), 'bad_definition', 'bad_saved_definition',
    'shared_location', 'backup_mismatch', 'load_mismatch' or 'failed', the stage
    it came to, and the full error; on all but 'ok' the live table is as before
    and the run's tables are gone. Rows that come into the sources before the
    swap are in the new table. ``on_stage`` is called when a stage begins.
    """
    pre, _, short = table.rpartition(".")
    run = uuid.uuid4().hex[:8]
    new_t, old_t, backup = (f"{pre}.{short}__sl_{k}_{run}" if pre else f"{short}__sl_{k}_{run}"
                            for k in ("new", "old", "backup"))
    r = MigrationResult(tbl=table, stage="check", status="running")
    leased = False

    def begin(stage: str) -> None:
        r.stage = stage
        if stage != "done":
            spark.sql(f"ALTER TABLE {_q(_lease(table))} SET TBLPROPERTIES ('sl.stage'='{stage}', "
                      f"'sl.at.{stage}'='{time.time():.3f}', "
                      f"'sl.until'='{time.time() + lease_seconds}')")
        if on_stage:
            on_stage(stage)

    def stopped(status: str, error: str) -> MigrationResult:
        r.status, r.error = status, error
        if leased:
            if r.stage not in ("cleanup", "done"):
                _clear(spark, table)
            _drop_lease(spark, table, run)
        return r

    try:
        holder = take_lease(spark, table, run, lease_seconds)
        if holder.get("run") != run:
            return stopped("refused", f"run {holder.get('run')} holds the lease, at stage "
                                      f"{holder.get('stage')}")
        leased = True
        begin("check")
        _clear(spark, table)
        for ddl, status in ((new_ddl, "bad_definition"), (saved_ddl, "bad_saved_definition")):
            err = check_definition(spark, ddl, scratch_db) if ddl is not None else None
            if err is not None:
                return stopped(status, err)
        place = ddl_location(new_ddl)
        if place:
            for t, there in {**sources_read(spark, select_sql),
                             table: table_location(spark, table)}.items():
                if there and overlaps(place, there):
                    return stopped("shared_location", f"location {place} of the new definition and "
                                                      f"{there} of {t} overlap")
        begin("backup")
        create_backup(spark, table, backup)
        backup_copy(spark, table, backup)

        begin("reconcile")
        live, copy = spark.table(table), spark.table(backup)
        same = (reconcile_fingerprint(live, copy).first() if exact else None)
        if exact:
            r.n_source, r.n_backup, equal = same.n_a, same.n_b, same.equal
        else:
            c = reconcile_counts(live, copy).first()
            r.n_source, r.n_backup, equal = c.n_source, c.n_backup, c.equal
        if not equal:
            c = reconcile_content(live, copy).first()
            return stopped("backup_mismatch", f"{c.n_missing} missing, {c.n_extra} extra")

        def files_now() -> dict[str, tuple]:
            return {t: files_of(spark, t) for t in sorted({table, *(
                t for t in tables_read(spark, select_sql) if spark.catalog.tableExists(t))})}
        begin("load")
        before = files_now()
        spark.sql(with_name(new_ddl, new_t, drop_location=False))
        reload_select(spark, select_sql, new_t)

        begin("verify")
        for _ in range(CATCH_UPS + 1):
            now = files_now()
            source, loaded = reload_source(spark, select_sql, new_t), spark.table(new_t)
            same = reconcile_fingerprint(source, loaded).first()
            r.n_new = same.n_b
            if same.equal:
                if r.stage == "verify":
                    begin("swap")
                if swap_in(spark, table, new_t, old_t, now[table]):
                    break
            elif now == before:
                c = reconcile_content(source, loaded).first()
                return stopped("load_mismatch", f"the SELECT has {same.n_a} rows, {same.n_b} were "
                                                f"loaded: {c.n_missing} missing, {c.n_extra} extra")
            else:
                before = now
                catch_up(spark, select_sql, new_t)
        else:
            return stopped("load_mismatch", f"rows kept coming in {CATCH_UPS} times")

        begin("cleanup")
        spark.sql(f"DROP TABLE IF EXISTS {_q(old_t)}")
        if not keep_backup:
            drop_backup(spark, backup)
        begin("done")
        _drop_lease(spark, table, run)
        r.status = "ok"
        return r
    except Exception as e:  # noqa: BLE001 - becomes the result
        return stopped("failed", str(e) or type(e).__name__)


def result_frame(spark: SparkSession, results: list[MigrationResult]) -> DataFrame:
    return spark.createDataFrame([asdict(r) for r in results], RESULT_SCHEMA)
