"""DDL corpus derived from the test tables.

customer = watched table, order = captured version, line item = column.
The base relations (``versions``, ``base_columns``, ``base_part_columns``,
``base_attrs``) follow FIXTURES.md §2; ``ddl_corpus`` renders them into
CREATE TABLE text, varying the spelling by ``vid`` without changing the
meaning. The extraction jobs must get the base rows back from the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import number_within
from ..functions.text import column_line
from ..session import scratch_path

CORPUS_COLUMNS = ["db", "tbl", "v", "vid", "captured_at", "ddl"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per captured version: db, tbl, v, vid, captured_at, status,
    prio, seg, is_like. ``v`` numbers a table's versions by time."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    ver = c.join(o, o.o_custkey == c.c_custkey).select(
        F.concat(F.lit("db_"), F.col("c_nationkey").cast("string")).alias("db"),
        F.concat(F.lit("t_"), F.col("c_custkey").cast("string")).alias("tbl"),
        F.col("o_orderkey").alias("vid"),
        F.col("o_orderdate").alias("captured_at"),
        F.col("o_orderstatus").alias("status"),
        F.substring("o_orderpriority", 1, 1).alias("prio"),
        F.lower("c_mktsegment").alias("seg"),
        (F.col("o_orderkey") % 50 == 7).alias("is_like"),
    )
    return number_within(ver, ["db", "tbl"], ["captured_at", "vid"], out="v")


def base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vid, name, type, comment: first line item per (order, name), without the
    orders that become LIKE texts. Line items are shuffled once, by order: the
    pick, an order's list and the join with its version need no other exchange."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_orderkey") % 50 != 7)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = (
        li.select(F.col("l_orderkey").alias("vid"), "l_linenumber", "l_partkey", "l_suppkey",
                  "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
                  "l_returnflag", "l_linestatus")
        .repartition(n, "vid")
        .groupBy("vid", F.concat(F.lit("c_"), (F.col("l_partkey") % 8).cast("string")).alias("name"))
        # min over the full tie-break = row_number() ... = 1, kept as one row
        .agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                            "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
                            "l_returnflag", "l_linestatus")).alias("f"))
    )
    return firsts.select(
        "vid", "name",
        F.when(F.col("f.l_returnflag") == "A", "DECIMAL(10,2)")
        .when(F.col("f.l_returnflag") == "R", "BIGINT")
        .otherwise("MAP<STRING,INT>").alias("type"),
        F.when(F.col("f.l_linestatus") == "O",
               F.concat(F.lit("open, (q "),
                        F.col("f.l_quantity").cast("int").cast("string"), F.lit(")")))
        .alias("comment"),
    )


def base_part_columns(ver: DataFrame) -> DataFrame:
    """db, tbl, v, pos, name, type, comment."""
    t = ver.filter(~F.col("is_like"))
    null = F.lit(None).cast("string")
    one = t.filter(F.col("prio").isin("1", "2")).select(
        "db", "tbl", "v", F.lit(1).alias("pos"), F.lit("dt").alias("name"),
        F.lit("STRING").alias("type"), F.lit("load day").alias("comment"))
    dt = t.filter(F.col("prio") == "3").select(
        "db", "tbl", "v", F.lit(1).alias("pos"), F.lit("dt").alias("name"),
        F.lit("STRING").alias("type"), null.alias("comment"))
    hr = t.filter(F.col("prio") == "3").select(
        "db", "tbl", "v", F.lit(2).alias("pos"), F.lit("hr").alias("name"),
        F.lit("INT").alias("type"), null.alias("comment"))
    return one.unionByName(dt).unionByName(hr)


def _attr_cols() -> list[Column]:
    vid, like = F.col("vid"), F.col("is_like")
    plain = ~like
    return [
        F.when(F.col("status") == "F", "external").alias("kind"),
        F.when(like, F.concat("db", F.lit(".t_template"))).alias("like_table"),
        F.when(plain & (vid % 4 == 0),
               F.concat(F.lit("CLUSTERED BY (c_0) INTO "), (vid % 16 + 1).cast("string"),
                        F.lit(" BUCKETS"))).alias("clustered"),
        F.when(plain & (vid % 10 == 0), "SKEWED BY (c_1, c_2)").alias("skewed"),
        F.when(plain & (vid % 10 == 0), "ON ((1,2),(3,4))").alias("skewed_on"),
        F.when(plain & (vid % 20 == 0), "STORED AS DIRECTORIES").alias("skewed_dirs"),
        F.when(like, F.concat(F.lit("LOCATION '/wh/"), "db", F.lit("/"), "tbl", F.lit("'")))
        .otherwise(F.concat(
            F.lit("STORED AS "),
            F.when(F.col("status") == "P", "PARQUET").otherwise("ORC"),
            F.lit(" LOCATION '/wh/"), "db", F.lit("/"), "tbl",
            F.lit("' TBLPROPERTIES ('owner'='"), "seg", F.lit("')"))).alias("options_tail"),
    ]


def base_attrs(ver: DataFrame) -> DataFrame:
    return ver.select("db", "tbl", "v", "vid", "captured_at", *_attr_cols())


def ddl_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ddl_corpus(db, tbl, v, vid, captured_at, ddl) rendered from the tables.

    Spelling varies by vid: %3 == 0 lower-case keywords, %2 == 0 no blank
    before '(', %7 == 0 IF NOT EXISTS, %5 == 0 columns in reverse order.
    vid % 6 == 1 adds a table constraint to a non-empty column list.
    """
    ver = versions(spark, sf_dir)
    per_order = base_columns(spark, sf_dir).groupBy("vid").agg(
        F.array_sort(F.collect_list(F.struct("name", "type", "comment"))).alias("cols"))
    v = ver.join(per_order, "vid", "left").select(
        "db", "tbl", "v", "vid", "captured_at", "is_like", "prio", *_attr_cols(), "cols")

    vid = F.col("vid")
    sp = F.when(vid % 2 == 0, F.lit("")).otherwise(F.lit(" "))
    ordered = F.when(vid % 5 == 0, F.reverse("cols")).otherwise(F.col("cols"))
    lines = F.transform(ordered, lambda c: F.concat(
        F.lit("  "), column_line(c["name"], c["type"], c["comment"])))
    lines = F.when((vid % 6 == 1) & (F.size("cols") > 0), F.concat(lines, F.array(F.concat(
        F.lit("  CONSTRAINT pk_"), vid.cast("string"),
        F.lit(" PRIMARY KEY (c_0, c_1) DISABLE NOVALIDATE"))))).otherwise(lines)
    body = F.when(F.size("cols") > 0,
                  F.concat(sp, F.lit("(\n"), F.array_join(lines, ",\n"), F.lit(")")))
    part = (F.when(F.col("prio").isin("1", "2"),
                   F.concat(F.lit("\nPARTITIONED BY"), sp, F.lit("(dt STRING COMMENT 'load day')")))
            .when(F.col("prio") == "3",
                  F.concat(F.lit("\nPARTITIONED BY"), sp, F.lit("(dt STRING, hr INT)"))))
    head = F.concat(
        F.lit("CREATE "), F.when(F.col("kind").isNotNull(), F.lit("EXTERNAL ")).otherwise(F.lit("")),
        F.lit("TABLE "), F.when(vid % 7 == 0, F.lit("IF NOT EXISTS ")).otherwise(F.lit("")),
        F.col("db"), F.lit("."), F.col("tbl"))
    opt = lambda c, pre="\n": F.coalesce(F.concat(F.lit(pre), c), F.lit(""))
    skew = F.concat_ws(" ", "skewed", "skewed_on", "skewed_dirs")
    like_text = F.concat(head, F.lit(" LIKE "), F.col("like_table"), F.lit("\n"), F.col("options_tail"))
    table_text = F.concat(
        head, F.coalesce(body, F.lit("")),
        F.when(F.col("is_like"), F.lit("")).otherwise(F.coalesce(part, F.lit(""))),
        opt(F.col("clustered")),
        opt(F.when(F.col("skewed").isNotNull(), skew)),
        F.lit("\n"), F.col("options_tail"))
    text = F.when(F.col("is_like"), like_text).otherwise(table_text)
    text = F.when(vid % 3 == 0, F.lower(text)).otherwise(text)
    # spread by version already (one table with many versions is split too)
    return v.select("db", "tbl", "v", "vid", "captured_at", text.alias("ddl"))


DEEP_TYPE = "STRUCT<a:STRUCT<b:STRUCT<c:STRUCT<d:STRUCT<e:MAP<STRING,ARRAY<DECIMAL(10,2)>>>>>>>"


def statement_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a statement for every part, by part key % 4: a view, a
    table from a query, a table with deep types and doubled quotes, and (in
    the second version) a text that can't be read. Sizes above 25 change the
    second version."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    k, big = F.col("p_partkey"), (F.col("p_size") > 25) & (F.col("v") == 2)
    name = F.concat(F.lit("s.x_"), k.cast("string"))
    brand = F.lower("p_brand")
    view = F.concat(F.lit("CREATE OR REPLACE VIEW "), name, F.lit(" AS\nSELECT * FROM s.base WHERE brand = '"),
                    brand, F.lit("'"), F.when(big, " AND size > 25").otherwise(""))
    ctas = F.concat(F.lit("CREATE TABLE "), name, F.lit(" USING Parquet OPTIONS ('compression'='"),
                    F.when(big, "gzip").otherwise("snappy"), F.lit("') COMMENT 'it''s "), brand,
                    F.lit("' AS SELECT * FROM s.base WHERE (((1 = 1)))"))
    deep = F.concat(F.lit("CREATE TABLE "), name, F.lit(f" (a {DEEP_TYPE} COMMENT 'it''s "), brand,
                    F.lit("', b INT DEFAULT 5, CHECK (((b > 0)))) STORED AS ORC"))
    bad = F.concat(F.lit("CREATE TABLE "), name, F.when(F.col("v") == 2, " (a INT, b ((INT)")
                   .otherwise(" (a INT)"))
    text = F.when(k % 4 == 0, view).when(k % 4 == 1, ctas).when(k % 4 == 2, deep).otherwise(bad)
    return spread_for_extraction(
        p.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2)))).select(
            F.lit("s").alias("db"), F.concat(F.lit("x_"), k.cast("string")).alias("tbl"), "v",
            (k * 2 + F.col("v")).alias("vid"),
            F.lit("2024-01-01").cast("timestamp_ntz").alias("captured_at"), text.alias("ddl")))


def probe_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a statement for every part, by part key % 8: columns
    called like constraints, names of four parts, partition transforms,
    CLUSTER BY, comments inside structs, SQL comments, text that no clause
    explains, and constraints without a name. Sizes above 25 change the second
    version."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    p = p.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))
    k, big = F.col("p_partkey"), (F.col("p_size") > 25) & (F.col("v") == 2)
    name, brand = F.concat(F.lit("x_"), k.cast("string")), F.lower("p_brand")

    def text(*parts) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    def either(yes: str, no: str = "") -> Column:
        return F.when(big, yes).otherwise(no)
    kinds = [
        text("CREATE TABLE s.", name, " (check ", either("BIGINT", "INT"), ", `unique` STRING COMMENT '",
             brand, "', constraint DATE)"),
        text("CREATE TABLE cat.ns.s.", name, " (id INT", either(", extra INT"), ") USING parquet"),
        text("CREATE TABLE s.", name, " (ts TIMESTAMP, id INT) USING iceberg PARTITIONED BY (days(ts), Bucket(",
             either("32", "16"), ", id), id)"),
        text("CREATE TABLE s.", name, " (a INT, b INT) USING delta CLUSTER BY (", either("b", "a"),
             ") COMMENT '", brand, "'"),
        text("CREATE TABLE s.", name, " (s STRUCT<x: INT COMMENT '", brand, ", (Q'", either(", y: INT"),
             "> COMMENT 'of s', t ARRAY<STRUCT<`A b`: INT>>)"),
        text("-- made by ", brand, "\nCREATE /* it's */ TABLE s.", name, " (a INT, -- the first, (one\n b ",
             either("BIGINT", "INT"), " COMMENT '-- no /* comment') /* end */"),
        text("CREATE TABLE s.", name, either(" SHALLOW CLONE s.base", " (a INT)")),
        text("CREATE TABLE s.", name, " (a INT, ", either("UNIQUE (a)", "CHECK (a > 0)"), ", PRIMARY KEY (a))"),
    ]
    ddl = F.when(k % 8 == 0, kinds[0])
    for i, x in enumerate(kinds[1:], 1):
        ddl = ddl.when(k % 8 == i, x)
    return spread_for_extraction(p.select(
        F.lit("s").alias("db"), name.alias("tbl"), "v", (k * 2 + F.col("v")).alias("vid"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("captured_at"), ddl.alias("ddl")))


def gap_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with texts that can't be read between the others: every
    version whose vid % 5 is 2 or 3 (runs of them too), every first version
    with vid % 11 = 0, and for tables whose number ends in 7 all versions from
    the third on."""
    vid, v = F.col("vid"), F.col("v")
    bad = ((vid % 5).isin(2, 3) | ((v == 1) & (vid % 11 == 0))
           | ((v >= 3) & F.col("tbl").endswith("7")))
    return corpus_table(spark, sf_dir).withColumn(
        "ddl", F.when(bad, F.concat(F.lit("CREATE TABLE "), F.col("db"), F.lit("."), F.col("tbl"),
                                    F.lit(" (c_0 INT, c_1 ((INT"))).otherwise(F.col("ddl")))


# rows of one corpus file: extraction is CPU per byte, and a scan deals whole
# files to its tasks, at most 32 of them (each counts as 4 MB of 128)
TEXTS_AT_ONCE = 10_000
_CORPUS_TABLES: dict[tuple[str, str], str] = {}


def corpus_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered corpus written once per application as a Parquet table in
    the shared scratch folder (it plays the captured, append-only corpus);
    later queries read it instead of re-rendering. Extraction and diffs still
    run from the texts in every query."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    path = _CORPUS_TABLES.get(key)
    if path is None:
        path = scratch_path(spark, "ddl_corpus")
        (ddl_corpus(spark, sf_dir).write.mode("overwrite")
         .option("maxRecordsPerFile", TEXTS_AT_ONCE).parquet(path))
        _CORPUS_TABLES[key] = path
    return spark.read.parquet(path)


def spread_for_extraction(corpus: DataFrame) -> DataFrame:
    """Extraction is CPU per byte, so versions of a corpus rendered from few
    files are spread over all tasks (by version: a table with very many is split
    too), at every size alike."""
    n = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return corpus.repartition(n, "db", "tbl", "v")
