"""Per-field Column functions agree with the staged definitions()."""

from pyspark.sql import functions as F

from schemaloom.functions import ddl as X
from schemaloom.operators import extract as E
from schemaloom.sources import fixture as FX


def test_field_functions_match_definitions(spark):
    corpus = FX.ddl_corpus(spark, "/root/testdata/sf0.001").cache()
    fields = corpus.select(
        "db", "tbl", "v",
        X.table_identity(F.col("ddl")).alias("ident"), X.table_kind(F.col("ddl")).alias("kind"),
        X.definition_shape(F.col("ddl")).alias("shape"), X.like_source(F.col("ddl")).alias("like_table"),
        X.cluster_spec(F.col("ddl"))["clustered"].alias("clustered"),
        X.skew_columns(F.col("ddl")).alias("skewed"), X.skew_values(F.col("ddl")).alias("skewed_on"),
        X.skew_directories(F.col("ddl")).alias("skewed_dirs"), X.options_tail(F.col("ddl")).alias("options_tail"),
        X.ctas_query(F.col("ddl")).alias("as_sql"), X.constraints(F.col("ddl")).alias("constraints"))
    defs = E.definitions(corpus).select(
        "db", "tbl", "v", F.struct(F.col("ident_db").alias("db"), F.col("ident_tbl").alias("tbl")).alias("ident"),
        "kind", "shape", "like_table", "clustered", "skewed", "skewed_on", "skewed_dirs",
        "options_tail", "as_sql", "constraints")
    assert fields.count() == 1500
    assert fields.exceptAll(defs).count() == 0 and defs.exceptAll(fields).count() == 0
