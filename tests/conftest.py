import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    scratch = tempfile.mkdtemp(prefix="schemaloom-test-")
    s = (SparkSession.builder.master("local[*]")
         .appName("schemaloom-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
         .config("spark.checkpoint.dir", os.path.join(scratch, "checkpoints"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(os.path.join(scratch, "checkpoints"))
    yield s


@pytest.fixture
def corpus_of(spark):
    """Build a corpus DataFrame from (tbl, v, ddl) triples (db 'd')."""
    import datetime as dt

    from pyspark.sql import types as T

    schema = T.StructType([
        T.StructField("db", T.StringType()), T.StructField("tbl", T.StringType()),
        T.StructField("v", T.IntegerType()), T.StructField("vid", T.LongType()),
        T.StructField("captured_at", T.TimestampNTZType()), T.StructField("ddl", T.StringType())])

    def make(rows):
        data = [("d", t, v, i, dt.datetime(2020, 1, 1) + dt.timedelta(days=v), ddl)
                for i, (t, v, ddl) in enumerate(rows)]
        return spark.createDataFrame(data, schema)
    return make
