"""Appends that happen once.

Rows of a run are written by attempts, each below its own folder; what counts
is the attempt that the run's manifest names, written last. A run repeated
under its id, an attempt that died half-way or two attempts side by side add no
row twice, and readers go by the manifests alone.

    <root>/data/run_id=<run>/attempt=<id>/…    rows of an attempt
    <root>/manifest/run_id=<run>/              the attempt that counts
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_MANIFEST = "run_id string, attempt string"


class AppendLog:
    """Runs appended to a folder on shared storage."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def committed(self) -> dict[str, str]:
        """Run id -> folder of its rows. One entry a run."""
        try:
            rows = self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifest/*").collect()
        except AnalysisException:
            return {}
        return {r.run_id: f"{self.root}/data/run_id={r.run_id}/attempt={r.attempt}" for r in rows}

    def append(self, run_id: str, write: Callable[[str], None]) -> bool:
        """Let ``write`` fill the folder of a new attempt, then commit it. A run
        that was committed before is left as it is, and False returned."""
        if run_id in self.committed():
            return False
        attempt = uuid.uuid4().hex[:12]
        write(f"{self.root}/data/run_id={run_id}/attempt={attempt}")
        (self.spark.createDataFrame([(run_id, attempt)], _MANIFEST).coalesce(1)
         .write.mode("overwrite").json(f"{self.root}/manifest/run_id={run_id}"))
        return True

    def read(self, schema=None, runs: list[str] | None = None) -> DataFrame:
        """Rows of all committed runs, or of ``runs``, with their run_id."""
        paths = [p for r, p in self.committed().items() if runs is None or r in runs]
        if not paths:
            if schema is None:
                raise ValueError(f"nothing was appended to {self.root}")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.option("basePath", f"{self.root}/data")
        return (reader.schema(schema) if schema is not None else reader).parquet(*paths)
