"""Figures of a query's stages, observed while it runs."""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _rows(seen: Observation) -> int | None:
    """What was observed; an observation that the run plan no longer held has an empty row, which PySpark takes for a failed assertion."""
    try:
        return seen.get["rows"]
    except Py4JJavaError as error:
        if "AssertionError" in str(error.java_exception):
            return None
        raise


class StageFigures:
    """Counts the rows that leave each stage of a query, in the job that runs the query: watch() its stages, run() the last, then read row().

    A stage that the plan reads in several places is counted once. One that Spark leaves out, since what it makes can't matter (the other side of a
    join is empty, say), has no figure: null. Where a lost executor makes Spark run a map task again, its rows may be counted again: figures are for watching, not for results.
    """

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}
        self._elapsed: int | None = None

    def watch(self, df: DataFrame, stage: str) -> DataFrame:
        """df, whose rows are counted under the stage's name; every name is given once."""
        if stage in self._seen:
            raise ValueError(f"stage {stage} is watched already")
        self._seen[stage] = Observation()
        return df.observe(self._seen[stage], F.count(F.lit(1)).alias("rows"))

    def run(self, df: DataFrame, path: str | None = None) -> None:
        """Runs df, the query whose stages were watched: into a Parquet table at path, or for its figures only."""
        begin = time.monotonic()
        if path is None:
            df.write.format("noop").mode("overwrite").save()
        else:
            df.write.parquet(path)
        self._elapsed = round(1000 * (time.monotonic() - begin))

    def row(self, spark: SparkSession) -> DataFrame:
        """One row of the run: a count for each stage, in the order in which they were watched, and the run's elapsed_ms."""
        if self._elapsed is None:
            raise ValueError("nothing was run")
        counts = [_rows(seen) for seen in self._seen.values()]
        names = [*self._seen, "elapsed_ms"]
        return spark.createDataFrame([(*counts, self._elapsed)], ", ".join(f"`{n}` bigint" for n in names))
