"""Figures of stages, observed in the job that runs the query."""

import pytest
from pyspark.sql import functions as F

from quarry.operators.figures import StageFigures


def test_counts_of_a_run(spark, tmp_path):
    figures = StageFigures()
    rows = figures.watch(spark.range(1000).repartition(7), "read")
    kept = figures.watch(rows.where("id % 3 = 0"), "kept")
    both = kept.where("id % 2 = 0").unionByName(kept.where("id % 2 = 1"))  # read in two places, counted once
    met = figures.watch(both.join(spark.range(50).withColumnRenamed("id", "other"), F.col("id") == F.col("other")), "met")
    figures.run(figures.watch(met.groupBy(F.col("id") % 2).count(), "groups"), f"{tmp_path}/out")
    (row,) = figures.row(spark).collect()
    assert row.asDict() | {"elapsed_ms": 0} == {"read": 1000, "kept": 334, "met": 17, "groups": 2, "elapsed_ms": 0} and row["elapsed_ms"] >= 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_empty_and_odd(spark):
    figures = StageFigures()
    none = figures.watch(spark.range(10).where("id < 0"), "a stage's name")
    figures.run(figures.watch(none.join(spark.range(5), "id"), "rows"))
    row = figures.row(spark).drop("elapsed_ms").first().asDict()
    assert list(row) == ["a stage's name", "rows"] and set(row.values()) <= {0, None}
    with pytest.raises(ValueError, match="watched already"):
        figures.watch(none, "rows")
    with pytest.raises(ValueError, match="nothing was run"):
        StageFigures().row(spark)
