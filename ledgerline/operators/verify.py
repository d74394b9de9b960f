"""Checkpoints: text files of them, comparison of two runs, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TITLE = "# ledger-checkpoints v1"


def write_checkpoints(rows: DataFrame, path: str, source: str, every: int) -> None:
    """``book_msgs, level_digest, order_hash`` as text, in order; the last one is the final state. One task writes, none collects."""
    last = rows.agg(F.max("book_msgs").alias("last"))
    lines = rows.join(F.broadcast(last), F.lit(True)).select("book_msgs", F.concat_ws(" ", F.when(F.col("book_msgs") == F.col("last"), "final").otherwise("cp"), "book_msgs", "level_digest", "order_hash").alias("value"))  # one row
    head = rows.sparkSession.createDataFrame([(k - 3, x) for k, x in enumerate((TITLE, f"# source {source}", f"# every {every}"))], "book_msgs long, value string")
    head.unionByName(lines).repartition(1).sortWithinPartitions("book_msgs").select("value").write.mode("overwrite").text(path)


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", " ")
    return spark.read.text(path).where("value NOT LIKE '#%'").select((parts[0] == "final").alias("final"), parts[1].cast("long").alias("book_msgs"), parts[2].alias("level_digest"), parts[3].alias("order_hash"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: checkpoints on either side, those that differ, the first of them, and whether all is equal."""
    left, right = a.select("book_msgs", F.struct("level_digest", "order_hash").alias("x")), b.select("book_msgs", F.struct("level_digest", "order_hash").alias("y"))
    both = left.join(right, "book_msgs", "full_outer").withColumn("differs", ~F.col("x").eqNullSafe(F.col("y")))
    wrong = F.count_if("differs")
    return both.agg(F.count("x").alias("left"), F.count("y").alias("right"), wrong.alias("differing"), F.min(F.when(F.col("differs"), F.col("book_msgs"))).alias("first_difference"), (wrong == 0).alias("passed"))
