"""Tables that several queries of a session share, written once in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple[str, str], str | list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerline-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def staged(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` as Parquet in the shared folder: cut off from its lineage, column-pruned when it is read."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _made:
        path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _made[key] = path
    return spark.read.parquet(_made[key])


def staged_list(spark: SparkSession, name: str, make: Callable[[], list[str]]) -> list[str]:
    """``make()``, called once a session: paths of files it wrote in the shared folder."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]
