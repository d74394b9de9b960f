"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows whose texts and results are Python objects at one time.
ROWS = 512
#: Most bytes of a sample that the driver takes.
SAMPLE_BYTES = 32 << 20


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


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own in the shared folder, whatever file system that is on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so a lost executor costs a read and not the whole lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop(spark: SparkSession, *done: DataFrame) -> None:
    """Deletes the files of tables that ``cut`` made, and shuffle files that nothing reads any more: Spark deletes those once
    the objects that stand for them are collected."""
    for df in done:
        remove(spark, df._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    for _ in range(2):  # objects of Python let go of the JVM's a moment later
        gc.collect()
        time.sleep(0.5)
        spark._jvm.System.gc()


def cut_in_loop(df: DataFrame) -> DataFrame:
    """As ``cut``, for tables that are joined round after round.

    A checkpoint keeps the size its plan was estimated at, and a join's estimate is the product of its sides', so within
    a few rounds the estimates alone would fill the driver with numbers of millions of digits. The rows are taken
    over as a table without an estimate; adaptive execution measures the real sizes.
    """
    done, spark = cut(df)._jdf, df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def map_batches(df: DataFrame, each: Callable[..., dict[str, list]], schema: str) -> DataFrame:
    """``each`` gets the columns of an Arrow batch as Python lists and returns the output columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_pydict(each(*(c.to_pylist() for c in part.columns)), schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass")


def sha256(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_texts(df: DataFrame, key: str, column: str, most: int) -> list[str]:
    """The texts of at most ``most`` keys, those with the least hashes; keys are picked before texts are read. Texts that would
    bring the sample over SAMPLE_BYTES are passed over.

    Null keys are left out, a repeated key counts once, a null text is empty.
    """
    size = F.max(F.coalesce(F.octet_length(F.col(column)), F.lit(0)))
    listed = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.xxhash64(key).alias("_h"), size.alias("_n")).orderBy("_h", key).limit(most).collect()
    keys, total = [], 0
    for r in listed:
        if total + r["_n"] <= SAMPLE_BYTES:
            keys.append(r[0])
            total += r["_n"]
    rows = df.where(F.col(key).isin(keys)).groupBy(key).agg(F.max(F.coalesce(F.col(column), F.lit(""))).alias("_text")).orderBy(key)
    return [r["_text"] for r in rows.collect()]
