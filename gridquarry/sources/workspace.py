"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set
    and the master is local, as in tests: other machines couldn't read it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
        named = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage, so that a lost executor costs one reread and loops don't
    grow their plans; several consumers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that may be broadcast: some 100 MB.
SMALL_ROWS = 2_000_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df``, a table of a few numbers a row, marked for broadcast if it has
    ``rows`` rows at most; otherwise as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` marked to meet the other side of a join in a shuffle, so that
    neither side goes through the driver. For exploded rows and what is
    computed of them: Spark takes their size for that of the rows before."""
    return df.hint("merge")


def with_index(df: DataFrame, *order, name: str = "index") -> DataFrame:
    """``df`` with each row's place, from 0, in the order of the columns.

    Rows are range-sorted over the cluster; only the sizes of the partitions
    come to the driver.
    """
    spark = df.sparkSession
    shared_dir(spark)
    placed = df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).checkpoint()
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    before, offsets = 0, []
    for part in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(part, 0)
    # A row a partition: joined, not written into the plan.
    starts = F.broadcast(spark.createDataFrame(list(enumerate(offsets)), "_part int, _start bigint"))
    return placed.join(starts, "_part").withColumn(name, F.col("_row") + F.col("_start")).drop("_part", "_row", "_start")
