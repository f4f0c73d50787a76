"""Object tables and image files as sources and sinks."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_objects(objects: DataFrame, path: str) -> None:
    """Write an object table, a folder for each result, sorted by label. Labels
    that a result holds twice are refused."""
    twice = objects.groupBy("result_id", "label").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError("a result holds a label twice")
    objects.repartition("result_id", F.expr("label div 1048576")).sortWithinPartitions("result_id", "label").write.partitionBy("result_id").parquet(path)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def image_files(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """Files as rows (image_id, content), with their size and digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("image_id"), "content", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def encode_images(grid: DataFrame, channel: str) -> DataFrame:
    """Each image as the bytes of an array file (image_id, content); an image
    is the bound of what a task holds."""
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.full((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), np.nan)
        a[pdf["y"], pdf["x"]] = pdf["v"]
        out = io.BytesIO()
        np.save(out, a)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[:1], "content": [out.getvalue()]})

    return grid.select("image_id", "y", "x", F.col(channel).alias("v")).groupBy("image_id").applyInPandas(run, "image_id bigint, content binary")


def decode_images(files: DataFrame) -> DataFrame:
    """Pixels (image_id, y, x, v) of array files; NaN is no pixel."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for image, content in zip(pdf["image_id"], pdf["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                y, x = np.nonzero(~np.isnan(a))
                yield pd.DataFrame({"image_id": image, "y": y, "x": x, "v": a[y, x].astype(float)})

    kind = files.schema["image_id"].dataType.simpleString()
    return files.select("image_id", "content").mapInPandas(run, f"image_id {kind}, y bigint, x bigint, v double")
