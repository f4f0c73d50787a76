"""Export packages: six related tables as CSV and the exact records as JSON
lines, written aside and put in place whole, with a manifest of digests.

A package is a folder: a folder of CSV files for each table, ``records`` with
JSON lines, and ``manifest`` with the files (size, SHA-256), the tables (rows,
header) and the sums. It is written beside its place and renamed at the end,
so that a reader never finds half of one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.functions import typed_cells

from .workspace import written

# The tables, their columns (text unless said otherwise), keys and parents.
TABLES = {
    "results": {"result_id": "string", "revision": "string", "source_id": "string", "total_count": "integer", "selected_count": "integer", "measurement_count": "integer", "review": "string"},
    "objects": {"result_id": "string", "revision": "string", "label": "integer", "measure": "number", "unit": "string", "touches_border": "boolean"},
    "measurements": {"result_id": "string", "revision": "string", "label": "integer", "metric_id": "string", "value": "number", "status": "string", "numeric_type": "string"},
    "samples": {"source_id": "string", "study": "string", "sample": "string", "condition": "string", "biological_replicate": "string"},
    "groups": {"group_id": "string", "result_id": "string", "revision": "string", "source_id": "string", "name": "string", "total_count": "integer", "included_count": "integer", "exported_count": "integer"},
    "memberships": {"group_id": "string", "result_id": "string", "revision": "string", "label": "integer"},
}
_RESULT = ["result_id", "revision"]
_OBJECT = [*_RESULT, "label"]
KEYS = {"results": _RESULT, "objects": _OBJECT, "measurements": [*_OBJECT, "metric_id"], "samples": ["source_id"], "groups": ["group_id"], "memberships": ["group_id", *_OBJECT]}
PARENTS = [("objects", _RESULT, "results"), ("measurements", _OBJECT, "objects"), ("groups", _RESULT, "results"), ("memberships", ["group_id"], "groups"), ("memberships", _OBJECT, "objects")]
RECORDS = {"result_id": "string", "revision": "string", "label": "integer", "record": "string"}
#: Rows of a file at most, so that its digest is taken in bounded memory.
MOST_ROWS = 500_000

_CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "encoding": "UTF-8", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _files(spark: SparkSession, path: str) -> DataFrame:
    """name, size, sha256 of the package's data files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load([f"{path}/{name}" for name in (*TABLES, "records")])
    name = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return found.select(name.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def sums(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: the totals that a manifest states."""
    r, s = tables["results"], tables["samples"]
    one = lambda df, name, value: df.agg(F.coalesce(value, F.lit(0)).cast("bigint").alias("n")).select(F.lit(name).alias("name"), "n")
    assigned = s.where("coalesce(biological_replicate, '') <> ''")
    parts = [
        one(r, "result_count", F.count("*")), one(r, "source_count", F.count_distinct("source_id")), one(r, "total_count", F.sum("total_count")),
        one(tables["objects"], "selected_count", F.count("*")), one(tables["measurements"], "measurement_count", F.count("*")),
        one(tables["groups"], "group_count", F.count("*")), one(tables["memberships"], "membership_count", F.count("*")),
        one(assigned.select("study", "condition", "biological_replicate").distinct(), "declared_replicate_count", F.count("*")),
        one(r.select("source_id").distinct().join(assigned, "source_id", "left_anti"), "unassigned_source_count", F.count("*")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def write(tables: dict[str, DataFrame], records: DataFrame, path: str, purpose: str = "preliminary") -> "Package":
    """Write a package to ``path``, which must not exist. ``records`` has the
    objects' keys and record, their exact JSON. Raises, and leaves nothing in
    place, where a value has no cell."""
    spark = records.sparkSession
    beside = f"{path}.staging-{uuid.uuid4().hex}"
    for name, kinds in TABLES.items():
        # Written once: it is looked through, sampled and sorted.
        coded = written(typed_cells.encoded(tables[name].select(*kinds), kinds))
        if wrong := coded.where(F.size("rejects") > 0).select(F.explode("rejects").alias("c")).distinct().limit(5).collect():
            raise ValueError(f"{name} has values without a cell in " + ", ".join(sorted(w.c for w in wrong)))
        ordered = coded.drop("rejects").sort(*KEYS[name])
        # All cells are quoted, so that an empty one is no null.
        ordered.write.options(**_CSV).option("quoteAll", True).option("maxRecordsPerFile", MOST_ROWS).csv(f"{beside}/{name}")
    lines = records.select(F.to_json(F.struct(*RECORDS)).alias("value"), *_OBJECT).sort(*_OBJECT)
    lines.select("value").write.option("maxRecordsPerFile", MOST_ROWS).text(f"{beside}/records")
    _files(spark, beside).write.parquet(f"{beside}/manifest/files")
    staged = Package(spark, beside)
    back = staged.tables()
    rows = None
    for name in TABLES:
        one = back[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(",".join(TABLES[name])).alias("header"))
        rows = one if rows is None else rows.union(one)
    rows.write.parquet(f"{beside}/manifest/tables")
    sums(back).withColumn("purpose", F.lit(purpose)).write.parquet(f"{beside}/manifest/sums")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    place = hadoop(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(place) or not system.rename(hadoop(beside), place):
        system.delete(hadoop(beside), True)
        raise ValueError(f"{path} is taken")
    return Package(spark, path)


class Package:
    """A package in its place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def cells(self, name: str) -> DataFrame:
        """A table's cells as they stand in the files."""
        schema = ", ".join(f"`{c}` string" for c in TABLES[name])
        # No text is null and nothing is trimmed: \N alone stands for null.
        return self.spark.read.options(**_CSV).option("nullValue", "\u0000").option("enforceSchema", False).schema(schema).csv(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        return typed_cells.decoded(self.cells(name), TABLES[name]).drop("rejects")

    def tables(self) -> dict[str, DataFrame]:
        """All tables, their files read and decoded once, for several uses."""
        return {name: written(self.table(name)) for name in TABLES}

    def records(self) -> DataFrame:
        schema = ", ".join(f"{c} {typed_cells.SPARK[k]}" for c, k in RECORDS.items())
        return self.spark.read.text(f"{self.path}/records").select(F.from_json("value", schema).alias("r")).select("r.*")

    def stated(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest/sums")

    def verified(self) -> DataFrame:
        """name, verdict of each file that the manifest or the folder has: ok,
        missing, unexpected, size or checksum; and of each table: rejects (a
        cell that isn't of its type), rows, or ok."""
        stated = self.spark.read.parquet(f"{self.path}/manifest/files").select("name", F.col("size").alias("m_size"), F.col("sha256").alias("m_sha256"))
        both = stated.join(_files(self.spark, self.path), "name", "full_outer")
        verdict = F.when(F.col("sha256").isNull(), "missing").when(F.col("m_sha256").isNull(), "unexpected").when(F.col("size") != F.col("m_size"), "size").when(F.col("sha256") != F.col("m_sha256"), "checksum").otherwise("ok")
        files = both.select("name", verdict.alias("verdict"))
        counted = None
        for name, kinds in TABLES.items():
            one = typed_cells.decoded(self.cells(name), kinds).agg(F.count("*").alias("n"), F.count_if(F.size("rejects") > 0).alias("bad")).select(F.lit(name).alias("name"), "n", "bad")
            counted = one if counted is None else counted.union(one)
        tables = counted.join(self.spark.read.parquet(f"{self.path}/manifest/tables"), "name", "left")
        return files.union(tables.select("name", F.when(F.col("bad") > 0, "rejects").when(~F.col("n").eqNullSafe(F.col("rows")), "rows").otherwise("ok").alias("verdict")))

    def audit(self) -> DataFrame:
        return audit(self.tables(), written(self.records()), self.stated())


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def audit(tables: dict[str, DataFrame], records: DataFrame, stated: DataFrame, only: list[str] | None = None) -> DataFrame:
    """check, faults: rows that break one of the package's relations (of all,
    or of those named)."""
    out: list[DataFrame] = []

    def fault(check: str, bad: DataFrame) -> None:
        if only is None or check in only:
            out.append(bad.agg(F.count("*").alias("faults")).select(F.lit(check).alias("check"), "faults"))

    for name, key in KEYS.items():
        lacking = F.lit(False)
        for k in key:
            lacking = lacking | F.col(k).isNull() | (F.col(k).cast("string") == "")
        fault(f"key of {name}", tables[name].groupBy(*key).count().where(lacking | (F.col("count") > 1)))
    for child, key, parent in PARENTS:
        fault(f"{child} without {parent}", tables[child].join(tables[parent].select(*key), key, "left_anti"))
    results, objects, groups = tables["results"], tables["objects"], tables["groups"]
    counts = results.join(objects.groupBy(*_RESULT).agg(F.count("*").alias("_objects")), _RESULT, "left").join(tables["measurements"].groupBy(*_RESULT).agg(F.count("*").alias("_metrics")), _RESULT, "left").fillna(0, ["_objects", "_metrics"])
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    fault("objects of a result", counts.where(differs("selected_count", "_objects")))
    fault("measurements of a result", counts.where(differs("measurement_count", "_metrics")))
    fault("total of a result", counts.where(F.coalesce(F.col("total_count") < F.col("_objects"), F.lit(True))))
    fault("range of labels", objects.where(~F.coalesce(F.col("label").between(1, 2**32 - 1), F.lit(False))))
    valued = F.col("status") == "value"
    sound = F.col("status").isin("value", "null", "missing") & (valued == F.col("value").isNotNull()) & F.when(valued, F.coalesce(F.col("numeric_type").isin("integer", "float"), F.lit(False))).otherwise(F.col("numeric_type").isNull())
    fault("status of measurements", tables["measurements"].where(~F.coalesce(sound, F.lit(False))))
    held = groups.alias("g").join(results.alias("r"), _same("g", "r", _RESULT), "left")
    fault("source of groups", held.where(~F.col("g.source_id").eqNullSafe(F.col("r.source_id"))))
    fault("total of groups", held.where(~F.col("g.total_count").eqNullSafe(F.col("r.total_count"))))
    members = groups.join(tables["memberships"].groupBy("group_id").agg(F.count("*").alias("_n")), "group_id", "left").fillna(0, ["_n"])
    fault("exported of groups", members.where(differs("exported_count", "_n")))
    fault("included of groups", members.where(F.coalesce(F.col("included_count") < F.col("_n"), F.lit(True))))
    own = tables["memberships"].alias("m").join(groups.alias("g"), F.col("m.group_id") == F.col("g.group_id"))
    fault("revision of memberships", own.where(~_same("m", "g", _RESULT)))
    fault("records of objects", objects.select(*_OBJECT).exceptAll(records.select(*_OBJECT)).union(records.select(*_OBJECT).exceptAll(objects.select(*_OBJECT))))
    fault("source of samples", tables["samples"].join(results.select("source_id"), "source_id", "left_anti"))
    fault("review of results", results.crossJoin(F.broadcast(stated.select("purpose").limit(1))).where("purpose = 'reviewed' and not review <=> 'reviewed'"))
    again = sums(tables).withColumnRenamed("n", "_n").join(stated.select("name", "n"), "name", "full_outer")
    fault("sums of the manifest", again.where(differs("n", "_n")))
    found = out[0]
    for o in out[1:]:
        found = found.union(o)
    return found


def from_objects(objects: DataFrame, metrics: dict[str, str], selected: Column, group: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The six tables and the records of one table of objects (result_id,
    revision, source_id, label, measure, unit, touches_border, review, study,
    sample, condition, biological_replicate, the ``metrics`` with their numeric
    types, and ``group``, which names each object's group)."""
    kept = objects.where(selected)
    result = objects.groupBy(*_RESULT, "source_id", "review").agg(F.count("*").alias("total_count"), F.count_if(selected).alias("selected_count"))
    values = F.array(*(F.struct(F.lit(m).alias("metric_id"), F.col(m).cast("double").alias("value"), F.lit(kind).alias("kind")) for m, kind in metrics.items()))
    measured = kept.select(*_OBJECT, F.explode(values).alias("m")).select(*_OBJECT, "m.metric_id", "m.value", F.when(F.col("m.value").isNull(), "null").otherwise("value").alias("status"), F.when(F.col("m.value").isNotNull(), F.col("m.kind")).alias("numeric_type"))
    named = F.concat_ws("/", "result_id", group)
    whole = result.select(*_RESULT, "total_count")
    groups = objects.groupBy(*_RESULT, "source_id", F.col(group).alias("name")).agg(F.first(named).alias("group_id"), F.count("*").alias("included_count"), F.count_if(selected).alias("exported_count")).join(whole, _RESULT)
    tables = {
        "results": result.withColumn("measurement_count", F.col("selected_count") * len(metrics)), "objects": kept.select(*TABLES["objects"]), "measurements": measured,
        "samples": objects.select(*TABLES["samples"]).distinct(), "groups": groups, "memberships": kept.select(named.alias("group_id"), *_OBJECT),
    }
    return tables, kept.select(*_OBJECT, F.to_json(F.struct("label", "measure", *metrics)).alias("record"))
