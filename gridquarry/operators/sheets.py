"""Sample sheets and packages: templates, previews, application, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridquarry.sources.workspace import written

# The columns of a sample sheet, in order.
COLUMNS = ("source_id", "study", "sample", "condition", "biological_replicate", "plate", "well")
#: Most characters of a field.
LONGEST = 256


def template(sources: DataFrame, samples: DataFrame, study: str) -> DataFrame:
    """The sheet's columns for every source, with its current values, or the
    study alone where it has none."""
    s = samples.select(F.col("source_id").alias("_id"), *COLUMNS[1:])
    both = sources.select("source_id").join(s, F.col("source_id") == F.col("_id"), "left").drop("_id")
    return both.withColumn("study", F.coalesce("study", F.lit(study))).select(*COLUMNS)


def fields(line: Column) -> Column:
    """The fields of one line of comma-separated text; quoted ones lose their
    quotes and doubled quotes. Null where a quote is out of place."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^",]*)(?=,|$)'), F.lit(1))
    bare = F.transform(parts, lambda p: F.when(p.startswith('"'), F.replace(F.substr(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(p))
    return F.when(F.length(F.array_join(parts, ",")) == F.length(line), bare)


def preview(lines: DataFrame, sources: DataFrame, study: str) -> DataFrame:
    """row, source_id, values (the other fields; empty optional ones are null)
    and issues of each data row of ``lines`` (row, line; row 1 is the header)."""
    parsed = lines.select("row", fields(F.col("line")).alias("f"))
    header = F.max(F.when(F.col("row") == 1, F.col("f") == F.array(*map(F.lit, COLUMNS))))
    sound = F.broadcast(parsed.agg(F.coalesce(header, F.lit(False)).alias("header")))  # one row
    rows = parsed.where("row > 1").withColumn("source_id", F.get("f", 0))
    times = rows.groupBy("source_id").agg(F.count("*").alias("times"), F.count_distinct("f").alias("kinds"))
    known = sources.select("source_id", F.lit(True).alias("known"))
    j = rows.join(times, "source_id", "left").join(known, "source_id", "left").crossJoin(sound)
    at = lambda i: F.get("f", i)
    whole = F.coalesce(F.size("f") == len(COLUMNS), F.lit(False))
    issue = lambda rule, name: F.when(F.coalesce(rule, F.lit(False)), F.lit(name))
    issues = F.array_compact(
        F.array(
            issue(~F.col("header"), "header"),
            issue(F.col("f").isNull(), "quoting"),
            issue(F.col("f").isNotNull() & ~whole, "fields"),
            issue(F.col("known").isNull(), "unknown source"),
            issue(whole & (at(1) != study), "study"),
            issue(whole & (F.trim(at(2)) == ""), "sample"),
            issue(whole & (F.trim(at(3)) == ""), "condition"),
            issue(F.exists("f", lambda v: (F.length(v) > LONGEST) | v.rlike(r"[\x00-\x1f\x7f]")), "text"),
            issue((F.col("times") > 1) & (F.col("kinds") == 1), "duplicate"),
            issue(F.col("kinds") > 1, "conflicting"),
        )
    )
    values = F.transform(F.slice("f", 2, len(COLUMNS) - 1), lambda v, i: F.when((i >= 3) & (v == ""), F.lit(None)).otherwise(v))
    return j.select("row", "source_id", values.alias("values"), issues.alias("issues"))


def digest(checked: DataFrame) -> str:
    """Digest of a preview: those of its rows, by ranges of their numbers."""
    rows = checked.select("row", F.sha2(F.to_json(F.struct("row", "source_id", "values", "issues")), 256).alias("h"))
    ordered = lambda key, h: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, h))), lambda s: s[h]), ""), 256)
    ranges = rows.groupBy(F.floor(F.col("row") / 4096).alias("r")).agg(ordered("row", "h").alias("d"))
    return ranges.agg(ordered("r", "d").alias("d")).first()[0]


def apply(checked: DataFrame, samples: DataFrame, expected: str) -> DataFrame:
    """The samples (sheet's columns and revision) after a preview: all of its
    rows, each with the next revision. Refused are a preview other than
    ``expected`` and one with an issue, or without rows."""
    checked = written(checked)
    if digest(checked) != expected:
        raise ValueError("the preview has changed")
    if checked.isEmpty() or not checked.where(F.size("issues") > 0).isEmpty():
        raise ValueError("the sheet can't be applied")
    new = checked.select("source_id", *(F.get("values", i).alias(c) for i, c in enumerate(COLUMNS[1:])))
    held = samples.select(F.col("source_id").alias("_id"), F.col("revision").alias("_revision"))
    new = new.join(held, F.col("source_id") == F.col("_id"), "left").select(*COLUMNS, (F.coalesce("_revision", F.lit(0)) + 1).alias("revision"))
    return samples.select(*COLUMNS, "revision").join(new.select("source_id"), "source_id", "left_anti").union(new)


def verify_package(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """name, verdict of each file of a manifest or a package (name, size,
    sha256, header, rows): the first thing that differs, or ok."""
    a = manifest.select("name", *(F.col(c).alias(f"m_{c}") for c in ("size", "sha256", "header", "rows")))
    j = a.join(found, "name", "full_outer")
    verdict = F.when(F.col("sha256").isNull(), "missing").when(F.col("m_sha256").isNull(), "unexpected")
    for c, name in (("header", "header"), ("rows", "rows"), ("size", "size"), ("sha256", "checksum")):
        verdict = verdict.when(~F.col(f"m_{c}").eqNullSafe(F.col(c)), name)
    return j.select("name", verdict.otherwise("ok").alias("verdict"))


def relation_faults(checks: dict[str, tuple[DataFrame, str, DataFrame | None, str | None]]) -> DataFrame:
    """check, faults. A check is a table, its key, and a parent table with its
    key (rows without a parent are faults) or nothing (keys that repeat are)."""
    out = None
    for name, (child, key, parent, other) in checks.items():
        own = child.select(F.col(key).alias("k"))
        bad = own.join(parent.select(F.col(other).alias("k")).distinct(), "k", "left_anti") if parent is not None else own.groupBy("k").count().where("count > 1")
        one = bad.agg(F.count("*").alias("faults")).select(F.lit(name).alias("check"), "faults")
        out = one if out is None else out.union(one)
    return out
