"""Column functions: text cells, identifiers, canonical records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridquarry.sources.workspace import with_index

# The signs by which spreadsheets know a formula.
_FORMULA = r"^[ \t\r\n]*[=+@-]"
_ESCAPED = r"^[ \t\r\n]*['=+@-]"


def formula_safe(c: Column) -> Column:
    """Text that no spreadsheet takes for a formula: an apostrophe before a
    leading sign, also after white space."""
    return F.when(c.rlike(_FORMULA), F.concat(F.lit("'"), c)).otherwise(c)


def encode(c: Column) -> Column:
    """A reversible text cell: null as \\N, backslashes doubled, an apostrophe
    before a leading sign or apostrophe."""
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.when(c.isNull(), F.lit("\\N")).when(c.rlike(_ESCAPED), F.concat(F.lit("'"), doubled)).otherwise(doubled)


def decode(c: Column) -> Column:
    """The inverse of encode()."""
    bare = F.when(c.rlike(r"^'[ \t\r\n]*['=+@-]"), F.substr(c, F.lit(2))).otherwise(c)
    return F.when(c == F.lit("\\N"), F.lit(None)).otherwise(F.replace(bare, F.lit("\\\\"), F.lit("\\")))


def number(c: Column) -> Column:
    """Text as a double; null unless it is a plain decimal number."""
    return F.when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), c.cast("double"))


def is_exact(c: Column) -> Column:
    """Whether a decimal text has 17 significant digits at most, its exponent
    aside."""
    digits = F.regexp_replace(F.regexp_replace(c, r"[eE].*$", ""), r"[^0-9]", "")
    return F.length(F.regexp_replace(digits, "^0+", "")) <= 17


def metric_id(channel: Column, statistic: str) -> Column:
    return F.concat_ws(":", F.lit("intensity"), F.lower(F.hex(F.encode(channel, "UTF-8"))), F.lit(statistic))


def metric_channel(metric: Column) -> Column:
    return F.decode(F.unhex(F.element_at(F.split(metric, ":"), 2)), "UTF-8")


def melt(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long measurements: keys, metric, value, status (value or null)."""
    long = df.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keys, metrics, "metric", "value")
    return long.withColumn("status", F.when(F.col("value").isNull(), "null").otherwise("value"))


def stable_id(prefix: str, path: Column, digest: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat(F.lit("v1:"), F.coalesce(path, F.lit("")), F.lit("/"), digest), 256), 1, 24))


def acquisition_group(path: Column) -> Column:
    """The first two parts of a path."""
    return F.array_join(F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, 2), "/")


def metadata_reasons(study: Column, sample: Column, condition: Column, *others: Column) -> Column:
    """What is wrong with a sample's metadata: a required text that lacks or is
    blank, one of more than 256 characters, one with control characters."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    every = F.array(study, sample, condition, *others)
    some = lambda rule: F.coalesce(F.exists(every, lambda v: F.coalesce(rule(v), F.lit(False))), F.lit(False))
    return F.array_compact(F.array(F.when(blank(study), "study"), F.when(blank(sample), "sample"), F.when(blank(condition), "condition"), F.when(some(lambda v: F.length(v) > 256), "too_long"), F.when(some(lambda v: v.rlike(r"[\x00-\x1f\x7f]")), "control")))


def label_transform(width: str, height: str, label_width: str, label_height: str) -> Column:
    """identity for equal sizes, resize where the label has the source's aspect
    to a pixel, else error."""
    w, h, lw, lh = (F.col(c) for c in (width, height, label_width, label_height))
    scale = F.least(lw / w, lh / h)
    near = lambda a, b: F.abs(F.bround(a * scale) - b) <= 1
    return F.when((w == lw) & (h == lh), "identity").when(near(w, lw) & near(h, lh), "resize").otherwise("error")


def canonical_json(*columns: str) -> Column:
    """Compact JSON with the keys in order."""
    return F.to_json(F.struct(*sorted(columns)))


def sentence(fields: dict[str, Column]) -> Column:
    """The supplied fields as one sentence; null ones are left out."""
    return F.concat_ws("; ", *(F.concat(F.lit(name + " "), c.cast("string")) for name, c in fields.items()))


def luminance(red: str, green: str, blue: str) -> Column:
    return 0.2126 * F.col(red) + 0.7152 * F.col(green) + 0.0722 * F.col(blue)


def byte_page(df: DataFrame, order: str, size: str, most: int, offset: int = 0) -> DataFrame:
    """The rows from place ``offset`` on, in order, whose sizes add up to
    ``most`` at most (the first one in any case), with next_offset, the place
    where the next page begins. Sizes are summed partition by partition in a
    range sort, so that rows of no size don't end a page."""
    from pyspark.sql import Window as W

    placed = with_index(df, order, name="_i").where(F.col("_i") >= offset).withColumn("_p", F.floor(F.col("_i") / 1024))
    # Whole runs of 1024 rows are summed first; of them, only those that begin within the page are looked at.
    runs = placed.groupBy("_p").agg(F.sum(size).alias("_s")).withColumn("_before", F.sum("_s").over(W.orderBy("_p")) - F.col("_s"))
    near = placed.join(F.broadcast(runs.where(F.col("_before") <= most).select("_p", "_before")), "_p")
    total = F.col("_before") + F.sum(size).over(W.partitionBy("_p").orderBy("_i"))
    page = near.withColumn("_total", total).where((F.col("_total") <= most) | (F.col("_i") == offset))
    return page.withColumn("next_offset", F.lit(offset) + F.count("*").over(W.partitionBy())).drop("_total", "_i", "_p", "_before")
