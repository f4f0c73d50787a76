"""Text cells of declared types, wide columns of nested rows, linear maps.

The types are ``string``, ``boolean``, ``integer`` (64 bits) and ``number``
(binary64). A cell holds its value without loss; what can't be is named in
``rejects``, never written as something else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import decode, encode

SPARK = {"string": "string", "boolean": "boolean", "integer": "bigint", "number": "double"}
# The lexemes of numbers.
INTEGER = r"^-?(0|[1-9][0-9]*)$"
NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def shortest(c: Column) -> Column:
    """The shortest decimal of a finite double that reads back as the same."""
    plain = c.cast("string")
    written = lambda n: F.regexp_replace(F.regexp_replace(F.format_string(f"%.{n - 1}e", c), r"(\.[0-9]*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    # 15 digits are always near enough to trim, 16 and 17 only where needed; the least numbers of all have fewer.
    out = F.when(F.abs(c) >= F.lit(2.3e-308), F.when(written(15).cast("double") == c, _as_written(written(15), plain)).when(written(16).cast("double") == c, _as_written(written(16), plain)).when(written(17).cast("double") == c, _as_written(written(17), plain)).otherwise(plain)).when(c == 0, plain)
    for n in range(1, 17):
        out = out.when(written(n).cast("double") == c, written(n))
    return out.otherwise(plain)


def _as_written(short: Column, plain: Column) -> Column:
    """``plain``, unless ``short`` has fewer digits; whole numbers keep a .0."""
    digits = lambda t: F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[eE].*$", ""), "[^0-9]", ""), "^0+|0+$", ""))
    return F.when(digits(plain) <= digits(short), plain).otherwise(short)


def encode_as(c: Column, kind: str) -> Column:
    """The cell of a value; null is \\N. A number that isn't finite has none
    (null)."""
    if kind == "string":
        return encode(c)
    if kind == "boolean":
        return F.when(c.isNull(), "\\N").otherwise(F.when(c, "true").otherwise("false"))
    if kind == "integer":
        return F.coalesce(c.cast("bigint").cast("string"), F.lit("\\N"))
    finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.when(c.isNull(), "\\N").when(finite, shortest(c.cast("double")))


def decode_as(c: Column, kind: str) -> Column:
    """The value of a cell; null for \\N and for a cell that isn't one."""
    if kind == "string":
        return decode(c)
    value = F.when(c != F.lit("\\N"), c)
    if kind == "boolean":
        return F.when(value.isin("true", "false"), value == "true")
    if kind == "integer":
        return F.when(value.rlike(INTEGER), value.try_cast("bigint"))
    read = F.when(value.rlike(NUMBER), value.try_cast("double"))
    return F.when(F.abs(read) != F.lit(float("inf")), read)


def _held(c: Column, kind: str) -> Column:
    """Whether a text is a cell of the type."""
    if kind == "string":
        # Backslashes come in pairs.
        return (c == F.lit("\\N")) | ~F.replace(c, F.lit("\\\\"), F.lit("")).contains("\\")
    return (c == F.lit("\\N")) | decode_as(c, kind).isNotNull()


def encoded(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The columns of ``kinds`` as cells, the others as they are, and rejects,
    the names of those that hold a value without a cell."""
    cells = {name: encode_as(F.col(name), kind) for name, kind in kinds.items()}
    rejects = F.array_compact(F.array(*(F.when(c.isNull(), name) for name, c in cells.items())))
    return df.withColumn("rejects", rejects).withColumns(cells)


def decoded(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The inverse of encoded(): typed columns, and rejects, the names of the
    columns whose text is null or no cell of its type."""
    rejects = F.array_compact(F.array(*(F.when(~F.coalesce(_held(F.col(name), kind), F.lit(False)), name) for name, kind in kinds.items())))
    return df.withColumn("rejects", rejects).withColumns({name: decode_as(F.col(name), kind) for name, kind in kinds.items()})


def parsed_number(text: Column, kind: str = "number") -> Column:
    """struct(exact, value, reason) of a number's text: exact is the decimal
    (18 places; null where it needs more room), value the binary64 only where
    that loses nothing, reason why not: lexeme, fraction (of an integer),
    integer range, digits, overflow or underflow; ok otherwise."""
    mantissa = F.regexp_replace(text, "[eE].*$", "")
    digits = F.length(F.regexp_replace(F.regexp_replace(mantissa, "[^0-9]", ""), "^0+", ""))
    whole = text.rlike(INTEGER)
    number = text.try_cast("double")
    zero = F.regexp_replace(mantissa, "[^1-9]", "") == ""
    reason = (
        F.when(text.isNull(), F.lit(None).cast("string")).when(~text.rlike(NUMBER), "lexeme").when(F.lit(kind == "integer") & ~whole, "fraction")
        .when(whole & ((digits > 16) | (F.abs(text.try_cast("decimal(38,0)")) > F.lit(2**53).cast("decimal(38,0)"))), "integer range").when(~whole & (digits > 17), "digits")
        .when(F.abs(number) == F.lit(float("inf")), "overflow").when((number == 0) & ~zero, "underflow").otherwise("ok")
    )
    places = F.length(F.regexp_extract(mantissa, r"\.([0-9]+)", 1))
    exact = F.when(text.rlike(NUMBER) & ~text.rlike("[eE]") & (places <= 18), text.try_cast("decimal(38,18)"))
    return F.struct(exact.alias("exact"), F.when(reason == "ok", number).alias("value"), reason.alias("reason"))


def flattened(df: DataFrame, separator: str = ":") -> DataFrame:
    """Every nested field as a column of its own, named by its path: structs to
    any depth, lists as ``key:index`` up to the longest list there is, maps by
    the keys there are. Lengths and keys are found in one aggregation a level
    of nesting; their number is that of the result's columns."""
    while True:
        deep = [f for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
        if not deep:
            return df
        asked = {}
        for i, f in enumerate(deep):
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.ArrayType):
                asked[f"_{i}"] = F.max(F.size(c))
            elif isinstance(f.dataType, T.MapType):
                asked[f"_{i}"] = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys(c)))))
        found = df.agg(*(v.alias(k) for k, v in asked.items())).first().asDict() if asked else {}
        columns: list[Column] = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            i = deep.index(f) if f in deep else -1
            if isinstance(f.dataType, T.StructType):
                columns += [c.getField(n).alias(f"{f.name}{separator}{n}") for n in f.dataType.names]
            elif isinstance(f.dataType, T.ArrayType):
                columns += [F.get(c, F.lit(k)).alias(f"{f.name}{separator}{k}") for k in range(max(found[f"_{i}"] or 0, 0))]
            elif isinstance(f.dataType, T.MapType):
                columns += [c.getItem(k).alias(f"{f.name}{separator}{k}") for k in found[f"_{i}"] or []]
            else:
                columns.append(c)
        df = df.select(*columns)


def inverse(matrix: list[list[float]]) -> list[list[float]]:
    """The inverse of a square matrix; raises where there is none."""
    import numpy as np

    a = np.asarray(matrix, dtype=float)
    if a.ndim != 2 or a.shape[0] != a.shape[1] or not np.isfinite(a).all():
        raise ValueError("a matrix must be square and finite")
    if np.linalg.matrix_rank(a) < len(a):
        raise ValueError("the matrix has no inverse")
    return np.linalg.inv(a).tolist()


def mapped(matrix: list[list[float]], columns: list[Column]) -> list[Column]:
    """The products of a matrix with a column vector."""
    out = []
    for row in matrix:
        total = F.lit(0.0)
        for k, c in zip(row, columns, strict=True):
            total = total + F.lit(float(k)) * c
        out.append(total)
    return out


class Geometry:
    """The map of a grid's indices, in the order of ``axes`` (YX or ZYX), to
    world X, Y, Z: a 4 x 4 matrix whose columns go with X, Y, Z index steps."""

    def __init__(self, affine: list[list[float]], axes: str):
        if axes not in ("YX", "ZYX"):
            raise ValueError("axes must be YX or ZYX")
        if len(affine) != 4 or any(len(row) != 4 for row in affine) or [float(x) for x in affine[3]] != [0, 0, 0, 1]:
            raise ValueError("an affine is 4 x 4 and ends in 0, 0, 0, 1")
        self.affine, self.axes = [[float(x) for x in row] for row in affine], axes
        self._back = inverse(affine)

    def _xyz(self, index: list[Column]) -> list[Column]:
        own = dict(zip(self.axes, index, strict=True))
        return [own.get(a, F.lit(0.0)).cast("double") for a in "XYZ"]

    def world(self, index: list[Column]) -> list[Column]:
        return mapped(self.affine, [*self._xyz(index), F.lit(1.0)])[:3]

    def index(self, world: list[Column]) -> list[Column]:
        """The inverse of world(), in the order of the axes."""
        found = dict(zip("XYZ", mapped(self._back, [*world, F.lit(1.0)])))
        return [found[a] for a in self.axes]

    def spacing(self) -> list[float]:
        """World length of a step along each axis, in their order."""
        size = {a: sum(self.affine[r][c] ** 2 for r in range(3)) ** 0.5 for c, a in enumerate("XYZ")}
        return [size[a] for a in self.axes]

    def cropped(self, start: list[float]) -> "Geometry":
        """The geometry of a crop whose first index is ``start``."""
        own = dict(zip(self.axes, start, strict=True))
        moved = [[*row[:3], row[3] + sum(row[c] * own.get(a, 0) for c, a in enumerate("XYZ"))] for row in self.affine[:3]]
        return Geometry([*moved, self.affine[3]], self.axes)


# Optical densities of stains in red, green and blue.
HAEMATOXYLIN_EOSIN = [[0.65, 0.70, 0.29], [0.07, 0.99, 0.11], [0.27, 0.57, 0.78]]
HAEMATOXYLIN_DAB = [[0.65, 0.704, 0.286], [0.268, 0.570, 0.776]]


def stains(rgb: list[Column], basis: list[list[float]], white: float = 255.0, least: float = 1e-6) -> list[Column]:
    """Amounts of the stains whose optical densities are the rows of ``basis``
    (of two rows, the third is at right angles to both): the logarithm of the
    intensities as parts of ``white``, not below ``least``, over that of
    ``least``, times the inverse of the basis, and not below 0. Null where an
    intensity is null or outside 0 to ``white``."""
    rows = [list(map(float, row)) for row in basis]
    if len(rows) == 2:
        (a, b, c), (d, e, f) = rows
        rows.append([b * f - c * e, c * d - a * f, a * e - b * d])
    back = inverse(rows)
    sound = F.lit(True)
    for c in rgb:
        sound = sound & c.between(0, white)
    density = [F.log(F.greatest(c.cast("double") / white, F.lit(least))) / F.log(F.lit(least)) for c in rgb]
    return [F.when(sound, F.greatest(c, F.lit(0.0))) for c in mapped([list(column) for column in zip(*back)], density)]
