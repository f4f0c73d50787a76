"""Validity of polygons, volumes and shifts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.sources.workspace import shuffled

from .components import grid_components


def edges(vertices: DataFrame) -> DataFrame:
    """Edges (shape, i, n, ax, ay, bx, by) of closed polygons (shape, i, x, y)."""
    w, whole = W.partitionBy("shape").orderBy("i"), W.partitionBy("shape").orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return vertices.select("shape", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(W.partitionBy("shape")).alias("n"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("bx"), F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("by"))


def _side(ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column) -> Column:
    return F.signum((bx - ax) * (y - ay) - (by - ay) * (x - ax))


def validity(vertices: DataFrame, most: int = 64) -> DataFrame:
    """shape, vertices, valid: 3 to ``most`` distinct vertices, an area, no two
    edges that meet, and neighbouring edges that share their vertex alone."""
    e = edges(vertices)
    # What has too many vertices isn't valid anyway. All joins are on the shape, by which the edges lie together.
    few = e.where(F.col("n") <= most)
    a, b = few.alias("a"), shuffled(few).alias("b")
    c = lambda s, k: F.col(f"{s}.{k}")
    meet = c("a", "shape") == c("b", "shape")
    apart = (c("b", "i") > c("a", "i") + 1) & ~((c("a", "i") == 0) & (c("b", "i") == c("a", "n") - 1))
    s1 = _side(c("a", "ax"), c("a", "ay"), c("a", "bx"), c("a", "by"), c("b", "ax"), c("b", "ay"))
    s2 = _side(c("a", "ax"), c("a", "ay"), c("a", "bx"), c("a", "by"), c("b", "bx"), c("b", "by"))
    s3 = _side(c("b", "ax"), c("b", "ay"), c("b", "bx"), c("b", "by"), c("a", "ax"), c("a", "ay"))
    s4 = _side(c("b", "ax"), c("b", "ay"), c("b", "bx"), c("b", "by"), c("a", "bx"), c("a", "by"))
    box = (F.greatest(c("a", "ax"), c("a", "bx")) >= F.least(c("b", "ax"), c("b", "bx"))) & (F.greatest(c("b", "ax"), c("b", "bx")) >= F.least(c("a", "ax"), c("a", "bx"))) & (F.greatest(c("a", "ay"), c("a", "by")) >= F.least(c("b", "ay"), c("b", "by"))) & (F.greatest(c("b", "ay"), c("b", "by")) >= F.least(c("a", "ay"), c("a", "by")))
    crossed = apart & box & (s1 * s2 <= 0) & (s3 * s4 <= 0)
    # The edge after a goes back over it where it doesn't turn but points the other way.
    after = c("b", "i") == F.pmod(c("a", "i") + 1, c("a", "n"))
    ahead = (c("a", "bx") - c("a", "ax")) * (c("b", "bx") - c("b", "ax")) + (c("a", "by") - c("a", "ay")) * (c("b", "by") - c("b", "ay"))
    folded = after & (s2 == 0) & (ahead < 0)
    faults = a.join(b, meet & (crossed | folded)).select(c("a", "shape").alias("shape")).distinct().withColumn("fault", F.lit(True))
    area = e.groupBy("shape").agg(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")).alias("area"))
    counted = vertices.groupBy("shape").agg(F.count_distinct(F.struct("x", "y")).alias("distinct"), F.count("*").alias("vertices"))
    sound = (F.col("distinct") == F.col("vertices")) & F.col("vertices").between(3, most) & (F.col("area") != 0) & F.col("fault").isNull()
    return counted.join(shuffled(area), "shape").join(shuffled(faults), "shape", "left").select("shape", "vertices", F.coalesce(sound, F.lit(False)).alias("valid"))


def inside_crop(vertices: DataFrame, crop: tuple[float, float, float, float]) -> DataFrame:
    """Valid shapes that lie wholly inside a crop (x0, x1, y0, y1)."""
    x0, x1, y0, y1 = crop
    held = vertices.groupBy("shape").agg(F.bool_and(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).alias("held"))
    return held.where("held").join(shuffled(validity(vertices).where("valid")), "shape").select("shape", "vertices")


def volume_components(mask: DataFrame, width: int, height: int, block: int = 32) -> DataFrame:
    """Components of voxels (z, y, x) that share a face: label is the number
    of the component's first voxel."""
    number = (F.col("z") * height + F.col("y")) * width + F.col("x")
    found = grid_components(mask.select("z", "y", "x", number.alias("node")), ["z", "y", "x"], [(1, 0, 0), (0, 1, 0), (0, 0, 1)], block)
    return found.withColumnRenamed("root", "label")


def _determinant(m: dict[tuple[str, str], Column]) -> Column:
    """Of a symmetric matrix, by its upper half."""
    zz, zy, zx, yy, yx, xx = (m[k] for k in (("z", "z"), ("z", "y"), ("z", "x"), ("y", "y"), ("y", "x"), ("x", "x")))
    return zz * (yy * xx - yx * yx) - zy * (zy * xx - yx * zx) + zx * (zy * yx - yy * zx)


def volume_morphometrics(voxels: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    """Per object (volume_id, label) of a label volume (z, y, x): voxels,
    volume, surface (exposed faces, where the neighbour has another label or
    there is none), sphericity (at most 1), the eigenvalues of the covariance
    of its voxels' places, eccentricity and elongation of the first two, and
    why ratios are null: one voxel, voxels on a line, voxels in a plane (the
    last eigenvalue is 0 then). ``spacing``: of z, y, x.

    The eigenvalues are those of a symmetric 3 x 3 matrix in closed form; what
    lies on a line or in a plane is decided in whole numbers, by the minors of
    the matrix of sums.
    """
    own = voxels.where("label > 0").select("volume_id", *(F.col(a).cast("bigint").alias(a) for a in "zyx"), "label")
    key, size = ["volume_id", "label"], dict(zip("zyx", map(float, spacing)))
    ahead = F.array(*(F.struct(*((F.col(b) + int(a == b)).cast("bigint").alias(b) for b in "zyx"), F.lit(a).alias("axis")) for a in "zyx"))
    steps = own.select(*key, F.explode(ahead).alias("n")).select(*key, "n.*")
    inner = shuffled(steps).join(own, ["volume_id", "z", "y", "x", "label"]).groupBy(*key).agg(*(F.count_if(F.col("axis") == a).alias(f"_{a}") for a in "zyx"))
    exact = lambda c: F.sum(c).cast("decimal(38,0)")
    pairs = [(a, b) for i, a in enumerate("zyx") for b in "zyx"[i:]]
    sums = own.groupBy(*key).agg(F.count("*").alias("voxels"), *(exact(F.col(a)).alias(f"s{a}") for a in "zyx"), *(exact(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in pairs))
    n = F.col("voxels").cast("decimal(12,0)")
    moment = lambda a, b: (n * F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}")).cast("decimal(18,0)")
    e = sums.join(inner, key, "left").fillna(0, ["_z", "_y", "_x"]).withColumns({f"m{a}{b}": moment(a, b) for a, b in pairs})
    minors = [F.col(f"m{a}{a}") * F.col(f"m{b}{b}") - F.col(f"m{a}{b}") * F.col(f"m{a}{b}") for a, b in pairs if a != b] + [F.col("mzz") * F.col("myx") - F.col("mzy") * F.col("mzx"), F.col("myy") * F.col("mzx") - F.col("mzy") * F.col("myx"), F.col("mxx") * F.col("mzy") - F.col("mzx") * F.col("myx")]
    line = F.lit(True)
    for m in minors:
        line = line & (m == 0)
    # Doubles where decimals would overflow: what is large is far from 0.
    m = {(a, b): F.col(f"m{a}{b}") for a, b in pairs}
    narrow = {k: v.cast("decimal(12,0)") for k, v in m.items()}
    det = _determinant(narrow)
    plane = F.when(F.greatest(*(F.abs(v) for v in m.values())) < 10**11, det == 0)
    e = e.withColumns({"_line": line, "_plane": F.coalesce(plane, F.lit(False))})
    c = {(a, b): F.col(f"m{a}{b}").cast("double") / F.col("voxels") ** 2 * size[a] * size[b] for a, b in pairs}
    mean = (c["z", "z"] + c["y", "y"] + c["x", "x"]) / 3
    off = c["z", "y"] ** 2 + c["z", "x"] ** 2 + c["y", "x"] ** 2
    spread = F.sqrt(((c["z", "z"] - mean) ** 2 + (c["y", "y"] - mean) ** 2 + (c["x", "x"] - mean) ** 2 + 2 * off) / 6)
    e = e.withColumns({"_mean": mean, "_p": spread})
    b = {k: F.try_divide(v - (F.col("_mean") if k[0] == k[1] else F.lit(0.0)), F.col("_p")) for k, v in c.items()}
    half = _determinant(b) / 2
    e = e.withColumn("_phi", F.acos(F.least(F.greatest(F.coalesce(half, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))) / 3)
    first = F.col("_mean") + 2 * F.col("_p") * F.cos("_phi")
    last = F.col("_mean") + 2 * F.col("_p") * F.cos(F.col("_phi") + 2 * F.pi() / 3)
    e = e.withColumns({"e1": first, "e3": F.when(F.col("_line") | F.col("_plane"), 0.0).otherwise(F.greatest(last, F.lit(0.0)))})
    e = e.withColumn("e2", F.when(F.col("_line"), 0.0).otherwise(F.greatest(3 * F.col("_mean") - F.col("e1") - F.greatest(last, F.lit(0.0)), F.lit(0.0))))
    face = {"z": size["y"] * size["x"], "y": size["z"] * size["x"], "x": size["z"] * size["y"]}
    surface = sum(((2 * F.col("voxels") - 2 * F.col(f"_{a}")) * face[a] for a in "zyx"), F.lit(0.0))
    volume = F.col("voxels") * (size["z"] * size["y"] * size["x"])
    single = F.col("voxels") == 1
    sphericity = F.least(F.pow(F.pi(), F.lit(1 / 3)) * F.pow(6 * volume, F.lit(2 / 3)) / surface, F.lit(1.0))
    r = lambda v, k=6: F.round(v, k)
    reason = F.when(single, "one voxel").when(F.col("_line"), "voxels on a line").when(F.col("_plane"), "voxels in a plane").otherwise("")
    return e.select(
        *key, "voxels", r(volume).alias("volume"), r(surface).alias("surface"), r(F.when(~single, sphericity)).alias("sphericity"), r(F.col("e1")).alias("major"), r(F.col("e2")).alias("middle"), r(F.col("e3")).alias("minor"),
        r(F.when(~single, F.sqrt(F.greatest(1 - F.col("e2") / F.col("e1"), F.lit(0.0)))), 5).alias("eccentricity"), r(F.when(~F.col("_line"), F.sqrt(F.col("e1") / F.col("e2"))), 5).alias("elongation"), reason.alias("reason"),
    )


def shifts(pairs: DataFrame) -> DataFrame:
    """Whole-pixel shift (dy, dx) that best lays the moving channel v2 of each
    image over v1, by phase correlation; an image is a task's bound."""
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        a, b = np.zeros(shape), np.zeros(shape)
        a[pdf["y"], pdf["x"]], b[pdf["y"], pdf["x"]] = pdf["v1"], pdf["v2"]
        f = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
        peak = np.abs(np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)))
        at = np.unravel_index(int(peak.argmax()), shape)
        d = [int(v) - n if v > n // 2 else int(v) for v, n in zip(at, shape)]
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[:1], "dy": d[0], "dx": d[1]})

    return pairs.groupBy("image_id").applyInPandas(run, "image_id bigint, dy bigint, dx bigint")


def accessor(df: DataFrame, path: str) -> Column:
    """The column of a dotted path through structs and maps; null where a map
    lacks the key or no column has the name."""
    from pyspark.sql import types as T

    first, *rest = path.split(".")
    if first not in df.columns:
        return F.lit(None).cast("double")
    out, kind = F.col(first), df.schema[first].dataType
    for part in rest:
        if isinstance(kind, T.MapType):
            out, kind = F.try_element_at(out, F.lit(part)), kind.valueType
        elif isinstance(kind, T.StructType) and part in kind.names:
            out, kind = out[part], kind[part].dataType
        else:
            return F.lit(None).cast("double")
    return out
