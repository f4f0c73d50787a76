"""Queries on files, shapes, volumes and shifts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridquarry.functions import cells
from gridquarry.operators import filters, grids, shapes
from gridquarry.sources import files, views
from gridquarry.sources.views import HEIGHT, WIDTH, sql, table
from gridquarry.sources.workspace import shared_dir

from .catalog import query

_VERTICES = "v as (select p_partkey as shape, i, case i when 0 then 0.0::double when 1 then p_size::double when 2 then (p_size % 7) * 3.0::double else 0.0::double end as x, case i when 0 then 0.0::double when 1 then (p_size % 5) * 2.0::double when 2 then 10.0::double else (p_size % 3) * 8.0::double - 4 end as y from part, range(0, 4) t(i))"


def _vertices(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("shape"), "p_size", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    s = F.col("p_size")
    x = F.when(F.col("i") == 0, 0.0).when(F.col("i") == 1, s.cast("double")).when(F.col("i") == 2, (s % 7) * 3.0).otherwise(0.0)
    y = F.when(F.col("i") == 0, 0.0).when(F.col("i") == 1, (s % 5) * 2.0).when(F.col("i") == 2, 10.0).otherwise((s % 3) * 8.0 - 4)
    return p.select("shape", "i", x.alias("x"), y.alias("y"))


_VALIDITY = (
    f"{_VERTICES}, n as (select *, coalesce(lead(x) over w, first(x) over u) as bx, coalesce(lead(y) over w, first(y) over u) as by from v window w as (partition by shape order by i), u as (partition by shape order by i rows between unbounded preceding and unbounded following)), "
    "crossed as (select distinct a.shape from n a join n b on a.shape = b.shape and b.i = a.i + 2 where greatest(a.x, a.bx) >= least(b.x, b.bx) and greatest(b.x, b.bx) >= least(a.x, a.bx) and greatest(a.y, a.by) >= least(b.y, b.by) and greatest(b.y, b.by) >= least(a.y, a.by) "
    "and sign((a.bx - a.x) * (b.y - a.y) - (a.by - a.y) * (b.x - a.x)) * sign((a.bx - a.x) * (b.by - a.y) - (a.by - a.y) * (b.bx - a.x)) <= 0 and sign((b.bx - b.x) * (a.y - b.y) - (b.by - b.y) * (a.x - b.x)) * sign((b.bx - b.x) * (a.by - b.y) - (b.by - b.y) * (a.bx - b.x)) <= 0), "
    "folded as (select a.shape from n a join n b on a.shape = b.shape and b.i = (a.i + 1) % 4 where (a.bx - a.x) * (b.by - a.y) - (a.by - a.y) * (b.bx - a.x) = 0 and (a.bx - a.x) * (b.bx - b.x) + (a.by - a.y) * (b.by - b.y) < 0), "
    "valid as (select shape, count(*) as vertices, count(distinct (x, y)) = 4 and sum(n.x * n.by - n.bx * n.y) <> 0 and shape not in (select shape from crossed) and shape not in (select shape from folded) as valid from n group by 1)"
)


@query("p13_polygon_validity", f"with {_VALIDITY} select shape, vertices, valid from valid")
def polygon_validity(spark, d):
    return shapes.validity(_vertices(spark, d))


@query("f14_reference_candidates", f"with {_VALIDITY} select shape, vertices from valid where valid and shape in (select shape from v group by 1 having bool_and(x between 0 and 40 and y between -4 and 12))")
def reference_candidates(spark, d):
    return shapes.inside_crop(_vertices(spark, d), (0.0, 40.0, -4.0, 12.0))


@query("s02_object_table_sink", sql("objects", then="select result_id, count(*) as n, sum(label)::bigint as labels, round(sum(measure), 4) as total from objects group by 1"))
def object_table_sink(spark, d):
    path = f"{shared_dir(spark)}/objects-{uuid.uuid4().hex}"
    files.write_objects(views.objects(spark, d), path)
    return files.read_objects(spark, path).groupBy(F.col("result_id").cast("bigint").alias("result_id")).agg(F.count("*").alias("n"), F.sum("label").alias("labels"), F.round(F.sum("measure"), 4).alias("total"))


@query("s09_still_image_source", sql("px", then="select image_id, y, x, v from px"))
def still_image_source(spark, d):
    return files.decode_images(files.encode_images(views.px(spark, d), "v"))


@query("p08_dotted_value_accessor", "select p_partkey, p_retailprice as mean, p_size::double as size, null::double as absent from part")
def dotted_value_accessor(spark, d):
    nested = table(spark, d, "part").select("p_partkey", F.struct(F.struct(F.col("p_retailprice").alias("mean")).alias("raw")).alias("intensity"), F.create_map(F.lit("size"), F.col("p_size").cast("double")).alias("extra"))
    return nested.select("p_partkey", shapes.accessor(nested, "intensity.raw.mean").alias("mean"), shapes.accessor(nested, "extra.size").alias("size"), shapes.accessor(nested, "intensity.dna.mean").alias("absent"))


# A recursive search of large components is too slow in SQL; the tests compare
# this with brute force.
@query("g02_components_nd")
def components_nd(spark, d):
    mask = views.px(spark, d).where("v > 15").select(F.col("image_id").alias("z"), "y", "x")
    return shapes.volume_components(mask, WIDTH, HEIGHT)


@query("a31_tissue_mask")
def tissue_mask(spark, d):
    gray = views.px(spark, d).select(*grids.PIXEL, cells.luminance("v", "v", "v2").alias("gray"))
    return filters.tissue_mask(gray, "gray", WIDTH, HEIGHT, closing=1.5, least=3)


@query("x04_phase_shift_estimate", sql("px", then="select image_id, 2 as dy, -3 as dx from px group by 1 having count(*) = 2500"))
def phase_shift_estimate(spark, d):
    p = views.px(spark, d).select(*grids.PIXEL, F.col("v").alias("v1"))
    whole = p.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") == WIDTH * HEIGHT).select("image_id")
    moved = p.select("image_id", ((F.col("y") - 2 + HEIGHT) % HEIGHT).alias("y"), ((F.col("x") + 3) % WIDTH).alias("x"), F.col("v1").alias("v2"))
    return shapes.shifts(p.join(moved, grids.PIXEL).join(whole, "image_id", "left_semi"))


@query("a27_morphometrics_3d", sql("labels_ref", then="").rstrip() + """, vox as (select image_id // 4 as volume_id, image_id % 4 as z, y, x, label from labels_ref where label > 0),
    faces as (select volume_id, label, sum(case when d = 0 then 0.5 * 0.25 else 2.0 * case when d = 1 then 0.25 else 0.5 end end)::double as surface from (select a.volume_id, a.label, d from vox a, (values (0, -1), (0, 1), (1, -1), (1, 1), (2, -1), (2, 1)) t(d, s)
        left join vox b on b.volume_id = a.volume_id and b.label = a.label and b.z = a.z + case when d = 0 then s else 0 end and b.y = a.y + case when d = 1 then s else 0 end and b.x = a.x + case when d = 2 then s else 0 end where b.label is null) group by all),
    m as (select volume_id, label, count(*)::hugeint as n, count(*) * sum(z * z)::hugeint - sum(z)::hugeint * sum(z) as zz, count(*) * sum(y * y)::hugeint - sum(y)::hugeint * sum(y) as yy, count(*) * sum(x * x)::hugeint - sum(x)::hugeint * sum(x) as xx,
        count(*) * sum(z * y)::hugeint - sum(z)::hugeint * sum(y) as zy, count(*) * sum(z * x)::hugeint - sum(z)::hugeint * sum(x) as zx, count(*) * sum(y * x)::hugeint - sum(y)::hugeint * sum(x) as yx from vox group by all)
    select volume_id, label, cast(n as bigint) as voxels, round(n * 0.25::double, 6) as volume, round(surface, 6) as surface, case when n > 1 then round(least(pow(pi(), 1 / 3) * pow(6 * n * 0.25::double, 2 / 3) / surface, 1), 6) end as sphericity, round((zz * 4::double + yy * 0.25::double + xx * 0.0625::double) / n / n, 4) as spread,
        case when n = 1 then 'one voxel' when zz * yy = zy * zy and zz * xx = zx * zx and yy * xx = yx * yx then 'voxels on a line' when zz * (yy * xx - yx * yx) - zy * (zy * xx - yx * zx) + zx * (zy * yx - yy * zx) = 0 then 'voxels in a plane' else '' end as reason
    from m join faces using (volume_id, label)""")
def volume_morphometrics(spark, d):
    voxels = views.labels_ref(spark, d).selectExpr("image_id div 4 as volume_id", "image_id % 4 as z", "y", "x", "label")
    told = shapes.volume_morphometrics(voxels, (2.0, 0.5, 0.25))
    return told.select("volume_id", "label", "voxels", "volume", "surface", "sphericity", F.round(F.col("major") + F.col("middle") + F.col("minor"), 4).alias("spread"), "reason")
