"""Queries on pixels and label grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridquarry.functions import typed_cells
from gridquarry.operators import corrections, filters, grids
from gridquarry.sources import views
from gridquarry.sources.views import HEIGHT, WIDTH, sql

from .catalog import query

_NEAR = "(values (0, 1), (1, 0), (0, -1), (-1, 0)) as s(dy, dx)"


@query("a01_object_measures", sql("labels_ref", then="""select image_id, label, count(*) as pixels, round(avg(y), 6) as centroid_y, round(avg(x), 6) as centroid_x, min(y) as y0, min(x) as x0, max(y) + 1 as y1, max(x) + 1 as x1,
    bool_or(x = 0 or y = 0 or x = 99 or y = 24) as border, round(avg(v), 6) as v_mean, round(sum(v), 4) as v_sum, min(v) as v_min, max(v) as v_max, round(stddev_pop(v), 6) as v_sd from labels_ref where label > 0 group by all"""))
def object_measures(spark, d):
    return grids.object_measures(views.labels_ref(spark, d), ["v"], WIDTH, HEIGHT)


@query("a02_principal_radii", sql("labels_ref", then="""select image_id, label, round(sqrt(greatest((a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c), 0)), 6) as major, round(sqrt(greatest((a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c), 0)), 5) as minor
    from (select image_id, label, var_pop(x) as a, var_pop(y) as b, covar_pop(x, y) as c from labels_ref where label > 0 group by all)"""))
def principal_radii(spark, d):
    return grids.principal_radii(views.labels_ref(spark, d))


@query("a03_mergeable_partials", sql("labels_ref", then="select image_id, label, count(*) as pixels, round(avg(v), 6) as mean, round(stddev_pop(v), 5) as sd, round(covar_pop(v, v2), 8) as covariance from labels_ref where label > 0 group by all"))
def mergeable_partials(spark, d):
    return grids.tiled_measures(views.labels_ref(spark, d), "v", 3, "v2")


def _compartment_sql() -> str:
    parts = []
    for name, inside in (("cell", "true"), ("nuclear", "inner_label > 0"), ("cytoplasm", "inner_label = 0")):
        parts.append(f"count(*) filter ({inside}) as {name}_pixels, round(coalesce(sum(v) filter ({inside}), 0), 4) as {name}_sum, round(avg(v) filter ({inside}), 6) as {name}_mean, min(v) filter ({inside}) as {name}_min, max(v) filter ({inside}) as {name}_max, round(stddev_pop(v) filter ({inside}), 5) as {name}_sd")
    return sql("labels_ref", "labels_pred", then=f"select image_id, label, {', '.join(parts)} from (select r.*, p.label as inner_label from labels_ref r join labels_pred p using (image_id, y, x)) where label > 0 group by all")


@query("a05_compartment_intensity", _compartment_sql())
def compartment_intensity(spark, d):
    inner = views.labels_pred(spark, d).select(*grids.PIXEL, F.col("label").alias("inner_label"))
    return grids.compartments(views.labels_ref(spark, d).join(inner, grids.PIXEL), "inner_label", "v")


@query("a04_compartment_partition", sql("labels_ref", "labels_pred", then="select r.image_id, r.label, count(*) as cell, count(*) filter (p.label > 0) as nuclear, count(*) filter (p.label = 0) as cytoplasm from labels_ref r join labels_pred p using (image_id, y, x) where r.label > 0 group by all"))
def compartment_partition(spark, d):
    inner = views.labels_pred(spark, d).select(*grids.PIXEL, F.col("label").alias("inner_label"))
    c = grids.compartments(views.labels_ref(spark, d).join(inner, grids.PIXEL), "inner_label", "v")
    return c.select("image_id", "label", F.col("cell_pixels").alias("cell"), F.col("nuclear_pixels").alias("nuclear"), F.col("cytoplasm_pixels").alias("cytoplasm"))


_PAIRS = """pairs as (select r.image_id, r.label as ref, p.label as pred, count(*) as n from labels_ref r join labels_pred p using (image_id, y, x) group by all),
    ious as (select *, n / (ra + pa - n) as iou from (select *, sum(n) over (partition by image_id, ref) as ra, sum(n) over (partition by image_id, pred) as pa from pairs) where ref > 0 and pred > 0)"""


def _pairs(then: str) -> str:
    return sql("labels_ref", "labels_pred", then="").rstrip() + ", " + _PAIRS + " " + then


@query("j06_contingency_iou", _pairs("select image_id, ref, pred, n as both, cast(ra as bigint) as ref_area, cast(pa as bigint) as pred_area, round(iou, 8) as iou from ious"))
def contingency_iou(spark, d):
    return grids.overlaps(views.labels_ref(spark, d), views.labels_pred(spark, d)).withColumn("iou", F.round("iou", 8))


@query("j04_label_overlap_association", _pairs("""select image_id, pred as nucleus, arg_max(ref, (n, -ref)) filter (ref > 0) as cell, round(coalesce(max(n) filter (ref > 0), 0) / sum(n), 6) as share, round(coalesce(sum(n) filter (ref = 0), 0) / sum(n), 6) as outside, count(*) filter (ref > 0) > 1 as ambiguous from pairs where pred > 0 group by all"""))
def label_overlap_association(spark, d):
    return grids.associate(views.labels_pred(spark, d), views.labels_ref(spark, d))


@query("j05_association_rollup", _pairs("""select image_id, cell, string_agg(cast(nucleus as varchar), ',' order by nucleus) as nuclei, count(*) as n, count(*) filter (ambiguous) as ambiguous from (select image_id, pred as nucleus, arg_max(ref, (n, -ref)) filter (ref > 0) as cell, count(*) filter (ref > 0) > 1 as ambiguous from pairs where pred > 0 group by all) group by all"""))
def association_rollup(spark, d):
    return grids.association_rollup(grids.associate(views.labels_pred(spark, d), views.labels_ref(spark, d)))


@query("a20_region_agreement", sql("labels_ref", "labels_pred", then="""select *, round(common / joint, 6) as iou, round(2 * common / (reference + prediction), 6) as dice from (select image_id, count(*) filter (r.label > 0) as reference, count(*) filter (p.label > 0) as prediction, count(*) filter (r.label > 0 and p.label > 0) as common, count(*) filter (r.label > 0 or p.label > 0) as joint from labels_ref r join labels_pred p using (image_id, y, x) group by image_id)"""))
def region_agreement(spark, d):
    return grids.region_agreement(views.labels_ref(spark, d), views.labels_pred(spark, d))


#: Counts and scores of each image at IoU 0.5. On these tables no object has two partners there.
_AGREEMENT = _pairs("""select *, preds - tp as fp, refs - tp as fn, round(tp / preds, 6) as "precision", round(tp / refs, 6) as recall, round(2 * tp / (refs + preds), 6) as f1, preds - refs as count_error, round(abs(preds - refs) / refs, 6) as count_error_share
    from (select image_id, count(distinct label) filter (label > 0) as refs from labels_ref group by 1) join (select image_id, count(distinct label) filter (label > 0) as preds from labels_pred group by 1) using (image_id)
    join (select image_id, count(iou) filter (iou >= 0.5) as tp, round(avg(iou) filter (iou >= 0.5), 6) as mean_iou from (select distinct image_id from px) left join ious using (image_id) group by 1) using (image_id)
    join (select i.image_id, (select count(*) from (select ref from ious where ious.image_id = i.image_id group by ref having count(*) > 1)) as splits, (select count(*) from (select pred from ious where ious.image_id = i.image_id group by pred having count(*) > 1)) as merges,
        coalesce((select string_agg(cast(label as varchar), ',' order by label) from (select distinct label from labels_ref where image_id = i.image_id and label > 0 and label not in (select ref from ious where ious.image_id = i.image_id and iou >= 0.5))), '') as missed,
        coalesce((select string_agg(cast(label as varchar), ',' order by label) from (select distinct label from labels_pred where image_id = i.image_id and label > 0 and label not in (select pred from ious where ious.image_id = i.image_id and iou >= 0.5))), '') as surplus
        from (select distinct image_id from px) i) using (image_id)""")


@query("a21_instance_agreement", f'select image_id, tp, fp, fn, "precision", recall, f1, mean_iou, count_error, count_error_share, splits, merges, missed, surplus from ({_AGREEMENT})')
def instance_agreement(spark, d):
    return grids.instance_agreement(views.labels_ref(spark, d), views.labels_pred(spark, d), 0.5)


@query("j07_optimal_matching", _pairs("select image_id, ref, pred, round(iou, 8) as iou from ious where iou >= 0.5"))
def optimal_matching(spark, d):
    return grids.matches(views.labels_ref(spark, d), views.labels_pred(spark, d), 0.5).withColumn("iou", F.round("iou", 8))


@query("j07_optimal_matching_low")
def optimal_matching_low(spark, d):
    return grids.matches(views.labels_ref(spark, d), views.labels_pred(spark, d), 0.2).withColumn("iou", F.round("iou", 8))


@query("j08_cardinality_matching", _pairs("select image_id, count(iou) filter (iou >= 0.5) as pairs from (select distinct image_id from px) left join ious using (image_id) group by 1"))
def cardinality_matching(spark, d):
    return grids.instance_agreement(views.labels_ref(spark, d), views.labels_pred(spark, d), 0.5).select("image_id", F.col("tp").alias("pairs"))


@query("a22_model_agreement_macro", "with agreement as (" + _AGREEMENT + "), pixel as (" + sql("labels_ref", "labels_pred", then="select image_id, round(count(*) filter (r.label > 0 and p.label > 0) / count(*) filter (r.label > 0 or p.label > 0), 6) as iou from labels_ref r join labels_pred p using (image_id, y, x) group by 1") + """)
    select image_id % 2 as "group", count(*) as images, round(avg(f1), 5) as mean_f1, round(median(f1), 5) as median_f1, round(avg(iou), 5) as mean_pixel_iou, round(median(iou), 5) as median_pixel_iou, round(avg(abs(count_error)), 5) as mean_count_error, round(quantile_cont(100 * count_error_share, 0.9), 3) as p90_percent_error from agreement join pixel using (image_id) group by 1""")
def model_agreement_macro(spark, d):
    first, second = views.labels_ref(spark, d), views.labels_pred(spark, d)
    a = grids.instance_agreement(first, second, 0.5).join(grids.region_agreement(first, second).select("image_id", "iou"), "image_id")
    both = lambda c, name: [F.round(F.avg(c), 5).alias(f"mean_{name}"), F.round(F.median(c), 5).alias(f"median_{name}")]
    return a.groupBy((F.col("image_id") % 2).alias("group")).agg(F.count("*").alias("images"), *both("f1", "f1"), *both("iou", "pixel_iou"), F.round(F.avg(F.abs("count_error")), 5).alias("mean_count_error"), F.round(F.percentile(100 * F.col("count_error_share"), 0.9), 3).alias("p90_percent_error"))


@query("a23_validation_pooled", f"select cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) as f1, round(sum(tp) / (sum(tp) + sum(fp) + sum(fn)), 6) as ap, round(sum(preds - refs) / sum(refs), 6) as count_bias, round(median(100 * count_error_share), 3) as median_percent_error, round(quantile_cont(100 * count_error_share, 0.9), 3) as p90_percent_error from ({_AGREEMENT})")
def validation_pooled(spark, d):
    a = grids.instance_agreement(views.labels_ref(spark, d), views.labels_pred(spark, d), 0.5)
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    error = 100 * F.col("count_error_share")
    return a.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(2 * tp / (2 * tp + fp + fn), 6).alias("f1"), F.round(tp / (tp + fp + fn), 6).alias("ap"), F.round(F.try_divide(F.sum("count_error"), tp + fn), 6).alias("count_bias"), F.round(F.median(error), 3).alias("median_percent_error"), F.round(F.percentile(error, 0.9), 3).alias("p90_percent_error"))


@query("a17_colocalisation", sql("px", then="select image_id, round(corr(v, v2), 5) as pearson, round(sum(v) filter (v > 5 and v2 > 300) / sum(v) filter (v > 5), 6) as first_share, round(sum(v2) filter (v > 5 and v2 > 300) / sum(v2) filter (v2 > 300), 6) as second_share from px group by image_id"))
def colocalisation(spark, d):
    return grids.colocalisation(views.px(spark, d), "v", "v2", 5.0, 300.0)


@query("a15_label_change_sets", sql("labels_ref", "labels_pred", then="").rstrip() + """, pair as (select image_id, r.label as a, p.label as b from labels_ref r join labels_pred p using (image_id, y, x)),
    ids as (select image_id, a as label, true as before, false as after, false as touched from pair union all select image_id, b, false, true, false from pair union all select image_id, unnest([a, b]), false, false, true from pair where a <> b),
    each as (select image_id, label, bool_or(before) as before, bool_or(after) as after, bool_or(touched) as touched from ids where label > 0 group by all)
    select image_id, changed, coalesce(added, '') as added, coalesce(removed, '') as removed, coalesce(retained, '') as retained from (select image_id, count(*) filter (a <> b) as changed from pair group by 1) left join
    (select image_id, string_agg(cast(label as varchar), ',' order by label) filter (after and not before) as added, string_agg(cast(label as varchar), ',' order by label) filter (before and not after) as removed, string_agg(cast(label as varchar), ',' order by label) filter (before and after and touched) as retained from each group by 1) using (image_id)""")
def label_change_sets(spark, d):
    return grids.label_changes(views.labels_ref(spark, d), views.labels_pred(spark, d))


@query("f08_threshold_mask", sql("px", then="select 'bright' as side, image_id, y, x from px where v > 20 union all select 'dark', image_id, y, x from px where v < 1"))
def threshold_mask(spark, d):
    sided = F.when(F.col("v") > 20, "bright").when(F.col("v") < 1, "dark")  # equality is background
    return views.px(spark, d).select(sided.alias("side"), *grids.PIXEL).where("side is not null")


@query("f07_size_and_border_filter", sql("labels_ref", then="""select image_id, y, x, coalesce(new, 0) as label from labels_ref left join (select image_id, label, row_number() over (partition by image_id order by label) as new from (select image_id, label, count(*) as n, bool_or(x = 0 or y = 0 or x = 99 or y = 24) as edge from labels_ref where label > 0 group by all) where n >= 12 and not edge) using (image_id, label)"""))
def size_and_border_filter(spark, d):
    return grids.size_and_border(views.labels_ref(spark, d), 12, WIDTH, HEIGHT)


@query("w06_compact_labels", sql("labels_ref", then="select image_id, y, x, case when label = 0 then 0 else dense_rank() over (partition by image_id order by nullif(label, 0) nulls last) end as label from labels_ref"))
def compact_labels(spark, d):
    return grids.compact_labels(views.labels_ref(spark, d))


def _components_sql(mask: str, near: str, same: str = "") -> str:
    return sql("px", then="").replace("with ", "with recursive ", 1).rstrip() + f""", m as ({mask}),
    e as (select a.image_id, a.p as a, b.p as b from m a join {near} on true join m b on b.image_id = a.image_id and b.y = a.y + s.dy and b.x = a.x + s.dx {same}),
    walk(image_id, p, root) as (select image_id, p, p from m union select e.image_id, e.b, w.root from walk w join e on e.a = w.p and e.image_id = w.image_id and w.root < e.b),
    roots as (select image_id, p, min(root) as root from walk group by all)
    select image_id, y, x, dense_rank() over (partition by image_id order by root) as label from m join roots using (image_id, p)"""


_NUMBER = "(image_id * 25 + y) * 100 + x as p"
_NEAR8 = "(values (0, 1), (1, 0), (0, -1), (-1, 0), (1, 1), (-1, -1), (1, -1), (-1, 1)) as s(dy, dx)"


@query("g01_tiled_components", _components_sql(f"select image_id, y, x, {_NUMBER} from px where v > 15", _NEAR))
def tiled_components(spark, d):
    return grids.components(views.px(spark, d).where("v > 15").select(*grids.PIXEL), WIDTH, HEIGHT)


@query("g10_equal_value_components", _components_sql(f"select image_id, y, x, v2 % 3 as k, {_NUMBER} from px where v2 % 3 <> 0 and v > 12", _NEAR8, "and a.k = b.k"))
def equal_value_components(spark, d):
    return grids.components(views.px(spark, d).where("v2 % 3 <> 0 and v > 12").select(*grids.PIXEL, F.expr("v2 % 3").alias("k")), WIDTH, HEIGHT, "k", diagonal=True)


@query("g03_threshold_recipe", "select image_id, label, count(*) as pixels from (" + _components_sql(f"select image_id, y, x, {_NUMBER} from px where v > 15", _NEAR) + ") group by all having count(*) >= 2")
def threshold_recipe(spark, d):
    labelled = views.px(spark, d).where("v > 15").select(*grids.PIXEL).transform(grids.components, WIDTH, HEIGHT)
    return labelled.groupBy(*grids.OBJECT).agg(F.count("*").alias("pixels")).where("pixels >= 2")


@query("a27_morphometrics", sql("labels_ref", then=f"""select image_id, label, pixels, pixels * 4 - coalesce(inner_edges, 0) as edges, round(case when pixels > 1 then least(4 * pi() * pixels / pow(pixels * 4 - coalesce(inner_edges, 0), 2), 1) end, 6) as circularity,
    round(big, 6) as major, round(small, 6) as minor, round(case when pixels > 1 then sqrt(greatest(1 - small / big, 0)) end, 6) as eccentricity, round(case when not line then sqrt(big) / sqrt(small) end, 5) as elongation, case when pixels = 1 then 'one pixel' when line then 'pixels on a line' else '' end as reason
    from (select *, (a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c) as big, case when line then 0 else greatest((a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c), 0) end as small from (
        select image_id, label, count(*) as pixels, var_pop(x) as a, var_pop(y) as b, covar_pop(x, y) as c, (count(*) * sum(x * x) - sum(x) * sum(x)) * (count(*) * sum(y * y) - sum(y) * sum(y)) = pow(count(*) * sum(x * y) - sum(x) * sum(y), 2) as line from labels_ref where label > 0 group by all))
    left join (select a.image_id, a.label, count(*) as inner_edges from labels_ref a join {_NEAR} on true join labels_ref b on b.image_id = a.image_id and b.y = a.y + s.dy and b.x = a.x + s.dx and b.label = a.label where a.label > 0 group by all) using (image_id, label)"""))
def morphometrics(spark, d):
    return grids.morphometrics(views.labels_ref(spark, d))


@query("j13_perinuclear_ring", sql("labels_ref", then="""select image_id, nucleus, count(*) as pixels, round(avg(v), 6) as mean from (
    select p.image_id, p.y, p.x, p.v, min(n.label) as nucleus, max(n.label) as other from labels_ref p join labels_ref n on n.image_id = p.image_id and n.label > 0 and n.y between p.y - 2 and p.y + 2 and n.x between p.x - 2 and p.x + 2 and (n.y - p.y) * (n.y - p.y) + (n.x - p.x) * (n.x - p.x) <= 4 where p.label = 0 group by all)
    where nucleus = other group by all"""))
def perinuclear_ring(spark, d):
    return grids.rings(views.labels_ref(spark, d), 2, "v")


@query("a30_otsu_threshold", sql("px", then="""select image_id, round(low + (1 - neg) * (high - low) / 256, 6) as threshold from (select image_id, low, high, arg_max(-bin, (spread, -bin)) as neg from (
    select *, round(pow(m * total - alls * w, 2) / (w * (total - w)), 3) as spread from (select image_id, low, high, bin, sum(n) over p as w, sum(n * (bin + 0.5)) over p as m, sum(n) over (partition by image_id) as total, sum(n * (bin + 0.5)) over (partition by image_id) as alls
    from (select image_id, low, high, least(floor((v - low) / ((high - low) / 256)), 255) as bin, cast(count(*) as double) as n from px join (select image_id, min(v) as low, max(v) as high from px group by 1) using (image_id) where high > low group by all) window p as (partition by image_id order by bin rows unbounded preceding)) where w < total) group by all)"""))
def otsu_threshold(spark, d):
    return grids.otsu(views.px(spark, d), "v")


@query("p15_percentile_normalize", sql("px", then="select image_id, y, x, round(greatest(least((v - p[1]) / (p[2] - p[1]), 1), 0), 6) as value from px join (select image_id, quantile_cont(v, [0.01, 0.99]) as p from px group by 1) using (image_id)"))
def percentile_normalize(spark, d):
    return grids.normalized(views.px(spark, d), "v")


def _foot(radius: float) -> str:
    reach = range(-int(radius), int(radius) + 1)
    return ", ".join(f"({a}, {b}, 1.0::double)" for a in reach for b in reach if a * a + b * b <= radius * radius)


def _bell(sigma: float) -> str:
    """Weights of a Gaussian over its square, cut at four deviations."""
    import math

    reach = range(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1)
    w = {i: math.exp(-0.5 * (i / sigma) ** 2) for i in reach}
    total = sum(w.values())
    return ", ".join(f"({a}, {b}, {w[a] * w[b] / total**2!r}::double)" for a in reach for b in reach)


def _mirrored(table: str, steps: str, agg: str) -> str:
    """Of each pixel what a footprint sees; beyond the border the image is mirrored."""
    at = lambda c, n: f"case when a.{c} + s.d{c} < 0 then -1 - (a.{c} + s.d{c}) when a.{c} + s.d{c} >= {n} then 2 * {n} - 1 - (a.{c} + s.d{c}) else a.{c} + s.d{c} end"
    return f"select a.image_id, a.y, a.x, {agg} as v from {table} a join ext using (image_id) join (values {steps}) as s(dy, dx, w) on true join {table} b on b.image_id = a.image_id and b.y = {at('y', 'ext.h')} and b.x = {at('x', 'ext.w')} group by all"


_FILTERS = sql("px", then="").rstrip() + f""", ext as (select image_id, max(y) + 1 as h, max(x) + 1 as w from px group by 1),
    eroded as ({_mirrored('px', _foot(1.5), 'min(b.v)')}), dilated as ({_mirrored('px', _foot(2), 'max(b.v)')}), smooth as ({_mirrored('px', _bell(0.75), 'sum(s.w * b.v)')})
    select 'median' as op, image_id, y, x, round(v, 6) as value from ({_mirrored('px', _foot(1), 'median(b.v)')}) union all select 'opening', image_id, y, x, round(v, 6) from ({_mirrored('eroded', _foot(1.5), 'max(b.v)')})
    union all select 'closing', image_id, y, x, round(v, 6) from ({_mirrored('dilated', _foot(2), 'min(b.v)')}) union all select 'gaussian', image_id, y, x, round(v, 5) from smooth
    union all select 'background', image_id, y, x, round(px.v - smooth.v, 5) from px join smooth using (image_id, y, x)"""


@query("p17_stencil_processing", _FILTERS)
def stencil_processing(spark, d):
    p, out = views.px(spark, d), None
    for op, size in (("median", 1.0), ("opening", 1.5), ("closing", 2.0), ("gaussian", 0.75), ("background", 0.75)):
        # Each image is whole, or ends with its last row.
        one = filters.filtered(p, "v", op, size).select(F.lit(op).alias("op"), *grids.PIXEL, F.round("value", 5 if op in ("gaussian", "background") else 6).alias("value"))
        out = one if out is None else out.union(one)
    return out


@query("p16_pointwise_processing", sql("px", then="select image_id, y, x, floor(greatest((v - 1) * mean_flat / (v2 + 1), 0) * 1000) / 1000.0::double as value from px join (select image_id, avg(v2 + 1) as mean_flat from px group by 1) using (image_id)"))
def pointwise_processing(spark, d):
    p = views.px(spark, d)
    flat = p.groupBy("image_id").agg(F.avg(F.col("v2") + 1).alias("mean_flat"))
    return p.join(flat, "image_id").select(*grids.PIXEL, (F.floor(F.greatest((F.col("v") - 1) * F.col("mean_flat") / (F.col("v2") + 1), F.lit(0.0)) * 1000) / 1000.0).alias("value"))


@query("p25_centroid_offset_targets", sql("labels_ref", then="select image_id, y, x, round(greatest(least((cy - y) / 2, 1), -1), 6) + 0.0 as dy, round(greatest(least((cx - x) / 2, 1), -1), 6) + 0.0 as dx from labels_ref join (select image_id, label, avg(y) as cy, avg(x) as cx from labels_ref where label > 0 group by all) using (image_id, label)"))
def centroid_offset_targets(spark, d):
    return grids.centroid_offsets(views.labels_ref(spark, d), 2.0)


@query("j26_object_locate", sql("labels_ref", then="select image_id, label, y, x from (select *, row_number() over (partition by image_id, label order by round(pow(y - cy, 2) + pow(x - cx, 2), 6), y, x) as k from labels_ref join (select image_id, label, avg(y) as cy, avg(x) as cx from labels_ref where label > 0 group by all) using (image_id, label)) where k = 1"))
def object_locate(spark, d):
    return grids.located(views.labels_ref(spark, d))


@query("j25_pixel_pick", sql("labels_ref", then="select p.image_id, p.label, n, mean from labels_ref p left join (select image_id, label, count(*) as n, round(avg(v), 6) as mean from labels_ref where label > 0 group by all) using (image_id, label) where p.y = 7 and p.x = 33"))
def pixel_pick(spark, d):
    g = views.labels_ref(spark, d)
    stats = g.where("label > 0").groupBy(*grids.OBJECT).agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))
    return g.where("y = 7 and x = 33").select(*grids.OBJECT).join(stats, grids.OBJECT, "left")


@query("a34_z_projection", sql("px", then="select y, x, max(v) as most, round(avg(v), 6) as mean from px where image_id between 1 and 3 group by all"))
def z_projection(spark, d):
    return views.px(spark, d).where("image_id between 1 and 3").groupBy("y", "x").agg(F.max("v").alias("most"), F.round(F.avg("v"), 6).alias("mean"))


@query("a33_display_range", sql("px", then="select image_id, min(v) as low, case when max(v) > min(v) then max(v) else min(v) + 1 end as high from px group by 1"))
def display_range(spark, d):
    return views.px(spark, d).groupBy("image_id").agg(F.min("v").alias("low"), F.when(F.max("v") > F.min("v"), F.max("v")).otherwise(F.min("v") + 1).alias("high"))


@query("a35_size_summary", sql("labels_ref", then="select image_id, count(*) as n, cast(sum(a) as bigint) as total, round(avg(a), 6) as mean, median(a) as median, min(a) as least, max(a) as greatest, count(*) filter (edge) as border from (select image_id, label, count(*) as a, bool_or(x = 0 or y = 0 or x = 99 or y = 24) as edge from labels_ref where label > 0 group by all) group by image_id"))
def size_summary(spark, d):
    m = grids.object_measures(views.labels_ref(spark, d), [], WIDTH, HEIGHT)
    return m.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("pixels").alias("total"), F.round(F.avg("pixels"), 6).alias("mean"), F.median("pixels").alias("median"), F.min("pixels").alias("least"), F.max("pixels").alias("greatest"), F.count_if("border").alias("border"))


@query("a36_basic_region_props", sql("labels_ref", then="""select image_id, label, area, cy as centroid_y, cx as centroid_x, round(sqrt(4 * area / pi()), 6) as equivalent_diameter, round(100.0 * area / 2500, 6) as confluence,
    round(case when area > 1 then sqrt(greatest(1 - greatest((a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c), 0) / ((a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c)), 0)) end, 6) as eccentricity
    from (select image_id, label, count(*) as area, round(avg(y), 6) as cy, round(avg(x), 6) as cx, var_pop(x) as a, var_pop(y) as b, covar_pop(x, y) as c from labels_ref where label > 0 group by all)"""))
def basic_region_props(spark, d):
    g = views.labels_ref(spark, d)
    own = grids.object_measures(g, [], WIDTH, HEIGHT).select(*grids.OBJECT, F.col("pixels").alias("area"), "centroid_y", "centroid_x")
    area = F.col("area")
    shape = grids.morphometrics(g).select(*grids.OBJECT, "eccentricity")
    return own.join(shape, grids.OBJECT).select(*grids.OBJECT, "area", "centroid_y", "centroid_x", F.round(F.sqrt(4 * area / F.pi()), 6).alias("equivalent_diameter"), F.round(100.0 * area / (WIDTH * HEIGHT), 6).alias("confluence"), "eccentricity")


@query("a41_overlap_blend", sql("px", then="select image_id, y, x, round(sum(w * v) / sum(w), 6) as value from (select image_id, y, x, v, 1.0 as w from px union all select image_id, y, x, v2, 0.5 from px where x % 10 < 3) group by all"))
def overlap_blend(spark, d):
    p = views.px(spark, d)
    tiles = p.select(*grids.PIXEL, "v", F.lit(1.0).alias("w")).union(p.where("x % 10 < 3").select(*grids.PIXEL, "v2", F.lit(0.5)))
    return tiles.groupBy(*grids.PIXEL).agg(F.round(F.sum(F.col("w") * F.col("v")) / F.sum("w"), 6).alias("value"))


@query("a49_label_file_stats", sql("labels_ref", then="select image_id, count(distinct label) filter (label > 0) as instances, count(distinct label) filter (label > 0) = 0 as zero_instance_mask, coalesce(max(label) <> count(distinct label) filter (label > 0), false) as non_contiguous from labels_ref group by 1"))
def label_file_stats(spark, d):
    g = views.labels_ref(spark, d).groupBy("image_id").agg(F.count_distinct(F.when(F.col("label") > 0, F.col("label"))).alias("instances"), F.max("label").alias("most"))
    return g.select("image_id", "instances", (F.col("instances") == 0).alias("zero_instance_mask"), (F.col("most") != F.col("instances")).alias("non_contiguous"))


@query("a51_label_coverage", sql("labels_ref", then="select image_id, count(distinct label) filter (label > 0) as regions, count(*) filter (label > 0) as labelled, round(avg(case when label > 0 then 1.0 else 0.0 end), 6) as fraction from labels_ref group by 1"))
def label_coverage(spark, d):
    on = F.col("label") > 0
    return views.labels_ref(spark, d).groupBy("image_id").agg(F.count_distinct(F.when(on, F.col("label"))).alias("regions"), F.count_if(on).alias("labelled"), F.round(F.avg(F.when(on, 1.0).otherwise(0.0)), 6).alias("fraction"))


@query("a47_object_qc_status", sql("labels_ref", then="""select image_id, label, case when inside = 0 then 'outside_focus' when edge then 'image_edge_rejected' when inside < n then 'focus_partial_rejected' when n < 6 then 'area_rejected' else 'accepted' end as status
    from (select image_id, label, count(*) as n, count(*) filter (v2 > 20) as inside, bool_or(x = 0 or y = 0 or x = 99 or y = 24) as edge from labels_ref where label > 0 group by all)"""))
def object_qc_status(spark, d):
    g = views.labels_ref(spark, d).where("label > 0").groupBy(*grids.OBJECT).agg(F.count("*").alias("n"), F.count_if(F.col("v2") > 20).alias("inside"), F.bool_or(F.expr(f"x = 0 or y = 0 or x = {WIDTH - 1} or y = {HEIGHT - 1}")).alias("edge"))
    status = F.when(F.col("inside") == 0, "outside_focus").when(F.col("edge"), "image_edge_rejected").when(F.col("inside") < F.col("n"), "focus_partial_rejected").when(F.col("n") < 6, "area_rejected").otherwise("accepted")
    return g.select(*grids.OBJECT, status.alias("status"))


@query("a48_alignment_quality", sql("px", then="select *, coalesce(fraction >= 0.5 and correlation >= -0.01, false) as accepted from (select a.image_id, count(*) as overlap, round(count(*) / 2500.0, 6) as fraction, case when max(a.v) > min(a.v) and max(b.v) > min(b.v) then round(corr(a.v, b.v), 5) end as correlation from px a join px b on a.image_id = b.image_id and b.x = a.x + 3 and b.y = a.y + 1 group by 1)"))
def alignment_quality(spark, d):
    return grids.alignment(views.px(spark, d), "v", 1, 3, WIDTH * HEIGHT, least_overlap=0.5, least_correlation=-0.01)


@query("a18_field_assay", sql("labels_ref", then="").rstrip() + """, bg as (select image_id, median(v) as bg from labels_ref where label = 0 group by 1), nuclei as (select image_id, label, avg(v) - any_value(bg) > 2 as positive from labels_ref join bg using (image_id) where label > 0 group by all)
    select image_id, integral, nuclei, round(integral_ / nuclei, 5) as per_nucleus, positive_fraction, saturated from (select image_id, sum(v - bg) filter (label > 0) as integral_, round(sum(v - bg) filter (label > 0), 4) as integral, count(*) filter (v >= 50) as saturated from labels_ref join bg using (image_id) group by 1)
    join (select image_id, count(*) as nuclei, round(avg(case when positive then 1.0 else 0.0 end), 6) as positive_fraction from nuclei group by 1) using (image_id)""")
def field_assay(spark, d):
    return grids.field_assay(views.labels_ref(spark, d), "v", saturated=50.0, above=2.0)


#: A turned, sheared grid of 0.5 by 0.7 um, cropped at plane 2, row 3, column 7.
_AFFINE = [[0.4, 0.32, 0.0, 3.0], [-0.3, 0.64, 0.0, -2.0], [0.05, 0.0, 2.0, 1.0], [0.0, 0.0, 0.0, 1.0]]


@query("p10_world_coordinates", sql("px", then="""select image_id, y, x, round(0.4::double * (x + 7) + 0.32::double * (y + 3) + 3, 6) as wx, round(-0.3::double * (x + 7) + 0.64::double * (y + 3) - 2, 6) as wy, round(0.05::double * (x + 7) + 2 * (image_id % 4 + 2) + 1, 6) as wz,
    cast(image_id % 4 as double) as back_z, cast(y as double) as back_y, cast(x as double) as back_x, 2.0::double as spacing_z, round(sqrt(0.32 * 0.32 + 0.64 * 0.64), 6)::double as spacing_y, round(sqrt(0.4 * 0.4 + 0.3 * 0.3 + 0.05 * 0.05), 6)::double as spacing_x from px"""))
def world_coordinates(spark, d):
    geometry = typed_cells.Geometry(_AFFINE, "ZYX").cropped([2, 3, 7])
    at = views.px(spark, d).withColumn("z", F.col("image_id") % 4)
    at = at.withColumns({f"w{a}": c for a, c in zip("xyz", geometry.world([F.col(a) for a in "zyx"]))})
    at = at.withColumns({f"back_{a}": F.round(c, 6) + 0.0 for a, c in zip("zyx", geometry.index([F.col(f"w{a}") for a in "xyz"]))})
    at = at.withColumns({f"spacing_{a}": F.round(F.lit(s), 6) for a, s in zip("zyx", geometry.spacing())})
    return at.select(*grids.PIXEL, *(F.round(f"w{a}", 6).alias(f"w{a}") for a in "xyz"), *(f"{k}_{a}" for k in ("back", "spacing") for a in "zyx"))


@query("h04_label_grid_hash", sql("labels_ref", then="select image_id, sha256(string_agg(d, ',' order by y)) as digest from (select image_id, y, sha256(string_agg(cast(label as varchar), ',' order by x)) as d from labels_ref group by all) group by 1"))
def label_grid_hash(spark, d):
    ordered = lambda key, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda s: s[value].cast("string")), ",")
    rows = views.labels_ref(spark, d).groupBy("image_id", "y").agg(F.sha2(ordered("x", "label"), 256).alias("d"))
    return rows.groupBy("image_id").agg(F.sha2(ordered("y", "d"), 256).alias("digest"))


@query("h08_measurement_reconcile", sql("labels_ref", then="select image_id, label, count(*) as pixels, round(avg(v), 6) as mean, round(stddev_pop(v), 5) as sd, true as agrees from labels_ref where label > 0 group by all"))
def measurement_reconcile(spark, d):
    g = views.labels_ref(spark, d)
    a = grids.object_measures(g, ["v"], WIDTH, HEIGHT).select(*grids.OBJECT, "pixels", F.col("v_mean").alias("mean"), F.col("v_sd").alias("sd"))
    b = grids.tiled_measures(g, "v", 4).select(*grids.OBJECT, F.col("pixels").alias("n"), F.col("mean").alias("mean2"), F.col("sd").alias("sd2"))
    near = lambda c: F.abs(F.col(c) - F.col(f"{c}2")) <= 1e-5 + 1e-6 * F.abs(f"{c}2")
    agrees = F.coalesce((F.col("pixels") == F.col("n")) & near("mean") & near("sd"), F.lit(False))
    # What is given comes from the tiles, and is compared with SQL over the whole.
    return a.join(b, grids.OBJECT, "full_outer").select(*grids.OBJECT, F.col("n").alias("pixels"), F.col("mean2").alias("mean"), F.col("sd2").alias("sd"), agrees.alias("agrees"))


@query("x03_probability_postprocess", "select image_id, label, count(*) as pixels from (" + _components_sql(f"select image_id, y, x, {_NUMBER} from px where least(v / 50, 1) >= 0.4", _NEAR) + ") group by all having count(*) >= 2")
def probability_postprocess(spark, d):
    on = views.px(spark, d).where(F.least(F.col("v") / 50, F.lit(1.0)) >= 0.4).select(*grids.PIXEL)
    return grids.components(on, WIDTH, HEIGHT).groupBy(*grids.OBJECT).agg(F.count("*").alias("pixels")).where("pixels >= 2")


#: Corrections of each image; the last one, of every second image, may run over another object.
_CORRECTIONS = [("merge", 2, [2, 3], None, None), ("delete", 7, None, None, None), ("paint", 45, None, [(21.0, 12.0), (23.0, 12.0)], 1.5), ("erase", 66, None, [(27.0, 17.0)], 1.0), ("delete", 88, None, None, None), ("polygon_add", 900, None, [(35.0, 20.0), (38.0, 20.0), (38.0, 23.0), (35.0, 23.0)], None), ("paint", 1000, None, [(50.0, 10.0)], 2.0)]
_PATH = "(p.y - 12) * (p.y - 12) + pow(p.x - least(greatest(p.x, 21), 23), 2) <= 2.25"


@query("u06_label_corrections", sql("labels_ref", then="").rstrip() + f""", p as (select *, case when label in (2, 3) then 2 when label in (7, 88) then 0 else label end as merged from labels_ref), c as (select image_id, count(distinct label) filter (label in (2, 3)) as two, count(*) filter (label = 7) as seven, count(*) filter (label = 3) as three, count(*) filter (label = 88) as old,
        count(*) filter ({_PATH} and merged not in (0, 45)) as hit3, count(*) filter ({_PATH} and merged = 0) as new3, count(*) filter ((y - 17) * (y - 17) + (x - 27) * (x - 27) <= 1 and merged not in (0, 66)) as hit4, count(*) filter ((y - 17) * (y - 17) + (x - 27) * (x - 27) <= 1 and merged = 66) as gone4,
        count(*) filter (y between 20 and 23 and x between 35 and 38 and merged <> 0) as hit6, count(*) filter (y between 20 and 23 and x between 35 and 38) as new6, count(*) filter (image_id % 2 = 0 and (y - 10) * (y - 10) + (x - 50) * (x - 50) <= 4 and merged <> 0) as hit7 from p group by 1),
    ok as (select image_id, two = 2 and three > 0 and seven > 0 and hit3 = 0 and new3 > 0 and hit4 = 0 and gone4 > 0 and old > 0 and hit6 = 0 and new6 > 0 and hit7 = 0 as fine from c)
    select image_id, y, x, case when not fine then label when {_PATH} then 45 when (y - 17) * (y - 17) + (x - 27) * (x - 27) <= 1 and merged = 66 then 0 when y between 20 and 23 and x between 35 and 38 then 900 when fine and image_id % 2 = 0 and (y - 10) * (y - 10) + (x - 50) * (x - 50) <= 4 then 1000 else merged end as label from p join ok using (image_id)""")
def label_corrections(spark, d):
    g = views.labels_ref(spark, d)
    place = lambda points: [{"x": x, "y": y} for x, y in points] if points else None
    asked = spark.createDataFrame([(i, op, label, labels, place(points), radius) for i, (op, label, labels, points, radius) in enumerate(_CORRECTIONS, 1)], "seq long, op string, label long, labels array<long>, points array<struct<x:double,y:double>>, radius double")
    asked = g.select("image_id").distinct().join(F.broadcast(asked)).where("seq < 7 or image_id % 2 = 0")
    return corrections.correct_labels(g, asked, WIDTH, HEIGHT)[0].select(*grids.PIXEL, "label")


@query("a40_centre_votes", sql("px", then="select image_id, least(greatest(y + cast(floor(v) as bigint) % 3 - 1, 0), 24) as cy, least(greatest(x + cast(v2 as bigint) % 3 - 1, 0), 99) as cx, count(*) as votes from px where v > 5 group by all"))
def centre_votes(spark, d):
    at = views.px(spark, d).where("v > 5").selectExpr("image_id", "least(greatest(y + cast(floor(v) as bigint) % 3 - 1, 0), 24) as cy", "least(greatest(x + cast(v2 as bigint) % 3 - 1, 0), 99) as cx")
    return at.groupBy("image_id", "cy", "cx").agg(F.count("*").alias("votes"))
