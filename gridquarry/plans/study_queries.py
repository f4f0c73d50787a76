"""Queries on studies, manifests, packages and tracks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.operators import gates, sheets, splits, studies, tracks
from gridquarry.sources import views
from gridquarry.sources.views import sql, table
from gridquarry.sources.workspace import shuffled, written

from .catalog import query

_OBS = sql("obs", then="").rstrip() + ", o as (select image_id, value, quantity, case review when 'F' then 'excluded' when 'P' then 'pending' else 'reviewed' end as review, condition, replicate, nation from obs), images as (select image_id, review, condition, replicate, count(value) as objects, avg(value) as mean from o group by all), reps as (select condition, replicate, count(*) as images, sum(objects) as objects, avg(mean) as mean from images where review <> 'excluded' and replicate is not null group by all) "


def _obs(spark, d):
    review = F.when(F.col("review") == "F", "excluded").when(F.col("review") == "P", "pending").otherwise("reviewed")
    return views.obs(spark, d).withColumn("review", review)


_CONDITIONS = "select c.condition, coalesce(replicates, 0) as replicates, cast(coalesce(images, 0) as bigint) as images, cast(coalesce(objects, 0) as bigint) as objects, mean, sd from (select distinct condition from images) c left join (select condition, count(*) as replicates, sum(images) as images, sum(objects) as objects, round(avg(mean), 6) as mean, round(stddev_samp(mean), 5) as sd from reps group by 1) using (condition)"


@query("a09_intensity_hierarchy", _OBS + _CONDITIONS)
def intensity_hierarchy(spark, d):
    return studies.condition_summary(_obs(spark, d))


@query("a10_inclusion_audit", _OBS + "select condition, case when review = 'excluded' then 'excluded-by-review' when mean is null then 'no-valid-object-means' when replicate is null then 'missing-biological-replicate' else 'included' end as reason, count(*) as images from images group by all")
def inclusion_audit(spark, d):
    return studies.inclusion(studies.image_means(_obs(spark, d))).groupBy("condition", "reason").agg(F.count("*").alias("images"))


@query("a11_study_summary_measurements", _OBS.replace("count(value) as objects, avg(value)", "count(quantity) as objects, avg(quantity)") + _CONDITIONS)
def study_summary_measurements(spark, d):
    return studies.condition_summary(_obs(spark, d), "quantity")


@query("f12_review_gate", _OBS + "select condition, count(*) filter (review = 'pending') = 0 as comparable, count(*) filter (review = 'pending') as pending from images group by 1")
def review_gate(spark, d):
    pending = F.count_if(F.col("review") == "pending")
    return studies.image_means(_obs(spark, d)).groupBy("condition").agg((pending == 0).alias("comparable"), pending.alias("pending"))


@query("h06_report_recompute", _OBS + "select 'saved' as report, 'same' as verdict, cast(0 as bigint) as differences union all select 'altered', 'changed', cast(2 as bigint)")
def report_recompute(spark, d):
    again = studies.condition_summary(_obs(spark, d))
    saved = written(again)
    first = saved.agg(F.min("condition").alias("_c"))
    altered = saved.join(F.broadcast(first)).withColumn("mean", F.when(F.col("condition") == F.col("_c"), F.col("mean") + 0.01).otherwise(F.col("mean"))).drop("_c")
    return studies.report_verdict("saved", saved, again).union(studies.report_verdict("altered", written(altered), again))


_BANDS = [0.0, 10000.0, 30000.0, 60000.0]
_BAND_SQL = "case when value >= 0 and value < 60000 then (case when value >= 10000 then 1 else 0 end) + (case when value >= 30000 then 1 else 0 end) end"


@query("j11_band_assignment", sql("obs", then=f"select {_BAND_SQL} as band, count(*) as n from obs group by 1"))
def band_assignment(spark, d):
    return views.obs(spark, d).groupBy(studies.band(F.col("value"), _BANDS).alias("band")).agg(F.count("*").alias("n"))


_FIELDS = f"fields as (select condition, nation as donor, {_BAND_SQL} as band, count(*) as n, sum(quantity) as area from obs group by all)"


def _fields(spark, d):
    f = views.obs(spark, d).groupBy("condition", F.col("nation").alias("donor"), studies.band(F.col("value"), _BANDS).alias("band")).agg(F.count("*").alias("n"), F.sum("quantity").alias("area"))
    return f.where("band is not null")


@query("a12_donor_density", sql("obs", then="").rstrip() + f", {_FIELDS} select c.condition, b.band, coalesce(donors, 0) as donors, mean, sd, median from (select distinct condition from fields) c cross join (select cast(unnest(range(0, 3)) as int) as band) b left join (select condition, band, count(n / area) as donors, round(avg(n / area), 6) as mean, round(stddev_samp(n / area), 5) as sd, round(median(n / area), 6) as median from fields where band is not null group by all) using (condition, band)")
def donor_density(spark, d):
    return studies.donor_density(_fields(spark, d), 3)


_DONORS = ", donors as (select condition, nation as donor, avg(value) as mean from obs where (nation + length(condition)) % 5 <> 0 group by all) "


def _donors(spark, d):
    return views.obs(spark, d).where((F.col("nation") + F.length("condition")) % 5 != 0).groupBy("condition", F.col("nation").alias("donor")).agg(F.avg("value").alias("mean"))


@query("j17_matched_donor_pairs", sql("obs", then="").rstrip() + _DONORS + "select donor, round(b.mean - a.mean, 6) as difference from (select * from donors where condition = '1-URGENT') a join (select * from donors where condition = '5-LOW') b using (donor)")
def matched_donor_pairs(spark, d):
    return studies.matched_pairs(_donors(spark, d), "1-URGENT", "5-LOW")


@query("j18_unmatched_donors", sql("obs", then="").rstrip() + _DONORS + "select donor, min(condition) as condition from donors where condition in ('1-URGENT', '5-LOW') group by 1 having count(distinct condition) = 1")
def unmatched_donors(spark, d):
    return studies.unmatched(_donors(spark, d), "1-URGENT", "5-LOW")


def _year_means(spark, d, year):
    o = table(spark, d, "orders").where(F.year("o_orderdate") == year)
    return o.groupBy(F.col("o_orderpriority").alias("condition")).agg(F.avg("o_totalprice").alias("mean"))


@query("j19_run_comparison", """select condition, round(a.mean, 6) as "left", round(b.mean, 6) as "right", round(b.mean - a.mean, 6) as difference from (select o_orderpriority as condition, avg(o_totalprice) as mean from orders where year(o_orderdate) = 1996 group by 1) a full join (select o_orderpriority as condition, avg(o_totalprice) as mean from orders where year(o_orderdate) = 1997 group by 1) b using (condition)""")
def run_comparison(spark, d):
    return studies.compare_summaries(_year_means(spark, d, 1996), _year_means(spark, d, 1997), "condition")


@query("j16_before_after_pairing", """select nation, round(a.mean, 6) as "left", round(b.mean, 6) as "right", round(b.mean - a.mean, 6) as difference from (select c_nationkey as nation, avg(c_acctbal) as mean from customer group by 1) a full join (select s_nationkey as nation, avg(s_acctbal) as mean from supplier group by 1) b using (nation)""")
def before_after_pairing(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("mean"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.avg("s_acctbal").alias("mean"))
    return studies.compare_summaries(a, b, "nation")


@query("a14_correction_effect", """select region, round(avg(b - a), 6) as effect, count(b - a) as pairs, count(*) filter (b is null or a is null) as omitted from (select c_nationkey as nation, avg(c_acctbal) as a from customer group by 1) full join (select s_nationkey as nation, avg(s_acctbal) as b from supplier group by 1) using (nation) join (select n_nationkey as nation, n_regionkey as region from nation) using (nation) group by 1""")
def correction_effect(spark, d):
    paired = before_after_pairing(spark, d)
    region = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    return paired.join(region, "nation").groupBy("region").agg(F.round(F.avg("difference"), 6).alias("effect"), F.count("difference").alias("pairs"), F.count_if(F.col("difference").isNull()).alias("omitted"))


_STRATA = "select 'condition' as dimension, condition as name, count(*) as n, round(median(value), 6) as median from obs group by 2 union all select 'review', review, count(*), round(median(value), 6) from obs group by 2"


@query("a24_stratified_summary", sql("obs", then=f"select *, row_number() over (partition by dimension order by median desc, name) = 1 as worst from ({_STRATA})"))
def stratified_summary(spark, d):
    long = views.obs(spark, d).unpivot(["value"], ["condition", "review"], "dimension", "name")
    strata = long.groupBy("dimension", "name").agg(F.count("*").alias("n"), F.round(F.median("value"), 6).alias("median"))
    # A row a stratum: the worst of each dimension is the one with the largest median.
    return strata.withColumn("worst", F.row_number().over(W.partitionBy("dimension").orderBy(F.desc("median"), "name")) == 1)


@query("a25_extended_median", sql("objects", then="""select brand, case when count(*) = 0 then 'none' when median(coalesce(size, 'inf'::double)) = 'inf'::double then 'infinite' else 'finite' end as kind, nullif(round(median(coalesce(size, 'inf'::double)), 6), 'inf'::double) as median from objects group by 1
    union all select 'Brand#00', 'none', null union all select 'missing', 'infinite', null"""))
def extended_median(spark, d):
    o = views.objects(spark, d).select("brand", "size")
    lost = o.select(F.lit("missing").alias("brand"), F.lit(None).cast("double").alias("size"))
    every = o.select("brand").distinct().union(spark.createDataFrame([("Brand#00",), ("missing",)], "brand string"))
    return studies.extended_medians(every, o.union(lost), "brand", "size")


@query("a26_control_z_prime", "select round(1 - 3 * (stddev_samp(c_acctbal) filter (c_mktsegment = 'BUILDING') + stddev_samp(c_acctbal) filter (c_mktsegment = 'MACHINERY')) / abs(avg(c_acctbal) filter (c_mktsegment = 'BUILDING') - avg(c_acctbal) filter (c_mktsegment = 'MACHINERY')), 6) as z_prime from customer")
def control_z_prime(spark, d):
    return studies.z_prime(table(spark, d, "customer").select(F.col("c_mktsegment").alias("control"), F.col("c_acctbal").alias("value")), "BUILDING", "MACHINERY")


@query("a43_count_outliers", """with c as (select o_orderkey, c_nationkey as nation, sum(l_quantity) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all), m as (select nation, median(n) as middle, count(*) as k from c group by 1), f as (select c.*, abs(n - middle) as off_ from c join m using (nation) where k >= 8), s as (select nation, median(off_) as mad from f group by 1)
select o_orderkey, off_ as deviation, mad from f join s using (nation) where mad > 0 and 0.6745::double * off_ > 2.0::double * mad""")
def count_outliers(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = joined.groupBy("o_orderkey", F.col("c_nationkey").alias("nation")).agg(F.sum("l_quantity").alias("n_"))
    return studies.outliers(counts, "nation", "n_", limit=2.0).select("o_orderkey", F.col("off").alias("deviation"), "mad")


@query("f06_structural_quality_flags", """with i as (select l_orderkey as image, count(*) as objects, sum(l_quantity) / 4.0 as coverage, max(l_quantity) / sum(l_quantity) * 100 as largest from lineitem group by 1)
select image, case when coverage >= 80 or largest >= 50 then 'error' when coverage >= 60 or coverage <= 0.05 or largest >= 20 then 'warning' else 'ok' end as status from i""")
def structural_quality_flags(spark, d):
    i = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(F.count("*").alias("objects"), (F.sum("l_quantity") / 4.0).alias("coverage"), (F.max("l_quantity") / F.sum("l_quantity") * 100).alias("largest"))
    return studies.quality_flags(i).select("image", "status")


@query("f09_release_gates", sql("obs", then="select 'mean' as metric, true as evaluated, avg(value) >= 100 as passed from obs union all select 'n', true, count(*) <= 10 from obs union all select 'sum', false, null from obs group by ()"))
def release_gates(spark, d):
    one = views.obs(spark, d).agg(F.avg("value").alias("mean"), F.count("*").cast("double").alias("n"), F.sum("value").alias("sum"))
    return studies.gates(one.unpivot([], ["mean", "n", "sum"], "metric", "value"), {"mean": (">=", 100.0), "n": ("<=", 10.0)})


@query("w11_latest_active_result", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderpriority desc, o_orderkey desc) as k from orders) where k = 1")
def latest_active_result(spark, d):
    return studies.latest(table(spark, d, "orders"), "o_custkey", F.col("o_orderdate").desc(), F.col("o_orderpriority").desc(), F.col("o_orderkey").desc()).select("o_custkey", "o_orderkey")


@query("j01_sample_join", "select o_orderkey, c_mktsegment as condition, case when c_custkey is null then 'missing-metadata' when c_mktsegment = 'HOUSEHOLD' then 'missing-replicate' else 'ok' end as reason from orders left join (select * from customer where c_custkey % 10 <> 0) on o_custkey = c_custkey")
def sample_join(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 10 <> 0")
    j = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("o_orderkey", F.col("c_mktsegment").alias("condition"), F.when(F.col("c_custkey").isNull(), "missing-metadata").when(F.col("c_mktsegment") == "HOUSEHOLD", "missing-replicate").otherwise("ok").alias("reason"))


@query("j02_conflicting_binding_check", "select o_custkey from orders group by 1 having count(distinct o_orderstatus || '|' || o_orderpriority) > 1")
def conflicting_binding_check(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct(F.struct("o_orderstatus", "o_orderpriority")).alias("n"))
    return g.where("n > 1").select("o_custkey")


@query("j03_group_membership_semi", "select l_orderkey, l_linenumber from lineitem where l_partkey in (select p_partkey from part where p_size between 10 and 20)")
def group_membership_semi(spark, d):
    group = table(spark, d, "part").where("p_size between 10 and 20").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").join(group, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("j21_source_label_pairing", """with labels_ as (select doc_id, lower('DOC' || doc_id) as stem from labels), sources as (select doc_id, lower('Doc' || doc_id) as stem from documents where doc_id % 9 <> 1 union all select doc_id, lower('dOC' || doc_id) from documents where doc_id % 9 = 2)
    select l.doc_id, case count(s.stem) when 0 then 'none' when 1 then 'paired' else 'several' end as verdict from labels_ l left join sources s using (stem) group by 1""")
def source_label_pairing(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    name = lambda case: F.concat(F.lit(case), F.col("doc_id").cast("string"), F.lit(".tif")).alias("name")
    sources = docs.where("doc_id % 9 <> 1").select(name("Doc")).union(docs.where("doc_id % 9 = 2").select(name("dOC")))
    return studies.stem_pairs(labels.select("doc_id", name("DOC")), sources).select("doc_id", "verdict")


_PATHS = "paths as (select doc_id, 'Raw//' || source || '/./' || lang || '/B' || doc_id % 40 || '/f' || doc_id || '.tif' as path, lower('raw/' || source || '/' || lang || '/b' || doc_id % 40 || '/f' || doc_id || '.tif') as clean from documents where doc_id % 25 <> 3 union all select doc_id, '../f' || doc_id, null from documents where doc_id % 25 = 3)"
#: Rules of three depths: a language of a source, one of its folders, single files. Some folders and files contradict what is above them.
_RULES = "rules as (select distinct 'raw/' || lower(source) || '/' || lang as prefix, case when ascii(substr(lang, 1, 1)) % 3 = 0 then 'train' else 'test' end as split from documents where lang <> 'fr' union select distinct 'raw/' || lower(source) || '/' || lang || '/b' || doc_id % 40, case when doc_id % 40 % 4 = 0 then 'validation' when ascii(substr(lang, 1, 1)) % 3 = 0 then 'train' else 'test' end from documents where doc_id % 40 < 20 union select 'raw/' || lower(source) || '/' || lang || '/b' || doc_id % 40 || '/f' || doc_id || '.tif', 'test' from documents where doc_id % 10 = 7)"


@query("j22_prefix_split_assignment", f"with {_PATHS}, {_RULES}, hit as (select doc_id, array_to_string(list_sort(list(distinct split)), ',') as splits, arg_max(prefix, length(prefix)) as rule from paths join rules on clean = prefix or starts_with(clean, prefix || '/') group by 1) select doc_id, case when clean is null then 'refused' when splits is null then 'unassigned' when not contains(splits, ',') then splits end as split, rule, coalesce(splits, '') as splits from paths left join hit using (doc_id)")
def prefix_split_assignment(spark, d):
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    text = lambda *c: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in c))
    folder, name = (k % 40).cast("string"), text("/f", k.cast("string"), ".tif")
    path = F.when(k % 25 == 3, text("../f", k.cast("string"))).otherwise(text("Raw//", F.col("source"), "/./", F.col("lang"), "/B", folder, name))
    first = F.when(F.ascii(F.substring("lang", 1, 1)) % 3 == 0, "train").otherwise("test")
    top = text("RAW/", F.col("source"), "/", F.col("lang"))
    rules = docs.where("lang <> 'fr'").select(first.alias("split"), top.alias("prefix")).distinct()
    rules = rules.union(docs.where(k % 40 < 20).select(F.when(k % 40 % 4 == 0, "validation").otherwise(first), text(top, "/B", folder, "/")).distinct())
    rules = rules.union(docs.where(k % 10 == 7).select(F.lit("test"), text(top, "/B", folder, name)))
    return splits.assign_splits(docs.select("doc_id", path.alias("path")), rules, "doc_id").withColumn("splits", F.array_join("splits", ","))


_SPLIT = "case when doc_id % 10 < 8 then 'train' else 'test' end"


_LINKS = """ids as (select doc_id, case when doc_id % 10 < 8 then 'train' else 'test' end as split, sha256(text) as hash, 'g' || doc_id // 3 as grp, lower(source) || '/' || n_chars as path from documents),
    long as (select doc_id, 'hash' as link, hash as value from ids where hash is not null union all select doc_id, 'group', grp from ids union all select doc_id, 'path', path from ids where path is not null),
    ties as (select a.doc_id as a, b.doc_id as b, link from long a join long b using (link, value) where a.doc_id <> b.doc_id)"""


@query("a39_split_leakage_check", f"with recursive {_LINKS}, walk(a, root) as (select doc_id, doc_id from ids union select b, root from walk join ties using (a)), roots as (select a as doc_id, min(root) as component from walk group by 1), told as (select component, count(*) as records, array_to_string(list_sort(list(distinct split)), ',') as splits, count(distinct split) as n from ids join roots using (doc_id) group by 1), kinds as (select component, array_to_string(list_sort(list(distinct link)), ',') as repeated from ties join roots on a = doc_id group by 1) select component, records, splits, repeated from told join kinds using (component) where n > 1")
def split_leakage_check(spark, d):
    docs = table(spark, d, "documents")
    split = F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test")
    links = {"hash": F.sha2("text", 256), "group": F.concat(F.lit("g"), F.expr("doc_id div 3").cast("string")), "path": F.concat(F.lower("source"), F.lit("/"), F.col("n_chars").cast("string"))}
    return splits.leaks(docs.withColumn("split", split), "doc_id", "split", links)


@query("a37_manifest_summary", f"select {_SPLIT} as split, count(*) as documents, count(quality) as paired, count(*) - count(quality) as unpaired, count(*) filter (toxic = 1) as flagged from documents left join labels using (doc_id) group by 1")
def manifest_summary(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    split = F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test")
    return j.groupBy(split.alias("split")).agg(F.count("*").alias("documents"), F.count("quality").alias("paired"), (F.count("*") - F.count("quality")).alias("unpaired"), F.count_if(F.col("toxic") == 1).alias("flagged"))


@query("a38_quarantine_rule", "select doc_id, quality = 0 or copies > 1 as quarantined from documents join labels using (doc_id) join (select sha256(coalesce(text, '')) as h, count(*) as copies from documents group by 1) on h = sha256(coalesce(text, ''))")
def quarantine_rule(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    copies = docs.groupBy("h").agg(F.count("*").alias("copies"))
    return docs.join(table(spark, d, "labels"), "doc_id").join(copies, "h").select("doc_id", ((F.col("quality") == 0) | (F.col("copies") > 1)).alias("quarantined"))


@query("a50_partition_audit", "select cast(floor(doc_id / 250) as bigint) as part, count(*) as n, count(*) filter (exposed) as exposed, count(*) - count(*) filter (exposed) as eligible from (select doc_id, doc_id in (select doc_id from labels) as exposed from documents) group by 1")
def partition_audit(spark, d):
    seen = table(spark, d, "labels").select("doc_id").distinct().withColumn("seen", F.lit(True))
    j = table(spark, d, "documents").select("doc_id").join(seen, "doc_id", "left")
    return j.groupBy(F.floor(F.col("doc_id") / 250).alias("part")).agg(F.count("*").alias("n"), F.count("seen").alias("exposed"), (F.count("*") - F.count("seen")).alias("eligible"))


@query("a45_folder_rollup", r"""with u as (select page_id, string_split(split_part(regexp_replace(url, '^[a-z]+://', ''), '?', 1), '/') as p from pages) select array_to_string(p[1:k], '/') as folder, count(*) as n, min(page_id) as first_page from (select page_id, p, unnest(range(1, len(p))) as k from u) group by 1""")
def folder_rollup(spark, d):
    parts = F.split(F.substring_index(F.regexp_replace("url", "^[a-z]+://", ""), "?", 1), "/")
    p = table(spark, d, "pages").select("page_id", parts.alias("p")).where("size(p) > 1")
    prefixes = p.select("page_id", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    return prefixes.groupBy(F.array_join(F.slice("p", F.lit(1), F.col("k")), "/").alias("folder")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("w12_unique_prefix_labels", """with h as (select doc_id, source, sha256(cast(doc_id as varchar)) as id from documents), n as (select *, lag(id) over w as a, lead(id) over w as b from h window w as (partition by source order by id))
select doc_id, left(id, cast(list_min(list_filter(range(6, 65), lambda k: coalesce(left(a, k) <> left(id, k), true) and coalesce(left(b, k) <> left(id, k), true))) as bigint)) as label from n""")
def unique_prefix_labels(spark, d):
    h = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.col("doc_id").cast("string"), 256).alias("id"))
    # Labels have six characters at least, so only ids that share these can meet.
    w = W.partitionBy("source", F.left("id", F.lit(6))).orderBy("id")
    n = h.withColumns({"a": F.lag("id").over(w), "b": F.lead("id").over(w)})
    return n.selectExpr("doc_id", "left(id, array_min(filter(sequence(6, 64), k -> coalesce(left(a, k) <> left(id, k), true) and coalesce(left(b, k) <> left(id, k), true)))) as label")


@query("w08_hash_chain_check", "select conv_id, turn, case when conv_id % 10 = 4 and turn = 0 then 'duplicate' when conv_id % 10 = 3 and turn = 1 then 'broken' else 'ok' end as verdict from conversations")
def hash_chain_check(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    kept = c.withColumn("previous", F.sha2(F.coalesce(F.lag("text").over(w), F.lit("")), 256))
    stored = kept.withColumn("previous", F.when((F.col("conv_id") % 10 == 3) & (F.col("turn") == 1), F.lit("x")).otherwise(F.col("previous")))
    return studies.chain_verdicts(stored.union(stored.where("conv_id % 10 = 4 and turn = 0")), "conv_id", "turn", "text", "previous")


@query("h05_single_contract_check", sql("obs", then="select condition, count(distinct review) as reviews, count(distinct replicate) as replicates, count(distinct nation) as nations, count(distinct review) <= 1 and count(distinct replicate) <= 1 and count(distinct nation) <= 1 as single from obs group by 1"))
def single_contract_check(spark, d):
    return studies.single_contract(views.obs(spark, d), "condition", {"reviews": "review", "replicates": "replicate", "nations": "nation"})


@query("h07_currentness_check", "select o_orderkey from orders where o_orderkey % 4 = 0 and o_orderstatus <> 'O'")
def currentness_check(spark, d):
    now = table(spark, d, "orders").select("o_orderkey", F.sha2("o_orderstatus", 256).alias("now"))
    saved = table(spark, d, "orders").select("o_orderkey", F.sha2(F.when(F.col("o_orderkey") % 4 == 0, "O").otherwise(F.col("o_orderstatus")), 256).alias("saved"))
    return saved.join(now, "o_orderkey", "full_outer").where(~F.col("saved").eqNullSafe(F.col("now"))).select("o_orderkey")


@query("h03_row_digest", "with h as (select p_brand, sha256(p_partkey || '|' || p_name || '|' || p_size) as h from part), r as (select p_brand, left(h, 3) as r, sha256(string_agg(h, '' order by h)) as d from h group by all) select p_brand, sha256(string_agg(d, '' order by r)) as digest from r group by 1")
def row_digest(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.sha2(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name", F.col("p_size").cast("string")), 256).alias("h"))
    # Ranges of the hash first, then their digests: no brand's rows are gathered in one place.
    ranges = rows.groupBy("p_brand", F.left("h", F.lit(3)).alias("r")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "d"))), lambda s: s["d"]), "")
    return ranges.groupBy("p_brand").agg(F.sha2(whole, 256).alias("digest"))


_REGISTERED = "select doc_id, strlen(coalesce(text, '')) as size_bytes, sha256(coalesce(text, '')) as sha256, case when doc_id % 40 = 0 then 'changed' when doc_id % 40 = 1 then 'new' else 'known' end as status from documents"


def _manifest(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.octet_length(t).cast("bigint").alias("size_bytes"), F.sha2(t, 256).alias("sha256"))


@query("s08_source_manifest", _REGISTERED)
def source_manifest(spark, d):
    m = _manifest(spark, d)
    before = m.where("doc_id % 40 <> 1").select("doc_id", F.when(F.col("doc_id") % 40 == 0, F.lit("x")).otherwise(F.col("sha256")).alias("held"))
    status = F.when(F.col("held").isNull(), "new").when(F.col("held") != F.col("sha256"), "changed").otherwise("known")
    return m.join(before, "doc_id", "left").select("doc_id", "size_bytes", "sha256", status.alias("status"))


@query("s20_package_verify", "select cast(doc_id as varchar) as name, case when doc_id % 50 = 1 then 'missing' when doc_id % 50 = 2 then 'checksum' when doc_id % 50 = 3 then 'header' when doc_id % 50 = 4 then 'rows' when doc_id % 50 = 5 then 'size' when doc_id % 50 = 6 then 'unexpected' else 'ok' end as verdict from documents")
def package_verify(spark, d):
    k = F.col("doc_id") % 50
    lines = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\n]", "")).cast("bigint") + 1
    files = _manifest(spark, d).join(table(spark, d, "documents").select("doc_id", lines.alias("rows")), "doc_id").select("doc_id", F.col("doc_id").cast("string").alias("name"), F.col("size_bytes").alias("size"), "sha256", F.lit("doc_id,text").alias("header"), "rows")
    declared = files.where(k != 6).select("name", F.when(k == 5, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(k == 2, F.lit("x")).otherwise(F.col("sha256")).alias("sha256"), F.when(k == 3, F.lit("text,doc_id")).otherwise(F.col("header")).alias("header"), F.when(k == 4, F.col("rows") + 1).otherwise(F.col("rows")).alias("rows"))
    return sheets.verify_package(declared, files.where(k != 1).drop("doc_id"))


@query("s21_foreign_keys", """select 'lineitem orders' as "check", count(*) filter (l_orderkey not in (select o_orderkey from orders)) as faults from lineitem union all select 'orders customer', count(*) filter (o_custkey not in (select c_custkey from customer where c_nationkey <> 3)) from orders
    union all select 'customer nation', count(*) filter (c_nationkey not in (select n_nationkey from nation)) from customer union all select 'orders key', count(*) from (select o_orderkey from orders group by 1 having count(*) > 1) union all select 'customer name twice', count(*) from (select c_nationkey from customer group by 1 having count(*) > 1)
    union all select 'lines as declared', (select count(*) from (select l_orderkey, count(*) as n, max(l_linenumber) as m from lineitem group by 1) where n <> m)""")
def foreign_keys(spark, d):
    t = lambda n: table(spark, d, n)
    counts = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("m")).where("n <> m").agg(F.count("*").alias("faults")).select(F.lit("lines as declared").alias("check"), "faults")
    return sheets.relation_faults({
        "lineitem orders": (t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"),
        "orders customer": (t("orders"), "o_custkey", t("customer").where("c_nationkey <> 3"), "c_custkey"),
        "customer nation": (t("customer"), "c_nationkey", t("nation"), "n_nationkey"),
        "orders key": (t("orders"), "o_orderkey", None, None),
        "customer name twice": (t("customer"), "c_nationkey", None, None),
    }).union(counts)


def _sheet(spark, d, wrong: bool):
    """Lines of a sheet over the customers, with faults by the number if ``wrong``."""
    k = F.col("c_custkey")
    when = lambda n, a, b: F.when(k % 20 == n, F.lit(a)).otherwise(b) if wrong else b
    source = when(1, "x0", F.concat(F.lit("c"), k.cast("string")))
    line = F.concat_ws(",", source, when(2, "Other", F.lit("Study")), when(3, " ", F.concat(F.lit('"Sample ""'), k.cast("string"), F.lit('"", x"'))), when(4, "", F.col("c_mktsegment")), F.lit("r1"), F.lit(""), when(5, "a,b", F.lit("A1")))
    line = F.when(k % 20 == 6, F.concat(line, F.lit('"'))).otherwise(line) if wrong else line
    rows = table(spark, d, "customer").select((k + 1).alias("row"), line.alias("line"))
    more = rows.where("row % 20 = 8").selectExpr("row + 1000000 as row", "line").union(rows.where("row % 20 = 9").selectExpr("row + 2000000 as row", "line || 'x'"))
    head = spark.createDataFrame([(1, ",".join(sheets.COLUMNS))], "row long, line string")
    return head.union(rows).union(more) if wrong else head.union(rows)


def _registered(spark, d):
    return table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source_id"))


@query("s11_sample_sheet_preview", """select row, issues from (select c_custkey + 1 as row, case c_custkey % 20 when 1 then 'unknown source,conflicting' when 2 then 'study' when 3 then 'sample' when 4 then 'condition' when 5 then 'fields' when 6 then 'quoting,unknown source' when 7 then 'duplicate' when 8 then 'conflicting' else '' end as issues from customer where c_custkey > 0
    union all select c_custkey + 1000001, 'duplicate' from customer where c_custkey % 20 = 7 and c_custkey > 0 union all select c_custkey + 2000001, 'conflicting' from customer where c_custkey % 20 = 8 and c_custkey > 0)""")
def sample_sheet_preview(spark, d):
    checked = sheets.preview(_sheet(spark, d, True).where("row > 0"), _registered(spark, d), "Study")
    return checked.where("row <> 1").select("row", F.array_join("issues", ",").alias("issues"))


@query("s12_sample_sheet_apply", "select 'c' || c_custkey as source_id, 'Study' as study, 'Sample \"' || c_custkey || '\", x' as sample, c_mktsegment as condition, 'r1' as biological_replicate, cast(null as varchar) as plate, 'A1' as well, case when c_custkey % 3 = 0 then 5 else 1 end as revision from customer where c_custkey > 0")
def sample_sheet_apply(spark, d):
    checked = written(sheets.preview(_sheet(spark, d, False).where("row > 0"), _registered(spark, d), "Study").where("row <> 1"))
    now = _registered(spark, d).where("cast(substring(source_id, 2) as bigint) % 3 = 0").select("source_id", *(F.lit("old").alias(c) for c in sheets.COLUMNS[1:]), F.lit(4).alias("revision"))
    return sheets.apply(checked, now.where("source_id <> 'c0'"), sheets.digest(checked))


@query("s10_sample_sheet_template", "select o_orderkey as source_id, coalesce(case when c_custkey is not null then 'Study' end, 'Study') as study, c_name as sample, c_mktsegment as condition, cast(c_nationkey as varchar) as biological_replicate, cast(null as varchar) as plate, 'W' || c_custkey as well from orders left join (select * from customer where c_custkey % 4 <> 0) on o_custkey = c_custkey")
def sample_sheet_template(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 4 <> 0")
    held = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    samples = held.select(F.col("o_orderkey").alias("source_id"), F.lit("Study").alias("study"), F.col("c_name").alias("sample"), F.col("c_mktsegment").alias("condition"), F.col("c_nationkey").cast("string").alias("biological_replicate"), F.lit(None).cast("string").alias("plate"), F.concat(F.lit("W"), F.col("c_custkey").cast("string")).alias("well"))
    return sheets.template(table(spark, d, "orders").select(F.col("o_orderkey").alias("source_id")), samples, "Study")


_BY_TIME = ["ts", "event_id"]


def _paths(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", "ts", "event_id", views.hour_frame("ts").alias("frame"), F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))


_PATHS = "with p as (select user_id, ts, event_id, cast(floor(epoch(ts - timestamp '2024-01-01') / 3600) as bigint) as frame, value as x, cast(event_id % 100 as double) as y from events), s as (select *, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as step_, first(x) over w as x0, first(y) over w as y0, frame - lag(frame) over w as gap from p window w as (partition by user_id order by ts, event_id)) "


@query("w04_trajectory_observations", _PATHS + "select user_id, event_id, round(step_, 5) as step, round(case when gap > 0 then step_ / gap end, 5) as speed, round(sqrt(pow(x - x0, 2) + pow(y - y0, 2)), 5) as displacement, round(sum(coalesce(step_, 0)) over (partition by user_id order by ts, event_id rows unbounded preceding), 3) as path, gap from s")
def trajectory_observations(spark, d):
    return tracks.observations(_paths(spark, d), ["user_id"], _BY_TIME).drop("ts")


@query("g06_track_metrics", _PATHS + "select user_id, count(*) as n, max(frame) - min(frame) as elapsed, round(sqrt(pow(arg_max(x, (ts, event_id)) - arg_min(x, (ts, event_id)), 2) + pow(arg_max(y, (ts, event_id)) - arg_min(y, (ts, event_id)), 2)), 5) as net, round(coalesce(sum(step_), 0), 3) as path, round(least(sqrt(pow(arg_max(x, (ts, event_id)) - arg_min(x, (ts, event_id)), 2) + pow(arg_max(y, (ts, event_id)) - arg_min(y, (ts, event_id)), 2)) / nullif(coalesce(sum(step_), 0), 0), 1), 5) as directionality, round(case when max(frame) > min(frame) then (arg_max(x, (ts, event_id)) - arg_min(x, (ts, event_id))) / (max(frame) - min(frame)) end, 5) as vx, round(case when max(frame) > min(frame) then (arg_max(y, (ts, event_id)) - arg_min(y, (ts, event_id))) / (max(frame) - min(frame)) end, 5) as vy, round(case when max(frame) > min(frame) then coalesce(sum(step_), 0) / (max(frame) - min(frame)) end, 5) as speed, count(*) filter (gap > 1) as gaps, count(*) filter (step_ > 60) as uncertain, case when count(*) = 1 then 'single' when coalesce(sum(step_), 0) = 0 then 'stationary' else 'moving' end as status from s group by 1")
def track_metrics(spark, d):
    return tracks.track_measures(_paths(spark, d), ["user_id"], _BY_TIME, 60.0)


@query("p12_polyline_metrics", _PATHS + "select user_id, count(*) as points, round(coalesce(sum(step_), 0), 4) as length from s group by 1")
def polyline_metrics(spark, d):
    return gates.polyline_lengths(_paths(spark, d), "user_id", _BY_TIME)


#: All matchings of each pair of frames, one link after the other; the one with most links, then the least total, is taken.
_LINKED = """p as (select a.seq, a.frame, a.label as src, b.label as dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as distance from det a join det b on a.seq = b.seq and b.frame = a.frame + 1 and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 25),
    k as (select *, row_number() over (partition by seq, frame order by src, dst) as nth from p),
    m(seq, frame, nth, srcs, dsts, n, cost) as (select distinct seq, frame, 0::bigint, []::bigint[], []::bigint[], 0, 0::double from p union all select k.seq, k.frame, k.nth, list_append(srcs, src), list_append(dsts, dst), n + 1, cost + distance from m join k on k.seq = m.seq and k.frame = m.frame and k.nth > m.nth where not list_contains(srcs, src) and not list_contains(dsts, dst)),
    best as (select * from m qualify row_number() over (partition by seq, frame order by n desc, cost) = 1), linked as (select seq, frame, unnest(srcs) as src, unnest(dsts) as dst from best), own as (select * from linked join p using (seq, frame, src, dst))"""
_TRACKED = sql("det", then="").replace("with ", "with recursive ", 1).rstrip() + ", " + _LINKED


@query("j14_gated_tracking", _TRACKED + " select seq, frame, src, dst, 1 as step, round(distance, 6) as distance from own")
def gated_tracking(spark, d):
    return tracks.links(tracks.candidates(views.det(spark, d), 25.0)).withColumn("distance", F.round("distance", 6))


@query("j15_tracking_ambiguity", _TRACKED + """, told as (select seq, src, dst, (select count(*) from p where p.seq = own.seq and p.frame = own.frame and p.src = own.src and p.dst <> own.dst and p.distance <= own.distance + 5) as by_source, (select count(*) from p where p.seq = own.seq and p.frame = own.frame and p.dst = own.dst and p.src <> own.src and p.distance <= own.distance + 5) as by_target from own)
    select *, by_source > 0 or by_target > 0 as ambiguous, by_source > 0 as split, by_target > 0 as "merge" from told""")
def tracking_ambiguity(spark, d):
    c = written(tracks.candidates(views.det(spark, d), 25.0))
    return tracks.ambiguity(c, tracks.links(c), 5.0)


#: Edges 1 or 2 on, and one back from every 300th that closes a cycle of five.
_TRACK_EDGES = """n as (select event_id as label, event_id // 2 as frame, value as x, user_id % 100 as y from events),
    raw as (select event_id as src, event_id + 1 + event_id % 3 as dst from events union all select event_id, event_id - 6 from events where event_id % 300 = 156),
    j as (select src, dst, a.frame as f1, b.frame as f2, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as far, count(*) over (partition by src) as outs, count(*) over (partition by dst) as ins from raw left join n a on a.label = src left join n b on b.label = dst)"""


@query("g04_track_graph_validation", f"""with {_TRACK_EDGES}, told as (select src, dst, list_filter([case when f1 is null or f2 is null then 'unknown' end, case when f2 <= f1 then 'backward' end, case when outs > 1 then 'branch' end, case when ins > 1 then 'merge' end,
    case when f2 is not null and ((src % 300, dst - src) in ((150, 1), (151, 2), (153, 1), (154, 2), (156, -6)) and exists (select 1 from events where event_id = src - src % 300 + 156)) then 'cycle' end,
    case when f2 is not null and src % 11 = 3 then 'gap' end, case when f2 is not null and src % 13 = 4 then 'cost' end, case when src % 17 = 5 then 'origin' end], lambda x: x is not null) as why from j)
    select src, dst, array_to_string(why, ',') as reasons from told where len(why) > 0""")
def track_graph_validation(spark, d):
    e = table(spark, d, "events")
    det = e.selectExpr("'all' as seq", "event_id div 2 as frame", "event_id as label", "value as x", "cast(user_id % 100 as double) as y")
    raw = e.selectExpr("event_id as src", "event_id + 1 + event_id % 3 as dst").union(e.where("event_id % 300 = 156").selectExpr("event_id", "event_id - 6"))
    at = lambda name: det.select(F.col("label").alias(name), F.col("frame").alias(f"f_{name}"), F.col("x").alias(f"x_{name}"), F.col("y").alias(f"y_{name}"))
    cost = F.sqrt((F.col("x_src") - F.col("x_dst")) ** 2 + (F.col("y_src") - F.col("y_dst")) ** 2)
    edges = raw.join(at("src"), "src", "left").join(at("dst"), "dst", "left").select(
        "src", "dst", (F.col("f_dst") - F.col("f_src") - 1 + F.when(F.col("src") % 11 == 3, 1).otherwise(0)).alias("gap"),
        (cost + F.when(F.col("src") % 13 == 4, 0.5).otherwise(0.0)).alias("cost"), F.when(F.col("src") % 17 == 5, "guess").otherwise("manual").alias("origin"),
    )
    return tracks.edge_faults(det, edges)


@query("g05_track_chaining", """with recursive e as (select event_id as src, event_id + 5 as dst from events where event_id % 50 < 45 and event_id + 5 <= (select max(event_id) from events)), c(node, track, depth) as (select event_id, event_id, cast(0 as bigint) from events where event_id not in (select dst from e) union all select e.dst, c.track, c.depth + 1 from c join e on e.src = c.node) select * from c""")
def track_chaining(spark, d):
    n = table(spark, d, "events").select(F.col("event_id").alias("node"))
    edges = n.where("node % 50 < 45").selectExpr("node as src", "node + 5 as dst")
    edges = edges.join(n.select(F.col("node").alias("dst")), "dst", "left_semi")
    return tracks.chains(n, edges)


@query("g08_revision_lineage", "select conv_id, turn, 0 as root_turn, turn as depth from conversations")
def revision_lineage(spark, d):
    node = lambda turn: F.struct("conv_id", turn.alias("turn"))
    c = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    edges = c.where("turn > 0").select(node(F.col("turn") - 1).alias("src"), node(F.col("turn")).alias("dst"))
    chained = tracks.chains(c.select(node(F.col("turn")).alias("node")), edges)
    return chained.select("node.conv_id", "node.turn", F.col("track.turn").cast("int").alias("root_turn"), "depth")


@query("w03_interval_rates", "with a as (select event_type, date_trunc('day', ts) as day, sum(value) as area from events group by all) select event_type, cast(epoch(day) // 86400 as bigint) as t, round(area, 4) as area, round((round(area, 4) - lag(round(area, 4)) over w) / (epoch(day) // 86400 - lag(epoch(day) // 86400) over w), 6) as rate from a window w as (partition by event_type order by day)")
def interval_rates(spark, d):
    a = table(spark, d, "events").groupBy("event_type", F.unix_date(F.col("ts").cast("date")).cast("bigint").alias("t")).agg(F.round(F.sum("value"), 4).alias("area"))
    return tracks.interval_rates(a, ["event_type"], "t", "area")


@query("a16_wound_area_series", "with a as (select event_type, cast(epoch(date_trunc('day', ts)) // 86400 as bigint) as t, count(*) filter (value > 5) as area from events group by all) select event_type, t, area, round(1 - area / first(area) over (partition by event_type order by t), 6) as closure from a")
def wound_area_series(spark, d):
    a = table(spark, d, "events").groupBy("event_type", F.unix_date(F.col("ts").cast("date")).cast("bigint").alias("t")).agg(F.count_if(F.col("value") > 5).alias("area"))
    first = F.first("area").over(W.partitionBy("event_type").orderBy("t"))
    return a.select("event_type", "t", "area", F.round(1 - F.try_divide("area", first), 6).alias("closure"))


@query("j29_sequence_frames_grid_check", "select event_type, date_trunc('day', ts) as day, count(*) as n, count(distinct event_id) = count(*) as distinct_frames from events group by all")
def sequence_frames_grid_check(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), (F.count_distinct("event_id") == F.count("*")).alias("distinct_frames"))


@query("j09_nearest_neighbour_distance", "with p as (select label as \"group\", vec_id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings) select a.vec_id, round(min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 7) as nearest from p a left join p b on a.\"group\" = b.\"group\" and a.vec_id <> b.vec_id group by 1")
def nearest_neighbour_distance(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("group"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return tracks.nearest(p, "vec_id", 0.02).select("vec_id", F.round("nearest", 7).alias("nearest"))




@query("j28_distance_nms")
def distance_nms(spark, d):
    p = views.px(spark, d).where("v > 8").selectExpr("(image_id * 25 + y) * 100 + x as id", "cast(x as double) as x", "cast(image_id * 1000 + y as double) as y", "v as response")
    return tracks.suppress(p, 4.0)


@query("u05_track_edge_edits", """with edits as (select event_id // 500 as graph, event_id * 4 as seq, case when event_id % 5 = 2 then 'remove' else 'add' end as op, event_id as src, event_id + case when event_id % 5 = 2 then 1 else 2 end as dst, event_id % 20 = 2 and event_id % 40 <> 2 as undone from events where event_id % 5 = 2 or event_id % 100 = 1),
    last as (select graph, src, dst, arg_max(op, seq) as op from edits where not undone group by all)
    select graph, src, dst, 'automatic' as origin from (select event_id // 500 as graph, event_id as src, event_id + 1 as dst from events) where (graph, src, dst) not in (select graph, src, dst from last) union all select graph, src, dst, 'manual' from last where op = 'add'""")
def track_edge_edits(spark, d):
    e = table(spark, d, "events").withColumn("graph", F.expr("event_id div 500"))
    base = e.selectExpr("graph", "event_id as src", "event_id + 1 as dst")
    edits = e.where("event_id % 5 = 2 or event_id % 100 = 1").selectExpr("graph", "event_id * 4 as seq", "if(event_id % 5 = 2, 'remove', 'add') as op", "event_id as src", "event_id + if(event_id % 5 = 2, 1, 2) as dst")
    # Every fourth removal is undone, and of these every second is done again.
    undo = edits.where("src % 20 = 2").selectExpr("graph", "seq + 1 as seq", "'undo' as op", "null as src", "null as dst")
    redo = edits.where("src % 40 = 2").selectExpr("graph", "seq + 2 as seq", "'redo' as op", "null as src", "null as dst")
    return tracks.edited(base, edits.union(undo).union(redo))


@query("p11_polygon_area_centroid", """with v as (select page_id as shape, i, cos(i * 1.2) * (page_id % 7 + 1) as x, sin(i * 1.2) * (page_id % 5 + 1) as y from pages, range(0, 5) t(i)), n as (select *, coalesce(lead(x) over w, first(x) over w2) as nx, coalesce(lead(y) over w, first(y) over w2) as ny from v window w as (partition by shape order by i), w2 as (partition by shape order by i rows between unbounded preceding and unbounded following)), s as (select shape, sum(x * ny - nx * y) as a, sum((x + nx) * (x * ny - nx * y)) as sx, sum((y + ny) * (x * ny - nx * y)) as sy from n group by 1)
select shape, round(abs(a) / 2, 4) as area, round(sx / (3 * a), 4) as centroid_x, round(sy / (3 * a), 4) as centroid_y from s""")
def polygon_area_centroid(spark, d):
    v = table(spark, d, "pages").select(F.col("page_id").alias("shape"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    v = v.select("shape", "i", (F.cos(F.col("i") * 1.2) * (F.col("shape") % 7 + 1)).alias("x"), (F.sin(F.col("i") * 1.2) * (F.col("shape") % 5 + 1)).alias("y"))
    return gates.polygon_measures(v)


@query("j20_overlap_selection_check", "select a.p_partkey as a, b.p_partkey as b from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_partkey < b.p_partkey and abs(a.p_size - b.p_size) < 5 and abs(a.p_retailprice - b.p_retailprice) < 50")
def overlap_selection_check(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    # Squares as large as the limits: a pair lies in one or in neighbours, so no brand meets itself whole.
    at = {"cs": F.floor(F.col("p_size") / 5), "cp": F.floor(F.col("p_retailprice") / 50)}
    around = F.array(*(F.struct((at["cs"] + i).alias("cs"), (at["cp"] + j).alias("cp")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a, b = p.withColumns(at).alias("a"), p.select("*", F.inline(around)).alias("b")
    near = (F.abs(F.col("a.p_size") - F.col("b.p_size")) < 5) & (F.abs(F.col("a.p_retailprice") - F.col("b.p_retailprice")) < 50)
    same = (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_type") == F.col("b.p_type")) & (F.col("a.cs") == F.col("b.cs")) & (F.col("a.cp") == F.col("b.cp")) & (F.col("a.p_partkey") < F.col("b.p_partkey"))
    return a.join(shuffled(b), same & near).select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"))


@query("s26_geojson_roi_sink", """with v as (select p_partkey as id, p_size from part) select id, '{"type":"Feature","id":' || id || ',"geometry":{"type":"Polygon","coordinates":[[[0,0],[' || p_size || ',0],[' || p_size || ',' || p_size || '],[0,0]]]}}' as feature from v""")
def geojson_roi_sink(spark, d):
    s = F.col("p_size")
    ring = F.array(F.array(F.array(F.lit(0), F.lit(0)), F.array(s, F.lit(0)), F.array(s, s), F.array(F.lit(0), F.lit(0))))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("p_partkey").alias("id"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.to_json(feature).alias("feature"))


@query("s25_geojson_roi_source", "select p_partkey as id, 4 as vertices, true as closed, p_size as width from part")
def geojson_roi_source(spark, d):
    kind = "struct<type:string,id:bigint,geometry:struct<type:string,coordinates:array<array<array<int>>>>>"
    f = geojson_roi_sink(spark, d).select(F.from_json("feature", kind, {"mode": "FAILFAST"}).alias("f"))
    ring = F.col("f.geometry.coordinates")[0]
    return f.select(F.col("f.id").alias("id"), F.size(ring).alias("vertices"), (ring[0] == F.element_at(ring, -1)).alias("closed"), F.array_max(F.transform(ring, lambda p: p[0])).alias("width"))


@query("s19_json_cell_csv", """select p_partkey, '"' || p_name || '"' as name_cell, cast(p_size as varchar) as size_cell from part""")
def json_cell_csv(spark, d):
    cell = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("c"))), r"^\{\"c\":(.*)\}$", 1)
    return table(spark, d, "part").select("p_partkey", cell("p_name").alias("name_cell"), cell("p_size").alias("size_cell"))


@query("a44_transect_summary", "select event_type, count(distinct user_id % 3) as protocols, case when count(distinct user_id % 3) <= 1 then round(avg(value), 6) end as mean, case when count(distinct user_id % 3) <= 1 then min(value) end as least, case when count(distinct user_id % 3) <= 1 then max(value) end as greatest, count(*) as n from events group by 1 union all select 'one', 1, round(avg(value), 6), min(value), max(value), count(*) from events where user_id % 3 = 1")
def transect_summary(spark, d):
    e = table(spark, d, "events").withColumn("protocol", F.col("user_id") % 3)
    both = e.union(e.where("protocol = 1").withColumn("event_type", F.lit("one")))
    n = F.count_distinct("protocol")
    alone = lambda c: F.when(n <= 1, c)
    return both.groupBy("event_type").agg(n.alias("protocols"), alone(F.round(F.avg("value"), 6)).alias("mean"), alone(F.min("value")).alias("least"), alone(F.max("value")).alias("greatest"), F.count("*").alias("n"))


@query("p22_label_filename_rules", r"select doc_id, regexp_extract(name, '^(.*?)(_segmented(_2|_tuned)?)?\.png$', 1) as stem, case when name like '%_segmented_2.png' then 'second' when name like '%_segmented_tuned.png' then 'tuned' when name like '%_segmented.png' then 'plain' else 'raw' end as variant from (select doc_id, source || '_' || doc_id || case doc_id % 4 when 0 then '' when 1 then '_segmented' when 2 then '_segmented_2' else '_segmented_tuned' end || '.png' as name from documents)")
def label_filename_rules(spark, d):
    k = F.col("doc_id") % 4
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.when(k == 0, "").when(k == 1, "_segmented").when(k == 2, "_segmented_2").otherwise("_segmented_tuned"), F.lit(".png"))
    n = table(spark, d, "documents").select("doc_id", name.alias("name"))
    variant = F.when(F.col("name").endswith("_segmented_2.png"), "second").when(F.col("name").endswith("_segmented_tuned.png"), "tuned").when(F.col("name").endswith("_segmented.png"), "plain").otherwise("raw")
    return n.select("doc_id", F.regexp_extract("name", r"^(.*?)(_segmented(_2|_tuned)?)?\.png$", 1).alias("stem"), variant.alias("variant"))
