"""Queries on object tables: sources, filters, gates, order, sets, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.functions import cells, typed_cells
from gridquarry.operators import gates, population, sets
from gridquarry.sources import views
from gridquarry.sources.views import sql, table

from .catalog import query

RANGES = {"measure": (950.0, 1500.0), "size": (5.0, 40.0)}
_WHERE = "measure between 950.0 and 1500.0 and size between 5.0 and 40.0"
HEXAGON = [(10.0, 0.0), (60.0, 100.0), (60.0, 400.0), (10.0, 500.0), (2.0, 400.0), (2.0, 100.0)]


@query("s01_object_table_scan", sql("objects", then="select result_id, count(*) as n, min(label) as first_label, max(label) as last_label from objects group by result_id"))
def object_table_scan(spark: SparkSession, d: str) -> DataFrame:
    return views.objects(spark, d).groupBy("result_id").agg(F.count("*").alias("n"), F.min("label").alias("first_label"), F.max("label").alias("last_label"))


@query("s03_object_page", sql("objects", then="select label, measure from objects order by label limit 100 offset 37"))
def object_page(spark, d):
    return population.page(views.objects(spark, d).select("label", "measure"), [F.col("label").asc()], 37, 100)


@query("s04_object_point_lookup", sql("objects", then="select label, measure, brand from objects where label = 42"))
def object_point_lookup(spark, d):
    return views.objects(spark, d).where("label = 42").select("label", "measure", "brand")


@query("f01_range_filters", sql("objects", then=f"select label, measure, size from objects where {_WHERE}"))
def range_filters(spark, d):
    return population.range_filters(views.objects(spark, d), RANGES).select("label", "measure", "size")


@query("f01_range_accounting", sql("objects", then=f"select count(*) as total, count(*) filter (where {_WHERE}) as selected, count(*) filter (where measure is null) as missing_measure, count(*) filter (where size is null) as missing_size from objects"))
def range_accounting(spark, d):
    return population.filter_accounting(views.objects(spark, d), RANGES)


@query("f02_rectangle_gate", "select event_type, case when value <= 0 then 'non_positive' when log10(value) between 0.0 and 1.5 and user_id between 10 and 400 then 'inside' else 'outside' end as gate, count(*) as n from events group by all")
def rectangle_gate(spark, d):
    gated = gates.rectangle_gate(table(spark, d, "events"), "value", "user_id", (0.0, 1.5, 10.0, 400.0), log_x=True)
    return gates.gate_accounting(gated, "event_type")


def _polygon_sql() -> str:
    parts, edges = [], []
    for (ax, ay), (bx, by) in zip(HEXAGON, HEXAGON[1:] + HEXAGON[:1]):
        cross = f"(({bx - ax}) * (user_id - ({ay})) - ({by - ay}) * (value - ({ax})))"
        edges.append(f"({cross} = 0 and value between {min(ax, bx)} and {max(ax, bx)} and user_id between {min(ay, by)} and {max(ay, by)})")
        if ay != by:
            parts.append(f"(case when user_id >= {min(ay, by)} and user_id < {max(ay, by)} and {cross} {'>' if by > ay else '<'} 0 then 1 else 0 end)")
    return f"select event_id, {' or '.join(edges)} or ({' + '.join(parts)}) % 2 = 1 as inside from events"


@query("f03_polygon_gate", f"select event_id from ({_polygon_sql()}) where inside")
def polygon_gate(spark, d):
    return gates.polygon_gate(table(spark, d, "events"), "value", "user_id", HEXAGON).where("gate = 'inside'").select("event_id")


@query("f05_marker_gates", "select l_orderkey, l_linenumber, l_quantity > 25 as high_count, l_extendedprice > 30000 as bright from lineitem")
def marker_gates(spark, d):
    return gates.marker_gates(table(spark, d, "lineitem"), {"high_count": ("l_quantity", 25.0), "bright": ("l_extendedprice", 30000.0)}).select("l_orderkey", "l_linenumber", "high_count", "bright")


@query("f10_visibility_filter", "select o_orderkey from orders where o_orderstatus <> 'P' and o_custkey not in (select c_custkey from customer where c_mktsegment = 'MACHINERY') and o_orderkey % 10 <> 3")
def visibility_filter(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    hidden = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    hidden_results = table(spark, d, "orders").where("o_orderkey % 10 = 3").select("o_orderkey")
    return orders.join(hidden, "o_custkey", "left_anti").join(hidden_results, "o_orderkey", "left_anti").select("o_orderkey")


@query("f11_diagnostic_file_filter", "select page_id from pages where not regexp_matches(lower(url), '(ref=|utm_source|#top)')")
def diagnostic_file_filter(spark, d):
    return table(spark, d, "pages").where(~F.lower("url").rlike("(ref=|utm_source|#top)")).select("page_id")


@query("f13_path_search", "select page_id from pages where contains(lower(url), 'example.com/en')")
def path_search(spark, d):
    return table(spark, d, "pages").where(F.lower("url").contains("example.com/en")).select("page_id")


@query("t01_population_sort", sql("objects", then="select label, size from objects order by size desc nulls last, label limit 200"))
def population_sort(spark, d):
    return population.page(views.objects(spark, d).select("label", "size"), population.ordering("size", True), 0, 200)


@query("t02_population_page", sql("objects", then=f"select label, measure, size from objects where {_WHERE} order by measure asc nulls last, label limit 50 offset 20"))
def population_page(spark, d):
    return population.page(population.range_filters(views.objects(spark, d), RANGES).select("label", "measure", "size"), population.ordering("measure"), 20, 50)


def _long(part: str, place="0", name="''", label="null", value="null", text="null", source="kept") -> str:
    return f"select '{part}' as part, cast({place} as bigint) as place, cast({name} as varchar) as name, cast({label} as bigint) as label, cast({value} as double) as value, cast({text} as varchar) as text from {source}"


_EDGE = "round(lo + (hi - lo) * {} / 8, 6)"
_T03 = sql("objects", then="").rstrip() + f""", kept as (select * from objects where {_WHERE}), ends as (select min(measure) as lo, max(measure) as hi from kept), bins as (select unnest(range(0, 8)) as bin),
    hist as (select bin, (select count(*) from kept where least(floor((measure - lo) * 8 / (hi - lo)), 7) = bin) as n, lo, hi from bins, ends where lo is not null),
    ranked as (select *, row_number() over (order by size desc nulls last, label) - 1 as place, row_number() over (order by label) - 1 as i, count(*) over () as many from kept), """ + """
    accounting as (select count(*) as total, count(*) filter (where """ + _WHERE + """) as selected, count(*) filter (where measure is null) as missing_measure, count(*) filter (where size is null) as missing_size from objects),
    whole as (select count(measure) as n, count(*) filter (where measure is null) as missing, min(measure) as least, max(measure) as greatest, round(avg(measure), 6) as mean, round(median(measure), 6) as median from kept),
    ranges as (select label // 4096 as r, count(*) as n, sha256(string_agg(cast(label as varchar), ',' order by label)) as d from kept group by all) """ + " union all ".join(
    [_long("filters", name=f"'{c}'", value=c, source="accounting") for c in ("total", "selected", "missing_measure", "missing_size")]
    + [_long("summary", name=f"'{c}'", value=f'"{c}"', source="whole") for c in ("n", "missing", "least", "greatest", "mean", "median")]
    + [_long("histogram", "bin", f"'{n}'", value=v, source="hist") for n, v in (("n", "n"), ("low", _EDGE.format("bin")), ("high", _EDGE.format("(bin + 1)")))]
    + [_long("missing", name=f"'{m}'", value=f"count(*) filter (where {m} is null)") for m in ("measure", "size")]
    + [_long("page", "place", "'size'", "label", "size", source="ranked where place between 10 and 39"), _long("rank", "place", label="label", source="ranked where label = 77"), _long("sample", "i", "'measure'", "label", "measure", source="ranked where many <= 13 or i in (select k * (many - 1) // 12 from range(0, 13) t(k))"), _long("members", "sum(n)", text="sha256('part:' || coalesce(string_agg(d, ',' order by r), ''))", source="ranges")]
)


@query("t03_population_query", _T03)
def population_query(spark, d):
    return population.population_query(views.objects(spark, d), RANGES, "measure", "size", 77, descending=True, offset=10, limit=30, binding="part")


@query("t04_preview_head", sql("objects", then="select label, measure, size, brand from objects order by label limit 5"))
def preview_head(spark, d):
    return views.objects(spark, d).select("label", "measure", "size", "brand").orderBy("label").limit(5)


@query("a06_population_summary", sql("objects", then="select brand, count(size) as n, count(*) filter (where size is null) as missing, min(size) as least, max(size) as greatest, round(avg(size), 6) as mean, round(median(size), 6) as median from objects group by brand"))
def population_summary(spark, d):
    return population.summary(views.objects(spark, d), "size", "brand")


@query(
    "a07_histogram",
    sql(
        "objects",
        then="""select b.bin, round(least_ + (greatest_ - least_) * b.bin / 8, 6) as low, round(least_ + (greatest_ - least_) * (b.bin + 1) / 8, 6) as high,
        (select count(*) from objects o where cast(least(floor((o.measure - least_) * 8 / (greatest_ - least_)), 7) as int) = b.bin) as n
        from (select cast(unnest(range(0, 8)) as int) as bin) b, (select min(measure) as least_, max(measure) as greatest_ from objects)""",
    ),
)
def histogram(spark, d):
    return population.histogram(views.objects(spark, d), "measure", 8)


@query("a08_metric_missing_counts", sql("objects", then="select 'measure' as metric, count(*) filter (where measure is null) as missing from objects union all select 'size', count(*) filter (where size is null) from objects"))
def metric_missing_counts(spark, d):
    return population.missing_counts(views.objects(spark, d), "measure", "size")


@query("w01_selected_rank", sql("objects", then="select label, place from (select label, row_number() over (order by size desc nulls last, label) - 1 as place from objects) where label = 77"))
def selected_rank(spark, d):
    return population.selected_rank(views.objects(spark, d), "size", 77, descending=True)


@query("w02_even_sample", sql("objects", then='select label, measure, i as "index" from (select *, row_number() over (order by label) - 1 as i, count(*) over () as n from objects) where i in (select k * (n - 1) // 12 from range(0, 13) t(k))'))
def even_sample(spark, d):
    return population.even_sample(views.objects(spark, d).select("label", "measure"), 13)


@query("h01_membership_hash", sql("objects", then="""select brand, cast(sum(n) as bigint) as n, sha256('part:' || string_agg(d, ',' order by r)) as digest from (select brand, label // 4096 as r, count(*) as n, sha256(string_agg(cast(label as varchar), ',' order by label)) as d from objects group by all) group by brand"""))
def membership_hash(spark, d):
    return population.membership_hash(views.objects(spark, d), "part", "label", "brand")


@query("h02_query_hash", sql("objects", then="""select sha256('filters=measure:950.0:1500.0;size:5.0:40.0|' || (select sha256('q:' || coalesce(string_agg(d, ',' order by r), '')) from (select label // 4096 as r, sha256(string_agg(cast(label as varchar), ',' order by label)) as d from objects where """ + _WHERE + """ group by r))) as query_hash"""))
def query_hash(spark, d):
    text = ";".join(f"{m}:{a}:{b}" for m, (a, b) in sorted(RANGES.items()))
    digest = population.membership_hash(population.range_filters(views.objects(spark, d), RANGES), "q")
    return digest.select(F.sha2(F.concat(F.lit(f"filters={text}|"), "digest"), 256).alias("query_hash"))


@query("u01_group_union", sql("objects", then="select label from objects where brand = 'Brand#11' or size > 30 or measure < 1000"))
def group_union(spark, d):
    o = views.objects(spark, d)
    return sets.union([o.where("brand = 'Brand#11'"), o.where("size > 30"), o.where("measure < 1000")])


@query("u02_group_intersection", sql("objects", then="select label from objects where size > 10 and measure < 1400"))
def group_intersection(spark, d):
    o = views.objects(spark, d)
    return sets.intersection([o.where("size > 10"), o.where("measure < 1400")])


@query("u03_group_unclassified", sql("objects", then="select label from objects where not (coalesce(size > 20, false) or measure < 905)"))
def group_unclassified(spark, d):
    o = views.objects(spark, d)
    return sets.unclassified(o, [o.where("size > 20"), o.where("measure < 905")])


@query("u04_subset_check", "select distinct l_partkey as label from lineitem where l_partkey not in (select p_partkey from part where p_size > 10)")
def subset_check(spark, d):
    return sets.outside(table(spark, d, "lineitem").select(F.col("l_partkey").alias("label")), table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("label")))


@query("g07_group_definition_eval", sql("objects", then="select label from objects where (size > 10 and measure < 1400) or brand = 'Brand#11'"))
def group_definition_eval(spark, d):
    o = views.objects(spark, d)
    groups = {"large": o.where("size > 10"), "cheap": o.where("measure < 1400"), "brand": o.where("brand = 'Brand#11'")}
    return sets.evaluate("answer", groups, {"both": ("intersection", ["large", "cheap"]), "answer": ("union", ["both", "brand"])}, o)


@query("p04_finite_or_null", "select event_id, case when event_id % 5 = 0 then null else value end as value from events")
def finite_or_null(spark, d):
    odd = F.when(F.col("event_id") % 10 == 0, F.lit(float("inf"))).when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", population.finite(odd).alias("value"))


@query("p03_metric_id_codec", "select p_partkey, 'intensity:' || lower(hex(encode(p_name))) || ':mean' as metric_id, p_name as channel from part")
def metric_id_codec(spark, d):
    return table(spark, d, "part").select("p_partkey", cells.metric_id(F.col("p_name"), "mean").alias("metric_id")).withColumn("channel", cells.metric_channel(F.col("metric_id")))


@query("p05_melt_measurements", sql("objects", then="select label, 'measure' as metric, measure as value, case when measure is null then 'null' else 'value' end as status from objects union all select label, 'size', size, case when size is null then 'null' else 'value' end from objects"))
def melt_measurements(spark, d):
    return cells.melt(views.objects(spark, d), ["label"], ["measure", "size"])


@query("p20_stable_id", "select doc_id, 'doc_' || substr(sha256('v1:' || coalesce(source, '') || '/' || sha256(coalesce(text, ''))), 1, 24) as stable_id from documents")
def stable_id(spark, d):
    return table(spark, d, "documents").select("doc_id", cells.stable_id("doc", F.col("source"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("stable_id"))


@query("p21_path_rules", "select page_id, array_to_string(list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda s: s <> '')[1:2], '/') as acquisition_group from pages")
def path_rules(spark, d):
    return table(spark, d, "pages").select("page_id", cells.acquisition_group(F.regexp_replace("url", "^[a-z]+://", "")).alias("acquisition_group"))


@query("p23_spatial_compatibility", """with s as (select p_partkey, p_size * 10 as w, p_size * 8 as h, case p_partkey % 3 when 0 then p_size * 10 when 1 then p_size * 5 else p_size * 7 end as lw, case p_partkey % 3 when 0 then p_size * 8 when 1 then p_size * 4 + p_partkey % 4 else p_size * 3 end as lh from part)
    select p_partkey, case when w = lw and h = lh then 'identity' when abs(round_even(w * k, 0) - lw) <= 1 and abs(round_even(h * k, 0) - lh) <= 1 then 'resize' else 'error' end as transform from (select *, least(lw / w, lh / h) as k from s)""")
def spatial_compatibility(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey") % 3
    sized = table(spark, d, "part").select("p_partkey", (s * 10).alias("w"), (s * 8).alias("h"), F.when(k == 0, s * 10).when(k == 1, s * 5).otherwise(s * 7).alias("lw"), F.when(k == 0, s * 8).when(k == 1, s * 4 + F.col("p_partkey") % 4).otherwise(s * 3).alias("lh"))
    return sized.select("p_partkey", cells.label_transform("w", "h", "lw", "lh").alias("transform"))


@query("p24_sample_metadata_check", "select c_custkey, list_filter([case when study is null or trim(study) = '' then 'study' end, case when sample is null or trim(sample) = '' then 'sample' end, case when condition is null or trim(condition) = '' then 'condition' end, case when length(study) > 256 or length(sample) > 256 then 'too_long' end, case when regexp_matches(sample, '[\x00-\x1f]') then 'control' end], lambda x: x is not null) as reasons from (select c_custkey, case c_custkey % 5 when 1 then ' ' else c_name end as study, case c_custkey % 7 when 1 then repeat('x', 257) when 2 then 'a' || chr(9) when 3 then null else c_name end as sample, nullif(c_mktsegment, 'HOUSEHOLD') as condition from customer)")
def sample_metadata_check(spark, d):
    k = F.col("c_custkey")
    study = F.when(k % 5 == 1, " ").otherwise(F.col("c_name"))
    sample = F.when(k % 7 == 1, F.repeat(F.lit("x"), 257)).when(k % 7 == 2, "a\t").when(k % 7 != 3, F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", cells.metadata_reasons(study, sample, F.expr("nullif(c_mktsegment, 'HOUSEHOLD')")).alias("reasons"))


@query("s15_formula_safe_csv", "select doc_id, case when regexp_matches(text, '^[ \\t\\r\\n]*[=+@-]') then '''' || text else text end as cell from (select doc_id, case when doc_id % 3 = 0 then '=' || text else text end as text from documents)")
def formula_safe_csv(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("="), "text")).otherwise(F.col("text")).alias("text"))
    return docs.select("doc_id", cells.formula_safe(F.col("text")).alias("cell"))


_KINDS = {"text": "string", "clean": "boolean", "n_chars": "integer", "share": "number"}
_TYPED = "typed as (select doc_id, text, case when doc_id % 9 <> 4 then n_chars > 900 end as clean, case when doc_id % 9 <> 5 then n_chars end as n_chars, case doc_id % 9 when 6 then null when 7 then 'inf'::double when 8 then n_chars else n_chars / 7 end as share from documents)"
_CELLS = r"select doc_id, case when text is null then '\N' when regexp_matches(text, '^[ \t\r\n]*[''=+@-]') then '''' || replace(text, '\', '\\') else replace(text, '\', '\\') end as text, coalesce(cast(clean as varchar), '\N') as clean, coalesce(cast(n_chars as varchar), '\N') as n_chars, case when share is null then '\N' when isinf(share) then null else cast(share as varchar) end as share"


def _typed(spark, d):
    k = F.col("doc_id") % 9
    share = F.when(k == 6, None).when(k == 7, float("inf")).when(k == 8, F.col("n_chars").cast("double")).otherwise(F.col("n_chars") / 7)
    return table(spark, d, "documents").select("doc_id", "text", F.when(k != 4, F.col("n_chars") > 900).alias("clean"), F.when(k != 5, F.col("n_chars")).alias("n_chars"), share.alias("share"))


@query("s16_lossless_cell_encode", f"with {_TYPED} {_CELLS}, case when isinf(share) then 'share' else '' end as rejects from typed")
def lossless_cell_encode(spark, d):
    return typed_cells.encoded(_typed(spark, d), _KINDS).withColumn("rejects", F.array_join("rejects", ","))


@query("s17_lossless_cell_decode", f"with {_TYPED} select doc_id, sha256(coalesce(text, '')) as digest, clean, case when doc_id % 5 = 1 then null else n_chars end as n_chars, case when not isinf(share) then share end as share, array_to_string(list_filter([case when doc_id % 5 = 1 and n_chars is not null then 'n_chars' end, case when isinf(share) then 'share' end], lambda x: x is not null), ',') as rejects from typed")
def lossless_cell_decode(spark, d):
    coded = typed_cells.encoded(_typed(spark, d), _KINDS).drop("rejects")
    # Every fifth count is written as no integer is.
    spoilt = coded.withColumn("n_chars", F.when((F.col("doc_id") % 5 == 1) & (F.col("n_chars") != F.lit("\\N")), F.concat(F.lit("0"), "n_chars")).otherwise(F.col("n_chars")))
    back = typed_cells.decoded(spoilt, _KINDS)
    return back.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "clean", "n_chars", "share", F.array_join("rejects", ",").alias("rejects"))


_LEXEMES = """lex as (select l_orderkey, l_linenumber, cast(cast(round(l_extendedprice, 2) as decimal(18,2)) as varchar) as p, l_orderkey % 8 as k from lineitem),
    written as (select *, case k when 0 then p || '000000000000001' when 1 then '9007199254740993' when 2 then '1e400' when 3 then p || '.' when 4 then '-1e-400' when 5 then cast(l_orderkey as varchar) when 6 then '0' || p else p end as text from lex)"""


@query("s18_typed_number_parse", f"with {_LEXEMES} select l_orderkey, l_linenumber, case k when 0 then 'digits' when 1 then 'integer range' when 2 then 'overflow' when 3 then 'lexeme' when 4 then 'underflow' when 6 then 'lexeme' else 'ok' end as reason, case when k in (5, 7) then cast(text as double) end as value, case when k in (0, 1, 5, 7) then cast(cast(text as decimal(38,18)) as varchar) end as exact, case when k = 5 then 'ok' when k = 1 then 'integer range' when k in (3, 6) then 'lexeme' else 'fraction' end as as_integer from written")
def typed_number_parse(spark, d):
    k, p = F.col("l_orderkey") % 8, F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    text = F.when(k == 0, F.concat(p, F.lit("000000000000001"))).when(k == 1, "9007199254740993").when(k == 2, "1e400").when(k == 3, F.concat(p, F.lit("."))).when(k == 4, "-1e-400").when(k == 5, F.col("l_orderkey").cast("string")).when(k == 6, F.concat(F.lit("0"), p)).otherwise(p)
    read = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", typed_cells.parsed_number(text).alias("n"), typed_cells.parsed_number(text, "integer").alias("i"))
    return read.select("l_orderkey", "l_linenumber", "n.reason", "n.value", F.col("n.exact").cast("string").alias("exact"), F.col("i.reason").alias("as_integer"))


@query("p26_canonical_json", """select event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' as record from events""")
def canonical_json(spark, d):
    return table(spark, d, "events").select("event_id", cells.canonical_json("user_id", "event_type").alias("record"))


@query("p09_methods_receipt", "select p_partkey, concat_ws('; ', 'brand ' || p_brand, case when p_size > 25 then 'size ' || p_size end) as sentence from part")
def methods_receipt(spark, d):
    return table(spark, d, "part").select("p_partkey", cells.sentence({"brand": F.col("p_brand"), "size": F.when(F.col("p_size") > 25, F.col("p_size"))}).alias("sentence"))


@query("p14_rgb_luminance", "select l_orderkey, l_linenumber, round(0.2126 * l_quantity + 0.7152 * l_discount + 0.0722 * l_tax, 8) as grey from lineitem")
def rgb_luminance(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(cells.luminance("l_quantity", "l_discount", "l_tax"), 8).alias("grey"))


@query("s27_count_summary_csv", "select cast(l_orderkey as varchar) as image_name, count(*) as cell_count from lineitem group by all")
def count_summary_csv(spark, d):
    return table(spark, d, "lineitem").groupBy(cells.formula_safe(F.col("l_orderkey").cast("string")).alias("image_name")).agg(F.count("*").alias("cell_count"))


@query("s23_study_summary", "select 'sources' as name, count(*) as n from customer union all select 'results', count(*) from orders union all select 'jobs', count(*) from lineitem")
def study_summary(spark, d):
    parts = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, t in (("sources", "customer"), ("results", "orders"), ("jobs", "lineitem"))]
    return parts[0].union(parts[1]).union(parts[2])


@query("s22_latest_records", "select conv_id, max(turn) as revision, arg_max(text, turn) as record from conversations group by conv_id")
def latest_records(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("revision"), F.max_by("text", "turn").alias("record"))


@query("w07_review_state", "select conv_id, arg_max(role, turn) as disposition, count(*) as events from conversations group by conv_id")
def review_state(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("disposition"), F.count("*").alias("events"))


@query("s24_revision_checked_append", "select c.conv_id, c.turn, c.turn = m.t as accepted from conversations c join (select conv_id, max(turn) as t from conversations group by conv_id) m using (conv_id)")
def revision_checked_append(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn")
    return sets.checked_append(turns.groupBy("conv_id").agg(F.max("turn").alias("current")), turns, "conv_id", "turn")


@query("s29_byte_bounded_page", "select doc_id, bytes, count(*) over () as next_offset from (select doc_id, strlen(text) as bytes, sum(strlen(text)) over (order by doc_id) as total from documents where text is not null) where total <= 65536 or total = bytes")
def byte_bounded_page(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"))
    return cells.byte_page(docs, "doc_id", "bytes", 65536)


@query("a42_rights_eligibility", "select source, count(*) filter (where lang <> 'de') as source_cleared, count(*) filter (where lang <> 'de' and n_chars > 500) as eligible, count(*) filter (where lang <> 'de' and n_chars > 500 and doc_id % 2 = 0) as weights from documents group by source")
def rights_eligibility(spark, d):
    cleared, label_cleared, weights_cleared = F.col("lang") != "de", F.col("n_chars") > 500, F.col("doc_id") % 2 == 0
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(cleared).alias("source_cleared"), F.count_if(cleared & label_cleared).alias("eligible"), F.count_if(cleared & label_cleared & weights_cleared).alias("weights"))