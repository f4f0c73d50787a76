"""The registered queries of the text operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_groups

    return embedding_groups(_table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    groups = simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, score_quality

    documents = _table(spark, sf_dir, "documents")
    model = fit_quality(documents, _table(spark, sf_dir, "labels"))
    return score_quality(documents, model).drop("text")


def op6_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_repair import repair_chats

    return repair_chats(_table(spark, sf_dir, "conversations"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify_language

    return identify_language(_table(spark, sf_dir, "documents")).drop("text")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path=public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    documents = _table(spark, sf_dir, "documents")
    model = fit_toxicity(documents, _table(spark, sf_dir, "labels"))
    scored = score_toxicity(documents, model)
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("segments").cast("bigint").alias("n_segments"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .main_text import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import fill_in_middle, restore_text

    made = restore_text(fill_in_middle(_table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    found = substring_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"op1_license_scan": op1_license_scan, "op2_embedding_dedup": op2_embedding_dedup, "op3_simhash": op3_simhash, "op4_decontaminate": op4_decontaminate, "op5_quality": op5_quality, "op6_chat_repair": op6_chat_repair, "op7_language": op7_language, "op8_packing": op8_packing, "op9_toxicity": op9_toxicity, "op10_main_text": op10_main_text, "op11_collocations": op11_collocations, "op12_fill_in_middle": op12_fill_in_middle, "op13_substring_dedup": op13_substring_dedup, "pipeline": pipeline}


def _license_sql() -> str:
    from .license_notices import notices
    from .license_scan import PHRASES, WORD, templates_of

    templates = templates_of(notices())
    sets = ", ".join(f"({t.number}, '{t.label}', {t.words!r}, {t.need}, {t.length}, {t.width})" for t in templates)
    phrases = ", ".join(f"('{label}', {phrase.split(' ')!r})" for phrase, label in PHRASES.items())
    return rf"""
    with texts as (
        select row_number() over () as r, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w
        from documents),
    phrases(label, p) as (values {phrases}),
    templates(number, label, t, need, length, width) as (values {sets}),
    places as (
        select r, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1 : i + len(p)] = p)) as place
        from texts, phrases),
    base as (
        select r, count(*) as n_base, min(place) as first_word, max(place) as last_word, list_sort(list_distinct(list(label))) as found
        from places group by r),
    words as (select r, unnest(w) as word, unnest(range(0, len(w))) as place from texts),
    tokens as (select number, width, need, unnest(t) as word from templates),
    held as (
        select r, number from (select distinct r, word from words) join tokens using (word)
        group by r, number, need having count(*) >= need),
    hits as (select r, number, width, word, place, place // width as part from held join tokens using (number) join words using (r, word)),
    starts as (select r, number, width, place as first_place, unnest([part, part + 1]) as part from hits),
    blocks as (
        select s.r, s.number, first_place, word, place, place - first_place + 1 as span,
               row_number() over (partition by s.r, s.number, first_place order by place) as met,
               row_number() over (partition by s.r, s.number, first_place, word order by place) as nth
        from starts s join hits h on s.r = h.r and s.number = h.number and s.part = h.part
         and h.place between first_place and first_place + s.width - 1),
    ends as (select *, row_number() over (partition by r, number, first_place order by place) as k from blocks where nth = 1),
    weighed as (select e.*, label, width, need, len(t) as n, k - greatest(span - met, span - length) as weight from ends e join templates using (number)),
    matches as (
        select r, number, width, label, first_place, place as last_place, k as shared, n, span, weight
        from weighed where k >= need
        qualify row_number() over (partition by r, number, first_place order by weight desc, place) = 1),
    best as (
        select r, label, shared / n as share from matches m
        where not exists (
            select 1 from matches o
            where o.r = m.r and (
                (o.number = m.number and abs(o.first_place - m.first_place) < m.width and o.weight > m.weight)
                or (o.number <> m.number and 4 * (least(m.last_place, o.last_place) - greatest(m.first_place, o.first_place) + 1) >= 3 * m.span
                    and (-o.weight, o.span, o.n, o.number) < (-m.weight, m.span, m.n, m.number))))),
    more as (select r, max(share) as share, list(distinct label) as labels from best group by r)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word,
           cast(last_word as bigint) as last_word, coalesce(array_to_string(found, ','), '') as base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(found, []), coalesce(labels, [])))), ','), '') as labels,
           case when n_base > 0 then 1.0::double else coalesce(share, 0.0)::double end as score
    from texts left join base using (r) left join more using (r)
    """


def _contamination_sql() -> str:
    from .license_scan import WORD

    words = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
    windows = "list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))"
    return rf"""
    with docs as (select row_number() over () as r, doc_id, {words} as w from documents),
    items as (select item_id, w, least(len(w), 10) as n from (select item_id, {words} as w from benchmark) where len(w) > 0),
    theirs as (select distinct item_id, n, unnest({windows}) as win from items),
    sought as (select distinct n from items),
    ours as (select r, n, unnest({windows}) as win, unnest(range(0, len(w) - n + 1)) as place from docs, sought where len(w) >= n),
    hits as (select r, n, place, win from ours where (n, win) in (select n, win from theirs)),
    hit as (select r, count(distinct k) as n_hit from (select r, unnest(range(place, place + n)) as k from hits) group by r),
    found as (select r, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as digest from (select distinct r, cast(item_id as varchar) as item from hits join theirs using (n, win)) group by r)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(digest, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from docs left join hit using (r) left join found using (r)
    """


#: All pairs of vectors; the lattice may miss a link in some hundreds of those just at the threshold (none on the tests' tables).
_EMBEDDING_SQL = """
    with recursive v as (select row_number() over () as r, vec_id, cast(embedding as double[]) as e from embeddings),
    sound as (select * from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
    links as (select a.r as a, b.r as b from sound a join sound b on a.r <> b.r and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
    walk(r, root) as (select r, r from v union select b, root from walk join links on a = r),
    component as (select walk.r, min(o.vec_id) as component_id from walk join v o on o.r = root group by walk.r)
    select vec_id, (select count(*) from links where a = v.r) as n_links, component_id, vec_id is not distinct from component_id as kept from v join component using (r)
    """


_COLLOCATIONS_SQL = r"""
    with texts as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
    pieces as (select lang, regexp_extract_all(piece, '[^ 	]+') as w from (select lang, unnest(string_split_regex(t, '[.,;:!?
-
]')) as piece from texts)),
    grams as (
        select lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) as p, k
        from (select lang, w, unnest([1, 2, 3, 4]) as k from pieces) where len(w) >= k),
    f as materialized (select lang, p, k, count(*) as a from grams group by lang, p, k),
    n as (select lang, sum(a) as n from f where k = 1 group by lang),
    candidates as materialized (select * from f where k > 1 and a >= 30),
    parted as (select lang, p, k, a, cut, p[1 : cut] as front, p[cut + 1 : k] as rest from (select *, unnest(range(1, k)) as cut from candidates)),
    cuts as (
        select c.lang, c.p, c.k, c.a, cut, x.a as l, y.a as r, cast(c.a as hugeint) * 2000000 // (cast(x.a as hugeint) + y.a) as score
        from parted c join f x on x.lang = c.lang and x.p = front join f y on y.lang = c.lang and y.p = rest),
    lowest as (select * from cuts qualify row_number() over (partition by lang, p order by score, cut) = 1),
    inside as (
        select lang, p[s : s + j - 1] as q, max(a) as longer
        from (select lang, p, k, a, j, unnest(range(1, k - j + 2)) as s from (select *, unnest(range(2, k)) as j from candidates)) group by lang, q),
    dropped as (select x.lang, x.p from lowest x join inside i on x.lang = i.lang and x.p = i.q where 100 * longer >= 80 * x.a),
    ranked as (
        select lang, array_to_string(p, ' ') as phrase, a, l, r, score,
               row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) as rank
        from lowest anti join dropped using (lang, p))
    select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked join n using (lang) where rank <= 2000
    """

_FILL_IN_MIDDLE_SQL = """
    with cut as (
        select doc_id, coalesce(text, '') as t,
               regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as w, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as d
        from documents),
    drawn as (
        select *, len(w) as n, list_transform([1, 9, 17, 25], lambda i: cast('0x' || substr(d, i, 8) as bigint)) as h from cut),
    formed as (
        select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
               case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 90 then 'plain'
                    when h[4] % 100 < 20 then 'spm' else 'psm' end as form
        from drawn),
    parts as (
        select *, array_to_string(w[1 : a], '') as p, array_to_string(w[a + 1 : b], '') as m, array_to_string(w[b + 1 : n], '') as s from formed)
    select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
           sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
           sha256(t) as restored_sha256
    from parts
    """

_SUBSTRING_SQL = r"""
    with texts as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    starts as (select r, doc_id, w, unnest(range(1, len(w) - 48)) as i from texts where len(w) >= 50),
    wins as (select r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as win from starts),
    least_id as (select win, min(doc_id) as low from wins group by win),
    gone as (select distinct r, unnest(range(i, i + 50)) as k from wins join least_id using (win) where low < doc_id or (low is not null and doc_id is null)),
    words as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from texts),
    kept as (select r, string_agg(word, ' ' order by k) as t from words anti join gone using (r, k) group by r)
    select doc_id, cast(len(w) as bigint) as n_words, (select count(*) from gone where gone.r = texts.r) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
    from texts left join kept using (r)
    """


def oracle_sql() -> dict[str, str]:
    return {"op11_collocations": _COLLOCATIONS_SQL, "op12_fill_in_middle": _FILL_IN_MIDDLE_SQL, "op13_substring_dedup": _SUBSTRING_SQL, "op1_license_scan": _license_sql(), "op2_embedding_dedup": _EMBEDDING_SQL, "op4_decontaminate": _contamination_sql()}
