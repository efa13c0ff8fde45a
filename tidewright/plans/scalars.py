"""Queries of scalar functions and scores on the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import scores
from tidewright.functions import text as T
from tidewright.plans.base import Tables, query


@query("SELECT p_partkey, left(trim(p_name), 300) AS lemma, left(lower(trim(p_name)), 300) AS key FROM part")
def x1_normalized_lemma(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.normalized_lemma("p_name").alias("l")).select("p_partkey", "l.*")


@query("SELECT doc_id, trim(regexp_replace(lower(replace(text, '_', ' ')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS s FROM documents")
def x2_squeezed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.squeezed("text").alias("s"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS s FROM documents")
def x3_ascii_folded(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.ascii_folded("text").alias("s"))


_STEM = """CASE WHEN w LIKE 'educat%' THEN 'educat' WHEN w LIKE 'universit%' THEN 'universit' WHEN w LIKE 'school%' THEN 'school' WHEN w LIKE '%ies' AND length(w) > 5 THEN regexp_replace(w, 'ies$', 'y')
 WHEN w LIKE '%s' AND length(w) > 5 AND NOT regexp_matches(w, '(ss|us|is)$') THEN regexp_replace(w, 's$', '') ELSE w END"""


@query(f"SELECT w, {_STEM} AS stem FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)")
def x4_stem(t: Tables) -> DataFrame:
    words = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("w")).distinct()
    return words.select("w", T.stem("w").alias("stem"))


@query("""
WITH x AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'that'))) AS w FROM benchmark) SELECT item_id, list_sort(w) AS words FROM x
""")
def x5_tokens(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.sort_array(T.tokens("text", least=3, stop=("the", "and", "that"))).alias("words"))


@query("""
WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS b FROM benchmark), n AS (SELECT max(item_id) + 1 AS n FROM benchmark),
d AS (SELECT doc_id, doc_id % n AS item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS a FROM documents, n)
SELECT doc_id, CAST(len(list_intersect(a, b)) AS INT) AS shared FROM d JOIN b ON d.item_id = b.item_id
""")
def x6_shared_words(t: Tables) -> DataFrame:
    """Each document against one benchmark item."""
    n = t.benchmark.agg(F.max("item_id") + 1).first()[0]
    items = t.benchmark.select("item_id", T.tokens("text", pattern="[a-z]+").alias("b"))
    docs = t.documents.select("doc_id", (F.col("doc_id") % n).alias("item_id"), T.tokens("text", pattern="[a-z]+").alias("a"))
    return docs.join(items, "item_id").select("doc_id", T.shared_words(F.col("a"), F.col("b")).alias("shared"))


@query("""
WITH x AS (SELECT DISTINCT unnest([p_brand, 'Educational ' || p_type, p_type || 'y', p_type || 's']) AS x FROM part)
SELECT x, list_distinct(list_filter([x, CASE WHEN x LIKE 'Educational %' THEN 'Education ' || substr(x, 13) END, CASE WHEN x LIKE '%y' THEN regexp_replace(x, 'y$', '') || 'ies' WHEN x NOT LIKE '%s' THEN x || 's' END], lambda v: v IS NOT NULL)).list_sort() AS variants FROM x
""")
def x7_label_variants(t: Tables) -> DataFrame:
    x = t.part.select(F.explode(F.array("p_brand", F.concat(F.lit("Educational "), "p_type"), F.concat("p_type", F.lit("y")), F.concat("p_type", F.lit("s")))).alias("x")).distinct()
    return x.select("x", F.sort_array(T.label_variants("x")).alias("variants"))


@query("SELECT item_id, regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+', '_', 'g') AS title FROM benchmark")
def x8_page_title(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", T.page_title("text").alias("title"))


@query("""
WITH x AS (SELECT doc_id, lower(CASE doc_id % 4 WHEN 0 THEN ' EN_us' WHEN 1 THEN 'eng-GB' WHEN 2 THEN '??' ELSE upper(lang) END) AS t FROM documents), y AS (SELECT doc_id, replace(trim(t), '_', '-') AS t FROM x)
SELECT doc_id, CASE WHEN NOT regexp_full_match(t, '[a-z0-9]{2,8}(-[a-z0-9]{1,8})*') THEN 'und' WHEN t LIKE 'eng%' THEN 'en' || substr(t, 4) ELSE t END AS code FROM y
""")
def x9_language_code(t: Tables) -> DataFrame:
    m = F.col("doc_id") % 4
    tag = F.when(m == 0, " EN_us").when(m == 1, "eng-GB").when(m == 2, "??").otherwise(F.upper("lang"))
    return t.documents.select("doc_id", T.language_code(tag, {"eng": "en"}).alias("code"))


@query("""
WITH w AS (SELECT doc_id, unnest(list_concat(['first one'], list_transform(string_split(text, ' '), lambda x: trim(regexp_replace(replace(regexp_extract(x, '^[^\\[\\]|#]*'), '_', ' '), '\\s+', ' ', 'g'))))) AS x FROM documents)
SELECT doc_id, list_sort(list(DISTINCT CASE left(x, 1) WHEN 'ß' THEN 'SS' ELSE upper(left(x, 1)) END || substr(x, 2))) AS links FROM w WHERE length(x) BETWEEN 1 AND 240 AND NOT contains(x, ':') AND NOT starts_with(x, '/') GROUP BY 1
""")
def x10_wiki_links(t: Tables) -> DataFrame:
    from tidewright.sources import html

    text = F.concat(F.lit("[[first_one|label]] and "), F.array_join(F.transform(F.split("text", " "), lambda w: F.concat(F.lit("[["), w, F.lit("]]"))), " "))
    return t.documents.select("doc_id", F.array_sort(html.wiki_links(text, 1 << 20)).alias("links"))


@query()
def x11_x12_lead_and_passages(t: Tables) -> DataFrame:
    from tidewright.sources import html

    wiki = F.concat(F.lit("{{box|{{in}}}}'''"), F.col("text"), F.lit("''' <ref>x</ref>\n== Part ==\nmore"))
    lead = t.documents.select("doc_id", html.plain_lead(wiki).alias("lead"))
    return lead.select("doc_id", F.length("lead").alias("n"), html.targeted_passages("lead", F.array(F.lit("the"), F.lit("le"))).alias("passages"))


@query("""
WITH u AS (SELECT page_id, trim(url) AS u FROM pages), p AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h,
 regexp_replace(regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '#.*$', '') AS r FROM u)
SELECT page_id, CASE WHEN s = '' THEN NULL ELSE s || '://' || CASE s WHEN 'http' THEN regexp_replace(h, ':80$', '') WHEN 'https' THEN regexp_replace(h, ':443$', '') ELSE h END || CASE WHEN r LIKE '/%' THEN r ELSE '/' || r END END AS url FROM p
""")
def x14_canonical_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.url_parts("url").alias("url"))


@query("""
SELECT page_id, 'https://' || array_to_string(list_reverse(string_split('org.example.p' || page_id, '.')), '.') || CASE WHEN page_id % 2 = 0 THEN '/x' ELSE '/' END AS url FROM pages
""")
def x15_external_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.external_url(F.concat(F.lit("https://org.example.p"), "page_id", F.lit(".")), F.when(F.col("page_id") % 2 == 0, "/x")).alias("url"))


@query("SELECT page_id, CASE WHEN page_id > 0 THEN 'Q' || page_id END AS qid, CASE WHEN page_id > 0 THEN 'concept' || page_id END AS cid FROM pages")
def x16_ids_from_urls(t: Tables) -> DataFrame:
    q = T.entity_id(F.concat(F.lit("http://e.org/Q"), "page_id"))
    return t.pages.select("page_id", q.alias("qid"), T.concept_id(F.concat(F.lit("concept"), "page_id")).alias("cid"))


@query("SELECT doc_id, 'V32_C_' || left(sha256(lang || '|' || source || '|' || doc_id), 26) AS a, 'V28_' || left(sha256(lang || '/' || source || '/' || doc_id), 24) AS b FROM documents")
def x17_candidate_ids(t: Tables) -> DataFrame:
    a = T.candidate_key("lang", "source", "doc_id")
    return t.documents.select("doc_id", a.alias("a"), T.candidate_key("lang", "source", "doc_id", prefix="V28_", joint="/", length=24).alias("b"))


@query("""SELECT conv_id, turn, 'PROP2_' || left(sha256('{"page_id":' || conv_id || ',"statement":' || to_json(text) || '}'), 40) AS fact_key FROM conversations""")
def x20_canonical_keys(t: Tables) -> DataFrame:
    from pyspark.sql.types import StringType

    from tidewright.sources import packs

    @F.pandas_udf(StringType())
    def key(c: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([packs.fact_key({"page_id": int(a), "statement": b, "source_quote": "x"}) for a, b in zip(c, u, strict=True)])

    return t.conversations.select("conv_id", "turn", key("conv_id", "text").alias("fact_key"))


@query("""
SELECT p_partkey, least(90, 40 + least(20, 6 * greatest(0, s - 1)) + least(12, 4 * l) + least(12, 6 * c) + least(8, 4 * b)) + least(15, 5 * o) AS priority
FROM (SELECT p_partkey, p_size % 7 AS s, p_size % 5 AS l, p_size % 3 AS c, p_size % 4 AS b, p_partkey % 5 AS o FROM part)
""")
def x21_discovery_priority(t: Tables) -> DataFrame:
    m = lambda c, n: F.col(c) % n
    return t.part.select("p_partkey", scores.discovery_priority(m("p_size", 7), m("p_size", 5), m("p_size", 3), m("p_size", 4), m("p_partkey", 5)).alias("priority"))


@query("""
WITH x AS (SELECT p_partkey, p_size % 5 AS l, p_size % 3 AS c, p_size % 4 AS b, p_size % 7 AS s, list_distinct(regexp_extract_all(lower(p_name || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' law' END), '[a-z]+')) AS t, list_distinct(regexp_extract_all(lower(p_type), '[a-z]+')) AS k FROM part),
y AS (SELECT *, len(list_intersect(t, k)) AS o, len(t) > 0 AND len(list_filter(t, lambda w: w NOT IN ('city','county','municipality','village','town','province','state','country','district','region','capital','legislature','government','rights','people','language','justice','social','law','legislation','wisdom','reason','violence','university','college'))) = 0 AS general FROM x)
SELECT p_partkey, CAST(greatest(0, least(100, 3 + least(37, 13 * l) + least(18, 4 * s) + least(8, 2 * c) + least(5, b) + least(26, 13 * o) - CASE WHEN general AND o = 0 THEN 24 ELSE 0 END - CASE WHEN l = 0 AND o = 0 THEN 12 ELSE 0 END - CASE WHEN b > 0 AND l = 0 THEN 3 ELSE 0 END)) AS BIGINT) AS score FROM y
""")
def x22_planning_score(t: Tables) -> DataFrame:
    m = lambda n: F.col("p_size") % n
    title = T.tokens(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "").otherwise(" law")), pattern="[a-z]+")
    return t.part.select("p_partkey", scores.planning_score(m(5), m(3), m(4), m(7), title, T.tokens("p_type", pattern="[a-z]+")).cast("long").alias("score"))


@query("""
WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN greatest(p_size, 20) ELSE p_size END AS own, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 100 END AS prof FROM part)
SELECT p_partkey, CASE WHEN prof IS NULL THEN own ELSE least(100, CAST(round_even(own * 0.8 + prof * 0.2 + CASE WHEN p_partkey % 5 = 0 THEN 5 ELSE 0 END, 0) AS INT)) END AS score FROM x
""")
def x23_blended_score(t: Tables) -> DataFrame:
    profile = F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") % 100)
    return t.part.select("p_partkey", scores.blended(F.col("p_size"), profile, F.col("p_partkey") % 5 == 0, F.col("p_partkey") % 3 == 0).alias("score"))


@query("""
WITH x AS (SELECT p_partkey, lower(p_type) AS n, lower(CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN split_part(p_type, ' ', 1) WHEN 2 THEN left(p_type, 4) WHEN 3 THEN split_part(p_type, ' ', 2) || ' ' || split_part(p_type, ' ', 1) ELSE 'zz ' || split_part(p_type, ' ', 1) END) AS l FROM part),
y AS (SELECT *, list_distinct(list_filter(regexp_extract_all(l, '[a-z0-9]+'), lambda w: length(w) >= 2)) AS ws, list_distinct(list_filter(regexp_extract_all(n, '[a-z0-9]+'), lambda w: length(w) >= 2)) AS cs FROM x), z AS (SELECT *, len(list_intersect(ws, cs)) AS m FROM y)
SELECT p_partkey, CAST(CASE WHEN n = trim(l) THEN 100 WHEN starts_with(n, trim(l) || ' ') OR ends_with(n, ' ' || trim(l)) THEN 88 WHEN contains(n, trim(l)) THEN 79 WHEN len(ws) > 0 AND m = len(ws) THEN 68 WHEN m > 0 THEN least(60, 20 + floor(40 * m / len(ws))) ELSE 0 END AS INT) AS score FROM z
""")
def x25_lexical_ladder(t: Tables) -> DataFrame:
    w = F.split("p_type", " ")
    m = F.col("p_partkey") % 5
    first, second = F.coalesce(F.get(w, F.lit(0)), F.lit("")), F.coalesce(F.get(w, F.lit(1)), F.lit(""))
    label = F.when(m == 0, F.col("p_type")).when(m == 1, first).when(m == 2, F.substring("p_type", 1, 4)).when(m == 3, F.concat(second, F.lit(" "), first)).otherwise(F.concat(F.lit("zz "), first))
    return t.part.select("p_partkey", scores.lexical_ladder(F.col("p_type"), label)["score"].alias("score"))


@query("SELECT p_partkey, greatest(20, CASE WHEN p_partkey % 2 = 0 THEN 78 ELSE 64 END - 8 * (p_size % 7)) AS confidence FROM part")
def x26_category_confidence(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", scores.category_confidence(F.col("p_size") % 7, F.col("p_partkey") % 2 == 0).alias("confidence"))


@query("""
SELECT p_partkey, round_even(70 - 22 * (p_size % 3) + least(35, 6 * (p_size % 4)) + least(10.0, ln(1 + CAST(p_retailprice AS DOUBLE))), 3) - CASE WHEN p_partkey % 5 = 0 THEN 9 ELSE 0 END AS score FROM part
""")
def x27_crawl_score(t: Tables) -> DataFrame:
    title = scores.title_boost(F.lit("plain"), F.col("p_size") % 4)
    return t.part.select("p_partkey", scores.crawl_score(F.col("p_size") % 3, title, F.col("p_retailprice"), F.col("p_partkey") % 5 == 0).alias("score"))


@query("SELECT p_partkey, round(1 / (1 + exp(-greatest(-30, least(30, 0.5 + 0.1 * p_size - 0.002 * p_retailprice)))), 9) AS p FROM part")
def x28_logistic(t: Tables) -> DataFrame:
    p = scores.logistic({"size": F.col("p_size"), "price": F.col("p_retailprice")}, {"size": 0.1, "price": -0.002}, 0.5)
    return t.part.select("p_partkey", F.round(p, 9).alias("p"))


@query("""
WITH x AS (SELECT p_partkey AS k, p_size % 3 AS fam, p_partkey % 6 = 0 AS lex, p_partkey % 5 = 0 AS pos, p_size % 2 AS g, p_size % 7 % 2 AS s, p_partkey % 11 = 0 AS miss FROM part)
SELECT k, CASE WHEN miss OR fam < 2 THEN 1 WHEN lex THEN 2 WHEN pos THEN 3 WHEN g > 0 AND s > 0 THEN 4 WHEN g > 0 OR s > 0 THEN 5 ELSE 6 END AS priority FROM x
""")
def x29_x30_triage(t: Tables) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    x = scores.review_triage(F.when(k % 11 == 0, 0).otherwise(1), F.lit(1), n % 3, k % 6 == 0, k % 5 == 0, F.lit(1), n % 2, n % 7 % 2, F.lit(False))
    return t.part.select(k.alias("k"), x["priority"].alias("priority"))


@query("SELECT doc_id, left(text, 80) AS value, length(text) > 80 AS cut FROM documents")
def x31_clipped(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.clipped("text", 80).alias("c")).select("doc_id", "c.*")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Q' || p_partkey WHEN 1 THEN p_name WHEN 2 THEN p_size || ',' || p_partkey END AS brief FROM part")
def x32_typed_brief(t: Tables) -> DataFrame:
    m, s = F.col("p_partkey") % 4, "string"
    value = F.struct(F.when(m == 0, F.concat(F.lit("Q"), "p_partkey")).alias("id"), F.when(m == 1, F.col("p_name")).alias("text"), F.lit(None).cast(s).alias("time"), F.lit(None).cast(s).alias("amount"), F.when(m == 2, F.col("p_size")).alias("latitude"), F.when(m == 2, F.col("p_partkey")).alias("longitude"))
    return t.part.select("p_partkey", T.typed_brief(value).alias("brief"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS INT) AS n_words FROM documents")
def x33_word_count(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.word_count("text").alias("n_words"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM events")
def x34_iso_time(t: Tables) -> DataFrame:
    return t.events.select("event_id", T.iso_utc("ts").alias("iso"))


@query("""
SELECT lang AS s, list_sort(list(DISTINCT source)) AS labels FROM documents GROUP BY 1
""")
def x37_language_literals(t: Tables) -> DataFrame:
    from tidewright.sources import dumps

    triples = t.documents.select(F.col("lang").alias("s"), F.lit("label").alias("p"), F.col("source").alias("o"), F.lit("literal").alias("kind"), F.lit("en").alias("lang"))
    return dumps.labels_by_language(triples, "label").select("s", F.col("labels")["en"].alias("labels"))


@query("SELECT item_id, trim(regexp_replace('**' || regexp_replace('[x](u) ' || text, '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g') || '**', '[*_`]+', '', 'g')) AS plain FROM benchmark")
def x38_plain_markdown(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", T.plain_markdown(F.concat(F.lit("**[x](u) "), "text", F.lit("**"))).alias("plain"))


@query("SELECT p_partkey, p_brand || ';' || p_type AS joined, [p_brand, p_type] AS items FROM part")
def x39_row_mapping(t: Tables) -> DataFrame:
    joined = T.listed(F.to_json(F.array("p_brand", "p_type")))
    return t.part.select("p_partkey", joined.alias("joined"), T.unlisted(joined).alias("items"))


@query("SELECT item_id, length(to_json({'item_id': item_id, 'text': text})) AS chars FROM benchmark")
def x40_serialized_size(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.length(F.to_json(F.struct("item_id", "text"))).cast("long").alias("chars"))


@query("""
WITH h AS (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)
SELECT page_id, left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h
""")
def x41_deterministic_uuid(t: Tables) -> DataFrame:
    import uuid

    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def uuid5(s: pd.Series) -> pd.Series:
        return s.map(lambda x: str(uuid.uuid5(uuid.NAMESPACE_URL, x)))

    return t.pages.select("page_id", uuid5("url").alias("uuid"))


@query("SELECT doc_id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_-]+', ' ', 'g')), ' '), lambda w: length(w) >= 3))) AS words FROM documents")
def x42_search_words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sort_array(T.search_words("text", 3)).alias("words"))
