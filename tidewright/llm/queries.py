"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import ann, bpe, decontamination, langid, line_dedup, ngram_join, pii, sharding, substring_dedup, warc
from tidewright.llm.tables import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of every document's ids and of the text decoded from them."""
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"])
    return coded.select("doc_id", *bpe.digests(coded))


def op2_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector, by inner product."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 3-word shingle Jaccard of 0.9 or more."""
    found = ngram_join.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)
    return found.withColumnRenamed("id", "doc_id")


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left of every document without runs of three lines that stand earlier."""
    found = line_dedup.delete_repeated_runs(table(spark, sf_dir, "documents"), min_lines=3)
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


def op4_long_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op4_line_runs``, also without runs of one or two lines of 50 words or more that stand earlier."""
    found = line_dedup.delete_repeated_runs(table(spark, sf_dir, "documents"), min_lines=3, min_words=50)
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


def op5_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    sample = langid.fit(docs.filter(F.coalesce(~langid.held_out(), F.lit(False))))
    return langid.classify(docs, sample, keep=[F.col("doc_id"), F.coalesce(langid.held_out(), F.lit(False)).alias("held_out")])


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document without 20-word windows that start earlier."""
    found = substring_dedup.cut_repeats(table(spark, sf_dir, "documents"), width=20)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_shard_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes, equal texts together."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the written archives of all pages hold, read back."""
    found = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: what the patterns find, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find_spans(docs, pii.fit(docs))
    # A lambda of two arguments, be the second a default, gets the place in the array as its second.
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    every = F.concat("base", "added")
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(every).alias("spans"))


def op10_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that it holds within a fifth of the item's words edited."""
    found = decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


QUERIES = {
    "op1_bpe_prefix_dp": op1_bpe_prefix_dp,
    "op2_posting_lists": op2_posting_lists,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_line_runs": op4_line_runs,
    "op4_long_runs": op4_long_runs,
    "op5_cross_parsing": op5_cross_parsing,
    "op6_recompression": op6_recompression,
    "op7_shard_differencing": op7_shard_differencing,
    "op8_warc_dictionary": op8_warc_dictionary,
    "op9_skip_chain_crf": op9_skip_chain_crf,
    "op10_cgk_decontamination": op10_cgk_decontamination,
}

ORACLES: dict[str, str] = {
    "op4_line_runs": """
        WITH d AS (
          SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS w FROM documents
        ), v AS (
          SELECT doc_id, s, md5(array_to_string(w[s:s + 2], chr(10))) AS h
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) >= 3)
        ), r AS (
          SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM v) WHERE k > 1
        ), gone AS (
          SELECT DISTINCT doc_id, unnest(range(s, s + 3)) AS p FROM r
        ), p AS (
          SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS line FROM d WHERE len(w) > 0
        ), k AS (
          SELECT p.doc_id, count(gone.p) AS n_removed, count(gone.p) - count(before.p) AS n_runs,
                 coalesce(string_agg(line, chr(10) ORDER BY p.p) FILTER (gone.p IS NULL), '') AS kept
          FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.p = gone.p
          LEFT JOIN gone AS before ON gone.doc_id = before.doc_id AND gone.p = before.p + 1 GROUP BY 1
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
               CASE WHEN text IS NOT NULL THEN sha256(kept) END AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id
    """,
    "op4_long_runs": r"""
        WITH d AS (
          SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS w FROM documents
        ), v AS (
          SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], chr(10)) AS run
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)
        ), l AS (
          SELECT doc_id, s, n, md5(run) AS h FROM v WHERE n = 3 OR len(regexp_extract_all(run, '[^\x20\x09-\x0D]+')) >= 50
        ), r AS (
          SELECT doc_id, s, n FROM (SELECT doc_id, s, n, row_number() OVER (PARTITION BY n, h ORDER BY doc_id, s) AS k FROM l) WHERE k > 1
        ), gone AS (
          SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM r
        ), p AS (
          SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS line FROM d WHERE len(w) > 0
        ), k AS (
          SELECT p.doc_id, count(gone.p) AS n_removed, count(gone.p) - count(before.p) AS n_runs,
                 coalesce(string_agg(line, chr(10) ORDER BY p.p) FILTER (gone.p IS NULL), '') AS kept
          FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.p = gone.p
          LEFT JOIN gone AS before ON gone.doc_id = before.doc_id AND gone.p = before.p + 1 GROUP BY 1
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
               CASE WHEN text IS NOT NULL THEN sha256(kept) END AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id
    """,
    "op6_recompression": r"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), v AS (
          SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)
        ), r AS (
          SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM v) WHERE k > 1
        ), gone AS (
          SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r
        ), p AS (
          SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d WHERE len(w) > 0
        ), k AS (
          SELECT p.doc_id, count(gone.p) AS n_removed,
                 coalesce(string_agg(word, ' ' ORDER BY p.p) FILTER (gone.p IS NULL), '') AS kept
          FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.p = gone.p GROUP BY 1
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id
    """,
    "op8_warc_dictionary": """
        WITH p AS (
          SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), g AS (
          SELECT payload_digest, max(page_id) AS target FROM p WHERE payload_bytes >= 1000 GROUP BY 1
        )
        SELECT page_id, payload_bytes, p.payload_digest,
               CASE WHEN target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN target <> page_id THEN target END AS refers_to
        FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 1000
    """,
}
