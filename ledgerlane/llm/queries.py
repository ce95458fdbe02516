"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm import conversation_queries, language_model
from ledgerlane.llm.common import documents
from ledgerlane.llm.exact_dedup import exact_groups
from ledgerlane.llm.language_id import held_out, identify, learn
from ledgerlane.llm.line_dedup import drop_site_lines
from ledgerlane.llm.mixing import mix
from ledgerlane.llm.near_dedup import near_groups
from ledgerlane.llm.secrets import KINDS, find_secrets
from ledgerlane.llm.sentence_pieces import digests
from ledgerlane.llm.spots import edited_fingerprints
from ledgerlane.llm.token_files import read_tokens, write_tokens

# Public vocabulary files; every worker must be able to read these paths.
TOKENIZERS = "/opt/tokenizers"
QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@_query("op2_near_dedup")
def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Five words, similarity of 0.75 or more."""
    return near_groups(documents(spark, folder))


@_query("op4_mix_sources", """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rated AS (SELECT source, (SELECT count(*) FROM documents) * (1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE) / n AS rate FROM sizes),
logs AS (
  SELECT source, rate, k, -rate + coalesce(sum(CASE WHEN k > 0 THEN ln(rate / k) END)
           OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING), 0) AS log_p
  FROM rated, LATERAL (SELECT unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k)),
points AS (SELECT source, rate, k, sum(exp(log_p)) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS point FROM logs),
tables AS (SELECT source, any_value(rate) AS rate, list(point ORDER BY k) AS cdf FROM points GROUP BY source),
drawn AS (
  SELECT d.*, t.rate, len(list_filter(t.cdf, lambda p: p <=
      ('0x' || substr(md5('17:' || coalesce(d.source, '') || ':' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)) AS copies
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
copied AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM drawn)
SELECT doc_id, text, lang, source, n_chars, copy::BIGINT AS copy, copies::BIGINT AS copies,
       ('0x' || substr(md5('17:' || coalesce(source, '') || ':' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS place
FROM copied
""")
def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Every source to the same weight, as many documents as there are."""
    return mix(documents(spark, folder)).select("doc_id", "text", "lang", "source", "n_chars", "mix.copy", "mix.copies", "mix.place")


@_query("op5_drop_site_lines", """
WITH pages AS (SELECT DISTINCT source, text FROM documents),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
counts AS (
  SELECT source, line, count(*) AS n
  FROM (SELECT DISTINCT source, text, unnest(string_split(text, chr(10))) AS line FROM pages) GROUP BY source, line),
bad AS (
  SELECT c.source, c.line FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= 3 AND c.n > 0.1::DOUBLE * t.pages),
lists AS (SELECT source, list(line) AS bad FROM bad GROUP BY source)
SELECT doc_id, d.source,
       CASE WHEN l.bad IS NULL THEN d.text
            ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(l.bad, x)), chr(10)) END AS text,
       coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS total,
       coalesce(len(list_filter(string_split(d.text, chr(10)), lambda x: list_contains(l.bad, x))), 0)::BIGINT AS dropped
FROM documents d LEFT JOIN lists l ON d.source IS NOT DISTINCT FROM l.source
""")
def op5_drop_site_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines on more than a tenth of a source's pages taken out."""
    return drop_site_lines(documents(spark, folder), ratio=0.1).select("doc_id", "source", "text", "lines.total", "lines.dropped")


@_query("op5_drop_site_lines_in_gap", ORACLES["op5_drop_site_lines"].replace("c.n > 0.1::DOUBLE", "c.n > 0.065::DOUBLE"))
def op5_drop_site_lines_in_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Lines above the measured ratio taken out, as in the pipeline."""
    return drop_site_lines(documents(spark, folder)).select("doc_id", "source", "text", "lines.total", "lines.dropped")


@_query("op7_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(documents(spark, folder))


@_query("op3_token_files")
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Written as flat files with an end id, and read back from them."""
    written = write_tokens(documents(spark, folder), f"{TOKENIZERS}/word_bpe_49k.json", end_id=2)
    return read_tokens(spark, written, with_ids=False)


@_query("op8_sentence_pieces")
def op8_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return digests(documents(spark, folder), f"{TOKENIZERS}/piece_bpe_32k.model")


@_query("op6_secrets")
def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(documents(spark, folder), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    base = F.filter("spans", lambda s: s["kind"] != "random")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", *[count(kind) for kind in KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


@_query("op10_spot_fingerprints")
def op10_spot_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edited_fingerprints(documents(spark, folder))


@_query("op1_language_id")
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Learned from three quarters of the labelled documents."""
    docs = documents(spark, folder)
    model = learn(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


@_query("op9_language_model")
def op9_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Three words, learned from four fifths of the documents."""
    docs = documents(spark, folder)
    held_out = language_model.held_out()
    model = language_model.train(docs.filter(~held_out), order=3)
    scored = language_model.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


QUERIES |= conversation_queries.QUERIES
ORACLES |= conversation_queries.ORACLES
