"""From raw documents to token ids, stage by stage.

Each stage takes what the one before it kept.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlane.llm import language_id as lid
from ledgerlane.llm.common import cut, documents, saved, small_side
from ledgerlane.llm.line_dedup import drop_site_lines
from ledgerlane.llm.mixing import mix
from ledgerlane.llm.near_dedup import BROADCAST_IDS, near_groups
from ledgerlane.llm.sentence_pieces import encode

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents whose text some language fits.

    A text without letters goes, and one that takes more than ``lid.MAX_BITS``
    bits a byte in every language.  Labels stay as they are.
    """
    model = lid.learn(docs)
    kept = lid.identify(docs, model, text_col="text", keep=COLUMNS[1:])
    fits = (F.col("lang_pred") != lid.UNKNOWN) & (F.col("bits_per_byte") <= lid.MAX_BITS)
    return kept.filter(fits).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found on more than 6.5 % of a source's pages go."""
    cleaned = drop_site_lines(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("lines.dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id."""
    groups = cut(near_groups(docs).filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")))

    def rows_of(ids: DataFrame) -> DataFrame:
        return docs.join(small_side(ids.select("doc_id"), F.lit(1), BROADCAST_IDS), "doc_id", "left_semi").select(*COLUMNS)

    # Rows without an id stay; rows that repeat an id are one document, and one
    # row of it stays.
    kept = rows_of(groups.filter("rows = 1")).unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS))
    repeated = groups.filter("rows > 1")
    if repeated.isEmpty():
        return kept
    copies = Window.partitionBy("doc_id").orderBy("text")
    first = rows_of(repeated).withColumn("__row", F.row_number().over(copies)).filter("__row = 1")
    return kept.unionByName(first.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source to the same weight."""
    return mix(docs).select(*COLUMNS)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to."""
    return encode(docs, PIECE_MODEL)


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("mix_sources", mix_sources), ("sentence_pieces", sentence_pieces),
]

# No SQL for languages, near duplicates or pieces; the tests have a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
