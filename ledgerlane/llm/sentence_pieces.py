"""SentencePiece encoding and decoding of a table of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import small_batches
from ledgerlane.llm.piece_model import piece_model
from ledgerlane.llm.words import pieces


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, ends, decoded`` of every row.

    ``ids`` are the library's, with the end id last and no sampling.  ``ends``
    says where each piece ends in the UTF-8 bytes of the text (it begins where
    the one before it ends).  ``decoded`` is the library's decoding of the ids.
    A null text counts as empty: the end id alone, decoded to an empty text.
    Null and repeated ids are returned as they are.  ``model`` is a path that
    every worker can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = piece_model(model)
        for batch in batches:
            for piece in pieces(batch):
                texts = piece.column(1).to_pylist()
                ids = loaded.encode(texts)
                ends = [loaded.ends(t, i) for t, i in zip(texts, ids)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(ids, type=pa.list_(pa.int32())), pa.array(ends, type=pa.list_(pa.int64())),
                     pa.array(loaded.decode(ids), type=pa.string())], names=["doc_id", "ids", "ends", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>, ends array<long>, decoded string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``encode`` returns, as digests made in the same task:
    ``doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes``.

    ``n_bytes`` is where the last piece ends: the bytes that all spans cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = piece_model(model)
        for batch in batches:
            for piece in pieces(batch):
                texts = piece.column(1).to_pylist()
                ids = loaded.encode(texts)
                decoded = loaded.decode(ids)
                covered = [int(loaded.ends(t, i)[-1]) for t, i in zip(texts, ids)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([len(i) for i in ids], type=pa.int64()),
                     pa.array([hashlib.sha256(loaded.as_decimals(i).encode()).hexdigest() for i in ids], type=pa.string()),
                     pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], type=pa.string()),
                     pa.array(covered, type=pa.int64())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
