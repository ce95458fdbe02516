"""Token ids as flat binary files that can be memory-mapped.

A folder holds, for every part of the corpus in ascending id order:

* ``*.tokens``: token ids of all its documents, little-endian, unsigned 16-bit
  if the vocabulary has at most 65,536 ids, else 32-bit;
* ``*.offsets``: where each document ends in that file, in tokens, unsigned 64-bit;
* ``*.documents``: the document ids, signed 64-bit (``nulls`` of them, at the front, are null);

and ``index.json`` with the parts' names, sizes and bases.  A part's base is
the number of tokens of all parts before it, so base + offset is a document's
place in the whole corpus.  Files carry the number of the task attempt that
wrote them; only those of successful attempts are in the index, so a lost
executor leaves files that nobody reads.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.common import cut, fresh_folder, small_batches
from ledgerlane.llm.counted import mapped, read_json, write_json
from ledgerlane.llm.memo import Memo
from ledgerlane.llm.words import pieces

# Documents of an Arrow batch that a reader makes.
READ_ROWS = 4096
# Words whose ids a worker remembers, twice over (about 130 MB each time).
MEMO_WORDS = 700_000


class WordIds:
    """Ids of texts under a tokenizer file, a word at a time.

    The tokenizer drops white space and never looks across it, so the ids of a
    text are those of its parts between blanks, and these repeat.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = Memo(self._encode, MEMO_WORDS)

    def _encode(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each followed by the end id, and where
        each text ends."""
        for blank in "\t\n\r":
            texts = pc.replace_substring(texts, blank, " ")
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        known = [*self.memo.values(words.dictionary.to_pylist()), struct.pack("<I", end_id)]
        sizes = np.fromiter(map(len, known), dtype=np.int32, count=len(known)) // 4
        table = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), type=pa.int32()),
                                         pa.Array.from_buffers(pa.uint32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(known))]))
        stops = np.cumsum(pc.list_value_length(split).to_numpy())
        each = np.insert(words.indices.to_numpy(), stops, len(known) - 1)
        found = table.take(pa.array(each))
        ends = found.offsets.to_numpy()[stops + np.arange(1, len(stops) + 1)]
        return found.values.to_numpy(), ends.astype(np.int64)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _splits_at_blanks(path: str) -> None:
    """Refuse a tokenizer file that may look across white space."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if not any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] and r"[^\s\p{L}\p{N}]+" in s["pattern"].get("Regex", "") for s in steps):
        raise ValueError(f"{path}: not a tokenizer that drops white space")


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> str:
    """Write the corpus and return its folder (by default a new shared one).

    ``tokenizer`` is a path that every worker can read; ``end_id`` is appended
    to every document.  Null texts count as empty.  Rows that repeat an id are
    all written, ordered by their texts; null ids come first.
    """
    _splits_at_blanks(tokenizer)
    ids_used = max(word_ids(tokenizer).tokenizer.get_vocab_size(), end_id + 1)
    token_type = "uint16" if ids_used <= 1 << 16 else "uint32"
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or fresh_folder(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        encoder = word_ids(tokenizer)
        files, place = pa.fs.FileSystem.from_uri(folder)
        files.create_dir(place, recursive=True)
        outs, total, nulls, rows = None, 0, 0, 0
        for batch in batches:
            for piece in pieces(batch):
                if outs is None:
                    outs = [files.open_output_stream(f"{place}/{name}.{kind}") for kind in ("tokens", "offsets", "documents")]
                ids, ends = encoder.encode(piece.column(1), end_id)
                ends = ends + total
                outs[0].write(ids.astype(np.dtype(token_type).newbyteorder("<")).tobytes())
                outs[1].write(ends.astype("<u8").tobytes())
                outs[2].write(piece.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                total, nulls, rows = int(ends[-1]), nulls + piece.column(0).null_count, rows + piece.num_rows
        if outs is not None:
            for out in outs:
                out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "part": [task.partitionId()], "rows": [rows], "tokens": [total], "nulls": [nulls]})

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    )
    # One row per file.
    parts = cut(ordered.mapInArrow(run, "name string, part long, rows long, tokens long, nulls long")).orderBy("part").collect()
    bases = accumulate((p.tokens for p in parts), initial=0)
    index = {"token_type": token_type, "offset_type": "uint64", "end_id": end_id,
             "parts": [{"name": p.name, "rows": p.rows, "tokens": p.tokens, "nulls": p.nulls, "base": b} for p, b in zip(parts, bases)]}
    write_json(folder, "index.json", index)
    return folder


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32[, ids]`` of every document.

    ``start`` counts the ids of all documents before it, ``n_tokens`` includes
    the end id, ``ids_crc32`` is the unsigned crc32 of the document's ids as
    little-endian unsigned 32-bit integers.
    """
    index = read_json(folder, "index.json")
    parts, stored = index["parts"], np.dtype(index["token_type"]).newbyteorder("<").str
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    if not parts:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame([(p["name"], p["base"], p["nulls"]) for p in parts], "name string, base long, nulls long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                tokens, ends, documents = (mapped(folder, f"{part['name']}.{kind}", dtype)
                                           for kind, dtype in (("tokens", stored), ("offsets", "<u8"), ("documents", "<i8")))
                ends = ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                for at in range(0, len(ends), READ_ROWS):
                    a, b, ids = starts[at:at + READ_ROWS], ends[at:at + READ_ROWS], documents[at:at + READ_ROWS]
                    columns = [pa.array(ids, mask=np.arange(at, at + len(ids)) < part["nulls"]), pa.array(a + part["base"]), pa.array(b - a),
                               pa.array([zlib.crc32(tokens[i:j].astype("<u4")) for i, j in zip(a, b)], type=pa.int64())]
                    if with_ids:
                        flat = pa.array(tokens[a[0]:b[-1]].astype(np.int64))
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(a, b[-1]) - a[0], type=pa.int32()), flat))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])

    return table.repartition(len(parts)).mapInArrow(run, schema)
