"""Counted 64-bit keys: compact blocks, merging, and files of arrays."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame

_CODEC = "zstd"


def _squeeze(numbers: np.ndarray) -> bytes:
    """Bytes of equal weight stand together, which compresses small numbers."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T)
    return pa.compress(planes.tobytes(), codec=_CODEC, asbytes=True)


def _expand(data: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec=_CODEC), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).reshape(n)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A block of ascending keys with their counts."""
    steps = _squeeze(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))
    return struct.pack("<QQ", len(keys), len(steps)) + steps + _squeeze(counts.astype("<u8"))


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = struct.unpack_from("<QQ", block)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    return np.cumsum(_expand(block[16:16 + size], n, "<u8"), dtype=np.uint64), _expand(block[16 + size:], n, "<u8")


def merged(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys of all blocks, with the sums of their counts."""
    keys, counts = (np.concatenate([b[k] for b in blocks]) for k in (0, 1))
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def blocks_by_bucket(keys: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
    """One row per bucket that has keys; bucket ``b`` holds ``edges[b] <= key < edges[b + 1]``."""
    places = np.searchsorted(keys, edges[1:])
    places = np.concatenate([[0], places[:-1], [len(keys)]])
    rows = [(b, pack(keys[s:e], counts[s:e])) for b, (s, e) in enumerate(zip(places[:-1], places[1:])) if e > s]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.int64()), pa.array([r[1] for r in rows], type=pa.binary())],
                                      names=["bucket", "block"])


def by_bucket(blocks: DataFrame, finish: Callable[[int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, buckets: int) -> DataFrame:
    """Bring the blocks of each bucket together, merge them, and call ``finish``.

    A bucket is a range of keys of bounded size; equal keys were added up
    before, so a key that is a third of the corpus is one entry per block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size = None, [], 0
        for batch in batches:
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != current:
                    if held:
                        yield from finish(current, *merged(held))
                    current, held, size = bucket, [], 0
                held.append(unpack(block))
                size += len(held[-1][0])
                if len(held) > 1 and size > 2 * len(held[0][0]) + 4_000_000:
                    held = [merged(held)]
                    size = len(held[0][0])
        if held:
            yield from finish(current, *merged(held))

    return blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def write_arrays(folder: str, name: str, **arrays: np.ndarray) -> None:
    files, place = pa.fs.FileSystem.from_uri(folder)
    files.create_dir(place, recursive=True)
    for kind, array in arrays.items():
        with files.open_output_stream(f"{place}/{name}.{kind}") as out:
            out.write(np.ascontiguousarray(array).tobytes())


def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where the folder is a path that the
    worker has, read elsewhere."""
    local = re.match(r"(?:file:(?://)?)?(/.*)", folder)
    if local:
        with pa.memory_map(f"{local[1]}/{name}") as file:
            return np.frombuffer(file.read_buffer(), dtype=kind)
    files, place = pa.fs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{place}/{name}") as file:
        return np.frombuffer(file.read_buffer(), dtype=kind)


# Larger counts, and this one, stand at the end of a file of counts.
LARGE = 2**32 - 1


def with_large(counts: np.ndarray) -> np.ndarray:
    """Counts as a file holds them: 32 bits each, then place and value of those
    that need more, and how many these are (64 bits each)."""
    large = np.flatnonzero(counts >= LARGE)
    tail = np.concatenate([np.asarray(part).astype("<u8") for part in (large, counts[large], [len(large)])])
    return np.concatenate([np.minimum(counts, LARGE).astype("<u4"), tail.view("<u4")])


class Counts:
    """The counts of a file written from ``with_large``, as 64-bit numbers."""

    def __init__(self, words: np.ndarray):
        n = int(words[-2:].view("<u8")[0])
        stop = len(words) - 2 - 4 * n
        self.low, tail = words[:stop], words[stop:-2].view("<u8")
        self.places, self.values = tail[:n], tail[n:]

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        found = self.low[at].astype(np.int64)
        large = np.flatnonzero(found == LARGE)
        if len(large):
            found[large] = self.values[np.searchsorted(self.places, at[large])]
        return found

    def all(self) -> np.ndarray:
        found = self.low.astype(np.int64)
        found[self.places.astype(np.int64)] = self.values
        return found


def mapped_counts(folder: str, name: str) -> Counts:
    return Counts(mapped(folder, name, "<u4"))


def write_json(folder: str, name: str, content: dict) -> None:
    files, place = pa.fs.FileSystem.from_uri(folder)
    files.create_dir(place, recursive=True)
    with files.open_output_stream(f"{place}/{name}") as out:
        out.write(json.dumps(content).encode())


def read_json(folder: str, name: str) -> dict:
    files, place = pa.fs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{place}/{name}") as file:
        return json.loads(file.read())
