"""The listing and the ranged reader of originals, over real folders."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlane import fixed
from ledgerlane.sources import originals

PNG = bytes.fromhex("89504E470D0A1A0A")


def manifest(spark, rows):
    return spark.createDataFrame(rows, "document_id string, content_type string, byte_size long")


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "u1" / "old").mkdir(parents=True)
    (tmp_path / "u2").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "u1" / "b.jpg").write_bytes(b"<script>")
    (tmp_path / "u1" / "old" / "c.png").write_bytes(PNG)
    (tmp_path / "u2" / "d").write_bytes(b"")
    (tmp_path / "u2" / "e.webp").write_bytes(b"RIFF\x01\x02\x03\x04WEBPVP8 ")
    (tmp_path / "u2" / "f.gif").write_bytes(b"GIF89a")
    (tmp_path / "u2" / "stranger.pdf").write_bytes(b"%PDF-1.7")
    with open(tmp_path / "u2" / "g.pdf", "wb") as file:
        file.truncate(fixed.MAX_FILE_BYTES + 1)
    (tmp_path / "u1" / "h.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "u2" / "h.pdf").write_bytes(b"longer than the first")
    rows = [("a", "application/pdf", 8), ("b", "image/jpeg", 8), ("c", "image/png", 8), ("d", "image/png", 0), ("e", "image/webp", 16),
            ("f", "image/gif", 6), ("g", "application/pdf", fixed.MAX_FILE_BYTES + 1), ("h", "application/pdf", 8), ("missing", "image/png", 5), ("c", "image/png", 9)]
    for depth in (0, 1, 3):
        listed = {r.path: r.length for r in originals.list_files(spark, str(tmp_path), depth).collect()}
        assert len(listed) == 10 and listed[str(tmp_path / "u2" / "g.pdf")] == fixed.MAX_FILE_BYTES + 1
        got = sorted((r.document_id, r.reason) for r in originals.scan_originals(spark, str(tmp_path), manifest(spark, rows), depth).fillna("").collect())
        assert got == [("a", ""), ("b", "content is another type"), ("c", ""), ("c", "size differs"), ("d", "empty"), ("e", ""),
                       ("f", "type not accepted"), ("g", "too large"), ("h", ""), ("missing", "empty")]


def test_only_heads_of_declared_files_are_read(spark, tmp_path, monkeypatch):
    """Files of 3 MB of which all but twelve bytes are holes, and one that must not be opened."""
    for k in range(20):
        with open(tmp_path / f"{k}.pdf", "wb") as file:
            file.write(b"%PDF-1.7" + bytes(4))
            file.truncate(3 << 20)
    (tmp_path / "locked.pdf").write_bytes(b"x" * 50)
    files = originals.list_files(spark, str(tmp_path))
    heads = originals.read_heads(files.filter("length > 100"), str(tmp_path)).collect()
    assert len(heads) == 20 and {bytes(r.content) for r in heads} == {b"%PDF-1.7" + bytes(4)}
    gone = spark.createDataFrame([(str(tmp_path / "gone.pdf"),)], "path string")
    assert originals.read_heads(gone, str(tmp_path)).first().content is None
    (tmp_path / "locked.pdf").chmod(0)
    rows = [("0", "application/pdf", 3 << 20), ("locked", "application/pdf", 51)]
    got = {r.document_id: r.reason for r in originals.scan_originals(spark, str(tmp_path), manifest(spark, rows)).collect()}
    assert got == {"0": None, "locked": "size differs"}


def test_empty_and_missing_folders(spark, tmp_path):
    assert originals.list_files(spark, str(tmp_path)).collect() == []
    got = originals.scan_originals(spark, str(tmp_path), manifest(spark, [("a", "image/png", 3), (None, None, None)])).collect()
    assert sorted(((r.document_id, r.ok, r.reason) for r in got), key=str) == [("a", False, "empty"), (None, False, "empty")]
    with pytest.raises(Exception):
        originals.list_files(spark, str(tmp_path / "none")).collect()


def test_written_files_are_listed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(originals, "LISTED", 7)
    files = spark.range(50).select(F.concat(F.col("id") % 3, F.lit("/"), "id").alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    folder = str(tmp_path / "out")
    assert originals.write_files(files, folder) == 50 and originals.write_files(files, folder) == 50
    assert originals.list_files(spark, folder).agg(F.count("*"), F.sum("length")).first()[:] == (50, 90)
    batches = list(originals._Listing(folder, 1).read(originals.Folder(folder, True)))
    assert max(b.num_rows for b in batches) == 7 and pa.Table.from_batches(batches).num_rows == 50
