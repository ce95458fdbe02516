"""Recognition payloads and uploaded originals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane import fixed
from ledgerlane.functions.text import blank
from ledgerlane.schemas import OCR_PAYLOAD


def _sound(detection):
    """A detection of the agreed shape: text, confidence in 0..1, two or more
    complete points if there is a box."""
    text, box = detection["text_prediction"], detection["bounding_box"]
    score = text["confidence"]
    return (
        text["text"].isNotNull()
        & (score.isNull() | score.between(0.0, 1.0))
        & (box.isNull() | (F.coalesce(F.size(box["points"]) >= 2, F.lit(False))
           & F.forall(box["points"], lambda p: p["x"].isNotNull() & p["y"].isNotNull())))
    )


def read_ocr_payloads(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Detections of every payload, and the ids of payloads of another shape.

    Input: document_id and a JSON payload.
    """
    parsed = df.withColumn("p", F.from_json(payload, OCR_PAYLOAD))
    sound = F.col("p.data").isNotNull() & F.forall(
        "p.data", lambda page: F.coalesce(F.forall(page["text_detections"], _sound), F.lit(False))
    )
    parsed = parsed.withColumn("sound", F.coalesce(sound, F.lit(False)))
    detections = (
        parsed.filter("sound")
        .select("document_id", F.posexplode("p.data").alias("page", "x"))
        .select("document_id", "page", F.posexplode("x.text_detections").alias("ord", "d"))
        .select(
            "document_id", "page", "ord",
            F.col("d.text_prediction.text").alias("text"),
            F.col("d.text_prediction.confidence").alias("confidence"),
            F.col("d.bounding_box.points").alias("points"),
        )
    )
    return detections, parsed.filter("NOT sound").select("document_id")


def page_confidence(detections: DataFrame) -> DataFrame:
    """Mean of the present confidences of non-blank detections, per document."""
    return (
        detections.filter(~blank(F.col("text")))
        .groupBy("document_id")
        .agg(F.avg("confidence").alias("confidence"))
    )


#: leading bytes of the accepted types, in hex
SIGNATURES = {
    "application/pdf": "^255044462D",
    "image/jpeg": "^FFD8FF",
    "image/png": "^89504E470D0A1A0A",
    "image/webp": "^52494646.{8}57454250",
}


def signature_ok(content, content_type):
    """Do the first bytes belong to the declared type?"""
    head = F.hex(F.substring(content, 1, 12))
    verdict = F.lit(False)
    for kind, pattern in SIGNATURES.items():
        verdict = F.when(content_type == kind, head.rlike(pattern)).otherwise(verdict)
    return verdict


def check_originals(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Uploaded originals against what was declared for them.

    ``files``: document_id, length, content.  ``manifest``: document_id,
    content_type, byte_size.  Gives document_id, ok, reason.
    """
    joined = manifest.join(files, "document_id", "left")
    reason = (
        F.when(F.col("length").isNull() | (F.col("length") == 0), "empty")
        .when(F.col("length") > fixed.MAX_FILE_BYTES, "too large")
        .when(F.col("length") != F.col("byte_size"), "size differs")
        .when(~F.col("content_type").isin(fixed.FILE_TYPES), "type not accepted")
        .when(~signature_ok(F.col("content"), F.col("content_type")), "content is another type")
    )
    return joined.select("document_id", reason.isNull().alias("ok"), reason.alias("reason"))


def scan_originals(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """``check_originals`` over a folder whose files are named by document.

    Sizes come from the listing alone.  Only files of an accepted size are
    opened (the source takes the filter), and twelve bytes leave the scan.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = F.regexp_extract("path", r"([^/]+?)(?:\.[A-Za-z]+)?$", 1).alias("document_id")
    sizes = scan.select(named, "length")
    heads = scan.filter(F.col("length") <= fixed.MAX_FILE_BYTES).select(named, F.substring("content", 1, 12).alias("content"))
    return check_originals(sizes.join(heads, "document_id", "left"), manifest)
