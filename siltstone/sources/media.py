"""Media types and families of source references, converters, sidecar files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OFFICE = "application/vnd.openxmlformats-officedocument."
# Media types by extension.
EXTENSIONS = {
    "txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "rst": "text/plain", "html": "text/html",
    "htm": "text/html", "pdf": "application/pdf", "csv": "text/csv", "json": "application/json", "jsonl": "application/jsonl",
    "docx": _OFFICE + "wordprocessingml.document", "pptx": _OFFICE + "presentationml.presentation",
    "xlsx": _OFFICE + "spreadsheetml.sheet", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "webp": "image/webp", "gif": "image/gif", "mp3": "audio/mpeg", "wav": "audio/wav", "m4a": "audio/mp4", "aac": "audio/aac",
    "flac": "audio/flac", "ogg": "audio/ogg", "mp4": "video/mp4", "mov": "video/quicktime", "webm": "video/webm",
    "mkv": "video/x-matroska", "avi": "video/x-msvideo",
}
SAME = {
    "text/x-markdown": "text/markdown", "application/x-ndjson": "application/jsonl", "application/msword": EXTENSIONS["docx"],
    "application/vnd.ms-powerpoint": EXTENSIONS["pptx"], "application/vnd.ms-excel": EXTENSIONS["xlsx"],
}
UNKNOWN = "application/octet-stream"
# What converts each media type, and each family otherwise.
CONVERTERS = {
    "text/html": "html", "text/csv": "csv", "application/json": "json", "application/jsonl": "json", "application/pdf": "pdf",
    EXTENSIONS["docx"]: "docx", EXTENSIONS["pptx"]: "pptx", EXTENSIONS["xlsx"]: "xlsx",
}
FAMILY_CONVERTERS = {"text": "text", "image": "image", "audio": "audio", "video": "video"}
SIDECARS = (".transcript.vtt", ".transcript.srt", ".transcript.txt", ".vtt", ".srt", ".txt")


def choose(c: Column, table: dict[str, str], other: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(other)


def normalize_media_type(c: Column) -> Column:
    low = F.lower(F.trim(F.get(F.split(F.coalesce(c, F.lit("")), ";"), 0)))
    return F.when(F.contains(low, F.lit("pdf")), F.lit("application/pdf")).otherwise(choose(low, SAME, low))


def detect_media_type(ref: Column, content_type: Column) -> Column:
    """The declared type unless it says nothing, else by extension (of a URL's path), else unknown."""
    said = normalize_media_type(content_type)
    path = F.regexp_replace(F.regexp_replace(ref, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when((said != "") & (said != UNKNOWN), said).otherwise(choose(extension, EXTENSIONS, F.lit(UNKNOWN)))


def media_family(media_type: Column) -> Column:
    """Family of a normalised media type (a column of its own: the expression names it many times)."""
    m = media_type
    return (
        F.when(m.startswith("text/"), "text").when(m.startswith("image/"), "image").when(m.startswith("audio/"), "audio").when(m.startswith("video/"), "video")
        .when(m.isin("application/json", "application/jsonl"), "structured")
        .when(m.isin("application/pdf", EXTENSIONS["docx"], EXTENSIONS["pptx"], EXTENSIONS["xlsx"]), "document")
        .otherwise("unknown")
    )


def converter(media_type: Column) -> Column:
    """Name of the converter of a normalised media type; null where there is none."""
    m = media_type
    return choose(m, CONVERTERS, choose(media_family(m), FAMILY_CONVERTERS, F.lit(None).cast("string")))


def sidecar(files: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, sidecar): the first existing file with a file's stem and one of the sidecar suffixes.

    Both sides grow with the folders, so they are merged and never broadcast, however small their stored columns look.
    """
    names = F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(s).alias("suffix")) for i, s in enumerate(SIDECARS))))
    stems = files.select("path", F.regexp_replace("path", r"\.[^./]+$", "").alias("stem"), names.alias("s"))
    hits = stems.select("path", "s.rank", F.concat("stem", "s.suffix").alias("sidecar")).join(listing.select(F.col("path").alias("sidecar")).hint("merge"), "sidecar")
    w = Window.partitionBy("path").orderBy("rank")
    return hits.where("path != sidecar").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("path", "sidecar")
