"""Converters of source bodies to units: text, HTML with its tables, CSV, JSON, office documents, transcripts.

A converter takes (reference, bytes) and returns (unit type, text) pairs in order; ``convert`` runs the one that
each file's media type asks for over a ``binaryFile`` scan, in Arrow batches without a shuffle.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import map_rows
from ..functions import text as T
from ..shipping import ship
from . import media
from .units import unit_id

Unit = tuple[str, str]
SKIPPED = {"script", "style", "noscript", "svg"}
BREAKS = {"p", "br", "li", "h1", "h2", "h3", "h4", "tr"}
CONTEXT_LIMIT = 1024


class _Page(HTMLParser):
    """Text of a page, with simple tables rewritten as labelled rows in their place."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.units: list[Unit] = []
        self.warnings: list[str] = []
        self.skip = 0
        self.tables: list[dict] = []

    def put(self, text: str) -> None:
        (self.tables[-1]["prose"] if self.tables else self.out).append(text)

    def handle_starttag(self, tag, attrs) -> None:
        if tag in SKIPPED:
            self.skip += 1
        attrs = dict(attrs)
        if tag == "table":
            if self.tables:
                self.tables[-1]["odd"] = "nested table"
            self.tables.append({"rows": [], "caption": "", "heading": self.heading() if not self.tables else "", "prose": [], "odd": "", "cell": None})
        elif self.tables:
            t = self.tables[-1]
            if tag == "tr":
                t["rows"].append([])
            elif tag in ("td", "th"):
                if attrs.get("rowspan", "1") not in ("", "1") or "headers" in attrs:
                    t["odd"] = "rowspan or headers"
                if not t["rows"]:
                    t["rows"].append([])
                t["cell"] = [tag, "", int(attrs.get("colspan") or 1) if (attrs.get("colspan") or "1").isdigit() else 1]
            elif tag == "caption":
                t["cell"] = ["caption", "", 1]
        if tag in BREAKS:
            self.put("\n")

    def heading(self) -> str:
        return self.last_heading if hasattr(self, "last_heading") else ""

    def handle_endtag(self, tag) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        if self.tables:
            t = self.tables[-1]
            if tag in ("td", "th") and t["cell"]:
                t["rows"][-1].append(tuple(t["cell"]))
                t["cell"] = None
            elif tag == "caption" and t["cell"]:
                t["caption"], t["cell"] = clean(t["cell"][1]), None
            elif tag == "table":
                self.close_table(self.tables.pop())
        if tag in BREAKS - {"br"}:
            self.put("\n")

    def handle_data(self, data) -> None:
        if self.skip:
            return
        if self.tables and self.tables[-1]["cell"]:
            self.tables[-1]["cell"][1] += data
        self.put(data + " ")
        if not self.tables and self.lasttag in ("h1", "h2", "h3", "h4") and data.strip():
            self.last_heading = clean(data)

    def close_table(self, t: dict) -> None:
        head, rows, group = None, [], ""
        for cells in t["rows"]:
            values = [clean(c[1]) for c in cells]
            if cells and all(c[0] == "th" for c in cells) and len(cells) > 1:
                if head is not None or len(set(values)) < len(values) or any(c[2] > 1 for c in cells):
                    t["odd"] = t["odd"] or "header tiers or doubles"
                head = values
            elif len(cells) == 1 and len(t["rows"]) > 1 and cells[0][2] > 1:
                group = values[0]
            elif len(cells) == 2 and cells[0][0] == "th":
                rows.append((group, [(values[0], values[1])]))
            elif head and len(values) == len(head):
                rows.append((group, [*zip(head, values)]))
            elif values:
                t["odd"] = t["odd"] or "unlabelled cells"
        context = [x for x in (t["heading"], t["caption"]) if x]
        if len("; ".join(context)) > CONTEXT_LIMIT:
            t["odd"] = t["odd"] or "long context"
        if t["odd"] or not rows:
            if t["odd"]:
                self.warnings.append(f"table kept as prose: {t['odd']}")
            self.put("".join(t["prose"]))
            return
        for group, pairs in rows:
            parts = [*context[-1:], *([group] if group else []), *(f"{k}: {v}" for k, v in pairs if v)]
            line = "; ".join(parts)
            self.units.append(("table_row", line))
            self.put("\n" + line + "\n")


def clean(text: str) -> str:
    return " ".join(text.split())


def html(ref: str, body: bytes) -> list[Unit]:
    page = _Page()
    page.feed(body.decode("utf-8", "replace"))
    page.close()
    for t in page.tables:  # never closed
        page.out += t["prose"]
    return [("page", tidy("".join(page.out))), *page.units]


def html_warnings(body: bytes) -> list[str]:
    page = _Page()
    page.feed(body.decode("utf-8", "replace"))
    return page.warnings


def tidy(text: str) -> str:
    text = re.sub(r"[ \t\f\v]+", " ", text)
    text = re.sub(r" ?\n ?", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def plain(ref: str, body: bytes) -> list[Unit]:
    return [("text", body.decode("utf-8", "replace").strip())]


def table_rows(header: list[str], rows: list[list[str]]) -> list[Unit]:
    out = []
    for row in rows:
        names = [*header, *(f"column_{i + 1}" for i in range(len(header), len(row)))]
        out.append(("table_row", "; ".join(f"{k}: {v}" for k, v in zip(names, row))))
    return out


def comma_separated(ref: str, body: bytes) -> list[Unit]:
    rows = [r for r in csv.reader(io.StringIO(body.decode("utf-8-sig", "replace"))) if r]
    if not rows:
        return []
    units = table_rows(rows[0], rows[1:])
    return [("table", "\n".join(u[1] for u in units)), *units]


def json_text(ref: str, body: bytes) -> list[Unit]:
    text = body.decode("utf-8", "replace")
    try:
        if ref.endswith(".jsonl"):
            data = [json.loads(line) for line in text.splitlines() if line.strip()]
        else:
            data = json.loads(text)
    except ValueError:
        return [("text", text.strip())]
    return [("json", json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False))]


def _texts(xml: bytes) -> list[str]:
    return [e.text for e in ElementTree.fromstring(xml).iter() if e.tag.rpartition("}")[2] == "t" and e.text]


def _numbered(names: list[str], pattern: str) -> list[str]:
    hits = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(hits)]


def docx(ref: str, body: bytes) -> list[Unit]:
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ["".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in root.iter() if p.tag.endswith("}p")]
    return [("document", "\n".join(x for x in lines if x.strip()))]


def pptx(ref: str, body: bytes) -> list[Unit]:
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        return [("slide", "\n".join(_texts(z.read(n)))) for n in _numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml")]


def xlsx(ref: str, body: bytes) -> list[Unit]:
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in root if si.tag.endswith("}si")]
        out = []
        for n in _numbered(names, r"xl/worksheets/sheet(\d+)\.xml"):
            rows = []
            for row in (e for e in ElementTree.fromstring(z.read(n)).iter() if e.tag.endswith("}row")):
                cells = []
                for c in (e for e in row if e.tag.endswith("}c")):
                    v = next((e.text or "" for e in c.iter() if e.tag.endswith(("}v", "}t"))), "")
                    cells.append(shared[int(v)] if c.get("t") == "s" and v.isdigit() and int(v) < len(shared) else v)
                rows.append("\t".join(cells))
            out.append(("sheet", "\n".join(rows)))
        return out


def pdf(ref: str, body: bytes) -> list[Unit]:
    from pypdf import PdfReader  # optional; without it the file becomes a row with this error

    return [("page", t) for p in PdfReader(io.BytesIO(body)).pages if (t := (p.extract_text() or "").strip())]


TIMES = re.compile(r"(?:(\d+):)?(\d\d):(\d\d)[,.](\d{3})\s+-->\s+(?:(\d+):)?(\d\d):(\d\d)[,.](\d{3})")

CONVERTERS: dict[str, Callable[[str, bytes], list[Unit]]] = {
    "text": plain, "html": html, "csv": comma_separated, "json": json_text, "docx": docx, "pptx": pptx, "xlsx": xlsx, "pdf": pdf,
}


def _converting(converters: dict[str, Callable[[str, bytes], list[Unit]]]):
    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for ref, body, how in rows:
            f = converters.get(how)
            try:
                units, error = (f(ref, body) if f else []), None if f else "no converter"
            except Exception as e:  # a damaged file is a row with its error, not the end of the scan
                units, error = [], f"{type(e).__name__}: {e}"[:200]
            yield from [(ref, how, i, kind, text, None) for i, (kind, text) in enumerate(units, 1)] or [(ref, how, 0, None, None, error)]

    return run


def convert(files: DataFrame, converters: dict[str, Callable[[str, bytes], list[Unit]]] | None = None) -> DataFrame:
    """Units of files (path, content, media_type), with their ids; a file without units is one row with its error."""
    rows = files.select("path", "content", media.converter(F.col("media_type")).alias("converter"))
    units = map_rows(
        rows, _converting(converters or CONVERTERS), "source_ref string, converter string, unit_index int, unit_type string, text string, error string"
    )
    return units.withColumn("unit_id", unit_id(F.col("source_ref"), F.col("unit_type"), F.col("unit_index"), F.col("text")))


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files below a path with content, hash and media type."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select(
        "path", "length", "content", F.sha2("content", 256).alias("artifact_hash"), media.detect_media_type(F.col("path"), F.lit("")).alias("media_type")
    )


def sidecar_units(files: DataFrame) -> DataFrame:
    """Units of images, recordings and films whose text lies beside them: (source_ref, sidecar, unit_type, text).

    ``files`` (path, content, media_type) holds the sidecars too; what needs recognition or transcription has no unit.
    """
    family = media.media_family(F.col("media_type"))
    found = media.sidecar(files.where(family.isin("image", "audio", "video")), files)
    text = T.strip(F.decode("content", "utf-8"))
    body = files.select(F.col("path").alias("sidecar"), text.alias("text"))
    return found.join(body, "sidecar").where("text != ''").select(F.col("path").alias("source_ref"), "sidecar", F.lit("sidecar").alias("unit_type"), "text")


def extract_files(files: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Units of whole files (path, content, media_type): recordings, films and images by the text beside them, others by their converter.

    (source_ref, converter, unit_index, unit_type, text, start, end, sidecar, artifact_hash, error). The timed cues of a transcript are a unit
    each, a transcript without times is one, as is the text of an image. The hash covers a file and its sidecar, which ``listing`` (path,
    content; by default the files themselves) holds. A sidecar without text is a row with that error.
    """
    listing = files if listing is None else listing
    family = media.media_family(F.col("media_type"))
    seen = files.where(family.isin("image", "audio", "video"))
    beside = media.sidecar(seen.select("path"), listing.select("path")).join(listing.select(F.col("path").alias("sidecar"), F.col("content").alias("beside")), "sidecar")
    rows = seen.withColumn("family", family).join(beside, "path").withColumn("text", F.decode("beside", "utf-8"))
    timed = F.when(F.col("family") != "image", cues(F.col("text")))
    whole = F.when(T.strip(F.col("text")) == "", F.array().cast("array<struct<start:double,end:double,text:string>>")).otherwise(
        F.array(F.struct(F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), T.strip(F.col("text")).alias("text")))
    )
    units = F.when(F.size(F.coalesce(timed, F.array().cast("array<struct<start:double,end:double,text:string>>"))) > 0, timed).otherwise(whole)
    kind = F.when(F.col("family") == "image", "image_text").otherwise(F.concat("family", F.lit("_transcript_segment")))
    name = F.when(F.col("family") == "image", "image-ocr-sidecar").otherwise(F.concat("family", F.lit("-transcript-sidecar")))
    found = rows.select(
        F.col("path").alias("source_ref"), name.alias("converter"), kind.alias("kind"), "sidecar", F.sha2(F.concat("content", "beside"), 256).alias("artifact_hash"), F.posexplode_outer(units).alias("at", "u"),
    ).select(
        "source_ref", "converter", F.coalesce(F.col("at") + 1, F.lit(0)).alias("unit_index"), F.when(F.col("u").isNotNull(), F.col("kind")).alias("unit_type"), "u.text", "u.start", "u.end",
        "sidecar", "artifact_hash", F.when(F.col("u").isNull(), F.lit("transcript_sidecar_empty")).alias("error"),
    )
    rest = files.join(beside.select("path"), "path", "left_anti")
    hashes = rest.select(F.col("path").alias("source_ref"), F.sha2("content", 256).alias("artifact_hash"))
    none = {c: F.lit(None).cast(k) for c, k in (("start", "double"), ("end", "double"), ("sidecar", "string"))}
    return found.unionByName(convert(rest).join(hashes, "source_ref").withColumns(none).select(*found.columns))


def html_text(html_col: Column) -> Column:
    """Text of a page by regular expressions only: a plain stand-in for the exact converter, without tables."""
    out = F.regexp_replace(html_col, r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?i)</?(p|br|li|h[1-4]|tr)\b[^>]*>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, " ?\n ?", "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def links(html_col: Column) -> Column:
    """Absolute links of a page with their text: array of struct(url, title)."""
    anchor = r'(?is)<a\s[^>]*?href="(https?://[^"]+)"[^>]*>(.*?)</a>'
    found = F.regexp_extract_all(html_col, F.lit(anchor), F.lit(0))
    title = lambda m: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(m, anchor, 2), "<[^>]*>", " "), r"\s+", " "))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, anchor, 1).alias("url"), title(m).alias("title")))


# --- transcripts -----------------------------------------------------------------------------------------------

_STAMP = r"(?:(\d+):)?(\d\d):(\d\d)[,.](\d{3})"
CUE = rf"{_STAMP}\s+-->\s+{_STAMP}"


def _seconds(line: Column, first: int) -> Column:
    g = lambda i: F.coalesce(F.regexp_extract(line, CUE, first + i).try_cast("double"), F.lit(0.0))
    return g(0) * 3600 + g(1) * 60 + g(2) + g(3) / 1000


def cues(text: Column) -> Column:
    """Timed segments of an SRT or VTT transcript: array of struct(start, end, text)."""
    blocks = F.split(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n"), r"\n\s*\n")
    one = lambda b: F.struct(
        _seconds(b, 1).alias("start"), _seconds(b, 5).alias("end"),
        F.trim(F.regexp_replace(F.regexp_replace(b, rf"(?s)^.*?{CUE}[^\n]*\n?", ""), r"\s*\n\s*", " ")).alias("text"),
    )
    return F.filter(F.transform(F.filter(blocks, lambda b: b.rlike(CUE)), one), lambda c: c["text"] != "")


def stamp(seconds: Column) -> Column:
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def to_vtt(segments: DataFrame, key: str) -> DataFrame:
    """(key, vtt): segments (start, end, text) of each key as one transcript, blank ones dropped."""
    line = F.concat(stamp(F.col("start")), F.lit(" --> "), stamp(F.col("end")), F.lit("\n"), F.trim("text"))
    kept = segments.where(F.trim("text") != "").withColumn("line", line)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "line"))), lambda x: x["line"])
    return kept.groupBy(key).agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(lines, "\n\n")).alias("vtt"))


def words_in_segments(words: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Words (start, end, word) that lie inside a segment (segment, start, end) of the same key."""
    w = words.select(key, F.col("start").alias("ws"), F.col("end").alias("we"), "word")
    j = segments.join(w, key).where((F.col("ws") >= F.col("start")) & (F.col("we") <= F.col("end")))
    return j.groupBy(key, "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ws", "word"))), lambda x: x["word"]), " ").alias("words"))


def speakers(segments: DataFrame, turns: DataFrame, key: str) -> DataFrame:
    """(key, segment, speaker): whose turn overlaps a segment most, the first on ties, nobody without overlap."""
    from pyspark.sql import Window

    t = turns.select(key, F.col("start").alias("ts"), F.col("end").alias("te"), "speaker")
    overlap = F.least("end", "te") - F.greatest("start", "ts")
    hits = segments.join(t, key).withColumn("overlap", overlap).where("overlap > 0")
    w = Window.partitionBy(key, "segment").orderBy(F.desc("overlap"), "ts", "speaker")
    best = hits.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(key, "segment", "speaker")
    return segments.select(key, "segment").join(best, [key, "segment"], "left").select(key, "segment", F.coalesce("speaker", F.lit("")).alias("speaker"))


ship(__name__)
