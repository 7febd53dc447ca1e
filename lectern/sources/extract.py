"""Text extraction from bytes: a registry of formats, one Arrow task for all of them.

Each extractor takes bytes and options and returns (text, metadata); a failure
is an error row, never a failed task. Page and image recognition are pluggable.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from html.entities import html5
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import clean_text
from lectern.options import CleaningOptions
from lectern.sources import pdf, xls
from lectern.sources.routing import content_key, extension, is_bin

Extractor = Callable[[bytes, CleaningOptions], tuple[str, dict]]
REGISTRY: dict[str, Extractor] = {}
#: Extensions that a zip's members may have.
ZIP_MEMBERS = (".pdf", ".docx", ".pptx", ".txt", ".eml", ".html", ".csv", ".json", ".xlsx", ".xls")
SCHEMA = "text string, metadata map<string,string>, success boolean, error string, processing_time double"


def register(*extensions: str) -> Callable[[Extractor], Extractor]:
    def put(f: Extractor) -> Extractor:
        REGISTRY.update(dict.fromkeys(extensions, f))
        return f

    return put


def decoded(data: bytes, codes: tuple[str, ...]) -> tuple[str, str]:
    """Text and code of the first code that fits."""
    for code in codes:
        try:
            return data.decode(code), code
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "ignore"), "utf-8-ignore"


@register(".txt")
def text_file(data: bytes, options: CleaningOptions) -> tuple[str, dict]:
    text, code = decoded(data, ("utf-8", "utf-16", "latin-1", "cp1252"))
    return text.strip(), {"encoding": code, "extraction_method": "text"}


class _Page(HTMLParser):
    """Texts outside dropped elements, title and named metadata."""

    def __init__(self, dropped: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.dropped, self.depth, self.texts = dropped, 0, []
        self.title, self.in_title, self.meta = [], False, {}

    def handle_starttag(self, tag, attrs):
        if tag in self.dropped:
            self.depth += 1
        self.in_title = tag == "title"
        if tag == "meta":
            a = dict(attrs)
            if (a.get("name") or "").lower() in ("description", "keywords"):
                self.meta[a["name"].lower()] = a.get("content") or ""

    def handle_endtag(self, tag):
        if tag in self.dropped and self.depth:
            self.depth -= 1
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.depth:
            return
        if self.in_title:
            self.title.append(data)
        self.texts.append(data)


_REFERENCE = re.compile(r"&(?:(#[0-9]+;|#[xX][0-9a-fA-F]+;)|([A-Za-z][A-Za-z0-9]*;))?")


def _closed_only(html: str) -> str:
    """Every ampersand that begins no whole character reference, semicolon included, as one that means itself."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] or m[2] in html5 else "&amp;" + m[0][1:], html)


def page_text(html: str, dropped: frozenset[str], mark: str, open_references: bool = True) -> tuple[str, dict]:
    """Stripped texts joined by ``mark``; title, description and keywords."""
    page = _Page(dropped)
    page.feed(html if open_references else _closed_only(html))
    page.close()
    texts = [t for x in page.texts if (t := x.strip())]
    return mark.join(texts), {"title": "".join(page.title).strip()} | page.meta


#: Fixed elements without readable text, in files and on fetched pages.
FILE_DROPPED = frozenset(("script", "style"))
WEB_DROPPED = FILE_DROPPED | {"nav", "footer", "header"}


@register(".html")
def html_file(data: bytes, options: CleaningOptions) -> tuple[str, dict]:
    text, meta = page_text(data.decode("utf-8", "replace"), FILE_DROPPED, "\n" if options.preserve_formatting else " ", options.open_references)
    return text, meta | {"extraction_method": "html"}


def rendered(rows: list[list[str]]) -> str:
    """Right-aligned columns under their names."""
    width = max(map(len, rows), default=0)
    rows = [r + [""] * (width - len(r)) for r in rows]
    sizes = [max(len(r[k]) for r in rows) for k in range(width)]
    return "\n".join(" ".join(c.rjust(s) for c, s in zip(r, sizes)) for r in rows)


@register(".csv")
def csv_file(data: bytes, options: CleaningOptions) -> tuple[str, dict]:
    text, code = decoded(data, ("utf-8", "latin-1", "cp1252"))
    try:
        mark = csv.Sniffer().sniff(text[:1024]).delimiter
    except csv.Error:
        mark = ","
    table = pd.read_csv(io.StringIO(text), sep=mark)
    meta = {"encoding": code, "delimiter": mark, "rows": len(table), "columns": len(table.columns), "extraction_method": "csv"}
    return table.to_string(index=False), meta


@register(".json")
def json_file(data: bytes, options: CleaningOptions) -> tuple[str, dict]:
    value = json.loads(data.decode("utf-8"))
    meta = {"data_type": type(value).__name__, "extraction_method": "json"}
    if isinstance(value, dict):
        meta["data_keys"] = ", ".join(value)
    return json.dumps(value, indent=2 if options.preserve_formatting else None, ensure_ascii=False), meta


@register(".eml")
def mail(data: bytes, options: CleaningOptions) -> tuple[str, dict]:
    message = email.message_from_bytes(data, policy=email.policy.compat32)
    head = [f"{k}: {message[k]}" for k in ("Subject", "From", "To", "Date") if message[k]]
    parts = [p for p in message.walk() if p.get_content_type() == "text/plain"] if message.is_multipart() else [message]
    body = [(p.get_payload(decode=True) or b"").decode("utf-8", "ignore") for p in parts]
    return "\n".join([*head, "", *body]).strip(), {"subject": message["Subject"] or "", "extraction_method": "email"}


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _said(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == "t")


@register(".docx")
def docx(data: bytes, options: CleaningOptions) -> tuple[str, dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(x for x in _xml(z, "word/document.xml") if _local(x) == "body")
    lines = [t for p in body if _local(p) == "p" and (t := _said(p)).strip()]
    tables = [x for x in body if _local(x) == "tbl"]
    rows = [
        " | ".join(_said(c).strip() for c in r if _local(c) == "tc") for t in tables for r in t if _local(r) == "tr"
    ]
    text = "\n".join(lines) + ("\n\nTables:\n" + "\n".join(rows) if rows else "")
    return text, {"paragraphs": len(lines), "tables": len(tables), "extraction_method": "docx"}


@register(".pptx")
def pptx(data: bytes, options: CleaningOptions) -> tuple[str, dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
        slides = []
        for k, n in enumerate(sorted(names, key=lambda n: int(re.search(r"\d+", n)[0])), 1):
            paragraphs = [t for p in _xml(z, n).iter() if _local(p) == "p" and (t := _said(p)).strip()]
            if paragraphs:
                slides.append(f"Slide {k}:\n" + "\n".join(paragraphs))
    return "\n\n".join(slides), {"slides": len(names), "extraction_method": "pptx"}


def framed(rows: list[list[object]]) -> str:
    """Rows under the names in the first one, as a frame is printed: blanks as NaN, columns without a name by number."""
    if not rows:
        return pd.DataFrame().to_string(index=False)
    width = max(map(len, rows))
    blank = float("nan")
    rows = [[blank if c == "" else c for c in r] + [blank] * (width - len(r)) for r in rows]
    names = [f"Unnamed: {k}" if c is blank else str(c) for k, c in enumerate(rows[0])]
    return pd.DataFrame(rows[1:], columns=names).to_string(index=False)


def _number(text: str) -> object:
    """A cell's number: whole ones as such."""
    try:
        return int(text)
    except ValueError:
        try:
            return float(text)
        except ValueError:
            return text


@register(".xls", ".xlsx")
def spreadsheet(data: bytes, options: CleaningOptions) -> tuple[str, dict]:
    """By content, whatever the suffix: zipped sheets as frames, binary ones as lines of cells with commas."""
    if not zipfile.is_zipfile(io.BytesIO(data)):
        parts = [f"Sheet: {name}\n" + "\n".join(", ".join(map(str, r)) for r in rows) for name, rows in xls.sheets(data)]
        return "\n\n".join(parts), {"sheets": len(parts), "extraction_method": "xls"}
    total, sheets = 0, []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [_said(s) for s in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        links = {r.get("Id"): r.get("Target") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
        for sheet in (s for s in _xml(z, "xl/workbook.xml").iter() if _local(s) == "sheet"):
            target = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            rows: list[list[object]] = []
            for row in (r for r in _xml(z, "xl/" + links[target].removeprefix("/xl/")).iter() if _local(r) == "row"):
                cells: list[object] = []
                for c in (c for c in row if _local(c) == "c"):
                    at = 0
                    for ch in re.match("[A-Z]*", c.get("r") or "")[0]:
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (at - 1 - len(cells))
                    value = next((x.text or "" for x in c if _local(x) == "v"), _said(c))
                    kind = c.get("t") or "n"
                    cells.append(shared[int(value)] if kind == "s" else value == "1" if kind == "b" else _number(value) if kind == "n" else value)
                rows.append(cells)
            total += max(0, len(rows) - 1)
            sheets.append(f"Sheet: {sheet.get('name')}\n{framed(rows)}")
    return "\n\n".join(sheets), {"sheets": len(sheets), "total_rows": total, "extraction_method": "excel"}


@register(".zip")
def archive(data: bytes, options: CleaningOptions) -> tuple[str, dict]:
    parts = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for n in z.namelist():
            base = n.rpartition("/")[2]
            suffix = "." + base.rpartition(".")[2].lower()
            if base and not base.startswith(".") and not n.startswith(("__MACOSX/", ".")) and suffix in ZIP_MEMBERS:
                row = extracted_row(z.read(n), suffix, options)
                if row["success"] and row["text"].strip():
                    parts.append(f"=== {n} ===\n{row['text']}")
    if not parts:
        raise ValueError("no supported file in the archive")
    return "\n\n".join(parts), {"files": len(parts), "extraction_method": "zip"}


@register(".bin")
def binary(data: bytes, options: CleaningOptions) -> tuple[str, dict]:
    text, code = decoded(data, ("utf-8", "utf-16", "latin-1", "cp1252"))
    if not any(c.isprintable() for c in text[:100]):
        raise ValueError("binary data without text")
    return text, {"encoding": code, "extraction_method": "binary_as_text"}


class PageTexts:
    """Pluggable provider of (digital text, recognised text) for the pages of a PDF or image."""

    def pages(self, data: bytes, options: CleaningOptions) -> Iterator[tuple[str, str]]:
        raise NotImplementedError("no page-text provider is installed; register one for its suffix")


class DigitalPages(PageTexts):
    """The text that the pages of a PDF hold themselves; nothing is recognised."""

    def pages(self, data: bytes, options: CleaningOptions) -> Iterator[tuple[str, str]]:
        return ((text, "") for text in pdf.page_texts(data))


def paged(data: bytes, options: CleaningOptions, provider: PageTexts) -> tuple[str, dict]:
    texts = [max(pair, key=len) for pair in provider.pages(data, options)]
    return "\n\n".join(t for t in texts if t.strip()), {"pages": len(texts), "extraction_method": "pages"}


@register(".pdf")
def pdf_file(data: bytes, options: CleaningOptions) -> tuple[str, dict]:
    return paged(data, options, DigitalPages())


@register(".png", ".jpg", ".jpeg", ".tiff", ".bmp")
def image(data: bytes, options: CleaningOptions) -> tuple[str, dict]:
    return paged(data, options, PageTexts())


def extracted_row(data: bytes | None, suffix: str, options: CleaningOptions) -> dict:
    began = time.time()
    try:
        if suffix not in REGISTRY:
            raise ValueError(f"Unsupported file type: {suffix}")
        text, meta = REGISTRY[suffix](data or b"", options)
        row = {"text": text, "metadata": {k: str(v) for k, v in meta.items()}, "success": True, "error": None}
    except Exception as e:  # noqa: BLE001  one bad file is one error row
        row = {"text": "", "metadata": {}, "success": False, "error": str(e) or "Unknown error occurred"}
    return row | {"processing_time": time.time() - began}


def extract(files: DataFrame, options: CleaningOptions = CleaningOptions(), cleaned: bool = True) -> DataFrame:
    """(source, text, metadata, success, error, processing_time, file_hash) of (source, filename, content).

    Equal contents under one name are extracted once; ``.bin`` sources are
    refused before anything is read of them when they come by URL.
    """
    files = files.select("source", "filename", "content", extension(F.col("filename")).alias("ext"))
    keyed = files.withColumn("file_hash", content_key(F.col("filename"), F.coalesce("content", F.lit(b""))))
    once = keyed.dropDuplicates(["file_hash"]).select("file_hash", "filename", "ext", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [extracted_row(c, x, options) for c, x in zip(f["content"], f["ext"])]
            out = pd.DataFrame(rows, columns=["text", "metadata", "success", "error", "processing_time"])
            out.insert(0, "file_hash", f["file_hash"].tolist())
            yield out

    done = once.mapInPandas(run, f"file_hash string, {SCHEMA}")
    whole = keyed.select("source", "filename", "ext", "file_hash", F.length("content").alias("size")).join(done, "file_hash")
    text = F.col("text")
    if cleaned:
        text = F.when(F.col("success"), clean_text(text, options)).otherwise(F.lit(""))
    stamp = F.create_map(
        F.lit("filename"), F.col("filename"), F.lit("file_type"), F.col("ext"), F.lit("file_size"), F.col("size").cast("string"),
        F.lit("cleaning_applied"), F.lit(str(cleaned).lower()),
    )
    meta = F.when(F.col("success"), F.map_concat("metadata", stamp)).otherwise(F.col("metadata"))
    return whole.select("source", text.alias("text"), meta.alias("metadata"), "success", "error", "processing_time", "file_hash")


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, filename, content, modified, length) of files on any file system Spark reads.

    Files without a byte have no row: Spark's file sources pass over them.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.col("path").alias("source"), name.alias("filename"), "content", F.col("modificationTime").alias("modified"), "length")


def fetched(sources: DataFrame, fetch: Callable[[str], tuple[int, str, bytes]]) -> DataFrame:
    """(source, status, content_type, content): a pluggable fetcher (with its own time limit) run over a sources table; ``.bin`` isn't fetched."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for s in f["source"]:
                try:
                    rows.append((s, *fetch(s)))
                except Exception:  # noqa: BLE001  a failed fetch is a row without a status
                    rows.append((s, None, None, None))
            yield pd.DataFrame(rows, columns=["source", "status", "content_type", "content"])

    kept = sources.where(~is_bin(F.col("source"))).select("source")
    return kept.mapInPandas(run, "source string, status int, content_type string, content binary")


def web_text(pages: DataFrame, options: CleaningOptions = CleaningOptions(), html: str = "html") -> DataFrame:
    """All columns and text, title, description, keywords of fetched pages."""
    mark = "\n" if options.preserve_formatting else " "

    def run(s: pd.Series) -> pd.DataFrame:
        rows = [page_text(x or "", WEB_DROPPED, mark, options.open_references) for x in s]
        return pd.DataFrame([{"text": t, "title": m.get("title"), "description": m.get("description"), "keywords": m.get("keywords")} for t, m in rows], columns=["text", "title", "description", "keywords"])

    out = pages.withColumn("_p", F.pandas_udf(run, "text string, title string, description string, keywords string")(F.col(html)))
    return out.select(*pages.columns, clean_text(F.col("_p.text"), options).alias("text"), "_p.title", "_p.description", "_p.keywords")


def api_text(df: DataFrame, body: str, options: CleaningOptions = CleaningOptions()) -> DataFrame:
    """All columns and text, data_type, data_keys, method of API responses; what isn't JSON stays as it is."""

    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                text, meta = json_file((x or "").encode(), options)
                rows.append((text, meta["data_type"], meta.get("data_keys"), "api_parser_json"))
            except ValueError:
                rows.append((x, None, None, "api_parser_text"))
        return pd.DataFrame(rows, columns=["text", "data_type", "data_keys", "method"])

    out = df.withColumn("_p", F.pandas_udf(run, "text string, data_type string, data_keys string, method string")(F.col(body)))
    return out.select(*df.columns, "_p.text", "_p.data_type", "_p.data_keys", "_p.method")
