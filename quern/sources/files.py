"""Files of many formats as units of blocks.

A scan of ``binaryFile`` (or any DataFrame with path, content and content_type) is dealt to the first reader that
supports a file's suffix or MIME type. Parsing runs in the tasks, a file at a time; a file that can't be parsed gives
one row with its ``error`` and fails nothing else. Formats whose parsers aren't installed take a function.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.schemas import UNITS


@dataclass
class Unit:
    number: int
    label: str
    blocks: list[dict] = field(default_factory=list)
    assets: list[dict] = field(default_factory=list)


def block(kind: str, text: str, section: tuple[str, ...] = (), **metadata) -> dict:
    return {"block_type": kind, "text": text, "section_path": list(section), "bbox": None, "metadata": [(k, str(v)) for k, v in metadata.items()]}


def asset(data: bytes, extension: str, content_type: str) -> dict:
    return {"data": data, "extension": extension, "content_type": content_type, "digest": hashlib.sha256(data).hexdigest()}


def read_text(data: bytes, name: str) -> Iterator[Unit]:
    yield Unit(1, name, [block("text", data.decode("utf-8", "replace"))])


class _Nodes(HTMLParser):
    """Text nodes outside of script, style and noscript."""

    SILENT = ("script", "style", "noscript")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in self.SILENT

    def handle_endtag(self, tag):
        self.silent -= tag in self.SILENT and self.silent > 0

    def handle_data(self, data):
        if not self.silent:
            self.nodes.append(data)


def html_lines(text: str) -> str:
    """Text nodes a line each, stripped, blank ones dropped."""
    parser = _Nodes()
    parser.feed(text)
    parser.close()
    lines = (line.strip() for line in "\n".join(parser.nodes).splitlines())
    return "\n".join(line for line in lines if line)


def read_html(data: bytes, name: str) -> Iterator[Unit]:
    yield Unit(1, name, [block("text", html_lines(data.decode("utf-8", "replace")))])


def read_csv(data: bytes, name: str) -> Iterator[Unit]:
    """The suffix says what separates cells: tabs for ``.tsv``, else commas."""
    rows = csv.reader(io.StringIO(data.decode("utf-8", "replace")), delimiter="\t" if name.lower().endswith(".tsv") else ",")
    yield Unit(1, name, [block("table", "\n".join(" | ".join(c.strip() for c in row) for row in rows))])


def read_json(data: bytes, name: str) -> Iterator[Unit]:
    text = data.decode("utf-8", "replace")
    value = [json.loads(line) for line in text.splitlines() if line.strip()] if name.lower().endswith(".jsonl") else json.loads(text)
    yield Unit(1, name, [block("text", json.dumps(value, ensure_ascii=False, indent=2))])


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(node, name: str, default: str = "") -> str:
    return next((v for k, v in node.attrib.items() if _local(k) == name), default)


def _find(node, *path: str):
    for name in path:
        node = next((x for x in node if _local(x.tag) == name), None) if node is not None else None
    return node


def _all(node, name: str) -> Iterator:
    return (x for x in node.iter() if _local(x.tag) == name)


def _parse(archive: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(archive.read(name))


def _targets(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relationship ids of a part of an Office file, and the parts they name."""
    folder, file = posixpath.split(part)
    name = f"{folder}/_rels/{file}.rels"
    if name not in archive.namelist():
        return {}
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))).lstrip("/") if not r.get("Target").startswith("/") else r.get("Target").lstrip("/") for r in _parse(archive, name) if r.get("TargetMode") != "External"}


def _media(archive: zipfile.ZipFile, targets: dict[str, str]) -> list[dict]:
    out: dict[str, dict] = {}
    for part in sorted(set(targets.values())):
        if "/media/" in part and part in archive.namelist():
            extension = part.rpartition(".")[2].lower()
            found = asset(archive.read(part), extension, f"image/{'jpeg' if extension == 'jpg' else extension}")
            out.setdefault(found["digest"], found)
    return list(out.values())


def read_xlsx(data: bytes, name: str) -> Iterator[Unit]:
    """A unit for each sheet; rows of blank cells are dropped."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = ["".join(t.text or "" for t in _all(item, "t")) for item in _parse(archive, "xl/sharedStrings.xml")]
        targets = _targets(archive, "xl/workbook.xml")
        for number, sheet in enumerate(_all(_parse(archive, "xl/workbook.xml"), "sheet"), 1):
            lines = []
            for row in _all(_parse(archive, targets[_attribute(sheet, "id")]), "row"):
                cells: list[str] = []
                for cell in _all(row, "c"):
                    column = 0
                    for letter in cell.get("r", ""):
                        if letter.isalpha():
                            column = column * 26 + ord(letter.upper()) - 64
                    cells += [""] * (column - 1 - len(cells))
                    value = _find(cell, "v")
                    text = "".join(t.text or "" for t in _all(cell, "t")) if cell.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
                    cells.append((shared[int(text)] if cell.get("t") == "s" and text else text).strip())
                if any(cells):
                    lines.append(" | ".join(cells))
            title = sheet.get("name", f"Sheet {number}")
            yield Unit(number, title, [block("table", "\n".join(lines), (title,))] if lines else [])


def _table_text(table, row: str, cell: str) -> str:
    return "\n".join(" | ".join(" ".join("".join(t.text or "" for t in _all(p, "t")) for p in _all(c, "p")).strip() for c in r if _local(c.tag) == cell) for r in _all(table, row))


def read_docx(data: bytes, name: str) -> Iterator[Unit]:
    """One unit: paragraphs by their style, then all tables under the last heading."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = _find(_parse(archive, "word/document.xml"), "body")
        styles: dict[str, str] = {}
        if "word/styles.xml" in archive.namelist():
            for style in _all(_parse(archive, "word/styles.xml"), "style"):
                named = _find(style, "name")
                styles[_attribute(style, "styleId")] = _attribute(named, "val").lower() if named is not None else ""
        out, section = [], ()
        for p in (x for x in body if _local(x.tag) == "p"):
            text = "".join(t.text or "" for t in _all(p, "t")).strip()
            if not text:
                continue
            style = _find(p, "pPr", "pStyle")
            style_id = _attribute(style, "val") if style is not None else ""
            known = styles.get(style_id, style_id.lower())
            if known.startswith("heading") or known == "title":
                section = (text,)
                out.append(block("heading", text, section))
            else:
                out.append(block("list" if "list" in known else "paragraph", text, section))
        for table in (x for x in body if _local(x.tag) == "tbl"):
            if (text := _table_text(table, "tr", "tc")).strip():
                out.append(block("table", text, section))
        yield Unit(1, name, out, _media(archive, _targets(archive, "word/document.xml")))


def read_pptx(data: bytes, name: str) -> Iterator[Unit]:
    """A unit for each slide: its title, its text frames, its tables and its pictures."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        targets = _targets(archive, "ppt/presentation.xml")
        for number, slide in enumerate(_all(_parse(archive, "ppt/presentation.xml"), "sldId"), 1):
            part = targets[slide.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")]
            shown = _parse(archive, part)
            out, section = [], ()
            shapes = [("\n".join(filter(None, ("".join(t.text or "" for t in _all(p, "t")).strip() for p in _all(s, "p")))), any(x.get("type") in ("title", "ctrTitle") for x in _all(s, "ph"))) for s in _all(shown, "sp")]
            for text, is_title in sorted(shapes, key=lambda s: not s[1]):
                if text:
                    section = (text,) if is_title and not section else section
                    out.append(block("heading" if is_title else "paragraph", text, section))
            out += [block("table", text, section) for table in _all(shown, "tbl") if (text := _table_text(table, "tr", "tc")).strip()]
            yield Unit(number, section[0] if section else f"Slide {number}", out, _media(archive, _targets(archive, part)))


def image_reader(ocr: Callable[[bytes], str] | None = None) -> Callable[[bytes, str], Iterator[Unit]]:
    """A reader of images; without a function for recognition the text says which image it is."""

    def read(data: bytes, name: str) -> Iterator[Unit]:
        extension = name.rpartition(".")[2].lower()
        try:
            text = (ocr(data) if ocr else "").strip()
        except Exception:  # noqa: BLE001  a picture that can't be recognised is still stored
            text = ""
        yield Unit(1, name, [block("image", text or f"Image: {name}")], [asset(data, extension, f"image/{extension}")])

    return read


@dataclass
class Reader:
    name: str
    suffixes: tuple[str, ...]
    mimes: tuple[str, ...]
    read: Callable[[bytes, str], Iterator[Unit]] | None

    def supports(self, path: Column, mime: Column) -> Column:
        suffix = F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\.[^.]*)$", 1))
        kinds = [mime.startswith(m[:-1]) if m.endswith("*") else mime == m for m in self.mimes]
        found = suffix.isin(*self.suffixes)
        for k in kinds:
            found = found | F.coalesce(k, F.lit(False))
        return found


_OFFICE = "application/vnd.openxmlformats-officedocument."


def readers(pdf: Callable | None = None, ocr: Callable[[bytes], str] | None = None) -> list[Reader]:
    """Readers in the order in which they are asked. PDF files need a parser to be given."""
    return [
        Reader("pdf", (".pdf",), ("application/pdf",), pdf),
        Reader("docx", (".docx",), (f"{_OFFICE}wordprocessingml.document",), read_docx),
        Reader("pptx", (".pptx",), (f"{_OFFICE}presentationml.presentation",), read_pptx),
        Reader("xlsx", (".xlsx",), (f"{_OFFICE}spreadsheetml.sheet",), read_xlsx),
        Reader("image", (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff"), ("image/*",), image_reader(ocr)),
        Reader("html", (".html", ".htm"), ("text/html",), read_html),
        Reader("csv", (".csv", ".tsv"), ("text/csv", "text/tab-separated-values"), read_csv),
        Reader("json", (".json", ".jsonl"), ("application/json",), read_json),
        Reader("text", (".txt", ".md", ".rst", ".log", ".yaml", ".yml", ".xml"), ("text/*",), read_text),
    ]


def reader_name(path: Column, mime: Column, known: list[Reader]) -> Column:
    """Name of the first reader that supports a file; null if none does."""
    out = F.when(known[0].supports(path, mime), F.lit(known[0].name))
    for r in known[1:]:
        out = out.when(r.supports(path, mime), F.lit(r.name))
    return out


def scan(spark: SparkSession, folder: str, content_type: str | None = None) -> DataFrame:
    """Path, content and content_type of all files below ``folder``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content", F.lit(content_type).cast("string").alias("content_type"), F.col("length").alias("size_bytes"))


#: Units, and bytes of their texts and assets, after which a task hands on what it has read.
BATCH_UNITS, BATCH_BYTES = 1000, 8 << 20


def _held(unit: Unit) -> int:
    """About how many bytes a unit holds."""
    return sum(len(b["text"] or "") for b in unit.blocks) + sum(len(a["data"] or b"") for a in unit.assets)


_UNITS = pa.schema([("path", pa.string()), ("reader", pa.string()), ("unit", pa.int32()), ("label", pa.string()), ("blocks", pa.list_(pa.struct([("block_type", pa.string()), ("text", pa.string()), ("section_path", pa.list_(pa.string())), ("bbox", pa.list_(pa.float64())), ("metadata", pa.map_(pa.string(), pa.string()))]))), ("assets", pa.list_(pa.struct([("data", pa.binary()), ("extension", pa.string()), ("content_type", pa.string()), ("digest", pa.string())]))), ("error", pa.string())])


def parsed(batches: Iterator[pa.RecordBatch], parsers: dict[str, Callable | None], most_units: int) -> Iterator[pa.RecordBatch]:
    """Units of batches of (path, content, reader). Those of small files are handed on together, as an Arrow batch for each
    file costs more than reading it."""
    ready: list[dict] = []
    size = 0
    for batch in batches:
        for path, data, reader in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            rows: list[dict] = []
            error, held = None, 0
            try:
                if parsers.get(reader) is None or data is None:
                    raise ValueError("unsupported" if data is not None else "no content")
                for u in parsers[reader](data, (path or "").rpartition("/")[2]):
                    if len(rows) >= most_units:
                        raise ValueError(f"more than {most_units} units")
                    rows.append({"path": path, "reader": reader, "unit": u.number, "label": u.label, "blocks": u.blocks, "assets": u.assets, "error": None})
                    held += _held(u)
            except Exception as e:  # noqa: BLE001  whatever a parser raises belongs to this file alone
                error = f"{type(e).__name__}: {e}"[:1000]
            if error:
                rows = [{"path": path, "reader": reader, "unit": None, "label": None, "blocks": [], "assets": [], "error": error}]
                held = 0
            if ready and size + held > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(ready, _UNITS)
                ready, size = [], 0
            ready += rows
            size += held
            if len(ready) >= BATCH_UNITS:
                yield pa.RecordBatch.from_pylist(ready, _UNITS)
                ready, size = [], 0
    if ready:
        yield pa.RecordBatch.from_pylist(ready, _UNITS)


def units(files: DataFrame, known: list[Reader] | None = None, most_units: int = 2000) -> DataFrame:
    """Units of all files (path, content, content_type): one row a unit, or one row with an error.

    A null path or content, a file that no reader supports and one with more than ``most_units`` units are errors.
    """
    known = known or readers()
    parsers = {r.name: r.read for r in known}
    named = files.select("path", "content", reader_name(F.col("path"), F.col("content_type"), known).alias("reader"))
    return named.mapInArrow(lambda batches: parsed(batches, parsers, most_units), UNITS)


#: What a line of a large file becomes, by the kind of file.
_LINES = {
    "csv": lambda line: " | ".join(c.strip() for c in next(csv.reader([line]), [])),
    "tsv": lambda line: " | ".join(c.strip() for c in next(csv.reader([line], delimiter="\t"), [])),
    "jsonl": lambda line: json.dumps(json.loads(line), ensure_ascii=False),
    "text": lambda line: line,
}


def line_units(spark: SparkSession, folder: str, kind: str, rows: int = 1000) -> DataFrame:
    """Units (path, reader, unit, label, blocks, assets, error) of files below ``folder`` that are too large to be read
    whole: ``csv``, ``tsv``, ``jsonl`` or ``text``, of at most ``rows`` lines each.

    Spark's own source reads the files by ranges of bytes, so one huge file is spread over tasks and a task holds some
    lines. Lines keep their order within a unit and units that within their file; a unit ends with its range at the
    latest. Blank lines are left out. A cell of CSV can't hold a line's end here. A line that can't be read makes an error of
    its unit, whose other lines stay.
    """
    parse, block_type = _LINES[kind], "table" if kind in ("csv", "tsv") else "text"
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), "value").where(F.trim("value") != "")
    parts = lines.groupBy("path", "start", F.floor(F.col("n") / rows).alias("part")).agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("lines"))
    parts = parts.withColumn("lines", F.transform("lines", lambda x: x["value"])).withColumn("unit", F.row_number().over(Window.partitionBy("path").orderBy("start", "part")))

    @F.arrow_udf("struct<text:string,error:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts, errors = [], []
            for some in batch.to_pylist():
                good, error = [], None
                for line in some:
                    try:
                        good.append(parse(line))
                    except Exception as e:  # noqa: BLE001  whatever a parser raises belongs to this line alone
                        error = error or f"{type(e).__name__}: {e}"[:1000]
                texts.append("\n".join(good))
                errors.append(error)
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["text", "error"])

    read = parts.withColumn("r", run("lines"))
    block_ = F.struct(F.lit(block_type).alias("block_type"), F.col("r.text").alias("text"), F.array().cast("array<string>").alias("section_path"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(None).cast("map<string,string>").alias("metadata"))
    label = F.concat_ws(" ", F.element_at(F.split("path", "/"), -1), F.col("unit").cast("string"))
    return read.select("path", F.lit(kind).alias("reader"), "unit", label.alias("label"), F.array(block_).alias("blocks"), F.array().cast("array<struct<data:binary,extension:string,content_type:string,digest:string>>").alias("assets"), "r.error")


def blocks(unit_rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each block of units that have no error: ``keep``, unit, pos, and the fields of the block."""
    rows = unit_rows.where("error is null")
    return rows.select(*keep, "unit", F.posexplode("blocks").alias("pos", "block")).select(*keep, "unit", "pos", "block.*")
