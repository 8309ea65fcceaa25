"""Readers of files that a page links to, and of the engine's own logs.

Each takes rows with the file's bytes (`content`), as Spark's binaryFile source
gives them, and returns one row per file.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def decode(blob: bytes) -> str:
    for name in ("utf-8-sig", "utf-8"):
        try:
            return blob.decode(name)
        except UnicodeDecodeError:
            continue
    return blob.decode("latin-1")


def csv_text(blob: bytes) -> str:
    """Rows of a comma, semicolon, tab or bar separated file, tab-joined; blank rows dropped."""
    text = decode(blob)
    try:
        dialect = csv.Sniffer().sniff(text[:4096], delimiters=",;\t|")
    except csv.Error:
        dialect = csv.excel
    rows = csv.reader(io.StringIO(text), dialect)
    return "\n".join("\t".join(r) for r in rows if any(c.strip() for c in r))


def xlsx_text(blob: bytes) -> str:
    """`# Sheet: name` and the tab-joined rows of each sheet; blank rows dropped."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        names = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        rels = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = rels.get(sheet.get(f"{_R}id"), "").lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            out.append(f"# Sheet: {sheet.get('name')}")
            for row in ElementTree.fromstring(z.read(path)).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    v, kind = c.find(f"{_S}v"), c.get("t")
                    if kind == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{_S}t")))
                    elif v is None or v.text is None:
                        cells.append("")
                    else:
                        cells.append(strings[int(v.text)] if kind == "s" else v.text)
                if any(x.strip() for x in cells):
                    out.append("\t".join(cells))
    return "\n".join(out)


def docx_text(blob: bytes) -> str:
    """Paragraphs, then each table under `# Table`, cells tab-joined."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out = [t for p in body.findall(f"{_W}p") if (t := text(p)).strip()]
    for table in body.findall(f"{_W}tbl"):
        out.append("# Table")
        out += ["\t".join(text(c) for c in row.findall(f"{_W}tc")) for row in table.findall(f"{_W}tr")]
    return "\n".join(out)


def pdf_text(blob: bytes) -> str | None:
    """Pages under `===== Page N =====` if a PDF library is there; else null."""
    try:
        import pypdf
    except ImportError:
        return None
    reader = pypdf.PdfReader(io.BytesIO(blob))
    return "\n".join(f"===== Page {i + 1} =====\n{p.extract_text() or ''}" for i, p in enumerate(reader.pages))


def docx_title(blob: bytes) -> str | None:
    """The title among a document's core properties; blank or missing: null."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        if "docProps/core.xml" not in z.namelist():
            return None
        found = ElementTree.fromstring(z.read("docProps/core.xml")).find("{http://purl.org/dc/elements/1.1/}title")
    return (found.text or "").strip() or None if found is not None else None


READERS: dict[str, Callable[[bytes], str | None]] = {"csv": csv_text, "xlsx": xlsx_text, "docx": docx_text, "pdf": pdf_text}


def _read_rows(kind: pa.Array, blob: pa.Array) -> pa.Array:
    out = []
    for k, b in zip(kind.to_pylist(), blob.to_pylist(), strict=True):
        text, error, title = None, None, None
        if k in READERS and b is not None:
            try:
                text = READERS[k](b)
                title = docx_title(b) if k == "docx" else None
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, csv.Error, AttributeError) as e:
                error = f"{type(e).__name__}: {e}"
        out.append({"content": text, "extraction_method": k if text is not None else "none", "error": error, "title": title})
    return pa.array(out, pa.struct([(c, pa.string()) for c in ("content", "extraction_method", "error", "title")]))


def extract_files(files: DataFrame, kind: str = "kind", content: str = "content") -> DataFrame:
    """The rows with the text of each file in place of its bytes; what can't be read has method `none`."""
    rest = [c for c in files.columns if c != content]

    @F.arrow_udf("struct<content:string,extraction_method:string,error:string,title:string>")
    def read(kind: pa.Array, blob: pa.Array) -> pa.Array:
        return _read_rows(kind, blob)

    return files.withColumn("__x", read(F.col(kind), F.col(content))).select(*rest, "__x.*")


def binary_files(spark: SparkSession, path: str, most_mb: int = 100) -> DataFrame:
    """Files below a size, read as bytes; the filter on length is pushed to the listing."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= most_mb * 1024 * 1024)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines; lines that are no objects are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def skill_file(text: str) -> dict | None:
    """A skill: `key: value` lines between `---` lines, then sections; null without name and domain."""
    lines = text.splitlines()
    if not lines or lines[0].strip() != "---" or "---" not in [x.strip() for x in lines[1:]]:
        return None
    end = next(i for i, x in enumerate(lines[1:], 1) if x.strip() == "---")
    head = {}
    for line in lines[1:end]:
        k, _, v = line.partition(":")
        if v.strip() and not line.startswith((" ", "-")):
            head[k.strip()] = v.strip().strip("\"'")
    if not head.get("name") or not head.get("domain"):
        return None
    sections, at = {}, None
    for line in lines[end + 1 :]:
        if line.startswith("## "):
            at = line[3:].strip().lower()
            sections[at] = []
        elif at is not None:
            sections[at].append(line)
    steps = [x.lstrip("0123456789. -*").strip() for x in sections.get("recommended flow", []) if x.strip()]
    return {"name": head["name"], "domain": head["domain"].lower(), "description": head.get("description", ""), "flow": steps, "sections": json.dumps({k: "\n".join(v).strip() for k, v in sections.items()})}


def skill_files(spark: SparkSession, path: str) -> DataFrame:
    kind = pa.struct([("name", pa.string()), ("domain", pa.string()), ("description", pa.string()), ("flow", pa.list_(pa.string())), ("sections", pa.string())])

    @F.arrow_udf("struct<name:string,domain:string,description:string,flow:array<string>,sections:string>")
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([skill_file(t or "") for t in texts.to_pylist()], kind)

    return spark.read.text(path, wholetext=True).select(read("value").alias("s")).where("s is not null").select("s.*")
