"""Word-document ingest (R01-R03) as a Spark job.

``read_docx_folder`` lists a folder (by suffix, no recursion) and extracts body text in
``mapInPandas`` tasks with the standard library only: the body's top-level
paragraphs are joined with newlines, runs' text, tabs and line breaks kept,
tables skipped. Unreadable files come out with ``text`` null and ``error`` set,
so a quarantine table is a filter, and they never reach the analysis.
"""

from __future__ import annotations

import io
import os
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.session import ship_package

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
EXTRACT_DDL = "path string, filename string, text string, error string"


def paragraph_text(p: ET.Element) -> str:
    """Text of one paragraph: run text, tabs, and line breaks (page and column breaks add nothing).

    Only the paragraph's own runs and those of its hyperlinks count: tab stop definitions,
    tracked insertions and text boxes are not part of it.
    """
    out = []
    runs = [r for c in p for r in ([c] if c.tag == W + "r" else c if c.tag == W + "hyperlink" else ())]
    for el in (x for r in runs if r.tag == W + "r" for x in r):
        tag = el.tag
        if tag == W + "t":
            out.append(el.text or "")
        elif tag in (W + "tab", W + "ptab"):
            out.append("\t")
        elif tag == W + "br":
            if el.get(W + "type", "textWrapping") == "textWrapping":
                out.append("\n")
        elif tag == W + "cr":
            out.append("\n")
        elif tag == W + "noBreakHyphen":
            out.append("-")
    return "".join(out)


def main_part(z: zipfile.ZipFile) -> str:
    """Name of the main document part, by the package's relationships."""
    if "_rels/.rels" in z.namelist():
        for r in ET.fromstring(z.read("_rels/.rels")):
            if r.get("Type", "").endswith("/officeDocument"):
                return posixpath.normpath(r.get("Target", "").lstrip("/"))
    return "word/document.xml"


def docx_text(content: bytes) -> str:
    """Body text of one .docx: top-level paragraphs joined by newlines."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read(main_part(z)))
    body = root.find(W + "body")
    if body is None:
        raise ValueError("document has no body")
    return "\n".join(paragraph_text(p) for p in body if p.tag == W + "p")


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            name = posixpath.basename(path)
            try:
                rows.append((path, name, docx_text(bytes(content)), None))
            except Exception as e:  # quarantine, never fail the task
                rows.append((path, name, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["path", "filename", "text", "error"])


def read_docx_folder(spark: SparkSession, folder: str, suffix: str = ".docx") -> DataFrame:
    """R01 + R02 + R03: ``(path, filename, text, error)`` for every ``*<suffix>`` file.

    Hidden names, folders and files of no bytes are left out, as ``binaryFile`` does. That source keeps the
    status of every file on the driver and packs some thirty files to a task, so a folder on a mount
    is listed in a task (``sources.folder``) and its files are dealt out; other stores go through ``binaryFile``.
    """
    from docket.sources.folder import list_folder, qualified, read_listed

    ship_package(spark)
    if qualified(spark, folder).startswith("file:"):
        hidden = F.col("filename").startswith(".") | F.col("filename").startswith("_") & ~F.contains("filename", F.lit("="))
        files = list_folder(spark, folder, suffix).where(~hidden & ~F.col("is_folder") & (F.col("length") > 0))
        return read_listed(files)
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*" + suffix)
        .option("recursiveFileLookup", "false")
        .load(folder)
        .select("path", "content")
    )
    return files.mapInPandas(_extract, EXTRACT_DDL)


def readable(extracted: DataFrame) -> DataFrame:
    """Documents to analyse: ``(filename, text)`` of files that could be read."""
    return extracted.where(F.col("error").isNull()).select("filename", "text")


def quarantine(extracted: DataFrame) -> DataFrame:
    return extracted.where(F.col("error").isNotNull()).select("path", "filename", "error")


# -- writer used to build test corpora from a text table -------------------------------

_CT = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" '
    'ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'
    "</Types>"
)
_RELS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" '
    'Target="word/document.xml"/></Relationships>'
)


def _escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def docx_bytes(text: str, table_cell: str | None = None) -> bytes:
    """A minimal .docx whose body paragraphs are the lines of ``text``."""
    paras = []
    for line in text.split("\n"):
        runs = []
        for i, piece in enumerate(line.split("\t")):
            if i:
                runs.append("<w:tab/>")
            if piece:
                runs.append(f'<w:t xml:space="preserve">{_escape(piece)}</w:t>')
        paras.append(f"<w:p><w:r>{''.join(runs)}</w:r></w:p>" if runs else "<w:p/>")
    if table_cell is not None:
        paras.append(f"<w:tbl><w:tr><w:tc><w:p><w:r><w:t>{_escape(table_cell)}</w:t></w:r></w:p></w:tc></w:tr></w:tbl>")
    doc = (
        '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        f'<w:document xmlns:w="{W[1:-1]}"><w:body>{"".join(paras)}</w:body></w:document>'
    )
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _CT)
        z.writestr("_rels/.rels", _RELS)
        z.writestr("word/document.xml", doc.encode("utf-8"))
    return buf.getvalue()


def write_docx_corpus(docs: DataFrame, folder: str, corrupt: str | None = None, empty: str | None = None) -> int:
    """Write one ``<filename>`` .docx per row of ``(filename, text)`` into ``folder``.

    Runs as a Spark job (each task writes its own files). ``corrupt`` is an
    optional SQL predicate: matching rows get a damaged archive instead; those that
    ``empty`` matches get a file of no bytes. The folder must be shared by all executors: a URI (written through Arrow's file
    systems) or a path on a shared mount.
    """
    ship_package(docs.sparkSession)
    if folder.startswith("file:"):
        folder = "/" + folder[len("file:"):].lstrip("/")
    if "://" not in folder:
        os.makedirs(folder, exist_ok=True)
    flag = F.expr(corrupt) if corrupt else F.lit(False)
    hollow = F.expr(empty) if empty else F.lit(False)
    src = docs.select("filename", "text", flag.alias("_bad"), hollow.alias("_hollow"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if "://" in folder:  # shared storage (hdfs://, s3://, ...) through Arrow's file systems
            from pyarrow import fs as pafs

            filesystem, base = pafs.FileSystem.from_uri(folder)
            opener = lambda name: filesystem.open_output_stream(f"{base}/{name}")
        else:
            opener = lambda name: open(os.path.join(folder, name), "wb")
        n = 0
        for pdf in batches:
            for fn, text, bad, none in zip(pdf["filename"], pdf["text"], pdf["_bad"], pdf["_hollow"]):
                data = b"" if none else docx_bytes(text or "")
                if bad:
                    data = data[: len(data) // 3]
                with opener(fn) as fh:
                    fh.write(data)
                n += 1
        yield pd.DataFrame({"n": [n]})

    return int(src.mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0)
