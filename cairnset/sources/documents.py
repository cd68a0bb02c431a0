"""Office documents as text: paragraphs of word files and rows of sheets, from their zipped XML."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

ROWS = 120  # a sheet of more rows is cut into windows of this many


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def docx_paragraphs(raw: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    texts = ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in root.iter() if _local(p.tag) == "p"]
    return [t for t in texts if t.strip()]


def sheet_rows(raw: bytes) -> list[tuple[str, list[str]]]:
    """(sheet, rows with cells joined by tabs)."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        titles = [s.attrib.get("name", "") for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"] if "xl/workbook.xml" in names else []
        out = []
        parts = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for i, part in enumerate(parts):
            rows = []
            for row in (r for r in ET.fromstring(z.read(part)).iter() if _local(r.tag) == "row"):
                cells = []
                for c in (c for c in row if _local(c.tag) == "c"):
                    value = "".join(v.text or "" for v in c.iter() if _local(v.tag) in ("v", "t"))
                    cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value else value)
                rows.append("\t".join(cells))
            out.append((titles[i] if i < len(titles) else f"Sheet{i + 1}", rows))
    return out


def _chunks(path: str, raw: bytes) -> list[tuple]:
    try:
        if path.lower().endswith(".docx"):
            return [(path, None, "\n\n".join(docx_paragraphs(raw)))]
        found = []
        for name, rows in sheet_rows(raw):
            if len(rows) <= ROWS:
                found.append((path, name, "\n".join(rows)))
            else:
                found += [(path, f"{name} (rows {a + 1}–{min(a + ROWS, len(rows))})", "\n".join(rows[a:a + ROWS])) for a in range(0, len(rows), ROWS)]
        return found
    except (zipfile.BadZipFile, KeyError, ET.ParseError, IndexError, ValueError):
        return []


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """path, name, content of the .docx and .xlsx files under a root; unreadable ones give no rows."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,xlsx}").load(root)

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([c for p, b in zip(pdf["path"], pdf["content"]) for c in _chunks(p, b)], columns=["path", "name", "content"])

    return raw.select("path", "content").mapInPandas(run, "path string, name string, content string")
