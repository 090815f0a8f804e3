"""Files of many formats as rows: detection, delimited text, office documents, XML, and a CSV sink."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What files of a format begin with, in hex.
SIGNATURES = [("pdf", "25504446"), ("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("gif", "47494638"), ("gzip", "1F8B"), ("ole", "D0CF11E0"), ("executable", "4D5A"), ("elf", "7F454C46")]
# Entries that tell what a zip container holds.
CONTAINERS = [("docx", "word/document.xml"), ("pptx", "ppt/presentation.xml"), ("xlsx", "xl/workbook.xml")]
# Formats by extension, for text files.
EXTENSIONS = {"csv": "csv", "tsv": "csv", "html": "html", "htm": "html", "md": "markdown", "txt": "text", "json": "json", "xml": "xml"}
#: A container may have so many entries and unpacked bytes; larger ones are reported, not read.
MOST_ENTRIES, MOST_BYTES = 5_000, 100 << 20


def read_files(spark: SparkSession, path: str, modified_after: str | None = None) -> DataFrame:
    """path, modificationTime, length and content of files, those changed since an instant only if given."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("modifiedAfter", modified_after) if modified_after else reader).load(path)


def detect_format(path: Column, content: Column) -> Column:
    """A file's format by its first bytes, the entries of a container, then its extension; unknown otherwise."""
    head = F.hex(F.substring(content, 1, 16))
    out = None
    for name, begins in SIGNATURES:
        test = F.startswith(head, F.lit(begins))
        out = F.when(test, name) if out is None else out.when(test, name)
    for name, entry in CONTAINERS:
        out = out.when(F.startswith(head, F.lit("504B0304")) & F.contains(content, F.lit(entry).cast("binary")), name)
    out = out.when(F.startswith(head, F.lit("504B0304")), "zip")
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    for name, kind in EXTENSIONS.items():
        out = out.when(extension == name, kind)
    return out.otherwise("unknown")


def sniff_delimiter(head: str) -> str:
    """The one of , ; tab | that the first lines have most, and as often in each; commas if none is."""
    lines = [re.sub(r'"[^"]*"', "", x) for x in head.splitlines()[:10] if x.strip()]
    score = {d: (min((x.count(d) for x in lines), default=0), sum(x.count(d) for x in lines)) for d in ",;\t|"}
    best = max(score, key=lambda d: score[d])
    return best if score[best][1] else ","


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, line_ends_in_cells: bool = True) -> DataFrame:
    """Delimited text with a header, quotes doubled inside quotes, line ends inside them kept; all cells are text.

    A file whose cells may have line ends is read by one task. Say that they don't, and Spark
    splits large files.
    """
    if delimiter is None:
        head = spark.read.text(path).limit(10).collect()
        delimiter = sniff_delimiter("\n".join(r["value"] for r in head))
    return spark.read.csv(path, header=True, sep=delimiter, quote='"', escape='"', multiLine=line_ends_in_cells, inferSchema=False)


def guard(cell: Column) -> Column:
    """A cell that a spreadsheet would take for a formula, with a quote before it."""
    text = cell.cast("string")
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV as RFC 4180 has it: CRLF, doubled quotes, no formulas."""
    guarded = df.select(*(guard(F.col(f"`{c}`")).alias(c) for c in df.columns))
    guarded.write.mode("overwrite").csv(path, header=True, lineSep="\n", quote='"', escape='"', emptyValue="")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def office_text(files: DataFrame) -> DataFrame:
    """(path, format, part, text, warning) of docx, pptx and xlsx files: a row a document, slide or sheet.

    Each file is opened in the task that holds it. A damaged or oversized container gives a row
    with a warning and no text.
    """
    known = files.withColumn("format", detect_format(F.col("path"), F.col("content"))).where(F.col("format").isin("docx", "pptx", "xlsx"))

    def work(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for f in batch.itertuples():
                try:
                    rows += [(f.path, f.format, k, t, None) for k, t in enumerate(parts_of(f.format, bytes(f.content)))]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((f.path, f.format, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "format", "part", "text", "warning"])

    return known.select("path", "format", "content").mapInPandas(work, "path string, format string, part int, text string, warning string")


def parts_of(kind: str, content: bytes) -> list[str]:
    """The texts of a container's document, slides in order of number, or sheets."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        entries = z.infolist()
        if len(entries) > MOST_ENTRIES or sum(e.file_size for e in entries) > MOST_BYTES:
            raise ValueError("the container is too large")
        if kind == "docx":
            return [lines(z.read("word/document.xml"), "p", "t")]
        folder = "ppt/slides/slide" if kind == "pptx" else "xl/worksheets/sheet"
        names = sorted((e.filename for e in entries if re.fullmatch(rf"{folder}\d+\.xml", e.filename)), key=lambda n: int(re.search(r"\d+", n)[0]))
        if kind == "pptx":
            return [lines(z.read(n), "p", "t") for n in names]
        shared = [lines(ElementTree.tostring(si), "si", "t") for si in named(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in z.namelist() else []
        return [sheet(z.read(n), shared) for n in names]


def named(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if e.tag.rpartition("}")[2] == name]


def lines(xml: bytes, block: str, run: str) -> str:
    found = ["".join(t.text or "" for t in named(p, run)) for p in named(ElementTree.fromstring(xml), block)]
    return "\n".join(x for x in found if x.strip())


def sheet(xml: bytes, shared: list[str]) -> str:
    """A sheet's rows, cells parted by tabs."""
    out = []
    for row in named(ElementTree.fromstring(xml), "row"):
        cells = []
        for c in named(row, "c"):
            value = next((v.text or "" for v in named(c, "v")), "".join(t.text or "" for t in named(c, "t")))
            cells.append(shared[int(value)] if c.get("t") == "s" else value)
        out.append("\t".join(cells))
    return "\n".join(out)
