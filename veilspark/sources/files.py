"""Text, delimited and office files as DataFrames, and back.

Files are read by Spark (``binaryFile``, ``csv``), so any store that Spark reaches will do. Office documents are zip archives of XML; one task parses one
document with the standard library and sends its text pieces out as rows.
"""

from __future__ import annotations

import codecs
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte order marks, encodings in the order tried, limits and the allowed kinds of files.
MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
ENCODINGS = ("utf-8", "cp1252", "iso-8859-1")
DELIMITERS = (",", ";", "\t", "|")
MOST_BYTES, MOST_ENTRIES, MOST_UNPACKED, MOST_RATIO, MOST_XML = 100 * 2**20, 10_000, 500 * 2**20, 100.0, 10 * 2**20
KINDS = ("csv", "xlsx", "xls", "docx", "doc", "pptx", "ppt")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
PIECES = "path string, part string, kind string, block int, row int, col int, run int, address string, text string, x long, y long, width long, height long"


def encoding_of(head: bytes) -> str:
    """By byte order mark, else the first encoding that decodes the sample."""
    for mark, name in MARKS:
        if head.startswith(mark):
            return name
    for name in ENCODINGS:
        try:
            codecs.getincrementaldecoder(name)().decode(head)  # a character may be cut at the end
            return name
        except UnicodeDecodeError:
            continue
    return "utf-8"


def delimiter_of(sample: Column) -> Column:
    """The delimiter with the greatest mean count a line over 1 + variance, of the first ten lines; a comma if none occurs."""
    lines = F.filter(F.slice(F.split(sample, "\n"), 1, 10), lambda x: F.trim(x) != "")
    n = F.size(lines)
    best = []
    for i, d in enumerate(DELIMITERS):
        counts = _counts(lines, d)
        mean = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) / n
        var = F.aggregate(F.transform(counts, _squared_from(mean)), F.lit(0.0), lambda a, x: a + x) / n
        best.append(F.struct(F.when(n > 0, mean / (1 + var)).otherwise(0.0).alias("score"), F.lit(-i).alias("rank"), F.lit(d).alias("delimiter")))
    top = F.array_max(F.array(*best))
    return F.when(top["score"] > 0, top["delimiter"]).otherwise(",")


def _counts(lines: Column, delimiter: str) -> Column:
    return F.transform(lines, lambda x: (F.length(x) - F.length(F.replace(x, F.lit(delimiter), F.lit("")))).cast("double"))


def _squared_from(mean: Column):
    return lambda x: (x - mean) * (x - mean)


def _head(spark: SparkSession, path: str, lines: int = 200, most: int = 65_536) -> bytes:
    """The first lines of a file as they stand, ``most`` bytes of them; no more of it is read than Spark needs for these lines."""
    rows = spark.read.text(path).limit(lines).select(F.col("value").cast("binary").alias("b")).collect()
    return b"\n".join(bytes(r.b) for r in rows)[:most]


def _quotes_span_lines(spark: SparkSession, path: str) -> bool:
    """Whether some line holds an odd number of quotes, so that a quoted cell goes on behind its end."""
    v = F.col("value")
    return not spark.read.text(path).where((F.length(v) - F.length(F.replace(v, F.lit('"'), F.lit("")))) % 2 == 1).isEmpty()


#: Where cp1252 differs from ISO 8859-1: the latter's control characters and what stands there in the former.
_ODD = {chr(i): bytes([i]).decode("cp1252", errors="ignore") for i in range(0x80, 0xA0)}
_ODD_FROM, _ODD_TO = "".join(k for k, v in _ODD.items() if v), "".join(_ODD.values())


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, header: bool = True) -> DataFrame:
    """Delimited files of one form with every cell as text; encoding and delimiter are found from the first lines where they aren't given. A file is cut
    into tasks unless quoted cells span lines or its characters have two bytes or four."""
    if encoding is None or delimiter is None:
        head = _head(spark, path)
        encoding = encoding or encoding_of(head)
        if delimiter is None:
            sample = head.decode(encoding, errors="ignore")
            delimiter = spark.range(1).select(delimiter_of(F.lit(sample))).first()[0]
    plain = {"utf-8-sig": "UTF-8", "cp1252": "ISO-8859-1"}.get(encoding, encoding.replace("-le", "LE").replace("-be", "BE"))
    whole = encoding.startswith(("utf-16", "utf-32")) or _quotes_span_lines(spark, path)
    df = spark.read.csv(path, sep=delimiter, encoding=plain, header=header, inferSchema=False, multiLine=whole, quote='"', escape='"')
    if encoding != "cp1252":
        return df
    return df.select(*[F.translate(f"`{c}`", _ODD_FROM, _ODD_TO).alias(c.translate(str.maketrans(_ODD_FROM, _ODD_TO))) for c in df.columns])


def decoded(content: Column) -> Column:
    """Bytes as text: by their mark, else as UTF-8 if they are, else as cp1252."""
    rest = lambda n: F.substring(content, F.lit(n + 1), F.length(content))
    starts = lambda mark: F.substring(content, F.lit(1), F.lit(len(mark))) == F.lit(mark)
    out = F.when(starts(codecs.BOM_UTF8), rest(3).cast("string"))
    for mark, name in ((codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF16_BE, "UTF-16BE")):
        out = out.when(starts(mark), F.decode(rest(len(mark)), name))
    plain = content.cast("string")
    return out.when(F.is_valid_utf8(plain), plain).otherwise(F.translate(F.decode(content, "ISO-8859-1"), _ODD_FROM, _ODD_TO))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files, in any of the encodings tried."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))


def cells(df: DataFrame, columns: list[str] | None = None, row: str = "row") -> DataFrame:
    """(row, col, header, address, text) of every cell that isn't blank; ``row`` is a column that numbers the rows from 0."""
    names = [c for c in df.columns if c != row]
    kept = [(i, c) for i, c in enumerate(names) if columns is None or c in columns]
    every = F.array(*[F.struct(F.lit(i).alias("col"), F.lit(c).alias("header"), F.col(f"`{c}`").cast("string").alias("text")) for i, c in kept])
    out = df.select(row, F.explode(every).alias("c")).select(row, "c.*").where(F.trim("text") != "")
    return out.withColumn("address", F.concat(F.lit("R"), (F.col(row) + 1).cast("string"), F.lit("C"), (F.col("col") + 1).cast("string")))


def with_replaced_cells(df: DataFrame, replacements: DataFrame, row: str = "row") -> DataFrame:
    """``df`` with the cells of ``replacements`` (row, col, replacement) put in; one join, whatever their number."""
    names = [c for c in df.columns if c != row]
    by_row = replacements.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("col", "replacement"))).alias("_r"))
    joined = df.join(by_row, row, "left")
    return joined.select(row, *[F.coalesce(F.try_element_at("_r", F.lit(i)), F.col(f"`{c}`").cast("string")).alias(c) for i, c in enumerate(names)])


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", encoding: str = "UTF-8") -> None:
    df.write.csv(path, sep=delimiter, encoding=encoding, header=True, quote='"', escape='"')


def file_kind(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def valid_file(path: Column, length: Column) -> Column:
    """Empty if a file may be read, else the reason."""
    return (
        F.when(~file_kind(path).isin(*KINDS), "kind not allowed").when(length > MOST_BYTES, "too large").when(length == 0, "empty")
        .when(path.contains(".."), "path leads upwards").otherwise("")
    )


def safe_name(name: Column) -> Column:
    """A file name without separators, control bytes, reserved characters and outer dots or spaces, of 255 characters at most."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[/\\]", "_"), r"\x00", ""), r"^[. ]+|[. ]+$", "")
    out = F.regexp_replace(out, r'[<>:"|?*]', "_")
    ext = F.regexp_extract(out, r"[^.](\.[^.]*)$", 1)
    cut = F.concat(F.left(out, F.lit(255) - F.length(ext)), ext)
    out = F.when(F.length(out) > 255, cut).otherwise(out)
    return F.when(out == "", "unnamed_file").otherwise(out)


def valid_text(text: Column, most: int = 10_000) -> Column:
    return (F.length(text) <= most) & ~text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def open_archive(data: bytes) -> zipfile.ZipFile:
    """A zip archive that is no bomb."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    unpacked = sum(i.file_size for i in archive.infolist())
    if len(archive.infolist()) > MOST_ENTRIES or unpacked > MOST_UNPACKED or (data and unpacked / len(data) > MOST_RATIO):
        raise ValueError("the archive unpacks to more than is safe")
    return archive


def parse_xml(data: bytes) -> ElementTree.Element:
    """XML without document type and entity declarations, within the size limit."""
    if len(data) > MOST_XML:
        raise ValueError("the XML is too large")
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("declarations are not allowed")
    return ElementTree.fromstring(data)


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _sheet_pieces(archive: zipfile.ZipFile) -> Iterator[dict]:
    names = archive.namelist()
    shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in parse_xml(archive.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    for part in _numbered(names, r"xl/worksheets/sheet(\d+)\.xml"):
        for cell in parse_xml(archive.read(part)).iter(f"{_S}c"):
            value, inline = cell.find(f"{_S}v"), "".join(t.text or "" for t in cell.iter(f"{_S}t"))
            text = shared[int(value.text)] if cell.get("t") == "s" and value is not None else inline or (value.text if value is not None else "") or ""
            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
            col = 0
            for c in letters:
                col = col * 26 + ord(c) - 64
            if text.strip():
                yield {"part": part, "kind": "formula" if cell.find(f"{_S}f") is not None else "cell", "row": int(row) - 1, "col": col - 1, "address": cell.get("r"), "text": text}
    yield from _comments(archive, r"xl/comments\d*\.xml", f"{_S}comment", f"{_S}t", "ref")


def _comments(archive: zipfile.ZipFile, pattern: str, tag: str, text: str, place: str) -> Iterator[dict]:
    """Comments of sheets and documents, with the cell or number that they belong to."""
    for part in (n for n in archive.namelist() if re.fullmatch(pattern, n)):
        for i, comment in enumerate(parse_xml(archive.read(part)).iter(tag)):
            if found := "".join(t.text or "" for t in comment.iter(text)):
                yield {"part": part, "kind": "comment", "block": i, "address": comment.get(place), "text": found}


def _word_pieces(archive: zipfile.ZipFile) -> Iterator[dict]:
    """Runs: body paragraphs, then table cells, then headers and footers."""

    def runs(part: str, kind: str, block: int, p, **where) -> Iterator[dict]:
        for i, run in enumerate(p.iter(f"{_W}r")):
            if text := "".join(t.text or "" for t in run.iter(f"{_W}t")):
                yield {"part": part, "kind": kind, "block": block, "run": i, "text": text} | where

    body = parse_xml(archive.read("word/document.xml")).find(f"{_W}body")
    block = 0
    for p in body.findall(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        yield from runs("word/document.xml", "heading" if style is not None and style.get(f"{_W}val", "").lower().startswith(("heading", "title")) else "paragraph", block, p)
        block += 1
    for table in body.findall(f"{_W}tbl"):
        for r, row in enumerate(table.findall(f"{_W}tr")):
            for c, cell in enumerate(row.findall(f"{_W}tc")):
                for p in cell.findall(f"{_W}p"):
                    yield from runs("word/document.xml", "cell", block, p, row=r, col=c)
                    block += 1
    for part in _numbered(archive.namelist(), r"word/(?:header|footer)(\d+)\.xml"):
        for p in parse_xml(archive.read(part)).iter(f"{_W}p"):
            yield from runs(part, "margin", block, p)
            block += 1
    yield from _comments(archive, r"word/comments\.xml", f"{_W}comment", f"{_W}t", f"{_W}id")


def _slide_pieces(archive: zipfile.ZipFile) -> Iterator[dict]:
    """Paragraph texts of shapes with their boxes, table cells, and notes."""
    for kind, pattern in (("shape", r"ppt/slides/slide(\d+)\.xml"), ("note", r"ppt/notesSlides/notesSlide(\d+)\.xml")):
        for part in _numbered(archive.namelist(), pattern):
            tree = parse_xml(archive.read(part))
            for block, shape in enumerate(tree.iter(f"{_P}sp")):
                off, ext = shape.find(f".//{_A}off"), shape.find(f".//{_A}ext")
                box = {"x": int(off.get("x")), "y": int(off.get("y")), "width": int(ext.get("cx")), "height": int(ext.get("cy"))} if off is not None and ext is not None else {}
                title = shape.find(f".//{_P}ph")
                named = "title" if kind == "shape" and title is not None and title.get("type") in ("title", "ctrTitle") else kind
                for run, p in enumerate(shape.iter(f"{_A}p")):
                    if text := "".join(t.text or "" for t in p.iter(f"{_A}t")):
                        yield {"part": part, "kind": named, "block": block, "run": run, "text": text} | box
            for row, tr in enumerate(tree.iter(f"{_A}tr")):
                for col, tc in enumerate(tr.findall(f"{_A}tc")):
                    if text := "".join(t.text or "" for t in tc.iter(f"{_A}t")):
                        yield {"part": part, "kind": "cell", "row": row, "col": col, "text": text}


_READERS = {"xlsx": _sheet_pieces, "docx": _word_pieces, "pptx": _slide_pieces}
_PIECE_FIELDS = [f.split()[0] for f in PIECES.split(", ")]
_PIECE_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}


def office_pieces(files: DataFrame) -> DataFrame:
    """Text pieces of office documents; ``files`` has path and content, as ``binaryFile`` reads them. Broken or unsafe files give one piece of kind
    ``error``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [_PIECE_TYPES[f.split()[1]] for f in PIECES.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                kind = posixpath.splitext(path)[1].lower().lstrip(".")
                try:
                    pieces = list(_READERS[kind](open_archive(content.as_py()))) if kind in _READERS else []
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as error:
                    pieces = [{"kind": "error", "text": str(error)}]
                yield pa.RecordBatch.from_arrays([pa.array([path if f == "path" else p.get(f) for p in pieces], k) for f, k in zip(_PIECE_FIELDS, kinds, strict=True)], _PIECE_FIELDS)

    return files.select("path", "content").mapInArrow(read, PIECES)


def inventory(pieces: DataFrame) -> DataFrame:
    """Per document and part: how many cells, formulas, paragraphs, headings, comments and other pieces, the last row and column, and characters."""
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return pieces.groupBy("path", "part").agg(
        n("cell").alias("cells"), n("formula").alias("formulas"), n("paragraph").alias("paragraphs"), n("heading", "title").alias("headings"), n("comment").alias("comments"), n("shape", "note").alias("shapes"), n("error").alias("errors"),
        F.max("row").alias("last_row"), F.max("col").alias("last_col"), F.sum(F.length("text")).alias("characters"),
    )


def replaced_in_archive(content: bytes, replacements: dict[str, str], clear_metadata: bool = False) -> bytes:
    """An office document with every value replaced wherever the runs of a paragraph or a cell's text hold it, the longest value first. The
    first run that a value touches takes the replacement, so the style there stays."""
    order = sorted(replacements, key=len, reverse=True)
    out = io.BytesIO()
    with open_archive(content) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in old.infolist():
            data = old.read(info.filename)
            if re.fullmatch(r"(word|ppt|xl)/.*\.xml", info.filename):
                tree = parse_xml(data)
                groups = [list(p.iter(f"{ns}t")) for ns, box in ((_W, "p"), (_A, "p"), (_S, "si"), (_S, "is")) for p in tree.iter(f"{ns}{box}")]
                if any([_replace(g, replacements, order) for g in groups]):
                    data = ElementTree.tostring(tree, encoding="utf-8", xml_declaration=True)
            elif clear_metadata and info.filename == "docProps/core.xml":
                tree = parse_xml(data)
                for child in list(tree):
                    child.text = ""
                data = ElementTree.tostring(tree, encoding="utf-8", xml_declaration=True)
            new.writestr(info, data)
    return out.getvalue()


def _replace(runs: list, replacements: dict[str, str], order: list[str]) -> bool:
    changed = False
    for value in order:
        start = 0
        while value and (at := "".join(r.text or "" for r in runs).find(value, start)) >= 0:
            begin, left, first = 0, len(value), True
            for run in runs:
                text = run.text or ""
                lo, hi = max(at - begin, 0), min(at + len(value) - begin, len(text))
                if lo < hi:
                    run.text = text[:lo] + (replacements[value] if first else "") + text[hi:]
                    first, left = False, left - (hi - lo)
                begin += len(text)
            start = at + len(replacements[value])
            changed = True
    return changed


def protect_office(files: DataFrame, replacements: DataFrame, clear_metadata: bool = False) -> DataFrame:
    """(path, content): documents with the values of ``replacements`` (path, value, replacement) replaced; others unchanged."""
    by_path = replacements.groupBy("path").agg(F.collect_list(F.struct("value", "replacement")).alias("_r"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                new = replaced_in_archive(content.as_py(), {r["value"]: r["replacement"] for r in wanted or []}, clear_metadata)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([new], pa.binary())], ["path", "content"])

    return files.select("path", "content").join(by_path, "path", "left").mapInArrow(write, "path string, content binary")
