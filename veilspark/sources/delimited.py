"""Folders of delimited files as they come: each file with its own encoding and delimiter, its rows numbered, and its bytes given back but for the cells that change.

Files are read twice, in blocks, by as many tasks as there are blocks. The first pass tells of each block how many rows end in it and whether it ends inside a quoted cell, for
either way in which it may begin, and of each file its beginning; block after block follow the row and the state with which each begins. The second pass cuts rows. A row that lies over blocks comes in parts, which meet by its
number. Delimiters and quotes are single bytes in all encodings read this way; files in UTF-16 or UTF-32 are read whole, a file a row.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import DELIMITERS, MARKS

#: Bytes of a file's beginning by which its form is judged, and lines of it by which its delimiter is.
HEAD_BYTES, HEAD_LINES = 65_536, 10
#: Letters beyond ASCII that are frequent in languages written in each single-byte encoding; the first encoding wins ties.
LETTERS = {
    "cp1252": "äöüßÄÖÜéèàçùâêîôûëïœñáíóúãõåæøÉÈÀÇÑÅØ«»€“”‘’–—…",
    "cp1250": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻčďěňřšťůýžČĎĚŇŘŠŤŮÝŽőűŐŰäöüß„”’–…",
    "iso-8859-15": "äöüßÄÖÜéèàçùâêîôûëïœñáíóúãõåæøÉÈÀÇÑÅØ«»€šž",
}
TABLE = "path string, row long, line binary, encoding string, delimiter string, feed boolean"


def encoding_by_bytes(head: bytes, whole: bool = True) -> str:
    """The encoding of a file that begins with ``head``: by its mark, by zero bytes in every second or fourth place, as UTF-8 if it is (but for a character that the end cuts,
    unless ``whole``), else the single-byte encoding in which most of its high bytes are frequent letters and fewest are controls or unassigned."""
    for mark, name in MARKS[1:3] + MARKS[:1] + MARKS[3:]:  # the longer marks of UTF-32 before those of UTF-16
        if head.startswith(mark):
            return name
    zeros = [head[k::4].count(0) / max(1, len(head[k::4])) for k in range(4)]
    if len(head) >= 8 and max(zeros) > 0.5:
        first, second = zeros[0] > 0.5, zeros[1] > 0.5
        if sum(z > 0.5 for z in zeros) == 3:
            return "utf-32-be" if first else "utf-32-le"
        if first != second:
            return "utf-16-be" if first else "utf-16-le"
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head, final=whole)
        return "utf-8"
    except UnicodeDecodeError:
        pass

    def score(name: str) -> int:
        letters = head.decode(name, errors="replace")
        beyond = [c for c in letters if ord(c) > 127]
        return sum(1 if c in LETTERS[name] else -4 if c == "�" or "\x80" <= c < "\xa0" else 0 for c in beyond)

    return max(LETTERS, key=score)


def delimiter_by_lines(text: str) -> str:
    """The delimiter with the greatest mean count a line over 1 + variance, outside quotes, of the first lines; a comma if none occurs."""
    lines = [re.sub(r'"[^"]*"', "", x) for x in text.split("\n")[:HEAD_LINES] if x.strip()]

    def score(d: str) -> float:
        counts = [x.count(d) for x in lines]
        mean = sum(counts) / len(counts)
        return mean / (1 + sum((c - mean) ** 2 for c in counts) / len(counts))

    best = max(DELIMITERS, key=lambda d: score(d) if lines else 0.0)
    return best if lines and score(best) > 0 else ","


def form_of(head: bytes, whole: bool) -> tuple[str, str]:
    """(encoding, delimiter) of a file by its beginning."""
    encoding = encoding_by_bytes(head, whole)
    return encoding, delimiter_by_lines(head.decode(encoding, errors="replace"))


#: A quote opens a cell where a line begins or behind a delimiter; the next one that isn't doubled closes it.
_OPEN, _CLOSE = re.compile(rb'(?:^|[,;\t|])"'), re.compile(rb'(?:[^"]+|"")*"(?!")')


def inside_after(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell goes on behind a line that begins ``inside`` one, or not."""
    if b'"' not in line:
        return inside
    closed = _CLOSE.match(line) if inside else None
    if inside and not closed:
        return True
    at = closed.end() if closed else 0
    while opened := _OPEN.search(line, at):
        closed = _CLOSE.match(line, opened.end())
        if not closed:
            return True
        at = closed.end()
    return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as bytes without their line feed (the reader drops a mark of UTF-8), in the order of their block."""
    m = F.col("_metadata")
    return spark.read.text(path, lineSep="\n").select(m["file_path"].alias("path"), m["file_block_start"].alias("block"), m["file_size"].alias("size"), F.col("value").cast("binary").alias("line"))


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, size, bytes, out, out_rows, in, in_rows, head) of each block: whether it ends inside a quoted cell and how many rows end in it, if it begins outside one and if it
    begins inside."""
    names = ["path", "block", "size", "bytes", "out", "out_rows", "in", "in_rows", "head"]
    kinds = [pa.string(), *[pa.int64()] * 3, pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
    now: list = []
    head = bytearray()

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([*now, bytes(head)], kinds, strict=True)], names)

    for batch in batches:
        for path, block, size, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now[:2] != [path, block]:
                if now:
                    yield told()
                now, head = [path, block, size, 0, False, 0, True, 0], bytearray()
            now[3] += len(line) + 1
            for state in (4, 6):
                now[state] = inside_after(line, now[state])
                now[state + 1] += not now[state]
            if block == 0 and len(head) < HEAD_BYTES:
                head += line[:HEAD_BYTES] + b"\n"
    if now:
        yield told()


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, row, part, line): rows of each block; ``part`` is the block for the pieces of a row that goes over its block's end or began before it, else null."""
    names, kinds = ["path", "row", "part", "line"], [pa.string(), pa.int64(), pa.int64(), pa.binary()]
    now, row, inside, held, torn = None, 0, False, [], False
    out: list[tuple] = []
    for batch in batches:
        for path, block, first, begins_inside, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (path, block):
                if held:
                    out.append((now[0], row, now[1], b"\n".join(held)))
                now, row, inside, held, torn = (path, block), first, begins_inside, [], begins_inside
            held.append(line)
            inside = inside_after(line, inside)
            if not inside:
                out.append((path, row, block if torn else None, b"\n".join(held)))
                row, held, torn = row + 1, [], False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((now[0], row, now[1], b"\n".join(held)), kinds, strict=True)], names)


def file_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, block, first_row, inside) of every block of the files at ``path``, and (path, encoding, delimiter, feed) of every file; ``feed``: it ends with a line feed."""
    blocks = _lines(spark, path).mapInArrow(_first_pass, "path string, block long, size long, bytes long, out boolean, out_rows long, in boolean, in_rows long, head binary")

    @F.udf("struct<encoding:string,delimiter:string>")
    def form(head, size):  # once for each file
        return form_of(bytes(head), size <= len(head) + len(codecs.BOM_UTF8))

    # what a block ends with follows from what it begins with, block after block; a file has as many blocks as its bytes fill
    one = F.struct("block", "out", "out_rows", "in", "in_rows", "bytes", "size", "head")
    files = blocks.groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("all"))

    def step(acc: Column, x: Column) -> Column:
        told = F.struct(x["block"].alias("block"), acc["row"].alias("first_row"), acc["inside"].alias("inside"))
        rows = F.when(acc["inside"], x["in_rows"]).otherwise(x["out_rows"])
        return F.struct((acc["row"] + rows).alias("row"), F.when(acc["inside"], x["in"]).otherwise(x["out"]).alias("inside"), F.array_append(acc["blocks"], told).alias("blocks"))

    start = F.struct(F.lit(0).cast("long").alias("row"), F.lit(False).alias("inside"), F.array().cast("array<struct<block:bigint,first_row:bigint,inside:boolean>>").alias("blocks"))
    placed = files.select("path", F.explode(F.aggregate("all", start, step, lambda acc: acc["blocks"])).alias("b")).select("path", "b.*")
    # lines and the feeds behind them are as long as the file, or one byte longer; a mark that the reader dropped makes them three shorter
    short = F.get("all", F.lit(0))["size"] - F.aggregate("all", F.lit(0).cast("long"), lambda acc, x: acc + x["bytes"])
    formed = files.select("path", form(F.get("all", F.lit(0))["head"], F.get("all", F.lit(0))["size"]).alias("f"), short.alias("short"))
    encoding = F.when((F.col("f.encoding") == "utf-8") & (F.col("short") >= 2), "utf-8-sig").otherwise(F.col("f.encoding"))
    return placed, formed.select("path", encoding.alias("encoding"), "f.delimiter", F.col("short").isin(0, 3).alias("feed"))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, line, encoding, delimiter, feed) of every row of the delimited files at ``path``, whatever their number and form: ``row`` counts a file's rows from 0, the heading
    included, and ``line`` is the row's bytes without mark and without the line feed that ends it (a carriage return stays).

    Empty files give no rows. A cell whose quote is never closed takes in all that follows, as it would for any reader.
    """
    blocks, forms = file_blocks(spark, path)
    # a file's first block begins with row 0, outside quotes: only blocks further on need be told, and of those there are as many as the files' bytes fill
    later = blocks.where("block > 0").select(F.col("path").alias("_p"), F.col("block").alias("_b"), "first_row", F.col("inside").alias("begins_inside"))
    met = _lines(spark, path).join(F.broadcast(later), (F.col("path") == F.col("_p")) & (F.col("block") == F.col("_b")), "left")
    placed = met.select("path", "block", F.coalesce("first_row", F.lit(0)).alias("first_row"), F.coalesce("begins_inside", F.lit(False)).alias("begins_inside"), "line")
    rows = placed.mapInArrow(_second_pass, "path string, row long, part long, line binary")
    torn = rows.where("part is not null").groupBy("path", "row").agg(F.array_sort(F.collect_list(F.struct("part", "line"))).alias("all"))
    joined = F.aggregate("all", F.lit(None).cast("binary"), lambda acc, x: F.when(acc.isNull(), x["line"]).otherwise(F.concat(acc, F.lit(b"\n"), x["line"])))
    whole = rows.where("part is null").select("path", "row", "line").unionByName(torn.select("path", "row", joined.alias("line")))
    wide = F.col("encoding").rlike("^utf-(16|32)")
    of_file = forms.withColumnRenamed("path", "_p")
    bytewise = whole.join(of_file.where(~wide), F.col("path") == F.col("_p"))
    return bytewise.select("path", "row", "line", "encoding", "delimiter", "feed").unionByName(_read_wide(spark, path, of_file.where(wide)))


def _read_wide(spark: SparkSession, path: str, forms: DataFrame) -> DataFrame:
    """Rows of files whose characters have two bytes or four; each is decoded whole, and its lines are UTF-8 until they are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, encoding, delimiter in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = content.decode(encoding, errors="replace").removeprefix("\ufeff")
                rows, inside, held = [], False, []
                for line in text.removesuffix("\n").encode().split(b"\n") if text else []:
                    held.append(line)
                    inside = inside_after(line, inside)
                    if not inside:
                        rows.append(b"\n".join(held))
                        held = []
                rows += [b"\n".join(held)] if held else []
                n = len(rows)
                columns = [pa.array([name] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(rows, pa.binary()), *[pa.array([x] * n, pa.string()) for x in (encoding, delimiter)], pa.array([text.endswith("\n")] * n, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "row", "line", "encoding", "delimiter", "feed"])

    content = spark.read.format("binaryFile").load(path).select(F.col("path").alias("_path"), "content")
    # only wide files are opened: a name that isn't wanted never has its content read twice
    wanted = content.join(forms, F.regexp_replace(F.col("_path"), "^file:/+", "/") == F.regexp_replace(F.col("_p"), "^file:/+", "/")).select(F.col("_p").alias("path"), "content", "encoding", "delimiter")
    return wanted.mapInArrow(run, TABLE)


def _cells_of(line: bytes, delimiter: bytes) -> list[bytes]:
    """The cells of a row as they stand, with their quotes; joined by the delimiter they are the row."""
    if b'"' not in line:
        return line.split(delimiter)
    cells, held = [], []
    for part in line.split(delimiter):
        # what a part closes was opened by the first of those held, or by itself
        closed = not _CLOSE.match(part) if held else part[:1] == b'"' and not _CLOSE.match(part, 1)
        held.append(part)
        if not closed:
            cells.append(delimiter.join(held))
            held = []
    return cells + ([delimiter.join(held)] if held else [])


def _value(raw: bytes, encoding: str) -> str:
    text = raw.decode(encoding, errors="replace")
    return text[1:].removesuffix('"').replace('""', '"') if text[:1] == '"' else text


def _raw(value: str, delimiter: str, encoding: str) -> bytes:
    quoted = '"' + value.replace('"', '""') + '"' if any(c in value for c in (delimiter, '"', "\n", "\r")) else value
    return quoted.encode(encoding, errors="replace")


def _plain(encoding: str) -> str:
    """The encoding of a row's bytes, whose mark stands before the first row only."""
    return "utf-8" if encoding.startswith("utf-") else encoding


def _body(line: bytes) -> tuple[bytes, bytes]:
    """A row's cells and the carriage return behind them."""
    return (line[:-1], b"\r") if line.endswith(b"\r") else (line, b"")


def cells_of_rows(rows: DataFrame) -> DataFrame:
    """(path, row, col, key_label, is_value_of_key, address, text) of every cell below the heading that isn't blank; ``key_label`` is the name at the head of its column, null beyond
    the last and where it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, row, line, encoding, delimiter in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = [_value(c, _plain(encoding)) for c in _cells_of(_body(line)[0], delimiter.encode())]
                out += [(path, row, k, v) for k, v in enumerate(values) if row == 0 or v.strip()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["path", "row", "col", "text"])

    every = rows.select("path", "row", "line", "encoding", "delimiter").mapInArrow(run, "path string, row long, col int, text string")
    heads = every.where("row = 0").groupBy(F.col("path").alias("_p")).agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("_h"))
    met = every.where("row > 0").join(heads, F.col("path") == F.col("_p"), "left")
    label = F.nullif(F.try_element_at("_h", "col"), F.lit(""))
    return met.select("path", "row", "col", label.alias("key_label"), label.isNotNull().alias("is_value_of_key"), F.format_string("R%dC%d", F.col("row") + 1, F.col("col") + 1).alias("address"), "text")


def replaced_rows(rows: DataFrame, replacements: DataFrame) -> DataFrame:
    """``rows`` with the cells of ``replacements`` (path, row, col, replacement) put in, quoted where they must be and in the file's encoding; every other byte stays."""
    by_row = replacements.groupBy(F.col("path").alias("_p"), F.col("row").alias("_r")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int"), "replacement"))).alias("_new"))
    met = rows.join(by_row, (F.col("path") == F.col("_p")) & (F.col("row") == F.col("_r")), "left").select(*rows.columns, F.map_entries("_new").alias("_new"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for line, encoding, delimiter, new in zip(*(batch.column(n).to_pylist() for n in ("line", "encoding", "delimiter", "_new")), strict=True):
                if new:
                    body, end = _body(line)
                    cells = _cells_of(body, delimiter.encode())
                    for x in new:
                        if x["key"] < len(cells) and x["value"] is not None:
                            cells[x["key"]] = _raw(x["value"], delimiter, _plain(encoding))
                    line = delimiter.encode().join(cells) + end
                lines.append(line)
            names = ["path", "row", "line", "encoding", "delimiter", "feed"]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()) if n == "line" else batch.column(n) for n in names], names)

    return met.mapInArrow(run, TABLE)


def file_contents(rows: DataFrame, rows_a_part: int = 100_000) -> DataFrame:
    """(path, part, content): the bytes of each file of ``rows`` in parts that follow each other, in its own encoding and with its own mark and last line feed."""
    last = rows.groupBy(F.col("path").alias("_p")).agg(F.max("row").alias("_last"))
    met = rows.join(last, F.col("path") == F.col("_p"))
    end = F.when((F.col("row") < F.col("_last")) | F.col("feed"), F.lit(b"\n")).otherwise(F.lit(b""))
    parts = met.groupBy("path", "encoding", F.floor(F.col("row") / rows_a_part).alias("part")).agg(F.array_sort(F.collect_list(F.struct("row", F.concat("line", end).alias("line")))).alias("all"))
    joined = F.aggregate("all", F.lit(b""), lambda acc, x: F.concat(acc, x["line"]))
    marked = F.when((F.col("encoding") == "utf-8-sig") & (F.col("part") == 0), F.concat(F.lit(codecs.BOM_UTF8), joined)).otherwise(joined)
    wide = F.col("encoding").rlike("^utf-(16|32)")

    @F.udf("binary")
    def widened(content, encoding, part):
        marks = {name: mark for mark, name in MARKS}
        return (marks[encoding] if part == 0 else b"") + bytes(content).decode("utf-8").encode(encoding)

    narrow = parts.where(~wide).select("path", "part", marked.alias("content"))
    return narrow.unionByName(parts.where(wide).select("path", "part", widened(joined, "encoding", "part").alias("content")))
