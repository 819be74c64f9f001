"""Delimited files as they come: forms, row numbers, cells, and the bytes given back."""

import csv
import io
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veilspark.sources import delimited

TEXTS = {
    "utf-8": "Zoë 漢字, naïve", "utf-8-sig": "naïve façade", "cp1252": "façade – “thé” très élégant à Noël, über Größe", "cp1250": "Łódź, Gdańsk i Kraków: zażółć gęślą jaźń, příliš žluťoučký kůň",
    "utf-16-le": "naïve 漢字", "utf-16-be": "naïve 漢字", "utf-32-le": "漢字", "utf-32-be": "é",
}
MARKS = {"utf-8-sig": "", "utf-16-le": "﻿", "utf-16-be": "﻿", "utf-32-le": "﻿", "utf-32-be": "﻿"}


@pytest.mark.parametrize("encoding", TEXTS)
def test_encodings(encoding):
    data = (MARKS.get(encoding, "") + f"nama;kota\n{TEXTS[encoding]};x\n" * 30).encode(encoding)
    assert delimited.encoding_by_bytes(data) == encoding
    if encoding.startswith(("utf-16", "utf-32")):  # without a mark
        assert delimited.encoding_by_bytes("nama;kota Zürich\n".encode(encoding) * 9) == encoding
    assert delimited.encoding_by_bytes(b"") == "utf-8" and delimited.encoding_by_bytes("aé".encode()[:-1], whole=False) == "utf-8"


def test_delimiters():
    assert [delimited.delimiter_by_lines(t) for t in ("a,b\n1,2", "a;b\n1,5;2,5\n3;4", "a\tb\tc\n1\t2\t3", "a|b", "none", "", '"a,b";c\n"d,e,f";g')] == [",", ";", "\t", "|", ",", ",", ";"]


def made(r, delimiter, end, feed, rows):
    """A file's rows and its text."""
    table = [[f"h{k}" for k in range(4)]]
    for n in range(rows):
        kinds = ["plain", "", " ", f"x{delimiter}y", 'say "hi"', "two\nlines", "é ü", f"n{n}", 'a""b', "\n\n"]
        table.append([r.choice(kinds) if k else f"r{n}" for k in range(r.choice([4, 4, 4, 3, 5]))])
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator=end).writerows(table)
    text = out.getvalue()
    return table, text if feed else text.removesuffix(end)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r, root, tables = random.Random(3), tmp_path_factory.mktemp("csv"), {}
    forms = [("utf-8", ",", "\n", True), ("utf-8-sig", ";", "\r\n", False), ("cp1252", "\t", "\n", False), ("utf-16-le", "|", "\n", True), ("utf-8", ";", "\r\n", True), ("utf-16-be", ",", "\n", False), ("utf-8-sig", ",", "\n", True)]
    for n, (encoding, delimiter, end, feed) in enumerate(forms):
        table, text = made(r, delimiter, end, feed, 20 if n else 4_000)
        (root / f"f{n}.csv").write_bytes((MARKS.get(encoding, "") + text).encode(encoding))
        tables[f"f{n}.csv"] = (table, encoding, delimiter)
    (root / "empty.csv").write_bytes(b"")
    (root / "stray.csv").write_bytes(b'size,name\n5" pipe,x\n6" pipe,"y"\n')
    tables["stray.csv"] = ([["size", "name"], ['5" pipe', "x"], ['6" pipe', "y"]], "utf-8", ",")
    return root, tables


@pytest.fixture
def small_blocks(spark):
    """A file of some hundred kilobytes is read by many tasks."""
    names = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_rows_and_cells(spark, folder, small_blocks):
    root, tables = folder
    rows = delimited.read_rows(spark, str(root))
    forms = {(x.path.rsplit("/", 1)[1], x.encoding, x.delimiter) for x in rows.select("path", "encoding", "delimiter").distinct().collect()}
    assert forms == {(n, e, d) for n, (_, e, d) in tables.items()}
    assert delimited.file_blocks(spark, str(root / "f0.csv"))[0].count() > 20
    numbers = defaultdict(list)
    for x in rows.select("path", "row").collect():
        numbers[x.path.rsplit("/", 1)[1]].append(x.row)
    assert {n: sorted(v) for n, v in numbers.items()} == {n: list(range(len(t))) for n, (t, _, _) in tables.items()}
    got = {(x.path.rsplit("/", 1)[1], x.row, x.col, x.key_label, x.is_value_of_key, x.address, x.text) for x in delimited.cells_of_rows(rows).collect()}
    want = set()
    for name, (table, _, _) in tables.items():
        for r, cells in enumerate(table[1:], 1):
            for c, text in enumerate(cells):
                if text.strip():
                    label = table[0][c] if c < len(table[0]) else None
                    want.add((name, r, c, label, label is not None, f"R{r + 1}C{c + 1}", text))
    assert got == want


def content(rows):
    out = defaultdict(bytes)
    for x in delimited.file_contents(rows, 700).orderBy("path", "part").collect():
        out[x.path.rsplit("/", 1)[1]] += x.content
    return out


def test_files_are_given_back(spark, folder, small_blocks):
    """Read, number, replace, write: the file byte for byte, but for the cells."""
    root, tables = folder
    rows = delimited.read_rows(spark, str(root))
    same = content(rows)
    assert {n: same[n] == (root / n).read_bytes() for n in tables} == dict.fromkeys(tables, True)
    cells = delimited.cells_of_rows(rows).where("col = 1 and row % 3 = 1")
    new = cells.select("path", "row", "col", F.concat(F.lit('[[T;,|\t"'), F.col("row"), F.lit("]] é")).alias("replacement"))
    after = content(delimited.replaced_rows(rows, new))
    for name, (table, encoding, delimiter) in tables.items():
        text = after[name].decode(encoding).removeprefix("﻿")
        want = [[f'[[T;,|\t"{r}]] é' if c == 1 and r % 3 == 1 and r and x.strip() else x for c, x in enumerate(cells)] for r, cells in enumerate(table)]
        assert list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)) == want, name
    # a row that nothing is put into keeps its bytes
    lines = {(x.path, x.row): x.line for x in rows.collect()}
    assert all(lines[x.path, x.row] == x.line for x in delimited.replaced_rows(rows, new).where("row % 3 <> 1").collect())
