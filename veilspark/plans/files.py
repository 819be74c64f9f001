"""Queries of the file helpers."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..sources import delimited as dl
from ..sources import files as f
from .detection import query as _query
from .inputs import derived

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    return _query(name, sql, QUERIES, ORACLES)


SAMPLES = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'a,b,c' || chr(10) || 'd,e,f' || chr(10) || 'x;y,z,w' WHEN 1 THEN 'a;b' || chr(10) || '1,5;2,5' || chr(10) || '3;4' WHEN 2 THEN 'a|b|c' || chr(10) || 'd|e|f' ELSE 'nothing here' END AS sample FROM customer"


def delimiter_sql() -> str:
    arms = []
    for d in (",", ";", "\t", "|"):
        q = f"chr({ord(d)})"
        n = f"list_transform(list_filter(string_split(sample, chr(10)), lambda x: trim(x) <> ''), lambda x: (length(x) - length(replace(x, {q}, '')))::DOUBLE)"
        arms.append(f"list_avg({n}) / (1 + list_var_pop({n}))")
    return f"SELECT id, CASE WHEN m <= 0 THEN ',' WHEN m = a THEN ',' WHEN m = b THEN ';' WHEN m = c THEN chr(9) ELSE '|' END AS delimiter FROM (SELECT *, greatest(a, b, c, e) AS m FROM (SELECT id, {arms[0]} AS a, {arms[1]} AS b, {arms[2]} AS c, {arms[3]} AS e FROM ({SAMPLES}) AS s))"


@query("src02_delimiter", delimiter_sql())
def src02(spark, d):
    return derived(spark, d, SAMPLES).select("id", f.delimiter_of(F.col("sample")).alias("delimiter"))


ROWS = "SELECT c_custkey AS row, c_name, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END AS c_mktsegment FROM customer"


@query("src03_cells", f"SELECT row, col, header, text, 'R' || (row + 1) || 'C' || (col + 1) AS address FROM (SELECT row, 0::INT AS col, 'c_name' AS header, c_name AS text FROM ({ROWS}) AS a UNION ALL SELECT row, 2::INT, 'c_mktsegment', c_mktsegment FROM ({ROWS}) AS b) WHERE trim(text) <> ''")
def src03(spark, d):
    return f.cells(derived(spark, d, ROWS), ["c_name", "c_mktsegment"]).select("row", "col", "header", "text", "address")


@query("snk01_replaced_cells", f"SELECT row, CASE WHEN row % 4 = 0 THEN 'N' || row ELSE c_name END AS c_name, c_nationkey::VARCHAR AS c_nationkey, CASE WHEN row % 6 = 0 THEN 'M' ELSE c_mktsegment END AS c_mktsegment FROM ({ROWS}) AS a")
def snk01(spark, d):
    rows = derived(spark, d, ROWS)
    names = rows.where("row % 4 = 0").select("row", F.lit(0).alias("col"), F.concat(F.lit("N"), F.col("row").cast("string")).alias("replacement"))
    return f.with_replaced_cells(rows, names.unionByName(rows.where("row % 6 = 0").select("row", F.lit(2).alias("col"), F.lit("M").alias("replacement"))))


#: Customers as lines of one file for each nation, delimiters and encodings going by turns: (nation, place, line).
NATION_LINES = """
SELECT c_nationkey AS nation, c_custkey AS place, concat_ws(CASE c_nationkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END, CAST(c_custkey AS STRING), c_name,
  CASE c_custkey % 5 WHEN 0 THEN '"' || c_mktsegment || ', ""é""' || chr(10) || 'dua"' WHEN 1 THEN '' ELSE c_mktsegment || ' é' END) AS line FROM customer
UNION ALL SELECT n_nationkey AS nation, -1 AS place, concat_ws(CASE n_nationkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END, 'id', 'nama', 'segmen') AS line FROM nation"""


def nation_files(spark, d) -> str:
    """The folder of those files, below the shared one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='spark-files-')}"
    path = f"{shared.rstrip('/')}/nations-{uuid.uuid4().hex}"
    lines = derived(spark, d, NATION_LINES)
    raw = F.when(F.col("nation") % 3 == 1, F.encode("line", "ISO-8859-1").cast("string")).otherwise(F.col("line"))
    # each nation's lines meet in one task, which writes one file
    lines.select("nation", "place", raw.alias("line")).repartition("nation").sortWithinPartitions("nation", "place").select("nation", "line").write.partitionBy("nation").text(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def nation_of():
    return F.regexp_extract("path", r"nation=(\d+)", 1).cast("int").alias("nation")


NATION_CELLS = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row FROM customer),
c AS (
  SELECT c_nationkey, row, 0 AS col, 'id' AS key_label, c_custkey::VARCHAR AS text FROM r
  UNION ALL SELECT c_nationkey, row, 1, 'nama', c_name FROM r
  UNION ALL SELECT c_nationkey, row, 2, 'segmen', CASE c_custkey % 5 WHEN 0 THEN c_mktsegment || ', "é"' || chr(10) || 'dua' WHEN 1 THEN '' ELSE c_mktsegment || ' é' END FROM r)"""


@query("src06_cells_of_files", f"{NATION_CELLS} SELECT c_nationkey::INT AS nation, row, col::INT AS col, key_label, true AS is_value_of_key, 'R' || (row + 1) || 'C' || (col + 1) AS address, text FROM c WHERE text <> ''")
def src06_files(spark, d):
    cells = dl.cells_of_rows(dl.read_rows(spark, nation_files(spark, d)))
    return cells.select(nation_of(), "row", "col", "key_label", "is_value_of_key", "address", "text")


@query(
    "src02_forms_of_files",
    """SELECT n_nationkey::INT AS nation, CASE WHEN n_nationkey % 3 = 1 AND n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 5 <> 1) THEN 'cp1252' ELSE 'utf-8' END AS encoding,
CASE n_nationkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END AS delimiter, true AS feed FROM nation""",
)
def src02_files(spark, d):
    return dl.file_blocks(spark, nation_files(spark, d))[1].select(nation_of(), "encoding", "delimiter", "feed")


@query("snk01_rows_given_back", f"{NATION_CELLS} SELECT c_nationkey::INT AS nation, row, col::INT AS col, CASE WHEN col = 1 AND row % 4 = 1 THEN '[[PERSON_' || row || '; \"x\"]]' ELSE text END AS text FROM c WHERE text <> ''")
def snk01_files(spark, d):
    rows = dl.read_rows(spark, nation_files(spark, d))
    new = dl.cells_of_rows(rows).where("col = 1 and row % 4 = 1").select("path", "row", "col", F.concat(F.lit("[[PERSON_"), F.col("row").cast("string"), F.lit('; "x"]]')).alias("replacement"))
    return dl.cells_of_rows(dl.replaced_rows(rows, new)).select(nation_of(), "row", "col", "text")


PATHS = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'a/' || p_name || '.CSV' WHEN 1 THEN 'b/../x.xlsx' WHEN 2 THEN 'c/y.txt' WHEN 3 THEN 'd/z.docx' WHEN 4 THEN 'ohne' ELSE 'e.v2/k.pptx' END AS path, CASE p_partkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 200000000 ELSE p_size END AS length FROM part"
KIND = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"


@query("src17_valid_files", f"SELECT id, {KIND} AS kind, CASE WHEN {KIND} NOT IN ('csv','xlsx','xls','docx','doc','pptx','ppt') THEN 'kind not allowed' WHEN length > 104857600 THEN 'too large' WHEN length = 0 THEN 'empty' WHEN contains(path, '..') THEN 'path leads upwards' ELSE '' END AS problem FROM ({PATHS}) AS p")
def src17(spark, d):
    return derived(spark, d, PATHS).select("id", f.file_kind(F.col("path")).alias("kind"), f.valid_file(F.col("path"), F.col("length")).alias("problem"))


NAMES = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN ' .' || p_name || '?.txt. ' WHEN 1 THEN 'a/b\\c:d' WHEN 2 THEN '...' WHEN 3 THEN repeat('x', 300) || '.csv' ELSE p_name || '<1>|2' END AS name FROM part"


@query("snk06_safe_names", f"SELECT id, CASE id % 5 WHEN 2 THEN 'unnamed_file' WHEN 3 THEN repeat('x', 251) || '.csv' ELSE regexp_replace(trim(regexp_replace(name, '[/\\\\]', '_', 'g'), '. '), '[<>:\"|?*]', '_', 'g') END AS safe FROM ({NAMES}) AS n")
def snk06(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.concat(F.lit(" ."), "p_name", F.lit("?.txt. "))).when(k == 1, F.lit("a/b\\c:d")).when(k == 2, "...").when(k == 3, F.lit("x" * 300 + ".csv")).otherwise(F.concat("p_name", F.lit("<1>|2")))
    return part.select(F.col("p_partkey").alias("id"), f.safe_name(name).alias("safe"))


@query("snk07_valid_text", "SELECT doc_id, length(text) <= 3000 AND NOT regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') AS valid FROM documents")
def snk07(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", f.valid_text(F.col("text"), 3000).alias("valid"))


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_A, _P = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"


def _archive(kind: str, name: str, note: str) -> bytes:
    """A small office document with a name, cut into two runs where the format has runs, and a note as its comment."""
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    cut = name[:9], name[9:]
    parts = {
        "docx": {
            "word/document.xml": f'<w:document xmlns:w="{_W}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>{run("Data")}</w:p><w:p>{run("Nama ")}{run(cut[0])}{run(cut[1])}{run(" ada")}</w:p><w:tbl><w:tr><w:tc><w:p>{run("Kolom")}</w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
            "word/comments.xml": f'<w:comments xmlns:w="{_W}"><w:comment w:id="7"><w:p>{run(note)}</w:p></w:comment></w:comments>',
        },
        "xlsx": {
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_S}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Nama</t></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>{name}</t></is></c><c r="B2"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>',
            "xl/comments1.xml": f'<comments xmlns="{_S}"><commentList><comment ref="A2"><text><t>{note}</t></text></comment></commentList></comments>',
        },
        "pptx": {
            "ppt/slides/slide1.xml": f'<p:sld xmlns:p="{_P}" xmlns:a="{_A}"><p:sp><p:spPr><a:xfrm><a:off x="10" y="20"/><a:ext cx="30" cy="40"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{cut[0]}</a:t></a:r><a:r><a:t>{cut[1]}</a:t></a:r></a:p></p:txBody></p:sp></p:sld>',
        },
    }[kind]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for part, data in parts.items():
            z.writestr(part, data)
    return out.getvalue()


def office_files(spark, d):
    """A document for every customer, of three kinds in turn: (path, content)."""

    @F.pandas_udf("binary")
    def made(kind: pd.Series, name: pd.Series, note: pd.Series) -> pd.Series:
        return pd.Series([_archive(*x) for x in zip(kind, name, note, strict=True)])

    c = spark.read.parquet(f"{d}/customer.parquet")
    kind = F.element_at(F.array(F.lit("docx"), F.lit("xlsx"), F.lit("pptx")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return c.select(F.concat(F.lit("f"), F.col("c_custkey").cast("string"), F.lit("."), kind).alias("path"), made(kind, F.col("c_name"), F.col("c_mktsegment")).alias("content"))


_FILE = "'f' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '.docx' WHEN 1 THEN '.xlsx' ELSE '.pptx' END"


def pieces_sql(name: str) -> str:
    """The pieces of the made documents, where the name reads ``name``."""
    return f"""SELECT {_FILE} AS path, unnest(CASE c_custkey % 3
 WHEN 0 THEN [{{'kind': 'heading', 'text': 'Data'}}, {{'kind': 'paragraph', 'text': 'Nama ' || {name} || ' ada'}}, {{'kind': 'cell', 'text': 'Kolom'}}, {{'kind': 'comment', 'text': c_mktsegment}}]
 WHEN 1 THEN [{{'kind': 'cell', 'text': 'Nama'}}, {{'kind': 'cell', 'text': {name}}}, {{'kind': 'formula', 'text': '2'}}, {{'kind': 'comment', 'text': c_mktsegment}}] ELSE [{{'kind': 'shape', 'text': {name}}}] END, recursive := true) FROM customer"""


def whole_pieces(pieces):
    """Paragraphs of one piece, their runs joined."""
    runs = F.array_sort(F.collect_list(F.struct("run", "text")))
    return pieces.groupBy("path", "part", "kind", "block", "row", "col").agg(F.array_join(F.transform(runs, lambda x: x["text"]), "").alias("text")).select("path", "kind", "text")


@query("src09_office_pieces", pieces_sql("c_name"))
def src09(spark, d):
    return whole_pieces(f.office_pieces(office_files(spark, d)))


@query("src08_inventory", f"SELECT path, count(*) FILTER (kind = 'cell')::BIGINT AS cells, count(*) FILTER (kind = 'formula')::BIGINT AS formulas, count(*) FILTER (kind = 'comment')::BIGINT AS comments, count(*) FILTER (kind = 'heading')::BIGINT AS headings, count(*) FILTER (kind = 'shape')::BIGINT AS shapes, sum(length(text))::BIGINT AS characters FROM ({pieces_sql('c_name')}) AS p GROUP BY 1")
def src08(spark, d):
    counted = f.inventory(f.office_pieces(office_files(spark, d)))
    return counted.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("cells", "formulas", "comments", "headings", "shapes", "characters")])


@query("snk03_protected_office", pieces_sql("'[[PERSON_' || c_custkey || ']]'"))
def snk03(spark, d):
    made = office_files(spark, d)
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name")
    named = made.select("path", F.regexp_extract("path", r"\d+", 0).cast("long").alias("k")).join(c, F.col("k") == F.col("c_custkey"))
    wanted = named.select("path", F.col("c_name").alias("value"), F.concat(F.lit("[[PERSON_"), F.col("k").cast("string"), F.lit("]]")).alias("replacement"))
    return whole_pieces(f.office_pieces(f.protect_office(made, wanted)))
