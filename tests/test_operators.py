"""Behaviour of the detection, protection and file operators on literal texts."""

import io
import json
import os
import re
import sys
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veilspark.functions import text as t
from veilspark.operators import protect, recognizers, recognizers_more, resolve, tables
from veilspark.plans.inputs import AS_OF, KEY
from veilspark.sources import files
from veilspark.streaming import guard

from .conftest import SF


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string")


def found(df):
    return sorted((r.id, r.entity_type, r.start_pos, r.end_pos, r.value) for r in df.collect())


def test_spans_are_those_of_finditer(spark):
    rows = ["", "a@b.co é 😀 x.y@z.org", "x@y.de", "kein", None, "😀😀 q@w.er"]
    want = [(i, "EMAIL_ADDRESS", m.start(), m.end(), m[0]) for i, s in enumerate(rows) if s for m in re.finditer(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", s, re.I)]
    assert found(recognizers.general(texts(spark, *rows), patterns=[recognizers.EMAIL])) == want


@pytest.mark.parametrize(
    ("recognise", "text", "want"),
    [
        (recognizers.nik, "NIK 3174015508900001", [("3174015508900001", 1.0)]),
        (recognizers.nik, "NIK 2074015508900001", []),
        (recognizers.nik, "31.74.01.300290.0001", [("31.74.01.300290.0001", 0.85)]),
        (recognizers.nik, "NIK 3174019913900001", [("3174019913900001", 0.5)]),
        (lambda df: recognizers.kk(df, AS_OF), "Kartu Keluarga 3174010101200001", [("3174010101200001", 0.9)]),
        (recognizers.npwp, "NPWP 01.234.567.8-901.000", [("01.234.567.8-901.000", 0.75)]),
        (recognizers.npwp, "angka 3174015508900001", [("3174015508900001", 0.5)]),
        (recognizers.id_phone, "hp 0812-3456-7890", [("0812-3456-7890", 0.95)]),
        (recognizers.id_phone, "kantor (021) 5555-1234", [("(021) 5555-1234", 1.0)]),
        (recognizers.bpjs, "No BPJS 0001234567890", [("0001234567890", 0.85)]),
        (recognizers.bpjs, "kode 0001234567890", []),
        (lambda df: recognizers.birth_date(df, AS_OF), "Tanggal lahir: 17-Agu-1990", [("17-Agu-1990", 0.95)]),
        (lambda df: recognizers.birth_date(df, AS_OF), "Budi Santoso kunjungan 10/06/2024", []),
        (recognizers.person, "Nama: Budi Santoso\nAlamat", [("Budi Santoso", 0.9)]),
        (recognizers.person, '{"nama_pasien": "Siti Rahayu"}', [("Siti Rahayu", 0.9)]),
        (recognizers.person, "[EMR-1] Agus Wijaya | L", [("Agus Wijaya", 0.85)]),
        (recognizers_more.passport, "paspor A6543219", [("A6543219", 0.85)]),
        (recognizers_more.licence, "SIM A 1234 5678 9012", [("1234 5678 9012", 0.8)]),
    ],
)
def test_recognizers(spark, recognise, text, want):
    got = [(r.value, round(r.score, 6)) for r in recognise(texts(spark, text)).collect()]
    assert got == want


def test_card_groups_need_one_separator(spark):
    got = recognizers.general(texts(spark, "4111 1111 1111 1111 3174-1988-0214 1001 4111-1111-1111-1111"), patterns=recognizers.CARDS)
    assert [r.value for r in got.orderBy("start_pos").collect()] == ["4111 1111 1111 1111", "4111-1111-1111-1111"]


def test_custom_patterns(spark):
    got = found(recognizers.custom(texts(spark, "Nomor RM-2024-000123 dan a.b"), [("rekam medis", "regex", r"RM-\d{4}-\d{6}"), ("titik", "contains", "a.b"), ("kata", "word", "nomor")]))
    assert got == [(0, "KATA", 0, 5, "Nomor"), (0, "REKAM_MEDIS", 6, 20, "RM-2024-000123"), (0, "TITIK", 25, 28, "a.b")]


def test_hmac_equals_the_library(spark):
    import hashlib
    import hmac

    for key in (KEY, b"k" * 100):
        got = spark.range(1).select(t.hmac_sha256(F.lit("EMAIL|é"), key)).first()[0]
        assert got == hmac.new(key, "EMAIL|é".encode(), hashlib.sha256).hexdigest()


def test_token_collisions_get_longer_ids(spark):
    vault = spark.createDataFrame([("AB", "abcdef" + "0" * 58, "[[AB_ABCDEF]]")], "entity_type string, hmac string, token string")
    values = spark.createDataFrame([("AB", f"v{i}") for i in range(3000)], "entity_type string, value string")
    got = protect.assign_tokens(values, KEY, vault).collect()
    assert len({r.token for r in got}) == len(got) == 3000 and all(re.fullmatch(protect.TOKEN, r.token) for r in got)


def test_round_trip(spark):
    docs = texts(spark, "tulis ke a@b.co, atau A@B.co 😀", "tanpa", None)
    spans = recognizers.general(docs, patterns=[recognizers.EMAIL]).withColumn("entity_type", F.lit("EMAIL"))
    tokens = protect.assign_tokens(spans.select("entity_type", "value"), KEY)
    hidden = protect.protect_texts(docs, spans, tokens, "id")
    assert [r.text for r in hidden.where("id = 0").collect()][0].count(tokens.first().token) == 2
    back = protect.restore_texts(hidden, tokens.select("token", F.lit("a@b.co").alias("original")), "id").orderBy("id").collect()
    assert [(r.text, r.restored, r.unresolved) for r in back] == [("tulis ke a@b.co, atau a@b.co 😀", 2, 0), ("tanpa", 0, 0), (None, 0, 0)]
    assert protect.missing_mappings(hidden, tokens.where("false"), "id").count() == 1


def test_merge_strategy_is_refused(spark):
    with pytest.raises(ValueError):
        resolve.by_priority(spark.createDataFrame([], "segment_id long, entity_type string, start_pos long, end_pos long, score double"), strategy="merge")


def test_stream_guard_gives_what_the_batch_gives(spark, tmp_path):
    rows = [("u", f"2024-01-01 00:00:{i // 4:02d}.{i % 4 * 100:03d}", f"hp 0812-3456-{7000 + i}") for i in range(40)] + [("u", "2024-01-01 01:00:00.000", "akhir")]
    df = spark.createDataFrame(rows, "source string, ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    guard.guard(stream, AS_OF, lambda b, n: got.extend(b.select("ts", "risk", "redacted").collect()), f"{tmp_path}/ck").awaitTermination(120)
    bursts = guard.debounce(df).withColumn("id", F.concat_ws("|", "source", F.col("ts").cast("string")))
    want = guard.judge(bursts, AS_OF).join(bursts.select("id", "ts"), "id").where("redacted <> 'akhir'").select("ts", "risk", "redacted").collect()
    assert len(want) == 10 and sorted(map(str, got)) == sorted(map(str, want))


def docx(paragraphs):
    body = "".join("<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in p) + "</w:p>" for p in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Nama</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    return pack({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}{table}</w:body></w:document>'})


def xlsx(cells):
    rows = "".join(f'<c r="{a}" t="inlineStr"><is><t>{v}</t></is></c>' for a, v in cells)
    return pack({"xl/worksheets/sheet1.xml": f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1">{rows}</row></sheetData></worksheet>'})


def pptx(text):
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    box = '<p:spPr><a:xfrm><a:off x="10" y="20"/><a:ext cx="30" cy="40"/></a:xfrm></p:spPr>'
    return pack({"ppt/slides/slide1.xml": f"<p:sld {ns}><p:sp>{box}<p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp></p:sld>"})


def pack(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    made = {"a.docx": docx([["Hubungi a@", "b.co", " segera"], ["lain"]]), "b.xlsx": xlsx([("A1", "Email"), ("AB1", "a@b.co")]), "c.pptx": pptx("a@b.co di sini"), "d.docx": b"broken", "e.docx": pack({"word/document.xml": "<!DOCTYPE x><a/>"})}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    read = spark.read.format("binaryFile").load(str(tmp_path))
    pieces = files.office_pieces(read).withColumn("f", F.substring_index("path", "/", -1)).collect()
    got = {(p.f, p.kind, p.text) for p in pieces}
    assert {("a.docx", "paragraph", "Hubungi a@"), ("a.docx", "cell", "Nama"), ("b.xlsx", "cell", "a@b.co"), ("c.pptx", "shape", "a@b.co di sini")} <= got
    assert {p.f for p in pieces if p.kind == "error"} == {"d.docx", "e.docx"}
    assert next((p.col, p.address) for p in pieces if p.f == "b.xlsx" and p.text == "a@b.co") == (27, "AB1")
    assert next((p.x, p.height) for p in pieces if p.f == "c.pptx") == (10, 40)
    good = read.where("not path like '%d.docx' and not path like '%e.docx'")
    wanted = good.select("path", F.lit("a@b.co").alias("value"), F.lit("[[EMAIL_ABCDEF]]").alias("replacement"))
    again = files.office_pieces(files.protect_office(good, wanted))
    joined = again.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("t")).collect()
    assert all("[[EMAIL_ABCDEF]]" in r.t and "a@" not in r.t for r in joined)


def test_zip_bombs_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "0" * 20_000_000)
    with pytest.raises(ValueError):
        files.open_archive(out.getvalue())


@pytest.mark.parametrize(("encoding", "delimiter"), [("utf-8", ","), ("utf-8-sig", ";"), ("cp1252", "|"), ("utf-16", "\t")])
def test_delimited_files(spark, tmp_path, encoding, delimiter):
    rows = [["Nama", "Kota"], ["Budi é", 'dia "X"'], ["Siti", "b"]]
    path = tmp_path / "x.csv"
    path.write_bytes("\n".join(delimiter.join('"' + c.replace('"', '""') + '"' if '"' in c else c for c in r) for r in rows).encode(encoding))
    assert files.read_delimited(spark, str(path)).collect() == [tuple(r) for r in rows[1:]]


def test_column_profile(spark):
    df = spark.createDataFrame([(f"N{i}", f"317401550890{i:04d}", "teks yang panjang sekali dan bebas tentang banyak hal di dunia ini", json.dumps({"a": i})) for i in range(20)], "nama string, kode string, catatan string, data string")
    got = {r.column_name: (r.suggested_type, r.mode) for r in tables.profile(df).collect()}
    assert got == {"nama": ("PERSON", "full_cell"), "kode": ("ID_NIK", "full_cell"), "catatan": ("TEKS_NARASI", "pii_only"), "data": ("TEKS_NARASI", "pii_only")}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


SQL = {k: v for k, v in entry.oracle_sql().items() if k != "pipeline"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    want = con.sql(SQL[name])
    columns = sorted(want.columns)
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    order = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["sp02_relations", "sp05_value_below"])
def test_every_order_is_a_slide(spark, name):
    from veilspark.plans.context import SHAPES
    from veilspark.plans.inputs import derived

    assert derived(spark, SF, SHAPES).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert len({r.slide % 10 for r in entry.queries()[name](spark, SF).select("slide").distinct().collect()}) == 10


def test_without_the_training_data_operators(tmp_path):
    """With the llm folders, or with the pipeline too, gone the entry still imports and offers all other queries."""
    import shutil
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    said = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and not [n for n in q if n.startswith('op') or n == 'pipeline'] and set(o) <= set(q)"
    for gone in (copy / "veilspark" / "llm", copy / "tests" / "llm"):
        shutil.rmtree(gone)
    # the copy comes first; what this process could import from elsewhere stays importable
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(copy), *[p for p in sys.path if p and os.path.abspath(p) != root]])}
    for _ in range(2):
        subprocess.run([sys.executable, "-c", said], cwd=copy, env=env, check=True, timeout=120)
        listed = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=copy, env=env, capture_output=True, text=True, timeout=200)
        assert listed.returncode == 0, listed.stdout[-2000:]
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)


def test_registry_choice(spark):
    df = spark.createDataFrame([(1, "mail a@b.id, NIK 3171234567890123 nama: Budi Santoso")], "id long, text string")
    kinds = lambda **how: {x.entity_type for x in recognizers.scan(df, "2024-06-15", **how).collect()}
    assert kinds() >= {"EMAIL_ADDRESS", "PERSON"} and kinds(only=["id_person"]) == {"PERSON"} and kinds(entities=["EMAIL_ADDRESS"]) == {"EMAIL_ADDRESS"}


def test_many_matches_in_one_text(spark):
    """Ends of matches are summed part by part beyond 256 of them."""
    from veilspark.functions.text import Pattern, find_spans

    text = "é12 " * 1000
    got = sorted((x.start_pos, x.end_pos) for x in find_spans(spark.createDataFrame([(text,)], "text string"), "text", [Pattern("N", r"\d+", 1.0)]).collect())
    assert got == [(4 * k + 1, 4 * k + 3) for k in range(1000)]


def test_tokens_beside_a_forged_vault(spark):
    """A vault that holds a value's six and eight digits for others: it gets ten."""
    from pyspark.sql import functions as F

    from veilspark.functions.text import value_hmac
    from veilspark.operators import protect

    values = spark.createDataFrame([("PERSON", "Budi"), ("PERSON", "Siti")], "entity_type string, value string")
    h = values.where("value = 'Budi'").select(value_hmac(F.col("entity_type"), F.col("value"), b"k" * 32)).first()[0]
    vault = spark.createDataFrame([("PERSON", "other1", f"[[PERSON_{h[:6].upper()}]]"), ("PERSON", "other2", f"[[PERSON_{h[:8].upper()}]]")], "entity_type string, hmac string, token string")
    got = {x.normalised: x.token for x in protect.assign_tokens(values, b"k" * 32, vault).collect()}
    assert got["budi"] == f"[[PERSON_{h[:10].upper()}]]" and len(set(got.values())) == 2


def test_derived_key_equals_the_library():
    import hashlib

    from veilspark.operators.repositories import derived_key

    key, salt = derived_key("rahasia", b"0" * 16, 1000)
    assert key == hashlib.pbkdf2_hmac("sha256", b"rahasia", b"0" * 16, 1000, 32) and salt == b"0" * 16 and len(derived_key("x", rounds=1)[1]) == 16
