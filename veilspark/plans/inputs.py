"""Inputs derived from the driver's tables, by SQL that both engines understand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.recognizers import PROVINCES

#: The province codes in a row, two digits each.
PROVINCE_TEXT = "".join(PROVINCES)
AS_OF = "2024-06-15"
KEY = bytes(range(32))

#: Texts with identity numbers made from keys, right and wrong ones, with and without labels: (id, text).
NIK = f"""
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'NIK: ' WHEN 1 THEN 'Nomor KK: ' WHEN 2 THEN 'kode ' ELSE 'kartu keluarga - ' END ||
  CASE WHEN o_orderkey % 11 = 0 THEN '20' ELSE substr('{PROVINCE_TEXT}', CAST(o_custkey % 38 AS INT) * 2 + 1, 2) END ||
  CASE WHEN o_orderkey % 5 = 0 THEN '.' ELSE '' END || lpad(CAST(o_custkey % 80 AS STRING), 2, '0') || CASE WHEN o_orderkey % 5 = 0 THEN '.' ELSE '' END || lpad(CAST(o_orderkey % 40 AS STRING), 2, '0') ||
  lpad(CAST(o_orderkey % 75 AS STRING), 2, '0') || lpad(CAST(o_custkey % 14 AS STRING), 2, '0') || lpad(CAST((o_orderkey + o_custkey) % 100 AS STRING), 2, '0') ||
  lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || ' selesai' AS text FROM orders"""
NPWP = """
SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'NPWP: ' WHEN 1 THEN 'wajib pajak ' ELSE 'ref ' END ||
  lpad(CAST(CASE WHEN c_custkey % 4 = 0 THEN 40 ELSE c_custkey % 33 END AS STRING), 2, '0') || '.' || lpad(CAST(c_custkey * 7 % 1000 AS STRING), 3, '0') || '.' ||
  lpad(CAST(c_custkey * 13 % 1000 AS STRING), 3, '0') || '.' || CAST(c_custkey % 10 AS STRING) || '-' || lpad(CAST(c_custkey % 900 AS STRING), 3, '0') || '.' ||
  lpad(CAST(c_custkey % 7 AS STRING), 3, '0') || CASE WHEN c_custkey % 6 = 1 THEN CAST(c_custkey % 10 AS STRING) ELSE '' END || ' ok' AS text FROM customer"""
PHONE = """
SELECT c_custkey AS id, CASE c_custkey % 6
  WHEN 0 THEN 'hp 08' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || '-' || lpad(CAST(c_custkey * 7 % 10000 AS STRING), 4, '0') || '-' || lpad(CAST(c_custkey * 3 % 10000 AS STRING), 4, '0')
  WHEN 1 THEN 'wa +62 8' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || ' ' || lpad(CAST(c_custkey * 7 % 10000 AS STRING), 4, '0') || ' ' || lpad(CAST(c_custkey * 3 % 1000 AS STRING), 3, '0')
  WHEN 2 THEN 'kantor (021) ' || lpad(CAST(c_custkey * 7 % 10000 AS STRING), 4, '0') || '-' || lpad(CAST(c_custkey * 3 % 10000 AS STRING), 4, '0')
  WHEN 3 THEN 'kantor 0' || CAST(c_custkey % 90 + 10 AS STRING) || '-' || lpad(CAST(c_custkey * 7 % 1000 AS STRING), 3, '0') || '-' || lpad(CAST(c_custkey * 3 % 1000 AS STRING), 3, '0')
  WHEN 4 THEN 'nomor 081' || lpad(CAST(c_custkey * 17 % 100000000 AS STRING), 8, '0') ELSE 'tanpa nomor ' || CAST(c_custkey AS STRING) END || ' .' AS text FROM customer"""
BPJS = """
SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'No. BPJS ' WHEN 1 THEN 'peserta JKN: ' ELSE 'kode ' END ||
  CASE WHEN s_suppkey % 7 = 0 THEN '1111111111111' WHEN s_suppkey % 5 = 0 THEN '0123456789012' WHEN s_suppkey % 4 = 0 THEN lpad(CAST(s_suppkey % 1000 AS STRING), 4, '0') || '-' || lpad(CAST(s_suppkey * 3 % 10000 AS STRING), 4, '0') || '-12345'
  ELSE CAST(s_suppkey % 9 AS STRING) || lpad(CAST(s_suppkey * 97 % 1000000 AS STRING), 12, '4') END || ' aktif' AS text FROM supplier"""
BIRTH = """
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Tanggal lahir: ' WHEN 1 THEN 'Budi Santoso, ' WHEN 2 THEN 'lahir di sebuah kota yang jauh sekali dari sini, ' ELSE 'tanggal ' END ||
  CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey % 32 AS STRING) || '/' || CAST(o_custkey % 13 AS STRING) || '/' || CAST(1915 + o_orderkey % 112 AS STRING)
  WHEN 1 THEN CAST(1915 + o_orderkey % 112 AS STRING) || '-' || lpad(CAST(o_custkey % 14 AS STRING), 2, '0') || '-' || lpad(CAST(o_orderkey % 32 AS STRING), 2, '0')
  ELSE lpad(CAST(o_orderkey % 32 AS STRING), 2, '0') || '-' || CASE o_custkey % 5 WHEN 0 THEN 'Jan' WHEN 1 THEN 'Agustus' WHEN 2 THEN 'mei' WHEN 3 THEN 'Foo' ELSE 'Feb' END || '-' || CAST(1915 + o_orderkey % 112 AS STRING) END || ' tercatat' AS text FROM orders"""
CARD = """
SELECT o_orderkey AS id, 'kartu ' || CASE o_orderkey % 4
  WHEN 0 THEN '4' || lpad(CAST(o_custkey * 31 % 1000 AS STRING), 3, '0') || '-' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || '-1111-' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0')
  WHEN 1 THEN '5' || CAST(o_custkey % 7 AS STRING) || lpad(CAST(o_orderkey % 1000000 AS STRING), 14, '0')
  WHEN 2 THEN lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || ' 2222 3333-' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0')
  ELSE lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || ' 2222 3333 ' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') END || ' habis' AS text FROM orders"""
PERSON = """
SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'Nama: ' || x || ' ' || y || chr(10) || 'Alamat: kota' WHEN 1 THEN '[EMR-' || CAST(c_custkey AS STRING) || '] ' || x || ' ' || y || ' | laki-laki'
  WHEN 2 THEN '{"nama_pasien": "' || x || ' ' || y || '", "n": 1}' WHEN 3 THEN 'hari ini pasien ' || x || ' kontrol' ELSE 'tidak ada ' || x END AS text
FROM (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'Budi' WHEN 1 THEN 'Siti' WHEN 2 THEN 'Agus' WHEN 3 THEN 'Dewi' WHEN 4 THEN 'Demam' WHEN 5 THEN 'Rina' ELSE 'Joko' END AS x,
  CASE c_custkey % 6 WHEN 0 THEN 'Santoso' WHEN 1 THEN 'Rahayu' WHEN 2 THEN 'Wijaya' WHEN 3 THEN 'Batuk' WHEN 4 THEN 'Lestari' ELSE 'Kota' END AS y FROM customer) AS c"""
LICENCE = """
SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'SIM A ' WHEN 1 THEN 'no paspor ' WHEN 2 THEN 'surat izin mengemudi ' ELSE 'catatan ' END || CASE WHEN s_suppkey % 4 IN (0, 2) THEN
  CASE WHEN s_suppkey % 6 = 0 THEN '777777777777' ELSE lpad(CAST(s_suppkey * 7919 % 1000000 AS STRING), 13, '5') END
  ELSE substr('ABCDMNPXZQ', CAST(s_suppkey % 10 AS INT) + 1, 1) || CASE WHEN s_suppkey % 9 = 0 THEN '1234567' ELSE lpad(CAST(s_suppkey * 37 % 10000000 AS STRING), 7, '6') END END || ' berlaku' AS text FROM supplier"""
#: Findings made from lineitem: (segment_id, finding_id, entity_type, start_pos, end_pos, value, score, recognizer).
FINDINGS = """
SELECT l_orderkey AS segment_id, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS finding_id,
  CASE l_partkey % 6 WHEN 0 THEN 'ID_NIK' WHEN 1 THEN 'EMAIL_ADDRESS' WHEN 2 THEN 'PERSON' WHEN 3 THEN 'CREDIT_CARD' WHEN 4 THEN 'PHONE_NUMBER' ELSE 'CUSTOM' END AS entity_type,
  CAST(l_linenumber * 4 + l_partkey % 3 AS BIGINT) AS start_pos, CAST(l_linenumber * 4 + l_partkey % 3 + 2 + l_suppkey % 9 AS BIGINT) AS end_pos,
  'v' || CAST(l_partkey % 50 AS STRING) AS value, CAST(30 + (l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 71 AS DOUBLE) / 100 AS score, CASE l_suppkey % 2 WHEN 0 THEN 'regex' ELSE 'ner' END AS recognizer FROM lineitem"""


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the tables of ``sf_dir`` that it names."""
    names = [t for t in ("lineitem", "orders", "customer", "supplier", "documents", "pages", "events", "conversations", "part", "nation", "region") if f" {t}" in sql]
    for t in names:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}} AS {t}")
    sql = sql.replace("{\"", "{{\"").replace("\"}", "\"}}") if "{\"" in sql else sql
    sql = sql.replace(", \"n\": 1}", ", \"n\": 1}}")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})
