"""A guard over a stream of texts: bursts collapse to their last text, which is scanned, judged and shown redacted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import length_bucket, splice
from ..operators import classify, recognizers, resolve

#: What stands for detected values, quiet time of a burst, the size from which a text is refused, and scans a second.
LABELS = {
    "ID_NIK": "NIK", "ID_NPWP": "NPWP", "ID_KK": "KK", "ID_PHONE": "PHONE", "ID_BPJS": "BPJS", "PHONE_NUMBER": "PHONE", "EMAIL_ADDRESS": "EMAIL", "CREDIT_CARD": "CARD", "IBAN_CODE": "IBAN", "IP_ADDRESS": "IP",
    "URL": "URL", "PERSON": "NAME", "DATE_OF_BIRTH": "DOB", "DATE": "DATE", "MEDICAL_RECORD": "MEDICAL_ID", "MEDICAL_INFO": "MEDICAL_INFO", "ADDRESS": "ADDRESS",
}
QUIET, HARD_LIMIT, SCANS_A_SECOND = "250 milliseconds", 512 * 1024, 4


def replacement(entity: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, f"[{v}_REDACTED]")])
    return F.coalesce(F.try_element_at(known, entity), F.lit("[REDACTED]"))


def debounce(texts: DataFrame, source: str = "source", quiet: str = QUIET, late: str = "10 seconds") -> DataFrame:
    """The last text of each burst of a source (source, ts, text): a burst ends when nothing came for ``quiet``. Batch or stream."""
    watched = texts.withWatermark("ts", late) if texts.isStreaming else texts
    burst = F.session_window("ts", quiet)
    last = watched.groupBy(F.col(source), burst).agg(F.max_by("text", F.struct("ts", "text")).alias("text"), F.max("ts").alias("ts"), F.count("*").alias("events"))
    return last.select(source, "ts", "text", "events")


def without_own_writes(texts: DataFrame, writes: DataFrame, source: str = "source", seconds: int = 2) -> DataFrame:
    """Texts but for the first echo of each own write (source, ts, text) within ``seconds``."""
    own = writes.select(F.col(source).alias("_s"), F.col("ts").alias("_w"), F.sha2(F.col("text").cast("binary"), 256).alias("_f"))
    keyed = texts.withColumn("_fp", F.sha2(F.col("text").cast("binary"), 256))
    near = (F.col("ts") >= F.col("_w")) & (F.col("ts") <= F.col("_w") + F.expr(f"INTERVAL {seconds} SECONDS"))
    echo = keyed.join(own, (F.col(source) == F.col("_s")) & (F.col("_fp") == F.col("_f")) & near)
    first = echo.groupBy("_s", "_w", "_f").agg(F.min("ts").alias("_t")).select("_s", "_f", "_t").distinct()
    met = keyed.join(first, (F.col(source) == F.col("_s")) & (F.col("_fp") == F.col("_f")) & (F.col("ts") == F.col("_t")), "left")
    # of rows with one text and time the first by their other columns is the echo
    turn = F.row_number().over(Window.partitionBy(source, "_fp", "ts").orderBy(*texts.columns))
    return met.withColumn("_n", turn).where(F.col("_t").isNull() | (F.col("_n") > 1)).select(*texts.columns)


def judge(texts: DataFrame, as_of: str, key: str = "id", text: str = "text") -> DataFrame:
    """(key, status, risk, findings, redacted, bucket) of each text: refused above the hard limit, else scanned, its overlaps decided by
    severity, its risk judged and its findings replaced by labels."""
    refused = F.octet_length(text) > HARD_LIMIT
    found = recognizers.scan(texts.where(~refused).select(key, text), as_of, text)
    kept = resolve.by_severity(found.withColumn("severity", classify.severity(F.col("entity_type"))), key)
    rank = F.array_position(F.array(*map(F.lit, classify.SEVERITIES)), F.col("severity")) - 1
    one = F.struct("start_pos", "end_pos", replacement(F.col("entity_type")).alias("replacement"))
    whole = kept.groupBy(key).agg(F.collect_list(one).alias("_e"), F.count("*").alias("findings"), F.max(rank).alias("_max"), F.count_if(rank >= 1).alias("_n"))
    level = F.when((F.col("_max") == 1) & (F.col("_n") >= 2), 2).otherwise(F.col("_max"))
    whole = whole.withColumn("risk", F.upper(F.element_at(F.array(*map(F.lit, classify.SEVERITIES)), (level + 1).cast("int"))))
    joined = texts.join(whole, key, "left")
    out = F.when(refused, None).when(F.col("_e").isNull(), F.col(text)).otherwise(splice(F.col(text), F.col("_e")))
    return joined.select(
        key, F.when(refused, "refused").otherwise("scanned").alias("status"), F.when(~refused, F.coalesce("risk", F.lit("LOW"))).alias("risk"), F.coalesce("findings", F.lit(0)).cast("long").alias("findings"),
        out.alias("redacted"), length_bucket(F.length(text)).alias("bucket"),
    )


def guard(stream: DataFrame, as_of: str, sink, checkpoint: str, source: str = "source", live: bool = False):
    """Start the guard on a stream (source, ts, text): each micro-batch of finished bursts is judged and handed to ``sink(df, batch_id)``. A live guard
    goes on until it is stopped, at most SCANS_A_SECOND batches a second; else it works through what is there and ends."""

    def judged(batch: DataFrame, number: int) -> None:
        ids = batch.withColumn("id", F.concat_ws("|", source, F.col("ts").cast("string")))
        sink(judge(ids, as_of).join(ids.select("id", source, "ts"), "id"), number)

    how = {"processingTime": f"{1000 // SCANS_A_SECOND} milliseconds"} if live else {"availableNow": True}
    return debounce(stream, source).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**how).foreachBatch(judged).start()
