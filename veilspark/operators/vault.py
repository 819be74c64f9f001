"""A vault of tokens that lasts: a table in a folder, cut into buckets by the first digits of the keyed hash, to which runs add.

A token is made from the digits of its value's hash, so only tokens of the same bucket can clash: a run reads the buckets of its own values and no other, and writes new rows into those.
Rows count once the log names them. An entry of the log is a file that is created only if it isn't there, so of two runs that began from one state the second finds the first's
entry; if they touched a bucket in common, it starts again from the new state, and no value gets two tokens, no token two values.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import value_hmac
from .protect import assign_tokens

ROWS = "entity_type string, hmac string, token string"


class VaultChangedError(RuntimeError):
    """Another run has written into a bucket that this one read."""


class Vault:
    """The vault in the folder ``path``, which all machines share; ``digits`` of the hash name a bucket (16 ** digits of them), the same for all runs."""

    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        self.spark, self.path, self.digits = spark, path.rstrip("/"), digits
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._files = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._lines = jvm.org.apache.commons.io.IOUtils

    def _entry(self, number: int):
        return self._at(f"{self.path}/log/{number:09d}.json")

    def log(self) -> list[dict]:
        """Its entries in order: {"commit", "buckets", "rows"}. One small file a run."""
        out: list[dict] = []
        while self._files.exists(self._entry(len(out))):
            stream = self._files.open(self._entry(len(out)))
            out.append(json.loads(self._lines.toString(stream, "UTF-8")))
            stream.close()
        return out

    def read(self, buckets: list[str] | None = None, log: list[dict] | None = None) -> DataFrame:
        """(entity_type, hmac, token) of the wanted buckets, of all by default. Folders of other buckets aren't even listed."""
        log = self.log() if log is None else log
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.path}/data/commit={e['commit']}/bucket={b}" for e in log for b in e["buckets"] if wanted is None or b in wanted]
        return self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)

    def tokens(self, values: DataFrame, key: bytes, attempts: int = 5) -> DataFrame:
        """(entity_type, normalised, hmac, token, is_new) for the distinct values of ``values`` (entity_type, value): those of the vault, and new ones, which are in the vault when this
        returns; ``is_new`` is false then for all. Null and repeated values as in ``assign_tokens``; no values write nothing."""
        hashed = values.select(F.left(value_hmac(F.col("entity_type"), F.col("value"), key), F.lit(self.digits)).alias("bucket"))
        touched = sorted(r[0] for r in hashed.where("bucket is not null").distinct().collect())  # at most 16 ** digits
        for _ in range(attempts):
            log = self.log()
            try:
                self._add(assign_tokens(values, key, self.read(touched, log)), touched, len(log))
            except VaultChangedError:
                continue
            return assign_tokens(values, key, self.read(touched))
        raise VaultChangedError(f"{attempts} times another run wrote into the same buckets first")

    def _add(self, tokens: DataFrame, touched: list[str], version: int) -> None:
        """Write the new rows of ``tokens``, made from the vault's state ``version``, and name them in the log, unless an entry since then is about one of the buckets ``touched``."""
        commit = uuid.uuid4().hex
        folder = f"{self.path}/data/commit={commit}"
        new = tokens.where("is_new").select("entity_type", "hmac", "token", F.left("hmac", F.lit(self.digits)).alias("bucket"))
        new.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        found = self.spark.read.schema(f"{ROWS}, bucket string").parquet(folder).groupBy("bucket").count().collect() if self._has_buckets(folder) else []
        rows = {r["bucket"]: r["count"] for r in found}
        try:
            if rows:
                self._commit({"commit": commit, "buckets": sorted(rows), "rows": sum(rows.values())}, touched, version)
        except VaultChangedError:
            self._files.delete(self._at(folder), True)
            raise
        if not rows:
            self._files.delete(self._at(folder), True)

    def _has_buckets(self, folder: str) -> bool:
        return any(x.isDirectory() for x in self._files.listStatus(self._at(folder)))

    def _commit(self, entry: dict, touched: list[str], version: int) -> None:
        number = version
        while True:
            for later in self.log()[number:]:
                number += 1
                if set(later["buckets"]) & set(touched):
                    raise VaultChangedError
            try:
                stream = self._files.create(self._entry(number), False)
            except Exception as e:
                if "already exists" in str(e).lower() or "FileAlreadyExists" in str(e):
                    continue
                raise
            stream.write(bytearray(json.dumps(entry).encode()))
            stream.close()
            return
