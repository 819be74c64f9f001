"""The stores of projects, files, operations, rules and token mappings as tables, and key derivation."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds and salt of the key derivation.
ROUNDS, SALT_BYTES, KEY_BYTES = 600_000, 16, 32


def projects(table: DataFrame) -> DataFrame:
    """Projects, the one last opened (or else last changed) first."""
    return table.orderBy(F.coalesce("last_opened_at", "updated_at").desc(), "id")


def of_project(table: DataFrame, project: str, order: str, newest: bool = True, limit: int | None = None) -> DataFrame:
    """The rows of a project by time: files and operations newest first, mappings and rules oldest first."""
    out = table.where(F.col("project_id") == project).orderBy(F.desc(order) if newest else F.asc(order), "id")
    return out.limit(limit) if limit is not None else out


def operations(table: DataFrame, project: str, limit: int = 100) -> DataFrame:
    return of_project(table, project, "started_at", limit=limit)


def completed(table: DataFrame, done: DataFrame) -> DataFrame:
    """Operations with the status, time and error of those in ``done`` (id, status, completed_at, error)."""
    new = done.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("status", "completed_at", "error")])
    met = table.join(new, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    return met.select(*[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ("status", "completed_at", "error") else F.col(c) for c in table.columns])


def rules(table: DataFrame, project: str, enabled_only: bool = True) -> DataFrame:
    own = of_project(table, project, "created_at", newest=False)
    return own.where("enabled") if enabled_only else own


def upserted(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with the rows of ``changes`` (same columns) put in: new ones added, known ones replaced."""
    return table.join(changes.select(key), key, "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))


def removed(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(key), key, "left_anti").select(*table.columns)


def mappings_of(table: DataFrame, wanted: DataFrame, *by: str) -> DataFrame:
    """The mappings of a project's wanted hashes (project_id, entity_type, normalized_hmac) or tokens (project_id, token)."""
    return table.join(wanted.select(*by).distinct(), list(by), "left_semi").select(*table.columns)


def exists(table: DataFrame, wanted: DataFrame, *by: str) -> DataFrame:
    """``wanted`` with known: whether a mapping is there."""
    return wanted.join(table.select(*by).distinct().withColumn("known", F.lit(True)), list(by), "left").withColumn("known", F.coalesce("known", F.lit(False)))


def unexpired(table: DataFrame, now: str) -> DataFrame:
    """Mappings but for those whose time is over."""
    return table.where(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now).cast("timestamp")))


def touched(table: DataFrame, used: DataFrame, now: str) -> DataFrame:
    """Mappings with the time of last use of those in ``used`` (id) set."""
    met = table.join(used.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left")
    return met.select(*[F.when(F.col("_id").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col(c)).alias(c) if c == "last_used_at" else F.col(c) for c in table.columns])


def derived_key(password: str, salt: bytes | None = None, rounds: int = ROUNDS) -> tuple[bytes, bytes]:
    """(key, salt) of a password by PBKDF2-SHA-256; on the driver, once a project."""
    salt = os.urandom(SALT_BYTES) if salt is None else salt
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, KEY_BYTES), salt


def unique_names(files: DataFrame, suffix: str = "_protected") -> DataFrame:
    """Output names of files (stem, ext): stem, suffix and ext, with _1, _2, ... behind the suffix where several have one."""
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("stem", "ext").orderBy("id")) - 1
    return files.withColumn("output", F.concat("stem", F.lit(suffix), F.when(turn > 0, F.concat(F.lit("_"), turn.cast("string"))).otherwise(""), "ext"))
