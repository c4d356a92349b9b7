"""Sinks: deduplicated appends, snapshots, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append_new(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key neither stands in old nor came before in new. Keys compare without underscores."""
    plain = F.regexp_replace(F.col(key), "_", "")
    new = new.withColumn("_k", plain).dropDuplicates(["_k"])
    if old is not None:
        new = new.join(old.select(plain.alias("_k")).distinct(), "_k", "left_anti")
    return new.drop("_k")


def write_by_source(rows: DataFrame, path: str) -> None:
    """One folder per source file, replaced as a whole."""
    rows.repartition("source_file").write.mode("overwrite").partitionBy("source_file").json(path)


def keep_newest(files: DataFrame, name: str, keep: int) -> DataFrame:
    """The listing without the newest `keep` names."""
    w = Window.orderBy(F.desc(name))
    return files.withColumn("_place", F.row_number().over(w)).where(F.col("_place") > keep).drop("_place")


def snapshot(rows: DataFrame, root: str, version: int) -> str:
    """A table version as a folder of its own; readers go on with the one before."""
    path = f"{root}/v{version:08d}"
    rows.write.parquet(path)
    return path


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """K4."""
    return rows.join(ids, key, "left_anti")


def expired(rows: DataFrame, updated: str, cutoff: int) -> DataFrame:
    """K5: rows with a known time before the cutoff."""
    return rows.where(F.col(updated).isNotNull() & (F.col(updated) < cutoff))


def retention_cutoff(now: int, days: int) -> int:
    """K6: midnight (UTC seconds) of the first of the last `days` days, today included."""
    return now - now % 86_400 - (days - 1) * 86_400


def orphans(files: DataFrame, references: DataFrame, key: str, changed: str, cutoff: int) -> DataFrame:
    """Files that nothing refers to and that are older than the cutoff."""
    return files.where(F.col(changed) < cutoff).join(references.select(key), key, "left_anti")


def pruned(rows: DataFrame, updated: str, cutoff: int, files: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Without rows updated before the cutoff (an unknown time stays), nor rows whose file is gone."""
    kept = rows.where(F.col(updated).isNull() | (F.col(updated) >= cutoff))
    return kept if files is None else kept.join(files.select(key), key, "left_semi")


def canvases_to_delete(files: DataFrame, folder: str, changed: str, name: str, active: DataFrame, cutoff: int, keep: int = 15) -> DataFrame:
    """Of each folder with more than `keep` canvases the oldest expired ones, so that `keep` stay; an active one is never deleted."""
    rows = files.join(active.select(folder, name).withColumn("_active", F.lit(True)), [folder, name], "left").withColumn("_total", F.count("*").over(Window.partitionBy(folder)))
    old = rows.where((F.col("_total") > keep) & F.col("_active").isNull() & (F.col(changed) < cutoff))
    place = F.row_number().over(Window.partitionBy(folder).orderBy(changed, name))
    return old.withColumn("_place", place).where(F.col("_place") <= F.col("_total") - keep).drop("_place", "_total", "_active")


def backups_to_drop(files: DataFrame, base: str, name: str, keep: int) -> DataFrame:
    """All but the newest `keep` copies of each base, by name."""
    place = F.row_number().over(Window.partitionBy(base).orderBy(F.desc(name)))
    return files.withColumn("_place", place).where(F.col("_place") > keep).drop("_place")
