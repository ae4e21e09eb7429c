"""Artifacts and manifests: registering, listing and verifying files by their hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelathe.functions.ids import digest, is_safe_relative, mime_of
from pagelathe.sources import storage


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files below a root: path relative to it, sha256, size_bytes, mime_type, and error where one can't be read. Files of any size are hashed as streams."""
    df = storage.hash_files(storage.list_files(spark, root, glob))
    base = storage.qualified(spark, root).rstrip("/")
    path = F.substring("path", F.lit(len(base) + 2), F.length("path"))
    return df.select(path.alias("path"), "sha256", "size_bytes", mime_of(path).alias("mime_type"), "error")


def store_bucketed(artifacts: DataFrame, table: str, key: str, buckets: int) -> None:
    """Append artifacts to a table in buckets of the key, so that what is registered later meets it without moving it."""
    artifacts.write.mode("append").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def register_bucketed(spark: SparkSession, table: str, new: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key (not null) the bucketed table doesn't hold, one a key: only the new rows are shuffled, to the table's buckets."""
    told = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Num Buckets'").first()
    if told is None:
        raise ValueError(f"{table} has no buckets")
    # Dealt as the table is: left to itself, a join with fewer buckets than shuffle partitions would move the table.
    rows = new.filter(F.col(key).isNotNull()).repartition(int(told["data_type"]), key).dropDuplicates([key])
    return rows.join(spark.table(table).select(key).hint("merge"), key, "left_anti")


def register_absent(artifacts: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("document_id", "kind", "path", "run_id")) -> DataFrame:
    """Rows of new that artifacts doesn't hold yet (null equals null), one a key; unsafe paths are refused."""
    known = artifacts.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    path = F.when(is_safe_relative(F.col("path")), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("path leaves its root: "), F.col("path"))).cast("string")) if "path" in keys else None
    rows = new.dropDuplicates(list(keys)).join(known, same, "left_anti")
    return rows.withColumn("path", path) if path is not None else rows


def build_manifest(files: DataFrame, assets: DataFrame, runs: DataFrame) -> DataFrame:
    """One manifest a run. files: run_id, path, sha256, size_bytes, mime_type; assets: run_id, kind, path, …, metadata; runs: run_id, document_hash, page_numbers, provider."""
    by_path = lambda df, cols, name: df.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("path", *[c for c in cols if c != "path"]))).alias(name))
    f = by_path(files, ("path", "sha256", "size_bytes", "mime_type"), "files")
    # Maps don't sort: an asset's metadata travels as JSON.
    a = by_path(assets.withColumn("metadata", F.to_json("metadata")), ("path", "kind", "sha256", "size_bytes", "mime_type", "metadata"), "shared_assets")
    df = runs.join(f, "run_id", "left").join(a, "run_id", "left")
    return df.select(F.lit(2).alias("schema_version"), "run_id", "document_hash", F.size("page_numbers").alias("page_count"), F.array_sort("page_numbers").alias("page_numbers"), "provider", F.coalesce("files", F.array()).alias("files"), F.coalesce("shared_assets", F.array()).alias("shared_assets"))


def manifest_hash(manifests: DataFrame) -> DataFrame:
    """A digest of a manifest's content without the run that made it: equal for equal replays."""
    body = F.to_json(F.struct("schema_version", "document_hash", "page_count", "page_numbers", F.transform("files", lambda x: F.struct(x["path"], x["sha256"])), F.transform("shared_assets", lambda x: F.struct(x["path"], x["sha256"]))))
    return manifests.select("run_id", F.sha2(body, 256).alias("manifest_hash"))


def verify(entries: DataFrame, actual: DataFrame, *keys: str) -> DataFrame:
    """entries: keys, path, sha256; actual: keys, path, sha256. State of each entry: ok, missing, mismatch or unsafe."""
    a = actual.groupBy(*keys, "path").agg(F.max("sha256").alias("_actual"))
    df = entries.join(a, [*keys, "path"], "left")
    state = F.when(~is_safe_relative(F.col("path")), "unsafe").when(F.col("_actual").isNull(), "missing").when(~F.col("_actual").eqNullSafe(F.col("sha256")), "mismatch").otherwise("ok")
    return df.withColumn("state", state).drop("_actual")


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """Files and shared assets of manifests of either version (the first has no assets)."""
    files = manifests.select("run_id", F.lit("file").alias("part"), F.explode("files").alias("f")).select("run_id", "part", "f.path", "f.sha256")
    assets = manifests.select("run_id", F.lit("asset").alias("part"), F.explode("shared_assets").alias("f")).select("run_id", "part", "f.path", "f.sha256")
    return files.unionByName(assets)


def asset_conflicts(assets: DataFrame) -> DataFrame:
    """Pages whose shared image isn't the same everywhere."""
    return assets.groupBy("document_id", "page_no").agg(F.countDistinct("content_hash").alias("n")).filter("n > 1").select("document_id", "page_no")


def unique_paths(artifacts: DataFrame, path: str = "path", key: str = "snapshot_id", place: Column | None = None) -> DataFrame:
    """Relative paths made unique: a later one of the same name gets its place in front, as it is written by place: whole, in four digits at least."""
    shown = F.format_string("%04d", "pos") if place is None else place
    w = Window.partitionBy(key, "_name").orderBy("pos")
    df = artifacts.withColumn("_name", F.substring_index(path, "/", -1)).withColumn("_n", F.row_number().over(w))
    return df.withColumn("snapshot_path", F.when(F.col("_n") == 1, F.col("_name")).otherwise(F.concat(shown, F.lit("-"), "_name"))).drop("_name", "_n")


def first_file(files: DataFrame, kind: str, page_no: int | None = None) -> DataFrame:
    """The first manifest entry of a kind (and page), by place."""
    df = files.filter((F.col("kind") == kind) & (F.coalesce("page_no", F.lit(-1)) == (-1 if page_no is None else page_no)))
    return df.orderBy("pos").limit(1)


def pages_are_contiguous(pages: DataFrame, key: str = "run_id") -> DataFrame:
    """Whether a run's page numbers are exactly 1 to their count."""
    n = F.count("page_no")
    return pages.groupBy(key).agg((F.coalesce(F.min("page_no") == 1, F.lit(False)) & (F.max("page_no") == n) & (F.countDistinct("page_no") == n)).alias("contiguous"))


def row_id(*parts: str):
    return digest(*[F.col(p) for p in parts], digits=32)
