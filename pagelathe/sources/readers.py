"""Readers: JSON facts, review logs, directories of resources, imported files, table listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str, version: int | None = None, version_column: str = "schema_version") -> DataFrame:
    """JSON objects, one a file; an unreadable file fails the query, and so does a version other than the one asked for."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if version is None:
        return df
    wrong = F.raise_error(F.concat(F.lit("unsupported schema version: "), F.coalesce(F.col(version_column).cast("string"), F.lit("none"))))
    return df.withColumn(version_column, F.when(F.col(version_column) == version, F.col(version_column)).otherwise(wrong.cast("int")))


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines. Events carry their own seq, for the order of lines isn't kept; a broken line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def stream_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same log as a stream: each file of lines once, as it is appended."""
    return spark.readStream.schema(schema).option("mode", "FAILFAST").json(path)


def list_resources(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All JSON resources below a folder, with the file each came from, in the order of their paths."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return df.select("*", F.col("_metadata.file_path").alias("resource_path")).orderBy("resource_path")


def overlay(runtime: DataFrame, versioned: DataFrame, key: str) -> DataFrame:
    """Union in which a runtime row hides the versioned rows of its key; unsorted."""
    both = runtime.withColumn("_rank", F.lit(0)).unionByName(versioned.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(key).orderBy("_rank"))
    return both.withColumn("_n", first).filter("_n = 1").drop("_n", "_rank")


def import_files(files: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files: path, content (as binaryFile gives them). New documents by content hash, one for equal contents, and the known ones that were offered again."""
    hashed = files.select("path", F.sha2("content", 256).alias("content_hash"), F.length("content").cast("long").alias("size_bytes"))
    one = hashed.groupBy("content_hash").agg(F.min("path").alias("path"), F.min("size_bytes").alias("size_bytes"))
    new = one.join(documents, "content_hash", "left_anti").withColumn("filename", F.substring_index("path", "/", -1))
    new = new.withColumn("source_path", F.concat(F.lit("documents/"), F.col("content_hash"), F.lit("/source.pdf")))
    return new, documents.join(one.select("content_hash"), "content_hash", "left_semi")


def table_counts(spark: SparkSession, pattern: str = "*", views: list[str] | None = None) -> DataFrame:
    """Rows of each table of the catalog that fits the pattern (or of the named views), in one query."""
    names = views or sorted(t.name for t in spark.catalog.listTables(pattern=pattern))
    counts = [spark.table(n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in names]
    out = spark.createDataFrame([], "table_name string, n_rows bigint")
    for c in counts:
        out = out.unionByName(c)
    return out


def lookup(df: DataFrame, **keys) -> DataFrame:
    """At most one row by its key; the filter reaches the scan."""
    for k, v in keys.items():
        df = df.filter(F.col(k) == v)
    return df.limit(1)


def locate(resources: DataFrame, wanted: DataFrame, key: str, home: str = "case_id") -> DataFrame:
    """wanted: key. Where each lies: outcome found (with home), missing, or conflict where more than one home holds it."""
    held = resources.groupBy(key).agg(F.countDistinct(home).alias("_n"), F.min(home).alias(home))
    df = wanted.select(key).distinct().join(held, key, "left")
    outcome = F.when(F.coalesce("_n", F.lit(0)) == 0, "missing").when(F.col("_n") > 1, "conflict").otherwise("found")
    return df.select(key, F.when(F.col("_n") == 1, F.col(home)).alias(home), outcome.alias("outcome"))


def sql(spark: SparkSession, text: str, **values) -> DataFrame:
    """A parameterised statement."""
    return spark.sql(text, args=values)
