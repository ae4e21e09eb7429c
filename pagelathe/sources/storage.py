"""Files as Spark jobs see them: hashing, copying and storing them in tasks, and publishing what is whole at once.

Tasks open files by pyarrow's file systems (file, hdfs, viewfs, s3, gs), by a URI that the driver has qualified as Spark
would: a path without a scheme is on the default file system, not on an executor's disk. Bytes are streamed in blocks, so
a file of any size takes the memory of one. What a task writes gets its name when it is whole; a task that runs twice, or
on two executors at once, leaves one file.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.functions.ids import is_safe_relative

BLOCK = 1 << 20
#: Bytes of files that a task copies or hashes, where files are no larger.
TASK = 256 << 20
#: How pyarrow names the schemes that Hadoop's connectors go by.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}

_own: list[str] = []
_made: list[tuple[SparkSession, str]] = []


class Damaged(ValueError):
    """Files that aren't what their entries say."""


# --------------------------------------------------------------------- places


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that driver and executors share, spark.checkpoint.dir; where that is unset, a temporary one in local mode. It goes when the process ends."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="pagelathe-"))
        found = _own[0]
    path = f"{found.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            delete(spark, path)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, on the file system where Spark would look for it; signs aren't escaped, as in Spark's own path columns."""
    fs, p = _hadoop(spark, path)
    return fs.makeQualified(p).toString()


def opened(uri: str):
    """pyarrow's file system of a qualified path, and the path there."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    rest = rest if rest.startswith("//") else f"//{rest}"
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{quote(rest, safe='/@:')}")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file with this text in one step; FileExistsError where there is one by that name, which stays as it is."""
    scheme, _, local = qualified(spark, path).partition(":")
    if scheme == "file":
        # A rename replaces what is there without a word; a link doesn't, on a shared mount neither.
        local = "/" + local.lstrip("/")
        os.makedirs(os.path.dirname(local), exist_ok=True)
        whole = f"{local}.{uuid.uuid4().hex}"
        with open(whole, "x") as f:
            f.write(text)
        try:
            os.link(whole, local)
        finally:
            os.remove(whole)
        return
    jvm = spark.sparkContext._jvm
    fs, p = _hadoop(spark, path)
    whole = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(whole, False)
    out.write(bytearray(text.encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(whole), fs.makeQualified(p), none)
    except Exception as e:
        fs.delete(whole, False)
        if fs.exists(p):
            raise FileExistsError(path) from e
        raise


# ---------------------------------------------------------------- file by file


def _hash(source, path: str, to=None) -> tuple[str, int]:
    """SHA-256 and bytes of a file, read once in blocks, which ``to`` gets too."""
    h, n = hashlib.sha256(), 0
    with source.open_input_stream(path, buffer_size=BLOCK) as f:
        while block := f.read(BLOCK):
            h.update(block)
            n += len(block)
            if to is not None:
                to.write(block)
    return h.hexdigest(), n


def _dealt(files: DataFrame, size: str, key: str) -> DataFrame:
    """files dealt over tasks of about TASK bytes."""
    total = files.agg(F.sum(size)).first()[0] or 0
    least = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(max(least, -(-int(total) // TASK)), key)


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path (qualified) and size_bytes of the files below a folder, empty ones too; none is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    names = found.inputFiles()
    found = found.select("path", F.col("length").alias("size_bytes"))
    if len(names) == found.count():
        return found
    # The source passes over empty files.
    every = spark.createDataFrame([(unquote(n).replace("file:///", "file:/", 1),) for n in names], "path string")
    return found.unionByName(every.join(found, "path", "left_anti").withColumn("size_bytes", F.lit(0).cast("long")))


def hash_files(files: DataFrame) -> DataFrame:
    """files: path (qualified), size_bytes; other columns stay. Adds sha256 and error (a file that can't be read has no hash)."""
    if {"sha256", "error"} & {c.lower() for c in files.columns}:
        raise ValueError("files already have a column sha256 or error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for uri in b.column("path").to_pylist():
                try:
                    out.append((_hash(*opened(uri))[0], None))
                except (OSError, ValueError, TypeError, AttributeError) as e:
                    out.append((None, f"{type(e).__name__}: {e}"[:500]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], names=[*b.schema.names, "sha256", "error"])

    schema = ", ".join(f"`{n}` {t}" for n, t in files.dtypes)
    return _dealt(files, "size_bytes", "path").mapInArrow(run, f"{schema}, sha256 string, error string")


def _stored(root: str, by_hash: bool):
    """Copy each entry's source, or its content, below root: by its own path, or by its hash. What was read, and what then lies there."""

    def put(where, base: str, path: str | None, source: str | None, content: bytes | None) -> tuple:
        attempt = f"{base}/.{uuid.uuid4().hex}"
        with where.open_output_stream(attempt, buffer_size=BLOCK) as out:
            if content is not None:
                out.write(content)
                before, n = hashlib.sha256(content).hexdigest(), len(content)
            else:
                before, n = _hash(*opened(source), to=out)
        target = f"{base}/{before[:2]}/{before}" if by_hash else f"{base}/{path}"
        where.create_dir(target.rpartition("/")[0], recursive=True)
        # Under a hash nothing else can lie; elsewhere the root belongs to this attempt alone.
        where.move(attempt, target)
        return before, _hash(where, target)[0], n, target

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = opened(root)
        where.create_dir(base, recursive=True)
        for b in batches:
            out = []
            for path, source, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    out.append((path, *put(where, base, path, source, content), None))
                except (OSError, ValueError, TypeError, AttributeError) as e:
                    out.append((path, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "before", "after", "size_bytes", "stored", "error"])

    return run


STORED = "path string, before string, after string, size_bytes long, stored string, error string"


def _entries(entries: DataFrame) -> DataFrame:
    """path, source, content, in tasks by size."""
    source = F.col("source") if "source" in entries.columns else F.lit(None)
    content = F.col("content") if "content" in entries.columns else F.lit(None)
    size = F.col("size_bytes") if "size_bytes" in entries.columns else F.coalesce(F.length(content.cast("binary")), F.lit(0))
    df = entries.select("path", source.cast("string").alias("source"), content.cast("binary").alias("content"), size.cast("long").alias("_size"))
    return _dealt(df, "_size", "path").drop("_size")


# ------------------------------------------------------- files by their content


def put_objects(entries: DataFrame, index: DataFrame | None, root: str) -> DataFrame:
    """Store files by content: entries (path, and source or content) to root/ab/abcdef..., once for equal contents.

    index: path, sha256 of what is known. Returns a row for each distinct path: path, sha256, size_bytes, and state: new,
    known, conflict (another content under a known path, or several under a new one) or error. Append the new rows to the
    index; a conflict's files lie under their hashes and harm nobody. The rows are written before they are returned.
    """
    spark = entries.sparkSession
    made = shared_path(spark, "objects")
    _entries(entries).mapInArrow(_stored(qualified(spark, root), True), STORED).write.parquet(made)
    rows = spark.read.schema(STORED).parquet(made)
    one = rows.groupBy("path").agg(F.min("before").alias("sha256"), F.countDistinct("before").alias("_n"), F.max("size_bytes").alias("size_bytes"), F.bool_or(F.col("error").isNotNull() | ~F.col("before").eqNullSafe(F.col("after"))).alias("_bad"))
    if index is not None:
        one = one.join(index.select("path", F.col("sha256").alias("_known")), "path", "left")
    else:
        one = one.withColumn("_known", F.lit(None).cast("string"))
    state = F.when(F.col("_bad"), "error").when(F.col("_n") > 1, "conflict").when(F.col("_known").isNull(), "new").when(F.col("_known") == F.col("sha256"), "known").otherwise("conflict")
    return one.select("path", "sha256", "size_bytes", state.alias("state"))


# ------------------------------------------------------------ frozen snapshots


def freeze(facts: DataFrame, entries: DataFrame, root: str, snapshot_id: str) -> None:
    """A snapshot that is all there or not at all: facts (a table), and entries (path, sha256, and source or content) as copies.

    Copies and tables go to a folder of this attempt. Each file's hash must be the entry's, as it is read and again as it
    lies there; then one small file, created in one step, makes the attempt the snapshot. A second freeze by that name, a
    damaged file, or an attempt that is lost on the way leaves nothing to see; clean_attempts removes what it left behind.
    """
    spark = entries.sparkSession
    if not snapshot_id or "/" in snapshot_id or snapshot_id.startswith("."):
        raise ValueError("a snapshot's id must be a plain name")
    pointer = f"{root}/{snapshot_id}.json"
    if exists(spark, pointer):
        raise FileExistsError(pointer)
    attempt = uuid.uuid4().hex
    place = f"{root}/_attempts/{attempt}"
    try:
        unsafe = entries.filter(~F.coalesce(is_safe_relative(F.col("path")), F.lit(False))).select("path").limit(5).collect()
        again = entries.groupBy("path").count().filter("count > 1").select("path").limit(5).collect()
        if unsafe or again:
            raise Damaged(f"unsafe or repeated paths: {[r['path'] for r in unsafe + again]}")
        copied = _entries(entries).mapInArrow(_stored(qualified(spark, f"{place}/files"), False), STORED)
        copied.join(entries.select("path", "sha256"), "path").write.parquet(f"{place}/entries")
        rows = spark.read.parquet(f"{place}/entries")
        bad = rows.filter(F.col("error").isNotNull() | ~F.col("before").eqNullSafe(F.col("sha256")) | ~F.col("after").eqNullSafe(F.col("sha256")))
        if found := bad.select("path", F.coalesce("error", F.lit("another hash")).alias("why")).limit(5).collect():
            raise Damaged(f"{bad.count()} files aren't as their entries say: {[tuple(r) for r in found]}")
        facts.write.parquet(f"{place}/facts")
        total = rows.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.bit_xor(F.xxhash64("path", "sha256")), F.lit(0)).alias("check")).first()
        publish(spark, pointer, json.dumps({"attempt": attempt, **total.asDict()}))
    except BaseException:
        delete(spark, place)
        raise


def pointer_of(spark: SparkSession, root: str, snapshot_id: str) -> dict:
    fs, p = _hadoop(spark, f"{root}/{snapshot_id}.json")
    if not fs.exists(p):
        raise FileNotFoundError(f"{root}/{snapshot_id}.json")
    return json.loads("".join(r["value"] for r in spark.read.text(f"{root}/{snapshot_id}.json").collect()))


def frozen(spark: SparkSession, root: str, snapshot_id: str) -> tuple[DataFrame, DataFrame]:
    """The facts and the entries (path, sha256, size_bytes, and stored: where the copy lies) of a snapshot."""
    place = f"{root}/_attempts/{pointer_of(spark, root, snapshot_id)['attempt']}"
    entries = spark.read.parquet(f"{place}/entries")
    return spark.read.parquet(f"{place}/facts"), entries.select("path", "sha256", "size_bytes", F.concat(F.lit(qualified(spark, f"{place}/files") + "/"), "path").alias("stored"))


def verify_frozen(spark: SparkSession, root: str, snapshot_id: str) -> DataFrame:
    """path and state (ok, missing or mismatch) of each file of a snapshot, by what lies there now."""
    entries = frozen(spark, root, snapshot_id)[1].select("path", F.col("sha256").alias("_wanted"), "size_bytes", "stored")
    now = hash_files(entries.select(F.col("stored").alias("path"), F.col("path").alias("_name"), "_wanted", "size_bytes"))
    state = F.when(F.col("error").isNotNull(), "missing").when(F.col("sha256") == F.col("_wanted"), "ok").otherwise("mismatch")
    return now.select(F.col("_name").alias("path"), state.alias("state"))


def clean_attempts(spark: SparkSession, root: str, older: float = 86_400.0) -> list[str]:
    """Delete attempts that no snapshot points at and that are older than so many seconds; their names."""
    import time

    fs, attempts = _hadoop(spark, f"{root}/_attempts")
    if not fs.exists(attempts):
        return []
    # One small file a snapshot: what is read is names, whatever the snapshots hold.
    points = [x.getPath().getName() for x in fs.listStatus(attempts.getParent()) if x.isFile() and x.getPath().getName().endswith(".json")]
    held = {pointer_of(spark, root, n.removesuffix(".json"))["attempt"] for n in points}
    gone = [x.getPath() for x in fs.listStatus(attempts) if x.getPath().getName() not in held and x.getModificationTime() / 1000 < time.time() - older]
    for p in gone:
        fs.delete(p, True)
    return sorted(p.getName() for p in gone)
