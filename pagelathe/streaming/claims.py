"""Claims of a stream of waiting workers, micro-batch by micro-batch, over a table of jobs in versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelathe.sources.versions import VersionedTable
from pagelathe.streaming import jobs

TABLE = "id long, status string, attempt int, max_attempts int, lease_owner string, lease_expires_at timestamp_ntz, created_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, error_json string"


def claim_batch(table: VersionedTable, claims: DataFrame, batch_id: int, query: str, lease_seconds: int = 120) -> bool:
    """Apply one micro-batch of claims (seq, worker, ts); the clock is its latest ts. False: it was applied before, or is empty.

    A version tells the last batch of each query, so a batch that comes again claims nothing twice; a commit that another
    writer was ahead of is made again from what that one left. Only rows that changed are written.
    """
    now = claims.agg(F.max("ts").alias("now")).first()["now"]
    if now is None:
        return False

    def change(held: DataFrame) -> tuple[DataFrame, None]:
        after = jobs.claim(held, claims.select("seq", "worker"), now, lease_seconds).drop("claimed").select(*held.columns)
        return after.subtract(held), None

    return table.commit_once(query, batch_id, change, done=lambda last: last >= batch_id)


def start(claims: DataFrame, table: VersionedTable, checkpoint: str, query: str, lease_seconds: int = 120, **trigger) -> StreamingQuery:
    """claims as a stream. The checkpoint and the table may be lost and found apart: batches are applied once by their number."""

    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            claim_batch(table, df, batch_id, query, lease_seconds)
        finally:
            df.unpersist()

    return claims.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
