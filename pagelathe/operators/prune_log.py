"""Pruning as an operation with a log: each step is on record before the next begins, so a stop anywhere can be made good.

Records are small files that are created once: planned (what goes, as a table beside it), staged (all that goes is in the
backup), purged (the tables are without it), rolling (it is to come back) and rolled_back. Tables take each operation's
change once, by its name. So after a stop ``recover`` does what the last record leaves to do, and does nothing twice.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.operators import maintenance
from pagelathe.sources.storage import _hadoop, exists, publish
from pagelathe.sources.versions import VersionedTable

STATES = ("planned", "staged", "purged", "rolling", "rolled_back")


class PruneLog:
    """Operations over tables of runs (id), pages and artifacts (id, run_id). Pages and artifacts may be tables near run_id."""

    def __init__(self, spark: SparkSession, root: str, runs: VersionedTable, pages: VersionedTable, artifacts: VersionedTable) -> None:
        self.spark, self.root, self.runs, self.pages, self.artifacts = spark, root.rstrip("/"), runs, pages, artifacts

    # ------------------------------------------------------------------ records

    def _place(self, operation_id: str) -> str:
        if not operation_id or "/" in operation_id or "\\" in operation_id or operation_id[0] in "._":
            raise ValueError("an operation's id must be a plain name")
        return f"{self.root}/{operation_id}"

    def record(self, operation_id: str, state: str | None = None) -> dict | None:
        """What a state's record says (by default the last one's), with the state; None where there is none."""
        place = self._place(operation_id)
        for s in [state] if state else reversed(STATES):
            path = f"{place}/{s}.json"
            if exists(self.spark, path):
                return json.loads("".join(r["value"] for r in self.spark.read.text(path).collect())) | {"state": s}
        return None

    def _tell(self, operation_id: str, state: str, **what) -> None:
        try:
            publish(self.spark, f"{self._place(operation_id)}/{state}.json", json.dumps(what))
        except FileExistsError:
            pass  # another process made the same step

    def operations(self) -> list[str]:
        fs, root = _hadoop(self.spark, self.root)
        return sorted(x.getPath().getName() for x in fs.listStatus(root)) if fs.exists(root) else []

    # -------------------------------------------------------------------- steps

    def plan(self, operation_id: str, plan: DataFrame, document_hash: str, keep: str) -> dict:
        """plan: maintenance.prune_plan's rows. Puts the operation on record; nothing has changed yet."""
        if self.record(operation_id):
            raise FileExistsError(operation_id)
        targets = f"targets-{uuid.uuid4().hex}"
        may = plan.filter("refusal IS NULL")
        may.select("id", "pos", "reclaimable_bytes").write.parquet(f"{self._place(operation_id)}/{targets}")
        total = self.spark.read.parquet(f"{self._place(operation_id)}/{targets}").agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("bytes")).first()
        publish(self.spark, f"{self._place(operation_id)}/planned.json", json.dumps({"targets": targets, "document_hash": document_hash, "keep_run_id": keep, **total.asDict()}))
        return self.record(operation_id)

    def _targets(self, operation_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._place(operation_id)}/{self.record(operation_id, 'planned')['targets']}").select("id")

    def _backup_path(self, operation_id: str, table: str) -> str:
        return f"{self._place(operation_id)}/{self.record(operation_id, 'staged')['backup']}/{table}"

    def _backup(self, operation_id: str, table: str) -> DataFrame:
        return getattr(self, table).got(self._backup_path(operation_id, table))

    def _stage(self, operation_id: str) -> None:
        ids, backup = self._targets(operation_id), f"backup-{uuid.uuid4().hex}"
        place = f"{self._place(operation_id)}/{backup}"
        self.pages.put(ids, f"{place}/pages")
        self.artifacts.put(ids, f"{place}/artifacts")
        self.runs.read().join(ids, "id", "left_semi").write.parquet(f"{place}/runs")
        self._tell(operation_id, "staged", backup=backup)

    def _purge(self, operation_id: str) -> None:
        ids = self._targets(operation_id)
        pages, artifacts = self._backup(operation_id, "pages"), self._backup(operation_id, "artifacts")
        # The backup has what the tombstones tell, whether or not the tables still do.
        tombs = lambda runs: maintenance.stage_prune(ids, runs, pages, artifacts)[0].join(ids, "id", "left_semi")
        self.runs.commit_once(f"purge {operation_id}", True, lambda held: (tombs(held), None))
        self.pages.commit_once(f"purge {operation_id}", True, lambda held: (None, pages), dealt=True)
        self.artifacts.commit_once(f"purge {operation_id}", True, lambda held: (None, artifacts), dealt=True)
        self._tell(operation_id, "purged")

    def _restore(self, operation_id: str) -> None:
        """What was taken away comes back; what has been written anew in the meantime stays."""
        if self.record(operation_id, "staged"):
            was = self._backup(operation_id, "runs")

            def runs(held: DataFrame) -> tuple[DataFrame, None]:
                mine = held.filter("artifact_state = 'pruned'").join(was.select("id"), "id", "left_semi")
                return maintenance.roll_back(mine, was.select("id"), mine, mine)[0], None

            for name in ("pages", "artifacts"):
                getattr(self, name).put_back_once(f"restore {operation_id}", True, self._backup_path(operation_id, name))
            self.runs.commit_once(f"restore {operation_id}", True, runs)
        self._tell(operation_id, "rolled_back")

    def _match(self, operation_id: str, document_hash: str, keep: str) -> dict:
        told = self.record(operation_id, "planned")
        if told is None:
            raise KeyError(operation_id)
        if (told["document_hash"], told["keep_run_id"]) != (document_hash, keep):
            raise ValueError("the operation is of another document, or keeps another run")
        return self.record(operation_id)

    def run(self, operation_id: str, document_hash: str, keep: str) -> str:
        """Do what is planned; the state it ends in. An operation that is to come back isn't done again."""
        self._match(operation_id, document_hash, keep)
        return self.recover(operation_id)

    def roll_back(self, operation_id: str, document_hash: str, keep: str) -> str:
        self._match(operation_id, document_hash, keep)
        self._tell(operation_id, "rolling")
        return self.recover(operation_id)

    def recover(self, operation_id: str) -> str:
        """Go on from the last record to the end: purged, or rolled_back if it was asked to come back."""
        while True:
            told = self.record(operation_id)
            if told is None:
                raise KeyError(operation_id)
            if told["state"] in ("purged", "rolled_back"):
                return told["state"]
            {"planned": self._stage, "staged": self._purge, "rolling": self._restore}[told["state"]](operation_id)
