"""The whole run: load, scan, merge, deduplicate, cluster, persist, project."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.config import EngineConfig, ModelInfo
from notewright.operators import incremental, manifest, vault
from notewright.sources import messages as M
from notewright.sources import snapshot
from notewright.storage import Tables


@dataclass(frozen=True)
class Outcome:
    """What a run did."""

    changed: bool
    projected: dict[str, int] | None
    fingerprint: str
    counts: dict[str, int]


class Engine:
    """One vault: a snapshot in ``root/_meta/tables`` and its files under ``root``.

    ``encode`` adds ``embedding`` to messages.
    """

    def __init__(self, spark: SparkSession, root: str, model: ModelInfo, encode: Callable[[DataFrame], DataFrame], config: EngineConfig | None = None):
        self.spark, self.root, self.model, self.encode = spark, root, model, encode
        self.config = config or EngineConfig()
        self.tables, self.header, self.manifest = f"{root}/_meta/tables", Path(root) / "_meta/header.json", Path(root) / "_meta/manifest.json"

    def previous(self) -> tuple[dict, DataFrame, DataFrame] | None:
        if not self.header.exists():
            return None
        head = json.loads(self.header.read_text())
        return head, *snapshot.load_tables(self.spark, head["tables"])

    def run(self, chat: str, records: DataFrame) -> Outcome:
        """``records``: the chat's history as record columns (see :mod:`notewright.sources.messages`)."""
        before = self.previous()
        incremental_run = self.config.run_mode == "incremental" and before is not None
        after = 0
        if incremental_run:
            wrong = manifest.metadata_mismatches(ModelInfo(**before[0]["model"]), self.model)
            if wrong:
                raise ValueError("the snapshot was made by another model: " + "; ".join(wrong))
            after = before[1].agg(F.coalesce(F.max("source_msg_id"), F.lit(0))).first()[0]
        fetched = M.content_filter(M.scan_history(records, after, self.config.max_messages), self.config.include_all)
        work = Tables(self.spark, "run")
        fetched = work.put("fetched", M.validated(M.latest_versions(fetched) if "arrival" in records.columns else fetched).select(*incremental.COLUMNS))
        if not fetched.limit(1).count():
            if before and (Path(self.root) / vault.DIRTY).exists():
                vault.project(before[1], before[2], self.model, self.root)
            return Outcome(False, None, before[0]["fingerprint"] if before else "", before[0]["counts"] if before else {})
        embedded = incremental.merged(before[1], fetched, self.encode, self.config.rebuild_text) if incremental_run else self.encode(fetched)
        embedded = work.put("embedded", embedded)
        rows, masters = manifest.dedup_and_cluster(embedded, self.config, work)
        heads, bodies = work.put("notes", manifest.heads(rows, masters, self.model)), manifest.bodies(masters)
        clusters = work.put("clusters", manifest.cluster_records(masters, heads))
        broken = manifest.integrity(heads, clusters, self.model, bodies).limit(5).collect()
        if broken:
            raise ValueError(f"the snapshot is not sound: {broken}")
        mark = manifest.fingerprint(heads, clusters, self.model, bodies)
        counts = manifest.counts(heads).first().asDict()
        if before and before[0]["fingerprint"] == mark and not (Path(self.root) / vault.DIRTY).exists():
            return Outcome(False, None, mark, counts)
        vault.write_atomic(str(Path(self.root) / vault.DIRTY), "dirty\n")
        run_id = manifest.run_id(chat, embedded, self.model, self.config)
        place = f"{self.tables}/{run_id}"
        notes = manifest.filled(heads, bodies)
        snapshot.save_tables(notes, clusters, place)
        model = {"model_id": self.model.model_id, "model_hash": self.model.model_hash, "model_profile": self.model.model_profile, "vector_dimension": self.model.vector_dimension}
        vault.write_atomic(str(self.header), json.dumps({"schema_version": manifest.SCHEMA_VERSION, "model": model, "fingerprint": mark, "counts": counts, "run_id": run_id, "tables": place}, indent=2) + "\n")
        if self.config.json_snapshot:
            self.write_json(notes, clusters, run_id, counts)
        return Outcome(True, vault.project(notes, clusters, self.model, self.root), mark, counts)

    def write_json(self, notes: DataFrame, clusters: DataFrame, run_id: str, counts: dict[str, int]) -> None:
        """The snapshot as one JSON file beside the tables, for other tools; turn ``json_snapshot`` off
        for vaults that are too large for one file."""
        span = manifest.span(notes.select(F.col("created_at").alias("date_utc"), "source_msg_id")).first()
        stamp = lambda s: datetime.fromtimestamp(s, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        header = {
            "schema_version": manifest.SCHEMA_VERSION, "model_id": self.model.model_id, "model_hash": self.model.model_hash, "model_profile": self.model.profile,
            "normalization_rule": self.model.normalization_rule, "vector_dimension": self.model.vector_dimension, "last_run_utc": stamp(span.finished),
        }
        run = {"run_id": run_id, "started_at": stamp(span.started), "finished_at": stamp(span.finished), "watermark": span.watermark, **counts}
        vault.write_atomic_parts(str(self.manifest), snapshot.document_lines(header, notes, clusters, run))
