"""Materialising a snapshot as files: what is wanted, what has changed, what must go."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.config import ModelInfo
from notewright.functions import text as T
from notewright.functions.render import note_markdown

DIRTY = "_meta/projection.dirty"


def note_files(notes: DataFrame, clusters: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """``path, content`` of canonical notes; ``bodies`` (body_of, body) of notes that come without."""
    slugs = clusters.select(F.col("id").alias("cluster_id"), "slug")
    if bodies is not None:
        notes = notes.where("duplicate_of = ''").join(bodies, "body_of")
    rows = notes.where("duplicate_of = ''").join(slugs, "cluster_id").where(T.safe_stem(F.col("slug")) & T.safe_stem(F.col("id")))
    return rows.select(F.concat(F.lit("topics/"), "slug", F.lit("/"), "id", F.lit(".md")).alias("path"), note_markdown(F.col).alias("content"))


def cluster_index(notes: DataFrame, clusters: DataFrame) -> DataFrame:
    """``path, content`` of each cluster's index: canonical notes in order, with their duplicates.

    Joins by id; a canonical note's duplicates are those of its own cluster.
    """
    order = F.struct(F.coalesce(T.numeric_suffix(F.col("id")), F.lit((1 << 63) - 1)).alias("n"), "id")
    copies = notes.where("duplicate_of <> ''").groupBy("cluster_id", F.col("duplicate_of").alias("id")).agg(F.sort_array(F.collect_list(order)).alias("copies"))
    rows = notes.where("duplicate_of = ''").join(copies, ["cluster_id", "id"], "left")
    lines = F.array_join(F.transform("copies", lambda x: F.concat(F.lit("    - `"), x["id"], F.lit("`\n"))), "")
    entry = F.concat(F.lit("- ["), "title", F.lit("]("), "id", F.lit(".md)\n"), F.coalesce(F.concat(F.lit("  - duplicates:\n"), lines), F.lit("")))
    listed = rows.select("cluster_id", F.struct(order.alias("o"), entry.alias("e")).alias("x")).groupBy("cluster_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    text = F.concat(F.lit("# "), "name", F.lit("\n\n## Canonical notes\n\n"), F.coalesce(F.array_join(F.transform("x", lambda e: e["e"]), ""), F.lit("")))
    out = clusters.select(F.col("id").alias("cluster_id"), "name", "slug").join(listed, "cluster_id", "left").where(T.safe_stem(F.col("slug")))
    return out.select(F.concat(F.lit("topics/"), "slug", F.lit("/index.md")).alias("path"), text.alias("content"))


def sidecars(notes: DataFrame, model: ModelInfo) -> DataFrame:
    """``path, content`` of the vectors of canonical notes, as JSON."""

    @F.pandas_udf("string")
    def rendered(note: pd.Series, vector: pd.Series) -> pd.Series:
        fixed = {"model_id": model.model_id, "model_hash": model.model_hash, "vector_dimension": model.vector_dimension, "normalization_rule": model.normalization_rule}
        out = []
        for n, v in zip(note, vector, strict=True):
            text = json.dumps({"note_id": n} | fixed | {"values": [float(str(x)) for x in v]}, indent=2, ensure_ascii=False)
            out.append(text.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e") + "\n")
        return pd.Series(out, dtype=object)

    rows = notes.where("duplicate_of = ''").where(T.safe_stem(F.col("id")))
    return rows.select(F.concat(F.lit("_meta/embeddings/"), "id", F.lit(".json")).alias("path"), rendered("id", "embedding").alias("content"))


def artifacts(notes: DataFrame, clusters: DataFrame, model: ModelInfo) -> DataFrame:
    return sidecars(notes, model).unionByName(cluster_index(notes, clusters)).unionByName(note_files(notes, clusters))


def plan(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """``path, status``: written, skipped (content is the same) or pruned (managed, not wanted).

    ``desired``: path, content; ``existing``: path, hash (SHA-256 of the content).
    """
    want = desired.select("path", F.sha2("content", 256).alias("wanted"))
    both = want.join(existing.select("path", "hash"), "path", "full_outer")
    status = F.when(F.col("wanted").isNull(), F.when(T.managed_path(F.col("path")), "pruned")).when(F.col("wanted").eqNullSafe(F.col("hash")), "skipped").otherwise("written")
    return both.select("path", status.alias("status")).where("status is not null")


def stats(planned: DataFrame) -> DataFrame:
    return planned.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("written", "skipped", "pruned")])


def existing_files(spark, root: str) -> DataFrame:
    """``path, hash`` of the files under a root that executors share.

    Names hold colons, which Hadoop's local file system refuses, so plain reads hash them; the driver
    only lists names.
    """
    names = ((os.path.relpath(os.path.join(d, n), root),) for d, _, files in os.walk(root) for n in files)
    rows = spark.createDataFrame(list(names), "path string")

    def hashed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(hash=[hashlib.sha256(Path(root, p).read_bytes()).hexdigest() for p in batch["path"]])

    return rows.mapInPandas(hashed, "path string, hash string")


def write_atomic(path: str, content: str) -> bool:
    """Writes unless the file has this content; a reader never sees half of it."""
    data = content.encode()
    try:
        if Path(path).read_bytes() == data:
            return False
    except FileNotFoundError:
        pass
    os.makedirs(os.path.dirname(path), exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".tmp-")
    with os.fdopen(handle, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)
    return True


def write_atomic_parts(path: str, parts: Iterable[str]) -> None:
    """Writes a file of any length part by part; a reader never sees half of it."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".tmp-")
    with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
        for part in parts:
            f.write(part)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def project(notes: DataFrame, clusters: DataFrame, model: ModelInfo, root: str) -> dict[str, int]:
    """Brings the files under ``root`` (shared by the executors) in line with a snapshot.

    Executors write; a marker tells a later run to project again if this one does not end.
    """
    base = Path(root)
    marker = base / DIRTY
    write_atomic(str(marker), "dirty\n")
    desired = artifacts(notes, clusters, model)
    existing = existing_files(notes.sparkSession, root).where(~F.col("path").startswith("_meta/") | F.col("path").startswith("_meta/embeddings/"))
    planned = plan(desired, existing).persist()
    result = stats(planned).first().asDict()

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [write_atomic(os.path.join(root, p), c) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame({"written": [sum(done)]})

    desired.join(planned.where("status = 'written'"), "path").select("path", "content").mapInPandas(write, "written int").agg(F.sum("written")).collect()

    def remove(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch["path"]:
                Path(root, p).unlink(missing_ok=True)
            yield pd.DataFrame({"folder": [str(f) for f in {f for p in batch["path"] for f in Path(p).parents} if f.name]})

    # Executors remove the files; only the names of their folders, a few for each topic, come back.
    folders = planned.where("status = 'pruned'").select("path").mapInPandas(remove, "folder string").distinct()
    for folder in sorted((base / r.folder for r in folders.toLocalIterator()), key=lambda p: len(p.parts), reverse=True):
        if folder.is_dir() and not any(folder.iterdir()):
            folder.rmdir()
    planned.unpersist()
    marker.unlink()
    return result
