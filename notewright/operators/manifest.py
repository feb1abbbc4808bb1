"""The snapshot: notes, clusters, run metadata, fingerprints and integrity."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.config import EngineConfig, ModelInfo
from notewright.functions import text as T
from notewright.functions.render import ADDITIONS, bullet, master_body
from notewright.operators import clusters as C
from notewright.operators import dedup as D
from notewright.storage import Tables, small_batches

SCHEMA_VERSION = 1
#: Bytes of a body that are read at once.
PIECE = 1 << 20


def _grouped(rows: DataFrame, config: EngineConfig, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Candidates with exact and semantic masters, and ``note_id, cluster_id`` of the semantic masters."""
    rows = tables.put("candidates", D.exact_masters(rows, tables))
    tables.drop("hashed")
    rows = tables.put("semantic", D.semantic_masters(rows, config.dedup_threshold, tables, config.search))
    tables.drop("candidates")
    firsts = rows.where("note_id = semantic_master").select("note_id", "source_chat", "source_msg_id", "embedding")
    return rows, tables.put("assigned", C.assign(firsts, config.cluster_threshold, config.search))


def _placed(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    return rows.join(assigned.select(F.col("note_id").alias("semantic_master"), "cluster_id"), "semantic_master")


def dedup_and_cluster(embedded: DataFrame, config: EngineConfig, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """All rows with their masters and clusters, without texts, and the masters with bodies."""
    small_batches(embedded.sparkSession)
    texts = tables.put("texts", D.candidates(embedded).drop("text"))
    rows, assigned = _grouped(texts.drop("normalized"), config, tables)
    masters = D.with_bodies(rows, texts).drop("normalized", "additions").withColumn("body_hash", F.sha2("body", 256))
    masters = tables.put("masters", masters.join(assigned, "note_id"))
    return tables.put("placed", _placed(rows, assigned)), masters


def placed(embedded: DataFrame, config: EngineConfig, tables: Tables) -> DataFrame:
    """As the rows of :func:`dedup_and_cluster`, for what needs no text: none is written, no title or
    body is made."""
    small_batches(embedded.sparkSession)
    return _placed(*_grouped(D.candidates(embedded).drop("text", "normalized", "title"), config, tables))


def placed_and_hashed(embedded: DataFrame, config: EngineConfig, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """As :func:`dedup_and_cluster`, with the hashes of the bodies in place of the masters: no body is made."""
    small_batches(embedded.sparkSession)
    texts = tables.put("texts", D.candidates(embedded).drop("text"))
    rows, assigned = _grouped(texts.drop("normalized"), config, tables)
    hashes = tables.put("hashes", body_hashes(rows, texts))
    tables.drop("texts")
    return _placed(rows, assigned), hashes


def body_hashes(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``note_id, body_hash`` of the semantic masters: SHA-256 of what :func:`D.with_bodies` renders.

    A group's texts pass in order through a running digest, so no task holds a body.
    """
    used = rows.where("note_id = exact_master").join(texts.select("note_id", "normalized"), "note_id")
    own = F.col("note_id") == F.col("semantic_master")
    piece = F.when(own, master_body(F.col("title"), F.col("normalized"), F.array().cast("array<string>"))).otherwise(bullet(F.col("normalized")))
    pieces = used.where(own | (F.col("normalized") != "")).select(F.col("semantic_master").alias("note_id"), own.alias("own"), "ord", piece.alias("piece"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = pieces.repartition(parts, "note_id").sortWithinPartitions("note_id", F.desc("own"), "ord").select("note_id", "own", "piece")
    schema = pa.schema([("note_id", pa.string()), ("body_hash", pa.string())])

    def digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, listed = None, None, False
        for batch in batches:
            done = []
            for note, is_own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if is_own:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest, listed = note, hashlib.sha256(), False
                else:
                    digest.update(b"\n" if listed else ADDITIONS.encode())
                    listed = True
                digest.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], schema=schema)

    return ordered.mapInArrow(digested, "note_id string, body_hash string")


def duplicate_of() -> Column:
    return F.when(F.col("note_id") == F.col("semantic_master"), "").otherwise(F.col("semantic_master"))


def heads(rows: DataFrame, masters: DataFrame, model: ModelInfo) -> DataFrame:
    """Note records without their bodies.

    A duplicate has its master's body, which holds the texts of all duplicates: written out for each
    note, bodies would grow with the square of a group.  ``body_of`` names the note whose body it is.
    """
    hashes = masters.select(F.col("note_id").alias("semantic_master"), "body_hash")
    out = rows.join(hashes, "semantic_master")
    return out.select(
        F.col("note_id").alias("id"), "source_chat", "source_msg_id", "title", F.col("body_hash").alias("hash"),
        F.lit(model.model_id).alias("embedding_id"), "embedding", "cluster_id", F.array().cast("array<string>").alias("tags"),
        F.col("date_utc").alias("created_at"), F.greatest("date_utc", F.coalesce("edited_at_utc", "date_utc")).alias("updated_at"),
        duplicate_of().alias("duplicate_of"),
        F.col("semantic_master").alias("body_of"),
    )


def bodies(masters: DataFrame) -> DataFrame:
    """``body_of, body``: each body once."""
    return masters.select(F.col("note_id").alias("body_of"), "body")


def filled(head_rows: DataFrame, body_rows: DataFrame) -> DataFrame:
    """Whole note records, for what keeps or shows each note with its body."""
    names = [c for c in head_rows.columns if c != "body_of"]
    names.insert(names.index("title") + 1, "body")
    return head_rows.join(body_rows, "body_of").select(*names)


def notes(rows: DataFrame, masters: DataFrame, model: ModelInfo) -> DataFrame:
    """Note records; a duplicate has its master's body."""
    return filled(heads(rows, masters, model), bodies(masters))


def members(note_rows: DataFrame) -> DataFrame:
    """``cluster_id, note_ids``: all notes, by the number in their id, then by id."""
    order = F.struct(F.coalesce(T.numeric_suffix(F.col("id")), F.lit((1 << 63) - 1)).alias("n"), "id")
    listed = note_rows.groupBy("cluster_id").agg(F.sort_array(F.collect_list(order)).alias("m"))
    return listed.select("cluster_id", F.transform("m", lambda x: x["id"]).alias("note_ids"))


def cluster_records(masters: DataFrame, note_rows: DataFrame) -> DataFrame:
    """Cluster records; created and updated are the run's earliest and latest message dates."""
    span = note_rows.agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    out = C.named(masters).join(C.centroids(masters), "cluster_id").join(members(note_rows), "cluster_id")
    # One row, by construction.
    return out.join(F.broadcast(span)).select(F.col("cluster_id").alias("id"), "name", "slug", "centroid", "note_ids", "created_at", "updated_at")


def counts(note_rows: DataFrame) -> DataFrame:
    return note_rows.agg(
        F.count(F.lit(1)).alias("notes"), F.count_if(F.col("duplicate_of") == "").alias("canonical_notes"),
        F.count_if(F.col("duplicate_of") != "").alias("duplicate_notes"), F.countDistinct("cluster_id").alias("clusters"),
    )


def span(messages: DataFrame) -> DataFrame:
    """Earliest and latest date in epoch seconds (0 without messages), and the highest id."""
    return messages.agg(
        F.coalesce(F.min(F.unix_seconds("date_utc")), F.lit(0)).alias("started"), F.coalesce(F.max(F.unix_seconds("date_utc")), F.lit(0)).alias("finished"),
        F.coalesce(F.max("source_msg_id"), F.lit(0)).alias("watermark"),
    )


def _digest(parts) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(p)
    return h.hexdigest()


def fingerprint(note_rows: DataFrame, cluster_rows: DataFrame, model: ModelInfo, body_rows: DataFrame | None = None) -> str:
    """A digest of what readers see: header, notes by id, clusters by id, each field ended by NUL.

    Rows come to the driver one at a time, in order; only the running digest is kept.  With
    ``body_rows`` notes come without bodies: each body comes once, to a temporary file of the driver,
    and is read from there for every note that has it.
    """

    def fields(*names: str) -> Column:
        # concat_ws leaves null fields out, which would move the others.
        return F.concat_ws("\0", *[F.coalesce(c, F.lit("")) for c in names], F.lit(""))

    def parts():
        for x in (SCHEMA_VERSION, model.model_id, model.model_hash, model.profile, model.vector_dimension):
            yield f"{x}\0".encode()
        before, after = fields("id", "hash", "cluster_id", "title"), fields("duplicate_of")
        if body_rows is None:
            for r in note_rows.orderBy("id").select(F.concat(before, fields("body"), after).alias("t")).toLocalIterator():
                yield r.t.encode()
        else:
            with tempfile.TemporaryFile() as file:
                at: dict[str, tuple[int, int]] = {}
                for r in body_rows.select("body_of", "body").toLocalIterator():
                    data = (r.body or "").encode()
                    at[r.body_of] = file.tell(), len(data)
                    file.write(data)
                file.flush()
                for r in note_rows.orderBy("id").select(before.alias("before"), "body_of", after.alias("after")).toLocalIterator():
                    yield r.before.encode()
                    start, size = at[r.body_of]
                    # A call may give less than it is asked for.
                    while size:
                        data = os.pread(file.fileno(), min(size, PIECE), start)
                        yield data
                        start, size = start + len(data), size - len(data)
                    yield b"\0" + r.after.encode()
        for r in cluster_rows.orderBy("id").select(F.concat_ws("\0", *[F.coalesce(c, F.lit("")) for c in ("id", "slug", "name")], F.col("note_ids"), F.lit("")).alias("t")).toLocalIterator():
            yield r.t.encode()

    return _digest(parts())


def run_id(chat: str, messages: DataFrame, model: ModelInfo, config: EngineConfig) -> str:
    """Sixteen digits that depend on settings, model and messages in order."""

    def parts():
        yield f"{chat}{model.model_id}{model.model_hash}{model.profile}{config.run_mode}/{config.batch_mode}/{config.batch_size}".encode()
        fields = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_chat", "source_msg_id", "text")])
        for r in messages.orderBy("source_msg_id", "source_chat").select(fields.alias("t")).toLocalIterator():
            yield r.t.encode()

    return _digest(parts())[:16]


def _bad(rows: DataFrame, rule: str, key: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def _broken(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """The rules that single rows break, in one pass."""
    found = F.array_compact(F.array(*[F.when(broken, rule) for rule, broken in rules.items()]))
    return rows.select(F.explode(found).alias("rule"), F.col(key).cast("string").alias("key"))


def integrity(note_rows: DataFrame, cluster_rows: DataFrame, model: ModelInfo, body_rows: DataFrame | None = None) -> DataFrame:
    """``rule, key`` of everything that a snapshot must not hold; empty for a sound one.

    Anti-joins and aggregates only; membership is compared as exploded pairs, not list by list.
    ``body_rows`` are the bodies of notes that come without: each is checked once, and what was found
    is joined to the notes that have it.
    """
    n, c = note_rows, cluster_rows
    pairs = c.select(F.col("id").alias("cluster_id"), F.explode("note_ids").alias("note_id"))
    held = n.select("cluster_id", F.col("id").alias("note_id"))
    canonical = n.where("duplicate_of = ''").select(F.col("id").alias("duplicate_of"), F.col("cluster_id").alias("master_cluster"))
    copies = n.where("duplicate_of <> ''").select("id", "cluster_id", "duplicate_of").join(canonical, "duplicate_of", "left")
    blank = lambda x: T.trim_spaces(F.col(x)) == ""
    of_body = [
        blank("body").alias("body_blank"), (F.col("body").contains("\r") | F.col("body").endswith("\n")).alias("body_rough"), F.sha2("body", 256).alias("body_hash"),
    ]
    checked = n.select("*", *of_body) if body_rows is None else n.join(body_rows.select("body_of", *of_body), "body_of", "left")
    found = [
        _bad(D.duplicate_keys(n, "id"), "note id repeats", F.col("id")),
        _bad(D.duplicate_keys(c, "id"), "cluster id repeats", F.col("id")),
        _bad(D.duplicate_keys(c, "slug"), "cluster slug repeats", F.col("slug")),
        _bad(D.duplicate_keys(pairs, "cluster_id", "note_id"), "cluster lists a note twice", F.col("note_id")),
        _broken(checked, "id", {
            "note id is not chat:id": F.col("id") != F.concat_ws(":", "source_chat", F.col("source_msg_id").cast("string")),
            "note has a blank field": blank("title") | F.col("body_blank") | blank("embedding_id") | blank("cluster_id"),
            "note body is not normalized": F.col("body_rough"),
            "note updated before created": F.col("updated_at") < F.col("created_at"),
            "note hash differs from body": F.col("body_hash") != F.col("hash"),
            "note vector has a wrong dimension": F.size("embedding") != model.vector_dimension,
            "duplicate of itself": F.col("duplicate_of") == F.col("id"),
        }),
        _broken(c, "id", {
            "centroid has a wrong dimension": F.size("centroid") != model.vector_dimension,
            "cluster has a bad field": blank("name") | (F.col("slug") == "") | F.col("slug").rlike(r"[/\\]") | (F.size("note_ids") == 0),
        }),
        _bad(n.join(c.select(F.col("id").alias("cluster_id")), "cluster_id", "left_anti"), "note's cluster is missing", F.col("id")),
        _broken(copies, "id", {
            "duplicate of no canonical note": F.col("master_cluster").isNull(),
            "duplicate in another cluster": F.col("master_cluster") != F.col("cluster_id"),
        }),
        _bad(pairs.join(held, ["cluster_id", "note_id"], "left_anti"), "cluster lists a foreign note", F.col("note_id")),
        _bad(held.join(pairs, ["cluster_id", "note_id"], "left_anti"), "cluster misses a note", F.col("note_id")),
    ]
    return reduce(DataFrame.unionByName, found)


def metadata_mismatches(previous: ModelInfo, current: ModelInfo) -> list[str]:
    """What differs between two models, as ``field existing=... current=...``."""
    pairs = [(f, getattr(previous, f), getattr(current, f)) for f in ("model_id", "model_hash", "profile", "vector_dimension", "normalization_rule")]
    show = lambda x: f'"{x}"' if isinstance(x, str) else str(x)
    return [f"{f} existing={show(a)} current={show(b)}" for f, a, b in pairs if a != b]


def mismatch_text(fields: dict[str, tuple[Column, Column]]) -> Column:
    """The same on columns of text: one string, empty where all agree."""
    found = [F.when(~a.eqNullSafe(b), F.format_string(f'{name} existing="%s" current="%s"', a, b)) for name, (a, b) in fields.items()]
    return F.array_join(F.array_compact(F.array(*found)), ", ")


def effective_profile(profile: Column) -> Column:
    return F.coalesce(F.nullif(T.trim_spaces(profile), F.lit("")), F.lit("bert_tokenized_mean_pooling"))


