import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.config import EngineConfig, ModelInfo
from notewright.operators import encode
from notewright.plans.engine import Engine
from notewright.sources import snapshot
from notewright.streaming import limits
from notewright.streaming.increments import follow

MODEL = ModelInfo("bag", "1", "", 16)


def make_bag():
    def bag(texts):
        out = np.zeros((len(texts), 16), np.float32)
        for i, t in enumerate(texts):
            for w in t.split():
                out[i, int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 16] += 1
            if not out[i].any():
                out[i, 0] = 1
            out[i] /= np.linalg.norm(out[i])
        return out

    return bag


bag = make_bag()


def history(spark, rows):
    frame = spark.createDataFrame(rows, "source_chat string, source_msg_id long, text string")
    return frame.select(
        "*", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("source_msg_id")).alias("date_utc"), F.lit(None).cast("timestamp").alias("edited_at_utc"),
        F.lit(None).cast("long").alias("reply_to_source_msg_id"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("media_kind"),
    )


def test_runs_are_incremental_and_repeat_without_writing(spark, tmp_path):
    root = str(tmp_path / "vault")
    engine = Engine(spark, root, MODEL, lambda m: encode.encode_messages(m, bag, 16))
    first = history(spark, [("c", 1, "alpha beta"), ("c", 2, "alpha beta"), ("c", 3, "gamma delta epsilon"), ("c", 4, "  ")])
    out = engine.run("c", first)
    assert out.changed and out.counts == {"notes": 3, "canonical_notes": 2, "duplicate_notes": 1, "clusters": 2}
    assert out.projected["written"] == 6 and out.projected["pruned"] == 0
    again = engine.run("c", first)
    assert not again.changed and again.fingerprint == out.fingerprint
    more = engine.run("c", history(spark, [("c", 1, "alpha beta"), ("c", 9, "zeta eta theta")]))
    assert more.changed and more.counts["notes"] == 4
    files = sorted(p.relative_to(root).as_posix() for p in (tmp_path / "vault/topics").rglob("*.md"))
    assert any(f.endswith("c:9.md") for f in files) and not (tmp_path / "vault/_meta/projection.dirty").exists()
    with pytest.raises(ValueError, match="another model"):
        Engine(spark, root, ModelInfo("other", "1", "", 16), engine.encode).run("c", first)
    whole = Engine(spark, root, MODEL, engine.encode, EngineConfig(run_mode="full_rebuild"))
    assert whole.run("c", first).counts["notes"] == 3


def test_json_snapshot_round_trip(spark, tmp_path):
    body = "# t\n\nb"
    notes = spark.createDataFrame([("c:1", "c", 1, "t", body, hashlib.sha256(body.encode()).hexdigest(), "m", [3.0, 4.0], "k", [], None, None, "")], snapshot.NOTES)
    clusters = spark.createDataFrame([("k", "n", "s", [0.0, 2.0], ["c:1"], None, None)], snapshot.CLUSTERS)
    path = tmp_path / "snapshot.json"
    path.write_text(snapshot.document({"schema_version": 1, "model_id": "m", "model_hash": "h", "vector_dimension": 2}, notes, clusters, {}))
    header, got, found = snapshot.read_document(spark, str(path))
    assert header.first().normalization_rule == "l2_unit"
    assert [round(x, 6) for x in got.first().embedding] == [0.6, 0.8] and found.first().centroid == [0.0, 1.0]
    doc = json.loads(path.read_text())
    doc["notes"][0]["body"] = "other"
    path.write_text(json.dumps(doc))
    with pytest.raises(Exception, match="differs from its hash"):
        snapshot.read_document(spark, str(path))[1].collect()
    path.write_text(json.dumps(doc | {"extra": 1}))
    with pytest.raises(ValueError, match="extra"):
        snapshot.read_document(spark, str(path))


def test_sliding_limit():
    from collections import deque

    assert limits.admit([0, 1, 2, 3, 60, 61], deque(), 60, 2) == [True, True, False, False, True, True]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [(i % 3, float(i), i) for i in range(60)]
    events = spark.createDataFrame(rows, "user long, at double, n long")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    batch = {(r.user, r.n): r.allowed for r in limits.limited(events, "user", "at", "n", 10, 2).collect()}
    stream = limits.limited_stream(spark.readStream.schema("user long, at double, n long").parquet(str(tmp_path / "in")), "user", "at", "n", 10, 2)
    query = stream.writeStream.format("memory").queryName("limited_test").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.user, r.n): r.allowed for r in spark.table("limited_test").collect()}
    assert got == batch


def test_follow_calls_merge_for_each_batch(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "m"))
    seen = []
    follow(spark.readStream.schema("id long").parquet(str(tmp_path / "m")), lambda df, i: seen.append(df.count()), str(tmp_path / "c")).awaitTermination(60)
    assert sum(seen) == 5
