import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.config import EngineConfig, ModelInfo
from notewright.operators import clusters, dedup, encode, manifest, vault
from notewright.plans import queries
from notewright.sources import messages as M
from notewright.sources import snapshot
from notewright.storage import Tables


def unit(rng, n, d):
    v = rng.normal(size=(n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def sequential_leaders(v, t):
    masters, of = [], []
    for i, x in enumerate(v):
        sims = [(float(np.dot(v[m].astype(float), x.astype(float))), -m) for m in masters]
        best = max(sims, default=(-2, 0))
        if best[0] >= t:
            of.append(-best[1])
        else:
            masters.append(i)
            of.append(i)
    return of


@pytest.mark.parametrize("t", [0.3, 0.5, 0.8])
def test_leaders_are_those_of_a_sequential_pass(spark, t):
    v = unit(np.random.default_rng(1), 120, 6)
    frame = spark.createDataFrame([(i + 1, "c", [float(x) for x in r]) for i, r in enumerate(v)], "source_msg_id long, source_chat string, embedding array<float>")
    frame = frame.withColumn("ord", F.struct("source_msg_id", "source_chat"))
    led = dedup.leaders(frame, dedup.near_pairs(frame, t), Tables(spark, "t"))
    got = {r.ord.source_msg_id - 1: r.master.source_msg_id - 1 for r in led.collect()}
    assert got == dict(enumerate(sequential_leaders(v, t)))


@pytest.mark.parametrize("t", [0.3, 0.8])
def test_masters_found_chunk_by_chunk_are_those_of_a_sequential_pass(spark, t, monkeypatch):
    v = unit(np.random.default_rng(4), 150, 6)
    v[100:110] = v[:10]
    frame = spark.createDataFrame([(i + 1, "c", [float(x) for x in r]) for i, r in enumerate(v)], "source_msg_id long, source_chat string, embedding array<float>")
    frame = frame.withColumn("ord", F.struct("source_msg_id", "source_chat")).repartition(3)
    led = dedup.sequential_leaders(frame, t, Tables(spark, "t"), first=16, walked=8, portion=5)
    assert {r.ord.source_msg_id - 1: r.master.source_msg_id - 1 for r in led.collect()} == dict(enumerate(sequential_leaders(v, t)))
    # The exact search makes no table of all pairs: its blocks would repeat each vector once for every 2048 others.
    monkeypatch.setattr(dedup, "near_pairs", None)
    rows = frame.withColumn("note_id", F.concat_ws(":", "source_chat", "source_msg_id")).withColumn("exact_master", F.col("note_id"))
    got = {r.note_id: r.semantic_master for r in dedup.semantic_masters(rows, t, Tables(spark, "t")).collect()}
    assert got == {f"c:{i + 1}": f"c:{m + 1}" for i, m in enumerate(sequential_leaders(v, t))}


def test_lsh_search_equals_exact_search_for_equal_vectors(spark):
    v = np.repeat(unit(np.random.default_rng(2), 10, 16), 2, axis=0)
    frame = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "k long, v array<float>")
    pairs = {(r.later, r.earlier) for r in dedup.lsh_pairs(frame, 0.999, "v", "k").collect()}
    assert pairs == {(2 * i + 1, 2 * i) for i in range(10)}


def test_clusters_with_and_without_index(spark):
    v = unit(np.random.default_rng(3), 90, 8)
    rows = [(f"c:{i + 1}", "c", i + 1, [float(x) for x in r]) for i, r in enumerate(v)]
    frame = spark.createDataFrame(rows, "note_id string, source_chat string, source_msg_id long, embedding array<float>").repartition(3)
    exact = {r.note_id: r.cluster_id for r in clusters.assign(frame, 0.5).collect()}
    late = {r.note_id: r.cluster_id for r in clusters.assign(frame, 0.5, "lsh", lsh_from=10_000).collect()}
    assert exact == late and len(set(exact.values())) < 90
    early = clusters.assign(frame, 0.5, "lsh", lsh_from=4).count()
    assert early == 90


def test_integrity_finds_what_is_broken(spark):
    model = ModelInfo("m", "h", "", 2)
    notes = spark.createDataFrame(
        [("c:1", "c", 1, "t", "b", "m", [1.0, 0.0], "k", ""), ("c:2", "c", 2, "t", "b\n", "m", [1.0], "gone", "c:9")],
        "id string, source_chat string, source_msg_id long, title string, body string, embedding_id string, embedding array<float>, cluster_id string, duplicate_of string",
    )
    notes = notes.withColumn("hash", F.sha2("body", 256)).withColumn("created_at", F.timestamp_seconds(F.lit(5))).withColumn("updated_at", F.col("created_at"))
    found = spark.createDataFrame([("k", "n", "s", [0.0, 1.0], ["c:1", "c:7"])], "id string, name string, slug string, centroid array<float>, note_ids array<string>")
    rules = {(r.rule, r.key) for r in manifest.integrity(notes, found, model).collect()}
    assert rules == {
        ("note body is not normalized", "c:2"), ("note vector has a wrong dimension", "c:2"), ("note's cluster is missing", "c:2"),
        ("duplicate of no canonical note", "c:2"), ("cluster lists a foreign note", "c:7"), ("cluster misses a note", "c:2"),
    }


@pytest.fixture
def group(spark):
    """A master with 60 near copies: rows, notes without bodies, clusters, bodies, whole notes."""
    v = np.array([[1.0, i / 1000] for i in range(61)])
    rows = [(i + 1, "c", f"text {i} " + "word " * 40, [float(x) for x in r / np.linalg.norm(r)]) for i, r in enumerate(v)]
    frame = spark.createDataFrame(rows, "source_msg_id long, source_chat string, text string, embedding array<float>").select("*", F.timestamp_seconds("source_msg_id").alias("date_utc"), F.lit(None).cast("timestamp").alias("edited_at_utc"))
    work = Tables(spark, "t")
    placed, masters = manifest.dedup_and_cluster(frame, EngineConfig(), work)
    heads = work.put("notes", manifest.heads(placed, masters, ModelInfo("m", "h", "", 2)))
    whole = work.put("whole", manifest.notes(placed, masters, ModelInfo("m", "h", "", 2)))
    return placed, heads, work.put("clusters", manifest.cluster_records(masters, heads)), manifest.bodies(masters), whole


def test_fingerprint_takes_each_body_once(group, monkeypatch):
    _, heads, found, body_rows, whole = group
    model = ModelInfo("m", "h", "", 2)
    assert body_rows.count() == 1 and heads.where("duplicate_of <> ''").count() == 60 and "body" not in heads.columns
    assert len(body_rows.first().body) > 61 * 200
    monkeypatch.setattr(manifest, "PIECE", 1000)
    assert manifest.fingerprint(heads, found, model, body_rows) == manifest.fingerprint(whole, found, model)
    assert manifest.fingerprint(heads, found, model, body_rows.withColumn("body", F.concat("body", F.lit("x")))) != manifest.fingerprint(whole, found, model)


def test_integrity_checks_each_body_once(group):
    _, heads, found, body_rows, whole = group
    model = ModelInfo("m", "h", "", 2)
    rules = lambda n, b: {(r.rule, r.key) for r in manifest.integrity(n, found, model, b).collect()}
    assert rules(heads, body_rows) == rules(whole, None) == set()
    for bad, said in (("\n", {"note body is not normalized", "note hash differs from body"}), ("", {"note has a blank field", "note hash differs from body"})):
        broken = body_rows.withColumn("body", F.concat("body", F.lit(bad)) if bad else F.lit(" "))
        assert rules(heads, broken) == rules(whole.withColumn("body", F.concat("body", F.lit(bad)) if bad else F.lit(" ")), None) == {(r, f"c:{i + 1}") for r in said for i in range(61)}


def test_snapshot_tables_hold_no_text_of_duplicates(group):
    # Groups of d rows would cost d * d texts; what is shuffled and kept for centroids, members, counts, vectors and notes is narrow.
    placed, heads, found, _, _ = group
    for table in (placed, heads, found):
        assert not {"text", "normalized", "body", "additions"} & set(table.columns)


def test_files_of_canonical_notes_take_bodies_from_their_table(group):
    _, heads, found, body_rows, whole = group
    files = lambda *x: {(r.path, r.content) for r in vault.note_files(*x).collect()}
    assert len(files(heads, found, body_rows)) == 1 and files(heads, found, body_rows) == files(whole, found)


def test_members_of_clusters_need_no_bodies(group):
    _, heads, _, _, whole = group
    assert manifest.members(heads).collect() == manifest.members(whole).collect()
    assert manifest.members(heads).first().note_ids == [f"c:{i + 1}" for i in range(61)]


def test_sidecars_need_no_bodies(group):
    _, heads, _, _, whole = group
    model = ModelInfo("m", "h", "", 2)
    assert vault.sidecars(heads, model).collect() == vault.sidecars(whole, model).collect()
    assert [r.path for r in vault.sidecars(heads, model).collect()] == ["_meta/embeddings/c:1.json"]


def test_notes_without_bodies_have_the_hash_of_their_body(spark, group):
    _, heads, _, body_rows, whole = group
    digest = body_rows.select(F.sha2("body", 256).alias("h")).first().h
    assert {r.hash for r in heads.select("hash").collect()} == {digest} and heads.count() == 61
    assert manifest.filled(heads, body_rows).columns == [x.split(" ")[0] for x in snapshot.NOTES.split(", ")] == whole.columns


@pytest.mark.parametrize("name", ["manifest_counts", "cluster_members", "sidecar_paths", "manifest_notes"])
def test_queries_without_bodies_make_none(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(dedup, "with_bodies", lambda *_: pytest.fail("a body was made"))
    put, kept = Tables.put, []
    monkeypatch.setattr(Tables, "put", lambda self, table, df: kept.append((table, set(df.columns))) or put(self, table, df))
    assert getattr(queries, name)(spark, sf_dir).count()
    with_text = {table for table, columns in kept if columns & {"text", "normalized", "additions", "body"}}
    assert with_text == ({"texts"} if name == "manifest_notes" else set())


def test_hashes_of_bodies_are_those_of_whole_bodies(spark):
    # c:1 has two additions and an empty one, c:2 none, c:3 is empty itself and has one of two lines.
    rows = spark.createDataFrame(
        [(9, "c:1", "t"), (3, "c:1", "u"), (1, "c:1", "é first"), (5, "c:1", ""), (2, "c:2", "alone"), (4, "c:3", ""), (6, "c:3", "x\ny")], "n long, semantic_master string, normalized string"
    )
    first = {1: "c:1", 2: "c:2", 4: "c:3"}
    rows = rows.withColumn("note_id", F.when(F.col("n").isin(*first), F.col("semantic_master")).otherwise(F.concat(F.lit("d:"), "n")))
    rows = rows.withColumn("exact_master", F.col("note_id")).withColumn("ord", F.struct("n")).withColumn("title", F.concat(F.lit("title "), "n"))
    wanted = {r.note_id: r.h for r in dedup.with_bodies(rows).select("note_id", F.sha2("body", 256).alias("h")).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = manifest.body_hashes(rows.drop("normalized"), rows.select("note_id", "normalized")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 3 and {r.note_id: r.body_hash for r in found} == wanted


def test_validation_stops_a_run(spark):
    bad = spark.createDataFrame([(" ", 1, "x")], "source_chat string, source_msg_id long, text string").select(
        "*", F.timestamp_seconds(F.lit(9)).alias("date_utc"), F.lit(None).cast("timestamp").alias("edited_at_utc"), F.lit(None).cast("long").alias("reply_to_source_msg_id")
    )
    with pytest.raises(ValueError, match="chat is blank"):
        M.validated(bad)


def test_settings():
    assert EngineConfig.from_mapping({"NOTEWRIGHT_BATCH_SIZE": " 8 ", "NOTEWRIGHT_SEARCH": ""}).batch_size == 8
    for wrong in ({"dedup_threshold": 0.0}, {"cluster_threshold": float("nan")}, {"batch_size": 0}, {"run_mode": "x"}):
        with pytest.raises(ValueError):
            EngineConfig(**wrong)
    assert manifest.metadata_mismatches(ModelInfo("a"), ModelInfo("b")) == ['model_id existing="a" current="b"']


def test_word_pieces():
    vocab = {t: i for i, t in enumerate(["[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "é"])}
    assert encode.word_pieces("unaffable", vocab) == ["un", "##aff", "##able"]
    assert encode.word_pieces("unx", vocab) == ["[UNK]"]
    assert encode.word_pieces("é", vocab) == ["é"]
    with pytest.raises(ValueError):
        encode.read_vocabulary("a\nb")
    assert encode.read_vocabulary("[UNK]\n\n[CLS]\n[SEP]") == ({"[UNK]": 0, "[CLS]": 2, "[SEP]": 3}, False)


def test_pooling():
    hidden = np.array([[[1.0, 0.0], [0.0, 1.0], [9.0, 9.0]]])
    got = encode.decode_output(hidden, np.array([[1, 1, 0]]))
    assert np.allclose(got, [[2**-0.5, 2**-0.5]])
    ids, mask = encode.padded([[5, 6], [7]])
    assert ids.tolist() == [[5, 6], [7, 0]] and mask.tolist() == [[1, 1], [1, 0]]


def test_encoder_output_is_checked(spark):
    frame = spark.createDataFrame([("a",), ("b",)], "text string")
    good = encode.encode_messages(frame, lambda texts: np.ones((len(texts), 3)), 3).collect()
    assert good[0].embedding == [1.0, 1.0, 1.0]
    with pytest.raises(Exception, match="encoder gave"):
        encode.encode_messages(frame, lambda texts: np.zeros((len(texts), 3)), 3).collect()
