"""Settings, model files, encoders, SQL names, strict snapshots and the search by signatures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.config import ModelConfig, Settings, VaultConfig
from notewright.functions import text as T
from notewright.functions.register import register
from notewright.operators import dedup, encode, incremental
from notewright.sources import snapshot
from notewright.storage import Tables


def test_settings_from_texts():
    s = Settings.from_mapping({"NOTEWRIGHT_BATCH_SIZE": "8", "NOTEWRIGHT_HISTORY_MAX_MESSAGES": "7", "NOTEWRIGHT_MODEL_PATH": "/m", "NOTEWRIGHT_MODEL_DIMENSION": " 5 ", "NOTEWRIGHT_VAULT_ROOT": "/v/"})
    assert (s.run.batch_size, s.history.max_messages, s.model.path, s.model.dimension, s.vault.manifest_path) == (8, 7, "/m", 5, "/v/_meta/manifest.json")
    assert s.model.info(lambda p: f"hash of {p}").model_hash == "hash of /m" and ModelConfig(hash="h").info(None).model_hash == "h"
    for wrong in ({"NOTEWRIGHT_HISTORY_MAX_MESSAGES": "0"}, {"NOTEWRIGHT_MODEL_DIMENSION": "x"}, {"NOTEWRIGHT_HISTORY_INCLUDE_ALL": "perhaps"}):
        with pytest.raises(ValueError):
            Settings.from_mapping(wrong)
    with pytest.raises(ValueError):
        VaultConfig(root=" ")


def test_model_files(tmp_path):
    model, words, empty = tmp_path / "m", tmp_path / "v", tmp_path / "e"
    model.write_bytes(b"abc"), words.write_text("x"), empty.write_bytes(b"")
    assert encode.file_hash(str(model)) == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    bert, direct = encode.PROFILES
    encode.check_assets(str(model), bert, str(words), 3)
    encode.check_assets(str(model), direct, "", 3)
    for args in ((str(model), bert, "", 3), (str(empty), direct, "", 3), (str(tmp_path), direct, "", 3), ("", direct, "", 3), (str(model), bert, str(tmp_path / "no"), 3), (str(model), direct, "", 0), (str(model), "other", "", 3)):
        with pytest.raises(ValueError):
            encode.check_assets(*args)


class Fake:
    """A session whose first run fails."""

    class Name:
        def __init__(self, name):
            self.name = name

    def __init__(self, inputs, outputs, answer):
        self.inputs, self.outputs, self.answer, self.opened, self.runs = inputs, outputs, answer, 0, 0

    def get_inputs(self):
        return [self.Name(n) for n in self.inputs]

    def get_outputs(self):
        return [self.Name(n) for n in self.outputs]

    def run(self, outputs, feed):
        self.runs += 1
        if self.runs == 1:
            raise RuntimeError("gone")
        return [self.answer(outputs[0], feed)]


def session(fake):
    s = encode.Session("nowhere")

    def opened():
        if s.opened is None:
            s.opened, fake.opened = fake, fake.opened + 1
        return s.opened

    s.open = opened
    return s


def test_texts_go_in_as_they_are_and_a_failed_session_is_opened_again():
    fake = Fake(["text"], ["other", "sentence_embedding"], lambda out, feed: np.array([[3.0, 4.0]] * len(feed["text"])) if out == "sentence_embedding" else None)
    run = encode.onnx_encoder("nowhere", None, profile="string_input_direct", session=session(fake))
    with pytest.raises(RuntimeError):
        run(["a"])
    assert np.allclose(run(["a", "b"]), [[0.6, 0.8]] * 2) and fake.opened == 2
    with pytest.raises(ValueError):
        encode.onnx_encoder("nowhere", None, profile="string_input_direct", input_name="none", session=session(fake))(["a"])


def test_both_token_paths_split_alike(spark):
    vocab = {w: i for i, w in enumerate(["[UNK]", "[CLS]", "[SEP]", "a", "b", "##b", "\u00a0", "##\u00a0"])}
    seen = {}
    fake = Fake(["input_ids"], ["sentence_embedding"], lambda out, feed: seen.update(feed) or np.ones((len(feed["input_ids"]), 2)))
    fake.runs = 1
    text = "a\u00a0b ab\tb"
    encode.onnx_encoder("nowhere", vocab, session=session(fake))([text])
    row = spark.createDataFrame([(text,)], "t string").select(encode.wordpiece_udf(vocab)(encode.basic_tokens(F.col("t"))).alias("e")).first()
    assert seen["input_ids"][0].tolist() == row.e.input_ids


def test_long_words_take_linear_time():
    vocab = {w: i for i, w in enumerate(["[UNK]", "[CLS]", "[SEP]", "a", "##a", "##aaa"])}
    assert len(encode.word_pieces("a" * 30_001, vocab)) == 10_001


def test_names_in_sql(spark):
    register(spark)
    texts = ["a \r\n\r\n\r\n\tb\t \rcafe\u0301\n\n", " \n x\n  \n\n\n\ny'q", "", None, "Привет, Мир! Щ", "***"]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    mine = d.select("i", T.normalize_text(F.col("t")), T.slugify(F.col("t")), T.derive_title(F.col("t"), F.col("i")), F.lit(14.0)).collect()
    theirs = spark.sql("SELECT i, normalize_text(t), slugify(t), derive_title(t, i), dot(array(1, 2, 3), array(4.0, 5.0)) FROM {d}", d=d).collect()
    assert [tuple(r) for r in sorted(mine)] == [tuple(r) for r in sorted(theirs)]


def test_snapshots_with_strange_data_are_refused(spark, tmp_path):
    def load(text):
        path = tmp_path / "s.json"
        path.write_text(text)
        return snapshot.read_document(spark, str(path))

    head = '"schema_version": 1, "model_id": "m", "model_hash": "h", "vector_dimension": 2, "clusters": []'
    assert load("{" + head + ', "notes": []}')[1].count() == 0
    for text, why in (("{" + head + ', "notes": []} {}', "after"), ("{" + head + ', "notes": [{"id": "a", "colour": 1}]}', "notes.colour"), ("{" + head + ', "notes": [}', "Expecting")):
        with pytest.raises(ValueError, match=why):
            load(text)


def test_rebuilt_source_texts_lose_heading_and_additions(spark):
    notes = spark.createDataFrame([("c:1", "c", 1, "t", "# t\n\nbody\nmore\n\n## Additions\n\n- x\n- y", None), ("c:2", "c", 2, "t", "# t", None)], "id string, source_chat string, source_msg_id long, title string, body string, embedding array<float>").withColumn("created_at", F.lit(None).cast("timestamp"))
    fetched = spark.createDataFrame([], "source_chat string, source_msg_id long, date_utc timestamp, text string, edited_at_utc timestamp")
    got = {r.source_msg_id: r.text for r in incremental.rebuilt(notes, fetched, "source").collect()}
    assert got == {1: "body\nmore", 2: "# t"}
    assert incremental.rebuilt(notes, fetched).where("source_msg_id = 1").first().text.startswith("# t")


@pytest.mark.parametrize("n", [100, 700])
def test_signature_search_finds_what_is_recent_or_early(spark, n):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(n, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(v.tolist())], "ord long, embedding array<double>")
    got = {(r.later, r.earlier) for r in dedup.recent_pairs(frame, 0.5, Tables(spark, "t")).collect()}
    near = v @ v.T >= 0.5
    want = {(a, b) for a in range(n) for b in range(a) if near[a, b] and (a < dedup.EXHAUSTIVE or a - b <= dedup.RECENT)}
    assert got == want
