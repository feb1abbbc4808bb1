"""Near-duplicates, vectors, mixing, tool calls and the pipeline, against brute force."""

import itertools
import json
import math
import random
import re
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from notewright.llm import chat_format, common, embedding_dedup, language_id, mixing, near_dedup, registry, shingles, toxicity
from notewright.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Sets:
    """Union-find with the least member as name."""

    def __init__(self):
        self.of = {}

    def find(self, x):
        self.of.setdefault(x, x)
        while self.of[x] != x:
            x = self.of[x]
        return x

    def union(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3)]
    want = Sets()
    for a, b in edges[:-2]:
        want.union(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long"), common.Tables(spark, "t"), "t")
    assert {r.node: r.root for r in got.collect()} == {x: want.find(x) for x in want.of}
    assert components(spark.createDataFrame([], "a long, b long"), common.Tables(spark, "t"), "t").count() == 0


def near_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [[word() for _ in range(n)] for n in (6, 9, 40, 120, 300)]
    texts = [None, "", " \n", "One", "one", "two words", "TWO\twords"]
    for b in base:
        for _ in range(14):
            c = list(b)
            for _ in range(rng.randint(0, max(1, len(b) // 25))):
                c[rng.randrange(len(c))] = word()
            texts.append(" ".join(c))
        texts.append(" ".join(b))
    shared = [word() for _ in range(60)]
    texts += [" ".join(shared + [word() for _ in range(rng.randint(5, 60))]) for _ in range(25)]
    return texts


@pytest.mark.parametrize(("block", "frequent"), [(near_dedup.BLOCK, near_dedup.FREQUENT), (5, 2)])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, block, frequent):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "FREQUENT", frequent)
    texts = near_texts()
    rows = [(i * 3 + 1, t, "x", 1) for i, t in enumerate(texts)] + [(1 + 3 * 20, texts[20], "x", 1)]
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(table))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    want = Sets()
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            want.union(a, b)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, digest string, component int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want.find(r.doc_id), want.find(r.doc_id) == r.doc_id)


@pytest.mark.parametrize("singly", [0, 8, 10**9])
def test_links_across_components_of_a_block(monkeypatch, singly):
    # Near copies of a text, just over and just below the threshold to each other, in two components and many single ones.
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, 300 - k % 50, replace=False), rng.integers(0, 2**64, k % 50, dtype=np.uint64)]) for k in range(120)]
    roots = {i: 0 if i < 40 else 1 if i < 60 else i for i in range(120)}
    calls, real = [], near_dedup.jaccard_links
    monkeypatch.setattr(near_dedup, "SINGLY", singly)
    monkeypatch.setattr(near_dedup, "jaccard_links", lambda *x: calls.append(x) or real(*x))
    found = list(near_dedup.links_across({1000 + i: (roots[i], s) for i, s in enumerate(sets)}))
    assert all(real(sets[a - 1000], sets[b - 1000]) for a, b in found)

    def parts(links):
        label = dict(roots)
        for a, b in links:
            x, y = label[a], label[b]
            label = {k: y if v == x else v for k, v in label.items()}
        return {frozenset(k for k, v in label.items() if v == w) for w in label.values()}

    every = [(i, j) for i in range(120) for j in range(i) if real(sets[i], sets[j])]
    assert parts((a - 1000, b - 1000) for a, b in found) == parts(every) and len(parts(every)) < len(parts([]))
    assert len(calls) <= singly * 120


def test_near_duplicates_of_nothing_and_without_ids(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(frame).count() == 0
    got = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b"), (4, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(4, 4, True)]
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["4", "None"]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(6)
    for j in (0.5, 0.75, 0.9):
        shared = rng.integers(0, 2**63, int(3000 * j), dtype=np.uint64)
        side = int((3000 - len(shared)) / 2)
        a, b = (np.unique(np.r_[shared, rng.integers(0, 2**63, side, dtype=np.uint64)]) * shingles.MIX for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = float(shingles.estimate(shingles.registers(np.sort(a)), shingles.registers(np.sort(b))))
        assert abs(got - true) < 0.13
    assert (shingles.registers(np.array([5], np.uint64)) == shingles.registers(np.array([5], np.uint64))).all()


def vectors(spark):
    rng = np.random.default_rng(7)
    rows = [rng.normal(size=16) for _ in range(60)]
    for c in range(6):
        centre = rng.normal(size=16)
        rows += [centre + rng.normal(size=16) * 0.12 for _ in range(20 + 10 * c)]
    rows += [rows[3]] * 5 + [rows[4] * 2.5]
    listed = [[float(np.float32(x)) for x in r] for r in rows]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    return spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(listed + odd)], "vec_id long, embedding array<float>, label int"), listed, odd


@pytest.mark.parametrize("most", [embedding_dedup.MOST, 60])
def test_vector_links_are_those_of_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(embedding_dedup, "MOST", most)
    monkeypatch.setattr(embedding_dedup, "REGION", 70)
    frame, listed, odd = vectors(spark)
    v = np.array(listed)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.95
    want, n = Sets(), len(listed)
    for a, b in zip(*np.nonzero(near), strict=True):
        want.union(int(a), int(b))
    links = near.sum(1) - 1
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(frame).collect()}
    for i in range(n):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], want.find(i), want.find(i) == i)
    for i in range(n, n + 6):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[n + 6].n_links == got[n + 7].n_links == 1 and got[n + 7].component_id == n + 6
    result = embedding_dedup.near_vectors(frame)
    assert embedding_dedup.audit_recall(frame.where(F.size("embedding") == 16), result, queries=80) >= 0.95
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def planted(n, dim, spread):
    """Vectors around some directions, each second one a partner in range of the one before it."""
    rng = np.random.default_rng(17)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    v = unit(unit(rng.normal(size=(30, dim)))[rng.integers(0, 30, n)] + spread * unit(rng.normal(size=(n, dim))))
    aside = rng.normal(size=(n, dim))
    aside = unit(aside - (aside * v).sum(1, keepdims=True) * v)
    other = 0.951 * v + math.sqrt(1 - 0.951**2) * aside
    return np.stack([v, other], 1).reshape(-1, dim)


@pytest.mark.parametrize("spread", [0.5, 50.0])
def test_all_vectors_in_range_meet_in_a_region(spread):
    v = planted(1500, 24, spread)
    to = embedding_dedup.Dealing(embedding_dedup.centres(v, 40, 3), 0.95)
    homes, rows, regions = to(v)
    held = set(zip(rows.tolist(), regions.tolist(), strict=True))
    for a, b in zip(*np.nonzero(np.triu(v @ v.T >= 0.95, 1)), strict=True):
        low = min(homes[a], homes[b])
        assert (a, low) in held and (b, low) in held


@pytest.mark.parametrize("spread", [0.5, 50.0])
def test_vector_links_across_many_regions(spark, monkeypatch, spread):
    monkeypatch.setattr(embedding_dedup, "REGION", 40)
    v = planted(800, 24, spread)
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(frame).collect()}
    near = v @ v.T
    assert [got[i] for i in range(len(v))] == ((near >= 0.95).sum(1) - 1).tolist()


def test_many_near_copies_in_one_region_take_seconds():
    rng = np.random.default_rng(3)
    v = rng.normal(size=64) + 0.1 * rng.normal(size=(6000, 64))
    v[5000:] = rng.normal(size=(1000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ones, began = np.ones(len(v), np.int64), time.time()
    digests = [b"%06d" % i for i in range(len(v))]
    links, roots = embedding_dedup.region_rows(digests, v, ones, ones * 0, ones * 0, 0, False, 0.95, False)
    assert time.time() - began < 60
    assert links == ((v @ v.T >= 0.95).sum(1) - 1).tolist()
    assert set(roots[:5000]) == {digests[0]} and roots[5000:] == digests[5000:]


def test_vectors_without_keys_and_repeated(spark):
    rows = [(None, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [1.0, 0.01]), (None, None)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got if r.n_links) == [("2", 3, 2, True), ("2", 3, 2, True), ("3", 3, 2, False), ("None", 3, 2, False)]
    assert [(r.component_id, r.kept) for r in got if not r.n_links] == [(None, False)]


def filled(sizes, weights):
    cap, target, free = [2.0 * s for s in sizes], [0.0] * len(sizes), set(range(len(sizes)))
    budget = 1.5 * sum(sizes)
    while free:
        rest = budget - sum(target[i] for i in range(len(sizes)) if i not in free)
        level = rest / sum(weights[i] for i in free)
        over = [i for i in free if level * weights[i] > cap[i] + 1e-9]
        for i in free:
            target[i] = level * weights[i]
        for i in over:
            target[i] = cap[i]
        free -= set(over)
        if not over:
            break
    return target


def mixture(spark):
    rng = random.Random(8)
    sources = ["b", "a", None, "é", "z"]
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 60))), "a" if rng.random() < 0.4 else rng.choice(sources), 1, "x") for i in range(900)]
    rows += [(1000, None, "b", 1, "x"), (1001, " ", None, 1, "x"), (None, "one two", "a", 1, "x"), (5, rows[5][1], rows[5][2], 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, h string"), rows


def test_mix_meets_its_targets(spark):
    frame, rows = mixture(spark)
    got = mixing.mix(frame).toPandas()
    assert len(got) == len(rows)
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(len(WORD.findall(r[1] or "")) for r in rows if r[2] == s) for s in names}
    target = dict(zip(names, filled([size[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
    assert sorted(set(zip(got.source_size, got.target.round(6)))) == sorted({(size[s], round(target[s], 6)) for s in names})
    most = int(got["size"].max())
    for s in names:
        taken = got[(got.source_size == size[s]) & (abs(got.target - target[s]) < 1e-6)].taken.sum()
        assert abs(taken - target[s]) <= most
    assert (got.taken <= 2 * got["size"]).all() and abs(got.taken.sum() - 1.5 * got["size"].sum()) <= most
    again = mixing.mix(frame.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(repr, got[key].fillna(-1).values.tolist())) == sorted(map(repr, again[key].fillna(-1).values.tolist()))


def test_mixed_rows_are_those_taken(spark):
    frame, _ = mixture(spark)
    frame = frame.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = {r.doc_id: r.taken // r.size for r in mixing.mix(frame).where("taken > 0").collect()}
    out = mixing.mixed_documents(frame)
    assert out.columns == frame.columns
    assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == want
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.mixed_documents(frame.where("doc_id = 1000")).count() == 0


def test_calls_are_linked_and_ordered(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for conv in range(8):
        n = rng.randint(1, 12)
        names = [f"c{i}" for i in range(n)]
        needs = {c: [x for x in rng.sample(names[:i], min(i, rng.randint(0, 2)))] for i, c in enumerate(names)}
        if conv == 3 and n > 1:
            needs["c0"] = [names[-1]]
        level = {}
        while True:
            ready = [c for c in names if c not in level and all(x in level for x in needs[c])]
            if not ready:
                break
            level.update({c: max((level[x] + 1 for x in needs[c]), default=0) for c in ready})
        want.update({(conv, c): level.get(c) for c in names})
        rows += [(conv, c, i, "f", json.dumps({"b": i, "a": [1.5, None]}, indent=1), needs[c], "x") for i, c in enumerate(names)]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string, after array<string>, status string")
    results = spark.createDataFrame([(0, "c0", 1, "é\n\"x\""), (5, "none", 1, None)], "conv_id long, call_id string, turn long, content string")
    schema = {"f": {"type": "object", "properties": {"b": {"type": "integer", "maximum": 5}}}}
    for gathered in (100, 2):
        got = {(r.conv_id, r.call_id): r for r in chat_format.link_calls(calls, results, schema, gathered).collect()}
        assert {k: r.level for k, r in got.items() if k != (5, "none")} == want
        assert got[5, "none"].status == "orphan" and got[0, "c0"].status == "linked"
        for r in got.values():
            assert r.canonical_json == chat_format.canonical(json.loads(r.canonical_json))
            assert r.status == "orphan" or r.errors == ("$.b: too large" if r.turn > 5 else "")
        for conv in range(8):
            own = sorted((r for k, r in got.items() if k[0] == conv and r.position), key=lambda r: r.position)
            assert [r.position for r in own] == list(range(1, len(own) + 1)) and [r.level for r in own] == sorted(r.level for r in own)
    assert chat_format.link_calls(calls.limit(0), results.limit(0), schema).count() == 0


def test_odd_calls_have_defined_results(spark):
    raw = {"a": '"\\ud800"', "b": "[" * 100_000, "c": '{"x": NaN}', "d": None, "e": '{"z": 1e999}', "f": '{"k\\udc00": 1}', "g": "1"}
    rows = [(1, k, 1, "f", r, None) for k, r in raw.items()] + [(1, "g", 0, "u", "2", ["g", "h"]), (1, "h", 2, "none", "3", ["g"]), (1, None, 3, "f", "1", None), (None, "x", 3, "f", "1", None)]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, "g", 5, "late"), (1, "g", 4, "z"), (1, "g", 4, "b"), (1, None, 1, "?"), (2, "q", None, None)], "conv_id long, call_id string, turn long, content string")
    schema = {"f": {"type": "object", "additionalProperties": False}, "u": {"type": "whole"}}
    got = {(r.conv_id, r.call_id): r for r in chat_format.link_calls(calls, results, schema).collect()}
    assert set(got) == {(1, k) for k in "abcdefgh"} | {(2, "q")}
    errors = {k: got[1, k].errors for k in "abcdefgh"}
    assert errors["a"] == "$: not object" and got[1, "a"].canonical_json.startswith('{"arguments":"\\ud800"')
    assert errors["b"] == "$: nested too deeply" and errors["c"] == errors["d"] == errors["e"] == "$: not JSON"
    assert errors["f"] == "$.k\\udc00: unknown" and errors["g"] == "$: schema has no type whole" and errors["h"] == "$: unknown tool"
    # Of several calls or results with one id the earliest counts; g and h wait for each other.
    assert '"result":"b"' in got[1, "g"].canonical_json and got[1, "g"].turn == 0
    assert got[1, "g"].level is None and got[1, "h"].position is None and got[2, "q"].status == "orphan"
    assert [got[1, k].position for k in "abcdef"] == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("gathered", [5, 100, 1000])
def test_levels_of_long_chains_knots_and_cycles(spark, gathered):
    rng = random.Random(11)
    needs = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(150)}
    for i in range(12):
        needs[f"k{i}"] = rng.sample([f"c{rng.randrange(150)}", f"k{max(0, i - 1)}", f"k{max(0, i - 2)}", "nowhere"], 3) if i else ["c149", "c3"]
        needs[f"t{i}"] = [f"k{i}"]
    needs |= {"x": ["z"], "y": ["x"], "z": ["y"], "w": ["x", "c1"], "v": ["w"], "u": ["v", "k3", "c9"]}
    level = {}
    while True:
        ready = [c for c in needs if c not in level and all(x in level for x in needs[c] if x in needs)]
        if not ready:
            break
        level.update({c: max((level[x] + 1 for x in needs[c] if x in needs), default=0) for c in ready})
    calls = spark.createDataFrame([(1, c, after) for c, after in needs.items()], "conv_id long, call_id string, after array<string>")
    got = chat_format.levels(calls, common.Tables(spark, "t"), gathered).collect()
    assert {r.call_id: r.level for r in got} == {c: level.get(c) for c in needs}


def test_other_turns_are_messages(spark):
    rows = [(1, 0, "system", 'be "kind"'), (1, 1, None, None), (None, 2, "user", "x"), (1, None, "assistant", "y")]
    got = chat_format.message_rows(chat_format.calls_of(spark.createDataFrame([*rows, (1, 3, "user", "z")], "conv_id long, turn long, role string, text string"))[2]).collect()
    assert {(r.conv_id, r.turn, r.status, r.canonical_json) for r in got} == {
        (1, 0, "message", '{"content":"be \\"kind\\"","role":"system"}'), (1, 1, "message", '{"content":null,"role":null}'),
        (None, 2, "message", '{"content":"x","role":"user"}'), (1, None, "message", '{"content":"y","role":"assistant"}'),
    }


def test_call_query_is_the_same_in_sql(spark, sf_dir):
    con = duckdb.connect()
    for table in ("conversations", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    for name, sql in registry.ORACLES.items():
        mine = registry.QUERIES[name](spark, sf_dir).toPandas()
        theirs = con.execute(sql).df()[list(mine.columns)]
        plain = lambda f: sorted(repr([None if pd.isna(x) else str(x).removesuffix(".0") for x in r]) for r in f.astype(object).values.tolist())
        assert plain(mine) == plain(theirs)


def test_pipeline_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.withColumn("size", F.lit("clash")).unionByName(spark.createDataFrame([(9001, None, None, None, None, "x"), (9002, "", "en", "src1", 0, "x")], docs.withColumn("size", F.lit("")).schema))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = extra.count()
        extra = common.Tables(spark, "p").put(name, stage(spark, extra, sf_dir))
        assert extra.columns == [*docs.columns, "size"], name
        after = extra.count()
        assert 0 < after <= (2 * before if name == "mixing" else before)
        if name == "language_id":
            assert extra.where("doc_id > 9000").count() == 0 and after > 0.9 * before
        if name == "near_dedup":
            left = near_dedup.near_duplicates(extra).toPandas()
            assert left.kept.all()
    packed = corpus_pipeline.STAGES[-1][1](spark, extra, sf_dir)
    assert packed.select("doc_id").distinct().count() == extra.select("doc_id").distinct().count()
    assert math.isclose(packed.where("start = 0").count(), extra.count())
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_pipeline_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(9001, None, None, "s", 0), (9002, "", "en", None, 0), (None, "the words of this text and that", "en", None, 3), (9003, "und der die und", "de", "s", 3), (9003, "und der die und", "de", "s", 3)]
    docs = common.Tables(spark, "p").put("docs", docs.unionByName(spark.createDataFrame(odd, docs.schema)))
    bag = lambda df: sorted(map(repr, df.collect()))
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    judge = toxicity.Scorer(toxicity.fit(docs, labels))
    assert bag(stages["toxicity"](spark, docs, sf_dir)) == sorted(repr(r) for r in docs.collect() if judge.score([r.text or ""])[0] < 0.5)
    known = language_id.Judge(language_id.fit(docs.where(~F.coalesce(language_id.held_out(), F.lit(False)))))
    assert bag(stages["language_id"](spark, docs, sf_dir)) == sorted(repr(r) for r in docs.collect() if known.judge([r.text or ""])[3][0])
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    distinct = list({r: None for r in sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))})
    words = [WORD.findall((r.text or "").translate(table)) for r in distinct]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    want = Sets()
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            want.union(a, b)
    assert bag(stages["near_dedup"](spark, docs, sf_dir)) == sorted(repr(r) for i, r in enumerate(distinct) if want.find(i) == i)
    taken = {(r.doc_id, r.size): r.taken // r.size for r in mixing.mix(docs).collect() if r.size}
    mixed = {}
    for r in stages["mixing"](spark, docs, sf_dir).collect():
        mixed[r] = mixed.get(r, 0) + 1
    for r in {r: None for r in docs.collect()}:
        n = len(WORD.findall(r.text or ""))
        assert mixed.get(r, 0) == taken.get((r.doc_id, n), 0) * (2 if r.doc_id == 9003 else 1)
    packed = stages["packing"](spark, docs, sf_dir).toPandas()
    assert (packed.groupby("sequence_id")["length"].sum() <= 2048).all() and len(packed[packed.start == 0]) == docs.count()


def test_pipeline_stages_on_an_empty_table(spark, sf_dir):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name


def test_near_dedup_stage_with_one_id_on_several_texts_and_without_ids(spark, sf_dir):
    text = lambda k, n=40: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(1, text("a")), (2, text("a") + " more"), (2, text("b")), (-3, text("c")), (-3, text("d")), (-3, text("d")), (None, text("b") + " more"), (None, text("e")), (None, text("e")), (7, None)]
    out = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    want = [(1, text("a")), (2, text("b")), (-3, text("c")), (-3, text("d")), (None, text("e")), (7, None)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
