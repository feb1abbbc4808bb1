"""Token counts and packing against the library itself."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notewright.llm import packing, token_counts, tokens

TEXTS = [None, "", " ", "a", "  a   b\n\n c ", "don't 1234 éß 你好 😀", "<|endoftext|> x <|endoftext|>", "x" * 30_000, "a\x00b", "  　y", "a \n b", "a\n "]


@pytest.fixture(scope="module")
def library():
    return tokens.load(tokens.vocabulary_path())


@pytest.fixture(scope="module")
def tables():
    path = tokens.vocabulary_path()
    whole = tokens.whole_tokens(path)
    return tokens.Chunks(path, whole), tokens.Chunks(path, whole, ids=True)


def test_whole_tokens_encode_alone(library):
    whole = tokens.whole_tokens(tokens.vocabulary_path())
    picked = random.Random(1).sample(sorted(whole), 500)
    assert all(library.encode(s, add_special_tokens=False).ids == [whole[s]] for s in picked)


@settings(max_examples=400, deadline=None)
@given(text=st.lists(st.sampled_from([*"ab 1!\n\t'sé\x85\x00你", "  ", "<|endoftext|>", " the", "\r\n", "\u3000"]), max_size=30).map("".join) | st.text(max_size=20))
def test_same_as_the_library(library, tables, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert tables[0].texts([text]) == [len(ids)]
    assert np.frombuffer(tables[1].texts([text])[0], "<u4").tolist() == ids


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n_tokens string")


def test_counts_of_odd_rows(spark, library):
    rows = [(i, t, "k", "clash") for i, t in enumerate(TEXTS)] + [(None, "a b", "k", "x"), (3, "a", "k", "x")]
    got = sorted(token_counts.count_tokens(frame(spark, rows)).collect(), key=repr)
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, *_ in rows), key=lambda r: repr(r))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_first_fit_decreasing(sizes):
    bins, offsets = packing.first_fit_decreasing(sizes, 64)
    slow, rooms = [None] * len(sizes), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, r in enumerate(rooms) if r >= sizes[i]), len(rooms))
        if b == len(rooms):
            rooms.append(64)
        slow[i] = b
        rooms[b] -= sizes[i]
    assert bins == slow
    for b in set(bins):
        own = sorted((offsets[i], sizes[i]) for i in range(len(sizes)) if bins[i] == b)
        assert [o for o, _ in own] == np.cumsum([0, *(s for _, s in own)])[:-1].tolist()


def test_packing_is_an_exact_round_trip(spark, library):
    rng = random.Random(2)
    rows = [(i, t, "k", "x") for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choice(["the", "of", "qzx", "12"]) for _ in range(rng.randint(0, 900))), "k", "x") for i in range(150)]
    rows += [(3, "a", "k", "x"), (None, "b", "k", "x")]
    got = packing.pack_documents(frame(spark, rows), group_docs=40, with_ids=True).toPandas()
    again = packing.pack_documents(frame(spark, rows).repartition(3), group_docs=40).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(map(repr, got[key].fillna(-1).values.tolist())) == sorted(map(repr, again[key].fillna(-1).values.tolist()))
    assert all(zlib.crc32(b) == c and len(b) == 4 * n for b, c, n in zip(got.ids, got.ids_crc32, got.length))
    for i, t, *_ in rows:
        if i in (None, 3):
            continue
        own = got[got.doc_id == i].sort_values("start")
        assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert own.start.tolist() == np.r_[0, own.length.cumsum()][:-1].tolist() and set(own.doc_tokens) == {own.length.sum()}
    assert len(got[got.doc_id == 3]) == 2 and got.doc_id.isna().sum() == 1
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == np.r_[0, s.length.cumsum()][:-1].tolist() and s.length.sum() <= 2048
    filled = got.groupby("sequence_id").length.sum()
    assert filled.map(packing.padding).sum() < 0.12 * filled.sum()
    assert packing.pack_documents(frame(spark, [])).count() == 0
