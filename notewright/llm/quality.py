"""Operator 7: quality rules and a hashed n-gram logistic regression.

The verdict is a calibrated probability from a logistic regression over hashed words, word pairs and
character n-grams of words, held against a fixed threshold; texts that fail the base rules are out
whatever it says.  Words and character n-grams enter as (shrunk) means over a text's words, so a word's part
is one number that is computed once; word pairs are looked up by hash.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from notewright.llm import common
from notewright.llm.words import MIX, STEP, WordTable, codes, fit_logistic, gram_hashes

#: Fixed by the contract.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\r\x0b\x0c"
#: The probability of good quality from which on a text is kept.
THRESHOLD = 0.5
#: Bounds of the fit: labelled texts of each label, and bytes of each text.
SAMPLE, LONGEST = 2000, 65_536
BITS, GRAMS = 18, (3, 4)
#: Words that pull a short text's means towards nothing.
SHRINK = 8
PAIR_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def inner_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the character n-grams of the words, with their bounds, and each one's word."""
    flat, owner, end = codes([w.decode("utf-8", "replace") for w in words], "\x02", "\x03")
    found, owners = [], []
    for n in GRAMS:
        ok = np.arange(len(flat)) + n <= end
        found.append(gram_hashes(flat, n)[ok] >> np.uint64(64 - BITS))
        owners.append(owner[ok])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners)


def pairs(hashes: np.ndarray) -> np.ndarray:
    """Feature numbers of the word pairs of a text."""
    h = (hashes[:-1] * MIX + hashes[1:] * PAIR_MIX) * STEP
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows whose words occur twice or more in the text, the first included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = (h ^ ids[k : k + n].astype(np.uint64)) * MIX
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[:n] += again
    edges[window : window + n] -= again
    return int((np.cumsum(edges[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


@dataclass
class Model:
    """Weights of words, character n-grams and word pairs by feature number, the constant, and the
    calibration: probability = logistic(scale * margin + shift)."""

    words: np.ndarray
    grams: np.ndarray
    pairs: np.ndarray
    constant: float
    scale: float = 1.0
    shift: float = 0.0


class Scorer:
    def __init__(self, model: Model | None):
        self.model = model
        self.words = WordTable(self.rows, 2)

    def rows(self, words: list[bytes]) -> np.ndarray:
        """By word: its hash (as a float64 bit pattern) and its part of the margin."""
        h = word_hashes(words)
        out = np.zeros((len(words), 2))
        out[:, 0] = h.view(np.float64)
        if self.model is not None:
            features, owner = inner_grams(words)
            gram = np.bincount(owner, self.model.grams[features], len(words)) / np.maximum(np.bincount(owner, minlength=len(words)), 1)
            out[:, 1] = self.model.words[(h >> np.uint64(64 - BITS)).astype(np.int64)] + gram
        return out

    def texts(self, texts: list[str]) -> dict[str, np.ndarray]:
        words = [t.encode("utf-8", "replace").split() for t in texts]
        ids = self.words.ids(words)
        out = {c: np.zeros(len(texts), np.int64) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        margin = np.zeros(len(texts))
        hashes = np.ascontiguousarray(self.words.rows[:, 0]).view(np.uint64)
        for k, (t, i) in enumerate(zip(texts, ids, strict=True)):
            out["n_words"][k] = n = len(i)
            out["word_chars"][k] = len(t) - sum(map(t.count, SPACES))
            out["n_symbols"][k] = sum(map(t.count, SYMBOLS))
            out["n_dup_lines"][k] = repeated_lines(t)
            out["n_repeat_words"][k] = repeated_words(i)
            if self.model is not None:
                m = self.model.constant
                if n:
                    m += self.words.rows[i, 1].sum() / (n + SHRINK)
                if n > 1:
                    m += self.model.pairs[pairs(hashes[i])].sum() / (n - 1 + SHRINK)
                margin[k] = m
        if self.model is not None:
            out["margin"] = margin
            out["probability"] = 1 / (1 + np.exp(-np.clip(self.model.scale * margin + self.model.shift, -35, 35)))
        return out


def train(texts: list[str], good: np.ndarray, weight: np.ndarray | None = None, epochs: int = 12, rate: float = 0.5, l2: float = 1e-6, seed: int = 7) -> Model:
    """Fits the regression by AdaGrad on four fifths of the texts and calibrates it on the rest."""
    size = 1 << BITS
    model = Model(np.zeros(size), np.zeros(size), np.zeros(size), 0.0)
    if len(texts) < 10 or good.min() == good.max():
        model.constant = 4.0 if not len(good) or good.mean() >= 0.5 else -4.0
        return model
    scorer = Scorer(None)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(texts), 200):
        split = [t.encode("utf-8", "replace").split() for t in texts[at : at + 200]]
        vocabulary = sorted({w for ws in split for w in ws})
        number = {w: i for i, w in enumerate(vocabulary)}
        h = word_hashes(vocabulary)
        features, owner = inner_grams(vocabulary) if vocabulary else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        starts = np.searchsorted(np.sort(owner), np.arange(len(vocabulary) + 1))
        order = np.argsort(owner, kind="stable")
        for ws in split:
            i = np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))
            if not len(i):
                rows.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
                continue
            u, c = np.unique(i, return_counts=True)
            inner = [features[order[starts[w] : starts[w + 1]]] for w in u]
            many = np.array([len(x) for x in inner])
            inner_weight = np.repeat(c / (len(i) + SHRINK) / np.maximum(many, 1), many)
            p = pairs(h[i]) if len(i) > 1 else np.zeros(0, np.int64)
            f = np.concatenate([(h[u] >> np.uint64(64 - BITS)).astype(np.int64), size + np.concatenate(inner), 2 * size + p])
            v = np.concatenate([c / (len(i) + SHRINK), inner_weight, np.full(len(p), 1.0 / (len(p) + SHRINK))])
            f, back = np.unique(f, return_inverse=True)
            rows.append((f.astype(np.int32), np.bincount(back, v).astype(np.float32)))
    del scorer
    check = np.arange(len(texts)) % 5 == 4
    w, g2 = np.zeros(3 * size + 1), np.full(3 * size + 1, 1e-4)
    prior = good.mean()
    w[-1] = np.log(prior / (1 - prior))
    rng = np.random.default_rng(seed)
    learn = np.flatnonzero(~check)
    balance = np.where(good > 0, 0.5 / prior, 0.5 / (1 - prior))
    for _ in range(epochs):
        rng.shuffle(learn)
        for at in range(0, len(learn), 64):
            batch = learn[at : at + 64]
            f = np.concatenate([rows[i][0] for i in batch])
            v = np.concatenate([rows[i][1] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            z = np.bincount(owner, v * w[f], len(batch)) + w[-1]
            error = balance[batch] * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - good[batch])
            touched, back = np.unique(f, return_inverse=True)
            grad = np.bincount(back, v * error[owner]) + l2 * w[touched]
            g2[touched] += grad**2
            w[touched] -= rate * grad / np.sqrt(g2[touched])
            g2[-1] += error.sum() ** 2
            w[-1] -= rate * error.sum() / np.sqrt(g2[-1])
    model = Model(w[:size], w[size : 2 * size], w[2 * size : 3 * size], float(w[-1]))
    held = np.flatnonzero(check)
    margin = np.array([w[-1] + (rows[i][1] * w[rows[i][0]]).sum() for i in held])
    if good[held].min() < good[held].max():
        scale, shift = fit_logistic(margin[:, None], good[held].astype(float), l2=1e-2, weight=None if weight is None else weight[held])
        if scale > 0:
            model.scale, model.shift = float(scale), float(shift)
    return model


@common.frugal
def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Learns from about ``sample`` labelled texts of each label at most, each of at most ``longest``
    bytes.  The bounded list of their ids is broadcast, so the documents are not shuffled."""
    rows = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).alias("label"))
    shares = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    chosen = common.bounded_sample(rows, "label", "key", sample, seed=7)
    found = docs.where(F.octet_length(text) <= longest).select(F.col(key).alias("key"), F.col(text).alias("text"))
    # At most about 2 * sample rows of two numbers: a proven bound.
    got = found.join(F.broadcast(chosen), "key").toArrow().sort_by([("key", "ascending"), ("label", "ascending")])
    order = np.random.default_rng(7).permutation(got.num_rows)
    texts, good = got["text"].to_pylist(), np.array(got["label"].to_pylist(), np.float64)
    # For the calibration a text weighs as its label's share of all labels.
    weight = np.array([max(1.0, shares.get(int(y), 1) / sample) for y in good])
    return train([texts[i] for i in order], good[order], weight[order])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, the base counts, ``base_failed``, ``quality`` and ``kept``, in one narrow pass.

    Null and empty texts have no words: they fail the base rules.  Repeated rows give repeated rows,
    an empty table an empty result; columns that are not kept are not read, so names cannot clash.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # three tables of 2**BITS numbers
    mark = uuid.uuid4().hex
    names = [f"keep_{i}" for i in range(len(keep))]
    schema = pa.schema([*zip(names, [to_arrow_type(docs.schema[c].dataType) for c in keep], strict=True), *((c, pa.int64()) for c in COUNTS), ("quality", pa.float64())])
    ddl = ", ".join([*(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)), *(f"{c} long" for c in COUNTS), "quality double"])

    def scored(batch: pa.RecordBatch) -> dict[str, object]:
        found = common.held(("quality", mark), lambda: Scorer(shared.value)).texts(common.texts_of(batch.column(len(keep))))
        return {n: batch.column(i) for i, n in enumerate(names)} | {c: found[c] for c in COUNTS} | {"quality": found["probability"]}

    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).alias("text"))
    out = rows.mapInArrow(common.by_batch(scored, schema), ddl)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *COUNTS, failed.alias("base_failed"), "quality", (~failed & (F.col("quality") >= threshold)).alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
