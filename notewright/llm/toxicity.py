"""Operator 8: toxicity by a subsequence string kernel and a support vector machine.

The kernel of two words is the sum, over all subsequences of three characters that both hold (gaps
allowed), of the products of their decayed weights: a subsequence that spans s characters counts
``DECAY ** s``.  Insults with characters put in between, or with other endings, still share most of
their subsequences.  The kernel is taken to Nyström landmarks; a linear support vector machine is
trained on that map.  Since the machine is linear in the kernel's features, landmarks and machine
fold into one weight for each (hashed) subsequence, and a word is scored by adding up its own.

Labels are of whole texts.  Which words of a toxic text are meant is found by how often they occur
in toxic and in clean texts in *different surroundings* (copies of one text count once), by a
binomial test.  A text's score is a calibrated logistic function of its worst words.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from notewright.llm import common
from notewright.llm.words import WordTable, codes, fit_logistic

DECAY, REACH, BITS = 0.6, 7, 18
LANDMARKS = 256
#: Bounds of the fit: labelled texts of each label, and bytes of each text.
SAMPLE, LONGEST = 3000, 65_536
#: Words whose subsequences are laid out at once.
PORTION = 4096
#: Rounds of the fit, words of a text that a round looks at, how soon a word that is less bad than the worst counts
#: less, and words whose margins are followed after the first round.
ROUNDS, WORST, SOFTNESS, NEAR = 5, 6, 0.25, 30_000
#: What a text's calibrated score is made of; the margin from which a word is surely toxic.
FEATURES, SURE = 4, 0.8
SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
PIECES = re.compile(r"[^\W_]{3,}")
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def plain(token: str) -> str:
    """Letters and digits of a token in lower case: signs put in between are gone."""
    return token.lower() if token.isalnum() else "".join(c for c in token if c.isalnum()).lower()


def units(text: str) -> list[str]:
    """The words of a text, and words spelled out in single characters put together."""
    words = text.split()
    if SPELLED.search(text):
        words += [re.sub(r"\s", "", m) for m in SPELLED.findall(text)]
    return words


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed number, word and weight of each subsequence of three characters within ``REACH``.

    Words are padded by one sign on both sides, so that beginnings and ends count.
    """
    flat, owner, end = codes(words, "\x02", "\x03")
    at = np.arange(len(flat))
    found, owners, weights = [], [], []
    for b in range(2, REACH):
        ok = np.flatnonzero(at + b < end)
        last = flat[ok + b] * C
        for a in range(1, b):
            h = ((flat[ok] * A) ^ (flat[ok + a] * B)) * C ^ last
            h = (h ^ (h >> np.uint64(31))) * A
            found.append((h >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(owner[ok])
            weights.append(np.full(len(ok), DECAY ** (b + 1)))
    return np.concatenate(found), np.concatenate(owners), np.concatenate(weights)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As above with the weights of a word scaled to unit length: the kernel of a word that repeats no
    subsequence with itself is 1."""
    f, o, w = subsequences(words)
    norm = np.sqrt(np.bincount(o, w * w, len(words)))
    return f, o, w / np.maximum(norm, 1e-12)[o]


def kernel_to(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The kernel of each word with each landmark."""
    f, o, w = features(landmarks)
    number, f = np.unique(f, return_inverse=True)
    table = np.zeros((len(number), len(landmarks)))
    np.add.at(table, (f, o), w)
    g, p, v = features(words)
    i = np.minimum(np.searchsorted(number, g), len(number) - 1)
    hit = number[i] == g
    out = np.zeros((len(words), len(landmarks)))
    order = np.flatnonzero(hit)
    for start in range(0, len(order), 20_000):
        part = order[start : start + 20_000]
        np.add.at(out, p[part], v[part, None] * table[i[part]])
    return out


@dataclass
class Model:
    """One weight for each hashed subsequence, the machine's constant, and the calibration of a text's
    ``FEATURES`` numbers (see ``Scorer.summary``) into a probability."""

    weights: np.ndarray
    constant: float
    calibration: np.ndarray

    def margins(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        parts = []
        for at in range(0, len(words), PORTION):
            f, o, w = features(words[at : at + PORTION])
            parts.append(np.bincount(o, w * self.weights[f], len(words[at : at + PORTION])))
        m = np.concatenate(parts) + self.constant
        return np.where(np.fromiter(map(len, words), np.int64, len(words)) > 1, m, -2.0)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.words = WordTable(lambda tokens: self.tokens(tokens)[:, None], 1)

    def tokens(self, tokens: list[str]) -> np.ndarray:
        """The margin of each token with the signs in it left out, or that of its worst piece between
        signs if this is more."""
        m = self.model.margins([plain(t) for t in tokens])
        pieces = [(i, p) for i, t in enumerate(tokens) if not t.isalnum() for p in PIECES.findall(t.lower())]
        if pieces:
            np.maximum.at(m, [i for i, _ in pieces], self.model.margins([p for _, p in pieces]))
        return m

    def summary(self, texts: list[str]) -> np.ndarray:
        """For each text the margins of its worst and second worst word, between -1 and 1, and the
        logarithm of how many words are beyond 0, and beyond ``SURE``."""
        ids = self.words.ids([units(t) for t in texts])
        out = np.tile([-1.0, -1.0, 0.0, 0.0], (len(texts), 1))
        column = self.words.rows[:, 0]
        for k, i in enumerate(ids):
            if len(i):
                m = np.sort(np.clip(column[np.unique(i)], -1, 1))
                out[k] = m[-1], m[-2] if len(m) > 1 else -1.0, np.log1p((m > 0).sum()), np.log1p((m >= SURE).sum())
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        c = self.model.calibration
        return 1 / (1 + np.exp(-np.clip(self.summary(texts) @ c[:-1] + c[-1], -35, 35)))


def telling_words(texts: list[str], toxic: np.ndarray) -> tuple[list[str], list[str]]:
    """Words to choose landmarks from: those that toxic texts hold more often than chance allows, and
    words of clean texts, the most frequent first.

    A word is counted once for each surrounding (the words before and after it) and text label.
    """
    number: dict[str, int] = {}
    ids, around = [], []
    for t in texts:
        mine = np.fromiter((number.setdefault(w, len(number)) for w in map(plain, units(t)) if len(w) > 1), np.int64, -1)
        padded = np.r_[-1, mine, -1].astype(np.uint64)
        ids.append(mine)
        around.append((padded[:-2] * A) ^ (padded[2:] * B))
    if not number:
        return [], []
    owner = np.repeat(toxic.astype(np.int64), [len(i) for i in ids])
    rows = np.unique(np.rec.fromarrays([np.concatenate(ids), owner, np.concatenate(around)], names="word,toxic,around"))
    bad, clean = (np.bincount(rows["word"][rows["toxic"] == y], minlength=len(number)) for y in (1, 0))
    rate = max(1, bad.sum()) / max(2, bad.sum() + clean.sum())
    # Chernoff's bound of the binomial tail, against all words at once.
    n = np.maximum(bad + clean, 1)
    p = bad / n
    with np.errstate(divide="ignore", invalid="ignore"):
        tail = -n * (np.where(p > 0, p * np.log(p / rate), 0) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - rate)), 0))
    found = (bad >= 3) & (p >= max(0.5, 3 * rate) if rate < 1 / 3 else p > 0.99) & (tail < np.log(0.05 / max(1, (bad > 0).sum())))
    names = np.array(list(number), object)
    order = np.argsort(-clean, kind="stable")
    return sorted(names[found]), list(names[order[clean[order] > 0]])


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, rounds: int = 400) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton's method on its active set."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(min(rounds, 60)):
        inside = y * (x @ w) < 1
        xa, ca = x[inside], cost * weight[inside]
        new = np.linalg.solve((xa * ca[:, None]).T @ xa + ridge, xa.T @ (ca * y[inside]))
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def nystroem(landmarks: list[str]) -> np.ndarray:
    """The matrix that takes kernels with the landmarks to coordinates whose products are the kernel."""
    k = kernel_to(landmarks, landmarks)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    good = values > 1e-6 * values.max()
    return vectors[:, good] / np.sqrt(values[good])


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray, seed: int = 8) -> Model:
    """Fits on three quarters of the texts, calibrates on the rest.

    The machine learns labelled texts.  The kernel of two texts is the sum of the kernels of their
    words, each weighed by how the machine of the round before takes it, so a toxic text is one
    example made of its worst words; of a clean text every word is clean, and its worst ones are an
    example each.  Toxic texts without any word near the others' are left out as mislabelled.
    """
    base = float(np.clip(np.average(toxic, weights=weight) if len(toxic) else 0.0, 1e-3, 0.4))
    nothing = Model(np.zeros(1 << BITS), -1.0, np.array([0.0] * FEATURES + [np.log(base / (1 - base))]))
    if len(texts) < 8:
        return nothing
    learn = np.arange(len(texts)) % 4 != 3
    learned = [t for t, k in zip(texts, learn, strict=True) if k]
    y, cost = np.where(toxic[learn] > 0, 1.0, -1.0), weight[learn]
    bad, clean = telling_words(learned, toxic[learn])
    if not bad or not clean:
        return nothing
    rng = np.random.default_rng(seed)
    pick = lambda pool, n: [pool[i] for i in np.sort(rng.choice(len(pool), min(n, len(pool)), replace=False))]
    landmarks = pick(bad, LANDMARKS // 2) + pick(clean, LANDMARKS // 2)
    root = nystroem(landmarks)
    f, o, w = features(landmarks)
    n_bad = min(LANDMARKS // 2, len(bad))
    # The first machine: nearness to the one half of the landmarks less that to the other.
    sign = np.r_[np.full(n_bad, 1 / n_bad), np.full(len(landmarks) - n_bad, -1 / (len(landmarks) - n_bad))]
    model = Model(np.bincount(f, w * sign[o], 1 << BITS), 0.0, nothing.calibration)
    vocabulary: dict[str, int] = {}
    held = [np.unique(np.fromiter((vocabulary.setdefault(u, len(vocabulary)) for u in map(plain, units(t)) if len(u) > 1), np.int64, -1)) for t in learned]
    names = np.array(list(vocabulary), object)
    margin, near = model.margins(names.tolist()), np.arange(len(names))
    known: dict[int, np.ndarray] = {}
    for turn in range(ROUNDS):
        # The words of each text that count, the worst first.
        worst = [i[np.argsort(-margin[i], kind="stable")[:WORST]] for i in held]
        fresh = sorted({int(i) for k in worst for i in k} - set(known))
        known.update(zip(fresh, kernel_to(names[fresh].tolist(), landmarks) @ root, strict=True))
        x, label, each = [], [], []
        for i, t, c in zip(worst, y, cost, strict=True):
            if not len(i):
                continue
            m = margin[i]
            if t > 0:
                if turn and m[0] < -1:
                    continue
                share = np.exp((m - m[0]) / SOFTNESS)
                x.append(share @ np.array([known[j] for j in i.tolist()]) / share.sum())
                label.append(1.0)
                each.append(c)
            else:
                x += [known[j] for j in i.tolist()]
                label += [-1.0] * len(i)
                each += [c / len(i)] * len(i)
        if len(set(label)) < 2:
            return nothing
        label, each = np.array(label), np.array(each)
        for side in (1, -1):
            each[label == side] *= 0.5 * len(learned) / each[label == side].sum()
        v = machine(np.array(x), label, each)
        model = Model(np.bincount(f, w * (root @ v[:-1])[o], 1 << BITS), float(v[-1]), nothing.calibration)
        margin[near] = model.margins(names[near].tolist())
        # Words that no machine takes to be toxic stay what they are.
        near = np.argsort(-margin, kind="stable")[:NEAR]
    scorer = Scorer(model)
    check = np.flatnonzero(~learn)
    x = scorer.summary([texts[i] for i in check])
    if toxic[check].min() < toxic[check].max():
        model.calibration = fit_logistic(x, toxic[check].astype(float), l2=0.1, weight=weight[check])
    else:
        model.calibration = np.array([4.0] + [0.0] * FEATURES)
    return model


@common.frugal
def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Learns from about ``sample`` labelled texts of each label at most, each of at most ``longest``
    bytes.  The bounded list of their ids is broadcast, so the documents are not shuffled.  Texts
    weigh as their label's share of all labels."""
    rows = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).alias("label"))
    shares = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    chosen = common.bounded_sample(rows, "label", "key", sample, seed=8)
    found = docs.where(F.octet_length(text) <= longest).select(F.col(key).alias("key"), F.col(text).alias("text"))
    # At most about 2 * sample rows of two numbers: a proven bound.
    got = found.join(F.broadcast(chosen), "key").toArrow().sort_by([("key", "ascending"), ("label", "ascending")])
    order = np.random.default_rng(8).permutation(got.num_rows)
    texts, toxic = got["text"].to_pylist(), np.array(got["label"].to_pylist(), np.float64)
    weight = np.array([max(1.0, shares.get(int(y), 1) / sample) for y in toxic])
    return train([texts[i] for i in order], toxic[order], weight[order])


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``score`` and ``predicted``, in one narrow pass.

    Null and empty texts are scored as texts without a word, which is far from toxic.  Without a
    usable label every text gets the share of toxic labels.  Repeated rows give repeated rows, an
    empty table an empty result; columns that are not kept are not read, so names cannot clash.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # one table of 2**BITS numbers
    mark = uuid.uuid4().hex
    names = [f"keep_{i}" for i in range(len(keep))]
    schema = pa.schema([*zip(names, [to_arrow_type(docs.schema[c].dataType) for c in keep], strict=True), ("score", pa.float64())])
    ddl = ", ".join([*(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)), "score double"])

    def scored(batch: pa.RecordBatch) -> dict[str, object]:
        return {n: batch.column(i) for i, n in enumerate(names)} | {"score": common.held(("toxicity", mark), lambda: Scorer(shared.value)).score(common.texts_of(batch.column(len(keep))))}

    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).alias("text"))
    out = rows.mapInArrow(common.by_batch(scored, schema), ddl)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one table of 2**BITS numbers
    mark = uuid.uuid4().hex

    def keep(texts: list[str]) -> np.ndarray:
        return common.held(("toxicity", mark), lambda: Scorer(shared.value)).score(texts) < 0.5

    return common.filtered(docs, text, keep)


def held_out():
    return F.coalesce(F.pmod(common.crc_of(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
