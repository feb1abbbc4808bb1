"""Operator 4: language ID by interpolated Kneser-Ney character models.

For each language an interpolated Kneser-Ney model over the letters of words is counted.  All models
are kept in sorted arrays of n-gram hashes; one row has the log-probability in every language, so a
letter is looked up once for all of them.  The language with the lowest cross-entropy for each letter
wins; a text whose cross-entropy is beyond what calibration texts of its length show is rejected.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from notewright.llm import common
from notewright.llm.words import WordTable, codes, gram_hashes

ORDER, DISCOUNT, ALPHABET = 4, 0.75, 400
#: Bounds of the fit: texts of each language, and bytes of each text that is learned from.
SAMPLE, LONGEST = 1200, 65_536
UNDETERMINED = "und"
START, END = "\x02", "\x03"


def letters(token: str) -> list[str]:
    """The runs of letters of a token, in lower case."""
    token = token.lower()
    return [token] if token.isalpha() else "".join(c if c.isalpha() else " " for c in token).split()


@dataclass
class Models:
    """Sorted hashes of the n-grams (``grams[n]``, with a row of log-probabilities by language) and of
    the contexts (``contexts[n]``, with a row of log back-off weights) of each order n."""

    languages: list[str]
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: float
    limits: np.ndarray | None = None

    def score(self, words: list[str]) -> np.ndarray:
        """For each word (letters only, lower case) the log-probabilities by language, and last the
        number of symbols that these are of."""
        k = len(self.languages)
        out = np.zeros((len(words), k + 1))
        if not words:
            return out
        flat, owner, _ = codes(words, START * (ORDER - 1), END)
        real = np.flatnonzero(flat != ord(START))
        left = np.arange(len(real))  # not found yet
        total = np.zeros((len(real), k))
        for n in range(ORDER, 0, -1):
            at = real[left] - (n - 1)
            h = gram_hashes(flat, n)[at]
            i = np.minimum(np.searchsorted(self.grams[n], h), len(self.grams[n]) - 1)
            hit = self.grams[n][i] == h
            total[left[hit]] += self.logs[n][i[hit]]
            left = left[~hit]
            if not len(left):
                break
            if n > 1:
                c = gram_hashes(flat, n - 1)[real[left] - (n - 1)]
                j = np.minimum(np.searchsorted(self.contexts[n], c), len(self.contexts[n]) - 1)
                known = self.contexts[n][j] == c
                total[left[known]] += self.backoff[n][j[known]]
            else:
                total[left] += self.backoff[1][0] + self.unseen
        for lang in range(k):
            out[:, lang] = np.bincount(owner[real], total[:, lang], len(words))
        out[:, k] = np.bincount(owner[real], minlength=len(words))
        return out


def _counts(words: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By order n: hashes of the n-grams, their Kneser-Ney counts, and the hashes of their contexts
    (all but the last letter) and of their tails (all but the first)."""
    flat, owner, _ = codes(list(words), START * (ORDER - 1), END)
    weight = np.fromiter(words.values(), np.float64)[owner]
    real = np.flatnonzero(flat != ord(START))
    hashes = [None, *(gram_hashes(flat, n) for n in range(1, ORDER + 1))]
    found = [None] * (ORDER + 1)
    for n in range(ORDER, 0, -1):
        at = real - (n - 1)
        h, first = np.unique(hashes[n][at], return_index=True)
        at = at[first]
        context = hashes[n - 1][at] if n > 1 else np.zeros(len(at), np.uint64)
        tail = hashes[n - 1][at + 1] if n > 1 else np.zeros(len(at), np.uint64)
        if n == ORDER:
            count = np.bincount(np.searchsorted(h, hashes[n][real - (n - 1)]), weight[real], len(h))
        else:  # in how many ways the n-gram is continued to the left
            above = found[n + 1][3]
            count = np.bincount(np.searchsorted(h, above), minlength=len(h)).astype(float)
        found[n] = (h, count, context, tail)
    return found


def train(texts: dict[str, list[str]]) -> Models:
    """Counts the models; ``texts`` by language.  Without any, all is undetermined."""
    texts = texts or {UNDETERMINED: []}
    languages = sorted(texts)
    per = []
    for lang in languages:
        words: dict[str, int] = {}
        for t in texts[lang]:
            for token in t.split():
                for w in letters(token):
                    words[w] = words.get(w, 0) + 1
        per.append(_counts(words or {"": 1}))
    k, unseen = len(languages), float(-np.log(ALPHABET))
    grams, logs, contexts, backoff = [None], [None], [None, np.zeros(1, np.uint64)], [None, np.zeros((1, k))]
    for n in range(1, ORDER + 1):
        all_grams = np.unique(np.concatenate([p[n][0] for p in per]))
        first_context = np.zeros(len(all_grams), np.uint64)
        first_tail = np.zeros(len(all_grams), np.uint64)
        for p in per:
            i = np.searchsorted(all_grams, p[n][0])
            first_context[i], first_tail[i] = p[n][2], p[n][3]
        all_contexts = np.unique(np.concatenate([p[n][2] for p in per]))
        weights, probs = np.zeros((len(all_contexts), k)), np.zeros((len(all_grams), k))
        lower = np.exp(logs[n - 1]) if n > 1 else None
        for lang, p in enumerate(per):
            h, count, context, _ = p[n]
            c = np.searchsorted(all_contexts, context)
            total = np.bincount(c, count, len(all_contexts))
            kinds = np.bincount(c, minlength=len(all_contexts))
            gamma = np.where(total > 0, DISCOUNT * np.minimum(kinds, total / DISCOUNT) / np.maximum(total, 1e-300), 1.0)
            weights[:, lang] = np.log(np.maximum(gamma, 1e-12))
            where = np.searchsorted(all_contexts, first_context)
            g = gamma[where]
            base = np.full(len(all_grams), 1.0 / ALPHABET)
            if n > 1:
                j = np.minimum(np.searchsorted(grams[n - 1], first_tail), len(grams[n - 1]) - 1)
                base = np.where(grams[n - 1][j] == first_tail, lower[j, lang], 1.0 / ALPHABET)
            own = np.zeros(len(all_grams))
            own[np.searchsorted(all_grams, h)] = np.maximum(count - DISCOUNT, 0) / np.maximum(total[c], 1e-300)
            probs[:, lang] = own + g * base
        grams.append(all_grams)
        logs.append(np.log(probs))
        if n > 1:
            contexts.append(all_contexts)
            backoff.append(weights)
        else:
            contexts[1], backoff[1] = all_contexts, weights
    return Models(languages, grams, logs, contexts, backoff, unseen)


class Judge:
    """Scores whole texts with remembered words."""

    def __init__(self, models: Models):
        self.models = models
        self.words = WordTable(self.tokens, len(models.languages) + 1)

    def tokens(self, tokens: list[str]) -> np.ndarray:
        runs = [letters(t) for t in tokens]
        owner = np.repeat(np.arange(len(tokens)), [len(r) for r in runs])
        rows = self.models.score([w for r in runs for w in r])
        out = np.zeros((len(tokens), rows.shape[1]))
        for c in range(rows.shape[1]):
            out[:, c] = np.bincount(owner, rows[:, c], len(tokens))
        return out

    def sums(self, texts: list[str]) -> np.ndarray:
        ids = self.words.ids([t.split() for t in texts])
        return np.array([self.words.rows[i].sum(0) for i in ids]).reshape(len(texts), self.words.width)

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy in nats a symbol, and whether the text is accepted."""
        sums, k = self.sums(texts), len(self.models.languages)
        n = sums[:, k]
        entropy = -sums[:, :k] / np.maximum(n, 1)[:, None]
        best = entropy.argmin(1) if k else np.zeros(len(texts), int)
        lowest = entropy[np.arange(len(texts)), best]
        # Letters in a row are not independent: the evidence is tempered.
        odds = np.exp(-np.minimum((entropy - lowest[:, None]) * np.minimum(n, 200)[:, None] * 0.5, 50))
        score = np.where(n > 0, 1 / odds.sum(1), 0.0)
        mean, spread, each, z = self.models.limits[best].T if self.models.limits is not None else np.tile([np.inf, 0, 0, 0], (len(texts), 1)).T
        accepted = (n > 0) & (lowest <= mean + z * np.sqrt(spread**2 + each**2 / np.maximum(n, 1)))
        names = [self.models.languages[b] if m > 0 else UNDETERMINED for b, m in zip(best, n, strict=True)]
        return names, score, np.where(n > 0, lowest, 0.0), accepted


def calibrate(models: Models, texts: dict[str, list[str]], accept: float = 0.999, slack: float = 1.5) -> Models:
    """Sets, by language, how far the cross-entropy of an accepted text may lie above the mean:
    ``slack`` times what all but ``1 - accept`` of the calibration texts of that language need."""
    judge = Judge(models)
    limits = []
    for i, lang in enumerate(models.languages):
        sums = judge.sums(texts.get(lang, []))
        sums = sums[sums[:, -1] > 0]
        if not len(sums):
            limits.append([np.inf, 0.0, 0.0, 0.0])
            continue
        n, e = sums[:, -1], -sums[:, i] / sums[:, -1]
        mean = float(np.average(e, weights=n))
        spread = float(np.sqrt(np.average((e - mean) ** 2, weights=n))) + 1e-3
        each = float(np.sqrt(np.median((e - mean) ** 2 * n))) + 1e-3
        z = float(np.quantile((e - mean) / np.sqrt(spread**2 + each**2 / n), accept))
        limits.append([mean, spread, each, slack * max(z, 4.0)])
    models.limits = np.array(limits, float).reshape(len(limits), 4)
    return models


@common.frugal
def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, longest: int = LONGEST) -> Models:
    """Learns the languages of ``lang`` from at most about ``sample`` texts of each, of at most
    ``longest`` bytes; three quarters are counted, the rest calibrates."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.octet_length(text) <= longest))
    rows = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    got = common.bounded_sample(rows, "lang", "key", sample, seed=4).toArrow().sort_by([("key", "ascending"), ("text", "ascending")])
    learn: dict[str, list[str]] = {}
    check: dict[str, list[str]] = {}
    for i, (t, name) in enumerate(zip(got["text"].to_pylist(), got["lang"].to_pylist(), strict=True)):
        learn.setdefault(name, [])
        (check if i % 4 == 3 else learn).setdefault(name, []).append(t)
    return calibrate(train(learn), check)


def predict(docs: DataFrame, models: Models, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred, score, entropy, accepted`` for each row, in one narrow pass.

    Null texts and texts without a letter are ``und``, with score 0 and not accepted.  Only the text
    is looked at.  An empty table gives an empty result; with no language learned all is ``und``.
    Columns that are not kept are not read, so extra names cannot clash.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(models)  # bounded by the sample
    mark = uuid.uuid4().hex
    kept = [to_arrow_type(docs.schema[c].dataType) for c in keep]
    names = [f"keep_{i}" for i in range(len(keep))]
    schema = pa.schema([*zip(names, kept, strict=True), ("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("accepted", pa.bool_())])
    ddl = ", ".join([*(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)), "lang_pred string, score double, entropy double, accepted boolean"])

    def judged(batch: pa.RecordBatch) -> dict[str, object]:
        lang, score, entropy, accepted = common.held(("languages", mark), lambda: Judge(shared.value)).judge(common.texts_of(batch.column(len(keep))))
        return {n: batch.column(i) for i, n in enumerate(names)} | {"lang_pred": lang, "score": score, "entropy": entropy, "accepted": accepted}

    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).alias("text"))
    out = rows.mapInArrow(common.by_batch(judged, schema), ddl)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "lang_pred", "score", "entropy", "accepted")


def accepted(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """The rows whose text is accepted, with all their columns."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample
    mark = uuid.uuid4().hex

    def keep(texts: list[str]) -> np.ndarray:
        return common.held(("languages", mark), lambda: Judge(shared.value)).judge(texts)[3]

    return common.filtered(docs, text, keep)


def held_out():
    return F.pmod(common.crc_of(F.col("doc_id")), F.lit(4)) == 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    models = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    out = predict(docs, models)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "accepted")
