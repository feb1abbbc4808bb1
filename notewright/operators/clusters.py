"""Online clustering of semantic masters around moving centroids.

The assignment of a master depends on all masters before it, so it is one ordered fold, over masters
only (duplicates are gone by then) and only the columns it needs.  ``search='lsh'`` bounds the work of
a step by looking at close signatures and the latest clusters only, once there are many.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.config import check_threshold
from notewright.functions import text as T
from notewright.functions.vectors import BITS, signatures

RECENT, LSH_FROM = 64, 512


def mean_unit(total: np.ndarray, n: int) -> np.ndarray:
    """The mean as floats, scaled to unit length; all zero stays so."""
    mean = (total / n).astype(np.float32)
    size = np.sqrt((mean.astype(np.float64) ** 2).sum())
    return (mean / size).astype(np.float32) if size else np.zeros(0, np.float32)


class Clusters:
    """The state of the fold."""

    def __init__(self, threshold: float, lsh_from: int | None):
        self.threshold, self.lsh_from = threshold, lsh_from
        self.ids: list[str] = []
        self.sums: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.rows = np.zeros((0, 0), np.float32)
        self.signs: list[int] = []
        self.buckets: dict[int, set[int]] = {}

    def lookup(self, v: np.ndarray) -> np.ndarray:
        n = len(self.ids)
        if self.lsh_from is None or n < self.lsh_from:
            return np.arange(n)
        own = int(signatures(v[None])[0])
        found = set(range(max(0, n - RECENT), n)).union(*(self.buckets.get(k, ()) for k in [own, *(own ^ (1 << b) for b in range(BITS))]))
        return np.array(sorted(found), np.int64)

    def sign(self, i: int, v: np.ndarray) -> None:
        if self.lsh_from is None:
            return
        s = int(signatures(v[None])[0])
        if i < len(self.signs):
            self.buckets[self.signs[i]].discard(i)
            self.signs[i] = s
        else:
            self.signs.append(s)
        self.buckets.setdefault(s, set()).add(i)

    def add(self, name: str, v: np.ndarray) -> str:
        at = self.lookup(v)
        if len(at):
            sims = self.rows[at].astype(np.float64) @ v.astype(np.float64)
            near = at[(sims >= self.threshold) & (sims == sims.max())]
            if len(near):
                i = min(near, key=lambda k: self.ids[k])
                self.sums[i] += v
                self.sizes[i] += 1
                self.rows[i] = mean_unit(self.sums[i], self.sizes[i])
                self.sign(i, self.rows[i])
                return self.ids[i]
        i = len(self.ids)
        if i >= len(self.rows):
            grown = np.zeros((max(64, 2 * i), len(v)), np.float32)
            grown[:i, : self.rows.shape[1]] = self.rows[:i]
            self.rows = grown
        self.ids.append(name)
        self.sums.append(v.astype(np.float64))
        self.sizes.append(1)
        self.rows[i] = v
        self.sign(i, v)
        return name


def assign(masters: DataFrame, threshold: float, search: str = "exact", lsh_from: int = LSH_FROM) -> DataFrame:
    """``note_id, cluster_id`` of each master (columns note_id, source_chat, source_msg_id, embedding)."""
    check_threshold("cluster threshold", threshold)
    named = masters.withColumn("own", F.concat_ws("-", F.lit("cluster"), T.slugify(F.col("source_chat")), F.col("source_msg_id").cast("string")))
    rows = named.select("note_id", "source_msg_id", "source_chat", "own", F.col("embedding").cast("array<float>").alias("embedding"))

    def fold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = Clusters(threshold, lsh_from if search == "lsh" else None)
        for batch in batches:
            found = [state.add(own, np.asarray(v, np.float32)) for own, v in zip(batch["own"], batch["embedding"], strict=True)]
            yield pd.DataFrame({"note_id": batch["note_id"], "cluster_id": found})

    # One ordered stream: the state is a row for each cluster, the batches pass through.
    ordered = rows.repartition(1).sortWithinPartitions("source_msg_id", "source_chat")
    return ordered.mapInPandas(fold, "note_id string, cluster_id string")


def centroids(masters: DataFrame) -> DataFrame:
    """``cluster_id, centroid, members`` from masters with their ``cluster_id``: the mean of the
    members' vectors in unit length.  A distributed sum by position; a cluster of one keeps its vector."""
    parts = masters.select("cluster_id", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("cluster_id", "i").agg((F.sum(F.col("x").cast("double")) / F.count(F.lit(1))).cast("float").alias("m"), F.count(F.lit(1)).alias("n"))
    rows = means.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("v"), F.max("n").alias("members"))
    mean = F.transform("v", lambda x: x["m"])
    size = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.when(size > 0, F.when(F.col("members") == 1, mean).otherwise(F.transform(mean, lambda x: (x.cast("double") / size).cast("float"))))
    return rows.select("cluster_id", F.coalesce(unit, F.array().cast("array<float>")).alias("centroid"), "members")


def named(masters: DataFrame) -> DataFrame:
    """``cluster_id, name, slug`` from each cluster's first master."""
    chat = T.slugify(F.col("source_chat"))
    own = F.concat_ws("-", F.lit("cluster"), chat, F.col("source_msg_id").cast("string"))
    first = masters.where(F.col("cluster_id") == own)
    return first.select("cluster_id", F.col("title").alias("name"), F.concat_ws("-", T.slugify(F.col("title")), chat, F.col("source_msg_id").cast("string")).alias("slug"))
