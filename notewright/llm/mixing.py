"""Operator 10 [native]: mixing sources to target weights by weighted fair queueing.

Each shuffled document gets a virtual finish time: its source's words up to and with it, divided by
the source's target.  All documents, twice over (a source may be repeated once), are put in order of
finish time, and the order is truncated at the total budget.

All of it is DataFrame operations.  Two running sums are needed, within a source and over all
documents; neither is left to one task:

* Within a source, documents are cut by their shuffle key into about sqrt(n) equal ranges.  The sums
  of the ranges (pre-aggregated) give each range its offset, and inside a range a window adds the
  rest, so a source with a third of all rows is as many windows as it has ranges.
* Over all documents, finish times are cut into about sqrt(n) ranges in the same way.  Only the one
  range in which the budget ends is sorted row by row; what is before it is taken, what is after it
  is not.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from notewright.llm import common

#: Fixed by the contract: weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MOST_TIMES = 1.5, 2


def word_count(text):
    """Words of a text, 0 for null: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, times: int = MOST_TIMES) -> DataFrame:
    """``source, source_size, target``: one row for each source.

    Water filling in closed form.  Sources in order of cap over weight: while the level that the
    rest of the budget would reach is over a source's cap, the source is filled to its cap.  The
    windows without a partition run over one row for each source, after aggregation: one task, which
    some millions of sources fit.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("most", (F.col("source_size") * times).cast("double"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("weights", F.sum("weight").over(everything))
    per = per.withColumn("level", level)
    # The first source that the level does not fill sets the level for all after it.
    per = per.withColumn("final", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct((F.col("most") / F.col("weight")).alias("r"), F.col("level").alias("l")))).over(everything))
    target = F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("final.l") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def shuffle_key(key, seed: int):
    """32 bits that shuffle the documents: a digest of seed and key, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def queue(docs: DataFrame, text: str, key: str, source: str, weights: tuple[int, ...], share: float, times: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """The sized documents, the queue with finish times, the targets and the time of truncation."""
    tables = common.Tables(docs.sparkSession, "mix")
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), shuffle_key(F.col(key), seed).alias("h"))
    sized = tables.put("sized", sized)
    ranges = max(1, math.isqrt(sized.count()))
    targets = tables.put("targets", source_targets(sized, weights, share, times))

    rows = sized.where("size > 0").withColumn("part", F.floor(F.col("h") * ranges / float(1 << 32)).cast("int"))
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("source", "part", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset"))
    offsets = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).select(offsets["source"], "part", "offset", "source_size", "target")
    # Rows that agree in all of these are taken together or not at all.
    inside = W.partitionBy("source", "part").orderBy("h", "key", "size").rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("inner", F.sum("size").over(inside)).alias("r")
    joined = rows.join(offsets.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.part") == F.col("o.part")))
    first = (F.col("inner") + F.col("offset")) / F.col("target")
    # Epoch e of a source starts when e times its words have gone by.
    joined = joined.select("key", "r.source", "size", "h", "source_size", "target", first.alias("finish"), (F.col("source_size") / F.col("target")).alias("lap"))
    queued = tables.put("queued", joined)
    return sized, queued, targets, _cut_time(queued, targets, times, ranges)


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, times: int = MOST_TIMES, seed: int = 10) -> DataFrame:
    """``key, size, source_size, target, taken`` for every document.

    ``taken`` is a whole multiple of ``size``, 0 to ``times`` of it.  The order of a source is a hash
    of the key; rows that agree in key, source and size are taken alike, so reruns agree.  Null texts and
    texts without a word have size 0 and take nothing; null sources are a source of their own, the
    last in order; a budget of 0 takes nothing; an empty table gives an empty result.
    """
    sized, queued, targets, cut = queue(docs, text, key, source, weights, share, times, seed)
    epochs = sum((F.when(F.col("finish") + F.col("lap") * e <= F.lit(cut), 1).otherwise(0) for e in range(times)), F.lit(0))
    taken = queued.select("key", "size", "source_size", "target", (F.col("size") * epochs).cast("long").alias("taken"))
    empty = sized.where("size = 0").alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    empty = empty.select("key", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty).select(F.col("key").alias(key), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, times: int = MOST_TIMES, seed: int = 10) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with all their columns.

    A source is served in order of its shuffle key, so what it gives in an epoch is all up to one
    last document.  These bounds, one row for each source, are joined to the documents; the texts are
    not shuffled where that small side can be broadcast (Spark decides by its size).
    """
    _, queued, _, cut = queue(docs, text, key, source, weights, share, times, seed)
    last = [F.max(F.when(F.col("finish") + F.col("lap") * e <= F.lit(cut), F.struct("h", "key", "size"))).alias(f"mix_last_{e}") for e in range(times)]
    bounds = queued.groupBy(F.col("source").alias("mix_source")).agg(*last)
    size = word_count(F.col(text))
    place = F.struct(shuffle_key(F.col(key), seed).alias("h"), F.col(key).alias("key"), size.alias("size"))
    copies = sum((F.when(F.col("mix_place") <= F.col(f"mix_last_{e}"), 1).otherwise(0) for e in range(times)), F.lit(0))
    found = docs.withColumn("mix_place", place).where("mix_place.size > 0").join(bounds, F.col(source).eqNullSafe(F.col("mix_source")))
    found = found.withColumn("mix_copies", copies).where("mix_copies > 0")
    return found.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _cut_time(queued: DataFrame, targets: DataFrame, times: int, ranges: int) -> float:
    """The finish time at which the global order is truncated: that of the last document of which
    at least half is within the budget."""
    entries = queued.select("size", F.explode(F.array(*[F.col("finish") + F.col("lap") * e for e in range(times)])).alias("finish"))
    # Nearly all budgets end near time 1; times far beyond it share the last range.
    far = 4 * ranges
    entries = entries.withColumn("range", F.least(F.floor(F.col("finish") * ranges), F.lit(far)).cast("long"))
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    sums = entries.groupBy("range").agg(F.sum("size").alias("words"))
    upto = W.orderBy("range").rowsBetween(W.unboundedPreceding, 0)
    found = sums.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") >= budget).orderBy("range").first()
    if budget <= 0:
        return -1.0
    if found is None:
        return float("inf")
    within = W.orderBy("finish", "size").rowsBetween(W.unboundedPreceding, 0)
    last = entries.where(F.col("range") == found["range"]).withColumn("upto", F.sum("size").over(within) + (found["upto"] - found["words"]))
    last = last.where(F.col("upto") - F.col("size") / 2 <= budget).agg(F.max("finish")).first()[0]
    return found["range"] / ranges if last is None else last


#: The same in SQL: one order for each source and one for all, without ranges.
OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('10:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents
), per AS (
  SELECT *, ([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1])::DOUBLE AS weight, (2 * source_size)::DOUBLE AS most
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)
), leveled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM per WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), final AS (
  SELECT *, min(CASE WHEN level * weight <= most THEN struct_pack(r := most / weight, l := level) END) OVER () AS f FROM leveled
), targets AS (
  SELECT source, source_size, CASE WHEN f IS NULL THEN most ELSE least(most, f.l * weight) END AS target FROM final
), queued AS (
  SELECT doc_id, size, source_size, target, source_size / target AS lap,
    sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id NULLS FIRST, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / target AS finish
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), entries AS (
  SELECT finish + lap * e AS finish, size, sum(size) OVER (ORDER BY finish + lap * e, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM queued, (VALUES (0), (1)) v(e) WHERE size > 0
), cut AS (
  SELECT max(finish) AS cut FROM entries WHERE upto - size / 2 <= (SELECT sum(target) FROM targets)
)
SELECT doc_id, size, source_size, target,
  (size * CASE WHEN size = 0 OR cut IS NULL THEN 0 ELSE (finish <= cut)::INT + (finish + lap <= cut)::INT END)::BIGINT AS taken
FROM queued, cut
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))
