"""Operator 3: near-duplicate vectors by a robust-pruned flat graph.

*Regions.*  Equal vectors are one class first.  Centres fitted on a bounded sample deal the classes
into regions: a class is at home with its nearest centre, and visits every region of a lower number
that can be home to a vector in range of it.  That is proven, not sampled: a vector is no further from
any vector at home elsewhere than from the plane between the two centres.  So each pair in range meets
in the lower one of its two homes.  How many centres there are is what makes the least work on the
sample; vectors that centres do not separate are one region, whose blocks are all searched.

*In a region* (one task, some thousands of vectors) the classes are clustered again into small
overlapping shards.  In each shard the nearest neighbours of a vector are pruned by the robust rule (a
neighbour goes if another kept one is nearer to it by the factor ``ALPHA``); the shards' adjacency
lists are united, with their reverse links, into one flat graph.  Every vector is then searched for:
a greedy beam search starts at the nearest shards' medoids, and what it finds is expanded along nodes
(nearly) in range until there are no more.  Ranges that touch are expanded once for all their vectors,
so a group of near copies costs one product of matrices.  Every pair of a range is verified by its
cosine in double precision.  A bounded sample of vectors audits the region by brute force, half of it vectors with
something close by; a region with a miss is searched exactly, in blocks.  In the end a bounded sample
of classes, most of them with links, is held against all classes of the table; if one of these misses
a link, all regions are searched exactly.

*Nothing quadratic is written.*  A link is counted in the lower one of its ends' homes, so
each region gives one row for each of its classes: how many links it counts, and the least class
that it is connected with there.  Components follow from these.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from notewright.llm import common
from notewright.llm.components import components

THRESHOLD = 0.95
#: Classes of a region before overlap, shards of a vector, and the most that a region's index holds.
REGION, OVERLAP, MOST = 4000, 2, 24_000
#: Sampled vectors that the work of a number of centres is told from, and what moving a vector costs in comparisons.
TRIED, MOVED = 4000, 2000
#: Classes with links, and without, that are held against the whole table.
LINKED, LONELY = 192, 64
#: Bounds of the sample that centres are fitted on: vectors, and numbers in all.
SAMPLE, SAMPLE_NUMBERS, MOST_CENTRES = 20_000, 4_000_000, 2048
SHARD, NEIGHBOURS, DEGREE, ALPHA = 96, 24, 12, 1.2
BEAM, STARTS, SLACK, AUDIT = 12, 4, 0.04, 48
#: Pairs of vectors that are held against each other at once.
BLOCK_PAIRS = 2_000_000


def usable(v) -> np.ndarray | None:
    """The unit vector in double precision; None if it is null or zero or has null or non-finite parts."""
    if v is None or len(v) == 0 or any(x is None for x in v):
        return None
    a = np.asarray(v, np.float64)
    if not np.isfinite(a).all():
        return None
    top = np.abs(a).max()
    return None if top == 0 else (a / top) / np.linalg.norm(a / top)


def centres(sample: np.ndarray, k: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(sample)))
    c = sample[np.sort(rng.choice(len(sample), k, replace=False))].copy()
    for _ in range(rounds if k > 1 else 1):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1)
        full = norm > 1e-12
        c[full] = total[full] / norm[full, None]
    return c


def nearest(v: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centres of each vector, nearest first."""
    n = min(n, len(c))
    out = np.zeros((len(v), n), np.int64)
    for i in range(0, len(v), 4096):
        s = v[i : i + 4096] @ c.T
        top = np.argpartition(-s, n - 1, axis=1)[:, :n]
        order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
        out[i : i + 4096] = np.take_along_axis(top, order, 1)
    return out


class Dealing:
    """To which regions a vector goes: its home, and lower regions that may be home to one in range."""

    def __init__(self, c: np.ndarray, threshold: float):
        self.c = c
        apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
        # No vector further from a plane through the origin has one in range on the other side.
        self.margin = (math.sqrt(max(0.0, 1 - threshold * threshold)) if threshold > 0 else 2.0) * apart + 1e-7

    def __call__(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The home of each vector; and pairs of a vector's row and a region, the home among them."""
        homes, rows, regions = [], [], []
        for i in range(0, len(v), 1024):
            s = v[i : i + 1024] @ self.c.T
            home = s.argmax(1)
            meets = s[np.arange(len(s)), home][:, None] - s <= self.margin[home]
            meets &= np.arange(len(self.c)) <= home[:, None]
            row, region = np.nonzero(meets)
            homes.append(home)
            rows.append(row + i)
            regions.append(region)
        return np.concatenate(homes), np.concatenate(rows), np.concatenate(regions)


def dealing(sample: np.ndarray, n: int, threshold: float, dim: int) -> Dealing:
    """The dealing of the least work among some numbers of centres, one centre among them."""
    tried = sample[:: max(1, len(sample) // TRIED)]
    best, least = Dealing(np.zeros((1, dim)), threshold), n * n + MOVED * n * (math.ceil(2 * n / MOST) if n > MOST else 1)
    k = min(math.ceil(n / REGION), MOST_CENTRES, len(sample) // 8)
    while k > 1:
        found = Dealing(centres(sample, k, seed=3), threshold)
        sizes = np.bincount(found(tried)[2], minlength=k) * (n / len(tried))
        work = float((sizes * sizes + MOVED * sizes * np.where(sizes > MOST, np.ceil(2 * sizes / MOST), 1)).sum())
        if work < least:
            best, least = found, work
        k //= 4
    return best


def pruned(v: np.ndarray) -> np.ndarray:
    """Robust-pruned adjacency of a shard's vectors, ``DEGREE`` columns, -1 where there is none."""
    n = len(v)
    k = min(NEIGHBOURS, n - 1)
    if k < 1:
        return np.full((n, DEGREE), -1, np.int64)
    s = v @ v.T
    np.fill_diagonal(s, -2)
    cand = np.argpartition(-s, k - 1, axis=1)[:, :k]
    cand = np.take_along_axis(cand, np.argsort(-np.take_along_axis(s, cand, 1), axis=1, kind="stable"), 1)
    far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(s, cand, 1)))
    among = np.sqrt(np.maximum(0, 2 - 2 * np.minimum(1, s[cand[:, :, None], cand[:, None, :]])))
    alive, kept = np.ones((n, k), bool), np.zeros((n, k), bool)
    for j in range(k):
        kept[:, j] = alive[:, j] & (kept.sum(1) < DEGREE)
        alive &= ~(kept[:, j, None] & (ALPHA * among[:, j, :] <= far))
    out = np.full((n, DEGREE), -1, np.int64)
    row, col = np.nonzero(kept)
    place = np.cumsum(kept, axis=1)[row, col] - 1
    out[row, place] = cand[row, col]
    return out


class Graph:
    """The flat graph of a region: united adjacency lists of its shards, and their medoids."""

    def __init__(self, v: np.ndarray, seed: int = 3):
        self.v = v
        c = centres(v, math.ceil(len(v) / SHARD), seed, rounds=4)
        near = nearest(v, c, OVERLAP)
        links, medoids = [], []
        for shard in range(len(c)):
            members = np.flatnonzero((near == shard).any(1))
            if not len(members):
                continue
            medoids.append(members[(v[members] @ c[shard]).argmax()])
            # A shard that near copies have swollen is built in portions.
            for at in range(0, len(members), 8 * SHARD):
                own = members[at : at + 8 * SHARD]
                adjacent = pruned(v[own])
                row, col = np.nonzero(adjacent >= 0)
                links.append(np.column_stack([own[row], own[adjacent[row, col]]]))
                if at:
                    links.append(np.array([[members[at - 1], own[0]]]))
        self.medoids = np.unique(np.array(medoids, np.int64))
        self.connect(np.concatenate(links) if links else np.zeros((0, 2), np.int64))

    def connect(self, links: np.ndarray) -> None:
        """Makes the adjacency lists of the links, in both directions."""
        v = self.v
        e = np.unique(np.concatenate([links, links[:, ::-1]]), axis=0)
        self.links = e
        self.start = np.searchsorted(e[:, 0], np.arange(len(v) + 1))
        self.to = e[:, 1]
        degree = np.diff(self.start)
        self.width = int(min(degree.max(initial=1), 4 * DEGREE))
        self.table = np.full((len(v), self.width), -1, np.int64)
        place = np.arange(len(e)) - self.start[e[:, 0]]
        ok = place < self.width
        self.table[e[ok, 0], place[ok]] = e[ok, 1]

    def greedy(self, queries: np.ndarray) -> np.ndarray:
        """Beam search for many vectors at once: the ``BEAM`` best nodes found for each."""
        v, n = self.v, len(queries)
        q = v[queries]
        starts = self.medoids[nearest(q, v[self.medoids], STARTS)]
        ids = np.full((n, BEAM), -1, np.int64)
        sims = np.full((n, BEAM), -3.0)
        w = min(BEAM, starts.shape[1])
        ids[:, :w] = starts[:, :w]
        sims[:, :w] = np.einsum("nd,nkd->nk", q, v[starts[:, :w]])
        done = ids < 0
        for _ in range(4 * BEAM):
            open_ = np.where(done, -3.0, sims)
            best = open_.argmax(1)
            active = np.flatnonzero(open_[np.arange(n), best] > -3)
            if not len(active):
                break
            done[active, best[active]] = True
            new = self.table[ids[active, best[active]]]
            s = np.einsum("nd,nkd->nk", q[active], v[new])
            s[(new < 0) | (new[:, :, None] == ids[active][:, None, :]).any(2)] = -3.0
            all_ids = np.concatenate([ids[active], new], 1)
            all_sims = np.concatenate([sims[active], s], 1)
            all_done = np.concatenate([done[active], s <= -3], 1)
            top = np.argpartition(-all_sims, BEAM - 1, axis=1)[:, :BEAM]
            ids[active], sims[active], done[active] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_done))
        return np.where(sims > -3, ids, -1)

    def ranges(self, beams: np.ndarray, threshold: float) -> np.ndarray:
        """Range expansion for all nodes at once: from a node and what its search found, along nodes
        (nearly) in range, until no further one is.  Nodes that reach each other get one number."""
        v, n = self.v, len(self.v)
        row, col = np.nonzero(beams >= 0)
        steps = np.concatenate([self.links, np.column_stack([row, beams[row, col]])])
        close = [np.einsum("nd,nd->n", v[e[:, 0]], v[e[:, 1]]) >= threshold - SLACK for e in (steps[i : i + 65_536] for i in range(0, len(steps), 65_536))]
        steps = steps[np.concatenate(close)] if close else steps
        label = np.arange(n)
        while len(steps):
            a, b = label[steps[:, 0]], label[steps[:, 1]]
            differ = a != b
            steps = steps[differ]
            np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
            while (label[label] != label).any():
                label = label[label]
        return label


#: Vectors held against others, and whether each pair is in range.
Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def held_against(v: np.ndarray, own: np.ndarray, other: np.ndarray, threshold: float) -> Iterator[Block]:
    """All pairs of ``own`` and ``other`` by cosine in double precision, in blocks of bounded size."""
    to = v[other].T
    step = max(1, BLOCK_PAIRS // max(1, len(other)))
    for at in range(0, len(own), step):
        part = own[at : at + step]
        yield part, other, v[part] @ to >= threshold


def region_links(v: np.ndarray, threshold: float, blocks: bool = False) -> Iterator[Block]:
    """The links of a region's vectors; with ``blocks`` by brute force."""
    everyone = np.arange(len(v))
    if not blocks:
        graph = Graph(v)
        beams = np.concatenate([graph.greedy(everyone[at : at + 1024]) for at in range(0, len(v), 1024)])
        label = graph.ranges(beams, threshold)
        order = np.argsort(label, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(label[order])) + 1)
        groups = {int(label[g[0]]): g for g in groups if len(g) > 1}
        near = everyone[np.isin(label, list(groups))]
        spread = lambda of: of[np.linspace(0, len(of) - 1, min(AUDIT, len(of))).astype(np.int64)]
        audit = np.unique(np.r_[spread(everyone), spread(near)])
        truth = np.concatenate([m.sum(1) for _, _, m in held_against(v, audit, everyone, threshold)])
        found = [(v[groups.get(int(label[q]), everyone[q : q + 1])] @ v[q] >= threshold).sum() for q in audit.tolist()]
        if (truth <= found).all():
            for g in groups.values():
                yield from held_against(v, g, g, threshold)
            return
    yield from held_against(v, everyone, everyone, threshold)


def part_links(v: np.ndarray, parts: np.ndarray, threshold: float) -> Iterator[Block]:
    """The links between vectors of two parts of a region, by brute force."""
    if parts.min() < parts.max():
        one, two = (np.flatnonzero(parts == p) for p in (parts.min(), parts.max()))
        yield from held_against(v, one, two, threshold)
        yield from held_against(v, two, one, threshold)


def region_rows(digests: list[bytes], v: np.ndarray, copies: np.ndarray, homes: np.ndarray, parts: np.ndarray, region: int, across: bool, threshold: float, blocks: bool) -> tuple[list[int], list[bytes]]:
    """For each class of a region: links that are counted here, and the least class connected here.
    With ``across`` only links between the two parts are looked for."""
    parent = list(range(len(v)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = np.zeros(len(v), np.int64)
    label = np.arange(len(v))  # a member of the same group, seen some time ago
    # The lower one of the homes counts the link: a class at home here counts all of its links.
    home = homes == region
    counts = np.column_stack([copies * home, copies])
    for own, other, near in part_links(v, parts, threshold) if across else region_links(v, threshold, blocks):
        totals = near.astype(np.float64) @ counts[other]
        links[own] += np.where(home[own], totals[:, 1], totals[:, 0]).astype(np.int64)
        for q, hit in zip(own.tolist(), near, strict=True):
            got = other[hit]
            seen = label[got]
            if (seen == label[q]).all():
                continue
            roots = sorted({find(x) for x in np.unique(seen).tolist()} | {find(q)})
            for x in roots[1:]:
                parent[x] = roots[0]
            label[got] = label[q] = roots[0]
    if not across:
        # A vector is in range of itself, where it was held against anything.
        links -= np.where(links > 0, copies * home, 0)
    return links.tolist(), [digests[find(i)] for i in range(len(v))]


def near_vectors(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = THRESHOLD) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row.

    Vectors that are null, empty or zero, or hold null or non-finite parts, link with nothing; vectors
    of different lengths do not link.  Repeated rows and equal vectors are one class of any size and
    link with each other.  A null key is a row like others and names no component.  An empty table
    gives an empty result; labels and other columns are not read.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    tables = common.Tables(spark, "vectors")
    kind = vectors.schema[key].dataType
    read_schema = pa.schema([("key", to_arrow_type(kind)), ("digest", pa.binary()), ("dim", pa.int32()), ("unit", pa.binary())])

    def read(batch: pa.RecordBatch) -> dict[str, object]:
        units = [usable(v) for v in batch.column(1).to_pylist()]
        packed = [None if u is None else u.tobytes() for u in units]
        return {"key": batch.column(0), "digest": [None if p is None else hashlib.blake2b(p, digest_size=16).digest() for p in packed], "dim": [None if u is None else len(u) for u in units], "unit": packed}

    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(common.by_batch(read, read_schema), f"key {kind.simpleString()}, digest binary, dim int, unit binary")
    rows = tables.put("rows", rows)
    good = rows.where("digest is not null")
    classes = tables.put("classes", good.groupBy("digest", "dim", "unit").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies")))
    found = None
    for dim, n in sorted(tuple(r) for r in classes.groupBy("dim").count().collect()):
        own = classes.where(F.col("dim") == dim)
        dealt = _dealt(own, dim, n, threshold, tables)
        part = tables.put(f"found-{dim}", _searched(dealt, threshold, blocks=False))
        if _misses(own, part, threshold):
            part = tables.put(f"exact-{dim}", _searched(dealt, threshold, blocks=True))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    counted = found.groupBy("digest").agg(F.sum("links").alias("links"))
    roots = components(found.where("digest <> root").select(F.col("digest").alias("a"), F.col("root").alias("b")), tables, "vectors")
    named = classes.select("digest", "rep", "copies").join(roots.select(F.col("node").alias("digest"), "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    named = named.join(least, "root").join(counted, "digest").select("digest", "component", (F.col("links") + F.col("copies") - 1).alias("links"))
    out = rows.select("key", "digest").join(named, "digest", "left")
    component = F.coalesce("component", "key")
    return out.select(F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))


def _dealt(classes: DataFrame, dim: int, n: int, threshold: float, tables: common.Tables) -> DataFrame:
    """The classes of one vector length, a row for each region and pair of its parts that a class is in."""
    spark = classes.sparkSession
    most = max(1, min(SAMPLE, SAMPLE_NUMBERS // dim))
    taken = classes.where(common.dice(F.col("digest"), seed=3) < min(1.0, most / n)).select("unit").toArrow()["unit"].to_pylist()
    sample = np.array([np.frombuffer(u) for u in taken]).reshape(len(taken), dim)
    shared = spark.sparkContext.broadcast(dealing(sample, n, threshold, dim).c)  # at most MOST_CENTRES vectors
    dealt_schema = pa.schema([("region", pa.int64()), ("home", pa.int64()), ("digest", pa.binary()), ("unit", pa.binary()), ("copies", pa.int64())])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = None
        for batch in batches:
            if not batch.num_rows:
                continue
            to = to or Dealing(shared.value, threshold)
            v = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, dim)
            homes, rows, regions = to(v)
            for at in range(0, len(rows), 4096):
                row = rows[at : at + 4096]
                columns = [pa.array(regions[at : at + 4096]), pa.array(homes[row]), *(batch.column(i).take(pa.array(row)) for i in range(3))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, dealt_schema, strict=True)], schema=dealt_schema)

    dealt = classes.select("digest", "unit", "copies").mapInArrow(deal, "region long, home long, digest binary, unit binary, copies long")
    dealt = tables.put(f"dealt-{dim}", dealt)
    # Regions beyond what an index holds are cut into parts by a hash;
    # each pair of parts is one task, which searches the links between them in blocks.
    sizes = [(r[0], math.ceil(2 * r[1] / MOST)) for r in dealt.groupBy("region").count().where(F.col("count") > MOST).collect()]
    cut = F.broadcast(spark.createDataFrame(sizes, "region long, cut int"))  # at most MOST_CENTRES rows
    dealt = dealt.join(cut, "region", "left").withColumn("parts", F.coalesce("cut", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("region", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "home", "digest", "unit", "copies")


def _searched(dealt: DataFrame, threshold: float, blocks: bool) -> DataFrame:
    """``digest, links, root`` of the classes, a row for each region and pair of parts."""
    dealt = dealt.repartition("region", "x", "y").sortWithinPartitions("region", "x", "y", "digest")
    schema = pa.schema([("digest", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def finish(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        region, x, y = held[0][:3]
        v = np.array([np.frombuffer(h[6]) for h in held])
        parts, homes, copies = (np.array([h[i] for h in held], np.int64) for i in (3, 4, 7))
        digests = [h[5] for h in held]
        links, roots = region_rows(digests, v, copies, homes, parts, region, x != y, threshold, blocks)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(links, pa.int64()), pa.array(roots, pa.binary())], schema=schema)

    def grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    yield from finish(held)
                    held = []
                held.append(row)
        if held:
            yield from finish(held)

    return dealt.mapInArrow(grouped, "digest binary, links long, root binary")


def _misses(classes: DataFrame, found: DataFrame, threshold: float) -> bool:
    """Whether any of a bounded sample of classes has links, with all classes of one vector length,
    that were not found."""
    counted = found.groupBy("digest").agg(F.sum("links").alias("links"))
    ask = [counted.where("links > 0").orderBy("digest").limit(LINKED), counted.where("links = 0").orderBy("digest").limit(LONELY)]
    asked = ask[0].unionByName(ask[1]).join(classes.select("digest", "unit", "copies"), "digest").collect()
    if not asked:
        return False
    q = np.array([np.frombuffer(r["unit"]) for r in asked])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(q), np.int64)
        for batch in batches:
            if batch.num_rows:
                v = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, q.shape[1])
                n += (q @ v.T >= threshold) @ np.array(batch.column(1).to_pylist(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), pa.array(n)], names=["i", "n"])

    truth = classes.select("unit", "copies").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n")).collect()
    return any(n - asked[i]["copies"] > asked[i]["links"] for i, n in truth)


def audit_recall(vectors: DataFrame, result: DataFrame, vector: str = "embedding", key: str = "vec_id", queries: int = 256, threshold: float = THRESHOLD) -> float:
    """Recall of ``n_links`` against brute force, for a bounded set of query vectors against all rows,
    in blocks."""
    asked = vectors.where(F.col(key).isNotNull()).select(key, vector).orderBy(F.xxhash64(key)).limit(queries).toArrow()
    units = {k: u for k, u in ((k, usable(v)) for k, v in zip(asked[key].to_pylist(), asked[vector].to_pylist(), strict=True)) if u is not None}
    if not units:
        return 1.0
    keys, q = list(units), np.array(list(units.values()))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [u for u in map(usable, batch.column(0).to_pylist()) if u is not None and len(u) == q.shape[1]]
            n = (q @ np.array(v).T >= threshold).sum(1) if v else np.zeros(len(keys), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys))), pa.array(n.astype(np.int64))], names=["i", "n"])

    truth = vectors.select(F.col(vector).cast("array<double>")).mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n")).collect()
    want = {keys[i]: n - 1 for i, n in truth}
    got = {r[0]: r[1] for r in result.where(F.col(key).isin(keys)).select(key, "n_links").collect()}
    total = sum(want.values())
    return sum(min(got[k], n) for k, n in want.items()) / total if total else 1.0


#: The same in SQL, by all pairs; vec_id is unique in the table.
OP3_SQL = """
WITH RECURSIVE units AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.v, b.v) >= 0.95 * a.size * b.size
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings LEFT JOIN counted ON counted.a = vec_id LEFT JOIN least ON least.a = vec_id
"""


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.table(spark, sf_dir, "embeddings"))
