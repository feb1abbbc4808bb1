"""Operator 9: near-duplicate texts by HyperMinHash, exact on full sets.

1. One pass over the texts gives each document's set size, a digest of its shingle set and its
   HyperMinHash registers (leading zeros and mantissa by bucket).  Equal sets are one *class* from
   here on, so exact copies cost one row; classes are numbered.
2. Bands of registers put classes into buckets: one exchange of two numbers a band, after which
   buckets of one class are gone.
3. In every bucket each class is paired with the least one only (a star, not all pairs); in a bucket
   that is frequent within a batch, with the batch's least one, and these with the least of all.  The
   collision-corrected estimate drops pairs that are far from the threshold; the rest is verified on
   full sets.  Components of the verified links are found.
4. What the stars may have missed lies in buckets of three classes or more that still hold several
   components; those with the same members are kept once.  Such a bucket is searched for further links between its components, in blocks: first
   on registers, which leaves the classes with a likely partner, and these on full sets, until no two
   of the bucket's components are linked; a block emits at most one link for each of its classes.  So
   no candidate pair is lost and nothing quadratic is written.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from notewright.llm import common, shingles
from notewright.llm.components import components

#: Link from this similarity in percent on.
PERCENT = 75
#: Registers of a band: 51 bands of 5 miss a pair at the threshold once in a million.
BAND = 5
#: Classes of a block of step 4, and partners of a star's centre that one task's portion holds.
BLOCK, PORTION = 512, 256
#: A bucket with so many classes of one batch is a star there, before anything is moved.
FREQUENT = 16
#: Likely partners of a class that are compared one by one; more are counted together.
SINGLY = 8
#: Ids that are broadcast to fetch rows; beyond, tables are joined by a shuffle.
BROADCAST_IDS = 250_000


def _shingler(width: int) -> shingles.Shingler:
    return common.held(("shingles", width), lambda: shingles.Shingler(width))


def sketch(docs: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """``key, n_shingles, digest, registers``; texts without a word have null digest and registers."""
    kind = docs.schema[key].dataType
    schema = pa.schema([("key", to_arrow_type(kind)), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("registers", pa.binary())])

    def sketched(batch: pa.RecordBatch) -> dict[str, object]:
        sets = _shingler(width).sets(common.texts_of(batch.column(1)))
        return {
            "key": batch.column(0),
            "n_shingles": [len(s) for s in sets],
            "digest": [shingles.set_digest(s) if len(s) else None for s in sets],
            "registers": [shingles.registers(s).tobytes() if len(s) else None for s in sets],
        }

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(common.by_batch(sketched, schema), f"key {kind.simpleString()}, n_shingles long, digest binary, registers binary")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def band_rows(classes: DataFrame) -> DataFrame:
    """``bucket, star, id``: one row for each class and band.

    Classes of a bucket that is frequent in a batch are a star at once, around the batch's least
    class: ``star`` is one more than that, and 0 elsewhere.  For the bucket's other batches the least
    class stands for all of them, in one row with the negative id ``-1 - id``.
    """
    schema = pa.schema([("bucket", pa.int64()), ("star", pa.int64()), ("id", pa.int64())])

    def banded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            keys = np.array([shingles.band_keys(r, BAND) for r in _registers(batch.column(1))])
            ids, keys = np.repeat(own, keys.shape[1]), keys.reshape(-1).view(np.int64)
            order = np.lexsort((ids, keys))
            ids, keys = ids[order], keys[order]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            many = np.diff(np.r_[starts, len(keys)])
            star = np.repeat(np.where(many >= FREQUENT, 1 + ids[starts], 0), many)
            told = starts[many >= FREQUENT]
            columns = [np.r_[keys, keys[told]], np.r_[star, np.zeros(len(told), np.int64)], np.r_[ids, -1 - ids[told]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return classes.select("id", "registers").mapInArrow(common.lean(banded), "bucket long, star long, id long")


def shared_buckets(classes: DataFrame) -> DataFrame:
    """``bucket, id, a, wide``: the classes of the buckets with several ones, the centre of each one's
    star, and whether there are more than two."""
    dealt = band_rows(classes).repartition("bucket", "star")
    own = W.partitionBy("bucket", "star")
    real = F.when(F.col("id") < 0, -1 - F.col("id")).otherwise(F.col("id"))
    met = dealt.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("told", F.min("id").over(own) < 0).withColumn("least", F.min(real).over(own))
    centre = F.when(F.col("star") > 0, F.col("star") - 1).otherwise(F.col("least"))
    return met.where("n > 1 or star > 0").select("bucket", real.alias("id"), centre.alias("a"), ((F.col("n") > 2) | F.col("told") | (F.col("star") > 0)).alias("wide"))


def mixed_buckets(shared: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """``bucket, members, id, root`` of the buckets that hold several components, buckets with the same
    members once.

    A class that is linked with its star's centre is in the centre's component, so only the others
    are looked at to tell which buckets these are.
    """
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    loose = shared.where("wide and id <> a").join(links.select("a", F.col("b").alias("id")), ["a", "id"], "left_anti")
    loose = loose.join(root("id"), "id", "left").join(root("a"), "a", "left")
    mixed = loose.where(F.coalesce("root_id", "id") != F.coalesce("root_a", "a")).select("bucket").distinct()
    held = shared.join(mixed, "bucket", "left_semi").select("bucket", "id").distinct()
    sums = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("id")).alias("sign"), F.min("id").alias("least"))
    once = sums.groupBy("members", "sign", "least").agg(F.min("bucket").alias("bucket")).select("bucket", "members")
    held = held.join(once, "bucket").join(root("id"), "id", "left")
    return held.select("bucket", "members", "id", F.coalesce("root_id", "id").alias("root"))


def jaccard_links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    i = np.searchsorted(large, small)
    i[i == len(large)] = 0
    shared = int((large[i] == small).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def likely(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sizes allow a link and the estimate is within five deviations of the threshold (at
    which it is wrong three times in ten million), for registers and sizes of sets."""
    j, n = percent / 100, np.minimum(na, nb)
    fits = 100 * n >= percent * np.maximum(na, nb)
    return fits & (shingles.estimate(a, b) >= j - 5 * np.sqrt(j * (1 - j) / np.minimum(n, shingles.BUCKETS)))


def _only(rows: DataFrame, column: str, wanted: DataFrame, tables: common.Tables) -> DataFrame:
    """``rows`` joined with ``wanted``, a written table, by ``column``.

    A bounded number of bare ids is broadcast to leave out all other rows before the shuffle; with
    more ids the join alone does it.
    """
    ids = tables.put("ids", wanted.select(column).distinct())
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(ids), column, "left_semi")
    return rows.join(wanted, column)


def texts_for(docs: DataFrame, text: str, key: str, wanted: DataFrame, tables: common.Tables) -> DataFrame:
    """``text`` with the columns of ``wanted``, whose column ``rep`` names the document."""
    return _only(docs.select(F.col(key).alias("rep"), F.col(text).alias("text")).where(F.col("text").isNotNull()), "rep", wanted, tables)


def star_ends(pairs: DataFrame) -> DataFrame:
    """``a, portion, place, id``: the centre (place 0) and the others of each portion of a star.

    A star has as many portions as its size asks for, so no star is one task.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PORTION).cast("int").alias("portions"))
    others = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("portions")).cast("int").alias("portion"), F.lit(1).alias("place"), F.col("b").alias("id"))
    centres = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), F.lit(0).alias("place"), F.col("a").alias("id"))
    return others.unionByName(centres)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], schema=PAIR)


def estimated(pairs: DataFrame, classes: DataFrame, tables: common.Tables) -> DataFrame:
    """The pairs ``a, b`` that their sizes and the estimate do not rule out."""
    got = _only(classes.select("id", "n_shingles", "registers"), "id", tables.put("ends", star_ends(pairs)), tables)
    got = got.select("a", "portion", "place", "id", "n_shingles", "registers").repartition("a", "portion").sortWithinPartitions("a", "portion", "place")

    def filtered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centre = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, portion, place, ids, n = (batch.column(k).to_numpy() for k in range(5))
            regs = _registers(batch.column(5))
            starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (portion[1:] != portion[:-1])])
            found: list[tuple[int, int]] = []
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(a)], strict=True):
                star = (a[i], portion[i])
                if place[i] == 0:
                    now, centre = star, (regs[i].copy(), n[i])
                    i += 1
                if now == star:
                    found += [(int(now[0]), int(b)) for b in ids[i:j][likely(regs[i:j], n[i:j], *centre)]]
            yield _pairs(found)

    return got.mapInArrow(common.lean(filtered), "a long, b long")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, key: str, width: int, tables: common.Tables) -> DataFrame:
    """The pairs ``a, b`` that link on full sets.

    The texts of a portion of a star meet in one place and are read as a stream, its centre first.
    """
    ends = tables.put("ends", star_ends(pairs).join(classes.select("id", "rep", "digest"), "id"))
    got = texts_for(docs, text, key, ends, tables).select("a", "portion", "place", "id", "digest", "text")
    got = got.repartition("a", "portion").sortWithinPartitions("a", "portion", "place", "id")

    def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = None, None
        for batch in batches:
            found = []
            sets = _shingler(width).sets(common.texts_of(batch.column(5)))
            for a, portion, place, b, digest, s in zip(*(batch.column(c).to_pylist() for c in range(5)), sets, strict=True):
                if shingles.set_digest(s) != digest:
                    continue  # another text under the same id
                if place == 0:
                    now, first = (a, portion), s
                elif now == (a, portion) and jaccard_links(first, s):
                    found.append((a, b))
            yield _pairs(found)

    return got.mapInArrow(common.lean(linked), "a long, b long").distinct()


def blocked(rows: DataFrame) -> DataFrame:
    """``rows`` (bucket, members, id, root, rep, digest) with ``x, y, side``: the pairs of blocks that a class meets
    others in.

    A bucket of up to ``BLOCK`` classes is one block.  In a larger one the components beyond ``BLOCK``
    have blocks of their own, the others share blocks, each component whole in one of them.  Blocks of
    one component are not paired, so a bucket that is nearly one component costs little more than one
    pass over it.
    """
    small = rows.where(F.col("members") <= BLOCK).select("*", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).alias("side"))
    large = rows.where(F.col("members") > BLOCK)
    sizes = large.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("n") > BLOCK
    # As many shared blocks as the classes of the components without own ones ask for.
    few = sizes.groupBy("bucket").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.when(own, 0).otherwise(F.col("n"))) / BLOCK)).alias("few"))
    sizes, shared = sizes.join(few, "bucket"), F.col("few")
    # Numbers of shared blocks are not negative; blocks of one component are negative numbers of it.
    sizes = sizes.select("bucket", "root", own.alias("own"), F.when(own, F.ceil(F.col("n") / BLOCK)).otherwise(1).alias("cuts"), F.pmod(F.xxhash64("root"), shared).alias("shared"))
    number = lambda cut: F.when(F.col("own"), -1 - F.abs(F.xxhash64("root", cut) % (1 << 62))).otherwise(F.col("shared"))
    cut = F.pmod(F.xxhash64("id"), F.col("cuts"))
    large = large.join(sizes, ["bucket", "root"]).withColumn("block", number(cut.cast("long")))
    blocks = sizes.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).select("bucket", number(F.col("cut")).alias("block"), F.when(F.col("own"), F.col("root")).alias("whole")).distinct()
    left, right = (blocks.select("bucket", F.col("block").alias(b), F.col("whole").alias(f"whole_{b}")) for b in "xy")
    met = left.join(right, "bucket").where("x <= y and (x = y or whole_x is null or whole_y is null or whole_x <> whole_y)").where("not (x = y and whole_x is not null)").select("bucket", "x", "y")
    one = large.join(met.withColumn("block", F.col("x")), ["bucket", "block"]).withColumn("side", F.lit(0))
    two = large.join(met.where("x <> y").withColumn("block", F.col("y")), ["bucket", "block"]).withColumn("side", F.lit(1))
    columns = small.columns
    return small.unionByName(one.select(*columns)).unionByName(two.select(*columns))


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each pair of blocks, as the first three columns tell."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:3] != held[0][:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def doubtful(rows: DataFrame, classes: DataFrame, tables: common.Tables) -> DataFrame:
    """Those of the blocked ``rows`` that have a likely partner of another component in their pair of
    blocks, by registers alone."""
    got = _only(classes.select("id", "n_shingles", "registers"), "id", rows, tables).select("bucket", "x", "y", "side", "root", "id", "n_shingles", "registers")
    got = got.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    schema = pa.schema([("bucket", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("id", pa.int64())])

    def sifted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            side, root, ids, n = (np.array([g[k] for g in group], np.int64) for k in range(3, 7))
            regs = np.frombuffer(b"".join(g[7] for g in group), np.uint16).reshape(len(group), -1)
            hit = np.zeros(len(group), bool)
            across = side.max() > side.min()
            for i in range(1, len(group)):
                ok = root[:i] != root[i]
                if across:
                    ok &= side[:i] != side[i]
                j = np.flatnonzero(ok)
                if len(j):
                    j = j[likely(regs[j], n[j], regs[i], n[i])]
                    hit[j] = True
                    hit[i] |= len(j) > 0
            if hit.any():
                columns = [np.full(int(hit.sum()), group[0][k]) for k in range(3)] + [ids[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return got.mapInArrow(common.lean(sifted), "bucket long, x long, y long, id long")


def links_across(group: dict[int, tuple[int, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Links that unite the components of a block's classes; ``group``: root and sorted set by id.

    Where a class has many likely partners, their intersections with its set are counted in one pass
    over the block's shingles: near copies just below the threshold would be compared pair by pair.
    """
    ids, sets = list(group), [s for _, s in group.values()]
    label = np.fromiter((root for root, _ in group.values()), np.int64, len(ids))
    sizes = np.fromiter(map(len, sets), np.int64, len(ids))
    starts = np.cumsum(sizes) - sizes
    regs = np.array([shingles.registers(s) for s in sets])
    flat, known = np.unique(np.concatenate(sets), return_inverse=True)[1], None
    for i in range(1, len(ids)):
        near = np.flatnonzero(label[:i] != label[i])
        near = near[likely(regs[near], sizes[near], regs[i], sizes[i])]
        if len(near) < SINGLY:
            found = [j for j in near if jaccard_links(sets[i], sets[j])]
        else:
            known = np.zeros(int(flat.max()) + 1, np.int64) if known is None else known
            own = flat[starts[i] : starts[i] + sizes[i]]
            known[own] = 1
            both = np.add.reduceat(known[flat[: starts[i]]], starts[:i])[near]
            known[own] = 0
            found = near[100 * both >= PERCENT * (sizes[near] + sizes[i] - both)]
        for j in found:
            if label[i] != label[j]:
                label[label == label[i]] = label[j]
                yield ids[i], ids[j]


def residual_links(rows: DataFrame, docs: DataFrame, text: str, key: str, width: int, tables: common.Tables) -> DataFrame:
    """Links between different components of a pair of blocks, on full sets.  ``rows``: ``bucket, x, y,
    id, root, rep, digest``."""
    got = texts_for(docs, text, key, rows, tables).select("bucket", "x", "y", "id", "root", "digest", "text")
    got = got.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "root", "id")

    def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, {}
        for batch in batches:
            sets = _shingler(width).sets(common.texts_of(batch.column(6)))
            for bucket, x, y, own, root, digest, s in zip(*(batch.column(c).to_pylist() for c in range(6)), sets, strict=True):
                if (bucket, x, y) != now:
                    if len(group) > 1:
                        yield _pairs(list(links_across(group)))
                    now, group = (bucket, x, y), {}
                if shingles.set_digest(s) == digest:
                    group[own] = (root, s)
        if len(group) > 1:
            yield _pairs(list(links_across(group)))

    return got.mapInArrow(common.lean(searched), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = shingles.WIDTH) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row of ``docs``.

    Links hold between texts whose shingle sets have a Jaccard similarity of ``PERCENT`` or more;
    components are of those links.  Null texts and texts without a word have an empty set and link
    with nothing; repeated rows and equal sets are one class, of any size; a null key is a row of its
    own result and never a component's name while another row has a key.  An empty table gives an
    empty result.  Columns other than text and key are not read.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    tables = common.Tables(spark, "near")
    sketches = tables.put("sketches", sketch(docs, text, key, width))
    with_set = sketches.where("digest is not null")
    # Copies are aggregated before they are moved, so a group of any size is a row of each task.
    least = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n_shingles", "registers"))).alias("least")
    classes = with_set.groupBy("digest").agg(least, F.count(F.lit(1)).alias("copies")).where("least is not null")
    classes = classes.select(F.monotonically_increasing_id().alias("id"), "digest", "copies", F.col("least.key").alias("rep"), "least.n_shingles", "least.registers")
    classes = tables.put("classes", classes)

    shared = tables.put("shared", shared_buckets(classes))
    stars = tables.put("stars", shared.where("id <> a").select("a", F.col("id").alias("b")).distinct())
    likely_pairs = tables.put("likely", estimated(stars, classes, tables))
    links = tables.put("links", verified(likely_pairs, classes, docs, text, key, width, tables))
    tables.drop("stars", "likely", "ends", "ids")
    found = components(links, tables, "first")

    rest = tables.put("rest", blocked(tables.put("mixed", mixed_buckets(shared, links, found))))
    tables.drop("shared")
    sifted = doubtful(rest, classes, tables).join(rest.select("bucket", "x", "y", "id", "root"), ["bucket", "x", "y", "id"])
    sifted = tables.put("sifted", sifted.join(classes.select("id", "rep", "digest"), "id"))
    tables.drop("mixed", "rest")
    more = tables.put("more", residual_links(sifted, docs, text, key, width, tables))
    if more.limit(1).count():
        found = components(links.unionByName(more), tables, "second")
    tables.drop("sifted", "ids")

    ids = classes.select("id", "digest", "rep", "copies")
    grouped = ids.join(found.select(F.col("node").alias("id"), "root"), "id")
    first = grouped.groupBy("root").agg(F.min("rep").alias("component"))
    linked = grouped.join(first, "root").select("id", "digest", "component")
    alone = ids.where("copies > 1").join(linked.select("id"), "id", "left_anti").select("id", "digest", F.col("rep").alias("component"))
    names = linked.unionByName(alone).select("digest", "component")
    out = sketches.select("key", "n_shingles", "digest").join(names, "digest", "left").withColumn("component", F.coalesce("component", "key"))
    return out.select(F.col("key").alias(key), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"))


#: The same in SQL, by all pairs of documents that share a shingle; doc_id is unique in the table.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT doc_id, len(w) AS m, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w
), windows AS (
  SELECT doc_id, m, i, concat_ws(' ', x, lead(x) OVER d, lead(x, 2) OVER d, lead(x, 3) OVER d, lead(x, 4) OVER d) AS x
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), distinct_windows AS (
  SELECT DISTINCT doc_id, x FROM windows WHERE i <= greatest(1, m - 4)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM distinct_windows GROUP BY doc_id
), shingles AS (
  SELECT doc_id, n, x FROM distinct_windows JOIN sizes USING (doc_id)
), shared AS (
  SELECT s.* FROM shingles s JOIN (SELECT x FROM shingles GROUP BY x HAVING count(*) > 1) USING (x)
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shared a JOIN shared b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = doc_id
"""


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
