"""Operator 6: main text of web pages, with a suffix array over each host's pages.

Each page is cut into blocks.  What stands in an article or main element, outside of menus, asides,
forms and the like, is the article and is kept whole, however often its passages occur elsewhere.
All other blocks are the page's *surroundings*.  The surroundings of a host's pages are laid end to
end as one stream of words, a suffix array (sorted as deep as a long run needs) finds the runs of
words that several distinct pages repeat; copies of a page are one page.  A block that such runs cover
wholly is boilerplate; a block that holds anything else is kept whole, so a passage that pages share
is not cut out of their sentences.  On pages without an article element the surroundings' other blocks
are the text, unless their markup marks them as menus, headers,
adverts and so on; on pages with one the surroundings are left out and only counted.

Large hosts are dealt into groups of bounded size by a hash of the page, so a host with a third of
all pages is many tasks.  There the runs are counted over the whole host by their hashes, and each
group gets those of its runs that recur, so a page's text does not depend on its host's size.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from notewright.llm import common

#: Words of a run that counts as long, and pages of a host that one suffix array takes.
RUN, GROUP_PAGES = 6, 256
#: Distinct pages that repeat a run of boilerplate: so many, or all of a host with fewer, but never under LEAST_PAGES.
MOST_PAGES, LEAST_PAGES = 5, 3
#: Hosts over GROUP_PAGES that are broadcast; with more, they are joined by a shuffle.
BROADCAST_HOSTS = 100_000

#: Fixed values of HTML: elements whose content is no markup, elements that start a block, elements without an end.
RAW = frozenset("script style textarea iframe title noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(["br", "hr"])
#: Elements that end a paragraph left open.
CLOSES_P = BLOCKS - {"option", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
DROPPED = frozenset("nav header footer aside button menu dialog head select object svg noscript template".split())
MAIN = frozenset(["article", "main"])
SPECIAL = DROPPED | MAIN | {"form"}
#: Words of class, id and role names that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsors sponsored promo promos promotion promoted banner banners menu menus nav navbar navigation"
    " breadcrumb breadcrumbs sidebar sidebars footer header masthead cookie cookies consent gdpr notice notices alert popup modal newsletter newsletters subscribe subscription"
    " signup login share sharing social related recommended recommendations comment comments disqus reply replies respond widget widgets toolbar pagination pager skip copyright legal disclaimer".split()
)
#: Words that may stand beside a mark in a name; with any other word ("with-sidebar", "entry-header") it marks nothing.
BESIDE = frozenset(
    "site page main top bottom left right center primary secondary global local mobile desktop sticky fixed floating inline list lists item items box boxes block blocks bar bars container containers wrapper"
    " wrap area areas section sections inner outer link links button buttons icon icons unit units slot slots zone form forms text message messages overlay content contents body holder group row col column"
    " module panel posts articles stories news media meta thread count author avatar date js no id the de us google policy privacy side crumbs trail toggle collapse dropdown tabs tab bread rail tools".split()
)
PARTS = re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|$|=)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)(>?)")
RAW_ENDS = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
ENDS = re.compile(r"""=\s*(["'])|>""")
#: Kinds of blocks; an article within a FORM is one, within what is MARKED it is none.
ARTICLE, MARKED, OPEN, FORM = 0, 1, 2, 3


@functools.lru_cache(maxsize=4096)
def marks(name: str) -> bool:
    """Whether a class, id or role name marks what is not the article: all its words are marks or stand
    beside marks ("site-footer", "adBox1"), and one is a mark."""
    words = [w.lower() for w in PARTS.findall(name) if not w.isdigit()]
    return any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE or len(w) == 1 for w in words)


class Tokens:
    """The tags and texts of a page in order, each place looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def tag_end(self, at: int) -> int:
        """Where the tag that starts at ``at`` ends, -1 if it does not; values in quotes may hold ``>``."""
        i = at
        while self.quotes:
            m = ENDS.search(self.page, i)
            if m is None:
                self.quotes = False  # from here on no tag ends outside of quotes: they are taken as they come
                break
            if m[1] is None:
                return m.end()
            i = self.page.find(m[1], m.end()) + 1
            if not i:
                self.quotes = False
        i = self.page.find(">", at) + 1
        return i or -1

    def __iter__(self) -> Iterator[tuple[str, bool, str]]:
        """``("", False, text)``, or the name of a tag in lower case, whether it is an end, its rest."""
        page, at, n = self.page, 0, len(self.page)
        text = 0  # where the text not yet given starts
        while at < n:
            start = page.find("<", at)
            if start < 0:
                break
            m = TAG.match(page, start)
            if m is None:
                if page.startswith("<!--", start):
                    end = page.find("-->", start + 4) + 3
                    end = n if end < 3 else end
                elif page.startswith(("<!", "<?", "</"), start):
                    end = page.find(">", start) + 1 or n
                else:
                    at = start + 1
                    continue
                if text < start:
                    yield "", False, page[text:start]
                at = text = end
                continue
            slash, name, whole = m.groups()
            end = m.end() if whole else self.tag_end(m.end())
            if end < 0:
                break  # no tag ends any more: the rest is text
            if text < start:
                yield "", False, page[text:start]
            name, closing = name.lower(), slash == "/"
            yield name, closing, "" if whole else page[m.end() : end - 1]
            at = text = end
            if name in RAW and not closing:
                close = RAW_ENDS[name].search(page, end)
                if close is None:
                    return
                at = text = close.start()
        if text < n:
            yield "", False, page[text:]


def blocks(page: str) -> list[tuple[int, str]]:
    """The blocks of a page in order: (kind, text), the text unescaped, its white space single."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = [("", OPEN)]
    tall: list[int] = [0]  # places of block elements in the stack
    opened: dict[str, int] = {}

    def close_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((stack[-1][1], text))
            parts.clear()

    def cut(i: int) -> None:
        if not stack[-1][1] == stack[i][1] == stack[i - 1][1]:
            close_block()
        while len(stack) > i:
            opened[stack.pop()[0]] -= 1
        while tall[-1] >= i:
            tall.pop()

    for tag, closing, rest in Tokens(page):
        if not tag:
            parts.append(html.unescape(rest) if "&" in rest else rest)
            continue
        block = tag in BLOCKS
        if block or tag in DROPPED or tag in BREAKS:
            close_block()
        if closing:
            if opened.get(tag):
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                cut(i)
            continue
        if tag in VOID or rest.endswith("/") and not block and tag not in DROPPED:
            continue
        if tag in CLOSES_P and stack[tall[-1]][0] == "p":
            cut(tall[-1])
        kind = stack[-1][1]
        if kind != MARKED and (rest or tag in SPECIAL):
            if tag in DROPPED and not (tag == "header" and kind == ARTICLE):
                kind = MARKED
            elif rest and HIDDEN.search(rest) and tag not in ("html", "body"):
                kind = MARKED
            # In an article's sentences a name marks nothing; comments and teasers can be articles too.
            elif (block or kind != ARTICLE) and "=" in rest and tag not in ("html", "body", "main") and any(marks(n) for found in NAMES.findall(rest) for n in "".join(found).split()):
                kind = MARKED
            elif tag in MAIN:
                kind = ARTICLE
            elif tag == "form":
                kind = FORM
        if kind != stack[-1][1]:
            close_block()
        stack.append((tag, kind))
        opened[tag] = opened.get(tag, 0) + 1
        if block:
            tall.append(len(stack) - 1)
    close_block()
    return out


def holders(words: np.ndarray, page: np.ndarray, run: int = RUN, same: np.ndarray | None = None) -> np.ndarray:
    """For each word, how many distinct pages hold the run of ``run`` words that starts there.

    A suffix array by prefix doubling, sorted as deep as ``run`` words: suffixes that share so many
    get the same rank, and the pages of a rank are counted.  No run crosses pages; where one would,
    the count is 0.  Pages with the same number in ``same`` count once.
    """
    n = len(words)
    out = np.zeros(n, np.int64)
    if n < 2 * run:
        return out
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        depth += step
    inside = np.zeros(n, bool)
    inside[: n - run + 1] = page[: n - run + 1] == page[run - 1 :]
    suffixes = np.flatnonzero(inside)
    if not len(suffixes):
        return out
    number = page if same is None else same
    suffixes = suffixes[np.lexsort((number[suffixes], rank[suffixes]))]  # the suffix array
    r, p = rank[suffixes], number[suffixes]
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    first = np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1])].astype(np.int64)
    out[suffixes] = np.repeat(np.add.reduceat(first, starts), np.diff(np.r_[starts, len(r)]))
    return out


def windows(words: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ``run`` words inside a page start, and a hash of each."""
    at = np.flatnonzero(page[: len(page) - run + 1] == page[run - 1 :]) if len(page) >= run else np.zeros(0, np.int64)
    out = np.zeros(len(at), np.uint64)
    for j in range(run):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[at + j]
    return at, out.view(np.int64)


def inside_runs(starts: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which words are inside a run that starts where ``starts`` is true."""
    edges = np.zeros(len(starts) + run, np.int64)
    at = np.flatnonzero(starts)
    edges[at] += 1
    edges[at + run] -= 1
    return np.cumsum(edges)[: len(starts)] > 0


def repeated(words: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which words are inside a run of ``run`` words or more that two distinct pages hold."""
    return inside_runs(holders(words, page, run) >= 2, run)


def needed(pages: int) -> int:
    """How many distinct pages of a host repeat what is boilerplate there."""
    return min(MOST_PAGES, max(LEAST_PAGES, pages))


def hashed(around: list[list[str]]) -> np.ndarray:
    """Hashes of the words of split blocks, in order."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for b in around for w in b), np.uint64)


def host_runs(pages: DataFrame, small: bool, tables: common.Tables) -> DataFrame:
    """``host, group, twice, often``: of the runs of a group's pages (host, group, html), those that two
    distinct pages of the host hold, and those that enough of them hold to be boilerplate."""
    schema = pa.schema([("host", pa.string()), ("group", pa.int64()), ("content", pa.int64()), ("runs", pa.list_(pa.int64()))])

    def found(batch: pa.RecordBatch) -> dict[str, object]:
        content, runs = [], []
        for h in common.texts_of(batch.column(2)):
            cut = blocks(h)
            content.append(xxhash.xxh3_64_intdigest("\n".join(f"{int(k == ARTICLE)}{t}" for k, t in cut).encode("utf-8", "replace")) - 2**63)
            words = hashed([t.split() for k, t in cut if k != ARTICLE])
            runs.append(np.unique(windows(words, np.zeros(len(words), np.int64))[1]))
        return {"host": batch.column(0), "group": batch.column(1), "content": content, "runs": runs}

    held = tables.put("runs", pages.mapInArrow(common.by_batch(found, schema), "host string, group long, content long, runs array<long>"))
    distinct = held.dropDuplicates(["host", "content"])
    contents = held.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("contents"))
    often = distinct.select("host", F.explode("runs").alias("run")).groupBy("host", "run").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    often = often.join(F.broadcast(contents) if small else contents, "host")
    often = often.select("host", "run", (F.col("n") >= F.least(F.lit(MOST_PAGES), F.greatest(F.lit(LEAST_PAGES), "contents"))).alias("enough"))
    own = held.select("host", "group", F.explode("runs").alias("run")).distinct()
    return own.join(often, ["host", "run"]).groupBy("host", "group").agg(F.collect_list("run").alias("twice"), F.collect_list(F.when(F.col("enough"), F.col("run"))).alias("often"))


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` for every page, and ``n_words_around``, ``n_repeated``: how many
    words stand outside the article, and how many of them two distinct pages of the host repeat.

    Null and empty pages have an empty text.  Null urls and urls without a host are one host.
    Repeated rows give repeated rows and count as one page, like all pages of one content, an empty table an empty
    result.  Broken markup is read as it comes: what is open at the end is closed there.  Columns
    that are not named are not read.
    """
    spark = pages.sparkSession
    common.small_batches(spark)
    counts = pages.groupBy(host_of(F.col(url)).alias("host")).agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") > GROUP_PAGES)
    tables = common.Tables(spark, "html")
    counts = tables.put("hosts", counts.select("host", F.ceil(F.col("pages") / GROUP_PAGES).alias("groups")))
    small = counts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    kind = pages.schema[key].dataType
    parsed_schema = pa.schema([("key", to_arrow_type(kind)), ("url", pa.string()), ("host", pa.string()), ("article", pa.binary()), ("around", pa.list_(pa.string())), ("marked", pa.list_(pa.bool_())), ("has_article", pa.bool_())])
    key_ddl = f"key {kind.simpleString()}, url string"

    def parsed(batch: pa.RecordBatch) -> dict[str, object]:
        found = [blocks(h) for h in common.texts_of(batch.column(3))]
        # The article only passes through: packed, it costs the shuffle half.
        return {
            "key": batch.column(0),
            "url": batch.column(1),
            "host": batch.column(2),
            "article": [zlib.compress("\n".join(t for k, t in f if k == ARTICLE).encode("utf-8", "replace"), 1) for f in found],
            "around": [[t for k, t in f if k != ARTICLE] for f in found],
            "marked": [[k in (MARKED, FORM) for k, t in f if k != ARTICLE] for f in found],
            "has_article": [any(k == ARTICLE for k, _ in f) for f in found],
        }

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(page).alias("html"))
    cut = rows.mapInArrow(common.by_batch(parsed, parsed_schema), f"{key_ddl}, host string, article binary, around array<string>, marked array<boolean>, has_article boolean")
    large = F.broadcast(counts) if small else counts
    group = F.pmod(F.xxhash64("key", "url"), F.col("groups"))
    cut = cut.join(large, "host", "left").withColumn("group", F.coalesce(group, F.lit(0)))
    dealt = cut.select("host", "group", "groups", *[f.name for f in parsed_schema if f.name != "host"])
    if counts.limit(1).count():
        runs = host_runs(rows.join(large, "host").select("host", group.alias("group"), "html"), small, tables)
    else:
        runs = spark.createDataFrame([], "host string, group long, twice array<long>, often array<long>")
    # A group's runs come before its pages.
    dealt = dealt.unionByName(runs, allowMissingColumns=True).repartition("host", "group").sortWithinPartitions("host", "group", F.col("has_article").isNotNull(), "key")
    schema = pa.schema([("key", to_arrow_type(kind)), ("url", pa.string()), ("text", pa.string()), ("n_words_around", pa.int64()), ("n_repeated", pa.int64())])

    def finish(held: list[dict], runs: dict) -> Iterator[pa.RecordBatch]:
        split = [[t.split() for t in r["around"]] for r in held]
        words = hashed([b for s in split for b in s])
        sizes = np.array([sum(map(len, s)) for s in split], np.int64)
        page = np.repeat(np.arange(len(held)), sizes)
        if held[0]["groups"] is None:
            numbers: dict[tuple, int] = {}
            page_no = [numbers.setdefault((r["article"], *r["around"]), len(numbers)) for r in held]
            # Equal pages count as one.
            count = holders(words, page, same=np.repeat(page_no, sizes))
            twice, covered = inside_runs(count >= 2), inside_runs(count >= needed(len(numbers)))
        else:
            starts, hashes = windows(words, page)
            twice, covered = (np.zeros(len(words), bool) for _ in range(2))
            twice[starts] = np.isin(hashes, np.array(runs.get("twice", []), np.int64))
            covered[starts] = np.isin(hashes, np.array(runs.get("often", []), np.int64))
            twice, covered = inside_runs(twice), inside_runs(covered)
        out: dict[str, list] = {f.name: [] for f in schema}
        at = 0
        for r, s, n in zip(held, split, sizes.tolist(), strict=True):
            mine, n_twice, at = covered[at : at + n], int(twice[at : at + n].sum()), at + n
            text = zlib.decompress(r["article"]).decode("utf-8")
            if not r["has_article"]:
                kept, i = [], 0
                for b, marked in zip(s, r["marked"], strict=True):
                    if not marked and not mine[i : i + len(b)].all():
                        kept.append(" ".join(b))
                    i += len(b)
                text = "\n".join(kept)
            for name, value in zip(out, (r["key"], r["url"], text, n, n_twice), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    def grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        now, runs = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                # Repeats of one page share a group whatever its size: no array over twice the size.
                if (r["host"], r["group"]) != now or len(held) >= 2 * GROUP_PAGES:
                    if held:
                        yield from finish(held, runs)
                    if (r["host"], r["group"]) != now:
                        now, runs = (r["host"], r["group"]), {}
                    held = []
                if r["has_article"] is None:
                    runs = {"twice": r["twice"], "often": r["often"]}
                else:
                    held.append(r)
        if held:
            yield from finish(held, runs)

    out = dealt.mapInArrow(grouped, f"{key_ddl}, text string, n_words_around long, n_repeated long")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"), "n_words_around", "n_repeated")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
