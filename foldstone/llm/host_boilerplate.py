"""Main text of pages by suffix arrays over the token streams of a host's pages.

Each page is read once into text blocks and a stream of tokens, its tags and words.  Text that
markup itself calls furniture (menus, footers, adverts, forms, comments, ...) is no block; text
inside an article enters the stream as a break, for pages may share an article, which says nothing
of furniture.  The streams of a host's distinct pages are concatenated, their suffixes sorted, and
runs of ``MIN_TOKENS`` or more tokens that occur on ``MIN_PAGES`` or more distinct pages are
boilerplate.  Every page keeps the blocks that such runs do not cover by half: its unique runs.

The words of articles are looked up among the runs the arrays found.  In an article a run counts if
it also lies in ``MIN_PAGES`` or more different articles of the host and in at least half of them
all: a notice of the template that some pages have in a footer and others amid the text goes, while
passages that only articles share, or some articles and an advert, and the lines of an article that
other pages show beside theirs, stay.

A host is cut into blocks of bounded size, whatever its share of all pages.  Each block has a suffix
array of its own; for hosts of several blocks the arrays are merged: a block hands on every
distinct run of ``MIN_TOKENS`` tokens once, with its number of pages, Spark adds them up and gives
back those that became frequent.  So the result does not depend on how hosts are cut.  Equal pages
are one page of the evidence.  Of an article only runs that a bitmap of the found ones lets through
travel, and its text only if the blocks to drop are too many to be sent to all tasks.

Defined results: null and empty pages have an empty text; a null URL is a host of its own; pages
whose every block is covered keep those that are not mostly links.  Equal rows stay rows of their
own.  Only the named columns are read, so other columns never clash.  Nothing is cut or capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, mix, partitions, staged, utf8_buffer, word_hashes
from .page_blocks import BREAK, read_page

#: Tokens of a long run, and distinct pages from which on it is boilerplate.
MIN_TOKENS, MIN_PAGES = 12, 3
#: Tokens of one suffix array.
BLOCK_TOKENS = 1 << 20
#: A table of hosts or blocks is sent to all tasks up to so many rows, runs of articles up to so many.
SHARED_ROWS, SHARED_RUNS = 1 << 16, 1 << 20
#: Bits of the bitmap of found runs: 16 for each, at most so many (2 to this power); it only saves
#: work, as what it lets through is joined with the runs.
MAP_BITS = 28
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_LOW = -(1 << 63)


def read_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """(id, url, host, k1, k2, text, open, pieces, links, starts, stops, stream) of each page.

    ``text`` is the article's; ``open`` pages have none, and their candidate blocks are ``pieces``.
    ``k1`` and ``k2`` are a key of the page's content.
    """
    pages = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"),
                         F.col(f"`{html_col}`").alias("html"))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    pages = pages.withColumn("host", F.coalesce(host, F.lit("")))
    id_kind, url_kind = (pages.schema[c].dataType.simpleString() for c in ("id", "url"))
    lists = {"pieces": pa.string(), "links": pa.int32(), "starts": pa.int32(), "stops": pa.int32()}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 4 << 20, "html"):
            sources = batch.column("html").to_pylist()
            texts, opened, streams, rows = [], [], [], {c: [] for c in lists}
            for source in sources:
                page = read_page(source)
                top = max((b.level for b in page.blocks), default=0)
                texts.append("\n".join(b.text for b in page.blocks if b.level == top) if top else "")
                blocks = [] if top else page.blocks
                opened.append(bool(blocks))
                rows["pieces"].append([b.text for b in blocks])
                rows["links"].append([b.linked for b in blocks])
                rows["starts"].append([b.start for b in blocks])
                rows["stops"].append([b.stop for b in blocks])
                streams.append(" ".join(page.stream))
            hashes, at = word_hashes(*utf8_buffer(pa.array(streams, pa.string())))
            keys = np.array([np.frombuffer(hashlib.blake2b((s or "").encode(), digest_size=16)
                                           .digest(), np.int64) for s in sources]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("id", "url", "host")],
                 pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(texts, pa.string()),
                 pa.array(opened), *[pa.array(rows[c], pa.list_(t)) for c, t in lists.items()],
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()),
                                          pa.array(hashes.view(np.int64)))],
                ["id", "url", "host", "k1", "k2", "text", "open", *lists, "stream"])

    return pages.mapInArrow(
        run, f"id {id_kind}, url {url_kind}, host string, k1 long, k2 long, text string, "
             "open boolean, pieces array<string>, links array<int>, starts array<int>, "
             "stops array<int>, stream array<long>")


def break_token() -> int:
    """The hash of the break of a stream."""
    return int(word_hashes(np.frombuffer(BREAK.encode(), np.uint8),
                           np.array([0, 1]))[0].view(np.int64)[0])


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): suffixes sorted by their first ``depth`` tokens, equal ones of equal rank.

    Ranks of prefixes double in length each round; suffixes that end earlier come first.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width, n = 1, len(tokens)
    while width < depth:
        step = min(width, depth - width)
        after = np.zeros(n, np.int64)
        after[:max(n - step, 0)] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        width += step
    return np.argsort(rank, kind="stable"), rank


def run_hashes(tokens: np.ndarray, places: np.ndarray, depth: int, base: int) -> np.ndarray:
    """A 64-bit hash of the run of ``depth`` tokens at each of some places."""
    mixed = mix(np.r_[tokens.view(np.uint64), np.zeros(depth, np.uint64)] + np.uint64(base))
    h = np.zeros(len(places), np.uint64)
    for j in range(depth):
        h = h * np.uint64(base) + mixed[places + j]
    return mix(h).view(np.int64)


def covered(places: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Which of n tokens lie in a run of ``depth`` tokens that starts at one of the places."""
    steps = np.zeros(n + depth + 1, np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + depth, -1)
    return np.cumsum(steps)[:n] > 0


def pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Two columns of numbers as one array of records."""
    out = np.empty(len(first), np.dtype([("a", np.int64), ("b", np.int64)]))
    out["a"], out["b"] = first, second
    return out


class HostBlock:
    """The concatenated streams of some pages of a host, and their suffix array."""

    def __init__(self, streams: list[np.ndarray], depth: int, broken: int):
        sizes = np.array([len(s) for s in streams], np.int64)
        self.at = np.r_[0, np.cumsum(sizes)]
        self.tokens = np.concatenate([*streams, np.zeros(0, np.int64)]).astype(np.int64)
        self.page = np.repeat(np.arange(len(streams)), sizes)
        self.depth, n = depth, len(self.tokens)
        # a window is whole if it neither leaves its page nor holds a break
        cuts = np.r_[0, np.cumsum(self.tokens == broken)]
        stop = np.arange(n) + depth
        self.whole = stop <= self.at[self.page + 1] if n else np.zeros(0, bool)
        self.whole &= cuts[np.minimum(stop, n)] == cuts[:n]
        self.order, self.rank = suffix_order(self.tokens, depth)

    def frequency(self) -> np.ndarray:
        """On how many distinct pages the run at each place of the array's order occurs."""
        order = self.order[self.whole[self.order]]
        if not len(order):
            return np.zeros(len(self.tokens), np.int64)
        # within a class of equal runs places are ascending, so pages are too
        cls, page = self.rank[order], self.page[order]
        new_class = np.r_[True, cls[1:] != cls[:-1]]
        new_page = new_class | np.r_[True, page[1:] != page[:-1]]
        pages = np.add.reduceat(new_page, np.flatnonzero(new_class))
        out = np.zeros(len(self.tokens), np.int64)
        out[order] = pages[np.cumsum(new_class) - 1]
        return out

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the run of ``depth`` tokens at each place (nonsense if not whole)."""
        places = np.arange(len(self.tokens))
        first, second = (run_hashes(self.tokens, places, self.depth, base) for base in _BASES)
        return first, second

    def covered(self, frequent: np.ndarray) -> np.ndarray:
        """Which tokens lie in a run that starts at a frequent place."""
        return covered(np.flatnonzero(frequent & self.whole), len(self.tokens), self.depth)


def _groups(parts: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key of a partition sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in parts:
        columns = [batch.column(k).to_pylist() for k in keys]
        now = list(zip(*columns))
        cuts = [0] + [i for i in range(1, len(now)) if now[i] != now[i - 1]] + [len(now)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held and now[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = now[lo]
    if held:
        yield pa.Table.from_batches(held)


def _streams(group: pa.Table) -> list[np.ndarray]:
    return [s.values.to_numpy() for s in group["stream"].combine_chunks()] if group.num_rows else []


def _by_block(df: DataFrame, *more: str) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), "host", "part").sortWithinPartitions(
        "host", "part", *more)


def host_runs(read: DataFrame, min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES,
              block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct pages dealt to blocks, the distinct runs that blocks hand on, and of these
    (host, w1, w2) of the frequent ones.

    Blocks of a host that has several hand on all their runs, others the frequent ones.
    """
    broken = break_token()
    one = staged(read.groupBy("host", "k1", "k2").agg(
        F.first("stream").alias("stream"), F.max("open").alias("open")))
    blocks = one.groupBy("host").agg(
        F.ceil(F.sum(F.size("stream")) / block_tokens).alias("blocks")).filter("blocks > 1")
    blocks = staged(blocks)
    large = blocks.count()
    dealt = one.join(F.broadcast(blocks) if large <= SHARED_ROWS else blocks, "host", "left")
    dealt = dealt.select("host", F.pmod(F.xxhash64("k1", "k2"), F.coalesce("blocks", F.lit(1)))
                         .alias("part"), "k1", "k2", "open", "stream",
                         F.coalesce("blocks", F.lit(1)).alias("blocks"))

    def runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(parts, ("host", "part")):
            block = HostBlock(_streams(group), min_tokens, broken)
            pages, (w1, w2) = block.frequency(), block.fingerprints()
            order = block.order[block.whole[block.order]]
            first = np.r_[True, block.rank[order][1:] != block.rank[order][:-1]][:len(order)]
            at = order[first]
            large = group["blocks"][0].as_py() > 1
            if not large:
                at = at[pages[at] >= min_pages]
            for lo in range(0, len(at), 1 << 17):
                i = at[lo:lo + (1 << 17)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group["host"][0].as_py()] * len(i), pa.string()),
                     pa.array(np.full(len(i), group["part"][0].as_py())), pa.array(w1[i]),
                     pa.array(w2[i]), pa.array(np.minimum(pages[i], min_pages))],
                    ["host", "part", "w1", "w2", "pages"])

    handed = staged(_by_block(dealt.select("host", "part", "stream", "blocks")).mapInArrow(
        runs, "host string, part long, w1 long, w2 long, pages long"))
    often = handed.groupBy("host", "w1", "w2").agg(F.sum("pages").alias("all")).filter(
        F.col("all") >= min_pages).drop("all")
    return dealt, handed, staged(often)


def boilerplate(read: DataFrame, min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES,
                block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(k1, k2, host, covered): of each distinct open page, which stream tokens are boilerplate."""
    return covered_streams(*host_runs(read, min_tokens, min_pages, block_tokens), min_tokens, min_pages)


def covered_streams(dealt: DataFrame, handed: DataFrame, often: DataFrame, min_tokens: int,
                    min_pages: int) -> DataFrame:
    """(k1, k2, host, covered) of the open ones of the pages dealt to blocks."""
    broken = break_token()
    known = handed.filter(F.col("pages") < min_pages).join(often, ["host", "w1", "w2"]).select(
        "host", "part", F.col("w1").alias("k1"), F.col("w2").alias("k2"),
        F.lit(None).cast("boolean").alias("open"),
        F.lit(None).cast("array<long>").alias("stream"), F.lit(0).alias("kind"))
    rows = dealt.drop("blocks").withColumn("kind", F.lit(1)).unionByName(known)

    def cover(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(parts, ("host", "part")):
            kind = group["kind"].to_numpy()
            told, pages = group.filter(pa.array(kind == 0)), group.filter(pa.array(kind == 1))
            block = HostBlock(_streams(pages), min_tokens, broken)
            frequent = block.frequency() >= min_pages
            if told.num_rows:
                frequent |= np.isin(pairs(*block.fingerprints()),
                                    pairs(told["k1"].to_numpy(), told["k2"].to_numpy()))
            marked = block.covered(frequent)
            opened = np.flatnonzero(pages["open"].to_numpy(zero_copy_only=False).astype(bool))
            if not len(opened):
                continue
            yield pa.RecordBatch.from_arrays(
                [*[pages[c].combine_chunks().take(pa.array(opened)) for c in ("k1", "k2", "host")],
                 pa.array([marked[block.at[i]:block.at[i + 1]] for i in opened],
                          pa.list_(pa.bool_()))], ["k1", "k2", "host", "covered"])

    return _by_block(rows, "kind").mapInArrow(
        cover, "k1 long, k2 long, host string, covered array<boolean>")


def unique_text(pieces: list[str], links: list[int], starts: list[int], stops: list[int],
                covered: np.ndarray) -> str:
    """The blocks that runs do not cover by half; if there are none, those that are not links."""
    sums = np.r_[0, np.cumsum(covered)]
    own = [p for p, a, b in zip(pieces, starts, stops) if 2 * (sums[b] - sums[a]) < max(b - a, 1)]
    return "\n".join(own or [p for p, n in zip(pieces, links) if 2 * n < len("".join(p.split()))])


def _bitmap(runs: DataFrame) -> tuple[bytes, int]:
    """A bitmap of hashes of (host, w1), and its number of bits; none if there are no runs."""
    n = runs.count()
    bits = 1 << min(max((16 * n).bit_length(), 15), MAP_BITS)
    place = F.col("w1").bitwiseXOR(F.xxhash64("host")).bitwiseAND(F.lit(bits - 1)) + 1
    out = bytearray(bits // 8 if n else 0)
    for r in runs.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toLocalIterator():
        out[(r["at"] - 1) * len(r["bits"]):r["at"] * len(r["bits"])] = r["bits"]
    return bytes(out), bits


def line_tokens(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, where each line's and each text's begin (and the end), and
    the places of the runs of ``depth`` words that lie in one line."""
    data, at = utf8_buffer(texts)
    cuts = np.union1d(at, np.flatnonzero(data == 10))
    hashes, lines = word_hashes(data, cuts)
    stops = np.repeat(lines[1:], np.diff(lines))
    places = np.arange(len(hashes))
    return hashes, lines, lines[np.searchsorted(cuts, at)], places[places + depth <= stops]


def article_runs(read: DataFrame, often: DataFrame, min_tokens: int, min_pages: int) -> DataFrame:
    """(host, article, runs): of each distinct article, its runs that are boilerplate, if any.

    These are frequent outside articles and lie in enough different articles of the host, and in at
    least half of them.
    """
    whole, bits = _bitmap(often)
    shared = read.sparkSession.sparkContext.broadcast(whole)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.frombuffer(shared.value, np.uint8)
        if not len(told):
            return
        for batch in batches(parts, 4 << 20):
            hashes, _, first, places = line_tokens(batch.column("text"), min_tokens)
            w1 = run_hashes(hashes, places, min_tokens, _BASES[0])
            page = np.searchsorted(first, places, "right") - 1
            bit = (w1 ^ batch.column("h").to_numpy()[page]) & (bits - 1)
            hit = (told[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            places, w1, page = places[hit], w1[hit], page[hit]
            w2 = run_hashes(hashes, places, min_tokens, _BASES[1])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(pa.array(page)) for c in ("host", "article")],
                 pa.array(w1), pa.array(w2)], ["host", "article", "w1", "w2"])

    run_of = ["host", "w1", "w2"]
    articles = read.filter("not open and text <> ''").select(
        "host", F.xxhash64("host").alias("h"), F.md5("text").alias("article"), "text")
    met = articles.mapInArrow(run, "host string, article string, w1 long, w2 long")
    met = staged(met.join(often, run_of, "left_semi").distinct())
    all_of = articles.select("host", "article").distinct().groupBy("host").agg(
        F.count("*").alias("all"))
    spread = met.groupBy(run_of).agg(F.count("*").alias("n")).filter(
        F.col("n") >= min_pages).join(all_of, "host").filter("2 * n >= all").select(run_of)
    return staged(met.join(spread, run_of).groupBy("host", "article").agg(
        F.collect_list(F.struct("w1", "w2")).alias("runs")))


def article_text(read: DataFrame, often: DataFrame, min_tokens: int, min_pages: int) -> DataFrame:
    """(id, url, text) of the pages with an article: its lines that boilerplate does not cover by
    half; the whole article if there are none."""
    articles = read.filter("not open").select("id", "url", "host", "text")
    runs = article_runs(read, often, min_tokens, min_pages)
    size = runs.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]
    if not size:
        return articles.drop("host")
    kinds = [f"{c} {read.schema[c].dataType.simpleString()}" for c in ("id", "url")]

    def own(text: str, w1: list[int], w2: list[int]) -> str:
        hashes, lines, _, places = line_tokens(pa.array([text]), min_tokens)
        mine = pairs(*(run_hashes(hashes, places, min_tokens, base) for base in _BASES))
        places = places[np.isin(mine, pairs(np.array(w1), np.array(w2)))]
        sums = np.r_[0, np.cumsum(covered(places, len(hashes), min_tokens))]
        kept = [p for p, a, b in zip(text.split("\n"), lines[:-1], lines[1:], strict=True)
                if 2 * (sums[b] - sums[a]) < max(b - a, 1)]
        return "\n".join(kept) or text

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 4 << 20):
            rows = zip(*[batch.column(c).to_pylist() for c in ("text", "w1", "w2")])
            texts = [t if a is None else own(t, a, b) for t, a, b in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string())],
                ["id", "url", "text"])

    runs = runs.select("host", "article", F.col("runs.w1").alias("w1"), F.col("runs.w2").alias("w2"))
    joined = articles.withColumn("article", F.md5("text")).join(
        F.broadcast(runs) if size <= SHARED_RUNS else runs, ["host", "article"], "left")
    return joined.select("id", "url", "text", "w1", "w2").mapInArrow(
        run, ", ".join([*kinds, "text string"]))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html", min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES,
              block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, url, text), one row per row of ``pages``."""
    read = staged(read_pages(pages, id_col, url_col, html_col))
    dealt, handed, often = host_runs(read, min_tokens, min_pages, block_tokens)
    found = covered_streams(dealt, handed, often, min_tokens, min_pages)
    opened = read.filter("open").drop("stream", "text").join(found, ["host", "k1", "k2"])
    kinds = [f"{c} {read.schema[c].dataType.simpleString()}" for c in ("id", "url")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows = zip(*[batch.column(c).to_pylist() for c in ("pieces", "links", "starts", "stops",
                                                               "covered")])
            texts = [unique_text(*r[:4], np.array(r[4], bool)) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string())],
                ["id", "url", "text"])

    mended = opened.select("id", "url", "pieces", "links", "starts", "stops", "covered").mapInArrow(
        run, ", ".join([*kinds, "text string"]))
    return article_text(read, often, min_tokens, min_pages).unionByName(mended)
