"""Alignment of the tokens of two tokenizers by coalescing intervals of bytes.

A task encodes each text with both tokenizers and turns the tokens into byte intervals.  All A and
B intervals of a batch are lexsorted by their start, the running maximum of ends is accumulated,
and a group breaks where a start reaches it; within a group every A occurrence is linked with every
B occurrence.  A document's distinct id pairs are staged with how often each is linked, so that
texts are encoded once.  Spark counts in how many documents a pair is linked and the highest count
of each A id.  The most widespread pairs, at most ``SHARED_PAIRS``, go to all tasks; documents
with other pairs look those up by a join, so a pair held by most documents is never a join key and
results do not depend on the bound.

Defined results: null and empty texts, and texts whose tokens of either side do not spell out
space + text, have zeros and an empty digest.  Equal rows are documents of their own, as are rows
with the same or no id.  Texts are never cut: a long one is encoded whole.  Only the named columns
are read, so other columns never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_lexicon import SPLIT, Vocabulary
from .common import batches, kept, staged

#: Pairs sent to all tasks, those of the highest counts: 13 bytes each.
SHARED_PAIRS = 1 << 20
#: Bytes of text encoded at a time, and links expanded at a time.
BATCH_BYTES, LINKS_AT_ONCE = 1 << 20, 1 << 21
_BITS = np.int64(32)
_LOW = np.int64((1 << 32) - 1)


def byte_table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes one after another, where each begins, and its length."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


def piece_bytes(piece: str) -> bytes:
    """Bytes of a sentence piece: a byte piece is its byte, U+2581 is a space."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Side:
    """One tokenizer: ids of many texts, and the bytes of an id."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode = encode
        self.data, self.begin, self.size = byte_table(tokens)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids one after another."""
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.arange(total) + np.repeat(self.begin[ids] - (ends - sizes), sizes)]


def byte_level_encoder(path: str, vocab: Vocabulary):
    """A function from texts to the ids of a byte-level BPE file.

    Where ids are numbered in the order of merges, as they are in files of plain training, the
    merge of lowest rank is the one whose result has the lowest id, and the faster library that
    works on such ranks gives the same ids; any other file goes through its own library.
    """
    if [i for *_, i in vocab.merges] == list(range(256, 256 + len(vocab.merges))):
        import tiktoken

        fast = tiktoken.Encoding(
            "ranks", pat_str=SPLIT, special_tokens={},
            mergeable_ranks={t: i for i, t in enumerate(vocab.bytes_of) if i < 256 + len(vocab.merges)})
        return lambda texts: [fast.encode_ordinary(t) for t in texts]
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    own.no_padding()
    own.no_truncation()
    # one text a call: a tokenizer that fans out over threads takes cores that Spark gave to others
    return lambda texts: [own.encode(t, add_special_tokens=False).ids for t in texts]


def sides(a_path: str, b_path: str) -> tuple[Side, Side]:
    """Both tokenizers, loaded once by a worker."""
    return kept("sides", (a_path, b_path), lambda: _load(a_path, b_path))


def _load(a_path: str, b_path: str) -> tuple[Side, Side]:
    import sentencepiece

    vocab = Vocabulary(a_path)
    a = byte_level_encoder(a_path, vocab)
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    pieces = [piece_bytes(b.id_to_piece(i)) for i in range(b.get_piece_size())]
    return (Side(lambda texts: a([" " + t for t in texts]), vocab.bytes_of),
            Side(lambda texts: b.encode(texts, num_threads=1), pieces))


def coalesce(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): intervals by start, and the number of the group that each falls in.

    A group breaks where a start reaches the highest end so far; empty intervals go before others.
    """
    order = np.lexsort((ends, starts))
    s, e = starts[order], ends[order]
    high = np.maximum.accumulate(e)
    breaks = np.zeros(len(s), np.int64)
    breaks[1:] = s[1:] >= high[:-1]
    return order, np.cumsum(breaks)


def _ids(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch as one array and where each text's begin."""
    at = np.zeros(len(found) + 1, np.int64)
    np.cumsum([len(x) for x in found], out=at[1:])
    flat = np.empty(int(at[-1]), np.int64)
    for x, lo, hi in zip(found, at, at[1:]):
        flat[lo:hi] = x
    return flat, at


def _spells(side: Side, ids: np.ndarray, at: np.ndarray, data: np.ndarray,
            want: np.ndarray) -> np.ndarray:
    """Whether each text's tokens spell its bytes (``data`` cut at ``want``)."""
    ends = np.r_[0, np.cumsum(side.size[ids])]
    same = np.diff(ends[at]) == np.diff(want)
    spelled = side.spelled(ids)
    for i in np.flatnonzero(same):
        lo, hi = ends[at[i]], ends[at[i + 1]]
        same[i] = np.array_equal(spelled[lo:hi], data[want[i]:want[i + 1]])
    return same


def _kept(ids: np.ndarray, at: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(at)
    return ids[np.repeat(fine, sizes)], np.r_[0, np.cumsum(np.where(fine, sizes, 0))]


def _tally(docs: np.ndarray, pairs: np.ndarray, times: np.ndarray):
    """Equal (document, pair) added up, in order."""
    order = np.lexsort((pairs, docs))
    docs, pairs, times = docs[order], pairs[order], times[order]
    first = np.r_[True, (docs[1:] != docs[:-1]) | (pairs[1:] != pairs[:-1])] if len(docs) else \
        np.zeros(0, bool)
    at = np.flatnonzero(first)
    return docs[at], pairs[at], np.add.reduceat(times, at) if len(at) else times


def _links(a_ids: np.ndarray, a_at: np.ndarray, b_ids: np.ndarray, b_at: np.ndarray,
           doc_of: np.ndarray):
    """(document, pair, times) of all links, and the number of links of each group.

    Ids lie in order of their group and begin at ``a_at`` and ``b_at``; ``doc_of`` is each group's
    document.  Links are expanded in slices of groups; a group larger than a slice is first added
    up by id on both sides.
    """
    n = len(doc_of)
    na, nb = np.diff(a_at), np.diff(b_at)
    links = na * nb
    done = [np.zeros(0, np.int64)] * 3
    sums = np.cumsum(links)
    lo = 0
    while lo < n:
        before = sums[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sums, before + LINKS_AT_ONCE, "right")))
        if links[lo] > LINKS_AT_ONCE:
            ua, ta = np.unique(a_ids[a_at[lo]:a_at[lo + 1]], return_counts=True)
            ub, tb = np.unique(b_ids[b_at[lo]:b_at[lo + 1]], return_counts=True)
            pairs = ((ua[:, None] << _BITS) | ub[None]).ravel()
            times = (ta[:, None] * tb[None]).ravel()
            docs = np.full(len(pairs), doc_of[lo])
        else:
            k, total = links[lo:hi], int(links[lo:hi].sum())
            group = np.repeat(np.arange(lo, hi), k)
            inside = np.arange(total) - np.repeat(np.cumsum(k) - k, k)
            pairs = (a_ids[a_at[group] + inside // nb[group]] << _BITS) | \
                b_ids[b_at[group] + inside % nb[group]]
            docs, times = doc_of[group], np.ones(total, np.int64)
        done = _tally(*[np.concatenate(x) for x in zip(done, (docs, pairs, times))])
        lo = hi
    return done, links


@lru_cache(maxsize=1)
def _digits(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return byte_table([str(i).encode() + b"," for i in range(n)])


def _digests(a_ids, a_at, b_ids, b_at, group_at) -> list[str]:
    """Of each document: groups as `a,a|b;a|b,b`, hashed; empty where there are none.

    ``a_at`` and ``b_at`` are where each group's ids begin.  Ids of both sides are dealt to their
    places in the text and written as digits and the mark that follows.
    """
    n, groups = len(a_ids) + len(b_ids), int(group_at[-1])
    if not n:
        return [""] * (len(group_at) - 1)
    ids = np.empty(n, np.int64)
    ids[np.arange(len(a_ids)) + np.repeat(b_at[:-1], np.diff(a_at))] = a_ids
    ids[np.arange(len(b_ids)) + np.repeat(a_at[1:], np.diff(b_at))] = b_ids
    data, begin, size = _digits(1 << max(1, int(ids.max()).bit_length()))
    sizes = size[ids]
    ends = np.cumsum(sizes)
    text = data[np.arange(int(ends[-1])) + np.repeat(begin[ids] - (ends - sizes), sizes)]
    text[ends[a_at[1:] + b_at[:-1] - 1] - 1] = ord("|")
    stops = ends[a_at[1:] + b_at[1:] - 1]
    text[stops - 1] = ord(";")
    stops = np.r_[0, stops][np.minimum(group_at, groups)]
    return [hashlib.sha256(text[lo:hi - 1]).hexdigest() if hi > lo else ""
            for lo, hi in zip(stops[:-1].tolist(), stops[1:].tolist())]


def align_batch(texts: list[str | None], a: Side, b: Side) -> dict[str, np.ndarray | list]:
    """The groups and links of a batch of texts, by document number."""
    spaced = [(" " + t).encode() if t else b"" for t in texts]
    want = np.r_[0, np.cumsum([len(s) for s in spaced], dtype=np.int64)]
    data = np.frombuffer(b"".join(spaced), np.uint8)
    full = [t or "" for t in texts]
    a_ids, a_at = _ids([x if t else [] for x, t in zip(a.encode(full), full)])
    b_ids, b_at = _ids([x if t else [] for x, t in zip(b.encode(full), full)])
    fine = _spells(a, a_ids, a_at, data, want) & _spells(b, b_ids, b_at, data, want)
    (a_ids, a_at), (b_ids, b_at) = _kept(a_ids, a_at, fine), _kept(b_ids, b_at, fine)
    n_a, n_b = np.diff(a_at), np.diff(b_at)

    # texts lie one after another, so intervals of different documents never overlap
    a_end, b_end = np.cumsum(a.size[a_ids]), np.cumsum(b.size[b_ids])
    starts = np.r_[a_end - a.size[a_ids], b_end - b.size[b_ids]]
    order, group = coalesce(starts, np.r_[a_end, b_end])
    of = np.empty(len(order), np.int64)
    of[order] = group
    a_group, b_group = of[:len(a_ids)], of[len(a_ids):]
    n_all = int(group[-1]) + 1 if len(group) else 0
    group_doc = np.zeros(n_all, np.int64)
    group_doc[a_group] = np.repeat(np.arange(len(texts)), n_a)
    group_at = np.searchsorted(group_doc, np.arange(len(texts) + 1))
    begins = np.arange(n_all + 1)
    a_from, b_from = np.searchsorted(a_group, begins), np.searchsorted(b_group, begins)
    (docs, pairs, times), links = _links(a_ids, a_from, b_ids, b_from, group_doc)
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(group_at),
            "n_links": np.diff(np.r_[0, np.cumsum(links)][group_at]),
            "groups_sha256": _digests(a_ids, a_from, b_ids, b_from, group_at),
            "at": np.searchsorted(docs, np.arange(len(texts) + 1)), "pairs": pairs, "times": times}


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def linked_pairs(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, row, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times), one row per document.

    ``row`` is a key of the staged row; a pair is the A id in the high and the B id in the low half.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(a_path, b_path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches(parts, BATCH_BYTES):
            got = align_batch(batch.column("text").to_pylist(), a, b)
            n, at = batch.num_rows, pa.array(got["at"], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.arange(row, row + n)),
                 *[pa.array(got[c], pa.int64()) for c in _COUNTS],
                 pa.array(got["groups_sha256"], pa.string()),
                 pa.ListArray.from_arrays(at, pa.array(got["pairs"])),
                 pa.ListArray.from_arrays(at, pa.array(got["times"]))],
                ["id", "row", *_COUNTS, "groups_sha256", "pairs", "times"])
            row += n

    return docs.mapInArrow(run, f"id {kind}, row long, n_a long, n_b long, n_groups long, "
                                "n_links long, groups_sha256 string, pairs array<long>, "
                                "times array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked; whether its A id has no higher."""
    n = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(
        F.count("*").alias("n"))
    n = staged(n)
    a = F.shiftright("pair", 32)
    # one row per A id: no more rows than the vocabulary has entries
    high = n.groupBy(a.alias("a")).agg(F.max("n").alias("high"))
    return staged(n.withColumn("a", a).join(F.broadcast(high), "a")
                  .select("pair", "n", (F.col("n") == F.col("high")).alias("best")))


def widespread(counts: DataFrame, limit: int = SHARED_PAIRS) -> tuple[np.ndarray, ...]:
    """The pairs of the highest counts, at most ``limit``, sorted, with count and best.

    Counts are taken in classes of about 4 %, whole classes only, so there is no tie to break.
    """
    size = F.floor(F.log2(F.col("n").cast("double")) * 16)
    least, room = 0, limit
    for r in counts.groupBy(size.alias("s")).count().orderBy(F.desc("s")).collect():
        room -= r["count"]
        if room < 0:
            least = r["s"] + 1
            break
    t = counts.filter(size >= least).select("pair", "n", "best").toArrow()
    pairs = t["pair"].to_numpy()
    order = np.argsort(pairs)
    return pairs[order], t["n"].to_numpy()[order], t["best"].to_numpy()[order]


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id",
                 text_col: str = "text", shared: int = SHARED_PAIRS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row per document."""
    aligned = staged(linked_pairs(docs, a_path, b_path, id_col, text_col))
    counts = pair_counts(aligned)
    spread = aligned.sparkSession.sparkContext.broadcast(widespread(counts, shared))
    kind = aligned.schema["id"].dataType.simpleString()
    own = ["id", "row", *_COUNTS, "groups_sha256"]

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = spread.value
        for batch in parts:
            lists = batch.column("pairs")
            at = lists.offsets.to_numpy().astype(np.int64)
            pairs = lists.values.to_numpy()[at[0]:at[-1]]
            times = batch.column("times").values.to_numpy()[at[0]:at[-1]]
            at = at - at[0]
            place = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[place] == pairs if len(keys) else np.zeros(len(pairs), bool)
            weight = np.zeros(len(pairs), np.int64)
            weight[known] = n[place[known]] * times[known]
            top = np.zeros(len(pairs), np.int64)
            top[known] = best[place[known]] * times[known]
            add = lambda x: np.diff(np.r_[0, np.cumsum(x)][at])
            rest = pa.array(np.r_[0, np.cumsum(~known)][at].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in own], pa.array(add(top)), pa.array(add(weight)),
                 pa.ListArray.from_arrays(rest, pa.array(pairs[~known])),
                 pa.ListArray.from_arrays(rest, pa.array(times[~known]))],
                [*own, "n_best", "count_sum", "pairs", "times"])

    found = aligned.mapInArrow(
        look, f"id {kind}, row long, n_a long, n_b long, n_groups long, n_links long, "
              "groups_sha256 string, n_best long, count_sum long, pairs array<long>, "
              "times array<long>")
    found = staged(found)
    rest = (found.filter(F.size("pairs") > 0)
            .select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
            .select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("t"))
            .join(counts, "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("b"),
                 F.sum(F.col("t") * F.col("n")).alias("c")))
    more = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long").alias(a)
    return found.join(rest, "row", "left").select(
        "id", *_COUNTS, more("n_best", "b"), more("count_sum", "c"), "groups_sha256")
