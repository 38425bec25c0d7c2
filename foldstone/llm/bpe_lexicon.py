"""Byte-level BPE with a lexicon of frequent words held in a minimal acyclic transducer.

Spark counts the words of all texts; the frequent ones are merged once and compiled into a minimal
acyclic automaton whose edges carry numbers that add up to the word's place in a table of id
sequences.  Words share prefixes and suffixes.  The file is shipped to every executor and memory-mapped there,
so workers of one machine share its pages.  A word that the automaton does not accept is merged
exactly, so the lexicon changes speed only.

Nulls and empty texts give no ids and decode to an empty text.  Columns of the input with the
names of output columns are replaced.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import kept, staged

#: Fixed value: how byte-level BPE cuts a text into words before merging.
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A word is frequent from so many occurrences on; the automaton gets at most so many words.
MIN_COUNT, MAX_WORDS = 8, 1 << 19
#: Words and pieces that a worker remembers.
CACHE_WORDS, CACHE_LETTERS = 400_000, 8 << 20
LONG_WORD, MATRIX_WORD = 48, 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else 256 + i."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special tokens of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in [*ids.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.bytes_of[i] = token
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.merges = []
        for m in spec["model"]["merges"]:
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            self.merges.append((ids[a], ids[b], ids[a + b]))


_SPACES = regex.compile(r"\s\s|^\s|\s$")


def pieces(text: str) -> list[str]:
    """The text cut before every space, if each lies alone between other characters.

    No word of ``SPLIT`` crosses such a cut and none looks over it, so pieces may be cut into words
    one by one; pieces come again more often than not.  Any other text is one piece.
    """
    if "\0" in text or _SPACES.search(text):
        return [text]
    return text.replace(" ", "\0 ").split("\0")


class Merger:
    """Exact merges: always the pair of lowest rank, the leftmost first."""

    def __init__(self, byte_ids: list[int], merges: list[tuple[int, int, int]]):
        self.byte_ids = byte_ids
        self.pairs = {a << 32 | b: rank << 32 | new for rank, (a, b, new) in enumerate(merges)}
        self.table = None

    def __call__(self, word: bytes) -> tuple[int, ...]:
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > LONG_WORD:
            return self.by_heap(ids)
        get, none = self.pairs.get, 1 << 62
        found = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            ids[i:i + 2] = [best & 0xFFFFFFFF]
            del found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
            if i < len(found):
                found[i] = get(ids[i] << 32 | ids[i + 1], none)
        return tuple(ids)

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another and how many each has, a merge of every word at once."""
        if self.table is None:
            keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
            order = np.argsort(keys)
            self.table = keys[order], np.fromiter(self.pairs.values(), np.int64, len(keys))[order]
        letters = np.array(self.byte_ids, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        parts: list = [None] * len(words)
        order = np.argsort(sizes, kind="stable")
        short = order[:int(np.searchsorted(sizes[order], MATRIX_WORD, "right"))]
        for i in order[len(short):].tolist():
            parts[i] = np.array(self(words[i]), np.int64)
        for lo in range(0, len(short), 1 << 13):  # words of like length, so little is padding
            some = short[lo:lo + (1 << 13)]
            wide = int(sizes[some].max(initial=0))
            data = np.frombuffer(b"".join(words[i].ljust(wide, b"\0") for i in some.tolist()), np.uint8)
            ids = letters[data.reshape(len(some), wide)] if wide else np.zeros((len(some), 0), np.int64)
            ids[np.arange(wide) >= sizes[some][:, None]] = -1
            self._rounds(ids)
            for i, row, n in zip(some.tolist(), ids, (ids >= 0).sum(1).tolist()):
                parts[i] = row[:n]
        return (np.concatenate([*parts, np.zeros(0, np.int64)]),
                np.fromiter(map(len, parts), np.int64, len(parts)))

    def _rounds(self, ids: np.ndarray) -> None:
        """Merge the rows of a matrix, -1 after their ends, until none has a pair to merge."""
        keys, found = self.table
        at, wide = np.arange(len(ids)), ids.shape[1]
        none = np.int64(1) << 62
        while len(at) and wide > 1 and len(keys):
            now = ids[at]
            pair = now[:, :-1] << 32 | np.maximum(now[:, 1:], 0)
            place = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            rank = np.where((keys[place] == pair) & (now[:, 1:] >= 0), found[place], none)
            best = rank.argmin(1)  # the leftmost of the lowest
            low = rank[np.arange(len(at)), best]
            going = low < none
            at, now, best, low = at[going], now[going], best[going], low[going]
            now[np.arange(len(at)), best] = low & 0xFFFFFFFF
            source = np.arange(wide) + (np.arange(wide) > best[:, None])
            now = np.take_along_axis(np.c_[now, np.full(len(now), -1)], source, 1)
            ids[at] = now

    def by_heap(self, ids: list[int]) -> tuple[int, ...]:
        """The same in n log n steps, for words of any length."""
        n, get = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and (found := get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (found >> 32, i, ids[i], ids[j], found & 0xFFFFFFFF))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return tuple(x for x in ids if x >= 0)


def minimal_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Edges of the minimal acyclic automaton of sorted distinct words, with the numbers to add.

    Words arrive in order; when the next word leaves a branch, its states are final in shape and
    are merged with an equal state from the register.
    """
    register: dict[tuple, int] = {}
    shapes: list[tuple] = []  # of registered states: (is an end, ((byte, state), ...))
    path: list[list] = [[False, []]]  # open states along the last word
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            end, edges = path.pop()
            shape = (end, tuple(edges))
            state = register.setdefault(shape, len(shapes))
            if state == len(shapes):
                shapes.append(shape)
            path[-1][1].append((last[len(path) - 1], state))

    for word in words:
        same = len(os.path.commonprefix([last, word]))
        close(same)
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
        last = word
    close(0)
    shapes.append((path[0][0], tuple(path[0][1])))
    below = [0] * len(shapes)  # words that end at or below; children have lower numbers
    starts, labels, targets, adds = [0], bytearray(), [], []
    for i, (end, edges) in enumerate(shapes):
        n = int(end)
        for byte, to in edges:
            labels.append(byte)
            targets.append(to)
            adds.append(n)
            n += below[to]
        below[i] = n
        starts.append(len(labels))
    return {"starts": np.array(starts, np.uint32), "labels": np.frombuffer(bytes(labels), np.uint8),
            "targets": np.array(targets, np.uint32), "adds": np.array(adds, np.uint32),
            "ends": np.array([s[0] for s in shapes], np.uint8)}


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays one after another behind a JSON head with their places."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, at, a.nbytes)
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    with open(path, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))


def mapped(path: str) -> tuple[mmap.mmap, dict[str, memoryview], dict[str, int]]:
    """The file's arrays as views of a memory map, and where each begins."""
    with open(path, "rb") as f:
        whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    n = int.from_bytes(whole[:8], "little")
    head = json.loads(whole[8:8 + n])
    view = memoryview(whole)
    kinds = {"|u1": "B", "<u4": "I", "<i4": "i", "<i8": "q"}
    return whole, {k: view[8 + n + at:8 + n + at + size].cast(kinds[t])
                   for k, (t, at, size) in head.items()}, {
                       k: 8 + n + at for k, (_, at, _) in head.items()}


_OTHER = chr(0x250)


def words_of(text: str, cut=regex.compile(SPLIT).findall) -> list[str]:
    """The words of a text; the same as cutting it with the pattern."""
    if "\0" in text or _SPACES.search(text):
        return cut(text)
    out = []
    for piece in text.replace(" ", "\0 ").split("\0"):
        out += (piece,) if one_word(piece) else cut(piece)
    return out


def one_word(piece: str) -> bool:
    """Whether a piece surely is one word: letters of Latin script, after a space at most."""
    return piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()) and max(piece) < _OTHER


def numbered(words: list[str], index: dict) -> np.ndarray:
    return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


class Coder:
    """Encodes and decodes with a memory-mapped lexicon file.

    Words and pieces met are numbered; new ones of a batch are looked up in the automaton all at
    once, a letter of every word at a time, and those it does not accept are merged.
    """

    def __init__(self, path: str):
        self.whole, v, _ = mapped(path)
        self.v = {k: np.frombuffer(x, x.format) for k, x in v.items()}
        v = self.v
        self.bytes_of = [bytes(x) for x in np.split(v["token_bytes"], v["token_ends"][:-1])]
        self.special = {self.bytes_of[i].decode(): int(i) for i in v["special"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") \
            if self.special else None
        self.split = regex.compile(SPLIT).findall
        self.sort_edges()
        self.token_size = np.diff(v["token_ends"], prepend=0)
        self.token_at = v["token_ends"] - self.token_size
        self.merge = Merger(v["byte_ids"].tolist(), list(zip(
            v["merge_a"].tolist(), v["merge_b"].tolist(), v["merge_new"].tolist())))
        self.forget()

    def sort_edges(self) -> None:
        """Edges in order of (state, byte), so that one search finds many words' next edges."""
        v = self.v
        state = np.repeat(np.arange(len(v["ends"]), dtype=np.int64), np.diff(v["starts"]))
        self.edges = state << 8 | v["labels"]

    def forget(self) -> None:
        """Empty the memory of words."""
        self.new: list[str] = []
        new = self.new

        class Numbers(dict):
            def __missing__(self, word):
                n = self[word] = len(self)
                new.append(word)
                return n

        self.index, self.letters = Numbers(), 0
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Append ids; where they begin."""
        at, end = self.used, self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(end, len(self.ids)), np.int32)])
        self.ids[at:end] = ids
        self.used = end
        return at

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and how many each has."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.start[numbers] - (ends - sizes), sizes)], sizes

    def places(self, words: list[bytes]) -> np.ndarray:
        """The numbers of words in the lexicon, -1 where it has none."""
        v, n = self.v, len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        state = np.full(n, len(v["ends"]) - 1, np.int64)
        number = np.zeros(n, np.int64)
        at, i = np.arange(n) if len(self.edges) else np.zeros(0, np.int64), 0
        alive = np.full(n, bool(len(self.edges)))
        while len(at := at[(sizes[at] > i) & alive[at]]):
            key = state[at] << 8 | data[begin[at] + i]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            found = self.edges[edge] == key
            alive[at] = found
            state[at] = v["targets"][edge]
            number[at] += v["adds"][edge]
            i += 1
        return np.where(alive & (v["ends"][state] > 0), number, -1)

    def _learn(self) -> None:
        """Ids of the words and pieces numbered since the last call."""
        first, index = len(self.size), self.index
        split, inner, counts = [], [], []
        k = 0
        while k < len(self.new):  # pieces of several words number those words too
            piece = self.new[k]
            if not one_word(piece):
                words = self.split(piece)
                if len(words) != 1:
                    split.append(k)
                    inner += [index[w] for w in words]
                    counts.append(len(words))
            k += 1
        words = [w.encode("utf-8", "surrogatepass") for w in self.new]
        self.letters += sum(map(len, words))
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        place = self.places(words)
        known = np.flatnonzero(place >= 0)
        if len(known):
            ends, at = self.v["out_ends"], place[known]
            lo = np.where(at > 0, ends[np.maximum(at - 1, 0)], 0)
            size[known] = ends[at] - lo
            upto = np.cumsum(size[known])
            take = np.arange(int(upto[-1])) + np.repeat(lo - (upto - size[known]), size[known])
            start[known] = self._keep(self.v["outs"][take].astype(np.int32)) + upto - size[known]
        alone = place < 0
        alone[split] = False
        rest = np.flatnonzero(alone)
        ids, wide = self.merge.many([words[j] for j in rest.tolist()])
        start[rest], size[rest] = self._keep(ids) + np.cumsum(wide) - wide, wide
        self.start, self.size = np.r_[self.start, start], np.r_[self.size, size]
        if split:
            ids, wide = self._gather(np.array(inner, np.int64))
            ends = np.r_[0, np.cumsum(wide)][np.r_[0, np.cumsum(counts)]]
            at = np.array(split) + first
            self.start[at], self.size[at] = self._keep(ids) + ends[:-1], np.diff(ends)
        self.new.clear()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, and how many each has."""
        if len(self.index) > CACHE_WORDS or self.letters > CACHE_LETTERS:
            self.forget()
        numbers, counts = [], []
        for text in texts:
            special = self.cut is not None and self.cut.search(text)
            n = 0
            for i, part in enumerate(self.cut.split(text) if special else (text,)):
                words = [part] if special and i % 2 else pieces(part)
                if words == [part] and not (special and i % 2):
                    words = self.split(part)
                numbers.append(np.array([-1 - self.special[part]]) if special and i % 2 else
                               numbered(words, self.index))
                n += len(words)
            counts.append(n)
        self._learn()
        every = np.concatenate([*numbers, np.zeros(0, np.int64)])
        plain = every >= 0
        ids, sizes = self._gather(np.where(plain, every, 0)) if len(self.size) else \
            (np.zeros(0, np.int32), np.zeros(len(every), np.int64))
        if not plain.all():
            kept_ids = np.repeat(plain, sizes)
            sizes = np.where(plain, sizes, 1)
            out = np.zeros(int(sizes.sum()), np.int32)
            own = np.repeat(plain, sizes)
            out[own], out[~own] = ids[kept_ids], -1 - every[~plain]
            ids = out
        return ids, np.diff(np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]])

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def spell(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of ids that lie one after another."""
        wide = self.token_size[ids]
        ends = np.cumsum(wide)
        total = int(ends[-1]) if len(ends) else 0
        data = self.v["token_bytes"][
            np.arange(total) + np.repeat(self.token_at[ids] - (ends - wide), wide)].tobytes()
        at = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]].tolist()
        return [data[lo:hi].decode("utf-8", "replace") for lo, hi in zip(at, at[1:])]

    def decode(self, ids: list[int]) -> str:
        return self.spell(np.array(ids, np.int64), np.array([len(ids)]))[0]


def count_words(docs: DataFrame, text_col: str = "text", special: tuple[str, ...] = (),
                flush: int = 1_000_000) -> DataFrame:
    """(word, n) over all texts; tasks add up what they read before it is shuffled."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        cut = regex.compile("|".join(map(regex.escape, special))) if special else None

        def out():
            seen: Counter = Counter()
            for piece, n in met.items():
                for word in words_of(piece):
                    seen[word] += n
            met.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                ["word", "n"])

        for batch in parts:
            for text in batch.column(0):
                text = text.as_py() or ""
                for part in cut.split(text) if cut and cut.search(text) else (text,):
                    met.update(pieces(part))
                if len(met) > flush:
                    yield out()
        if met:
            yield out()

    return (docs.select(F.col(text_col).alias("text"))
            .mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


def merged_words(words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(word, ids): each word merged once, by Spark's tasks."""
    byte_ids, merges = vocab.byte_ids, vocab.merges

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = Merger(byte_ids, merges)
        for batch in parts:
            ids, sizes = merge.many([w.encode() for w in batch.column("word").to_pylist()])
            at = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.ListArray.from_arrays(
                    pa.array(at), pa.array(ids.astype(np.int32)))], ["word", "ids"])

    return words.mapInArrow(run, "word string, ids array<int>")


def compile_lexicon(docs: DataFrame, vocab_path: str, text_col: str = "text",
                    min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> str:
    """Build the lexicon file from all texts, add it to the session's files; its name there."""
    spark = docs.sparkSession
    vocab = Vocabulary(vocab_path)
    often = staged(count_words(docs, text_col, tuple(vocab.special))
                   .filter(F.col("n") >= min_count).withColumn(
                       "size", F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")))
    least, room = 0, max_words
    for r in often.groupBy("size").count().orderBy(F.desc("size")).collect():
        room -= r["count"]
        if room < 0:
            least = r["size"] + 1
            break
    found = merged_words(often.filter(F.col("size") >= least).select("word"), vocab).toArrow()
    order = pa.compute.sort_indices(found["word"])  # at most max_words rows
    found = found.take(order).combine_chunks()
    words = [w.encode() for w in found["word"].to_pylist()]
    outs = found["ids"].combine_chunks()
    a, b, new = zip(*vocab.merges)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
    save(path, minimal_automaton(words) | {
        "outs": outs.flatten().to_numpy(zero_copy_only=False).astype(np.uint32),
        "out_ends": np.cumsum(pa.compute.list_value_length(outs).to_numpy(zero_copy_only=False),
                              dtype=np.int64),
        "merge_a": np.array(a, np.uint32), "merge_b": np.array(b, np.uint32),
        "merge_new": np.array(new, np.uint32), "byte_ids": np.array(vocab.byte_ids, np.uint32),
        "token_ends": np.cumsum([len(t) for t in vocab.bytes_of], dtype=np.int64),
        "token_bytes": np.frombuffer(b"".join(vocab.bytes_of), np.uint8),
        "special": np.array(sorted(vocab.special.values()), np.uint32)})
    spark.sparkContext.addFile(path)
    return name


def _replaced(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])


def encode(docs: DataFrame, lexicon: str, text_col: str = "text",
           with_decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``n_tokens``, and, if asked, ``decoded`` from the ids."""
    docs = _replaced(docs, "ids", "n_tokens", *["decoded"] * with_decoded)
    schema = StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType())),
                         StructField("n_tokens", LongType())]
                        + [StructField("decoded", StringType())] * with_decoded)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept("coder", lexicon, lambda: Coder(SparkFiles.get(lexicon)))
        for whole in parts:
            for batch in _few(whole, text_col):
                texts = batch.column(batch.schema.get_field_index(text_col))
                flat, sizes = coder.encode_all([t or "" for t in texts.to_pylist()])
                ends = np.zeros(len(sizes) + 1, np.int32)
                np.cumsum(sizes, out=ends[1:])
                more = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(sizes)]
                if with_decoded:
                    more.append(pa.array(coder.spell(flat, sizes), pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *more], [*batch.schema.names, "ids", "n_tokens",
                                              *["decoded"] * with_decoded])

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, lexicon: str, ids_col: str = "ids") -> DataFrame:
    """``coded`` with ``decoded``, the text of the ids; null ids give an empty text."""
    coded = _replaced(coded, "decoded")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept("coder", lexicon, lambda: Coder(SparkFiles.get(lexicon)))
        for batch in parts:
            at = batch.schema.get_field_index(ids_col)
            texts = pa.array([coder.decode(x.as_py() or []) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts],
                                             [*batch.schema.names, "decoded"])

    return coded.mapInArrow(run, StructType([*coded.schema.fields,
                                             StructField("decoded", StringType())]))


def _few(batch: pa.RecordBatch, text_col: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text."""
    from .common import batches

    return batches([batch], size, text_col)
