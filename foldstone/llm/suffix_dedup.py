"""Removal of byte strings that also start elsewhere, by two-stage suffix sorting.

A string of ``length`` bytes is assigned to an anchor: of the ``GRAM``-byte strings inside it, the
one with the least hash (the leftmost of equals).  Equal strings have equal anchors, so

1. tasks cut each text into runs of starts with one anchor; of equal runs of a batch, all of which
   repeat, one goes on and the bytes of all are joined within each text; anchors met once are done;
2. runs of an anchor met more than ``SPLIT`` times are cut by where the anchor lies in the string
   and renamed by the bytes that all strings of such a class share: first in classes of ``CLASSES[0]``
   places, where the name is still that frequent in classes of one, where it stands for the whole
   string.  Equal strings keep equal names, and names met once are done, so a phrase with different
   text around it in a third of all documents leaves nothing;
3. runs with a shared anchor are shuffled by it, equal runs of a task as one, with their places;
4. a task concatenates the runs of many anchors and sorts their suffixes in two stages: suffixes
   smaller than their successor are sorted directly, the others are induced by scanning the buckets
   of first bytes; neighbours in this order whose common prefix reaches ``length`` repeat.

Starts whose string has a hash of its own within the task cannot repeat and are left out of the
sorting, as are runs that occur as a whole at several places, which repeat anyway.

Nulls and empty texts have no bytes.  Rows equal in id and text are rows of their own: they repeat
one another.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, mix, partitions, rolling, row_key, staged, utf8_buffer

LENGTH, GRAM = 400, 32
#: Runs of one anchor that a task holds at most, and places of the anchor that make a finer name.
SPLIT, CLASSES = 4096, (32, 1)
#: At most so many names can each have a larger share of all runs: these are broadcast.
SHARES = 50_000
_BLOCK = 1 << 20
#: Bytes of runs that are sorted together, and places held until then.
SORTED, PLACES = 1 << 20, 50_000
BREAK = 0xFF  # in no UTF-8 text


def runs(data: np.ndarray, at: np.ndarray, length: int = LENGTH,
         gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor place, its hash) of runs of starts with one anchor."""
    out = []
    width = length - gram + 1
    for begin in range(0, len(data), _BLOCK):
        part = data[begin:begin + _BLOCK + length - 1]
        n = len(part) - length + 1
        if n <= 0:
            break
        lo, hi = np.maximum(at[:-1] - begin, 0), np.minimum(at[1:] - length - begin, n - 1)
        some = hi >= lo
        if not some.any():
            continue
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, lo[some], 1)
        np.add.at(step, hi[some] + 1, -1)
        valid = np.cumsum(step[:-1]) > 0
        h = rolling(part, gram)
        place = np.arange(len(h), dtype=np.uint64)
        key = (h >> np.uint64(32) << np.uint64(32)) | place
        # least key of each window: of the rest of its block and of the begin of the next one
        rows = -(-len(key) // width)
        grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
        grid[:len(key)] = key
        grid = grid.reshape(rows, width)
        head = np.minimum.accumulate(grid, axis=1).ravel()
        tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(tail[:n], head[width - 1:width - 1 + n])
                  & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        first = np.flatnonzero(new)
        ends = valid.copy()
        ends[:-1] &= ~valid[1:] | new[1:]
        last = np.flatnonzero(ends)
        text = np.searchsorted(at, first + begin, "right") - 1
        out.append((text, first + begin - at[text], last + begin - at[text],
                    anchor[first] + begin - at[text], h[anchor[first]]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out))


def met_twice(data: np.ndarray, at: np.ndarray, found: tuple[np.ndarray, ...],
              length: int = LENGTH) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Which runs to go on with: the first of equal ones.  (text, begin, end) of what equal ones hold.

    Equal runs repeat one another whole, and any other string that is equal to one of theirs is
    equal to one of the first.  Copies and texts of one phrase over and over so leave few runs.
    """
    text, first, last, place, anchor = found
    goes_on = np.ones(len(text), bool)
    if not len(text):
        return goes_on, []
    shape = mix(anchor + mix((last - first).astype(np.uint64) << np.uint64(32)
                             | (place - first).astype(np.uint64)))
    _, which, times = np.unique(shape, return_inverse=True, return_counts=True)
    like = np.flatnonzero(times[which] > 1)
    begin, end = at[text[like]] + first[like], at[text[like]] + last[like] + length
    marks: dict[bytes, int] = {}
    twice: set[int] = set()
    for i, a, b in zip(like.tolist(), begin.tolist(), end.tolist()):
        one = marks.setdefault(hashlib.blake2b(data[a:b], digest_size=16).digest(), i)
        if one != i:
            goes_on[i] = False
            twice.update((one, i))
    spans: list[tuple[int, int, int]] = []
    for i in sorted(twice):  # runs are in the order of texts and starts
        t, a, b = int(text[i]), int(first[i]), int(last[i]) + length
        if spans and spans[-1][0] == t and a <= spans[-1][2]:
            spans[-1] = t, spans[-1][1], max(spans[-1][2], b)
        else:
            spans.append((t, a, b))
    return goes_on, spans


def two_stage_order(text: bytes, wanted: np.ndarray, depth: int) -> list[int]:
    """The wanted positions in the order of the ``depth`` bytes from them on.

    A suffix is small if it is less than its successor.  Small ones are sorted; any other is
    its first byte before a smaller suffix, so a scan in order meets that one first and puts the
    larger in the next free place of its first byte's bucket, ahead of the small ones there.
    """
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    small = np.zeros(n, bool)
    if len(change):
        up = t[change + 1] > t[change]
        stop = np.searchsorted(change, np.arange(n))
        inner = stop < len(change)
        small[inner] = up[stop[inner]]
    small[n - 1] = True  # stands for the end
    # the wanted ones, and what follows them up to the next small suffix
    use = np.zeros(n, bool)
    use[wanted] = True
    nearest = np.flatnonzero(small)
    reach = nearest[np.searchsorted(nearest, wanted)]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, wanted, 1)
    np.add.at(step, reach + 1, -1)
    use |= np.cumsum(step[:-1]) > 0
    sorted_small = sorted(np.flatnonzero(use & small).tolist(), key=lambda i: text[i:i + depth])
    large = use & ~small
    room = np.bincount(t[large], minlength=256).tolist()
    of_small: list[list[int]] = [[] for _ in range(256)]
    for i in sorted_small:
        of_small[text[i]].append(i)
    buckets: list[list[int]] = [[] for _ in range(256)]
    is_large = large.tobytes()
    for c in range(256):
        bucket = buckets[c]
        k = 0
        while k < len(bucket):  # grows while it is read: runs of one byte
            i = bucket[k] - 1
            k += 1
            if i >= 0 and is_large[i]:
                buckets[text[i]].append(i)
        for i in of_small[c]:
            if i > 0 and is_large[i - 1]:
                buckets[text[i - 1]].append(i - 1)
        if len(bucket) != room[c]:
            raise AssertionError("a suffix was not induced")
        bucket.extend(of_small[c])
    asked = np.zeros(n, bool)
    asked[wanted] = True
    asked = asked.tobytes()
    return [i for bucket in buckets for i in bucket if asked[i]]


def repeated_starts(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece the starts whose string also starts elsewhere in the pieces."""
    whole = bytes([BREAK]).join(pieces) + bytes([BREAK])
    data = np.frombuffer(whole, np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begins = np.cumsum(sizes + 1) - sizes - 1
    h = rolling(data, length)
    step = np.zeros(len(h) + 1, np.int64)
    fit = sizes >= length
    np.add.at(step, begins[fit], 1)
    np.add.at(step, begins[fit] + sizes[fit] - length + 1, -1)
    valid = np.cumsum(step[:-1]) > 0
    starts = np.flatnonzero(valid)
    by = np.argsort(h[starts], kind="stable")
    ordered = h[starts][by]
    same = np.r_[False, ordered[1:] == ordered[:-1]][:len(ordered)]
    starts = np.sort(starts[by[same | np.r_[same[1:], False][:len(same)]]])
    marked = np.zeros(len(data) + 1, bool)
    if len(starts):
        order = two_stage_order(whole, starts, length)
        for a, b in zip(order, order[1:]):
            if whole[a:a + length] == whole[b:b + length]:  # the common prefix reaches length
                marked[a] = marked[b] = True
    return [np.flatnonzero(marked[b:b + s]) for b, s in zip(begins, sizes)]


def _ranges(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Stretches of bytes that the strings at sorted starts cover."""
    if len(starts) == 0:
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, gap + 1]].tolist(),
                    (starts[np.r_[gap, len(starts) - 1]] + length).tolist()))


def finer(data: bytes, run: dict, width: int, length: int = LENGTH,
          gram: int = GRAM) -> Iterator[tuple[int, int, int]]:
    """(name, first, last): a run cut by the anchor's place in the string, ``width`` places a class.

    The strings of a class share the bytes from its least place before the anchor to the end of the
    string that begins at its largest; they and the class make the name.
    """
    first, last, place = run["first"], run["last"], run["place"]
    for j in range((place - last) // width, (place - first) // width + 1):
        low, high = j * width, min(j * width + width - 1, length - gram)
        name = hashlib.blake2b(data[place - low:place - high + length], digest_size=8,
                               salt=struct.pack("<qi", run["anchor"], j)).digest()
        yield (int.from_bytes(name, "little", signed=True),
               max(first, place - high), min(last, place - low))


def met_again(found: DataFrame, split: int = SPLIT) -> tuple[DataFrame, DataFrame, list[int]]:
    """Runs whose anchor has several but not too many, runs of the others, and those anchors.

    Too many are more than ``split`` and more than one in ``SHARES`` of all runs, so fewer than
    ``SHARES`` anchors: they reach the runs by broadcast, and none gathers its runs in one task.
    """
    counts = staged(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    most = max(split, found.count() // SHARES)
    often = F.broadcast(counts.filter(F.col("n") > most).select("anchor"))
    few = found.join(often, "anchor", "left_anti").join(
        counts.filter(F.col("n") <= most).select("anchor"), "anchor")
    return few, found.join(often, "anchor"), [r.anchor for r in often.collect()]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            length: int = LENGTH, gram: int = GRAM, split: int = SPLIT) -> DataFrame:
    """(id, text, spans): spans are the sorted maximal byte ranges to remove, null if none."""
    spark = docs.sparkSession
    n = partitions(spark)
    names = ["anchor", "key", "first", "last", "place"]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.select(row_key("id", "text").alias("key"), "id", "text")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Different runs of a batch; without an anchor: the bytes of those that repeat in it."""
        for batch in batches(parts, 8 << 20):
            data, at = utf8_buffer(batch.column("text"))
            found = runs(data, at, length, gram)
            goes_on, known = met_twice(data, at, found, length)
            text, first, last, place, anchor = (c[goes_on] for c in found)
            keys = batch.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(keys[text]),
                 pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
                 pa.array(place.astype(np.int32))], names)
            if known:
                text, first, end = map(np.array, zip(*known))
                none = len(known)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(none, pa.int64()), pa.array(keys[text]),
                     pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32)),
                     pa.nulls(none, pa.int32())], names)

    def cut_again(levels: list[set[int]]):
        """Runs of the last level's names; texts are cut anew, which is less than shuffling them."""

        def names_of(data: bytes, run: dict) -> Iterator[dict]:
            open_runs = [run]
            for often, width in zip(levels, CLASSES):
                open_runs = [{"anchor": name, "first": a, "last": b, "place": run["place"]}
                             for r in open_runs if r["anchor"] in often
                             for name, a, b in finer(data, r, width, length, gram)]
            yield from open_runs

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first_level = np.array(sorted(levels[0]), np.int64)
            for batch in batches(parts, 4 << 20):
                whole, begins = utf8_buffer(batch.column("text"))
                found = runs(whole, begins, length, gram)
                often = np.isin(found[-1].view(np.int64), first_level)
                found = tuple(c[often] for c in found)
                goes_on, known = met_twice(whole, begins, found, length)
                keys = batch.column("key").to_pylist()
                if known:
                    yield pack([(None, keys[i], a, b, None) for i, a, b in known])
                text, first, last, place, anchor = (c[goes_on] for c in found)
                anchor = anchor.view(np.int64)
                out, at, data = [], -1, b""
                for i in range(len(text)):
                    if text[i] != at:
                        at = int(text[i])
                        data, key = batch.column("text")[at].as_py().encode(), keys[at]
                    own = {"anchor": int(anchor[i]), "first": int(first[i]), "last": int(last[i]),
                           "place": int(place[i])}
                    out += [(r["anchor"], key, r["first"], r["last"], r["place"])
                            for r in names_of(data, own)]
                    if len(out) > 100_000:
                        yield pack(out)
                        out = []
                if out:
                    yield pack(out)

        def pack(out: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        return run

    def per_text(found: DataFrame, *names: str) -> DataFrame:
        return found.groupBy("key").agg(F.collect_set(F.struct(*names)).alias("runs"))

    # rows equal in id and text have the same runs: both count, and they are looked at once
    schema = "anchor long, key long, first int, last int, place int"
    kept, known, levels, job = [], [], [], cut
    for level in range(len(CLASSES) + 1):
        found = staged(rows.select("key", "text").mapInArrow(job, schema))
        known.append(found.filter("anchor is null").select(
            "key", F.col("first").alias("a"), F.col("last").alias("b")))
        few, many, often = met_again(found.filter("anchor is not null"), split)
        kept.append(few)
        if not often:
            break
        if level == len(CLASSES):  # names that stand for whole strings
            kept.append(many)
            break
        levels.append(set(often))
        job = cut_again(list(levels))
    of_text = per_text(reduce(DataFrame.unionByName, kept), "first", "last", "anchor")

    def ship(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each different run of a batch once with its number of places (kind 0), and its place (1).

        A run with several places in the batch repeats for certain: the bytes of those places are
        known here, are joined within each text and only pass through (kind 2).
        """
        names = ["anchor", "kind", "mark", "key", "first", "n", "bytes"]
        for batch in batches(parts, 4 << 20):
            seen: dict[tuple[int, bytes], list] = {}
            places = []
            for key, text, own in zip(batch.column("key").to_pylist(),
                                      batch.column("text").to_pylist(),
                                      batch.column("runs").to_pylist()):
                data = text.encode()
                for r in own:
                    piece = data[r["first"]:r["last"] + length]
                    mark = hashlib.blake2b(piece, digest_size=16).digest()
                    seen.setdefault((r["anchor"], mark), [0, piece])[0] += 1
                    places.append((r["anchor"], mark, key, r["first"]))
            if places:
                m = len(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in seen], pa.int64()), pa.array([0] * m, pa.int32()),
                     pa.array([k[1] for k in seen], pa.binary()), pa.nulls(m, pa.int64()),
                     pa.nulls(m, pa.int32()), pa.array([v[0] for v in seen.values()], pa.int32()),
                     pa.array([v[1] for v in seen.values()], pa.binary())], names)
                known: dict[int, list] = {}
                for anchor, mark, key, first in places:
                    times, piece = seen[anchor, mark]
                    if times > 1:
                        known.setdefault(key, []).append((first, first + len(piece)))
                whole = []
                for key, own in known.items():
                    at = 0
                    for a, b in sorted(set(own)):
                        if at and a <= at:
                            whole[-1][2] = at = max(at, b)
                        else:
                            whole.append([key, a, at := b])
                if whole:
                    key, first, end = zip(*whole)
                    m = len(key)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key, pa.int64()), pa.array([2] * m, pa.int32()),
                         pa.nulls(m, pa.binary()), pa.array(key, pa.int64()),
                         pa.array(first, pa.int32()), pa.array(end, pa.int32()),
                         pa.nulls(m, pa.binary())], names)
                places = [p for p in places if seen[p[0], p[1]][0] == 1]
                if not places:
                    continue
                anchor, mark, key, first = zip(*places)
                m = len(anchor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor, pa.int64()), pa.array([1] * m, pa.int32()),
                     pa.array(mark, pa.binary()), pa.array(key, pa.int64()),
                     pa.array(first, pa.int32()), pa.nulls(m, pa.int32()),
                     pa.nulls(m, pa.binary())], names)

    def solve(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by anchor, runs before places."""
        pieces: dict[tuple[int, bytes], list] = {}
        places: list[tuple] = []
        ranges: dict[tuple[int, bytes], list] | None = None
        passed: list[tuple] = []
        size, now = 0, None

        def settle() -> dict:
            out = {}
            kinds: dict[int, int] = {}
            for a, _ in pieces:
                kinds[a] = kinds.get(a, 0) + 1
            mixed = [k for k in pieces if kinds[k[0]] > 1]
            marks = dict(zip(mixed, repeated_starts([pieces[k][1] for k in mixed], length))) \
                if mixed else {}
            for k, (times, piece) in pieces.items():
                out[k] = [(0, len(piece))] if times > 1 else _ranges(marks.get(k, ()), length)
            return out

        def emit(solved: dict):
            rows = passed + [(key, first + a, first + b) for anchor, mark, key, first in places
                    for a, b in solved[anchor, mark]]
            if rows:
                key, a, b = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                    ["key", "a", "b"])

        for batch in parts:
            cols = [batch.column(c).to_pylist() for c in
                    ("anchor", "kind", "mark", "key", "first", "n", "bytes")]
            for anchor, kind, mark, key, first, times, piece in zip(*cols):
                if kind == 2:
                    passed.append((key, first, times))
                    continue
                if anchor != now:
                    if ranges is not None or size > SORTED:
                        yield from emit(ranges if ranges is not None else settle())
                        pieces, places, passed, ranges, size = {}, [], [], None, 0
                    now = anchor
                if kind == 0:
                    own = pieces.setdefault((anchor, mark), [0, piece])
                    size += len(piece) if own[0] == 0 else 0
                    own[0] += times
                else:
                    places.append((anchor, mark, key, first))
                    if len(places) > PLACES:  # a very common anchor: its places pass through
                        ranges = ranges if ranges is not None else settle()
                        yield from emit(ranges)
                        places, passed = [], []
        yield from emit(ranges if ranges is not None else settle())

    # the text goes through one exchange, which both joins below read
    tagged = rows.join(of_text, "key").select("key", "id", "text", "runs")
    spans = (tagged.mapInArrow(ship, "anchor long, kind int, mark binary, key long, first int, "
                               "n int, bytes binary")
             .repartition(n, "anchor").sortWithinPartitions("anchor", "kind")
             .mapInArrow(solve, "key long, a int, b int")
             .unionByName(reduce(DataFrame.unionByName, known))
             .groupBy("key").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans")))
    return rows.join(spans, "key", "left").select("id", "text", "spans")


def remove(found: DataFrame) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): ``kept`` holds the bytes that remain."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 4 << 20):
            out = []
            for text, spans in zip(batch.column("text").to_pylist(),
                                   batch.column("spans").to_pylist()):
                data, at, kept, count = text.encode(), 0, [], 0
                for s in spans or ():
                    if s["a"] > at or count == 0:
                        kept.append(data[at:s["a"]])
                        count += 1
                    at = max(at, s["b"])
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((len(data), len(data) - len(rest), count, rest))
            n_bytes, removed, spans, kept = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, pa.int64()) for c in (n_bytes, removed, spans)),
                 pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = found.schema["id"].dataType.simpleString()
    return found.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
