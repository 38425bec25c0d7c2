"""Secret scans with a worklist of decoded layers.

The text is the first layer.  Each layer is scanned, and every encoded stretch found in it (URL
escapes, Unicode and HTML escapes, base64, hex, and gzip, zlib, bzip2, xz or Zstandard data inside the
latter two) becomes a new layer, until none is left.  A layer whose content was already met in the
same place is not opened again, so chains that lead back to themselves end.  Layers carry for each character
the span of the text that it comes from; findings are reported as spans of the text.

Null is an empty text: no findings.  A stretch that unpacks to more than ``MAX_LAYER`` bytes is not
held in memory; it is reported itself, as a span of kind ``packed``, so nothing is passed over silently.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import repeat

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .common import batches

KINDS = ("assign", "access", "hex")
MAX_LAYER = 16 << 20

# The base patterns.  Character runs with a least length give the same matches as runs
# of any length of which the short ones are dropped, as both begin where the run begins.
_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINT = re.compile(r"[:=]")

_URL = re.compile(r"%[0-9A-Fa-f]{2}")
_URLS = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
# Every character that a base pattern, encoded data or an escape can hold: none of them crosses the end
# of such a run, nor does one in what the run decodes to.
_RUN = re.compile(r"""[A-Za-z0-9+/_.=:"'\x20%&#;\\{}\t\r\n-]+""")
# The shortest finding has 12 characters of a run; bytes without such a run hold none, encoded or not.
_LEAST_RUN = re.compile(_RUN.pattern[:-1] + "{12,}")
_WIDE = re.compile(rb"(?:[\t\n\r -~]\0){12,}")  # UTF-16 of either order
_PACKED = re.compile(rb"\x1f\x8b|\x78|BZh|\xfd7zXZ\0|\x28\xb5\x2f\xfd")
_ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}"
                     r"|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[a-z]{2,6};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_HEXDATA = re.compile(r"[0-9a-fA-F]{32,}")
# Data wrapped into lines, also by escaped breaks; a match begins only where a run begins.
_BREAK = r"(?:[\r\n]|\\[rn])++[ \t]*+"
_BASE64_LINES = re.compile(
    rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{_BREAK}[A-Za-z0-9+/_-]++)++={{0,2}}")
_HEX_LINES = re.compile(rf"(?<![0-9a-fA-F])[0-9a-fA-F]++(?:{_BREAK}[0-9a-fA-F]++)++")
_BREAKS = re.compile(_BREAK)

Span = tuple[int, int, str]  # start, end, kind


def base_spans(text: str) -> list[Span]:
    found = []
    if _HINT.search(text):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    return found + [(*m.span(), "hex") for m in _HEX.finditer(text)]


class Layer:
    """A text whose character i comes from ``[starts[i], ends[i])`` of the document."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts, ends):
        self.text, self.starts, self.ends = text, starts, ends

    def origin(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def _member(data: bytes, room: int) -> tuple[bytes, bytes] | None:
    """What the first packed member of the bytes unpacks to, and the bytes after it."""
    if data[:2] == b"\x1f\x8b":
        make = lambda: zlib.decompressobj(31)
    elif data[:1] == b"\x78" and len(data) > 2 and (data[0] << 8 | data[1]) % 31 == 0:
        make = lambda: zlib.decompressobj(15)
    elif data[:3] == b"BZh":
        make = bz2.BZ2Decompressor
    elif data[:6] == b"\xfd7zXZ\0":
        make = lzma.LZMADecompressor
    elif data[:4] == b"\x28\xb5\x2f\xfd":
        out = bytearray()
        try:
            with zstd.ZstdDecompressor().stream_reader(data, read_across_frames=True) as stream:
                while len(out) < room and (more := stream.read(min(1 << 16, room - len(out)))):
                    out += more
        except zstd.ZstdError:
            if not out:
                return None
        return bytes(out), b""
    else:
        return None
    try:
        one = make()
        out = one.decompress(data, room)
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return None
    return out, one.unused_data if one.eof else b""


def _inflate(data: bytes) -> bytes | None:
    """Unpacked bytes of all members; None if not packed; OverflowError if more than MAX_LAYER."""
    out, rest = bytearray(), data
    while rest and (member := _member(rest, MAX_LAYER + 1 - len(out))) is not None:
        out += member[0]
        if len(out) > MAX_LAYER:
            raise OverflowError
        rest = member[1]
    return None if rest is data else bytes(out)


def _open(data: bytes) -> bytes | None:
    """The bytes in packed bytes, through any number of packed layers; None if not packed or a cycle."""
    seen, unpacked = set(), _inflate(data)
    if unpacked is None:
        return None
    while unpacked is not None:
        mark = hashlib.blake2b(data, digest_size=16).digest()
        if mark in seen:
            return None
        seen.add(mark)
        data, unpacked = unpacked, _inflate(unpacked)
    return data


def _from_base64(body: str) -> bytes:
    body = body[:len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4), b"-_") if body else b""


def _from_hex(body: str) -> bytes:
    return bytes.fromhex(body[:len(body) - len(body) % 2])


def _texts(data: bytes) -> Iterator[tuple[str, Sequence[int]]]:
    """Texts in bytes, and the byte of each character.  One character a byte: patterns are ASCII,
    and control characters or other bytes only separate."""
    text = data.decode("latin-1")
    if _LEAST_RUN.search(text):
        yield text, range(len(data))
    for m in _WIDE.finditer(data):
        yield m[0][::2].decode("latin-1"), range(m.start(), m.end(), 2)


def _from_data(layer: Layer, places: Sequence[int], word: str, unit: int, size: int,
               decode) -> Iterator[Layer | Span]:
    """Layers in data of ``unit`` characters for ``size`` bytes, begun at any character of a unit.

    Packed data begins at one of the first characters or after one that may belong to a path or name.
    """
    body, last = word.rstrip("="), len(word) - 1
    begins = [[] for _ in range(unit)]
    for i in sorted({*range(unit), *(m.end() for m in re.finditer("[/_-]", body))}):
        begins[i % unit].append(i)
    for off in range(unit):
        data = decode(body[off:])
        for text, at in _texts(data):
            units = [off + k // size * unit for k in at]
            step = unit - 1
            yield Layer(text, [layer.starts[places[u]] for u in units],
                        [layer.ends[places[min(u + step, last)]] for u in units])
        for i in begins[off]:
            at = (i - off) // unit * size
            if not _PACKED.match(data, at):
                continue
            a, b = layer.starts[places[i]], layer.ends[places[last]]
            try:
                new = _open(data[at:])
            except OverflowError:
                yield a, b, "packed"
                continue
            for text, _ in _texts(new or b""):
                yield Layer(text, _Same(a, len(text)), _Same(b, len(text)))


def _rewritten(layer: Layer, a: int, b: int, pattern: re.Pattern, new) -> Layer:
    """A stretch with what matches replaced by the (text, starts, ends) of ``new``."""
    text, out, starts, ends, i = layer.text, [], [], [], a
    for m in pattern.finditer(text, a, b):
        own, first, last = new(layer, m)
        out += text[i:m.start()], own
        for into, before, fresh in ((starts, layer.starts, first), (ends, layer.ends, last)):
            into.extend(before[i:m.start()])
            into.extend(fresh)
        i = m.end()
    out.append(text[i:b])
    starts.extend(layer.starts[i:b])
    ends.extend(layer.ends[i:b])
    return Layer("".join(out), starts, ends)


def _from_url(layer: Layer, m: re.Match) -> tuple[str, list[int], list[int]]:
    """The letters of adjacent URL escapes; each comes from its own escapes."""
    out, starts, ends, at = [], [], [], m.start()
    for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
        broken = "\udc80" <= c <= "\udcff"
        width = 1 if broken else len(c.encode("utf-8"))
        out.append("\ufffd" if broken else c)
        starts.append(layer.starts[at])
        ends.append(layer.ends[at + 3 * width - 1])
        at += 3 * width
    return "".join(out), starts, ends


def _from_escape(layer: Layer, m: re.Match) -> tuple[str, list[int], list[int]]:
    """The letters of one Unicode or HTML escape."""
    word = m[0]
    try:
        new = html.unescape(word) if word[0] == "&" else chr(int(word[2:].strip("{}"), 16))
    except (ValueError, OverflowError):
        new = word
    if "\ud800" <= new[:1] <= "\udfff":
        new = "\ufffd"
    return new, [layer.starts[m.start()]] * len(new), [layer.ends[m.end() - 1]] * len(new)


def _runs_with(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """The whole runs of characters around matches; what is found in a run ends in it."""
    m = pattern.search(text)
    if m:
        for run in _RUN.finditer(text):
            if m.start() < run.end():
                yield run.span()
                m = pattern.search(text, run.end())
                if not m:
                    return


def _inner(layer: Layer) -> Iterator[Layer | Span]:
    """The layers that a layer holds, and spans of kind packed."""
    text = layer.text
    if "%" in text:
        for a, b in _runs_with(text, _URL):
            yield _rewritten(layer, a, b, _URLS, _from_url)
    if "\\" in text or "&" in text:
        for a, b in _runs_with(text, _ESCAPE):
            yield _rewritten(layer, a, b, _ESCAPE, _from_escape)
    for pattern, lines, *kind in ((_BASE64, _BASE64_LINES, 4, 3, _from_base64),
                                  (_HEXDATA, _HEX_LINES, 2, 1, _from_hex)):
        for m in pattern.finditer(text):
            yield from _from_data(layer, range(*m.span()), m[0], *kind)
        for m in lines.finditer(text):
            places, i = [], m.start()
            for gap in _BREAKS.finditer(text, *m.span()):
                places.extend(range(i, gap.start()))
                i = gap.end()
            places.extend(range(i, m.end()))
            if len(places) >= 16:
                yield from _from_data(layer, places, "".join([text[k] for k in places]), *kind)


class _Same:
    """A sequence of one value."""

    def __init__(self, value: int, n: int):
        self.value, self.n = value, n

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[int]:
        return repeat(self.value, self.n)

    def __getitem__(self, i):
        return _Same(self.value, len(range(*i.indices(self.n)))) if isinstance(i, slice) \
            else self.value


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, spans found in inner layers that no base span equals), both sorted."""
    text = text or ""
    base = base_spans(text)
    more: set[Span] = set()
    work = [Layer(text, range(len(text)), range(1, len(text) + 1))]
    done: set[tuple] = set()
    first = True
    while work:
        layer = work.pop()
        if not layer.text:
            continue
        if not first:
            # a content met before at the same place leads to the same findings: a cycle or repeat
            mark = (layer.starts[0], layer.ends[len(layer.text) - 1],
                    hashlib.blake2b(layer.text.encode("utf-8", "replace"), digest_size=16).digest())
            if mark in done:
                continue
            done.add(mark)
            for a, b, kind in base_spans(layer.text):
                more.add((*layer.origin(a, b), kind))
        first = False
        for inner in _inner(layer):
            if isinstance(inner, Layer):
                if inner.text != layer.text:
                    work.append(inner)
            else:
                more.add(inner)
    order = lambda s: (s[0], (*KINDS, "packed").index(s[2]), s[1])
    return sorted(base, key=order), sorted(more - set(base), key=order)


SPAN = "struct<start:int,end:int,kind:string>"


def find_secrets(docs: DataFrame, text_col: str = "text", base_col: str = "base",
                 inner_col: str = "inner") -> DataFrame:
    """``docs`` with ``base`` and ``inner``: arrays of spans (start, end, kind) in code points.

    Columns of ``docs`` with those names are replaced.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (base_col, inner_col)])
    spans = ArrayType(StructType.fromDDL("start int, end int, kind string"))
    schema = StructType([*docs.schema.fields, StructField(base_col, spans),
                         StructField(inner_col, spans)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [dict(zip(("start", "end", "kind"), s)) for s in spans]
        for batch in batches(parts, 4 << 20, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col))
            found = [scan(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([as_rows(b) for b, _ in found], kind),
                 pa.array([as_rows(i) for _, i in found], kind)],
                [*batch.schema.names, base_col, inner_col])

    return docs.mapInArrow(run, schema)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column) -> Column:
    """By start, then kind as listed (packed last), then end."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate((*KINDS, "packed")) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"),
        s["kind"].alias("kind")))
    return F.sort_array(keyed)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each stretch covered by spans replaced by ``mark``; null stays null."""
    found = find_secrets(docs, text_col, "_llm_base", "_llm_inner")
    spans = F.array_sort(F.transform(F.concat("_llm_base", "_llm_inner"), lambda s: F.struct(
        s["start"].alias("a"), s["end"].alias("b"))))
    piece = lambda a, b: F.substring(F.col(text_col), a + 1, F.greatest(b - a, F.lit(0)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        fresh = s["a"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], piece(acc["at"], s["a"]), F.lit(mark))
                     ).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["b"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, cut, lambda acc: F.concat(
        acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))))
    clean = F.when(F.size(spans) > 0, done).otherwise(F.col(text_col))
    return found.withColumn(text_col, clean).drop("_llm_base", "_llm_inner")
