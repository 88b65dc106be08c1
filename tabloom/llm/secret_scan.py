r"""Secrets in plain and in encoded text: a worklist that unwraps layers until none is new.

Every layer is scanned for the base kinds:

* ``assign``: a secret's name, ``:`` or ``=``, and a value of 8 characters or more;
* ``access``: ``AKIA`` and capitals or digits, 16 characters or more together;
* ``hex``: 32 or more hexadecimal digits.

A layer's runs of URL escapes, Unicode and octal escapes and base64 are decoded into new layers; gzip, zlib, bzip2,
xz or zstandard data anywhere in the bytes that base64, percent or backslash escapes spell are unpacked, all
members as one stream, also where the escapes go on over several lines or quoted literals. It is scanned in windows of ``UNPACK_BYTES`` that overlap and keep an encoded run whole.
An encoded run longer than a window may hold packed data that is not read to its end: ``n_cut`` counts the
runs of the text that hold one, and ``redact`` masks them whole. A layer seen before at the same place is not
taken up again, so texts that decode to themselves end. Each layer keeps, for each of its characters,
the source characters it came from, so a secret found deep inside maps to a span of the original text.
What was unpacked maps to the whole packed run.

Decoded bytes are scanned whatever else they hold: as UTF-8 where they are, else byte by byte, and ASCII
in two or four bytes a character (UTF-16, UTF-32) as a layer of its own.

A base64 run goes on over line ends and indentation, also line ends written as ``\n``, those before ``> `` and
the quotes of adjoining literals, and is decoded from
each of its first four characters. So every start in it is tried: what stands before the encoded text
without a gap, such as a path or the word that ends the line above, does not hide it.

Spans are ``kind:start:end`` in code points, end exclusive, ordered by start, then kind as listed above,
then end. ``base`` spans come from the text itself. Decoded finds are added unless a base span of the
same kind holds them.

Defined results: a missing or empty text has no spans (digest of no bytes). Repeated rows give repeated
results, an empty table an empty one; columns other than the keys and the text are not read.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.batches import _quoted, add_columns, map_rows, texts

# The base kinds, in order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

# Cheap tests of a whole batch: a text that matches none of its kind's is not scanned further.
_MAY_ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]"
_MAY_ACCESS = r"AKIA[A-Z0-9]{12}"
_MAY_HEX = r"[0-9a-f]{32}"
_MAY_DECODE = r"%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#[0-9xX]|[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-][ \t]*(?:[\r\n]|\\[rn])|[A-Za-z0-9+/_-][\"'][ \t]*[+.\\]?[ \t]*[+.bBrRuU]*[\"']|\\[0-7]|\x00"

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|\\(?P<octal>[0-3]?[0-7]{1,2})|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
#: What a base64 run goes on over.
_BREAK = re.compile(
    r"[ \t]*+(?:\r\n|\r|\n|\\r\\n|\\n)[ \t]*+(?:>[ \t]*+)*+"
    r"|(?:\\r)?(?:\\n)?[\"'][ \t]*+[+.\\]?[ \t]*+(?:\r\n|\r|\n)?[ \t]*+(?:>[ \t]*+)*+[+.]?[ \t]*+[bBrRuU]{0,2}[\"']"
)
_BASE64 = re.compile(
    rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{16,}}+|[A-Za-z0-9+/_-]++(?=(?:{_BREAK.pattern})[A-Za-z0-9+/_-]))"
    rf"(?:(?:{_BREAK.pattern})[A-Za-z0-9+/_-]++)*+={{0,2}}"
)
_LEAST = 16
#: Bytes of unpacked data that are scanned at a time, those of them scanned again with the next ones, and bytes of one step.
UNPACK_BYTES = 64 << 20
_OVERLAP = 1 << 20
_PIECE = 1 << 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, each leftmost and without overlaps."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A decoded text with, for each character, where its source begins and ends in the original."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def whole(cls, text: str, low: int, high: int) -> Layer:
        """A layer of which every character comes from the same source."""
        return cls(text, np.broadcast_to(np.int64(low), len(text)), np.broadcast_to(np.int64(high), len(text)))

    @property
    def flat(self) -> bool:
        return self.starts.strides == (0,)

    def span(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())


def _spliced(layer: Layer, pieces: list[tuple[int, int, str]]) -> Layer:
    """The layer with (start, end) ranges replaced; new characters map to their whole range."""
    out, starts, ends, at = [], [], [], 0
    if layer.flat:
        for start, end, new in pieces:
            out += [layer.text[at:start], new]
            at = end
        return Layer.whole("".join(out) + layer.text[at:], int(layer.starts[0]), int(layer.ends[0]))
    for start, end, new in pieces:
        out += [layer.text[at:start], new]
        low, high = layer.span(start, end)
        starts += [layer.starts[at:start], np.full(len(new), low)]
        ends += [layer.ends[at:start], np.full(len(new), high)]
        at = end
    out.append(layer.text[at:])
    return Layer("".join(out), np.concatenate([*starts, layer.starts[at:]]), np.concatenate([*ends, layer.ends[at:]]))


def _url(layer: Layer) -> Layer | None:
    """Runs of percent escapes, character by character of what they spell."""
    pieces = []
    for m in _URL.finditer(layer.text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        at = 0
        while at < len(raw):
            n = next((n for n in (1, 2, 3, 4) if (c := raw[at : at + n].decode("utf-8", "ignore")) and len(c.encode()) == n), 0)
            if n:
                pieces.append((m.start() + 3 * at, m.start() + 3 * (at + n), raw[at : at + n].decode()))
            at += n or 1
    return _spliced(layer, pieces) if pieces else None


def _unicode(layer: Layer) -> Layer | None:
    pieces = []
    for m in _UNICODE.finditer(layer.text):
        code = next((g for g in m.groups() if g), None)
        if code is None:
            new = html.unescape(m[0])
        else:
            number = int(code, 8 if m["octal"] else 16)
            if number > 0x10FFFF:
                continue
            new = chr(number)
        if new != m[0] and not any("\ud800" <= c <= "\udfff" for c in new):
            pieces.append((m.start(), m.end(), new))
    pieces = _surrogates(layer.text, pieces)
    return _spliced(layer, pieces) if pieces else None


_PAIR = re.compile(r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})")


def _surrogates(text: str, pieces: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Adds the characters that two escapes spell together."""
    pairs = [
        (m.start(), m.end(), chr(0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00)) for m in _PAIR.finditer(text)
    ]
    return sorted(pieces + pairs) if pairs else pieces


_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")


@dataclass
class Packed:
    """A window of unpacked bytes, the source they come from, and whether the data goes on after it."""

    data: bytes
    low: int
    high: int
    more: bool


def _unpack(data: bytes, at: int) -> Generator[bytes, None, tuple[int, bool]]:
    """Pieces of what is packed at a place; returns where it ends, and whether the data ended before it did."""
    start, step = at, min(_PIECE, UNPACK_BYTES)
    zstd = data[at] == 0x28
    try:
        if zstd:
            import zstandard

            unpack = zstandard.ZstdDecompressor().decompressobj()
        else:
            unpack = {0x42: bz2.BZ2Decompressor, 0xFD: lzma.LZMADecompressor}.get(data[at], lambda: zlib.decompressobj(47))()
        size = 512 if zstd else 1 << 16  # 512 bytes of zstandard data hold less than 128 blocks of 128 KB
        while at < len(data):
            rest = data[at : at + size]
            at += len(rest)
            while True:
                if piece := unpack.decompress(rest) if zstd else unpack.decompress(rest, step):
                    yield piece
                if unpack.eof:
                    return at - len(unpack.unused_data), False
                rest = getattr(unpack, "unconsumed_tail", b"")
                if not rest and getattr(unpack, "needs_input", True):
                    break
        if hasattr(unpack, "unconsumed_tail") and (piece := unpack.flush()):
            yield piece
        return at, True
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        return start + 1, False
    except Exception as problem:  # zstandard's error class exists only with the library
        if type(problem).__name__ == "ZstdError":
            return start + 1, False
        raise


_IN_RUN = np.isin(np.arange(256), np.frombuffer(b"+/_-=%\\ \t\r\n", np.uint8))
_IN_RUN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _windows(data: bytes, more: bool, missed: Callable[[int], None], read: list | None = None) -> Iterator[tuple[int, bytes, bool]]:
    """(place, window, whether more follows) of what is packed in some bytes, all members as one stream.

    ``missed`` gets the place of data that may hold something packed that is not read to its end, ``read``
    the (start, end) of each member that was.
    """
    at, first, held = 0, -1, bytearray()
    while m := _MAGIC.search(data, at):
        source = _unpack(data, m.start())
        while True:
            try:
                held += next(source)
            except StopIteration as end:
                at, short = max(end.value[0], m.start() + 1), end.value[1]
                break
            first = m.start() if first < 0 else first
            while len(held) > UNPACK_BYTES:
                window = bytes(held[:UNPACK_BYTES])
                outside = ~_IN_RUN[np.frombuffer(window, np.uint8)[::-1]]
                run = int(outside.argmax()) if outside.any() else 0
                if not run and not outside.any():
                    missed(first)
                yield first, window, True
                del held[: UNPACK_BYTES - max(run, min(_OVERLAP, UNPACK_BYTES // 2))]
        if short and more:
            missed(m.start())
        if read is not None and not short and at > m.start() + 1:
            read.append((m.start(), at))
    if held:
        yield first, bytes(held), False


def _of_bytes(data: bytes, source, high: int, more: bool, cut: set[tuple[int, int]]) -> Generator[Layer | Packed, None, bool]:
    """Some bytes as text, and what is packed in them; returns whether there is nothing else in them.

    ``source`` gives where (first, last) bytes begin and end in the original, or is the place where all begin.
    """
    low = lambda at: source if isinstance(source, int) else int(source(np.array([at]), np.array([at]))[0][0])
    read: list[tuple[int, int]] = []
    for at, window, goes_on in _windows(data, more, lambda at: cut.add((low(at), high)), read):
        yield Packed(window, low(at), high, goes_on)
    # What was unpacked is not text besides.
    if read:
        rest = bytearray(data)
        for start, end in read:
            rest[start:end] = b"\n" * (end - start)
        data = bytes(rest)
    text = _text(data) if not read or data.strip(b"\n") else None
    if text is not None and isinstance(source, int):
        yield Layer.whole(text, source, high)
    elif text is not None:
        first = np.cumsum([0, *(len(c.encode()) for c in text)])[:-1] if len(text) < len(data) else np.arange(len(text))
        yield Layer(text, *source(first, np.append(first[1:], len(data)) - 1))
    return bool(read) and not data.strip(b"\n")


_PERCENT = re.compile("%([0-9A-Fa-f]{2})")
_BACKSLASH = re.compile(r"""\\(?:[xX]([0-9A-Fa-f]{2})|u00([0-9A-Fa-f]{2})|([0-3]?[0-7]{1,2})|([abfnrtv\\'"]))""")
_CONTROL = dict(zip("abfnrtv\\'\"", "\a\b\f\n\r\t\v\\'\""))


def _escape(m: re.Match) -> str:
    if m.re is _BACKSLASH and m[4]:
        return _CONTROL[m[4]]
    return chr(int(m[3], 8) if m.re is _BACKSLASH and m[3] else int(next(g for g in m.groups() if g), 16))


_LINE = re.compile(r"[^\r\n]+")
#: What stands between parts of escaped bytes: ends of lines, and ends and beginnings of quoted literals.
_JOINTS = (
    re.compile(r"[ \t]*+\\?(?:\r\n|\r|\n)[ \t]*+(?:>[ \t]*+)*+"),
    re.compile(r"(?<!\\)[\"'][ \t]*+[+.\\]?[ \t]*+(?:\r\n|\r|\n)?[ \t]*+(?:>[ \t]*+)*+[+.]?[ \t]*+[bBrRuU]{0,2}[\"']"),
)


def _spelling(text: str, mark: str) -> Iterator[tuple[str, np.ndarray]]:
    """Lines that hold a mark, and stretches of them without their joints, with the place of each character and of the end."""
    stretch: list[re.Match] = []
    for line in [*_LINE.finditer(text), None] if mark in text else ():
        if line and mark in line[0]:
            yield line[0], np.arange(line.start(), line.end() + 1)
        follows = line and mark in line[0] and (not stretch or len(text[stretch[-1].end() : line.start()]) <= 2)
        if follows:
            stretch.append(line)
            continue
        if stretch:
            low, high = stretch[0].start(), stretch[-1].end()
            for joint in _JOINTS:
                ranges, at = [], low
                for m in joint.finditer(text, low, high):
                    ranges.append((at, m.start()))
                    at = m.end()
                if ranges:
                    ranges.append((at, high))
                    yield "".join(text[a:b] for a, b in ranges), np.concatenate([*(np.arange(a, b) for a, b in ranges), [high]])
        stretch = [line] if line and mark in line[0] else []


def _raw(layer: Layer, cut: set[tuple[int, int]]) -> Iterator[Packed]:
    """What is packed in the bytes that percent or backslash escapes spell beside other characters.

    Lines that hold escapes are read each by itself and, with those that follow on them, without the line
    ends, and without the quotes of adjoining literals, between them.
    """
    for escapes, mark in ((_PERCENT, "%"), (_BACKSLASH, "\\")):
        for text, origin in _spelling(layer.text, mark):
            spelled = escapes.sub(_escape, text)
            for said in {spelled, escapes.sub(_escape, text.replace("+", " ")) if mark == "%" else spelled}:
                data = said.encode("latin-1", "replace")
                if not _MAGIC.search(data):
                    continue
                width = np.ones(len(text) + 1, bool)
                for m in escapes.finditer(text):
                    width[m.start() + 1 : m.end()] = False
                places, last = origin[np.flatnonzero(width)], 0
                for m in _MAGIC.finditer(data):
                    if m.start() < last:
                        continue
                    last = _end(data, m.start())
                    low, high = layer.span(places[m.start()], places[last])
                    for _, window, goes_on in _windows(data[m.start() : last], False, lambda _, run=(low, high): cut.add(run)):
                        yield Packed(window, low, high, goes_on)


def _end(data: bytes, at: int) -> int:
    """Where packed data and the members right behind it end."""
    while m := _MAGIC.match(data, at):
        source = _unpack(data, at)
        while True:
            try:
                next(source)
            except StopIteration as end:
                at = end.value[0]
                break
    return at


#: A decoded layer that is no readable text is taken up if it holds a base kind's beginning or something to decode.
_MAY = re.compile(
    rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#[0-9xX]"
    rb"|\\[0-7]|[A-Za-z0-9+/_-]{16}|(?:[A-Za-z0-9+/_-]{4,}[ \t]*(?:\r?\n|\\n)[ \t]*){2}|(?:[\x20-\x7e\t\r\n]\x00{1,3}){7}"
)
_WIDE = re.compile("(?:[^\x00]\x00){7,}[^\x00]?|(?:[^\x00]\x00{3}){7,}[^\x00]?")


def _text(data: bytes) -> str | None:
    """Bytes as text: UTF-8, else a character for each byte; None if there is nothing to find in them."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1") if _MAY.search(data) else None
    return text if text and (all(c.isprintable() or c in "\t\r\n" for c in text) or _MAY.search(data)) else None


def _wide(layer: Layer) -> Iterator[Layer]:
    """A layer for each stretch of characters with one or three NULs between them."""
    if "\x00" in layer.text:
        for m in _WIDE.finditer(layer.text):
            places = m.start() + np.flatnonzero(np.frombuffer(m[0].encode("utf-32-le"), np.uint32))
            yield Layer(m[0].replace("\x00", ""), layer.starts[places], layer.ends[places])


def _run_bytes(run: str) -> bytes:
    body = run.replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _joined(text: str, start: int, end: int) -> tuple[str, list[tuple[int, int]]]:
    """The base64 characters of a run without its line ends and padding, and the ranges that they stand in."""
    ranges, at = [], start
    for m in _BREAK.finditer(text, start, end):
        ranges.append((at, m.start()))
        at = m.end()
    ranges.append((at, at + len(text[at:end].rstrip("="))))
    return "".join(text[a:b] for a, b in ranges), ranges


def _base64(layer: Layer, cut: set[tuple[int, int]]) -> Iterator[Layer | Packed]:
    """What each base64 run spells from each start in it."""
    for m in _BASE64.finditer(layer.text):
        run, ranges = _joined(layer.text, m.start(), m.end())
        for skip in range(4) if len(run) >= _LEAST else ():

            def source(first, last):
                # Byte i comes from the base64 characters that hold its bits; a character from all its bytes.
                places = np.concatenate([np.arange(a, b) for a, b in ranges])
                return layer.starts[places[skip + first * 8 // 6]], layer.ends[places[skip + (last * 8 + 7) // 6]]

            high = int(layer.ends[m.end() - 1])
            if (yield from _of_bytes(_run_bytes(run[skip:]), int(layer.starts[0]) if layer.flat else source, high, False, cut)):
                break


def _inner(layer: Layer, cut: set[tuple[int, int]]) -> Iterator[Layer | Packed]:
    for decoded in (_url, _unicode):
        if new := decoded(layer):
            yield new
    yield from _wide(layer)
    yield from _raw(layer, cut)
    yield from _base64(layer, cut)


def decoded_spans(text: str) -> tuple[set[tuple[int, int, int]], int, set[tuple[int, int]]]:
    """Spans found in decoded layers, the number of layers, and the runs that may not have been read to their end."""
    places = np.arange(len(text) + 1)
    root, cut = Layer(text, places[:-1], places[1:]), set()
    key = lambda said, low, high: (hashlib.sha256(said).digest(), low, high)
    seen = {key(text.encode("utf-8", "surrogatepass"), 0, len(text))}
    work: list[Iterator[Layer | Packed]] = [_inner(root, cut)]
    found: set[tuple[int, int, int]] = set()
    layers = 0
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
        elif isinstance(inner, Packed):
            if (own := key(b"packed" + inner.data, inner.low, inner.high)) not in seen:
                seen.add(own)
                work.append(_of_bytes(inner.data, inner.low, inner.high, inner.more, cut))
        elif inner.text:
            own = key(inner.text.encode("utf-8", "surrogatepass"), *inner.span(0, len(inner.text)))
            if own in seen:
                continue
            seen.add(own)
            layers += 1
            for start, kind, end in base_spans(inner.text):
                low, high = inner.span(start, end)
                found.add((low, kind, high))
            work.append(_inner(inner, cut))
    return found, layers, cut


def shown(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(text: str, decode: bool = True) -> tuple[list, list, int, int]:
    """Base spans, all spans, layers unwrapped and runs cut of one text."""
    base, spans, layers, cut = _scan(text, decode)
    return base, spans, layers, len(cut)


def _scan(text: str, decode: bool) -> tuple[list, list, int, set[tuple[int, int]]]:
    base = base_spans(text)
    if not decode:
        return base, base, 0, set()
    found, layers, cut = decoded_spans(text)
    added = {s for s in found if not any(k == s[1] and a <= s[0] and s[2] <= b for a, k, b in base)}
    return base, sorted({*base, *added}), layers, cut


_EMPTY = hashlib.sha256(b"").hexdigest()


def _prepare(column: pa.Array):
    """For each text whether anything can be found in it, and whether it may hold a layer."""
    plain = pc.match_substring_regex(column, f"{_MAY_ACCESS}|{_MAY_HEX}")
    plain = pc.or_(plain, pc.match_substring_regex(column, _MAY_ASSIGN))
    return plain.to_pylist(), pc.match_substring_regex(column, _MAY_DECODE).to_pylist()


def scan_texts(docs: DataFrame, *, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Secrets of every whole text, without a shuffle.

    Gives the keys with n_assign, n_access and n_hex (base spans), base_sha256 (digest of the base
    spans), spans (all spans), n_layers and n_cut.
    """

    def make():
        def run(column: pa.Array, _):
            rows = []
            for i, (plain, layered) in enumerate(zip(*_prepare(column))):
                if not plain and not layered:
                    rows.append((0, 0, 0, _EMPTY, "", 0, 0))
                    continue
                base, spans, layers, cut = scan(column[i].as_py(), layered)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), layers, cut))
            return list(zip(*rows)) if rows else [[]] * 7

        return run

    added = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_cut long"
    return add_columns(docs, keys, text, added, make)


def redact(docs: DataFrame, *, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """The rows with every found span of the text, and every run counted in n_cut, replaced by ``mask``; overlapping spans become one.

    All other columns, whatever their names, and texts without a secret (missing ones too) stay as they are.
    """

    def hidden(values: pa.Array) -> list:
        column, out = texts(values), values.to_pylist()
        for i, (plain, layered) in enumerate(zip(*_prepare(column))):
            if plain or layered:
                _, spans, _, cut = _scan(column[i].as_py(), layered)
                spans = [*spans, *((start, None, end) for start, end in cut)]
                if spans:
                    out[i] = masked(out[i], spans, mask)
        return out

    place = docs.columns.index(text)
    if not isinstance(docs.schema[place].dataType, T.StringType):
        named = [F.col(_quoted(c)) for c in docs.columns]
        docs = docs.select(*named[:place], named[place].cast("string").alias(text), *named[place + 1 :])

    def run(batches):
        for batch in batches:
            arrays = list(batch.columns)
            arrays[place] = pa.array(hidden(batch.column(place)), batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return map_rows(docs, run)


def masked(text: str, spans, mask: str) -> str:
    parts, at = [], 0
    for start, end in sorted((s, e) for s, _, e in spans):
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join(parts) + text[at:]
