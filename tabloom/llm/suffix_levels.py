"""Removal of byte strings that occur earlier, by a logarithmic family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of smaller id,
or earlier in the same one. Strings are judged on the input and never cross documents.

**Sampled suffixes.** Of all suffixes those are indexed whose first ``COARSE`` bytes have the smallest
fingerprint of some string of ``LENGTH`` bytes around them, the leftmost of equal ones. Every such string
holds exactly one suffix that it chooses, found from its own bytes alone, so equal strings choose at equal
places and no match is lost. Neighbouring strings that choose the same suffix make a *piece*: about 30
strings in 130 bytes.

**The family.** Documents come in batches of rising ids, packed into units of a few megabytes. A batch gets
its suffix array: the sampled suffixes, a prefix once for each unit, in order of their prefixes. It is scanned
together with the arrays of all levels, merged in one order; prefixes met twice are where long matches
can be. Then it joins the family, and as long as two levels are equally large they are merged into one of
twice the size, so a family of n batches has at most log n levels.

**Matches.** Only pieces around repeated prefixes are compared. Equal pieces are repeated whole, but for
the first. Pieces that share a prefix and differ are cut into finer ones, by prefixes of ``FINE`` and then
of all ``LENGTH`` bytes, where a piece is a single string. Places are compared in each round only among
the distinct pieces of the round before, at the first place of each.

Hot passages: within a unit equal pieces are one row, sums and smallest places are combined in tasks before
anything moves, and no group is gathered. Texts move in units, packed, as often as places are asked for in
them (three times). Strings are told apart by two 64-bit fingerprints, of the prefix and of the whole.

Defined results: a missing text is empty. Repeated rows, and rows of one id, stand in the order of the scan;
the first keeps what they share. Rows without id come last. An id must be a whole number. Documents shorter
than ``LENGTH`` lose nothing. An empty table gives no rows. Only id and text are read. What is kept is bytes,
since a removal may end inside a character.
"""

from __future__ import annotations

from collections import defaultdict
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.functions.storage import remove, staged
from tabloom.llm.batches import _quoted

LENGTH, COARSE, FINE = 100, 40, 72
#: Text bytes of a unit; a longer text makes one of its own.
UNIT = 4 << 20
BATCHES = 4
#: Places hashed at a time: their arrays stay in a core's cache.
BLOCK = 1 << 15
_M = [np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_LAST_ID = (1 << 63) - 1


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A fingerprint of two fingerprints side by side."""
    x = b >> np.uint64(32)
    x ^= b
    x *= _M[1]
    x += a * _M[0]
    x ^= x >> np.uint64(29)
    x *= _M[2]
    x ^= x >> np.uint64(32)
    return x


def _fingerprints(data: np.ndarray, widths: set[int]) -> dict[int, np.ndarray]:
    """Fingerprints of the ``width`` bytes from every place, for widths of 8 and more."""
    raw = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).astype(np.uint64)
    now, size, out = _mixed(raw, raw), 8, {}
    while True:
        for w in widths:
            if size <= w < 2 * size:
                out[w] = now if w == size else _mixed(now[: len(now) - w + size], now[w - size :])
        if 2 * size > max(widths):
            return out
        now, size = _mixed(now[:-size], now[size:]), 2 * size


def pieces(data: np.ndarray, ends: np.ndarray, k: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(start, strings, prefix, whole) of every piece of texts that lie one after another.

    A piece stands for ``strings`` strings of ``length`` bytes, from ``start`` on, whose chosen suffix starts
    with ``k`` bytes of the fingerprint ``prefix``; ``whole`` is the fingerprint of all its bytes.
    """
    data = np.ascontiguousarray(data)
    count = len(data) - length + 1
    if count <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    fits = np.ones(len(data), bool)
    begin = 0
    for end in ends.tolist():
        fits[max(begin, end - length + 1) : end] = False
        begin = end
    window, found = length - k + 1, []
    low = np.uint64(127)
    for at in range(0, count, BLOCK):
        many = min(BLOCK, count - at)
        prints = _fingerprints(data[at : at + many + length - 1], {k, length})
        v, whole = prints[k][: many + window - 1], prints[length]
        # The smallest fingerprint of each window with, in its low bits, how far on it is.
        best, span = v & ~low, 1
        while 2 * span <= window:
            best = np.minimum(best[:-span], best[span:] + np.uint64(span))
            span *= 2
        if span < window:
            best = np.minimum(best[: span - window], best[window - span :] + np.uint64(window - span))
        own = np.arange(many) + (best & low).astype(np.int64)
        fit = fits[at : at + many]
        change = own[1:] != own[:-1]
        opens, closes = fit.copy(), fit.copy()
        opens[1:] &= change | ~fit[:-1]
        closes[:-1] &= change | ~fit[1:]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes)
        found.append((s + at, e + at, own[s] + at, v[own[s]], whole[s], whole[e]))
    s, e, own, prefix, first, last = (np.concatenate(x) for x in zip(*found))
    # Pieces that reach over blocks are put together again.
    new = np.ones(len(s), bool)
    new[1:] = (own[1:] != own[:-1]) | (s[1:] != e[:-1] + 1)
    i = np.flatnonzero(new)
    s, e, prefix, first = s[i], e[np.append(i[1:], len(new)) - 1] if len(i) else e, prefix[i], first[i]
    last = last[np.append(i[1:], len(new)) - 1] if len(i) else last
    n = e - s + 1
    return s, n, prefix, _mixed(first + n.astype(np.uint64) * _M[2], last)


def packed(docs: DataFrame, batches: int, *, key: str, text: str) -> DataFrame:
    """Units of documents of one batch each: their ids and rows in order, sizes, and texts compressed. Stored."""
    named = docs.select(
        F.col(_quoted(key)).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(_quoted(text)).cast("string").cast("binary").alias("raw")
    )
    shares = [i / batches for i in range(1, batches)]
    cuts = named.select(F.col("key").cast("double").alias("key")).na.drop().approxQuantile("key", shares, 0.001) if shares else []
    number = sum(((F.col("key") > c).cast("int") for c in cuts), F.lit(0))
    named = named.withColumn("batch", F.when(F.col("key").isNull(), batches - 1).otherwise(number))

    def run(parts):
        press = zstandard.ZstdCompressor(level=3)
        held, size = defaultdict(list), defaultdict(int)

        def unit(batch: int) -> pa.RecordBatch:
            rows = held.pop(batch)
            size.pop(batch)
            first = rows[0][1]
            rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            raw = press.compress(b"".join(r[2] for r in rows))
            keys, order, sizes = [r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows]
            return pa.RecordBatch.from_arrays(
                [pa.array([first]), pa.array([keys], pa.list_(pa.int64())), pa.array([order], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int32())), pa.array([raw], pa.binary()), pa.array([batch], pa.int32())],
                names=["unit", "keys", "rows", "sizes", "raw", "batch"],
            )

        for part in parts:
            for one, row, raw, batch in zip(*(part.column(i).to_pylist() for i in range(4))):
                raw = raw or b""
                if held[batch] and size[batch] + len(raw) > UNIT:
                    yield unit(batch)
                held[batch].append((one, row, raw))
                size[batch] += len(raw)
        for batch in [b for b in held if held[b]]:
            yield unit(batch)

    shape = "unit long, keys array<long>, rows array<long>, sizes array<int>, raw binary, batch int"
    whole = named.select(F.col("key").cast("long"), "row", "raw", "batch")
    return staged(whole.mapInArrow(run, shape), "units", parts="batch")


def _unit(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a unit, one after another, and where they end."""
    get = lambda name: batch.column(batch.schema.get_field_index(name))
    sizes = get("sizes").slice(i, 1).flatten().to_numpy().astype(np.int64)
    raw = zstandard.ZstdDecompressor().decompress(get("raw")[i].as_py(), max_output_size=max(1, int(sizes.sum())))
    return np.frombuffer(raw, np.uint8), np.cumsum(sizes)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Family:
    """Suffix arrays of batches, in levels of which no two are equally large."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    @staticmethod
    def array(units: DataFrame) -> DataFrame:
        """(prefix, unit) of the sampled suffixes of a batch, in order of prefixes. Stored."""

        def run(batches):
            for batch in batches:
                for i in range(len(batch)):
                    data, ends = _unit(batch, i)
                    prefix = np.unique(pieces(data, ends, COARSE)[2])
                    unit = np.full(len(prefix), batch.column(0)[i].as_py())
                    yield pa.RecordBatch.from_arrays([_long(prefix), pa.array(unit, pa.int64())], names=["prefix", "unit"])

        found = units.select("unit", "sizes", "raw").mapInArrow(run, "prefix long, unit long")
        return staged(found.repartition("prefix").sortWithinPartitions("prefix", "unit"), "suffixes")

    def scan(self, array: DataFrame) -> DataFrame:
        """(unit, prefix) of all suffixes, new and old, with a prefix that some new one shares with another. Stored."""
        runs = array.withColumn("new", F.lit(True))
        for _, level in self.levels:
            runs = runs.unionByName(level.withColumn("new", F.lit(False)))
        one = Window.partitionBy("prefix")
        met = runs.select("unit", "prefix", F.count("*").over(one).alias("n"), F.max("new").over(one).alias("new"))
        return staged(met.where("n > 1 and new").select("unit", "prefix"), "repeated")

    def add(self, array: DataFrame) -> None:
        self.levels.append((1, array))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            merged = staged(a.unionByName(b).repartition("prefix").sortWithinPartitions("prefix", "unit"), "level")
            remove(a, b)
            self.levels.append((2 * size, merged))

    def remove(self) -> None:
        remove(*(level for _, level in self.levels))


#: A piece: its prefix and whole, how many strings, and the place it starts at.
_PIECE = "prefix long, whole long, n int, unit long, key long, row long, start int"


def asked(units: DataFrame, repeated: DataFrame) -> DataFrame:
    """The distinct pieces of each unit around repeated prefixes, each at its first place there. Stored."""
    wanted = repeated.groupBy("unit").agg(F.collect_list("prefix").alias("wanted"))

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                data, ends = _unit(batch, i)
                s, n, prefix, whole = pieces(data, ends, COARSE)
                _, first = np.unique(whole, return_index=True)
                again, times = np.unique(prefix[first], return_counts=True)
                # Prefixes that other units have too, or that start different pieces within this one.
                listed = batch.column(5).slice(i, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                keep = np.sort(first[np.isin(prefix[first], np.union1d(listed, again[times > 1]))])
                doc = np.searchsorted(ends, s[keep], side="right")
                key = batch.column(1).slice(i, 1).flatten().fill_null(_LAST_ID).to_numpy()
                row = batch.column(2).slice(i, 1).flatten().to_numpy()
                begin = np.concatenate([[0], ends])[doc]
                yield pa.RecordBatch.from_arrays(
                    [_long(prefix[keep]), _long(whole[keep]), pa.array(n[keep], pa.int32()), pa.array(np.full(len(keep), batch.column(0)[i].as_py()), pa.int64()),
                     pa.array(key[doc]), pa.array(row[doc]), pa.array(s[keep] - begin, pa.int32())],
                    names=["prefix", "whole", "n", "unit", "key", "row", "start"],
                )

    rows = units.join(wanted, "unit", "left").select("unit", "keys", "rows", "sizes", "raw", "wanted")
    return staged(rows.mapInArrow(run, _PIECE), "pieces")


def _firsts(found: DataFrame, *carried: str) -> DataFrame:
    """Each distinct piece at its first place, with the number of its rows. Stored."""
    place = F.struct("key", "row", "start", "unit", "n", *carried)
    one = found.groupBy("prefix", "whole").agg(F.min(place).alias("at"), F.count("*").alias("times"))
    return staged(one.select("prefix", "whole", "times", "at.*"), "firsts")


def _unlike(firsts: DataFrame) -> DataFrame:
    """Of the distinct pieces those that share a prefix with another."""
    shared = firsts.groupBy("prefix").agg(F.count("*").alias("kinds")).where("kinds > 1").select("prefix")
    return firsts.join(shared, "prefix")


def cut_out(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of pieces, read from their units. Stored."""
    lists = wanted.groupBy("unit").agg(F.collect_list(F.struct("row", "start", "n")).alias("wanted"))

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                data, ends = _unit(batch, i)
                key = batch.column(1).slice(i, 1).flatten().fill_null(_LAST_ID).to_numpy()
                rows = batch.column(2).slice(i, 1).flatten().to_numpy()
                row, start, n = (c.to_numpy() for c in batch.column(5).slice(i, 1).flatten().flatten())
                order = np.argsort(rows)
                doc = order[np.searchsorted(rows[order], row)]
                begin = np.concatenate([[0], ends])[doc] + start
                raw = data.tobytes()
                texts = [raw[b : b + m + LENGTH - 1] for b, m in zip(begin.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), batch.column(0)[i].as_py()), pa.int64()), pa.array(key[doc]), pa.array(row), pa.array(start), pa.array(texts, pa.binary())],
                    names=["unit", "key", "row", "start", "raw"],
                )

    rows = units.join(lists, "unit").select("unit", "keys", "rows", "sizes", "raw", "wanted")
    return staged(rows.mapInArrow(run, "unit long, key long, row long, start int, raw binary"), "cut-out")


def finer(texts: DataFrame, k: int) -> DataFrame:
    """Pieces of texts by prefixes of ``k`` bytes, with their bytes unless each is a single string. Stored."""
    single = k == LENGTH

    def run(batches):
        for batch in batches:
            raw = batch.column(4).to_pylist()
            ends = np.cumsum([len(r) for r in raw])
            data = np.frombuffer(b"".join(raw), np.uint8)
            s, n, prefix, whole = pieces(data, ends, k)
            doc = np.searchsorted(ends, s, side="right")
            unit, key, row, start = (batch.column(c).to_numpy()[doc] for c in range(4))
            inside = s - np.concatenate([[0], ends])[doc]
            own = [_long(prefix), _long(whole), pa.array(n, pa.int32()), pa.array(unit), pa.array(key), pa.array(row), pa.array(start + inside, pa.int32())]
            if not single:
                own.append(pa.array([raw[d][a : a + m + LENGTH - 1] for d, a, m in zip(doc.tolist(), inside.tolist(), n.tolist())], pa.binary()))
            yield pa.RecordBatch.from_arrays(own, names=["prefix", "whole", "n", "unit", "key", "row", "start", "raw"][: len(own)])

    rows = texts.select("unit", "key", "row", "start", "raw")
    return staged(rows.mapInArrow(run, _PIECE + ("" if single else ", raw binary")), "finer")


def _later(found: DataFrame, firsts: DataFrame) -> DataFrame:
    """(unit, row, start, n) of pieces that are not the first of their kind."""
    one = firsts.where("times > 1").select("prefix", "whole", F.struct("key", "row", "start").alias("first"))
    return found.join(one, ["prefix", "whole"]).where(F.struct("key", "row", "start") != F.col("first")).select("unit", "row", "start", "n")


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, the shuffle files of a query go as soon as its result is stored, not when memory is next tidied."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def repeats(units: DataFrame, batches: int) -> tuple[DataFrame, DataFrame]:
    """(unit, whole) of pieces repeated from another unit, and (unit, row, start, n) of single runs of strings."""
    family, repeated = Family(), []
    for batch in range(batches):
        array = family.array(units.where(F.col("batch") == batch))
        repeated.append(family.scan(array))
        family.add(array)
    family.remove()
    every = repeated[0]
    for more in repeated[1:]:
        every = every.unionByName(more)
    found = asked(units, every)
    remove(*repeated)
    firsts = _firsts(found)
    elsewhere = found.join(firsts.where("times > 1").select("prefix", "whole", F.col("unit").alias("home")), ["prefix", "whole"])
    elsewhere = staged(elsewhere.where("unit <> home").select("unit", "whole"), "elsewhere")
    texts = cut_out(units, _unlike(firsts).select("unit", "row", "start", "n"))
    remove(found, firsts)
    later = []
    for k in (FINE, LENGTH):
        found = finer(texts, k)
        remove(texts)
        firsts = _firsts(found, *(["raw"] if k < LENGTH else []))
        later.append(staged(_later(found, firsts), "later"))
        if k < LENGTH:
            texts = staged(_unlike(firsts).select("unit", "key", "row", "start", "raw"), "cut-out")
        remove(found, firsts)
    return elsewhere, later[0].unionByName(later[1])


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """For each document its key, n_bytes, the spans removed (bytes, end exclusive) and the bytes kept."""
    with shuffles_dropped(docs.sparkSession):
        units = packed(docs, batches, key=key, text=text)
        elsewhere, later = repeats(units, batches)
    whole = elsewhere.groupBy("unit").agg(F.collect_list("whole").alias("whole"))
    single = later.groupBy("unit").agg(F.collect_list(F.struct("row", "start", "n")).alias("single"))
    rows = units.join(whole, "unit", "left").join(single, "unit", "left")

    def run(parts):
        for batch in parts:
            for i in range(len(batch)):
                data, ends = _unit(batch, i)
                begins = np.concatenate([[0], ends])[:-1]
                s, n, _, kind = pieces(data, ends, COARSE)
                _, first = np.unique(kind, return_index=True)
                again = np.ones(len(s), bool)
                again[first] = False
                again |= np.isin(kind, batch.column(5).slice(i, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                s, n = s[again], n[again]
                listed = batch.column(6).slice(i, 1).flatten()
                if len(listed):
                    row, start, more = (c.to_numpy() for c in listed.flatten())
                    order = np.argsort(rows_ := batch.column(2).slice(i, 1).flatten().to_numpy())
                    s = np.concatenate([s, begins[order[np.searchsorted(rows_[order], row)]] + start])
                    n = np.concatenate([n, more])
                change = np.zeros(len(data) + 1, np.int32)
                np.add.at(change, s, 1)
                np.add.at(change, s + n + LENGTH - 1, -1)
                gone = np.cumsum(change)[:-1] > 0
                edge = np.zeros(len(data) + 1, bool)
                edge[1:-1] = gone[1:] != gone[:-1]
                edge[ends] = edge[begins] = True
                edges = np.flatnonzero(edge)
                lost = gone[edges[:-1]] if len(edges) > 1 else np.zeros(0, bool)
                span = np.stack([edges[:-1][lost], edges[1:][lost]], axis=1) if lost.any() else np.zeros((0, 2), np.int64)
                at = np.searchsorted(span[:, 0], np.append(begins, len(data)))
                raw, spans, kept = data.tobytes(), [], []
                for d, (b, e) in enumerate(zip(begins.tolist(), ends.tolist())):
                    own = span[at[d] : at[d + 1]].tolist()
                    spans.append([{"start": x - b, "end": y - b} for x, y in own])
                    stops = [b, *(p for o in own for p in o), e]
                    kept.append(b"".join(raw[x:y] for x, y in zip(stops[::2], stops[1::2])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(i, 1).flatten(), pa.array(ends - begins), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                    names=["key", "n_bytes", "spans", "kept"],
                )

    rows = rows.select("unit", "keys", "rows", "sizes", "raw", "whole", "single")
    out = rows.mapInArrow(run, "key long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    return out.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "n_bytes", "spans", "kept")


def summary(removed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of what ``deduplicate`` gives."""
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return removed.select(
        key, "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


#: The same by listing every string. Texts are compared as hexadecimal digits, two a byte.
SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
  SELECT r, b, substr(h, 500 * b + 1, {500 + 2 * LENGTH - 2}) AS x FROM d, range(0, length(h) // 500 + 1) AS t(b)
), w AS (
  SELECT r, 250 * b + i AS i, md5_number(substr(x, 2 * i + 1, {2 * LENGTH})) AS s
  FROM blocks, range(0, least(250, length(x) // 2 - {LENGTH - 1})) AS t(i)
), later AS (
  SELECT r, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY r, i) > 1
), marked AS (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS opens FROM later
), numbered AS (
  SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS span FROM marked
), spans AS (
  SELECT r, min(i) AS a, max(i) + {LENGTH} AS b FROM numbered GROUP BY r, span
), before AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM spans
), kept AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS x
  FROM before JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(x, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
