"""Similarity join on word shingles: MinHash candidates, Bayesian pruning, exact verification.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more.
Words are what white space separates, in lower case; a text of fewer words has one shingle of all of
them.

1. Equal texts become one class, known by a digest.
2. Each class representative gets ``BANDS * ROWS`` MinHash values. Two that agree in a whole band meet
   in a bucket. Rows are spread by bucket; buckets of one member go before any signature moves.
3. In a bucket, values are compared ``STEP`` at a time. With a uniform prior, the similarity after m of n
   agreements is Beta(m+1, n-m+1); a pair goes as soon as its probability of reaching the threshold is
   below ``TOLERANCE``. What stays connects representatives into candidate groups.
4. Within a group every pair is compared once in blocks: again pruned step by step, over all values,
   then verified on the whole shingle sets. Blocks give sums and spanning links only, so a group of m
   near copies costs m rows of output, not m squared.
5. Connected components of the verified links are the near-duplicate classes.

Defined results: a missing text or one without words is in no class but its own. Repeated rows are
copies. A missing id never names a class that has another id. An empty table gives no rows. Only the
id and the text are read by ``join``; ``deduplicate`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.storage import staged
from tabloom.llm.batches import by_bytes
from tabloom.llm.groups import Union, blocks, components, pair_blocks, small

SHINGLE = 5
#: The threshold as a fraction of integers, which makes the comparison exact.
THRESHOLD = (4, 5)
BANDS, ROWS = 32, 6
VALUES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-5
#: Values that travel with bucket members; all of them travel to the verification.
FIRST_VALUES = 64
BUCKET_BLOCK, GROUP_BLOCK = 4096, 512
#: Text bytes hashed at a time in a task.
SLICE = 2 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@lru_cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20)
    return random.integers(1, 1 << 63, VALUES, np.uint64) * 2 + 1, random.integers(0, 1 << 63, VALUES, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, in order and with repetitions, and how many each text has."""
    parts = pc.utf8_split_whitespace(pc.utf8_lower(column))
    flat = pc.list_flatten(parts)
    text = np.repeat(np.arange(len(column)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.filter(pa.array(full)).dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False)
    hashed = pd.util.hash_array(words.astype(object), categorize=False) if len(words) else np.empty(0, np.uint64)
    word = hashed[coded.indices.to_numpy(zero_copy_only=False)]
    n = np.bincount(text[full], minlength=len(column))
    ends = np.cumsum(n)
    # One more word than there is stands behind the end, so that short texts have a window too.
    padded = np.concatenate([word, np.zeros(SHINGLE, np.uint64)])
    place = np.arange(len(word))
    left = np.repeat(ends, n) - place
    out = np.zeros(len(word), np.uint64)
    for i in range(SHINGLE):
        out = out * _M1 + np.where(left > i, padded[i : i + len(word)], np.uint64(0))
    starts = (left >= SHINGLE) | (place == np.repeat(ends - n, n))
    return _mixed(out[starts]), np.bincount(np.repeat(np.arange(len(n)), n)[starts], minlength=len(n))


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values, a row of 64-bit numbers for each text; texts without shingles have zeros."""
    a, b = _multipliers()
    out = np.zeros((len(counts), VALUES), np.uint64)
    have = np.flatnonzero(counts)
    if len(have):
        ends = np.cumsum(counts)
        # Some texts at a time, so that the numbers stay in the processor's cache.
        at = 0
        while at < len(have):
            base = ends[have[at]] - counts[have[at]]
            stop = max(at + 1, int(np.searchsorted(ends[have], base + 65_536, side="right")))
            some = have[at:stop]
            piece, starts = hashes[base : ends[some[-1]]], (ends[some] - counts[some] - base).astype(np.int64)
            for k in range(VALUES):
                out[some, k] = np.minimum.reduceat(piece * a[k] + b[k], starts)
            at = stop
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """A bucket number for each band of each text."""
    out = np.empty((len(values), BANDS), np.uint64)
    for i in range(BANDS):
        h = np.full(len(values), i + 1, np.uint64)
        for j in range(ROWS):
            h = _mixed(h * _M1 + values[:, i * ROWS + j])
        out[:, i] = h
    return out.view(np.int64)


@lru_cache
def least_matches(n: int, threshold: tuple[int, int] = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Agreements of n that a pair needs so that it may still reach the threshold.

    P(Beta(m+1, n-m+1) >= t) is P(Binomial(n+1, t) <= m).
    """
    t, total = threshold[0] / threshold[1], 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def plausible(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Places in ``others`` that may be similar to ``one``, after comparing values step by step."""
    left, agree = np.arange(len(others)), np.zeros(len(others), np.int64)
    for at in range(0, others.shape[1], STEP):
        agree += (others[left, at : at + STEP] == one[at : at + STEP]).sum(axis=1)
        stay = agree >= least_matches(min(at + STEP, others.shape[1]))
        left, agree = left[stay], agree[stay]
        if not len(left):
            break
    return left


def _signature_rows(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, width)


def sketch(docs: DataFrame) -> DataFrame:
    """(row, id, digest, bands, first) for docs (row, id, text): no bands for a text without words."""

    def run(batches):
        for part, column, _ in by_bytes(batches, "text", SLICE):
            hashes, counts = shingles(column)
            values = signatures(hashes, counts)
            first = (values[:, :FIRST_VALUES] >> np.uint64(48)).astype(np.uint16)
            number = np.where(counts > 0, BANDS, 0)
            offsets = np.concatenate([[0], np.cumsum(number)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    part.column(3),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands(values)[counts > 0].ravel())),
                    pa.array([r.tobytes() for r in first], pa.binary()),
                ],
                names=["row", "id", "digest", "bands", "first"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    source = docs.select("row", "id", F.col("text").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return source.mapInArrow(run, f"row long, id {kind}, digest string, bands array<long>, first binary")


def candidate_links(reps: DataFrame) -> DataFrame:
    """Spanning links (a, b) of representatives that may be similar, bucket by bucket."""
    member = reps.select("rep", F.explode("bands").alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    member = member.join(sizes, "bucket").join(reps.select("rep", "first"), "rep")

    def run(batches):
        for block in blocks(batches, ["bucket", "p", "q"]):
            rep, part = block["rep"].to_numpy(), block["part"].to_numpy()
            values = _signature_rows(block["first"].combine_chunks(), FIRST_VALUES)
            across = block["p"][0].as_py() != block["q"][0].as_py()
            a, b = spanning(values, part if across else None)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], names=["a", "b"])

    return pair_blocks(member, "bucket", "rep", "size", BUCKET_BLOCK).mapInArrow(run, "a long, b long")


def spanning(values: np.ndarray, part: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what may be similar, found by a search from member to member.

    A member reached is compared with those not reached yet, so near copies cost one pass. With ``part``
    only members of different parts are compared.
    """
    if len(values) == 2:
        hit = len(plausible(values[0], values[1:])) and (part is None or part[0] != part[1])
        return (np.array([0]), np.array([1])) if hit else (np.empty(0, np.int64),) * 2
    free, a, b = np.arange(len(values)), [], []
    while len(free):
        queue, free = [int(free[0])], free[1:]
        while queue and len(free):
            one = queue.pop()
            near = plausible(values[one], values[free])
            if part is not None:
                near = near[part[free[near]] != part[one]]
            if len(near):
                found = free[near]
                a.append(np.full(len(found), one))
                b.append(found)
                queue += found.tolist()
                free = np.delete(free, near)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def _sets(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])] if len(counts) else []


def with_sets(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """(rep, component, size, copies, values, set) of the wanted digests: whole signatures and shingle sets."""
    source = docs.select(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest"), F.col("text").cast("string"))
    source = source.join(small(wanted, rows), "digest").select("rep", "component", "size", "copies", "text")

    def run(batches):
        for part, column, _ in by_bytes(batches, "text", SLICE):
            # Copies in the same slice are taken once.
            _, once = np.unique(part.column(0).to_numpy(), return_index=True)
            part, column = part.take(pa.array(once)), column.take(pa.array(once))
            hashes, counts = shingles(column)
            values = (signatures(hashes, counts) >> np.uint64(48)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(i) for i in range(4)),
                    pa.array([r.tobytes() for r in values], pa.binary()),
                    pa.array([s.tobytes() for s in _sets(hashes, counts)], pa.binary()),
                ],
                names=["rep", "component", "size", "copies", "values", "set"],
            )

    made = source.mapInArrow(run, "rep long, component long, size long, copies long, values binary, set binary")
    return made.groupBy("rep").agg(*[F.first(c).alias(c) for c in ("component", "size", "copies", "values", "set")])


def verified(values: np.ndarray, sets: list[np.ndarray], part: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) of a block that reach the threshold: pruned, then counted exactly.

    With ``part`` only pairs of different parts are meant.
    """
    sizes = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(code.max() + 1, np.int64)
    a, b = [], []
    for i in range(len(sets) - 1):
        near = i + 1 + plausible(values[i], values[i + 1 :])
        if part is not None:
            near = near[part[near] != part[i]]
        # A set smaller than the threshold's share of the other cannot reach it.
        low, high = np.minimum(sizes[near], sizes[i]), np.maximum(sizes[near], sizes[i])
        near = near[low * THRESHOLD[1] >= high * THRESHOLD[0]]
        if not len(near):
            continue
        own = code[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        if 4 * sizes[near].sum() < len(code):
            shared = np.array([mark[code[starts[j] : starts[j] + sizes[j]]].sum() for j in near])
        else:
            shared = np.add.reduceat(mark[code], starts)[near]
        mark[own] = 0
        hit = near[shared * THRESHOLD[1] >= (sizes[near] + sizes[i] - shared) * THRESHOLD[0]]
        a.append(np.full(len(hit), i))
        b.append(hit)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def verify(members: DataFrame) -> DataFrame:
    """For each representative the linked documents in its blocks, and one link (rep, to) that spans them."""

    def run(batches):
        for block in blocks(batches, ["component", "p", "q"]):
            rep, copies, part = (block[c].to_numpy() for c in ("rep", "copies", "part"))
            sets = [np.frombuffer(s, np.uint64) for s in block["set"].to_pylist()]
            across = block["p"][0].as_py() != block["q"][0].as_py()
            values = _signature_rows(block["values"].combine_chunks(), VALUES)
            a, b = verified(values, sets, part if across else None)
            if not len(a):
                continue
            links = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
            classes = Union(len(rep))
            for i, j in zip(a.tolist(), b.tolist()):
                classes.join(i, j)
            used = np.flatnonzero(links)
            to = rep[[classes.find(i) for i in used.tolist()]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[used]), pa.array(to), pa.array(np.rint(links[used]).astype(np.int64))], names=["rep", "to", "links"]
            )

    return pair_blocks(members, "component", "rep", "size", GROUP_BLOCK).mapInArrow(run, "rep long, to long, links long")


def join_rows(docs: DataFrame) -> DataFrame:
    """For docs (row, id, text), with rows numbered once: row, id, class_id, n_links and kept.

    ``row`` must be stored with the docs, so that reading them again gives the same numbers.
    """
    sketched = staged(sketch(docs), "sketch")
    listed = sketched.where(F.size("bands") > 0)
    classes = listed.groupBy("digest").agg(
        F.min("row").alias("rep"), F.count("*").alias("copies"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("head")
    )
    classes = staged(classes, "classes")
    reps = listed.select(F.col("row").alias("rep"), "bands", "first").join(classes.select("rep"), "rep")
    groups = components(candidate_links(reps), "candidates")
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    members = groups.join(sizes, "component").withColumnRenamed("node", "rep")
    wanted = staged(members.join(classes.select("rep", "digest", "copies"), "rep"), "wanted")
    checked = staged(verify(with_sets(docs, wanted, wanted.count())), "verified")
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    final = components(checked.select(F.col("rep").alias("a"), F.col("to").alias("b")), "linked")
    classes = (
        classes.join(final.withColumnRenamed("node", "rep"), "rep", "left")
        .join(links, "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    heads = classes.groupBy("component").agg(F.min("head").alias("first"))
    named = classes.join(heads, "component").select("digest", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    rows = sketched.select("row", "id", "digest", (F.size("bands") > 0).alias("listed"))
    rows = rows.join(named, "digest", "left")
    inside = F.col("listed") & F.col("first").isNotNull()
    return rows.select(
        "row",
        "id",
        F.when(inside, F.col("first.id")).otherwise(F.col("id")).alias("class_id"),
        F.when(inside, F.col("links") + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(inside, F.col("first.row") == F.col("row")).otherwise(F.lit(True)).alias("kept"),
    )


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its key, class_id (smallest key of its class), n_links (other documents
    that it is linked to directly, copies included) and kept (the one document of its class that stays)."""
    numbered = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(text).alias("text")), "docs")
    return join_rows(numbered).select(F.col("id").alias(key), "class_id", "n_links", "kept")


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, of which one of each class stays.

    The rows that go are counted; a few are broadcast, many are joined by shuffle.
    """
    number = "~row"
    numbered = staged(docs.withColumn(number, F.monotonically_increasing_id()), "docs")
    decided = join_rows(numbered.select(F.col(number).alias("row"), F.col(key).alias("id"), F.col(text).alias("text")))
    gone = staged(decided.where(~F.col("kept")).select(F.col("row").alias(number)), "gone")
    return numbered.join(small(gone, gone.count()), number, "left_anti").drop(number)
