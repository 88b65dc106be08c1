"""Brown's class-based bigram model: words in classes found by exchange, smoothed log probabilities of texts.

``p(w | v) = p(class(w) | class(v)) * p(item(w) | class(w)) * p(w | item(w))``. The ``CORE`` most
frequent words are items of their own. Every other word belongs to the item of its ending, one of
``ENDINGS`` groups by a checksum of its last four bytes (unlike endings meet in a group), so every word, seen or not, has an item, and an item has one class. The last
factor is 1 for core words; in a group it is the word's share after absolute discounting, and what is
discounted is the share of the words never seen there. The factors of each step add up to 1.

Learning, on all training texts:

1. words are counted by a shuffle (whole vocabulary, stored);
2. each text is written as item numbers, two bytes for each token;
3. exchange: for all items at once, the counts of the classes before and after them are summed over the
   corpus, and each item moves to the class that raises the class bigram likelihood most. In later
   rounds halves of the items move in turn, so that neighbours do not swap places for ever. The counts
   of a round are one row for each item, whatever the size of the corpus;
4. class transitions are smoothed towards the share of each class, emissions by a small constant.

Scoring looks up frequent words (at most ``LOOKUP``, found from a histogram of counts, each of at most
64 bytes) in a broadcast list, and joins all other tokens to the stored vocabulary. The list only
decides which way a count is found, not which.

Defined results: a missing or empty text has one token, its end. A row without id is a training row.
Repeated rows count as often as they occur and are scored each. Without training texts every word is
unseen. An empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.storage import staged
from tabloom.llm.batches import by_bytes

LOOKUP = 200_000
LOOKUP_BYTES = 64
CORE = 24_575
ENDINGS = 8_192
END = CORE + ENDINGS
ITEMS = END + 1
CLASSES = 48
ROUNDS = 5
DISCOUNT = 0.5
_SLICE = 4 << 20


def tokens(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of the texts, capitals A-Z made small, and the number of words of each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column))
    flat = pc.list_flatten(parts)
    full = pc.greater(pc.binary_length(flat), 0)
    text = np.repeat(np.arange(len(column)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    mask = full.to_numpy(zero_copy_only=False)
    return flat.filter(full), np.bincount(text[mask], minlength=len(column))


def ending(word: str, groups: int = ENDINGS) -> int:
    return zlib.crc32(word.encode()[-4:]) % groups


def _ending_column(word: str = "word", groups: int = ENDINGS):
    raw = F.col(word).cast("binary")
    tail = F.when(F.octet_length(raw) > 4, F.substring(raw, -4, 4)).otherwise(raw)
    return (F.crc32(tail) % groups).cast("int")


def count_words(train: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over whole texts: counted in each slice, summed by a shuffle, stored."""

    def run(batches):
        for _, column, _ in by_bytes(batches, text, 2 * _SLICE):
            counted = tokens(column)[0].value_counts()
            yield pa.RecordBatch.from_arrays(
                [counted.field("values").cast(pa.string()), counted.field("counts")], names=["word", "n"]
            )

    counted = train.select(text).mapInArrow(run, "word string, n long")
    return staged(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")


@dataclass
class Lookup:
    """Frequent words with their counts, most frequent first, and what each group holds beside core words."""

    words: pa.Array
    counts: np.ndarray
    group_tokens: np.ndarray
    group_words: np.ndarray
    least: int

    def items(self) -> np.ndarray:
        rest = [CORE + ending(w) for w in self.words[CORE:].to_pylist()]
        return np.concatenate([np.arange(min(CORE, len(self.words))), np.array(rest, np.int64)]).astype(np.int64)

    def shares(self) -> np.ndarray:
        """log10 of each word's share of its item."""
        item = self.items()
        held = np.maximum(self.group_tokens[np.maximum(item - CORE, 0)], 1)
        return np.where(item < CORE, 0.0, np.log10((self.counts - DISCOUNT) / held))


def frequent(vocabulary: DataFrame, most: int = LOOKUP) -> tuple[pa.Array, np.ndarray, int]:
    """The words that occur at least so often that no more than ``most`` do, and that limit."""
    bins = F.floor(F.log2("n") * 8).cast("int")
    short = vocabulary.where(F.octet_length("word") <= LOOKUP_BYTES)
    sizes = {r["b"]: r["count"] for r in short.groupBy(bins.alias("b")).count().collect()}
    first, have = max(sizes, default=0) + 1, 0
    for b in sorted(sizes, reverse=True):
        if have + sizes[b] > most:
            break
        first, have = b, have + sizes[b]
    rows = short.where(bins >= first).select("word", "n").toArrow()
    word, n = rows["word"].to_pylist(), rows["n"].to_pylist()
    order = sorted(range(len(word)), key=lambda i: (-n[i], word[i]))
    return pa.array([word[i] for i in order], pa.large_string()), np.array([n[i] for i in order], np.int64), first


def make_lookup(vocabulary: DataFrame) -> Lookup:
    words, counts, least = frequent(vocabulary)
    sums = vocabulary.groupBy(_ending_column().alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("w")).collect()
    tokens_, types = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for g, n, w in sums:
        tokens_[g], types[g] = n, w
    core = [ending(w) for w in words[:CORE].to_pylist()]
    np.subtract.at(tokens_, core, counts[:CORE])
    np.subtract.at(types, core, 1)
    return Lookup(words, counts, tokens_, types, least)


def sums_by_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, each text added up by itself."""
    out, starts = np.zeros(len(ends)), np.concatenate([[0], ends[:-1]])
    full = np.flatnonzero(ends > starts)
    if len(full):
        out[full] = np.add.reduceat(values, starts[full])
    return out


def encode(rows: DataFrame, key: str, text: str, lookup: Lookup, end_count: int, total: int) -> DataFrame:
    """Each text as item numbers, with the sums its looked-up tokens give, and its other words; stored.

    ``total`` is what a count and one are divided by for the base score.
    """
    shared = rows.sparkSession.sparkContext.broadcast((lookup, lookup.items(), lookup.shares()))

    def run(batches):
        known, items, shares = shared.value
        logs = np.log10((known.counts + 1.0) / total)
        for part, column, _ in by_bytes(batches, "~text", _SLICE):
            flat, lengths = tokens(column)
            coded = flat.dictionary_encode()
            words = coded.dictionary
            place = pc.fill_null(pc.index_in(words, value_set=known.words), -1).to_numpy(zero_copy_only=False)
            missing = np.flatnonzero(place < 0)
            item = np.where(place >= 0, items[place] if len(items) else 0, 0)
            item[missing] = [CORE + ending(w) for w in words.take(pa.array(missing)).to_pylist()]
            code = coded.indices.to_numpy(zero_copy_only=False)
            found, ends = place >= 0, np.cumsum(lengths)
            log = np.where(found, logs[place] if len(logs) else 0, 0)
            share = np.where(found, shares[place] if len(shares) else 0, 0)
            sums = [sums_by_text(value[code], ends) for value in (found.astype(float), log, share)]
            # Item numbers of each text, then its end.
            numbers = np.insert(item[code], ends, END).astype(np.uint16)
            offsets = np.concatenate([[0], 2 * (ends + np.arange(1, len(ends) + 1))]).astype(np.int32)
            rare = ~found[code]
            rare_ends = np.concatenate([[0], np.cumsum(rare)])[np.concatenate([[0], ends])].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    part.column(2),
                    pa.array(lengths + 1),
                    pa.array(np.rint(sums[0]).astype(np.int64) + (end_count > 0)),
                    pa.array(sums[1] + np.log10((end_count + 1.0) / total)),
                    pa.array(sums[2]),
                    pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(numbers)]),
                    pa.ListArray.from_arrays(pa.array(rare_ends), flat.filter(pa.array(rare)).cast(pa.string())),
                ],
                names=["row", "key", "held_out", "n_tokens", "known", "logs", "shares", "items", "rare"],
            )

    source = rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), "held_out", F.col(text).cast("string").alias("~text")
    )
    kind = source.schema["key"].dataType.simpleString()
    schema = (
        f"row long, key {kind}, held_out boolean, n_tokens long, known long, logs double, shares double,"
        " items binary, rare array<string>"
    )
    return staged(source.mapInArrow(run, schema), "items")


def _chunks(batches, column: int = 0, size: int = 1_000_000):
    """Item numbers of whole texts, some millions at a time."""
    for batch in batches:
        values = batch.column(column).to_pylist()
        at = 0
        while at < len(values):
            stop, have = at, 0
            while stop < len(values) and (have == 0 or have + len(values[stop]) // 2 <= size):
                have += len(values[stop]) // 2
                stop += 1
            yield batch.slice(at, stop - at), np.frombuffer(b"".join(values[at:stop]), np.uint16).astype(np.int64)
            at = stop


def before(items: np.ndarray) -> np.ndarray:
    """The item before each one; a text begins after an end."""
    return np.concatenate([[END], items[:-1]])


def class_counts(encoded: DataFrame, classes: np.ndarray) -> DataFrame:
    """For each item the counts of the class before it (b columns) and after it (a columns); stored.

    Rows with a negative item hold the sums of a class, of which -1 is the first.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(classes.astype(np.int64))
    names = ["item"] + [f"b{c}" for c in range(CLASSES)] + [f"a{c}" for c in range(CLASSES)]

    def run(batches):
        own = shared.value
        counts = np.zeros((2, ITEMS * CLASSES), np.int64)
        for _, items in _chunks(batches):
            last = before(items)
            counts[0] += np.bincount(items * CLASSES + own[last], minlength=ITEMS * CLASSES)
            counts[1] += np.bincount(last * CLASSES + own[items], minlength=ITEMS * CLASSES)
        both = np.concatenate([counts[0].reshape(ITEMS, CLASSES), counts[1].reshape(ITEMS, CLASSES)], axis=1)
        sums = np.zeros((CLASSES, 2 * CLASSES), np.int64)
        np.add.at(sums, own, both)
        used = np.flatnonzero(both.any(axis=1))
        item = np.concatenate([used, -1 - np.arange(CLASSES)])
        table = np.concatenate([both[used], sums])
        yield pa.RecordBatch.from_arrays([pa.array(item), *(pa.array(table[:, i]) for i in range(2 * CLASSES))], names=names)

    schema = ", ".join(f"{n} long" for n in names)
    counted = encoded.where(~F.col("held_out")).select("items").mapInArrow(run, schema)
    return staged(counted.groupBy("item").agg(*[F.sum(n).alias(n) for n in names[1:]]), "classes")


def transitions(counts: DataFrame) -> np.ndarray:
    """Class bigram counts (before, after), from the few rows of class sums."""
    rows = counts.where("item < 0").select("item", *[f"b{c}" for c in range(CLASSES)]).collect()
    table = np.zeros((CLASSES, CLASSES))
    for r in rows:
        table[:, -1 - r[0]] = r[1:]
    return table


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def gains(before_: np.ndarray, after: np.ndarray, own: int, table: np.ndarray) -> np.ndarray:
    """Change of the class bigram log likelihood if an item moves from its class to each class."""
    rows, columns = table.sum(axis=1), table.sum(axis=0)
    n_after, n_before = after.sum(), before_.sum()
    base = table.copy()
    base[:, own] = np.maximum(base[:, own] - before_, 0)
    base[own, :] = np.maximum(base[own, :] - after, 0)
    rows, columns = rows.copy(), columns.copy()
    rows[own] -= n_after
    columns[own] -= n_before
    rows, columns = np.maximum(rows, 0), np.maximum(columns, 0)
    entering = (_xlogx(base + before_[:, None]) - _xlogx(base)).sum(axis=0)
    leaving = (_xlogx(base + after[None, :]) - _xlogx(base)).sum(axis=1)
    # The cell of the class with itself takes both counts at once.
    own_cell, b, a = np.diag(base), before_, after
    both = _xlogx(own_cell + b + a) - _xlogx(own_cell + b) - _xlogx(own_cell + a) + _xlogx(own_cell)
    total = entering + leaving + both - _xlogx(rows + n_after) + _xlogx(rows) - _xlogx(columns + n_before) + _xlogx(columns)
    return total - total[own]


def moves(counts: DataFrame, classes: np.ndarray, table: np.ndarray, half: int | None) -> dict[int, int]:
    """Items that gain by moving, with their new class: at most one entry for each item."""
    shared = counts.sparkSession.sparkContext.broadcast((classes, table))

    def run(batches):
        own, sums = shared.value
        for batch in batches:
            items = batch.column(0).to_numpy()
            data = np.stack([batch.column(i).to_numpy() for i in range(1, 2 * CLASSES + 1)], axis=1).astype(float)
            out = []
            for item, row in zip(items.tolist(), data):
                gain = gains(row[:CLASSES], row[CLASSES:], int(own[item]), sums)
                gain[CLASSES - 1] = -np.inf
                best = int(gain.argmax())
                if gain[best] > 1e-6:
                    out.append((item, best))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*out)], names=["item", "class"])

    free = counts.where((F.col("item") >= 0) & (F.col("item") != END))
    if half is not None:
        free = free.where(F.pmod(F.hash("item"), F.lit(2)) == half)
    return {r[0]: r[1] for r in free.mapInArrow(run, "item int, class int").collect()}


def exchange(encoded: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Classes of all items, class bigram counts, and the item counts of the last round.

    At first the most frequent words have a class each and all other items share one. The end of a text
    keeps the last class for itself.
    """
    classes = np.minimum(np.arange(ITEMS), CLASSES - 2)
    classes[END] = CLASSES - 1
    for step in range(rounds):
        counts = class_counts(encoded, classes)
        for item, to in moves(counts, classes, transitions(counts), None if step < 2 else step % 2).items():
            classes[item] = to
    counts = class_counts(encoded, classes)
    return classes, transitions(counts), counts


@dataclass
class ClassModel:
    """log10 probabilities: of a class after a class, and of an item in its class."""

    classes: np.ndarray
    after: np.ndarray
    item: np.ndarray

    @classmethod
    def of(cls, classes: np.ndarray, table: np.ndarray, item_counts: np.ndarray) -> ClassModel:
        share = (table.sum(axis=0) + 1) / (table.sum() + CLASSES)
        after = (table + CLASSES * share[None, :]) / (table.sum(axis=1, keepdims=True) + CLASSES)
        held = np.bincount(classes, item_counts + 0.1, CLASSES)
        return cls(classes, np.log10(after), np.log10((item_counts + 0.1) / held[classes]))

    def score(self, items: np.ndarray) -> np.ndarray:
        """log10 probability of each item after the one before it."""
        return self.after[self.classes[before(items)], self.classes[items]] + self.item[items]


def _item_counts(counts: DataFrame) -> np.ndarray:
    """Occurrences of each item; one number for each of a fixed number of items."""
    total = sum((F.col(f"b{c}") for c in range(1, CLASSES)), F.col("b0"))
    out = np.zeros(ITEMS)
    for item, n in counts.where("item >= 0").select("item", total.alias("n")).collect():
        out[item] = n
    return out


def score_items(encoded: DataFrame, model: ClassModel) -> DataFrame:
    """The encoded rows without words, with ``classed``: the class model's log10 of their items."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, items in _chunks(batches, 7):
            lengths = part.column(3).to_numpy()
            classed = sums_by_text(shared.value.score(items), np.cumsum(lengths))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(7)), pa.array(classed)],
                names=["row", "key", "held_out", "n_tokens", "known", "logs", "shares", "classed"],
            )

    kind = encoded.schema["key"].dataType.simpleString()
    schema = f"row long, key {kind}, held_out boolean, n_tokens long, known long, logs double, shares double, classed double"
    columns = ["row", "key", "held_out", "n_tokens", "known", "logs", "shares", "items"]
    return encoded.select(*columns).mapInArrow(run, schema)


def rare_sums(encoded: DataFrame, vocabulary: DataFrame, lookup: Lookup, total: int) -> DataFrame:
    """For each row with words outside the lookup: how many are known, and the sums of their logs and shares."""
    groups = encoded.sparkSession.createDataFrame(
        [(g, float(n), float(w)) for g, (n, w) in enumerate(zip(lookup.group_tokens, lookup.group_words))],
        "g int, held double, words double",
    ).coalesce(1)
    listed = (F.octet_length("word") <= LOOKUP_BYTES) & (F.floor(F.log2("n") * 8).cast("int") >= lookup.least)
    rest = vocabulary.where(~listed)
    words = encoded.select("row", F.explode("rare").alias("word"))
    found = words.join(rest, "word", "left").withColumn("g", _ending_column())
    found = found.join(F.broadcast(groups), "g")
    share = F.when(F.col("n").isNotNull(), F.log10((F.col("n") - DISCOUNT) / F.col("held"))).when(
        F.col("held") > 0, F.log10(DISCOUNT * F.col("words") / F.col("held"))
    )
    return found.groupBy("row").agg(
        F.count("n").alias("rare_known"),
        F.sum(F.log10((F.coalesce("n", F.lit(0)) + 1.0) / total)).alias("rare_logs"),
        F.sum(F.coalesce(share, F.lit(0.0))).alias("rare_shares"),
    )


def score_texts(docs: DataFrame, held_out, *, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Learn from the rows where ``held_out`` is not true and score all rows.

    Gives the key with held_out, n_tokens, n_known, train_tokens, base_score (unigrams, one added to each
    count), score (this model) and perplexity (of this model, per token).
    """
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    train = rows.where(~F.col("held_out"))
    vocabulary = count_words(train)
    words, types = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    total, types = words + ends, types + (ends > 0)
    lookup = make_lookup(vocabulary)
    divisor = total + types + 1
    encoded = encode(rows, key, "text", lookup, ends, divisor)
    classes, table, counts = exchange(encoded, rounds)
    model = ClassModel.of(classes, table, _item_counts(counts))
    joined = score_items(encoded, model).join(rare_sums(encoded, vocabulary, lookup, divisor), "row", "left")
    rare = {c: F.coalesce(f"rare_{c}", F.lit(0)) for c in ("known", "logs", "shares")}
    score = F.col("classed") + F.col("shares") + rare["shares"]
    return joined.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("known") + rare["known"]).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + rare["logs"]).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
