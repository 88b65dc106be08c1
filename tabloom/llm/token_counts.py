"""Token counts of whole texts by a sentence-piece model, in Arrow batches that return lengths only.

Slices of a batch hold about as many bytes each. Texts, above all long ones, are cut at safe
boundaries: a single space between two other characters. There the counts add up, because the model
puts a space mark before a text and before a word alike and none of its pieces has such a mark behind
another character; ``safe_to_cut`` checks both for a model, and without them texts are counted whole.

Defined results: a missing or empty text has 0 bytes and 0 tokens. Repeated rows give repeated results,
an empty table an empty one; columns other than the keys and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tabloom.llm.batches import add_columns

#: Texts with more bytes are handled in segments of about this size.
SEGMENT_BYTES = 4 << 20
#: Remembered counts in a task; beyond it the memory is emptied and filled again.
MEMORY = 300_000
MARK = "▁"
_SAFE = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")


def safe_to_cut(model) -> bool:
    """Whether no piece has a space mark behind another character, and text is taken as it is."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        return False
    # A dummy mark goes before a text, spaces are kept, and characters are not normalised.
    probe = "  a ééÅ  b "
    shown = "".join(model.encode(probe, out_type=str))
    spelled = re.sub(r"(?:<0x[0-9A-F]{2}>)+", lambda m: bytes.fromhex(re.sub(r"<0x|>", "", m[0])).decode(), shown)
    return spelled == (" " + probe).replace(" ", MARK)


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.safe = safe_to_cut(self.model)
        self.known: dict[str, int] = {}

    def _counted(self, parts: list[str]) -> np.ndarray:
        """Tokens of each distinct part."""
        known = self.known
        counts = np.fromiter((known.get(p, -1) for p in parts), np.int64, len(parts))
        new = np.flatnonzero(counts < 0).tolist()
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for i, ids in zip(some, self.model.encode([parts[i] for i in some], num_threads=1)):
                counts[i] = len(ids)
                if len(parts[i]) <= 64:
                    known[parts[i]] = len(ids)
        if len(known) > MEMORY:
            known.clear()
        return counts

    def _parts(self, column: pa.Array) -> pa.Array:
        """A list of parts for each text; together they have the tokens of the text."""
        if not self.safe:
            return pc.split_pattern(column, "\u0000\u0000never")
        plain = pc.invert(pc.match_substring_regex(column, f"  |^ | $|{MARK}|\\A\\z"))
        if pc.all(plain).as_py() or not len(column):
            return pc.split_pattern(column, " ")
        return pa.array([v.split(" ") if p else _SAFE.split(v) for v, p in zip(column.to_pylist(), plain.to_pylist())], pa.large_list(pa.large_string()))

    def count(self, column: pa.Array, size: np.ndarray) -> np.ndarray:
        """Tokens of each text of a slice."""
        if len(column) == 1 and size[0] > SEGMENT_BYTES and self.safe:
            return np.array([sum(int(self.count(s, np.zeros(1, np.int64))[0]) for s in segments(column[0].as_py()))])
        parts = self._parts(column)
        coded = pc.list_flatten(parts).dictionary_encode()
        each = self._counted(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        sums = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        return np.diff(sums[np.concatenate([[0], ends])])


def segments(text: str, length: int = SEGMENT_BYTES):
    """Cut a long text at safe boundaries, without the space of each cut."""
    start = 0
    while start < len(text):
        cut = _SAFE.search(text, start + length) if start + length < len(text) else None
        stop = cut.start() if cut else len(text)
        yield pa.array([text[start:stop]], pa.large_string())
        start = stop + 1


_loaded: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def count_tokens(
    docs: DataFrame, path: str, *, keys: Sequence[str] = ("doc_id",), text: str = "text", limit: int = 4096
) -> DataFrame:
    """The keys with n_bytes, n_tokens and over_limit (more than ``limit`` tokens), without a shuffle."""

    def make():
        own = counter(path)

        def run(column: pa.Array, size: np.ndarray):
            tokens = own.count(column, size)
            return [size, tokens, tokens > limit]

        return run

    return add_columns(docs, keys, text, "n_bytes long, n_tokens long, over_limit boolean", make)
