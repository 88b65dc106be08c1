"""Byte-level BPE by tree reduction: encode halves, join neighbours, concatenate to decode.

Each match of the splitting pattern is a piece. A piece longer than a leaf is halved; the encodings of
the halves are joined by encoding anew a window around the seam, which grows until the tokens outside
are known to stay.

Why the window may stop: a token sequence is the encoding of its bytes exactly when every two
neighbours are the encoding of theirs together, as a merge across a seam depends on the two tokens
beside it alone (this needs ranks in which every token is itself reachable by merges, as trained
vocabularies have). Left of the window, right of it and inside it all neighbours agree already, so only
the two seams are tested.

Defined results: a missing or empty text has no tokens, and its digests are those of no bytes. Repeated
rows give repeated results, an empty table an empty one. Only the key and the text column are read, so
other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from tabloom.llm.batches import add_columns

#: Bytes up to which a piece is merged directly; longer ones are halved.
LEAF_BYTES = 32
#: Remembered encodings in a task; beyond it the memory is emptied and filled again.
MEMORY = 200_000
_NEVER = 1 << 60
_ENDS_IN_SPACE_RUN = re.compile(r" (?=\s|\Z)")
_WORD_START = re.compile(r" (?=\S)")


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        # White space as the Unicode property, which leaves out the four separators U+001C to U+001F.
        self.split = regex.compile(pattern.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.stays: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.words: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        """Ranks from a file of lines, each a token in base64 and its rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}, pattern)

    def merged(self, text: bytes) -> list[int]:
        """Merge by rank, leftmost first among equals, until no two neighbours can merge."""
        ids, pairs = [self.byte[b] for b in text], self.pairs
        if len(ids) > 64:
            return self._merged_long(ids)
        ranks = [pairs.get(a << 32 | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [best]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = pairs.get(best << 32 | ids[at + 1], _NEVER)
            if at:
                ranks[at - 1] = pairs.get(ids[at - 1] << 32 | best, _NEVER)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of merges and links to neighbours."""
        pairs, end = self.pairs, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := pairs.get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at, a, b = heapq.heappop(heap)
            nxt = after[at]
            if ids[at] != a or nxt == end or ids[nxt] != b:
                continue
            ids[at], ids[nxt] = rank, -1
            after[at] = far = after[nxt]
            if far != end:
                before[far] = at
                if (r := pairs.get(rank << 32 | ids[far])) is not None:
                    heapq.heappush(heap, (r, at, rank, ids[far]))
            if (near := before[at]) >= 0 and (r := pairs.get(ids[near] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, near, ids[near], rank))
        return [i for i in ids if i >= 0]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes."""
        key = left << 32 | right
        known = self.stays.get(key)
        if known is None:
            if len(self.stays) >= MEMORY:
                self.stays.clear()
            known = self.stays[key] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two texts together, from the encoding of each."""
        if not left or not right:
            return left or right
        tokens, i, j = self.tokens, 1, 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merged(b"".join(tokens[t] for t in left[len(left) - i :] + right[:j]))
            left_stays = i == len(left) or self.neighbours(left[-i - 1], window[0])
            right_stays = j == len(right) or self.neighbours(window[-1], right[j])
            if left_stays and right_stays:
                return left[: len(left) - i] + window + right[j:]
            i, j = i * (1 if left_stays else 2), j * (1 if right_stays else 2)

    def reduced(self, text: bytes, leaf: int = LEAF_BYTES) -> list[int]:
        if len(text) <= leaf:
            return self.merged(text)
        half = len(text) // 2
        return self.joined(self.reduced(text[:half], leaf), self.reduced(text[half:], leaf))

    def _piece(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            ids = [whole] if whole is not None else self.reduced(raw)
            if len(piece) <= LEAF_BYTES:
                if len(self.pieces) >= MEMORY:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def _ids(self, text: str) -> bytes:
        ids = array("I")
        for piece in self.split(text):
            ids.extend(self._piece(piece))
        return ids.tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word after its space."""
        found = self._ids(" " + word)
        if len(word) <= LEAF_BYTES:
            if len(self.words) >= MEMORY:
                self.words.clear()
            self.words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids, each as a little-endian unsigned 32-bit integer.

        A space before a visible character always begins a piece, so words are encoded apart. Where a
        space stands before other white space, only those safe spaces are cut.
        """
        if not text:
            return b""
        parts = _WORD_START.split(text) if _ENDS_IN_SPACE_RUN.search(text) else text.split(" ")
        found = [self.words.get(p) for p in parts]
        found[0] = self._ids(parts[0])
        if None in found:
            word = self._word
            found = [word(p) if f is None else f for p, f in zip(parts, found)]
        return b"".join(found)

    def decode(self, ids: bytes | Iterable[int], leaf: int = 4096) -> bytes:
        """Concatenate token bytes: leaves of tokens, then neighbours up the tree."""
        numbers = array("I", ids) if isinstance(ids, bytes) else list(ids)
        level = [b"".join(map(self.tokens.__getitem__, numbers[i : i + leaf])) for i in range(0, len(numbers), leaf)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


_loaded: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(path: str, pattern: str) -> ByteBpe:
    """The tokenizer of a vocabulary file, read once in each Python process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe.load(path, pattern)
    return _loaded[path, pattern]


def encode_texts(
    docs: DataFrame, path: str, pattern: str, *, keys: Sequence[str] = ("doc_id",), text: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encode every whole text and decode it again, without a shuffle.

    Gives the keys with n_tokens, ids_sha256 and decoded_sha256, and the ids as bytes on request.
    """

    def make():
        bpe = tokenizer(path, pattern)

        def run(column: pa.Array, _):
            counts, ids_digest, text_digest, kept = [], [], [], []
            for value in column.to_pylist():
                ids = bpe.encode(value)
                counts.append(len(ids) // 4)
                ids_digest.append(hashlib.sha256(ids).hexdigest())
                text_digest.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            return [counts, ids_digest, text_digest] + [kept] * with_ids

        return run

    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return add_columns(docs, keys, text, added, make)
