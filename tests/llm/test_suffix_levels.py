import hashlib
import random

import numpy as np
import pytest
from edge import documents

from tabloom.llm import suffix_levels


def brute(rows, length=100):
    """Every string of every text, in order, against all earlier ones."""
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((str(rows[i][0]), len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def awkward():
    pick = random.Random(3)
    words = ["".join(pick.choices("abcdefg é漢", k=pick.randint(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(pick.choices(words, k=n))
    shared = [text(60) for _ in range(4)]
    exact = "".join(pick.choices("xyz", k=100))
    texts = [text(40) + shared[i % 4] + text(30) for i in range(40)]
    for i in range(12):  # near copies, at other offsets
        t = list(texts[i])
        for _ in range(i % 4):
            t[pick.randrange(len(t))] = "#"
        texts.append(text(i % 3) + "".join(t))
    texts += [exact, exact[:99], exact[1:], "ab" + exact, exact + exact, exact[:50] + "!" + exact[50:]]
    texts += ["=" * 5000, "=" * 99, "=" * 101, "ab" * 700, ("line of text\n") * 90, None, "", "short", texts[0], texts[0], texts[5][7:]]
    rows = [(i if i % 11 else i - 1, t) for i, t in enumerate(texts)]
    rows += [(None, shared[0] + "end"), (None, None), (-5, shared[1])]
    return rows


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, "a", b"b") for i, t in rows], "doc_id long, text string, unit int, row string, raw binary").coalesce(1)
    got = suffix_levels.summary(suffix_levels.deduplicate(docs, **options))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in got.collect())


@pytest.mark.parametrize("unit, batches", [(4 << 20, 1), (900, 5)])
def test_against_every_string(spark, monkeypatch, unit, batches):
    monkeypatch.setattr(suffix_levels, "UNIT", unit)
    rows = awkward()
    assert found(spark, rows, batches=batches) == brute(rows)


def test_odd_rows_and_empty_tables(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.coalesce(1).collect()]
    got = suffix_levels.deduplicate(docs.coalesce(1))
    assert sorted((str(r[0]), *r[1:]) for r in suffix_levels.summary(got).collect()) == brute(rows)
    assert suffix_levels.deduplicate(documents(spark, empty=True)).count() == 0


def test_spans_and_kept_bytes(spark):
    same = "0123456789" * 12
    rows = [(1, "first " + same), (2, "é" + same + " own " + same)]
    out = {r.doc_id: r for r in suffix_levels.deduplicate(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    raw = rows[1][1].encode()
    assert bytes(out[2].kept) == b"".join(raw[a:b] for a, b in zip([0, *(s.end for s in out[2].spans)], [*(s.start for s in out[2].spans), len(raw)]))
    # Strings of period ten repeat within the first text as well.
    assert out[1].spans and out[1].n_bytes == 126


@pytest.mark.parametrize("k", [suffix_levels.COARSE, suffix_levels.FINE, 100])
@pytest.mark.parametrize("block", [64, 1 << 15])
def test_pieces_cover_every_string_once(monkeypatch, k, block):
    monkeypatch.setattr(suffix_levels, "BLOCK", block)
    sizes = [0, 99, 100, 101, 700, 5, 3000]
    data = np.random.default_rng(k).integers(0, 3, size=sum(sizes)).astype(np.uint8)
    ends = np.cumsum(sizes)
    s, n, prefix, whole = suffix_levels.pieces(data, ends, k)
    starts = np.concatenate([np.arange(a, a + m) for a, m in zip(s, n)])
    assert starts.tolist() == [p for b, e in zip([0, *ends], ends) for p in range(b, e - 99)]
    assert n.max() <= 100 - k + 1
    # The same text elsewhere has the same pieces.
    moved = np.concatenate([np.full(37, 9, np.uint8), data[-3000:]])
    again = suffix_levels.pieces(moved, np.array([37, 3037]), k)
    own = s >= ends[-2]
    assert (again[2] == prefix[own]).all() and (again[3] == whole[own]).all()


def test_levels_are_of_different_sizes(spark):
    family = suffix_levels.Family()
    sizes = []
    for i in range(7):
        units = suffix_levels.packed(spark.createDataFrame([(i, str(i) * 150)], "doc_id long, text string"), 1, key="doc_id", text="text")
        family.add(family.array(units))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]
    family.remove()
