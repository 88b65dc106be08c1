"""Rows with every awkward case, with extra columns whose names operators use themselves."""

LONG = "word " * 30_000 + "x" * 40_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, digest string, size int, id string, factor double, kept boolean, `a.b` int, mix_tokens string, mix_kept int, mix_topic string, topic int, `c0` string"


def documents(spark, texts=None, empty=False):
    texts = texts or [None, "", "   ", LONG, "one two three four five six seven", "one two three four five six seven", "a", "é ß 漢字 👍\u0000 end"]
    rows = [(i, t, None if i % 3 == 0 else "en", "s", None, 1, "d", 2, "k", 0.5, None, i, "own", 7, "t", 8, "z") for i, t in enumerate(texts)]
    rows += [rows[min(4, len(rows) - 1)], (None, "row without id", None, None, 3, *[None] * 12)]
    return spark.createDataFrame([] if empty else rows, SCHEMA)
