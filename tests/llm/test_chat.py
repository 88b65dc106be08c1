import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import chat

TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b\n<", ""]), st.text(alphabet="ab\\#</turn> \n:", max_size=30)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TURNS)
def test_marked_can_be_read_back(turns):
    assert chat.read_marked(chat.marked(turns)) == turns


@settings(max_examples=200, deadline=None)
@given(TURNS)
def test_spans_hold_the_texts(turns):
    found = chat.locate(turns, chat.marked)
    assert not found.rewrites
    assert "".join(found.formatted[a:b] for a, b in found.spans) == found.formatted
    assert [chat.unescape(found.formatted[a:b]) for a, b in found.texts] == [t for _, t in turns]


def test_rewriting_templates_are_found():
    last_system = lambda turns: "".join(f"[{r}]{t}\n" for i, (r, t) in enumerate(turns) if r != "system" or i == len(turns) - 1)
    short = lambda turns: "".join(f"[{r}]{t if i + 2 > len(turns) else t[:3]}\n" for i, (r, t) in enumerate(turns))
    turns = [("system", "be kind"), ("user", "hello there"), ("assistant", "good day")]
    assert chat.locate(turns, last_system).rewrites and chat.locate(turns, short).rewrites
    assert chat.locate(turns, lambda t: "<s>" + "".join(f"[{r}]{x}" for r, x in t)).spans[0] == (3, 18)


def test_stray_text_is_an_error():
    with pytest.raises(ValueError):
        chat.read_marked("### user:\nhi\n</turn>\nstray")


def test_format_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, rows string, formatted int"
    rows = [
        (1, 1, "assistant", "b", "x", 1),
        (1, 0, "user", None, "x", 1),
        (1, 1, "assistant", "a", "x", 1),
        (1, 1, "assistant", "a", "x", 1),
        (None, None, None, "no id", "x", 1),
        (2, 0, "user", "only", "x", 1),
    ] + [(3, i, "assistant", f"# t{i}", "x", 1) for i in range(300)]
    found = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, schema), with_text=True).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found[1].turns_sha256 == sha("user\n\nassistant\na\nassistant\na\nassistant\nb\n")
    assert (found[1].n_turns, found[1].loss_chars, found[1].loss_sha256) == (4, 3, sha("aab"))
    assert found[None].turns_sha256 == sha("\nno id\n") and found[2].loss_sha256 == sha("")
    whole = "".join(f"# t{i}" for i in range(300))
    assert found[3].loss_sha256 == sha(whole) and found[3].formatted_chars == len(found[3].formatted)
    assert not any(r.rewrites for r in found.values())
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


def test_rewriting_templates_are_reported_from_tables(spark):
    rows = [(1, 0, "system", "a"), (1, 1, "user", "b"), (1, 2, "system", "c"), (1, 3, "user", "d"), (2, 0, "system", "e"), (2, 1, "user", "f")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    read = lambda said: [tuple(line[1:].split("]", 1)) for line in said.splitlines()]
    last_system = lambda turns: "".join(
        f"[{r}]{t}\n" for i, (r, t) in enumerate(turns) if r != "system" or all(s != "system" for s, _ in turns[i + 1 :])
    )
    own = dict(render=last_system, read=read, unescape=str, learned="user")
    whole = {r.conv_id: r for r in chat.format_conversations(docs, **own, with_text=True).collect()}
    assert whole[1].rewrites and whole[1].spans == whole[1].mask == [] and whole[1].formatted == "[user]b\n[system]c\n[user]d\n"
    assert not whole[2].rewrites and whole[2].formatted == "[system]e\n[user]f\n" and whole[2].loss_chars == 1
    near = {r.conv_id: r for r in chat.format_conversations(docs, **own, window=3).collect()}
    assert near[1].asDict() == dict.fromkeys(near[1].asDict()) | {"conv_id": 1, "rewrites": True}
    assert near[2] == tuple(whole[2])[:7]


def numbered(turns):
    return "<s>" + "".join(f"{i} {r}: {t}\n" for i, (r, t) in enumerate(turns))


def test_windows_shorter_than_a_template_looks_back_are_errors():
    told = chat._Windowed(numbered, lambda said: [("user", said)], str, "user", 2)
    for i in range(3):
        told.add(("user", f"t{i}"))
    with pytest.raises(ValueError, match="looks back"):
        told.add(("user", "t3"))


def test_windows_are_short_where_texts_are_long(monkeypatch):
    monkeypatch.setattr(chat, "HELD_CHARS", 100)
    turns = [("assistant", "x<" * n) for n in (1, 40, 200, 3, 0, 20, 20, 20)]
    near, whole = (c(chat.marked, chat.read_marked, chat.unescape, "assistant", last) for c, last in ((chat._Windowed, 5), (chat._Whole, False)))
    most = 0
    for turn in turns:
        near.add(turn)
        whole.add(turn)
        most = max(most, len(near.held))
    assert near.row() == whole.row() and most < 5


def test_an_opening_belongs_to_no_turn():
    render = lambda turns: "<s>\n" + chat.marked(turns)
    read = lambda said: chat.read_marked(said[4:])
    turns = [("user" if i % 2 else "assistant", "#" * i) for i in range(20)]
    near, whole = (c(render, read, chat.unescape, "assistant", last) for c, last in ((chat._Windowed, 3), (chat._Whole, False)))
    for turn in turns:
        near.add(turn)
        whole.add(turn)
    assert near.row() == whole.row()


def test_frames_may_depend_on_the_turns_number_or_length():
    turns = [("user", "x" * i) for i in range(1, 13)]
    for render in (
        lambda turns: "".join(f"Turn {i}: {t}\n" for i, (_, t) in enumerate(turns)),
        lambda turns: "".join(f"{len(t)}:{t};" for _, t in turns),
    ):
        found = chat.locate(turns, render)
        assert [found.formatted[a:b] for a, b in found.texts] == [t for _, t in turns]
    with pytest.raises(ValueError):
        chat.locate([("user", "no"), ("user", "yes")], lambda turns: "".join(f"{'Q' if t.startswith('y') else 'S'}:{t};" for _, t in turns))


def test_long_conversations_are_not_one_row(spark):
    rows = [(None if i % 3 else i % 7, i // 2, ("user", "assistant", None)[i % 3], f"#<{i}\\") for i in range(3000)] + [(8, None, "user", None)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(docs)
    assert "collect_list" not in made._jdf.queryExecution().toString()
    some = docs.where("conv_id is not null or turn < 100")
    whole = chat.format_conversations(some, with_text=True)
    assert chat.format_conversations(some, window=4).count() == whole.count() == 9
    for window in (None, 1, 3, 32):
        part = chat.format_conversations(some, window=window)
        assert sorted(map(str, part.collect())) == sorted(map(str, whole.select(*part.columns).collect()))
    assert {r.conv_id: r.n_turns for r in chat.format_conversations(docs, window=8).collect()}[None] == 2000
    zero = spark.createDataFrame([(0.0, 1), (-0.0, 2), (float("nan"), 1), (float("nan"), 2)], "conv_id double, turn long")
    assert chat.format_conversations(zero.selectExpr("*", "'user' role", "'a' text")).count() == 2
