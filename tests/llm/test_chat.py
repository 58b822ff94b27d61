import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from lorebank.llm import chat

PARTS = ["\\", "\n", "###", " ", "### assistant:\n", "</turn>", "<turn/>", "ok", "\n</turn>\n", "\n<turn/>\n", "é", "\\n", "#", "<", ":"]


def conversations(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 6)):
            text = None if rng.random() < 0.05 else "".join(rng.choices(PARTS, k=rng.randint(0, 7)))
            role = rng.choice(["user", "assistant", "assistant", "system", None, "odd\\role\n:x", ""])
            rows.append((c if c else None, rng.choice([t, t, None, 0]), role, text))
    return rows


def plain(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in out.items()}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_outputs_are_read_back_whole(spark):
    rows = conversations(5)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.conversation_digests(formatted).collect()}
    turns = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in formatted.select("conv_id", chat.read_back(formatted.formatted).alias("turns")).collect()}
    texts = {r.conv_id: r.formatted for r in formatted.collect()}
    want = plain(rows)
    assert turns == want and set(got) == set(want)
    for c, own in want.items():
        loss = "".join(x for r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), sha("".join(f"{r}\n{x}\n" for r, x in own)))
        assert (got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(loss), sha(loss), len(texts[c]))


def test_adjacent_turns_of_a_role_share_a_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    (row,) = chat.format_conversations(df).collect()
    assert row.formatted == "### user:\na\n</turn>\n### assistant:\nb\n<turn/>\nc\n</turn>\n"
    assert [row.formatted[s.start : s.stop] for s in row.loss_spans] == ["b", "c"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digests(chat.format_conversations(df)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=8).map("".join), min_size=1, max_size=40))
def test_escaping_is_reversible(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", chat.escape(rows.t).alias("e"), chat.unescape(chat.escape(rows.t)).alias("u"), chat.unescape_role(chat.escape_role(rows.t)).alias("role")).collect():
        assert r.u == r.t and r.role == r.t
