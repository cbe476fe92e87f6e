import hashlib
import random

import pytest

from vislens.llm import chat_format as cf

SCHEMA = "conv_id bigint, turn bigint, role string, text string, seq string, kind string, loss string"
TRICKY = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<", "[", "<<", "\\<", "[ROLE]x[/ROLE]", "</", "é\n\r", "", None, "<s></s><<SYS>><</SYS>>", "[/TURN", "]\\"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def expected(rows, template):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        turns = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), turns, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_texts_come_back_whatever_they_say(spark):
    rng = random.Random(1)
    rows = []
    for c in [None, *range(60)]:
        for t in range(rng.randint(1, 8)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "[/ROLE]", "*"])
            rows.append((c, rng.choice([t, t, None, 3]), role, rng.choice(TRICKY) if rng.random() < 0.7 else (rng.choice(TRICKY) or "") + (rng.choice(TRICKY) or "")))
    rows += rows[:5]  # repeated rows are turns
    segments = cf.format_conversations(frame(spark, rows))
    table = segments.collect()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.read_conversations(cf.sorted_segments(spark.createDataFrame(table, segments.schema))).collect()}
    assert got == expected(rows, cf.Template())
    chars = {r.conv_id: r.formatted_chars for r in cf.read_conversations(segments).collect()}
    for c in chars:
        assert chars[c] == sum(len(s.text) for s in table if s.conv_id == c)


def test_segments_laid_end_to_end_read_the_same(spark):
    rows = [(i, t, role, (a or "") + (b or "")) for i, (a, b) in enumerate((a, b) for a in TRICKY for b in TRICKY) for t, role in enumerate(["system", "user", "assistant", "tool"])]
    segments = cf.format_conversations(frame(spark, rows))
    by = {}
    for s in segments.collect():
        by.setdefault(s.conv_id, []).append(s)
    whole = [(c, "".join(s.text for s in sorted(own, key=lambda s: s.seq)), False, None) for c, own in by.items()]
    joined = spark.createDataFrame(whole, "conv_id bigint, text string, loss boolean, error string")
    want = expected(rows, cf.Template())
    assert {r.conv_id: (r.n_turns, r.turns_sha256) for r in cf.read_conversations(joined).collect()} == {c: v[:2] for c, v in want.items()}


def test_loss_covers_assistant_texts_only(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a</s>")]
    got = cf.format_conversations(frame(spark, rows)).collect()
    assert [(s.kind, s.text, s.loss) for s in got if s.loss] == [("text", "a\\</s>", True)]
    assert "".join(s.text for s in got) == "<<SYS>>s<</SYS>>[INST]u[/INST]<s>a\\</s></s>"


@pytest.mark.parametrize(
    "roles, error",
    [("ua", None), ("sua", None), ("u", None), ("uu", "user after user"), ("a", "assistant after (start)"), ("su", None), ("s", "unfinished"), ("usa", "system after user"), ("ut", "tool after user"), ("uaua", None)],
)
def test_turn_order(spark, roles, error):
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    rows = [(1, i, names[r], "x") for i, r in enumerate(roles)]
    errors = [s.error for s in cf.format_conversations(frame(spark, rows)).collect() if s.error]
    assert errors[:1] == ([error] if error else [])
    assert cf.read_conversations(cf.format_conversations(frame(spark, rows))).first().valid == (error is None)


def test_long_conversations_and_empty_tables(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i} " * 20) for i in range(25_000)]
    got = cf.read_conversations(cf.format_conversations(frame(spark, rows))).first()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == expected(rows, None)[1] and got.valid
    assert cf.format_conversations(frame(spark, [])).count() == 0
    assert cf.read_conversations(cf.format_conversations(frame(spark, []))).count() == 0


def test_damaged_output_is_an_error(spark):
    for text in ("[INST]no end", "text outside", "[INST]a</s>", "[INST]a[/INST][/INST]"):
        df = spark.createDataFrame([(1, text, False, None)], "conv_id bigint, text string, loss boolean, error string")
        with pytest.raises(Exception, match="conversation 1"):
            cf.read_conversations(df).collect()
