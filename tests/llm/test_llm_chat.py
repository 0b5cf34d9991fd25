import hashlib

from rallylens.llm import chat

TALK = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", "\\<\\/s>\\\\ [\\INST]<s>"), (1, 3, "assistant", "é\n\\"), (1, 4, "user", None),
    (2, 0, None, "no reply"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (3, None, "as[/INST]sistant</s>", "x" * 50000),
    (None, 1, "user", "a"), (None, 2, "assistant", "b"),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip(spark):
    rows = spark.createDataFrame([(*t, "extra") for t in TALK], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.digest(chat.examples(rows)).collect()}
    assert len(got) == 4
    for conv in (1, 2, 3, None):
        turns = sorted((-1 if t is None else t, r or "", x or "") for c, t, r, x in TALK if c == conv)
        replies = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{x}\n" for _, role, x in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(replies), sha(replies))


def test_one_example_per_reply_and_for_the_rest(spark):
    rows = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    made = sorted((r for r in chat.examples(rows).collect() if r.conv_id == 1), key=lambda r: r.example)
    assert [r.target_turn for r in made] == [1, 3, None]
    assert made[2].loss_start == made[2].loss_stop and made[1].formatted.startswith(made[0].formatted)
    assert made[0].formatted.count("</s>") == 2 and made[0].formatted.count("[INST]") == 2
    assert made[0].formatted[made[0].loss_start : made[0].loss_stop] == "<\\/s>[\\INST] ok [\\/INST]"


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.examples(none)).collect() == []
