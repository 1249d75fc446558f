"""A conversation is one text; pieces may be cut anywhere."""

import hashlib

import pytest

from clickstrata.llm import chat

ROWS = [(1, "user", "</s>[INST] ok \\ [/INST]"), (1, "assistant", "\\\\b<>[] \\"), (2, "assistant", ""), (1, "assistant", "x" * 500), (None, "user", "é𝄞"), (2, "", "<s>[user] no </s>")]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 16])
def test_read_back_from_pieces(spark, size):
    table = spark.createDataFrame([(c, i, role, text) for i, (c, role, text) in enumerate(ROWS)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_log(chat.table_events(table))
    pieces = chat.texts(formatted, size).collect()
    whole = {}
    for r in pieces:
        assert len(r.text) <= size and r.piece == len(whole.setdefault(r.conv_id, []))
        whole[r.conv_id].append(r.text)
    got = {r.conv_id: r for r in chat.digests(formatted, size).collect()}
    for conv in (1, 2, None):
        turns = [(role, text) for c, role, text in ROWS if c == conv]
        assert chat.parse("".join(whole[conv])) == turns
        loss = "".join(text for role, text in turns if role == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars == sum(map(len, whole[conv]))


def test_a_text_that_ends_within_a_turn_is_an_error():
    reader = chat.Reader()
    reader.feed(chat.render("user", "hello")[0] + "<s>[user] ", [])
    with pytest.raises(ValueError):
        reader.row(1)
