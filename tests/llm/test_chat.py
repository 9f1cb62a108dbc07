import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import chat

PARTS = st.lists(st.sampled_from(["</s>", "<|turn|>", "<|text|>", "[INST]", "[/INST]", "<s>", "\\", "<", "|", "é", "a ", "\n", "<\\/s>", "</", "s>", "𝄞"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PARTS)
def test_escaping_is_reversible_and_hides_control_strings(text):
    t = chat.Template()
    hidden = t.escape(text)
    assert t.unescape(hidden) == text
    assert not any(c in hidden for c in (t.turn, t.body, t.end, *t.reserved))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|turn|>", ""]), PARTS), max_size=6))
def test_round_trip_of_turns_and_loss_text(turns):
    t = chat.Template()
    text, spans = t.render(turns, ("assistant",))
    assert t.parse(text) == turns
    coder = chat.load_tokenizer(chat.public_tokenizers.path(chat.TOKENIZER), t)
    offsets = np.array(coder.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
    under = chat.mask(offsets, spans)
    assert chat.masked_text(text, offsets[:, 0], offsets[:, 1], under, t) == "".join(x for role, x in turns if role == "assistant")


def test_parts_nulls_ties_and_empty_table(spark):
    rows = [(1, 0, "user", "hi"), (1, 5000, "assistant", "late"), (1, 1, None, None), (1, 1, None, None), (None, None, "assistant", "x"), (2, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(df, part_turns=100)
    parts = {(r["conv_id"], r["part"]): r for r in got.collect()}
    assert len(parts) == 4
    assert parts[(1, 0)]["n_turns"] == 3 and parts[(1, 50)]["n_turns"] == 1
    assert not any(parts[(2, 0)]["loss_mask"]) and any(parts[(1, 50)]["loss_mask"])
    assert len(parts[(1, 0)]["input_ids"]) == len(parts[(1, 0)]["loss_mask"]) == len(parts[(1, 0)]["token_starts"])
    assert chat.format_conversations(df.limit(0)).count() == 0
