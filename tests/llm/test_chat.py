"""Round trips of formatted conversations, and the digests against a direct calculation."""

import hashlib

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from pactum.llm import chat

VOCABULARY = str(P.path("byte_bpe_50k.json"))
SCHEMA = "conv_id long, turn long, role string, text string, ids string"


@given(st.lists(st.sampled_from(["\\", "###", " ", "User", "Assistant:", "</turn>", "### System:\n", "x", "\n", "</", "turn>", "#"]), max_size=25))
@settings(max_examples=1000, deadline=None)
def test_escaping_is_reversible(parts):
    text = "".join(parts)
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    import re

    assert not re.search(rf"(?<!\\){chat.CONTROL}", escaped)


def expected(rows):
    convs = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for conv, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def test_conversations(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 2, "assistant", "Éh 漢字 🙂\n"), (1, 1, "user", "Hi </turn>\n### Assistant:\nno"), (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    rows += [(2, i, ("user", "assistant")[i % 2], f"text {i} \\\\</turn>" * (i % 5)) for i in range(700)]
    rows += [(3, 0, "critic ### Role", "x"), (3, 1, None, None), (None, 0, "assistant", "<|endoftext|>"), (4, None, "assistant", "end\\"), (4, None, "assistant", "end\\"), (5, 1, "user", "y" * 20000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    formatted = chat.format_turns(frame, VOCABULARY)
    got = {r.conv_id: r for r in chat.read_back(formatted, VOCABULARY).collect()}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == expected(rows)
    one = formatted.filter("conv_id = 1").orderBy("turn_no").collect()
    assert [r.position for r in one] == [0, len(one[0].loss), len(one[0].loss) + len(one[1].loss)]
    text = "".join(chat.render(r.ids, VOCABULARY) for r in one)
    assert text == "### System:\nBe brief.\n</turn>\n### User:\nHi \\</turn>\n\\### Assistant:\nno\n</turn>\n### Assistant:\nÉh 漢字 🙂\n\n</turn>\n"
    assert got[1].formatted_chars == len(text)
    assert all(len(r.ids) == 4 * len(r.loss) for r in one) and sum(one[2].loss) == len(one[2].loss) - 2 and not any(one[1].loss)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_turns(empty, VOCABULARY), VOCABULARY).count() == 0
