import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import chat as c
from weftline.llm import encoder as e
from weftline.llm.packing import tokenizer_path


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\>im_startend n\n", max_size=40))
def test_escape_is_reversible(text):
    assert c.unescape(c.escape(text)) == text and "<|" not in c.escape(text)
    assert c._role_back(c._role(text)) == text


def test_round_trip(spark):
    rows = [
        (1, 1, "user", "hi <|im_end|>"), (1, 2, "assistant", "<|im_start|>assistant\n<\\|im_end|> ok"), (1, 3, "assistant", None),
        (2, None, None, "x"), (2, 0, "assistant", "é\n\n"), (2, 0, "assistant", "é\n\n"), (None, 5, "a\nb\\n", "t" * 70_000), (3, 1, "user", ""),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    formatted = c.assemble(df, tokenizer_path())
    got = {r.conv_id: r for r in c.read_back(formatted, tokenizer_path()).collect()}
    assert len(got) == 4
    for conv in (1, 2, 3, None):
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        learnt = "".join(t[3] for t in turns if t[2] == "assistant")
        assert got[conv].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest() and got[conv].loss_chars == len(learnt)
        shown = "".join(f"{c.START}{c._role(t[2])}\n{c.escape(t[3])}{c.END}\n" for t in turns)
        assert got[conv].formatted_chars == len(shown)
    for r in formatted.collect():
        assert len(r.ids) == 2 * len(r.mask) and set(np.frombuffer(r.mask, np.int8).tolist()) <= {0, 1}
    assert c.read_back(c.assemble(df.limit(0), tokenizer_path()), tokenizer_path()).count() == 0


def test_bytes_of_ids():
    fast, plain = e.Encoder(tokenizer_path()), e.Encoder(tokenizer_path())
    plain.engine = None
    assert fast.token_bytes() == plain.token_bytes() and fast.size == plain.tok.get_vocab_size(with_added_tokens=True)
