"""What makes the two encoders fast leaves their ids as they are."""

import os
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from barweave.llm import pieces, records  # noqa: E402


def test_undone_merges_tell_what_merging_tells():
    c = pieces.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(3)
    every = list(c.id.values())
    short = [i for i in every if len(c.vocab[i]) <= 3]
    seen = set()
    for k in range(6000):
        a, b = (r.choice(short if k % 2 else every) for _ in range(2))
        x, y = c.vocab[a], c.vocab[b]
        want = c.merged(x + y) == [x, y]
        assert c.compatible(a, b) == want
        seen.add(want)
    assert seen == {True, False}


def test_texts_are_cut_at_line_ends_too_and_equal_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    c, sp = pieces.PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(5)
    letters = list("aeithns  \n\t.,-'▁AÉé漢字1209^]\\") + [r.choice(c.vocab) for _ in range(60)]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 25))) for _ in range(1500)]
    assert [c.encode_text(t) for t in texts] == [",".join(map(str, sp.encode(t))) for t in texts]
    assert c.chunks("▁of.\nIn▁▁") == ["▁of.", "\n", "In", "▁▁"]


def test_words_are_encoded_on_the_tasks_own_thread(monkeypatch):
    monkeypatch.setattr(records, "MEMO", 3)
    w = records.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    texts = ["one two three", None, "", "two four two five", "one six é漢", "six six"]
    want = [b"".join(i.to_bytes(w.width, "little") for i in w.tok.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [w.encode_all([t.encode() if t else None])[0] for t in texts] == want == w.encode_all([t.encode() if t else None for t in texts])
    assert len(w.memo) <= 3
