"""Where token_output cuts texts into pieces, and what of a text the library's whole chain still works on (round 3, op1)."""

import json
import random
import re
import unicodedata

import numpy as np
import pytest

from redline.llm import token_output


@pytest.fixture
def encoder():
    return token_output.PieceEncoder(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))


class Counting:
    """A tokenizer that counts the characters it encodes."""

    def __init__(self, tokenizer):
        self.tokenizer, self.characters = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.characters += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_of_letters_go_to_the_model_alone(encoder):
    draw = random.Random(1)
    words = ["".join(draw.choice("abdeiorstéßñи") for _ in range(9)) for _ in range(4000)]
    texts = ["First " + " ".join(w + draw.choice(["", ",", ".", "***"]) for w in words[i : i + 50]) for i in range(0, 4000, 50)]
    want = [encoder.whole(t) for t in texts]
    encoder.tokenizer = Counting(encoder.tokenizer)
    assert encoder.encode(texts) == want
    assert encoder.tokenizer.characters < 100  # all 4,000 words before


def test_cuts_are_after_letters_only():
    letter = re.compile(f"[{token_output.LETTERS}]")
    for c in map(chr, range(0x21, 0x3000)):
        if not c.isspace():
            data = np.frombuffer(f"a{c},b".encode(), np.uint8)
            is_cut = len(data) - 2 in token_output.piece_starts(data, np.array([0, len(data)]))
            assert is_cut == bool(letter.fullmatch(c)), hex(ord(c))
            assert not is_cut or unicodedata.category(c)[0] == "L"


@pytest.mark.parametrize("kept", [1, 50, 1 << 20])
def test_any_characters_and_a_small_table(encoder, kept):
    draw, encoder.pieces_kept = random.Random(kept), kept
    pool = [*"abXYZ   \n'.,;!-_*$<>10", "é", "ß", "Ж", "—", "日", "ª", "×", "÷", "ʼ", "́", "​", "\x00", "ǅ", "҂", "²", "'s", "'ll", " the", "\t", "\xa0"]
    texts = ["".join(draw.choice(pool) for _ in range(draw.choice([1, 3, 9, 60]))) for _ in range(300)]
    texts += ["".join(chr(draw.randrange(0x21, 0x600)) if draw.random() < 0.5 else draw.choice("aé, '") for _ in range(20)).strip() for _ in range(300)]
    texts += [" ".join(t.split()) for t in texts]
    for some in (texts, texts[::-1], texts[:1], []):
        assert encoder.encode(some) == [encoder.whole(t) if t else b"" for t in some]


def test_without_the_byte_level_chain_the_model_is_not_used(encoder, tmp_path):
    state = json.loads(encoder.tokenizer.to_str())
    state["normalizer"] = {"type": "NFC"}
    (tmp_path / "other.json").write_text(json.dumps(state))
    assert encoder.model is not None and token_output.PieceEncoder(str(tmp_path / "other.json")).model is None
