"""The word table of packing: the library's ids, without a call of the library for every unseen word."""

import random

import numpy as np
import pytest

from innlytics.llm import packing

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture()
def words():
    return packing.WordTable(tokenizers.path("word_bpe_49k.json"))


class Counted:
    def __init__(self, tk):
        self.tk, self.calls = tk, 0

    def encode(self, *args, **kwargs):
        self.calls += 1
        return self.tk.encode(*args, **kwargs)


def expected(t, text):
    return np.array(t.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()


def test_unseen_words_are_not_tokenised_one_by_one(words):
    r = random.Random(4)
    text = " ".join("".join(r.choices("aeioulmnrstéö", k=r.randint(1, 14))) + r.choice(["***", "!!", "$$$", ",%%%", ""])
                    for _ in range(3000))
    words.tk = counted = Counted(words.tk)
    assert words.encode(text.encode()) == expected(counted.tk, text)
    assert counted.calls < 50


def test_odd_words_have_the_ids_of_the_library(words, monkeypatch):
    monkeypatch.setattr(packing, "TABLE_SIZE", 500)  # both tables change often
    r = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz" * 3 + "ÀÉÈÑÖÜßàéèçñöüÿ÷×æøåABCXYZ0123456789" + "ſİÅµªº̸́\x00\x1c 　日😀"
    letters += "".join(map(chr, packing.MARKS))
    texts = [" ".join("".join(r.choices(letters, k=r.randint(1, r.choice([3, 8, 14, 70])))) for _ in range(40))
             for _ in range(300)]
    texts += ["", " \n", "it's we're x's' É's É'S ÉCOLE!!! U.S.A. rock'n'roll'''", "<|endoftext|> a<|endoftext|>b X ab<| cd<|.",
              "<|EndOfText|> endoftext|>"] + ["a" * n for n in (1, 2, 63, 64, 65, 900)] + ["é" * n + "." for n in (31, 32, 33)]
    for _ in range(2):
        assert words.encode_all([t.encode() for t in texts]) == [expected(words.tk, t) for t in texts]
    assert all(len(w) <= packing.LONG_WORD for w in words.young)


def test_a_model_that_is_not_plain_merges_is_asked_word_by_word(words):
    words.merges = None
    text = "The cat's mat, straße*** É. 12"
    assert words.encode(text.encode()) == expected(words.tk, text)
