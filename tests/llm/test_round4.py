"""Findings on CPU seconds: words of many texts are worked out together, once each."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tokenizers")

import public_tokenizers  # noqa: E402
from sentencepiece import SentencePieceProcessor  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tidemark.llm import idcoder, spm  # noqa: E402
from tidemark.llm.tokens import Coder  # noqa: E402

BITS = ["word", "Word", "WORD,", "don't", "we'LL", "'s", "s'", "a1", "12", "x.", "x..", "|", "İx", "ıſ", "ſ", "ǅ", "éa", "é", "Σας", "日本", "a b", "\t", "\n", "\r\n", "\x85", "\x00", "ª", "²", "ß.", "", " ",
        "<", "<|endoftext|>", "<|EndOfText|>", "(y)", "-z", "́", "😀", "K"]


@pytest.mark.parametrize("name, remembered", [("word_bpe_49k.json", 250_000), ("word_bpe_49k.json", 2), ("byte_bpe_50k.json", 250_000)])
def test_texts_together_give_the_ids_of_whole_texts(name, remembered):
    rng = random.Random(5)
    fresh, mine = Tokenizer.from_file(public_tokenizers.path(name)), Coder(name, remembered)
    for size in (1, 0, 40, 400):
        texts = ["".join(rng.choice(BITS) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(size)]
        got = mine.encode_all(pa.array(["skipped", *texts], pa.string())[1:])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


def test_letters_are_lowered_alike():
    """What arrays lower and split by themselves, up to the last letter they are trusted with."""
    mine = Coder("word_bpe_49k.json")
    words = [x for i in range(1, 0x180) for x in (chr(i), f"a{chr(i)}", f"{chr(i)}b", f"A{chr(i)}.", f"a{chr(i)}s")]
    assert mine.encode_all(pa.array(words)) == [mine.encode(w) for w in words]


def test_a_word_is_worked_out_once():
    mine = Coder("word_bpe_49k.json")
    made = []
    atom = mine.atom
    mine.atom = lambda x: made.append(x) or atom(x)
    for _ in range(2):
        mine.encode_all(pa.array(["Anword anword, ANWORD\nanword.", "anword! anword"]))
    assert made.count("anword") == 1


@pytest.mark.parametrize("kinds", [5, (1 << 13) - 1, 1 << 13, 1 << 16])
def test_alphabets_of_all_widths(kinds):
    n = max(kinds, 9000)
    ids = np.concatenate([np.arange(kinds), np.random.default_rng(kinds).integers(0, 3, n)]).astype(np.uint32)
    alphabet, counts, places = idcoder.in_alphabet(ids)
    words = idcoder.encode_blocks(places, counts.astype(float))
    assert len(alphabet) == kinds and (alphabet[idcoder.decode_blocks(words, len(ids), counts.astype(float))] == ids).all()


def test_arcs_end_with_the_pieces():
    """A place is left for the next one as soon as no piece ends with what lies before it."""
    weight = dict.fromkeys("abcdefgh", 1.0) | {"ab": 1.0, "h" * 40: 1.0}
    lattice = spm.Lattice(weight)

    class Counted(dict):
        asked = 0

        def get(self, key, other=None):
            Counted.asked += 1
            return super().get(key, other)
    lattice.ends = Counted(lattice.ends)
    word = "abcdefg" * 40
    assert lattice.shortest(word) == ["ab", "c", "d", "e", "f", "g"] * 40
    assert Counted.asked < 3 * len(word)


def test_remembered_states_do_not_change_paths(monkeypatch):
    monkeypatch.setattr(spm, "STATES", 5)
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    few = spm.Transducer(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    for _ in range(3000):
        word = "".join(rng.choice(["th", "er", "in", "é", "Ω", "日", "a", "tion", ".", "\n", "▁", "☃"]) for _ in range(rng.randint(1, 9)))
        assert np.frombuffer(few.part(spm.MARK + word), "<u4").tolist() == model.encode(word), word


def test_parts_between_pieces_are_found_once():
    t = spm.Transducer(public_tokenizers.path("piece_bpe_32k.model"))
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    asked = []
    part = t.part
    t.part = t.inner.make = lambda s: asked.append(s) or part(s)
    text = "Thanword Thanword☃ Thanword☃日 ☃ Thanword\nThanword\n ☃☃"
    assert np.frombuffer(t.encode(text), "<u4").tolist() == model.encode(text)
    assert asked.count("▁Thanword") == 1
