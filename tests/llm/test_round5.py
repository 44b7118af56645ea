"""Finding on CPU seconds of op2: what is known when ids are written is worked out over whole arrays."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tokenizers")

from tidemark.llm import idcoder  # noqa: E402
from tidemark.llm.tokens import coder  # noqa: E402


def drawn(n: int, kinds: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of ids of which few are frequent."""
    ids = np.minimum(np.random.default_rng(seed).zipf(1.3, n) - 1, kinds - 1).astype(np.uint32)
    _, counts, places = idcoder.in_alphabet(ids)
    return places, counts.astype(float)


def test_look_ahead_is_the_model_step_by_step():
    places, counts = drawn(3 * 2000, 300)
    ids = places.reshape(3, 2000)
    said, freq, below = idcoder.look_ahead(ids, counts)
    bits, prior = idcoder.order0_bits(len(counts)), counts / counts.sum()
    for row in range(len(ids)):
        tables: tuple[dict, dict] = ({}, {})
        seen, f, last, before = np.zeros(len(counts), int), None, 0, 0
        for step, s in enumerate(ids[row].tolist()):
            if step == 0 or step in idcoder.REBUILDS:
                first, each = idcoder.order0(prior, bits, step)
                f = first + each * seen
                f[-1] += (1 << bits) - f.sum()
            want = 0
            at = last % idcoder.TABLE, (last * 2_654_435_761 + before * 40_503 >> 7) % idcoder.TABLE
            for order in range(2):
                expected, sure = tables[order].get(at[order], (None, 0))
                met = expected == s
                want |= (met + 2 * sure) << 3 * order
                tables[order][at[order]] = s, 1 + met * min(sure, 2)
            assert (said[row, step], freq[row, step], below[row, step]) == (want, f[s], f[:s].sum())
            seen[s] += 1
            last, before = s, last


def test_known_ids_are_not_coded_like_unknown_ones():
    """What is known beforehand is worked out over whole arrays: encoding took as long as decoding, where each id waits for the one before."""
    places, counts = drawn(200 * idcoder.BLOCK + 100, 2000)

    def least(fn, *args):
        took = []
        for _ in range(3):
            start = time.process_time()
            out = fn(*args)
            took.append(time.process_time() - start)
        return min(took), out

    encode, words = least(idcoder.encode_blocks, places, counts)
    decode, back = least(idcoder.decode_blocks, words, len(places), counts)
    assert (back == places).all()
    assert encode < 0.7 * decode


def test_blocks_of_a_long_document_are_coded_in_parts(monkeypatch):
    """More blocks than are coded in step give the same words."""
    places, counts = drawn(7 * 256 + 30, 50)
    words = idcoder.encode_blocks(places, counts, 256)
    monkeypatch.setattr(idcoder, "LANES", 3)
    assert [w.tolist() for w in idcoder.encode_blocks(places, counts, 256)] == [w.tolist() for w in words]
    assert (idcoder.decode_blocks(words, len(places), counts, 256) == places).all()


def test_texts_without_words():
    c = coder("word_bpe_49k.json")
    for texts in ([], [""], ["", " \n ", ""], ["", "a", "", "b c", ""]):
        assert c.encode_all(pa.array(texts, pa.string())) == [c.whole(t) for t in texts]
