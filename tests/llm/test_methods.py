"""The methods by themselves: fuzzed against libraries and brute force, round trips, held-out accuracy."""

import random
import re

import numpy as np
import public_tokenizers
import pytest

from tests.llm.conftest import prose
from tidemark.llm import idcoder, linededup, packing, pii, simhash, spm, toxicity, warc
from tidemark.llm.tokens import Coder

BITS = ["a", "b", "the", " ", "  ", "\n", "é", "'s", "'ll", "S", "1", "23", "!", "日本", "́", "\t", "İ", "ß", "Σ", " ", "\x1c", "<|endoftext|>", "ﬁ", "🙂", "tion", "http://", "　"]


def texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 10))) for _ in range(n)] + [prose(seed, 300)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_parts_give_the_ids_of_whole_texts(name):
    c = Coder(name)
    for t in texts(3000, 1):
        assert np.frombuffer(c.encode(t), "<u4").tolist() == c.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_shortest_paths_are_the_models_ids():
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    t = spm.transducer("piece_bpe_32k.model")
    for x in texts(3000, 2):
        ids = np.frombuffer(t.encode(x), "<u4").tolist()
        assert ids == model.encode(x), repr(x)
        assert t.decode(ids) == x
    rng = random.Random(3)
    pieces = rng.sample([p for p in t.arcs if len(p) > 1], 300)
    for a, b in zip(pieces, pieces[1:]):
        assert t.stable(a, b) == (t.history(a + b)[0] == f"{a} {b}")


@pytest.mark.parametrize("n, kinds", [(1, 1), (4096, 3), (4097, 50), (30_000, 70_000), (13_000, 2)])
def test_blocks_round_trip_and_stand_alone(n, kinds):
    ids = (np.random.default_rng(n).zipf(1.4, n) % kinds).astype(np.uint32)
    alphabet, counts, places = idcoder.in_alphabet(ids)
    words = idcoder.encode_blocks(places, counts.astype(float))
    assert (alphabet[idcoder.decode_blocks(words, n, counts.astype(float))] == ids).all()
    last = (n - 1) // idcoder.BLOCK
    for i in {0, last}:
        part = ids[i * idcoder.BLOCK:(i + 1) * idcoder.BLOCK]
        assert (alphabet[idcoder.decode_blocks(words[i:i + 1], len(part), counts.astype(float))] == part).all()


def plain_spans(t: str) -> list[tuple[int, int, int]]:
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        if 13 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(5)
    bits = ["a", "1", "2", "255", "300", ".", "@", "-", " ", "+", "(", ")", "b.c", "_", "é", "9" * 13, "4111111111111111", "00", "x@y.z"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_random_field_finds_held_out_spans():
    rng = random.Random(6)

    def window(i):
        d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
        thing = [f"{prose(i, 1).split()[0]}.{d(2)}@mail{d(1)}.example.com", f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 255)}", "4111111111111111", f"+1 ({d(3)}) 555-{d(4)}", f"{d(1)}.{d(1)}", d(12)][i % 6]
        return f"{prose(i, 3)} {thing} {prose(i + 1, 3)}".replace("\n", " ")
    sample = [(w, pii.base_spans(w)) for w in map(window, range(300))]
    model = pii.fit([*sample, *(pii.rewritten(w, s, i) for i, (w, s) in enumerate(sample) if s)], rounds=3)
    found = wanted = extra = 0
    for i in range(300, 420):
        w = window(i)
        base = pii.base_spans(w)
        extra += len(set(pii.spans_of(w, model)[1]) - set(base))
        new, marks = pii.rewritten(w, base, i)
        wanted += len(marks)
        found += len(set(marks) & set(pii.spans_of(new, model)[1]))
    assert found >= 0.9 * wanted and extra <= 2


def test_severity_on_held_out_rows():
    rng = np.random.default_rng(7)
    words = [b"plain%d" % i for i in range(400)]
    bad, worse = [b"rude%d" % i for i in range(6)], [b"vile%d" % i for i in range(6)]

    def row(g):
        w = list(rng.choice(words, 60))
        return b" ".join(w + (list(rng.choice(bad, 3)) if g else []) + (list(rng.choice(worse, 3)) if g > 1 else []))
    grades = np.arange(900) % 3
    feats = [np.array(toxicity.features(row(g))) for g in grades]
    m = toxicity.fit(feats[:600], grades[:600])
    assert (np.diff(m.thresholds) >= 0).all()
    sev = np.array([m.severity(sum(m.weights.get(int(p), 0.0) for p in f)) for f in feats[600:]])
    assert np.mean(np.rint(sev) == grades[600:]) > 0.93
    assert toxicity.fit(feats[:3], np.zeros(3, int)).severity(1.0) == 0.0


def test_linked_fingerprints_meet_at_an_anchor():
    rng = random.Random(8)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            b ^= 1 << bit
        met = False
        for half in (0, 32):
            pair = np.array([a >> half & 0xFFFFFFFF, b >> half & 0xFFFFFFFF], np.uint64)
            found, n = simhash.anchors(pair)
            met |= found[0][0] in found[1][:n[1]] and found[1][0] in found[0][:n[0]]
        assert met
    words = np.array([rng.getrandbits(31) for _ in range(300)], np.uint64)
    found, n = simhash.anchors(words)
    dist = np.bitwise_count(found ^ words[:, None])
    assert (dist[:, 0] <= 1).all() and (dist <= 2).all() and all(len(set(f[:k])) == k for f, k in zip(found.tolist(), n))


def test_forest_connects_what_links_connect():
    rng = random.Random(9)
    fps = list({rng.getrandbits(64) & 0xFF0F for _ in range(200)})
    edges = simhash.forest(np.array(fps, np.int64), 3)
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)

    def groups(pairs):
        par = {f: f for f in fps}

        def find(x):
            while par[x] != x:
                x = par[x]
            return x
        for a, b in pairs:
            par[find(a)] = find(b)
        return {frozenset(g for g in fps if find(g) == find(f)) for f in fps}
    assert groups(edges) == groups((a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3)


def test_loser_tree_merges():
    rng = random.Random(10)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        assert [runs[r][i] for r, i in warc.LoserTree(runs)] == sorted(x for r in runs for x in r)


def test_patience_aligns_equal_lines_in_order():
    rng = random.Random(11)
    for _ in range(300):
        a, b = ([rng.randint(1, 12) for _ in range(rng.randint(0, 20))] for _ in range(2))
        pairs = linededup.patience(a, b)
        assert all(a[x] == b[y] for x, y in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    block = list(range(100, 110))
    assert linededup.common_lines([1, 2, *block, 3], [*block[:5], 7, 8, *block[5:]], [3] * 12, 12) == [0, 1, 2, 3, 4, 7, 8, 9, 10, 11]


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(1024, 1024, 1 << 20), (1024, 3, 1 << 20), (1024, 1024, 300_000)])
def test_bins_keep_every_capacity(score, capacity):
    lengths = np.sort(np.random.default_rng(12).integers(1, 500, 600))[::-1]
    bins, offsets = packing.best_fit(lengths, capacity, score=score)
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert own.sum() <= capacity[0] and len(own) <= capacity[1] and (own.astype(float) ** 2).sum() <= capacity[2]
        assert sorted(offsets[bins == b].tolist()) == [0, *np.cumsum(own[np.argsort(offsets[bins == b])])[:-1].tolist()]
    if capacity == (1024, 1024, 1 << 20):
        assert len(set(bins.tolist())) <= -(-int(lengths.sum()) // 1024) + 1
