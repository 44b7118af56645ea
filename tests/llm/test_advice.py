
import random

import pytest

from tests.llm.conftest import DOC, prose
from tidemark.llm import linededup, pii, simhash


def test_near_copies_of_the_stage_are_those_of_all_pairs(spark):
    rng = random.Random(20)
    word = lambda: f"w{rng.randint(0, 5000)}"
    docs = []
    for i in range(30):
        base = [word() for _ in range(rng.randint(60, 200))]
        for j in range(4):
            new = list(base)
            for k in rng.sample(range(len(base)), rng.randint(0, 4) if j else 0):
                new[k] = word()
            docs.append((len(docs), " ".join(new), "en", "s", 1))
    sets = [set(simhash.shingle_set(d[1].encode()).tolist()) for d in docs]
    near = [(a, b) for b in range(len(docs)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    far = [p for p in near if (simhash.simhash(docs[p[0]][1].encode()) ^ simhash.simhash(docs[p[1]][1].encode())).bit_count() > 3]
    assert len(far) > 20        # pairs that op9's setting does not link
    par = list(range(len(docs)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for a, b in near:
        x, y = sorted((find(a), find(b)))
        par[y] = x
    left = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(docs, DOC)).collect()}
    assert left == {find(i) for i in range(len(docs))}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(21)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    things = [lambda: f"{rng.choice(['ann', 'bob', 'carol', 'dave'])}@{rng.choice(['mail', 'post', 'example'])}.{rng.choice(['com', 'org'])}", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), lambda: f"+1 ({d(3)}) 555-{d(4)}", lambda: d(2)]
    sample = []
    for i in range(400):
        w = " ".join([*prose(i, rng.randint(0, 2)).split(), *(things[(i + k) % 4]() for k in range(rng.randint(1, 3))), *prose(i + 1, rng.randint(0, 2)).split()])
        sample.append((w, pii.base_spans(w)))
    return pii.fit([*sample, *(pii.rewritten(w, s, i) for i, (w, s) in enumerate(sample) if s)], rounds=4)


@pytest.mark.parametrize("text", ["24 bob (at) example.com now", "alice@x.com bob (at) example.com", "bob (at) example.com carol (at) example.org"])
def test_an_entity_right_after_a_trigger_lies_in_a_window(text, model):
    assert list(pii.windows(text)) == [(0, len(text))]
    at = text.index("example")
    end = len(text.removesuffix(" now"))
    last = max(at, text.rfind("example"))
    assert any(k == 0 and a <= last < b == end for k, a, b in pii.spans_of(text, model)[1])


def test_long_windows_are_decoded_as_one(model):
    rng = random.Random(22)
    filler = lambda n: [str(rng.randint(10, 99)) for _ in range(n)]
    for at in range(pii.WINDOW - 8, pii.WINDOW + 2, 3):
        text = " ".join([*filler(at), "mail bob (at) example.com now", *filler(500)])
        assert len(list(pii.windows(text))) == 1
        atoms, segs, feats = pii.segments(text)
        whole = pii.decode(len(atoms), [(len(atoms), segs, pii.scores(model, feats))])
        assert pii.entities(text, model) == [(k, atoms[i][0], atoms[j - 1][1]) for i, j, k in whole]
        start = text.index("bob")
        assert (0, start, start + len("bob (at) example.com")) in pii.spans_of(text, model)[1]


def test_a_block_of_frequent_lines_meets_its_first_holder(spark):
    a, b = "a line of six common words", "another line of exactly seven common words"
    own = lambda i: f"only document {i} has this line of its own words, twelve or more"
    docs = [(i, "\n".join([own(i), a if i % 2 else b, own(i + 100)]), "en", "s", 1) for i in range(12)]
    docs += [(i, "\n".join([own(i), a, b, own(i + 100)]), "en", "s", 1) for i in (20, 21)]
    got = {r.doc_id: r.n_deleted for r in linededup.align_lines(spark.createDataFrame(docs, DOC), keep=["doc_id"]).select("doc.doc_id", "n_deleted").collect()}
    assert got == {i: 2 * (i == 21) for i in got}


def test_run_keys_cover_every_line_of_a_block():
    rng = random.Random(23)
    for _ in range(300):
        n = rng.randint(1, 12)
        words = [rng.choice([0, 1, 3, 5, 7, 12, 15]) for _ in range(n)]
        hashes = [i + 1 if w else 0 for i, w in enumerate(words)]
        lines = [(h, w) for h, w in zip(hashes, words) if w]
        # a block on its own has the run keys that a document around it has; every line of it lies in a keyed run
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                block = lines[i:j]
                if sum(w for _, w in block) < 12:
                    continue
                outer = set(linededup.run_keys(hashes, words, set(hashes) - {0}, 12))
                assert set(linededup.run_keys([h for h, _ in block], [w for _, w in block], {h for h, _ in block}, 12)) <= outer
                spans = [(p, q) for p in range(len(block)) for q in range(p + 1, len(block) + 1) if sum(w for _, w in block[p:q]) >= 12 > min(sum(w for _, w in block[p:q - 1]), sum(w for _, w in block[p + 1:q]))]
                own = linededup.run_keys([h for h, _ in block], [w for _, w in block], {h for h, _ in block}, 12)
                assert len(own) == len(spans) and {x for p, q in spans for x in range(p, q)} == set(range(len(block)))


def test_a_passage_that_one_side_repeats_is_aligned_once():
    passage = [101, 102, 103]
    for early, late in (([1, *passage, 2], [3, *passage, 4, *passage, 5]), ([1, *passage, 6, *passage, 2], [3, *passage, 4]), ([1, *passage, 102, 2], [3, 103, 101, *passage, 4, 5])):
        got = linededup.common_lines(early, late, [5] * len(late), 12)
        assert len(got) == 3 and [late[i] for i in got] == passage, (early, late)
    # edges in the range between anchors, and lines without words inside the passage
    assert linededup.common_lines([50, 1, *passage, 2, 60], [50, 3, 101, 0, 102, 103, 4, *passage, 5, 60], [5, 5, 5, 0, 5, 5, 5, 5, 5, 5, 5, 5], 12) in ([2, 4, 5], [7, 8, 9])


def test_heaviest_run_is_that_of_all_runs():
    rng = random.Random(24)
    for _ in range(2000):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        weight = [0, *(rng.randint(1, 9) for _ in range(4))]
        words = [weight[x] for x in b]
        got, p, q, n = linededup.heaviest_run(a, b, words)
        assert a[p:p + n] == b[q:q + n] and sum(words[q:q + n]) == got
        assert got == max([sum(words[k:k + m]) for i in range(len(a)) for k in range(len(b)) for m in range(1, 13) if i + m <= len(a) and k + m <= len(b) and a[i:i + m] == b[k:k + m]], default=0)
