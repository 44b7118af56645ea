"""The whitening, the repair of conversations and the licence scan against brute force, on odd tables and in parts."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import repair, whitening
from tidemark.llm.common import QUERIES
import tidemark.llm.queries  # noqa: F401


# --- whitening -----------------------------------------------------------------------------

def spectrum(kind: str, d: int, rng) -> np.ndarray:
    return {"spread": rng.random(d) * 10, "tripled": np.repeat(rng.random(d // 3 + 1) + 1, 3)[:d], "low rank": np.r_[rng.random(5), np.zeros(d)][:d],
            "clustered": 1 + 1e-9 * rng.random(d), "equal": np.ones(d), "steep": 10.0 ** -np.arange(d)}[kind]


@pytest.mark.parametrize("kind, d", [("spread", 64), ("spread", 1), ("spread", 2), ("tripled", 30), ("low rank", 40), ("clustered", 40), ("equal", 30), ("steep", 12)])
def test_eigenpairs(kind, d):
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = (q * spectrum(kind, d, rng)) @ q.T
    v = (v + v.T) / 2
    want = np.linalg.eigvalsh(v)[::-1]
    e, u = whitening.leading_eigenpairs(v, 16)
    assert len(e) == min(16, (want > 1e-12 * want[0]).sum())
    assert np.abs(e - want[:len(e)]).max() < 1e-13 * want[0]
    assert np.abs(v @ u - u * e).max() < 1e-13 * want[0] and np.abs(u.T @ u - np.eye(len(e))).max() < 1e-13


def test_counts_of_inertia():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 7, 20):
        for _ in range(30):
            v = rng.integers(-3, 4, (n, n)).astype(float)
            v = v + v.T
            s = rng.random() * 4 - 2
            assert whitening.count_above(v, s) == (np.linalg.eigvalsh(v) > s).sum()


def brute_whitening(rows):
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in good]
    by = {}
    for _, v in x:
        by.setdefault(len(v), set()).add(v)
    if not by:
        return [], None, None
    length = max(by, key=lambda k: (len(by[k]), k))
    fit = np.array(sorted(by[length]), dtype=object)
    n, s = len(fit), fit.sum(0)
    y = np.array([[float(a * n - b) / n for a, b in zip(r, s)] for r in fit])
    v = y.T @ y / n
    return [(i, n, sum((n * a - b) ** 2 for a, b in zip(r, s)), np.array([float(a * n - b) / n for a, b in zip(r, s)])) for i, r in x if len(r) == length], v, n


def check_whitening(got, rows, k=16):
    want, v, n = brute_whitening(rows)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > 1e-12 * e[0]).sum()) if e[0] > 0 else 0)
    assert len(got) == k * len(want)
    by = {}
    for r in got:
        assert r.n == n and abs(r.explained / (e[r.component - 1] / np.trace(v)) - 1) < 1e-4 and r.identity_error <= 1e-4
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    sign = {}
    for i, _, d, y in want:
        mine = by[i, d if d < 2 ** 63 else None]
        for c in range(1, k + 1):
            w = y @ u[:, c - 1] / math.sqrt(e[c - 1])
            close = [x for x in mine[c] if abs(abs(x) - abs(w)) < 1e-6 * (1 + abs(w))]
            assert close
            if len(mine[c]) == 1 and abs(w) > 1e-3:
                assert sign.setdefault(c, np.sign(w * close[0])) == np.sign(w * close[0])


def test_whole_whitening(spark, odd):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{odd}/embeddings.parquet").collect()]
    check_whitening(QUERIES["op11_feast_whitening"](spark, odd).collect(), rows)


@pytest.mark.parametrize("rows", [[(1, [1.0, 2.0])] * 3, [(1, [1e30, -1e30, 0.5]), (2, [0.0, 1.0, 0.25]), (3, [5.0, 1e12, 0.0])], [(1, []), (2, None)], [(1, [3.0]), (None, [4.5]), (2, [9.0])]])
def test_whitening_of_few(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    v = df.select("vec_id", whitening.whole_numbers(df.embedding).alias("x"))
    got = whitening.whiten(v, whitening.fit(v), "vec_id").collect()
    if len({tuple(x) for _, x in rows if x}) < 2:
        assert got == []
    else:
        assert {r.vec_id for r in got} == {i for i, x in rows} and all(r.identity_error < 1e-4 for r in got)
        assert all(r.deviation is None for r in got) == (rows[0][1][0] == 1e30)


# --- conversations -------------------------------------------------------------------------

GRAMMAR = re.compile(r"(s?(ua)+)?")


def fault_of(row, before):
    role, text = row
    body = re.sub(r"[\x20\x09-\x0D]+", "", text)
    return "blank" if not body else "duplicate" if row in before else "truncated" if body[-1] not in ".!?" else ""


def brute_repair(rows):
    """(cost, audit, repaired) by trying everything: a table of the least (cost, audit) per output, kept by its last initials."""
    faults = [fault_of(r, rows[:i]) for i, r in enumerate(rows)]
    best = {"": (0, "", [])}            # what is put out so far -> (cost, audit, lines); outputs that the grammar treats alike are merged

    def shape(out):
        return out if len(out) < 2 else "ua" + ("u" if out.count("u") > out.count("a") else "")

    def put(into, out, item):
        viable = re.fullmatch(r"s?(ua)*u?", out)
        if viable and (shape(out) not in into or item[:2] < into[shape(out)][:2]):
            into[shape(out)] = item

    def inserted(table):
        for _ in range(3):
            grown = dict(table)
            for out, (c, a, lines) in table.items():
                for role in ("user", "assistant"):
                    put(grown, out + role[0], (c + 5, a + "I", lines + [role + ":"]))
            table = grown
        return table

    for (role, text), f in zip(rows, faults):
        now = {}
        for out, (c, a, lines) in inserted(best).items():
            put(now, out, (c + 2, a + "D", lines))
            if f not in ("blank", "duplicate"):
                extra = 5 if f == "truncated" else 0
                put(now, out + role[:1], (c + extra, a + "K", lines + [f"{role}:{text}"]))
                for new in ("user", "assistant"):
                    put(now, out + new[0], (c + extra + 1, a + "R", lines + [f"{new}:{text}"]))
        best = now
    done = [v for out, v in inserted(best).items() if GRAMMAR.fullmatch(out)]
    return min(done, key=lambda v: v[:2])


def conversation(rng, n):
    out = []
    for i in range(n):
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", " "])
        out.append((role, rng.choice([f"Text {i}.", f"Text {i}.", f"cut {i}", " \t", "Same!", "x? "])))
    return out


def test_edits_against_everything():
    rng = random.Random(5)
    for trial in range(300):
        rows = conversation(rng, rng.randrange(0, 9))
        block = repair.Block()
        seen = set()
        for i, r in enumerate(rows):
            block.add(i, *r, r in seen)
            seen.add(r)
        cost, audit = repair.solve(block.marks)
        want = brute_repair(rows)
        assert (cost, audit) == want[:2], rows
        assert repair.render(audit, rows, repair.NOTHING)[0] == want[2]


def test_brute_force_is_exhaustive():
    """The table above against an enumeration of all edit sequences of short conversations."""
    rng = random.Random(6)
    for _ in range(40):
        rows = conversation(rng, rng.randrange(0, 4))
        faults = [fault_of(r, rows[:i]) for i, r in enumerate(rows)]
        best = None
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            for ops in itertools.product("DKua", repeat=len(rows)):
                out, audit, cost = gaps[0], "I" * len(gaps[0]), 5 * len(gaps[0])
                for (role, _), f, op, gap in zip(rows, faults, ops, gaps[1:]):
                    if op != "D" and f in ("blank", "duplicate"):
                        break
                    cost += 2 if op == "D" else (op != "K") + 5 * (f == "truncated")
                    audit += op if op in "DK" else "R"
                    out += "" if op == "D" else role[:1] if op == "K" else op
                    out, audit, cost = out + gap, audit + "I" * len(gap), cost + 5 * len(gap)
                else:
                    if GRAMMAR.fullmatch(out) and (best is None or (cost, audit) < best):
                        best = (cost, audit)
        assert brute_repair(rows)[:2] == best


def check_repair(got, damaged, ids):
    by = {}
    for c, t, role, text in damaged:
        by.setdefault(c, []).append((t is not None, t if t is not None else 0, role, text))
    assert sorted((r.conv_id for r in got), key=repr) == sorted(ids, key=repr)
    for r in got:
        ordered = sorted(by.get(r.conv_id, []))
        rows = [(x[2], x[3]) for x in ordered]
        faults = [fault_of(x, rows[:i]) for i, x in enumerate(rows)]
        turns = [x[1] for x in ordered if x[0]]
        cost, audit, lines = brute_repair(rows)
        initials = [x[0][:1] for x in rows]
        assert (r.blank, r.duplicate, r.truncated) == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        assert (r.cost, r.audit) == (cost, audit), r.conv_id
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(c, t, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    return out


def test_whole_repair(spark, odd):
    rows = [tuple(r)[:4] for r in spark.read.parquet(f"{odd}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_repair(QUERIES["op12_conversation_repair"](spark, odd).collect(), brute_damage(rows), {r[0] for r in rows})


@pytest.mark.parametrize("block, fan", [(1, 2), (3, 2), (5, 4)])
def test_long_conversations_in_blocks(spark, block, fan):
    """Small blocks: every conversation spans several, and tasks."""
    rng = random.Random(block)
    rows = [(c, i // 2 if c == 3 else i, *r) for c in range(6) for i, r in enumerate(conversation(rng, (0, 1, 7, 30, 60, 11)[c]))]
    df = spark.createDataFrame([(*r, False) for r in rows] + [(0, 1, "user", "", True)], "conv_id bigint, turn bigint, role string, text string, gone boolean")
    check_repair(repair.repair(df, block=block, fan=fan).collect(), rows, set(range(6)))


# --- licences ------------------------------------------------------------------------------

FILES = {
    1: "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files",
    2: "Permission is hereby granted, free of charge, kindly, to any nice person obtaining a copy of this Software and associated documentation files",     # words put in
    3: "Permission is hereby granted free of charge; see the documentation and its associated files, to any person",                                        # no key phrase
    4: "associated documentation files " + "x " * 50 + "permission hereby granted charge person obtaining",                                                   # far from its place
    5: "This is free and unencumbered software released into the public domain. Licensed under CC BY-SA 4.0",
    6: "Released under the MIT License. Licensed under the Apache License, Version 2.0!",
    7: "GENERAL public licence", 8: None, 9: "\u00c9mit license", 10: "general public\u00a0license", 11: "MIT \u212aicense mit license"}


def test_licences_found_by_their_words(spark):
    from tidemark.llm import licenses
    rows = [*FILES.items(), *((20 + i, "any copy of the files is free to use for the person of charge") for i in range(5))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: got[i].labels for i in FILES} == {1: "mit", 2: "mit", 3: "", 4: "", 5: "cc-by-sa,unlicense", 6: "apache,mit", 7: "", 8: "", 9: "", 10: "", 11: "mit"}
    assert got[1].score == 1 and got[2].score >= 0.6 and got[4].score == 0 and got[8].n_words == 0 and got[1].base_labels == ""
    assert (got[6].n_base, got[6].first_word, got[6].last_word, got[6].base_labels) == (2, 3, 8, "apache,mit")
    assert (got[9].n_words, got[11].first_word) == (2, 2) and all(got[i].labels == "" for i in range(20, 25))


def test_base_places(spark, odd):
    got = {r.doc_id: r for r in QUERIES["op13_license_index"](spark, odd).collect()}
    for r in spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        at = [i for p in ("mit license", "apache license", "general public license") for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        if r.doc_id is not None:
            g = got[r.doc_id]
            assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
    assert got[85].labels == "cc-by-nc" and got[84].n_base == 304 and got[84].base_labels == "apache,gpl,mit"


# --- neighbours of any ids, near copies in blocks ----------------------------------------------

@pytest.mark.parametrize("ids", [[0, 1, 9 * 10 ** 18], [-9 * 10 ** 18, 5, 9 * 10 ** 18], [17 * 10 ** 17 + 31 * i for i in range(50)] + [1], list(range(200)) + [2 ** 63 - 1], [-(2 ** 63), 2 ** 63 - 1],
                                 [7] * 40 + [3, 9], [], [None, None, 4], [i ** 9 for i in range(60)]])
def test_neighbours_of_any_ids(spark, ids):
    """With ranges of three rows: every row meets the next one in falling order, the last one the first."""
    from pyspark.sql import functions as F

    from tidemark.llm import fingerprint
    rows = [(d, f"t{i:03d}") for i, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    ranged = fingerprint.in_ranges(df, "doc_id", ["text"], 3)
    got = fingerprint.with_next(ranged, "doc_id", ["text"], ["text"]).collect()
    known = sorted((r for r in rows if r[0] is not None), reverse=True)
    want = {a[1]: b[1] for a, b in zip(known, known[1:])}
    assert sorted(r.text for r in got) == sorted(t for _, t in rows)
    assert {t: n for t, n in ((r.text, r.next_text) for r in got) if t in want} == want
    follow = {r.text: r.next_text for r in got}
    seen, at = set(), known[0][1] if known else None
    while at is not None and at not in seen:
        seen.add(at)
        at = follow[at]
    assert len(seen) == len(rows) or not known
    crowded = ranged.filter("NOT guest").groupBy("range_no").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("k")).filter("n > 12 AND k > 1")
    assert crowded.count() == 0


def test_next_texts_on_the_odd_table(spark, odd):
    """op8 against its SQL, the row after the last one included; ids that are missing or repeated have no one neighbour there."""
    import duckdb

    from tidemark.llm.common import SQL
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, min(text) AS text FROM read_parquet('{odd}/documents.parquet/*.parquet') WHERE doc_id IS NOT NULL GROUP BY doc_id")
    con.execute("CREATE TABLE given AS SELECT * FROM documents")
    want = con.execute(SQL["op8_document_fingerprints"]).fetchall()
    from tidemark.llm import fingerprint
    import tempfile
    folder = tempfile.mkdtemp(prefix="run-")
    con.execute(f"COPY given TO '{folder}/documents.parquet' (FORMAT parquet)")
    got = QUERIES["op8_document_fingerprints"](spark, folder).collect()
    assert fingerprint.WORDS == 5 and sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("block", [2, 7, 512])
def test_near_sets_in_blocks(spark, block):
    """A band that holds several groups and chains of near sets: the blocks connect just what all pairs do."""
    from tidemark.llm import simhash
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(-2 ** 62, 2 ** 62, 120)) for _ in range(4)]
    sets, now = [], None
    for i in range(40):
        now = base[i % 4].copy() if i < 8 else sets[i - 4].copy()
        now[rng.integers(0, len(now), 3)] = rng.integers(-2 ** 62, 2 ** 62, 3)
        sets.append(np.unique(now))
    frame = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "node bigint, hashes array<bigint>")
    left = spark.createDataFrame([(k, i, i if i % 5 else 0) for k in (1, 2) for i in range(40) if (i + k) % 9], "key bigint, node bigint, root bigint")
    edges = [(r.a, r.b) for r in simhash.met_in_blocks(left, frame, block).collect()]
    assert all(simhash.near(sets[a], sets[b]) for a, b in edges)

    def classes(links):
        par = list(range(40))

        def find(x):
            while par[x] != x:
                x = par[x]
            return x
        for a, b in links:
            par[find(a)] = find(b)
        return [{i for i in range(40) if find(i) == find(j)} for j in range(40)]
    members = {k: [i for i in range(40) if (i + k) % 9] for k in (1, 2)}
    known = [(0, i) for i in range(0, 40, 5)]
    assert classes(edges + known) == classes([(a, b) for k in (1, 2) for a in members[k] for b in members[k] if simhash.near(sets[a], sets[b])] + known)


# --- shortest paths ---------------------------------------------------------------------------

def test_least_path_counts():
    """Weights compete: the first arc into a place is not the best one, nor the longest."""
    from tidemark.llm import spm
    rng = random.Random(4)
    weight = {"".join(x): rng.uniform(0.5, 9) for k in (1, 2, 3) for x in itertools.product("ab", repeat=k)}
    lattice = spm.Lattice(weight)

    def ways(s):
        return [[]] if not s else [[s[:k], *rest] for k in (1, 2, 3) if s[:k] in weight and len(s) >= k for rest in ways(s[k:])]
    for _ in range(60):
        s = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 11)))
        assert lattice.shortest(s) == min(ways(s), key=lambda w: sum(weight[p] for p in w))
    assert lattice.shortest("aéb")[1] == "é" and lattice.shortest("") == []
    assert spm.Lattice({"a": 1.0, "b": 1.0, "ab": 5.0, "abb": 2.5}).shortest("abbab") == ["abb", "a", "b"]


def varint(x):
    return bytes([x]) if x < 128 else bytes([x & 127 | 128]) + varint(x >> 7)


def field(n, value):
    return varint(n << 3) + varint(value) if isinstance(value, int) else varint(n << 3 | 2) + varint(len(value)) + value


def test_specification_of_a_model():
    from tidemark.llm import spm
    plain = field(3, 1) + field(4, 0) + field(5, 1)
    piece = field(1, b"a") + varint(2 << 3 | 5) + b"\0\0\0\0"
    assert spm.specification(field(1, piece) + field(2, field(3, 2)) + field(3, plain)) == (spm.MERGES, True)
    assert spm.specification(field(2, b"") + field(3, field(3, 0) + field(4, 0))) == (spm.UNIGRAM, False)
    for bad, why in ((field(3, plain + field(2, b"map")), "map"), (field(3, field(3, 1)), "blanks"), (field(3, field(4, 0) + field(5, 0)), "spaces"), (field(1, piece + field(3, 4)) + field(3, plain), "user"), (field(2, field(3, 3)) + field(3, plain), "merging")):
        with pytest.raises(ValueError, match=why):
            spm.specification(bad)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_strings_of_added_tokens(name):
    """Ids equal a fresh library's plain call, whatever stands around such a string."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm.tokens import Coder
    fresh, mine = Tokenizer.from_file(public_tokenizers.path(name)), Coder(name)
    for t in ("see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|>b", "<|EndOfText|> x", "<|startoftext|><|endoftext|>", "< |endoftext|>", "x <|endoftext| > y", "é <|endoftext|>\n  z"):
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == fresh.encode(t, add_special_tokens=False).ids, t


def test_large_pages_go_into_small_files(spark, tmp_path):
    from tidemark.llm import warc
    pages = spark.range(0, 30, 1, 1).selectExpr("id AS page_id", "concat('http://h.example/', id) AS url", "repeat(concat('p', id % 10), if(id < 10, 2500000, 50)) AS html")
    warc.write_archives(pages, f"{tmp_path}/w")
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("part-*")]
    assert max(sizes) < warc.FILE_BYTES + 10_000_000 and sum(sizes) > 50_000_000
    index = warc.merge_runs(warc.capture_runs(spark, f"{tmp_path}/w")).collect()
    assert sorted(r.page_id for r in index) == list(range(30)) and {r.payload_bytes for r in index if r.page_id < 10} == {5_000_000} and [r.place for r in sorted(index, key=lambda r: r.url_key)] == list(range(30))


@pytest.mark.parametrize("capacity, score", [((100, 100, 10_000), "norm"), ((100, 4, 10_000), "norm"), ((100, 100, 4_000), "norm"), ((100, 5, 5_000), "dot"), ((1024, 1024, 1024 * 1024), "norm")])
def test_bins_are_those_of_a_plain_search(capacity, score):
    """Every piece goes where a search over all bins ever opened would put it (same score; the bins' numbers may differ among equals)."""
    from tidemark.llm import packing
    rng = np.random.default_rng(sum(capacity))
    limit = min(capacity[0], int(capacity[2] ** 0.5))
    lengths = np.sort(rng.integers(1, limit + 1, 400))[::-1].astype(np.int64)
    weights, cap = (1.0, 0.05, 0.2), np.array(capacity, float)
    bins, offsets = packing.best_fit(lengths, capacity, weights, score)
    left: dict[int, np.ndarray] = {}
    for x, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        need = np.array([x, 1.0, float(x) * x])

        def value(room):
            share, d, w = room / cap, need / cap, np.array(weights)
            return -(w * share * d).sum() if score == "dot" else (w * (share - d) ** 2).sum()
        fitting = {i: value(room) for i, room in left.items() if (room >= need).all()}
        if b in left:
            assert b in fitting and fitting[b] <= min(fitting.values()) + 1e-12
        else:
            assert not fitting
        room = left.get(b, cap.copy())
        assert o == int(cap[0] - room[0])
        left[b] = room - need
        assert (left[b] >= 0).all()
