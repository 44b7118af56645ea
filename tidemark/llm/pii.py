"""Personal data by a semi-Markov conditional random field over text segments, beside fixed patterns.

The patterns (email, ip, card, phone) give the base spans. The model scores whole segments: features of the span's shape, digit groups, checksum and neighbouring words vote for a
kind, and dynamic programming over segments of at most LONGEST atoms finds the best cut of a window into entities and single outside atoms, boundaries and kinds together. What it
finds besides the base spans is added if it overlaps none of them.

An atom is a run of letters or digits, or one other character that is no white space. Only windows around a character that an entity of a kind needs (a digit, @ or a spelled-out
at) can hold one, so that the rest of a text is passed over. The model is trained here: windows of the corpus labelled by the patterns, and copies of them with entities rewritten
in ways the patterns do not know (no country code, spelled-out at, brackets or other separators). At most SAMPLE windows, those with the smallest hashes, are drawn from the whole table.

A null text is empty. Equal texts give equal spans. A corpus without any entity trains nothing and adds nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fields, map_texts, query, table

KINDS = ("email", "ip", "card", "phone")
LONGEST = 24            # atoms of a segment
AROUND = 2              # words of context on either side of a window
SAMPLE = 1200           # windows a model is trained on
ROUNDS = 6
FEATURES = 1 << 14
WINDOW = 400            # atoms of a window whose segments are held at once; longer windows are not trained on

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9]+|@|[\[({]\s?at\s?[\])}]", re.I)
ATOM = re.compile(r"[^\W\d_]+|[0-9]+|\S")
NEEDED = b"0123456789@([{"


def luhn(digits: str) -> bool:
    d = [int(x) for x in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost local@domain spans; each @ is looked at once, outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1)
        if start < at and m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, by kind and start."""
    out = [(0, *x) for x in emails(text)]
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((2, *m.span()))
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text around what an entity needs, with some words of context; stretches that touch are one."""
    start = end = -1
    for m in TRIGGER.finditer(text):
        a, b = m.start(), m.end()
        for _ in range(AROUND + 1 if a >= end else 0):
            a = max(text.rfind(" ", 0, max(a - 1, 0)), text.rfind("\n", 0, max(a - 1, 0)), 0)
        for _ in range(AROUND + 1):
            stops = [x for x in (text.find(" ", b + 1, b + 200), text.find("\n", b + 1, b + 200)) if x >= 0]
            b = min(stops) if stops else min(b + 200, len(text))
        a = max(a, m.start() - 200)
        if start < 0:
            start, end = a, b
        elif a <= end:
            end = max(end, b)
        else:
            yield start, end
            start, end = a, b
    if start >= 0:
        yield start, end


def feature(name: str) -> int:
    return zlib.crc32(name.encode()) & (FEATURES - 1)


_SHAPES: dict[str, list[int]] = {}


def span_features(s: str) -> list[int]:
    """Features of a segment's own text."""
    known = _SHAPES.get(s)
    if known is not None:
        return known
    d = digits_of(s)
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", s))
    groups = re.findall(r"[0-9]+", s)
    names = ["bias", "shape=" + shape[:40], "kinds=" + "".join(sorted(set(shape)))[:20], f"digits={min(len(d), 20)}", "ends=" + shape[:1] + shape[-1:], "lengths=" + ",".join(str(min(len(g), 9)) for g in groups[:6]),
             f"groups={min(len(groups), 6)}", f"space={' ' in s}", f"words={min(len(re.findall('[^0-9 ]+', s)), 5)}"]
    if 13 <= len(d) <= 19 and "a" not in shape:
        names += [f"luhn={luhn(d)}"] * 2
    if len(groups) == 4 and "a" not in shape:
        names.append(f"octets={all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    if "@" in s or TRIGGER.search(s) and re.search(r"at", s, re.I):
        names.append(f"at, then dot={bool(re.search(r'(@|at).*([.]|dot)', s, re.I | re.S))}, end={shape[-2:]}")
    if len(_SHAPES) > 20_000:
        _SHAPES.clear()
    _SHAPES[s] = out = [feature(n) for n in names]
    return out


def atoms_of(text: str) -> tuple[list[tuple[int, int]], list[str], np.ndarray]:
    """Atoms of a window as (start, end); their texts; how many of the first n hold what an entity needs."""
    atoms = [m.span() for m in ATOM.finditer(text)]
    word = [text[a:b] for a, b in atoms]
    return atoms, word, np.cumsum([0, *(bool(TRIGGER.search(w)) or w.lower() == "at" for w in word)])


def candidates(text: str, atoms: list[tuple[int, int]], word: list[str], need: np.ndarray, after_atom: int, until: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Candidate segments as (first atom, last atom + 1), by last atom, of those that end in atoms after_atom + 1 to until; their features."""
    segs, feats = [], []
    for j in range(after_atom + 1, until + 1):
        if not word[j - 1][-1].isalnum():
            continue
        for i in range(max(0, j - LONGEST), j):
            if need[j] == need[i] or not (word[i][0].isalnum() or word[i] in "+("):
                continue
            before = word[i - 1].lower() if i else "^"
            after = word[j].lower() if j < len(word) else "$"
            glued = (i > 0 and atoms[i - 1][1] == atoms[i][0], j < len(word) and atoms[j - 1][1] == atoms[j][0])
            segs.append((i, j))
            feats.append([*span_features(text[atoms[i][0]:atoms[j - 1][1]]), feature("before=" + (before if glued[0] else "_")), feature("after=" + (after if glued[1] else "_"))])
    return segs, feats


def segments(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[list[int]]]:
    """Atoms of a window, all its candidate segments and their features."""
    atoms, word, need = atoms_of(text)
    return atoms, *candidates(text, atoms, word, need, 0, len(atoms))


def scores(weights: np.ndarray, feats: list[list[int]]) -> np.ndarray:
    """(segments, kinds) scores; an outside atom scores 0."""
    if not feats:
        return np.zeros((0, len(KINDS)))
    flat = np.concatenate([np.array(f) for f in feats])
    return np.add.reduceat(weights[flat], np.cumsum([0, *(len(f) for f in feats[:-1])]), axis=0)


def decode(n: int, parts: Iterable[tuple[int, list[tuple[int, int]], np.ndarray]]) -> list[tuple[int, int, int]]:
    """Best cut of n atoms: (first, end, kind) of its entities. A part is the number of atoms it ends at, the segments that end in it and their scores."""
    best, back = [0.0], [None]
    for until, segs, s in parts:
        kinds, tops = s.argmax(1).tolist() if len(s) else [], s.max(1).tolist() if len(s) else []
        at = 0
        for j in range(len(best), until + 1):
            best.append(best[-1])
            back.append(None)
            while at < len(segs) and segs[at][1] == j:
                i = segs[at][0]
                if best[i] + tops[at] > best[j]:
                    best[j], back[j] = best[i] + tops[at], (i, j, kinds[at])
                at += 1
    out, j = [], n
    while j > 0:
        if back[j]:
            out.append(back[j])
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def entities(text: str, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the entities of a window's best cut. Segments are made and scored for WINDOW last atoms at a time; the cut is one of the whole window."""
    atoms, word, need = atoms_of(text)

    def parts() -> Iterator[tuple[int, list[tuple[int, int]], np.ndarray]]:
        for n in range(0, len(atoms), WINDOW):
            until = min(n + WINDOW, len(atoms))
            segs, feats = candidates(text, atoms, word, need, n, until)
            yield until, segs, scores(weights, feats)
    return [(k, atoms[i][0], atoms[j - 1][1]) for i, j, k in decode(len(atoms), parts())]


def expectations(n: int, segs: list[tuple[int, int]], s: np.ndarray) -> np.ndarray:
    """Marginal probability of each (segment, kind) over all cuts of the window."""
    total = np.logaddexp.reduce(s, axis=1)
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0.0
    at = 0
    for j in range(1, n + 1):
        terms = [ahead[j - 1]]
        while at < len(segs) and segs[at][1] == j:
            terms.append(ahead[segs[at][0]] + total[at])
            at += 1
        ahead[j] = np.logaddexp.reduce(terms)
    starts: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, _) in enumerate(segs):
        starts[i].append(k)
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1], *(total[k] + behind[segs[k][1]] for k in starts[i])])
    i, j = np.array(segs).T
    return np.exp(ahead[i, None] + s + behind[j, None] - ahead[n])


def rewritten(text: str, spans: list[tuple[int, int, int]], seed: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The window with its entities written as the patterns do not know them."""
    out, marks, at = "", [], 0
    for kind, a, b in sorted(spans, key=lambda x: x[1]):
        if a < at:
            continue
        s, out = text[a:b], out + text[at:a]
        way = zlib.crc32(f"{seed}{s}".encode()) % 3
        if kind == 0:
            s = s.replace("@", (" [at] ", "(at)", " (at) ")[way])
        elif kind == 1:
            s = s.replace(".", ("[.]", "(.)", " . ")[way])
        elif kind == 2:
            d = digits_of(s)
            s = (".", "/", " - ")[way].join(d[i:i + 4] for i in range(0, len(d), 4))
        else:
            d = digits_of(s)[-10:]
            s = (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"001 {d[:3]} {d[3:6]} {d[6:]}")[way]
        marks.append((kind, len(out), len(out) + len(s)))
        out, at = out + s, b
    return out + text[at:], marks


def fit(samples: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = ROUNDS) -> np.ndarray:
    """Weights (FEATURES, kinds) that maximise the likelihood of the labelled windows, by adaptive gradient steps with a small penalty."""
    data = []
    for text, spans in samples:
        atoms, segs, feats = segments(text)
        first, last = {a: i for i, (a, _) in enumerate(atoms)}, {b: i + 1 for i, (_, b) in enumerate(atoms)}
        gold = {(first.get(a), last.get(b)): k for k, a, b in spans}
        if segs and len(atoms) <= WINDOW and set(gold) <= set(segs):
            want = np.zeros((len(segs), len(KINDS)))
            for n, x in enumerate(segs):
                if x in gold:
                    want[n, gold[x]] = 1
            data.append((len(atoms), segs, feats, want))
    w, sq = np.zeros((FEATURES, len(KINDS))), np.full((FEATURES, len(KINDS)), 1e-2)
    for _ in range(rounds):
        for n, segs, feats, want in data:
            diff = want - expectations(n, segs, scores(w, feats))
            far = np.flatnonzero(np.abs(diff).max(1) > 1e-4)
            if not len(far):
                continue
            ids = np.concatenate([np.array(feats[k]) for k in far])
            per = np.repeat(diff[far], [len(feats[k]) for k in far], axis=0)
            use, inv = np.unique(ids, return_inverse=True)
            g = np.zeros((len(use), len(KINDS)))
            np.add.at(g, inv, per)
            g -= 1e-4 * w[use]
            sq[use] += g * g
            w[use] += 0.5 * g / np.sqrt(sq[use])
    return w.astype(np.float32)


def spans_of(text: str, weights: np.ndarray | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans by kind and start."""
    base = base_spans(text)
    if weights is None:
        return base, base
    more = []
    for a, b in windows(text):
        more += [(k, a + x, a + y) for k, x, y in entities(text[a:b], weights)]
    taken = sorted((x, y) for _, x, y in base)
    free = [m for m in more if not any(x < m[2] and m[1] < y for x, y in taken)]
    return base, sorted({*base, *free})


def sample_windows(docs: DataFrame, text: str, n: int = SAMPLE) -> list[str]:
    """At most n windows of the corpus, those with the smallest hashes; at most eight from a text."""
    def run(texts: list[bytes]) -> list[tuple]:
        out = []
        for t in texts:
            found = []
            if len(t) != len(t.translate(None, NEEDED)):
                s = t.decode("utf-8", "replace")
                found = [s[a:b] for a, b in windows(s) if b - a < 1000]
            out.append((sorted(found, key=lambda w: zlib.crc32(w.encode()))[:8],))
        return out
    found = map_texts(docs, text, run, fields(found="array<string>"), []).select(F.explode("out.found").alias("w")).distinct()
    return [r.w for r in found.orderBy(F.xxhash64("w"), "w").limit(n).collect()]


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> np.ndarray | None:
    """Weights from the corpus itself; None if no sampled window has an entity."""
    plain = [(w, base_spans(w)) for w in sample_windows(docs, text, sample)]
    if not any(s for _, s in plain):
        return None
    return fit([*plain, *(rewritten(w, s, i) for i, (w, s) in enumerate(plain) if s)])


def find_spans(docs: DataFrame, weights: np.ndarray | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`doc` and, in `out`: base and found, the base and all spans as kind:start:end joined by commas; starts, ends, kinds of all."""
    def run(texts: list[bytes]) -> list[tuple]:
        out = []
        for t in texts:
            base = every = []
            if len(t) != len(t.translate(None, NEEDED)):
                base, every = spans_of(t.decode("utf-8", "replace"), weights)
            line = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
            out.append((*(sum(x[0] == k for x in base) for k in range(4)), line(base), line(every), [x[1] for x in every], [x[2] for x in every], [KINDS[x[0]] for x in every]))
        return out
    return map_texts(docs, text, run, fields(**{f"n_{k}": "bigint" for k in KINDS}, base="string", found="string", starts="array<bigint>", ends="array<bigint>", kinds="array<string>"), keep)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the earlier, longer one counts."""
    out, at = [], 0
    for a, b, k in sorted(spans, key=lambda x: (x[0], -x[1])):
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents with personal data masked, and their length brought up to date if they have that column."""
    weights = train(docs, text)

    def run(texts: list[bytes]) -> list[tuple]:
        out = []
        for t in texts:
            new = None
            if len(t) != len(t.translate(None, NEEDED)):
                s = t.decode("utf-8", "replace")
                every = spans_of(s, weights)[1]
                new = mask(s, [(a, b, KINDS[k]) for k, a, b in every]) if every else None
            out.append((new,))
        return out
    rows = map_texts(docs, text, run, fields(masked="string"))
    new = F.col("out.masked")
    value = {text: F.coalesce(new, F.col(f"doc.`{text}`"))} | ({n_chars: F.when(new.isNotNull(), F.char_length(new)).otherwise(F.col(f"doc.`{n_chars}`")).cast(docs.schema[n_chars].dataType)} if n_chars in docs.columns else {})
    return rows.select(*[value.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


@query("op3_semi_markov_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = find_spans(docs, train(docs), keep=["doc_id"])
    return rows.select("doc.doc_id", *[f"out.n_{k}" for k in KINDS], F.sha2("out.base", 256).alias("base_sha256"), F.col("out.found").alias("spans"))
