"""SentencePiece encoding and decoding as shortest paths in weighted finite-state transducers.

Three transducers are compiled from the model file: the normaliser (input characters to the model's alphabet, as the file's normaliser specification says: spaces to the space mark, a mark in
front), the pieces (strings of that alphabet to ids, each with its weight), and the byte fallback (a character no piece spells to the ids of its UTF-8 bytes, at a weight no piece path can
lose to). Composed with an input they give a lattice over its characters; the ids are the outputs on its shortest path in the tropical semiring: weights add along a path, and of
all arcs into a place the one with the least total stays.

A unigram model's weights are the negative scores of its pieces, and its paths are free. A merging model returns the one path on which every two neighbouring pieces would also stand if they were
merged by themselves: an arc to the next piece has a finite weight only if the pair is stable, which is worked out once per pair. Of all paths to a place then one alone is finite, so the minimum, though
taken over all arcs, has one candidate.

Models with a character map, with blanks to be removed, without space marks or with user-defined symbols are refused: their normaliser is more than this one. Inputs fall apart before each space mark
that follows something else, if no piece has a mark after another character: a part's path is found once and remembered. So are the parts between two
characters that stand together in no piece.

Decoding is the inverse: ids to pieces, runs of byte ids to characters, space marks to spaces, and the mark put in front of a text taken off.

A null text is empty and has no ids. Rows are independent.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fields, map_texts, query, table
from tidemark.llm.tokens import Recent

MARK = "▁"
STATES = 300_000        # states remembered since the table was last full; those before are looked up once more
BEGINNING = 12          # longest beginning of a part whose state is remembered
WORDS = 500_000         # words remembered likewise
FALLBACK = 1e6          # weight of a byte arc: above any path of pieces
INFINITE = float("inf")


UNIGRAM, MERGES = 1, 2
USER_DEFINED = 4


def message(data: bytes) -> dict[int, list]:
    """The fields of a protocol buffer message by number: whole numbers, or bytes."""
    out: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value
    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            value, at = data[at:at + size], at + size
        out.setdefault(tag >> 3, []).append(value)
    return out


def specification(model: bytes) -> tuple[int, bool]:
    """(kind of model, whether a mark is put in front) of a model file; raises for one whose normaliser or symbols are not compiled here."""
    fields_of = message(model)
    trainer, normaliser = message(b"".join(fields_of.get(2, []))), message(b"".join(fields_of.get(3, [])))
    flag = lambda n: bool(normaliser.get(n, [1])[-1])  # noqa: E731 - true where the file says nothing
    kind = trainer.get(3, [UNIGRAM])[-1]
    if kind not in (UNIGRAM, MERGES):
        raise ValueError("neither a unigram nor a merging model")
    if any(normaliser.get(2, [])):
        raise ValueError("the model normalises by a character map")
    if flag(4) or not flag(5):
        raise ValueError("the model removes blanks or keeps spaces as they are")
    if any(message(p).get(3, [1])[-1] == USER_DEFINED for p in fields_of.get(1, [])):
        raise ValueError("the model has user-defined symbols")
    return kind, flag(3)


#: Least total up to a place, the last piece on the way there, and the state of the place before.
State = tuple[float, str, "State | None"]
NOTHING: State = (0.0, "", None)


class Lattice:
    """Pieces with weights, and whether they come from merges: shortest paths over strings of the model's alphabet."""

    def __init__(self, weight: dict[str, float], merges: dict[str, float] | None = None):
        self.rank = merges or {}
        self.merged = merges is not None
        self.follows: dict[str, dict[str, bool]] = {}       # piece -> next piece -> whether the two stay two
        if self.merged:                                     # pieces that merging can make, and how
            self.made = {p: h for p in weight if (h := self.history(p))[0] == p}
            weight = {p: weight[p] for p in self.made}
        self.weight = weight
        #: every end of a piece -> its weight, infinite where it is no piece itself: longer strings than these end no piece
        self.ends = {p[i:]: INFINITE for p in weight for i in range(1, len(p))} | weight
        self.beginnings: dict[str, State] = {}
        self.older: dict[str, State] = {}

    def history(self, s: str) -> tuple[str, list[float], list[str], list[str]]:
        """What merging, best rank first and leftmost among equals, makes of a short string: the result (joined by spaces), the rank of each merge, then
        infinity, and the first and the last symbol before each merge and at the end."""
        parts = list(s)
        ranks, firsts, lasts = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            best, at = min((self.rank.get(parts[i] + parts[i + 1], np.inf), i) for i in range(len(parts) - 1))
            if best == np.inf:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            ranks.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        return " ".join(parts), [*ranks, np.inf], firsts, lasts

    def stable(self, a: str, b: str) -> bool:
        """Whether two pieces in a row stay two: their merges are taken in turn, and no pair across the border ever comes first."""
        _, left, _, last = self.made[a]
        _, right, first, _ = self.made[b]
        i = j = 0
        while True:
            x, y, across = left[i], right[j], self.rank.get(last[i] + first[j], np.inf)
            if across < x and across <= y:
                return False
            if x == y == np.inf:
                return True
            if x <= y:
                i += 1
            else:
                j += 1

    def shortest(self, s: str) -> list[str]:
        """Pieces on the shortest path over `s`; a character that is no piece stands for its bytes. A state is a place and the last piece.

        What a place's least state is depends on the text before it only: those of short beginnings are remembered, each with the one before it. Of equal totals the longer last piece counts.
        """
        n, arcs, ends, follows, known, older, merged = len(s), self.weight, self.ends, self.follows, self.beginnings, self.older, self.merged
        state = None
        for have in range(min(n, BEGINNING), 0, -1):
            start = s[:have]
            state = known.get(start) or older.get(start)
            if state is not None:
                break
        else:
            have, state = 0, NOTHING
        states: list[State] = []
        while state is not None:
            states.append(state)
            state = state[2]
        states.reverse()
        for end in range(have + 1, n + 1):
            least, last = INFINITE, ""
            for at in range(end - 1, -1, -1):
                p = s[at:end]
                w = ends.get(p)
                if w is None:
                    break
                if w == INFINITE:
                    continue
                total, before, _ = states[at]
                total += w
                if total > least:
                    continue
                if merged and before in arcs:
                    pairs = follows.get(before)
                    if pairs is None:
                        pairs = follows[before] = {}
                    ok = pairs.get(p)
                    if ok is None:
                        ok = pairs[p] = self.stable(before, p)
                    if not ok:
                        continue
                least, last = total, p
            if not last:        # a character that is no piece: its bytes, across which nothing merges
                least, last = states[-1][0] + FALLBACK, s[end - 1]
            state = (least, last, states[-1])
            if end <= BEGINNING:
                known[s[:end]] = state
            states.append(state)
        if len(known) >= STATES:
            self.beginnings, self.older = {}, known
        out: list[str] = []
        while n:
            p = states[n][1]
            out.append(p)
            n -= len(p)
        return out[::-1]


class Transducer:
    """The compiled model: `path` is a SentencePiece model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        kind, self.leading = specification(model.serialized_model_proto())
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
        scores = {p: -model.get_score(i) for i, p in enumerate(self.pieces) if not special(i)}
        self.id = {p: i for i, p in enumerate(self.pieces) if not special(i)}
        self.byte_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_id)}
        self.lattice = Lattice(dict.fromkeys(scores, 1.0), scores) if kind == MERGES else Lattice(scores)
        self.arcs, self.stable, self.history = self.lattice.weight, self.lattice.stable, self.lattice.history
        self.apart = not any(MARK in p.lstrip(MARK) for p in scores)
        self.words, self.inner = Recent(self.word, WORDS), Recent(self.part, WORDS // 10)
        self.pairs = {p[i:i + 2] for p in scores for i in range(len(p) - 1)}
        # a byte below 128 is a character whatever stands beside it
        self.spelled = [chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else p for i, p in enumerate(self.pieces)]
        self.joins = np.array([self.byte_of.get(i, 0) >= 128 for i in range(n)])

    def normalise(self, text: str) -> str:
        """The text in the model's alphabet."""
        return (MARK if self.leading and text else "") + text.replace(" ", MARK)

    def part(self, s: str) -> bytes:
        ids, spell = self.id, self.byte_id
        path = self.lattice.shortest(s)
        try:
            return array("I", [ids[p] for p in path]).tobytes()
        except KeyError:
            return array("I", [i for p in path for i in ([ids[p]] if p in ids else [spell[b] for b in p.encode()])]).tobytes()

    def word(self, w: str) -> bytes:
        """Ids of a mark and a word. Two characters that stand together in no piece belong to two parts, as no path crosses between them."""
        s, pairs = MARK + w, self.pairs
        cuts = [i for i in range(1, len(s)) if s[i - 1:i + 1] not in pairs]
        if not cuts:
            return self.part(s)
        return b"".join([self.words[s[1:cuts[0]]], *[self.inner[s[a:b]] for a, b in zip(cuts, [*cuts[1:], len(s)])]])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.apart:
            return self.part(self.normalise(text))
        words = text.split(" ")
        if self.leading and "" not in words and MARK not in text:
            return b"".join(map(self.words.__getitem__, words))
        # a run of marks belongs to one part: empty words are marks without letters
        head, *words = self.normalise(text).split(MARK)
        out, run = [self.part(head)] if head else [], ""
        for w in words:
            run += MARK
            if w:
                out.append(self.part(run + w))
                run = ""
        return b"".join([*out, self.part(run)] if run else out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids."""
        ids = np.asarray(ids, np.int64)
        if not self.joins[ids].any():
            s = "".join(map(self.spelled.__getitem__, ids.tolist()))
        else:
            out, run = [], bytearray()
            for i in ids.tolist():
                b = self.byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(self.pieces[i])
            s = "".join([*out, run.decode("utf-8", "replace")])
        s = s.replace(MARK, " ")
        return s[1:] if self.leading and s[:1] == " " else s


_MADE: dict[str, Transducer] = {}


def transducer(name: str) -> Transducer:
    """The worker's own transducer; `name` is a file of public_tokenizers or a path."""
    if name not in _MADE:
        path = name
        if "/" not in name:
            import public_tokenizers
            path = public_tokenizers.path(name)
        _MADE[name] = Transducer(path)
    return _MADE[name]


def encode(docs: DataFrame, text: str = "text", model: str = "piece_bpe_32k.model", keep: list[str] | None = None) -> DataFrame:
    """`doc` and ids, the ids of its whole text as an array."""
    def run(texts: list[bytes]) -> list[tuple]:
        t = transducer(model)
        return [(np.frombuffer(t.encode(x.decode("utf-8", "replace")), "<u4").astype(np.int32),) for x in texts]
    return map_texts(docs, text, run, fields(ids="array<int>"), keep).select("doc", "out.ids")


def decode(rows: DataFrame, ids: str = "ids", model: str = "piece_bpe_32k.model") -> DataFrame:
    """`rows` with the decoded text of an array of ids."""
    import pandas as pd

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        t = transducer(model)
        return s.map(lambda x: "" if x is None else t.decode(x))
    return rows.withColumn("decoded", text(F.col(ids)))


@query("op6_sentencepiece_paths")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and text of every document, taken through the transducers and back."""
    def run(texts: list[bytes]) -> list[tuple]:
        t = transducer("piece_bpe_32k.model")
        out = []
        for x in texts:
            ids = t.encode(x.decode("utf-8", "replace"))
            back = t.decode(np.frombuffer(ids, "<u4")).encode()
            out.append((len(ids) // 4, zlib.crc32(ids), zlib.crc32(back), back == x))
        return out
    kinds = fields(n_pieces="bigint", ids_crc32="bigint", decoded_crc32="bigint", round_trip="boolean")
    return map_texts(table(spark, sf_dir, "documents"), "text", run, kinds, ["doc_id"]).select("doc.doc_id", "out.*")
