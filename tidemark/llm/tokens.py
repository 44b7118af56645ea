"""Whole texts to ids with the public tokenizers, remembering the ids of words.

Both tokenizers split a text at certain places whatever stands around them, so a text's ids are those of its parts in a row:
`word_bpe` drops white space and looks at no word across it; `byte_bpe` starts a new part at a single space between two other
characters. Parts are looked up in a table first; only new ones go through the library (of many texts at once each different one, kept in arrays), whole texts with other white space or the string of
an added token too.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts remembered by one Python worker since the last time the table was full; those before are looked up once more before they go.
REMEMBERED = 250_000

#: A character that only the library normalises.
RARE = r"[^\x00-\x{12F}\x{131}-\x{17F}]"


class Recent(dict):
    """Part of a text -> its ids as little-endian bytes, worked out by `make` where not remembered."""

    def __init__(self, make: Callable[[str], bytes], most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        out = self.older.get(part)
        if out is None:
            out = self.make(part)
        self[part] = out
        return out


def gathered(pool: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ids of some of the parts that lie in `pool`, in the given order."""
    n = lengths[which]
    at = np.repeat((np.cumsum(lengths) - lengths)[which] - np.cumsum(n) + n, n)
    at += np.arange(len(at))
    return pool[at]


class Known:
    """Ids of parts in arrays, looked up many at once. Place 0 is the empty part."""

    def __init__(self, most: int):
        self.most, self.turn = most, 0
        self.parts, self.ids, self.lengths, self.used = pa.array([""]), np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def places(self, kinds: tuple[pa.Array, ...], make: tuple[Callable[[str], bytes], ...]) -> np.ndarray:
        """Where each part of each kind is; new ones are made by the function of their kind."""
        found = pc.index_in(pa.concat_arrays(kinds), value_set=self.parts)
        starts = np.cumsum([0, *map(len, kinds)]).tolist()
        fresh = [x.filter(found.slice(i, len(x)).is_null()) for i, x in zip(starts, kinds)]
        new = pa.concat_arrays(fresh)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            made = [f(x) for f, xs in zip(make, fresh) for x in xs.to_pylist()]
            at[at < 0] = np.arange(len(made)) + len(self.parts)
            self.parts = pa.concat_arrays([self.parts, new])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), "<u4")])
            self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, made), np.int64, len(made)) // 4])
            self.used = np.concatenate([self.used, np.zeros(len(made), np.int64)])
        self.used[at] = self.turn
        return at

    def shrink(self) -> None:
        """Beyond the most, the half that was looked up last stays."""
        self.turn += 1
        self.used[0] = self.turn
        if len(self.parts) > self.most:
            stay = np.sort(np.argsort(-self.used, kind="stable")[:self.most // 2])
            self.parts, self.ids = self.parts.take(pa.array(stay)), gathered(self.ids, self.lengths, stay)
            self.lengths, self.used = self.lengths[stay], self.used[stay]


class Unsplittable(Exception):
    """A part whose ids may depend on its neighbours."""


class Coder:
    """Ids of whole texts by one tokenizer file; `name` is a file of public_tokenizers or a path."""

    def __init__(self, name: str, remembered: int = REMEMBERED):
        import regex
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = name
        if "/" not in name:
            import public_tokenizers
            path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        #: strings of added tokens get ids of their own wherever they stand, so a text that has one is left to the library
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.openings = sorted({c for t in self.added for c in (t[0], t[0].upper())})
        self.model = self.tokenizer.model
        self.drops_space = "Lowercase" in str(self.tokenizer.normalizer)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+" if self.drops_space else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.first = Recent(self.part, remembered)
        self.rest = self.first if self.drops_space else Recent(lambda part: self.part(" " + part), remembered)
        self.atoms = Recent(self.atom, remembered)
        self.known = Known(4 * remembered)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}     # how the vocabulary writes bytes

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, part: str) -> bytes:
        bare = part[1:] if part[:1] == " " else part
        if self.drops_space:
            if max(part, default="a") > "ſ":       # normalisation of rarer letters is left to the library
                return self.whole(part)
            return b"".join([self.atoms[x] for x in self.split.findall(part.lower())])
        if not bare or bare[0].isspace() or bare[-1].isspace():
            raise Unsplittable
        return b"".join([self.atoms[x] for x in self.split.findall(part)])

    def atom(self, x: str) -> bytes:
        written = x if x.isascii() and x.isalnum() else x.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """`encode` of each of some texts, none of them null. Without white space between them words are independent, so each different one is worked out once."""
        if not self.drops_space:
            return [self.encode(t) for t in texts.to_pylist()]
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        words, low = coded.dictionary, pc.utf8_lower(coded.dictionary)
        plain = pc.invert(pc.match_substring_regex(words, RARE))
        bare = pc.and_(plain, pc.utf8_is_alpha(low))
        heads = pc.if_else(bare, low, pc.utf8_slice_codeunits(low, 0, -1))
        simple = pc.and_(plain, pc.utf8_is_alpha(heads))       # letters, and one other character at most
        marked = pc.and_not(simple, bare)
        head, mark = pc.filter(heads, simple).dictionary_encode(), pc.filter(pc.utf8_slice_codeunits(low, -1), marked).dictionary_encode()
        other = pc.filter(words, pc.invert(simple))
        # the two pieces of each word: the second is empty where there is one alone
        pieces = np.zeros((len(words), 2), np.int64)
        simple, marked = (x.to_numpy(zero_copy_only=False) for x in (simple, marked))
        heads, others, marks = np.split(self.known.places((head.dictionary, other, mark.dictionary), (self.atom, self.part, self.part)), np.cumsum([len(head.dictionary), len(other)]))
        pieces[simple, 0], pieces[~simple, 0], pieces[marked, 1] = heads[head.indices.to_numpy()], others, marks[mark.indices.to_numpy()]
        pool, ends = gathered(self.known.ids, self.known.lengths, pieces.ravel()), 4 * np.cumsum(self.known.lengths[pieces].sum(1))
        self.known.shrink()
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(pool)])
        _, cuts, raw = ids.take(coded.indices).buffers()
        cuts = np.frombuffer(cuts, np.int64)[parts.offsets.to_numpy() - parts.offsets[0].as_py()].tolist() if raw else [0] * (len(parts) + 1)
        out = [raw[a:b].to_pybytes() for a, b in zip(cuts, cuts[1:])] if raw else [b""] * len(parts)
        for c in self.openings:
            for i in np.flatnonzero(pc.match_substring(texts, c).to_numpy(zero_copy_only=False)).tolist():
                out[i] = self.encode(texts[i].as_py())
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(c in text for c in self.openings):
            low = text.lower()
            if any(x in low for x in self.added):
                return self.whole(text)
        first, *rest = text.split(" ")
        try:
            return b"".join([self.first[first], *map(self.rest.__getitem__, rest)])
        except Unsplittable:
            return self.whole(text)


_CODERS: dict[str, Coder] = {}


def coder(name: str, remembered: int = REMEMBERED) -> Coder:
    """The worker's own coder, made once per process."""
    if name not in _CODERS:
        _CODERS[name] = Coder(name, remembered)
    return _CODERS[name]
