"""Token ids of whole texts with a public tokenizer, each distinct chunk of a slice encoded once.

A chunk is a run of white space with the run of other characters after it. Both supported
tokenizers cut their pre-tokens at every change from other characters to white space, so the
ids of a text are the ids of its chunks in order; the tokenizers library encodes the chunks.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Unicode's white space, as the tokenizers' patterns take it (fixed values).
SPACE = " \\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: The same, but a single line end before other characters stands alone.
LINES = re.compile(f"\n(?=[^{SPACE}])|{CHUNK.pattern}")
#: White space after something else; marks behind a letter or digit at the end (for Arrow's expressions).
INNER, ENDED = r"[^\t-\r\x{85}\p{Z}][\t-\r\x{85}\p{Z}]", r"[\p{L}\p{N}][!-&(-/:-@\[-`{-~]+\z"
#: A single space with white space before it and white space or the end behind it.
UNSAFE = r"[\t-\r\x{85}\p{Z}] (?:[\t-\r\x{85}\p{Z}]|\z)"
PLAIN = r"\A ?[^\t-\r\x{85}\p{Z}\x01]+\z"
#: ASCII's but the apostrophe, with which contractions begin.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Chunks that are encoded in one call, between separators; calls in a batch.
TOGETHER, CALLS = 400, 16
#: Pieces kept from slice to slice; beyond that only those of the last slice stay.
MOST = 300_000

_loaded: dict[str, "Encoder"] = {}


class Encoder:
    """Little-endian unsigned 32-bit ids of texts as bytes."""

    def __init__(self, path: str, most: int = MOST):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # pieces of slices before, and their ids as in _pieces
        self.known, self.ids, self.start, self.length = pa.array([], type=pa.string()), np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        # between two chunks stands a piece that is one token of its own and in no plain chunk
        self.between, self.mark = next(((gap, ids[0]) for gap in ("\n", " \x01 ") if len(ids := self._ids(gap)) == 1 and self._ids(f"a{gap} b") == [*self._ids("a"), *ids, *self._ids(" b")]), (None, None))

        # where a line end is a pre-token of its own, a line's first word is a plain piece
        self.cut = LINES if all(self._ids(f"\n{x}") == self._ids("\n") + self._ids(x) for x in ("a", "É", "1", "'s", "-a", "\x01", "木")) else CHUNK
        self.drops_space = self._ids(" a\nb ") == self._ids("a") + self._ids("b") and self._ids("a b") == self._ids("a") + self._ids("b")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct ``pieces`` in one row, and each piece's first place and number in it.

        Plain pieces go to the tokenizer many at a time, with a separator between them that is a token of
        its own; the others, and any group in which the separators do not come back, one by one.
        """
        easy = np.asarray(pc.match_substring_regex(pieces, PLAIN)) if self.between else np.zeros(len(pieces), dtype=bool)
        at, odd = np.flatnonzero(easy), [np.flatnonzero(~easy)]
        plain = common.strings(pieces.take(pa.array(at)))
        index, sizes, ids = [], [], []
        starts = range(0, len(plain), TOGETHER)
        for a in range(0, len(starts), CALLS):
            part = starts[a : a + CALLS]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([self.between.join(plain[i : i + TOGETHER]) for i in part], add_special_tokens=False), strict=True):
                got, own = np.array(e.ids, dtype="<u4"), at[i : i + TOGETHER]
                cut = got == self.mark
                cuts = np.flatnonzero(cut)
                if len(cuts) != len(own) - 1:
                    odd.append(own)
                    continue
                index.append(own), sizes.append(np.diff(cuts, prepend=-1, append=len(got)) - 1), ids.append(got[~cut])
        odd = np.concatenate(odd)
        for i in range(0, len(odd), 512):
            own = odd[i : i + 512]
            for e in self.tokenizer.encode_batch_fast(common.strings(pieces.take(pa.array(own))), add_special_tokens=False):
                sizes.append(np.array([len(e.ids)])), ids.append(np.array(e.ids, dtype="<u4"))
            index.append(own)
        length, start = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        if index:
            index, sizes = np.concatenate(index), np.concatenate(sizes)
            length[index], start[index] = sizes, np.cumsum(sizes) - sizes
        return np.concatenate(ids) if ids else np.zeros(0, dtype="<u4"), start, length

    def _recalled(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_pieces``, which is asked for those that were not in slices before."""
        at = np.asarray(pc.fill_null(pc.index_in(pieces, value_set=self.known), -1))
        hit = at >= 0
        new = pieces.filter(pa.array(~hit))
        own, first, size = self._pieces(new)
        ids, start, length = np.concatenate([self.ids, own]), np.empty(len(at), dtype=np.int64), np.empty(len(at), dtype=np.int64)
        start[hit], length[hit] = self.start[at[hit]], self.length[at[hit]]
        start[~hit], length[~hit] = first + len(self.ids), size
        if len(self.known) + len(new) <= self.most:
            self.known = pa.concat_arrays([self.known, new])
            self.ids, self.start, self.length = ids, np.concatenate([self.start, first + len(self.ids)]), np.concatenate([self.length, size])
        else:
            upto = np.cumsum(length)
            self.known, self.start, self.length = pieces, upto - length, length
            self.ids = ids[np.repeat(start - self.start, length) + np.arange(upto[-1] if len(upto) else 0)]
        return ids, start, length

    def _resolve(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct ``chunks`` in one row, and each chunk's first place and number in it.

        Marks after a letter or digit up to the chunk's end are a pre-token of their own, so a chunk that
        ends in them is its stem and the marks.
        """
        n = len(chunks)
        several = pc.match_substring_regex(chunks, INNER)  # white space inside: more than one chunk
        ended = pc.and_not(pc.match_substring_regex(chunks, ENDED), several)
        none = pc.equal(pc.binary_length(chunks), 0)
        whole = pc.invert(pc.or_(pc.or_(several, ended), none))
        marked = chunks.filter(ended)
        stems = pc.utf8_rtrim(marked, MARKS)
        marks = [c[len(stem) :] for c, stem in zip(common.strings(marked), common.strings(stems), strict=True)]
        parts = [self.cut.findall(c) for c in common.strings(chunks.filter(several))]
        count = np.ones(n, dtype=np.int64)
        several, ended, whole = (np.flatnonzero(np.asarray(m)) for m in (several, ended, whole))
        count[np.asarray(none)], count[ended] = 0, 2
        count[several] = [len(p) for p in parts]
        first = np.concatenate(([0], np.cumsum(count)))
        every = pa.concat_arrays([chunks.take(pa.array(whole)), stems, pa.array(marks, type=pa.string()), pa.array([x for p in parts for x in p], type=pa.string())]).dictionary_encode()
        code = np.asarray(every.indices, dtype=np.int64)
        piece = np.empty(first[-1], dtype=np.int64)
        a, b, c = np.cumsum([len(whole), len(ended), len(ended)])
        piece[first[whole]], piece[first[ended]], piece[first[ended] + 1] = code[:a], code[a:b], code[b:c]
        size = count[several]
        piece[np.repeat(first[several] - (np.cumsum(size) - size), size) + np.arange(size.sum())] = code[c:]
        ids, start, length = self._recalled(every.dictionary)
        upto = np.concatenate(([0], np.cumsum(length[piece])))
        flat = ids[np.repeat(start[piece] - upto[:-1], length[piece]) + np.arange(upto[-1])]
        return flat, upto[first[:-1]], upto[first[1:]] - upto[first[:-1]]

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """For each text its chunks as numbers, the texts' edges in them, and the distinct chunks.

        Where white space is dropped: the words. Else the parts between single spaces, each with its
        space in front; a text in which such a cut may fall inside a run of white space is one chunk.
        """
        if self.drops_space:
            lists = pc.ascii_split_whitespace(texts)
        else:
            lists = pc.split_pattern(texts, " ")
        edges = np.asarray(lists.offsets, dtype=np.int64)
        flat, edges = lists.values.slice(edges[0], edges[-1] - edges[0]), edges - edges[0]
        coded = flat.dictionary_encode()
        code, names = np.asarray(coded.indices, dtype=np.int64), coded.dictionary
        if self.drops_space:
            return code, edges, names
        # a text's first part has no space in front of it: it gets a number of its own
        first = edges[:-1]
        heads, own = np.unique(code[first], return_inverse=True)
        code = code.copy()
        code[first] = own + len(names)
        names = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(" "), names, ""), names.take(pa.array(heads))])
        odd = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, UNSAFE)))
        if len(odd):
            keep = np.ones(len(code), dtype=bool)
            size = np.diff(edges)
            for k, i in enumerate(odd.tolist()):
                keep[edges[i] + 1 : edges[i + 1]] = False
                code[edges[i]] = len(names) + k
                size[i] = 1
            names = pa.concat_arrays([names, texts.take(pa.array(odd))])
            code, edges = code[keep], np.concatenate(([0], np.cumsum(size)))
        return code, edges, names

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end``, and the texts' edges in them; null counts as empty."""
        code, edges, names = self._chunks(pc.fill_null(texts, ""))
        flat, start, length = self._resolve(names)
        # the end's number behind every text's chunks
        start, length, flat = np.append(start, len(flat)), np.append(length, 1), np.append(flat, np.uint32(end)).astype("<u4")
        n = len(edges) - 1
        every = np.full(len(code) + n, len(names), dtype=np.int64)
        every[np.arange(len(code)) + np.repeat(np.arange(n), np.diff(edges))] = code
        size = length[every]
        upto = np.concatenate(([0], np.cumsum(size)))
        out = flat[np.repeat(start[every] - upto[:-1], size) + np.arange(upto[-1])]
        return out, upto[edges + np.arange(n + 1)]


def encoder(path: str, most: int = MOST) -> Encoder:
    """The worker's encoder for a tokenizer file, loaded once; it keeps up to ``most`` pieces."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    _loaded[path].most = most
    return _loaded[path]


def tokenizer_path(name: str) -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)
