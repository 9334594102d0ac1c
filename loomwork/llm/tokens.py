"""Whole-text token ids with the ``tokenizers`` library, one lookup per distinct chunk.

A byte-level BPE never merges across a change from non-space to space, so a text cut before each
single space and newline encodes to the concatenation of its chunks' ids.  Arrow splits whole columns
and numbers their distinct chunks; only these are looked up in a bounded dictionary, and numpy puts
the ids together.  Texts with other white space take the library's path as a whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts in which white space other than single spaces and one or two newlines decides the pre-tokens.
_HARD = "[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}]|  | \\n|\\n |\\n\\n\\n|\\n\\n\\z"
#: Marks the key of a chunk that starts a text; no other key starts with two newlines.
_ALONE = "\n\n"
_ID = attrgetter("id")


def strings(column: pa.Array) -> list[str]:
    """A string column without nulls as a list; by numpy, many times faster than Arrow's own way."""
    return column.to_numpy(zero_copy_only=False).tolist()


class ChunkEncoder:
    """Texts → ids, in ``dtype``.

    ``special_as_text``: the strings of special tokens in a text are ordinary text, as the notes of the
    tokenizer files ask for; else they become the special tokens, as a freshly loaded file has it.
    """

    def __init__(self, path: str, dtype: str = "<u4", cache: int = 1_000_000, special_as_text: bool = True):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.tokenize = self.library.model.tokenize
        self.hard = _HARD
        if not special_as_text:
            self.hard += "".join("|" + re.sub(r"\W", lambda m: "\\" + m[0], t.content) for t in self.library.get_added_tokens_decoder().values())
        # the byte-level alphabet: printable Latin-1 stands for itself, other bytes for characters from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        other = iter(range(256, 512))
        self.alphabet = [chr(b if b in plain else next(other)) for b in range(256)]
        self.space = self.alphabet[32]
        self.dtype, self.limit = np.dtype(dtype), cache
        *marks, self.newline = self._encode([",", ".", "\n"])
        self.marks = dict(zip(",.", marks))
        self._clear()

    def _clear(self) -> None:
        """Forget all chunks: key → row, and the ids of all rows one after another."""
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(1 << 16, self.dtype), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, w: str, space: bool) -> list[int] | None:
        """Ids of a word of letters, perhaps with a mark after it, straight from the library's model: each is one pre-token. Null for other words."""
        mark = self.marks.get(w[-1:])
        if mark:
            w = w[:-1]
        if not w.isalpha():
            return None
        if not w.isascii():
            if max(w) >= "\u0250":
                return None
            w = "".join(map(self.alphabet.__getitem__, w.encode()))
        ids = list(map(_ID, self.tokenize(self.space + w if space else w)))
        return ids + mark if mark else ids

    def _learn(self, keys: list[str]) -> None:
        """Add rows for new keys: " " + key, or without that space after a newline or at a text's start."""
        found: list[list[int] | None] = []
        rest: list[str] = []
        word = self._word
        for k in keys:
            if k[:1] != "\n":
                head, w, space = [], k, True
            elif k[:2] == _ALONE:
                head, w, space = [], k[2:], False
            else:
                head, w, space = self.newline, k[1:], False
            ids = word(w, space) if w else [] if not space else None
            if ids is None:
                rest.append(" " + w if space else w)
                found.append(None)
            else:
                found.append(head + ids if head else ids)
        if rest:
            own = iter(self._encode(rest))
            found = [x if x is not None else (self.newline if k[:1] == "\n" and k[:2] != _ALONE else []) + next(own) for k, x in zip(keys, found)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        base, total = len(self.known), int(size.sum())
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.start) < base + len(keys):
            self.start, self.size = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), self.dtype, total)
        self.start[base : base + len(keys)] = self.used + np.cumsum(size) - size
        self.size[base : base + len(keys)] = size
        self.used += total
        self.known.update(zip(keys, range(base, base + len(keys))))

    def _rows(self, keys: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(found < 0).tolist()
        if new:
            own = [keys[i] for i in new]
            self._learn(list(dict.fromkeys(own)))
            found[new] = list(map(self.known.__getitem__, own))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has; null counts as empty."""
        if len(self.known) > self.limit:
            self._clear()
        texts = pc.fill_null(texts, "")
        hard = pc.match_substring_regex(texts, self.hard)
        if pc.any(hard).as_py():
            own = [np.array(x, self.dtype) for x in self._encode(texts.filter(hard).to_pylist())]
            ids, size = self._easy(texts.filter(pc.invert(hard)))
            easy = np.split(ids, np.cumsum(size)[:-1]) if len(size) else []
            out, a, b = [], iter(own), iter(easy)
            for h in hard.to_pylist():
                out.append(next(a) if h else next(b))
            return np.concatenate(out), np.array([len(x) for x in out], np.int64)
        return self._easy(texts)

    def _easy(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        at = chunks.offsets.to_numpy().astype(np.int64)
        words = chunks.flatten()
        at -= at[0]
        coded = words.dictionary_encode()
        row = self._rows(strings(coded.dictionary))[coded.indices.to_numpy()]
        row[at[:-1]] = self._rows([_ALONE + w for w in strings(words.take(pa.array(at[:-1])))])
        size, start = self.size[row], self.start[row]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]
        return ids, np.add.reduceat(size, at[:-1])


@lru_cache(maxsize=4)
def encoder(path: str, dtype: str = "<u4", special_as_text: bool = True) -> ChunkEncoder:
    """One encoder a worker process."""
    return ChunkEncoder(path, dtype, special_as_text=special_as_text)


def slices(texts: list | pa.Array, most_chars: int = 2_000_000):
    """Index ranges of at most about ``most_chars`` characters (bytes of a column), so that work space stays bounded."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist() if isinstance(texts, pa.Array) else [len(t or "") for t in texts]
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most_chars:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)
