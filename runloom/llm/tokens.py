"""Token ids of whole texts, a batch at a time.

Texts repeat their words, and a byte-level vocabulary splits a text into words before
it merges anything, so each distinct word of a batch is encoded once and the ids are
gathered.  Word borders are found on arrays of code points.  Two kinds of texts go to
the tokenizer as a whole: those with an apostrophe ending (its pattern treats some of
them apart), and those with the text of a special token.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence

import numpy as np

CHARS_PER_CHUNK = 500_000
CACHED_WORDS = 400_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


def char_classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other."""
    import regex

    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


class Grown:
    """An array that takes new values at its end; it doubles when it is full."""

    def __init__(self, kind: type):
        self._room, self._n = np.empty(1024, kind), 0

    def extend(self, values: Sequence[int]) -> None:
        n = self._n + len(values)
        if n > len(self._room):
            self._room = np.concatenate([self._room[: self._n], np.empty(max(n, 2 * len(self._room)) - self._n, self._room.dtype)])
        self._room[self._n : n] = values
        self._n = n

    @property
    def values(self) -> np.ndarray:
        return self._room[: self._n]


class BatchEncoder:
    """Ids of a byte-level vocabulary; equal to encoding each text with the tokenizer."""

    def __init__(self, tokenizer_file: str, ranks_file: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._words = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._whole = Tokenizer.from_file(tokenizer_file)
        special = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._apart = regex.compile("|".join([r"'(?:s|t|re|ve|m|ll|d)", *map(regex.escape, special)]))
        self._class = char_classes()
        self._power = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)
        self._reset()

    def _reset(self) -> None:
        self._at: dict[int, int] = {}
        self._ids = Grown(np.uint32)
        self._start = Grown(np.int64)
        self._start.extend([0])

    def _powers(self, n: int) -> None:
        if len(self._power) < n:
            inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
            for name, step in (("_power", _STEP), ("_inverse", inverse)):
                steps = np.full(n, step, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def encode(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """Ids (uint32) of each text, in order."""
        chunk: list[str] = []
        size = 0
        for text in texts:
            chunk.append(text)
            size += len(text)
            if size >= CHARS_PER_CHUNK:
                yield from self._chunk(chunk)
                chunk, size = [], 0
        yield from self._chunk(chunk)

    def _chunk(self, texts: list[str]) -> Iterator[np.ndarray]:
        apart = [bool(self._apart.search(t)) for t in texts]
        plain = [t for t, a in zip(texts, apart) if not a]
        ids, ends = self._plain(plain)
        k = 0
        for text, whole in zip(texts, apart):
            if whole:
                yield np.array(self._whole.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                yield ids[ends[k] : ends[k + 1]]
                k += 1

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        n = len(joined)
        border = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=border[1:])
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self._class[cp]
        first = np.zeros(n, bool)
        first[border[:-1][border[:-1] < n]] = True
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        # the last white space before a word begins a token; a plain blank joins the word
        after = np.flatnonzero(start[1:] & ~first[1:] & (kind[1:] != _SPACE) & (kind[:-1] == _SPACE)) + 1
        start[after - 1] = True
        start[after[cp[after - 1] == 32]] = False
        at = np.flatnonzero(start)
        end = np.append(at[1:], n)
        self._powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((cp + np.uint64(1)) * self._power[:n], dtype=np.uint64, out=total[1:])
        key = (total[end] - total[at]) * self._inverse[at] + (end - at).astype(np.uint64)
        distinct, sample, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(self._at) + len(distinct) > CACHED_WORDS:
            self._reset()
        place = np.empty(len(distinct), np.int64)
        known, fresh, ends, before = len(self._start.values) - 1, [], [], len(self._ids.values)
        for i, (h, s) in enumerate(zip(distinct.tolist(), sample.tolist())):
            k = self._at.get(h)
            if k is None:
                k = self._at[h] = known + len(ends)
                fresh += self._words.encode_ordinary(joined[at[s] : end[s]])
                ends.append(before + len(fresh))
            place[i] = k
        self._ids.extend(fresh)
        self._start.extend(ends)
        starts, flat = self._start.values, self._ids.values
        word = place[inverse]
        length = starts[word + 1] - starts[word]
        upto = np.zeros(len(word) + 1, np.int64)
        np.cumsum(length, out=upto[1:])
        ids = flat[np.repeat(starts[word] - upto[:-1], length) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(at, border)]


def public_encoder(name: str = "byte_bpe_50k") -> BatchEncoder:
    import public_tokenizers

    path = public_tokenizers.path
    return BatchEncoder(path(f"{name}.json"), path(f"{name}.tiktoken"), public_tokenizers.PATTERN)
