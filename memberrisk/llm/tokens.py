"""Token ids of whole texts by the ``tokenizers`` library, a word at a time.

Both vocabularies used here split a text at white space before they merge
anything, so a text's ids are the ids of its words (and, for the byte-level
vocabulary, of the white space between them) in order. The words of a slice of
texts are found as arrays of hashes; each distinct word that the task has not
met goes to the library once, many in one call, and its ids are kept. A text's
ids are then gathered from there. The store is bounded and starts anew when full.

Texts with white space beyond ASCII, control characters or combining marks, on
which libraries' ideas of white space differ, go to the library whole. So do texts
that hold the string of a special token, which the library gives that token's id.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from memberrisk.llm import common as C

#: Distinct words kept in a task's memory.
WORDS = 1_200_000
#: New words that are kept apart before they are merged with the others.
RECENT = 50_000
#: Words of one call of the library, and of one text of a call (long ones take it longer).
CALL, LOT = 20_000, 50
_EMPTY, _END = 0, 1

# First bytes of characters that need a closer look, and control characters.
_LOOK = np.zeros(256, bool)
_LOOK[[*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F, 0xC2, 0xCC, 0xCD, 0xE1, 0xE2, 0xE3, 0xEF]] = True


def _odd(data: np.ndarray) -> np.ndarray:
    """Positions of characters that send a text to the library whole."""
    at = np.flatnonzero(_LOOK[data])
    if not len(at):
        return at
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = data[at], padded[at + 1], padded[at + 2]
    two = (b.astype(np.int32) << 8) | c
    odd = (a < 0x80) | (a == 0xC2) & (b <= 0xA0) | (a == 0xCC) | (a == 0xCD) & (b <= 0xAF)
    odd |= (a == 0xE1) & ((two == 0x9A80) | (two == 0xA08E))
    odd |= (a == 0xE2) & ((two >= 0x8080) & (two <= 0x808F) | (two >= 0x80A8) & (two <= 0x80AF) | (two >= 0x819F) & (two <= 0x81AF))
    odd |= (a == 0xE3) & (two == 0x8080) | (a == 0xEF) & (two == 0xBBBF)
    return at[odd]


class Encoder:
    """Ids of texts; made once a Python worker for each vocabulary file."""

    _made: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted({a.content.encode() for a in self.tokenizer.get_added_tokens_decoder().values()})
        self.spaced = spaced
        if spaced:  # a word's first token starts with its space, and no other does
            self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True
        self.mark = self._ids("\n" if spaced else "\x01")  # stands between words given in one call
        self._start()

    @classmethod
    def of(cls, path: str, spaced: bool) -> Encoder:
        """``spaced``: white space matters (byte-level); else it only separates."""
        if (path, spaced) not in cls._made:
            cls._made[path, spaced] = cls(path, spaced)
        return cls._made[path, spaced]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    # -- the store: pieces by number, words by hash
    def _start(self) -> None:
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.flat, self.used = np.zeros(1 << 20, np.uint16 if small else np.uint32), 0
        self.at, self.size, self.count = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32), 0
        # Sorted hashes and piece numbers of most words, and of the latest ones.
        self.keys, self.number = [np.zeros(0, np.uint64)] * 2, [np.zeros(0, np.int32)] * 2
        self.gaps: dict[bytes, int] = {}
        self._add([np.zeros(0, np.uint32), np.zeros(1, np.uint32)])

    def _add(self, pieces: list[np.ndarray]) -> np.ndarray:
        """Numbers of new pieces."""
        size = np.array([len(p) for p in pieces], np.int64)
        return self._add_flat(np.concatenate(pieces) if pieces else np.zeros(0, np.uint32), size)

    def _add_flat(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(size) > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.flat[self.used:self.used + len(ids)] = ids
        new = slice(self.count, self.count + len(size))
        self.at[new], self.size[new] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)
        self.count += len(size)
        return np.arange(new.start, new.stop)

    def _gap(self, gap: bytes) -> int:
        """Number of white space before a word (what the word itself does not take) or after the last one."""
        if gap not in self.gaps:
            text = gap.decode()
            tail = text.endswith("\0")  # after the last word: one piece
            text = text.rstrip("\0")
            parts = [text] if tail else [text[:-1], text[-1:] if text[-1:] != " " else ""]
            self.gaps[gap] = int(self._add([np.concatenate([np.zeros(0, np.uint32), *(self._ids(p) for p in parts if p)])])[0])
        return self.gaps[gap]

    def _learn(self, keys: np.ndarray, words: list[bytes], spaced: np.ndarray) -> None:
        """Store new words; ``spaced``: those that take a space before them."""
        numbers = np.zeros(len(keys), np.int64)
        for flag in (False, True):
            own = np.flatnonzero(spaced == flag)
            for i in range(0, len(own), CALL):
                part = own[i:i + CALL]
                numbers[part] = self._encode_words([words[j] for j in part], flag)
        self._merge(1, keys, numbers)
        if len(self.keys[1]) > RECENT:
            self._merge(0, self.keys[1], self.number[1])
            self.keys[1], self.number[1] = self.keys[1][:0], self.number[1][:0]

    def _merge(self, tier: int, keys: np.ndarray, numbers: np.ndarray) -> None:
        at = np.searchsorted(self.keys[tier], keys)  # both are sorted
        self.keys[tier] = np.insert(self.keys[tier], at, keys)
        self.number[tier] = np.insert(self.number[tier], at, numbers)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers of words, -1 for new ones."""
        out = np.full(len(keys), -1, np.int64)
        for held, number in zip(self.keys, self.number):
            if len(held):
                at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
                hit = held[at] == keys
                out[hit] = number[at[hit]]
        return out

    def _encode_words(self, words: list[bytes], spaced: bool) -> np.ndarray:
        between = b" " if spaced else b"\n" if self.spaced else b" \x01 "
        lots = [(between + between.join(words[i:i + LOT])).decode() for i in range(0, len(words), LOT)]
        found = self.tokenizer.encode_batch_fast(lots, add_special_tokens=False)  # without offsets
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32)
        first = np.flatnonzero(self.opens[ids] if spaced else ids == self.mark[0])
        if len(first) == len(words) and (spaced or len(self.mark) == 1):
            size = np.diff(np.concatenate([first, [len(ids)]]))
            if not spaced:  # without the marks
                keep = np.ones(len(ids), bool)
                keep[first] = False
                return self._add_flat(ids[keep], size - 1)
            return self._add_flat(ids, size)
        return self._add([self._ids((" " * spaced) + w.decode()) for w in words])

    # -- texts
    def encode_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text with the end id 0 appended, one after the other."""
        for w in C.words(column):
            if len(self.keys[0]) > WORDS:
                self._start()
            ids, ends = self._slice(w)
            odd = set((np.searchsorted(w.edge, _odd(w.data), side="right") - 1).tolist()) | self._special(w)
            for d in range(len(w.first) - 1):
                if d in odd:
                    text = w.data[w.edge[d]:w.edge[d + 1]].tobytes().decode()
                    yield np.concatenate([self._ids(text), np.zeros(1, np.uint32)])
                else:
                    yield ids[ends[d]:ends[d + 1]]

    def _special(self, w: C.Words) -> set[int]:
        """Texts in whose bytes the string of a special token stands."""
        data, found = w.data.tobytes(), []
        for token in self.special:
            at = data.find(token)
            while at >= 0:
                found.append(at)
                at = data.find(token, at + 1)
        return set((np.searchsorted(w.edge, np.array(found, np.int64), side="right") - 1).tolist())

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text."""
        return next(self.encode_column(pa.array([text])))[:-1]

    def _slice(self, w: C.Words) -> tuple[np.ndarray, np.ndarray]:
        n, docs = len(w.hash), len(w.first) - 1
        doc = np.repeat(np.arange(docs), np.diff(w.first))
        gap, tail = np.full(n, _EMPTY), np.full(docs, _EMPTY)
        spaced = np.zeros(n, bool)
        if self.spaced:
            before = np.concatenate([[0], w.end[:-1]])
            opens = np.concatenate([[True], doc[1:] != doc[:-1]])[:n]
            before = np.where(opens, w.edge[doc], before[:n]) if n else before[:0]
            length = w.start - before
            spaced = (length > 0) & (w.data[np.maximum(w.start - 1, 0)] == 0x20)
            for i in np.flatnonzero((length > 1) | (length == 1) & ~spaced).tolist():
                gap[i] = self._gap(w.data[before[i]:w.start[i]].tobytes())
            last = w.edge[:-1].copy()
            has = w.first[1:] > w.first[:-1]
            last[has] = w.end[w.first[1:][has] - 1]
            for d in np.flatnonzero(last < w.edge[1:]).tolist():
                tail[d] = self._gap(w.data[last[d]:w.edge[d + 1]].tobytes() + b"\0")
        key = C.mix(w.hash + spaced * C.GOLDEN) if self.spaced else w.hash
        keys, one, which = np.unique(key, return_index=True, return_inverse=True)
        number = self._find(keys)
        new = np.flatnonzero(number < 0)
        if len(new):
            data = w.data.tobytes()
            self._learn(keys[new], [data[s:e] for s, e in zip(w.start[one[new]].tolist(), w.end[one[new]].tolist())], spaced[one[new]])
            number = self._find(keys)
        # Pieces in order: before each word its gap; after a text its last gap and the end id.
        pieces = np.empty(2 * n + 2 * docs, np.int64)
        place = 2 * np.arange(n) + 2 * doc
        pieces[place], pieces[place + 1] = gap, number[which]
        place = 2 * w.first[1:] + 2 * np.arange(docs)
        pieces[place], pieces[place + 1] = tail, _END
        size = self.size[pieces]
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[pieces] - ends + size, size)]
        return ids.astype(np.uint32), np.concatenate([[0], ends[place + 1]])


def encode_column(column: pa.Array, path: str, spaced: bool) -> Iterator[np.ndarray]:
    """Ids of each text with the end id 0 appended, one after the other."""
    return Encoder.of(path, spaced).encode_column(column)
