"""Token counts by a linear longest-match automaton (operator 5).

Greedy longest-match word pieces of every word, counted without building them.
The vocabulary is a byte trie. Each node knows where matching goes on when it has
no child for the next byte (its failure link) and how many pieces that step
pops. A node that ends a piece pops that one piece and fails to the root;
another node takes its parent's way until a node has the child it needs. So
each byte is read once, and a step back never reads text again.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; its pieces are
those of the word with one space before it. The byte-level vocabulary holds
every single byte, so nothing is unknown.

Words are looked at once a slice (equal words share a 64-bit hash) and advance
through the automaton together, byte by byte, as arrays; a word longer than
``LONG`` bytes goes alone. The automaton is broadcast; its size is the
vocabulary's.

Edge cases: null or empty text: 0 words, 0 tokens. Null and repeated ids keep
their rows. Words of any length are counted whole.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memberrisk.llm import common as C

LONG = 128


def byte_vocabulary(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file, whose characters stand for bytes."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letter = {chr(b): b for b in shown}
    letter |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    return [bytes(letter[c] for c in piece) for piece in vocabulary if all(c in letter for c in piece)]


@dataclass
class Automaton:
    keys: np.ndarray    # sorted: node * 256 + byte
    child: np.ndarray   # the node that each key leads to
    fail: np.ndarray    # by node; the root is 0
    pops: np.ndarray    # pieces that the step along the failure link pops

    @classmethod
    def of(cls, vocabulary: list[bytes]) -> Automaton:
        if len({p for p in vocabulary if len(p) == 1}) < 256:
            raise ValueError("the vocabulary must hold every single byte")
        child: dict[int, int] = {}
        parent, byte, piece = [0], [0], [False]
        for entry in vocabulary:
            node = 0
            for b in entry:
                after = child.get(node * 256 + b)
                if after is None:
                    after = child[node * 256 + b] = len(parent)
                    parent.append(node)
                    byte.append(b)
                    piece.append(False)
                node = after
            piece[node] = node > 0
        depth = np.zeros(len(parent), np.int64)
        for node in range(1, len(parent)):  # a parent's number is smaller
            depth[node] = depth[parent[node]] + 1
        fail, pops = [0] * len(parent), [0] * len(parent)
        for node in np.argsort(depth, kind="stable")[1:].tolist():
            if piece[node]:
                pops[node] = 1  # and on from the root
                continue
            at, n = fail[parent[node]], pops[parent[node]]
            while at * 256 + byte[node] not in child:
                n += pops[at]
                at = fail[at]
            fail[node], pops[node] = child[at * 256 + byte[node]], n
        keys = np.array(sorted(child), np.int64)
        return cls(keys, np.array([child[k] for k in keys.tolist()], np.int32), np.array(fail, np.int32), np.array(pops, np.int32))

    def count_one(self, word: bytes) -> int:
        child, fail, pops = self._tables()
        node = n = 0
        for b in word:
            after = child.get(node * 256 + b)
            while after is None:
                n += pops[node]
                node = fail[node]
                after = child.get(node * 256 + b)
            node = after
        while node:
            n += pops[node]
            node = fail[node]
        return n

    def _tables(self):
        if not hasattr(self, "_dict"):
            self._dict = (dict(zip(self.keys.tolist(), self.child.tolist())), self.fail.tolist(), self.pops.tolist())
        return self._dict

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each word ``data[start:end]`` with a space before it."""
        size = end - start
        out = np.zeros(len(start), np.int64)
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = self.count_one(b" " + data[start[i]:end[i]].tobytes())
        # Longest first, so that the words still being read are a prefix.
        order = np.flatnonzero(size <= LONG)
        order = order[np.argsort(-size[order], kind="stable")]
        size, start = size[order], start[order]
        space = int(self.child[np.searchsorted(self.keys, 32)])
        node, n = np.full(len(order), space, np.int64), np.zeros(len(order), np.int64)
        live = len(order)
        for t in range(int(size[0]) if live else 0):
            live = int(np.searchsorted(-size, -t, side="left"))  # words of more than t bytes
            byte = data[start[:live] + t].astype(np.int64)
            todo = np.arange(live)
            while len(todo):
                key = node[todo] * 256 + byte[todo]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[at] == key
                node[todo[found]] = self.child[at[found]]
                todo = todo[~found]
                n[todo] += self.pops[node[todo]]
                node[todo] = self.fail[node[todo]]
        todo = np.flatnonzero(node)
        while len(todo):
            n[todo] += self.pops[node[todo]]
            node[todo] = self.fail[node[todo]]
            todo = todo[node[todo] > 0]
        out[order] = n
        return out


def count_tokens(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for w in C.words(batch.column(1)):
            rows = slice(w.row, w.row + len(w.first) - 1)
            n_words[rows] = np.diff(w.first)
            if len(w.hash):
                _, one, which = np.unique(w.hash, return_index=True, return_inverse=True)
                pieces = shared.value.count(w.data, w.start[one], w.end[one])[which]
                total = np.concatenate([[0], np.cumsum(pieces)])
                n_tokens[rows] = total[w.first[1:]] - total[w.first[:-1]]
        return C.batch_of({"doc_id": batch.column(0), "n_words": pa.array(n_words), "n_tokens": pa.array(n_tokens)})

    return C.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                         "doc_id long, n_words long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(C.documents(spark, sf_dir), Automaton.of(byte_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))))
