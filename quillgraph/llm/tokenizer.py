"""Encoding with a public byte-level BPE tokenizer by a tokenization automaton.

The merges are compiled in order.  The gadget of merge k, (u, v) -> w, makes the state reached by u forbid v from then
on and gives every state that had an arc u an arc w that leads where v led.  Every arc of one label leads to one state,
so the state is the label read last, and the automaton needs three tables only: the cuts (u, v) -> k, the parts of each
label, and the labels.  A copied state inherits the cuts of the state it was copied from, which belongs to v; so
whether label t may follow label a is decided by the cuts between the right spine of a and the left spine of t that
were made while both ends were current.  Decided arcs are kept in the transition table.

A pre-split word is encoded left to right: exactly one label ending at each byte continues the state at the label's
start.  Decoding emits the labels of the arcs.

Defined results: null and empty texts have the empty list; strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed value: Unicode White_Space, as the tokenizer's \s has it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _split_pattern(letters: str, digits: str, space: str) -> str:
    """The pre-split of this family of tokenizers: contractions, letters, digits, other signs, white space."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+"


_ASCII = re.compile(_split_pattern("A-Za-z", "0-9", r"\t-\r "))
_FULL = None


def pre_split(text: str) -> list[str]:
    """The words of a text; they are encoded on their own, and joined they are the text."""
    global _FULL
    if text.isascii():
        return _ASCII.findall(text)
    if _FULL is None:
        import regex

        _FULL = regex.compile(_split_pattern(r"\p{L}", r"\p{N}", _SPACE))
    return _FULL.findall(text)


def _byte_signs() -> dict[str, int]:
    """Which byte each sign of the vocabulary file stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The compiled automaton: ``cuts``, ``left``, ``right``, ``born`` and ``labels`` as the module docstring has them."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        n = len(labels)
        self.labels = labels
        self.left, self.right, self.born = [-1] * n, [-1] * n, [-1] * n
        self.cuts: dict[int, int] = {}
        for k, (u, v, w) in enumerate(merges):  # one gadget a merge
            self.cuts[u << 20 | v] = k
            self.left[w], self.right[w], self.born[w] = u, v, k
        self.ids = {b: i for i, b in enumerate(labels) if self.born[i] >= 0 or len(b) == 1}
        self.steps: dict[int, int] = {}  # node << 8 | byte -> node of the labels' prefix tree
        self.ends = [-1]  # the label that ends at a node
        for label, t in self.ids.items():
            node = 0
            for b in label:
                key = node << 8 | b
                node = self.steps.get(key, 0)
                if not node:
                    node = self.steps[key] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = t
        self.arcs: dict[int, bool] = {}

    def follows(self, a: int, t: int) -> bool:
        """Whether the state of label ``a`` has an arc ``t``."""
        key = a << 20 | t
        known = self.arcs.get(key)
        if known is None:
            known = self.arcs[key] = self._decide(a, t)
            if len(self.arcs) > 2_000_000:
                self.arcs.clear()
        return known

    def _decide(self, a: int, t: int) -> bool:
        born, newest = self.born, 1 << 30
        until = newest  # cuts of this part of a's spine count if older than the label above it
        while a >= 0:
            u, bound = t, newest  # cuts of this part of t's spine count up to the gadget that made the label above it
            while u >= 0:
                k = self.cuts.get(a << 20 | u)
                if k is not None and k < until and k <= bound:
                    return False
                bound = born[u]
                u = self.left[u]
            until = born[a]
            a = self.right[a]
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """The labels on the one accepted path over the word's bytes."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        n, get, ends, arcs = len(word), self.steps.get, self.ends, self.arcs.get
        last = [-1] * (n + 1)
        for i in range(n):
            node, state = 0, last[i]
            for e in range(i, n):
                node = get(node << 8 | word[e])
                if node is None:
                    break
                t = ends[node]
                if t >= 0 and last[e + 1] < 0:
                    if state >= 0:
                        ok = arcs(state << 20 | t)
                        if not (self.follows(state, t) if ok is None else ok):
                            continue
                    last[e + 1] = t
        out = []
        while n:
            out.append(last[n])
            n -= len(self.labels[last[n]])
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.labels[i] for i in ids)


def compile_vocabulary(path: str = DEFAULT_VOCABULARY) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """(labels by id, merges as id triples) of a vocabulary file in the JSON form."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    signs = _byte_signs()
    vocab: dict[str, int] = model["vocab"]
    labels = [b""] * (max(vocab.values()) + 1)
    for s, i in vocab.items():
        if all(c in signs for c in s):
            labels[i] = bytes(signs[c] for c in s)
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    return labels, [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs]


class _Words(dict):
    """Packed ids of the words met so far; emptied when full, so its size is bounded."""

    FULL = 400_000

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.FULL:
            self.clear()
        packed = np.array(self.automaton.encode_word(word.encode()), np.int32).tobytes()
        if len(word) <= 64:
            self[word] = packed
        return packed


_LOADED: dict[str, _Words] = {}


def words_of(compiled: tuple[list[bytes], list[tuple[int, int, int]]], key: str) -> _Words:
    """This process's word table for the vocabulary of one file."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = _Words(Automaton(*compiled))
    return _LOADED[key]


def encode_packed(words: _Words, text: str | None) -> bytes:
    """The text's ids as packed 32-bit integers."""
    return b"".join(map(words.__getitem__, pre_split(text))) if text else b""


def broadcast_vocabulary(spark: SparkSession, path: str = DEFAULT_VOCABULARY) -> Broadcast:
    """The compiled tables, a few MB whatever the data (the vocabulary's size)."""
    return spark.sparkContext.broadcast(compile_vocabulary(path))


def token_ids(df: DataFrame, id_col: str, text_col: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of each text, without special tokens.  A map over partitions; nothing is shuffled."""
    shared = broadcast_vocabulary(df.sparkSession, path)
    kind = dict(df.dtypes)[id_col]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(shared.value, path)
        for b in batches:
            packed = [encode_packed(words, t) for t in b[1].to_pylist()]
            offsets = np.fromiter(accumulate((len(p) // 4 for p in packed), initial=0), np.int32, len(packed) + 1)
            values = np.frombuffer(b"".join(packed), np.int32)
            yield pa.RecordBatch.from_arrays([b[0], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], [id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, n_tokens), without building the lists."""
    shared = broadcast_vocabulary(df.sparkSession, path)
    kind = dict(df.dtypes)[id_col]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(shared.value, path)
        for b in batches:
            n = [len(encode_packed(words, t)) // 4 for t in b[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[0], pa.array(n, pa.int64())], [id_col, "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_tokens bigint")
