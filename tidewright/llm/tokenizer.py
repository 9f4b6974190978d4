"""Problem 8: byte-level BPE of a whole corpus with a public vocabulary.

A text is cut by the vocabulary's pattern; the bytes of a piece are merged by rank. A segment tree over the byte
positions holds at each node the least key of its pairs, where a key is the pair's rank times the tree's width plus
its position, so that the root names the leftmost pair of least rank. A merge updates only the pairs at the merged
position and at its live neighbours, each in logarithmic time, so a piece of n bytes takes n log n steps.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Where the vocabularies are; a parameter of every function here.
VOCABULARY = os.environ.get("TIDEWRIGHT_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered by a Python worker; the memory is emptied when full, which changes no result.
REMEMBERED = 200_000

_FREE = 1 << 62


def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the leftmost pair of least rank is merged until no pair has a rank."""
    n = len(piece)
    if n == 0:
        return []
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    width = 1 << max(0, (n - 2).bit_length())  # leaves: pairs (i, its live right neighbour), i = 0 .. n-2
    tree = [_FREE] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r * width + i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    right = list(range(1, n + 1))  # start of the next live token; n: none
    left = list(range(-1, n - 1))

    def put(i: int, key: int) -> None:
        k = width + i
        tree[k] = key
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            m = a if a < b else b
            if tree[k] == m:
                break
            tree[k] = m
            k >>= 1

    while (top := tree[1]) < _FREE:
        i = top % width
        j = right[i]
        after = right[j]
        right[i] = after
        if after < n:
            left[after] = i
        if j < n - 1:
            put(j, _FREE)  # the pair that began at the swallowed token
        if after < n:
            r = get(piece[i : right[after]])
            put(i, _FREE if r is None else r * width + i)
        else:
            put(i, _FREE)
        p = left[i]
        if p >= 0:
            r = get(piece[p : right[i]])
            put(p, _FREE if r is None else r * width + p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : right[i]]])
        i = right[i]
    return out


class Encoder:
    """Encodes texts; text that looks like a special token is ordinary text."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        self.ranks = read_vocabulary(path)
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                # a lone surrogate can't be in a Spark string; if one comes from elsewhere it is encoded as U+FFFD
                ids = merge(piece.encode("utf-8", "replace"), self.ranks)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = ids
            out += ids
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str = VOCABULARY, pattern: str = PATTERN) -> Encoder:
    """One encoder a Python worker."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, pattern: str = PATTERN, lengths_only: bool = False) -> DataFrame:
    """(key, ids), or (key, tokens) with their number alone, of every row's whole text.

    Null and empty texts give an empty list, or 0. Repeated rows give repeated rows; other columns, whatever their
    names, play no part; an empty table gives no rows. One pass without a shuffle; the vocabulary is read by each
    worker from `path`, which every executor must have.
    """
    kind = dict(docs.dtypes)[key]
    out = "tokens" if lengths_only else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):  # keeps the lists of long texts small in memory
                ids = [e.encode(t) for t in texts[at : at + 500]]
                value = pa.array([len(x) for x in ids], pa.int64()) if lengths_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), value], names=[key, out])

    schema = f"`{key}` {kind}, {out} " + ("bigint" if lengths_only else "array<int>")
    return spread(docs.select(F.col(key), F.col(text)), key).mapInArrow(run, schema)
