"""Byte-pair encoding by segment trees, and decoding.

The leaves of a tree are the ranks of the adjacent pairs of a word's symbols; a
node holds the least (rank, place) below it, so that the root is the leftmost
pair of lowest rank. A merge changes three leaves at most and the nodes above
them, until the root holds no pair: n symbols take O(n log n) steps, also a
word of a million letters. Words are what the vocabulary file's own splitter
makes of a text, around its added tokens; a worker merges each distinct word once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.base import bounded_batches
from fathom.llm.blocks import text_slices
from fathom.llm.tokens import Encoder

#: What a leaf without a mergeable pair holds, and the bits of a place in the others.
FREE, PLACE = 1 << 96, 40
#: Words that a worker remembers beside its chunks; beyond this it starts afresh.
REMEMBERED = 100_000


class Ids(NamedTuple):
    ids: list[int]


def merged(symbols: list[int], ranks: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """symbols after all merges. ranks: of pairs; made: the symbol that each rank makes."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    width = 1 << (n - 2).bit_length()
    tree = [FREE] * (2 * width)

    def leaf(i: int) -> int:
        rank = ranks.get((symbols[i], symbols[after[i]])) if after[i] < n else None
        return FREE if rank is None else rank << PLACE | i

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        while k > 1:
            k >>= 1
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                return
            tree[k] = low

    tree[width : width + n - 1] = [leaf(i) for i in range(n - 1)]
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    while tree[1] != FREE:
        rank, i = tree[1] >> PLACE, tree[1] & (1 << PLACE) - 1
        gone = after[i]
        symbols[i], symbols[gone] = made[rank], -1
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        if gone < n - 1:
            put(gone, FREE)
        if i < n - 1:
            put(i, leaf(i))
        if before[i] >= 0:
            put(before[i], leaf(before[i]))
    return [s for s in symbols if s >= 0]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it
    is printable, else the next one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class TreeTokenizer:
    """Encodes as the library does with the same file, but merges by segment trees."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.vocabulary = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(self.vocabulary[a], self.vocabulary[b]): rank for rank, (a, b) in reversed([*enumerate(pairs)])}
        self.made = [self.vocabulary[a + b] for a, b in pairs]
        self.added = {x.content: i for i, x in library.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.known: dict[str, list[int]] = {}
        as_byte = {letter: byte for byte, letter in enumerate(byte_letters())}
        content = {i: t for t, i in (self.vocabulary | self.added).items()}
        self.pieces = [bytes(as_byte[c] for c in t) if all(c in as_byte for c in t) else t.encode() for t in (content.get(i, "") for i in range(max(content) + 1))]

    def word(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = merged([self.vocabulary[c] for c in word], self.ranks, self.made)
            if len(word) < 1024:
                self.known[word] = found
        return found

    def ids(self, text: str) -> list[int]:
        found: list[int] = []
        for part in self.cut.split(text) if self.cut else (text,):
            if part in self.added:
                found.append(self.added[part])
            elif part:
                for word, _ in self.split(part):
                    found += self.word(word)
        return found

    def encode_batch_fast(self, texts: list[str], add_special_tokens: bool = False) -> list[Ids]:
        return [Ids(self.ids(t)) for t in texts]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")


class TreeEncoder(Encoder):
    """Batches of texts, each distinct chunk of them encoded once, by segment trees."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer = TreeTokenizer(path)


_known: dict[str, TreeEncoder] = {}


def tree_encoder(path: str) -> TreeEncoder:
    """The worker's encoder for a vocabulary file; it lasts as long as the worker."""
    if path not in _known:
        _known[path] = TreeEncoder(path)
    return _known[path]


def encoded(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of each row of docs, other columns left out whatever their
    names; ids are little-endian unsigned 32-bit integers in a binary. A null text is an
    empty one and has no ids; repeated rows and null ids stay as they are. Nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tree_encoder(tokenizer)
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column("text")):
                ids, at = enc.encode(data, offsets)
                ids = np.ascontiguousarray(ids, "<u4")
                found = pa.array([ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:end], pa.array(np.diff(at).astype(np.int64)), found], schema=schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def decoded(rows: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """rows with `decoded`, the text of their ids (as encoded() gives them), special tokens
    with it; a column of that name is replaced. Null ids have a null text; an id outside
    the vocabulary is an error."""
    bounded_batches(rows.sparkSession)
    rows = rows.drop("decoded")
    place = rows.columns.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = tree_encoder(tokenizer).tokenizer.decode
        for batch in batches:
            found = [None if x is None else text(np.frombuffer(x, "<u4").tolist()) for x in (v.as_buffer() if v.is_valid else None for v in batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(decode, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "decoded string"]))
