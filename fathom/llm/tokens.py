"""Byte-level BPE ids for batches of texts, with the tokenizers library.

Byte-level BPE never merges across the splits of its pre-tokenizer, so the ids
of a text are those of its chunks in a row for any cut at such splits. Each
distinct chunk is encoded by the library once in a worker's lifetime; a batch
then maps to ids through sorted chunk hashes.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from fathom.llm import blocks

#: Chunks that a worker remembers; beyond this it starts afresh.
REMEMBERED = 3_000_000
_LETTER, _SPACE, _PUNCT = (np.zeros(256, bool) for _ in range(3))
_LETTER[65:91] = _LETTER[97:123] = True
_SPACE[[32, 9, 10, 11, 12, 13, 28, 29, 30, 31]] = True
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_AFTER = _PUNCT.copy()
_AFTER[39] = False  # what follows an apostrophe may belong to it
#: White space outside ASCII, as UTF-8; and control characters that engines class differently.
_ODD = re.compile(rb"\xc2[\x80-\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f-\xa4]|\xe3\x80\x80|[\x00-\x08\x0e-\x1f\x7f]")


class Encoder:
    """encode() gives the ids of texts; the vocabulary's added tokens are found in them
    as the library does it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = re.compile(b"|".join(re.escape(x.content.encode()) for x in added)) if added else None
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    def _learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        """chunks, in the order of their sorted keys, become known."""
        texts = [c.decode() for c in chunks]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int32, len(found))
        total = int(size.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(total, self.used), self.dtype)])
        self.pool[self.used : self.used + total] = np.fromiter((i for ids in found for i in ids), self.dtype, total)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.size = np.insert(self.keys, where, keys), np.insert(self.size, where, size)
        self.at = np.insert(self.at, where, self.used + np.cumsum(size) - size)
        self.used += total

    def _spans(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the chunks: places where the pre-tokenizer surely splits."""
        if not len(data):
            return np.zeros(0, np.int64)
        space, letter = _SPACE[data], _LETTER[data]
        cut = np.zeros(len(data), bool)
        before, after = ~space[:-1], ~space[1:]
        cut[1:] = (before & space[1:]) | (letter[:-1] & _PUNCT[data[1:]]) | (_AFTER[data[:-1]] & letter[1:])
        cut[1:] |= space[:-1] & (data[:-1] != 32) & after
        # a run of white space is split by rules that look at its end: keep it whole, with what follows
        run = space[:-1] & space[1:]
        if run.any():
            inside = np.flatnonzero(run) + 1
            cut[inside] = False
            ends = inside[(inside + 1 < len(data)) & ~space[np.minimum(inside + 1, len(data) - 1)]] + 1
            cut[ends] = False
        cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of the texts in them)."""
        n = len(offsets) - 1
        raw = data.tobytes()
        if _ODD.search(raw) or self.added and self.added.search(raw):
            return self._plain(raw, offsets)
        start = self._spans(data, offsets)
        end = np.append(start[1:], len(data))
        keys = blocks.span_hashes(data, start, end)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > REMEMBERED:
            self._forget()
        where = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == distinct[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            self._learn(distinct[new], [raw[start[i] : end[i]] for i in first[new].tolist()])
            where = np.searchsorted(self.keys, distinct)
        at, size = self.at[where][back], self.size[where][back].astype(np.int64)
        begin = np.cumsum(size) - size
        total = int(size.sum())
        ids = self.pool[np.arange(total) + np.repeat(at - begin, size)] if total else np.zeros(0, self.dtype)
        bounds = np.append(begin, total)
        return ids, bounds[np.searchsorted(start, offsets, "left")] if n else np.zeros(1, np.int64)

    def _plain(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), self.dtype, int(size.sum())), np.append(0, np.cumsum(size))

    def texts(self, column: pa.Array, end_id: int):
        """The ids of each text with end_id after them; null is empty."""
        for _, _, data, offsets in blocks.text_slices(column):
            ids, at = self.encode(data, offsets)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                out = np.empty(b - a + 1, np.uint32)
                out[:-1] = ids[a:b]
                out[-1] = end_id
                yield out


_known: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it lasts as long as the worker."""
    if path not in _known:
        _known[path] = Encoder(path)
    return _known[path]
