"""Encoding of text columns piece by piece: equal pieces of a batch are encoded once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time, and pieces that a worker remembers.
SLICE_BYTES = 4_000_000
REMEMBERED = 400_000

#: A blank that may not be cut before: it stands at an end or beside other white space.
_UNSAFE = re.compile(r"^ | $|\s | \s")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in slices of about most bytes of text; a longer text is a slice by itself."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cut = 0
    while cut < batch.num_rows:
        base = size[cut - 1] if cut else 0
        end = max(cut + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(cut, end - cut)
        cut = end


def text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """slices() of an array of texts."""
    for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
        yield part.column(0)


class PieceEncoder:
    """ids of texts, from the ids of their pieces.

    encode gives the ids of a string. With glue, a piece keeps the blank before
    it (for patterns that attach a blank to the next word); then texts are cut
    only at blanks between two visible characters. Many pieces are encoded as one
    string, apart is what stands between them: it must give one id of its own,
    which nothing else gives, and keep its neighbours from joining. fold lower-cases
    A to Z first, for tokenizers that do so anyway.
    """

    def __init__(self, encode: Callable[[str], list[int]], glue: bool, apart: str, fold: bool = False):
        self.encode, self.glue, self.apart, self.fold = encode, glue, apart, fold
        (self.apart_id,) = encode(apart)
        self.odd = re.compile(rf"[^\S ]|.\s|^ ?$|{re.escape(apart.strip(' '))}", re.DOTALL)
        self.known: dict[str, list[int]] = {}

    def _learn(self, pieces: list[str]) -> None:
        odd = [p for p in pieces if self.odd.search(p)]
        self.known.update((p, self.encode(p)) for p in odd)
        plain = [p for p in pieces if p not in self.known] if odd else pieces
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            ids = self.encode(self.apart.join(part))
            ends = [-1, *np.flatnonzero(np.array(ids) == self.apart_id).tolist(), len(ids)]
            self.known.update((p, ids[a + 1 : b]) for p, a, b in zip(part, ends, ends[1:], strict=False))

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        # a word and the stop or comma at its end are two matches of the pattern (lower(): U+0130 ends in a mark then)
        stems = [p[:-1] if p[-1:] in (".", ",") and p[-2:-1].lower().isalnum() else p for p in pieces]
        wanted = dict.fromkeys(stems)
        wanted.update({".": None, ",": None})
        missing = [p for p in wanted if p not in self.known]
        if len(self.known) + len(missing) > REMEMBERED:
            self.known.clear()
            missing = list(wanted)
        self._learn(missing)
        known = self.known
        return [known[s] if len(s) == len(p) else known[s] + known[p[-1]] for s, p in zip(stems, pieces)]

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Bounds of each text's pieces, the pieces, and which of them lost a blank in front."""
        if not self.glue:
            lists = pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts) if self.fold else texts, "\n", " "), " ")
            return lists.offsets.to_numpy(), lists.values, np.zeros(len(lists.values), dtype=bool)
        plain = texts.to_pylist()
        if any(map(_UNSAFE.search, plain)):
            cut = [_SAFE_CUT.split(t) if _UNSAFE.search(t) else t.split(" ") for t in plain]
            bounds = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
            values = pa.array(list(chain.from_iterable(cut)), pa.string())
        else:
            lists = pc.split_pattern(texts, " ")
            bounds, values = lists.offsets.to_numpy().astype(np.int64), lists.values
        led = np.ones(len(values), dtype=bool)
        led[bounds[:-1]] = False
        return bounds, values, led

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each text's ids, and all ids (int32) one after the other. texts: no nulls."""
        if not len(texts):
            return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)
        bounds, values, led = self._cut(texts)
        coded = values.dictionary_encode()
        key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + led
        words = coded.dictionary.to_pylist()
        there = np.zeros(2 * len(words), dtype=bool)
        there[key] = True
        of = np.cumsum(there) - 1
        ids = self._ids([(" " if k & 1 else "") + words[k >> 1] for k in np.flatnonzero(there).tolist()])
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(size.sum()))
        start = np.cumsum(size) - size
        piece = of[key]
        length = size[piece]
        end = np.cumsum(length)
        total = int(end[-1]) if len(end) else 0
        out = flat[np.arange(total) + np.repeat(start[piece] - (end - length), length)]
        return np.concatenate([[0], end])[bounds], out
