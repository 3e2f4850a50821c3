"""Words of texts as bytes: a table maps A-Z to a-z, what belongs to a word to itself and all else to a blank."""

from __future__ import annotations

import pyarrow as pa


def fold_table(letters: bool = True, digits: bool = True) -> bytes:
    """A table for bytes.translate(): ASCII letters lower-cased, digits if asked for, and all bytes of other characters."""
    low = {b + 32: b + 32 for b in range(65, 91)} | {b: b + 32 for b in range(65, 91)} if letters else {}
    return bytes(low.get(b, b if b >= 128 or (digits and 48 <= b <= 57) else 32) for b in range(256))


#: Only A-Z lower-cased, nothing else changed.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an array of strings; a null is empty."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
