"""Terms of Arrow text columns: maximal runs of chosen characters, lower-cased, whole columns at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import split_words


def byte_table(digits: bool) -> bytes:
    """Letters A-Z become a-z, other bytes of terms stay, all else is a space. Every byte of a character
    beyond ASCII is 0x80 or more, so bytes decide as characters would."""
    keeps = lambda b: b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or (digits and 0x30 <= b <= 0x39)
    return bytes((b + 32 if 0x41 <= b <= 0x5A else b) if keeps(b) else 0x20 for b in range(256))


#: ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` and ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``.
LETTERS, LETTERS_AND_DIGITS = byte_table(False), byte_table(True)


def split_terms(texts: pa.Array, table: bytes) -> tuple[pa.Array, np.ndarray]:
    """(all terms in order, number of terms of each text); a null text has none."""
    whole = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    body = memoryview(data)[at[0] : at[-1]].tobytes().translate(table) if data is not None else b""
    clean = pa.Array.from_buffers(pa.large_string(), len(whole), [None, pa.py_buffer(np.ascontiguousarray(at - at[0])), pa.py_buffer(body)])
    return split_words(clean)
