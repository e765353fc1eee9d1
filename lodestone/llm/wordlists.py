"""Words of whole texts as Arrow columns: lower-cased A-Z only, cut at runs of separator characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def word_lists(texts: pa.Array, separators: str) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and how many each text has; a null text has none.

    ``separators`` is the inside of a character class; a word is a maximal run of other characters.
    """
    spaced = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), f"[{separators}]+", " ")
    split = pc.split_pattern(pc.ascii_trim(spaced, " "), " ")
    offsets = split.offsets.to_numpy()
    words, lengths = split.flatten(), np.diff(offsets).astype(np.int64)
    # an empty text splits into one empty word
    lengths[pc.equal(pc.binary_length(spaced), 0).to_numpy(zero_copy_only=False) | pc.equal(spaced, " ").to_numpy(zero_copy_only=False)] = 0
    return words.filter(pc.not_equal(words, "")), lengths


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each run of ``lengths`` begins, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def packed_rows(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Runs of numbers as one binary value a row."""
    ends = starts_of(lengths) * values.itemsize
    kind, offset = (pa.binary(), "<i4") if ends[-1] < 1 << 31 else (pa.large_binary(), "<i8")
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(ends.astype(offset).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def flat_rows(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a binary column, and how many each row has; the reverse of :func:`packed_rows`."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], "<i8" if wide else "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    item = np.dtype(dtype).itemsize
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].tobytes() if data is not None else b""
    return np.frombuffer(body, dtype), np.diff(offsets) // item
