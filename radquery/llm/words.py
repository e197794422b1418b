"""Words of texts as Arrow and numpy arrays, for use inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split into words at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system; a worker is used again, and its executor's memory has room for few large ones."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


class Words(NamedTuple):
    codes: np.ndarray  # int32, an index into distinct for each word
    offsets: np.ndarray  # int64, words of text i: codes[offsets[i]:offsets[i + 1]]
    distinct: pa.Array  # strings


def texts_of(column: pa.Array) -> pa.Array:
    """Strings without nulls: a null text is an empty one."""
    return pc.fill_null(column, "")


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most so many bytes of text each, or a single row."""
    column = batch.column(batch.schema.get_field_index(text))
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at)
        give_back()
        at = to


def split_flat(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` one after another, and their offsets by text."""
    lists = pc.ascii_split_whitespace(texts)
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # white space at either end leaves an empty string there
        before = np.concatenate(([0], np.cumsum(full)))
        flat, offsets = flat.filter(pa.array(full)), before[offsets]
    return flat, offsets.astype(np.int64)


def split_words(texts: pa.Array) -> Words:
    flat, offsets = split_flat(texts)
    coded = flat.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False), offsets, coded.dictionary)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[i]:starts[i] + lengths[i]] for each i, one after another."""
    if not len(lengths):
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
