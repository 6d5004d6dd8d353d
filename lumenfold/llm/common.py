"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import broadcast_if_small, new_path, staged

__all__ = ["SPACE", "WORD", "broadcast_if_small", "code_points", "gathered", "let", "new_path", "numbered_words", "release", "released", "staged", "text_slices"]

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: A worker looks at texts of about this many bytes at once; a longer text is looked at alone.
SLICE_BYTES = 8 << 20


def let(value: Column, body) -> Column:
    """body(value) with value computed once for the row, however often body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def code_points(text: Column) -> Column:
    return F.char_length(text).cast("long")


def text_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """texts, a text column of a batch, in runs of rows of about `size` bytes; nulls become empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset + 1 : texts.offset + len(texts) + 1] if len(texts) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(texts):
        start = ends[lo - 1] if lo else ends[0]
        hi = max(lo + 1, int(np.searchsorted(ends, start + size, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def numbered_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, the number of each word of all texts in a row, and per text the end of its words.
    Words are runs of other characters than space, tab, line feed, vertical tab, form feed, carriage return."""
    split = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(split.offsets).astype(np.int64)
    ends = offsets[1:] - offsets[0]
    coded = split.flatten().dictionary_encode()
    words, number = coded.dictionary, coded.indices.to_numpy()
    if (blank := pc.index(words, "").as_py()) >= 0:  # stands before leading and behind trailing white space
        real = number != blank
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        number = number[real]
    return words, number, ends


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat that begin at `begin` and have `size` values each, in a row, and where each begins there, with the
    end of all behind them."""
    after = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat((begin - after[:-1]).astype(np.int32), size) + np.arange(after[-1], dtype=np.int32)], after


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of a task's batches, for Python workers, which outlive their tasks: what a task has freed goes
    back to the system when it ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
