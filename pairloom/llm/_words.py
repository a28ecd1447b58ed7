"""Words of a batch of texts: each different word once, and where it stands."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different words, number of each word in order, bounds of each text).

    Words are what stands between the six ASCII blanks. A text that begins or ends
    with blanks may have empty words there.
    """
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    return _numbered(lists)


def split(texts: pa.Array, mark: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The same for what stands between marks."""
    return _numbered(pc.split_pattern(texts, mark))


def _numbered(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    bounds = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    return flat.dictionary, flat.indices.to_numpy(zero_copy_only=False), bounds - bounds[0]


def no_blanks(found: tuple[pa.Array, np.ndarray, np.ndarray]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Without the empty words."""
    different, number, bounds = found
    empty = pc.index(different, pa.scalar("", different.type)).as_py()
    if empty < 0:
        return found
    full = number != empty
    before = np.concatenate([[0], np.cumsum(full)])
    return different, number[full], before[bounds]


def taken(blob: np.ndarray, ends: np.ndarray, number: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[number] end to end, and the texts' bounds in them; value i stands from ends[i] to ends[i + 1] of blob."""
    each = np.diff(ends)[number]
    upto = np.concatenate([[0], np.cumsum(each)])
    at = np.repeat(ends[:-1][number] - upto[:-1], each)
    at += np.arange(upto[-1])
    return blob[at], upto[bounds]


def slices(texts: pa.Array, size: int, do: Callable[[pa.Array], list]) -> list:
    """``do`` over about ``size`` bytes at a time; the results as one list."""
    out: list = []
    for start, stop in cuts(texts, size):
        out += do(texts.slice(start, stop - start))
    return out


def cuts(texts: pa.Array, size: int) -> list[tuple[int, int]]:
    """Bounds of runs of texts of about ``size`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, start, done = [], 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, done + size)))
        stop = min(stop, len(texts))
        out.append((start, stop))
        start, done = stop, int(ends[stop - 1])
    return out


def plain(column: pa.Array) -> pa.Array:
    """A text column with null as the empty text."""
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column
