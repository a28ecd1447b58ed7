"""What Python workers remember: bounded by bytes, and only as long as a stage lasts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

from pairloom.llm._words import taken

#: Bytes that the words of a generation take at most, by a rough count.
MOST_BYTES = 12 << 20
#: What a word and its value take besides their own bytes.
_ENTRY = 160

_kept: dict[Hashable, Any] = {}
_kept_for: list[int | None] = [None]


class WordMemo:
    """Maps words to encoded values; unknown words are encoded together, in bulk.

    It has two generations of about ``most`` bytes each. When the young one is full
    it becomes the old one, and words that turn up again move back from there. So its
    memory has a bound, frequent words stay, and results don't depend on it. Words of
    more than ``longest`` letters or bytes are not kept.
    """

    def __init__(self, encode: Callable[[list], list], most: int = MOST_BYTES, longest: int = 64):
        self.encode, self.most, self.longest = encode, most, longest
        self.young: dict = {}
        self.old: dict = {}
        self.size = 0

    def values(self, texts: list[list]) -> list[list]:
        """For each list of words, the list of their values."""
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        young = self.young
        get, old, extra = young.get, self.old.get, {}
        out, gaps = [], []
        for words in texts:
            found = list(map(get, words))
            out.append(found)
            i = -1
            try:
                while True:
                    # The next word that is not known: a scan at the speed of C.
                    i = found.index(None, i + 1)
                    word = words[i]
                    value = old(word)
                    if value is not None:
                        young[word] = found[i] = value
                        self.size += _ENTRY + len(word)
                    else:
                        extra[word] = None
                        gaps.append((found, i, word))
            except ValueError:
                pass
        if extra:
            unknown = list(extra)
            for word, value in zip(unknown, self.encode(unknown)):
                extra[word] = value
                if len(word) <= self.longest and self.size <= self.most:
                    young[word] = value
                    self.size += _ENTRY + len(word)
            for found, i, word in gaps:
                found[i] = extra[word]
        return out


class WordTable:
    """The same for words in Arrow arrays: their values lie end to end in one array.

    When words and values take more than ``most`` bytes, only the words asked for last
    stay.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = MOST_BYTES):
        self.encode, self.most = encode, most
        self.words = pa.array([], pa.large_string())
        self.blob, self.ends = encode([])

    def values(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, ends, place): those of word i stand from ends[place[i]] to ends[place[i] + 1]."""
        place = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            unknown = words.take(pa.array(new))
            place[new] = len(self.words) + np.arange(len(new))
            blob, ends = self.encode(unknown.to_pylist())
            self.ends = np.concatenate([self.ends, ends[1:] + len(self.blob)])
            self.blob = np.concatenate([self.blob, blob])
            self.words = pa.concat_arrays([self.words, unknown])
        out = self.blob, self.ends, place
        if self.words.nbytes + self.blob.nbytes + self.ends.nbytes > self.most:
            self.words = words if words.nbytes < self.most else words.slice(0, 0)
            at = place[: len(self.words)]
            self.blob, self.ends = taken(self.blob, self.ends, at, np.arange(len(at) + 1))
        return out


def of_stage(key: Hashable, make: Callable[[], Any]) -> Any:
    """``make()``, kept by the worker for other tasks of the same stage; what another stage has kept goes."""
    forget_other_stages()
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget_other_stages() -> None:
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if stage != _kept_for[0]:
        _kept.clear()
        _kept_for[0] = stage


def give_back() -> None:
    """Return freed memory to the system, so that the next stage finds it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
