"""Encoding and decoding with a merge-type sentence piece vocabulary.

The encoder is an agenda of adjacent symbol pairs, ordered by the score of the
piece that a pair makes (the leftmost first where scores tie). A word's symbols
are its characters at first; the best pair on the agenda is merged, which puts
its new neighbours there, until no pair makes a piece. What is still not a piece
falls back to its UTF-8 bytes.

No piece of the vocabulary has a space sign after another character, so merges
never cross into the next word, and words are encoded by themselves and
remembered. Nor do they cross two characters that no piece has side by side.
Every newly merged word is checked against the sentencepiece library within the
Arrow batch where it turns up, and so is every text that is not plain words; a
difference is an error, never a wrong result.

Defined cases: a null text is an empty one, which has no ids. Rows that repeat a
doc_id are rows of their own. Extra columns are ignored, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import operator
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm._memo import WordMemo, give_back, of_stage
from pairloom.llm._words import cuts, plain, split

SPACE = "▁"
#: Bytes of text that are encoded at once; each different word of them is looked up once.
BATCH_BYTES = 8 << 20
#: Bytes of words that a worker remembers in a generation, whole words and parts of words each.
MEMO_BYTES = 64 << 20


class PieceCoder:
    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.names: list[str] = []
        scores = []
        for i in range(lib.vocab_size()):
            name = lib.id_to_piece(i)
            self.names.append(name)
            if lib.is_byte(i):
                self.bytes[i] = int(name[1:-1], 16)
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.ids[name] = i
                scores.append(lib.get_score(i))
        order = {s: k for k, s in enumerate(sorted(set(scores), reverse=True))}
        self.rank = {name: order[lib.get_score(i)] for name, i in self.ids.items()}
        self.of_byte = {b: i for i, b in self.bytes.items()}
        # A byte's own name may stand in a text as well; a lone surrogate can't.
        self.surface = ["\ud800" if i in self.bytes else name for i, name in enumerate(self.names)]
        self.digits = [b"%d" % i for i in range(len(self.names))]
        self.joins = {x + y for name in self.ids for x, y in zip(name, name[1:])}
        if any(x != SPACE and y == SPACE for x, y in self.joins):
            raise ValueError("the vocabulary has pieces that reach into the next word")
        if len(self.of_byte) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        self.parts = WordMemo(lambda parts: [tuple(self.merge(p)) for p in parts], MEMO_BYTES)
        self.words = WordMemo(self._checked_words, MEMO_BYTES)

    def merge(self, text: str) -> list[int]:
        """Ids of a run of characters, space signs included."""
        symbols: list[str] = list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        # An entry is (rank, left position) in one integer.
        agenda = [(r << 32) | i for i in range(n - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if not symbols[i] or j >= n:
                continue
            pair = symbols[i] + symbols[j]
            if rank.get(pair) != entry >> 32:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(pair + symbols[k])) is not None:
                    heapq.heappush(agenda, (r << 32) | i)
            h = before[i]
            if h >= 0 and (r := rank.get(symbols[h] + pair)) is not None:
                heapq.heappush(agenda, (r << 32) | h)
        out: list[int] = []
        for s in symbols:
            if s:
                i = self.ids.get(s)
                out.extend([i] if i is not None else [self.of_byte[b] for b in s.encode()])
        return out

    def decode(self, ids: list[int]) -> str:
        out = bytearray()
        for i in ids:
            if i in self.bytes:
                out.append(self.bytes[i])
            else:
                out += self.names[i].encode()
        text = out.decode(errors="replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text

    def _split(self, text: str) -> list[str]:
        """Cut where no piece has the two characters side by side."""
        joins, out, last = self.joins, [], 0
        if joins.issuperset(map(operator.add, text, text[1:])):
            return [text]
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in joins:
                out.append(text[last:i])
                last = i
        out.append(text[last:])
        return out

    def _checked_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, a space sign before it; a comma follows each id."""
        out, surface, digits, start = [], self.surface, self.digits, 0
        cut = [self._split(SPACE + w) for w in words]
        found = self.parts.values([[p for parts in cut for p in parts]])[0]
        for parts, word, told in zip(cut, words, self.library.encode(words, num_threads=1)):
            stop = start + len(parts)
            ids = list(found[start]) if len(parts) == 1 else [i for p in found[start:stop] for i in p]
            start = stop
            if ids != told or ("".join([surface[i] for i in ids]) != SPACE + word and self.decode(ids) != word):
                raise ValueError(f"the library encodes {word!r} as {told}, not as {ids}")
            out.append(b",".join([digits[i] for i in ids]) + b",")
        return out

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, list[memoryview]]:
        """Numbers of ids and comma-joined ids of texts whose words stand one space apart."""
        different, number, bounds = split(texts, " ")
        codes = pa.array(self.words.values([different.to_pylist()])[0], pa.large_binary())
        upto = np.concatenate([[0], np.cumsum(pc.count_substring(codes, ",").to_numpy()[number])])
        # Taken in the order of the words, the codes of a text lie end to end.
        flat = codes.take(pa.array(number))
        at = np.frombuffer(flat.buffers()[1], np.int64)[bounds].tolist()
        view = memoryview(flat.buffers()[2])
        return np.diff(upto[bounds]), [view[i : j - 1] for i, j in zip(at, at[1:])]

    def _encode_other(self, text: str) -> tuple[int, bytes, bytes]:
        """The same for any text, checked as a whole; the decoded text in UTF-8 comes third."""
        if not text:
            return 0, b"", b""
        runs = re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))
        ids = [i for part in self.parts.values([[p for r in runs for p in self._split(r)]])[0] for i in part]
        told = self.library.encode(text, num_threads=1)
        decoded = self.decode(ids)
        if ids != told or decoded != self.library.decode(told):
            raise ValueError(f"the library encodes a text of {len(text)} characters otherwise: {text[:60]!r}")
        return len(ids), b",".join([self.digits[i] for i in ids]), decoded.encode()

    def encode(self, texts: list[str]) -> list[tuple[int, bytes, str]]:
        """For each text: number of ids, ids joined by commas, decoded text."""
        counts, codes, decoded = self.encode_column(pa.array(texts, pa.large_string()))
        return [(n, bytes(c), str(d, "utf-8")) for n, c, d in zip(counts.tolist(), codes, decoded)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, list, list]:
        """Of each text: the number of ids, the ids joined by commas, the decoded text in UTF-8."""
        odd = pc.match_substring_regex(texts, f"^$|^ |  | $|{SPACE}").to_numpy(zero_copy_only=False)
        counts, codes, decoded = np.zeros(len(texts), np.int64), [b""] * len(texts), [b""] * len(texts)
        usual = np.flatnonzero(~odd)
        if len(usual):
            some = texts.take(pa.array(usual))
            counts[usual], found = self._encode_plain(some)
            at, view = np.frombuffer(some.buffers()[1], np.int64).tolist(), memoryview(some.buffers()[2])
            for k, i in enumerate(usual.tolist()):
                codes[i], decoded[i] = found[k], view[at[k] : at[k + 1]]
        for i in np.flatnonzero(odd).tolist():
            counts[i], codes[i], decoded[i] = self._encode_other(texts[i].as_py())
        return counts, codes, decoded


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _rows(path: str, full: bool) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = of_stage(("pieces", path), lambda: PieceCoder(path))

        for batch in batches:
            texts = plain(batch.column(1))
            for start, stop in cuts(texts, BATCH_BYTES):
                counts, codes, decoded = coder.encode_column(texts.slice(start, stop - start))
                cols = [
                    batch.column(0).slice(start, stop - start),
                    pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in codes], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    ids = [[int(i) for i in bytes(c).split(b",")] if c else [] for c in codes]
                    cols += [pa.array(ids, pa.list_(pa.int32())), pa.array([str(d, "utf-8") for d in decoded], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)
        give_back()

    return rows


def encode_pieces(docs: DataFrame, vocabulary: str | None = None, full: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``full``, ids and decoded."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return slim.mapInArrow(_rows(vocabulary or default_vocabulary(), full), schema + ", ids array<int>, decoded string" * full)
