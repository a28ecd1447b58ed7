"""Packing of tokenised documents into fixed-length sequences by swap-based local search.

Documents become token ids and an end id, and only those over the sequence length
are cut. Full pieces are sequences by themselves. The others are dealt by hash to
shards of about ``SHARD`` pieces; a task packs one shard: best fit on decreasing
lengths, then a local search between underfull bins. It moves a piece, or
exchanges one for one, two for one or one for two, whenever the fuller bin gets
fuller, which raises the sum of squared fills; the emptiest bins so run empty.
The pieces of bins that stay underfull are dealt again to fewer shards, until one
shard holds them or a round saves no bin, so shards cost next to no sequences.

Defined cases: null and empty texts are documents of the end id alone. Each row is
a document, also where doc_ids are null or repeat. Extra columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm._common import written
from pairloom.llm._memo import WordTable, give_back, of_stage
from pairloom.llm._words import cuts, plain, taken, words

LENGTH, END_ID, SHARD = 2048, 0, 4096
#: Bins filled less than this share are dealt again.
WELL_FILLED = 0.98
BATCH_BYTES = 8 << 20
#: Bytes of parts of words that a worker remembers in a generation.
MEMO_BYTES = 32 << 20
#: Characters that the vocabulary's pre-tokenizer never joins to letters or digits.
_OUTER = ".,!*%$&#|<>?:;()\"-"
_CLASS = "".join("\\" + c for c in _OUTER)
#: A core that begins and ends with a letter or digit, of characters whose lower case and normal form go letter by letter.
_PLAIN = r"^[\pL\pN]([\x00-\x{12F}]*[\pL\pN])?$", r"^[\x00-\x{12F}]*$"


class WordEncoder:
    """Token ids of texts, by the tokenizers library, with a memory for parts of words.

    The vocabulary's pre-tokenizer never joins across ASCII blanks, nor letters or
    digits with the marks around them, and its normal form works inside such
    parts. So a text's ids are those of its parts, in order. Words of other
    scripts are always encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Whether an id is the last one of a word.
        self.is_last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_last[[i for w, i in self.tokenizer.get_vocab().items() if suffix and w.endswith(suffix)]] = True
        self.parts = WordTable(self._by_library, MEMO_BYTES)

    def _by_library(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts end to end, and where each one's end; many parts in one call."""
        # A run of letters ends with the one id that ends a word; of other parts the offsets tell.
        order = sorted(range(len(parts)), key=lambda i: not parts[i].isalpha())
        letters = sum(map(str.isalpha, parts))
        found, sizes = [], []
        for start, stop in ((0, letters), (letters, len(parts))):
            for k in range(start, stop, 20_000):
                some = [parts[i] for i in order[k : min(stop, k + 20_000)]]
                code = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
                ids = np.array(code.ids, "<u4")
                last = np.flatnonzero(self.is_last[ids]) if k < letters else []
                if len(last) == len(some):
                    cut = np.concatenate([[0], last + 1])
                else:
                    at = np.array(code.offsets, np.int64).reshape(-1, 2)[:, 0]
                    cut = np.searchsorted(at, np.cumsum([0] + [len(p) + 1 for p in some]))
                found.append(ids)
                sizes.append(np.diff(cut))
        back = np.empty(len(parts), np.int64)
        back[order] = np.arange(len(parts))
        ends = np.concatenate([[0], np.cumsum(np.concatenate([[], *sizes]))]).astype(np.int64)
        return taken(np.concatenate([np.empty(0, "<u4"), *found]), ends, back, np.arange(len(parts) + 1))

    def _split(self, different: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Parts, and for each word the places of its marks before, its core and its marks behind; -1: none."""
        core = pc.utf8_trim(different, _OUTER)
        plain = pc.and_(pc.match_substring_regex(core, _PLAIN[0]), pc.match_substring_regex(core, _PLAIN[1]))
        if self.special:
            maybe = pc.match_substring(different, "<|")
            if pc.any(maybe).as_py():
                plain = pc.and_not(plain, pc.and_(maybe, pc.match_substring_regex(different, self.special)))
        place = np.full((len(different), 3), -1, np.int64)
        place[:, 1] = np.arange(len(different))
        parts = [pc.if_else(plain, pc.utf8_lower(core), different)]
        size, left = pc.binary_length(different), pc.binary_length(pc.utf8_ltrim(different, _OUTER))
        for k, has, rest in (
            (0, pc.less(left, size), f"(?s)[^{_CLASS}].*$"),
            (2, pc.less(pc.binary_length(core), left), f"(?s)^.*[^{_CLASS}]"),
        ):
            at = np.flatnonzero(pc.and_(plain, has).to_numpy(zero_copy_only=False))
            if len(at):
                marks = pc.replace_substring_regex(different.take(pa.array(at)), rest, "")
                place[at, k] = sum(map(len, parts)) + np.arange(len(at))
                parts.append(marks)
        return pa.chunked_array(parts).combine_chunks(), place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the bounds of each text."""
        different, number, bounds = words(texts)
        if not len(different):
            return np.empty(0, "<u4"), bounds
        parts, place = self._split(different)
        parts = parts.dictionary_encode()
        blob, at, found = self.parts.values(parts.dictionary)
        there = place >= 0
        which = found[parts.indices.to_numpy(zero_copy_only=False)[place[there]]]
        ids, ends = taken(blob, at, which, np.concatenate([[0], np.cumsum(there.sum(axis=1))]))
        return taken(ids, ends, number, bounds)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_of(ids: bytes, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; its end id is not yet among them."""
    ids += END_ID.to_bytes(4, "little")
    for k, at in enumerate(range(0, len(ids), 4 * length)):
        part = ids[at : at + 4 * length]
        yield k, at // 4, len(part) // 4, zlib.crc32(part)


def _piece_rows(path: str, length: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = of_stage(("words", path), lambda: WordEncoder(path))

        for batch in batches:
            texts = plain(batch.column(1))
            for start, stop in cuts(texts, BATCH_BYTES):
                ids, bounds = encoder.encode(texts.slice(start, stop - start))
                docs, found = [], []
                for i in range(stop - start):
                    for piece in pieces_of(ids[bounds[i] : bounds[i + 1]].tobytes(), length):
                        docs.append(start + i)
                        found.append(piece)
                cols = list(zip(*found))
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(docs)), *(pa.array(c, t) for c, t in zip(cols, types))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        give_back()

    return rows


def best_fit(lengths: list[int], room: int) -> list[list[int]]:
    """Bins of indices, by best fit on decreasing lengths."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        k = bisect.bisect_left(free, (lengths[i], -1))
        if k < len(free):
            left, b = free.pop(k)
        else:
            left, b = room, len(bins)
            bins.append([])
        bins[b].append(i)
        if left > lengths[i]:
            bisect.insort(free, (left - lengths[i], b))
    return bins


def _by_length(members: list[int], lengths: list[int]) -> dict[int, list[int]]:
    """A bin's pieces by their length; a bin of 2,048 has at most 63 different lengths, however many pieces."""
    out: dict[int, list[int]] = {}
    for i in members:
        out.setdefault(lengths[i], []).append(i)
    return out


def _pairs(some: dict[int, list[int]]) -> list[tuple[int, int, int]]:
    """(sum, one length, another) of all pairs of pieces that differ in their lengths."""
    sizes = sorted(some)
    out = [(x + y, x, y) for k, x in enumerate(sizes) for y in sizes[k + 1 :]]
    return sorted(out + [(2 * x, x, x) for x in sizes if len(some[x]) > 1])


def _exchange(a: list[int], b: list[int], lengths: list[int], space: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """What to give from bin a for what of b so that b gains most, but at most ``space``."""
    mine, theirs = _by_length(a, lengths), _by_length(b, lengths)
    back, twos = sorted(theirs), None
    best, gain = None, 0

    def offer(give: tuple[int, ...], take: tuple[int, ...]) -> None:
        nonlocal best, gain
        g = sum(give) - sum(take)
        if gain < g <= space:
            best, gain = (give, take), g

    # The smallest return that still fits gains most.
    for x in mine:
        offer((x,), ())
        k = bisect.bisect_left(back, x - space)
        if k < len(back):
            offer((x,), (back[k],))
    if gain < space:
        for both, x, y in _pairs(mine):
            offer((x, y), ())
            k = bisect.bisect_left(back, both - space)
            if k < len(back):
                offer((x, y), (back[k],))
            if gain == space:
                break
    if gain < space:
        twos = _pairs(theirs)
        for x in mine:
            k = bisect.bisect_left(twos, (x - space, -1, -1))
            if k < len(twos):
                offer((x,), twos[k][1:])
    if best is None:
        return None
    chosen = []
    for sizes, some in zip(best, (mine, theirs)):
        chosen.append(tuple(some[x][n] for n, x in enumerate(sizes)) if len(set(sizes)) < len(sizes) else tuple(some[x][0] for x in sizes))
    return chosen[0], chosen[1]


def local_search(bins: list[list[int]], lengths: list[int], room: int) -> list[list[int]]:
    """Exchange pieces between underfull bins until no exchange raises the squared fill."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fill) // room)
    used = sum(1 for f in fill if f)
    better = True
    while used > least and better:
        better = False
        for a in sorted((k for k in range(len(bins)) if 0 < fill[k] < room), key=lambda k: (fill[k], k)):
            for b in sorted((k for k in range(len(bins)) if fill[a] <= fill[k] < room and k != a), key=lambda k: (-fill[k], k)):
                while fill[a] and fill[b] < room and fill[a] <= fill[b] and (found := _exchange(bins[a], bins[b], lengths, room - fill[b])):
                    give, take = found
                    bins[a] = [i for i in bins[a] if i not in give] + list(take)
                    bins[b] = [i for i in bins[b] if i not in take] + list(give)
                    moved = sum(lengths[i] for i in give) - sum(lengths[i] for i in take)
                    fill[a] -= moved
                    fill[b] += moved
                    better = True
                if not fill[a]:
                    used -= 1
                    break
            if used <= least:
                break
    return [b for b in bins if b]


def pack(lengths: list[int], room: int = LENGTH) -> list[list[int]]:
    return local_search(best_fit(lengths, room), lengths, room)


def _pack_shard(room: int, stage: int) -> Callable:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        lengths = pdf["length"].tolist()
        seq, at, fill = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, members in enumerate(pack(lengths, room)):
            total = 0
            for i in members:
                seq[i], at[i] = ((stage << 52) | (int(key[0]) << 20) | k), total
                total += lengths[i]
            fill[members] = total
        return pdf[["row", "length"]].assign(sequence_id=seq, offset=at, fill=fill)

    return run


def tokenised_pieces(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_piece_rows(vocabulary or default_vocabulary(), length), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(
    docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = written(tokenised_pieces(docs, vocabulary, length, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    schema = "row long, length long, sequence_id long, offset long, fill long"
    todo = pieces.filter(F.col("length") < length).select("row", "length")
    count, bins, stage, done = todo.count(), None, 1, []
    well = F.col("fill") >= int(WELL_FILLED * length)
    while count:
        shards = -(-count // shard)
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(stage)), F.lit(shards)))
        packed = written(dealt.groupBy("shard").applyInPandas(_pack_shard(length, stage), schema), "packed")
        firsts = F.col("offset") == 0
        told = packed.agg(F.count_if(firsts).alias("bins"), F.count_if(~well).alias("left"), F.count_if(~well & firsts).alias("poor")).first()
        # One shard is as good as it gets, and so is a round that saved no bin.
        if shards == 1 or not told.left or bins is not None and told.bins >= bins:
            done.append(packed)
            break
        done.append(packed.filter(well))
        todo, count, bins, stage = packed.filter(~well).select("row", "length"), told.left, told.poor, stage + 1
    placed = spark.createDataFrame([], "row long, sequence_id long, offset long")
    for packed in done:
        placed = placed.unionByName(packed.select("row", "sequence_id", "offset"))
    full = pieces.filter(F.col("length") == length).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    rest = pieces.filter(F.col("length") < length).join(placed, "row")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return full.select(names).unionByName(rest.select(names))
