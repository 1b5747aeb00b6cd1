"""SentencePiece encoding and decoding by unigram Viterbi over a double-array trie (operator 8).

The pieces of a model file stand in a double-array trie over UTF-8 bytes. Of all
ways to cut a text into pieces the one of the largest sum of log scores is found
by dynamic programming from left to right; of equal sums the one whose last
piece begins first stays. A character that is no piece becomes its bytes' pieces.
Spaces are written as the marker U+2581, with one in front of the text; decoding
turns markers back and drops the first.

Scores: a unigram model's own. A byte-pair model has ranks in their place; they
become log scores by Zipf's law, ``-log((rank + 3) * 10)``.

No piece has a marker after another character, or a line end (this is checked),
so a text is cut before its spaces and around line ends into chunks whose best
cuts are independent; chunks are remembered within a task.

Defined results: null and empty texts have no pieces and decode to an empty
text. A marker character in a text itself is written in bytes, so decoding gives
back every text exactly. Texts of any length are handled whole. Repeated rows get
equal pieces; an empty table gives an empty result. One pass, no shuffle; other
columns pass, but ones named like the results are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.storage import table, unused

MARKER = "▁"
#: How far the score of an unknown character is below the least one.
UNKNOWN_PENALTY = 10.0
#: Chunks remembered by one worker before the memory is emptied; bounds memory only.
REMEMBERED_CHUNKS = 200_000
#: Longer chunks are cut one by one and not remembered.
REMEMBERED_BYTES = 64
#: Characters of texts whose new chunks are cut together.
TOGETHER = 500_000
#: Bytes of texts that are strings of Python, or decoded, at a time.
SLICE_BYTES = 1 << 20


#: The check of a slot that no state has.
FREE = -2


class DoubleArrayTrie:
    """Byte strings to numbers: from state s the byte b leads to base[s] + b + 1 if that one's check is s."""

    def __init__(self, values: dict[bytes, int]):
        self.base, self.check, self.value = [1], [-1], [-1]
        start = {False: 1, True: 1}  # where a search begins, for one child and for more
        todo = [(0, sorted(values), 0)]
        while todo:
            state, keys, depth = todo.pop()
            children: dict[int, list[bytes]] = {}
            for key in keys:
                if len(key) == depth:
                    self.value[state] = values[key]
                else:
                    children.setdefault(key[depth], []).append(key)
            if not children:
                continue
            codes = [b + 1 for b in children]
            base, tries = max(1, start[len(codes) > 1] - codes[0]), 0
            self.grow(base + 257)
            while any(self.check[base + c] != FREE for c in codes):
                base, tries = base + 1, tries + 1
                self.grow(base + 257)
            if tries > 8:  # it is crowded there
                start[len(codes) > 1] = base + codes[0]
            self.base[state] = base
            for code, below in zip(codes, children.values()):
                self.check[base + code] = state
                todo.append((base + code, below, depth + 1))
        self.grow(max(self.base) + 257)

    def grow(self, size: int) -> None:
        more = size + 1 - len(self.base)
        if more > 0:
            more += 4096
            self.base += [0] * more
            self.check += [FREE] * more
            self.value += [-1] * more


class PieceModel(dict):
    """Encodes and decodes; as a dict it remembers chunks' pieces as packed 32-bit numbers."""

    CHUNK = re.compile(r"\n| *[^ \n]+| +")

    def __init__(self, path: str):
        super().__init__()
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm = model.normalizer_spec
        if norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError(f"{path}: only models with byte fallback, without normalisation, are handled")
        normal = [i for i, p in enumerate(model.pieces) if p.type == p.NORMAL]
        if any(MARKER in model.pieces[i].piece.lstrip(MARKER) or "\n" in model.pieces[i].piece for i in normal):
            raise ValueError(f"{path}: a piece has white space after other characters")
        ranked = model.trainer_spec.model_type != model.trainer_spec.UNIGRAM
        self.scores = {i: -math.log((k + 3) * 10.0) if ranked else model.pieces[i].score for k, i in enumerate(normal)}
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.trie = DoubleArrayTrie({model.pieces[i].piece.replace(MARKER, " ").encode(): i for i in normal})
        score = np.zeros(len(model.pieces))
        score[list(self.scores)] = list(self.scores.values())
        self.arrays = np.array(self.trie.base), np.array(self.trie.check), np.array(self.trie.value), score
        self.byte_ids = [0] * 256
        self.pieces = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == p.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.pieces[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type == p.NORMAL:
                self.pieces[i] = p.piece.replace(MARKER, " ").encode()
        self.piece_table = pa.array(self.pieces, pa.large_binary())

    def best(self, data: bytes) -> list[int]:
        """The pieces of the best cut of a chunk, whose markers are spaces."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(data)
        total = [-math.inf] * (n + 1)
        total[0] = 0.0
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        i = 0
        while i < n:
            lead = data[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, state, j, whole = total[i], 0, i, False
            while j < n:
                after = base[state] + data[j] + 1
                if check[after] != state:
                    break
                state = after
                j += 1
                piece = value[state]
                if piece >= 0:
                    whole |= j == i + width
                    if (score := here + scores[piece]) > total[j]:
                        total[j], came[j] = score, (i, piece)
            if not whole and (score := here + self.unknown) > total[i + width]:
                total[i + width], came[i + width] = score, (i, -1)
            i += width
        found = []
        while n:
            i, piece = came[n]
            found += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(data[i:n])]
            n = i
        return found[::-1]

    def best_of_all(self, chunks: list[str]) -> None:
        """Remembers the best cuts of short chunks; those of one length are cut in step."""
        data = [c.encode() for c in chunks]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        for n in np.unique(sizes).tolist():
            which = np.flatnonzero(sizes == n)
            found, counts, rare = self.in_step(np.frombuffer(b"".join(data[i] for i in which), np.uint8).reshape(-1, n))
            packed, width = found.tobytes(), 4 * n
            for k, (i, count, alone) in enumerate(zip(which.tolist(), counts.tolist(), rare.tolist())):
                self[chunks[i]] = np.array(self.best(data[i]), np.int32).tobytes() if alone else packed[(k + 1) * width - 4 * count : (k + 1) * width]

    def in_step(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of rows of bytes, right-aligned, their numbers, and which rows have unknown characters."""
        base, check, value, score = self.arrays
        rows, n = text.shape
        total = np.full((n + 1, rows), -np.inf)
        total[0] = 0.0
        came = np.zeros((n + 1, rows), np.int64)
        piece = np.zeros((n + 1, rows), np.int32)
        rare = np.zeros(rows, bool)
        columns = np.ascontiguousarray(text.T).astype(np.int64)
        for i in range(n):
            live = np.flatnonzero(total[i] > -np.inf)
            if not len(live):
                continue
            here, state, own = total[i, live], np.zeros(len(live), np.int64), np.arange(len(live))
            lead = columns[i, live]
            width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            whole = np.zeros(len(live), bool)
            for j in range(i, n):
                after = base[state] + columns[j, live[own]] + 1
                going = check[after] == state
                state, own = after[going], own[going]
                if not len(own):
                    break
                ends = value[state]
                at = ends >= 0
                if at.any():
                    ids, o = ends[at], own[at]
                    whole[o] |= j + 1 == i + width[o]
                    sums, r = here[o] + score[ids], live[o]
                    up = sums > total[j + 1, r]
                    r = r[up]
                    total[j + 1, r], came[j + 1, r], piece[j + 1, r] = sums[up], i, ids[up]
            unknown = np.flatnonzero(~whole)
            if len(unknown):
                r, end = live[unknown], i + width[unknown]
                rare[r] = True  # cut one by one, in bytes
                total[end, r] = np.maximum(total[end, r], here[unknown] + self.unknown)
        found, counts, at, every = np.zeros((rows, n), np.int32), np.zeros(rows, np.int64), np.full(rows, n), np.arange(rows)
        while len(every := every[(at[every] > 0) & ~rare[every]]):
            counts[every] += 1
            found[every, n - counts[every]] = piece[at[every], every]
            at[every] = came[at[every], every]
        return found, counts, rare

    def __missing__(self, chunk: str) -> bytes:
        return np.array(self.best(chunk.encode()), np.int32).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Each text's pieces as packed 32-bit numbers."""
        found, start = [], 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size < TOGETHER):
                size += len(texts[stop] or "")
                stop += 1
            cut = [self.CHUNK.findall(" " + t) if t else [] for t in texts[start:stop]]
            new = [c for c in set().union(*cut) if c not in self]
            if len(self) + len(new) > REMEMBERED_CHUNKS:
                self.clear()
                new = set().union(*cut)
            self.best_of_all([c for c in new if 4 * len(c) <= REMEMBERED_BYTES or len(c.encode()) <= REMEMBERED_BYTES])
            found += [b"".join(map(self.__getitem__, chunks)) for chunks in cut]
            start = stop
        return found

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")[1:]

    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """Each list's text; the pieces of all lists, one after the other, are already the bytes of all texts."""
        ids = lists.flatten()
        if not len(ids):
            return pa.array([""] * len(lists), pa.string())
        last = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        pieces = self.piece_table.take(ids)
        _, offsets, data = pieces.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(ids) + 1)[np.concatenate(([0], last))]
        filled = bounds[1:] > bounds[:-1]
        plain = np.delete(np.frombuffer(data, np.uint8, bounds[-1]), bounds[:-1][filled])  # without the markers in front
        bounds = bounds - np.concatenate(([0], np.cumsum(filled)))
        texts = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(bounds), pa.py_buffer(plain)])
        try:
            return texts.cast(pa.string())
        except pa.ArrowInvalid:  # lists that no text gave
            return pa.array((self.decode(x.values.to_pylist()) if x.is_valid else "" for x in lists), pa.string())


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def few_at_a_time(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about ``SLICE_BYTES``; a longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def listed(ids: bytes | bytearray, counts: list[int]) -> pa.ListArray:
    """Packed identifiers as lists; they are not copied."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), len(ids) // 4, [None, pa.py_buffer(ids)]))


def cut_and_checked(texts: pa.Array, model: PieceModel, check: bool = True) -> tuple[pa.ListArray, pa.Array]:
    """Each text's pieces, and whether they decode to it; only few texts at a time are strings of Python or are decoded."""
    every, counts, same = bytearray(), [], [pa.array([], pa.bool_())]
    for few in few_at_a_time(texts):
        found = model.encode_all(few.to_pylist())
        own = [len(f) // 4 for f in found]
        packed = b"".join(found)
        if check:
            same.append(pc.equal(model.decode_all(listed(packed, own)), few.fill_null("")))
        every += packed
        counts += own
    return listed(every, counts), pa.concat_arrays(same)


def encoded(text: Column, model_path: str) -> Column:
    """The identifiers of the text's pieces."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return cut_and_checked(texts, piece_model(model_path), check=False)[0]

    return encode(text)


def decoded(ids: Column, model_path: str) -> Column:
    """The text that the pieces give; null identifiers give an empty text."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        return piece_model(model_path).decode_all(lists)

    return decode(ids)


def encode_and_decode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "piece_ids", count_col: str = "n_pieces", same_col: str = "round_trip") -> DataFrame:
    """``docs`` with the pieces' identifiers, their number and whether they decode to the same text.

    Texts are decoded where they are cut: decode(encode(text)) beside encode(text)
    would cut every text twice, and send it back once more to be compared.
    """

    @F.arrow_udf("ids array<int>, same boolean")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(cut_and_checked(texts, piece_model(model_path)), ["ids", "same"])

    row = unused(docs, "_cut")
    made = docs.withColumn(row, cut(F.col(text_col)))
    ids, same = F.col(f"{row}.ids"), F.col(f"{row}.same")
    return made.withColumns({ids_col: ids, count_col: F.size(ids).cast("long"), same_col: same}).drop(row)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_and_decode(docs, default_model()).select("doc_id", "n_pieces", "round_trip", "piece_ids")
