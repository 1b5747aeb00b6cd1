"""Token counts by heap-and-linked-list byte-pair merging (operator 9).

A text is cut into pre-tokens; each pre-token's bytes start as a linked list of
one-byte symbols, and the adjacent pair of the lowest rank is merged until no
ranked pair is left. The count is the number of symbols left; identifiers are
never looked up. Pre-tokens never cross from a word into the white space after
it, so a text's count is the sum of the counts of its chunks (white space and
the word that follows), and chunks are remembered within a task.

Defined results: a null or empty text has 0 bytes and 0 tokens. A special
token's string inside a text counts as one token, as the library does by
default. Texts of any length are handled whole. Ties between equal ranks go to
the leftmost pair. Repeated rows count alike; an empty table gives an empty result.
Other columns pass through; the output columns are named by parameters so that they
need not clash, and replace columns of their names.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.storage import table

#: Chunks remembered by one worker before the memory is emptied; bounds memory only.
REMEMBERED_CHUNKS = 300_000
#: Only chunks up to this many characters are remembered.
REMEMBERED_LENGTH = 64


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in symbols:
            symbols[b] = chr(256 + len(symbols) - len(plain))
    return [symbols[b] for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left after all merges: the initial symbols minus the merges."""
    n = len(symbols)
    if n < 2:
        return n
    symbols = symbols.copy()
    after = [*range(1, n), -1]
    before = list(range(-1, n - 1))
    heap = [(ranks[pair], i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, (left, right) = heapq.heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] != left or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = left + right, ""
        merges += 1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (rank := ranks.get(pair := (symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i, pair))
        h = before[i]
        if h >= 0 and (rank := ranks.get(pair := (symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, h, pair))
    return n - merges


class BytePairCounter(dict):
    """Counts tokens; as a dict it remembers the counts of short chunks."""

    #: Fixed pattern: the pre-tokens of byte-level vocabularies.
    PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
    OTHER_SPACE = re.compile(r"[^\S \n]")

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kind = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: only byte-level BPE without normaliser and prefix space is handled")
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.symbols = byte_symbols()
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None

    def pretokens(self, piece: str) -> int:
        symbols, ranks = self.symbols, self.ranks
        return sum(merged_length([symbols[b] for b in p.encode("utf-8")], ranks) for p in self.PRETOKEN.findall(piece))

    def __missing__(self, chunk: str) -> int:
        n = self.pretokens(chunk)
        if len(chunk) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED_CHUNKS:
                self.clear()
            self[chunk] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        pieces = self.special.split(text) if self.special else [text]
        total = len(pieces) - 1
        for piece in pieces:
            if self.OTHER_SPACE.search(piece):  # a run of mixed white space must not be cut
                total += self.pretokens(piece)
            else:
                total += sum(map(self.__getitem__, self.CHUNK.findall(piece)))
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> BytePairCounter:
    return BytePairCounter(path)


def token_count(text: Column, tokenizer_path: str) -> Column:
    """The number of tokens of ``text`` under the byte-level BPE file at ``tokenizer_path``."""

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        count = counter(tokenizer_path).count
        return pa.array((count(t.as_py()) for t in texts), pa.int64())

    return counted(text)


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 1024, n_bytes: str = "n_bytes", n_tokens: str = "n_tokens", over_limit: str = "over_limit") -> DataFrame:
    """``docs`` with byte and token counts; no shuffle, one pass."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.withColumns({n_bytes: F.octet_length(text).cast("long"), n_tokens: token_count(text, tokenizer_path)})
    return counted.withColumn(over_limit, F.col(n_tokens) > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")
