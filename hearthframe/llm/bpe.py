"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words; decoding joins the ids' byte strings.

encode_words() is the fold in Spark's higher-order functions, over a table of distinct words, with the ranks as a
literal. encode_docs() applies the same fold to whole texts: each task folds each distinct word it meets
once and looks the others up, so no token is shuffled. README has the figures that led to that.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Words that a worker keeps folded; beyond it the table starts anew.
CACHE_WORDS = 150_000
BUCKETS = 16_384


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """The rank of each byte string, from a file of lines 'base64 rank'."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def fold_word(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """The ids of one word: its own rank if it has one, else the ranks of its parts once no two neighbours have a rank.

    Of all neighbours the leftmost pair of least rank is made one; pairs wait on a heap, so that a word of any length
    takes time in proportion to n log n.
    """
    if (own := ranks.get(word)) is not None:
        return [own]
    n, rank = len(word), ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
    heapify(heap)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by start of a part: its end (0: no part starts here), the start of the one before
    while heap:
        _, i, stop = heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := rank(word[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if i and (r := rank(word[before[i] : stop])) is not None:
            heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Ids(dict):
    """word -> its ids joined by commas, made when first asked for; bytes_ has what those ids stand for. Bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.bytes_ = ranks, {}
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, rank in ranks.items():
            self.pieces[rank] = word

    def __missing__(self, word: str) -> str:
        ids = fold_word(self.ranks, word.encode())
        self[word] = out = ",".join(map(str, ids))
        self.bytes_[word] = b"".join(map(self.pieces.__getitem__, ids))
        return out

    def text(self, words: list[str]) -> tuple[str, bytes]:
        """All words' ids joined by commas, and the bytes that the ids stand for."""
        if len(self) > CACHE_WORDS:
            self.clear()
            self.bytes_.clear()
        return ",".join(map(self.__getitem__, words)), b"".join(map(self.bytes_.__getitem__, words))


class Lengths(dict):
    """word -> how many ids it has, made when first asked for; bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = len(fold_word(self.ranks, word.encode()))
        return out


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> tuple[Ids, Lengths, "regex.Pattern"]:
    """The worker's tables of words and the compiled pattern."""
    # \s is Unicode's White_Space, as in Rust and in Java's (?U); Python's has four control characters more
    unicode_space = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    ranks = load_ranks(path)
    return Ids(ranks), Lengths(ranks), regex.compile(unicode_space)


def encode_text(text: str, path: str, pattern: str) -> tuple[str, bytes]:
    """The text's ids joined by commas, and the bytes that they stand for."""
    words, _, split = tokenizer(path, pattern)
    return words.text(split.findall(text))


def encode_docs(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of each whole text, and with ids the array itself, token_ids.

    Null text: as empty (no tokens). A column of docs with the name of an added one is replaced. All other columns of
    docs pass through as they are; rows may repeat, and a table without rows gives none.
    """

    def run(texts: Iterator[str | None]) -> dict[str, pa.Array]:
        counts, hashes, back, joined = [], [], [], []
        for text in texts:
            told, raw = encode_text(text or "", path, pattern)
            counts.append(told.count(",") + 1 if told else 0)
            hashes.append(hashlib.sha256(told.encode()).hexdigest())
            back.append(hashlib.sha256(raw).hexdigest())
            if ids:
                joined.append(told or None)
        out = {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(hashes), "decoded_sha256": pa.array(back)}
        if ids:
            numbers = pc.split_pattern(pa.array(joined, pa.string()), ",")
            flat = numbers.flatten().cast(pa.int32())
            out["token_ids"] = pa.ListArray.from_arrays(pa.array([0, *pc.cumulative_sum(out["n_tokens"]).to_pylist()], pa.int32()), flat)
        return out

    return map_texts(docs, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids, run)


def count_docs(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(n_tokens) of each row of docs; null text has none."""

    def run(texts: Iterator[str | None]) -> dict[str, pa.Array]:
        _, lengths, split = tokenizer(path, pattern)
        return {"n_tokens": pa.array([sum(map(lengths.__getitem__, split.findall(t))) if t else 0 for t in texts], pa.int64())}

    return map_texts(docs.select(text_col), text_col, "n_tokens long", run).select("n_tokens")


def _rank_literal(path: str) -> Column:
    """array<map<string, int>>: the ranks by hex string, in buckets of a few entries, folded to a literal by Catalyst."""
    ranks = load_ranks(path)
    frame: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for word, rank in ranks.items():
        text = word.hex().upper()
        frame[int(hashlib.md5(text.encode()).hexdigest()[:7], 16) % BUCKETS][text] = rank
    return F.from_json(F.lit(json.dumps(frame, separators=(",", ":"))), "array<map<string,int>>")


def encode_words(words: DataFrame, path: str, word_col: str = "word") -> DataFrame:
    """words, distinct, with ids array<int>: the merges as a fold of higher-order functions over an array of bytes."""
    table = F.array(_rank_literal(path))

    def run(ranks: Column) -> Column:
        def rank(x: Column) -> Column:
            return F.try_element_at(F.get(ranks, (F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("int")) % F.lit(BUCKETS)), x)

        def step(parts: Column, _: Column) -> Column:
            near = F.zip_with(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, F.lit(2), F.size(parts)), lambda x, y: F.concat(x, y))
            best = F.array_min(F.filter(F.transform(near, lambda x, i: F.struct(rank(x).alias("r"), i.alias("i"))), lambda x: x["r"].isNotNull()))

            def merge(b: Column) -> Column:
                joined = F.concat(F.get(parts, b["i"]), F.get(parts, b["i"] + 1))
                return F.concat(F.slice(parts, F.lit(1), b["i"]), F.array(joined), F.slice(parts, b["i"] + 3, F.size(parts)))

            return F.get(F.transform(F.array(best), lambda b: F.when(b.isNull(), parts).otherwise(merge(b))), F.lit(0))

        hexed = F.hex(F.encode(F.col(word_col), "UTF-8"))
        bytes_ = F.transform(F.sequence(F.lit(1), F.greatest(F.length(hexed) / 2, F.lit(1)).cast("int")), lambda i: F.substring(hexed, i * 2 - 1, F.lit(2)))
        parts = F.when(rank(hexed).isNotNull(), F.array(hexed)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(bytes_), F.lit(1))), bytes_, step))
        return F.when(F.length(hexed) > 0, F.transform(parts, rank)).otherwise(F.array().cast("array<int>"))

    return words.withColumn("ids", F.get(F.transform(table, run), F.lit(0)))


def decode_arrays(ids: DataFrame, pieces: DataFrame, ids_col: str = "ids") -> DataFrame:
    """(key columns of ids, text): the binary pieces (id, piece) of an id array put together in its order.

    An empty or null array gives an empty text; rows with equal keys and ids stay rows of their own.
    """
    keys = [c for c in ids.columns if c != ids_col]
    rows = ids.withColumn("_row", F.monotonically_increasing_id())
    flat = rows.select(*keys, "_row", F.posexplode_outer(ids_col).alias("_at", "id")).join(pieces, "id", "left")
    joined = flat.groupBy("_row").agg(*[F.first(k).alias(k) for k in keys], F.array_sort(F.collect_list(F.struct("_at", "piece"))).alias("_p"))
    hexed = F.array_join(F.transform("_p", lambda x: F.hex(x["piece"])), "")  # array_join leaves nulls out
    return joined.select(*keys, F.decode(F.unhex(hexed), "UTF-8").alias("text"))
