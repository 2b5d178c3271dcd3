"""Near-duplicates by Order MinHash over word k-mers, verified by banded alignment of the words.

A k-mer is labelled with its occurrence in the text, so that repeats count. A sketch keeps the few labelled k-mers that
hash least under one of several hash functions, in the order of the text; texts that share a sketch are candidates.
A pair is verified by aligning the words of both: their longest common subsequence within the band that the threshold
allows, by rows of bits; similarity is common / (n + m - common). A changed word takes five k-mers with it but only itself
from the alignment, so similarity is told by words, as sketches of ordered k-mers are meant to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, checkpoint, components, id_key, map_texts, small_side, string_or_empty

K, SIMILARITY, SKETCHES, KEPT = 5, 0.8, 16, 2
#: Lower-cases A-Z; what is no digit, letter or character beyond ASCII parts words.
WORD_BYTES = bytes(32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Centres that a text is first paired with, those with which it shares the most sketches; what they miss is paired later.
CENTRES = 4
U = np.uint64
AT_ONCE, PARITY = 1 << 20, 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word in order."""
    data = np.frombuffer(b" " + text.encode().translate(WORD_BYTES) + b" ", np.uint8)
    blank = data == 32
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    with np.errstate(over="ignore"):
        letters = np.where(blank, U(0), _mix((place.astype(np.uint64) << U(8)) + data.astype(np.uint64) + U(1)))
        return _mix(np.add.reduceat(letters, starts) + (ends - starts).astype(np.uint64))


def labelled(marks: np.ndarray) -> np.ndarray:
    """marks, each mixed with the number of equal ones before it."""
    if not len(marks):
        return marks
    with np.errstate(over="ignore"):
        order = np.argsort(marks, kind="stable")
        ranked = marks[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        at = np.arange(len(marks))
        label = np.empty(len(marks), np.uint64)
        label[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
        return _mix(marks + label * U(0xD6E8FEB86659FD93))


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of each labelled word k-mer in order; fewer words have one k-mer of all, no words none."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        k = min(k, len(words))
        out = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            out = _mix(out * U(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i])
        return labelled(out)


def sketches(marks: np.ndarray, count: int = SKETCHES, kept: int = KEPT) -> np.ndarray:
    """count 64-bit keys, each of the kept least labelled k-mers of one hash function in text order."""
    if not len(marks):
        return np.zeros(0, np.int64)
    kept, out = min(kept, len(marks)), []
    at_once = max(1, AT_ONCE // len(marks))  # hash functions, so that a long text takes bounded memory
    with np.errstate(over="ignore"):
        for low in range(0, count, at_once):
            seeds = np.arange(low, min(count, low + at_once), dtype=np.uint64)
            hashed = _mix(marks[None, :] ^ _mix((seeds + U(1)) * U(0x9E3779B97F4A7C15))[:, None])
            least = np.sort(np.argpartition(hashed, kept - 1, axis=1)[:, :kept], axis=1)
            key = seeds
            for i in range(kept):
                key = _mix(key * U(0x9E3779B97F4A7C15) + marks[least[:, i]])
            out.append(key)
    return np.concatenate(out).view(np.int64)


def parity(words: np.ndarray) -> np.ndarray:
    """PARITY longs of bits, each the parity of the labelled words that hash to it: two texts differ in at most as many
    bits as in labelled words."""
    odd = np.bincount((labelled(words) >> U(17)) % U(64 * PARITY), minlength=64 * PARITY) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def common_words(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of two arrays, places of a match at most band apart, equal ends taken first."""
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    if not len(differs):
        return n
    lead = int(differs[0])
    a, b, n = a[lead:], b[lead:], n - lead
    differs = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differs[0]) if len(differs) else n
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full, wide = (1 << len(b)) - 1, (1 << (2 * band + 1)) - 1
    row = full
    for i, x in enumerate(a):
        hit = where.get(x, 0) & (wide << (i - band) if i >= band else wide >> (band - i))
        if hit:
            hit &= row
            row = ((row + hit) | (row - hit)) & full
    return lead + tail + len(b) - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """common / (n + m - common) of two arrays of words, exact where it reaches least; a pair that cannot may get less."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    found = common_words(a, b, int((n + m) * (1 - least) / (1 + least)) + 1)
    return found / (n + m - found)


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(u, v) of the pairs whose texts align; texts: (node, text) with a row per node."""
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("x")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("y")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, word_hashes(""))
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                if last[0] != (x := x.as_py()):
                    last = (x, word_hashes(x))
                good.append(similarity(last[1], word_hashes(y.as_py()), least) >= least)
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _text_hashes(text: Column) -> dict[str, Column]:
    return {"_h1": F.xxhash64(text), "_h2": F.xxhash64(text, F.lit(17))}


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(_doc, _h1, _h2, n, class_id, best): a row for each id and text, n the rows that have both.

    Equal texts are one node, linked without being paired; a row without id is a document like any other. Nodes are
    numbered in the order of their least ids, and the least node of a class is its best. Candidates are first paired with
    centres of their sketches, nodes whose sketches are the most shared: the text that the others were copied from, in a
    large group. Then all those are paired that share a sketch but are not yet in one class, so that classes are the
    same as if every candidate pair had been verified, while a large group of copies makes few pairs.
    """
    base = docs.select(id_key(id_col).alias("_doc"), string_or_empty(text_col).alias("text")).withColumns(_text_hashes(F.col("text")))
    same = checkpoint(base.groupBy("_doc", "_h1", "_h2").agg(F.count(F.lit(1)).alias("n")))
    firsts = same.groupBy("_h1", "_h2").agg(F.min("_doc").alias("first")).orderBy("first", "_h1", "_h2")
    nodes = checkpoint(firsts.withColumn("node", F.monotonically_increasing_id()))

    def sketched(texts: Iterator[str | None]) -> dict[str, pa.Array]:
        counts, keys, bits = [], [], []
        for text in texts:
            words = word_hashes(text)
            counts.append(len(words))
            keys.append(sketches(kmers(words)))
            bits.append(parity(words))
        flat = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (keys, bits)]
        ends = [pa.array(np.cumsum([0, *map(len, x)]), pa.int32()) for x in (keys, bits)]
        return {"words": pa.array(counts, pa.int64()), "keys": pa.ListArray.from_arrays(ends[0], flat[0]), "bits": pa.ListArray.from_arrays(ends[1], flat[1])}

    signs = map_texts(base.select("_h1", "_h2", "text"), "text", "words long, keys array<long>, bits array<long>", sketched, keep=False)
    marks = checkpoint(signs.dropDuplicates(["_h1", "_h2"]).join(nodes, ["_h1", "_h2"]).select("node", "words", "keys", *[F.col("bits")[i].alias(f"b{i}") for i in range(PARITY)]))
    signs = marks.select("node", F.explode("keys").alias("key"))
    groups = signs.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "size")
    groups = checkpoint(groups)
    members = checkpoint(signs.join(small_side(groups, groups.count()), "key").select("key", "node", "size"))
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    centres = members.join(weights, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("centre"))
    met = members.join(centres, "key").where("node != centre").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("shared"))
    most = Window.partitionBy("node").orderBy(F.desc("shared"), "centre")  # a row per sketch at most
    star = met.withColumn("nth", F.row_number().over(most)).where(F.col("nth") <= CENTRES)
    star = star.select(F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v")).distinct()
    star = checkpoint(star)
    wanted = checkpoint(members.select("node").distinct().join(nodes, "node"))
    placed = F.col("_h1") == F.col("w1"), F.col("_h2") == F.col("w2"), F.col("_doc") == F.col("first")
    wanted = wanted.select("node", "first", F.col("_h1").alias("w1"), F.col("_h2").alias("w2"))
    texts = base.join(small_side(wanted, wanted.count()), list(placed)).dropDuplicates(["node"]).select("node", "text")

    edges = checkpoint(_verified(star, texts, least))
    labels = components(edges) if not edges.isEmpty() else edges.selectExpr("u as node", "v as label")
    placed = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    apart = placed.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    placed = checkpoint(placed.join(apart, "key").join(marks.drop("keys"), "node"))
    left, right = (placed.select("key", *[F.col(c).alias(c + x) for c in placed.columns if c != "key"]) for x in ("_u", "_v"))
    # bounds that no similar pair breaks, as conditions of the join: pairs within a large group that are not alike stay in it
    differ = sum((F.bit_count(F.col(f"b{i}_u").bitwiseXOR(F.col(f"b{i}_v"))) for i in range(PARITY)), F.lit(0))
    alike = (F.least("words_u", "words_v") >= F.lit(least) * F.greatest("words_u", "words_v")) & (differ <= (F.col("words_u") + F.col("words_v")) * F.lit((1 - least) / (1 + least)) + F.lit(1e-6))
    met = left.join(right, "key").where("node_u < node_v and label_u != label_v").where(alike)
    rest = met.select(F.col("node_u").alias("u"), F.col("node_v").alias("v")).distinct().join(star, ["u", "v"], "left_anti")
    found = checkpoint(_verified(rest, texts, least))
    if not found.isEmpty():
        labels = components(edges.unionAll(found))
    labels = checkpoint(labels)
    heads = checkpoint(labels.select("label").distinct().join(nodes.select(F.col("node").alias("label"), F.col("first").alias("head")), "label"))
    labels = labels.join(small_side(heads, heads.count()), "label").select("node", "label", "head")
    own = nodes.join(labels, "node", "left")
    best = F.coalesce("label", "node") == F.col("node")
    own = own.select("_h1", "_h2", "first", F.coalesce("head", "first").alias("head"), best.alias("best"))
    out = same.join(own, ["_h1", "_h2"])
    return out.select("_doc", "_h1", "_h2", "n", F.when(F.col("head") != NO_ID, F.col("head")).alias("class_id"), (F.col("best") & (F.col("_doc") == F.col("first"))).alias("best"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(id, class_id, keep): class_id is the least id of the row's class, keep true for exactly one row of it.

    Texts without words have equal ones only for partners. Null text: as empty. Rows that share an id are judged by their
    own texts. Null ids come last; class_id is null if all ids of a class are. No rows: none. Other columns do not matter.
    """
    rows = classes(docs, id_col, text_col, least)
    rows = rows.select("_doc", "class_id", "best", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_nth"))
    return rows.select(F.when(F.col("_doc") != NO_ID, F.col("_doc")).alias(id_col), "class_id", (F.col("best") & (F.col("_nth") == 1)).alias("keep"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class, whole; of rows with equal id and text the least by its other columns."""
    same = F.struct(id_key(id_col).alias("_doc"), *[c.alias(n) for n, c in _text_hashes(string_or_empty(text_col)).items()])
    keyed = docs.withColumn("__near", same)
    best = checkpoint(classes(docs, id_col, text_col, least).where("best").select(F.struct("_doc", "_h1", "_h2").alias("__near"), "n"))
    single = keyed.join(best.where("n = 1").select("__near"), "__near", "left_semi")
    repeated = keyed.join(best.where("n > 1").select("__near"), "__near", "left_semi")
    least_first = Window.partitionBy("__near").orderBy(*[F.col(f"`{c}`").cast("string") for c in docs.columns if c != text_col])
    repeated = repeated.withColumn("__nth", F.row_number().over(least_first)).where("__nth = 1").drop("__nth")
    return single.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
