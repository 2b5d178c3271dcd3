"""Spelling variants: words at one edit from each other, found by automata over the halves of words."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_side

RUN = re.compile("[A-Za-zÀ-ÿ]+")
TYPO_EVERY = 199
MIN_LENGTH, MIN_COUNT, FORM_TIMES = 6, 5, 5

#: Distinct words that a task counts before it hands them on, and words of a shard's automaton.
HELD_WORDS, WORDS_A_SHARD = 300_000, 20_000
#: Pairs of words under which they are compared one by one, and characters that are compared at once beyond.
FEW_PAIRS, CODES_AT_ONCE = 24, 1 << 20


def counted_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the distinct words of docs (doc_id, text) that are long and frequent enough. Tasks count before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                if (text := text.as_py()) is None:
                    continue
                name, low = doc.as_py() or "", Counter()
                for run, n in Counter(RUN.findall(text)).items():
                    low[run.encode("latin-1").lower().decode("latin-1")] += n  # bytes lower A-Z alone
                for word, n in low.items():
                    h = zlib.crc32(f"{name}:{word}".encode())
                    if h % TYPO_EVERY == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def edit_pairs(a: list[str], b: list[str]) -> Iterator[tuple[int, int]]:
    """(i, j) of the pairs a[i], b[j] at one edit; the words of a are of one length, and so are those of b. Many pairs are compared at once."""
    if abs(len(a[0]) - len(b[0])) > 1:
        return
    if len(a) * len(b) < FEW_PAIRS:
        yield from ((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if one_edit(x, y))
        return
    if len(a[0]) > len(b[0]):
        yield from ((i, j) for j, i in edit_pairs(b, a))
        return
    codes = lambda words: np.frombuffer("".join(words).encode("utf-16-le"), np.uint16).reshape(len(words), -1)
    x, y = codes(a), codes(b)
    size, step = x.shape[1], max(1, CODES_AT_ONCE // y.size)
    for at in range(0, len(a), step):
        some = x[at : at + step, None, :]
        lead = some == y[None, :, :size]
        if y.shape[1] == size:
            near = lead.sum(axis=2) == size - 1
        else:  # what the shorter shares with the longer's beginning and end makes it up
            tail = (some == y[None, :, 1:])[:, :, ::-1]
            near = np.logical_and.accumulate(lead, axis=2).sum(axis=2) + np.logical_and.accumulate(tail, axis=2).sum(axis=2) >= size
        yield from zip((at + (k := np.nonzero(near))[0]).tolist(), k[1].tolist())


def near_in_shard(side: str, patterns: list[tuple[str, int]], scanned: list[str]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, the largest of their counts, the least word that has it) of the scanned words with near ones among the patterns' words.

    One edit leaves one half of a word whole: the first at the start of the near word, or the second at its end. Shards of side
    "first" hold first halves; those of "last" hold second halves and leave out the words whose first half stands at the start too.
    """
    by_half: dict[str, dict[int, list[str]]] = defaultdict(lambda: defaultdict(list))
    for word, _ in patterns:
        by_half[word[: len(word) // 2] if side == "first" else word[len(word) // 2 :]][len(word)].append(word)
    automaton = ahocorasick.Automaton()
    for half in by_half:
        automaton.add_word(half, half)
    automaton.make_automaton()
    found: dict[str, dict[int, list[str]]] = defaultdict(lambda: defaultdict(list))
    for word in scanned:
        for end, half in automaton.iter(word):
            if end + 1 == (len(half) if side == "first" else len(word)):
                found[half][len(word)].append(word)
    counts, near = dict(patterns), {}
    for half, words_by_size in found.items():
        for size, words in words_by_size.items():
            for other in (size - 1, size, size + 1):
                given = by_half[half].get(other, ())
                for i, j in edit_pairs(words, given) if given else ():
                    if side == "first" or not words[i].startswith(given[j][: other // 2]):
                        key = -counts[given[j]], given[j]
                        seen, best = near.get(words[i], (0, key))
                        near[words[i]] = seen + 1, min(best, key)
    for word, (seen, (n, best)) in near.items():
        yield word, seen, -n, best


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): of each word with near ones their number, their largest count and the least word that has it; words: word, n.

    A half has three code points at least, so the words that hold a first half at their start share its first three code points, and
    those that hold a second half at their end share its last three: shards are hashes of these. Each shard's counted words are cut into
    blocks of WORDS_A_SHARD at most on average, and all scanned words of the shard pass the automaton of every block, so no shard grows
    with a frequent beginning.
    """
    total = words.count()
    shards = max(1, -(-total // WORDS_A_SHARD)) * 2
    sides = words.withColumn("side", F.explode(F.array(F.lit("first"), F.lit("last"))))
    key = F.when(F.col("side") == "first", F.substring("word", 1, 3)).otherwise(F.substring("word", -3, 3))
    sides = checkpoint(sides.withColumn("shard", F.pmod(F.xxhash64("side", key), F.lit(shards)).cast("int")))
    sizes = sides.groupBy("side", "shard").agg(F.ceil(F.count("*") / WORDS_A_SHARD).cast("int").alias("blocks"))
    sides = sides.join(small_side(sizes, 2 * shards), ["side", "shard"])
    block, others = F.pmod(F.xxhash64("word"), "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    patterns = sides.select("side", "shard", block.alias("i"), others.alias("j"), "word", "n")
    scanned = sides.select(F.col("side").alias("of_side"), F.col("shard").alias("of_shard"), others.alias("of_i"), block.alias("of_j"), F.col("word").alias("text"))

    def search(key: tuple[pa.Scalar, ...], patterns: pa.Table, scanned: pa.Table) -> pa.Table:
        pairs = list(zip(patterns.column("word").to_pylist(), patterns.column("n").to_pylist()))
        found = list(near_in_shard(key[0].as_py(), pairs, scanned.column("text").to_pylist()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 4, made.types)], schema=made)

    made = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])
    # a partition a shard, as the work lies in comparing and not in bytes
    patterns, scanned = patterns.repartition(shards, "side", "shard", "i", "j"), scanned.repartition(shards, "of_side", "of_shard", "of_i", "of_j")
    parts = patterns.groupBy("side", "shard", "i", "j").cogroup(scanned.groupBy("of_side", "of_shard", "of_i", "of_j")).applyInArrow(search, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.near").alias("near"))


def with_roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) with root, the last of the forms that follow from a word. Forms grow in count, so there are no cycles.

    Each round doubles the steps that a pointer takes; each is cut in the shared folder.
    """
    at = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = checkpoint(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        at = step.select("word", "root")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs (doc_id, text; other columns are not read).

    Words are runs of Latin letters with A-Z lower-cased, of which one code point goes where the crc32 of document and run says so;
    a null id counts as an empty one, a null text has no words. Words shorter than min_length or rarer than min_count over all rows are
    left out; repeated rows count again. A word's form is its near word (one edit) of largest count, ties to the smaller in code-point
    order, if that is FORM_TIMES the word's own count or more. No words give no rows.
    """
    if min_length < 6:
        raise ValueError("halves need three code points")
    words = checkpoint(counted_words(docs, min_length, min_count))
    near = words.join(near_words(words), "word", "left")
    fits = F.col("near_n") >= FORM_TIMES * F.col("n")
    near = checkpoint(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")))
    roots = with_roots(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
