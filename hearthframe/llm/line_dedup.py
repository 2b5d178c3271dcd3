"""Line dedup by a segment-partition edit join. DataFrame functions only.

Two lines are linked if their edit distance is at most tau. A line is cut into tau + 1 segments; if two lines are
within tau edits, some segment i of the shorter has no edit, exactly i - 1 edits stand before it and at most
tau + 1 - i after it. So the longer line has that segment at a shift s with |s| <= i - 1 and |s - d| <= tau + 1 - i,
d being the difference of lengths. Segments and those substrings, hashed with their number and the length, are the
index and the probes. What is left of two such lines once the shared segment is removed is again within tau edits,
so keys are refined by the signatures of the rests before lines are paired: exact, and a group of lines that merely share
a passage is not paired off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, NO_ID, checkpoint, components, id_key, string_or_empty

#: Times that keys are refined by the rests of their lines.
REFINE = 2
#: Longs of bits, a power of two, by which lines are told apart before their distance is computed.
PARITY = 4
SALTS = 16
#: Rows of bits, and longs in each, powers of two, by which most rows without a wanted key are told where the keys are too many to broadcast.
SLOTS, WORDS = 1 << 19, 4


def bounded_edit_distance(a: Column, b: Column, tau: int) -> Column:
    """Edit distance of two strings if it is at most tau (else some number above tau), by a banded bit-parallel scan.

    The band of 2 tau + 1 diagonals is one integer; the longer string's characters slide through it. Strings must be
    longer than tau and differ in length by at most tau.
    """
    width = 2 * tau + 1
    full = F.lit((1 << width) - 1).cast("long")
    top = 1 << (width - 1)
    swap = F.char_length(a) < F.char_length(b)
    chars = F.struct(
        F.regexp_extract_all(F.when(swap, b).otherwise(a), F.lit("(?s)."), F.lit(0)).alias("p"),
        F.regexp_extract_all(F.when(swap, a).otherwise(b), F.lit("(?s)."), F.lit(0)).alias("t"),
    )

    def scan(x: Column) -> Column:
        p, t = x["p"], x["t"]
        turn = F.size(p) - F.lit(tau)

        def column(acc: Column, i: Column) -> Column:
            eq = F.lit(0).cast("long")
            for j in range(width):
                eq = eq + F.coalesce((F.get(p, i + F.lit(j - tau)) == F.get(t, i)).cast("long"), F.lit(0).cast("long")) * F.lit(1 << j).cast("long")

            def vectors(s: Column) -> Column:
                e, vp, vn, d = s["e"], s["vp"], s["vn"], s["d"]
                d0 = (((e.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(e).bitwiseOR(vn)).bitwiseAND(full)
                down = F.shiftright(d0, 1)
                hp = vn.bitwiseOR(full.bitwiseXOR(d0.bitwiseOR(vp)))
                hn = d0.bitwiseAND(vp)
                edge = F.call_function("shiftleft", F.lit(1).cast("long"), (F.size(p) - F.lit(1) - i + F.lit(tau)).cast("int"))
                moved = F.when(i < turn, F.when(d0.bitwiseAND(F.lit(top).cast("long")) == 0, 1).otherwise(0)).otherwise(
                    F.when(hp.bitwiseAND(edge) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(edge) != 0, 1).otherwise(0)
                )
                return F.struct(
                    hn.bitwiseOR(full.bitwiseXOR(down.bitwiseOR(hp))).bitwiseAND(full).alias("vp"),
                    down.bitwiseAND(hp).alias("vn"),
                    (d + moved).cast("int").alias("d"),
                )

            state = F.array(F.struct(eq.alias("e"), acc["vp"].alias("vp"), acc["vn"].alias("vn"), acc["d"].alias("d")))
            return F.get(F.transform(state, vectors), F.lit(0))

        start = F.struct(
            F.lit(((1 << width) - 1) ^ ((1 << tau) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(tau).cast("int").alias("d")
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(t) - F.lit(1)), start, column, lambda s: s["d"])

    return F.get(F.transform(F.array(chars), scan), F.lit(0))


def _probes(tau: int) -> list[tuple[int, int, int]]:
    """(i, delta, s): a line's segment i, cut as for a line delta characters shorter, looked for at shift s."""
    return [(i, delta, s) for i in range(1, tau + 2) for delta in range(tau + 1) for s in range(-(i - 1), i) if abs(s - delta) <= tau + 1 - i]


def signed(rows: DataFrame, text: str, tau: int, shortest: int, salt: str | None = None) -> DataFrame:
    """rows with key, probe (0: indexed), at (from 1) and width, a row for each segment and substring of the text.

    One hash expression after the explode keeps the generated code small enough to be compiled. Pieces are hashed as
    UTF-8; where all characters are ASCII they are cut by bytes, without counting through the text.
    """
    probes = [F.struct(*[F.lit(x).alias(n) for n, x in zip(("i", "delta", "shift"), one, strict=True)]) for one in _probes(tau)]
    kept = [c for c in rows.columns if c != salt]
    cut = rows.withColumns({"_chars": F.char_length(text), "_ascii": F.char_length(text) == F.octet_length(text), "_bytes": F.col(text).cast("binary")})
    out = cut.withColumn("_p", F.explode(F.array(*probes))).withColumn("_size", F.col("_chars") - F.col("_p.delta")).where(F.col("_size") >= shortest)
    begin = F.expr(f"cast((_size * (_p.i - 1)) div {tau + 1} as int)")
    out = out.withColumns({"at": begin + F.col("_p.shift") + 1, "width": F.expr(f"cast((_size * _p.i) div {tau + 1} as int)") - begin})
    piece = F.when(F.col("_ascii"), F.substring("_bytes", F.col("at"), F.col("width"))).otherwise(F.substring(F.col(text), F.col("at"), F.col("width")).cast("binary"))
    key = F.xxhash64(*([F.col(salt)] if salt else []), F.col("_p.i"), F.col("_size"), piece)
    return out.select(*kept, "at", "width", key.alias("key"), ((F.col("_p.delta") != 0) | (F.col("_p.shift") != 0)).cast("int").alias("probe"))


def bigram_parity(text: Column) -> Column:
    """PARITY longs as a struct: whether pairs of neighbouring characters, hashed to so many bits, are odd in number.

    An edit flips 4 bits at most.
    """
    # the last dot takes a whole character, where a match of no width would also stop within one beyond U+FFFF
    grams = F.regexp_extract_all(text, F.lit("(?s)(?=(..))."), F.lit(1))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 8).bitwiseAND(63).cast("int"))

    def part(hashes: Column, k: int) -> Column:
        return F.aggregate(F.filter(hashes, lambda h: h.bitwiseAND(PARITY - 1) == k), F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(bit(h)))

    hashed = F.array(F.transform(grams, lambda g: F.xxhash64(g)))  # an array of one, so that the hashes are made once
    return F.get(F.transform(hashed, lambda h: F.struct(*[part(h, k).alias(f"b{k}") for k in range(PARITY)])), F.lit(0))


def _pairs(rows: DataFrame, tau: int) -> DataFrame:
    """Pairs of different lines under a key of which one is indexed; rows: (key, probe, owner, h1, h2, bits, line).

    Bounds by bigram parities and lengths are conditions of the join itself, so that a group of lines that share a
    passage but are not alike puts out few pairs; bounded_edit_distance() decides on them.
    """
    a = rows.where("probe = 0").select("key", F.struct("owner", "h1", "h2").alias("a"), F.col("bits").alias("bits_a"), F.col("line").alias("line_a"))
    b = rows.select("key", "probe", F.struct("owner", "h1", "h2").alias("b"), F.col("bits").alias("bits_b"), F.col("line").alias("line_b"))
    flips = sum((F.bit_count(F.col(f"bits_a.b{k}").bitwiseXOR(F.col(f"bits_b.b{k}"))) for k in range(PARITY)), F.lit(0))
    # one condition, as the optimizer may reorder several; the cheapest come first
    near = F.expr("a != b and (probe = 1 or a < b)") & (flips <= 4 * tau) & (F.abs(F.char_length("line_a") - F.char_length("line_b")) <= tau)
    met = a.join(b, "key").where(near)
    low = F.least("a", "b")
    return met.select(
        low.alias("u"), F.greatest("a", "b").alias("v"), F.when(low == F.col("a"), F.col("line_a")).otherwise(F.col("line_b")).alias("x"), F.when(low == F.col("a"), F.col("line_b")).otherwise(F.col("line_a")).alias("y")
    )


def probably_among(rows: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """rows whose hash `name` is among those of keys, and a share of the others, by a broadcast of fixed size."""
    slot, word = (lambda c: c.bitwiseAND(SLOTS - 1)), (lambda c: F.shiftright(c, SLOTS.bit_length() - 1).bitwiseAND(WORDS - 1))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(c, (SLOTS * WORDS).bit_length() - 1).bitwiseAND(63).cast("int"))
    k = F.col(name)
    marks = [F.coalesce(F.bit_or(F.when(word(k) == i, bit(k))), F.lit(0).cast("long")).alias(f"_w{i}") for i in range(WORDS)]
    bits = checkpoint(keys.select(name).groupBy(slot(k).alias("_slot")).agg(*marks))
    mark = F.col("_w0")
    for i in range(1, WORDS):
        mark = F.when(word(k) == i, F.col(f"_w{i}")).otherwise(mark)
    return rows.withColumn("_slot", slot(k)).join(F.broadcast(bits), "_slot").where(mark.bitwiseAND(bit(k)) != 0).select(*rows.columns)


def _under(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows under one of these distinct keys. Where these are too many to broadcast, only rows that bits do not exclude are shuffled with their lines."""
    keys = checkpoint(keys)
    if keys.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), "key", "left_semi")
    # not a semi join, as the optimizer would move it before the bits
    return probably_among(rows, "key", keys).join(keys, "key")


def _live(rows: DataFrame) -> DataFrame:
    """rows, signed, under keys that hold two different lines, one of them indexed; told by two numbers a key."""
    keys = rows.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("probe").alias("p")).where("a != b and p = 0").select("key")
    return _under(rows, keys)


def _single(rows: DataFrame) -> DataFrame:
    """_live() rows without the keys that hold the same lines, indexed and probing, as a lesser key, and so pair the same; in one semi join."""
    members = rows.select("key", "probe", "h1", "h2").distinct()
    sums = [F.bit_xor(F.xxhash64(F.lit(seed), "h1", "h2", "probe")).alias(f"x{seed}") for seed in (1, 2)]
    live = members.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("probe").alias("p"), *sums).where("a != b and p = 0")
    return _under(rows, live.groupBy("x1", "x2").agg(F.min("key").alias("key")).select("key"))


def once(lines: DataFrame) -> DataFrame:
    """lines with the commonest ones, as many as may be broadcast, only in their least document; so each is signed once, not as often as it occurs."""
    counts = checkpoint(lines.groupBy("h1", "h2").agg(F.min("doc").alias("_least"), F.count("*").alias("_n")).where("_n > 1"))
    least = 2
    while counts.where(F.col("_n") >= least).count() > BROADCAST_ROWS:
        least *= 2
    return lines.join(F.broadcast(counts.where(F.col("_n") >= least).drop("_n")), ["h1", "h2"], "left").where("_least is null or doc = _least").select(*lines.columns)


def linked_lines(lines: DataFrame, tau: int, min_chars: int) -> DataFrame:
    """(u, v): the pairs of different lines within tau edits, u < v, each a struct (owner, h1, h2).

    lines: (key of its document, line, h1, h2) of lines of at least min_chars characters, repeated as they occur.
    """
    if min_chars < 4 * (tau + 1):
        raise ValueError("min_chars must be at least 4 * (tau + 1)")
    rest = F.concat(F.expr("substring(old, 1, at - 1)"), F.expr("substring(old, at + width)")).alias("rest")
    rows = _live(signed(once(lines), "line", tau, min_chars)).groupBy("key", "probe", "at", "width", "line", "h1", "h2").agg(F.min("doc").alias("owner"))
    rows = _single(checkpoint(rows)).withColumns({"old": F.col("line"), "bits": bigram_parity(F.col("line"))})
    for _ in range(REFINE):
        rows = checkpoint(rows.select("owner", "h1", "h2", "bits", "line", "key", rest).distinct())
        rows = _single(signed(rows.withColumnRenamed("rest", "old"), "old", tau, 1, "key"))
    pairs = _pairs(checkpoint(rows.select("key", "probe", "owner", "h1", "h2", "bits", "line").distinct()), tau)
    return pairs.dropDuplicates(["u", "v"]).where(bounded_edit_distance(F.col("x"), F.col("y"), tau) <= tau).select("u", "v")


def documents_of(docs: DataFrame, id_col: str, text_col: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    """docs with the number of its document by order of id and then of text as column `name`, and (name, id) of the numbers.

    If no id repeats and none is null, the ids are the numbers, and there is no second table.
    """
    ids = docs.select(id_key(id_col).alias("id"))
    if ids.groupBy("id").agg(F.count("*").alias("n"), F.max(F.col("id") == NO_ID).alias("none")).where("n > 1 or none").isEmpty():
        return docs.withColumn(name, id_key(id_col)), None
    sign = F.xxhash64(string_or_empty(text_col))
    # numbers of sorted rows grow from partition to partition; once written they stay
    ranks = checkpoint(docs.select(id_key(id_col).alias("id"), sign.alias("sign")).distinct().orderBy("id", "sign").withColumn(name, F.monotonically_increasing_id()))
    keyed = docs.join(ranks.withColumnsRenamed({"id": name + "id", "sign": name + "sign"}), (id_key(id_col) == F.col(name + "id")) & (sign == F.col(name + "sign"))).drop(name + "id", name + "sign")
    return keyed, ranks.select(name, "id")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 2, min_chars: int = 12) -> DataFrame:
    """docs with each line kept only where its class of near-equal lines first occurs, over all documents.

    Lines of at least min_chars characters within tau edits of each other are linked, and classes are the connected
    components; a class keeps the line whose first document has the least id (between lines of one document, an
    arbitrary but fixed one), there once. 4 * (tau + 1) characters are the least that the join supports; shorter lines are no
    passages and stay. Adds n_lines, n_kept, n_links (links
    of its lines to different ones) and class_id (the least id of a document that owns a line kept for one of its lines,
    itself if it has none). Null text: one empty line. Rows that share an id, or have none, are documents of their own by their
    texts, those without an id after all others, with a null class_id where they own their lines; rows equal in id and
    text are one document and keep the same lines. No rows: none. A column of docs with the name of an added one is replaced, all
    others pass through.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_kept", "n_links", "class_id")]
    mark = "_"
    while any(c.startswith(mark) for c in kept):
        mark += "_"
    doc, cut, taken, first_, tagged_ = (mark + n for n in ("doc", "lines", "gone", "first", "tagged"))
    docs, ranks = documents_of(docs.select(*kept), id_col, text_col, doc)
    base = docs.withColumn(cut, F.split(string_or_empty(text_col), "\n", -1))

    def lines_of(array: Column) -> DataFrame:
        lines = base.select(F.col(doc).alias("doc"), F.explode(array).alias("line")).where(F.char_length("line") >= min_chars)
        return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64("line", F.lit(17))})

    lines = lines_of(F.col(cut))
    links = checkpoint(linked_lines(lines_of(F.array_distinct(cut)), tau, min_chars))
    if links.isEmpty():
        near = None
    else:
        degree = links.select(F.col("u").alias("node")).unionAll(links.select(F.col("v").alias("node"))).groupBy("node").count()
        labels = components(links).join(degree, "node")
        near = labels.select(F.col("node.h1").alias("h1"), F.col("node.h2").alias("h2"), F.col("label.owner").alias("first"), F.col("label.h1").alias("r1"), F.col("label.h2").alias("r2"), F.col("count").alias("links"))
    counts = lines.select("doc", "h1", "h2").groupBy("h1", "h2").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"))
    if near is None:
        shared = counts.where("owner != last").select("h1", "h2", F.col("owner").alias("first"), F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.lit(0).cast("long").alias("links"))
    else:
        shared = counts.join(near, ["h1", "h2"], "left").where("owner != last or links is not null")
        shared = shared.select("h1", "h2", F.coalesce("first", "owner").alias("first"), F.coalesce("r1", "h1").alias("r1"), F.coalesce("r2", "h2").alias("r2"), F.coalesce("links", F.lit(0)).alias("links"))
    shared = checkpoint(shared)
    if (n := shared.count()) <= BROADCAST_ROWS:
        met = lines.join(F.broadcast(shared), ["h1", "h2"])
    else:  # a line that a third of all documents have is spread over the salts
        lines = probably_among(lines, "h1", shared)
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = lines.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(salted, ["h1", "h2", "salt"])
    goes = ~((F.col("first") == F.col("doc")) & (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")))
    gone = F.collect_set(F.when(goes, F.concat(F.lit(":"), "line")))
    told = met.groupBy(F.col("doc").alias(doc)).agg(gone.alias(taken), F.sum("links").alias("n_links"), F.min("first").alias(first_))
    tagged = F.transform(cut, lambda x, i: F.concat(F.when(F.char_length(x) < min_chars, i.cast("string")).otherwise(""), F.lit(":"), x))
    out = base.join(told, doc, "left").withColumn(tagged_, F.array_except(tagged, F.coalesce(taken, F.array().cast("array<string>"))))
    out = out.withColumn(first_, F.least(doc, F.coalesce(first_, doc)))
    if ranks is not None:
        out = out.join(ranks.select(F.col(doc).alias(first_), F.col("id").alias("class_id")), first_)
    else:
        out = out.withColumn("class_id", F.col(first_))
    return out.withColumns(
        {
            text_col: F.array_join(F.transform(tagged_, lambda x: F.substring(x, F.instr(x, ":") + 1, F.length(x))), "\n"),
            "n_lines": F.size(cut).cast("long"),
            "n_kept": F.size(tagged_).cast("long"),
            "n_links": F.coalesce("n_links", F.lit(0)).cast("long"),
            "class_id": F.when(F.col("class_id") != NO_ID, F.col("class_id")),
        }
    ).select(*kept, "n_lines", "n_kept", "n_links", "class_id")
