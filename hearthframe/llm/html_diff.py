"""Main text of pages: blocks of the markup, minus what a page shares with the page of the nearest URL on its host.

The nearest page is the neighbour, in the order of paths within a host, with the longer common beginning of the path; a
page with the same lines is a copy, not a neighbour. The lines of both, each with the kind of place it stands in, are aligned
by their longest common subsequence, and the lines they share go. Articles may quote one sentence, so a line within an
<article> or <main> goes only if it also stands outside of one on another page of the host, as what surrounds articles does.
Places that are never main text go in any case: elements for menus, forms and so on, and those whose class, id or role
says so by one of its names and speaks of no content by another (ad-slot, but neither share-prices nor "tags content");
what that leaves open the alignment decides.
"""

from __future__ import annotations

import bisect
import html as entities
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpoint, id_key, map_texts, string_or_empty

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Fixed values of HTML: elements whose content is no text, that are never main text, that hold nothing, and that break lines.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
NEVER = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "head", "object", "canvas", "audio", "video", "fieldset", "datalist"} | RAW
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words that mark a place as none of the article, if a class, an id or a role has no words but these and PARTS.
MARKS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments complementary consent contentinfo cookie cookies copyright disclaimer discussion disqus "
    "footer form gdpr hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices pagination paywall popup promo promos promoted promotion related recommended "
    "replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar tracking widget".split()
)
#: Names of a class, id or role that tell a place of content, whatever its other names are.
CONTENT = {"content", "contents", "body", "entry", "post", "story", "article", "main", "text", "prose"}
#: Words that say what shape a place has, not what it is about.
PARTS = set("area bar block body bottom box btn button buttons card cards col column container content entry form group holder icon icons inner item items label left link links list nav outer page panel policy post posts right row section site slot stories strip thread top unit wrap wrapper zone".split())
MAIN_WORDS = {"main", "article"}
#: A line's place: within the main element, or elsewhere.
MAIN, OTHER = 1, 0
SALTS = 16


def _marked(name: str, attributes: str, in_main: bool) -> bool:
    if name in NEVER or (name == "header" and not in_main):
        return True
    if not attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role") and name not in ("body", "html", "main", "article"):
            tokens = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split()
            for token in tokens if CONTENT.isdisjoint(tokens) else ():
                words = set(re.findall(r"[a-z]+", token))
                if words & MARKS and words <= MARKS | PARTS or words & {"header"} and words <= MARKS | PARTS | {"header"} and not in_main:
                    return True
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
    return False


def lines_of(page: str) -> list[tuple[int, str]]:
    """(place, line) for each block of text outside the places that are never main text; white space made one blank.

    Tags left open or closed out of order are repaired as browsers do, as far as it moves text between places.
    """
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, marked (itself or above), main (itself or above)
    at = 0

    def flush() -> None:
        line = "".join(text)
        line = " ".join((entities.unescape(line) if "&" in line else line).split())
        text.clear()
        if line:
            out.append((MAIN if stack and stack[-1][2] else OTHER, line))

    def pop_to(k: int) -> None:
        del stack[k:]

    while at < len(page):
        end = page.find("<", at)
        end = len(page) if end < 0 else end
        if end > at and not (stack and stack[-1][1]):
            text.append(page[at:end])
        if end == len(page):
            break
        m = TOKEN.match(page, end)
        if not m:  # a bare less-than sign
            if not (stack and stack[-1][1]):
                text.append("&lt;")
            at = end + 1
            continue
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA[") and not (stack and stack[-1][1]):
                text.append(entities.escape(m[0][9:-3]))
            continue
        if name in RAW and not m[1]:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in BLOCKS or name == "br":
            if name == "br":
                text.append(" ")
            else:
                flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
                if name not in BLOCKS and stack[k][0] in BLOCKS:
                    break  # an inline end tag does not close blocks
                if name == "p" and stack[k][0] in ("article", "main", "body", "div", "section"):
                    break
            continue
        if name in EMPTY or m[3].endswith("/") and name in ("svg", "path"):
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        for k in range(len(stack) - 1, -1, -1) if name in IMPLIED else ():
            if stack[k][0] in IMPLIED[name]:
                pop_to(k)
                break
            if stack[k][0] in ("ul", "ol", "dl", "table", "select", "tbody"):
                break
        above = stack[-1] if stack else ("", False, False)
        is_main = above[2] or name in MAIN_WORDS or "main" in m[3] and bool(re.search(r"role\s*=\s*[\"']?main", m[3]))
        stack.append((name, above[1] or _marked(name, m[3], is_main), is_main))
    flush()
    return out


def line_hash(place: int, line: str) -> int:
    """A hash of the line, whose last bit is its place."""
    return int.from_bytes(blake2b(line.encode(), digest_size=8).digest(), "little", signed=True) & ~1 | place


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions of a in a longest common subsequence of a and b, by rows of bits, equal ends taken first."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {*range(lead), *range(len(a) - tail, len(a))}
    both = set(a[lead : len(a) - tail]) & set(b[lead : len(b) - tail])
    x = [i for i in range(lead, len(a) - tail) if a[i] in both]
    y = [v for v in b[lead : len(b) - tail] if v in both]
    if not x:
        return found
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full, row, rows = (1 << len(y)) - 1, (1 << len(y)) - 1, []
    for i in x:
        rows.append(row)
        hit = row & where[a[i]]
        row = ((row + hit) | (row - hit)) & full
    j = len(y)
    for i, before in zip(reversed(x), reversed(rows), strict=True):  # zero bits of a row count the subsequence so far
        now = row
        while j and (now >> (j - 1)) & 1:
            j -= 1
        if not j:
            break
        if (before >> (j - 1)) & 1 and where[a[i]] >> (j - 1) & 1:
            found.add(i)
            j -= 1
        row = before
    return found


def main_text(lines: list[tuple[int, str]], other: list[int], outside: set[int]) -> str:
    """The page's lines without those shared with the other page, whose hashes are given; of a main element only those go that stand outside of one elsewhere."""
    hashes = [line_hash(*x) for x in lines]
    gone = shared_lines(hashes, other) if other else set()
    main = [i for i, (place, _) in enumerate(lines) if place == MAIN]
    if main:
        gone = {i for i in gone if hashes[i] in outside}
    return "\n".join(lines[i][1] for i in main or range(len(lines)) if i not in gone)


def url_parts(url: str):
    """host and path of a url column, lower-case host without port; no scheme, query or fragment needed."""
    rest = F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"[?#].*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/]*)", 1), r":\d+$", ""))
    return host, F.concat(F.lit("/"), F.regexp_replace(rest, r"^[^/]*/?", ""))


def _common(a, b):
    """Characters that two strings have in common at their beginnings."""
    n = F.least(F.length(a), F.length(b))
    differs = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), False)
    return F.when(a.isNull() | b.isNull(), F.lit(-1)).when(n == 0, F.lit(0)).when(differs == 0, n).otherwise(differs - 1)


def lines_outside(pages: DataFrame) -> DataFrame:
    """(page, outside): the hashes of each page's lines within main elements that stand outside of one on another page of its host."""
    lines = pages.select("host", "page", F.explode(F.array_distinct("hashes")).alias("hash"))
    lines = lines.select("page", "hash", F.xxhash64("host", F.shiftright("hash", 1)).alias("key"), (F.col("hash") % 2 != 0).alias("within"))
    apart = F.when(~F.col("within"), F.col("page"))
    keys = lines.groupBy("key").agg(F.min(apart).alias("low"), F.max(apart).alias("high"), F.max("within").alias("both")).where("low is not null and both")
    keys = checkpoint(keys.drop("both"))
    lines = lines.where("within")
    if keys.count() <= BROADCAST_ROWS:
        met = lines.join(F.broadcast(keys), "key")
    else:  # a line that all pages of a large host have is spread over the salts
        salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = lines.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    return met.where("low != page or high != page").groupBy("page").agg(F.collect_list("hash").alias("outside"))


def nearest_pages(pages: DataFrame, cuts: list[tuple[str, str, int]]) -> DataFrame:
    """(page, lines of the nearest page that is no copy, those of the own ones that stand outside a main element elsewhere) from (host, path, page, hashes); a host of any size spans several ranges.

    cuts, sorted places in the order (host, path, page), deal the rows out; the first and last row of each range are
    gathered, a row per range, so that neighbours meet over the ends of ranges as well.
    """
    place = F.struct("host", "path", "page")
    if cuts:
        fixed = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(k).cast("long").alias("page")) for h, p, k in cuts])
        ranged = pages.withColumn("_p", place).withColumn("part", F.size(F.filter(fixed, lambda c: c <= F.col("_p")))).drop("_p")
    else:
        ranged = pages.withColumn("part", F.lit(0))
    ranged = checkpoint(ranged)
    ranged = checkpoint(ranged.join(lines_outside(ranged), "page", "left"))
    row = F.struct("host", "path", "page", "hashes")
    ends = ranged.groupBy("part").agg(F.min(row).alias("low"), F.max(row).alias("high"))
    by_part = Window.orderBy("part")  # a row per range
    ends = checkpoint(ends.select("part", F.lag("high").over(by_part).alias("before"), F.lead("low").over(by_part).alias("after")))
    order = Window.partitionBy("part").orderBy("host", "path", "page")
    near = ranged.join(F.broadcast(ends), "part").select("host", "path", "page", "hashes", "outside", F.coalesce(F.lag(row).over(order), "before").alias("b"), F.coalesce(F.lead(row).over(order), "after").alias("a"))
    same = lambda c: F.when((F.col(f"{c}.host") == F.col("host")) & (F.col(f"{c}.hashes") != F.col("hashes")), F.col(c))
    near = near.withColumns({"b": same("b"), "a": same("a")})
    near = near.withColumn("pick", F.when(_common(F.col("path"), F.col("a.path")) > _common(F.col("path"), F.col("b.path")), F.col("a")).otherwise(F.coalesce("b", "a")))
    return near.select("page", F.col("pick.hashes").alias("other"), "outside").dropDuplicates(["page"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages' id and url with text (the main text, blocks joined by line ends) and n_chars.

    Null html: empty. Null urls: one host without name. Rows that are equal in id, url and html are one page, which is no
    neighbour of itself; other rows are pages of their own, whether or not they share an id or have one. No rows: none. Two passes
    parse the pages: the first keeps only hashes of lines for the alignment, the second ships the lines, compressed.
    """
    host, path = url_parts(url_col)
    base = pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("url"), F.xxhash64(id_key(id_col), F.coalesce(F.col(url_col).cast("string"), F.lit("")), string_or_empty(html_col)).alias("page"), string_or_empty(html_col).alias("html"), host.alias("host"), path.alias("path"))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = base.select("host", "path", "page").orderBy(F.xxhash64("host", "path", "page")).limit(8 * parts).collect()  # bounded by the number of partitions
    ordered = sorted({(x.host, x.path, x.page) for x in sample}, key=lambda x: (x[0].encode(), x[1].encode(), x[2]))
    cuts = ordered[8::8]

    def hashed(texts: Iterator[str | None]) -> dict[str, pa.Array]:
        return {"hashes": pa.array([[line_hash(*x) for x in lines_of(h)] for h in texts], pa.list_(pa.int64()))}

    def packed(texts: Iterator[str | None]) -> dict[str, pa.Array]:
        return {"lines": pa.array([zlib.compress("\n".join(f"{p}{t}" for p, t in lines_of(h)).encode(), 1) for h in texts], pa.binary())}

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for blob, other, outside in zip(*[batch.column(c) for c in ("lines", "other", "outside")], strict=True):
                lines = [(int(x[0]), x[1:]) for x in zlib.decompress(blob.as_py()).decode().split("\n") if x]
                texts.append(main_text(lines, other.as_py() or [], set(outside.as_py() or ())))
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), *made], names=["key", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)[id_col]
    signs = map_texts(base.select("host", "path", "page", "html"), "html", "hashes array<long>", hashed, keep=False)
    # equal pages have equal lines, so any of them will do
    near = nearest_pages(signs.dropDuplicates(["page"]), cuts)
    whole = map_texts(base.select("key", "url", "page", "html"), "html", "lines binary", packed, keep=False)
    out = whole.join(near, "page", "left").select("key", "url", "lines", "other", "outside").mapInArrow(aligned, f"key {kind}, url {dict(pages.dtypes)[url_col]}, text string, n_chars long")
    return out.select(F.col("key").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
