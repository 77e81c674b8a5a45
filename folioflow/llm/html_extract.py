"""Main text of web pages: page differencing against the nearest URLs of the host, with element roles as its guard.

A page becomes text lines, one per block, each with the role of the elements around
it. Every page is paired with the pages before and after it in the order of URL paths
within its host; the lines of both are aligned by longest common subsequence, and
shared lines are deleted. Only line hashes move between pages. Then roles correct
this: a marked article rules if it holds the larger part of the text that no neighbour
shares, so that its lines are restored and others go; an article that is less than the
rest, as a teaser is, rules nothing, and differencing decides alone. Lines of two pages
that are copies are restored too, and what lies in menus, headers, footers, sidebars,
notices, adverts, forms or comments is dropped whether or not another page shares it.
"""

from __future__ import annotations

import bisect
import html as entities
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, bounded_batches, neighbours, table, text_or_empty
from folioflow.llm.url_filter import host_of, path_of

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SUBSTANCE = re.compile(r"[^\W_]+")
#: Element names by what they are in HTML.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
CLOSERS = {tag: re.compile(f"</{tag}\\b[^>]*>", re.I) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img del label ruby rt rp acronym".split())
ARTICLE = frozenset("article main".split())
BOILER = frozenset("nav footer aside form head menu dialog button select option fieldset svg math object canvas audio video map applet header".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id values that mark an element as no part of the article.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related "
    "recommended recommendations share sharing social comment comments commentlist disqus respond reply replies notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "subscription signup login search form copyright toolbar pagination pager skip skiplink paywall outbrain taboola".split()
)
ARTICLE_BOILER_WORDS = frozenset("comment comments reply ad advert related".split())
#: Words that may stand beside these in one class or id value, as in share-buttons; others, as in share-price, make it another thing.
NEUTRAL_WORDS = frozenset(
    "area bar block body box button buttons container content group icon icons inner item items link links list main page panel post posts reader readers section site slot top bottom left right unit user users wrap wrapper".split()
)
CLOSED_BY_BLOCK = frozenset(["p"])
#: What an opening tag ends, where its own end tag may be left out, and the elements that this does not reach out of.
ROWS, GROUPS = frozenset("td th tr".split()), frozenset("thead tbody tfoot".split())
LIKES = {
    "option": frozenset(["option"]), "optgroup": frozenset("option optgroup".split()), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()),
    "td": frozenset("td th".split()), "th": frozenset("td th".split()), "tr": ROWS,
} | dict.fromkeys(GROUPS, ROWS | GROUPS)
HOLDERS = ARTICLE | {"table"}
LIST_HOLDERS = HOLDERS | frozenset("select datalist dl ul ol menu td th section nav aside header footer form fieldset figure blockquote dialog details object".split())


def marks(value: str, words: frozenset[str]) -> bool:
    """Whether a token of a class or id value is made of such words, beside neutral ones."""
    for token in value.split():
        parts = SUBSTANCE.findall(token)
        if not words.isdisjoint(parts) and all(p in words or p in NEUTRAL_WORDS or p.isdigit() for p in parts):
            return True
    return False


def is_boiler(tag: str, attributes: str) -> bool:
    if tag in BOILER:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and marks(value, ARTICLE_BOILER_WORDS if tag in ARTICLE else BOILER_WORDS):
            return True
        if name == "role" and value in BOILER_ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


def is_article(tag: str, attributes: str) -> bool:
    return tag == "article" or (bool(attributes) and "articlebody" in attributes.lower())


#: Bytes of a line's hash, which is compared with those of two other pages only.
HASH = 6
#: Kinds of a line: of the article, of the page outside it or without one, and boilerplate by its role.
INSIDE, OUTSIDE, ROLE = 1, 0, 2


#: What a page marks: nothing, articles, or its main part alone.
NOTHING, ARTICLES, MAIN = 0, 1, 2


def lines_of(page: str) -> tuple[list[str], list[int], int]:
    """Blocks of visible text, the kind of each, and what the page marks.

    Truncated pages and unclosed elements are read as far as they go; a block ends at any element that is not inline.
    """
    out: list[str] = []
    kinds: list[int] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # element and kind: 1 boilerplate, 2 article, 4 main, 0 else
    boiler = article = main = 0
    mains: list[bool] = []
    places: dict[str, list[int]] = {}  # of the open elements of a name in the stack

    def last(name: str) -> int:
        return mine[-1] if (mine := places.get(name)) else -1

    def shut(depth: int) -> None:
        """End the elements of the stack from this place on."""
        nonlocal boiler, article, main
        while len(stack) > depth:
            name, kind = stack.pop()
            places[name].pop()
            boiler, article, main = boiler - (kind == 1), article - (kind == 2), main - (kind == 4)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append(text)
                kinds.append(ROLE if boiler else INSIDE if article else OUTSIDE)
                mains.append(main > 0)

    at, end = 0, page.rfind(">") + 1  # no tag ends behind it
    while m := TAG.search(page, at, end):
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if m.start() > at:
            parts.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            at = len(page)  # a comment that nothing closes
        if not tag:
            continue
        tag = tag.lower()
        if not closing:
            if tag in RAW:
                close = CLOSERS[tag].search(page, at)
                at = close.end() if close else len(page)
                if tag in ("textarea", "iframe"):  # the others leave no trace in a line
                    flush()
                continue
            odd = is_boiler(tag, attributes)
            if tag in ("header", "hgroup") and article and odd:
                odd = False  # an article's own heading
            if tag not in INLINE or odd:
                flush()
            if tag in VOID or (tag in INLINE and not odd):
                continue
            if tag not in INLINE:
                while stack and (stack[-1][0] in CLOSED_BY_BLOCK or stack[-1][0] == tag == "li"):
                    shut(len(stack) - 1)
                if tag in LIKES:
                    bar = max(map(last, HOLDERS if tag in ROWS or tag in GROUPS else LIST_HOLDERS))
                    shut(min((k for k in map(last, LIKES[tag]) if k > bar), default=len(stack)))
            kind = 1 if odd else 2 if is_article(tag, attributes) else 4 if tag == "main" or 'role="main"' in attributes else 0
            boiler, article, main = boiler + (kind == 1), article + (kind == 2), main + (kind == 4)
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, kind))
        else:
            depth = last(tag)
            if tag not in INLINE or depth >= 0:
                flush()
            if depth >= 0:
                shut(depth)
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<[a-zA-Z/!?][^>]*\Z", rest)  # a tag that the end of the page cuts off
        parts.append(entities.unescape(rest[: cut.start()] if cut else rest))
    flush()
    if INSIDE in kinds:
        return out, kinds, ARTICLES
    kinds = [INSIDE if k == OUTSIDE and m else k for k, m in zip(kinds, mains, strict=True)]
    return out, kinds, MAIN if INSIDE in kinds else NOTHING


def rules(marked: int, kinds: list[int], sizes: list[int], gone: set[int] = frozenset()) -> bool:
    """Whether what the page marks is its text: its main part always, articles if they are the larger part of what could stay.

    Of the lines outside, those that a neighbour shares do not count.
    """
    if marked != ARTICLES:
        return marked == MAIN
    inside = sum(n for kind, n in zip(kinds, sizes, strict=True) if kind == INSIDE)
    return inside > 0 and inside >= sum(n for k, (kind, n) in enumerate(zip(kinds, sizes, strict=True)) if kind == OUTSIDE and k not in gone)


def chosen(kinds: list[int], gone: set[int], copy: bool, article: bool) -> list[int]:
    """Positions of the lines that stay: ``gone`` are those that a neighbour shares; it is a ``copy`` if it shares all that could stay."""
    if article:
        return [k for k, kind in enumerate(kinds) if kind == INSIDE]  # shared or not: restored
    return [k for k, kind in enumerate(kinds) if kind != ROLE and (copy or k not in gone)]


def shared(lines, other) -> set[int]:
    """Positions of ``lines`` in its longest common subsequence with ``other``; the k-th copies of a line match each other."""

    def numbered(x):
        seen: dict = {}
        for h in x:
            seen[h] = seen.get(h, 0) + 1
            yield h, seen[h]

    where = {key: k for k, key in enumerate(numbered(other))}
    pairs = [(k, where[key]) for k, key in enumerate(numbered(lines)) if key in where]
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, w) in enumerate(pairs):  # longest increasing run of places in the other page
        k = bisect.bisect_left(tails, w)
        before[n] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(w)
            ends.append(n)
        else:
            tails[k], ends[k] = w, n
    out, n = set(), ends[-1] if ends else -1
    while n >= 0:
        out.add(pairs[n][0])
        n = before[n]
    return out


def hashes_of(packed: bytes) -> list[bytes]:
    return [packed[k : k + HASH] for k in range(0, len(packed), HASH)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", pairing: bool = True) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_lines (text lines kept), n_shared (lines that a neighbour shares), n_restored (of these, kept).

    * A null html counts as empty and gives empty text; a null url has an empty host and is paired with its likes.
    * An article that is the larger part of the lines without a role, or of those of them that no neighbour shares, is the text,
      and so is the main part of a page without one.
    * Another page that shares all its lines with a neighbour is a copy of it and keeps them.
    * Without ``pairing`` no line is shared. Repeated rows stay repeated and are paired like others. Very long pages count whole.
    * An empty table gives no rows. Only the three named columns are read.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "html")
    url = pages[url_col]
    kind = pages.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [lines_of(page) for page in b.column(4).to_pylist()]
            hashes = [b"".join(xxhash.xxh64_digest(x)[:HASH] for x in lines) for lines, _, _ in found]
            # Of a page whose article is the larger part whatever is shared, no other line can stay. What can stay travels packed.
            sizes = [[len(x) for x in lines] for lines, _, _ in found]
            sure = [rules(marked, kinds, n) for (_, kinds, marked), n in zip(found, sizes, strict=True)]
            sizes = [n if has and not one else None for (_, _, has), n, one in zip(found, sizes, sure, strict=True)]
            lines = [[x if k == INSIDE or (k == OUTSIDE and not one) else "" for x, k in zip(x, kinds, strict=True)] for (x, kinds, _), one in zip(found, sure, strict=True)]
            packed = [zlib.compress("\n".join(x).encode("utf-8", "surrogatepass")) for x in lines]  # a line has no line break
            columns = [pa.array(packed, pa.binary()), pa.array([bytes(f[1]) for f in found], pa.binary()), pa.array(hashes, pa.binary()), pa.array(sizes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *columns], names=["page_id", "url", "host", "path", "packed", "kinds", "hashes", "sizes"])

    rows = pages.select(pages[id_col].alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), text_or_empty(pages[html_col]).alias("html"))
    parsed = rows.mapInArrow(work, f"page_id {kind}, url string, host string, path string, packed binary, kinds binary, hashes binary, sizes array<int>")
    parsed = scratch.put(parsed.withColumn("row", F.monotonically_increasing_id()), "parsed")

    @F.pandas_udf("kept array<int>, n_shared long, n_restored long")
    def differenced(kinds: pd.Series, sizes: pd.Series, mine: pd.Series, prev: pd.Series, following: pd.Series) -> pd.DataFrame:
        """``sizes`` of the lines are given where it depends on what is shared whether the article rules."""
        out = []
        for kind, size, x, *others in zip(kinds, sizes, mine, prev, following, strict=True):
            could = {k for k, one in enumerate(kind) if one != ROLE}
            gone: set[int] = set()
            copy = False
            for found in (shared(hashes_of(x), hashes_of(o)) for o in others if o is not None):
                copy |= found >= could
                gone |= found
            article = INSIDE in kind if size is None else rules(ARTICLES, list(kind), list(size), gone)
            kept = chosen(list(kind), gone, copy, article)
            out.append((kept, len(gone), len(gone.intersection(kept))))
        return pd.DataFrame(out, columns=["kept", "n_shared", "n_restored"])

    near = neighbours(scratch, parsed.select("row", "host", "path", "kinds", "sizes", "hashes"), ["host", "path", "row"], "hashes", "host", ("host", "row"))
    others = (F.col("prev"), F.col("next")) if pairing else (F.lit(None).cast("binary"),) * 2
    kept = near.select("row", differenced("kinds", "sizes", "hashes", *others).alias("d")).select("row", "d.*")

    @F.pandas_udf("string")
    def text_of(packed: pd.Series, kept: pd.Series) -> pd.Series:
        def one(x, places):
            lines = zlib.decompress(x).decode("utf-8", "surrogatepass").split("\n")
            return " ".join([lines[k] for k in places])

        return pd.Series([one(*x) for x in zip(packed, kept, strict=True)], dtype="object")

    done = parsed.select("row", "page_id", "url", "packed").join(kept, "row").withColumn("text", text_of("packed", "kept"))
    return done.select(
        F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), F.size("kept").cast("long").alias("n_lines"), "n_shared", "n_restored"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
