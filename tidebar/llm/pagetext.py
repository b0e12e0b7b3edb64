"""Main text of web pages by removal of site templates (operator 12).

Every element's subtree is hashed (tags and text, bottom up). Spark counts per host on how many pages with
different content a subtree stands, and a subtree that recurs on many pages of its host is deleted from all
of them. What is left loses the parts that a page itself marks as no article: menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments, by element, role, or words of class
and id. The rest of the page's article (or main element, or body) is its text.

Two things are never taken for a template: what makes up half of the page's text or more, and inside an
article the author's own blocks (paragraphs, headings, lists, tables, quotations), so copied articles and
repeated passages stay. Pages of one host with the same content count once.

The first pass sends a row of five longs for each subtree; the second reads the pages again with the
subtrees to delete, few rows that are broadcast where they have been counted as few. A hot host's
subtrees are counted in two steps and joined in salted parts.

Defined cases: null html is an empty page with empty text; a page without a host is compared with none;
unclosed and misnested elements end as browsers end them, tags that never end are text, comments and raw text
elements that never end reach to the end; line breaks are white space; pages of any length count whole; repeated
rows give repeated results and count once; an empty table gives an empty table; an input column with the
name of an output column is replaced, all others are carried along.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.llm.common import packed, small, unpacked, written

#: A template stands on this many pages at least, and on this share of its host's pages.
LEAST_PAGES, SHARE = 4, 0.3
#: Pages with subtrees to delete that may be broadcast with their lists; salted parts of a hot subtree.
BROADCAST_PAGES, SALT_ROWS = 20_000, 200_000

# -- fixed values: names of elements, roles and common class words --------------------------------------

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
#: Elements that are blocks of text of their own; all others are parts of a line.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that end an open paragraph.
ENDS_P = BLOCK - set("body caption dd dt head html legend li optgroup option select tbody td tfoot th thead tr".split())
#: An opening tag ends the nearest open element of the first set, unless one of the second stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "body": ({"head"}, set()),
}
SCOPE = {"html", "table", "td", "th", "caption", "object", "template"}
#: The author's own blocks.
PROSE = set(
    "p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol dl dt dd table thead tbody tfoot tr td th caption figure figcaption".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
NO_TEXT = set(
    "head script style title noscript template iframe object embed applet canvas audio video svg nav aside footer form "
    "button select option textarea input label fieldset datalist dialog menu noembed noframes xmp map".split()
)
NO_TEXT_ROLES = set(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
NO_TEXT_WORDS = set(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices "
    "notification pager pagination popover popup promo promoted promotion recommended related replies respond share sharing "
    "sidebar signup social sponsor sponsored sponsors subscribe subscription teaser toolbar topbar widget widgets".split()
)
#: A class that begins like this says something about a page, not about the element itself.
ABOUT = ("has-", "no-", "with-", "without-", "is-", "not-")

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[^a-z0-9]+")
_TELLING = re.compile("class|id|role|hidden|style", re.IGNORECASE)
_UNSEEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)


class Page:
    """Elements in page order with their parents, and the text between them."""

    def __init__(self, source: str):
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.attributes: list[str] = []
        #: (element, text), or None where a block begins or ends
        self.events: list[tuple[int, str] | None] = []
        self._open: list[int] = []
        self._opened: Counter = Counter()
        self._start("#page", "")
        at = 0
        while True:
            found = _TAG.search(source, at)
            if found is None:
                break
            self._text(source[at : found.start()])
            at = found.end()
            end, name, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if not name:
                continue
            name = name.lower()
            if end:
                self._end(name)
                continue
            self._begin(name, attributes)
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
                at = stop.end() if stop else len(source)
                self._end(name)
        self._text(source[at:])

    def _start(self, name: str, attributes: str) -> None:
        self.parent.append(self._open[-1] if self._open else -1)
        self._opened[name] += 1
        self._open.append(len(self.tag))
        self.tag.append(name)
        self.attributes.append(attributes)

    def _text(self, text: str) -> None:
        if text:
            self.events.append((self._open[-1], references.unescape(text) if "&" in text else text))

    def _close(self, names: set[str], stops: set[str]) -> bool:
        if not any(self._opened[name] for name in names):
            return False
        for k in range(len(self._open) - 1, 0, -1):
            name = self.tag[self._open[k]]
            if name in names:
                self._opened.subtract(self.tag[i] for i in self._open[k:])
                del self._open[k:]
                return True
            if name in stops:
                return False
        return False

    def _begin(self, name: str, attributes: str) -> None:
        if name in ("html", "body") and self._opened[name]:
            return
        if name in BLOCK:
            self.events.append(None)
        if name in ENDS_P:
            self._close({"p"}, SCOPE | {"button"})
        if name in ENDS:
            self._close(*ENDS[name])
        if name == "br":
            self.events.append((self._open[-1], " "))
        if name in VOID:
            return
        self._start(name, attributes)

    def _end(self, name: str) -> None:
        if name not in BLOCK:
            self._close({name}, BLOCK)
        elif self._close({name}, set() if name in SCOPE or name == "body" else SCOPE) or name == "p":
            self.events.append(None)  # an end without its beginning is nothing, but for a paragraph's

    # -- what is no article -----------------------------------------------------------------------

    def sizes(self) -> list[int]:
        """Characters of visible text below each element."""
        size = [0] * len(self.tag)
        for event in self.events:
            if event:
                size[event[0]] += len(event[1].strip())
        for i in range(len(size) - 1, 0, -1):
            size[self.parent[i]] += size[i]
        return size

    def _says(self, i: int) -> str:
        """What the element says of itself: "other" than the article, a "header", or nothing."""
        name, attributes = self.tag[i], self.attributes[i]
        if name in NO_TEXT:
            return "other"
        if name in ("html", "body", "main", "#page") or not _TELLING.search(attributes):
            return "header" if name == "header" else ""
        values = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        if "hidden" in values or values.get("aria-hidden") == "true" or _UNSEEN.search(values.get("style", "")):
            return "other"
        if values.get("role", "").lower() in NO_TEXT_ROLES:
            return "other"
        names = f"{values.get('class', '')} {values.get('id', '')}".lower().split()
        if name == "article":
            return "" if NO_TEXT_WORDS.isdisjoint(names) else "other"
        words = {w for n in names if not n.startswith(ABOUT) for w in _WORDS.split(n)}
        if not NO_TEXT_WORDS.isdisjoint(words):
            return "other"
        return "header" if name == "header" or "header" in words else ""

    def article(self, deleted: set[int] = frozenset()) -> tuple[list[bool], list[int], bool]:
        """Which elements are left out, the elements whose text is the article, and whether they are marked as one.

        ``deleted``: elements that are left out in any case, as templates of the site.
        """
        n = len(self.tag)
        size, says = self.sizes(), [self._says(i) for i in range(n)]
        within, heading = [False] * n, [False] * n
        for i in range(1, n):
            within[i] = within[self.parent[i]] or self.tag[self.parent[i]] in ("article", "main")
        for i in range(n - 1, 0, -1):
            heading[i] = heading[i] or self.tag[i] in HEADINGS
            heading[self.parent[i]] |= heading[i]
        marked = [x == "other" or x == "header" and not (within[i] and heading[i]) for i, x in enumerate(says)]
        body = max((size[i] for i in range(n) if self.tag[i] == "body"), default=size[0])

        def left_out(kept: set[int]) -> list[bool]:
            out = [False] * n
            for i in range(1, n):
                out[i] = out[self.parent[i]] or i in deleted or marked[i] and i not in kept
            return out

        out = left_out(set())
        for name in ("article", "main"):
            every = [i for i in range(n) if self.tag[i] == name]
            found = [i for i in every if not out[i]]
            if not found and every and not any(i in deleted for i in every):
                around = set()  # the page wraps its article into an element that is marked
                for i in every:
                    if not marked[i]:
                        while i > 0:
                            around.add(i)
                            i = self.parent[i]
                if around:
                    out = left_out(around)
                    found = [i for i in every if not out[i]]
            if found:
                return out, found, True
        most = {i for i in range(n) if 2 * size[i] > body and self.tag[i] not in ("nav", "footer", "aside", "head")}
        return left_out(most), [0], False

    def text(self, out: list[bool], scope: list[int]) -> str:
        """The blocks of the scope, one a line."""
        inside = [False] * len(self.tag)
        for i in range(len(self.tag)):
            inside[i] = not out[i] and (i in scope or i > 0 and inside[self.parent[i]])
        blocks, held = [], []
        for event in [*self.events, None]:
            if event is None:
                line = " ".join("".join(held).split())
                if line:
                    blocks.append(line)
                held = []
            elif inside[event[0]]:
                held.append(event[1])
        return "\n".join(blocks)

    # -- subtrees ---------------------------------------------------------------------------------

    def subtrees(self) -> dict[int, int]:
        """element -> hash of its subtree, for all that have text; of a chain with one text the outermost."""
        parts: list[list[str]] = [[] for _ in self.tag]
        places: list[tuple[int, int, str]] = []
        for k, event in enumerate(self.events):
            if event:
                text = " ".join(event[1].split())
                if text:
                    places.append((event[0], k, text))
        own: dict[int, list[str]] = {}
        for i, _, text in places:
            own.setdefault(i, []).append(text)
        hashes: dict[int, int] = {}
        below: list[list[int]] = [[] for _ in self.tag]
        for i in range(len(self.tag) - 1, 0, -1):
            children = below[i][::-1]
            parts[i] = own.get(i, []) + [f"\1{hashes[c]}" for c in children]
            if parts[i]:
                hashes[i] = xxhash.xxh64_intdigest("\0".join([self.tag[i], *parts[i]])) - 2**63
                below[self.parent[i]].append(i)
        return {i: h for i, h in hashes.items() if self.parent[i] <= 0 or len(parts[self.parent[i]]) > 1}

    def candidates(self, scope: list[int], marked: bool) -> dict[int, int]:
        """The subtrees that may be templates of the site."""
        n = len(self.tag)
        size, around, inside = self.sizes(), set(), [False] * n
        for i in scope:
            while i > 0:
                around.add(i)
                i = self.parent[i]
        for i in range(1, n):
            inside[i] = inside[self.parent[i]] or self.parent[i] in scope
        most = sum(size[i] for i in scope)
        return {
            i: h for i, h in self.subtrees().items()
            if i not in around and self.tag[i] not in ("html", "body", "head", *RAW)
            and (not inside[i] or 2 * size[i] < most and not (marked and (self.tag[i] in PROSE or self.tag[i] not in BLOCK)))
            and not (self.tag[self.parent[i]] == "head")
        }


# -- the operator -----------------------------------------------------------------------------------

def host_of(url) -> F.Column:
    """The host in lower case, without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _with_host(pages: DataFrame, url: str, html: str) -> DataFrame:
    source = F.coalesce(F.col(html), F.lit(""))
    host = host_of(F.col(url))
    return pages.select(
        packed(pages), F.xxhash64(host).alias("h"), F.xxhash64(host, source).alias("d0"),
        F.xxhash64(F.lit(1), host, source).alias("d1"), (host != "").alias("hosted"), source.alias("html"),
    )


def subtree_rows(rows: DataFrame) -> DataFrame:
    """(h, sub, content, d0, d1): every candidate of every page that has a host; a row with sub 0 for the page itself."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found: list[tuple[list[int], int]] = []
            for text in batch.column(3).to_pylist():
                page = Page(text)
                out, scope, marked = page.article()
                subs = set(page.candidates(scope, marked).values()) - {0}
                found.append(([0, *subs], xxhash.xxh64_intdigest(page.text(out, scope)) - 2**63))
            n = [len(subs) for subs, _ in found]
            longs = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(longs[0], n)), pa.array([s for subs, _ in found for s in subs], pa.int64()),
                 pa.array(np.repeat(np.array([c for _, c in found], np.int64), n)),
                 pa.array(np.repeat(longs[1], n)), pa.array(np.repeat(longs[2], n))],
                ["h", "sub", "content", "d0", "d1"],
            )

    return rows.filter("hosted").select("h", "d0", "d1", "html").mapInArrow(run, "h long, sub long, content long, d0 long, d1 long")


def templates(candidates: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(h, sub, n): the subtrees that recur on many pages of their host, and on how many."""
    seen = candidates.select("h", "sub", "content").distinct().groupBy("h", "sub").agg(F.count("*").alias("n"))
    counts = written(seen.filter((F.col("n") >= least)), "subtrees")
    hosts = counts.filter("sub = 0").select("h", F.col("n").alias("pages"))
    return counts.filter("sub <> 0").join(small(hosts), "h").filter(F.col("n") >= F.col("pages") * share).select("h", "sub", "n")


def to_delete(candidates: DataFrame, found: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(d0, d1, subs): of each page the subtrees to delete."""
    most = found.agg(F.max("n")).first()[0] or 0
    salts = max(1, min(1024, -(-most // salt_rows)))
    spread = found.select("h", "sub", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return (
        candidates.filter("sub <> 0").withColumn("salt", F.pmod("d0", F.lit(salts)).cast("int"))
        .join(small(spread), ["h", "sub", "salt"])
        .groupBy("d0", "d1").agg(F.collect_set("sub").alias("subs"))
    )


def extract(
    pages: DataFrame, url: str = "url", html: str = "html", least: int = LEAST_PAGES, share: float = SHARE,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``text``, the main text, and ``n_chars``, its code points."""
    kept = pages.columns if keep is None else keep
    rows = _with_host(pages, url, html)
    candidates = written(subtree_rows(rows), "subtrees")
    found = written(templates(candidates, least, share), "templates")
    deletions = written(to_delete(candidates, found), "deletions")
    joined = rows.join(small(deletions, BROADCAST_PAGES), ["d0", "d1"], "left")
    packs = joined.select(F.struct(*[F.col("row").getField(c).alias(c) for c in kept]).alias("row"), "html", "subs")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = []
            for text, subs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                page = Page(text)
                out, scope, marked = page.article()
                if subs:
                    known = set(subs)
                    deleted = {i for i, h in page.candidates(scope, marked).items() if h in known}
                    out, scope, _ = page.article(deleted)
                texts.append(page.text(out, scope))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    schema = T.StructType([packs.schema["row"], T.StructField("text", T.StringType())])
    return unpacked(packs.mapInArrow(run, schema), kept, text=F.col("text"), n_chars=F.length("text").cast("long"))
