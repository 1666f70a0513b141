"""Operator 12: the main text of pages, by removal of what a site's pages share.

A page is parsed into elements, leniently as browsers do: end tags may be missing, paragraphs and list items end where the
next begins, scripts and comments hold no tags, a tag that never ends is dropped. Each element that holds text is hashed: its
name, class and id, its words and its elements. Spark counts, for each host, the elements that recur, over different
contents: pages whose longest block of text is the same are copies of one article and count once. Elements that recur over
MANY contents of their host, and SHARE of all of them, are template. The text is then taken from the article:

* Its element is the `article` with most text, else `main` or one so named, else the deepest element that still holds
  MOST of the page's text, template left out.
* Never part of it are menus, page headers, footers, asides, forms, scripts, styles and the like, and elements whose class,
  id or role says notice, advert, sidebar, menu or comments. What holds the article itself is not dropped.
* Template elements go, with all they hold. Inside an `article`, where sentences that many articles share are text and not
  template, only containers go; a paragraph, heading or list item alone stays. On pages without such an element, single
  blocks that recur go too, where no text of the page's own comes before them, or none after.

Blocks are what stands between starts and ends of block elements. Character references are decoded; white space is what
Python's str.split() takes for it, `br` and no-break spaces included. A block that is empty then is left out.

Null or empty html, or html without text of an article, gives an empty text. Pages without a host in their url have no
template. Repeated rows are pages of their own and come out alike; a page of any length is parsed whole, in one pass with a
stack, so neither depth nor missing end tags matter.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts, trimmed, unused

MANY, SHARE, MOST = 5, 0.01, 0.6
#: Template elements that are broadcast at most, at eight bytes each; more are joined.
BROADCAST = 1 << 21

# HTML's elements without content, with raw text, of block level, and what ends an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body caption dd dt head html legend li optgroup option p select tbody td tfoot th thead tr".split()) | {"p"}
SAME = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
SAME |= {k: ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}) for k in ("thead", "tbody", "tfoot")}
#: Elements that are no text of an article, and words of a class, id or role that say so.
DROPPED = frozenset("head nav footer aside form button select option textarea dialog menu search template noscript svg object embed canvas audio video iframe script style title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices alert alerts notification sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs comment comments commentlist discussion disqus reply replies respond share sharing social newsletter subscribe subscription signup popup modal overlay related recommended footer toolbar widget widgets pager pagination login masthead topbar".split()
)
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr caption figcaption".split())
_CONTENT = re.compile(r"^(?:article|content|main|post|entry|story)(?:-?(?:body|content|text|main))?$")
_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """The elements of a page in the order of their starts: names, words of class, id and role, parents, hashes, and the ranges
    of tokens that they hold. A token is a text, or None where a block starts or ends."""

    def __init__(self, html: str):
        self.tokens: list[str | None] = []
        self.name, self.attributes, self.parent, self.first, self.last, self.hash = ["#"], [""], [-1], [0], [0], [0]
        self.open: list[int] = [0]
        self.counts: dict[str, int] = {}
        self.parts: list[list[bytes]] = [[b"#"]]
        at = 0
        while m := _TAG.search(html, at):
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            name = name.lower()
            if m.group(1):
                self.end(name)
                continue
            self.start(name, m.group(3))
            if name in RAW:
                close = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(html, at)
                to = close.start() if close else len(html)
                if name == "xmp":
                    self.text(html[at:to])
                at = to
                if not close:
                    self.end(name)
        if at < len(html):
            self.text(html[at:])
        while self.open:
            self.close()

    def text(self, raw: str) -> None:
        words = unescape(raw)
        self.tokens.append(words)
        words = " ".join(words.split())
        if words:
            self.parts[-1].append(words.encode("utf-8", "surrogatepass"))

    def close(self) -> None:
        k, parts = self.open.pop(), self.parts.pop()
        self.counts[self.name[k]] = self.counts.get(self.name[k], 0) - 1
        if self.name[k] in BLOCK:
            self.tokens.append(None)
        self.last[k] = len(self.tokens)
        if len(parts) > 1:  # it holds text
            self.hash[k] = xxhash.xxh3_64_intdigest(b"\0".join(parts)) or 1
            if self.parts:
                self.parts[-1].append(self.hash[k].to_bytes(8, "little"))

    def close_until(self, names: set[str] | frozenset[str], but: set[str] | frozenset[str]) -> None:
        """Ends the innermost open element of one of the names, and what is open in it, unless one of but comes first."""
        if not any(self.counts.get(n, 0) > 0 for n in names):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.name[self.open[depth]]
            if name in names:
                while len(self.open) > depth:
                    self.close()
                return
            if name in but:
                return

    def start(self, name: str, attributes: str) -> None:
        if name in ENDS_P and self.counts.get("p", 0) > 0:
            self.close_until({"p"}, {"button", "table", "td", "th", "object"})
        if name in SAME:
            names, but = SAME[name]
            if name in ("tr", "thead", "tbody", "tfoot"):
                while any(self.counts.get(n, 0) > 0 for n in names) and self.name[self.open[-1]] != "table" and (before := len(self.open)):
                    self.close_until(names, but)
                    if len(self.open) == before:
                        break
            else:
                self.close_until(names, but)
        if name in BLOCK:
            self.tokens.append(None)
        if name in VOID:
            if name in ("br", "wbr"):
                self.tokens.append(" " if name == "br" else "")
            return
        k = len(self.name)
        own = " ".join(f"{m[1].lower()}={m[2] or m[3] or m[4] or ''}" for m in _ATTRIBUTE.finditer(attributes)) if "=" in attributes else ""
        self.name.append(name)
        self.attributes.append(own)
        self.parent.append(self.open[-1])
        self.first.append(len(self.tokens))
        self.last.append(0)
        self.hash.append(0)
        self.open.append(k)
        self.parts.append([f"{name} {own}".encode("utf-8", "surrogatepass")])
        self.counts[name] = self.counts.get(name, 0) + 1

    def end(self, name: str) -> None:
        if name == "p" and not self.counts.get("p", 0) or name in ("br", "html", "body"):
            return  # what follows the end of the body still belongs to it
        self.close_until({name}, frozenset() if name in BLOCK else BLOCK)

    # --- what is the article ---

    def named(self, k: int) -> set[str]:
        said = self.attributes[k].replace("class=", " ").replace("id=", " ").replace("itemprop=", " ")
        if self.name[k] in ("article", "main"):  # one of class post has-sidebar is none: only what a name begins with counts
            return {m[0].lower() for word in said.split() if (m := _PART.match(word))}
        return {p.lower() for p in _PART.findall(said)} if said else set()

    def blocks(self, a: int, b: int, gone: list[tuple[int, int]]) -> list[tuple[int, str]]:
        """(first token, text) of the blocks among the tokens [a, b), ranges gone left out; these are in order."""
        out, held, start, skip = [], [], a, iter(gone)
        lo, hi = next(skip, (b, b))
        k = a
        while k < b:
            while hi <= k < b and (lo, hi) != (b, b):
                lo, hi = next(skip, (b, b))
            if lo <= k < hi:
                k = hi
                continue
            t = self.tokens[k]
            if t is None:
                if held and (text := " ".join("".join(held).split())):
                    out.append((start, text))
                held = []
            else:
                if not held:
                    start = k
                held.append(t)
            k += 1
        if held and (text := " ".join("".join(held).split())):
            out.append((start, text))
        return out

    def sizes(self, dropped: np.ndarray) -> np.ndarray:
        """Characters of text before each token, tokens where dropped is set not counted."""
        n = np.array([0 if t is None else len(t.strip()) for t in self.tokens], np.int64)
        n[dropped] = 0
        return np.append(0, np.cumsum(n))

    def article(self) -> tuple[int, bool, set[int]]:
        """(the article's element, whether its markup says so, elements that are dropped by name or by their own markup)."""
        unwanted, n = set(), len(self.name)
        for k in range(1, n):
            role = re.search(r"role=(\S+)", self.attributes[k]) if "role=" in self.attributes[k] else None
            if self.name[k] in DROPPED or (role and role[1].lower() in ROLES) or (self.attributes[k] and self.name[k] not in ("html", "body") and self.named(k) & NAMES):
                unwanted.add(k)
        inside = np.zeros(n, bool)
        for k in range(1, n):
            inside[k] = inside[self.parent[k]] or k in unwanted
        before = self.sizes(np.zeros(0, np.int64))
        size = lambda k: int(before[self.last[k]] - before[self.first[k]])
        for found in ("article", "main", "named"):
            # a form or a div that is named so may be wrapped around the whole page: then it still counts
            mine = [k for k in range(1, n) if self.is_article(k, found) and size(k)]
            mine = [k for k in mine if not inside[k]] or [k for k in mine if k not in unwanted and self.name[k] in ("article", "main") and not any(self.named(j) & NAMES or self.name[j] in ("aside", "nav", "footer") for j in self.above(k))]
            if mine:
                best = max(mine, key=lambda k: (size(k), -k))
                return best, True, unwanted - {best, *self.above(best)}
        titles = {j for k in range(1, n) if self.name[k] == "h1" for j in self.above(k)}
        unwanted |= {k for k in range(1, n) if self.name[k] == "header" or (self.attributes[k] and "header" in self.named(k))}
        return 0, False, {k for k in unwanted if k not in titles or self.name[k] in DROPPED - {"form"}}

    def is_article(self, k: int, how: str) -> bool:
        if how in ("article", "main"):
            return self.name[k] == how or (how == "main" and ("role=main" in self.attributes[k] or "itemprop=articleBody" in self.attributes[k]))
        return self.name[k] in ("div", "section", "td") and any(_CONTENT.match(x.lower()) for x in re.split(r"[\s=]+", self.attributes[k])[1:])

    def above(self, k: int):
        while (k := self.parent[k]) > 0:
            yield k

    def candidates(self) -> tuple[int, list[int]]:
        """(hash of the page's content, hashes of elements that may be template)."""
        root, marked, unwanted = self.article()
        holds = {root, *self.above(root)}
        hashes = {self.hash[k] for k in range(1, len(self.name)) if self.hash[k] and self.name[k] in BLOCK and k not in holds and self.name[k] not in ("html", "body") and not (marked and self.name[k] in LEAF)}
        longest = max((t for _, t in self.blocks(self.first[root], self.last[root], self.ranges(unwanted))), key=len, default="")
        return xxhash.xxh3_64_intdigest(longest.encode("utf-8", "surrogatepass")), list(hashes)

    def ranges(self, elements: set[int]) -> list[tuple[int, int]]:
        """The tokens of the elements, as ranges that don't overlap, in order."""
        out: list[tuple[int, int]] = []
        for k in sorted(elements):
            if not out or self.first[k] >= out[-1][1]:
                if self.last[k] > self.first[k]:
                    out.append((self.first[k], self.last[k]))
        return out

    def extract(self, template: set[int]) -> str:
        """The article's blocks, joined by newlines; template has hashes."""
        root, marked, unwanted = self.article()
        if self.name[root] == "#":
            root, pruned = self.densest(unwanted, template)
            unwanted = unwanted | pruned
        else:
            unwanted = unwanted | {k for k in range(root + 1, len(self.name)) if self.hash[k] in template and self.name[k] in BLOCK and self.name[k] not in LEAF}
        shown = self.blocks(self.first[root], self.last[root], self.ranges(unwanted))
        if not marked:
            own = {self.first[k]: self.hash[k] for k in range(1, len(self.name)) if self.name[k] in LEAF}
            fresh = [own.get(a) is None or own[a] not in template for a, _ in shown]
            if any(fresh):
                shown = shown[fresh.index(True) : len(fresh) - fresh[::-1].index(True)]
        return "\n".join(t for _, t in shown)

    def densest(self, unwanted: set[int], template: set[int]) -> tuple[int, set[int]]:
        """(the deepest element with MOST of the text that is neither dropped nor template, the elements that are template)."""
        pruned = {k for k in range(1, len(self.name)) if self.hash[k] in template and self.name[k] in BLOCK and self.name[k] not in LEAF and self.name[k] not in ("html", "body")}
        dropped = np.zeros(len(self.tokens), bool)
        leaves = {k for k in range(1, len(self.name)) if self.hash[k] in template and self.name[k] in LEAF}
        for a, b in self.ranges(unwanted | pruned | leaves):
            dropped[a:b] = True
        before = self.sizes(dropped)
        if not before[-1]:  # nothing but template: as well as without
            dropped[:] = False
            for a, b in self.ranges(unwanted):
                dropped[a:b] = True
            before, pruned = self.sizes(dropped), set()
        size = lambda k: int(before[self.last[k]] - before[self.first[k]])
        at, title = 0, [k for k in range(1, len(self.name)) if self.name[k] == "h1" and size(k)]
        children: dict[int, list[int]] = {}
        for k in range(1, len(self.name)):
            children.setdefault(self.parent[k], []).append(k)
        while True:
            down = [k for k in children.get(at, ()) if self.name[k] in BLOCK and self.name[k] not in LEAF and size(k) >= MOST * max(1, size(at))]
            if not down or any(self.first[at] <= self.first[h] < self.last[at] and not self.first[down[0]] <= self.first[h] < self.last[down[0]] for h in title):
                return at, pruned
            at = down[0]


def _host(url: str | None) -> str | None:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", url or "")
    return m[1].lower() if m else None


def _place(host: str, element: int) -> int:
    """An element of a host, as a signed number of 64 bits."""
    h = xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass") + element.to_bytes(8, "little"))
    return h - (1 << 64) if h >> 63 else h


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def elements(pages: DataFrame) -> DataFrame:
    """(host, place, content, page) of pages(page, url, html): each element of a page that may be template; place is null in one
    more row, which stands for the page."""

    def run(batches):
        for batch in batches:
            out = []
            for page, url, html in zip(batch.column("page").to_pylist(), batch.column("url").to_pylist(), texts(batch, "html"), strict=True):
                if (host := _host(url)) is not None and html:
                    content, found = Page(html).candidates()
                    where = _signed(xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass")))
                    out += [(where, None, _signed(content), page), *((where, _place(host, h), _signed(content), page) for h in found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["host", "place", "content", "page"])

    return pages.mapInArrow(trimmed(run), "host bigint, place bigint, content bigint, page bigint")


def templates(found: DataFrame) -> DataFrame:
    """(place): the elements that recur over MANY contents of their host, and SHARE of its contents."""
    contents = materialize(found.select("host", "place", "content").distinct().groupBy("host", "place").agg(F.count("*").alias("n")))
    total = contents.where("place is null").select("host", F.col("n").alias("total"))  # a row a host
    return contents.where(F.col("place").isNotNull() & (F.col("n") >= MANY)).join(total, "host").where(F.col("n") >= SHARE * F.col("total")).select("place")


def main_text(pages: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """pages(page_id, url, html) with text and n_chars; html and other columns of pages stay as they are."""
    spark, page = pages.sparkSession, F.xxhash64("url", "html")
    keyed = pages.select(page.alias("page"), "url", "html")
    found = elements(keyed)
    template = materialize(templates(found))
    names, key, own_places = [c for c in pages.columns if c not in ("text", "n_chars")], unused(pages, "key"), unused(pages, "own_places")
    few = template.count() <= broadcast
    if few:
        known, source = spark.sparkContext.broadcast(np.sort(template.toArrow()["place"].to_numpy())), pages.select(names)  # broadcast rows at most
    else:  # each page's own template elements, by its hash
        mine = found.join(template, "place").groupBy("page").agg(F.collect_set("place").alias(own_places)).withColumnRenamed("page", key)
        source = pages.withColumn(key, page).join(mine, key, "left").select(*names, own_places)

    def run(batches):
        for batch in batches:
            out = []
            listed = [None] * batch.num_rows if few else batch.column(own_places).to_pylist()
            for url, html, places in zip(batch.column("url").to_pylist(), texts(batch, "html"), listed, strict=True):
                if not html:
                    out.append("")
                    continue
                parsed, host = Page(html), _host(url)
                hashes = {h for h in parsed.hash if h}
                if host is None:
                    template = set()
                elif few:
                    where = {_place(host, h): h for h in hashes}
                    asked = np.array(list(where), np.int64)
                    at = np.minimum(np.searchsorted(known.value, asked), max(0, len(known.value) - 1))
                    template = {where[p] for p in asked[known.value[at] == asked].tolist()} if len(known.value) else set()
                else:
                    own = set(places or ())
                    template = {h for h in hashes if _place(host, h) in own}
                out.append(parsed.extract(template))
            text = pa.array([t.encode("utf-8", "replace").decode() for t in out], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), text, pc.utf8_length(text).cast(pa.int64())], [*names, "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(names).schema)
    return source.mapInArrow(trimmed(run), f"{fields}, text string, n_chars bigint")
