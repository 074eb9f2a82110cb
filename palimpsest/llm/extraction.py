"""Main text of HTML pages: page structure, and removal of the subtrees that a host repeats."""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, join_small, materialize, scratched, text_slices, texts_of

#: A subtree goes if this many different pages of the host have it, and one in ONE_IN of them. Copies of a page count once.
LEAST_PAGES, ONE_IN = 5, 10

TOKEN = re.compile(r"<!--|<!\[CDATA\[|<(/?)([A-Za-z][A-Za-z0-9:-]*)|<[!?]")
#: An attribute list up to its end: quoted values may hold '>'.
ATTRIBUTES = re.compile(r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
NAMES = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that never hold main text: menus, footers, sidebars, forms and their controls, and what isn't shown.
DROPPED = {"nav", "footer", "aside", "form", "noscript", "template", "menu", "dialog", "button", "select", "datalist", "head", *RAW}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Subtrees that are hashed and counted: containers, and outside main content all blocks.
CONTAINERS = {"div", "section", "aside", "nav", "header", "footer", "ul", "ol", "dl", "table", "form", "figure", "menu", "details"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "td", "th", "blockquote", "aside", "nav", "header", "footer", "form", "figure", "details"}
#: What an element is, by the last word of a class or id, as in cookie-notice or site_footer ...
HEADS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "adsense", "sponsor", "sponsored", "sponsors", "promo", "promotion", "promotions", "banner", "banners", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "sidebar", "sidebars", "comment", "comments", "disqus", "reply", "replies", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "footer", "masthead", "pagination", "pager", "popup", "popups", "modal", "toolbar",
    "newsletter", "subscribe", "signup",
}
#: ... but for these words, which say no more than that it holds something, as in comment-list or ad-slot-2.
HOLDERS = {"area", "bar", "block", "bottom", "box", "container", "form", "icons", "inner", "item", "items", "left", "link", "links", "list", "outer", "panel", "right", "section", "slot", "thread", "top", "unit", "wrap", "wrapper"}
#: Names that mark an element only as a whole.
NAMES_AS_A_WHOLE = {
    "site-header", "page-header", "top-header", "global-header", "main-header", "share-buttons", "sharing-buttons", "social-buttons", "share-links", "social-links", "related-posts", "related-articles", "related-links", "search-form", "search-box", "side-bar",
}
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "menu", "menubar", "toolbar", "dialog", "alert", "alertdialog"}
WHOLE_IDS = NAMES_AS_A_WHOLE | {"comments", "comment-list", "comment-section", "comment-form", "comments-area", "comments-list", "comments-section", "disqus-thread", "disqus_thread", "sidebar", "cookie-notice", "cookie-banner", "cookie-consent", "navbar", "breadcrumbs", "pagination", "toolbar", "ad-slot", "ad-container", "ad-banner", "newsletter-signup"}
COMMENTS = {"comment", "comments", "disqus", "reply", "replies"}
WORD_EDGE = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")


@functools.lru_cache(maxsize=1 << 14)
def what(name: str) -> str:
    """What a class or id says that its element is: its name as a whole, its last word that says something, or nothing."""
    words = [w for w in WORD_EDGE.split(name) if w]
    whole = "-".join(words).lower()
    if whole in NAMES_AS_A_WHOLE:
        return whole
    words = [w for w in (w.rstrip("0123456789") for w in whole.split("-")) if w]
    while len(words) > 1 and words[-1] in HOLDERS:
        words.pop()
    return words[-1] if words and words[-1] in HEADS else ""


HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN_ROLES = {"main", "article"}


class Page:
    """One page taken apart: blocks (text, whether it is in main content), and hashes of subtrees with the blocks that they hold."""

    def __init__(self, source: str):
        self.source = source
        self.blocks: list[tuple[str, bool]] = []
        self.spans: list[tuple[int, int, int]] = []  # first and last block of a hashed subtree, its key
        self.subtrees: set[int] = set()
        self.stack: list[list] = []  # tag, dropped, main, first block, what it holds (text and digests of elements)
        self.places: dict[str, list[int]] = {}  # of the open elements of each tag
        self.words: list[str] = []
        self.has_main = False
        self._read()

    def _flush(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            self.words = []
            if text:
                self.blocks.append((text, bool(self.stack and self.stack[-1][2])))

    def _add(self, text: str) -> None:
        text = html.unescape(text)  # a reference ends where a tag or comment begins
        if not (self.stack and self.stack[-1][1]):
            self.words.append(text)
        if self.stack and not text.isspace():
            self.stack[-1][4].append(" ".join(text.split()))

    def _pop(self) -> None:
        """Closes the innermost element."""
        tag, _, main, first, held = self.stack[-1]
        if tag in BLOCKS:
            self._flush()
        self.stack.pop()
        self.places[tag].pop()
        digest = xxhash.xxh3_64_intdigest("\0".join(held))
        if self.stack:
            self.stack[-1][4].append(f"{digest:x}")
        outer_main = bool(self.stack and self.stack[-1][2])
        if tag in (CONTAINERS if main else BLOCKS) and tag not in ("html", "body") and (outer_main or not main):
            key = digest - (1 << 63)
            self.subtrees.add(key)
            self.spans.append((first, len(self.blocks), key))

    def _innermost(self, tags: set[str]) -> int:
        """Place of the innermost open element among `tags`; -1 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _close(self, tags: set[str], until: set[str]) -> None:
        """Closes up to the innermost element among `tags`, if there is one above any of `until`."""
        at = self._innermost(tags)
        if at >= 0 and at >= self._innermost(until):
            while len(self.stack) > at:
                self._pop()

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._close({"p"}, SCOPES)
            self._flush()
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES - {"td", "th"} if tag == "tr" else SCOPES)
        dropped, main = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (False, False)
        names = {k.lower(): v.strip("\"'") for k, v in NAMES.findall(attributes)}
        role, ids = names.get("role", "").lower(), names.get("id", "").split()
        is_main = tag in ("article", "main") or role in MAIN_ROLES or names.get("itemprop", "").lower() == "articlebody"
        said = {what(n) for n in names.get("class", "").split()} - {""}
        if tag not in HEADINGS:  # an id of a heading is the slug of its title, and so may one inside main content be: there it counts as a whole only
            said |= {n.lower() for n in ids if n.lower() in WHOLE_IDS} if main else {what(n) for n in ids} - {""}
        marked = tag not in ("html", "body", "main") and not (is_main and tag != "article")
        marked = marked and bool(said & COMMENTS if tag == "article" and not main else said or role in ROLES)
        unseen = not main and ("hidden" in names or names.get("aria-hidden", "").lower() == "true")
        gone = tag in DROPPED or tag == "header" and not main or marked or unseen
        main = not dropped and not gone and (main or is_main)
        self.has_main |= main
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append([tag, dropped or gone, main, len(self.blocks), [f"{tag} {' '.join(attributes.split())}"]])

    def _read(self) -> None:
        s, at, n = self.source, 0, len(self.source)
        while at < n:
            m = TOKEN.search(s, at)
            if not m:
                break
            if m.start() > at:
                self._add(s[at : m.start()])
            if m[0] == "<!--":
                end = s.find("-->", m.end())
                at = n if end < 0 else end + 3
            elif m[0] == "<![CDATA[":
                end = s.find("]]>", m.end())
                at = n if end < 0 else end + 3
            elif m[0] in ("<!", "<?"):
                end = s.find(">", m.end())
                at = n if end < 0 else end + 1
            else:
                rest = ATTRIBUTES.match(s, m.end())
                end = rest.end() if rest else (s.find(">", m.end()) + 1 or n)
                tag, at = m[2].lower(), end
                if m[1]:
                    if tag == "br":
                        self.words.append(" ")
                    elif tag == "p" and not self.places.get("p"):
                        self._flush()
                    else:
                        self._close({tag}, {"td", "th"} - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else set())
                elif tag in VOID:
                    if tag == "hr":
                        self._close({"p"}, SCOPES)
                        self._flush()
                    elif tag == "br":
                        self.words.append(" ")
                elif tag in RAW:
                    stop = re.compile(rf"</{re.escape(tag)}(?=[\s>/])", re.I).search(s, end)
                    if not stop:
                        at = n
                    else:
                        close = s.find(">", stop.end())
                        at = n if close < 0 else close + 1
                elif not s[m.end() : end].endswith("/>") or tag in BLOCKS:
                    self._open(tag, s[m.end() : end - 1])
        if at < n:
            self._add(s[at:])
        self._flush()
        while self.stack:
            self._pop()

    def main(self) -> tuple[list[str], list[tuple[int, int, int]]]:
        """The blocks of the main content, and (first, stop, key) of the subtrees that hold some of them; where no element is marked as main,
        all blocks that aren't dropped."""
        wanted = [inside or not self.has_main for _, inside in self.blocks]
        place = [0]
        for w in wanted:
            place.append(place[-1] + w)
        spans = [(place[a], place[b], key) for a, b, key in self.spans if place[a] < place[b]]
        return [text for (text, _), w in zip(self.blocks, wanted, strict=True) if w], spans


def take_apart(df: DataFrame, id: str = "page_id", url: str = "url", page: str = "html", texts: bool = True) -> DataFrame:
    """Per row: id, url, host, page_key long (hash of url and html), main_hash long, spans array<struct<first, stop, key>>, subtrees array<long>;
    blocks array<string> if `texts`, else null."""
    kind = df.schema[id].dataType.simpleString()
    span_type = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("key", pa.int64())]))
    signed = lambda t: xxhash.xxh3_64_intdigest(t) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            sources, urls = texts_of(batch, "html"), texts_of(batch, "url")
            pages = [Page(t) for t in sources]
            mains = [p.main() for p in pages]
            keys = [signed(f"{u}\0{t}") for u, t in zip(urls, sources, strict=True)]
            hashes = [signed("\n\n".join(m)) for m, _ in mains]
            spans = [[{"first": a, "stop": b, "key": k} for a, b, k in s] for _, s in mains]
            blocks = pa.array([m if texts else None for m, _ in mains], pa.list_(pa.string()))
            columns = [batch.column("id"), batch.column("url"), pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()), blocks, pa.array(spans, span_type), pa.array([sorted(p.subtrees) for p in pages], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "url", "page_key", "main_hash", "blocks", "spans", "subtrees"])

    rows = df.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html"))
    out = rows.mapInArrow(run, f"id {kind}, url string, page_key long, main_hash long, blocks array<string>, spans array<struct<first:int,stop:int,key:bigint>>, subtrees array<bigint>")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return out.withColumn("host", host)


def templates(parts: DataFrame, least: int = LEAST_PAGES, one_in: int = ONE_IN) -> DataFrame:
    """(host, key) of the subtrees that recur: on `least` different pages of the host at least, and on one in `one_in` of them.

    Pages whose main text is equal count once, so that a copied article isn't taken for a template. Counts are made by
    partial aggregation, so a host may hold any share of the pages.
    """
    pages = parts.select("host", "main_hash").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    seen = parts.select("host", "main_hash", F.explode("subtrees").alias("key")).distinct().groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    met = join_small(seen, pages, ["host"], ["key"])
    return met.where(F.col("n") * one_in >= F.col("pages")).select("host", "key")


@scratched
def extract(df: DataFrame, id: str = "page_id", url: str = "url", page: str = "html", least: int = LEAST_PAGES, one_in: int = ONE_IN) -> DataFrame:
    """One row per row of df: id, url, text string (empty if none), n_chars long (code points), host string, removed long.

    Main content is what article or main elements hold; on a page without one, all of its body. Menus, headers, footers, sidebars, notices, adverts,
    forms, scripts, styles and comments never belong to it, by their tag, role, or what their class or id says (what()): `cookie-notice` is a notice,
    `search-results` and `related-work` are nothing of the kind. Ids of headings don't count, and inside an article or main element
    only ids that are such a name as a whole. Character references are decoded where they stand, none reaches across a tag. Of the rest, blocks inside
    a subtree of containers that recurs on the host go too (`removed` counts them). Paragraphs and headings of an article are no
    such subtrees: an article keeps passages that other pages share. White space inside a block becomes one blank; blocks are
    joined by an empty line. Null or empty html, or html without text: empty text. A null or odd url: host ''. Repeated rows
    give repeated rows. Empty table: no rows. Pages are taken apart twice, first for their layout alone, so no text is stored on
    the way; pages that lose a block are broadcast if they are few by count, else joined by a shuffle.
    """
    layout = take_apart(df, id, url, page, texts=False).select("page_key", "host", "main_hash", "spans", "subtrees")
    layout = materialize(layout, "layout")
    found = materialize(templates(layout, least, one_in), "templates")
    alike = layout.groupBy("page_key").agg(F.first("host").alias("host"), F.first("spans").alias("spans"))  # equal pages once
    inside = alike.select("page_key", "host", F.explode(F.array_distinct(F.transform("spans", lambda s: s["key"]))).alias("key"))
    gone = join_small(inside, found.withColumn("hit", F.lit(1)), ["host", "key"], ["page_key"]).where("hit = 1")
    gone = materialize(gone.groupBy("page_key").agg(F.collect_set("key").alias("gone")), "gone")
    met = take_apart(df, id, url, page).join(few(gone), "page_key", "left")
    cut = F.filter("spans", lambda s: F.array_contains("gone", s["key"]))
    left = F.filter("blocks", lambda _, i: ~F.exists("cut", lambda s: (s["first"] <= i) & (i < s["stop"])))
    met = met.withColumn("cut", cut).withColumn("stay", F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(left)).withColumn("text", F.array_join("stay", "\n\n"))
    return met.select(F.col("id").alias(id), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"), "host", (F.size("blocks") - F.size("stay")).cast("long").alias("removed"))
