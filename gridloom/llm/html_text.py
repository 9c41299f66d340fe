"""Main text of web pages by removal of site templates.

Every page is parsed once into blocks of text. Each block carries the hashes of the element subtrees that
hold it, and Spark counts in how many different pages of a host a subtree recurs. Subtrees that recur
across many of them are the site's template and are deleted, wherever they stand. Elements whose tag, role
or class says that they are menus, headers, footers, sidebars, notices, adverts, forms or reader comments
are left out even where a site has too few pages to tell.

A page's copies would make its own paragraphs recur. So pages are counted by what is their own: of a page's blocks those
are left out that recur on as many different pages of the host as a template does, and pages that have the rest in
common count as one, however long or short the template is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, small_or_shuffled, table

#: A subtree is template if it recurs in at least this many different pages of its host ...
LEAST_PAGES = 5
#: ... and in this share of them; inside an article the share is larger.
SHARE, SHARE_IN_ARTICLE = 0.1, 0.3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Left out whole, and left out unless they hold the article.
NEVER = frozenset("script style noscript template head title iframe object embed applet svg math canvas audio video map select option datalist button textarea input dialog noembed noframes xmp plaintext nav footer aside menu".split())
FORMS = frozenset(["form", "fieldset"])
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
#: Which open elements a start tag ends, and where the search for them stops.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "thead": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: Words of a class, id or role that name what is not the article.
BOILERPLATE = frozenset(
    "nav navbar navigation menu menus menubar breadcrumb breadcrumbs masthead footer sidebar sidebars aside complementary contentinfo"
    " ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion banner"
    " cookie cookies consent gdpr notice notices notification notifications alert disclaimer popup modal overlay dialog"
    " newsletter subscribe subscription signup login paywall share sharing sharebar social related recommended recommendations"
    " comment comments commentlist disqus respond reply replies discussion widget widgets pagination pager toolbar skip search form"
    " hidden offscreen".split()
)
#: Inside an article a word alone is not enough: whole class tokens and roles of widgets leave an element out there.
WIDGETS = frozenset(
    "ad ads advert adverts advertisement advertisements adsbygoogle sponsored promo share-bar share-buttons share-links social-share social-links sharedaddy"
    " newsletter newsletter-signup related-posts related-articles recommended-posts comments comment comment-list commentlist breadcrumb breadcrumbs pagination"
    " sidebar navbar cookie-notice cookie-banner paywall popup modal".split()
)
WIDGET_ROLES = frozenset("navigation complementary contentinfo banner search dialog alertdialog alert menu menubar".split())
#: Ids of an article's reader comments, if the element holds articles of its own.
COMMENT_IDS = frozenset("comments comment-list commentlist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that mean so only outside an article.
BOILERPLATE_OUTSIDE = frozenset("header topbar top bottom tags".split())
_ARTICLE = frozenset("article articlebody".split())
_MARKUP = re.compile(
    r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|/[^a-zA-Z>][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']|(?<=[=\s])\"[^\"]*\"|(?<=[=\s])'[^']*'|[\"'])*))>)", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


class Element:
    __slots__ = ("tag", "parent", "parts", "flag", "chars", "hash", "root", "holds_heading")

    def __init__(self, tag: str, parent: Element | None, flag: int):
        #: flag: 0 text, 1 boilerplate by class or form, 2 never text; until measured -1 and -4 boilerplate outside an
        #: article only, -3 also where it holds articles. root: 1 article, 2 main.
        self.tag, self.parent, self.flag = tag, parent, flag
        self.parts: list = []
        self.chars, self.hash, self.root, self.holds_heading = 0, 0, 0, False


def _flag(tag: str, attributes: str) -> tuple[int, int]:
    root = 1 if tag == "article" else 2 if tag == "main" else 0
    if tag in NEVER:
        return 2, 0
    flag = 1 if tag in FORMS else 0
    if "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                words = {w.lower() for w in _WORD.findall(value)}
                if name == "role" and "main" in words:
                    root = root or 2
                if tag not in ("html", "body", "main"):
                    if words & BOILERPLATE:
                        known = value.lower()
                        if tag in HEADINGS:
                            own = 0 if name == "id" else -4
                        elif name == "id":
                            own = -3 if known.strip() in COMMENT_IDS else -4
                        else:
                            own = 1 if known.strip() in WIDGET_ROLES and name == "role" or name == "class" and not WIDGETS.isdisjoint(known.split()) else -4
                        flag = 1 if flag == 1 or own == 1 else min(flag, own) if -3 not in (flag, own) else -3
                    elif flag < -1:
                        continue
                    elif words & BOILERPLATE_OUTSIDE:
                        flag = max(flag, -1) if flag else -1
            elif name == "itemprop" and value.lower() in _ARTICLE:
                root = root or 1
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _INVISIBLE.search(value.lower()):
                return 2, 0
    return flag, root


def parse(page: str) -> Element:
    """The tree of a page. Parts of an element are texts and elements; unclosed and stray tags are mended."""
    top = Element("", None, 0)
    now, at, size = top, 0, len(page)
    find = _MARKUP.search
    while at < size:
        m = find(page, at)
        if m is None:
            now.parts.append(page[at:])
            break
        if m.start() > at:
            now.parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                now.parts.append(" ")
                continue
            x, inline = now, tag in INLINE
            while x is not top and x.tag != tag and not (inline and x.tag not in INLINE):
                x = x.parent
            if x is not top and x.tag == tag:
                now = x.parent
            continue
        if tag == "br":
            now.parts.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                now.parts.append(Element(tag, now, 2))
            continue
        if tag in ENDS_P:
            x = now
            while x is not top and (x.tag in INLINE or x.tag == "p"):
                if x.tag == "p":
                    now = x.parent
                    break
                x = x.parent
        if tag in ENDS:
            ended, stop = ENDS[tag]
            x = now
            while x is not top and x.tag not in stop:
                if x.tag in ended:
                    now = x.parent
                x = x.parent
        attributes = m[3]
        flag, root = _flag(tag, attributes)
        e = Element(tag, now, flag)
        e.root = root
        now.parts.append(e)
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else size
        elif not attributes.rstrip().endswith("/") or tag not in ("svg", "path", "circle", "rect", "use"):
            now = e
    return top


def _measure(e: Element, in_article: bool) -> None:
    """Subtree hashes and characters, without recursion (pages may nest deeply)."""
    stack = [(e, in_article, False)]
    while stack:
        x, inside, done = stack.pop()
        if not done:
            if x.flag == -3:
                x.flag = 0 if inside and not any(y.root == 1 for y in _walk(x)) else 1
            elif x.flag == -4:  # an article that is labelled so is a reader's or a teaser
                x.flag = 0 if inside and x.root != 1 else 1
            inside = inside or x.root > 0 and x.flag <= 0
            if x.flag == -1:
                x.flag = 0 if inside else 1
            if x.tag == "header" and not x.flag:
                x.flag = -2 if inside else 1
            stack.append((x, inside, True))
            if x.flag != 2:
                stack += [(p, inside, False) for p in x.parts if type(p) is Element]
            continue
        digest = [x.tag]
        for p in x.parts:
            if type(p) is Element:
                if p.flag != 2:
                    digest.append(f"{p.hash:x}")
                    x.chars += p.chars
                    x.holds_heading |= p.holds_heading
            elif not p.isspace():
                digest.append(" ".join(p.split()))
                x.chars += len(p)
        x.holds_heading |= x.tag in ("h1", "h2")
        if x.flag == -2:  # the header of an article stays if it has its heading
            x.flag = 0 if x.holds_heading else 1
        x.hash = xxhash.xxh3_64_intdigest("\x1f".join(digest).encode("utf-8", "surrogatepass")) if x.chars else 0


def _walk(e: Element):
    stack = [e]
    while stack:
        x = stack.pop()
        yield x
        stack += [p for p in reversed(x.parts) if type(p) is Element and p.flag != 2]


def _roots(top: Element) -> list[Element]:
    """The elements whose text is the page's: its articles, else its main element, else all of it."""
    found: dict[int, list[Element]] = {1: [], 2: []}
    for x in _walk(top):
        if x.root and not x.flag and x.chars:
            found[x.root].append(x)
    free = {1: [], 2: []}
    for kind, xs in found.items():
        for x in xs:
            up, flagged = x.parent, False
            while up is not None:
                flagged |= up.flag == 1 and up.tag not in FORMS
                up = up.parent
            if not flagged:
                free[kind].append(x)
    chosen = free[1] or free[2]
    if not chosen:
        # a boilerplate word on a wrapper of the only article is no reason to lose it
        chosen = sorted(found[1] or found[2], key=lambda x: -x.chars)[:1]
    if not chosen:
        return [top]
    inner = set(map(id, chosen))
    out = []
    for x in chosen:
        up = x.parent
        while up is not None and id(up) not in inner:
            up = up.parent
        if up is None:
            out.append(x)
    if free[1] and free[2]:  # the heading may stand beside the article
        within = set(map(id, out))
        for main in free[2]:
            stack = [p for p in main.parts if type(p) is Element]
            while stack:
                p = stack.pop()
                if id(p) in within or p.flag:
                    continue
                if p.tag == "h1" and p.chars:
                    out.append(p)
                else:
                    stack += [q for q in p.parts if type(q) is Element]
    order = {id(x): k for k, x in enumerate(_walk(top))}
    return sorted(out, key=lambda x: order[id(x)])


def _text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def blocks(page: str) -> tuple[list[str], list[list[int]]]:
    """A page's blocks of text in order, and the hashes of the subtrees that hold each.

    A hash's lowest bit tells whether the subtree stands inside an article.
    """
    top = parse(page)
    _measure(top, False)
    texts: list[str] = []
    marks: list[list[int]] = []
    pending: list[str] = []
    pending_marks: list[int] = []

    def flush() -> None:
        if pending:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text:
                texts.append(text)
                marks.append(list(pending_marks))

    for root in _roots(top):
        inside = int(root.root > 0)
        stack: list = [(root, [])]
        while stack:
            x, above = stack.pop()
            if x is None:
                flush()
            elif type(x) is str:
                if not pending:
                    pending_marks = above
                pending.append(html.unescape(x) if "&" in x else x)
            elif x.flag == 0:
                if x.tag in INLINE:
                    stack += [(p, above) for p in reversed(x.parts)]
                else:
                    flush()
                    own = above
                    if x is not root and x.chars and x.tag not in ("html", "body") and not x.root:
                        signed = (x.hash >> 1 << 1 | inside) - (1 << 63)
                        own = [*above, signed]
                    stack.append((None, own))
                    stack += [(p, own) for p in reversed(x.parts)]
        flush()
    return texts, marks


_PARSED = "page_id long, url string, host string, whole long, hashes array<long>, texts array<string>, marks array<array<long>>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())))
    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            part, out = batch.slice(a, 200), []
            for page_id, url, page in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                texts, marks = blocks(page)
                m = _HOST.match(url)
                texts = [t.encode("utf-8", "replace").decode() for t in texts]
                hashes = list(dict.fromkeys(map(_text_hash, texts)))
                out.append((page_id, url, m[1].lower() if m else "", _text_hash("\x1f".join(texts)), hashes, texts, marks))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [c.split()[0] for c in _PARSED.split(", ")])


def _recurring(seen: DataFrame, of: DataFrame, what: str, share, least_pages: int) -> DataFrame:
    """``host`` and the array ``found`` of the values of ``what`` that recur in enough of the host's pages, as a table.

    ``seen`` has a row for each page and value, ``of`` the pages of each host. A page has few values and those found are on
    a share of the pages, so a host has a bounded number of them.
    """
    counted = seen.groupBy("host", what).agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)
    enough = counted.join(of, "host").filter(F.col("pages") >= share * F.col("of"))
    return materialise(enough.groupBy("host").agg(F.collect_set(what).alias("found")), what)


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE, share_in_article: float = SHARE_IN_ARTICLE) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row: the article, with blocks joined by one space.

    A null or empty page has an empty text. Pages without a url, or with one that names no host, count as
    one host; their url stays as it is. Repeated rows each keep their row and count as one page, as do pages that differ in
    template only. A subtree that recurs in exactly the share of the pages is template. Extremely long and deeply nested
    pages are parsed whole, without recursion. An empty table gives no rows. Other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    parsed = rows.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.col("url").isNull().alias("no_url"), "html")
    parsed = materialise(
        parsed.select("page_id", F.when(F.col("no_url"), F.lit("\x00")).otherwise(F.col("url")).alias("url"), "html").mapInArrow(_parsed, _PARSED), "pages"
    )
    none = F.array().cast("array<long>")
    # equal pages once; then what is a page's own
    different = parsed.select("host", "whole", "hashes").dropDuplicates(["host", "whole"])
    sizes = parsed.select("host", "whole").distinct().groupBy("host").agg(F.count("*").alias("of"))
    common = _recurring(different.select("host", F.explode("hashes").alias("block")), sizes, "block", F.lit(share), least_pages)
    own = F.array_except("hashes", F.coalesce("found", none))
    signed = parsed.select("host", "whole", "hashes", "marks").join(small_or_shuffled(common), "host", "left")
    signed = signed.select("host", F.when(F.size(own) > 0, F.xxhash64(F.array_sort(own))).otherwise(F.col("whole")).alias("signature"), "marks")
    # (host, page, subtree) once for all pages that count as one
    seen = signed.select("host", "signature", F.explode(F.array_distinct(F.flatten("marks"))).alias("mark")).distinct()
    sizes = signed.select("host", "signature").distinct().groupBy("host").agg(F.count("*").alias("of"))
    templates = _recurring(seen, sizes, "mark", F.when(F.col("mark") % 2 == 0, F.lit(share)).otherwise(F.lit(share_in_article)), least_pages)
    joined = parsed.join(small_or_shuffled(templates), "host", "left").withColumn("template", F.coalesce("found", none))
    kept = F.filter(F.arrays_zip("texts", "marks"), lambda b: ~F.arrays_overlap(b["marks"], F.col("template")))
    text = F.array_join(F.transform(kept, lambda b: b["texts"]), " ")
    out = joined.select("page_id", F.when(F.col("url") != "\x00", F.col("url")).alias("url"), text.alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`extract` of all pages; its docstring states the odd cases."""
    return extract(table(spark, sf_dir, "pages"))
