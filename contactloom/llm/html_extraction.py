"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from templates: markup and phrases that pages have in common, around
slots that each page fills. A token is an element at its path or a block of text at its path;
it has an occurrence vector over the host's pages. Tokens with equal vectors form a class. A
class is valid if it holds elements, its tokens occur once in each of its pages, and enough of
the host's pages have it; so hosts with several layouts, or with an odd page among the others, have a class
for each. The elements of valid classes nest by their paths into the template. Text in a valid class is the
template's own. What remains of a page are its slots, elements of the template with text of the page's own
below them:

* a slot of links, outside the one that holds most of the text, is a menu;
* where a slot is the page's ``main`` or ``article`` and holds at least half of the text, what lies outside
  (but for a headline) is none of it;
* the names of elements decide about the rest: menus, headers, footers, sidebars, notices, adverts, forms
  and comments go. Names that articles bear as well count only for slots with less than half of the text.

Hosts with fewer than ``LEAST_PAGES`` different pages use the template of all hosts' pages, but for its text.

Vectors are never built: each token's vector is represented by two sums over the pages of
page number times occurrences in a prime field, which combine on the map side. Pages are
parsed once; what was found is stored for the second look. So a host with a third of all pages costs one row per
token and task. A template is one small row for each host; templates are broadcast when their number is below
``BROADCAST_HOSTS``, else joined on the host with its pages spread over ``SALTS`` keys. Paths are numbers made
of the path above and the element, and the scanner never goes back, so time and memory grow with the page.

Defined results: null or empty html gives an empty text; a url without a host belongs to
the common template; repeated pages each get a row and are one page of the template's
evidence; unclosed and stray tags are closed or ignored, as is a raw element that is never closed (but a script
or style, which then takes the rest); text outside any element counts as
the body's; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import filled_id, python_ready, restored_id, stored

#: A tag to its end, quoted values whole; failing that, to the next sign that ends one.
TAG = re.compile(r"""<[a-zA-Z/!?](?:[^>"']|"[^"]*"|'[^']*')*+>|<[a-zA-Z/!?][^>]*+>""")
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
RAW_END = {name: re.compile(rf"</{name}(?![a-z0-9:-])", re.I) for name in RAW}
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag closes an open element of these, up to the nearest of the barriers.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)),
}
BARRIERS = ("table", "td", "th", "article", "section", "div", "body", "blockquote", "li", "ul", "ol", "main", "aside", "nav", "form")
#: Elements and names that are never main text, and those that may be where they hold most of it.
NEVER = frozenset("nav footer script style noscript template iframe svg math button select textarea title head menu".split())
RARELY = frozenset("header aside form dialog object".split())
NEVER_NAME = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|breadcrumbs?|footer|side-?bar|cookies?|consent|newsletter|subscri\w*|signup|login|comments?|commentlist|respond|replies|disqus\w*)(?:$|[-_ ])", re.I
)
RARELY_NAME = re.compile(r"(?:^|[-_ ])(?:banner|promo\w*|nav\w*|menu\w*|header|masthead|aside|widgets?|notice|alert|popup|modal|share|sharing|social\w*|related|recommend\w*)(?:$|[-_ ])", re.I)

#: What is known of an element by itself.
IS_NEVER, IS_RARELY, IS_MAIN, IS_ARTICLE, IS_HEADLINE = 1, 2, 4, 8, 16

PRIME = (1 << 31) - 1
#: Different pages that a host, and a class, needs for a template.
LEAST_PAGES = 4
#: Parts of a host's pages that an element's class, and one with text, has to have.
ELEMENT_SUPPORT, TEXT_SUPPORT = 0.1, 0.25
#: Part of its pages' text that a slot holds to be the one with most of it.
MOST = 0.6
BROADCAST_HOSTS = 100_000
SALTS = 32
COMMON = ""


def kind_of(name: str, label: str, in_article: bool) -> int:
    if name == "main" or (name == "div" and re.search(r"\bmain\b", label) and "role=main" in label):
        return IS_MAIN
    if name == "article":
        return IS_ARTICLE
    if name in ("html", "body"):
        return 0
    plain = re.sub(r"\b(?:class|id|role)=", "", label)
    if name in NEVER or plain and NEVER_NAME.search(plain):
        return IS_NEVER
    if name in RARELY and not (name == "header" and in_article) or plain and RARELY_NAME.search(plain):
        return IS_RARELY
    return IS_HEADLINE if name == "h1" else 0


@dataclass
class Page:
    """Element paths in order of their first appearance (a path stands behind the one above it), and blocks of text."""

    paths: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    #: Text, the number of its path, the characters of it that are links, and the links that begin in it.
    texts: list[str] = field(default_factory=list)
    places: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)


def parse_page(page: str) -> Page:
    out, number = Page(), {}
    # open elements: name, number of the path, that of the nearest element with blocks of its own, whether in an article, whether in a link
    stack: list[tuple[str, int, int, bool, bool]] = [("", -1, -1, False, False)]
    open_at: dict[str, list[int]] = defaultdict(list)
    pieces: list[str] = []
    linked = links = 0

    def end_block() -> None:
        nonlocal linked, links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.texts.append(text)
                out.places.append(stack[-1][2])
                out.linked.append(min(linked, len(text)))
                out.links.append(links)
        linked = links = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            if stack[-1][1] == stack[-1][2]:
                end_block()
            open_at[stack.pop()[0]].pop()

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            pieces.append(piece)
            if stack[-1][4]:
                linked += len(piece.strip())

    latest = lambda names: max((open_at[x][-1] for x in names if open_at.get(x)), default=0)
    at, last = 0, page.rfind(">")
    while True:
        start = page.find("<", at)
        if start < 0 or start > last:
            text(page[at:])
            break
        text(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            continue
        m = TAG.match(page, start)
        if not m:
            text("<")
            at = start + 1
            continue
        token, at = m.group(), m.end()
        n = NAME.match(token)
        if not n:
            continue
        name = n.group(1).lower()
        if token[1] == "/":
            if open_at.get(name):
                close(open_at[name][-1])
            elif name in BLOCK:
                end_block()
            continue
        if name in BLOCK and name != "br":
            end_block()
            # an open paragraph ends where a block begins
            if open_at.get("p") and open_at["p"][-1] > latest(BARRIERS):
                close(open_at["p"][-1])
            if name in CLOSES:
                ends, stops = CLOSES[name]
                stop = latest(stops)
                inner = [own[k] for x in ends if (own := open_at.get(x)) and (k := bisect_right(own, stop)) < len(own)]
                if inner:
                    close(min(inner))
        elif name == "br":
            text(" ")
        label = " ".join(sorted(f"{k.lower()}={a or b or c}" for k, a, b, c in ATTRIBUTE.findall(token))) if len(token) > len(name) + 2 else ""
        _, up, block, in_article, in_link = stack[-1]
        path = xxhash.xxh64_intdigest(f"{name}[{label}]", out.paths[up] & (1 << 64) - 1 if up >= 0 else 0)
        path -= path >> 63 << 64
        k = number.setdefault(path, len(out.paths))
        if k == len(out.paths):
            out.paths.append(path)
            out.above.append(up)
            out.kinds.append(kind_of(name, label, in_article))
            out.times.append(0)
        out.times[k] += 1
        if name in VOID or token.endswith("/>") and name in ("svg", "math"):
            continue
        if name in RAW:
            # its content is no markup: nothing in it ends it but its own closing tag
            ending = RAW_END[name].search(page, at)
            if ending or name in ("script", "style"):
                at = ending.start() if ending else len(page)
            continue
        if out.kinds[k] & (IS_NEVER | IS_RARELY):
            end_block()
            block = k
        links += name == "a"
        open_at[name].append(len(stack))
        stack.append((name, k, k if name in BLOCK else block, in_article or name in ("article", "main"), in_link or name == "a"))
    close(1)
    end_block()
    return out


def inherited(page: Page, own: list[bool]) -> list[bool]:
    """Whether a path or one above it has the property."""
    out: list[bool] = []
    for k, up in enumerate(page.above):
        out.append(own[k] or (up >= 0 and out[up]))
    return out


def sums_below(page: Page, used: list[bool]) -> tuple[list[int], list[int], list[int]]:
    """Characters of text, of them in links, and links, of the used blocks at or below each path."""
    chars, linked, links = ([0] * len(page.paths) for _ in range(3))
    for use, text, at, n, k in zip(used, page.texts, page.places, page.linked, page.links, strict=True):
        if use and at >= 0:
            chars[at] += len(text)
            linked[at] += n
            links[at] += k
    for k in range(len(page.paths) - 1, -1, -1):
        if (up := page.above[k]) >= 0:
            chars[up] += chars[k]
            linked[up] += linked[k]
            links[up] += links[k]
    return chars, linked, links


def text_token(path: int, text: str) -> int:
    h = xxhash.xxh64_intdigest(text, path & (1 << 64) - 1)
    return h - (h >> 63 << 64)


FIELDS = {"paths": "array<long>", "above": "array<int>", "kinds": "array<int>", "times": "array<int>", "texts": "array<string>", "places": "array<int>", "linked": "array<int>", "links": "array<int>"}


def parsed(pages: DataFrame) -> DataFrame:
    """One row for each page: what parse_page finds, sums below each path of the text that isn't NEVER main text, their
    total, tokens of the text, and two page numbers in the prime field."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page_id, url, source in zip(frame["page_id"], frame["url"], frame["html"], strict=True):
                page = parse_page(source or "")
                code = (source or "").encode("utf-8", "surrogatepass")
                numbers = [(zlib.crc32(code, seed) * 2654435761 + seed) % PRIME for seed in (1, 77)]
                never = inherited(page, [bool(k & IS_NEVER) for k in page.kinds])
                used = [at < 0 or not never[at] for at in page.places]
                below = sums_below(page, used)
                tokens = [text_token(page.paths[at] if at >= 0 else 0, t) if u else None for u, at, t in zip(used, page.places, page.texts, strict=True)]
                total = sum(len(t) for u, t in zip(used, page.texts, strict=True) if u)
                rows.append((page_id, url, *numbers, *[getattr(page, f) for f in FIELDS], *below, tokens, total))
            yield pd.DataFrame(rows, columns=["page_id", "url", "one", "two", *FIELDS, "chars", "linked_below", "links_below", "tokens", "total"])

    kinds = ", ".join(f"{f} {t}" for f, t in FIELDS.items())
    schema = f"page_id long, url string, one long, two long, {kinds}, chars array<long>, linked_below array<long>, links_below array<int>, tokens array<long>, total long"
    rows = pages.select("page_id", "url", "html").mapInPandas(parse, schema)
    return stored(rows, "parsed-pages").withColumn("host", host_of(F.col("url")))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def deduce(pages: DataFrame) -> DataFrame:
    """From parsed pages, one row for each host with a template: host, and of its elements and texts those that are
    main slots, headlines, menus or heavy (with most of the text), cleared of their names, or the template's own text.
    Host '' stands for all pages."""
    some = pages.where(F.size("paths") > 0)
    modulo = lambda c: F.pmod(F.sum(c), F.lit(PRIME))
    vector = [modulo(F.pmod(F.col(c) * F.col("n"), F.lit(PRIME))).alias(c) for c in ("one", "two")]
    measures = ("pages", "times", "chars", "linked", "links", "total")
    zipped = F.arrays_zip("paths", "kinds", "times", "chars", "linked_below", "links_below")
    elements = some.select("host", "one", "two", "total", F.explode(zipped).alias("e")).select(
        "host", "one", "two", "total", F.col("e.paths").alias("token"), F.col("e.kinds").alias("kind"), F.col("e.times").cast("long").alias("n"),
        F.col("e.chars").alias("chars"), F.col("e.linked_below").alias("linked"), F.col("e.links_below").cast("long").alias("links"),
    )
    elements = elements.groupBy("host", "token", "kind").agg(*vector, F.count("*").alias("pages"), F.sum("n").alias("times"), *[F.sum(c).alias(c) for c in measures[2:]])
    elements = stored(elements, "element-tokens")
    texts = some.select("host", "one", "two", F.explode("tokens").alias("token")).where("token is not null").withColumn("n", F.lit(1))
    # most blocks are a page's own; those of a class are on so many pages at least
    texts = texts.groupBy("host", "token").agg(*vector, F.count("*").alias("times")).where(F.col("times") >= LEAST_PAGES)
    differ = some.select("host", "one", "two").distinct().groupBy("host").agg(F.count("*").alias("n_pages"))
    hosts = stored(some.groupBy("host").agg(F.count("*").alias("all_pages")).join(differ, "host"), "hosts")
    # the common template: the hosts' sums once more
    again = [modulo(c).alias(c) for c in ("one", "two")] + [F.sum(c).alias(c) for c in measures]
    common = elements.groupBy("token", "kind").agg(*again).withColumn("host", F.lit(COMMON)).select(elements.columns)
    everywhere = hosts.agg(F.sum("all_pages").alias("all_pages"), F.sum("n_pages").alias("n_pages")).where("all_pages is not null").select(F.lit(COMMON).alias("host"), "all_pages", "n_pages")
    named = F.col("host") != COMMON
    hosts = stored(hosts.where(named).unionByName(everywhere).where(F.col("n_pages") >= LEAST_PAGES), "template-hosts")
    few = hosts.count() <= BROADCAST_HOSTS
    sizes = F.broadcast(hosts) if few else hosts
    # elements of valid classes: once in each of their pages, in enough of them
    valid = elements.where(named).unionByName(common).where("times = pages").join(sizes, "host")
    valid = stored(valid.where(F.col("pages") >= F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("all_pages") * ELEMENT_SUPPORT))), "valid-elements")
    classes = valid.where(named & (F.col("pages") >= F.ceil(F.col("all_pages") * TEXT_SUPPORT))).select("host", "one", "two", F.col("pages").alias("times")).distinct()
    own_text = texts.join(classes, ["host", "one", "two", "times"], "left_semi").select("host", F.lit("own_words").alias("role"), "token")
    role = lambda test, name: valid.where(test).select("host", F.lit(name).alias("role"), "token")
    is_kind = lambda k: F.col("kind").bitwiseAND(k) > 0
    half = 2 * F.col("chars") >= F.col("total")
    menu = (2 * F.col("linked") >= F.col("chars")) & (F.col("links") >= 2 * F.col("pages"))
    roles = own_text
    for test, name in (
        (is_kind(IS_MAIN) & half, "mains"), (is_kind(IS_ARTICLE) & half, "articles"), (is_kind(IS_HEADLINE), "headlines"),
        (is_kind(IS_RARELY) & half, "cleared"), (menu, "menus"), (F.col("chars") >= MOST * F.col("total"), "heavy"),
    ):
        roles = roles.unionByName(role(test, name))
    found = roles.groupBy("host").pivot("role", list(ROLES)).agg(F.collect_set("token"))
    return hosts.select("host").join(found, "host", "left")


ROLES = ("own_words", "mains", "articles", "headlines", "cleared", "menus", "heavy")


def main_text(page: Page, roles: dict[str, frozenset[int]]) -> str:
    """The page's text in the slots that are left."""
    paths = page.paths
    gone = [bool(k & IS_NEVER) or bool(k & IS_RARELY) and p not in roles["cleared"] for p, k in zip(paths, page.kinds, strict=True)]
    heavy = [k for k, p in enumerate(paths) if p in roles["heavy"]]
    most = inherited(page, [bool(heavy) and k == heavy[-1] for k in range(len(paths))])
    gone = inherited(page, [g or p in roles["menus"] and bool(heavy) and not most[k] and not _holds(page, k, heavy[-1]) for k, (g, p) in enumerate(zip(gone, paths, strict=True))])
    slot = next((s for r in ("mains", "articles") if any(s := [p in roles[r] for p in paths])), None)
    inside = inherited(page, [s or p in roles["headlines"] for s, p in zip(slot, paths, strict=True)]) if slot else None
    kept = []
    for text, at in zip(page.texts, page.places, strict=True):
        if at >= 0 and (gone[at] or inside and not inside[at]) or at < 0 and inside:
            continue
        if text_token(paths[at] if at >= 0 else 0, text) not in roles["own_words"]:
            kept.append(text)
    return " ".join(kept)


def _holds(page: Page, k: int, inner: int) -> bool:
    """Whether path ``inner`` lies below path ``k``."""
    while inner > k:
        inner = page.above[inner]
    return inner == k


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    pages = python_ready(pages)
    rows = parsed(pages.select(filled_id("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    templates = stored(deduce(rows), "templates")
    common = templates.where(F.col("host") == COMMON).drop("host").first()
    shared = {r: frozenset(common[r] or () if common and r != "own_words" else ()) for r in ROLES}
    own = templates.where(F.col("host") != COMMON).withColumn("known", F.lit(True))
    if own.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(own), "host", "left")
    else:
        own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("one", "two", "page_id"), F.lit(SALTS)).cast("int")).join(own, ["host", "salt"], "left")

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held: dict[str, dict[str, frozenset[int]]] = {}
            out = []
            for r in frame.itertuples(index=False):
                if r.known is True or r.known == 1:
                    if r.host not in held:
                        held[r.host] = {x: frozenset(v.tolist() if (v := getattr(r, x)) is not None else ()) for x in ROLES}
                    roles = held[r.host]
                else:
                    roles = shared
                text = main_text(Page(**{f: getattr(r, f).tolist() for f in FIELDS}), roles)
                out.append((r.page_id, r.url, text, len(text)))
            yield pd.DataFrame(out, columns=["page_id", "url", "text", "n_chars"])

    chosen = joined.select("page_id", "url", "host", "known", *FIELDS, *ROLES).mapInPandas(choose, "page_id long, url string, text string, n_chars long")
    return restored_id(chosen, "page_id")
