"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page's tokens become a tree whose sequences are regular expressions without unions: an element, a text slot,
a repeated group (adjacent siblings, or runs of siblings, of one kind fold into one) or an optional part. Two
expressions align token by token: what both have is aligned further inside, what one has alone becomes
optional, texts that pages differ in or lack make a slot variable. Every task aligns the pages that it reads,
host by host; the hosts' partial wrappers are aligned in two more steps. The wrapper then says which of its
elements holds the article: a marked one (article, main), else the deepest that holds all variable text outside
of furniture. Inside it, what goes is furniture by its tag or whole names; a name that only resembles furniture's
needs the wrapper's evidence (the same on all pages, or links for the most part).
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import broadcast_if_small, map_slices, materialise, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg math iframe object canvas select title".split())
#: Elements that part blocks of text.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: An open tag of the first kind ends an open element of the second, unless one of the third stands between.
ENDS = {t: ("p", "button table td th article section div") for t in BLOCK - {"html", "head", "body"}} | {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
}
ENDS = {t: (frozenset(a.split()), frozenset(b.split())) for t, (a, b) in ENDS.items()}
FURNITURE = frozenset("nav footer aside form script style noscript template button iframe svg canvas object select textarea dialog menu head title".split())
#: A name (class, id or role; its words are parted by -, _ and capitals) is furniture's if some word is one of FIRM
#: or LIKELY and all the others say only where or how the part stands. FIRM: adverts, reader comments, hidden parts.
FIRM = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle adbox adslot adunit sponsor sponsors sponsored comment comments commentlist commentform disqus replies respond hidden".split()
)
LIKELY = frozenset(
    "sidebar sidebars side nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe login signup promo promos"
    " share sharing sharedaddy social related recommended recommendations widget widgets teaser teasers pagination pager search skip complementary contentinfo".split()
)
PLACE = frozenset(
    "box list form section area thread bar slot unit wrapper wrap container inner outer block panel column col row group link links button buttons icon icons item items top bottom left right main site page global primary secondary post posts"
    " article articles story stories entry blog content reader readers user users visitor visitors privacy policy header head up in the of and on to a by your our this text title widget area count".split()
)
#: Furniture by a whole name whose words only say where.
PLACES = frozenset("site-header top-bar".split())
#: Names that may be furniture's: they count where the wrapper has more evidence, or outside of the article.
LOOSE = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|side\w*|widgets?|nav\w*|menus?|toc|breadcrumbs?|footer|masthead|cookies?|consent|notices?|alert\w*|disclaimer|banner|popup|modal|overlay|newsletter|subscri\w+|sign-?up|log-?in|share|sharing"
    r"|social|related|recommend\w*|teasers?|comments?|repl\w+|discussion|feedback|tags?|meta|byline|author\w*|pagination|pager|search|toolbar|skip)(?:[-_ ]|$)",
    re.I,
)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
CAPITALS = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Blocks of running text: the article's element is never one of them.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tr td th blockquote pre figure a b i em strong span br hr img".split())
#: Runs of this many siblings fold when they repeat.
PERIODS = (1, 2, 3, 4)
#: A sequence of a wrapper knows this many names of one tag; elements of rarer names are one item, <tag>.~ for all.
KINDS = 24
#: A part that is the same on this many pages is the host's, where its name is LOOSE.
SAME_PAGES = 3


def deep(levels: int) -> None:
    """Lets merge, align and fold call each other this many levels down; such calls take no room on C's stack."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * levels + 1000))


def parse(page: str) -> list:
    """The page as nested elements [key, tag, children]; texts are strings, character references still in them."""
    root = ["", "", []]
    stack = [root]
    still: Counter[str] = Counter()  # open elements by tag
    at, n, deepest = 0, len(page), 0

    def close(k: int) -> None:
        for x in stack[k:]:
            still[x[1]] -= 1
        del stack[k:]

    while at < n:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            stack[-1][2].append(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if still[tag]:
                k = len(stack) - 1
                while stack[k][1] != tag:
                    k -= 1
                close(k)
            continue
        if tag in ENDS:
            ended, walls = ENDS[tag]
            if any(still[t] for t in ended):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][1] in ended:
                        close(k)
                        break
                    if stack[k][1] in walls:
                        break
        key = tag
        if m[3]:
            names = " ".join(a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(m[3])) if "=" in m[3] else ""
            if HIDDEN.search(m[3]):
                names += " hidden"
            if names:
                key += "." + CAPITALS.sub("-", re.sub(r"\d+", "", names)).strip()
        node = [key, tag, []]
        stack[-1][2].append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            still[tag] += 1
            deepest = max(deepest, len(stack))
    deep(deepest)
    return root


@lru_cache(maxsize=65536)
def named(key: str) -> str:
    """Whose an element's names are: firm, likely, loose (see above) or nobody's ("")."""
    names = key.partition(".")[2].lower()
    found = ""
    for name in names.split():
        words = [w for w in re.split(r"[-_]+", name) if w]
        if words and all(w in FIRM or w in LIKELY or w in PLACE for w in words):
            if any(w in FIRM for w in words):
                return "firm"
            if any(w in LIKELY for w in words) or name in PLACES:
                found = "likely"
    return found or ("loose" if names and LOOSE.search(names) else "")


def is_furniture(key: str, names: bool = True) -> bool:
    """By its tag, or by its names; with names=False only firm ones count."""
    return key.partition(".")[0] in FURNITURE or named(key) in (("firm", "likely") if names else ("firm",))


# An expression's item: [key, optional, repeated, children, pages]; of a text slot [#, optional, repeated, its text's
# checksum or null where pages differ, characters]; of a group of siblings [(keys), optional, repeated, items, pages].


def merge(a: list, b: list, pages: bool = True) -> list:
    """One item for both: of two pages, or with pages=False of two places in one."""
    if a[0] == "#":
        if a[3] == b[3]:
            text = a[3]
        else:
            text = None if pages or a[3] is None or b[3] is None else zlib.crc32(b"%d %d" % (a[3], b[3]))
        return ["#", a[1] or b[1], a[2] or b[2], text, a[4] + b[4]]
    return [a[0], a[1] or b[1], a[2] or b[2], align(a[3], b[3], pages), a[4] + b[4] if pages else max(a[4], b[4])]


def variable(item: list) -> list:
    """The item with all its texts variable."""
    return [*item[:3], None, item[4]] if item[0] == "#" else [*item[:3], [variable(x) for x in item[3]], item[4]]


def align(a: list, b: list, pages: bool = True) -> list:
    """One sequence for both: equal keys in order meet, the rest is optional; what one page has alone is variable."""
    if len(a) == len(b) and all(x[0] == y[0] for x, y in zip(a, b, strict=True)):
        return [merge(x, y, pages) for x, y in zip(a, b, strict=True)]

    def lone(items: list) -> list:
        return [[x[0], True, *(variable(x) if pages else x)[2:]] for x in items]

    places: tuple[dict, dict] = ({}, {})
    for side, items in zip(places, (a, b), strict=True):
        for i, x in enumerate(items):
            side.setdefault(x[0], []).append(i)

    def following(side: int, key: str, at: int) -> int | None:
        found = places[side].get(key, ())
        k = bisect_left(found, at)
        return found[k] if k < len(found) else None

    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i][0] == b[j][0]:
            out.append(merge(a[i], b[j], pages))
            i, j = i + 1, j + 1
            continue
        ahead_a, ahead_b = following(0, b[j][0], i), following(1, a[i][0], j)
        if ahead_a is not None and (ahead_b is None or ahead_a - i <= ahead_b - j):
            out += lone(a[i:ahead_a])
            i = ahead_a
        elif ahead_b is not None:
            out += lone(b[j:ahead_b])
            j = ahead_b
        else:
            out += lone([a[i], b[j]])
            i, j = i + 1, j + 1
    out += lone(a[i:] + b[j:])
    return general(fold(out))


def general(items: list) -> list:
    """Of a tag with more than KINDS names the rarer ones become one item."""
    if len(items) <= KINDS:
        return items
    kinds: dict[str, Counter] = {}
    for x in items:
        if x[0][0] not in "#(":
            kinds.setdefault(x[0].partition(".")[0], Counter())[x[0]] += x[4]
    rare: set[str] = set()
    for tag, found in kinds.items():
        if len(found) > KINDS:
            rare.update(sorted(found, key=lambda k: (k == f"{tag}.~", k != tag, -found[k], k))[KINDS - 1 :])
    if not rare:
        return items
    out: list[list] = []
    at: dict[str, int] = {}
    for x in items:
        if x[0] not in rare:
            out.append(x)
            continue
        key = x[0].partition(".")[0] + ".~"
        x = [key, True, True, variable(x)[3], x[4]]
        if key in at:
            out[at[key]] = merge(out[at[key]], x)
        else:
            at[key] = len(out)
            out.append(x)
    return out


def fold(items: list) -> list:
    """Adjacent repeats become one repeated item or group."""
    for period in PERIODS:
        if len(items) < 2 * period:
            break
        out, i = [], 0
        keys = [x[0] for x in items]
        while i < len(items):
            if i + 2 * period <= len(items) and keys[i : i + period] == keys[i + period : i + 2 * period] and (period == 1 or len(set(keys[i : i + period])) > 1):
                own, k = items[i : i + period], i + period
                while keys[k : k + period] == keys[i : i + period]:
                    own = [merge(x, y, False) for x, y in zip(own, items[k : k + period], strict=True)]
                    k += period
                if period == 1:
                    out.append([own[0][0], own[0][1], True, *own[0][3:]])
                else:
                    out.append(["(" + "|".join(keys[i : i + period]) + ")", False, True, own, max(x[4] for x in own)])
                i = k
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def below(root: list, children: Callable[[list], Iterable[list]]) -> list[list]:
    """The node and all under it, each before those under it."""
    order = [root]
    for x in order:
        order.extend(children(x))
    return order


def elements(node: list) -> list[list]:
    return [c for c in node[2] if not isinstance(c, str) and c[1] != "br"]


def expression(node: list) -> list:
    """The expression of one parsed element and all below it."""
    made: dict[int, list] = {}
    for x in reversed(below(node, elements)):
        out = []
        for child in x[2]:
            if isinstance(child, str):
                text = child.strip()
                if text:
                    out.append(["#", False, False, zlib.crc32(text.encode("utf-8", "surrogatepass")), len(text)])
            elif child[1] != "br":
                out.append(made.pop(id(child)))
        made[id(x)] = [x[0], False, False, fold(out), 1]
    return made[id(node)]


def dump(item: list) -> str:
    """An expression as a flat list, each item before those under it: no depth is too deep for JSON."""
    flat, todo = [], [item]
    while todo:
        x = todo.pop()
        flat.append(x if x[0] == "#" else [*x[:3], len(x[3]), x[4]])
        if x[0] != "#":
            todo.extend(reversed(x[3]))
    return json.dumps(flat, separators=(",", ":"))


def load(text: str) -> list:
    flat = json.loads(text)
    stack: list[tuple[list, int]] = []  # open items and how many children they take
    deepest = 0
    for x in flat:
        n = 0
        if x[0] != "#":
            n, x[3] = x[3], []
        if stack:
            stack[-1][0][3].append(x)
        if n:
            stack.append((x, n))
            deepest = max(deepest, len(stack))
        while stack and len(stack[-1][0][3]) == stack[-1][1]:
            stack.pop()
    deep(deepest)
    return flat[0]


class Measure(NamedTuple):
    """Characters under an item, outside of furniture."""

    mass: float = 0.0  # outside of links; a text that is the same on all pages counts little
    varies: int = 0  # not the same on all pages
    all: int = 0
    links: int = 0
    heads: bool = False  # holds a heading


def measures(wrapper: list, names: bool) -> dict[int, Measure]:
    out: dict[int, Measure] = {}
    for x in reversed(below(wrapper, lambda x: () if x[0] == "#" else x[3])):
        tag = x[0].partition(".")[0]
        if tag == "#":
            out[id(x)] = Measure(x[4] * (1.0 if x[3] is None else 0.01), x[4] if x[3] is None else 0, x[4])
            continue
        mass, varies, every, links, heads = 0.0, 0, 0, 0, tag in ("h1", "h2", "h3")
        for c in x[3]:
            m = out[id(c)]
            mass, varies, every, links, heads = mass + m.mass, varies + m.varies, every + m.all, links + m.links, heads or m.heads
        if is_furniture(x[0], names) or tag == "header" and not heads:
            out[id(x)] = Measure(heads=heads)
        elif tag == "a":
            out[id(x)] = Measure(0.0, varies, every, every, heads)
        else:
            out[id(x)] = Measure(mass, varies, every, links, heads)
    return out


def keys_of(place: tuple | None) -> list[str]:
    """The keys from the root to a place (the place above, key); groups have none."""
    out = []
    while place:
        place, key = place
        if key[0] != "(":
            out.append(key)
    return out[::-1]


def article(wrapper: list, names: bool) -> tuple[list, tuple | None]:
    """The item that holds the article, and its place: a marked one, else the deepest that holds all text that varies
    outside of furniture. Without text of that kind it is the whole page."""
    found = measures(wrapper, names)
    marked: list[tuple[float, int, list, tuple]] = []
    todo: list[tuple[list, tuple | None]] = [(wrapper, None)]
    while todo:
        item, place = todo.pop()
        if item is not wrapper:
            if is_furniture(item[0], names):
                continue
            place = (place, item[0])
            tag, _, own = item[0].partition(".")
            if item[0][0] != "(" and (tag in ("article", "main") or re.search(r"\bmain\b|\barticle\b", own)) and found[id(item)].all:
                marked.append((found[id(item)].mass * (1.0 if tag == "article" else 0.999), -len(marked), item, place))
        todo.extend((x, place) for x in reversed(item[3]) if x[0] != "#")
    if marked:
        best = max(marked, key=lambda x: x[:2])
        articles = [x for x in marked if x[2][0].partition(".")[0] == "article"]
        if articles:
            own = max(articles, key=lambda x: x[:2])
            best = own if own[0] >= 0.5 * best[0] else best
        return best[2], best[3]
    item, place = wrapper, None
    every = not found[id(wrapper)].varies  # nothing varies on one page, or on copies of one
    while True:
        inside = [(m.all if every else m.varies, x) for x in item[3] if (m := found[id(x)]).all and (every or m.varies)]
        if len(inside) > 1:  # small parts with an odd name beside the rest
            total = sum(n for n, _ in inside)
            inside = [(n, x) for n, x in inside if x[0][0] in "#(" or 2 * n >= total or named(x[0]) != "loose" or x[0].partition(".")[0] in RUNNING]
        if len(inside) != 1:
            return item, place
        best = inside[0][1]
        if best[2] or best[0][0] in "#(" or best[0].partition(".")[0] in RUNNING or found[id(best)].mass < 0.5 * found[id(item)].mass:
            return item, place
        item, place = best, (place, best[0])


def region(wrapper: list) -> dict:
    """Where the article is, and what the wrapper knows about names inside it.

    path: the keys from the root to its element. drop: places in it whose name is LOOSE and that are the same on all
    pages, or links for the most part. keep: places whose name is LIKELY but that hold most of the article. trust:
    whether LIKELY names count; they don't where nothing would be left.
    """
    names = measures(wrapper, True)[id(wrapper)].all > 0
    item, place = article(wrapper, names)
    plain = measures(wrapper, False)
    whole = plain[id(item)]
    drop, keep = [], []
    todo: list[tuple[list, tuple | None]] = [(x, None) for x in item[3]]
    while todo:
        x, at = todo.pop()
        if x[0] == "#":
            continue
        at, m, kind = (at, x[0]), plain[id(x)], named(x[0])
        if kind == "likely" and 2 * m.all > whole.all and 2 * m.links < m.all:
            keep.append(keys_of(at))
        elif kind == "loose" and m.all and x[0].partition(".")[0] not in RUNNING:
            same = wrapper[4] >= SAME_PAGES and not m.varies and whole.varies
            if same or m.links >= 0.7 * m.all:
                drop.append(keys_of(at))
                continue
        todo.extend((c, at) for c in x[3])
    return {"path": keys_of(place), "drop": sorted(drop), "keep": sorted(keep), "trust": names}


def verdicts(known: dict) -> dict:
    """The places of drop and keep as nested dicts by key; what is said of a place stands under ""."""
    tree: dict = {}
    for say in ("drop", "keep"):
        for path in known[say]:
            at = tree
            for key in path:
                at = at.setdefault(key, {})
            at[""] = say
    return tree


def blocks(node: list, marks: dict, trust: bool) -> list[str]:
    """The texts of an article's blocks, in order."""
    out: list[list[str]] = [[]]
    open_: list[tuple[Iterator, dict, bool]] = [(iter(node[2]), marks, False)]
    while open_:
        rest, at, ends = open_[-1]
        for child in rest:
            if isinstance(child, str):
                out[-1].append(child)
                continue
            key, tag, _ = child
            if tag == "br":
                out[-1].append(" ")
                continue
            here = at.get(key, at.get(f"{tag}.~", NOWHERE)) if at else NOWHERE
            said = here.get("")
            if tag in FURNITURE or tag in RAW or said == "drop" or said != "keep" and is_furniture(key, trust):
                continue
            if tag == "header" and not any(x[1] in ("h1", "h2", "h3") for x in below(child, elements)):
                continue
            if tag in ("td", "th"):
                out[-1].append(" ")
            elif tag in BLOCK:
                out.append([])
            open_.append((iter(child[2]), here, tag in BLOCK and tag not in ("td", "th")))
            break
        else:
            open_.pop()
            if ends:
                out.append([])
    return [" ".join(entities.unescape("".join(b)).split()) for b in out]


NOWHERE: dict = {}


def under(node: list, path: list[str]) -> list[list]:
    """The outermost elements that the keys of path lead to."""
    level = [node]
    for key in path:
        tag = key[:-2] if key.endswith(".~") else None
        level = [c for x in level for c in x[2] if not isinstance(c, str) and (c[0] == key or tag is not None and c[1] == tag and c[0] != tag)]
    return level


def main_text(page: str, known: dict | None) -> str:
    """The blocks of the article, joined by line feeds. A page that its host's wrapper doesn't fit has one of its own."""
    root = parse(page)
    found = under(root, known["path"]) if known is not None else []
    if not found:
        known = region(expression(root))
        found = under(root, known["path"])
    marks = verdicts(known)
    return "\n".join(x for node in found for x in blocks(node, marks, known["trust"]) if x)


def host(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper (its expression as JSON), aligned over all pages(url, html)."""
    rows = pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))

    def start():
        def f(batch: dict) -> dict:
            own: dict[str, list] = {}
            for h, page in zip(batch["host"], batch["html"], strict=True):
                e = expression(parse(page))
                own[h] = merge(own[h], e) if h in own else e
            return {"host": list(own), "wrapper": [dump(w) for w in own.values()]}

        return f

    part = map_slices(rows, start, "host string, wrapper string", rows=2048)

    def together(pdf):
        w = None
        for x in sorted(pdf["wrapper"]):  # the result must not depend on the order of tasks
            x = load(x)
            w = x if w is None else merge(w, x)
        out = pdf.head(1).copy()
        out["wrapper"] = [dump(w)]
        return out

    part = part.withColumn("some", F.pmod(F.xxhash64("wrapper"), F.lit(256)).cast("int"))
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for keys in (["host", "some"], ["host"]):  # a host's parts come together few at a time
        # few bytes and much work: with a stated number of partitions they aren't put together by their size
        part = part.repartition(tasks, *keys).groupBy(*keys).applyInPandas(together, "host string, wrapper string, some int")
    return part.select("host", "wrapper")


def extract(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `carry` of pages(url, html), text and n_chars (its code points): a row for every row.

    Null html gives an empty text. Pages with a null url, or one without a host, are a host of their own kind.
    Repeated rows stay; ValueError if a carried column is named text or n_chars; other columns are not read. Elements
    may nest at any depth.
    """
    if {"text", "n_chars"} & {c.lower() for c in carry}:
        raise ValueError("carried columns must not be named text or n_chars")

    def start():
        return lambda rows: {"host": rows["host"], "known": [json.dumps(region(load(w))) for w in rows["wrapper"]]}

    regions = materialise(map_slices(wrappers(pages), start, "host string, known string"), "regions")
    cols = list(dict.fromkeys([*carry, "url", "html"]))
    rows = pages.select(*cols, host(F.col("url")).alias("__host"))
    known = regions.withColumnsRenamed({"host": "__host", "known": "__known"})
    rows = rows.join(broadcast_if_small(known, regions), "__host", "left")
    schema = T.StructType([*[pages.schema[c] for c in carry], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def begin():
        read: dict[str, dict] = {}

        def f(batch: dict) -> dict:
            texts = []
            for page, known in zip(batch["html"], batch["__known"], strict=True):
                if known is not None and known not in read:
                    if len(read) > 10_000:
                        read.clear()
                    read[known] = json.loads(known)
                texts.append(main_text(page or "", read.get(known)))
            return {c: batch[c] for c in carry} | {"text": texts, "n_chars": [len(t) for t in texts]}

        return f

    return map_slices(rows.select(*cols, "__known"), begin, schema, rows=64)


def op10_wrapper_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
