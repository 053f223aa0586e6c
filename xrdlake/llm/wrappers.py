"""Main text of web pages through wrappers inferred per host.

A page is read as a token stream (tags by name, class and role; text slots). Streams of one host are aligned level by level: tags that
match stay, tags that only some pages have become optional groups, neighbours alike become one repeated group, texts become
slots. The result is a union-free regular expression, kept as nested ``[name, optional, repeated, children]``. Alignment runs on distinct
streams only, first in shares of a host, then over the shares, so that a host with most of the pages is no single task's work.
A second pass matches every page with its host's expression and gathers what each slot of the expression holds; slots are marked as main text
or not, and a third pass matches again and reads the text out of the marked slots.
"""

from __future__ import annotations

import html
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrdlake.llm.common import pick
from xrdlake.llm.url_filter import split_url
from xrdlake.session import written

#: Deeper elements count as part of their ancestor at this depth; their text is read like any other.
DEPTH = 40
SHARES = 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol menu dl table select".split())
MAIN = frozenset(("article", "main"))
ASIDE = frozenset("nav header footer aside form script style noscript template iframe head title button select textarea object svg canvas dialog menu xmp".split())
ASIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal overlay sidebar side menu nav
navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe signup login widget
pagination pager toolbar skip search complementary contentinfo navigation banner""".split())
#: In longer names (page-with-sidebar, sidebar-right) these may as well describe a frame around the main text.
FRAME_WORDS = frozenset("sidebar side header masthead banner notice alert overlay popup modal toolbar skip widget".split())
LAYOUT = frozenset(("has", "with", "no", "without", "is", "layout"))
MAIN_WORDS = frozenset(("main", "article", "articlebody"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


def tokens(page: str):
    """``(kind, name, attributes or text)``: ``open``, ``close`` or ``text``; comments and declarations are left out."""
    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at:m.start()]
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            yield "close", name, ""
            continue
        attributes = m[3] or m[6] or ""
        yield "open", name, attributes
        if name in RAW and not attributes.endswith("/"):
            end = re.compile(f"</{re.escape(name)}\\b", re.IGNORECASE).search(page, at)
            stop = end.start() if end else len(page)
            if stop > at:
                yield "text", "", page[at:stop]
            at = stop


def signature(name: str, attributes: str) -> tuple[str, int, bool]:
    """The element's name in wrappers, and whether it is set aside (2; 1 if an article or main element below it is not) or main text by what it is called."""
    aside, main, label = 2 * (name in ASIDE), name in MAIN, name
    if attributes:
        found = []
        for m in _ATTRIBUTE.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            for word in value.split():
                parts = _WORDS.findall(word)
                parts = set(parts) if parts and parts[0] not in LAYOUT else set()  # has-sidebar is not a sidebar
                if parts & ASIDE_WORDS and name not in ("html", "body"):
                    aside = max(aside, 2 if word in ASIDE_WORDS or parts & ASIDE_WORDS - FRAME_WORDS else 1)
                main |= word in MAIN_WORDS and m[1].lower() in ("role", "itemprop", "id")
                found.append(_DIGITS.sub("0", word))
        if found:
            label += "." + ".".join(sorted(set(found)))
    return label, aside, main


class Reader:
    """Walks one page; ``slot`` is told of every stretch of text with its path and surroundings."""

    def walk(self, page: str):
        """Yields ``("in", label)``, ``("out",)`` for wrapper levels and ``("text", path, aside, main, link, text)``, ``("break",)`` for content."""
        # label, path, aside, main, in a link, counts as a level
        stack = [("", 0, 0, False, False, False)]
        names = [""]
        levels = 0

        def pop():
            nonlocal levels
            name, own = names.pop(), stack.pop()
            if own[5]:
                levels -= 1
                yield ("out",)
            if name not in INLINE:
                yield ("break",)

        for kind, name, rest in tokens(page):
            if kind == "text":
                if rest:
                    _, path, aside, main, link, _ = stack[-1]
                    yield "text", path, aside > 0, main, link, rest
                continue
            if kind == "open":
                if name in CLOSES_P and "p" in names:
                    back = len(names) - 1
                    while names[back] != "p" and names[back] in INLINE:
                        back -= 1
                    if names[back] == "p":
                        while len(names) > back:
                            yield from pop()
                if name in SAME_CLOSES:
                    back = len(names) - 1
                    while back and names[back] not in SAME_CLOSES[name] and names[back] not in LISTS:
                        back -= 1
                    if back and names[back] in SAME_CLOSES[name]:
                        while len(names) > back:
                            yield from pop()
                if name not in INLINE:
                    yield ("break",)
                if name == "br":
                    yield "text", stack[-1][1], stack[-1][2] > 0, stack[-1][3], stack[-1][4], " "
                if name in VOID or rest.endswith("/") and name not in RAW:
                    continue
                label, aside, main = signature(name, rest)
                up = stack[-1]
                level = levels < DEPTH
                path = xxhash.xxh64_intdigest(f"{up[1]}/{label}") >> 1 if level else up[1]
                stack.append((label, path, max(0 if main and up[2] == 1 else up[2], aside), up[3] or main, up[4] or name == "a", level))
                names.append(name)
                if level:
                    levels += 1
                    yield "in", label
                continue
            if name in names:
                if name == "p" or name in INLINE:  # not across a block that is still open
                    back = len(names) - 1
                    while names[back] != name and names[back] in INLINE:
                        back -= 1
                    if names[back] != name:
                        continue
                while names[-1] != name:
                    yield from pop()
                yield from pop()
            elif name not in INLINE:
                yield ("break",)
        while len(names) > 1:
            yield from pop()


def merged(a: list, b: list) -> list:
    """Two aligned child lists: equal names meet in order, the rest becomes optional, alike neighbours one repeated group."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append([a[i][0], a[i][1] or b[j][1], a[i][2] or b[j][2], merged(a[i][3], b[j][3])])
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], True, a[i][2], a[i][3]])
            i += 1
        else:
            out.append([b[j][0], True, b[j][2], b[j][3]])
            j += 1
    return folded(out)


def folded(nodes: list) -> list:
    """Runs of alike nodes, also with optional ones of another name between them, as one repeated node."""
    out: list = []
    for node in nodes:
        if out and out[-1][0] == node[0]:
            out[-1] = [node[0], out[-1][1] and node[1], True, merged(out[-1][3], node[3])]
        else:
            out.append(node)
    return out


def stream(page: str) -> tuple[list, int]:
    """A page's own wrapper, and the number of its texts."""
    root: list = []
    open_ = [root]
    texts = 0
    for event in Reader().walk(page):
        if event[0] == "in":
            node = [event[1], False, False, []]
            open_[-1].append(node)
            open_.append(node[3])
        elif event[0] == "out":
            open_.pop()
            own = open_[-1][-1]
            own[3] = folded(own[3])
            if len(open_[-1]) > 1 and open_[-1][-2][0] == own[0]:  # fold at once: long lists of alike blocks stay short
                open_[-1][-2:] = folded(open_[-1][-2:])
        elif event[0] == "text" and not event[5].isspace():
            texts += 1
            if not open_[-1] or open_[-1][-1][0] != "#":
                open_[-1].append(["#", False, False, []])
    return folded(root), texts


class Expression:
    """A host's wrapper with its nodes numbered, to be matched with pages."""

    def __init__(self, wrapper: list):
        self.nodes = 0
        self.top = self.numbered(wrapper)

    def numbered(self, nodes: list) -> list:
        out = []
        for name, _, repeated, children in nodes:
            self.nodes += 1
            out.append((name, self.nodes, repeated, self.numbered(children)))
        return out

    def match(self, page: str | None):
        """``Reader``'s breaks and texts, with slots in place of paths: the text's node in the expression, and whether it is set aside or main.

        Children are met from left to right, each by the first node that its own children match: a repeated node stays, others
        are passed over. The expression holds every page it was inferred from in this way; all texts of another page have slot -1.
        White space has none.
        """
        root: list = []
        open_, events, owner = [root], [], []
        for event in Reader().walk(page or ""):
            if event[0] == "in":
                open_[-1].append([event[1], [], -1])
                open_.append(open_[-1][-1][1])
            elif event[0] == "out":
                open_.pop()
            else:
                node = None
                if event[0] == "text" and not event[5].isspace():
                    if not open_[-1] or open_[-1][-1][0] != "#":
                        open_[-1].append(["#", [], -1])
                    node = open_[-1][-1]
                events.append(event)
                owner.append(node)
        known: dict = {}

        def along(own, nodes):
            """The node of each of ``own`` among ``nodes``, or None."""
            out, last = [], -1
            for child in own:
                for k in range(max(last, 0), len(nodes)):
                    name, number, repeated, below = nodes[k]
                    if name == child[0] and (k > last or repeated):
                        key = id(child), number
                        if key not in known:
                            known[key] = along(child[1], below)
                        if known[key] is not None:
                            break
                else:
                    return None
                last = k
                out.append(nodes[k])
            return out

        def place(own, nodes):
            for child, node in zip(own, nodes, strict=True):
                child[2] = node[1]
                place(child[1], known[id(child), node[1]])

        found = along(root, self.top)
        if found is not None:
            place(root, found)
        for event, node in zip(events, owner, strict=True):
            if event[0] == "text":
                _, _, aside, main, link, text = event
                slot = None if node is None else node[2] * 4 + 2 * aside + main if node[2] > 0 else -1
                yield "text", slot, aside, main, link, text
            else:
                yield event


def marked(slots: dict[int, tuple]) -> tuple[list[int], list[int]]:
    """The slots of a wrapper (with aside, main, characters, those in links, least and greatest text hash, pages) that hold main text: for pages with text in an article or main element, and for the other pages.

    The former are those below such an element that are not set aside. The latter are those not set aside whose text
    is not mostly links, without texts that are the same on three pages or more while others differ.
    """
    free = [(p, s) for p, s in slots.items() if not s[0]]
    rest = [(p, s) for p, s in free if not s[1] and 2 * s[3] <= s[2]]
    vary = any(s[4] != s[5] for _, s in rest)
    return [p for p, s in free if s[1]], [p for p, s in rest if not vary or s[4] != s[5] or s[6] < 3]


def main_text(page: str | None, expression: Expression, keep: set[int] | frozenset[int], other: set[int] | frozenset[int]) -> str:
    """The text of the slots in ``keep``, or in ``other`` if those have none: references decoded, a line per block, one space for white space."""
    texts: tuple[list, list] = ([], [])
    now: tuple[list, list] = ([], [])

    def close():
        for blocks, part in zip(texts, now, strict=True):
            if part:
                line = " ".join(html.unescape("".join(part)).split())
                if line:
                    blocks.append(line)
                part.clear()

    for event in expression.match(page):
        if event[0] == "break":
            close()
        elif event[0] == "text" and not event[2]:
            if event[1] is None:  # white space between what is kept
                for part in now:
                    part.append(" ")
            elif event[1] in keep:
                now[0].append(event[5])
            elif event[1] in other:
                now[1].append(event[5])
    close()
    return "\n".join(texts[0] or texts[1])


SLOT = "slot long, aside boolean, main boolean, chars long, link_chars long, low long, high long, pages long"
SLOT_NAMES = [x.split()[0] for x in SLOT.split(", ")]
SLOT_TYPES = [pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 5]


def expressions(texts: list):
    """The expression of each wrapper in JSON; one of a batch's equal ones is built."""
    known: dict = {}
    for t in texts:
        if t not in known:
            known[t] = Expression(json.loads(t or "[]"))
        yield known[t]


def seen(pages: DataFrame) -> DataFrame:
    """``host, stream``: the distinct streams of every host, over all pages."""
    def read(batches):
        for b in batches:
            found = {(split_url(url)[0], json.dumps(stream(page or "")[0], separators=(",", ":"))) for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], names=["host", "stream"])

    return pages.select("url", "html").mapInArrow(read, "host string, stream string").distinct()


def join_streams(texts) -> list:
    out = None
    for t in texts:
        own = json.loads(t)
        out = own if out is None else merged(out, own)
    return out or []


def infer(pages: DataFrame) -> DataFrame:
    """``host, wrapper (JSON)`` of every host."""
    found = written(seen(pages), "streams")

    def share(table: pa.Table) -> pa.Table:
        wrapper = join_streams(sorted(table.column("stream").to_pylist()))
        return pa.table({"host": table.column("host")[:1], "stream": pa.array([json.dumps(wrapper, separators=(",", ":"))])})

    shares = found.select("host", F.pmod(F.xxhash64("stream"), F.lit(SHARES)).alias("share"), "stream").groupBy("host", "share").applyInArrow(
        share, "host string, stream string")
    return shares.groupBy("host").applyInArrow(share, "host string, stream string").withColumnRenamed("stream", "wrapper")


def held(pages: DataFrame) -> DataFrame:
    """``host`` and what each slot of its wrapper holds over all pages, given ``host, html, wrapper``."""
    def read(batches):
        for b in batches:
            slots: dict = {}
            for host, page, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), expressions(b.column(2).to_pylist()), strict=True):
                on_page = set()
                for event in e.match(page):
                    if event[0] != "text" or event[1] is None:
                        continue
                    _, slot, aside, main, link, text = event
                    h = xxhash.xxh64_intdigest(text.strip()) >> 1
                    s = slots.setdefault((host, slot), [aside, main, 0, 0, h, h, 0])
                    s[2] += len(text)
                    s[3] += len(text) if link else 0
                    s[4], s[5] = min(s[4], h), max(s[5], h)
                    s[6] += slot not in on_page
                    on_page.add(slot)
            rows = [(h, p, *s) for (h, p), s in slots.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), *SLOT_TYPES], strict=True)], names=["host", *SLOT_NAMES])

    found = pages.select("host", "html", "wrapper").mapInArrow(read, f"host string, {SLOT}")
    return found.groupBy("host", "slot").agg(
        F.max("aside").alias("aside"), F.max("main").alias("main"), F.sum("chars").alias("chars"), F.sum("link_chars").alias("link_chars"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("pages").alias("pages"))


def marks(slots: DataFrame) -> DataFrame:
    """``host, slots, others``: the main-text slots of every host, for pages with and without an article or main element."""
    def whole(table: pa.Table) -> pa.Table:
        own = {r["slot"]: tuple(r[n] for n in SLOT_NAMES[1:]) for r in table.to_pylist()}
        return pa.table({"host": table.column("host")[:1], **{n: pa.array([x], pa.list_(pa.int64())) for n, x in zip(("slots", "others"), marked(own), strict=True)}})

    return slots.groupBy("host").applyInArrow(whole, "host string, slots array<long>, others array<long>")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every row: the main text, empty where there is none.

    Null pages are empty; null urls belong to the host "". Repeated rows give repeated results, an empty table none; other columns
    are not read. Wrappers are written before they are joined, so Spark knows their size when it chooses the join.
    """

    @F.pandas_udf("string")
    def host_of(urls):
        return urls.map(lambda u: split_url(u)[0])

    rows = pick(pages, page_id="long", url="string", html="string").withColumn("host", host_of("url"))
    wrappers = written(infer(rows), "wrappers")
    found = written(marks(held(rows.join(wrappers, "host"))), "marks")

    def read(batches):
        for b in batches:
            sets: dict = {}
            texts = []
            for page, e, *slots in zip(b.column(2).to_pylist(), expressions(b.column(3).to_pylist()), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                key = tuple(tuple(x or ()) for x in slots)
                if key not in sets:
                    sets[key] = tuple(map(frozenset, key))
                texts.append(main_text(page, e, *sets[key]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    met = rows.join(wrappers, "host", "left").join(found, "host", "left").select("page_id", "url", "html", "wrapper", "slots", "others")
    return met.mapInArrow(read, "page_id long, url string, text string")
