"""Main text of web pages: site templates by subtree hashes, then what its role puts outside the article."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Fixed values of HTML: elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes noscript template svg object select xmp annotation annotation-xml".split())
#: Of these, an element that its own slash closes ends there.
SELF_CLOSED = frozenset("svg annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li summary tbody td tfoot th thead tr".split())
#: An open element of the second kind ends when one of the first kind starts (up to the third).
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: Elements that hold no article text. An article or main element in one of the first kind is a
#: side piece, unless the page has no other.
ASIDE = frozenset("nav aside footer".split())
OUTSIDE = ASIDE | frozenset("form button dialog menu search head fieldset label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that name such a part, and words that may stand beside them in the name.
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
NAMES = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs footer header masthead share sharing social related recommended widget toolbar pagination pager teaser".split()
)
LAYOUT = frozenset(
    "area bar block body box btn button buttons container content global group holder inner item items left link links list main outer page panel "
    "pane policy post posts primary region right secondary section site slot space thread top bottom unit wrap wrapper".split()
)
#: Names that are no outside part within an article, where a header holds the title.
TITLE_NAMES = frozenset("header masthead".split())
#: Names that may also be what a section of an article is about: with a heading inside, it stays.
TOPICS = frozenset("notice notices notification alert promotion promo consent menu banner login signup overlay social widget teaser sponsor cookie cookies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Inside an article only such containers can be template; its paragraphs, headings and lists are text.
CONTAINERS = frozenset("div section aside header".split())
#: Elements whose id counts beside their class, and what is hashed beside an article.
BOXES = CONTAINERS | frozenset("nav footer form table ul ol".split())

#: Of the hashes of runs of blocks.
PRIME, BASE = (1 << 89) - 1, 0x9E3779B97F4A7C15F39CC06

TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>[^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+)(?:>|\Z)"
    r"|<(?P<cut>/?[A-Za-z])"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")


def _named(value: str, words: frozenset[str]) -> set[str]:
    """The words of a class or id that name an outside part: all parts of a name are such words or
    words of layout. So ``comment-list`` names one, and ``comment-on-law``, ``has-sidebar`` do not."""
    found: set[str] = set()
    for name in value.split():
        parts = [p.lower() for p in PARTS.split(name) if p]
        said = words.intersection(parts)
        if said and all(p in words or p in LAYOUT or (p.isdigit() and said <= COMMENTS) for p in parts):
            found |= said
    return found


@dataclass
class Element:
    """An element that is open or was: blocks from ``first`` to ``end``, and why it may be outside:
    ``tag`` (what it is), ``hidden``, or ``name`` (its class or id; ``topic`` if that may be a topic)."""

    tag: str
    parent: int
    first: int
    why: str
    end: int = 0
    comments: bool = False
    topic: bool = False
    heading: bool = False
    title: bool = False


def _reason(tag: str, attrs: str, in_article: bool) -> tuple[str, bool, bool]:
    """Why an element may be outside the article (``in_article``: it stands in an article or main
    element), whether it says that it holds comments, and whether its name may be a topic."""
    why = "tag" if tag in OUTSIDE or (tag == "header" and not in_article) else ""
    if not attrs or attrs.isspace() or tag in ("html", "body", "main"):
        return why, False, False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
    bare = ATTR.sub(" ", attrs).lower().split()
    if "hidden" in found or "hidden" in bare or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return "hidden", False, False
    if found.get("role", "").strip().lower() in ROLES:
        return why or "tag", False, False
    if tag in HEADINGS or (in_article and tag in BLOCK and tag not in BOXES and tag != "article"):
        return why, False, False  # in an article, names act on containers and on inline elements
    value = found.get("class", "") + (" " + found.get("id", "") if tag in BOXES or tag == "article" else "")
    said = _named(value, NAMES - TITLE_NAMES if in_article or tag == "article" else NAMES)
    return why or ("name" if said else ""), bool(said & COMMENTS), not why and said <= TOPICS


@dataclass
class Page:
    """Text blocks in page order with the element each lies in, and all elements (0 is the page)."""

    blocks: list[str]
    owner: list[int]
    elements: list[Element]

    def settle(self) -> None:
        """Decide which blocks are outside, and which lie in an article (2) or main element (1).

        An element that holds the page's article, or most of the text of a page without one, is
        never outside by its name or as a form; nor as a side element if the page has no other.
        """
        es = self.elements
        own = [bool(e.why) for e in es]
        titles = sum(e.tag == "h1" for e in es)
        held = [False] * len(es)  # holds an article or main that is not outside by itself
        side = [False] * len(es)  # is or lies in a side piece
        free = False
        for i, e in enumerate(es):  # parents come before their children
            above = e.parent >= 0 and side[e.parent]
            side[i] = above or e.tag in ASIDE or e.why == "hidden" or (e.why == "name" and e.comments)
            free |= e.tag in ("article", "main") and not own[i] and not above
        for i in range(len(es) - 1, 0, -1):
            if held[i] or (es[i].tag in ("article", "main") and not own[i]):
                held[es[i].parent] = True
        size = [0]
        for b in self.blocks:
            size.append(size[-1] + len(b))
        out = [False] * len(es)
        level = [0] * len(es)
        has_main = any(held)
        for i, e in enumerate(es):
            up = e.parent
            gone = own[i]
            if gone and e.why != "hidden":
                aside = e.tag in ASIDE or e.comments
                if held[i] and not (aside and free):
                    gone = False
                elif e.why == "name" and e.heading and (e.topic and up >= 0 and level[up] > 0):
                    gone = False  # a section about a notice, not a notice
                elif e.why == "name" and e.title and not has_main and titles == 1:
                    gone = False  # the page's only title stands in its header
                elif not has_main and not aside and e.tag != "head" and (e.why == "name" or e.tag in ("form", "fieldset", "label")):
                    gone = 2 * (size[e.end] - size[e.first]) <= size[-1]
            out[i] = gone or (up >= 0 and out[up])
            level[i] = max(level[up] if up >= 0 else 0, 0 if out[i] else 2 if e.tag == "article" else int(e.tag == "main"))
        self.outside = [out[k] for k in self.owner]
        self.place = [level[k] for k in self.owner]
        self.level = level

    def main(self) -> list[int]:
        """The blocks of the article, else of the main element, else of the whole page, without what is outside."""
        for least in (2, 1, 0):
            got = [i for i, p in enumerate(self.place) if p >= least and not self.outside[i]]
            if got:
                return got
        return []

    def hashes(self) -> list[tuple[int, int, int]]:
        """(hash, first block, end) of the subtrees that may be template: beside the article all,
        menus and footers too, in it its containers but not the article itself."""
        has_main = any(self.place)
        most = len(self.main())
        # hashes of runs of blocks from prefix sums, so that nested subtrees cost no more than flat ones
        prefix, power = [0], [1]
        for t in self.blocks:
            prefix.append((prefix[-1] * BASE + xxhash.xxh64_intdigest(t)) % PRIME)
            power.append(power[-1] * BASE % PRIME)
        out = []
        for e, level in zip(self.elements[1:], self.level[1:], strict=True):
            a, b = e.first, e.end
            if b > a and e.tag in (CONTAINERS if level == 2 else BOXES if has_main else BLOCK):
                if level == 2 and b - a >= most:
                    continue  # the whole article
                run = (prefix[b] - prefix[a] * power[b - a]) % PRIME
                out.append((xxhash.xxh64_intdigest(f"{e.tag} {b - a} {run}") - (1 << 63), a, b))
        return out


def parse(text: str | None) -> Page:
    """All blocks of a page and its elements, with what is outside the article by its role.

    Reads tags with the implied ends that matter for text; never fails: unknown or unfinished
    markup at the end of the page is dropped, character references are decoded.
    """
    page, buf = Page([], [], [Element("", -1, 0, "")]), []
    # open elements: tag, number in the page, whether inside an article or main element, whether its
    # own text is outside (inline elements alone: the text around them stays one block), number of its block
    stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]
    places: dict[str, list[int]] = {}  # where each tag is open, so that no end tag has to search
    blocks = [0]  # where block elements are open

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else 0

    def flush() -> None:
        if buf:
            t = " ".join("".join(buf).split())
            buf.clear()
            if t:
                page.blocks.append(t)
                page.owner.append(stack[-1][4])

    def close(to: int) -> None:
        while len(stack) > to:
            tag, k = stack[-1][:2]
            places[tag].pop()
            if tag in BLOCK:
                blocks.pop()
                flush()
            if k != stack[-2][1]:
                page.elements[k].end = len(page.blocks)
            stack.pop()

    def say(t: str) -> None:
        if t and not stack[-1][3]:
            buf.append(entities.unescape(t) if "&" in t else t)

    text, at = text or "", 0
    while m := TAG.search(text, at):
        say(text[at : m.start()])
        at = m.end()
        if m["cut"]:
            at = len(text)  # an unfinished tag takes the rest
            break
        if not m["name"]:
            continue
        tag = m["name"].lower()
        if m["end"]:
            k = last(tag)
            if k and (tag in BLOCK or k > blocks[-1]):  # an inline end tag closes no block
                close(k)
            continue
        closed = m["attrs"].rstrip().endswith("/")
        if tag in RAW:
            if not (closed and tag in SELF_CLOSED):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(text, at)
                at = end.end() if end else len(text)
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in CLOSES_P and blocks[-1] and stack[blocks[-1]][0] == "p":
            close(blocks[-1])
        if tag in IMPLIED:
            ends, scope = IMPLIED[tag]
            k = max(map(last, ends))
            if k > max(map(last, scope)):
                close(k)
        if tag in BLOCK:
            flush()
        if tag in VOID or (closed and last("math")):
            continue
        _, up, in_article, mute, owner = stack[-1]
        why, comments, topic = _reason(tag, m["attrs"], in_article)
        if tag in BLOCK or why:
            page.elements.append(Element(tag, up, len(page.blocks), why, 0, comments, topic))
            if tag in HEADINGS:
                k = up
                while k >= 0 and not (page.elements[k].heading and (page.elements[k].title or tag != "h1")):
                    page.elements[k].heading, page.elements[k].title = True, page.elements[k].title or tag == "h1"
                    k = page.elements[k].parent
            up = len(page.elements) - 1
            mute = tag not in BLOCK
            owner = owner if mute else up
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append((tag, up, in_article or (tag in ("article", "main") and not why), mute, owner))
    say(text[at:])
    close(1)
    flush()
    page.elements[0].end = len(page.blocks)
    page.settle()
    return page


def host_of(url: str | None) -> str:
    """Host of an address in lower case; empty if it has none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


@dataclass(frozen=True)
class TemplateRule:
    """A subtree is template if it stands beside ``min_pages`` different main texts of its host at
    least, and beside ``min_share`` of them or beside ``many``, whatever the host's size."""

    min_pages: int = 5
    min_share: float = 0.2
    many: int = 100

    def needed(self, pages: Column) -> Column:
        return F.greatest(F.lit(self.min_pages), F.least(F.lit(self.many), F.ceil(self.min_share * pages)))


def templates(pages: DataFrame, rule: TemplateRule = TemplateRule(), url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Rows (host, hash) of template subtrees. Counts different main texts, so copies of one
    article, however many, make no template of their own parts. One distinct and two sums, all
    with map-side aggregation: a hot host is no hot task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            hosts, hashes, mains = [], [], []
            for url, text in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                page, host = parse(text), host_of(url)
                main = xxhash.xxh64_intdigest("\n".join(page.blocks[i] for i in page.main())) - (1 << 63)
                found = {h for h, _, _ in page.hashes()}
                hosts += [host] * (len(found) + 1)
                hashes += [None, *found]
                mains += [main] * (len(found) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(mains, pa.int64())], names=["host", "hash", "main"])

    src = pages.select(pages[url_column].alias("url"), pages[html_column].alias("html"))
    rows = src.mapInArrow(run, "host string, hash bigint, main bigint").distinct()
    counts = rows.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    all_pages = counts.filter("hash is null").select("host", F.col("n").alias("pages"))
    many = counts.filter((F.col("hash").isNotNull()) & (F.col("n") >= rule.min_pages))
    return many.join(all_pages, "host").filter(F.col("n") >= rule.needed(F.col("pages"))).select("host", "hash")


#: Templates up to this many rows (16 bytes and a host name each) are sent to every task.
BROADCAST_ROWS = 200_000


def _text(page: Page, gone: set[int]) -> str:
    step = [0] * (len(page.blocks) + 1)
    for h, a, b in page.hashes() if gone else ():
        if h in gone:
            step[a] += 1
            step[b] -= 1
    dead = list(accumulate(step))
    return "\n".join(page.blocks[i] for i in page.main() if not dead[i])


def extract(pages: DataFrame, rule: TemplateRule = TemplateRule(), id_column: str = "page_id", url_column: str = "url", html_column: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per page: id, url, text, n_chars.

    Null and empty pages give an empty text; a null url is a host of its own; repeated pages each
    get their row; other columns are not read. Pages are read twice (count, then extract) and
    never shuffled while the templates number at most ``broadcast_rows``; beyond that each page
    is joined with those of its own subtrees that are template.
    """
    from pyspark.storagelevel import StorageLevel

    src = pages.select(pages[id_column].alias("id"), pages[url_column].alias("url"), pages[html_column].alias("html"))
    found = templates(src, rule).persist(StorageLevel.MEMORY_AND_DISK)
    schema = f"id {src.schema['id'].dataType.simpleString()}, url string, text string, n_chars bigint"

    def write(b: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    if found.count() <= broadcast_rows:
        known: dict[str, set[int]] = {}
        for r in found.collect():
            known.setdefault(r["host"], set()).add(r["hash"])
        shared = pages.sparkSession.sparkContext.broadcast(known)
        found.unpersist()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "html"):
                rows = zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True)
                yield write(b, [_text(parse(h), shared.value.get(host_of(u), set())) for u, h in rows])

        return src.mapInArrow(run, schema).withColumnRenamed("id", id_column)

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            keys, hosts, hashes = [], [], []
            for k, u, h in zip(b.column("key").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                own = {x for x, _, _ in parse(h).hashes()}
                keys += [k] * len(own)
                hosts += [host_of(u)] * len(own)
                hashes += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hosts, pa.string()), pa.array(hashes, pa.int64())], names=["key", "host", "hash"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            yield write(b, [_text(parse(h), set(g or ())) for h, g in zip(b.column("html").to_pylist(), b.column("gone").to_pylist(), strict=True)])

    keyed = src.withColumn("key", F.xxhash64("url", "html"))  # pages of one url and content are extracted alike
    own = keyed.select("key", "url", "html").mapInArrow(subtrees, "key bigint, host string, hash bigint").distinct()
    gone = own.join(found, ["host", "hash"]).groupBy("key").agg(F.collect_set("hash").alias("gone"))
    return keyed.join(gone, "key", "left").select("id", "url", "html", "gone").mapInArrow(finish, schema).withColumnRenamed("id", id_column)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
