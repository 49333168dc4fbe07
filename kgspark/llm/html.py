"""Main text of web pages: what the pages of a host don't repeat, by page parts whose ordered tokens are alike.

Each page is read as tokens, tags and words in page order. The tokens of a structural element (a block with a name, or
a plain container) are one class: they are known by one hash of their order and nesting and of the path of open
elements, names and classes. A class is template if it occurs on a share of SUPPORT of the host's pages, and on at
least SUPPORT * HOST_PAGES. Everything else lies in slots, whose words and plain paragraphs are never template, so a
passage that all pages of a host repeat stays. Pages of one host with equal free text are copies and count once. Hosts
with fewer than HOST_PAGES distinct pages share one template. An element with most of its page's free text (HOLDS, and
LONG characters) is text even where others repeat it.

The text is what lies in no template element, inside and around an article, and in no part that by its element, role
or name is a menu, header, footer, notice or the like; around an article, an element of links only is a menu too.
Without an own template, a page that has an article has its text there alone.

Text rules: character references are decoded, white space inside a block is one space, blocks are trimmed and joined
by one line feed, empty ones go. Rules for input: null html is empty and gives an empty text; null urls are one host;
unclosed tags, comments and scripts end with the page; every row gives one row; repeated page ids count as pages.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import attach_groups, checkpoint, small_batches

HOST_PAGES, SUPPORT = 8, 0.5
#: Share and characters of a page's free text with which an element is never template.
HOLDS, LONG = 0.5, 200

# Element names of the HTML standard by how they are read, and names that mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - frozenset("caption head html body legend li option optgroup summary tbody td tfoot th thead title tr".split())
OWN_KIND = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
OTHER_ELEMENTS = frozenset(
    "head script style nav footer aside form noscript template iframe svg canvas object embed button select textarea input "
    "dialog menu title xmp noembed noframes map audio video".split()
)
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
OTHER_NAMES = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|banner|sponsor(?:ed|s)?|promo(?:tion|ted)?|sidebar|side-bar|menu|nav|navbar|navigation|"
    r"breadcrumbs?|masthead|header|topbar|footer|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|"
    r"social|related|recommended|recommendations|comments?|commentlist|disqus|respond|replies|reply|widget|toolbar|pagination|pager|skip|search|form|hidden|disclaimer|copyright|trending|popular)(?:$|[\s_\d-])"
)
COMMENT_NAMES = re.compile(r"(?i)(?:^|[\s_-])(?:comments?|commentlist|repl(?:y|ies))(?:$|[\s_\d-])")
#: Names that tell what a wrapper has beside the article, not what it is.
STATES = re.compile(r"(?i)(?:^|(?<=\s))(?:has|with|no|without|is|show|hide)[-_][\w-]+")
ARTICLE = frozenset(["article", "main"])
#: Blocks without names that can be template: anywhere, and outside articles.
CONTAINERS = frozenset("div section center".split())
LISTS = frozenset("ul ol dl table figure address details fieldset".split())
PAGE = frozenset("html body head".split()) | ARTICLE

MARKUP = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?](?:[^>]*>|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[^\s<>]+")


class Element:
    __slots__ = ("name", "role", "other", "article", "parent", "structural", "order", "size", "linked", "links", "out")

    def __init__(self, name: str, attributes: str, parent: Element | None) -> None:
        held = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
        names = f"{held.get('class', '')} {held.get('id', '')}".strip()
        self.name = name
        self.role = f"{parent.role if parent else ''}/{name}" + (f".{names}" if names and not any(c.isdigit() for c in names) else "")
        within = parent is not None and parent.article
        role = held.get("role", "").lower()
        own = name in OTHER_ELEMENTS or role in OTHER_ROLES or "hidden" in held or (name == "header" and not within)
        said = STATES.sub("", re.sub(r"([a-z])([A-Z])", r"\1-\2", names)) if name not in ("html", "body") else ""
        marked = bool(said) and bool((COMMENT_NAMES if name in ARTICLE else OTHER_NAMES).search(said))
        self.other = (parent is not None and parent.other) or own or marked
        self.article = within or ((name in ARTICLE or role == "main") and not self.other)
        block = name in BLOCK or "-" in name
        plain = name in CONTAINERS or "-" in name or (name in LISTS and not within)
        self.parent = parent
        self.structural = block and name not in PAGE and role != "main" and not self.other and (bool(names) or plain)
        # hash of the tokens so far; characters of free text, those of them in links, and number of links
        self.order, self.size, self.linked, self.links = xxhash.xxh64(), 0, 0, 0
        self.out = self.other


def parts(page: str) -> Iterator[tuple[str, Element | None, str]]:
    """("open" | "close" | "text", element, raw text) in page order."""
    stack: list[Element] = []

    def close(down_to: int) -> Iterator[tuple[str, Element | None, str]]:
        while len(stack) > down_to:
            yield "close", stack.pop(), ""

    at, size = 0, len(page)
    while at < size:
        found = MARKUP.search(page, at)
        begin = found.start() if found else size
        if begin > at:
            yield "text", stack[-1] if stack else None, page[at:begin]
        if not found:
            break
        at = found.end()
        name = (found[2] or found[6] or "").lower()
        if not name:
            continue
        if found[1] or found[5]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if depth is not None:
                yield from close(depth)
            continue
        if name in ENDS_PARAGRAPH:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == "p"), None)
            if depth is not None and not any(e.name in ("td", "th", "button", "object") for e in stack[depth:]):
                yield from close(depth)
        if name in OWN_KIND:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in OWN_KIND[name]:
                    break
                if stack[i].name == name or {stack[i].name, name} <= {"dt", "dd"} or {stack[i].name, name} <= {"td", "th"}:
                    yield from close(i)
                    break
        element = Element(name, found[3] or found[7] or "", stack[-1] if stack else None)
        yield "open", element, ""
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]|\Z", re.I).search(page, at)
            if end.start() > at:
                yield "text", element, page[at : end.start()]
            at = end.start()
            yield "close", element, ""
            stop = page.find(">", at)
            at = size if stop < 0 else stop + 1
        elif name in VOID or (found[3] or "").endswith("/") and name not in BLOCK:
            yield "close", element, ""
        else:
            stack.append(element)
    yield from close(0)


def _measured(page: str) -> tuple[list[tuple[str, Element | None, str]], list[Element], int, int]:
    """The parts of a page, its elements that hold free text, and size and hash of that text.

    Free text lies in no other part; an element's hash covers its tags and words in their order.
    """
    read, held, size, whole, anchors = list(parts(page)), [], 0, xxhash.xxh64(), 0
    for kind, element, raw in read:
        if kind == "text":
            if (element is None or not element.other) and (words := " ".join(raw.split())):
                size += len(words)
                whole.update(f"{words} ")
                if element is not None:
                    element.order.update(f"{words} ")
                    element.size += len(words)
                    element.linked += len(words) if anchors else 0
        elif kind == "open":
            anchors += element.name == "a"
        else:
            anchors -= element.name == "a"
            above = element.parent
            if not element.other and element.size:
                held.append(element)
            if above is not None and not element.other:
                above.order.update(f"<{element.name} {element.order.intdigest()}>")
                above.size += element.size
                above.linked += element.linked
                above.links += element.links + (element.name == "a")
    return read, held, size, whole.intdigest() >> 1


def _key(element: Element) -> int:
    return xxhash.xxh64_intdigest(f"{element.role}\0{element.order.intdigest()}") >> 1


def _may_be_template(element: Element, size: int) -> bool:
    return element.structural and not (element.size >= LONG and element.size > HOLDS * size)


def classes_of(page: str) -> tuple[set[int], int]:
    """The classes (63-bit hashes) that can be template, and the hash of the free text."""
    _, held, size, whole = _measured(page)
    return {_key(e) for e in held if _may_be_template(e, size)}, whole


def text_of(page: str, template: frozenset[int], own: bool = False) -> str:
    """The blocks of the slots that are the page's text; own says that the template is the host's own."""
    read, held_by, size, _ = _measured(page)
    articles = any(k == "open" and e.article for k, e, _ in read)
    for e in held_by:
        if e.structural and not e.out:
            menu = articles and not e.article and e.links > 1 and e.linked == e.size
            e.out = menu or (_may_be_template(e, size) and _key(e) in template)
    only_articles = articles and not own
    blocks, held = [], []

    def end() -> None:
        block = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if block:
            blocks.append(block)

    for kind, element, raw in read:
        if kind == "text":
            if element is None or not element.out:
                held.append(raw if not only_articles or (element is not None and element.article) else "")
        else:
            if kind == "open" and element.parent is not None and element.parent.out:
                element.out = True
            if element.name in BLOCK:
                end()
            elif element.name == "br":
                held.append(" ")
    end()
    return "\n".join(blocks)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, content, class): every page's free text with each of its classes, and once without one."""
    for batch in batches:
        held = set()
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            classes, content = classes_of(page.as_py() or "")
            held.update((host, content, c) for c in (None, *classes))
        columns = list(zip(*held, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["host", "content", "class"])


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)))


def templates(hosted: DataFrame) -> DataFrame:
    """(host, host_pages, own, template): the classes of every host's template, for hosted (host, html)."""
    rows = hosted.groupBy("host").agg(F.count("*").alias("host_pages"))
    contents = checkpoint(hosted.select("host", "html").mapInArrow(_contents, "host string, content long, class long").distinct())
    sizes = contents.where("class is null").groupBy("host").agg(F.count("*").alias("n"))
    sizes = checkpoint(rows.join(sizes, "host").withColumn("own", F.col("n") >= HOST_PAGES))
    by_class = contents.where("class is not null").groupBy("host", "class").agg(F.count("*").alias("pages")).where(F.col("pages") >= HOST_PAGES * SUPPORT)
    owned = by_class.join(sizes.where("own").select("host", "n"), "host")
    pooled = attach_groups(contents, sizes.select("host", "host_pages", "own"), "host", "host_pages").where("not own").select("content", "class").distinct()
    small = pooled.groupBy("class").agg(F.count("*").alias("pages"))
    small = checkpoint(small.where(F.col("pages") >= HOST_PAGES * SUPPORT))
    small_pages = small.where("class is null").select(F.col("pages").alias("n"))
    every = owned.select("host", "class", "pages", "n").unionByName(
        small.where("class is not null").select(F.lit(None).cast("string").alias("host"), "class", "pages").join(F.broadcast(small_pages))
    )
    valid = every.where(F.col("pages") >= F.col("n") * SUPPORT).groupBy("host").agg(F.array_sort(F.collect_list("class")).alias("template"))
    joined = sizes.withColumn("owner", F.when(F.col("own"), F.col("host"))).alias("s").join(valid.alias("v"), F.expr("s.owner <=> v.host"), "left")
    return joined.select("s.host", "s.host_pages", "s.own", F.coalesce("template", F.array().cast("array<bigint>")).alias("template"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    hosted = with_host(small_batches(pages).select("page_id", "url", "html"))
    ready = attach_groups(hosted, checkpoint(templates(hosted)), "host", "host_pages").select("page_id", "url", "html", "template", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, template = None, frozenset()
        for batch in batches:
            made = []
            for page, classes, own in zip(batch.column("html"), batch.column("template"), batch.column("own"), strict=True):
                here = classes.values.to_numpy().tobytes()
                if here != last:
                    last, template = here, frozenset(np.frombuffer(here, np.int64).tolist())
                made.append(text_of(page.as_py() or "", template, own.as_py()))
            arrays = [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    return ready.mapInArrow(run, "page_id long, url string, text string, n_chars long")
