"""Main text of web pages: site template removal.

One light parser walks a page's tags.  Elements that are page furniture by
their tag, role or class go.  Every other subtree with text is hashed (tag,
attributes that shape it, and text), inside articles too; Spark counts, per
host, on how many different pages each subtree occurs; subtrees found on
many pages of a host are that site's template and are deleted.  Inside an
article the bar is higher and only boxes and paragraphs count: headings,
list items, cells and words within a sentence recur in real text.

What remains is read block by block.  <article> and <main> are a hint: when
they hold half of the text or more, other blocks stay only if they read
like text (a main heading, or some length and few links); else all stay.

Defined cases: null or empty html gives the empty text; a null or
unparsable url belongs to the empty host; unclosed, misnested and truncated
markup is read as browsers do in the common cases (a block start closes an
open paragraph); equal pages count once, so copies make no template;
repeated rows give equal results; pages of any length are read whole.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.staging import Stage

MIN_PAGES = 3           # a template subtree is on this many different pages of its host at least,
MIN_SHARE = 0.1         # and on this share of them or on HOT_PAGES;
HOT_PAGES = 1000
MAIN_PAGES = 4          # inside main content on so many at least
MAIN_SHARE = 0.25       # and on this share or on HOT_PAGES
PROSE_CHARS = 40        # a block of text outside main content has so many characters
LINK_SHARE = 1 / 3      # and no larger part of them in links

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
                  r"|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul option caption".split())
_DROP = frozenset(
    "head script style noscript template iframe title textarea nav footer aside form menu button select dialog svg canvas "
    "object embed audio video map datalist".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
# whole class names and ids: a name, perhaps with a place before it and a kind of box after it
_COMMENT_NAMES = r"comments?|commentlist|comment-body|comment-content|comment-text|disqus|replies|reply|respond"
_DROP_NAMES = re.compile(
    r"(?:(?:site|page|main|top|bottom|left|right|primary|secondary|global|post|social)[-_])?"
    rf"(?:{_COMMENT_NAMES}|ads?|advert(?:s|isements?|ising)?|sponsor(?:s|ed)?|promo(?:s|tions?)?|banners?|cookies?|consent|notice|gdpr|"
    r"popup|modal|overlay|newsletter|subscri(?:be|ption)|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|pagination|"
    r"footer|masthead|site-header|share|sharing|social|related(?:[-_](?:posts|articles|links))?|recommended|widgets?|toolbar|"
    r"skip-link)(?:[-_](?:box|bar|area|list|links?|container|wrapper|wrap|block|section|buttons?|icons?|form|thread|banner|notice|"
    r"consent|slot|unit|widget|signup|\d+))*")
_COMMENT = re.compile(rf"(?:{_COMMENT_NAMES})(?:[-_](?:box|area|list|container|wrapper|section|thread|\d+))*")
_NO_NAMES = frozenset("html body article main p h1 h2 h3 h4 h5 h6".split())
_MAY_WRAP = frozenset("form header dialog".split())     # furniture by tag that may hold the main content, as named elements may
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
              "th": ("td", "th"), "option": ("option",)}
_STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"),
          "th": ("table", "tr"), "option": ("select",)}


# recur in real text, so inside main content they go only with the box that holds them
_PARTS = frozenset("h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption option summary figcaption body".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "main", "drop")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.kids, self.main, self.drop = tag, attrs, [], False, False


def _named_furniture(attrs: str, names: re.Pattern | None = _DROP_NAMES) -> bool:
    for name, value in _ATTR.findall(attrs):
        name = name.lower()
        value = value.strip("\"'").lower()
        if (name in ("class", "id") and names and any(map(names.fullmatch, value.split()))) \
                or (name == "role" and value in _DROP_ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
    return False


def _comment(attrs: str) -> bool:
    return any(_COMMENT.fullmatch(x) for name, value in _ATTR.findall(attrs) if name.lower() in ("class", "id")
               for x in value.strip("\"'").lower().split())


def parse(text: str) -> Node:
    """A tree of nodes and strings."""
    root = Node("#root", "")
    stack = [root]
    at, n = 0, len(text)
    while at < n:
        m = _TAG.search(text, at)
        if m is None:
            stack[-1].kids.append(text[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(text[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, attrs = tag.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in _BLOCK:
            for i in range(len(stack) - 1, 0, -1):      # a block start closes an open paragraph
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in _BLOCK:
                    break
        if tag in _CLOSED_BY:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _STOPS[tag]:
                    break
                if stack[i].tag in _CLOSED_BY[tag]:
                    del stack[i:]
                    break
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(text, at)
            at = end.end() if end else n
        elif tag not in _VOID and not attrs.endswith("/"):
            stack.append(node)
    return root


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """(node, leaving) in document order, without recursion."""
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        yield node, leaving
        if not leaving:
            todo.append((node, True))
            todo.extend((k, False) for k in reversed(node.kids) if isinstance(k, Node))


def mark(root: Node) -> bool:
    """Flag furniture, and the nodes that are or hold main content.  True if the page has any.

    Where every article lies in furniture that may be a wrapper, and the
    articles hold more text than the page outside furniture, the wrappers
    around those in the fewest are none; so is, without articles, a form
    that holds more text than all outside furniture."""
    around: list[Node] = []                     # furniture around the node, outermost first
    open_ = [0]                                 # articles open within each of them
    chars: dict[int, int] = {0: 0}              # text by innermost furniture (0: none), and the part of it in articles
    in_articles: dict[int, int] = {0: 0}
    found: list[tuple[Node, list[Node]]] = []
    comments: dict[int, Node] = {}
    forms: list[Node] = []
    for node, leaving in _walk(root):
        article = node.tag in ("article", "main")
        if leaving:
            if node.drop:
                around.pop()
                open_.pop()
            elif article and id(node) not in comments:
                open_[-1] -= 1
            continue
        node.drop = (node.tag in _DROP or (node.tag == "header" and not any(open_))
                     or (bool(node.attrs) and node.tag not in ("html", "body", "article", "main")
                         and _named_furniture(node.attrs, None if node.tag in _NO_NAMES else _DROP_NAMES)))
        if article and node.attrs and _comment(node.attrs):
            node.drop = any(open_)              # a reader's comment within an article
            if not node.drop:
                comments[id(node)] = node
        if node.drop:
            if node.tag == "form" and not around:
                forms.append(node)
            around.append(node)
            open_.append(0)
        elif article and id(node) not in comments:
            found.append((node, list(around)))
            open_[-1] += 1
        own = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        if own:
            at = id(around[-1]) if around else 0
            chars[at] = chars.get(at, 0) + own
            if open_[-1]:
                in_articles[at] = in_articles.get(at, 0) + own
    if found:
        for node in comments.values():          # comments beside the articles
            node.drop = True
    else:
        found = [(node, []) for node in comments.values()]
    free = [node for node, over in found if not over]
    if not free:
        wrapped = [(node, over) for node, over in found if all(o.tag in _MAY_WRAP or o.tag not in _DROP for o in over)]
        least = min((len(over) for _, over in wrapped), default=0)
        wrapped = [(node, over) for node, over in wrapped if len(over) == least]
        if sum(in_articles.get(x, 0) for x in {id(over[-1]) for _, over in wrapped}) > chars[0]:
            free = [node for node, _ in wrapped]
            for _, over in wrapped:
                for o in over:
                    o.drop = False
    if not free:
        for node in forms:
            node.drop = chars.get(id(node), 0) <= chars[0]
    for node in free:
        node.main = True
    for node, leaving in _walk(root):
        if leaving:
            node.main = node.main or any(isinstance(k, Node) and k.main for k in node.kids)
    return bool(free)


def digests(root: Node) -> dict[int, int]:
    """64-bit hash of each subtree that may be template, by id(node): it has
    text, is or lies in no furniture, holds no main content, and is no part of
    a sentence.  Odd hashes are of subtrees inside main content."""
    out: dict[int, int] = {}
    every: dict[int, int] = {}
    skip = inside = 0
    above: list[Node] = []
    for node, leaving in _walk(root):
        own = node.main and node.tag in ("article", "main")
        if not leaving:
            skip += node.drop
            inside += own
            above.append(node)
            continue
        above.pop()
        skip -= node.drop
        inside -= own
        if skip or node.drop or node.main or node.tag in ("#root", "html", "body", "head") or node.tag in _RAW:
            continue
        text = False
        h = hashlib.blake2b(node.tag.encode(), digest_size=8)
        h.update(" ".join(node.attrs.split()).encode("utf-8", "surrogatepass"))
        for k in node.kids:
            part = " ".join(k.split()) if isinstance(k, str) else str(every.get(id(k), k.tag))
            text = text or (bool(part) if isinstance(k, str) else id(k) in every)
            h.update(b"\0" + part.encode("utf-8", "surrogatepass"))
        if not text:
            continue
        every[id(node)] = x = int.from_bytes(h.digest(), "little", signed=True) & ~1 | bool(inside)
        if node.tag in _BLOCK:
            count = not (inside and node.tag in _PARTS)
        else:
            # an inline element counts alone only outside main content and beside no words
            count = not inside and not any(isinstance(k, str) and k.strip() for k in above[-1].kids)
        if count:
            out[id(node)] = x
    return out


def main_text(html: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's text: blocks in page order, joined by an empty line."""
    root = parse(html)
    has_main = mark(root)
    hashed = digests(root) if template else {}
    blocks: list[tuple[str, bool, bool]] = []           # text, in main content, reads like text
    line: list[str] = []
    keeping = links = linked = title = 0

    def flush() -> None:
        nonlocal linked
        block = " ".join("".join(line).split())
        if block:
            blocks.append((block, keeping > 0, title > 0 or (len(block) >= PROSE_CHARS and linked <= LINK_SHARE * len(block))))
        line.clear()
        linked = 0

    todo: list[Node | str | tuple[Node]] = [root]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            line.append(_html.unescape(item) if "&" in item else item)
            linked += len(item.strip()) if links else 0
            continue
        if isinstance(item, tuple):
            node = item[0]
            if node.tag in _BLOCK:
                flush()
            keeping -= node.tag in ("article", "main")
            links -= node.tag == "a"
            title -= node.tag == "h1"
            continue
        if item.drop or hashed.get(id(item)) in template:
            if item.tag in _BLOCK:
                flush()
            continue
        if item.tag in _BLOCK:
            flush()
        if item.tag == "br":
            line.append(" ")
        keeping += item.tag in ("article", "main")
        links += item.tag == "a"
        title += item.tag == "h1"
        todo.append((item,))
        todo.extend(reversed(item.kids))
    flush()
    if has_main and 2 * sum(len(t) for t, main, _ in blocks if main) >= sum(len(t) for t, _, _ in blocks):
        blocks = [b for b in blocks if b[1] or b[2]]
    return "\n\n".join(t for t, _, _ in blocks)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, stage: Stage, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
              hot_pages: int = HOT_PAGES, main_pages: int = MAIN_PAGES, main_share: float = MAIN_SHARE) -> DataFrame:
    """(site, page, subtrees) for rows (site, page, html): hashes of those of
    the page's subtrees that are on many different pages of its site; pages
    without any have no row.  The lists are made page by page, so they are
    bounded by the page and not by what recurs anywhere on a large site."""
    schema = "site long, page long, subtree long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple[int, int, int]] = set()
            for site, page, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                root = parse(text)
                mark(root)
                # 0 stands for the page itself
                rows.update((site, page, x) for x in (0, *digests(root).values()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["site", "page", "subtree"])

    seen = stage.write(pages.mapInArrow(run, schema).distinct(), "seen")
    counts = seen.groupBy("site", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min(min_pages, main_pages))
    total = counts.where("subtree = 0").select("site", F.col("n").alias("pages"))
    inside = (F.col("subtree").bitwiseAND(1)) == 1
    bar = F.when(inside, F.greatest(F.lit(main_pages), F.least(F.col("pages") * main_share, F.lit(hot_pages)))).otherwise(
        F.greatest(F.lit(min_pages), F.least(F.col("pages") * min_share, F.lit(hot_pages))))
    recurring = stage.write(counts.where("subtree <> 0").join(total, "site").where(F.col("n") >= bar)
                            .select("site", "subtree"), "recurring")
    # Written before and after, so that the joins have no aggregation in their stages and adaptive execution may split
    # a subtree that is on very many pages, and a page that is there very many times.
    met = stage.write(seen.join(recurring, ["site", "subtree"], "left_semi"), "met")
    lists = stage.write(met.groupBy("site", "page").agg(F.collect_list("subtree").alias("subtrees")), "templates")
    stage.release("seen", "recurring", "met")
    return lists


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", html: str = "html",
            **how) -> DataFrame:
    """``keep`` columns, text and n_chars of every page."""
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()),
                                                             T.StructField("n_chars", T.LongType())])
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(text or "", frozenset(t or ())) for text, t in
                   zip(batch.column(n_keep).to_pylist(), batch.column(n_keep + 1).to_pylist())]
            cols = [batch.column(i) for i in range(n_keep)]
            cols += [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    site, page = F.xxhash64(host(pages[url])), F.xxhash64(F.coalesce(pages[html], F.lit("")))
    rows = pages.select(site.alias("site"), page.alias("page"), F.coalesce(pages[html], F.lit("")).alias("html"))
    lists = templates(rows, Stage(pages.sparkSession, "templates"), **how)
    return (pages.select(*[pages[c].alias(f"k{i}") for i, c in enumerate(keep)], pages[html].alias("page_html"),
                         site.alias("site"), page.alias("page"))
            .join(lists, ["site", "page"], "left")
            .select(*[f"k{i}" for i in range(n_keep)], "page_html", "subtrees")
            .mapInArrow(run, schema))
