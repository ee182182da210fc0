"""Main text of web pages by tree scoring.

The markup is read into a tree.  Subtrees that are no article text by their element,
role, class or id (menus, headers, footers, sidebars, notices, adverts, forms,
comments, scripts, styles, hidden parts) are left out.  A form, and an element with a layout word (a sidebar, sharing,
adverts) in its class or id, is in doubt: it stays if it holds an article or main element, or two thirds of the
page's text outside links; a half is enough for a form, or beside a word of article bodies.  A word with its state behind it (`share-enabled`, `ad-free`) says nothing.  If no text is left, layout words alone
leave nothing out, and what then scores is kept.  Every block of text passes
points for itself, its length and its commas to its ancestors, fully to the
nearest container, half to the next, less to those above; points are discounted by the share
of linked text.  The container with most points leads to what is kept.  Inside an article
element the whole outermost article is kept.  Inside a main element, or an element marked as body by
its class, id or role, all under that element is kept but for containers on the way up whose text is to a
quarter links.  Of the siblings of what is kept its headings and paragraphs stay, and containers that score
like a paragraph, or, beside an article or main, like a fifth of it.  The text is that of all kept blocks.

Inside a block white space becomes one space; blocks are joined in page order by one
space.  A line break counts as white space.  Nothing inside a kept container is
dropped for being short, long or linked.

Each page is read whole by one call, in one scan without a shuffle. The work grows in proportion
to the page, however deep its elements lie and however many tags and quotes stay open.
Of containers with equal points the first leads.

Defined results.  Null and empty pages and pages without text give the empty string.
Where no container scores, all text outside left-out parts is kept, but nothing of what only layout words had left out.  Text without
markup is kept whole.  Unclosed, unopened and crossing tags are accepted: a close tag
closes the innermost open element of its name, a new block closes an open paragraph,
the end of the page closes all.  Repeated rows are extracted each.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|noframes|noembed|xmp)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)",
    re.S | re.I,
)
#: The rest of a tag up to its end; a quoted value may hold any character.
TAG_REST = re.compile(r"""((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Fixed values of the HTML standard: elements that stay inside a line, and elements without content.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, roles and words of classes and ids that mark no article text.
LEFT_OUT = frozenset("head nav header footer aside menu dialog button select option fieldset svg math canvas audio video object applet".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
LEFT_OUT_WORDS = frozenset(
    "breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer foot gdpr login masthead menu menus modal nav navbar navigation "
    "overlay pager pagination popup replies reply respond signup skip".split()
)
#: Words that also stand on wrappers of articles, for what lies beside the text.
LAYOUT_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner banners header hidden newsletter notice notices notification promo promotion recommended related "
    "share sharing sidebar sidebars social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split()
)
BODY_WORDS = frozenset("article body content entry main page post story text".split())
LAYOUT_WORDS = frozenset("has no with without".split())
STATE_WORDS = frozenset("closed disabled enabled free off on open".split())
NEVER_LEFT_OUT = frozenset("html body main article".split())
#: What an element or a word of its class is worth before any text is seen.
PRIOR = {"article": 25.0, "main": 15.0, "div": 2.0, "section": 2.0, "td": 1.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "table": -3.0, "tr": -3.0, "tbody": -3.0, "blockquote": -2.0, "body": -5.0, "html": -10.0}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd dt figcaption address summary".split()) | HEADINGS
CLOSES_LIKE = {"li": ("li", frozenset(("ul", "ol"))), "dt": ("dt dd", frozenset(("dl",))), "dd": ("dt dd", frozenset(("dl",))), "tr": ("tr td th", frozenset(("table",))), "td": ("td th", frozenset(("tr", "table"))), "th": ("td th", frozenset(("tr", "table"))), "option": ("option", frozenset(("select",)))}
SIBLING_SHARE, LINKED_SHARE = 0.2, 0.5
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


#: Why an element may be left out: it is in doubt, a layout word says so, or it always is.
DOUBT, LAYOUT, ALWAYS = 1, 2, 3
#: The share of the page's text outside links with which an element stays all the same.
HELD_SHARE = {DOUBT: 1 / 2, LAYOUT: 2 / 3}


class _Node:
    __slots__ = ("tag", "parent", "out", "why", "score", "length", "linked", "order", "kept", "marked", "holds")

    def __init__(self, tag: str, parent: _Node | None, out: bool, score: float, order: int, why: int = 0, holds: bool = False):
        self.tag, self.parent, self.out, self.score, self.order, self.why, self.holds = tag, parent, out, score, order, why, holds
        self.length = self.linked = 0
        self.kept = False
        self.marked = tag == "main" or score - PRIOR.get(tag, 0.0) >= 10.0  # as body, by element, class, id or role


def _word_kinds(value: str) -> tuple[bool, bool, bool]:
    """Whether a class or id has a word that leaves out, a layout word, and a body word."""
    never = layout = good = False
    for one in value.split():
        words = [w.lower() for w in _WORD.findall(one)]
        told = [w for k, w in enumerate(words) if not (k and words[k - 1] in LAYOUT_WORDS) and not (k + 1 < len(words) and words[k + 1] in STATE_WORDS)]
        body = any(w in BODY_WORDS for w in words)
        if not (body and words[-1] == "header"):  # an article's own header has its title
            bad, beside = any(w in LEFT_OUT_WORDS for w in told), any(w in LAYOUT_PARTS for w in told)
            never, layout = never or bad, layout or beside
            good = good or (body and not bad)
    return never, layout, good


def _judge(tag: str, attributes: str) -> tuple[int, float, bool, bool]:
    """(why it may be left out, prior points, whether it is a link, whether it is an article or main element by all it says)."""
    why, prior, whole = ALWAYS if tag in LEFT_OUT else DOUBT if tag == "form" else 0, PRIOR.get(tag, 0.0), tag in ("article", "main")
    if not attributes or attributes.isspace() or attributes == "/":
        return why, prior, tag == "a", whole
    never = layout = good = False
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = values[0] or values[1] or values[2]
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            why = ALWAYS
        elif name == "role":
            why = ALWAYS if value.lower() in LEFT_OUT_ROLES else why
            if value.lower() in ("main", "article"):
                prior, whole = prior + 15.0, True
        elif name in ("class", "id"):
            n, p, g = _word_kinds(value)
            never, layout, good = never or n, layout or p, good or g
    if tag in NEVER_LEFT_OUT:
        return 0, prior, False, whole and not never
    if never:
        why = ALWAYS
    elif layout:
        why = max(why, DOUBT if good else LAYOUT)
    elif good:
        prior += 10.0
    return why, prior, tag == "a", whole and not (never or layout)


def _tag_ends(html: str) -> list[int]:
    """For each position where the tag ends that is open there outside of quotes, -1 without an end; one pass from the right."""
    out = [-1] * (len(html) + 1)
    plain = double = single = -1
    for k in range(len(html) - 1, -1, -1):
        c = html[k]
        plain, double, single = (
            k if c == ">" else double if c == '"' else single if c == "'" else plain,
            plain if c == '"' else double,
            plain if c == "'" else single,
        )
        out[k] = plain
    return out


def _tokens(html: str) -> Iterator[tuple[int, int, str | None, str | None, bool, str]]:
    """(start, stop, element skipped with its content, tag, whether it closes, attributes); what lies between tokens is text."""
    ends: list[int] | None = None
    at = 0
    while m := TOKEN.search(html, at):
        at = m.end()
        if m[3] is None:
            yield m.start(), at, m[1], None, False, ""
            continue
        if ends is None:
            if rest := TAG_REST.match(html, at):
                stop = rest.end() - 1
            else:  # from here on no tag is looked for twice
                ends = _tag_ends(html)
                stop = -1
        else:
            stop = ends[at]
        if stop >= 0:  # a tag without an end is text
            yield m.start(), stop + 1, None, m[3], bool(m[2]), html[at:stop]
            at = stop + 1


class _Stack:
    """The open elements, and where those of each name lie."""

    def __init__(self, root: _Node):
        self.items, self.places = [root], defaultdict(list)

    def top(self) -> _Node:
        return self.items[-1]

    def push(self, node: _Node) -> None:
        self.places[node.tag].append(len(self.items))
        self.items.append(node)

    def cut(self, k: int) -> None:
        """Close all from place k on."""
        for node in self.items[k:]:
            self.places[node.tag].pop()
        del self.items[k:]

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost element of these names, 0 without one."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)


def _read(html: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """The block elements in page order, and the blocks of text that are not always left out, with their element and linked characters."""
    root = _Node("html", None, False, PRIOR["html"], 0)
    nodes, blocks, stack = [root], [], _Stack(root)
    pieces: list[str] = []
    linked = [0]  # characters of links in the open block
    links = 0

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                node = stack.top()
                while node.tag in INLINE and node.parent is not None:
                    node = node.parent
                blocks.append((node, text, min(len(text), linked[0])))
        linked[0] = 0

    def say(raw: str) -> None:
        if not stack.top().out and raw:
            text = unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                linked[0] += len(text)

    at = 0
    for start, stop, skipped, name, closes, attributes in _tokens(html):
        if start > at:
            say(html[at:start])
        at = stop
        if name is None:
            if skipped is not None and skipped.lower() in ("iframe", "noscript", "textarea"):
                pieces.append(" ")
            continue
        tag = name.lower()
        if tag == "br" or tag == "hr" or tag == "wbr":
            if not stack.top().out:
                pieces.append("" if tag == "wbr" else " ")
            if tag == "hr":
                flush()
            continue
        if tag in VOID:
            continue
        inline = tag in INLINE
        if closes:
            if tag == "a":
                links = max(0, links - 1)
            if k := stack.last((tag,)):
                if not inline or any(n.tag not in INLINE for n in stack.items[k:]):
                    flush()
                stack.cut(k)
            continue
        why, prior, link, holds = _judge(tag, attributes)
        links += link
        if inline:
            if why and not stack.top().out:  # kept on the stack only to find its end
                stack.push(_Node(tag, stack.top(), True, 0.0, 0))
            elif stack.top().out and stack.top().tag == tag:
                stack.push(_Node(tag, stack.top(), True, 0.0, 0))
            continue
        flush()
        links = 0
        if tag == "header" and why and not attributes.strip() and stack.last(("article", "main")):
            why = 0  # an article's own header has its title
        while len(stack.items) > 1 and stack.top().tag in INLINE and not stack.top().out:
            stack.cut(len(stack.items) - 1)
        if len(stack.items) > 1 and (stack.top().tag == "p" or (stack.top().tag in HEADINGS and tag in HEADINGS | {"p"})):
            stack.cut(len(stack.items) - 1)
        if tag in CLOSES_LIKE:
            like, scope = CLOSES_LIKE[tag]
            if (k := stack.last(like.split())) > stack.last(scope):
                stack.cut(k)
        if tag == "html" or (tag == "body" and stack.top().tag in ("html", "head")):
            stack.cut(1)
            if tag == "html":
                continue
        node = _Node(tag, stack.top(), why == ALWAYS or stack.top().out, prior, len(nodes), why, holds)
        nodes.append(node)
        stack.push(node)
    if at < len(html):
        say(html[at:])
    flush()
    return nodes, blocks


def _leave_out(nodes: list[_Node], blocks: list[tuple[_Node, str, int]], words: bool) -> None:
    """Mark what is left out: elements in doubt or, with words, with a layout word, that hold no article and too little of the text outside links."""
    own: dict[int, int] = defaultdict(int)
    for node, text, linked in blocks:
        own[id(node)] += len(text) - linked if linked <= LINKED_SHARE * len(text) else 0
    total, holds = sum(own.values()), {id(n) for n in nodes if n.holds and not n.out}
    for n in reversed(nodes):  # parents stand before their children
        if n.parent is not None:
            own[id(n.parent)] += own[id(n)]
            if id(n) in holds:
                holds.add(id(n.parent))
    for n in nodes[1:]:
        share = HELD_SHARE.get(n.why, 0.0) if words or n.why == DOUBT else 0.0
        n.out = n.out or n.parent.out or (share > 0 and id(n) not in holds and (own[id(n)] < share * total or not total))


def _scored(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> list[tuple[_Node, str]]:
    """Points and lengths of the blocks that are not left out; these blocks."""
    inside = [b for b in blocks if not b[0].out]
    for node, text, linked in inside:
        _pass_points(node, text, linked)
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.length += n.length
            n.parent.linked += n.linked
    return [(node, text) for node, text, _ in inside]


def _pass_points(node: _Node, text: str, linked: int) -> None:
    """Give a block's points to the ancestors and its length to its element."""
    heading = node.tag in HEADINGS
    points = 0.5 if heading else 1.0 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3.0)
    points *= 1 - linked / len(text)
    target = node.parent if node.tag in PARAGRAPHS and node.parent is not None else node
    share = 1.0
    node.length += len(text)
    node.linked += linked
    level = 1
    while target is not None and level < 7:
        target.score += points * share
        level += 1
        share = 1 / 2 if level == 2 else 1 / (2 * level)
        target = target.parent


def _home(best: _Node, nodes: list[_Node]) -> tuple[_Node, set[_Node]]:
    """The element that is kept for the best container, and those between them, of which all but link-dense children are kept."""
    line = [best]
    while line[-1].parent is not None:
        line.append(line[-1].parent)
    articles = [n for n in line if n.tag == "article"]
    if articles:
        return articles[-1], set()
    mains = [k for k, n in enumerate(line) if n.tag == "main"]
    marked = mains[-1:] or [k for k, n in enumerate(line) if n.marked][:1]
    if not marked or not marked[0]:
        return best, set()
    path = set(line[1 : marked[0] + 1])
    best.kept = True
    for n in nodes:
        if n.parent in path and n not in path and n is not best and n.length and not n.out:
            n.kept = n.tag in PARAGRAPHS or n.linked <= LINKED_SHARE * n.length / 2
    return line[marked[0]], path


def main_text(html: str | None) -> str:
    """The main text of one page."""
    nodes, read = _read(html or "")
    _leave_out(nodes, read, words=True)
    blocks, whole = _scored(nodes, read), True
    if not blocks and read:
        nodes, read = _read(html or "")
        _leave_out(nodes, read, words=False)
        blocks, whole = _scored(nodes, read), False
    if not blocks:
        return ""

    def worth(n: _Node) -> float:
        return n.score * (1 - n.linked / n.length) if n.length else 0.0

    best = max((n for n in nodes if n.tag not in PARAGRAPHS and n.length and not n.out), key=lambda n: (worth(n), -n.order), default=None)
    if best is None or worth(best) <= 0 or (not whole and best.linked > LINKED_SHARE * best.length):
        return " ".join(t for _, t in blocks) if whole else ""
    best, path = _home(best, nodes)
    best.kept = not path
    least = max(3.0, SIBLING_SHARE * worth(best)) if best.tag in ("article", "main") else 3.0
    for n in nodes:
        if n.parent is best.parent and n is not best and n.length and not n.out:
            few_links = n.linked <= LINKED_SHARE * n.length / 2
            if n.tag in HEADINGS or n.tag == "p":
                n.kept = few_links
            else:
                n.kept = worth(n) >= least and few_links
    for n in nodes:  # parents stand before their children
        n.kept = n.kept or (n.parent is not None and n.parent.kept)
    return " ".join(text for node, text in blocks if node in path or node.kept)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): the main text of every page."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")
