"""Main text of HTML pages by tree scoring.

A page becomes a tree; elements that are or are named as boilerplate are cut, unless they hold most of a page that has no article
beside them; each paragraph passes points for its length and its
commas to its ancestors, discounted by the share of its text that links hold; the container with the most points and those of
its siblings that look like parts of the same article are kept, block by block in page order. A name that only has a word
of boilerplate in it costs points, and the element goes if it loses: if it has less than half of the points of what is kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import bounded_batches

#: Elements by their part in a page (HTML living standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CUT = frozenset(
    "script style noscript template head title nav footer aside form button select textarea input iframe svg math canvas "
    "object embed menu dialog audio video map datalist noembed noframes fieldset".split()
)
#: Of these, the ones that can lie around a whole page.
AROUND = frozenset("form fieldset".split())
BLOCK = frozenset(
    "html body address article blockquote center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr li main nav ol p pre section summary table caption thead tbody tfoot tr td th ul aside menu dialog".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a paragraph and are no container of their own.
LEAVES = HEADINGS | frozenset("p li td th tr dt dd pre blockquote figcaption caption address summary".split())
#: A start tag on the left ends an open element on the right.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: Words in class, id and role that name what is not the article, and the ones that name the article.
BOILERPLATE = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices newsletter subscribe subscription signup popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead comment comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations "
    "widget pagination pager toolbar copyright disclaimer outbrain taboola skip login search alert complementary contentinfo".split()
)
ARTICLE = frozenset("article content main post entry story body text blog page".split())
#: Words of boilerplate that always are it, however much text they hold; and some that are also what an article can be about.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
TOPICS = frozenset("share sharing social related search alert notice notices copyright banner skip login reply discussion menu ad ads".split())
#: Words that say nothing beside a word of boilerplate: such a name is boilerplate, one with any other word may be.
NEUTRAL = ARTICLE | frozenset(
    "site section container wrapper wrap box area block list items item inner outer top bottom left right col column row panel bar header head "
    "title global primary secondary posts articles entries view module region group links link buttons button icons icon form the a".split()
)
#: What follows these in a name describes the layout or says what is absent.
NOT_NAMES = frozenset("has with no is without".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A quote opens a value only after "="; one that is never closed is part of an unquoted value.
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)>?""", re.S)
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Node:
    __slots__ = ("block", "children", "cut", "doubted", "open", "parent", "points", "score", "softly", "tag", "tall", "within")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False, tall: bool = False, doubtful: bool = False, soft: bool = False):
        self.tag, self.parent, self.cut, self.tall, self.score, self.points = tag, parent, cut, tall, 0.0, 0.0
        self.children: list[Node | str] = []
        self.block: Node = self if parent is None or tag in BLOCK else parent.block
        #: The nearest element, itself included, whose name raises a doubt.
        self.doubted: Node | None = self if doubtful else parent and parent.doubted
        #: The nearest element, itself included, that is cut only if something else holds the article; and whether one named like an article is around.
        self.softly: Node | None = self if soft else parent and parent.softly
        self.within: bool = tall or bool(parent and parent.within)
        #: Of a block, how many inline elements of each kind are open in it.
        self.open: dict[str, int] = {} if self.block is self else self.block.open


def named(attributes: dict[str, str], tag: str, within: bool) -> tuple[bool, bool, bool, bool]:
    """Whether class, id or role name boilerplate, name comments, have a word of boilerplate, and name the article.

    Ids of headings, and of sections in an article, are made from their titles and don't count. In an article a word that it can be
    about raises no doubt beside words of other kinds, nor does the name of a paragraph.
    """
    bad = comments = doubtful = good = False
    titled = tag in HEADINGS or (within and tag == "section")
    for name in f"{attributes.get('class', '')} {'' if titled else attributes.get('id', '')} {attributes.get('role', '')}".split():
        parts = [p.lower() for p in NAME_PARTS.findall(name)]
        parts = parts[: next((i for i, p in enumerate(parts) if p in NOT_NAMES), None)]
        if not BOILERPLATE.isdisjoint(parts):
            sure = all(p in BOILERPLATE or p in NEUTRAL for p in parts)
            bad |= sure
            comments |= sure and not COMMENTS.isdisjoint(parts)
            doubtful |= not sure and not (within and (tag in LEAVES or all(p in TOPICS or p not in BOILERPLATE for p in parts)))
        elif not ARTICLE.isdisjoint(parts):
            good = True
    return bad, comments, doubtful, good


def parsed(page: str, trusting: bool = False) -> tuple[Node, bool]:
    """The tree of a page, with the end tags that HTML lets authors leave out, and whether names cut any of it; what is open ends with it.

    Counts of what is open save the walk up the tree for an end tag that ends nothing. ``trusting``: names raise doubts only.
    """
    root = at = Node("#root", None)
    blocks: dict[str, int] = {}
    place, doubts, softs = 0, False, False

    def close(node: Node) -> None:
        """End a node and all in it."""
        nonlocal at
        while True:
            (blocks if at.block is at else at.open)[at.tag] -= 1
            last, at = at, at.parent
            if last is node:
                return

    while place < len(page):
        token = TOKEN.search(page, place)
        if token is None:
            at.children.append(page[place:])
            break
        if token.start() > place:
            at.children.append(page[place : token.start()])
        place = token.end()
        if not (tag := token[2]):
            continue
        tag = tag.lower()
        if token[1]:
            if (blocks if tag in BLOCK else at.open).get(tag):
                node = at
                while node.tag != tag:
                    node = node.parent
                close(node)
            continue
        if tag in BLOCK and at.block.tag == "p":  # ends a paragraph that is open
            close(at.block)
        if tag in ENDS and any(blocks.get(t) or at.open.get(t) for t in ENDS[tag]):
            node = at
            while node.parent and node.tag not in ENDS[tag] and node.tag not in FENCE[tag]:
                node = node.parent
            if node.tag in ENDS[tag]:
                close(node)
                if tag == "tr" and at.tag == "tr":
                    close(at)
        if tag == "br":
            at.children.append(" ")
        if tag in VOID:
            continue
        attributes = {} if not token[3] else {k.lower(): html.unescape(v[1:-1] if v[:1] in ("'", '"') and v[-1:] == v[:1] else v) for k, v in ATTRIBUTE.findall(token[3])}
        bad, comments, doubtful, good = named(attributes, tag, at.within) if attributes else (False, False, False, False)
        if tag in ("html", "body", "main"):
            bad = doubtful = False
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(HIDDEN.search(attributes.get("style", "")))
        # A header heads the page, unless it lies in the article itself.
        heads = tag == "header" and not blocks.get("article") and not blocks.get("main")
        doubts |= bad
        soft = not hidden and not comments and ((bad and not trusting and not heads and tag not in CUT) or tag in AROUND)
        cut = not soft and ((bad and not trusting) or hidden or heads or tag in CUT)
        node = Node(tag, at, cut, good or tag in ("article", "main"), doubtful or (bad and trusting), soft)
        softs |= soft
        at.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*/?>", re.I).search(page, place)
            node.children.append(page[place : end.start() if end else len(page)])
            place = end.end() if end else len(page)
        elif not token[0].endswith("/>"):
            at = node
            counts = blocks if node.block is node else node.open
            counts[tag] = counts.get(tag, 0) + 1
    if softs:
        settle(root)
    return root, doubts


class Block:
    """A run of text that no block element breaks: its container, its text and how much of it links hold."""

    __slots__ = ("linked", "node", "parts", "points", "text")

    def __init__(self, node: Node):
        self.node, self.parts, self.linked, self.text, self.points = node, [], 0, "", 0.0


def blocks(root: Node) -> list[Block]:
    out, stack, new = [], [(root, iter(root.children), False)], True
    while stack:
        node, rest, link = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            new |= node.tag in BLOCK
        elif isinstance(child, str):
            if new or not out:
                out.append(Block(node.block))
                new = False
            out[-1].parts.append(child)
            out[-1].linked += link and len("".join(child.split()))
        elif not child.cut:
            new |= child.tag in BLOCK
            stack.append((child, iter(child.children), link or child.tag == "a"))
        else:
            new |= child.tag in BLOCK
    for block in out:
        block.text = " ".join(html.unescape("".join(block.parts)).split())
    return [b for b in out if b.text]


def points_of(block: Block) -> float:
    """1, 1 for each comma, and 1 for each 100 characters up to 3, times the share of the text outside links."""
    size = len(block.text)
    return (1 + block.text.count(",") + min(size / 100, 3)) * max(0.0, 1 - block.linked / size)


def softly_in(node: Node | None) -> Iterator[Node]:
    """The elements around a node that are cut softly, from the innermost on."""
    soft = node and node.softly
    while soft:
        yield soft
        soft = soft.parent and soft.parent.softly


def settle(root: Node) -> None:
    """Cut the elements that are cut softly, but the ones with more than half of the page's points beside which nothing named like an
    article has a twentieth of theirs."""
    held: dict[int, list] = {}
    total = article = 0.0
    for block in blocks(root):
        points = points_of(block)
        total += points
        told = points if block.node.within else 0.0
        article += told
        for _, soft in zip(range(REACH), softly_in(block.node), strict=False):
            own = held.setdefault(id(soft), [soft, 0.0, 0.0])
            own[1] += points
            own[2] += told
    stays = {key for key, (_, points, told) in held.items() if 2 * points > total and 20 * (article - told) < points}
    stack = [root]
    while stack:
        node = stack.pop()
        for child in node.children:
            if isinstance(child, Node) and not child.cut:
                child.cut = child.softly is child and id(child) not in stays
                stack.append(child)


def ancestors(node: Node | None) -> Iterator[Node]:
    while node:
        yield node
        node = node.parent


#: How many ancestors a paragraph passes points to; each takes half of what the one below took, so the rest is nothing.
REACH = 64


def chosen(root: Node) -> list[str]:
    """The article's blocks of a tree."""
    found = blocks(root)
    scored: dict[int, Node] = {}
    for block in found:
        block.points = points = points_of(block)
        if block.node.doubted:
            points /= 2
        for _, node in zip(range(REACH), ancestors(block.node), strict=False):
            if node.tag in LEAVES:
                continue
            if id(node) not in scored:
                scored[id(node)] = node
                node.score = 5.0 if node.tall and points else 0.0
            node.score += points
            points /= 2
    best = max(scored.values(), key=lambda n: n.score, default=None)
    if best is None or best.score <= 0:
        return []
    best = next((n for n in ancestors(best) if n.tag in ("article", "main")), None) or next((n for n in ancestors(best) if n.tall), best)
    inside = {id(best): True}
    beside = best.parent if best.tag != "main" else None
    for node in beside.children if beside else ():
        # Beside an article stand other articles only.
        if isinstance(node, Node) and node.score >= max(1.0, 0.2 * best.score) and (best.tag != "article" or node.tag == "article"):
            inside[id(node)] = True
    tops, kept = set(inside), []

    def doubts_of(block: Block) -> Iterator[Node]:
        """The doubted elements around a block, below what is kept as a whole."""
        doubt = block.node.doubted
        for _ in range(REACH):
            if not doubt or not inside.get(id(doubt)) or id(doubt) in tops:
                return
            yield doubt
            doubt = doubt.parent.doubted

    for block in found:
        path, node = [], block.node
        while node and id(node) not in inside:
            path.append(id(node))
            node = node.parent
        within_kept = inside[id(node)] if node else False
        inside.update(dict.fromkeys(path, within_kept))
        near = best.tag not in ("article", "main") and beside is not None and block.node.parent is beside and block.node.tag in LEAVES and block.linked * 4 < len(block.text)
        if within_kept or near:
            kept.append(block)
            for doubt in doubts_of(block):
                doubt.points += block.points
    least = sum(b.points for b in kept) / 2

    def loses(block: Block) -> bool:
        return any(doubt.points < least for doubt in doubts_of(block))

    return [b.text for b in kept if not loses(b)]


def main_text(page: str) -> str:
    """The article's blocks, joined by newlines; empty if the page has no text outside boilerplate.

    A paragraph's points are 1, 1 for each comma, and 1 for each 100 characters up to 3, times the share of it outside links;
    its own element takes them in full, each ancestor half of what the one below took. Elements that are, or are named
    like, an article start with 5 points, and the innermost such element around the best container is preferred to it. If names
    leave nothing, they are only doubted.
    """
    if not page or page.isspace():
        return ""
    root, doubts = parsed(page)
    return "\n".join(chosen(root) or (chosen(parsed(page, trusting=True)[0]) if doubts else []))


def extracted(page: str | Column = "html") -> Column:
    """The main text of a column of pages; a null page gives an empty text."""

    @F.pandas_udf("string")
    def text_of(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return text_of(F.coalesce(F.col(page) if isinstance(page, str) else page, F.lit("")))


def main_texts(pages: DataFrame) -> DataFrame:
    """Every page with ``text`` and ``n_chars`` (code points), one by one: no shuffle, whole pages, nothing capped.

    A null or empty page, and one with nothing outside boilerplate, has an empty text. Rows that repeat give repeated rows, and
    null ids or urls pass through. An empty table gives an empty result. Columns of ``pages`` that are named text or n_chars are replaced.
    """
    bounded_batches(pages.sparkSession)
    return pages.withColumn("text", extracted()).withColumn("n_chars", F.length("text").cast("long"))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row; odd rows as in ``main_texts``."""
    return main_texts(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
