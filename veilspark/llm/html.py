"""Main text of web pages by consensus host paths.

Every page scores its containers by the text they hold outside links and names the best
one by its path of tags and classes, without numbers. The pages of a host vote with these
scores in Spark; then every page is read again with its host's winning path. A page that
has no such container, or no host, is read by its own best container.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from veilspark.session import materialize

from .common import map_rows

RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset(
    "html body div main article section td header footer nav aside form center blockquote "
    "fieldset dialog menu details head".split())
#: Tags that end a block of text; those inside a sentence do not.
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr th tbody thead tfoot caption pre figure "
    "figcaption address hr br option legend summary hgroup".split())
#: What is never part of the article, with all that it holds.
ASIDE = frozenset(
    "nav footer aside form head dialog menu button select template svg canvas object audio "
    "video map fieldset".split())
#: Blocks that become containers only if their names say that they are no article text.
NAMED = frozenset("p ul ol dl table figure".split())
ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu "
    "menubar toolbar".split())
ASIDE_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|nav|navbar|navigation|"
    r"menus?|sidebar|side|footer|masthead|comments?|commentlist|disqus|respond|repl(?:y|ies)|"
    r"cookies?|consent|gdpr|notices?|notification\w*|alerts?|popup|modal|overlay|newsletter|"
    r"subscribe|subscription|share|sharing|social|related|recommend\w*|breadcrumbs?|responses?|"
    r"threads?|reactions?|pagination|pager|login|signup|search|widgets?|toolbar|skip)(?:[-_ ]|$)",
    re.IGNORECASE)
#: Names that an article's own parts may have as well; they do not count beside a name of
#: ``ARTICLE_NAMES``, nor in an article for a part that is text and not links.
LOOSE_NAMES = frozenset("search related recommended recommend side".split())
ARTICLE_NAMES = frozenset("post article entry content story main".split())
TEXT_LEAST, LINKS_MOST = 200, 0.2
# A tag with its quotes in pairs, without giving back; else one that ends at the next ">".
_TAG = re.compile(
    r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ODD_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^<>]*+)>")
_ATTRIBUTE = re.compile(
    r"(?:^|\s)(class|id|role|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=/])", re.IGNORECASE)
_NOT_SHOWN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)
_COMMENT_END = re.compile("--!?>")


@dataclass
class Node:
    """A container: where it hangs, how it is called, what it holds.

    ``path`` stands for the tags and classes from the root down: a digest of the path
    above and the own name, so that deep nesting costs no more than flat.
    """

    parent: int
    tag: str
    path: str
    aside: bool
    inside: bool  # the article or main element, or in one
    loose: bool = False  # aside by a loose name alone, until its text is known
    inherited: bool = False  # aside only because what it hangs in is
    score: float = 0.0
    last: int = 0  # the last node of the subtree


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # (container, text)
    linked: list[int] = field(default_factory=list)  # characters of links, per block


def parse(source: str) -> Page:
    """The containers of a page and its blocks of text, in page order. Never fails."""
    page = Page([Node(-1, "", "", False, False)])
    stack = [0]
    opened: Counter = Counter()  # tags on the stack
    text: list[str] = []
    links = in_link = 0

    def close_block() -> None:
        nonlocal links
        words = " ".join(html.unescape("".join(text)).split())
        if words:
            page.blocks.append((stack[-1], words))
            page.linked.append(min(links, len(words)))
        text.clear()
        links = 0

    def leave(depth: int) -> None:
        for node in stack[depth:]:
            opened[page.nodes[node].tag] -= 1
        del stack[depth:]

    at, end = 0, len(source)
    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            text.append(source[at:lt])
            if in_link:
                links += lt - at
        if lt == end:
            break
        if source.startswith("<!--", lt):
            if source[lt + 4:lt + 5] == ">" or source[lt + 4:lt + 6] == "->":  # ends at once
                at = source.index(">", lt) + 1
                continue
            stop = _COMMENT_END.search(source, lt + 4)
            at = end if stop is None else stop.end()
            continue
        if source[lt + 1:lt + 2] in ("!", "?"):
            stop = source.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(source, lt) or _ODD_TAG.match(source, lt)
        if m is None:
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m.group(2).lower()
        if m.group(1):  # an end tag
            if tag in BLOCKS or opened[tag] > 0:
                close_block()
                in_link = 0
                if opened[tag] > 0:
                    depth = len(stack) - 1
                    while page.nodes[stack[depth]].tag != tag:
                        depth -= 1
                    leave(depth)
            elif tag == "a":
                in_link = 0
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(source, at)
            at = end if stop is None else stop.end()
            continue
        if tag in BLOCKS:
            close_block()
            in_link = 0
            if page.nodes[stack[-1]].tag == "p":  # a block ends an open paragraph
                leave(len(stack) - 1)
        elif tag == "a":
            in_link = 1
        if tag in VOID or m.group(3).endswith("/"):
            continue
        if tag in CONTAINERS or tag in ASIDE or (tag in NAMED and (
                opened[tag] > 0 or _aside(m.group(3)))):
            close_block()
            if tag == "body":  # ends the head, whatever is left open there
                depth = len(stack)
                while depth > 1 and page.nodes[stack[depth - 1]].tag != "html":
                    depth -= 1
                leave(depth)
            stack.append(_open(page, stack[-1], tag, m.group(3)))
            opened[tag] += 1
    close_block()
    for i in range(len(page.nodes) - 1, -1, -1):
        node = page.nodes[i]
        node.last = max(node.last, i)
        if node.parent >= 0:
            above = page.nodes[node.parent]
            above.last = max(above.last, node.last)
    _settle(page)
    return page


def _names(attributes: str) -> dict[str, str]:
    named = {"class": "", "id": "", "role": "", "style": ""}
    for m in _ATTRIBUTE.finditer(attributes):
        named[m.group(1).lower()] = html.unescape(m.group(2) or m.group(3) or m.group(4) or "")
    return named


def _named_aside(named: dict[str, str]) -> str:
    """"" for names of an article's parts, "aside" for others, "loose" where it may be either."""
    names = f"{named['class']} {named['id']}".lower()
    if named["role"].lower() in ASIDE_ROLES:
        return "aside"
    found = [m.group().strip("-_ ").lower() for m in ASIDE_NAMES.finditer(names)]
    if not found:
        return ""
    if any(word not in LOOSE_NAMES for word in found):
        return "aside"
    return "" if ARTICLE_NAMES & set(names.split()) else "loose"


def _hidden(attributes: str, named: dict[str, str]) -> bool:
    return bool(_NOT_SHOWN.search(named["style"])) or (
        "hidden" in attributes.lower() and bool(_HIDDEN.search(_QUOTED.sub('""', attributes))))


def _aside(attributes: str) -> bool:
    named = _names(attributes)
    return bool(_named_aside(named)) or _hidden(attributes, named)


def _open(page: Page, parent: int, tag: str, attributes: str) -> int:
    above = page.nodes[parent]
    named = _names(attributes)
    inside = above.inside or tag in ("article", "main")
    by_name = "" if tag in ("html", "body", "main", "article") else _named_aside(named)
    own = tag in ASIDE or (tag == "header" and not above.inside) or (
        named["role"].lower() in ASIDE_ROLES) or by_name == "aside" or _hidden(attributes, named)
    loose = by_name == "loose" and not own
    classes = sorted({re.sub(r"[0-9]+", "", c.lower()) for c in named["class"].split()} - {""})
    name = f"{above.path}/{'.'.join([tag, *classes])}"
    path = hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=16).hexdigest()
    page.nodes.append(Node(parent, tag, path, above.aside or own or loose, inside, loose=loose,
                           inherited=above.aside and not own and not loose))
    return len(page.nodes) - 1


def _settle(page: Page) -> None:
    """Parts of an article with a loose name stay if they are text and not links."""
    if not any(n.loose and n.inside for n in page.nodes):
        return
    size, links = [0] * len(page.nodes), [0] * len(page.nodes)
    for (at, words), linked in zip(page.blocks, page.linked, strict=True):
        size[at] += len(words)
        links[at] += linked
    for i in range(len(page.nodes) - 1, 0, -1):
        parent = page.nodes[i].parent
        size[parent] += size[i]
        links[parent] += links[i]
    freed: list[int] = []
    for i, node in enumerate(page.nodes):
        while freed and page.nodes[freed[-1]].last < i:
            freed.pop()
        if node.loose and node.inside and size[i] >= TEXT_LEAST and links[i] <= LINKS_MOST * size[i] and (
                not page.nodes[node.parent].aside):
            node.aside = False
            freed.append(i)
        elif freed and node.inherited:
            node.aside = page.nodes[node.parent].aside


def score(page: Page) -> None:
    """Text outside links counts for its container whole and half for the one around it."""
    for (at, words), linked in zip(page.blocks, page.linked, strict=True):
        node = page.nodes[at]
        if node.aside:
            continue
        worth = max(0.0, len(words) - 3.0 * linked) * (1 + 0.02 * min(20, words.count(",")))
        node.score += worth
        if node.parent >= 0:
            page.nodes[node.parent].score += worth / 2


def best(page: Page) -> int | None:
    """The container with the highest score, the first of equals; an article wins a tie."""
    found, top = None, 0.0
    for i, node in enumerate(page.nodes):
        if node.path and not node.aside and node.score > top:
            found, top = i, node.score
    return found


def read(page: Page, path: str | None) -> str:
    """The text of all containers with this path, else of the page's best container."""
    score(page)
    roots = [i for i, n in enumerate(page.nodes) if path and n.path == path and not n.aside]
    if not any(page.nodes[r].score for r in roots):
        own = best(page)
        if own is None:
            return ""
        roots = [own]
    wanted = bytearray(len(page.nodes))
    done = 0
    for r in roots:  # in page order; one inside another is covered by it
        if page.nodes[r].last >= done:
            first = max(r, done)
            done = page.nodes[r].last + 1
            wanted[first:done] = b"\1" * (done - first)
    return " ".join(words for at, words in page.blocks
                    if wanted[at] and not page.nodes[at].aside)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html", name: str = "html") -> DataFrame:
    """(id, url, text) with the main text of every page, whole.

    A null or empty page, or one without text outside menus and the like, gives the
    empty text. Without a host in the url nothing is voted on. Ties of votes go to the
    smaller path. Repeated rows stay; other columns are left out; an empty table stays
    empty. The winning paths are a written table: a hot host is one row of it, its pages
    are never gathered.
    """
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")),
                                    r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"),
                     F.col(html_col).cast("string").alias("html"))

    def vote(group):
        votes: Counter = Counter()
        for row in group:
            page = parse(row["html"] or "")
            score(page)
            chosen = best(page)
            if chosen is not None:
                node = page.nodes[chosen]
                total = sum(n.score for n in page.nodes)
                votes[row["host"], node.path] += node.score / total
        for (where, path), weight in votes.items():
            # whole numbers: a sum that does not depend on the order of its parts
            yield {"host": where, "path": path, "weight": round(weight * 1_000_000)}

    winners = materialize(
        map_rows(rows.filter("host != ''").select("host", "html"), vote,
                 "host string, path string, weight long", weigh="html")
        .groupBy("host", "path").agg(F.sum("weight").alias("weight"))
        .groupBy("host").agg(F.min(F.struct(-F.col("weight"), "path")).getField("path").alias("path")),
        f"{name}-paths")
    kind = rows.schema["id"].dataType.simpleString()
    url_kind = rows.schema["url"].dataType.simpleString()

    def again(group):
        for row in group:
            yield {"id": row["id"], "url": row["url"],
                   "text": read(parse(row["html"] or ""), row["path"])}

    return map_rows(rows.join(winners, "host", "left").select("id", "url", "html", "path"), again,
                    f"id {kind}, url {url_kind}, text string", weigh="html"
                    ).withColumnsRenamed({"id": id_col, "url": url_col})
