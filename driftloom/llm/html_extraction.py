"""Main text of web pages, by a style tree of each site."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .storage import materialize

#: Below this importance a branch goes; a style seen on fewer pages of a site says nothing; weight of inner nodes.
LOW_IMPORTANCE, MIN_PAGES, DAMPING = 0.2, 5, 0.9
#: What importance counts outside the articles of a page that has some.
OUTSIDE = 0.5
#: Most rows of site statistics that are broadcast; more are joined by host, with this many salts.
MAX_BROADCAST_ROWS, SALTS = 200_000, 16

#: Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg select option button audio video canvas".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NOISE_TAGS = frozenset("head nav footer aside form menu search dialog".split())
MAIN_TAGS = frozenset("article main".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NOISE_WORDS = re.compile(
    r"(?i)^(ads?|adverts?|advertisement|adbox|banner|sponsor(ed)?|promo(tion)?|nav(bar|igation)?|menu|breadcrumbs?|side-?bar|foot(er)?|"
    r"(site-?|page-?|top-?)?header|masthead|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|"
    r"share|sharing|social|comments?|disqus|repl(y|ies)|discussion|related|recommended|widget|login|search(box)?|skip-?link)$"
)
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)""", re.S)
_CLASS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_MASK = 2**63 - 1


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big") & _MASK


@dataclass(slots=True)
class Node:
    """A block element: its style path on the site, its parts in order, and what its tag and class say."""

    tag: str
    path: int
    noise: bool
    main: bool
    parts: list = field(default_factory=list)  # nodes and own texts


def parse(page: str) -> Node:
    """Tree of block elements. Inline markup is transparent; missing end tags end where HTML ends them."""
    root = Node("#root", 1, False, False)
    stack, buffer, at = [root], [], 0
    opened: Counter[str] = Counter()  # elements in the stack by name; most stray end tags close nothing
    quiet = 0  # depth inside a noisy inline element

    def flush() -> None:
        text = "".join(buffer)
        buffer.clear()
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if text:
            stack[-1].parts.append(text)

    noisy_inline: list[str] = []
    while at < len(page):
        m = _TAG.search(page, at)
        lt = m.start() if m else len(page)
        if lt > at and not quiet:
            buffer.append(page[at:lt])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            buffer.append(" ")
        elif name in VOID:
            if name == "hr":
                flush()
            else:
                buffer.append(" " if name in ("br", "img") else "")
        elif name not in BLOCK:
            if noisy_inline:
                if name == noisy_inline[0]:
                    quiet += -1 if closing else 1
                    if not quiet:
                        noisy_inline.clear()
            elif not closing and m[3] and _noisy(m[3]):
                noisy_inline.append(name)
                quiet = 1
        elif closing:
            for i in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[i].tag == name:
                    flush()
                    noisy_inline.clear()
                    quiet = 0
                    opened.subtract(n.tag for n in stack[i:])
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "body", "td", "th") and name in ("p", "li", "div"):
                    break  # a stray end tag does not end what holds it
        else:
            flush()
            noisy_inline.clear()
            quiet = 0
            if stack[-1].tag == "p":
                opened[stack.pop().tag] -= 1
            ends = CLOSES.get(name)
            while ends and stack[-1].tag in ends:
                opened[stack.pop().tag] -= 1
            parent = stack[-1]
            node = Node(name, *_style(parent.path, parent.noise, parent.main, name, m[3]))
            parent.parts.append(node)
            stack.append(node)
            opened[name] += 1
    flush()
    return root


@lru_cache(50_000)
def _style(path: int, noise: bool, main: bool, name: str, attributes: str) -> tuple[int, bool, bool]:
    """Path, noise and main of an element below one with these three."""
    classes = _classes(attributes)
    main = main or name in MAIN_TAGS
    inside = main and name in ("header", "hgroup")  # an article's own heading
    noise = noise or name in NOISE_TAGS or (name == "header" and not inside) or any(NOISE_WORDS.match(c) for c in classes)
    return _hash(f"{path}/{name}.{'.'.join(sorted(classes))}"), noise, main


def _classes(attributes: str) -> list[str]:
    if not attributes or "=" not in attributes:
        return []
    return [c for m in _CLASS.finditer(attributes) for c in (m[2] or m[3] or m[4] or "").split()]


def _noisy(attributes: str) -> bool:
    return any(NOISE_WORDS.match(c) for c in _classes(attributes))


def style_rows(page: str | None) -> list[tuple[int, int, int]]:
    """(path, kind, feature) of a page, each once: 0 the style is there, 1 a text under it, 2 its sequence of children."""
    found = set()
    todo = [parse(page)] if page else []
    while todo:
        node = todo.pop()
        found.add((node.path, 0, 0))
        inner = [p for p in node.parts if isinstance(p, Node)]
        found.update((node.path, 1, _hash(p)) for p in node.parts if not isinstance(p, Node))
        if inner:
            shape = [n.path for i, n in enumerate(inner) if not i or n.path != inner[i - 1].path]  # runs of one style count once
            found.add((node.path, 2, _hash(str(shape))))
        todo += inner
    return sorted(found)


def main_text(page: str | None, importance: dict[int, tuple[float, float]], low: float = LOW_IMPORTANCE, damping: float = DAMPING) -> str:
    """Text of the branches that matter, blocks joined by newlines.

    importance holds, for styles of the site that enough pages have, how much their children's layout and their texts
    vary between pages; others count as 1. A branch's importance mixes its own layout's with the mean of what it holds.
    A branch goes if it and all in it is of low importance, a text of a kept one if neither the texts of its style nor
    the branch itself reach the bar. Tags and classes shift the bar: in an article it is relative to the most important
    part, so that an article repeated as a whole stays; outside, on a page that has articles with text, importance counts
    by OUTSIDE only. Branches named as a menu, notice, advert and the like always go: their texts may vary a lot.
    """
    if not page:
        return ""
    root = parse(page)
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in node.parts if isinstance(p, Node)]
    worth: dict[int, float] = {}
    own: dict[int, float] = {}  # of the texts right in a node
    peak: dict[int, float] = {}  # the most in a branch, what is named as noise left out; none without text
    holds = set()  # articles with text and what they are in
    for node in reversed(order):
        layout, content = importance.get(node.path, (1.0, 1.0))
        inner = [p for p in node.parts if isinstance(p, Node)]
        texts = len(inner) < len(node.parts)
        values = [worth[id(n)] for n in inner] + [content] * texts
        weight = damping ** len({n.path for n in inner}) if inner else 1.0
        value = (1 - weight) * layout + weight * (sum(values) / len(values) if values else 1.0)
        worth[id(node)], own[id(node)] = value, max(value, content)
        peaks = [peak[id(n)] for n in inner if id(n) in peak]
        if not node.noise and (peaks or texts):
            peak[id(node)] = max([own[id(node)]] * texts + peaks)
            if node.main or any(id(n) in holds for n in inner):
                holds.add(id(node))
    kept: list[str] = []
    branches: list[tuple[Node | str, float]] = [(root, low / OUTSIDE if holds else low)]
    while branches:
        item, bar = branches.pop()
        if isinstance(item, str):
            kept.append(item)
            continue
        for part in reversed(item.parts):
            if isinstance(part, str):
                if own[id(item)] >= bar:
                    branches.append((part, bar))
            elif id(part) in peak:
                inside = low * peak[id(part)] if part.main and not item.main else bar
                if peak[id(part)] >= inside or not part.main and id(part) in holds:
                    branches.append((part, inside))
    return "\n".join(kept)


def _emit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pages.map(lambda p: [{"path": a, "kind": b, "feature": c} for a, b, c in style_rows(p)])


def site_importance(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, path, layout, content) for each style that at least min_pages pages of a site have.

    layout is the entropy of the sequences of children, content one minus the mean entropy of the texts over the pages
    that hold them, both in units of the logarithm of the number of pages. Counts are summed per task before any shuffle,
    so no site is gathered in one place.
    """
    rows = pages.select("host", F.explode(pandas_udf(_emit, "array<struct<path:long,kind:int,feature:long>>")(F.col("html"))).alias("r")).select("host", "r.*")
    c = F.col("count").cast("double")
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    per_path = rows.groupBy("host", "path", "kind", "feature").count().groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == 0, c)).alias("pages"), of(1, c).alias("texts"), of(1, c * F.log(c)).alias("text_spread"),
        of(2, c).alias("shapes"), of(2, c * F.log(c)).alias("shape_spread"),
    )
    scale = F.log("pages")
    content = F.coalesce(1 - F.col("text_spread") / F.col("texts") / scale, F.lit(1.0))
    layout = F.coalesce((F.log("shapes") - F.col("shape_spread") / F.col("shapes")) / scale, F.lit(1.0))
    return per_path.where(F.col("pages") >= max(min_pages, 2)).select("host", "path", layout.alias("layout"), content.alias("content"))


def _extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pages, styles in batches:
        out = []
        for page, rows in zip(pages, styles, strict=True):
            known = {r["path"]: (r["layout"], r["content"]) for r in rows} if rows is not None else {}
            out.append(main_text(page, known))
        yield pd.Series(out, dtype=object)


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages (page_id, url, html).

    Null html and pages without kept text give an empty text. A page without url counts to a site of its own kind (an
    empty host). Repeated rows are extracted each. Other columns are not read. An empty table gives no rows.
    The site statistics are broadcast if they have max_broadcast_rows rows or fewer; else pages are joined by host, dealt
    over SALTS salts so that a large site is no single task's.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    slim = pages.select("page_id", "url", F.col("html").alias("html"), host.alias("host"))
    per_path = materialize(site_importance(slim, min_pages), "site-styles")
    sites = per_path.groupBy("host").agg(F.collect_list(F.struct("path", "layout", "content")).alias("styles"))
    if per_path.count() <= max_broadcast_rows:
        joined = slim.join(F.broadcast(sites), "host", "left")
    else:
        salted = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = slim.withColumn("salt", salt).join(salted, ["host", "salt"], "left")
    text = pandas_udf(_extract, "string")(F.col("html"), F.col("styles"))
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
