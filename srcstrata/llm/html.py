"""Main text of web pages as a maximum-scoring contiguous region.

A page is a sequence of tokens: words score positive, tags negative. The region
with the highest sum, found in one linear scan, is the content (Pasternack and
Roth 2009). Weights are fitted on labelled pages: pages whose own markup names
their content element. Inside of it and everywhere else, menus, headers, footers and
adverts included, words and every tag are counted; a tag's weight is its log
odds, kept below zero, and the weight of a word the log odds of words, kept
above it. No tag bars a region: articles side by side are one region where
their words outweigh the tags between them. The sample of labelled pages is
bounded: ``SAMPLE`` pages with the smallest hash of their html, and the ``NAMES``
most frequent of their tag names, others having the weight of unknown tags.

Elements that never are content (menus, headers, footers, forms, adverts,
notices, comments and the like, by element name, role, or a class or id with a
token that says so) score nothing, and their text is left out where a region
spans them. Content elements
and what holds the page's content are exempt, unless hidden. Text of scripts,
styles and comments is no text.

Defined cases: null html is empty; a page without words gives the empty text; of
regions with equal sums the first and shortest counts; an element that is never
closed ends with its parent; an empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcstrata.llm.common import rows_of

SAMPLE, NAMES, LEAST = 2000, 10_000, 0.01
# A page's tokens inside and outside count as so many; what never occurs counts as half of one.
SHARES, UNSEEN = 10_000, 0.5
CONTENT = {"article", "main"}
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select")
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "figure-ad",
               "label", "fieldset", "option", "input", "address"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
          "u", "var", "wbr", "nobr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Elements that a new block closes when they are left open.
CLOSED_BY_BLOCK = {"p"}
# A class or id says boilerplate if one of its tokens consists of such words, and of words for places and boxes, only.
SAYS_BOILERPLATE = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|sidebar|side|footer|header|"
    r"masthead|comments?|respond|replies|disqus|cookies?\w*|consent|gdpr|notices?|notification|alert|popup|modal|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|widget|toolbar|pagination|pager|"
    r"search|copyright|legal|disclaimer|hidden", re.IGNORECASE)
NEUTRAL = re.compile(
    r"|[0-9]+|site|page|main|global|primary|secondary|top|bottom|left|right|upper|lower|fixed|sticky|mobile|desktop|"
    r"box|bar|wrap|wrapper|container|area|block|section|inner|outer|panel|slot|unit|list|links?|items?|buttons?|icons?|"
    r"form|posts?|stories", re.IGNORECASE)
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
# Attributes one by one; a quoted value is part of its attribute, and quotes without a name are no attribute.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}


def says_boilerplate(value: str) -> bool:
    for token in value.split():
        parts = re.split("[_-]", token)
        said = [SAYS_BOILERPLATE.fullmatch(p) is not None for p in parts]
        if any(said) and all(x or NEUTRAL.fullmatch(p) for x, p in zip(said, parts)):
            return True
    return False


def is_boilerplate(name: str, attributes: str, holds_content: bool = False) -> bool:
    """Content elements, and what holds the page's content, are boilerplate only where they are hidden."""
    if name in BOILERPLATE and not (name == "form" and holds_content):
        return True
    if name in ("html", "body") or not attributes:
        return False
    exempt = holds_content or name in CONTENT
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" and name != "main" or key == "aria-hidden" and value == "true" and name != "main":
            return True
        if not exempt and (key in ("class", "id") and says_boilerplate(value) or key == "role" and value.lower() in ROLES):
            return True
    return False


def tokens(page: str) -> list[tuple[str, str, bool, bool]]:
    """(kind, value, outside, content) of every text and tag in page order.

    Kind is ``text`` or the tag's name. ``outside`` says that the token lies in
    a boilerplate element, ``content`` that it lies in a content element. An
    element that holds the page's main elements, or all of its articles where it
    has no main element, is no boilerplate by its class, id or role.
    """
    around: dict[str, _Common] = {}
    found = list(_tokens(page, set(), around))
    common = around.get("main", around.get("article"))
    holders = set(common.starts[:common.length]) if common else ()
    return list(_tokens(page, holders, {})) if holders else found


def scanned(page: str):
    """(kind, value, start) of every piece in page order: ``text``, ``raw``, ``open`` and ``close`` with the tag's name,
    ``open`` with its attributes as a fourth.

    Linear in the page: a piece is consumed once. A tag whose quotes never close
    ends at its first ``>``, and so do the tags after it; what looks like a tag
    but has no ``>`` after it is text; a comment or raw element that never ends
    goes to the end.
    """
    at, said, strict, last = 0, 0, True, page.rfind(">")
    while (start := page.find("<", at)) >= 0:
        name = None
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = len(page) if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), start):
            closing = "]]>" if page.startswith("<![CDATA[", start) else ">"
            end = page.find(closing, start)
            end = len(page) if end < 0 else end + len(closing)
        else:
            name = NAME.match(page, start + 1) if start < last else None
            if name is None:
                at = start + 1
                continue
            end = ATTRIBUTES.match(page, name.end()).end() if strict else -1
            if end < 0 or end == len(page) or page[end] != ">":
                strict, end = False, page.find(">", name.end())
            end += 1
        if start > said:
            yield "text", page[said:start], said
        if name is not None:
            value, attributes = name[0].lower(), page[name.end():end - 1]
            if value[0] == "/":
                yield "close", value[1:], start
            elif value in RAW_END:
                if not attributes.endswith("/"):
                    closed = RAW_END[value].search(page, end)
                    end = closed.end() if closed else len(page)
                yield "raw", value, start
            else:
                yield "open", value, start, attributes
        at = said = end
    if said < len(page):
        yield "text", page[said:], said


class _Common:
    """Elements open around all places of a kind, as the length of a part of the first place's stack."""

    def __init__(self, starts: list[int]):
        self.starts, self.length, self.low = starts, len(starts), len(starts)


def _tokens(page: str, holders: set[int], around: dict[str, _Common]):
    """Tokens of a page; elements that start at ``holders`` hold content.

    ``around`` gets, per kind of content element, where the elements start that
    would be boilerplate by what they say and are open around all of that kind.
    """
    open_elements: list[tuple[str, bool, bool]] = [("", False, False)]  # name, outside, content
    opened: dict[str, int] = {}  # how many open elements have a name
    said: list[tuple[int, int]] = []  # depth and start of open elements that say they are boilerplate
    surely = 0  # depth of the outermost open element that is boilerplate whatever it holds

    def close(depth: int) -> None:
        nonlocal surely
        for name, _, _ in open_elements[depth:]:
            opened[name] -= 1
        del open_elements[depth:]
        if said and said[-1][0] >= depth:
            while said and said[-1][0] >= depth:
                said.pop()
            for common in around.values():
                common.low = min(common.low, len(said))
        surely = 0 if surely >= depth else surely

    for kind, name, start, *rest in scanned(page):
        _, outside, content = open_elements[-1]
        if kind == "text":
            yield "text", name, outside, content
            continue
        if kind == "raw":
            yield name, "", True, content
            continue
        if kind == "close":
            if opened.get(name):
                depth = next(i for i in range(len(open_elements) - 1, 0, -1) if open_elements[i][0] == name)
                outside = open_elements[depth][1]
                close(depth)
            yield name, "", outside, open_elements[-1][2]
            continue
        attributes = rest[0]
        if name not in INLINE and open_elements[-1][0] in CLOSED_BY_BLOCK and name != "br":
            close(len(open_elements) - 1)
            _, outside, content = open_elements[-1]
        says = is_boilerplate(name, attributes, start in holders)
        away = outside or says
        yield name, "", away, content
        if name in CONTENT and not content and not surely:
            if name not in around:
                around[name] = _Common([s for _, s in said])
            common = around[name]
            common.length = common.low
        if name not in VOID and not attributes.endswith("/"):
            if says and is_boilerplate(name, attributes, True):
                surely = surely or len(open_elements)
            elif says:
                said.append((len(open_elements), start))
            open_elements.append((name, away, content or name in CONTENT))
            opened[name] = opened.get(name, 0) + 1


def words_in(text: str) -> int:
    return len(entities.unescape(text).split())


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest positive sum; empty if there is none."""
    best, first, last, total, start = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, first, last = total, start, i + 1
    return first, last


def main_text(page: str, weights: dict[str, float]) -> str:
    """Text of the best region, its blocks joined by one space."""
    parts = tokens(page)
    scores = []
    for kind, value, outside, _ in parts:
        if outside:
            scores.append(0.0)
        elif kind == "text":
            scores.append(weights["word"] * words_in(value))
        else:
            scores.append(weights.get(kind, weights["tag"]))
    first, last = best_region(scores)
    pieces = []
    for kind, value, outside, _ in parts[first:last]:
        if kind == "text":
            if not outside:
                pieces.append(entities.unescape(value))
        elif kind not in INLINE:
            pieces.append(" ")
    return " ".join("".join(pieces).split())


def counted(page: str) -> dict[str, list[int]]:
    """Words and tags of a labelled page inside and outside of its content, as shares of ``SHARES`` of what is there, so
    that a page counts the same whatever its length."""
    counts: dict[str, list[int]] = {}
    for kind, value, outside, content in tokens(page):
        n = words_in(value) if kind == "text" else 1
        place = 0 if content and not outside else 1
        counts.setdefault("word" if kind == "text" else kind, [0, 0])[place] += n
    inside, outside = (max(1, sum(c[place] for c in counts.values())) for place in (0, 1))
    return {name: [SHARES * a // inside, SHARES * b // outside] for name, (a, b) in counts.items()}


def fitted(pages: DataFrame, sample: int = SAMPLE, names: int = NAMES) -> dict[str, float]:
    """Weights of words and tags; ``tag`` is the weight of a tag that no labelled page has.

    Reads the ``sample`` labelled pages with the smallest hash of their html;
    what comes to the driver is a row for each of the ``names`` most frequent tags.
    """
    def count(batches):
        for batch in batches:
            totals: dict[str, list[int]] = {}
            for (page,) in rows_of(batch, "html"):
                for name, (a, b) in counted(page).items():
                    total = totals.setdefault(name, [0, 0])
                    total[0] += a
                    total[1] += b
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals), pa.string()), pa.array([t[0] for t in totals.values()], pa.int64()),
                 pa.array([t[1] for t in totals.values()], pa.int64())], names=["name", "inside", "outside"])

    labelled = (pages.filter(F.col("html").rlike(r"(?i)<(?:article|main)[\s>]"))
                .select("html", F.xxhash64("html").alias("hash")))
    # Only hashes are ordered; the pages below the cut are read where they are.
    cut = labelled.select("hash").distinct().orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    labelled = labelled.filter(F.col("hash") <= F.lit(cut).cast("long")).select("html")
    rows = (labelled.mapInArrow(count, "name string, inside long, outside long").groupBy("name")
            .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
            .orderBy(F.desc(F.col("inside") + F.col("outside")), "name").limit(names).collect())
    return weights_of({r["name"]: (r["inside"], r["outside"]) for r in rows})


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log odds of words and tags, words above zero and tags below it."""
    inside = sum(a for a, _ in counts.values()) + 1
    outside = sum(b for _, b in counts.values()) + 1

    def odds(a, b):
        return math.log(((a + UNSEEN) / inside) / ((b + UNSEEN) / outside))
    weights = {"word": max(1.0, odds(*counts.get("word", (1, 0)))), "tag": -1.0}
    for name, (a, b) in counts.items():
        if name != "word":
            weights[name] = min(-LEAST, odds(a, b))
    return weights


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages(page_id, url, html)``."""
    learned = fitted(pages) if weights is None else weights

    def run(batches):
        for batch in batches:
            said = [main_text(h or "", learned) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(said, pa.string()),
                 pa.array(map(len, said), pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return (pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
