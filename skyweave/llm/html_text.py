"""Main text of a page by tree scoring.

The page is read into a tree of block elements. What is no article goes first: by its element menus, page headers and
footers, asides, scripts and styles; by a whole class, id or role, or as a form, adverts, notices, reader comments and
the like, unless it holds the page's first article or main element, or in pages without text in those SHARE of all
points: then it is a wrapper, and its points are only discounted if it was found by its points. Every block of text of some length gives
points (one, one for each comma, up to three for its length) to its container, half to the one above and less further
up; a container's points are discounted by the share of its text inside links. The container with the most points is
taken, or the article or main element around it, and with it siblings that have a good part of its points or are text
with few links, and other articles of text with few links. A page's header goes with its headings, as a site's name often is one. Their blocks are the text, in page order, without what is mostly links outside the container or between
neighbours that are mostly links, too.

Null html counts as empty; a page without points gives the text of its article, main or body element; a broken page is
read as far as its tags go (an unclosed element ends with its parent, an unclosed script or style with the page). Rows are independent of each other: repeated
rows, null ids and urls pass through, an empty table gives an empty result, other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*+)>|<[!?][^>]*>""", re.S)
MARKS = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden|aria-label)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: HTML elements by what they do here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = set("script style noscript template textarea title iframe svg select canvas object audio video button annotation annotation-xml".split())
TO_THE_END = set("script style textarea title iframe noscript".split())
NEVER = set("nav aside footer dialog menu head".split())
FORMS = {"form", "fieldset"}
ENDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "p": BLOCK - {"p"}}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NAMES = r"ads?|advert\w*|adslot|banner|sponsor\w*|promo\w*|side-?bar|menu|nav\w*|bread-?crumbs?|footer|masthead|cookie\w*|consent|gdpr|notice\w*|alert|newsletter|subscri\w*|sign-?up|log-?in|pop-?up|modal|overlay|comments?|respond|replies|reply|disqus|shar\w*|social\w*|related|recommend\w*|pagination|pager|widget|toolbar|skip|search\w*|tags|byline-?links|complementary|navigation|contentinfo"
#: Whole tokens of a class, id or role: a name, perhaps with a word for its place before it and one for its kind after it.
NO_ARTICLE = re.compile(rf"(?:^|\s)(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|post)[_-])?(?:{NAMES})(?:[_-](?:list|area|section|box|block|bar|wrap|wrapper|container|inner|menu|links?|left|right|top|bottom|form|notice|\d+))?(?:\s|$)", re.I)
HEADER = re.compile(r"(?:^|\s)(?:header|site-?header|page-?header|top-?bar)(?:\s|$)", re.I)
COMMA = re.compile("[,、，،;]")
PARAGRAPH, FEW, DENSE, SHARE, WRAPPER = 25, 0.25, 0.6, 0.5, 0.25


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NEVER or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, value in MARKS.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _doubtful(tag: str, attributes: str, in_article: bool) -> bool:
    """Named like something that is no article, or a form."""
    if tag in FORMS:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in MARKS.findall(attributes):
        value = value.strip("\"'")
        if name.lower() in ("class", "id", "role") and (NO_ARTICLE.search(value) or (not in_article and HEADER.search(value))):
            return True
    return False


def parse(html: str):
    """Block elements (parent, tag, whether doubtful or unwanted) and blocks (element, text, characters of it in links),
    without what is unwanted."""
    parent, tags, unwanted, doubtful = [-1], ["html"], [False], [False]
    stack, blocks, buffer = [0], [], []
    linked, state = [0], {"links": 0, "bad": 0}
    inline: list[str] = []
    within = [False]  # of each element whether it is an article or main element or inside one
    opened: Counter[str] = Counter({"html": 1})
    endless: set[str] = set()

    def flush():
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                blocks.append((stack[-1], text, min(linked[0], len(text))))
            buffer.clear()
        linked[0] = 0

    def pop():
        flush()
        k = stack.pop()
        opened[tags[k]] -= 1
        if unwanted[k]:
            state["bad"] -= 1
        state["links"] = 0
        inline.clear()

    def put(text: str):
        if text and not state["bad"]:
            buffer.append(text)
            if state["links"]:
                linked[0] += len(text.strip())

    at, size = 0, len(html)
    while at < size:
        m = TAG.search(html, at)
        if m is None:
            put(unescape(html[at:]))
            break
        if m.start() > at:
            put(unescape(html[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                state["links"] = max(0, state["links"] - 1)
            elif tag in inline:
                while inline and inline.pop() != tag:
                    pass
                state["bad"] -= 1
            elif tag in BLOCK and opened[tag]:
                stop = ENDS.get(tag, ())
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == tag:
                        while len(stack) > k:
                            pop()
                        break
                    if tags[stack[k]] in stop:
                        break
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/") and tag not in endless:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                if end:
                    at = end.end()
                elif tag in TO_THE_END:
                    at = size
                else:
                    endless.add(tag)
            if tag in ("iframe", "button", "select", "textarea", "video", "object"):
                put(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                put(" ")
            continue
        if tag == "a":
            state["links"] += 1
            continue
        if tag not in BLOCK:
            if m[3] and _unwanted(tag, m[3], True):
                inline.append(tag)
                state["bad"] += 1
            continue
        flush()
        if tags[stack[-1]] == "p":
            pop()
        if tag == "body" and opened["head"]:
            while tags[stack[-1]] != "html":
                pop()
        if tag in CLOSES and any(opened[x] for x in CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] in CLOSES[tag]:
                    while len(stack) > k:
                        pop()
                    break
                if tags[stack[k]] in ENDS[tag]:
                    break
        in_article = within[stack[-1]]
        within.append(in_article or tag in ("article", "main"))
        bad = _unwanted(tag, m[3], in_article)
        doubtful.append(_doubtful(tag, m[3], in_article))
        parent.append(stack[-1])
        tags.append(tag)
        unwanted.append(bad)
        state["bad"] += bad
        opened[tag] += 1
        stack.append(len(tags) - 1)
    flush()
    return parent, tags, doubtful, blocks


def _gain(text: str, inside: int) -> float:
    return (1 + len(COMMA.findall(text)) + min(len(text) // 100, 3)) * (1 - inside / len(text)) if len(text) >= PARAGRAPH else 0.0


def _judged(parent: list[int], tags: list[str], doubtful: list[bool], blocks: list) -> tuple[list[bool], list[float]]:
    """Of each element whether it goes as a doubtful one, and the weight of its points."""
    n = len(tags)
    filled, held, whole, gone, weight = [False] * n, [0.0] * n, 0.0, [False] * n, [1.0] * n
    if not any(doubtful):
        return gone, weight
    for node, text, inside in blocks:
        gain = _gain(text, inside)
        whole += gain
        filled[node] = True
        held[node] += gain
    for k in range(n - 1, 0, -1):  # elements come after the ones they are in
        filled[parent[k]] |= filled[k]
        held[parent[k]] += held[k]
    first = next((k for k in range(n) if tags[k] in ("article", "main") and filled[k]), None)
    around = set()
    k = first
    while k is not None and k >= 0:
        around.add(k)
        k = parent[k]
    for k in range(1, n):
        p = parent[k]
        gone[k], weight[k] = gone[p], weight[p]
        if doubtful[k] and k not in around:
            if first is None and whole and held[k] >= SHARE * whole:
                weight[k] *= WRAPPER
            else:
                gone[k] = True
    return gone, weight


def _neighbours(parent: list[int], chars: list[int]) -> list[list[int]]:
    """Of each element the ones with text before and after it."""
    near, last = [[] for _ in parent], {}
    for k, p in enumerate(parent):
        if chars[k]:
            if p in last:
                near[k].append(last[p])
                near[last[p]].append(k)
            last[p] = k
    return near


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parent, tags, doubtful, blocks = parse(html)
    gone, weight = _judged(parent, tags, doubtful, blocks)
    blocks = [b for b in blocks if not gone[b[0]]]
    n = len(tags)
    points, far, chars, links = [0.0] * n, [0.0] * n, [0] * n, [0] * n
    for node, text, inside in blocks:
        chars[node] += len(text)
        links[node] += inside
        if len(text) < PARAGRAPH:
            continue
        gain = _gain(text, inside) * weight[node]
        k = node if tags[node] in ("div", "section", "article", "main", "body", "html", "td") else parent[node]
        for share in (1, 2, 6, 9):
            if k >= 0:
                points[k] += gain / share
                k = parent[k]
        if k >= 0:
            far[k] += gain / 12  # and as much to all above
    for k in range(n - 1, -1, -1):
        points[k] += far[k]
        if k:
            for sums in (far, chars, links):
                sums[parent[k]] += sums[k]
    density = [links[k] / chars[k] if chars[k] else 0.0 for k in range(n)]
    score = [points[k] * (1 - density[k]) for k in range(n)]
    best = max(range(n), key=lambda k: (score[k], -k))
    if score[best] <= 0:
        whole = [k for k in range(n) if tags[k] in ("article", "main") and chars[k]]
        best = whole[0] if whole else 0
    k, around = best, None
    while k >= 0:
        if tags[k] in ("article", "main"):
            around = around if around is not None and tags[k] == "main" else k
        k = parent[k]
    kept = {best if around is None else around}
    if around is not None and tags[around] == "article":
        # other articles of text beside it, not those inside one
        kept |= {k for k in range(n) if tags[k] == "article" and score[k] > 0 and density[k] < FEW}
    if around is None and parent[best] >= 0:
        for k in range(n):
            if parent[k] == parent[best] and (score[k] >= max(4.0 * weight[best], 0.2 * score[best]) or (tags[k] in ("p", "h1", "h2", "blockquote", "pre") and chars[k] and density[k] < FEW) or (tags[k] == "section" and score[k] > 0 and density[k] < FEW)):
                kept.add(k)
    near = _neighbours(parent, chars)
    under = [False] * n  # inside the container
    for k in range(1, n):
        under[k] = under[parent[k]] or parent[k] == best

    def links_only(k: int) -> bool:
        """Mostly links, and outside the container or between neighbours that are, too."""
        if tags[k] not in ("ul", "ol", "div", "section", "table", "dl", "p") or density[k] <= DENSE:
            return False
        return not under[k] or (bool(near[k]) and all(density[x] > DENSE for x in near[k]))

    stays = [False] * n
    for k in range(n):
        stays[k] = k in kept or (k > 0 and stays[parent[k]] and not links_only(k))
    return " ".join(text for node, text, _ in blocks if stays[node])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
