"""Main text of web pages by the line-block distribution.

Markup is stripped into lines, one per block element. Every line has a weight: the
length of its text, without link text where the page does not mark its article, and zero
inside menus, headers, footers, sidebars, notices, adverts, forms and reader comments,
which elements, roles and class names tell. Weights are summed over windows of ``WINDOW``
lines; text starts where the sum surges to the threshold and ends at the dive, where a
whole window is empty. A page with an ``article`` or ``main`` element has its weights there
alone and any text is a surge, so that no short paragraph is lost; elsewhere the threshold
is ``SURGE`` characters and headings right above a surge belong to it; if no window surges,
the heaviest run of lines is the text. Class names are a guess: an element that they make
noise counts as text if an article inside it is longer than those outside noise, or than all
text outside noise if there are none, or if it holds over half of the text of a page without.

Defined cases: null, empty and text-free pages give an empty text; unclosed elements end
with their parent, unclosed scripts and comments with the page; page_id and url may be
null or repeated; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
SURGE = 80

# Element names of HTML by their role in a page.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small "
             "span strike strong sub sup time tt u var wbr img br".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = set("nav footer aside form button select textarea menu dialog head iframe object video audio canvas".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
HEAD = set("html head title meta link base script style noscript template".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NOISE = re.compile(
    r"(?<![a-z])(ads?|adverts?|advertisements?|sponsor(ed)?|promos?|banners?|cookies?|consent|gdpr|notices?|alerts?|"
    r"menus?|nav|navbar|navigation|breadcrumbs?|sidebars?|widgets?|footers?|headers?|masthead|comments?|comment-?list|"
    r"replies|disqus|share|sharing|social|related|recommended|newsletter|subscribe|signup|popups?|modals?|overlay|"
    r"pagination|pager|toolbar|topbar|bottombar|skip-?link)(?![a-z])")
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|noscript|template|svg|math|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-z][a-z0-9:-]*)([^<>]*)>|<[!?][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")


def is_noise(name: str, attributes: str, in_article: bool) -> int:
    """Whether an element holds no main text; 1 if only its class or id says so, else 2."""
    if name in BOILERPLATE or name == "header" and not in_article:
        return 2
    if "=" not in attributes and "hidden" not in attributes:
        return 0
    found = {k.lower(): (a or b or c).lower() for k, a, b, c in ATTRIBUTE.findall(attributes)}
    hidden = found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) or re.search(
        r"(?<![\w=\"'-])hidden(?![\w-])", attributes.lower())
    if name in ("body", "html", "main"):
        return 0
    named = f"{found.get('class', '')} {found.get('id', '')}".replace("_", "-")
    return 2 if hidden or found.get("role", "") in ROLES else int(bool(NOISE.search(named)))


def lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, weight without links, inside an article, heading) of every line; noise is empty."""
    out, spared = scan(page, frozenset())
    return scan(page, spared)[0] if spared else out


def scan(page: str, spared: frozenset) -> tuple[list[tuple[str, int, bool, bool]], frozenset]:
    """The lines, and the places of elements that are noise by class name and hold the main text."""
    out, pieces, links = [], [], 0
    stack: list[tuple[str, int, bool, int | None]] = []  # name, noise, inside an article, place if noise by class name
    heading = False
    opened: dict[str, list[int]] = defaultdict(list)  # name -> its places in the stack
    total, in_articles, held, articles = 0, 0, Counter(), Counter()

    def push(name: str, *state):
        opened[name].append(len(stack))
        stack.append((name, *state))

    def drop(depth: int):
        for name, *_ in stack[depth:]:
            opened[name].pop()
        del stack[depth:]

    def close():
        nonlocal pieces, links, heading, total, in_articles
        text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
        noise, article = stack[-1][1:3] if stack else (0, False)
        if text and noise < 2:
            weight, inner = max(len(text) - links, 0), False
            total += weight
            in_articles += len(text) if article and not noise else 0
            for name, _, _, place in reversed(stack if noise else []):
                if place is not None:
                    held[place] += weight
                    articles[place] += len(text) if inner else 0
                inner = inner or name in ("article", "main")
        if text:
            out.append(("", 0, article, False) if noise else (text, max(len(text) - links, 0), article, heading))
        pieces, links, heading = [], 0, False

    def take(text: str):
        nonlocal links, heading
        if stack and stack[-1][0] == "head" and text.strip():
            drop(len(stack) - 1)  # text is never in the head
        if text:
            pieces.append(text)
            if opened["a"]:
                links += len(SPACE.sub(" ", html.unescape(text)).strip())
            heading = heading or any(opened[h] for h in HEADINGS)

    at = 0
    for m in TAG.finditer(page):
        take(page[at:m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if not (m[2] or m[5]) and name not in HEAD and opened["head"]:
            close()
            drop(opened["head"][0])
        if name == "br":
            pieces.append(" ")
            continue
        if name not in INLINE:
            close()
        if m[2] or m[5]:
            if opened[name]:
                depth = opened[name][-1]
                if any(e[0] not in INLINE for e in stack[depth:]):
                    close()
                drop(depth)
        elif name not in VOID:
            if name not in INLINE and stack:  # a block ends an open paragraph and what is open in it
                p = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE), None)
                if p is not None and stack[p][0] == "p":
                    drop(p)
            noise, article = stack[-1][1:3] if stack else (0, False)
            main = name in ("article", "main")
            if main and noise and next(e[0] for e in stack if e[1]) in ("nav", "header"):
                noise = 0  # a menu that was never closed
            own = 0 if noise == 2 else is_noise(name, m[4] or m[7] or "", article)
            if own == 1 and m.start() in spared:
                own = 0
            noise = max(noise, own)
            push(name, noise, article or main and not noise, m.start() if own == 1 else None)
    take(page[at:])
    close()
    least = in_articles or sum(weight for text, weight, _, _ in out if text)
    if in_articles or any(n > least for n in articles.values()):
        return out, frozenset(p for p, n in articles.items() if n > least)
    return out, frozenset(p for p, n in held.items() if 2 * n > total)


def main_text(page: str | None) -> str:
    """The main text, blocks joined by two line feeds."""
    found = lines(page or "")
    marked = any(text and article for text, _, article, _ in found)
    if marked:
        weight, surge = [len(text) if article else 0 for text, _, article, _ in found], 1
    else:
        weight, surge = [w for _, w, _, _ in found], SURGE
    weight += [0] * WINDOW
    run = sum(weight[:WINDOW])
    sums = [run := run + (weight[i + WINDOW - 1] - weight[i - 1] if i else 0) for i in range(len(found))]
    kept, i = [], 0
    while i < len(found):
        if sums[i] < surge or not weight[i] and not found[i][0]:
            i += 1
            continue
        first = i
        while not marked and first and found[first - 1][3] and found[first - 1][0] and (first - 1) not in kept[-1:]:
            first -= 1
        while i < len(found) and sums[i]:
            i += 1
        kept += range(first, i)
    if not kept and any(weight):
        stops = [-1, *[k for k, n in enumerate(sums) if not n], len(found)]
        first, last = max(((a + 1, b) for a, b in zip(stops, stops[1:])), key=lambda r: sum(weight[r[0]:r[1]]))
        while first and found[first - 1][3] and found[first - 1][0]:
            first -= 1
        kept = range(first, last)
    return "\n\n".join(found[k][0] for k in kept if found[k][0] and (found[k][2] or not marked))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    def made(batches):
        for b in batches:
            texts = [main_text(p) for p in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(made, f"page_id {kind}, url string, text string, n_chars long")
