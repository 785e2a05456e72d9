"""HTML extraction by flat text blocks and a decision tree over neighbouring blocks.

A page is cut into flat blocks of text between block-level tags. A block is described by its words and the share of them
in links, the same of the blocks before and after, and by what it stands in: an article, an element like a menu, an
element whose class or id hints at something else. A decision tree, grown where the job starts from the blocks of the
small labelled pages below, tells main text from the rest; a hint is one of its inputs and decides nothing by itself.
Pages are independent: one pass, no shuffle.

Scripts, styles, comments and other elements that are never shown as text are left out while cutting. An element that
wraps the article or its headline, or outside of an article all there is, is the page's layout, whatever its name: a form
around the whole page or a "has-sidebar" column has no mark. No part is judged by its share of the page: a long sidebar,
notice, advert or form beside a short article goes. Readers' parts are known by their names, or by a headline such as
"3 comments", from which on the element around it is theirs. Every step moves on in the page and is done once, so the time is in proportion to its
length, also for broken markup; an unclosed tag ends at the next "<".

Edge cases: a null html is an empty one, whose text is empty; unclosed and stray tags, unclosed comments and text
without any tag are cut like a browser would, as far as a flat list needs it; long pages are read whole; extra columns
are kept, and a column named text is replaced; repeated rows are extracted each; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed lists: elements that end a block, elements without shown text, elements and name parts of what is not the article.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style noscript template iframe object svg math head title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
APART = frozenset("nav header footer aside form menu button select dialog".split())
READERS = frozenset("comment comments commentlist reply replies disqus respond responses discussion discussions reactions".split())
#: A headline that begins the readers' part.
READERS_HEADLINE = re.compile(r"\W*(?:\d+\s+)?(?:(?:reader|user|leave a|post a|add a|your)\s+)?(?:comments?|repl(?:y|ies))\b.{0,24}$", re.IGNORECASE)
STRONG = frozenset("notice notices alert promo promotion ad ads advert adverts advertisement advertising banner sponsor sponsored sidebar navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent popup modal overlay newsletter subscribe pagination pager login signup".split())
WEAK = frozenset("nav header share sharing social related recommended widget".split())
#: A name like "no-sidebar" or "has-ads" speaks of the layout.
LAYOUT = frozenset("no has with without hide show is not layout".split())
MAIN = frozenset("article main".split())
#: A paragraph, item or cell ends where one like it begins.
CLOSES = {"p": frozenset("p".split()), "li": frozenset("li".split()), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "td": frozenset("td th".split()), "th": frozenset("td th".split()), "tr": frozenset("tr td th".split()), "option": frozenset("option".split())}
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
BROKEN = re.compile(r"<[^<>]*+>?")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
HEAD_END = re.compile(r"</head\s*>|<body\b", re.IGNORECASE)
ENDS = {name: re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE) for name in HIDDEN}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "apart", "hint", "main", "heading", "outside")
#: Labelled pages: +n stands for a block of n words of the article, -n for one of n other words. Each is read three
#: times, with the longer blocks as they are, twice and half as long.
PAGES = (
    "<body><nav><ul><li><a>-1</a><li><a>-1</a><li><a>-2</a></ul></nav><div class=ad>-9</div><article><h1>+9</h1><p>+60<p>+1</p><p>+2</p><p>+35 <a>w</a></p><p>+1</p></article><footer>-14</footer>",
    "<body><header>-3</header><article><h1>+7</h1><p>+30</p><div class=ad>-25</div><p>+1</p><aside>-30</aside><h2>+3</h2><p>+12</p><p>+4</p><ul><li>+5</li><li>+2</li></ul></article><div>-9</div><footer>-4</footer>",
    "<body><div class=cookie-notice>-30</div><main><h1>+5</h1><p>+80</p><p><a>+3</a></p><p>+2</p><blockquote>+20</blockquote><div class=share><a>-1</a><a>-1</a></div></main><section id=comments><h2>-2</h2><p>-40</p><p>-3</p></section><footer>-9</footer>",
    "<body><article><p>+40</p><section class=related-work><h2>+2</h2><p>+35</p><p>+12</p></section><div class=market-share><p>+28</p></div><div class=related><h3>-2</h3><ul><li><a>-6</a><li><a>-7</a></ul></div><div class=social><a>-2</a></div><p>+3</p></article><aside>-20</aside>",
    "<body><article><h1>+6</h1><p>+50</p><form><label>-2</label><button>-1</button></form><p>+9</p><div class=newsletter>-14</div><p>+25</p><div class=pagination><a>-1</a> <a>w</a></div></article><div class=sidebar><h3>-2</h3><p>-30</p><ul><li><a>-4</a><li><a>-5</a></ul></div>",
    "<body><div class=widget>-6</div><article><p>+15</p><p>+1</p><p>+1</p><table><tr><td>+1<td>+2<tr><td>+1<td>+3</table><p>+22</p></article><div>-12</div><div>-60</div><p>-25</p><ul><li><a>-3</a><li><a>-3</a></ul>",
    "<body><div><ul><li><a>-1</a><li><a>-2</a><li><a>-1</a></ul></div><h1>+7</h1><p>+45</p><p>+30</p><p>+4</p><p>+60</p><p>+2</p><p>+25</p><div><a>-4</a></div><div>-5</div>",
    "<body><div>-3</div><div><a>-2</a> <a>w</a></div><p>+28</p><p>+9</p><p>+40</p><h2>+3</h2><p>+33 <a>w w</a></p><p>+16</p><ul><li>+14</li><li>+11</li></ul><p>+50</p><div class=ad>-18</div><div><a>-3</a><a>-3</a></div><p>-6</p>",
    "<body><h1>+6</h1><p>+90</p><p>+70</p><div class=notice>-8</div><div id=comments><p>-50</p><p>-20</p></div><div class=footer>-12</div>",
    "<body><p>+3</p>", "<body>+8", "<body><p>+1</p>", "<body><p>+12</p><p>+5</p>", "<body><h1>+4</h1><p>+20</p>", "<body><p>+40</p><p>+1</p><p>+30</p>", "<body><h1>+5</h1><p>+3</p><p>+2</p><p>+6</p>",
    "<body><table><tr><td><a>-2</a><td><a>-1</a><td><p>+55</p><p>+38</p><p>+12</p><td>-4 <a>w w w</a></table><div><a>-2</a> <a>w</a> <a>w</a></div>",
    "<body><nav><a>-1</a> <a>w</a></nav><div class=promo>-20</div><article><header><h1>+6</h1></header><p>+18</p><figure><figcaption>+7</figcaption></figure><p>+64</p><p>+5 <a>w w</a></p><div class=header>+30</div><div class=notice>-6</div></article><div class=promo>-8</div><footer><p>-20</p></footer>",
    "<body><article><h1>+5</h1><p>+2</p><p>+3</p><p>+1</p><h2>+1</h2><p>+1</p></article><p>-3</p><p>-30</p><footer>-2</footer>",
    "<body><nav><a>-1</a></nav><article><h1>+6</h1><p>+1</p><p><a>+2</a></p><p>+2</p><ul><li><a>+4</a></li><li><a>+1</a></li></ul><p>+2</p><p><a>+30</a></p><p>+1</p><ul><li><a>+9</a></li></ul><p>+1</p></article><div><a>-4</a></div>",
    "<body><article><p>+1</p><p><a>+2</a></p><p>+3</p><p><a>+1</a></p><p>+1</p></article>", "<body><article><ul><li><a>+4</a></li><li>+2</li></ul><p>+6 <a>w w w w</a></p><p>+2</p><p><a>+5</a></p></article>",
    "<body><main><p>+25</p><p><a>+6</a></p><p>+8</p><ul><li><a>+2</a><li><a>+4</a></ul><p>+30</p><div class=subscribe>-10</div><article class=comment><p>-30</p></article></main>",
)


class Mark:
    """An open element that hints at something else than the article, and what it turned out to wrap."""

    __slots__ = ("article", "begin", "hint", "inside", "kind", "parent", "voids", "words")

    def __init__(self, kind: str, begin: int, parent: Mark | None, inside: bool):
        self.kind, self.begin, self.parent, self.inside = kind, begin, parent, inside
        self.article = self.voids = False  # does it hold an article; a main element or a headline
        self.words, self.hint = 0, (0, 0)

    def own(self, total: int) -> tuple[int, int]:
        """(apart, hint) of this element alone, when the page has been read; decided by what it holds and stands in, not by its size.

        inside: it stands in an article or main element. Outside of one, an element that holds the article, or a form or
        a name without any text beside it, is the page's layout.
        """
        if self.voids and self.kind not in ("nav", "aside", "footer", "menu", "button", "select", "dialog"):
            return 0, 0
        if self.kind == "readers":
            return 0, 2
        layout = self.article or (not self.inside and self.words == total)
        if self.kind in ("strong", "weak"):
            return (0, 0) if layout else (0, 1 if self.kind == "weak" and self.inside else 2)
        if self.kind == "form":
            return (0, 0) if layout else (1, 0)
        return (0, 0) if self.kind == "header" and self.article else (1, 0)


class Block:
    __slots__ = ("heading", "linked", "main", "mark", "text", "words")

    def __init__(self, text: str, linked: int, mark: Mark | None, main: bool, heading: bool):
        self.text, self.linked, self.mark, self.main, self.heading = text, linked, mark, main, heading
        self.words = len(text.split())


def kind_of(name: str, attributes: str) -> str | None:
    """What an element hints at: its own name where it is apart, else "readers", "strong" or "weak" by its class, id or role."""
    if name in APART:
        return name
    if name in ("body", "html", "main") or not attributes:
        return None
    found = None
    for m in ATTRIBUTE.finditer(attributes):
        for label in html.unescape(m[2] or m[3] or m[4] or "").lower().split():
            parts = re.split(r"[_-]+", label)
            if LAYOUT.intersection(parts):
                continue
            if READERS.intersection(parts):
                return "readers"
            if name == "article":
                continue
            if STRONG.intersection(parts) or ("side" in parts and "bar" in parts):
                found = "strong"
            elif not found and WEAK.intersection(parts):
                found = "weak"
    return found


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, Mark | None]] = []  # open elements, each with its mark if it has one
    tops: list[int] = []  # where the block-level ones are in the stack
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    headline: list[str] = []  # a headline of a readers' part that was just read
    mark: Mark | None = None
    total = 0
    at, end, headless = 0, len(page), True

    def flush() -> None:
        nonlocal total
        text = " ".join("".join(parts).split())
        if text:
            heading = any(opened[h] for h in ("h1", "h2", "h3", "h4", "h5", "h6"))
            out.append(Block(text, len("".join(linked).split()), mark, opened["article"] + opened["main"] > 0, heading))
            total += out[-1].words
            if heading and READERS_HEADLINE.match(text):
                headline.append(text)
        parts.clear()
        linked.clear()

    def close(k: int) -> None:
        nonlocal mark
        for name, own in reversed(stack[k:]):
            opened[name] -= 1
            if own:
                own.words, mark = total - own.begin, own.parent
        del stack[k:]
        while tops and tops[-1] >= k:
            tops.pop()

    while at < end:
        begin = page.find("<", at)
        text = page[at : begin if begin >= 0 else end]
        if text:
            parts.append(text := html.unescape(text))
            if opened["a"]:
                linked.append(text)
        if begin < 0:
            break
        if page.startswith("<!--", begin):
            stop = page.find("-->", begin + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        m = TAG.match(page, begin)
        if not m:
            if page[begin + 1 : begin + 2].isalpha() or page[begin + 1 : begin + 2] in ("/", "!", "?"):
                at = BROKEN.match(page, begin).end()
            else:
                at = begin + 1
                parts.append("<")
            continue
        at = m.end()
        name = m[2].lower()
        if name in HIDDEN:
            if not m[1] and not m[3].rstrip().endswith("/"):
                if name != "head":
                    stop = ENDS[name].search(page, at)
                    at = stop.end() if stop else end
                elif headless:
                    stop = HEAD_END.search(page, at)
                    headless = stop is not None
                    if stop:
                        at = stop.end() if stop[0][1] == "/" else stop.start()
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if m[1]:
            if opened[name]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            if headline:
                # what follows in the element around the headline is the readers'
                if name in ("h1", "h2", "h3", "h4", "h5", "h6") and stack and stack[-1][0] not in ("body", "html", "article", "main") and stack[-1][1] is None:
                    mark = Mark("readers", total, mark, opened["article"] + opened["main"] > 0)
                    stack[-1] = (stack[-1][0], mark)
                    out[-1].mark = mark
                headline.clear()
        elif name not in VOID:
            if tops and stack[tops[-1]][0] in CLOSES.get(name, ()):
                close(tops[-1])
            held = mark
            while name in ("h1", "main") and held and not held.voids:
                held.voids, held = True, held.parent
            while name == "article" and held and not held.article:
                held.article, held = True, held.parent
            kind = kind_of(name, m[3])
            own = Mark(kind, total, mark, opened["article"] + opened["main"] > 0) if kind else None
            mark = own or mark
            if name in BLOCKS:
                tops.append(len(stack))
            stack.append((name, own))
            opened[name] += 1
    flush()
    close(0)
    settle(out, total)
    return out


def settle(found: list[Block], total: int) -> None:
    """Give every mark the strongest hint of itself and all it stands in; parents first."""
    done: set[int] = set()
    for block in found:
        chain, own = [], block.mark
        while own and id(own) not in done:
            chain.append(own)
            own = own.parent
        for own in reversed(chain):
            done.add(id(own))
            outer = own.parent.hint if own.parent else (0, 0)
            own.hint = tuple(map(max, own.own(total), outer))


def described(found: list[Block]) -> np.ndarray:
    own = np.array([(b.words, b.linked / max(1, b.words)) for b in found]).reshape(-1, 2)
    none = np.zeros((1, 2))
    hints = [b.mark.hint if b.mark else (0, 0) for b in found]
    flags = np.array([(*h, b.main, b.heading) for b, h in zip(found, hints, strict=True)], dtype=float).reshape(-1, 4)
    outside = float(any(b.main and not any(h) for b, h in zip(found, hints, strict=True))) * (1 - flags[:, 2:3])
    return np.hstack([own, np.vstack([none, own[:-1]])[: len(own)], np.vstack([own[1:], none])[: len(own)], flags, outside])


def training() -> tuple[np.ndarray, np.ndarray]:
    """The described blocks of the labelled pages, and which are main text."""
    x, y = [], []
    for page in PAGES:
        for scale in (1.0, 2.0, 0.5):

            def words(m: re.Match, scale: float = scale) -> str:
                n = int(m[2])
                return f" {'main' if m[1] == '+' else 'rest'}{' w' * ((max(10, round(n * scale)) if n >= 10 else n) - 1)} "

            found = blocks(re.sub(r"([+-])(\d+)", lambda m: words(m) if page[m.start() - 1] in "> " else m[0], page))
            x.append(described(found))
            y += [b.text.startswith("main") for b in found]
    return np.vstack(x), np.array(y, dtype=float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A tree by Gini impurity: (feature, threshold, left, right), or a share of main text in a leaf."""
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = None
    for k in range(x.shape[1]):
        for edge in (np.unique(x[:, k])[1:] + np.unique(x[:, k])[:-1]) / 2:
            left = x[:, k] <= edge
            impurity = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (left, ~left))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, k, float(edge), left)
    if best is None:
        return float(y.mean())
    _, k, edge, left = best
    return (k, edge, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


def decide(tree, x: np.ndarray) -> np.ndarray:
    """Which rows of x the tree takes for main text."""
    if isinstance(tree, float):
        return np.full(len(x), tree >= 0.5)
    k, edge, left, right = tree
    low = x[:, k] <= edge
    out = np.empty(len(x), dtype=bool)
    out[low], out[~low] = decide(left, x[low]), decide(right, x[~low])
    return out


def main_text(page: str, tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = decide(tree, described(found))
    return " ".join(b.text for b, own in zip(found, keep, strict=True) if own)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text, the main text of each."""
    tree = grow(*training())

    @F.pandas_udf("string")
    def text_of_pages(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: main_text(page, tree))

    return pages.withColumn("text", text_of_pages(F.coalesce(F.col(column), F.lit(""))))


def op7_rows(pages: DataFrame) -> DataFrame:
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
