"""Main text of web pages by two passes of block rules.

Pass 1 looks at each block alone. Menus, headers outside the article, footers, sidebars, notices, adverts, forms and comments (by element
or role, or by a class or id that is a telling name) are bad, as is a block that is mostly links. A name that only contains a telling
part speaks against short blocks alone. Names and forms do not count around the page's article or around most of its text. Stop-word density decides with length,
and lying in an article or main element is a weight: there, some stop words make a block of ``SHORT`` characters good and few leave
it open; elsewhere many make a long block good, some leave it open and few make it bad. Shorter blocks stay open, with
some links too. Where the page is in none of the stop words' languages, length decides alone. Articles that hold less than half
of the page's text are teasers and weigh nothing.

Pass 2 gives open blocks the label of their nearest decided neighbours: good when the nearer one is (either, at equal
distance). Only blocks of the same article, or outside any, count. With none decided an open block is good in an article, and on
a page without articles if it has stop words.

Null and empty pages give empty text. Character references are decoded, white space becomes one blank, and blocks are
joined by a line break. Each row is read alone, so equal rows give equal texts; extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import common

SHORT, LONG = 70, 200
LINKS, LOW, HIGH = 0.5, 0.2, 0.3
#: A page with fewer stop words is in none of their languages, whatever it says; one that says nothing, with fewer than ``LOW``.
NONE = 0.05

#: Frequent words of four languages. Fixed values.
STOP_WORDS = {
    "en": "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were which will with you",
    "de": "als am an auch auf aus bei das dass dem den der des die ein eine einer es für hat ich im in ist mit nach nicht sich sie sind so und von war werden wie zu zum",
    "fr": "à au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sont sur un une",
    "es": "a al como con de del el ella en es esta este fue ha la las le lo los más me no o para pero por que se ser si sin su sus un una y ya",
}
_WORDS = {lang: frozenset(words.split()) for lang, words in STOP_WORDS.items()}
_EVERY = frozenset().union(*_WORDS.values())

BLOCKS = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video select option button textarea".split())
#: What may stand in a head; anything else, text too, ends it.
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
ASIDE = frozenset("nav footer aside dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OPEN_ENDED = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "option": frozenset({"option"})}
_NAMES = (
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|comments?|disqus|replies|respond|cookies?|consent|gdpr|notices?|alert|newsletter|subscribe|popup|modal|overlay"
    r"|nav\w*|menus?|breadcrumbs?|sidebar|widgets?|related|recommend\w*|share|sharing|social|footer|masthead|toolbar|pagination|login|signup|search)"
)
_WHOLE = re.compile(_NAMES, re.I)
_PART = re.compile(rf"(?:^|[_-]){_NAMES}(?:$|[_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())


class _Blocks(HTMLParser):
    """Blocks of a page in order: (text, characters in links, whether set aside, number of the article it lies in).

    A telling name or a form is a hint until the page's end, when it is known what text its element holds.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, bool, int]] = []
        self.stack: list[tuple[str, bool, bool, int, int]] = []  # element, silent, aside, article, innermost hint
        self.under: list[int] = []  # the innermost hint around each block, -1 for none
        self.parent: list[int] = []  # of each hint, the one around it
        self.whole: list[bool] = []  # of each hint: a whole name or a form, not a part of a name
        self.holds: set[int] = set()  # innermost hints around an article
        self.text: list[str] = []
        self.linked = self.links = self.articles = 0

    def _state(self) -> tuple[bool, bool, int, int]:
        return self.stack[-1][1:] if self.stack else (False, False, 0, -1)

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, aside, article, hint = self._state()
            self.blocks.append((text, self.linked, aside, article))
            self.under.append(hint)
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "body" or (self.stack and self.stack[-1][0] == "head" and tag not in HEAD_ONLY):
            self.handle_endtag("head")
        if tag in VOID:
            if tag in ("br", "hr"):
                self.text.append(" ")
            if tag == "hr":
                self._flush()
            return
        if tag in _OPEN_ENDED and self.stack and self.stack[-1][0] in _OPEN_ENDED[tag]:
            self.handle_endtag(self.stack[-1][0])
        if tag in BLOCKS or tag in SILENT:
            self._flush()
        elif tag in ("td", "th"):
            self.text.append(" ")
        silent, aside, article, hint = self._state()
        given = dict(attrs)
        if tag in ("article", "main"):
            self.holds.add(hint)
            if not article and not aside:
                self.articles += 1
                article = self.articles
        elif tag not in ("html", "body"):
            aside = aside or tag in ASIDE or (tag == "header" and not article) or (given.get("role") or "").lower() in _ROLES or "hidden" in given
            names = f"{given.get('class') or ''} {given.get('id') or ''}".split()
            whole = tag == "form" or any(_WHOLE.fullmatch(name) for name in names)
            if whole or any(_PART.search(name) for name in names):
                self.parent.append(hint)
                hint = len(self.whole)
                self.whole.append(whole)
        self.stack.append((tag, silent or tag in SILENT, aside, article, hint))
        self.links += tag == "a"

    def handle_endtag(self, tag):
        depth = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if depth is None:
            return
        if any(name in BLOCKS or name in SILENT for name, *_ in self.stack[depth:]):
            self._flush()
        self.links -= sum(name == "a" for name, *_ in self.stack[depth:])
        del self.stack[depth:]

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self.handle_endtag("head")
        if not self._state()[0]:
            self.text.append(data)
            if self.links:
                self.linked += len("".join(data.split()))

    def finish(self) -> list[tuple[str, int, bool, int]]:
        self.close()
        self._flush()
        if not self.whole:
            return self.blocks
        size = [0 if aside or _linked(text, linked) or len(text) < SHORT else len(text) for text, linked, aside, _ in self.blocks]
        mine, inside = [0] * len(self.whole), [0] * len(self.whole)
        for (_, _, _, article), n, h in zip(self.blocks, size, self.under, strict=True):
            if h >= 0:
                mine[h] += n
                inside[h] += n if article else 0
        holds = [h in self.holds for h in range(len(self.whole))]
        for h in range(len(self.whole) - 1, -1, -1):  # an outer hint has a smaller number
            if (up := self.parent[h]) >= 0:
                mine[up] += mine[h]
                inside[up] += inside[h]
                holds[up] |= holds[h]
        articles = sum(n for block, n in zip(self.blocks, size, strict=True) if block[3])
        # a hint means nothing around the page's article, or around most of its text where no article of some length is elsewhere
        kept = [
            not ((holds[h] and articles - inside[h] <= mine[h]) or (mine[h] >= LONG and 2 * mine[h] > sum(size) and articles - inside[h] < LONG))
            for h in range(len(self.whole))
        ]
        any_text, short_text = [], []  # of each hint: whether it or one around it sets aside all blocks, short ones
        for h, up in enumerate(self.parent):
            any_text.append((kept[h] and self.whole[h]) or (up >= 0 and any_text[up]))
            short_text.append(kept[h] or (up >= 0 and short_text[up]))
        return [
            (text, linked, aside or (h >= 0 and (any_text[h] or (len(text) < SHORT and short_text[h]))), article)
            for (text, linked, aside, article), h in zip(self.blocks, self.under, strict=True)
        ]


def _linked(text: str, linked: int) -> bool:
    return linked > LINKS * len(text.replace(" ", ""))


def _density(text: str, stop: frozenset) -> float:
    words = [w.strip(".,;:!?\"'()").lower() for w in text.split()]
    return sum(w in stop for w in words) / len(words)


def _first_pass(text: str, linked: int, aside: bool, article: int, stop: frozenset | None) -> str:
    if aside or _linked(text, linked):
        return "bad"
    if len(text) < SHORT:
        return "open"
    if stop is None:
        return "good" if article or len(text) >= LONG else "open"
    density = _density(text, stop)
    if density >= HIGH:
        return "good" if article or len(text) >= LONG else "open"
    if density >= LOW:
        return "good" if article else "open"
    return "open" if article else "bad"


def main_text(html: str | None, lang: str | None = None) -> str:
    """The main text of one page; ``lang`` picks the stop words where the page does not say its language."""
    if not html:
        return ""
    parser = _Blocks()
    parser.feed(html)
    blocks = parser.finish()
    said = re.search(r"<html[^>]*\blang=[\"']?([A-Za-z]{2})", html[:2000], re.I)  # the element itself, wherever its start stands
    name = (said[1] if said else lang or "").lower()
    stop = _WORDS.get(name, _EVERY)
    prose = [b for b in blocks if not b[2] and not _linked(b[0], b[1]) and len(b[0]) >= SHORT]
    listed = not name or name in _WORDS
    inside = sum(len(b[0]) for b in blocks if b[3] and not b[2] and not _linked(b[0], b[1]))
    outside = sum(len(b[0]) for b in prose if not b[3] and (not listed or _density(b[0], stop) >= LOW))
    if outside >= LONG and outside > inside:
        blocks = [(*b[:3], 0) for b in blocks]  # most of the text is elsewhere: its articles are teasers
    has_article = any(b[3] for b in blocks)
    foreign = not listed or (prose and _density(" ".join(b[0] for b in prose), stop) < (NONE if name else LOW))
    known = None if foreign else stop
    label = [_first_pass(*block, known) for block in blocks]
    decided: dict[int, list[int]] = {}
    for i, x in enumerate(label):
        if x != "open":
            decided.setdefault(blocks[i][3], []).append(i)
    out = []
    for i, (text, _, _, article) in enumerate(blocks):
        verdict = label[i]
        if verdict == "open":
            mine = decided.get(article, [])
            k = bisect_left(mine, i)
            near = mine[max(k - 1, 0) : k + 1]
            least = min((abs(d - i) for d in near), default=0)
            labels = {label[d] for d in near if abs(d - i) == least}
            if not near:
                labels = {"good"} if article or (not has_article and any(w.lower().strip(".,") in stop for w in text.split())) else {"bad"}
            elif article and labels == {"bad"} and any(label[d] == "good" for d in near):
                labels = {"good"}  # inside an article text on either side outweighs a nearer list of links
            elif article and len(text) >= SHORT and not any(label[d] == "good" for d in mine):
                labels = {"good"}  # an article without any decided text keeps what is not short
            verdict = "good" if "good" in labels else "bad"
        if verdict == "good":
            out.append(text)
    return "\n".join(out)


def _extract(batches):
    for batch in batches:
        texts = [main_text(html) for html in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html)."""
    common.ready(pages.sparkSession)
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
