"""Main text of web pages by two passes over blocks.

A page is cut at its tags into blocks of text. Blocks of scripts, styles, menus, headers, footers, asides and of
containers whose class, id or role names such a part are dropped, as are forms, unless such a container or form is a
layout wrapper around the page's text (_spared).

Pass one classifies each remaining block by length, stop-word density and link density as good, bad or ambiguous;
where no block has stop words that we know, sentence ends stand in for them (_first_pass). Pass two gives ambiguous
blocks the label of the nearest decided neighbours; where these differ, the one in the same element wins, then the
nearer, and at equal distance the one before, from which the block reads on. On a page without a good block,
ambiguous ones that share no element with a bad one are its text.

Article and main elements are one vote: where they hold the larger part of the good text (_marked), the blocks outside
them are dropped and a block in one inherits from that one alone; else they count as any other element.

Defined results: a null or empty page, or one without main text, gives an empty string; unclosed tags, comments and
raw-text elements end at the page's end; a head ends at the first tag or text that no head has; repeated pages are
repeated rows; an empty table gives an empty table; only the three columns named are read. Work is in proportion to a
page's length, but for elements named as other parts within each other, of which each that is spared costs a look at
all others.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

# The most frequent function words of four languages.
STOP_WORDS = {
    "en": "the of and a to in is you that it he was for on are as with his they i at be this have from or one had by but not what all were we when your can said there use an each which she do how their if will".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la mais comme ou si leur y dont avec cette ces son sa aux été nous vous on tout elle fait".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy".split(),
}
_STOPS = [frozenset(v) for v in STOP_WORDS.values()]
LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH, LINKS_HIGH = 70, 200, 0.15, 0.3, 0.4
# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select canvas audio video".split())
HEAD = frozenset("title meta link base script style noscript template".split())
BOILERPLATE = frozenset("nav header footer aside menu dialog button fieldset label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
LEAVES = INLINE | HEADINGS | {"p"}
# Words in class, id and role that mark parts other than the article.
NAMES = "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidebars menu menus nav navbar navigation footer header masthead comment comments respond reply replies cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription share sharing social related recommended breadcrumb breadcrumbs pagination pager disqus widget widgets login signup search toolbar complementary contentinfo dialog alertdialog".split()
# Those of them that name regions of a page, which the classes of layout wrappers name as well.
LAYOUT = frozenset("form ad ads banner sidebar sidebars menu menus nav navbar navigation footer header masthead breadcrumb breadcrumbs toolbar widget widgets share sharing social search".split())
# Layout words that name a part even on an element within a line of text.
WITHIN = frozenset("ad ads share sharing social".split())
# Ends of sentences, in several scripts.
_SENTENCE = re.compile("[.!?\u2026](?=[\\s\"'\u00bb\u201d\u2019)]|$)|[\u3002\uff01\uff1f\uff61\u0964\u061f\u06d4\u0589\u1362\u104b]")
# Letters of scripts that write a word, or a syllable, in one character.
_WIDE = re.compile("[\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_WORD = re.compile(r"[^\W_]+")
# A word behind has-, with- or no- says what a container has, not what it is.
_NAMED = re.compile(r"(?:^|[\s_-])(?<!\bhas[_-])(?<!\bwith[_-])(?<!\bno[_-])(?<!\bwithout[_-])(" + "|".join(NAMES) + r")(?=$|[\s_\d-])", re.I)
_MARKS = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)


def _unwanted(name: str, attributes: str) -> tuple[bool, set[str]]:
    """Whether the element is dropped whatever it holds, and the words of NAMES in its class, id and role."""
    if name in BOILERPLATE:
        return True, set()
    words: set[str] = set()
    if not attributes.strip():
        return False, words
    seen = set()
    for m in _MARKS.finditer(attributes):
        key = m[1].lower()
        if key in seen:
            continue
        seen.add(key)
        value = next((v for v in m.groups()[1:] if v is not None), "")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, words
        if key in ("class", "id", "role") and name not in ("html", "body") and name not in HEADINGS:
            words.update(w.lower() for w in _NAMED.findall(value))
    if name in INLINE:  # within a line of text there is no layout wrapper: it is such a part, or it is text
        return bool(words - LAYOUT or words & WITHIN), set()
    return False, words


class Named:
    """An element that its class, id or role names as another part than the article, or a form; parent is the
    one around it. mains, articles and parts are numbers of main and article elements in it, and of those that its
    blocks are in (0: in none); good is how much good text it holds."""

    __slots__ = ("parent", "layout", "mains", "articles", "parts", "good", "spared", "shown")

    def __init__(self, parent: "Named | None", layout: bool):
        self.parent, self.layout, self.spared, self.shown, self.good = parent, layout, False, False, 0
        self.mains, self.articles, self.parts = set(), set(), set()


class Block:
    """parent is the number of the element around it that is neither a paragraph, a heading nor within a line."""

    __slots__ = ("raw", "linked", "container", "parent", "heading", "title", "item", "named", "text", "size", "density")

    def __init__(self, container: int, parent: int, around: list[str], named: Named | None):
        self.raw: list[str] = []
        self.linked, self.container, self.parent, self.named, self.text = 0, container, parent, named, ""
        self.heading, self.title = not HEADINGS.isdisjoint(around), "h1" in around
        self.item = "p" not in around and not self.heading

    def close(self) -> bool:
        """Decode and measure the block's text; whether it has any."""
        self.text = " ".join(entities.unescape("".join(self.raw)).split())
        self.size, self.density = _size(self.text), _density(self.text)
        return bool(self.text)


def blocks_of(page: str) -> tuple[list[Block], list[Named]]:
    """The page's blocks that no tag rules out, and the named elements, in order; container 0 is outside article and
    main."""
    out: list[Block] = []
    every: list[Named] = []
    stack: list[tuple[str, bool, bool, Named | None]] = []  # name, dropped, article or main, the named element before
    opened: Counter[str] = Counter()
    current, parents = [0], [0]
    drop = links = serial = elements = 0
    block, named = None, None

    def text(raw: str) -> None:
        nonlocal block
        if not raw:
            return
        if stack and stack[-1][0] == "head" and not raw.isspace():
            shut()
        if drop:
            return
        if block is None:
            block = Block(current[-1], parents[-1], [x[0] for x in stack[-2:]], named)
            out.append(block)
        block.raw.append(raw)
        if links:
            block.linked += len(raw.strip())

    def shut() -> None:
        nonlocal drop, named
        name, bad, part, named = stack.pop()
        opened[name] -= 1
        drop -= bad
        if part:
            current.pop()
        if name not in LEAVES:
            parents.pop()

    at = 0
    while m := _TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name not in INLINE:
            block = None
        elif name == "br":
            text(" ")
        if closing:
            if name == "a":
                links = 0
            if opened[name]:
                while stack[-1][0] != name:
                    shut()
                shut()
            continue
        if stack and stack[-1][0] == "head" and name not in HEAD:
            shut()
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or attributes.endswith("/") and name not in ("p", "div"):
            continue
        if name == "a":
            links = 1
        if name in INLINE and not opened[name] and not attributes.strip():
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and opened[name]:
            # A new one closes an open one of the same kind beside it, and what is open of a line within that.
            k = len(stack) - 1
            while k > len(stack) - 9 and k > 0 and stack[k][0] in INLINE:
                k -= 1
            if stack[k][0] == name:
                while len(stack) > k:
                    shut()
        bad, words = (True, set()) if name == "head" else _unwanted(name, attributes)
        if name == "a" and not bad and not opened[name]:
            continue
        part = name in ("article", "main") and not drop and not bad
        before = named
        if part:
            serial += 1
            current.append(serial)
            # An article that is itself named so, as a comment or a card, does not tell a wrapper.
            if named and (name == "main" or not words):
                (named.mains if name == "main" else named.articles).add(serial)
        if name == "form":
            words.add("form")
        if words and not bad and name not in ("article", "main"):
            named = Named(named, words <= LAYOUT)
            every.append(named)
        drop += bad
        stack.append((name, bad, part, before))
        opened[name] += 1
        if name not in LEAVES:
            elements += 1
            parents.append(elements)
        if name not in INLINE:
            links = 0
    text(page[at:])
    return out, every


def _density(text: str) -> float:
    """The share of a text's words that are stop words of one language, the one that has most."""
    words = _WORD.findall(text.lower())
    return max(sum(map(s.__contains__, words)) for s in _STOPS) / len(words) if words else 0.0


def _size(text: str) -> int:
    """Length of a text, a letter of a script without short words counting as three."""
    return len(text) if text.isascii() else len(text) + 2 * len(_WIDE.findall(text))


def _first_pass(blocks: list[Block]) -> list[str]:
    """Each block is good, bad, or ambiguous: near (reads like text) or short (no evidence)."""
    # Without stop words of a known language, sentence ends for each LENGTH_HIGH of text say what reads like text.
    foreign = not any(b.density >= STOP_LOW and len(b.text) >= LENGTH_LOW for b in blocks)
    out = []
    for b in blocks:
        n, d = b.size, b.density
        if b.linked > LINKS_HIGH * len(b.text):
            out.append("bad" if b.item or not b.container else "short")
        elif n < LENGTH_LOW:
            out.append("short")
        elif d >= STOP_HIGH or foreign and len(_SENTENCE.findall(b.text)) * 2 * LENGTH_HIGH >= n:
            out.append("good" if n > LENGTH_HIGH else "near")
        else:
            out.append("near" if d >= STOP_LOW else "short")
    return out


def _spared(found: list[Block], every: list[Named]) -> list[Block]:
    """The blocks outside named elements and in those that turn out to be layout wrappers, from the outside inwards: an
    element that holds the main part; or where no article is left outside, one that holds an article with as much
    good text as is outside, or, with no good text outside, one that names regions only and holds some."""
    shown = [b for b in found if not b.named]
    for e in reversed(every):
        if e.parent:
            e.parent.mains |= e.mains
            e.parent.articles |= e.articles
    if len(shown) == len(found) or any(b.container for b in shown) and not any(e.mains for e in every):
        return shown
    good = [b.size if x == "good" else 0 for b, x in zip(found, _first_pass(found))]
    for b, n in zip(found, good):
        if b.named:
            b.named.good += n
            b.named.parts.add(b.container)
    for e in reversed(every):
        if e.parent:
            e.parent.good += e.good
            e.parent.parts |= e.parts
    tried: set[Named] = set()
    while True:
        for e in every:
            e.shown = e.spared and (e.parent is None or e.parent.shown)
        seen = [b.named is None or b.named.shown for b in found]
        outside = sum(n for n, x in zip(good, seen) if x)
        article = any(b.container for b, x in zip(found, seen) if x)

        def spare(e: Named) -> bool:
            if e.parts & e.mains:
                return True
            if article:
                return False
            holds = not e.parts.isdisjoint(e.articles)
            if e.layout:
                return holds and e.good >= outside or not outside and e.good > 0
            return holds and e.good > 0 and not outside

        # The one with the main part, then with the most good text, first; what it shows counts for the others.
        edge = [e for e in every if e.parts and e not in tried and not e.spared and (e.parent is None or e.parent.shown)]
        for e in sorted(edge, key=lambda e: (e.parts.isdisjoint(e.mains), -e.good)):
            tried.add(e)
            if spare(e):
                e.spared = True
                break
        else:
            return [b for b, x in zip(found, seen) if x]


def _marked(found: list[Block], labels: list[str]) -> bool:
    """Whether the article and main parts are the page's text: they hold at least half of the good text, or the page's
    only h1 and at least as many blocks as there are good ones outside."""
    if all(b.container for b in found):
        return True
    good = [b for b, x in zip(found, labels) if x == "good"]
    outside = [b for b in good if not b.container]
    if 2 * sum(b.size for b in outside) <= sum(b.size for b in good):
        return True
    if not any(b.title and b.container for b in found) or any(b.title and not b.container for b in found):
        return False
    return sum(bool(b.container) for b in found) >= len(outside)


def _second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Which blocks are main text, the ambiguous ones by the nearest decided ones before and behind."""
    sides: list[list[int | None]] = []
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        side, last = [None] * len(found), None
        for i in order:
            side[i] = last
            last = i if labels[i] in ("good", "bad") else last
        sides.append(side)
    # Without a good block on the page, what shares no element with a bad one is all there is of text.
    bad = None if "good" in labels else {b.parent for b, x in zip(found, labels) if x == "bad"}
    out = []
    for i, (b, label) in enumerate(zip(found, labels)):
        if label in ("near", "short"):
            near = [j for j in (sides[0][i], sides[1][i]) if j is not None and found[j].container == b.container]
            if bad is not None and b.parent not in bad:
                label = "good"
            elif not near:
                label = "good" if b.container or label == "near" else "bad"
            elif len({labels[j] for j in near}) == 1:
                label = "good" if b.container and label == "near" else labels[near[0]]
            elif label == "near" or b.container or b.heading and labels[near[-1]] == "good":
                label = "good"
            else:
                beside = [j for j in near if found[j].parent == b.parent]
                label = labels[min(beside or near, key=lambda j: abs(j - i))]
        out.append(label == "good")
    return out


def main_text(page: str | None) -> str:
    found, every = blocks_of(page or "")
    found = _spared([b for b in found if b.close()], every)
    labels = _first_pass(found)
    if any(b.container for b in found):
        if _marked(found, labels):
            found = [b for b in found if b.container]
        else:
            for b in found:
                b.container = 0
        labels = _first_pass(found)
    return "\n\n".join(b.text for b, keep in zip(found, _second_pass(found, labels)) if keep)


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars of each page."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(s.as_py()) for s in b.column(html)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return df.select(*keep, html).mapInArrow(run, f"{fields}, text string, n_chars long")


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return extract(common.table(spark, sf_dir, "pages"))
