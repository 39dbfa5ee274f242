"""Main text of web pages from streaming parser events.

The standard library's parser feeds events to a small state machine that
writes one line per block (paragraph, heading, list item, cell, stray text),
with its text, the number of tags in it and the container that holds it.  The
text-to-tag ratio (characters per tag) is smoothed with a Gaussian over the
lines; two-means clustering of the smoothed ratios gives the threshold above
which a line is content.

*Furniture.*  Elements that are never content (scripts, styles, controls, menus,
page footers, asides) keep no text.  Others only look like furniture: by their
role, by a word of ``class`` or ``id``, as a form, or as an article inside a list
or another article (reader comments).  Their lines have a ratio of 0 and are left
out, unless the element is the page: it holds most of the text, and every
article, main element and first heading.  A word counts only if
all other words of its name say nothing about content (``site-header`` does,
``with-sidebar``, ``entry-header`` and ``social-history`` do not), and never on
headings, paragraphs, cells and other parts of a text.

*Region.*  The content region is the ``article`` and ``main`` elements, where
they hold nearly all of the content lines' text, or else the smallest element
that does and is no list, table or section of a text; its text is all its blocks
that are no furniture, so headings and short paragraphs stay, and so do content
lines outside it, and a heading of the first level right before it.  Where only
the whole page is large enough, stray text must be above the threshold by its own
ratio, and headings and paragraphs below it stay beside content lines of the same
element, headings also before the last content line, all from the first heading
on.

All walks are linear in the page: sums over containers run once over them, and
end tags without a start are told by counts of open elements.

Defined results: a null or empty page, or one without text outside its
furniture, has text '' and 0 characters; broken markup is read as far as the
parser reads it; null and repeated ids keep their rows; other columns are not
read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
#: share of the content lines' text that a region must hold
REGION_SHARE = 0.9

BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td
tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements that are never content
FURNITURE = frozenset("""aside button datalist dialog embed footer head iframe input map menu nav noscript object
option optgroup script select style svg template textarea title""".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: words of names that mean furniture, whatever part of a page they belong to
STRONG = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
commentlist consent cookie cookies disclaimer discussion disqus login masthead modal navbar newsletter pagination popup
promo promoted promotion replies reply respond responses share sharing sidebar signup sponsor sponsored sponsors
subscribe toolbar widget widgets""".split())
#: and those that do unless the name is of a part of the text
WEAK = frozenset("footer header menu nav navigation notice notices notification related social".split())
#: words that say nothing
NEUTRAL = frozenset("""area bar block bottom box btn button buttons center column container content div first float fixed
form global group holder icons inner item items last left level line link links list main mobile outer page panel
primary region right row secondary section site slot slots small strip sub thread top unit wrap wrapper zone""".split())
#: words of parts of a text
PART = frozenset("article entry post posts stories story articles".split())
#: readers' texts: left out even where they are long
READERS = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
#: elements whose names are not read: parts of a text
NAMELESS = frozenset("""html body article main h1 h2 h3 h4 h5 h6 p td th tr tbody thead tfoot caption blockquote pre dt dd
figure figcaption address em strong b i code cite q""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: a text's own lines, which stay beside its content lines
TEXT_LINES = HEADINGS | frozenset("p li blockquote pre dd dt td th figcaption caption".split())
#: share of the page's text at which what looks like furniture is the page
MOST, MOST_READERS = 0.5, 0.9
#: signs that it must have where nothing marks a page
PAGE_SIGNS = 200
_WORDS = re.compile(r"[a-z]+|[0-9]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def named_furniture(value: str) -> str:
    """'readers', 'furniture' or '' by the names in a ``class`` or ``id``."""
    out = ""
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", name)) if not w.isdigit()]
        means = [w for w in words if w in STRONG or w in WEAK]
        rest = [w for w in words if not (w in STRONG or w in WEAK or w in NEUTRAL)]
        if not means or any(w not in PART for w in rest):
            continue
        if rest and not any(w in STRONG for w in means) and not (
                "related" in means and all(w in ("posts", "articles", "stories") for w in rest)):
            continue
        if READERS & set(means):
            return "readers"
        out = "furniture"
    return out


#: an open element of the first kind ends when one of the second starts
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option", "optgroup"}}
_SCOPE = frozenset(("ul", "ol", "dl", "table", "div", "article", "section", "main", "aside", "body"))


class BlockReader(HTMLParser):
    """Lines of (text, tags, container) of one page; per container its parent,
    element and what it looks like ('', 'furniture' or 'readers')."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.start_page()

    def start_page(self):
        self.reset()
        self.parents = [-1]      # parent of each container; 0 is the page
        self.names = [""]
        self.looks = [""]
        self.stack = [("", 0, False)]  # (element, container, never content)
        self.open: Counter = Counter()
        self.lines: list[tuple[str, int, int]] = []
        self.text: list[str] = []
        self.tags = 0

    def end_line(self):
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, self.stack[-1][1]))
            self.text = []
        self.tags = 0

    def _cut(self, i):
        for element, _, _ in self.stack[i:]:
            self.open[element] -= 1
        del self.stack[i:]

    def _close_before(self, tag):
        """End the open element that the start of ``tag`` ends."""
        if not any(self.open[x] for x in _CLOSES.get(tag, ())):
            return
        stack = self.stack
        for i in range(len(stack) - 1, 0, -1):
            if tag in CLOSED_BY.get(stack[i][0], ()):
                self.end_line()
                self._cut(i)
                return
            if stack[i][0] in _SCOPE:
                return

    def _looks(self, tag, attrs):
        if tag == "form":
            return "furniture"
        if tag == "header" and not (self.open["article"] or self.open["main"]):
            return "furniture"
        if tag == "article" and (self.open["article"] or self.open["li"]):
            return "readers"
        out = ""
        for name, value in attrs:
            if name == "role" and (value or "").strip().lower() in ROLES or name == "hidden":
                out = out or "furniture"
            elif name in ("class", "id") and tag not in NAMELESS:
                out = max(out, named_furniture(value or ""))  # readers over furniture over nothing
        return out

    def handle_starttag(self, tag, attrs):
        stack = self.stack
        if tag in BLOCKS:
            self.end_line()
        self._close_before(tag)
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        _, where, never = stack[-1]
        looks = ""
        if not never:
            if tag in FURNITURE:
                self.end_line()
                never = True
            else:
                looks = self._looks(tag, attrs)
                if looks:
                    self.end_line()  # inline furniture ends the line it stands in
        if tag in BLOCKS or looks:
            self.parents.append(where)
            self.names.append(tag)
            self.looks.append(looks)
            where = len(self.parents) - 1
        stack.append((tag, where, never))
        self.open[tag] += 1

    def handle_endtag(self, tag):
        if tag == "br":
            self.text.append(" ")
            return
        self.tags += 1
        if not self.open[tag]:
            return
        stack, block, i = self.stack, False, len(self.stack) - 1
        while stack[i][0] != tag:
            block = block or stack[i][0] in BLOCKS
            i -= 1
        if block or tag in BLOCKS or stack[-1][1:] != stack[i - 1][1:]:
            self.end_line()
        self._cut(i)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "svg", "iframe"):
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.stack[-1][2]:
            self.text.append(data)

    def page(self, html: str):
        self.start_page()
        self.feed(html)
        self.close()
        self.end_line()
        return self.lines


#: what the start of an element ends
_CLOSES = {tag: [k for k, v in CLOSED_BY.items() if tag in v] for tag in BLOCKS | {"option", "optgroup"}}


def furniture(reader: BlockReader) -> list[bool]:
    """Whether each container is furniture: it or one around it looks so and is
    not the page itself, which holds most of the text and every article, main
    element and heading of the first level that there is."""
    parents, looks = reader.parents, reader.looks
    held, marks = [0] * len(parents), [int(n in ("article", "main", "h1")) for n in reader.names]
    for text, _, c in reader.lines:
        held[c] += len(text)
    for c in range(len(parents) - 1, 0, -1):  # children come after their parents
        held[parents[c]] += held[c]
        marks[parents[c]] += marks[c]
    out = [False] * len(parents)
    for c in range(1, len(parents)):
        most = MOST_READERS if looks[c] == "readers" else MOST
        page = held[c] >= most * held[0] and marks[c] == marks[0] and (marks[c] or held[c] >= PAGE_SIGNS)
        out[c] = out[parents[c]] or bool(looks[c]) and not page
    return out


def smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratio, kernel)[reach:reach + len(ratio)]
    return full / np.convolve(np.ones(len(ratio)), kernel)[reach:reach + len(ratio)]


def threshold(values: np.ndarray) -> float:
    """Two-means cut between low and high ratios; 0 if they are one cluster."""
    low, high = float(values.min()), float(values.max())
    if high - low < 1e-9:
        return 0.0
    for _ in range(20):
        cut = (low + high) / 2
        new = float(values[values <= cut].mean()), float(values[values > cut].mean())
        if new == (low, high):
            break
        low, high = new
    # lines at a quarter of the way up are already far from furniture
    return low + (high - low) / 4


def main_text(reader: BlockReader, html: str | None) -> str:
    lines = reader.page(html or "")
    off = furniture(reader)
    keep = [i for i, line in enumerate(lines) if not off[line[2]]]
    if not keep:
        return ""
    parents, names = reader.parents, reader.names
    ratio = np.array([0.0 if off[c] else len(text) / (tags + 1) for text, tags, c in lines])
    level = smooth(ratio)
    cut = threshold(level)
    content = [i for i in keep if level[i] >= cut] or keep

    weight = [0] * len(parents)
    for i in content:
        weight[lines[i][2]] += len(lines[i][0])
    for c in range(len(parents) - 1, 0, -1):
        weight[parents[c]] += weight[c]
    least = REGION_SHARE * weight[0]

    def within(chosen):
        """Whether each container is one that is chosen, or inside one."""
        out = [chosen(c) for c in range(len(parents))]
        for c in range(1, len(parents)):
            out[c] = out[c] or out[parents[c]]
        return out

    marked = within(lambda c: names[c] in ("article", "main") and weight[c] > 0)
    if sum(len(lines[i][0]) for i in content if marked[lines[i][2]]) >= least:
        return _joined(reader, [i for i in keep if marked[lines[i][2]]], keep)
    # children come after their parents, so the last one is the smallest
    region = max(c for c in range(len(parents)) if weight[c] >= least and names[c] not in _PARTS)
    held = set(content)
    if names[region] not in ("", "html", "body"):
        inside = within(lambda c: c == region)
        return _joined(reader, [i for i in keep if i in held or inside[lines[i][2]]], keep)

    # the whole page: a line that is no part of a text must be content by its own
    # ratio, and a part of a text must stand beside content, or be a heading before it
    def own(i):
        return names[lines[i][2]] in TEXT_LINES

    def place(i):
        c = lines[i][2]
        return parents[c] if own(i) else c

    held = {i for i in content if own(i) or ratio[i] >= cut}
    beside, last = {place(i) for i in held}, max(held, default=-1)
    first = min([i for i in keep if names[lines[i][2]] in HEADINGS][:1] + content[:1])
    return " ".join(lines[i][0] for i in keep if i in held or first <= i and own(i) and (
        place(i) in beside or i < last and names[lines[i][2]] in HEADINGS))


def _joined(reader: BlockReader, chosen: list[int], keep: list[int]) -> str:
    """The chosen lines, and the heading of the first level that comes last before
    them, where they hold none."""
    lines, names = reader.lines, reader.names

    def title(i):
        return names[lines[i][2]] == "h1"

    if chosen and not any(title(i) for i in chosen):
        before = [i for i in keep if i < chosen[0] and title(i)]
        chosen = before[-1:] + chosen
    return " ".join(lines[i][0] for i in chosen)


#: elements that are lines or parts of a text, not the whole
_PARTS = frozenset("""blockquote caption dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre section table
tbody td tfoot th thead tr ul""".split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    cols = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    schema = cols.drop("html").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        reader = BlockReader()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [main_text(reader, h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return cols.mapInArrow(run, schema)
