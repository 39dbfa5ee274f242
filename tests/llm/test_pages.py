"""Main text of hand-labelled pages: what is lost, what is kept wrongly, time."""

import sys
import time
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from flowmetrics.llm import htmltext  # noqa: E402

P = [f"Paragraph {n} tells a good part of the story, at some length, so that it counts as running text of the page." for n in range(9)]
A, B, C = (f"<p>{p}</p>" for p in P[:3])
TEXT = " ".join(P[:3])
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>"
FOOT = "<footer>Copyright by the owner</footer>"

# (page, its main text)
PAGES = {
    "with-sidebar": (f'<body><div class="page with-sidebar">{NAV}<h1>Title</h1>{A}{B}{C}</div>{FOOT}', f"Title {TEXT}"),
    "no-header": (f"<body><div id=content class='no-header'><h1>Title</h1>{A}{B}{C}</div>{FOOT}", f"Title {TEXT}"),
    "page form": (f"<body><form action=/post>{NAV}<input name=q><h1>Title</h1>{A}{B}{C}<button>Send</button></form>{FOOT}", f"Title {TEXT}"),
    "heading id": (f"<article><h1>Title</h1>{A}<h2 id='related-work'>Related work</h2>{B}{C}</article>", f"Title {P[0]} Related work {P[1]} {P[2]}"),
    "section id": (f"<article><h1>Title</h1>{A}<section id='social-history'>{B}{C}</section></article>", f"Title {TEXT}"),
    "entry header": (f"<article><div class='entry-header'><h1>Title</h1></div>{A}{B}{C}</article>", f"Title {TEXT}"),
    "header in article": (f"<article><header><h1>Title</h1></header>{A}{B}{C}</article>", f"Title {TEXT}"),
    "notice paragraph": (f"<article><h1>Title</h1><p class='notice'>{P[3]}</p>{A}{B}</article>", f"Title {P[3]} {P[0]} {P[1]}"),
    "cell": (f"<article><h1>Title</h1>{A}{B}<table><tr><td class='header'>Name of it</td><td>Value of it</td></tr></table></article>",
             f"Title {P[0]} {P[1]} Name of it Value of it"),
    "sibling divs": (f"<body><div>HOME ABOUT</div><h1>Title</h1><div>{A}{B}</div><div>{C}<p>{P[3]}</p></div><div>COPYRIGHT</div>",
                     f"Title {TEXT} {P[3]}"),
    "bare divs": (f"<body><div>HOME ABOUT</div><div>{P[0]} {P[1]}</div><div>{P[2]} {P[3]}</div><div>COPYRIGHT</div>", f"{TEXT} {P[3]}"),
    "disqus": (f"<body><article><h1>Title</h1>{A}{B}{C}</article><div id='disqus_thread'><p>{P[4]}</p><p>{P[5]}</p></div>", f"Title {TEXT}"),
    "discussion": (f"<body><div class=story><h1>Title</h1>{A}{B}{C}</div><div class='discussion'><p>{P[4]}</p></div>", f"Title {TEXT}"),
    "article comments": (f"<body><article><h1>Title</h1>{A}{B}{C}</article><ol><li><article><p>{P[4]}</p></article></li></ol>", f"Title {TEXT}"),
    "long comments": (f"<body><article><h1>Title</h1>{A}</article><section id=comments>" + "".join(f"<p>{p}</p>" for p in P[3:]) + "</section>",
                      f"Title {P[0]}"),
    "site furniture": (f"<body><div class='site-header'>The great site of all things and more of them, every day</div>{NAV}<div id='main'><h1>Title</h1>{A}{B}{C}</div>"
                       f"<div class='sidebar'><p>{P[4]}</p></div><div class='cookie-notice'><p>{P[5]}</p></div><div class=ad>{P[6]}</div>{FOOT}", f"Title {TEXT}"),
    "camel case": (f"<body><div class='mainContent'><h1>Title</h1>{A}{B}{C}</div><div class='sideBar siteFooter'>{P[4]}</div>"
                   f"<div class='newsletterSignup'>{P[5]}</div>", f"Title {TEXT}"),
    "title above": (f"<body>{NAV}<h1>Title</h1><div class=text>{A}{B}{C}</div>{FOOT}", f"Title {TEXT}"),
    "short last paragraph": (f"<article><h1>Title</h1>{A}{B}<p>The end.</p></article>{FOOT}", f"Title {P[0]} {P[1]} The end."),
    "newsletter form": (f"<article><h1>Title</h1>{A}{B}<form><p>{P[4]}</p><input></form>{C}</article>", f"Title {TEXT}"),
    "hidden and scripts": (f"<article><script>var a='<p>no</p>';</script><h1>Title</h1>{A}<div hidden>{P[4]}</div>{B}<style>p{{}}</style></article>",
                           f"Title {P[0]} {P[1]}"),
    "references": ("<article><h1>A &amp; B</h1><p>caf&eacute;\n\t  x &#8212; y</p></article>", "A & B café x — y"),
    "ad longer than the article": (f"<div class=ad>{P[0]} {P[1]}</div><article><h1>T</h1><p>Short text.</p></article>", "T Short text."),
    "share of posts": (f"<article><h1>Title</h1>{A}{B}<div class='related-posts'><p>{P[4]}</p></div><div class='share-buttons'>Share it now</div></article>",
                       f"Title {P[0]} {P[1]}"),
}


def text_of(html):
    return htmltext.main_text(htmltext.BlockReader(), html)


@pytest.mark.parametrize("name", sorted(PAGES))
def test_labelled_page(name):
    html, want = PAGES[name]
    assert text_of(html) == want


def test_recall_and_precision_of_the_labelled_pages():
    found = wanted = right = 0
    for html, want in PAGES.values():
        a, b = Counter(text_of(html).split()), Counter(want.split())
        found, wanted, right = found + a.total(), wanted + b.total(), right + (a & b).total()
    assert right / wanted >= 0.99 and right / found >= 0.99


@pytest.mark.parametrize("page", [
    lambda n: "<div>" * n + "text " * 9 + "</div>" * n, lambda n: "<div>x" + "</b>" * n, lambda n: "<div>" * n + "</b>" * n,
    lambda n: "<span>" * n + "<p>a</p>" * n, lambda n: "<ul>" + "<li><div>" * n, lambda n: "<form><div class=ad>" * n + "x",
    lambda n: "<article>" * n + "<p>words and words</p>"])
def test_time_grows_with_the_page(page):
    def seconds(n):
        start = time.process_time()
        text_of(page(n))
        return time.process_time() - start
    seconds(1000)
    small, large = min(seconds(3000) for _ in range(3)), min(seconds(24_000) for _ in range(2))
    assert large < 3 * 8 * small + 0.2  # eight times the page; quadratic would be 64 times


def test_clashing_columns_and_odd_pages(spark):
    from pyspark.sql import functions as F
    rows = [(1, "u", PAGES["cell"][0]), (1, "u", PAGES["cell"][0]), (None, None, None), (2, "u", ""), (3, "u", "<p"),
            (4, "u", "no markup at all"), (5, "u", NAV)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string") \
        .select("*", *[F.lit("x").alias(c) for c in ("text", "n_chars", "lines", "row")])
    got = [(r.page_id, r.text, r.n_chars) for r in htmltext.extract(df).collect()]
    want = {1: PAGES["cell"][1], None: "", 2: "", 3: "<p", 4: "no markup at all", 5: ""}
    assert got == [(i, want[i], len(want[i])) for i, _, _ in rows]


def test_given_pages(spark):
    """Of the given pages the article's blocks, and nothing else."""
    import re
    for r in H.sample(spark, "pages").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html or "", re.S)
        if inner:
            assert set(text_of(r.html).split()) <= set(text_of(f"<div>{inner[1]}</div>").split())
