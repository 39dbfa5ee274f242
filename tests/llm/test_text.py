"""Token counts, packing and page text against the libraries."""

import random
import sys
import zlib
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from flowmetrics.llm import htmltext, packing, tokencount  # noqa: E402

ODD = ["á b", "A\x1cb", "İstanbul ΣΑΣ", "<|endoftext|> x<|endoftext|>y", "it's I'll 'S don't", "é ß x y_z", "日本 語 漢字",
       "1 22 a1b2 ²³½", " ", "", "x\x85y z　w", "ͅ ́b", "  a  b ", "\U0001F600\U0001F601 x", "▁a", "<unk> <unk>a", "\n\t x", "a" * 500]


def _unigram():
    from tokenizers import Tokenizer, models, pre_tokenizers
    vocab, unk = tokencount.load_vocabulary()
    t = Tokenizer(models.Unigram(vocab, unk_id=unk, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    return t, tokencount.CountViterbi(vocab, unk)


def test_counts_equal_the_tokenizer(spark):
    t, counter = _unigram()
    texts = [r.text for r in H.sample(spark).limit(60).collect()] + ODD
    for text in texts:
        assert counter.count(text) == len(t.encode(text).ids), text[:60]


def test_ties_and_fractions_equal_the_tokenizer():
    from tokenizers import Tokenizer, models
    rng = random.Random(5)
    for trial in range(60):
        pieces = {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(8)}
        step = rng.choice([1.0, 0.1])
        vocab = [("<unk>", 0.0)] + [(p, -step * rng.randint(1, 4)) for p in sorted(pieces)]
        t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
        counter = tokencount.CountViterbi(vocab, 0)
        for _ in range(20):
            text = "▁" + "".join(rng.choice("abc▁") for _ in range(rng.randint(0, 12)))
            assert counter.count(text) == len(t.encode(text).ids), (vocab, text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_ids_equal_the_tokenizer(text):
    cache = _cache()
    want = cache.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(cache.ids(text), "<u4").tolist() == want


def _cache(made=[]):  # noqa: B006
    if not made:
        made.append(packing.PartCache(packing.tokenizer_path()))
    return made[0]


def test_ids_of_odd_texts():
    for text in ODD:
        want = _cache().tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(_cache().ids(text), "<u4").tolist() == want, text


def check_packing(docs, rows, size):
    ids = {}
    for i, (doc, text) in enumerate(docs):
        ids.setdefault(doc, []).append(_cache().tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    want = sorted((repr(d), s // size, s, len(x[s:s + size]), zlib.crc32(np.array(x[s:s + size], "<u4").tobytes()))
                  for d, xs in ids.items() for x in xs for s in range(0, len(x), size))
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(seqs), -(-sum(w[3] for w in want) // size)


def test_packing_of_odd_rows(spark):
    docs = [(r[0], r[1]) for r in H.odd_rows()]
    rows = packing.pack(H.odd_documents(spark)).collect()
    used, least = check_packing(docs, rows, packing.MAX_LEN)
    assert used <= least + 1
    assert packing.pack(H.no_documents(spark)).count() == 0


def test_packing_of_the_corpus(spark):
    docs = [(r.doc_id, r.text) for r in H.sample(spark).collect()]
    used, least = check_packing(docs, packing.pack(H.sample(spark)).collect(), packing.MAX_LEN)
    assert used <= least * 1.02 + 1


def test_plan_uses_every_length_once():
    rng = random.Random(2)
    for size in (16, 100):
        for _ in range(20):
            hist = {}
            for _ in range(rng.randint(1, 400)):
                v = rng.randint(1, size)
                hist[v] = hist.get(v, 0) + rng.randint(1, 5)
            used = {}
            for content, n in packing.make_plan(hist, size):
                assert sum(v * k for v, k in content) <= size
                for v, k in content:
                    used[v] = used.get(v, 0) + k * n
            assert used == hist


def test_patterns_fit_a_histogram_of_pairs():
    hist = {10: 500, 6: 500, 16: 40, 4: 1}
    plan = packing.make_plan(hist, 16)
    assert sum(n for _, n in plan) == 541
    assert packing.make_plan({}, 16) == []


PAGES = [
    ("<div id=main><h2>Head</h2><p>Some longer text of the body, with words.</p><p>Short.</p><p>Another long paragraph of"
     " the text here.</p></div><div class='sidebar'><p>Side text that is long too, really long.</p></div><footer>f</footer>",
     "Head Some longer text of the body, with words. Short. Another long paragraph of the text here."),
    ("plain text only", "plain text only"), ("<p>a&nbsp;b&amp;c<p>d<b>e</b>f<br>g", "a b&c def g"),
    ("<html><body><header>H</header><article><h1>T</h1><p>x y</p><div class=comments><p>c</p></div></article></body>", "T x y"),
    ("<script>x", ""), ("", ""), (None, ""), ("<ul><li>a<li>b</ul>", "a b"), ("<form><p>x</p></form>", ""),
    ("<article><p>one</p></article><article><p>two</p></article>", "one two"),
    ("<article><p>text</p><aside>no</aside><div id='cookie-notice'>no</div><!-- no --><style>p{}</style></article>", "text"),
    ("<nav><ul><li>m</ul></nav><article><p><b>bold<br>next</p><p>&copy; &#233;</p></article>", "bold next © é"),
]


def test_pages(spark):
    df = spark.createDataFrame([(i if i else None, None, p, "x") for i, (p, _) in enumerate(PAGES)],
                               "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in htmltext.extract(df).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i or None].text == want and got[i or None].n_chars == len(want)
    assert htmltext.extract(df.limit(0)).count() == 0
    again = htmltext.extract(df.union(df))
    assert again.count() == 2 * len(PAGES)


SENTENCE = "A sentence of the story with a good number of words in it. "


def test_region_keeps_the_whole_story():
    def text(page):
        return htmltext.main_text(htmltext.BlockReader(), page)

    prose = (SENTENCE * 4).strip()
    items = " ".join(f"Item {i}. {prose}" for i in range(6))
    listed = "".join(f"<li>Item {i}. {prose}</li>" for i in range(6))
    cells = "".join(f"<tr><td>Item {i}. {prose}</td></tr>" for i in range(6))
    parts = "".join(f"<p>Item {i}. {prose}</p>" for i in range(6))
    head = f"<h1>Title</h1><p>{prose}</p><p>{prose}</p><p>{prose}</p>"
    whole = f"Title {prose} {prose} {prose} {items}"
    for body in (f"<ul>{listed}</ul>", f"<table>{cells}</table>", f"<section>{parts}</section>", f"<div>{parts}</div>"):
        assert text(f"<body><nav>menu</nav><div>{head}{body}</div></body>") == whole
    got = text(f"<body><div id=story>{head}{parts}</div><article class=card><p>{prose}</p></article></body>")
    assert got == f"{whole} {prose}"
    assert text(f"<body><div>short</div><article>{head}{parts}</article></body>") == whole


def test_long_page():
    page = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    assert len(htmltext.main_text(htmltext.BlockReader(), page)) == 20_000 * 10 - 1


def test_token_counts_of_odd_rows(spark):
    got = tokencount.token_counts(H.odd_documents(spark)).collect()
    assert len(got) == len(H.odd_rows())
    assert [(r.n_tokens, r.n_chars) for r in got if r.doc_id == 3] == [(0, 0)]
    assert tokencount.token_counts(H.no_documents(spark)).count() == 0


def test_a_worker_reads_the_tokenizer_once():
    """A worker does many tasks, each with a cache of its own."""
    path = packing.tokenizer_path()
    a, b = packing.PartCache(path), packing.PartCache(path)
    assert a.tokenizer is b.tokenizer
    assert a.ids("one two") == b.ids("one two") and a is not b and a.words is not b.words
