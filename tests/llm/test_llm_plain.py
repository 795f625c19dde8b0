"""The operators' numpy parts against brute force; no Spark."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tablelens.llm import bpe, decontaminate, embeddings, html_extract, near_dup, repeats, toxicity
from tablelens.llm.common import chunks, runs

random.seed(5)


def buffer(texts):
    ((_, _, data, offsets),) = chunks(pa.array(texts, pa.string()), 1 << 30)
    return data, offsets


def test_bpe_equals_tiktoken():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    ranks = bpe.load_ranks(bpe.default_path())
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    alphabet = "ab'srtveldm  \n\t.,1２é中 　'’!?ſⅣ😀"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    texts += [None, "", "'s", " '", "  ", "it's 'rex we'll", "x" * 3000, "ab" * 2000, " " * 500 + "a", "\r\n\n a"]
    data, offsets = buffer(texts)
    ids, count = ranks.encode(data, offsets)
    ends = np.cumsum(count)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, count)] == [enc.encode_ordinary(t or "") for t in texts]
    assert ranks.decode(ids).tobytes() == data.tobytes()


def test_fm_index_finds_all_occurrences():
    for n in (1, 2, 50, 400):
        text = np.array([random.randint(0, 3) for _ in range(n)])
        index = decontaminate.FMIndex(text, 5, sample=3)
        for width in (1, 2, 5):
            patterns = np.array([[random.randint(0, 4) for _ in range(width)] for _ in range(20)])
            lo, hi = index.search(patterns)
            for p, a, b in zip(patterns, lo, hi):
                want = [i for i in range(n - width + 1) if (text[i : i + width] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination_equals_plain_search():
    words = ["a", "b", "c", "Dé", "x1"]
    make = lambda n: " ".join(random.choice(words) for _ in range(n))
    items = [(str(k), make(random.randint(0, 6))) for k in range(8)] + [("9", None), (None, "a b c"), ("1", "x1 x1")]
    texts = [make(random.randint(0, 60)) for _ in range(40)] + [None, "", "...", "A-b"]
    queries = decontaminate.Queries(items, window=4)
    data, offsets = buffer(texts)
    n_words, n_hit, _, (row, window) = decontaminate.find(data, offsets, queries)
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for r, t in enumerate(texts):
        ws, hit, met = pattern.findall(lower(t)), set(), set()
        for item, text in items:
            own = pattern.findall(lower(text))
            for w in {tuple(own[i : i + 4]) for i in range(max(1, len(own) - 3))} if own else ():
                for i in range(len(ws) - len(w) + 1):
                    if tuple(ws[i : i + len(w)]) == w:
                        hit.update(range(i, i + len(w)))
                        if item is not None:
                            met.add(item)
        got = {o for k in window[row == r] for o in queries.owners[k]}
        assert (n_words[r], n_hit[r], got) == (len(ws), len(hit), met)


def test_collection_classes_equal_windows():
    width = 6
    texts = [bytes(random.choice(b"ab") for _ in range(random.randint(width, 14))) for _ in range(60)]
    heads = [t[:-width] for t in texts]
    tails = np.array([list(t[-width:]) for t in texts], np.uint8)
    classes = repeats.collection(heads, tails, width)
    # equal distance from the end and equal windows: equal classes; unequal windows: unequal
    seen = {}
    for t, c in zip(texts, classes):
        for i, k in enumerate(c):
            key = (len(t) - i, t[i : i + width])
            assert seen.setdefault(key, k) == k
    by_class = {}
    for (_, w), k in seen.items():
        assert by_class.setdefault(k, w) == w


def test_anchors_cover_windows_alike():
    base = bytes(random.choice(b"abcd ") for _ in range(900))
    data = np.frombuffer(base, np.uint8)
    at, _, first = repeats.anchors(data, 200)
    inner, _, _ = repeats.anchors(data[300:600], 200)
    assert set(inner + 300) <= set(at) and first[0] == 0
    assert len(repeats.anchors(data[:199], 200)[0]) == 0


def test_shingle_sets():
    data, offsets = buffer(["A b c d e", "a b  c\td\ne", "a b", None, "a b", "a b c d"])
    sets = [*near_dup.shingle_sets(data, offsets, 4)]
    assert [len(s) for s in sets] == [2, 2, 1, 0, 1, 1]
    assert (sets[0] == sets[1]).all() and (sets[2] == sets[4]).all() and sets[2][0] != sets[5][0]
    assert near_dup.least_overlap(32, 0.8) >= 9


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(1)
    x = rng.random((900, 6)) < 0.3
    score = x @ np.array([2.0, 2.0, 1.0, 0, 0, 0])
    grade = np.digitize(score, [0.5, 2.5]).astype(np.int64)
    rows, cols = np.nonzero(x)
    weights, cutoffs = toxicity.fit_ordinal(rows, cols, grade, 6)
    assert (np.diff(cutoffs) > 0).all() and weights[:3].min() > np.abs(weights[3:]).max()
    severity, _ = toxicity.Model(np.zeros(6, np.uint64), weights, cutoffs).severity(x @ weights)
    assert severity[grade == 2].mean() > severity[grade == 1].mean() > severity[grade == 0].mean()


def test_rotation_balances_bits():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 16))
    code = x @ embeddings.learn_rotation(x, 16) >= 0
    assert np.abs(code.mean(axis=0) - 0.5).max() < 0.1


def test_html_blocks():
    page = """<html><head><title>t</title><script>if(a<b)"</p>"</script></head><body><nav><a>menu</a></nav>
    <header>site</header><article><h1>T &amp; x</h1><p>one <b>two</b>
    three<p>four<br>five<div class="ad">buy</div><form>f</form><section id="comments">c</section></article><footer>f</footer></body>"""
    assert " ".join(html_extract.blocks(html_extract.parse(page))) == "T & x one two three four five"
    for odd in ["", "<", "<p", "plain", "</p></div>x", "<!-- open", "<script>", "<a b='", "&#x41;&nope;"]:
        html_extract.blocks(html_extract.parse(odd))
    deep = "<div>" * 5000 + "x"
    assert html_extract.blocks(html_extract.parse(deep)) == ["x"]


def test_html_keeps_the_article_by_names():
    page = """<body><div class="site-menu">menu</div><article><div class="article-header"><h1>Title</h1></div>
    <h2 id="related-work">Related work</h2><p class="notice-period">one</p><section id="legal-history"><h2 id="search">Search</h2>two</section>
    <pre><span class="comment"># three</span></pre><div class="post-share-of-votes">four</div>
    <div class="related">r</div><ul class="links share">s</ul><div id="comments">c</div><p class="ad">a</p></article></body>"""
    assert " ".join(html_extract.blocks(html_extract.parse(page))) == "Title Related work one Search two # three four"


def test_runs_do_not_cross_rows():
    flag = np.array([1, 1, 0, 1, 1, 1], bool)
    s, e, r = runs(flag, np.array([0, 4, 4, 6]))
    assert (s.tolist(), e.tolist(), r.tolist()) == ([0, 3, 4], [2, 4, 6], [0, 0, 2])
