"""Main text of pages: pages written by hand with their texts, the trees and the decoding recomputed plainly, ties, and markup left open."""

import itertools
import math

import numpy as np
import pytest

from corpusmill.llm import html, trees

BODY = "<h1>Head line</h1><p>First paragraph of the article stands here. It has sentences.</p><p>Second paragraph goes on for a while, and ends.</p>"
TEXT = "Head line\nFirst paragraph of the article stands here. It has sentences.\nSecond paragraph goes on for a while, and ends."
ARTICLE = f"<article>{BODY}</article>"
MENU = '<ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta</a></li><li><a href="/c">Gamma</a></li></ul>'

PAGES = [
    # anchors and links
    f"<body><a name=top>{ARTICLE}", f"<article><a name=s1>{BODY}</article>", f"<article><a href=/x>{BODY}</a></article>", f"<article><a id=here></a>{BODY}</article>", f"<nav><a href=/>Home<a href=/b>News<a href=/c>Shop</nav><main>{BODY}</main>",
    f'<div class="menu"><a href=/>Home</a> | <a href=/b>News</a> | <a href=/c>Shop</a></div>{ARTICLE}',
    # drawings and formulas left open
    f"<body><svg><path>{ARTICLE}", f"<div><math><mi>{BODY}</div>", f"<body><svg><g><rect/><circle></g></svg>{ARTICLE}",
    # what stands for scripts, frames and films
    f"<article>{BODY}<noscript>Enable JavaScript</noscript></article>", f"<noscript><p>Enable JavaScript</p></noscript>{ARTICLE}", f"<noscript>left open{ARTICLE}", f"<article>{BODY}<video src=x>Your browser is old</video><iframe src=y>no frames</iframe></article>", f"<article>{BODY}<audio>no sound<source src=z></audio></article>",
    # form controls
    f"<option>Stray{ARTICLE}", f"<form class=search><input><select><option>a<option>b</select><button>Go</button></form>{ARTICLE}", f"<div><label>Name</label><textarea>text</textarea></div>{ARTICLE}".replace("<label>Name</label>", ""),
    # roles
    f"<div role=dialog><p>Please accept our terms to go on.</p></div>{ARTICLE}", f"<div role=navigation>{MENU}</div>{ARTICLE}<div role=contentinfo>Some Company Ltd</div>", f"<div role=complementary><h3>Related</h3>{MENU}</div>{ARTICLE}",
    # parts without any name
    f"<div>We use cookies on this site to improve it.</div>{ARTICLE}", f"<div>Home | About | Contact</div>{ARTICLE}<div>© 2024 Some Company</div>", f"{ARTICLE}<div>3 comments</div><div>Ann says: what a nice one</div>", f"{ARTICLE}<div>Subscribe to our newsletter</div>", f"{ARTICLE}<div>Copyright Some Company. All rights reserved.</div>",
    # named parts
    f'<header><h2>My site</h2></header>{ARTICLE}<footer>2024</footer>', f'{ARTICLE}<section id="comments"><h3>Comments</h3><p>Nice one, I liked it.</p></section>', f'<div class="sidebar"><h3>Popular</h3>{MENU}</div><div class="content">{BODY}</div>', f'<div class="ad">Buy it now.</div>{ARTICLE}<div class="ad">Or later.</div>', f'<div class="cookie-notice"><p>We use cookies.</p></div>{ARTICLE}',
    f"<html><head><title>t</title><style>p {{}}</style><script>var a = '<p>no</p>'</script></head><body>{ARTICLE}</body></html>", f"<article>{BODY}<!-- <p>not this</p> --></article>", f"<article>{BODY}<template><p>nor this</p></template></article>",
]


@pytest.fixture(scope="module")
def model():
    return html.trained()


@pytest.mark.parametrize("page", PAGES, ids=range(len(PAGES)))
def test_pages_by_hand(model, page):
    assert next(html.extract([page], *model)) == TEXT


@pytest.mark.parametrize(("page", "text"), [
    ("<p>The only paragraph is about cookies.</p>", "The only paragraph is about cookies."),
    ("<article><h1>Cookies</h1><p>Cookies are baked goods and a subject of copyright.</p></article>", "Cookies\nCookies are baked goods and a subject of copyright."),
    ("<article><p>one | two | three | four</p><p>© 2024 all rights reserved</p><div>Subscribe</div></article>", "one | two | three | four\n© 2024 all rights reserved\nSubscribe"),
    ("<article><h2>Comments</h2><p>3 comments were made on the plan, he says: no.</p></article>", "Comments\n3 comments were made on the plan, he says: no."),
    ("<article><p>Here <math><mi>x</mi></math> and <svg><text>drawn</text></svg> stand.</p><p>So.</p></article>", "Here x and drawn stand.\nSo."),
    ("bare text", "bare text"), ("", ""), ("<p></p>", ""),
])
def test_clean_texts_stay(model, page, text):
    assert next(html.extract([page], *model)) == text


def test_given_pages(model):
    """All text of the articles of the given pages, and nothing else, by a plain cut of their one layout."""
    import re

    import duckdb

    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        if page and page.count("<article") == 1:
            inner = re.search(r"<article[^>]*>(.*?)</article>", page, re.S)[1]
            got = next(html.extract([page], *model))
            want = next(html.extract([f"<article>{inner}</article>"], *model))
            whole = html.parse(f"<article>{inner}</article>")
            assert got == want == html.main_text(whole, np.ones(len(whole.tags), bool))


# the trees and the decoding


def test_decoding_is_the_likeliest(model):
    """Against all labellings of small trees."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        parents = [-1, *(int(rng.integers(0, v)) for v in range(1, n))]
        odds = rng.normal(size=n) * 2
        score = lambda keep, odds=odds: sum(-math.log1p(math.exp(-o)) if k else -math.log1p(math.exp(o)) for k, o in zip(keep, odds, strict=True))
        allowed = [k for k in itertools.product([False, True], repeat=n) if all(not k[v] or k[parents[v]] for v in range(1, n))]
        assert score(html.decode(parents, odds)) == pytest.approx(max(map(score, allowed)))


def test_decoding_of_ties():
    """Odds of exactly one half: no main text."""
    assert html.decode([-1, 0, 0], np.zeros(3)).tolist() == [False, False, False]


def plain_boost(x, y, rounds, depth, rate=0.3, ridge=2.0, least=2.0):
    """Trees by plain loops: each level's nodes split by the feature of the largest gain, the first of equal ones."""
    p0 = (sum(y) / len(y) + 1e-6) / (1 - sum(y) / len(y) + 1e-6)
    score, out = [math.log(p0)] * len(y), []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g, h = [t - q for t, q in zip(y, p, strict=True)], [q * (1 - q) for q in p]
        splits, at = [], [0] * len(y)
        for level in range(depth):
            for node in range(2**level):
                rows = [i for i in range(len(y)) if at[i] == node]
                best = None
                for f in range(len(x[0])):
                    sides = [[i for i in rows if x[i][f] == side] for side in (0, 1)]
                    hs = [sum(h[i] for i in s) for s in sides]
                    gain = -1.0 if min(hs) < least else sum(sum(g[i] for i in s) ** 2 / (hh + ridge) for s, hh in zip(sides, hs, strict=True))
                    if best is None or gain > best[0] + 1e-6:
                        best = (gain, f)
                splits.append(best[1])
            first = len(splits) - 2**level
            at = [2 * a + x[i][splits[first + a]] for i, a in enumerate(at)]
        leaves = [rate * sum(g[i] for i in range(len(y)) if at[i] == leaf) / (sum(h[i] for i in range(len(y)) if at[i] == leaf) + ridge) for leaf in range(2**depth)]
        score = [s + leaves[a] for s, a in zip(score, at, strict=True)]
        out.append((splits, leaves))
    return out, score


def test_trees_are_those_of_plain_loops():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, size=(150, 7))
    y = ((x[:, 0] & x[:, 3]) | (rng.random(150) < 0.15)).astype(float)
    model = trees.boost(x.astype(np.uint8), y, rounds=4, depth=3)
    want, score = plain_boost(x.tolist(), y.tolist(), 4, 3)
    assert np.allclose(trees.log_odds(x.astype(np.uint8), model), score, atol=1e-4)
    assert [f.tolist() for f in model[0]] == [s for s, _ in want]


def test_odds_are_those_of_plain_walks(model):
    features, (splits, leaves, start) = model
    page = html.parse(PAGES[-6])
    x = np.concatenate(list(features.of(page)))
    depth = int(math.log2(len(leaves[0])))
    for row, odds in zip(x, trees.log_odds(x, (splits, leaves, start)), strict=True):
        total = start
        for tree, leaf in zip(splits, leaves, strict=True):
            at = 0
            for level in range(depth):
                at = 2 * at + int(row[tree[2**level - 1 + at]] > 0)
            total += leaf[at]
        assert odds == pytest.approx(total)
