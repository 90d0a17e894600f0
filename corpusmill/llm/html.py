"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Every block-level element is a node. Its features are its tag and its ancestors' tags, the tokens of class, id and role (its own and
inherited) and of what short lines of menus and notices say, depth, density of its subtree (characters, share in links, characters a tag, words, sentence ends) and its
place among its siblings. The trees give the odds that main text lies in the node. Decoding picks the likeliest labelling in which
no node has main text under an ancestor that has none: sums over the children, from the leaves up, then one walk down.

The model is trained on the driver from ``training_pages``: pages written by a rule, in many layouts, whose main blocks are
known. It is a few kilobytes and goes along with the function.

Defined results: null and empty html give an empty text; broken markup is closed where the next block or the end makes it necessary, a link by the next one;
character references are decoded, unknown ones stay as they are; markup comments, scripts, styles, templates, titles, form controls and what stands for scripts, frames and films that can't be shown never count; an object's fallback text, formulas and
drawings' text are text like any other; an anchor without href is no link; a br is white space, other empty tags are nothing; equal rows get equal results; other
columns are kept, columns text and n_chars are replaced. Pages are read whole in one pass, without recursion, in time linear in the page; memory grows with the page by some hundred bytes a node.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusmill.llm.memory import short_batches
from corpusmill.llm.trees import boost, log_odds

INLINE = set("a abbr acronym audio b bdi bdo big canvas cite code data dfn em font i iframe ins kbd label mark math object q s samp small span strike strong sub sup svg time tt u var video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Scripts, styles, inert markup and form controls. A select or button that isn't closed ends with a block that begins, or with what it stands in.
UNREAD = set("script style template title select option optgroup datalist textarea button noscript iframe video audio".split())
CLOSES_P = set("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CELLS = {"li", "dt", "dd", "tr", "td", "th", "body"}
SECTIONS = set("body article main section header footer nav aside h1 h2 h3 h4 h5 h6".split())
ENDS = {"datalist": CLOSES_P, "button": (CLOSES_P | CELLS) - {"div"}} | {t: CLOSES_P | CELLS for t in ("select", "option", "optgroup")} | {t: SECTIONS for t in ("noscript", "iframe", "video", "audio")}
#: Blocks that end drawings and formulas left open, and blocks whose text is their own though a link stands around them.
BREAKS = CLOSES_P | CELLS
OWN_TEXT = set("p article main section h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = set("table ul ol dl body html article section div main aside nav footer header td th form".split())
TAGS = "article main section div p h1 h2 h3 h4 h5 h6 ul ol li table tr td th nav header footer aside form figure figcaption blockquote pre dl dt dd body html center fieldset menu address hr details".split()
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
LINK, SHORT = -2, 160
#: What short lines of menus, notices and the like say; such a line is a token of its node beside its names, if it stands in no paragraph, heading or article.
CUE_TAGS = set("div section footer header aside center li td body".split())
CUES = {
    "~legal": re.compile(r"©|\(c\) ?\d{4}|copyright|all rights reserved", re.I),
    "~cookies": re.compile(r"\bcookies?\b", re.I),
    "~bars": re.compile(r"\S \| \S+.* \| |\S · \S+.* · |\S » \S+.* » "),
    "~replies": re.compile(r"^\s*(?:\d+ )?(?:comments?|replies|responses|reply)\b|\bwrites:|\bsays:|leave a (?:comment|reply)", re.I),
    "~signup": re.compile(r"\b(?:subscribe|newsletter|sign up|log in|sign in)\b", re.I),
}


class Page(HTMLParser):
    """Nodes in page order (a parent before its children) and pieces of text between block boundaries."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.tokens = ["#"], [-1], [[]]
        self.open: list[tuple[str, int]] = [("#", 0)]
        self.nodes, self.inline, self.blocks = [0], [Counter()], Counter()  # open nodes, the inline tags open in each, open block tags
        self.unread: list[str] = []
        self.linked, self.foreign, self.pieces = [0], 0, []  # links open around the text of each open node; pieces: (node, text, in a link) or None at a boundary
        self.said = [""]  # the beginning of each node's own text
        self.marked: list[int] = []

    def _close(self, depth: int) -> None:
        for tag, node in reversed(self.open[depth:]):
            if node >= 0:
                self.pieces.append(None)
                self.nodes.pop()
                self.inline.pop()
                self.linked.pop()
                self.blocks[tag] -= 1
            else:
                self.inline[-1][tag] -= 1
                self.linked[-1] -= node == LINK
                self.foreign -= tag in ("math", "svg")
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        if self.unread:
            if tag not in ENDS.get(self.unread[0], ()):
                if tag not in VOID:
                    self.unread.append(tag)
                return
            self.unread = []
        if tag == "head":  # its end may be left out, and what it holds is unread or empty
            return
        if tag in UNREAD:
            self.unread.append(tag)
            return
        if tag in VOID:
            if tag == "hr":
                self.pieces.append(None)
            elif tag == "br":
                self.pieces.append((self.nodes[-1], " ", False))
            return
        if self.foreign and tag in BREAKS:
            self._close(next(d for d, (t, node) in enumerate(self.open) if node < 0 and t in ("math", "svg")))
        if tag in INLINE or self.foreign:
            if tag == "a" and self.inline[-1]["a"]:  # a link ends where the next one begins
                self._close(max(d for d in range(len(self.open)) if self.open[d][0] == "a"))
            link = tag == "a" and any(k == "href" for k, _ in attrs)
            self.linked[-1] += link
            self.foreign += tag in ("math", "svg")
            self.inline[-1][tag] += 1
            self.open.append((tag, LINK if link else -1))
            return
        ends = CLOSED_BY.get(tag) or ({"p"} if tag in CLOSES_P else ())
        if any(self.blocks[e] > 0 for e in ends):
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth][0] in ends:
                    self._close(depth)
                    break
                if self.open[depth][0] in SCOPES:
                    break
        tokens = [t.lower() for k, v in attrs if k in ("class", "id", "role") and v for t in TOKEN.findall(v)]
        if any(k == "data-main" for k, _ in attrs):
            self.marked.append(len(self.tags))
        self.parents.append(self.nodes[-1])
        self.open.append((tag, len(self.tags)))
        self.nodes.append(len(self.tags))
        self.inline.append(Counter())
        self.linked.append(0 if tag in OWN_TEXT else self.linked[-1])
        self.said.append("")
        self.blocks[tag] += 1
        self.tags.append(tag)
        self.tokens.append(tokens)
        self.pieces.append(None)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.unread:
            if tag in self.unread:
                while self.unread.pop() != tag:
                    pass
                return
            if self.unread[0] not in ENDS or self.blocks[tag] <= 0:
                return
            self.unread = []
        inline = self.inline[-1][tag] > 0
        if not inline and self.blocks[tag] <= 0:
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                self._close(depth)
                return

    def handle_data(self, data):
        if not self.unread:
            node = self.nodes[-1]
            self.pieces.append((node, data, self.linked[-1] > 0))
            if len(self.said[node]) <= SHORT:
                self.said[node] += data[: SHORT + 1]


def parse(html: str) -> Page:
    page = Page()
    page.feed(html)
    page.close()
    within = [False] * len(page.tags)
    for v, (tag, said) in enumerate(zip(page.tags, page.said, strict=True)):
        within[v] = tag in ("article", "main") or (v > 0 and within[page.parents[v]])
        if said and len(said) <= SHORT and tag in CUE_TAGS and not within[v]:
            page.tokens[v] += [cue for cue, found in CUES.items() if found.search(said)]
    return page


NUMERIC = 8
CUTS = [0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.98]


def numbers(page: Page) -> np.ndarray:
    """(nodes, NUMERIC) in 0..1: depth, characters, share in links, characters a tag, words, sentence ends, siblings, share among siblings."""
    n = len(page.tags)
    own = np.zeros((4, n))
    for piece in page.pieces:
        if piece:
            node, text, link = piece
            size = len(text) if not text.isspace() else 0
            own[0, node] += size
            own[1, node] += size * link
            own[2, node] += text.count(" ") + 1 if size else 0
            own[3, node] += text.count(". ") + text.endswith(".") + text.count("? ") + text.count("! ")
    parents, below, depth = page.parents, np.ones(n), np.zeros(n)
    for v in range(n - 1, 0, -1):
        own[:, parents[v]] += own[:, v]
        below[parents[v]] += below[v]
    siblings = np.zeros(n)
    for v in range(1, n):
        p = parents[v]
        depth[v] = depth[p] + 1
        siblings[p] += 1
    count = siblings[parents] if n > 1 else np.ones(n)
    chars_beside = own[0][parents]
    log = lambda a, top: np.minimum(np.log1p(a) / np.log(top), 1)
    out = [depth / 12, log(own[0], 20000), own[1] / np.maximum(own[0], 1), log(own[0] / below, 3000), log(own[2], 4000), np.minimum(own[3] / np.maximum(own[2], 1) * 5, 1),
        log(count, 100), own[0] / np.maximum(chars_beside, 1)]
    return np.stack(out, 1)


ODDS_CUTS = [-3, -2, -1, -0.3, 0.3, 1, 2, 3]


class Features:
    """Columns: cuts of the numbers, tag, parent's tag, tags above, own tokens, inherited tokens, cuts of the tokens' and tags' odds.

    The odds of a token or tag are those of main text in the training nodes that have it; a node has the least of its own, and the least on
    the way from the root, so a rare name weighs as much as its kind.
    """

    def __init__(self, pages: list[Page], labels: list[np.ndarray]):
        seen: dict[str, list[float]] = {}
        for page, label in zip(pages, labels, strict=True):
            for tag, tokens, y in zip(page.tags, page.tokens, label, strict=True):
                for t in {*tokens, "<" + tag}:
                    n = seen.setdefault(t, [1.0, 1.0])
                    n[int(y)] += 1
        self.odds = {t: float(np.log(n[1] / n[0])) for t, n in seen.items()}
        self.tag = {t: i for i, t in enumerate(TAGS)}
        self.token = {t: i for i, t in enumerate(sorted(t for t in seen if t[0] != "<" and len(t) > 1))}
        self.first_tag = NUMERIC * len(CUTS)
        self.first_token = self.first_tag + 3 * len(TAGS)
        self.first_odds = self.first_token + 2 * len(self.token)
        self.width = self.first_odds + 4 * len(ODDS_CUTS)

    def of(self, page: Page, nodes: int = 6000) -> Iterator[np.ndarray]:
        """Rows of the page's nodes in order, some ``nodes`` at a time; between them a node is a few numbers."""
        n, k, m = len(page.tags), len(TAGS), len(self.token)
        values = numbers(page)
        odds = np.zeros((n, 4))
        own, above, said, inherited = [0] * n, [0] * n, [0] * n, [0] * n
        for v, tag in enumerate(page.tags):
            p, tokens = page.parents[v], page.tokens[v]
            odds[v, 0] = min((self.odds.get(t, 0.0) for t in tokens), default=0.0)
            odds[v, 2] = self.odds.get("<" + tag, 0.0)
            own[v] = 1 << i if (i := self.tag.get(tag)) is not None else 0
            for t in tokens:
                if (i := self.token.get(t)) is not None:
                    said[v] |= 1 << i
            if p >= 0:  # what is above or inherited is the parent's and what the parent has above or inherited
                above[v], inherited[v] = above[p] | own[p], inherited[p] | said[p]
                odds[v, 1], odds[v, 3] = min(odds[p, 1], odds[v, 0]), min(odds[p, 3], odds[v, 2])
        width = 3 * k + 2 * m
        for a in range(0, n, nodes):
            b = min(n, a + nodes)
            x = np.zeros((b - a, self.width), dtype=np.uint8)
            x[:, : self.first_tag] = (values[a:b, :, None] > np.array(CUTS)).reshape(b - a, -1)
            rows = [own[v] | (own[page.parents[v]] if v else 0) << k | above[v] << 2 * k | said[v] << 3 * k | inherited[v] << 3 * k + m for v in range(a, b)]
            bits = np.frombuffer(b"".join(r.to_bytes(-(-width // 8), "little") for r in rows), dtype=np.uint8).reshape(b - a, -1)
            x[:, self.first_tag : self.first_odds] = np.unpackbits(bits, axis=1, count=width, bitorder="little")
            x[:, self.first_odds :] = (odds[a:b, :, None] > np.array(ODDS_CUTS)).reshape(b - a, -1)
            yield x


def decode(parents: list[int], odds: np.ndarray) -> np.ndarray:
    """Likeliest labels such that a node with main text has it in all its ancestors."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    s1, s0 = yes.copy(), no.copy()
    for v in range(len(parents) - 1, 0, -1):
        s1[parents[v]] += max(s1[v], s0[v])
        s0[parents[v]] += s0[v]
    keep = s1 > s0
    for v in range(1, len(parents)):
        keep[v] &= keep[parents[v]]
    return keep


def main_text(page: Page, keep: np.ndarray) -> str:
    """Kept text: a line for each block, white space as one space."""
    blocks, run = [], []
    for piece in [*page.pieces, None]:
        if piece is None:
            if run and (text := " ".join("".join(run).split())):
                blocks.append(text)
            run = []
        elif keep[piece[0]]:
            run.append(piece[1])
    return "\n".join(blocks)


#: Names that layouts use for the parts of a page, for the training pages.
PARTS = {
    "header": ["header", "banner", "site-header", "masthead", "top-bar", "branding", "page-header", "logo"],
    "nav": ["menubar", "nav", "menu", "navigation", "navbar", "breadcrumbs", "main-menu", "tabs", "pagination", "toc"],
    "ad": ["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "adsense"],
    "notice": ["dialog", "alertdialog", "cookie-notice", "gdpr", "consent", "alert", "notice", "popup", "modal", "disclaimer"],
    "side": ["complementary", "sidebar", "secondary", "widget", "related", "popular", "recommended", "aside", "trending"],
    "form": ["newsletter", "search", "login", "signup", "subscribe", "contact-form"],
    "share": ["share", "social", "tags", "byline-links", "toolbar"],
    "comments": ["comments", "comment-list", "comment", "discussion", "replies", "responses", "disqus"],
    "footer": ["contentinfo", "footer", "site-footer", "copyright", "bottom", "legal", "colophon"],
    "main": ["content", "main", "post", "entry-content", "story", "article-body", "post-body", "text", "article"],
}


def training_pages(count: int = 400, seed: int = 11) -> Iterator[str]:
    """Pages in many layouts, whose main blocks carry data-main."""
    r = random.Random(seed)
    syllables = "ka lo mi re su ta ven or ist el qua du pi sha no".split()

    def words(a: int, b: int) -> str:
        said = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b))]
        return " ".join(w + ("." if r.random() < 0.12 else "") for w in said).capitalize() + r.choice([".", ".", ""])

    def name(part: str) -> str:
        return r.choice(["", *[f' {k}="{r.choice(PARTS[part])}"' for k in ("class", "class", "id", "role")], f' class="{r.choice(PARTS[part])} {r.choice("abcdefgh")}{r.randint(1, 9)}"'])

    def sure(part: str) -> str:
        return f' {r.choice(["class", "class", "id", "id", "role"])}="{r.choice(PARTS[part])}"'

    def bare() -> str:
        """A part without any name, told by its links or by what it says."""
        x = r.choice(["menu", "menu", "legal", "cookies", "replies", "signup"])
        if x == "menu":
            return f"<div>{r.choice([links(r.randint(3, 9)), ' | '.join(words(1, 1).strip('.') for _ in range(r.randint(3, 7)))])}</div>"
        said = {
            "legal": [f"© {r.randint(1999, 2026)} {words(1, 3)}", f"Copyright {words(1, 3)} All rights reserved.", f"&copy; {words(1, 4)}"], "cookies": [f"{words(1, 5)} cookies {words(1, 6)}", f"We use cookies {words(0, 6)}"],
            "replies": [f"{r.randint(1, 40)} comments", f"{words(1, 2)} says: {words(2, 12)}", f"Leave a reply {words(0, 3)}"], "signup": [f"Subscribe {words(1, 5)}", f"Sign up for our newsletter {words(0, 5)}", "Log in"],
        }[x]
        return f"<div>{r.choice(said)}</div>"

    def links(n: int) -> str:
        items = [f'<a href="/{i}">{words(1, 3)}</a>' for i in range(n)]
        return r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)])

    def part(kind: str) -> str:
        if kind == "nav":
            return r.choice([f"<nav{name('nav')}>{links(r.randint(2, 9))}</nav>", f"<div{sure('nav')}>{links(r.randint(2, 9))}</div>"])
        if kind == "header":
            inner = f"<p>{words(1, 6)}</p>" * r.randint(0, 1) + r.choice(["", f"<h2>{words(1, 4)}</h2>", part("nav")])
            return r.choice([f"<header{name('header')}>{inner}</header>", f"<div{sure('header')}>{inner}{words(1, 5)}</div>"])
        if kind == "side":
            inner = "".join(r.choice([f"<h3>{words(1, 4)}</h3>", f"<p>{words(3, 30)}</p>", links(4)]) for _ in range(r.randint(1, 4)))
            return r.choice([f"<aside{name('side')}>{inner}</aside>", f"<div{sure('side')}>{inner}</div>"])
        if kind == "footer":
            inner = r.choice(["&copy; ", ""]) + r.choice([words(2, 12), f"<p>{words(2, 15)}</p>" + links(3)])
            return r.choice([f"<footer{name('footer')}>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{sure('footer')}>{inner}</div>"])
        if kind == "comments":
            inner = f"<h3>{words(1, 3)}</h3>" * r.randint(0, 1) + "".join(r.choice([f"<p>{words(3, 40)}</p>", f'<div class="comment"><b>{words(1, 2)}</b><p>{words(2, 30)}</p></div>', f"<li>{words(3, 30)}</li>"]) for _ in range(r.randint(1, 5)))
            return f"<{(t := r.choice(['div', 'section', 'ol', 'ul', 'aside']))}{sure('comments')}>{inner}</{t}>"
        if kind == "form":
            return f"<form{name('form')}><label>{words(1, 4)}</label><input name=q><p>{words(2, 12)}</p></form>"
        return f"<{(t := r.choice(['div', 'div', 'section', 'p']))}{sure(kind)}>{r.choice([words(3, 18), links(2) if t != 'p' else words(2, 9)])}</{t}>"

    def main() -> str:
        out = [f"<{(t := r.choice(['h1', 'h1', 'h2']))} data-main>{words(2, 12)}</{t}>"] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.05:
                out.append(f"<{(t := r.choice(['p', 'p', 'div']))} data-main>{words(4, 25)} {r.choice(['copyright', 'cookies', 'newsletter', 'subscribe', 'comments', '|', 'reply'])} {words(4, 40)}</{t}>")
            elif x < 0.78:
                out.append(r.choice([f"<p data-main>{words(1, 80)}</p>", f"<p data-main>{words(8, 120)}</p>", f"<p data-main><b>{words(4, 30)}<br>", f"<div data-main>{words(10, 60)}</div>"]))
            elif x < 0.93:
                out.append(r.choice([f"<h2 data-main>{words(1, 8)}</h2>", f"<blockquote data-main>{words(5, 40)}</blockquote>", f"<ul><li data-main>{words(2, 20)}</li><li data-main>{words(2, 20)}</li></ul>", f"<pre data-main>{words(5, 30)}</pre>", f"<table><tr><td data-main>{words(1, 6)}</td><td data-main>{words(1, 6)}</td></tr></table>", f"<ol><li data-main>{words(2, 15)}</li></ol>"]))
            else:
                out.append(part(r.choice(["ad", "share", "form", "notice", "side"])))
        return "".join(out)

    for _ in range(count):
        tag = r.choice(["article", "article", "main", "section", "div", "div", "td"])
        body = f"<{tag}{name('main') if tag in ('article', 'main') else sure('main')}>{main()}{part('share') if r.random() < 0.3 else ''}{part('comments') if r.random() < 0.25 else ''}</{tag}>"
        if tag == "td":
            body = f"<table><tr><td>{links(4)}</td>{body}</tr></table>"
        if r.random() < 0.3:
            body = f"<{(w := r.choice(['main', 'div', 'section']))}{name('main')}>{body}</{w}>"
        before = [part(k) for k in ("header", "nav", "ad", "notice", "form") if r.random() < 0.6] + [bare() for _ in range(2) if r.random() < 0.2]
        after = [bare() for _ in range(3) if r.random() < 0.2] + [part(k) for k in ("side", "comments", "ad", "form", "footer", "notice") if r.random() < 0.55] + [bare() for _ in range(2) if r.random() < 0.2]
        wrap = r.choice(["{}", "{}", '<div class="wrapper">{}</div>', '<div id="page">{}</div>'])
        yield "<html><body>" + wrap.format("".join(before) + body + "".join(after)) + "</body></html>"


@lru_cache(1)
def trained() -> tuple[Features, tuple]:
    pages, labels = [parse(h) for h in training_pages()], []
    for page in pages:
        label = np.zeros(len(page.tags))
        label[page.marked] = 1
        for v in range(len(label) - 1, 0, -1):
            label[page.parents[v]] = max(label[page.parents[v]], label[v])
        labels.append(label)
    features = Features(pages, labels)
    return features, boost(np.concatenate([x for p in pages for x in features.of(p)]), np.concatenate(labels))


def extract(htmls: Iterator[str | None], features: Features, model: tuple, nodes: int = 6000) -> Iterator[str]:
    """Main text of each page, in order; the trees judge some ``nodes`` nodes, or a page, at a time."""

    def odds_of(pages: list[Page | None]) -> np.ndarray:
        out, held = [np.zeros(0)], []
        for x in (x for p in pages if p for x in features.of(p, nodes)):
            held.append(x)
            if sum(map(len, held)) >= nodes:
                out.append(log_odds(np.concatenate(held), model))
                held = []
        return np.concatenate([*out, log_odds(np.concatenate(held), model)] if held else out)

    def judged(pages: list[Page | None]) -> Iterator[str]:
        odds, at = odds_of(pages), 0
        for page in pages:
            if page is None:
                yield ""
                continue
            yield main_text(page, decode(page.parents, odds[at : at + len(page.tags)]))
            at += len(page.tags)

    held, size = [], 0
    for html in htmls:
        held.append(parse(html) if html else None)
        size += len(held[-1].tags) if held[-1] else 0
        if size >= nodes:
            yield from judged(held)
            held, size = [], 0
    yield from judged(held)


def main_texts(pages: DataFrame, html_col: str = "html", text_out: str = "text", chars_out: str = "n_chars") -> DataFrame:
    """pages without the html, with the main text and its length in code points."""
    features, model = trained()
    at, others = pages.columns.index(html_col), [c for c in pages.columns if c not in (html_col, text_out, chars_out)]
    places = [pages.columns.index(c) for c in others]
    schema = T.StructType([*[pages.schema[c] for c in others], T.StructField(text_out, T.StringType()), T.StructField(chars_out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(extract((h.as_py() for h in batch.column(at)), features, model))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in places], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*others, text_out, chars_out])

    return short_batches(pages).mapInArrow(run, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
