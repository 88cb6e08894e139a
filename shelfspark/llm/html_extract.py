"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every block element gets a row of features: what its subtree holds (text,
links, tags, headings, punctuation, long runs, inputs, in all and by share of the
page), tokens of its tag, class, id and role, its depth, its place and weight
among its siblings, what its neighbours hold, and the same tokens on its
ancestors. Text directly in body counts as a block of its own. Boosted trees
give it a log-odds of being main text. Decoding is hierarchical: an element may
only be kept with its parent, and the kept set is the one of largest total, so
that no answer contradicts an ancestor's. Where that set has no text but the page has
prose, the best closed set that holds some of it is taken.

The trees are trained here, on pages that this module writes itself from random
layouts, of which it knows the main parts. In a share of the pages (FAMILIES) no
name tells anything: elements are plain `div`s of random or misleading classes,
or the article stands in body itself, as paragraphs or bare text; articles may be in
several parts, rich in links, or end in lists of links. Training takes some 15 seconds, on the driver, with a fixed seed.

Defined results: null or empty html has empty text; a page cut off in the
middle counts as far as it goes; a page without main text has empty text;
repeated rows repeat their results; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .html_dom import BLOCK, HEADINGS, LOOSE, Page, parse

#: Tokens of tag, class, id and role, by what they speak of.
LEXICON = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc topnav tabs",
    "head": "header masthead banner topbar logo branding hero",
    "foot": "footer copyright legal colophon contentinfo bottom",
    "side": "aside sidebar related recommended widget rail secondary complementary more also trending popular",
    "advert": "ad ads advert advertisement adslot sponsor sponsored promo promotion banner dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert alertdialog modal popup overlay newsletter subscribe paywall toast",
    "comment": "comment comments reply replies disqus discussion respond responses feedback thread",
    "form": "form search searchbox login signup fieldset input",
    "share": "share sharing social follow tags tag tagged tools buttons",
    "main": "article main content post entry story body text prose articlebody hentry page",
    "byline": "byline author meta date dateline published time credit",
    "part": "question answer answers chapter section part lead intro summary step accepted",
    "quote": "pullquote quote blockquote epigraph callout",
}
_LEXICON = {w: i for i, words in enumerate(LEXICON.values()) for w in words.split()}
_KINDS = len(LEXICON)
_TOKEN = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")
TAGS = ("p", "div", "section", "article", "main", "ul", "ol", "li", "nav", "aside", "header", "footer", "form", "table", "td", "blockquote", "pre", "figure", LOOSE)
N_FEATURES = 2 * _KINDS + len(TAGS) + 34
#: Characters of a run of text that no menu, button or caption has.
LONG = 80


def kinds(page: Page) -> np.ndarray:
    """For each element, which parts of the lexicon its tag and attributes speak of."""
    out = np.zeros((len(page.tags), _KINDS), np.float32)
    for i, (tag, attributes) in enumerate(zip(page.tags, page.attributes)):
        if tag in _LEXICON and tag not in ("body", "input"):
            out[i, _LEXICON[tag]] = 1
        if attributes:
            for word in _TOKEN.findall(attributes):
                k = _LEXICON.get(word)
                if k is not None:
                    out[i, k] = 1
    return out


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the block elements, and their feature rows."""
    n = len(page.tags)
    parents = np.array(page.parents)
    text, links, marks, runs, long, longest, controls = (np.zeros(n) for _ in range(7))
    for element in page.controls:
        controls[element] += 1
    link = [False] * n
    for i in range(1, n):
        link[i] = page.tags[i] == "a" or link[page.parents[i]]
    for element, _, piece in page.runs:
        size = len(piece.strip())
        if size:
            text[element] += size
            runs[element] += 1
            marks[element] += len(_PUNCTUATION.findall(piece))
            long[element] += size >= LONG
            longest[element] = max(longest[element], size)
            if link[element]:
                links[element] += size
    own = text.copy()
    count, paragraphs, headings, anchors = np.ones(n), *(np.array([t in names for t in page.tags], float) for names in (("p",), HEADINGS, ("a",)))
    copyright_sign = np.zeros(n)
    for element, _, piece in page.runs:
        if "©" in piece:
            copyright_sign[element] += 1
    columns = np.stack([text, links, marks, runs, count, paragraphs, headings, anchors, copyright_sign, long, controls], 1)
    titles = np.array([t == "h1" for t in page.tags])
    has_title = titles.copy()
    for i in range(n - 1, 0, -1):
        columns[parents[i]] += columns[i]
        longest[parents[i]] = max(longest[parents[i]], longest[i])
        has_title[parents[i]] |= has_title[i]
    blocks = np.array([i for i in range(1, n) if page.tags[i] in BLOCK and page.tags[i] not in ("html", "body")], int)
    if not len(blocks):
        return blocks, np.empty((0, N_FEATURES), np.float32)
    spoken = kinds(page)
    above = np.zeros_like(spoken)
    for i in range(1, n):
        p = parents[i]
        above[i] = np.maximum(above[p], spoken[p])
    siblings: dict[int, list[int]] = {}
    for i in blocks:
        siblings.setdefault(parents[i], []).append(i)
    place = np.zeros((n, 10))
    density = columns[:, 1] / (columns[:, 0] + 1)
    for group in siblings.values():
        sizes = columns[group, 0]
        whole = sizes.sum() + 1
        same = [page.tags[i] for i in group]
        last = len(group) - 1
        titled = next((k for k, i in enumerate(group) if has_title[i]), None)
        for k, i in enumerate(group):
            before, after = group[max(0, k - 1)], group[min(last, k + 1)]
            place[i] = (
                k / max(1, last), len(group), sizes[k] / whole, same.count(same[k]) / len(group),
                np.log1p(columns[before, 0]) * (k > 0), density[before] * (k > 0), np.log1p(columns[after, 0]) * (k < last), density[after] * (k < last),
                0 if titled is None else 1 + (k > titled) + (k == titled) * 2, sizes[k] / (sizes.max() + 1),
            )
    c = columns[blocks]
    page_text = columns[0, 0] + 1
    depth = np.array(page.depths)[blocks]
    size = c[:, 0] + 1
    position = np.cumsum(own)[blocks] / page_text
    extra = np.stack(
        [
            np.log1p(c[:, 0]), np.log1p(own[blocks]), c[:, 1] / size, c[:, 2] / size, size / c[:, 4], c[:, 0] / page_text, np.log1p(c[:, 4]), np.log1p(c[:, 5]), np.log1p(c[:, 6]), np.log1p(c[:, 7]),
            c[:, 8] > 0, depth, position, *(place[blocks].T), np.array([page.tags[i] in HEADINGS for i in blocks]),
            np.log1p(c[:, 9]), np.log1p(longest[blocks]), np.log1p(c[:, 10]), has_title[blocks], titles[blocks], np.full(len(blocks), np.log1p(columns[0, 9])),
            np.log1p(columns[parents[blocks], 0]), columns[parents[blocks], 1] / (columns[parents[blocks], 0] + 1), np.log1p(columns[parents[blocks], 5]), size / (columns[parents[blocks], 0] + 1),
        ],
        1,
    )
    tag = np.array([[page.tags[i] == t for t in TAGS] for i in blocks])
    return blocks, np.concatenate([spoken[blocks], above[blocks], tag, extra], 1).astype(np.float32)


class Boosted:
    """Gradient-boosted regression trees of fixed depth for two classes, with binned features. `least` is the second-order weight that a child needs."""

    def __init__(self, trees: int = 100, depth: int = 6, rate: float = 0.2, bins: int = 32, least: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._bin(x)
        self.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(len(y), self.bias)
        self.forest = []
        rng = np.random.default_rng(11)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(b, y - p, p * (1 - p), rng)
            self.forest.append(tree)
            score += self._run(tree, b)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, rng: np.random.Generator):
        """Arrays over a complete tree: feature (-1 for none) and cut by inner node, value by leaf. Grown on a random half of the rows."""
        inner = (1 << self.depth) - 1
        feature, cut, value = np.full(inner, -1), np.zeros(inner, int), np.zeros(inner + 1)
        half = np.flatnonzero(rng.random(len(g)) < 0.5)
        width = self.bins
        flat, gh, hh = b[half].astype(np.int32) + np.arange(b.shape[1], dtype=np.int32) * width, g[half], h[half]

        def sums(rows):
            cells, times = flat[rows].ravel(), b.shape[1]
            return np.stack([np.bincount(cells, np.repeat(x[rows], times), width * times) for x in (gh, hh)]).reshape(2, times, width)

        node = np.zeros(len(half), int)
        known = {0: sums(np.arange(len(half)))}
        for k in range(inner):
            total = known[k][:, 0].sum(1)
            left = np.cumsum(known[k], 2)[:, :, :-1]
            right = total[:, None, None] - left
            gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - total[0] ** 2 / (total[1] + 1)
            gain[(left[1] < self.least) | (right[1] < self.least)] = 0
            j, at = np.unravel_index(int(gain.argmax()), gain.shape)
            rows = np.flatnonzero(node == k)
            goes = np.zeros(len(rows), bool)
            if gain[j, at] > 1e-3:
                feature[k], cut[k] = j, at
                goes = b[half[rows], j] > at
            node[rows] = 2 * k + 1 + goes
            if 2 * k + 2 < inner:
                fewer = sums(rows[goes] if goes.sum() * 2 <= len(rows) else rows[~goes])
                small, large = (2 * k + 2, 2 * k + 1) if goes.sum() * 2 <= len(rows) else (2 * k + 1, 2 * k + 2)
                known[small], known[large] = fewer, known[k] - fewer
            del known[k]
        for leaf in range(inner + 1):
            rows = node == inner + leaf
            value[leaf] = self.rate * gh[rows].sum() / (hh[rows].sum() + 1) if rows.any() else 0
        return feature, cut, value

    def _run(self, tree, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), int)
        rows = np.arange(len(b))
        for _ in range(self.depth):
            f = feature[node]
            node = 2 * node + 1 + ((f >= 0) & (b[rows, np.maximum(f, 0)] > cut[node]))
        return value[node - len(feature)]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self._bin(x)
        return self.bias + sum(self._run(t, b) for t in self.forest)


#: Marks that the page writer leaves on its main elements and at the front of main text that no element holds. The features don't see them.
_MAIN, _MAIN_TEXT = "data-main", "\ue000"
#: Kinds of layouts, with their shares: parts with telling names; plain elements of random classes; an article whose classes tell of something else; an article's elements directly in body; and its bare text there.
FAMILIES = {"named": 0.43, "plain": 0.2, "misnamed": 0.14, "bare": 0.14, "text": 0.09}


def write_page(rng: random.Random, family: str | None = None) -> str:
    """A page of random layout. Elements of the main text bear the mark _MAIN, main text outside them _MAIN_TEXT."""
    family = family or rng.choices(list(FAMILIES), list(FAMILIES.values()))[0]
    telling = family == "named"
    semantic = telling or rng.random() < 0.4

    def random_class() -> str:
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(1, 7)))
        return rng.choice(["", f' class="x{word}"', f' class="css-{word}"', f' id="{word}z"', f' class="row {word}q"'])

    def words(least: int, most: int) -> str:
        out = ["".join(rng.choice("aeiounrstldhmgcbpé") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(least, most))]
        noise = rng.choice(["", "", "", "%%%", "###", "!!"])
        marks = rng.random() * 0.25
        return " ".join(w + (rng.choice([".", ",", ".", "?"]) if rng.random() < marks else "") + noise for w in out) + rng.choice([".", ".", ""])

    def linked(n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{i}">{words(1, 3)}</a></{tag}>' for i in range(n))

    def named(tag: str, kind: str, inside: str) -> str:
        if not telling:
            return f"<div{random_class()}>{inside}</div>"
        word = rng.choice(LEXICON[kind].split())
        word = rng.choice([word, word, f"{word}-{rng.choice(['box', 'wrap', 'area', 'inner', '1'])}", f"site-{word}"])
        return f'<{tag} {rng.choice(["class", "class", "id"])}="{word}">{inside}</{tag}>'

    def bulk() -> str:
        return rng.choice([words(1, 30), f"<p>{words(1, 60)}</p>", f"<p>{words(1, 20)}</p><p>{words(1, 40)}</p>", f"<h3>{words(1, 4)}</h3><ul>{linked(rng.randint(2, 8))}</ul>", words(20, 200)])

    def bad(kind: str) -> str:
        if kind == "menu":
            inside = rng.choice([f"<ul>{linked(rng.randint(2, 12))}</ul>", linked(rng.randint(2, 8), "span")])
            if not semantic and rng.random() < 0.4:
                return inside if inside.startswith("<ul") else f"<p>{inside}</p>"
            return f"<nav>{inside}</nav>" if semantic and rng.random() < 0.6 else named(rng.choice(["div", "ul", "nav"]), "menu", inside)
        if kind == "comment":
            mark = ' class="comment"' if telling else random_class()
            inside = "".join(f'<{rng.choice(["div", "li"])}{mark}>{rng.choice(["", f"<h4>{words(1, 2)}</h4>"])}<p>{words(1, 80)}</p></div>' for _ in range(rng.randint(1, 8)))
            return named(rng.choice(["section", "div", "ol"]), "comment", f"<h3>{words(1, 3)}</h3>" * (rng.random() < 0.5) + inside)
        if kind == "form":
            inside = f'<label>{words(1, 4)}</label><input name="q"><p>{words(1, 12)}</p><button>{words(1, 2)}</button>'
            return rng.choice([f"<form>{inside}</form>", named("div", "form", f"<form>{inside}</form>")])
        if kind == "foot":
            inside = rng.choice(["&copy; ", "&copy; 2020 ", ""]) + bulk()
            if not telling:
                inside = rng.choice([f"&copy; 2021 {words(1, 6)}", f"<p>&copy; {words(1, 8)}</p>", linked(rng.randint(2, 6), "span"), f"<ul>{linked(rng.randint(2, 6))}</ul>&copy; {words(1, 4)}"])
            return f"<footer>{inside}</footer>" if semantic and rng.random() < 0.7 else named("div", "foot", inside)
        if kind == "side":
            if not telling:
                return named("div", "side", f"<h3>{words(1, 4)}</h3><ul>{linked(rng.randint(2, 10))}</ul>")
            return f"<aside>{bulk()}</aside>" if rng.random() < 0.5 else named(rng.choice(["div", "section"]), "side", bulk())
        if kind == "head":
            inside = rng.choice([f"<h2>{words(1, 4)}</h2>", bulk(), f"<p>{words(1, 12)}</p>"])
            if not telling:
                inside = rng.choice([f'<a href="/">{words(1, 3)}</a>', f'<a href="/"><b>{words(1, 2)}</b></a>' + linked(rng.randint(1, 4), "span")])
            return f"<header>{inside}</header>" if semantic and rng.random() < 0.6 else named("div", "head", inside)
        if not telling:
            return named("div", kind, rng.choice([linked(rng.randint(1, 3), "span"), f'{words(1, 12)} <a href="/c">{words(1, 2)}</a> <button>{words(1, 2)}</button>', f'<a href="/b">{words(1, 8)}</a>']))
        return named(rng.choice(["div", "div", "section", "p"]), kind, rng.choice([words(1, 40), bulk()]))

    def link() -> str:
        return f'<a href="/{rng.randint(1, 99)}">{words(1, rng.choice([2, 4, 8]))}</a>'

    def with_links() -> str:
        """A sentence that is links for a good part."""
        pieces = [rng.choice([words(1, 6), words(1, 25), ""])]
        for _ in range(rng.choice([1, 2, 3, 5])):
            pieces += [link(), rng.choice([words(1, 3), words(1, 12), ",", "and"])]
        return " ".join(pieces)

    def sources() -> str:
        """A heading and a list of what the text refers to: links, with or without words beside them."""
        tag, heading = rng.choice(["ul", "ol"]), rng.choice(["h2", "h3", "h4", "p"])
        kinds = rng.choice([[link], [link], [link, lambda: f"{link()} {words(1, 9)}", lambda: f"{words(1, 6)} {link()}", lambda: words(3, 15)]])
        item = lambda: rng.choice(kinds)()
        return f"<{heading} {_MAIN}>{words(1, 3)}</{heading}><{tag} {_MAIN}>" + "".join(f"<li {_MAIN}>{item()}</li>" for _ in range(rng.randint(1, 9))) + f"</{tag}>"

    def byline() -> str:
        tag, word = rng.choice(["p", "div", "span", "address"]), rng.choice(LEXICON["byline"].split())
        inside = rng.choice([words(1, 7), words(2, 5), f"{words(1, 2)} {link()}", f"<time>{rng.randint(1, 28)} {words(1, 1)} {rng.randint(1990, 2030)}</time>", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}"])
        inside = f"<{tag} {_MAIN}" + (f' class="{word}"' if telling else random_class()) + f">{inside}</{tag}>"
        return f"<p {_MAIN}>{inside}</p>" if tag == "span" else inside

    def good() -> str:
        kind = rng.random()
        if kind < 0.6:
            inside = words(1, rng.choice([3, 20, 150, 400]))
            if rng.random() < 0.2:
                inside = f"<b>{words(1, 12)}<br>" + inside * (rng.random() < 0.3)
            if rng.random() < 0.1:
                inside += f' <a href="/x">{words(1, 5)}</a> {words(1, 9)}'
            return f"<p {_MAIN}>{inside}" + "</p>" * (rng.random() < 0.9)
        if kind < 0.68:
            return f"<p {_MAIN}>{with_links()}</p>"
        if kind < 0.75:
            return f"<{(h := rng.choice(['h2', 'h3']))} {_MAIN}>{words(1, 8)}</{h}>"
        if kind < 0.83:
            tag = rng.choice(["ul", "ul", "ol"])
            item = lambda: rng.choice([words(1, 20), words(1, 4), f"{words(1, 12)} {link()}", with_links()])
            return f"<{tag} {_MAIN}>" + "".join(f"<li {_MAIN}>{item()}</li>" for _ in range(rng.randint(1, 6))) + f"</{tag}>"
        if kind < 0.86:
            inside = f"<p {_MAIN}>{words(3, 40)}</p>"
            if rng.random() < 0.4:
                word = rng.choice(LEXICON["quote"].split())
                return f'<{(q := rng.choice(["aside", "div", "blockquote"]))} {_MAIN} class="{word}">{inside}</{q}>'
            return f"<blockquote {_MAIN}>{inside}</blockquote>"
        if kind < 0.89:
            return f"<div {_MAIN}>{words(1, 100)}</div>"
        if kind < 0.92:
            cell = lambda: f"<{(c := rng.choice(['td', 'td', 'th']))} {_MAIN}>{words(1, 3)}</{c}>"
            return f"<table {_MAIN}>" + "".join(f"<tr {_MAIN}>{cell()}{cell()}</tr>" for _ in range(rng.randint(1, 5))) + "</table>"
        if kind < 0.94:
            return f"<dl {_MAIN}>" + "".join(f"<dt {_MAIN}>{words(1, 3)}</dt><dd {_MAIN}>{words(2, 40)}</dd>" for _ in range(rng.randint(1, 5))) + "</dl>"
        if kind < 0.96:
            return f'<figure {_MAIN}><img src="x"><figcaption {_MAIN}>{words(2, 20)}</figcaption></figure>'
        return f"<pre {_MAIN}>{words(1, 60)}</pre>"

    def divided(parts: list[str]) -> str:
        """The article's elements in several containers, most with a heading of their own."""
        tag = rng.choice(["section", "div", "div"]) if semantic else "div"
        named_part = lambda: f' class="{rng.choice(LEXICON["part"].split())}"' if telling and rng.random() < 0.6 else "" if rng.random() < 0.4 else random_class()
        cuts = sorted(rng.sample(range(1, len(parts)), min(len(parts) - 1, rng.choice([1, 1, 2, 4])))) if len(parts) > 1 else []
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(parts)]):
            heading = f"<{(h := rng.choice(['h2', 'h2', 'h3']))} {_MAIN}>{words(1, 8)}</{h}>" if rng.random() < 0.75 else ""
            out.append(f"<{tag} {_MAIN}{named_part()}>{heading}{''.join(parts[a:b])}</{tag}>")
        return "".join(out)

    title = words(1, 12)
    title_part = f"<h1 {_MAIN}>{title}</h1>" if rng.random() < 0.8 else ""
    if family == "text":
        pieces = [words(15, rng.choice([30, 120, 400])) for _ in range(rng.choice([1, 1, 2, 4]))]
        if rng.random() < 0.3:
            pieces.append(f'<b>{words(1, 9)}</b> {words(5, 30)} <a href="/x">{words(1, 3)}</a> {words(5, 60)}')
        body = title_part + _MAIN_TEXT + rng.choice(["<br>", "<br><br>", " "]).join(pieces)
    elif telling:
        inner_bad = [k for k in ("advert", "share", "comment", "side", "form", "notice") if rng.random() < 0.12]
        parts = [good() for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 13, 25]))]
        if parts and rng.random() < 0.25:
            parts.append(sources())
        in_parts = len(parts) > 1 and rng.random() < 0.25
        if in_parts:
            parts = [divided(parts)]
        for k in inner_bad:
            parts.insert(rng.randint(0, len(parts)) if k != "comment" else len(parts), bad(k))
        under_title = byline() if rng.random() < 0.2 else ""
        if title_part:
            parts.insert(0, title_part + under_title if rng.random() < 0.75 else f"<header {_MAIN}>{title_part}{under_title}</header>")
        elif not parts:
            parts = [good()]
        body = "".join(parts)
        if rng.random() < 0.3:
            body = f'<div {_MAIN} class="{rng.choice(["content", "entry", "text", "body", "inner", "wrap"])}">{body}</div>'
        shell = rng.random()
        if in_parts and shell < 0.45:
            pass
        elif shell < 0.6:
            body = f"<article {_MAIN}>{body}</article>"
        elif shell < 0.75:
            body = f"<main {_MAIN}>{body}</main>"
        else:
            body = f'<div {_MAIN} {rng.choice(["class", "id"])}="{rng.choice(["content", "main", "post", "article", "entry-content", "page", "story"])}">{body}</div>'
        if rng.random() < 0.3:
            body = f"<main {_MAIN}>{body}" + (bad(rng.choice(["side", "comment", "advert"])) if rng.random() < 0.4 else "") + "</main>"
    else:
        parts = [good() for _ in range(rng.choice([0, 1, 2, 4, 8, 16]))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            parts.insert(rng.randint(0, len(parts)), f"<p {_MAIN}>{words(25, rng.choice([40, 120, 300]))}</p>")
        if rng.random() < 0.2:
            parts.insert(rng.randint(0, len(parts)), bad(rng.choice(["share", "advert", "form"])))
        if rng.random() < 0.25:
            parts.append(sources())
        under_title = byline() if title_part and rng.random() < 0.15 else ""
        body = title_part + under_title + "".join(parts)
        shape = rng.random()
        if shape < 0.2:
            body = title_part + under_title + f"<div {_MAIN}{random_class()}>{''.join(parts)}</div>"
        elif shape < 0.5:
            body = title_part + under_title + divided([x for x in parts if _MAIN in x] if family == "bare" else parts)
        if family == "misnamed":
            word = rng.choice([w for kind in ("head", "side", "comment", "foot", "form", "share", "notice", "menu") for w in LEXICON[kind].split()])
            body = f'<div {_MAIN} {rng.choice(["class", "id"])}="{rng.choice([word, "layout-" + word, word + "-page"])}">{body}</div>'
        elif family == "plain":
            for _ in range(rng.choice([0, 1, 1, 2, 3]) if 0.2 <= shape < 0.5 else rng.choice([1, 1, 2, 3])):
                body = f"<{(tag := rng.choice(['div', 'div', 'section'] if semantic else ['div']))} {_MAIN}{random_class()}>{body}</{tag}>"
    often = 1.0 if telling else 0.7
    before = [bad(k) for k in ("head", "menu", "notice", "advert", "form", "advert") if rng.random() < 0.45 * often]
    after = [bad(k) for k in ("side", "comment", "advert", "notice", "form", "share", "foot") if rng.random() < 0.4 * often]
    rng.shuffle(before)
    page = "".join(before) + body + "".join(after)
    if rng.random() < 0.25 and family not in ("bare", "text"):
        page = f'<div {_MAIN} class="{rng.choice(["wrapper", "container", "outer", "site"])}">{page}</div>'
    if rng.random() < 0.5 or family not in ("bare", "text"):
        page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{page}</body></html>"
    return page[: rng.randint(len(page) // 2, len(page))] if rng.random() < 0.08 else page


_MARKED = re.compile(rf"<([a-z0-9]+) {_MAIN}")


def labelled_page(source: str) -> tuple[Page, np.ndarray]:
    """The page without its marks, and for each element whether it bore one."""
    page = parse(_MARKED.sub(r'<\1 id="qqmainqq"', source))
    marked = np.array(["qqmainqq" in a for a in page.attributes])
    for k, (element, block, piece) in enumerate(page.runs):
        if _MAIN_TEXT in piece:
            page.runs[k] = (element, block, piece.replace(_MAIN_TEXT, ""))
            while page.tags[element] != LOOSE and element:
                element = page.parents[element]
            marked[element] = page.tags[element] == LOOSE
    page.attributes = [" ".join(a.replace("qqmainqq", "").split()) for a in page.attributes]
    return page, marked


TRAINING_PAGES = 2500
_model: Boosted | None = None


def train(pages: int = TRAINING_PAGES, seed: int = 7, families: dict[str, float] | None = None) -> Boosted:
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        family = rng.choices(list(families), list(families.values()))[0] if families else None
        page, marked = labelled_page(write_page(rng, family))
        blocks, x = features(page)
        xs.append(x)
        ys.append(marked[blocks])
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def model() -> Boosted:
    global _model
    _model = _model or train()
    return _model


def decode(page: Page, blocks: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The elements to keep: closed under parents, of the largest total score. Elements without a score follow their parent."""
    n = len(page.tags)
    own = np.zeros(n)
    own[blocks] = scores
    total = own.copy()
    for i in range(n - 1, 0, -1):
        if total[i] > 0:
            total[page.parents[i]] += total[i]
    keep = np.zeros(n, bool)
    keep[0] = True
    for i in range(1, n):
        keep[i] = keep[page.parents[i]] and total[i] >= 0 and page.tags[i] != "head"
    return keep


#: The lowest total at which prose is kept where nothing else is.
LEAST_SCORE = -4.0


def with_prose(page: Page, blocks: np.ndarray, scores: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """keep, unless it holds no text though the page has prose (a run of LONG characters outside of links): then the closed set of largest total that holds some, if that total is at least LEAST_SCORE."""
    if any(keep[element] and piece.strip() for element, _, piece in page.runs):
        return keep
    n = len(page.tags)
    linked = [False] * n
    for i in range(1, n):
        linked[i] = page.tags[i] == "a" or linked[page.parents[i]]
    prose = sorted({element for element, _, piece in page.runs if len(piece.strip()) >= LONG and not linked[element]})
    own = np.zeros(n)
    own[blocks] = scores
    total, gains = own.copy(), np.zeros(n)
    for i in range(n - 1, 0, -1):
        if total[i] > 0:
            total[page.parents[i]] += total[i]
            gains[page.parents[i]] += total[i]
    best, chosen = LEAST_SCORE, None
    for element in prose:
        path, sum_of_path = set(), gains[0]
        while element > 0:
            path.add(element)
            # What is gained beside the path counts too; the path's own elements were counted if they gain.
            sum_of_path += own[element] + gains[element]
            sum_of_path -= max(total[element], 0)
            element = page.parents[element]
        if sum_of_path >= best and not any(page.tags[i] == "head" for i in path):
            best, chosen = sum_of_path, path
    if chosen is None:
        return keep
    out = np.zeros(n, bool)
    out[0] = True
    for i in range(1, n):
        out[i] = i in chosen or (out[page.parents[i]] and total[i] >= 0 and page.tags[i] != "head")
    return out


def main_text(page: Page, keep: np.ndarray) -> str:
    blocks: list[str] = []
    last = None
    for element, block, piece in page.runs:
        if not keep[element]:
            continue
        if block == last:
            blocks[-1] += piece
        else:
            blocks.append(piece)
            last = block
    return "\n".join(t for b in blocks if (t := " ".join(b.split())))


def extract_pages(sources: list[str], trees: Boosted) -> list[str]:
    pages = [parse(s) for s in sources]
    rows = [features(p) for p in pages]
    scores = trees.score(np.concatenate([x for _, x in rows])) if rows else np.zeros(0)
    out, at = [], 0
    for page, (blocks, _) in zip(pages, rows):
        own = scores[at : at + len(blocks)]
        at += len(blocks)
        out.append(main_text(page, with_prose(page, blocks, own, decode(page, blocks, own))))
    return out


def html_extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches):
        trees = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = extract_pages([x.as_py() or "" for x in part.column("html")], trees)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
