"""Main text of web pages by a graphical model on the DOM tree (operator 3).

A page's block elements and text runs form a tree. Every node is content or not.
Unary potentials come from a node's own features (tag, class and id words, share
of linked text, length, punctuation); pair potentials on the edges say how
content passes from parent to child. Sum-product messages, once from the leaves
up and once from the root down, give every node's exact content marginal; a text
run whose marginal is over one half is part of the article.

The weights are trained in the driver by gradient ascent on the likelihood of
``labelled_pages``: whole pages, generated from a grammar of page layouts, whose
every text run is labelled. Their number is a parameter.

Script, style, template, form controls, inner documents and the head never have
text; that of formulas, drawings and fallbacks is for the model to decide. Character
references are decoded; white space inside a block becomes one space; blocks are
joined in page order by one space. Markup that is not well-formed is read as
browsers do in the common cases: paragraphs and list items close each other,
stray end tags are ignored, open elements end with the page. Nulls and empty
pages give an empty text. Rows that repeat a page_id are rows of their own.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_HEAD_END = re.compile(r"</head\s*>|<body\b", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|itemprop|aria-label)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page: code, form controls, other documents.
_RAW = frozenset("script style template title textarea select option datalist button iframe noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPES = frozenset("html body table ul ol dl div article section main aside nav header footer td th li blockquote form".split())
#: Word families in class, id and role.
_FAMILIES = {
    "nav": "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager tabs toc skip sitemap",
    "ad": "ad ads advert advertisement advertisements advertising banner sponsor sponsored promo promoted promotion adsense outbrain taboola",
    "side": "sidebar side aside rail widget widgets related recommended recommendations trending popular more complementary teaser",
    "foot": "footer foot copyright colophon legal contentinfo imprint credits",
    "head": "header masthead topbar logo brand branding",
    "talk": "comment comments commentlist reply replies respond disqus discussion responses feedback",
    "note": "cookie cookies consent gdpr notice notification alert banner popup modal overlay subscribe newsletter signup paywall toast privacy",
    "share": "share sharing social follow tweet facebook tools toolbar meta byline tags tag",
    "form": "form search login register signin input",
    "main": "content main article post entry story body text page prose articlebody hentry blog markdown",
}
_FAMILY = {w: f for f, ws in _FAMILIES.items() for w in ws.split()}
_TAGS = "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody tr td th blockquote pre figure figcaption nav header footer aside form fieldset address details summary center".split()
_STRONG = frozenset("nav header footer aside form article main section p li body div td".split())

Node = tuple[int, str, list[str], str, float]  # parent, tag, families, text of a run, share of it in links


class _Finder:
    """Places of what comes next in a page, each part of it looked at once."""

    def __init__(self, page: str):
        self.page = page
        self.found: dict[str, int] = {}
        self.closes: dict[str, re.Pattern | None] = {}
        self.quoted = True

    def next(self, what: str, at: int) -> int:
        """The next ``what`` from at on, or -1. Calls come with growing at."""
        known = self.found.get(what, -2)
        if known == -1 or known >= at:
            return known
        self.found[what] = known = self.page.find(what, at)
        return known

    def close(self, name: str, at: int) -> int:
        """The end of the next end tag of that name, or -1."""
        pattern = self.closes.setdefault(name, re.compile(rf"</{name}\s*>", re.IGNORECASE))
        found = pattern.search(self.page, at) if pattern else None
        if not found:
            self.closes[name] = None  # nor will there be one later
        return found.end() if found else -1

    def tag_end(self, at: int) -> int:
        """The > of a tag, not one in quotes; -1 if there is none. A page whose quotes
        do not close has tags end at the first >, from there on."""
        first = self.next(">", at)
        while self.quoted and first >= 0:
            end = self.next(">", at)
            quotes = [q for q in (self.next('"', at), self.next("'", at)) if q >= 0 and (q < end or end < 0)]
            if end >= 0 and not quotes:
                return end
            close = self.next(self.page[min(quotes)], min(quotes) + 1) if quotes else -1
            if close < 0:
                self.quoted = False
                self.found.pop(">", None)
                return first
            at = close + 1
        return first


class _Open:
    """The open elements, with the places of each name and of those that bound
    searches, so that no search walks the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = [("html", 0)]  # inline ones with the node around them
        self.places: dict[str, list[int]] = {}
        self.blocks, self.scopes = [0], [0]

    def push(self, name: str, node: int) -> None:
        at = len(self.stack)
        self.stack.append((name, node))
        self.places.setdefault(name, []).append(at)
        if name not in _INLINE:
            self.blocks.append(at)
        if name in _SCOPES:
            self.scopes.append(at)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            name, _ = self.stack.pop()
            self.places[name].pop()
            if name not in _INLINE:
                self.blocks.pop()
            if name in _SCOPES:
                self.scopes.pop()

    def last(self, *names: str) -> int:
        return max((x[-1] for name in names if (x := self.places.get(name))), default=0)


def parse(page: str) -> list[Node]:
    """The block tree of a page, parents before children, runs in page order."""
    nodes: list[Node] = [(-1, "html", [], "", 0.0)]
    own, find = _Open(), _Finder(page)
    stack = own.stack
    run: list[str] = []
    links = total = 0
    anchors = 0
    no_head_end = False

    def flush() -> None:
        nonlocal links, total
        if run:
            text = " ".join(_html.unescape("".join(run)).split())
            if text:
                nodes.append((stack[-1][1], "#run", [], text, links / max(1, total)))
            run.clear()
        links = total = 0

    def take(text: str) -> None:
        nonlocal links, total
        run.append(text)
        n = len(text.strip())
        total += n
        if anchors:
            links += n

    at, size = 0, len(page)
    while at < size:
        start = find.next("<", at)
        if start < 0:
            take(page[at:])
            break
        if start > at:
            take(page[at:start])
        if page.startswith("<!--", start):
            end = find.next("-->", start + 4)
            at = end + 3 if end >= 0 else size
            continue
        found = _NAME.match(page, start)
        end = find.tag_end(found.end()) if found else find.next(">", start) if page[start + 1 : start + 2] in ("!", "?") else -1
        if end < 0:
            take("<")
            at = start + 1
            continue
        at = end + 1
        if not found:
            continue
        name = found[2].lower()
        if found[1]:
            if name == "a" and anchors:
                anchors -= 1
            if name in _VOID:
                if name == "br":
                    flush()
                continue
            place = own.last(name)
            if place > (own.blocks[-1] if name in _INLINE else own.scopes[-1] if name == "p" else 0):
                if own.blocks[-1] >= place:
                    flush()
                own.cut(place)
            continue
        if name in _RAW:
            if page[end - 1] != "/":
                close = find.close(name, at)
                at = close if close >= 0 else size if name in ("script", "style") else at
            continue
        if name in _VOID:
            if name in ("br", "hr"):
                flush()
            continue
        if name == "a":
            anchors += 1
        if name in _INLINE:
            own.push(name, stack[-1][1])
            continue
        flush()
        anchors = 0
        if name in _CLOSES_P and own.last("p") > own.scopes[-1]:
            own.cut(own.last("p"))
        if name in _SIBLINGS and (place := own.last(*_SIBLINGS[name])) > own.last("ul", "ol", "dl", "table", "select"):
            own.cut(place)
        while stack[-1][0] in _INLINE:
            own.cut(len(stack) - 1)
        if name == "head":
            close = None if no_head_end else _HEAD_END.search(page, at)
            no_head_end = close is None
            if close:
                at = close.start() if close[0][1] != "/" else close.end()
            continue
        words: list[str] = ["note"] if name == "noscript" else []
        for key, *value in _ATTRIBUTE.findall(page[found.end() : end]):
            if key.lower() == "hidden":
                words.append("note")
            words += [f for w in _WORDS.findall(" ".join(value)) if (f := _FAMILY.get(w.lower()))]
        nodes.append((stack[-1][1], name, words, "", 0.0))
        own.push(name, len(nodes) - 1)
    flush()
    return nodes


_FEATURES: dict[str, int] = {}
for _name in ["bias", "run", "element", *(f"tag {t}" for t in _TAGS), "tag other", *(f"family {f}" for f in _FAMILIES), *(f"run {x}" for x in ("tiny", "short", "long", "longer", "linked", "half linked", "stop", "in heading", "in li", "in p"))]:
    _FEATURES[_name] = len(_FEATURES)
_PAIRS: dict[str, int] = {}
for _name in ["run", "element", *(f"tag {t}" for t in sorted(_STRONG)), *(f"family {f}" for f in _FAMILIES)]:
    _PAIRS[_name] = len(_PAIRS)


def features(nodes: list[Node]) -> tuple[list[int], list[list[int]], list[list[int]]]:
    """(parent, active unary features, active pair features) of each node. A
    node's pair features belong to the edge to its parent."""
    up, unary, pair = [], [], []
    f, p = _FEATURES, _PAIRS
    for parent, tag, families, text, linked in nodes:
        own = [f["bias"]]
        if tag == "#run":
            n = len(text)
            own += [f["run"], f["run tiny" if n < 20 else "run short" if n < 80 else "run long" if n < 300 else "run longer"]]
            if linked > 0.8:
                own.append(f["run linked"])
            elif linked > 0.3:
                own.append(f["run half linked"])
            if text[-1] in ".!?…»\"'":
                own.append(f["run stop"])
            above = nodes[parent][1]
            if above[0] == "h" and len(above) == 2:
                own.append(f["run in heading"])
            elif above in ("li", "p"):
                own.append(f[f"run in {above}"])
            edge = [p["run"]]
        else:
            own += [f["element"], f.get(f"tag {tag}", f["tag other"]), *(f[f"family {x}"] for x in set(families))]
            edge = [p["element"]]
        if parent >= 0:
            above = nodes[parent]
            if above[1] in _STRONG:
                edge.append(p[f"tag {above[1]}"])
            edge += [p[f"family {x}"] for x in set(above[2])]
        up.append(parent)
        unary.append(own)
        pair.append(edge)
    return up, unary, pair


def marginals(up: list[int], odds: list[float], edge: list[list[float]]) -> tuple[list[float], list[float], list[float]]:
    """Sum-product on the tree, in log odds of the content state. odds[i] is node
    i's own potential, edge[i] the potentials of (parent state, own state) in the
    order 00, 01, 10, 11. Returns each node's belief, what came from below it
    (with its own potential), and its parent's belief without it."""
    n = len(up)
    inside = list(odds)
    message = [0.0] * n
    exp, log = math.exp, math.log
    for i in range(n - 1, 0, -1):  # up
        x = inside[i]
        r = exp(x if -30 < x < 30 else 30 if x > 0 else -30)
        a, b, c, d = edge[i]
        message[i] = m = log((c + d * r) / (a + b * r))
        inside[up[i]] += m
    belief = list(inside)
    around = [0.0] * n
    for i in range(1, n):  # down
        around[i] = x = belief[up[i]] - message[i]
        r = exp(x if -30 < x < 30 else 30 if x > 0 else -30)
        a, b, c, d = edge[i]
        belief[i] = inside[i] + log((b + d * r) / (a + c * r))
    return belief, inside, around


class Model:
    """Weights of the unary (features x 2 states, as one for content) and pair potentials."""

    def __init__(self) -> None:
        self.unary = np.zeros(len(_FEATURES))
        self.pair = np.zeros((len(_PAIRS), 2, 2))

    def potentials(self, unary: list[list[int]], pair: list[list[int]]) -> tuple[list[float], list[list[float]]]:
        own, edges = self.unary.tolist(), self.pair.reshape(-1, 4).tolist()
        exp = math.exp
        factors: dict[tuple, list[float]] = {}
        out = []
        for p in pair:
            key = tuple(p)
            if key not in factors:
                factors[key] = [exp(max(-30.0, min(30.0, sum(edges[x][s] for x in p)))) for s in range(4)]
            out.append(factors[key])
        return [sum([own[x] for x in u]) for u in unary], out

    def content(self, nodes: list[Node]) -> list[float]:
        """Each node's log odds of being content."""
        up, unary, pair = features(nodes)
        return marginals(up, *self.potentials(unary, pair))[0]

    def fit(self, pages: list[tuple[list[Node], list[int]]], steps: int = 60, rate: float = 0.5, decay: float = 1e-3) -> Model:
        ready = [(*features(nodes), np.array(labels)) for nodes, labels in pages]
        total = sum(len(r[0]) for r in ready)
        base = np.cumsum([0, *(len(r[0]) for r in ready)])
        labels = np.concatenate([r[3] for r in ready])
        parent = np.concatenate([np.array(r[0]) + b for r, b in zip(ready, base, strict=False)])
        inner = np.concatenate([np.array(r[0]) >= 0 for r in ready])
        own = np.array([(i + b, x) for r, b in zip(ready, base, strict=False) for i, u in enumerate(r[1]) for x in u])
        edges = np.array([(i + b, x) for r, b in zip(ready, base, strict=False) for i, u in enumerate(r[2]) for x in u if i])
        seen = np.zeros((total, 4))
        seen[np.flatnonzero(inner), 2 * labels[parent[inner]] + labels[inner]] = 1
        square_u, square_p = np.full_like(self.unary, 1e-6), np.full_like(self.pair, 1e-6)
        for _ in range(steps):
            odds = np.bincount(own[:, 0], self.unary[own[:, 1]], total).tolist()
            weight = np.zeros((total, 4))
            np.add.at(weight, edges[:, 0], self.pair.reshape(-1, 4)[edges[:, 1]])
            factor = np.exp(weight)
            runs = [marginals(r[0], odds[b:z], factor[b:z].tolist()) for r, b, z in zip(ready, base[:-1], base[1:], strict=True)]
            belief, inside, around = (np.clip(np.concatenate([x[i] for x in runs]), -30, 30) for i in range(3))
            joint = factor * np.exp(np.stack([np.zeros(total), inside, around, inside + around], axis=1))
            joint /= joint.sum(axis=1, keepdims=True)
            grad_u, grad_p = np.zeros_like(self.unary), np.zeros((len(_PAIRS), 4))
            np.add.at(grad_u, own[:, 1], (labels - 1 / (1 + np.exp(-belief)))[own[:, 0]])
            np.add.at(grad_p, edges[:, 1], (seen - joint)[edges[:, 0]])
            grad_u = grad_u / total - decay * self.unary
            grad_p = grad_p.reshape(-1, 2, 2) / total - decay * self.pair
            square_u += grad_u**2
            square_p += grad_p**2
            self.unary += rate * grad_u / np.sqrt(square_u)
            self.pair += rate * grad_p / np.sqrt(square_p)
        return self


def labelled_pages(count: int, seed: int = 7) -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """(html, labelled runs in page order) from a grammar of page layouts."""
    rng = np.random.Generator(np.random.PCG64(seed))
    letters = np.array(list("abcdefghijklmnoprstuvwzéüñ"))

    def pick(*options):
        return options[int(rng.integers(len(options)))]

    def chance(p: float) -> bool:
        return rng.random() < p

    def some(low: int, high: int) -> str:
        made = ["".join(rng.choice(letters, int(rng.integers(1, 9)))) for _ in range(int(rng.integers(low, high + 1)))]
        return " ".join(made).capitalize()

    def sentence(low: int = 3, high: int = 30) -> str:
        return some(low, high) + pick(".", ".", "!", "?", "")

    for _ in range(count):
        runs: list[tuple[str, int]] = []

        def run(text: str, content: int) -> str:
            runs.append((text, content))  # noqa: B023
            return text

        def items(n: int, tag: str = "ul", content: int = 0, linked: float = 1.0) -> str:
            own = []
            for _ in range(n):
                text = run(sentence(1, 12) if content else some(1, 4), content)  # noqa: B023
                own.append(f"<li><a href='/x'>{text}</a></li>" if chance(linked) else f"<li>{text}</li>")
            return f"<{tag}>{''.join(own)}</{tag}>"

        def named(family: str) -> str:
            word = pick(*_FAMILIES[family].split())
            return pick(f" class='{word}'", f' id="{word}"', f" class='{pick('block', 'js', 'c-12')} {word}-{pick('box', 'wrap', 'inner')}'")

        def paragraphs(n: int) -> str:
            out = []
            for _ in range(n):
                kind = rng.random()
                if kind < 0.72:
                    text = " ".join(sentence() for _ in range(int(rng.integers(1, 7))))
                    out.append(f"<p>{run(text, 1)}</p>")  # noqa: B023
                elif kind < 0.8:
                    out.append(f"<p>{run(some(1, 4) + pick('.', ''), 1)}{pick('</p>', '')}")  # noqa: B023
                elif kind < 0.86:
                    out.append(f"<{(h := pick('h2', 'h3', 'h4'))}>{run(some(1, 8), 1)}</{h}>")  # noqa: B023
                elif kind < 0.92:
                    out.append(items(int(rng.integers(1, 6)), pick("ul", "ol"), 1, 0.15))
                elif kind < 0.95:
                    out.append(f"<blockquote><p>{run(sentence(), 1)}</p></blockquote>")  # noqa: B023
                elif kind < 0.97:
                    out.append(f"<pre>{run(some(2, 12), 1)}</pre>")  # noqa: B023
                else:
                    out.append("<table>" + "".join(f"<tr><td>{run(some(1, 3), 1)}</td><td>{run(some(1, 3), 1)}</td></tr>" for _ in range(2)) + "</table>")  # noqa: B023
                if chance(0.05):
                    out.append(aside("ad"))
                if chance(0.03):
                    out.append(aside("share"))
                if chance(0.04):
                    text = run(sentence(), 0)  # noqa: B023
                    out.append(f"<aside>{pick(text, f'<p>{text}</p>')}</aside>")
                if chance(0.02):
                    out.append(f"<nav>{items(int(rng.integers(2, 6)))}</nav>")
            return "".join(out)

        def aside(family: str) -> str:
            tag = pick("div", "div", "section", "aside", "p")
            if family in ("side", "nav", "share") and chance(0.6):
                return f"<{pick('div', 'aside', 'nav')}{named(family)}>{'<h3>' + run(some(1, 3), 0) + '</h3>' if chance(0.5) else ''}{items(int(rng.integers(2, 9)))}</div>"  # noqa: B023
            if family == "talk":
                head = f"<h2>{run(some(1, 3), 0)}</h2>" if chance(0.5) else ""  # noqa: B023
                inner = "".join(f"<{pick('p', 'div', 'li')}>{run(' '.join(sentence() for _ in range(int(rng.integers(1, 4)))), 0)}" for _ in range(int(rng.integers(1, 7))))  # noqa: B023
                return f"<{(t := pick('div', 'section'))}{named('talk')}>{head}{inner}</{t}>"
            text = " ".join(sentence() for _ in range(int(rng.integers(1, 4))))
            return f"<{tag}{named(family)}>{run(text, 0)}</{tag}>"  # noqa: B023

        body = []
        if chance(0.7):
            body.append(f"<{(t := pick('header', 'div'))}{named('head') if t == 'div' else ''}>{run(some(1, 4), 0) if chance(0.6) else ''}{'<nav>' + items(int(rng.integers(2, 8))) + '</nav>' if chance(0.5) else ''}</{t}>")
        if chance(0.7):
            body.append(f"<{(t := pick('nav', 'nav', 'div'))}{named('nav') if t == 'div' else ''}>{items(int(rng.integers(2, 9)))}</{t}>")
        for family, p in (("ad", 0.5), ("note", 0.3)):
            if chance(p):
                body.append(aside(family))
        tag = pick("article", "article", "article", "main", "div", "section")
        title = f"<h1>{run(some(2, 10), 1)}</h1>" if chance(0.85) else ""
        inner = title + (f"<div{named('share')}>{run(some(1, 5), 0)}</div>" if chance(0.15) else "") + paragraphs(int(rng.integers(1, 14)))
        if chance(0.2):
            inner = f"<div{named('main')}>{inner}</div>"
        if chance(0.15):
            inner += aside("talk")
        if chance(0.08):
            inner += aside("side")
        if chance(0.05):
            inner += f"<form{named('form')}><p>{run(some(1, 5), 0)}</p><input></form>"
        if chance(0.1):
            inner += f"<footer>{run(sentence(), 0)}</footer>"
        article = f"<{tag}{named('main') if tag in ('div', 'section') or chance(0.3) else ''}>{inner}</{tag}>"
        if chance(0.25):
            article = f"<main>{article}{aside('side') if chance(0.3) else ''}{aside('talk') if chance(0.4) else ''}</main>"
        body.append(article)
        for family, p in (("side", 0.4), ("talk", 0.3), ("ad", 0.2), ("share", 0.15), ("note", 0.15)):
            if chance(p):
                body.append(f"<aside>{run(sentence(), 0)}</aside>" if family == "side" and chance(0.3) else aside(family))
        if chance(0.15):
            body.append(f"<form{named('form')}><p>{run(some(1, 5), 0)}</p><input></form>")
        if chance(0.85):
            body.append(f"<{(t := pick('footer', 'footer', 'div'))}{named('foot') if t == 'div' else ''}>{run('© ' + ' '.join(sentence() for _ in range(int(rng.integers(1, 3)))), 0)}</{t}>")
        yield f"<!DOCTYPE html><html><head><title>x</title></head><body>{''.join(body)}</body></html>", runs


def labels_of(nodes: list[Node], runs: list[tuple[str, int]]) -> list[int]:
    """A label for each node: runs as labelled, elements content if any run below is."""
    labels = [0] * len(nodes)
    own = iter(runs)
    for i, node in enumerate(nodes):
        if node[1] == "#run":
            text, label = next(own)
            if " ".join(_html.unescape(text).split()) != node[3]:
                raise ValueError("labels and page differ")
            labels[i] = label
    for i in range(len(nodes) - 1, 0, -1):
        if labels[i]:
            labels[nodes[i][0]] = 1
    return labels


@lru_cache(maxsize=4)
def trained(pages: int = 240, seed: int = 7) -> Model:
    """The model that ``pages`` labelled pages give."""
    ready = []
    for page, runs in labelled_pages(pages, seed):
        nodes = parse(page)
        ready.append((nodes, labels_of(nodes, runs)))
    return Model().fit(ready)


def main_text(page: str | None, model: Model) -> str:
    nodes = parse(page or "")
    if len(nodes) == 1:
        return ""
    content = model.content(nodes)
    return " ".join(n[3] for n, p in zip(nodes, content, strict=True) if n[1] == "#run" and p > 0)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html)."""
    held = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                texts = [main_text(x.as_py(), held.value) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_query(spark, sf_dir: str) -> DataFrame:
    """Contract: the main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
