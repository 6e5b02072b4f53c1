"""Main-text extraction with a tree-structured graphical model over DOM nodes (operator 1)."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>", re.S)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ATTRIBUTE = re.compile(r"(class|id|role|aria-label|itemprop|hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
HINT = re.compile(r"[a-z]+|\d+")
# fixed values: element names of the HTML standard
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea select option".split())
RAW = frozenset("script style textarea title iframe".split())  # hold text only, no tags
END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in OPAQUE | INLINE | {"form"}}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table div section article main body aside nav footer header form".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# fixed values: words that sites use in class, id and role
AVOID = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion promoted sponsor sponsored menu nav navigation navbar sidebar side rail foot footer head header masthead topbar comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended recommendations widget breadcrumb breadcrumbs pagination pager subscribe subscription newsletter signup login search searchbox form disclaimer copyright legal toolbar tags tagcloud complementary contentinfo hidden".split()
)
SEEK = frozenset("article articlebody content main maincontent post entry body story text prose page".split())
TAGS = "article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form menu body html address fieldset button dialog details".split()
MAYBE = {t: i for i, t in enumerate(TAGS)}
FEATURES = [*(f"tag:{t}" for t in TAGS), "tag:other", "avoid", "seek", "hidden", "leaf", "words:0", "words:1", "words:2", "words:3", "words:4", "linked:some", "linked:half", "linked:all", "stops", "no-stop", "mark", "in-p", "in-heading", "in-li", "in-cell", "bias"]
KINDS = 4
AT = {f: i for i, f in enumerate(FEATURES)}
COPY_MARK = re.compile("[©®]|all rights reserved", re.I)


class Page:
    """The nodes of a page in document order: parent, active features, and text (leaves only)."""

    __slots__ = ("features", "leaf_linked", "parent", "text")

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.features: list[list[int]] = []
        self.text: list[str | None] = []


def parse(source: str) -> Page:
    """Build the tree of block elements and text blocks of a page, however broken its markup.

    A block is the text between two block-level tags; inline tags leave no trace, <br> is white
    space. The parser is iterative, so depth and length are limited by memory alone.
    """
    page = Page()
    parent, features, texts = page.parent, page.features, page.text
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    linked = links = 0
    opaque, depth, mute = "", 0, False  # mute: what an unclosed element would show, up to the next tag
    inside: Counter[str] = Counter()  # elements open within the opaque one
    next_end: dict[str, re.Match | None] = {}
    at = 0

    def end_of(tag: str) -> re.Match | None:
        """The next end tag of ``tag``, looked for once until it is passed."""
        if tag not in next_end or (next_end[tag] and next_end[tag].start() < at):
            next_end[tag] = END[tag].search(source, at)
        return next_end[tag]

    def unseen(attributes: str) -> bool:
        return any(name.lower() == "hidden" or (name.lower() == "style" and UNSEEN.search(value)) for name, value in ATTRIBUTE.findall(attributes))

    def element(tag: str, attributes: str) -> None:
        own = [MAYBE.get(tag, len(TAGS)), AT["bias"]]
        if attributes and not attributes.isspace():
            words: set[str] = set()
            for name, value in ATTRIBUTE.findall(attributes):
                name = name.lower()
                if name == "hidden" or (name == "style" and UNSEEN.search(value)):
                    own.append(AT["hidden"])
                elif name != "style":
                    words.update(HINT.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))
            if words & AVOID:
                own.append(AT["avoid"])
            if words & SEEK:
                own.append(AT["seek"])
        parent.append(stack[-1][1] if stack else -1)
        features.append(own)
        texts.append(None)
        stack.append((tag, len(parent) - 1))

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                n = text.count(" ") + 1
                share = linked / max(1, len(text))
                tag = stack[-1][0] if stack else ""
                own = [AT["leaf"], AT["bias"], AT[f"words:{0 if n < 3 else 1 if n < 8 else 2 if n < 20 else 3 if n < 60 else 4}"], AT["stops" if text[-1] in ".!?…\"'”。" else "no-stop"]]
                if share > 0.05:
                    own.append(AT["linked:all" if share > 0.8 else "linked:half" if share > 0.4 else "linked:some"])
                if COPY_MARK.search(text):
                    own.append(AT["mark"])
                where = {"p": "in-p", "blockquote": "in-p", "pre": "in-p", "li": "in-li", "td": "in-cell", "th": "in-cell"}.get(tag, "in-heading" if re.fullmatch("h[1-6]", tag) else "")
                if where:
                    own.append(AT[where])
                parent.append(stack[-1][1] if stack else -1)
                features.append(own)
                texts.append(text)
            parts.clear()
        linked = 0

    def data(raw: str) -> None:
        nonlocal linked
        if raw and not opaque and not mute:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if links:
                linked += len(raw)

    while m := TOKEN.search(source, at):
        data(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        empty = m[3].endswith("/")
        mute = False
        if tag in RAW:
            if not closing:
                if end := end_of(tag):
                    at = end.end()
                elif tag in ("script", "style"):  # code to the end of the page
                    at = len(source)
                elif tag == "textarea" and any(t == "form" for t, _ in stack) and (end := end_of("form")):
                    at = end.start()
                else:
                    mute = True
            continue
        if opaque:
            if tag == opaque:
                depth += -1 if closing else not empty
                if depth <= 0:
                    opaque = ""
                continue
            if opaque == "head" and tag == "body":
                opaque = ""
                if closing:
                    continue
            elif closing and not inside[tag] and any(t == tag for t, _ in stack):  # an enclosing element ends
                opaque = ""
            else:
                inside[tag] = max(0, inside[tag] + (-1 if closing else not empty))
                continue
        if tag in OPAQUE:
            if not closing and not empty:
                if end_of(tag):
                    opaque, depth = tag, 1
                    inside.clear()
                else:
                    mute = True
            continue
        if tag in INLINE:
            if not closing and not empty and m[3] and tag not in VOID and unseen(m[3]) and end_of(tag):
                opaque, depth = tag, 1
                inside.clear()
                continue
            if tag == "a":
                links = 0 if closing else 1
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            continue
        flush()
        links = 0
        if closing:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE or stack[k][0] in ("td", "th", "li"):
                    break
        if tag in CLOSES and tag != "p":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES[tag]:
                    del stack[k:]
                    if tag != "tr":
                        break
                elif stack[k][0] in SCOPE:
                    break
        element(tag, m[3])
    data(source[at:])
    flush()
    return page


class TreeModel:
    """Binary labels on a forest: unary weights per feature, one 2 x 2 parent-child potential per kind of child."""

    def __init__(self, weights: np.ndarray, pair: np.ndarray) -> None:
        self.weights, self.pair = weights, pair  # pair[kind, parent label, child label]

    def marginals(self, parent: np.ndarray, unary: np.ndarray, kind: np.ndarray, levels: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of every node, and the joint (parent, child) marginals, by sum-product.

        ``unary`` is each node's log-odds. Messages go up from the deepest level, then down
        from the roots; nodes of one depth are handled together.
        """
        n = len(parent)
        levels = by_depth(parent) if levels is None else levels
        belief = np.stack([np.zeros(n), unary], axis=1)  # log potential and upward messages
        up = np.zeros((n, 2))
        for level in reversed(levels[1:]):
            joint = self.pair[kind[level]] + belief[level][:, None, :]
            up[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            np.add.at(belief, parent[level], up[level])
        total = belief.copy()
        joint = np.full((n, 2, 2), -np.inf)
        for level in levels[1:]:
            cavity = total[parent[level]] - up[level]
            cavity -= cavity.max(axis=1, keepdims=True)
            both = self.pair[kind[level]] + cavity[:, :, None]
            total[level] = belief[level] + np.logaddexp(both[:, 0], both[:, 1])
            full = both + belief[level][:, None, :]
            joint[level] = full - np.logaddexp.reduce(full.reshape(len(level), 4), axis=1)[:, None, None]
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))), np.exp(joint)


def by_depth(parent: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth, roots first; parents come before their children."""
    depth: list[int] = []
    for p in parent.tolist():
        depth.append(depth[p] + 1 if p >= 0 else 0)
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(np.array(depth)[order])) + 1) if len(depth) else []


def flatten(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(parent, feature ids, their starts, kind) of all pages as one forest.

    kind tells text blocks (1) from elements (0), and (+2) whether the parent is html or body:
    those hold everything, so a menu below them says nothing about them.
    """
    base, parents, flat, starts, kinds = 0, [], [], [], []
    roots = (MAYBE["html"], MAYBE["body"])
    for page in pages:
        parents.extend(p + base if p >= 0 else -1 for p in page.parent)
        for own, text, p in zip(page.features, page.text, page.parent, strict=True):
            starts.append(len(flat))
            flat.extend(own)
            kinds.append(int(text is not None) + (2 if p >= 0 and page.features[p][0] in roots else 0))
        base += len(page.parent)
    return np.array(parents, np.int64), np.array(flat, np.int64), np.array(starts, np.int64), np.array(kinds, np.int64)


def train(pages: list[Page], labels: list[list[int]], steps: int = 250, rate: float = 0.12, decay: float = 0.002) -> TreeModel:
    """Maximum likelihood on fully labelled trees: observed minus expected counts, by Adam steps."""
    parent, flat, starts, kind = flatten(pages)
    y = np.array([v for own in labels for v in own], np.float64)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(flat))))
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (kind[child], y[parent[child]].astype(int), y[child].astype(int)), 1)
    w, pair, levels = np.zeros(len(FEATURES)), np.zeros((KINDS, 2, 2)), by_depth(parent)
    m, v = np.zeros(len(w) + pair.size), np.zeros(len(w) + pair.size)
    for t in range(1, steps + 1):
        model = TreeModel(w, pair)
        p, joint = model.marginals(parent, np.add.reduceat(w[flat], starts), kind, levels)
        gw = np.bincount(flat, (y - p)[owner], len(w))
        expected = np.stack([joint[child][kind[child] == k].sum(axis=0) for k in range(KINDS)])
        g = np.concatenate([gw, (seen - expected).ravel()]) / len(pages) - decay * np.concatenate([w, pair.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, pair = w + step[: len(w)], pair + step[len(w) :].reshape(pair.shape)
    return TreeModel(w, pair)


def labelled_pages(n: int = 300, seed: int = 11) -> Iterator[tuple[str, set[str]]]:
    """Training pages of many layouts, each with the set of its content blocks.

    Words are made of random letters, so a model can learn from structure and shape only.
    """
    rnd = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rnd.choices("abcdefghijklmnoprstuvwz", k=rnd.randint(2, 9))) for _ in range(rnd.randint(lo, hi)))

    def sentence(lo: int = 4, hi: int = 30) -> str:
        return words(lo, hi).capitalize() + rnd.choice("...!?")

    def attr(*names: str) -> str:
        name = rnd.choice(names)
        return "" if not name else f' {rnd.choice(("class", "id", "class"))}="{name}{rnd.choice(("", "", " x1", "-box"))}"'

    def links(k: int, tag: str) -> str:
        items = [f'<a href="/{words(1, 1)}">{words(1, 3)}</a>' for _ in range(k)]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if tag == "ul" else " ".join(items)

    for number in range(n):
        content: set[str] = set()

        def keep(tag: str, text: str, content: set[str] = content) -> str:
            content.add(text)
            return f"<{tag}>{text}</{tag}>" if tag else text

        boiler = [
            lambda: f"<nav{attr('', 'menu', 'nav')}>{links(rnd.randint(2, 8), rnd.choice(('ul', '')))}</nav>",
            lambda: f"<div{attr('menu', 'navigation', 'navbar', 'breadcrumb')}>{links(rnd.randint(2, 8), rnd.choice(('ul', '')))}</div>",
            lambda: f"<header{attr('', 'header', 'masthead')}>{rnd.choice(('<h1>%s</h1>', '<p>%s</p>', '<div>%s</div>', '%s')) % words(1, 8)}{links(rnd.randint(0, 4), '')}</header>",
            lambda: f"<div{attr('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo')}>{rnd.choice(('%s', '<p>%s</p>')) % sentence(3, 40)}</div>",
            lambda: f"<aside{attr('', 'sidebar', 'widget', 'related')}>{rnd.choice(('<h3>%s</h3>' % words(1, 4), ''))}<p>{sentence(3, 40)}</p>{links(rnd.randint(0, 5), 'ul')}</aside>",
            lambda: f"<div{attr('sidebar', 'side', 'related', 'widget')}><p>{sentence(3, 30)}</p>{links(rnd.randint(1, 5), 'ul')}</div>",
            lambda: f"<div{attr('cookie', 'notice', 'consent', 'cookie-notice', 'alert')}>{rnd.choice(('%s', '<p>%s</p>')) % sentence(5, 40)}{rnd.choice(('', '<button>%s</button>' % words(1, 2)))}</div>",
            lambda: f"<form{attr('', 'search', 'newsletter', 'login')}>{rnd.choice(('<label>%s</label>', '<p>%s</p>', '%s')) % sentence(2, 15)}<input name=q><button>{words(1, 2)}</button></form>",
            lambda: f"<section{attr('comments', 'discussion', 'comment-list')}>{rnd.choice(('<h2>%s</h2>' % words(1, 2), ''))}{''.join('<div class=comment><p>%s</p></div>' % sentence(3, 50) for _ in range(rnd.randint(1, 5)))}</section>",
            lambda: f"<div{attr('comments', 'comment-list', 'replies')}>{''.join(rnd.choice(('<p>%s</p>', '<div>%s</div>', '<article><p>%s</p></article>')) % sentence(3, 50) for _ in range(rnd.randint(1, 5)))}</div>",
            lambda: f"<ul{attr('comments', 'commentlist')}>{''.join('<li>%s</li>' % sentence(3, 40) for _ in range(rnd.randint(1, 5)))}</ul>",
            lambda: f"<div{attr('share', 'social', 'tags')}>{links(rnd.randint(2, 5), '')}</div>",
        ]
        # drawn apart from the rest, so that the other parts of a page stay what they were without it
        aside = random.Random(f"unseen {seed} {number}")
        mark = aside.choice(("hidden", 'style="display:none"', 'style="display: none;"', 'hidden=""'))
        lost = [" ".join("".join(aside.choices("abcdefghijklmnoprstuvwz", k=aside.randint(2, 9))) for _ in range(aside.randint(3, 40))).capitalize() + "." for _ in range(aside.randint(1, 3))]
        tag = aside.choice(("div", "p", "section", "span", "li"))
        unseen = f"<{tag} {mark}>{lost[0]}</{tag}>" if tag in ("p", "li", "span") else f"<{tag} {mark}>{''.join(f'<p>{x}</p>' for x in lost)}</{tag}>"
        foot = [
            lambda: f"<footer{attr('', 'footer')}>{rnd.choice(('&copy; %s', '<p>&copy; %s</p>', '<p>%s</p>', '%s')) % sentence(3, 30)}{links(rnd.randint(0, 4), '')}</footer>",
            lambda: f"<div{attr('footer', 'copyright', 'legal')}><p>{rnd.choice(('&copy; ', ''))}{sentence(3, 25)}</p></div>",
        ]
        body = [keep(rnd.choice(("h1", "h1", "h2")), words(1, 12))] if rnd.random() < 0.85 else []
        for _ in range(rnd.randint(1, 9)):
            r = rnd.random()
            if r < 0.66:
                body.append(keep("p", " ".join(sentence(1, 40) for _ in range(rnd.randint(1, 4)))))
            elif r < 0.72:
                body.append(keep(rnd.choice(("h2", "h3")), words(1, 6)))
            elif r < 0.79:
                body.append("<ul>" + "".join(keep("li", sentence(2, 20)) for _ in range(rnd.randint(2, 5))) + "</ul>")
            elif r < 0.84:
                body.append("<table>" + "".join("<tr>" + keep("td", words(1, 4)) + keep("td", words(1, 4)) + "</tr>" for _ in range(rnd.randint(1, 3))) + "</table>")
            elif r < 0.88:
                body.append("<blockquote>" + keep("p", sentence(4, 30)) + "</blockquote>")
            elif r < 0.92:
                body.append(keep("div", sentence(4, 40)))
            elif r < 0.95:
                body.append(keep("", words(2, 30)))
            else:
                body.append(keep("p", f"{words(2, 10)}. {words(1, 2)}"))
            if rnd.random() < 0.14:
                body.append(rnd.choice(boiler[3:])())
        if aside.random() < 0.4:
            body.insert(aside.randint(0, len(body)), unseen)
        if aside.random() < 0.4:
            asked = "".join(f"<label>{' '.join(x.split()[:aside.randint(1, 3)])}</label><input name=q>" for x in lost)
            body.insert(aside.randint(0, len(body)), f"<form{aside.choice(('', ' action=/q'))}>{asked}<select><option>{lost[0]}</select>{aside.choice(('', '<button>%s</button>' % lost[0].split()[0]))}</form>")
        inner = "".join(body)
        wrap = rnd.choice(("article", "article", "main", "div-seek", "div", "main-article", "section", "nested"))
        shell = {"article": f"<article{attr('', 'post')}>{inner}</article>", "main": f"<main>{inner}</main>", "div-seek": f"<div{attr('content', 'post', 'entry', 'article-body', 'main')}>{inner}</div>", "div": f"<div>{inner}</div>", "main-article": f"<main><article>{inner}</article></main>", "section": f"<section{attr('', 'content')}>{inner}</section>", "nested": f"<div{attr('', 'page', 'wrapper')}><div{attr('content', 'main', '')}><article>{inner}</article></div></div>"}[wrap]
        top = [rnd.choice(boiler[:8])() for _ in range(rnd.randint(0, 3))]
        low = [rnd.choice(boiler[3:])() for _ in range(rnd.randint(0, 3))]
        page = "".join([*top, shell, *low, *([rnd.choice(foot)()] if rnd.random() < 0.85 else [])])
        yield f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title></head><body>{page}</body></html>", content


def page_labels(page: Page, content: set[str]) -> list[int]:
    """1 for content blocks and for every element above one."""
    y = [int(t is not None and t in content) for t in page.text]
    for i in range(len(y) - 1, -1, -1):
        if y[i] and page.parent[i] >= 0:
            y[page.parent[i]] = 1
    return y


@lru_cache(maxsize=4)
def trained_model(n: int = 300, seed: int = 11) -> TreeModel:
    """The model fitted to ``labelled_pages``: ``n`` pages are the bound of its sample."""
    made = list(labelled_pages(n, seed))
    pages = [parse(source) for source, _ in made]
    return train(pages, [page_labels(p, c) for p, (_, c) in zip(pages, made, strict=True)])


def main_texts(sources: list[str | None], model: TreeModel) -> list[str]:
    """The content blocks of every page, one to a line."""
    pages = [parse(s or "") for s in sources]
    parent, flat, starts, kind = flatten(pages)
    if not len(parent):
        return [""] * len(pages)
    p, _ = model.marginals(parent, np.add.reduceat(model.weights[flat], starts), kind)
    out, base = [], 0
    for page in pages:
        out.append("\n".join(t for t, q in zip(page.text, p[base : base + len(page.text)], strict=True) if t is not None and q >= 0.5))
        base += len(page.text)
    return out


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages(page_id, url, html)``.

    A null or empty page, or one without content, has the empty text. Rows are independent:
    repeated rows give repeated results, and an empty table gives none. Other columns are not
    read. No shuffle.
    """
    fitted = model or trained_model()
    weights, pair = fitted.weights, fitted.pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TreeModel(weights, pair)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(main_texts(part.column(2).to_pylist(), own), pa.string())], names=["page_id", "url", "text"])

    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
    texts = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, schema)
    return texts.withColumn("n_chars", F.length("text").cast("long"))
