"""Main text of web pages by a tree-structured graphical model over their blocks and containers.

A page becomes a tree: containers are elements, leaves are blocks, the runs of inline text between block borders. Every node is content or
not; a node's own features give it a potential, and each parent-child pair another. Messages pass upward from the leaves and downward
from the root, which on a tree gives exact marginals, and blocks that are more likely content than not are kept. The potentials are
fitted by gradient on the likelihood of labelled pages, whose expected counts come from the same messages.

Cases: a null or empty page, or one without content, gives an empty text; unclosed, crossed and stray tags, cut-off tags and comments,
and deep nesting are taken as they come; repeated rows are read each; other columns stay, names clashing with the results excepted;
an empty table gives an empty table. Nothing is cut: texts may be of any length.
"""

from __future__ import annotations

import html as references
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the format: elements whose content is no text of the page, void elements, inline elements, and the elements that
# an open one of a kind ends at.
_SILENT = frozenset("script style template noscript iframe object svg math canvas head title textarea select audio video".split())
_RAW = frozenset("script style textarea title noscript iframe xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table td th tr ul".split())
_LIKE_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table tbody thead div article section body".split())

_IN_HEAD = frozenset("head html base basefont bgsound link meta".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"  # comment, cut off or not
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|$)"  # tag
    r"|<[!?][^>]*+(?:>|$)",  # declaration
    re.S,
)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")

#: Words of class, id and role names that the model looks for; all other names count as unknown.
_NAMES = frozenset(
    "ad ads advert advertisement article author banner body bottom breadcrumb breadcrumbs button byline caption comment comments content cookie "
    "copyright dialog discussion disqus entry feedback footer form gdpr header hero legal links login main masthead menu meta modal nav navbar "
    "navigation newsletter notice pagination paragraph popup post primary privacy promo recommended related replies reply respond review "
    "search section share sidebar sign signup site skip social sponsor sponsored story subscribe tags text toc toolbar top widget".split()
)
_TAGS = frozenset(
    "html body main article section aside nav header footer form div p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table tr td th figure figcaption details summary dialog menu fieldset address button center".split()
)


class Node:
    __slots__ = ("block", "features", "parent", "tag")

    def __init__(self, tag: str, parent: int, block: str | None, features: list[tuple[str, float]]):
        self.tag, self.parent, self.block, self.features = tag, parent, block, features


def _leaf_features(text: str, linked: int, parent_tag: str) -> list[tuple[str, float]]:
    n = len(text)
    words = text.count(" ") + 1
    share = min(1.0, linked / n)
    ends = text[-1:] in ".!?。…\"'»”"
    return [
        ("leaf", 1.0),
        ("log length", math.log1p(n) / 8),
        ("linked", share),
        ("all linked", float(share > 0.9)),
        ("ends a sentence", float(ends)),
        ("under 3 words", float(words < 3)),
        ("over 15 words", float(words > 15)),
        ("copyright", float("©" in text or "(c)" in text.lower()[:40])),
        (f"in {parent_tag if parent_tag in _TAGS else 'other'}", 1.0),
    ]


def _head_end(page: str, at: int) -> int:
    """Where the head whose start tag ends at this place is over: after its end tag, or before the first text or tag that belongs to the
    body, as the tags of head and body may be left out. An unclosed element of the head holds none of the body where that can be told."""
    while m := _TOKEN.search(page, at):
        if page[at : m.start()].strip():
            return at
        if m[2] is None:
            at = m.end()
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if closing:
            if tag == "head":
                return m.end()
            if tag in ("body", "html"):
                return m.start()
            at = m.end()
        elif tag in _IN_HEAD:
            at = m.end()
        elif tag in ("script", "style", "title", "noscript", "template"):
            end = re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*+>?", re.I).search(page, m.end())
            border = None if end and tag in ("script", "style") else re.compile(r"</head\s*>|<body[\s>]" if not end else r"</head\s*>", re.I).search(page, m.end(), end.start() if end else len(page))
            if border:
                return border.end() if border[0][1] == "/" else border.start()
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                return len(page)
            else:  # its text ends at the next tag
                after = _TOKEN.search(page, m.end())
                at = after.start() if after else len(page)
        else:
            return m.start()
    return at if page[at:].strip() else len(page)


def tree(page: str) -> list[Node]:
    """Nodes in page order, parents first. The first is the root."""
    nodes = [Node("#root", -1, None, [("bias", 1.0)])]
    stack: list[tuple[str, int]] = [("#root", 0)]
    held: list[str] = []
    linked = link = at = silent = 0
    silent_tag = ""

    def close_block():
        nonlocal linked, link
        if held:
            text = " ".join(references.unescape("".join(held)).split())
            if text:
                tag, parent = stack[-1]
                nodes.append(Node("#text", parent, text, _leaf_features(text, linked, tag)))
            held.clear()
        linked = link = 0

    def say(text: str):
        nonlocal linked
        held.append(text)
        if link:
            linked += len(text.strip())

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            if not silent:
                say(page[at:])
            break
        if not silent and m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if silent:
            if tag == silent_tag:
                silent += -1 if closing else 1
            continue
        if not closing and tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(page, at)
            at = len(page) if not end else end.start()
            if end:
                at = max(at, page.find(">", at) + 1) or len(page)
            continue
        if tag in _SILENT:
            if not closing and not m[3].endswith("/"):
                if tag == "head":
                    at = _head_end(page, at)
                else:
                    silent, silent_tag = 1, tag
            continue
        if tag in _INLINE:
            if tag == "br":
                held.append(" ")
            elif tag == "a":
                link = 0 if closing else 1
            continue
        close_block()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in _VOID:
            continue
        if tag in _ENDS_P and stack[-1][0] == "p":
            stack.pop()
        ends = _LIKE_ENDS.get(tag, ())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in ends:
                del stack[i:]
                break
            if stack[i][0] in _SCOPES:
                break
        features = [("bias", 1.0), (f"tag {tag if tag in _TAGS else 'other'}", 1.0)]
        for x in _NAMED.finditer(m[3]):
            for part in set(_PART.findall((x[1] or x[2] or x[3] or "").lower())):
                features.append((f"named {part if part in _NAMES else 'otherwise'}", 1.0))
        nodes.append(Node(tag, stack[-1][1], None, features))
        stack.append((tag, len(nodes) - 1))
    close_block()
    return nodes


#: Kinds of parent-child pairs, each with potentials of its own.
_KINDS = {"child is text": 0, "child is a container": 1, "parent is the root or body": 2}


def _kind(node: Node, nodes: list[Node]) -> int:
    if nodes[node.parent].tag in ("#root", "html", "body"):
        return 2
    return 0 if node.block is not None else 1


def passes(nodes: list[Node], own: list[float], pair) -> tuple[list[float], list[list[float]], float]:
    """Sum-product messages in log space. own: a node's log odds of content; pair[kind][parent][child]. Returns marginals of content,
    joint marginals of (parent, child) as four numbers for each node, and the log partition sum."""
    n = len(nodes)
    up = [[0.0, x] for x in own]
    to_parent: list = [None] * n
    kinds = [0] + [_kind(x, nodes) for x in nodes[1:]]
    add = lambda a, b: (a if a > b else b) + math.log1p(math.exp(-abs(a - b)))
    for i in range(n - 1, 0, -1):
        p, u = pair[kinds[i]], up[i]
        m = to_parent[i] = (add(p[0][0] + u[0], p[0][1] + u[1]), add(p[1][0] + u[0], p[1][1] + u[1]))
        above = up[nodes[i].parent]
        above[0] += m[0]
        above[1] += m[1]
    total = add(*up[0])
    # whole[i]: log of everything that touches node i, in either state
    whole: list = [None] * n
    whole[0] = up[0]
    joint: list = [None] * n
    marginals = [math.exp(up[0][1] - total)] + [0.0] * (n - 1)
    for i in range(1, n):
        p, u, m, w = pair[kinds[i]], up[i], to_parent[i], whole[nodes[i].parent]
        rest = (w[0] - m[0], w[1] - m[1])
        whole[i] = [add(rest[0] + p[0][c], rest[1] + p[1][c]) + u[c] for c in (0, 1)]
        joint[i] = [math.exp(rest[a] + p[a][c] + u[c] - total) for a in (0, 1) for c in (0, 1)]
        marginals[i] = math.exp(whole[i][1] - total)
    return marginals, joint, total


class Model:
    def __init__(self, weights: dict[str, float], pair):
        self.weights, self.pair = weights, pair

    def own(self, node: Node) -> float:
        get = self.weights.get
        return sum(get(k, 0.0) * v for k, v in node.features)

    def extract(self, page: str | None) -> list[str]:
        """Content blocks in page order."""
        nodes = tree(page or "")
        if len(nodes) == 1:
            return []
        marginals, _, _ = passes(nodes, [self.own(x) for x in nodes], self.pair)
        return [x.block for x, m in zip(nodes, marginals, strict=True) if x.block is not None and m > 0.5]


def fit(pages: list[tuple[str, set[str]]], rounds: int = 120, rate: float = 0.8, decay: float = 1e-4) -> Model:
    """Maximum likelihood on labelled pages: (html, texts of its content blocks). A container is content if it is
    the lowest around all content blocks, or lies below that and holds some."""
    trees = []
    for page, content in pages:
        nodes = tree(page)
        good = [0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            if nodes[i].block is not None:
                good[i] = int(nodes[i].block in content)
            good[nodes[i].parent] += good[i]
        top = max((i for i, g in enumerate(good) if g == good[0] and nodes[i].block is None), default=0)  # the deepest around all content
        if nodes[top].tag in ("h1", "p"):
            top = nodes[top].parent
        labels = [0] * len(nodes)
        for i in range(top, len(nodes)):
            labels[i] = int(good[i] > 0 and (i == top or labels[nodes[i].parent] == 1))
        trees.append((nodes, labels))
    weights: dict[str, float] = {}
    pair = [[[0.0, 0.0], [0.0, 0.0]] for _ in _KINDS]
    squares: dict = {}
    for _ in range(rounds):
        grad: dict = {}
        for nodes, labels in trees:
            model = Model(weights, pair)
            marginals, joint, _ = passes(nodes, [model.own(x) for x in nodes], pair)
            for i, (x, m, y) in enumerate(zip(nodes, marginals, labels, strict=True)):
                for k, v in x.features:
                    grad[k] = grad.get(k, 0.0) + (y - m) * v
                if i:
                    kind, above = _kind(x, nodes), labels[x.parent]
                    for a in (0, 1):
                        for c in (0, 1):
                            key = (kind, a, c)
                            grad[key] = grad.get(key, 0.0) + (a == above and c == y) - joint[i][2 * a + c]
        for k, g in grad.items():
            old = weights.get(k, 0.0) if isinstance(k, str) else pair[k[0]][k[1]][k[2]]
            g = g / len(trees) - decay * old
            squares[k] = squares.get(k, 1e-8) + g * g
            step = old + rate * g / math.sqrt(squares[k])
            if isinstance(k, str):
                weights[k] = step
            else:
                pair[k[0]][k[1]][k[2]] = step
    return Model(weights, pair)


def labelled_pages(count: int = 150, seed: int = 7) -> list[tuple[str, set[str]]]:
    """Made-up pages of many shapes, each with the texts of its content blocks."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiourstnlmdp") for _ in range(rng.randint(2, 8)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize()
    sentence = lambda: phrase(5, 18) + rng.choice(".....?!")

    def links(n):
        return "".join(f'<li><a href="/{word()}">{phrase(1, 2)}</a></li>' for _ in range(n))

    def boiler(kind):
        pick = rng.choice
        return {
            "nav": lambda: pick([f"<nav><ul>{links(rng.randint(3, 8))}</ul></nav>", f'<div class="{pick(["menu", "navbar", "site-navigation"])}"><ul>{links(5)}</ul></div>', f"<ul>{links(6)}</ul>", f'<div id="breadcrumbs"><a href="/">{phrase(1, 1)}</a> <a href="/x">{phrase(1, 2)}</a></div>']),
            "header": lambda: pick([f"<header><h2>{phrase(1, 3)}</h2><p>{phrase(3, 6)}</p></header>", f'<div class="{pick(["header", "masthead", "site-header", "banner"])}">{phrase(1, 4)}</div>']),
            "footer": lambda: pick([f"<footer>&copy; {word()}.com &middot; {sentence()}</footer>", f"<footer><p>{sentence()}</p><ul>{links(3)}</ul></footer>", f'<div class="{pick(["footer", "copyright", "legal"])}">&copy; {phrase(2, 4)}. {sentence()}</div>']),
            "aside": lambda: pick([f"<aside><h3>{phrase(1, 3)}</h3><p>{sentence()}</p></aside>", f'<div class="{pick(["sidebar", "widget", "related", "recommended"])}"><h3>{phrase(1, 3)}</h3><ul>{links(4)}</ul><p>{sentence()} {sentence()}</p></div>', f"<aside><ul>{links(4)}</ul></aside>"]),
            "ad": lambda: f'<{pick(["div", "section", "div"])} class="{pick(["ad", "ads", "advert", "sponsored", "promo", "advertisement"])}">{pick([sentence(), f"<p>{sentence()} {sentence()}</p>", sentence() + " " + sentence()])}</div>',
            "notice": lambda: f'<div {pick(["class", "id"])}="{pick(["cookie", "cookie-notice", "notice", "gdpr", "privacy", "newsletter", "subscribe", "popup", "modal"])}"><p>{sentence()} {pick(["", sentence()])}</p><button>{phrase(1, 2)}</button></div>',
            "form": lambda: f'<form><label>{phrase(1, 2)}</label><input name="q"><p>{sentence()}</p><button>{phrase(1, 2)}</button></form>',
            "share": lambda: f'<div class="{pick(["share", "social", "tags", "byline", "meta"])}">{phrase(1, 3)}</div>',
            "comments": lambda: f'<{pick(["div", "section", "ul", "ol"])} {pick(["class", "id"])}="{pick(["comments", "comment-list", "discussion", "replies", "respond"])}"><h3>{phrase(1, 2)}</h3>' + "".join(f'<{pick(["div", "li", "article"])} class="comment"><p>{sentence()} {sentence()}</p></div>' for _ in range(rng.randint(1, 4))) + "</div>",
        }[kind]()

    out = []
    for _ in range(count):
        content: list[str] = []
        terse = rng.random() < 0.12

        def said(text):
            content.append(text)  # noqa: B023
            return text.replace(" ", rng.choice([" ", " ", "\n ", "  ", "<br>" if rng.random() < 0.05 else " "]))

        def paragraph():
            x = rng.random()
            text = " ".join(sentence() for _ in range(rng.randint(1, 6))) if x < 0.6 and not terse else phrase(1, 3) + "." if x < 0.7 or terse else phrase(1, 40) if x < 0.9 else phrase(60, 400)
            body = said(text)
            if rng.random() < 0.2:
                body = f"<b>{body}" if rng.random() < 0.5 else f"<em>{body}</em>"
            return f"<p>{body}</p>" if rng.random() < 0.8 else f"<p>{body}"

        parts = [f"<h1>{said(phrase(3, 9))}</h1>"]
        for _ in range(rng.choice([15, 60, 150]) if terse else rng.choice([0, 1, 1, 2, 3, 4, 6, 9, 12])):
            x = rng.random()
            parts.append(f"<h2>{said(phrase(2, 6))}</h2>" if x < 0.1 else f"<ul><li>{said(sentence())}</li><li>{said(sentence())}</li></ul>" if x < 0.17 else f"<blockquote>{said(sentence())}</blockquote>" if x < 0.22 else boiler(rng.choice(["ad", "share", "notice"])) if x < 0.3 else paragraph())
        start, end = rng.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ('<div class="article-body">', "</div>"), ('<div class="content"><div class="post">', "</div></div>"), ('<div id="main"><section class="story">', "</section></div>"), ('<article class="post entry">', "</article>")])
        before = "".join(boiler(k) for k in rng.sample(["nav", "header", "ad", "notice", "form", "aside"], rng.randint(1, 4)))
        after = "".join(boiler(k) for k in rng.sample(["aside", "footer", "comments", "share", "ad", "form", "nav"], rng.randint(1, 5)))
        inner = boiler("comments") if rng.random() < 0.15 else ""
        page = f"<!DOCTYPE html><html><head><title>{phrase(2, 5)}</title><style>p{{margin:0}}</style></head><body>{before}{start}{''.join(parts)}{inner}{end}{after}" + rng.choice(["</body></html>", ""])
        out.append((page, {" ".join(x.split()) for x in content}))
    return out


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None, html: str = "html") -> DataFrame:
    """Adds text (content blocks joined by blank lines) and n_chars, in place of the page. The model is a few hundred numbers."""
    import pyarrow as pa

    model = model or default_model()
    new = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    rest = [c for c in pages.columns if c not in ("text", "n_chars", html)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
            texts = ["\n\n".join(model.extract(x.as_py())) for x in column(html)]
            yield pa.RecordBatch.from_arrays([*(column(c) for c in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    return pages.select(*rest, html).mapInArrow(run, T.StructType([pages.schema[c] for c in rest] + new))
