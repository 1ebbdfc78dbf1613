"""Main text of web pages from flat text blocks.

A page is cut into text blocks at block-level tags; nothing of the tree is kept beyond what a block
carries: its words, the share of them in links, the same of two neighbours on each side, whether it is
a heading, a paragraph or in the same element as they are, and whether an enclosing element is an article, page furniture or hidden, or
named like furniture. A decision tree, grown on a small labelled table that a seeded rule writes, says
which blocks are the article.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship
from .common import named, slices
from .tree import Node, grow, predict

#: Elements that hold no markup and end at their next end tag only.
RAW = frozenset("script style title textarea".split())
#: Elements in the line whose text is furniture and no part of the text around them; of these, those
#: that hold others of their kind.
WIDGETS = frozenset("noscript template svg iframe object datalist select optgroup option button canvas audio video".split())
_NESTING = frozenset("noscript template svg object".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are page furniture whatever they are called, and elements that hold the article.
FURNITURE = frozenset("nav aside footer form menu dialog".split())
ARTICLE = frozenset(["article", "main"])
#: Names of furniture and of reader comments: a class, an id or a role counts where it is one of these or
#: where its first or last part is. They are two features among the others, no verdict.
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar related recommended share sharing footer masthead newsletter subscribe signup popup modal overlay login widget pagination pager contentinfo".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = BLOCKS - frozenset("p li dd dt td th tr thead tbody tfoot h1 h2 h3 h4 h5 h6 hr head html caption legend summary pre".split())
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?>[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+)(?=>)|[^>]*+)>|<[!?][^>]*+>""",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "words_2_before", "link_density_2_before",
    "words_2_after", "link_density_2_after", "standing", "in_furniture", "in_header", "bad_name", "comment_name",
    "heading", "paragraph", "after_heading", "hidden", "like_before", "like_after",
)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    flags: tuple[bool, ...]
    widget: bool = False
    element: str = ""
    row: list[float] = field(default_factory=list)


@dataclass
class _Open:
    """An open container or widget and what holds inside it. A widget holds back the state of the text
    around it, and is loose where its end tag is missing: then it ends at the next block."""

    name: str
    article: bool = False
    main: bool = False
    furniture: bool = False
    header: bool = False
    bad: bool = False
    comment: bool = False
    hidden: bool = False
    held: tuple | None = None
    loose: bool = False


def _names(attrs: str) -> set[str]:
    """The classes, ids and roles of a tag, each whole and by its first and last part, in lower case."""
    found = set()
    for m in _NAMES.finditer(attrs):
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = _PARTS.findall(name)
            found |= {x.lower() for x in (name, *parts[:1], *parts[-1:])}
    return found


def _entered(name: str, attrs: str, outer: _Open) -> _Open:
    called = _names(attrs) if "=" in attrs and name not in ("body", "html", "article", "main") else set()
    article = outer.article or name == "article"
    return _Open(
        name, article, outer.main or name == "main", outer.furniture or name in FURNITURE or name in WIDGETS, outer.header or (name == "header" and not outer.article),
        outer.bad or bool(called & BAD_NAMES), outer.comment or bool(called & COMMENT_NAMES), outer.hidden or bool(_HIDDEN.search(attrs)),
    )


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, with their features."""
    found: list[Block] = []
    stack = [_Open("")]
    text: list[str] = []
    linked = links = inside = 0
    heading = seen = False
    element = ""
    at, n = 0, len(page)
    tags: dict[str, tuple[list[int], list[bool]]] = {}

    def flush() -> None:
        nonlocal text, linked, seen
        whole = " ".join("".join(text).split())
        if whole:
            o = stack[-1]
            found.append(Block(whole, whole.count(" ") + 1, linked, (o.article, o.main, o.furniture, o.header, o.bad, o.comment, heading, element == "p", seen, o.hidden), inside > 0, element))
            seen |= heading and not (o.furniture or o.header)
        text, linked = [], 0

    def said(part: str) -> None:
        nonlocal linked
        if part:
            if "&" in part:
                part = entities.unescape(part)
            text.append(part)
            if links:
                linked += len(part.split())

    def leave() -> _Open:
        """Ends the innermost element."""
        nonlocal text, linked, links, heading, element, inside
        flush()
        o = stack.pop()
        if o.held is not None:
            inside -= 1
            text, linked, links, heading, element = o.held
        return o

    def is_loose(name: str) -> bool:
        """Whether the widget that has just begun has no end tag of its own."""
        if name not in tags:
            seen = [(m.start(), bool(m[1])) for m in re.compile(rf"<(/?){name}(?=[\s/>])", re.I).finditer(page, at)]
            tags[name] = [p for p, _ in seen], [end for _, end in seen]
        starts, ends = tags[name]
        k = bisect_left(starts, at)
        return k == len(starts) or (not ends[-1] if name in _NESTING else not ends[k])

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            said(page[at:])
            break
        said(page[at : m.start()])
        at = m.end()
        if not (name := m["name"]):
            continue
        name = name.lower()
        if name in RAW and not m["end"]:
            if not m["attrs"].endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
        elif name in WIDGETS:
            if m["end"]:
                if any(o.name == name for o in stack):
                    while leave().name != name:
                        pass
            elif not m["attrs"].endswith("/"):
                if stack[-1].loose and (stack[-1].name == name or (name == "optgroup" and stack[-1].name == "option")):
                    leave()
                widget = _entered(name, m["attrs"], stack[-1])
                widget.held, widget.loose = (text, linked, links, heading, element), is_loose(name)
                stack.append(widget)
                inside += 1
                text, linked = [], 0
        elif name == "a":
            links = 0 if m["end"] else 1
        elif name == "br":
            text.append(" ")
        elif name in BLOCKS:
            flush()
            while stack[-1].loose or (name in ARTICLE and not m["end"] and stack[-1].held is not None):
                leave()
                flush()
            if name in _CONTAINERS:
                if not m["end"]:
                    if name not in _VOID:
                        stack.append(_entered(name, m["attrs"], stack[-1]))
                elif any(o.name == name for o in stack):
                    while leave().name != name:
                        pass
            heading = not m["end"] and name in ("h1", "h2", "h3", "h4", "h5", "h6")
            element = "" if m["end"] else name
            links = 0
    while len(stack) > 1:
        leave()
    flush()
    return _with_features(found)


def _with_features(found: list[Block]) -> list[Block]:
    # where the page has an article element (main, where it has none): 1 inside, -1 outside
    telling = next((k for k in (0, 1) if any(b.flags[k] for b in found)), None)
    size = lambda b: (float(b.words), min(1.0, b.linked / b.words)) if b else (0.0, 0.0)
    # the neighbours of a block are those in the text around, which widgets are no part of
    shown, place = [None, None, *(b for b in found if not b.widget), None, None], 2
    for b in found:
        after = place if b.widget else place + 1
        standing = 0.0 if telling is None else 1.0 if b.flags[telling] else -1.0
        b.row = [*size(b), *size(shown[place - 1]), *size(shown[after]), *size(shown[place - 2]), *size(shown[after + 1]), standing, *map(float, b.flags[2:]), *(float(o is not None and o.element == b.element) for o in (shown[place - 1], shown[after]))]
        place += not b.widget
    return found


#: Pages of the labelled table, and the seed of the rule that writes them.
PAGES, SEED = 1200, 8


def _labelled_page(rng: random.Random) -> str:
    """A page whose blocks begin with + (article) or - (everything else). Half of the pages tell the
    article by its element, a quarter some furniture by name, a quarter nothing: there only lengths,
    links and neighbours do."""
    telling = rng.choice(("element", "element", "names", "nothing"))
    text = lambda n: " ".join("word" for _ in range(max(1, n)))
    n = lambda a, b: rng.randint(a, b)
    long = lambda: min(150, 12 + int(rng.expovariate(1 / 40)))
    named = lambda *names: f' class="{rng.choice(names)}"' if telling == "names" else ""
    element = lambda name: name if telling == "element" or rng.random() < 0.4 else "div"
    links = lambda k, inner="li": "".join(f"<{inner}><a>-{text(n(1, 4))}</a></{inner}>" for _ in range(k))
    advert = lambda: f"<div{named('ad', 'ad-slot', 'promo', 'banner-top')}>-{text(n(2, 14))}</div>"

    p = rng.choice(("p", "p", "p", "div"))

    def nav() -> str:
        name = element("nav")
        return rng.choice((f"<{name}{named('menu', 'navbar')}><ul>{links(n(2, 9))}</ul></{name}>", f"<div><p><a>-{text(n(1, 3))}</a> <a>{text(2)}</a></p></div>", f"<div>{links(n(1, 5), 'p')}</div>"))

    def body() -> str:
        out = [f"<h1>+{text(n(1, 12))}</h1>"] if rng.random() < 0.85 else []
        if rng.random() < 0.2:
            out.append(f"<p>+by {text(n(1, 3))}</p>")
        # an article has a paragraph of some length, among them short ones as well
        sizes = [long(), *(rng.choice((long(), long(), long(), n(1, 6))) for _ in range(n(0, 7)))]
        for size in sizes if rng.random() < 0.5 else rng.sample(sizes, len(sizes)):
            tail = f" <a>{text(n(1, max(1, size // 4)))}</a>" if rng.random() < 0.25 and size > 4 else ""
            out.append(f"<{p}>+{text(size)}{tail}</{p}>")
            if rng.random() < 0.12:
                out.append(f"<h2>+{text(n(1, 6))}</h2><p>+{text(long())}</p>")
            if rng.random() < 0.08:
                out.append("<ul>" + "".join(f"<li>+{text(n(2, 20))}</li>" for _ in range(n(2, 5))) + "</ul>")
            if rng.random() < 0.05:
                out.append(f"<blockquote>+{text(long())}</blockquote>")
            if rng.random() < 0.05 and telling != "nothing":
                out.append(f'<div class="{rng.choice(("ad", "promo", "share", "related"))}">-{text(n(1, 14))}</div>')
            if rng.random() < 0.05 and telling == "element":
                out.append(rng.choice((f"<form><label>-{text(n(1, 5))}</label></form>", f"<button>-{text(n(1, 3))}</button>", f"<aside>-{text(n(1, 30))}</aside>", f"<nav><a>-{text(2)}</a></nav>", f"<div hidden>-{text(n(1, 30))}</div>")))
            if rng.random() < 0.04 and telling != "nothing":  # a name that misleads
                out.append(f'<div class="{rng.choice(("menu", "banner", "related"))}"><p>+{text(40 + long())}</p><p>+{text(30 + long())}</p></div>')
        if telling == "element" and rng.random() < 0.3:
            out.append(rng.choice((f"<p>+{text(n(1, 3))}</p>", f"<p><a>+{text(n(1, 8))}</a></p>")))
        return "".join(out)

    def comments() -> str:
        said = "".join(f"<p>-{text(n(1, 60))}</p>" for _ in range(n(1, 4)))
        return f'<section class="{rng.choice(("comments", "comment-list", "replies"))}">{said}</section>'

    def footer() -> str:
        name = element("footer")
        return rng.choice((f"<{name}{named('footer', 'page-footer')}>-{text(n(1, 16))}</{name}>", f"<{name}><a>-{text(2)}</a> <a>{text(2)}</a></{name}>", ""))

    if telling == "element":
        name = rng.choice(("article", "article", "main"))
        header = f"<header><p>-{text(n(1, 8))}</p></header>" if rng.random() < 0.4 else ""
        inner = rng.choices(("p", "div", "li", "h2", "td", "blockquote"), k=6)
        inner = inner if rng.random() < 0.5 else inner[:1] * 6
        bits = [f"<{t}>{link}+{text(n(1, 9))}{link and '</a>'}</{t}>" for t, link in zip(inner[: n(1, 6)], rng.choices(("", "", "", "<a>"), k=6))]
        if rng.random() < 0.2:
            bits.append(f"<button>-{text(n(1, 3))}</button>")
        small = f"<{name}>{''.join(bits)}</{name}>"
        middle = small if rng.random() < 0.45 else f"<{name}>{body()}{comments() if rng.random() < 0.3 else ''}</{name}>"
        aside = f"<div><p>-{text(long())}</p></div>" if name == "article" and rng.random() < 0.3 else f"<aside><p>-{text(n(2, 40))}</p></aside>"
    else:
        header = f"<div>-{text(n(1, 6))}</div>" if rng.random() < 0.4 else ""
        middle = f"<div>{body()}</div>" if rng.random() < 0.7 else body()
        middle += comments() if telling == "names" and rng.random() < 0.4 else ""
        aside = rng.choice(("", f"<div>{links(n(3, 8))}</div>", f"<div class=sidebar><p>-{text(n(2, 40))}</p></div>" if telling == "names" else ""))
    if rng.random() < (0.4 if telling == "element" else 0.2):  # a page of nothing else, or of one paragraph
        return middle if rng.random() < 0.6 else f"<{'div' if telling != 'element' else 'article'}><{p}>+{text(long())}</{p}>"
    parts = (header, nav() if rng.random() < 0.85 else "", advert() if rng.random() < 0.6 else "", middle, aside if rng.random() < 0.6 else "", nav() if rng.random() < 0.2 else "", footer())
    return "".join(parts)


def labelled_table(pages: int = PAGES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: article) of the blocks of the labelled pages."""
    rng = random.Random(seed)
    found = [b for _ in range(pages) for b in blocks_of(_labelled_page(rng))]
    return np.array([b.row for b in found]), np.array([float(b.text[0] == "+") for b in found])


def train() -> Node:
    return grow(*labelled_table(), depth=16, least=8)


def main_text(page: str | None, model: Node) -> str:
    """The article's blocks, one a line; empty where there is none."""
    return "\n".join(b.text for b in blocks_of(page or "") if predict(model, b.row) >= 0.5)


def extract_html(pages: DataFrame, html_col: str = "html", model: Node | None = None) -> DataFrame:
    """pages with columns text and n_chars in place of the html.

    Null, empty and textless html give the empty text. Unclosed, misnested and truncated markup is
    read to its end; of any length nothing is cut. Rows are independent: repeated rows repeat their
    result, other columns pass through, and columns of the input named text or n_chars are replaced.
    An empty table gives an empty result.
    """
    tree = model or train()
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(*map(named, (*kept, html_col)))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html_col):
                texts = [main_text(h, tree) for h in part.columns[-1].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    schema.names,
                )

    return rows.mapInArrow(run, schema)
