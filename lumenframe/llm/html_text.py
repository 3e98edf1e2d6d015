"""Main text of HTML pages by a tree-structured graphical model.

The block elements of a page are the nodes of a tree, each with the label "holds main text" or not. A
node's potential is a naive Bayes ratio of its features (tag, class and id words, length, links,
sentences); a potential for each parent and child, by the parent's tag and the child's share of its text, joins the labels. Sum-product
messages up and down the tree give exact marginals. Both are counted on labelled pages: a
fixed number of pages that labelled_pages() makes, in whose mark-up each region's label stands. A page with
labels of one's own (attribute data-gold) may be given instead.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Labelled pages that the model is trained on.
TRAINING_PAGES = 600
#: Weight of a node's features, which are not independent.
WEIGHT = 0.7
GOLD = "data-gold"

BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul ins iframe".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page; those of the first kind hold no mark-up.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
UNSEEN = frozenset("script style textarea title xmp noembed noframes iframe head noscript template svg math object canvas audio video map select button datalist".split())
#: Start tags that end an open element of the second set, up to the nearest of the third.
CLOSES_P = BLOCKS - {"html", "body", "option", "optgroup", "ins", "iframe"}
SAME = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table thead tbody tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("thead tbody tfoot tr td th", "table"), "thead": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table")}
SAME = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SAME.items()}

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
_HINT_WORD = re.compile(r"[a-z]{2,}")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "words", "gold", "chars", "linked", "stops")

    def __init__(self, tag: str, parent: int, words: tuple[str, ...], gold: int | None):
        self.tag, self.parent, self.words, self.gold = tag, parent, words, gold
        self.chars = self.linked = self.stops = 0


@lru_cache(20_000)
def _kept_attributes(raw: str) -> tuple[tuple[str, ...], int | None]:
    return _read_attributes(raw)


def _attributes(raw: str) -> tuple[tuple[str, ...], int | None]:
    """As _read_attributes; what was read of shorter strings is kept."""
    return _kept_attributes(raw) if len(raw) < 400 else _read_attributes(raw)


def _read_attributes(raw: str) -> tuple[tuple[str, ...], int | None]:
    """Words of class, id and role; the label, if there is one."""
    words: list[str] = []
    gold = None
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "aria-label"):
            words += _HINT_WORD.findall(_CAMEL.sub(" ", value).lower())
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I) or name == "aria-hidden" and value == "true":
            words.append("(hidden)")
        elif name == GOLD:
            gold = int(value)
    return tuple(dict.fromkeys(words)), gold


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes, parents first, and the text blocks (node, text) in page order. Lenient: unclosed,
    stray and cut tags are read as browsers do, about."""
    nodes = [Node("html", -1, (), None)]
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with their block node
    run: list[str] = []
    at, unseen, links, linked = 0, 0, 0, 0

    def end_run() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                of = stack[-1][1]
                blocks.append((of, text))
                node = nodes[of]
                node.chars += len(text)
                node.linked += min(linked, len(text))
                node.stops += text.count(". ") + (text[-1] in ".!?…") + text.count(", ")
            linked = 0

    def pop_to(k: int) -> None:
        nonlocal unseen, links
        end_run()
        for tag, _ in stack[k:]:
            unseen -= tag in UNSEEN
            links -= tag == "a"
        del stack[k:]

    def text_of(begin: int, end: int) -> None:
        nonlocal linked
        if begin < end and not unseen:
            piece = page[begin:end]
            run.append(piece)
            if links:
                linked += len(piece.strip())

    position, size = 0, len(page)
    while position < size:
        m = _TOKEN.search(page, position)
        if not m:
            text_of(position, size)
            break
        text_of(position, m.start())
        position = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:  # an end tag
            if tag == "br":
                run.append(" ")
            elif tag == "p" and not any(t == "p" for t, _ in stack):
                end_run()
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        if tag in BLOCKS or any(t in BLOCKS for t, _ in stack[k:]):
                            pop_to(k)
                        else:
                            unseen -= sum(t in UNSEEN for t, _ in stack[k:])
                            links -= sum(t == "a" for t, _ in stack[k:])
                            del stack[k:]
                        break
                    if stack[k][0] in ("table", "article", "body") and tag not in BLOCKS:
                        break
            continue
        if m[0][-1] != ">":  # cut in a tag
            break
        if tag in ("html", "body", "head") and tag != "head":
            words, gold = _attributes(m[3] or m[6] or "")
            if tag == "body":
                k = next((k for k, (t, _) in enumerate(stack) if t == "head"), None)
                if k is not None:
                    pop_to(k)
                end_run()
                if nodes[stack[-1][1]].tag == "html":
                    nodes.append(Node("body", stack[-1][1], words, gold))
                    stack.append(("body", len(nodes) - 1))
            continue
        if tag in VOID:
            if tag == "br":
                run.append(" ")
            elif tag == "hr":
                end_run()
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in ("td", "th", "table", "article", "section", "body", "div", "li", "button"):
                    break
        if tag in SAME:
            close, upto = SAME[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in upto:
                    break
                if stack[k][0] in close:
                    pop_to(k)
                    if tag not in ("tr", "tbody", "thead", "tfoot"):
                        break
        raw = m[3] or m[6] or ""
        if tag in BLOCKS and tag not in UNSEEN:
            end_run()
            words, gold = _attributes(raw)
            nodes.append(Node(tag, stack[-1][1], words, gold))
            stack.append((tag, len(nodes) - 1))
        else:
            if raw.endswith("/") and tag in ("svg", "path", "use"):
                continue
            unseen += tag in UNSEEN
            links += tag == "a"
            stack.append((tag, stack[-1][1]))
        if tag in RAW:
            m = _RAW_END[tag].search(page, position)
            position = m.end() if m else size
            pop_to(len(stack) - 1) if tag in BLOCKS else stack.pop()
            unseen -= tag in UNSEEN and tag not in BLOCKS
    end_run()
    return nodes, blocks


def _add_up(nodes: list[Node]) -> None:
    for k in range(len(nodes) - 1, 0, -1):
        n, up = nodes[k], nodes[nodes[k].parent]
        up.chars += n.chars
        up.linked += n.linked
        up.stops += n.stops


def features(node: Node) -> list[str]:
    chars = node.chars
    density = node.linked / chars if chars else 0
    links = 0 if not density else 1 + (density > 0.25) + (density > 0.6)
    out = [f"tag {node.tag} {links}", f"long {0 if not chars else 1 + (chars > 30) + (chars > 120) + (chars > 500)}", f"stops {min(node.stops, 3)}"]
    out += ["word " + w for w in node.words]
    return out


class TreeModel:
    def __init__(self, pages: list[str]):
        seen, total = (Counter(), Counter()), [0, 0]
        steps: dict = defaultdict(lambda: [[1.0, 1.0], [1.0, 1.0]])
        for page in pages:
            nodes, _ = parse(page)
            _add_up(nodes)
            nodes[0].gold = 1
            for n in nodes:
                if n.gold is None:
                    n.gold = nodes[n.parent].gold
                if n.parent >= 0:
                    up = nodes[n.parent]
                    for tag in (up.tag, ""):
                        steps[tag, self.whole(up, n)][up.gold][n.gold] += 1
                total[n.gold] += 1
                seen[n.gold].update(set(features(n)))
        kinds = Counter(f.split()[0] for f in seen[0].keys() | seen[1].keys())
        self.ratio = {}
        for f in seen[0].keys() | seen[1].keys():
            if seen[0][f] + seen[1][f] >= 3:
                v = 1 if f.startswith("word") else kinds[f.split()[0]]
                self.ratio[f] = WEIGHT * (math.log((seen[1][f] + 0.5) / (total[1] + 0.5 * v)) - math.log((seen[0][f] + 0.5) / (total[0] + 0.5 * v)))
        self.steps = {key: [[math.log(x / sum(row)) for x in row] for row in s] for key, s in steps.items()}

    @staticmethod
    def whole(parent: Node, child: Node) -> bool:
        """Whether the child holds nearly all of its parent's text."""
        return child.chars > 0 and child.chars >= 0.9 * parent.chars

    def step(self, parent: Node, child: Node) -> list[list[float]]:
        """Log potentials [parent's label][child's label]."""
        whole = self.whole(parent, child)
        return self.steps.get((parent.tag, whole)) or self.steps["", whole]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Chance of the label 1 for each node: messages from the leaves up, then from the root down."""
        n = len(nodes)
        ratio = self.ratio
        own = [[0.0, sum(ratio.get(f, 0.0) for f in features(x))] for x in nodes]
        own[0] = [-8.0, 0.0]  # the page holds its text
        up: list[tuple[float, float]] = [(0.0, 0.0)] * n
        inner = [list(x) for x in own]
        for k in range(n - 1, 0, -1):
            step = self.step(nodes[nodes[k].parent], nodes[k])
            a, b = inner[k]
            message = []
            for s in step:
                x, y = s[0] + a, s[1] + b
                top = x if x > y else y
                message.append(top + math.log(math.exp(x - top) + math.exp(y - top)))
            up[k] = (message[0], message[1])
            into = inner[nodes[k].parent]
            into[0] += message[0]
            into[1] += message[1]
        belief = [None] * n
        belief[0] = inner[0]
        for k in range(1, n):
            p = nodes[k].parent
            step = self.step(nodes[p], nodes[k])
            x0, x1 = belief[p][0] - up[k][0], belief[p][1] - up[k][1]
            down = []
            for c in (0, 1):
                x, y = step[0][c] + x0, step[1][c] + x1
                top = x if x > y else y
                down.append(top + math.log(math.exp(x - top) + math.exp(y - top)))
            low, high = inner[k][0] + down[0], inner[k][1] + down[1]
            top = low if low > high else high
            belief[k] = [low - top, high - top]  # kept near 0, whatever the size of the tree
        return [1 / (1 + math.exp(max(-700.0, min(700.0, b[0] - b[1])))) for b in belief]

    def text(self, page: str) -> str:
        nodes, blocks = parse(page)
        if not blocks:
            return ""
        _add_up(nodes)
        chance = self.marginals(nodes)
        return "\n".join(text for node, text in blocks if chance[node] >= 0.5)


#: Class and id names of page regions, as they are common on the web (fixed values).
REGIONS = {
    "header": "header masthead site-header top-bar branding logo page-header topbar banner-top hero-nav",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs main-menu nav-links pagination pager skip-link toc",
    "advert": "ad ads advert advertisement sponsored promo ad-slot adsbygoogle sponsor ad-container banner-ad commercial",
    "notice": "cookie cookie-notice consent gdpr notice alert banner popup modal newsletter subscribe paywall privacy message overlay",
    "sidebar": "sidebar side-bar widget related trending popular recommended rail secondary aside more-stories most-read teaser",
    "form": "search search-form login contact-form signup form field",
    "comments": "comments comment-list disqus respond replies discussion responses comment user-comments reader-comments thread",
    "share": "share social tags sharing social-links toolbar tools meta-links",
    "footer": "footer site-footer copyright colophon bottom foot legal footer-links",
    "content": "content article post entry story article-body post-content entry-content main-content text body articleBody main page-content story-body",
    "wrapper": "page container wrapper wrap site row col layout inner grid",
}
_SYLLABLES = "ba ce di fo gu ka le mi no pu ra se ti vo zu an er in or ut".split()


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 5) -> list[str]:
    """Pages in the styles of the web, with data-gold on the elements that begin a region."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: (words(4, 9) + r.choice([", ", " ", " "]) + words(2, 9)).capitalize() + r.choice(".....!?")
    prose = lambda a, b: " ".join(sentence() for _ in range(r.randint(a, b)))
    link = lambda a=1, b=3: f'<a href="/{word()}">{words(a, b)}</a>'

    def mark(region: str, tags: str, gold: int, inside: str) -> str:
        tag = r.choice(tags.split())
        names = REGIONS[region].split()
        attributes = f' {GOLD}="{gold}"'
        if tag in ("div", "section", "ul", "ol", "p", "aside", "ins", "span") or r.random() < 0.4:
            attributes += f' {r.choice(["class", "class", "id"])}="{r.choice(names)}{r.choice(["", "", " " + word()])}"'
        return f"<{tag}{attributes}>{inside}</{tag}>"

    def menu(gold: int = 0) -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9)))
        return mark("menu", "nav nav div ul", gold, f"<ul>{items}</ul>" if r.random() < 0.8 else " | ".join(link() for _ in range(5)))

    def advert() -> str:
        return mark("advert", "div div aside ins section", 0, r.choice([prose(1, 3), link(2, 6), f"<p>{prose(1, 2)}</p>", f"<h3>{words(2, 5)}</h3><p>{prose(1, 1)}</p>{link()}"]))

    def notice() -> str:
        return mark("notice", "div div section aside dialog", 0, r.choice([f"<p>{prose(1, 3)}</p>", prose(1, 2)]) + r.choice(["", link(), f"<button>{word()}</button>"]))

    def sidebar() -> str:
        return mark("sidebar", "aside aside div section", 0, f"<h3>{words(1, 3)}</h3>" + r.choice([f"<ul>{''.join(f'<li>{link(3, 8)}</li>' for _ in range(r.randint(2, 6)))}</ul>", f"<p>{prose(1, 3)}</p>", "".join(f"<div><h4>{link(3, 7)}</h4><p>{prose(1, 1)}</p></div>" for _ in range(3))]))

    def form() -> str:
        return f'<form {GOLD}="0" class="{r.choice(REGIONS["form"].split())}"><label>{words(1, 3)}</label><input name="q">{r.choice(["", f"<p>{prose(1, 2)}</p>", f"<fieldset><legend>{words(1, 3)}</legend></fieldset>"])}<button>{word()}</button></form>'

    def comments() -> str:
        one = lambda: f'<{(t := r.choice(["div", "li", "div", "li", "div", "li", "div", "li", "article"]))} class="comment"><p>{words(1, 2)}</p><p>{prose(1, 5)}</p></{t}>'
        return mark("comments", "section div div ol", 0, f"<h2>{words(1, 3)}</h2>" + "".join(one() for _ in range(r.randint(1, 5))) + r.choice(["", form()]))

    def share() -> str:
        return mark("share", "div ul p", 0, "".join(f"<li>{link(1, 1)}</li>" for _ in range(4)) if r.random() < 0.5 else " ".join(link(1, 1) for _ in range(4)))

    def body_block() -> str:
        x = r.random()
        if x < 0.07:  # without sentences
            return f"<p>{words(1, r.choice([6, 60, 300]))}</p>"
        if x < 0.68:
            text = prose(1, 7)
            if r.random() < 0.2:
                text += " " + link(1, 4) + " " + sentence()
            return f"<p>{text}</p>" if r.random() < 0.85 else f"<p><b>{words(1, 4)}</b> {text}<br>"
        if x < 0.78:
            return f"<h{(h := r.randint(2, 4))}>{words(2, 7)}</h{h}>"
        if x < 0.86:
            return f"<ul>{''.join(f'<li>{r.choice([sentence(), words(1, 6), link(2, 4) + ' ' + sentence()])}</li>' for _ in range(r.randint(2, 6)))}</ul>"
        if x < 0.9:
            return f"<blockquote><p>{prose(1, 3)}</p></blockquote>"
        if x < 0.93:
            return f"<figure><img src='x'><figcaption>{sentence()}</figcaption></figure>"
        if x < 0.96:
            return f"<table>{''.join(f'<tr><td>{words(1, 3)}</td><td>{words(1, 4)}</td></tr>' for _ in range(3))}</table>"
        return r.choice([f"<pre>{words(3, 9)}</pre>", f"<p>{words(1, 5)}</p>", f"<div>{prose(1, 4)}</div>", f"<section><h3>{words(1, 4)}</h3><p>{prose(1, 4)}</p></section>"])

    def article() -> str:
        head = f"<h1>{words(2, 9)}</h1>"
        inside = [r.choice([head, head, f"<header>{head}</header>", f"<div>{head}</div>"]), *(body_block() for _ in range(r.choice([1, 2, 4, 8, 14])))]
        if r.random() < 0.15:  # verse, lists of names
            inside = [inside[0], *(f"<p>{words(1, 5)}{r.choice(['', '.', '.'])}</p>" for _ in range(r.randint(4, 30)))]
        for extra in (advert, share, sidebar, notice):
            if r.random() < 0.15:
                inside.insert(r.randint(1, len(inside)), extra())
        if r.random() < 0.12:
            inside.append(comments())
        text = "".join(inside)
        return f'<article {GOLD}="1">{text}</article>' if r.random() < 0.55 else mark("content", "article main div div section", 1, text)

    pages = []
    for _ in range(n):
        header = mark("header", "header header div", 0, r.choice([f"<p>{words(1, 3)}</p>", link(), f"<h2>{words(1, 3)}</h2>"]) + r.choice(["", menu()]))
        parts = [header if r.random() < 0.5 else "", menu() if r.random() < 0.8 else ""]
        parts += [f() for f, p in ((notice, 0.3), (advert, 0.5), (form, 0.2)) if r.random() < p]
        middle = [article()]
        middle += [f() for f, p in ((sidebar, 0.4), (advert, 0.2), (comments, 0.3), (form, 0.1)) if r.random() < p]
        if r.random() < 0.2:
            middle.insert(0, sidebar())
        inside = "".join(middle)
        if r.random() < 0.4:
            inside = f'<{(t := r.choice(["main", "div", "div"]))} {GOLD}="1" class="{r.choice(REGIONS["wrapper"].split())}">{inside}</{t}>'
        parts += [inside, mark("footer", "footer footer div", 0, r.choice([f"&copy; {words(1, 4)} &middot; {sentence()}", f"<p>{prose(1, 2)}</p>" + menu(), "".join(link() for _ in range(5))])) if r.random() < 0.85 else ""]
        if r.random() < 0.12:  # a bare page
            parts = [f'<{(t := r.choice(["p", "p", "div", "pre", "h1"]))} {GOLD}="1">{r.choice([prose(1, 4), words(1, 40)])}</{t}>' for _ in range(r.randint(1, 6))]
            if r.random() < 0.5:
                pages.append("".join(parts))
                continue
        text = "".join(parts)
        if r.random() < 0.4:
            text = f'<div {GOLD}="1" id="{r.choice(REGIONS["wrapper"].split())}">{text}</div>'
        pages.append(f'<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body {GOLD}="1">{text}</body></html>')
    return pages


@cache
def default_model() -> TreeModel:
    return TreeModel(labelled_pages())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = default_model()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [model.text(p) if p else "" for p in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, url, text, n_chars (code points).

    A null or empty html, and a page without main text, has the empty text. Blocks are joined by one line
    end, white space inside a block is one space. Repeated rows are read alike; other columns
    are ignored; an empty table gives no rows.
    """
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
