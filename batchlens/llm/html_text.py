"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, with the stack of open elements
(tags, class and id words) above them. Each block gets features of its ancestors and of its text; two labels,
article and other, form a chain whose best path is found by Viterbi. The weights are fitted at the start of a run,
on the driver, to ``TRAINING_PAGES`` labelled pages drawn by a seeded generator of page layouts (menus,
headers, sidebars, notices, adverts, forms, comments, footers; semantic and plain markup): a bounded sample,
about two seconds. Extraction is one pass over the pages, no shuffle.

Article blocks are given with character references decoded and white space runs (line-break tags included)
as one blank, joined by line feeds. Script, style, frames, noscript, titles, text areas and comments never give blocks, nor does
a closed template; text of svg, math, object, canvas, audio and video is text like any other.

Edge cases: null or empty html, or no article block, gives an empty text; broken or cut-off markup is read as far
as it goes; very long pages are read whole (time linear in their length); repeated rows stay; null ids and
urls stay; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_columns, emit

TRAINING_PAGES, SEED = 600, 17

# FIXED VALUES: HTML element classes.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Their content is text without tags up to their end tag, or to the page's end; it isn't shown as text of the page.
RAW = frozenset("script style noscript title textarea iframe noframes xmp".split())
#: Content that is never shown, where the element is closed.
HIDDEN = frozenset(("template",))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends these open elements of its own kind.
CLOSES = {
    **dict.fromkeys("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",),
}
#: ... but not beyond these.
SCOPE = frozenset("ul ol table body html article section div main aside nav footer header form td th dl".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")


class Block:
    """``around``: features of all open elements (tags, class and id words); ``parent``: the innermost tag."""

    __slots__ = ("around", "parent", "text", "linked")

    def __init__(self, around: tuple[str, ...], parent: str, text: str, linked: int):
        self.around, self.parent, self.text, self.linked = around, parent, text, linked


class Stack:
    """Open elements. Counts of their features and tags are kept while they come and go, so a block deep down costs no more
    than one at the top. ``known``: the features that anyone asks for (None: all)."""

    def __init__(self, known: frozenset[str] | None = None):
        self.known, self.items, self.tags, self.counts, self.cached = known, [], {}, {}, ()

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        own = [f for f in (f"in:{tag}", *names) if self.known is None or f in self.known]
        self.items.append((tag, own))
        self.tags[tag] = self.tags.get(tag, 0) + 1
        for f in own:
            if f not in self.counts:
                self.counts[f], self.cached = 0, None
            self.counts[f] += 1

    def cut(self, at: int) -> None:
        """Close all elements from place ``at`` on."""
        while len(self.items) > at:
            tag, own = self.items.pop()
            self.tags[tag] -= 1
            for f in own:
                self.counts[f] -= 1
                if not self.counts[f]:
                    del self.counts[f]
                    self.cached = None

    def around(self) -> tuple[str, ...]:
        if self.cached is None:
            self.cached = tuple(sorted(self.counts))
        return self.cached

    def open(self, tags) -> bool:
        return any(self.tags.get(t) for t in tags)


@lru_cache(maxsize=4096)
def _words(attributes: str) -> tuple[str, ...]:
    found = " ".join("".join(m) for m in NAMES.findall(attributes)).lower()
    return tuple(f"name:{w}" for w in dict.fromkeys(WORDS.findall(found)))


@lru_cache(maxsize=1024)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE)


def blocks(html: str, known: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks with text, in page order."""
    out: list[Block] = []
    stack = Stack(known)
    parts: list[str] = []
    linked, at = 0, 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(stack.around(), stack.items[-1][0] if stack.items else "", text, linked))
        parts, linked = [], 0

    while True:
        m = TAG.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece:
            parts.append(piece)
            if stack.tags.get("a"):
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCKS:
                close()
            if stack.tags.get(name):
                k = len(stack.items) - 1
                while stack.items[k][0] != name:
                    k -= 1
                stack.cut(k)
            continue
        if name in RAW or name in HIDDEN:
            if not m[0].endswith("/>"):
                end = _raw_end(name).search(html, at)
                if end:
                    at = end.end()
                    continue
                if name in RAW:
                    at = len(html)
                    continue
            else:
                continue
        if name in BLOCKS:
            close()
            ends, k = CLOSES.get(name, ()), len(stack.items) - 1
            while k >= 0 and stack.open(ends) and (stack.items[k][0] in ends or stack.items[k][0] not in SCOPE):
                if stack.items[k][0] in ends:
                    stack.cut(k)
                k -= 1
        elif name == "br":
            parts.append(" ")
        if name not in VOID and not m[0].endswith("/>"):
            stack.push(name, _words(m[3]))
    close()
    return out


END = re.compile(r"[.!?:;…][\"'»”)\]]*$")


def features(page: list[Block]) -> list[list[str]]:
    out, n = [], len(page)
    for k, b in enumerate(page):
        text = b.text
        words, size = text.count(" ") + 1, len(text)
        f = [*b.around, f"parent:{b.parent}", f"words:{min(words.bit_length(), 8)}"]
        share = b.linked / size
        f.append("links:" + ("none" if not b.linked else "some" if share < 0.5 else "most"))
        f.append("end:" + ("stop" if END.search(text) else "open"))
        if words >= 8 and not b.linked:
            f.append("prose")
        if "©" in text or "(c)" in text.lower():
            f.append("copyright")
        if k == n - 1:
            f.append("last")
        if k == 0:
            f.append("first")
        out.append(f)
    return out


class Chain:
    """Two-label linear-chain model: a weight per feature (for label 1 against 0), transitions, start."""

    def __init__(self, weights: dict[str, float], bias: float, moves: np.ndarray, start: float):
        self.weights, self.bias, self.start = weights, bias, start
        self.known = frozenset(weights)
        self.moves = moves.tolist()

    def decode(self, page: list[list[str]]) -> list[int]:
        """Best path of labels (Viterbi; label 0 scores nothing by itself)."""
        get = self.weights.get
        (m00, m01), (m10, m11) = self.moves
        zero, one, back = 0.0, 0.0, []
        for k, f in enumerate(page):
            e = self.bias
            for x in f:
                e += get(x, 0.0)
            if k == 0:
                zero, one = 0.0, self.start + e
                continue
            a, b, c, d = zero + m00, one + m10, zero + m01, one + m11
            back.append((a < b, c < d))
            zero, one = (b if a < b else a), (d if c < d else c) + e
        if not page:
            return []
        label = int(one > zero)
        path = [label]
        for stay in reversed(back):
            label = int(stay[label])
            path.append(label)
        return path[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], l2: float = 0.02, rounds: int = 150) -> Chain:
    """Maximum likelihood by batch gradient ascent with momentum-free adaptive steps; forward-backward runs
    over all pages at once, padded to the longest."""
    names: dict[str, int] = {}
    for feats, _ in pages:
        for f in feats:
            for x in f:
                names.setdefault(x, len(names))
    n, longest = len(pages), max(len(f) for f, _ in pages)
    row, col = [], []
    gold, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for p, (feats, labels) in enumerate(pages):
        gold[p, : len(labels)], mask[p, : len(labels)] = labels, True
        for k, f in enumerate(feats):
            row += [p * longest + k] * len(f)
            col += [names[x] for x in f]
    row, col = np.array(row), np.array(col)
    w, bias, moves, start = np.zeros(len(names)), 0.0, np.zeros((2, 2)), 0.0
    flat_gold, flat_mask = gold.ravel(), mask.ravel()
    pair_mask = mask[:, 1:]
    gold_moves = np.array([[((gold[:, :-1] == i) & (gold[:, 1:] == j) & pair_mask).sum() for j in (0, 1)] for i in (0, 1)], float)
    squares = [np.full(len(names), 1e-8), 1e-8, np.full((2, 2), 1e-8), 1e-8]
    for _ in range(rounds):
        score = (np.bincount(row, w[col], n * longest) + bias).reshape(n, longest)
        emit_ = np.stack([np.zeros_like(score), score], 2)
        emit_[:, 0, 1] += start
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = emit_[:, 0]
        for k in range(1, longest):
            step = np.logaddexp(forward[:, k - 1, 0, None] + moves[0], forward[:, k - 1, 1, None] + moves[1]) + emit_[:, k]
            forward[:, k] = np.where(mask[:, k, None], step, forward[:, k - 1])
        for k in range(longest - 2, -1, -1):
            after = backward[:, k + 1] + emit_[:, k + 1]
            step = np.stack([np.logaddexp(after[:, 0] + moves[i, 0], after[:, 1] + moves[i, 1]) for i in (0, 1)], 1)
            backward[:, k] = np.where(mask[:, k + 1, None], step, 0.0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        one = np.exp(np.minimum(forward[:, :, 1] + backward[:, :, 1] - total[:, None], 0.0))
        diff = np.where(flat_mask, flat_gold - one.ravel(), 0.0)
        expect = np.zeros((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                p = np.exp(np.minimum(forward[:, :-1, i] + moves[i, j] + emit_[:, 1:, j] + backward[:, 1:, j] - total[:, None], 0.0))
                expect[i, j] = p[pair_mask].sum()
        grads = [np.bincount(col, diff[row], len(names)) - l2 * w, diff.sum(), gold_moves - expect - l2 * moves, (gold[:, 0] - one[:, 0]).sum()]
        steps = []
        for k, g in enumerate(grads):
            squares[k] = squares[k] + g * g
            steps.append(0.3 * g / np.sqrt(squares[k]))
        w, bias, moves, start = w + steps[0], bias + steps[1], moves + steps[2], start + steps[3]
    return Chain({x: float(w[k]) for x, k in names.items()}, float(bias), moves, float(start))


class Layouts:
    """Seeded generator of labelled pages: pairs of html and the article's blocks."""

    SYLLABLES = "an be co da el fi go ha in jo ka lu me no or pa qui ra so ti un ver wa xe yo ze tion ment ed ing".split()

    def __init__(self, seed: int):
        self.rnd = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rnd.choices(self.SYLLABLES, k=self.rnd.choice((1, 1, 2, 2, 3, 4))))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rnd.randint(low, high)))

    def sentence(self, low: int = 1, high: int = 25) -> str:
        return self.phrase(low, high).capitalize() + self.rnd.choice((".", ".", ".", ".", "!", "?", ".&amp;&amp;", ".%%%", ""))

    def prose(self) -> str:
        text = " ".join(self.sentence() for _ in range(self.rnd.choice((1, 1, 1, 2, 3, 5, 8))))
        if self.rnd.random() < 0.15:
            text = text.replace(" ", f' <a href="/{self.word()}">{self.word()}</a> ', 1)
        if self.rnd.random() < 0.1:
            text = text.upper()
        return text

    def named(self, *names: str) -> str:
        key = self.rnd.choice(("class", "class", "id"))
        extra = self.rnd.choice(("", "", " wrap", " box", " block"))
        return f' {key}="{self.rnd.choice(names)}{extra}"'

    def menu(self) -> str:
        items = "".join(f'<li><a href="/{self.word()}">{self.phrase(1, 3)}</a></li>' for _ in range(self.rnd.randint(2, 8)))
        return self.rnd.choice((
            f"<nav><ul>{items}</ul></nav>", f"<nav{self.named('menu', 'main-nav')}><ul>{items}</ul></nav>", f"<div{self.named('menu', 'nav', 'navbar', 'navigation', 'breadcrumb')}><ul>{items}</ul></div>",
            f"<ul{self.named('menu', 'nav', 'links')}>{items}</ul>",
        ))

    def header(self) -> str:
        inner = f"<h2>{self.phrase(1, 4)}</h2>" + (f"<p>{self.sentence(2, 8)}</p>" if self.rnd.random() < 0.5 else "")
        return self.rnd.choice((f"<header>{inner}</header>", f"<div{self.named('header', 'masthead', 'site-header', 'banner', 'topbar')}>{inner}</div>"))

    def footer(self) -> str:
        inner = self.rnd.choice(("&copy; ", "Copyright ", "© 2020 ", "")) + self.phrase(1, 4) + self.rnd.choice((" &middot; ", " | ", " ")) + self.sentence(3, 25)
        inner = self.rnd.choice((inner, f"<p>{inner}</p>"))
        return self.rnd.choice((f"<footer>{inner}</footer>", f"<div{self.named('footer', 'site-footer', 'colophon', 'bottom')}>{inner}</div>"))

    def boxed(self, tags: tuple, names: tuple) -> str:
        tag = self.rnd.choice(tags)
        inner = self.rnd.choice((self.sentence(3, 25), f"<p>{self.prose()}</p>", f"<h3>{self.phrase(1, 4)}</h3><p>{self.sentence(3, 20)}</p>"))
        return f"<{tag}{'' if tag == 'aside' and self.rnd.random() < 0.5 else self.named(*names)}>{inner}</{tag}>"

    def aside(self) -> str:
        return self.boxed(("aside", "div", "section"), ("sidebar", "side", "related", "widget", "aside", "recommended", "teaser", "share", "social", "newsletter", "promo"))

    def advert(self) -> str:
        return self.boxed(("div", "div", "section", "aside"), ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "banner-ad", "adbox"))

    def notice(self) -> str:
        return self.boxed(("div", "section"), ("cookie", "cookie-notice", "notice", "consent", "popup", "modal", "alert", "gdpr", "banner"))

    def form(self) -> str:
        fields = "".join(f"<label>{self.phrase(1, 3)}</label><input name=q>" for _ in range(self.rnd.randint(1, 3)))
        return f"<form{self.rnd.choice(('', ' class=\"search\"', ' id=\"subscribe\"'))}><p>{self.sentence(2, 9)}</p>{fields}<button>{self.phrase(1, 2)}</button></form>"

    def comments(self) -> str:
        inner = "".join(self.rnd.choice((f"<p>{self.prose()}</p>", f'<div class="comment"><b>{self.word()}</b><p>{self.prose()}</p></div>', f"<li>{self.prose()}</li>")) for _ in range(self.rnd.randint(1, 5)))
        return self.rnd.choice((f"<section{self.named('comments', 'comment-list', 'responses', 'discussion', 'replies')}><h3>{self.phrase(1, 2)}</h3>{inner}</section>", f"<div{self.named('comments', 'comment-list', 'disqus', 'replies', 'reader-comments')}>{inner}</div>"))

    def page(self) -> tuple[str, int, int]:
        """html, and the marks between which the article lies (numbers of marker attributes)."""
        body = []
        for _ in range(self.rnd.choice((1, 1, 2, 3, 4, 6, 10))):
            body.append(self.rnd.choice((
                f"<p>{self.prose()}</p>", f"<p>{self.prose()}</p>", f"<p>{self.prose()}</p>", f"<p>{self.prose()}", f"<p><b>{self.sentence(1, 12)}<br>", f"<h2>{self.phrase(1, 6)}</h2><p>{self.prose()}</p>",
                f"<blockquote><p>{self.prose()}</p></blockquote>", f"<ul><li>{self.sentence()}</li><li>{self.sentence()}</li></ul>", f"<div>{self.prose()}</div>", f"<pre>{self.prose()}</pre>", f"<table><tr><td>{self.phrase(1, 5)}</td><td>{self.sentence(1, 6)}</td></tr></table>",
            )))
            if self.rnd.random() < 0.06:
                body.append("\x01" + self.rnd.choice((self.advert, self.aside))() + "\x02")
        head = f"<h1>{self.phrase(1, 12).capitalize()}{self.rnd.choice(('', '.'))}</h1>" if self.rnd.random() < 0.8 else ""
        inner = head + "".join(body)
        tag, end = self.rnd.choice((
            ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div{self.named('content', 'main', 'article', 'post', 'entry', 'story', 'article-body', 'post-content', 'text')}>", "</div>"),
            (f"<section{self.named('content', 'main', 'article', 'story')}>", "</section>"), (f'<div id="page"><article{self.named("post", "entry", "hentry")}>', "</article></div>"),
        ))
        before = [f() for f in (self.menu, self.header, self.notice, self.advert, self.form, self.aside) if self.rnd.random() < 0.4]
        after = [f() for f in (self.comments, self.aside, self.advert, self.form, self.footer, self.footer, self.menu) if self.rnd.random() < 0.4]
        self.rnd.shuffle(before)
        tail = "" if self.rnd.random() < 0.1 else "</body></html>"
        top = f'<!DOCTYPE html><html><head><title>{self.phrase(2, 9)}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
        return top + "".join(before) + "<!-- a -->" + tag + "\x02" + inner + "\x01" + end + "".join(after) + tail, 0, 0

    def labelled(self) -> tuple[list[Block], list[int]]:
        """Blocks with labels: text after a start mark is article until the next end mark."""
        found, labels, inside = [], [], 0
        for b in blocks(self.page()[0].replace("\x02", "<hr>\x02<hr>").replace("\x01", "<hr>\x01<hr>")):
            if b.text in ("\x01", "\x02"):
                inside = int(b.text == "\x02")
            else:
                found.append(b)
                labels.append(inside)
        return found, labels


@lru_cache(maxsize=4)
def model(pages: int = TRAINING_PAGES, seed: int = SEED) -> Chain:
    layouts = Layouts(seed)
    drawn = [layouts.labelled() for _ in range(pages)]
    return train([(features(b), y) for b, y in drawn if b])


def extract_text(html: str | None, chain: Chain) -> str:
    page = blocks(html or "", chain.known)
    return "\n".join(b.text for b, label in zip(page, chain.decode(features(page)), strict=True) if label)


def extract(pages: DataFrame, chain: Chain | None = None, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    chain = chain or model()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            keys, urls, html = batch_columns(batch, "page_id", "url", "html")
            for at in range(0, len(keys), 500):
                part = slice(at, at + 500)
                yield emit(schema, [keys[part], urls[part], [extract_text(h, chain) for h in html[part]]])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
