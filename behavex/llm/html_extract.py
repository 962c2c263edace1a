"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks in page order: runs of text without a block element's border
inside, each with the elements it stands in. A block's features are its ancestors' tags and the
words of their class and id, and what its text is like; the field's two labels, content or not,
also depend on the label before. It is trained by maximum likelihood on labelled pages made by
`labelled_pages` (templates of many kinds, labels known by construction), and pages are decoded
by Viterbi.
"""

from __future__ import annotations

import html as html_
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behavex.llm.common import table

#: Elements whose border ends a block of text.
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements that have no content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
HIDDEN = frozenset("script style noscript template textarea svg iframe object canvas".split())
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME, _TAG, _BORDER = re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), re.compile(r"(/?)([a-zA-Z][^\s/>]*)"), re.compile(r"[>\"']")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Parts of the names that sites give to what is and what is not the article, however they are put together. Fixed values.
STEMS = tuple("ad advert article aside auth author banner bottom brand bread byline comment consent content cookie copy credit discuss entry feed foot form head hentry legal link logo main mast menu meta modal nav news note notice overlay page pager popular popup post promo reader related reply respon search share side signup social sponsor story subscri tag text toc tool top trend widget".split())
#: Words that such parts begin with or hold, in English. Fixed values.
CUES = frozenset("advertisement comment comments cookies copyright follow home login menu newsletter next previous privacy related reply responses search share sidebar sign sponsored subscribe tags trending".split())
#: Elements that end where the next of their kind begins, and those that they may hold open meanwhile.
_ENDED = frozenset("p li dt dd tr td th option".split())
_INNER = frozenset("p td th dt dd".split())
#: Tags that say little and only make the model larger.
_PLAIN = frozenset("html body b i em strong span font u small a".split())


class _Tags:
    """The next tag or text of a page, in time linear in the page whatever is broken in it."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.border: int | None = -1  # of the next ">"; None: there is none
        self.strict = True  # until a quote has been left open
        self.ends: dict[str, re.Pattern] = {}

    def _close(self, at: int) -> int | None:
        if self.border is not None and self.border < at:
            found = self.page.find(">", at)
            self.border = None if found < 0 else found
        return self.border

    def _end(self, at: int) -> int | None:
        """The place of the > that ends a tag: the first outside quotes, or if a quote is left open the first."""
        at_first, page = at, self.page
        while self.strict:
            m = _BORDER.search(page, at)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            close = page.find(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        if self._close(at_first) is not None:
            self.strict = False
        return self._close(at_first)

    def skip(self, tag: str) -> None:
        """Goes on behind the end of an element whose content is no text."""
        end = self.ends.setdefault(tag, re.compile(rf"</{re.escape(tag)}\s*>", re.I)).search(self.page, self.at)
        self.at = end.end() if end else len(self.page)

    def __iter__(self) -> Iterator[tuple[str | None, bool, str]]:
        """(tag, closing, attributes), or (None, False, text)."""
        page, n = self.page, len(self.page)
        while self.at < n:
            at = self.at
            if page[at] != "<":
                end = page.find("<", at)
                self.at = n if end < 0 else end
                yield None, False, page[at : self.at]
            elif page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                self.at = n if end < 0 else end + 3
            elif page[at + 1 : at + 2] in ("!", "?") and self._close(at) is not None:
                self.at = self._close(at) + 1
            elif (m := _TAG.match(page, at + 1)) and self._close(at) is not None and (end := self._end(m.end())) is not None:
                self.at = end + 1
                yield m[2].lower(), bool(m[1]), page[m.end() : end]
            else:
                self.at = at + 1
                yield None, False, "<"


def _names(tag: str, attributes: str) -> set[str]:
    """Features of an element: its tag, the parts of its class and id, and the stems in them."""
    out = set() if tag in _PLAIN else {"t:" + tag}
    if "=" in attributes:
        for a in _ATTRIBUTE.finditer(attributes):
            for name in (a[2] or a[3] or a[4] or "").split():
                parts = [x.lower() for x in _NAME.findall(name)]
                out.update("n:" + x for x in parts)
                whole = "".join(parts)
                out.update("s:" + x for x in STEMS if (x in whole if len(x) > 3 else x in parts))
        if _HIDDEN_STYLE.search(attributes):
            out.add("n:hidden")
    if re.search(r"\bhidden\b", attributes) and "=" not in attributes:
        out.add("n:hidden")
    return out


def blocks(page: str | None, known: frozenset[str] | None = None) -> list[tuple[list[str], str]]:
    """(features, text) of each non-empty leaf block. Character references are decoded
    and white space becomes one space. A closing tag without its opening one is ignored; p, li, td and the
    like end where the next begins; what is left open ends with the page. Of ancestors' features only known ones are given, if known is."""
    out: list[tuple[list[str], str, str, float]] = []
    stack: list[tuple[str, set[str]]] = []
    outer: list[int] = []  # places in the stack of block elements
    spans: list[list[int]] = []  # first and last block of each block element, as they are opened
    open_spans: list[int] = []
    count: dict[str, int] = {}  # how often a tag is open
    active: dict[str, int] = {}  # features of what is open
    names: list[str] | None = []  # sorted, None: to be sorted anew
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        nonlocal names
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                if names is None:
                    names = sorted(active)
                total = sum(len(t) for t, _ in parts)
                out.append((names, stack[outer[-1]][0] if outer else "none", text, sum(len(t) for t, a in parts if a) / max(1, total)))
            parts.clear()

    def close(size: int) -> None:
        nonlocal names
        while len(stack) > size:
            tag, own = stack.pop()
            count[tag] -= 1
            if outer and outer[-1] == len(stack):
                outer.pop()
                spans[open_spans.pop()][1] = len(out)
            for f in own:
                active[f] -= 1
                if not active[f]:
                    del active[f]
                    names = None

    tags = _Tags(page or "")
    for tag, closing, rest in tags:
        if tag is None:
            parts.append((html_.unescape(rest) if "&" in rest else rest, count.get("a", 0) > 0))
            continue
        if tag in HIDDEN:
            if not closing and not rest.endswith("/"):
                tags.skip(tag)
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if closing:
            if count.get(tag):
                while stack[-1][0] != tag:
                    close(len(stack) - 1)
                close(len(stack) - 1)
            continue
        if tag in _ENDED and count.get(tag):
            for i in reversed(outer):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] not in _INNER:
                    break
        elif tag in BLOCK and outer and stack[outer[-1]][0] == "p":  # a block element ends a paragraph
            close(outer[-1])
        if not rest.endswith("/"):
            own = _names(tag, rest)
            own = own if known is None else own & known
            if tag in BLOCK:
                outer.append(len(stack))
                open_spans.append(len(spans))
                spans.append([len(out), 0, tag not in _LEAVES])
            stack.append((tag, own))
            count[tag] = count.get(tag, 0) + 1
            for f in own:
                if f not in active:
                    names = None
                active[f] = active.get(f, 0) + 1
    flush()
    close(0)
    return list(zip(_features(out, spans), (b[2] for b in out), strict=True))


#: Characters of scripts that put no spaces between words; two count as a word.
_UNSPACED = re.compile(r"[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\u0e00-\u0e7f]")


def _shape(text: str, linked: float) -> tuple[str, str, list[str], int]:
    words = text.split()
    n = len(words) + (0 if text.isascii() else len(_UNSPACED.findall(text)) // 2)
    more = ["stop"] if text[-1] in ".!?…:;\"'”»。！？" else []
    if "©" in text or "(c)" in text.lower():
        more.append("copyright")
    more += sorted({"w:" + w for w in (x.strip(".,:!?()").lower() for x in words[:6]) if w in CUES})
    prose = 0 if linked > 0.6 or n < 5 else len(text)
    return f"len:{min(6, n.bit_length())}", "links:" + ("most" if linked > 0.6 else "some" if linked > 0.1 else "none"), more, prose


#: Elements that hold text rather than parts of a page.
_LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "dt", "dd"}


def _features(found: list[tuple[list[str], str, str, float]], spans: list[list[int]]) -> list[list[str]]:
    """What an element is like, what the text is like, what the blocks before and after are like, and whether the block
    lies in the smallest element that has most of the page's prose."""
    shapes = [_shape(text, linked) for *_, text, linked in found]
    total = [0]
    for *_, prose in shapes:
        total.append(total[-1] + prose)
    core = min(((b - a, a, b) for a, b, holds in spans if holds and b > a and total[b] - total[a] >= 0.6 * total[-1]), default=(0, 0, len(found)))[1:]
    out = []
    for i, ((names, leaf, _, _), (length, links, more, _)) in enumerate(zip(found, shapes, strict=True)):
        where = "core" if core[0] <= i < core[1] else "rim"
        fs = ["bias", *names, "leaf:" + leaf, length, links, f"{length}{links}", *more, where, f"{where}{length}{links}"]
        for side, j in (("before", i - 1), ("after", i + 1)):
            fs += [f"{side}:{x}" for x in shapes[j][:2]] if 0 <= j < len(found) else [f"{side}:none"]
        out.append(fs)
    return out


class Chain:
    """Weights of features for content against not, and of label pairs."""

    def __init__(self):
        self.w: dict[str, float] = {}
        self.pair = [[0.0, 0.0], [0.0, 0.0]]

    @property
    def known(self) -> frozenset[str]:
        return frozenset(self.w)

    def _scores(self, page: list[list[str]]) -> list[float]:
        get = self.w.get
        return [sum(get(f, 0.0) for f in fs) for fs in page]

    def decode(self, page: list[list[str]]) -> list[int]:
        """Viterbi; of equal paths the one with more content is kept."""
        if not page:
            return []
        s, t = self._scores(page), self.pair
        best, back = (0.0, s[0]), []
        for x in s[1:]:
            a = [(best[0] + t[0][j], best[1] + t[1][j]) for j in (0, 1)]
            back.append([int(p[1] >= p[0]) for p in a])
            best = (max(a[0]), max(a[1]) + x)
        label = int(best[1] >= best[0])
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 8, rate: float = 0.3, l2: float = 1e-3, seed: int = 1) -> Chain:
        """Stochastic gradient ascent of the log-likelihood, by AdaGrad; gradients come from forward-backward."""
        rng, square, square_pair = random.Random(seed), {}, [[1e-6, 1e-6], [1e-6, 1e-6]]
        order = list(range(len(pages)))
        for _ in range(epochs):
            rng.shuffle(order)
            for i in order:
                fs, ys = pages[i]
                if not fs:
                    continue
                s, t, n = self._scores(fs), self.pair, len(fs)
                f = [[0.0, s[0]]]
                for x in s[1:]:
                    p = f[-1]
                    f.append([_lse(p[0] + t[0][0], p[1] + t[1][0]), _lse(p[0] + t[0][1], p[1] + t[1][1]) + x])
                b = [[0.0, 0.0] for _ in range(n)]
                for k in range(n - 2, -1, -1):
                    nb, x = b[k + 1], s[k + 1]
                    b[k] = [_lse(t[j][0] + nb[0], t[j][1] + x + nb[1]) for j in (0, 1)]
                z = _lse(*f[-1])
                for k in range(n):
                    e = ys[k] - math.exp(f[k][1] + b[k][1] - z)
                    if abs(e) > 1e-4:
                        for name in fs[k]:
                            w = self.w.get(name, 0.0)
                            g = e - l2 * w
                            square[name] = square.get(name, 1e-6) + g * g
                            self.w[name] = w + rate * g / math.sqrt(square[name])
                grad = [[0.0, 0.0], [0.0, 0.0]]
                for k in range(n - 1):
                    grad[ys[k]][ys[k + 1]] += 1
                    for a in (0, 1):
                        for c in (0, 1):
                            grad[a][c] -= math.exp(f[k][a] + t[a][c] + (s[k + 1] if c else 0.0) + b[k + 1][c] - z)
                for a in (0, 1):
                    for c in (0, 1):
                        square_pair[a][c] += grad[a][c] ** 2
                        t[a][c] += rate * grad[a][c] / math.sqrt(square_pair[a][c])
        return self


def _lse(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log(math.exp(a - m) + math.exp(b - m))


#: Names that sites give to what is not the article, by kind.
_ASIDES = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "links", "toc", "pager", "pagination", "main-menu", "page-nav"],
    "header": ["header", "masthead", "banner", "top", "branding", "logo", "site-header", "pageHeader"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "popular", "trending", "share", "social", "tags", "author-box", "newsletter", "subscribe", "promo", "side-bar", "widget-area", "relatedPosts"],
    "footer": ["footer", "bottom", "legal", "copyright", "site-footer", "colophon", "page-footer"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "banner-ad", "promo", "ad-slot"],
    "notice": ["cookie", "cookies", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "cookie-bar"],
    "form": ["form", "search", "login", "signup", "contact-form", "respond", "search-box"],
    "comments": ["comments", "comment", "discussion", "replies", "respond", "disqus", "reply", "comment-list", "commentList", "user-comments", "reader-comments", "feedback", "notes", "responses"],
}
#: Names that sites give to the article or what holds it.
_MAIN = ["content", "post", "entry", "article", "main", "story", "post-content", "entry-content", "article-body", "text", "page", "body", "hentry", "main-content", "postBody", "single-post", "post-body", "story-body"]
#: Names of an article's own paragraphs where they are no p elements.
_PARAGRAPHS = ["paragraph", "para", "text", "line", "block", "row", "p1"]
#: How such parts begin now and then.
_OPENERS = {"nav": ["Menu", "Home"], "aside": ["Related", "Tags", "Share", "Trending"], "footer": ["Copyright", "Privacy"], "ad": ["Advertisement", "Sponsored"], "notice": ["Cookies"], "form": ["Search", "Login", "Subscribe"], "comments": ["Comments", "Responses", "Reply"]}

Part = tuple[str, bool | None]


class _Maker:
    """Pages of four kinds of layout: by semantic elements, by named div elements, as weblogs, and by tables without names."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, a: int, b: int) -> str:
        pick = self.rng
        return " ".join("".join(pick.choice("abcdeéghiklmnoüprstuvz") for _ in range(pick.randint(1, 9))) for _ in range(pick.randint(a, b))).capitalize()

    def prose(self, a: int, b: int) -> str:
        return " ".join(self.words(3, 14) + self.rng.choice([".", ".", ".", "!", "?", ""]) for _ in range(self.rng.randint(a, b)))

    def named(self, kind: str) -> str:
        name = self.rng.choice(_ASIDES.get(kind, _MAIN))
        return self.rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {self.rng.choice("abc")}"'])

    def opener(self, kind: str) -> str:
        return self.rng.choice(_OPENERS[kind]) if kind in _OPENERS and self.rng.random() < 0.4 else self.words(1, 3)

    def wrapped(self, tag: str, attributes: str, parts: list[Part]) -> list[Part]:
        return [(f"<{tag}{attributes}>", None), *parts, (f"</{tag}>", None)]

    def links(self, bare: bool = False) -> list[Part]:
        pick, items = self.rng, [self.words(1, 3) for _ in range(self.rng.randint(2, 9))]
        x = pick.random()
        if x < 0.6 and not bare:
            return self.wrapped("ul", "", [(f'<li><a href="/{i}">{t}</a></li>', False) for i, t in enumerate(items)])
        if x < 0.8:
            return [(f'<a href="/{i}">{t}</a><br>', False) for i, t in enumerate(items)]
        return [(pick.choice([" ", " | ", " &gt; "]).join(f'<a href="/{i}">{t}</a>' for i, t in enumerate(items)), False)]

    def comments(self, attributes: str, tag: str) -> list[Part]:
        pick, list_ = self.rng, self.rng.random() < 0.4
        inner: list[Part] = [(f"<h3>{self.opener('comments')}</h3>", False)] if pick.random() < 0.6 else []
        said = []
        for _ in range(pick.randint(1, 6)):
            x = pick.random()
            body = [(f"<p>{self.prose(1, 5)}</p>", False)] if x < 0.5 else [(f"<div>{self.prose(1, 5)}</div>", False)]
            if pick.random() < 0.4:
                body = [(f"<div>{self.words(1, 2)}</div>", False), *body]
            said += [*(self.wrapped("li", "", body) if list_ else body)]
        return self.wrapped(tag, attributes, inner + (self.wrapped("ol", "", said) if list_ else said))

    def aside(self, kind: str, named: bool | None = None) -> list[Part]:
        """A part that is no article. named: by a div's name; else by an element of its own where there is one."""
        pick = self.rng
        own_tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        by_name = named if named is not None else own_tag is None or pick.random() < 0.3
        tag = own_tag if own_tag and not by_name else pick.choice(["div", "div", "section"])
        attributes = self.named(kind) if by_name or pick.random() < 0.4 else ""
        if kind == "comments":
            return self.comments(attributes, tag)
        if kind == "nav":
            return self.wrapped(tag, attributes, self.links())
        if kind == "form":
            return self.wrapped("form", attributes if not by_name or pick.random() < 0.5 else "", [(f'<label>{self.opener(kind)}</label><input name="q"><button>', False), (f"{self.words(1, 2)}</button>", False)])
        if kind == "aside" and pick.random() < 0.5:
            return self.wrapped(tag, attributes, [(f"<h3>{self.opener(kind)}</h3>", False), *self.links()])
        text = (lambda: pick.choice(["&copy; ", "© ", "Copyright ", ""]) + f"{self.words(1, 3)} &middot; {self.prose(1, 2)}") if kind == "footer" else (lambda: self.prose(1, 2))
        if pick.random() < 0.4:
            return [(f"<{tag}{attributes}>{text()}", False), (f"</{tag}>", None)]
        parts: list[Part] = [(f"<h4>{self.opener(kind)}</h4>", False)] if pick.random() < 0.2 else []
        for _ in range(pick.choice([1, 1, 2])):
            parts.append((f"<p>{text()}</p>" if pick.random() < 0.4 else f"<div>{text()}</div>", False))
        return self.wrapped(tag, attributes, parts)

    def paragraph(self, style: str, text: str) -> list[Part]:
        """A paragraph as sites write it: in an element of its own, in one with another inside, or as bare text up to a line break."""
        if style == "br":
            return [(text + self.rng.choice(["<br>", "<br><br>", "<br />", "<br/><br/>\n"]), True)]
        before, after = {"p": ("<p>", "</p>"), "div": ("<div>", "</div>"), "span": ("<div><span>", "</span></div>"), "pspan": ("<p><span>", "</span></p>")}[style]
        if style != "p" and self.rng.random() < 0.3:
            before = before.replace("div", f'div class="{self.rng.choice(_PARAGRAPHS)}"', 1)
        return [(before + text + after, True)]

    def body(self, inside: bool) -> list[Part]:
        """What an article holds, with other parts in between if inside; its paragraphs are all written in one way."""
        pick = self.rng
        style = pick.choices(["p", "div", "br", "span", "pspan"], [5, 2, 2, 1, 0.5])[0]
        if pick.random() < 0.06:  # one text is all there is
            return [(self.prose(2, 8), True)] if style == "br" else self.paragraph(style, self.prose(2, 8))
        parts: list[Part] = [(f"<h{n}>{self.words(2, 10)}</h{n}>", True) for n in pick.choice(["1", "1", "1", "2", ""])]
        for _ in range(pick.choice([0, 1, 2, 4, 7, 12] if style == "p" else [1, 2, 3, 5, 8])):
            x = pick.random() if style == "p" else max(0.02, pick.random() * 1.4 - 0.1)
            if x < 0.12:
                n = pick.choice("234")
                parts.append((f"<h{n}>{self.words(1, 7)}</h{n}>", True))
            elif x < 0.2:
                parts += self.wrapped("ul", "", [(f"<li>{self.prose(1, 1)}</li>", True) for _ in range(pick.randint(1, 5))])
            elif x < 0.26:
                parts.append((f"<blockquote>{self.prose(1, 3)}</blockquote>", True))
            elif x < 0.32:
                parts += [(f"<p><b>{self.prose(1, 2)}<br>", True), (f"{self.prose(1, 2)}</p>", True)]
            elif x < 0.36:
                parts += [("<table><tr>", None), *((f"<td>{self.words(1, 3)}</td>", True) for _ in range(4)), ("</tr></table>", None)]
            elif x < 0.4:
                parts.append((f"<pre>{self.words(3, 12)}</pre>", True))
            elif x < 0.48:
                before, after = self.words(1, 4), pick.choice(["", ".", f" {self.words(1, 5)}."])
                parts.append((f'<p>{before if pick.random() < 0.5 else ""} <a href="/x">{self.words(4, 16)}</a>{after}</p>', True))
            elif x < 0.54 and inside:
                parts += self.aside(pick.choice(["ad", "aside", "aside", "notice"]))
            else:
                parts += self.paragraph(style, self.prose(1, 8) if pick.random() < 0.85 else self.words(1, 2) + ".")
        if style == "br" and pick.random() < 0.6:  # the last one ends with what holds it
            parts.append((self.prose(1, 4), True))
        elif pick.random() < 0.25:
            parts.append((f"<p>{self.prose(1, 4)}<br>", True))
        return parts + (self.aside("comments") if inside and pick.random() < 0.25 else [])

    def semantic(self) -> list[Part]:
        tag = self.rng.choice(["article", "article", "article", "main", "div", "section"])
        own = f' class="{self.rng.choice(_MAIN)}"' if tag in ("div", "section") or self.rng.random() < 0.3 else ""
        inner = self.body(True)
        if self.rng.random() < 0.3:  # an element more in between
            inner = self.wrapped("div", self.rng.choice(["", f' class="{self.rng.choice(_MAIN)}"']), inner)
        return self.around(self.wrapped(tag, own, inner), None)

    def lone(self) -> list[Part]:
        """An article with nothing around it, often of one block."""
        rng = self.rng
        tag = rng.choice(["article", "main", "div", "div", "section", ""])
        inner: list[Part] = [(self.prose(1, 8), True)] if rng.random() < 0.5 else self.body(False)
        if rng.random() < 0.3:
            inner = self.wrapped("div", "", inner)
        own = f' class="{rng.choice(_MAIN)}"' if tag and rng.random() < 0.6 else ""
        return self.wrapped(tag, own, inner) if tag else inner

    def around(self, article: list[Part], named: bool | None) -> list[Part]:
        rng, out = self.rng, []
        for kind in ("notice", "header", "nav", "ad"):
            if rng.random() < {"nav": 0.8, "header": 0.5}.get(kind, 0.35):
                out += self.aside(kind, named)
        for kind, p in (("form", 0.15), ("aside", 0.2), ("ad", 0.2)):
            out += self.aside(kind, named) if rng.random() < p else []
        out += article
        for kind in ("aside", "comments", "form", "ad", "nav", "footer"):
            out += self.aside(kind, named) if rng.random() < (0.8 if kind == "footer" else 0.25) else []
        return out

    def divs(self) -> list[Part]:
        inner = self.wrapped("div", f' class="{self.rng.choice(_MAIN)}"', self.body(True))
        return self.wrapped("div", self.rng.choice(["", ' id="wrapper"', ' class="container"']), self.around(inner, True))

    def weblog(self) -> list[Part]:
        rng = self.rng
        post = self.wrapped("div", rng.choice([' class="post hentry"', ' class="hentry"', ' class="blog-post"', ' id="post-1" class="post"']), [(f"<{(h := rng.choice(['h2', 'h2', 'h3']))} class=\"{rng.choice(['entry-title', 'post-title', 'title'])}\">{self.words(2, 8)}</{h}>", True), *self.wrapped("div", rng.choice(["", ' class="entry"', ' class="entry-content"', ' class="post-body"', ' class="post-body entry-content"']), self.body(False))])
        said = self.comments(rng.choice([' class="commentlist"', ' id="comments"', ' class="comment-list"', ' class="comments-area"']), rng.choice(["ol", "div"])) if rng.random() < 0.7 else []
        holds = self.wrapped("div", rng.choice([' id="content"', ' id="primary"', ' id="main"', ""]), post + said)
        return [*self.aside("header", True), *self.aside("nav", True), *holds, *self.aside("aside", True), *(self.aside("form", True) if rng.random() < 0.5 else []), *self.aside("footer", True)]

    def tables(self) -> list[Part]:
        rng = self.rng
        text: list[Part] = [(f"<{t}>{self.words(2, 8)}</{t}><br>", True) for t in rng.choice([["h1"], ["h2"], ["b"], ["center"], []])]
        for _ in range(rng.randint(1, 7)):
            text += self.paragraph(rng.choice(["p", "p", "br", "br", "div"]), self.prose(1, 7))
        cell = lambda parts: self.wrapped("td", rng.choice(["", ' width="100"', ' valign="top"']), parts)
        row = lambda cells: self.wrapped("tr", "", cells)
        menu, body = cell(self.links(bare=rng.random() < 0.7)), cell(text)
        rows = row(rng.choice([menu + body, body + menu, menu + body + cell(self.links(bare=True))]))
        head = row(cell([(self.words(1, 4), False)])) if rng.random() < 0.5 else []
        foot = row(cell([(f"<center>{rng.choice(['&copy; ', 'Copyright ', ''])}{self.words(1, 4)}</center>", False)])) if rng.random() < 0.6 else []
        return self.wrapped("table", rng.choice(["", ' border="0"']), head + rows + foot)


def labelled_pages(count: int = 1500, seed: int = 11, kinds: tuple[str, ...] = ("semantic", "semantic", "divs", "weblog", "tables"), lone: float = 0.06) -> list[tuple[str, list[bool]]]:
    """(page, whether each of its blocks is content); the labels come with the parts."""
    make, out = _Maker(seed), []
    for _ in range(count):
        body = make.lone() if make.rng.random() < lone else getattr(make, make.rng.choice(kinds))()
        head = f"<head><title>{make.words(2, 8)}</title><script>var a = '<p>';</script></head>" if make.rng.random() < 0.8 else ""
        parts = [(f"<!DOCTYPE html><html>{head}<body>", False if head else None), *body, ("</body></html>", None)]
        page, labels = "".join(p for p, _ in parts), [y for p, y in parts if y is not None]
        if len(blocks(page)) == len(labels):
            out.append((page, labels))
    return out


def train(pages: list[tuple[str, list[bool]]] | None = None) -> Chain:
    rows = [([fs for fs, _ in blocks(page)], [int(y) for y in labels]) for page, labels in (labelled_pages() if pages is None else pages)]
    return Chain().fit(rows)


def main_text(page: str | None, model: Chain, known: frozenset[str] | None = None) -> str:
    found = blocks(page, known or model.known)
    labels = model.decode([fs for fs, _ in found])
    return " ".join(text for (_, text), y in zip(found, labels, strict=True) if y)


def _extract(model: Chain):
    known = model.known

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            text = [main_text(h.as_py(), model, known) for h in rb.column("html")]
            yield pa.RecordBatch.from_arrays([rb.column("page_id"), rb.column("url"), pa.array(text, type=pa.string()), pa.array([len(t) for t in text], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: Chain | None = None) -> DataFrame:
    """pages(page_id, url, html, ...) -> (page_id, url, text, n_chars), one row for each row of pages.

    Null or empty html, and a page without content blocks, gives the empty text. Broken markup is
    read as far as it goes. Repeated rows and null ids pass like any other; other columns are ignored."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(_extract(model or train()), "page_id long, url string, text string, n_chars long")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
