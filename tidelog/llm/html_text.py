"""HTML extraction by a recurrent block labeller.

A page becomes a sequence of leaf blocks: runs of text between block-level tags, each with the path of open tags (names, class and id
words, roles). A block is two mean vectors, one of its hashed path words and one of its hashed text words, its length and the share of it that is link. A bidirectional LSTM
in numpy reads the whole sequence, so each block is labelled in view of the document around it. The model is trained here, on pages that
sample_page() makes up with known labels; its size is fixed, and the driver sends it to the executors.

Defined results: null or empty html, and pages without content blocks, give an empty text. Scripts, styles, templates, form fields, embedded media and HTML
comments are never text; formulas and noscript parts are. Unclosed and stray tags are borne; a tag cut off by the end of the page is dropped. Time is linear in the page: tags open
deeper than MAX_DEPTH add nothing to a path, of a deeper path than PATH_TAGS the outer and inner halves count, and where quotes of more than a few tags run
to the end of the page, its further tags end at the first >. Repeated rows give repeated results, an empty table an empty one; further columns, of whatever name, have no part.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

PATH_SLOTS, WORD_SLOTS, VECTOR, HIDDEN = 2048, 512, 16, 16
TRAIN_PAGES, EPOCHS, SEED = 1200, 8, 20

MAX_DEPTH, PATH_TAGS, BROKEN_QUOTES = 256, 48, 8
#: Pages are labelled in groups of so many at most, and of so many blocks, padding included (or one page).
GROUP_PAGES, GROUP_BLOCKS = 64, 8_000

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""[>"']""")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-label)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
RAW = frozenset("script style template svg iframe textarea title select option button head object canvas audio video datalist annotation annotation-xml".split())
VOID = frozenset("br img hr input meta link wbr source area base col embed param track".split())
BLOCK = frozenset("html body p div section article main header footer nav aside ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 address details summary hr center menu dialog legend hgroup search noscript".split())
_CLOSES_P = BLOCK - {"html", "body"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = frozenset("ul ol dl table div section article main body nav aside header footer form".split())
_RAW_END: dict[str, re.Pattern] = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


@lru_cache(100_000)
def _slot(word: str, slots: int) -> int:
    return zlib.crc32(word.encode()) % slots


@lru_cache(50_000)
def _path_words(tag: str, attributes: str) -> tuple[int, ...]:
    words = ["<" + tag]
    for name, value in _NAMES.findall(attributes):
        words += [f"{name.lower()}:{w}" if name.lower() == "role" else w for w in _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())] or [name.lower()]
    return tuple(_slot(w, PATH_SLOTS) for w in words)


class Tags:
    """The tags of a page in order; the caller may move on to a later place."""

    def __init__(self, page: str):
        self.page, self.last, self.broken = page, page.rfind(">"), 0

    def _end(self, at: int) -> tuple[int, int]:
        """(end of the attributes, end of the tag) of the tag whose name ends there: the next > outside quotes, or the next at all where a quote never ends."""
        start = at
        while self.broken < BROKEN_QUOTES:
            stop = _STOP.search(self.page, at)
            if stop is None:
                self.broken += 1
                break
            if stop[0] == ">":
                return stop.start(), stop.end()
            close = self.page.find(stop[0], stop.end())
            if close < 0:
                self.broken += 1
                break
            at = close + 1
        end = self.page.find(">", start)
        return end, end + 1

    def after(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """(start, end, name, attributes, whether it closes) of the next tag; the name of a comment or declaration is empty."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), "", "", False
            if at > self.last:
                return None  # no tag ends any more, but a comment might still begin
            if page[at + 1 : at + 2] in ("!", "?"):
                return at, page.find(">", at) + 1, "", "", False
            tag = _TAG.match(page, at)
            if tag:
                stop, end = self._end(tag.end())
                return at, end, tag[2].lower(), page[tag.end() : stop], tag[1] == "/"
            at += 1
        return None


def blocks(page: str) -> list[tuple[tuple[int, ...], str, float]]:
    """(slots of the path words, text, share of it in links) of each leaf block in page order, white space turned into single spaces."""
    out: list[tuple[tuple[int, ...], str, float]] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    parts: list[str] = []
    at, size, linked, links_open = 0, len(page), 0, 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(entities.unescape(piece) if "&" in piece else piece)
            if links_open:
                linked += len(parts[-1])

    def close() -> None:
        nonlocal linked
        if parts:
            joined = " ".join("".join(parts).split())
            parts.clear()
            if joined:
                path = stack if len(stack) <= PATH_TAGS else stack[: PATH_TAGS // 2] + stack[-PATH_TAGS // 2 :]
                out.append((tuple(s for _, p in path for s in p), joined, min(1.0, linked / len(joined))))
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links_open
        if any(t in BLOCK for t, _ in stack[depth:]):
            close()
        links_open -= sum(t == "a" for t, _ in stack[depth:])
        del stack[depth:]

    tags = Tags(page)
    while found := tags.after(at):
        start, end, tag, attributes, closing = found
        text(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if tag == "br":
                parts.append(" ")
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
                if tag not in BLOCK and stack[depth][0] in BLOCK:
                    break  # an inline end tag doesn't close blocks
            else:
                if tag in BLOCK:
                    close()
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            elif tag in ("br", "wbr", "img"):
                parts.append("" if tag == "wbr" else " ")
            continue
        if tag in RAW:
            if tag not in ("head",) and not attributes.endswith("/"):
                ended = _RAW_END[tag].search(page, at)
                at = ended.end() if ended else size
                parts.append(" ")
            continue
        if tag in BLOCK:
            close()
            if tag in _CLOSES_P:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == "p":
                        pop_to(depth)
                        break
                    if stack[depth][0] in BLOCK:
                        break
            if tag in _SAME:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in _SAME[tag]:
                        pop_to(depth)
                        if tag != "tr":
                            break
                    elif stack[depth][0] in _SCOPE:
                        break
        if (not attributes.endswith("/") or tag in BLOCK) and len(stack) < MAX_DEPTH:
            stack.append((tag, _path_words(tag, attributes)))
            links_open += tag == "a"
    rest = page[at:]
    cut = re.search(r"<[a-zA-Z/!?]", rest)
    text(rest[: cut.start()] if cut else rest)
    close()
    return out


def _words(text: str, links: float) -> list[int]:
    words = dict.fromkeys(text.lower().split())
    return [_slot(w, WORD_SLOTS) for w in words] + [_slot(f"#{min(9, len(text).bit_length())}", WORD_SLOTS), _slot(f"#links{round(4 * links)}", WORD_SLOTS)]


# --- made-up pages -----------------------------------------------------------------------------------------------


@lru_cache(1)
def _vocabulary() -> list[str]:
    """Made-up words and a few numbers."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnoprstuvwéöñ", k=rng.randint(1, 9))) for _ in range(20_000)]
    return words + [str(rng.randint(0, 2030)) for _ in range(600)]


def sample_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page and for each of its blocks whether it is main text."""
    parts: list[str] = []
    labels: list[bool] = []
    vocabulary = _vocabulary()
    word = lambda: rng.choice(vocabulary)
    words = lambda a, b: " ".join(rng.choices(vocabulary, k=rng.randint(a, b))).capitalize()
    notes = ["cookie", "subscribe", "newsletter", "privacy", "copyright", "share", "login", "menu", "comments", "reply", "advertisement", "sponsored"]
    short = lambda: " ".join([word(), *([rng.choice(notes)] if rng.random() < 0.4 else []), *[word() for _ in range(rng.randint(0, 10))]])

    def block(tag: str, body: str, main: bool, names: str = "") -> None:
        inner = body
        if rng.random() < 0.15:
            inner = f"<b>{body}" + ("</b>" if rng.random() < 0.5 else "")
        elif rng.random() < 0.1:
            inner = f'<a href="/{word()}">{body}</a>'
        parts.append(f"<{tag}{names}>{inner}" + ("" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>"))
        labels.append(main)

    def attribute(names: list[str]) -> str:
        return rng.choice([' class="{}"', ' id="{}"', ' class="x-{} widget"', " class='{}'"]).format(rng.choice(names)) if names else ""

    junk = {
        "menu": (["nav", "div", "ul", "header"], ["nav", "menu", "navbar", "main-menu", "navigation", "breadcrumbs", "topbar", "toc"]),
        "header": (["header", "div"], ["header", "site-header", "masthead", "banner", "page-header", "logo"]),
        "footer": (["footer", "div"], ["footer", "site-footer", "page-footer", "copyright", "colophon", "bottom"]),
        "side": (["aside", "div", "section"], ["sidebar", "side", "related", "widget-area", "recommended", "trending", "popular", "more-stories"]),
        "notice": (["div", "section", "dialog", "p"], ["cookie-banner", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "paywall", "overlay"]),
        "advert": (["div", "aside", "section", "ins"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "adsbox"]),
        "form": (["form", "div"], ["newsletter", "subscribe", "signup", "search", "login", "search-form", "contact-form"]),
        "comments": (["section", "div", "ol", "ul", "article"], ["comments", "comment-list", "comment", "disqus", "responses", "discussion", "reader-comments", "replies", "user-comments"]),
        "share": (["div", "ul"], ["share", "social", "share-buttons", "tags", "pagination", "byline-links", "author-box", "social-links"]),
    }
    bare_ok = {"nav", "header", "footer", "aside", "form", "dialog"}

    def boiler(kind: str) -> None:
        tags, names = junk[kind]
        tag = rng.choice(tags)
        bare = tag in bare_ok and kind not in ("comments", "share") and rng.random() < 0.5
        parts.append(f"<{tag}{'' if bare else attribute(names)}>")
        n = rng.randint(1, 7)
        if kind == "notice" and rng.random() < 0.2:
            parts.append("<noscript>")
            block("p", short(), False)
            parts.append("</noscript>")
        if kind == "comments":
            for _ in range(n):
                shell = rng.choice(["", "li", "div", "article"])
                parts.append(f'<{shell} class="{rng.choice(["comment", "reply", "comment-body", "c"])}">' if shell else "")
                for _ in range(rng.randint(1, 3)):
                    block("p", words(3, 40), False)
                parts.append(f"</{shell}>" if shell else "")
        elif kind == "form":
            tag2 = tag == "div"
            parts.append("<form>" if tag2 else "")
            block("p", short(), False)
            parts.append('<input name="q"><button>Go</button>')
            parts.append("</form>" if tag2 else "")
        elif rng.random() < 0.5 and tag != "p":
            inner = tag if tag in ("ul", "ol") else "ul"
            parts.append(f"<{inner}>" if inner != tag else "")
            for _ in range(n):
                block("li", f'<a href="/{word()}">{short()}</a>', False)
            parts.append(f"</{inner}>" if inner != tag else "")
        elif rng.random() < 0.4 or tag == "p":
            parts.append(words(2, 30) if rng.random() < 0.5 else short())
            labels.append(False)
        else:
            for _ in range(rng.randint(1, 3)):
                block(rng.choice(["p", "div", "h3"]), words(2, 40), False)
        parts.append(f"</{tag}>")

    def items(tag: str, n: int) -> None:
        """A list of the text: short items, of one make, with few links."""
        long = rng.random() < 0.5
        parts.append(f"<{tag}>")
        for _ in range(n):
            block("li", f"{rng.randint(1, 500)} {words(1, 6)}" if rng.random() < 0.3 else words(1, 20 if long else 6), True)
        parts.append(f"</{tag}>")

    def bare() -> None:
        """Pages without anything around the text: no tags, or plain ones without names."""
        kind = rng.choice(["none", "lines", "divs", "paragraphs", "list", "body"])
        if kind in ("none", "lines"):
            parts.append((" " if kind == "none" else "\n").join(words(1, 30) for _ in range(rng.randint(1, 5))))
            labels.append(True)
            return
        parts.append(rng.choice(["", "<html><body>", "<body>"]))
        if rng.random() < 0.5:
            block("h1", words(1, 8), True)
        if kind == "list":
            items("ul", rng.randint(1, 9))
        for _ in range(rng.randint(1, 6)):
            block("div" if kind == "divs" else "p", words(1, 8) if rng.random() < 0.5 else words(8, 50), True)

    def main() -> None:
        shell = rng.choice(["article", "article", "main", "div", "div", "section", "main+article", "div+article", "body", "td"])
        good = ["content", "article", "post", "entry-content", "article-body", "story", "main", "post-content", "text", "main-content", "markdown-body"]
        opened = []
        for tag in (["table", "tr", "td"] if shell == "td" else [] if shell == "body" else shell.split("+")):
            named = tag in ("div", "section") or rng.random() < 0.3
            parts.append(f"<{tag}{attribute(good) if named and tag not in ('table', 'tr') else ''}>")
            opened.append(tag)
        head = rng.random()
        if head < 0.3:
            parts.append("<header>")
            block("h1", words(2, 10), True)
            parts.append("</header>")
        elif head < 0.9:
            block("h1", words(2, 14), True)
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14, 25])):
            r = rng.random()
            if r < 0.6:
                block("p", words(1, 8) if rng.random() < 0.25 else words(8, 90), True, attribute(["lead", "text", "intro", "c1"]) if rng.random() < 0.05 else "")
            elif r < 0.67:
                block(rng.choice(["h2", "h3"]), words(1, 8), True)
            elif r < 0.79:
                items(rng.choice(["ul", "ol"]), rng.randint(1, 10))
            elif r < 0.81:
                parts.append("<dl>")
                for _ in range(rng.randint(1, 4)):
                    block("dt", words(1, 4), True)
                    block("dd", words(2, 20), True)
                parts.append("</dl>")
            elif r < 0.85:
                block(rng.choice(["blockquote", "pre", "div"]), words(3, 40), True)
            elif r < 0.87:
                block(rng.choice(["p", "div"]), f"{words(1, 9)} <math><mi>{word()}</mi><mo>=</mo><mn>{rng.randint(0, 99)}</mn></math> {words(1, 9)}", True)
            elif r < 0.88:
                parts.append("<noscript>")
                block("p", words(6, 40), True)
                parts.append("</noscript>")
            elif r < 0.92:
                parts.append("<table>")
                for _ in range(rng.randint(1, 3)):
                    parts.append("<tr>")
                    block("td", words(1, 4), True)
                    block("td", words(1, 4), True)
                    parts.append("</tr>")
                parts.append("</table>")
            elif r < 0.94:
                parts.append("<figure><img src=x>")
                block("figcaption", words(3, 12), True)
                parts.append("</figure>")
            else:
                boiler(rng.choice(["advert", "share", "side", "form", "notice", "footer" if shell == "article" else "advert"]))
        if rng.random() < 0.15:
            boiler("comments")
        for tag in reversed(opened):
            parts.append(f"</{tag}>")

    if rng.random() < 0.08:
        bare()
        return "".join(parts), labels
    parts.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>")
    for kind in ("notice", "header", "menu", "advert", "side"):
        if rng.random() < 0.5:
            boiler(kind)
    wrapped = rng.random() < 0.3
    parts.append(f'<div{attribute(["container", "page", "wrapper", "wrap", "layout", "row"])}>' if wrapped else "")
    if rng.random() < 0.97:
        main()
    for kind in ("side", "share", "comments", "advert", "form"):
        if rng.random() < 0.35:
            boiler(kind)
    parts.append("</div>" if wrapped else "")
    for kind in ("footer", "notice"):
        if rng.random() < 0.6:
            boiler(kind)
    parts.append("</body></html>")
    return "".join(parts), labels


# --- the model ---------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, one LSTM each way, and a logistic layer over both states and the block's own vector."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        d = 2 * VECTOR
        self.w = {"path": rng.normal(0, 0.3, (PATH_SLOTS, VECTOR)), "word": rng.normal(0, 0.1, (WORD_SLOTS, VECTOR)), "out": draw(2 * HIDDEN + d), "bias": np.zeros(1)}
        for way in "fb":
            self.w |= {f"x{way}": draw(d, 4 * HIDDEN), f"h{way}": draw(HIDDEN, 4 * HIDDEN), f"c{way}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}

    def _vectors(self, pages: list[list[tuple[tuple[int, ...], list[int]]]]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors (block, page, 2 * VECTOR), zero past a page's end, and the mask (block, page)."""
        steps = max(map(len, pages))
        x, mask = np.zeros((steps, len(pages), 2 * VECTOR)), np.zeros((steps, len(pages)))
        for side, (name, part) in enumerate((("path", 0), ("word", 1))):
            slots = [s for p in pages for b in p for s in b[part]]
            counts = np.array([len(b[part]) for p in pages for b in p])
            if not len(counts):
                continue
            owner = np.repeat(np.arange(len(counts)), counts)
            sums = np.zeros((len(counts), VECTOR))
            if slots:
                # One column at a time: a block's words may be many.
                for k in range(VECTOR):
                    sums[:, k] = np.bincount(owner, self.w[name][slots, k], len(counts))
            sums /= np.sqrt(np.maximum(counts, 1))[:, None]
            page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
            step = np.concatenate([np.arange(len(p)) for p in pages])
            x[step, page, side * VECTOR : (side + 1) * VECTOR] = sums
            mask[step, page] = 1
            self._trace = getattr(self, "_trace", {}) | {name: (np.array(slots, int), owner, step, page, counts)}
        return x, mask

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        w = self.w
        steps, pages, _ = x.shape
        inputs = x @ w["x" + way] + w["c" + way]
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        out, trace = np.zeros((steps, pages, HIDDEN)), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + h @ w["h" + way]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = (f * c + i * g) * m
            tc = np.tanh(new)
            if keep:
                trace.append((t, h, c, i, f, o, g, tc, m))
            h, c = o * tc * m, new
            out[t] = h
        return out, trace

    def chances(self, pages: list[list[tuple[tuple[int, ...], list[int]]]]) -> list[np.ndarray]:
        if not pages or not max(map(len, pages)):
            return [np.zeros(0) for _ in pages]
        x, mask = self._vectors(pages)
        top = np.concatenate([self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0], x], 2)
        p = _sigmoid(top @ self.w["out"] + self.w["bias"])
        return [p[: len(b), k] for k, b in enumerate(pages)]

    def gradients(self, pages, labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        w, d = self.w, 2 * VECTOR
        x, mask = self._vectors(pages)
        sides = {way: self._run(x, mask, way, True) for way in "fb"}
        top = np.concatenate([sides["f"][0], sides["b"][0], x], 2)
        y = np.zeros(mask.shape)
        for k, want in enumerate(labels):
            y[: len(want), k] = want
        err = (_sigmoid(top @ w["out"] + w["bias"]) - y) * mask / mask.sum()
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["out"], grad["bias"] = np.einsum("tp,tpk->k", err, top), np.array([err.sum()])
        back = err[:, :, None] * w["out"]
        dx = back[:, :, 2 * HIDDEN :].copy()
        for n, way in enumerate("fb"):
            dh, dc = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
            for t, h, c, i, f, o, g, tc, m in reversed(sides[way][1]):
                dh = (dh + back[t, :, n * HIDDEN : (n + 1) * HIDDEN]) * m
                dn = (dc + dh * o * (1 - tc * tc)) * m
                dz = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), dh * tc * o * (1 - o), dn * i * (1 - g * g)], 1)
                grad["x" + way] += x[t].T @ dz
                grad["h" + way] += h.T @ dz
                grad["c" + way] += dz.sum(0)
                dx[t] += dz @ w["x" + way].T
                dh, dc = dz @ w["h" + way].T, dn * f
        for side, name in enumerate(("path", "word")):
            slots, owner, step, page, counts = self._trace[name]
            if len(slots):
                share = dx[step, page, side * VECTOR : (side + 1) * VECTOR] / np.sqrt(np.maximum(counts, 1))[:, None]
                np.add.at(grad[name], slots, share[owner])
        return grad


def features(page: str) -> tuple[list[tuple[tuple[int, ...], list[int]]], list[str]]:
    found = blocks(page)
    return [(path, _words(text, links)) for path, text, links in found], [text for _, text, _ in found]


def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """Trains on made-up pages by Adam; the same seed gives the same model."""
    rng = random.Random(seed)
    data = []
    while len(data) < pages:
        page, labels = sample_page(rng)
        got, _ = features(page)
        if got and len(got) == len(labels):
            data.append((got, np.array(labels, float)))
    model = Labeller(seed)
    m, v, n = ({k: np.zeros_like(x) for k, x in model.w.items()} for _ in range(2)), None, 0
    m, v = m
    for epoch in range(epochs):
        rng.shuffle(data)
        rate = 0.02 if epoch < epochs - 2 else 0.005
        for start in range(0, len(data), 32):
            # Pages of like lengths share a batch, so that little of it is padding.
            part = sorted(data[start : start + 32], key=lambda p: len(p[0]))
            grad = model.gradients([p for p, _ in part], [y for _, y in part])
            n += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.w[k] -= rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)
    model._trace = {}
    return model


@lru_cache(1)
def trained() -> Labeller:
    return train()


def main_texts(model: Labeller, pages: list[str | None]) -> list[str]:
    """The main text of each page. Pages are labelled in groups of like lengths, of GROUP_BLOCKS blocks at most, padding included."""
    got = [features(p) if p else ([], []) for p in pages]
    order = sorted(range(len(pages)), key=lambda i: len(got[i][0]))
    out = [""] * len(pages)
    while order:
        # The last of a group is its longest page.
        n = 1
        while n < min(len(order), GROUP_PAGES) and (n + 1) * len(got[order[n]][0]) <= GROUP_BLOCKS:
            n += 1
        part, order = order[:n], order[n:]
        for i, chance in zip(part, model.chances([got[i][0] for i in part])):
            out[i] = "\n".join(t for t, c in zip(got[i][1], chance) if c >= 0.5)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of pages."""
    model = pages.sparkSession.sparkContext.broadcast(trained().w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller()
        labeller.w = model.value
        for batch in batches:
            for part in slices(batch, 2):
                texts = main_texts(labeller, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
