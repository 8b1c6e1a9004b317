"""HTML extraction (operator 1): a recurrent block labeller over the leaf blocks of a page."""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ship
from tessella.llm.ragged import NOT_ALNUM, U64, buffers, hashes, lower_ascii, mix64, spans

#: fixed values: elements inside a line of text; all others begin a block
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe object select".split())
SWALLOWS = frozenset("script style textarea iframe".split())
#: what an opening tag closes if it is still open
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
BLOCK_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
#: elements whose own text isn't the page's, and what may stand in them; the first other element closes them, as their end tags may be missing
HEAD = frozenset("head title".split())
IN_HEAD = HEAD | frozenset("html base basefont bgsound link meta noframes noscript script style template".split())

PATH, WORDS, NUMBERS = 512, 32, 11
HIDDEN = 24

#: names on a path that count, from the inside
NEAR = 12

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_STOP = re.compile("[>\"']")
_TITLE = re.compile(r"<(/?title|/head)\b", re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass
class Block:
    """One leaf: its text, the NEAR innermost names on its path, how many names the path has, and the share of its characters that are links."""

    text: str
    path: tuple[str, ...]
    depth: int
    linked: float


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            out += [f".{x}" for x in _NAME.findall((m[2] or m[3] or m[4] or "").lower())]
    return tuple(out)


class _Tags:
    """The tags of a page from left to right, in time proportional to its length however broken it is."""

    def __init__(self, page: str):
        self.page = page
        self.quotes = True  # until a tag isn't closed outside of quotes: from there on quotes are plain
        self.no_end: set[str] = set()

    def end_of(self, at: int) -> int:
        """Past the > that closes a tag whose name ends at `at`; -1 if there is none."""
        page = self.page
        while self.quotes:
            m = _STOP.search(page, at)
            if m is None:
                break
            at = m.end()
            if m[0] == ">":
                return at
            close = page.find(m[0], at)
            at = close + 1 if close >= 0 else at
        else:
            return page.find(">", at) + 1 or -1
        self.quotes = False
        return page.find(">", at) + 1 or -1

    def next(self, at: int):
        """(start, end, name or none, whether it closes, attributes) of the next tag, comment or declaration; none at the end."""
        page = self.page
        while m := _OPEN.search(page, at):
            if m[1]:
                end = page.find("-->", m.end())
                return m.start(), end + 3 if end >= 0 else len(page), None, False, ""
            if m[2]:
                end = page.find(">", m.end()) + 1
                if end:
                    return m.start(), end, None, False, ""
                return None
            begin = m.end()
            end = self.end_of(begin)
            if end < 0:
                end = page.find(">", begin) + 1
                if not end:
                    return None  # no > follows: no tag either
            return m.start(), end, m[4].lower(), bool(m[3]), page[begin : end - 1]
        return None

    def close_of(self, tag: str, at: int) -> int:
        """Past the next end tag of a name; -1 if there is none."""
        if tag in self.no_end:
            return -1
        m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(self.page, at)
        end = self.page.find(">", m.end()) + 1 if m else 0
        if not end:
            self.no_end.add(tag)
        return end or -1

    def title_end(self, at: int) -> int:
        """Where the end tag of a title stands; -1 if another title or the head's end comes first."""
        if "title" in self.no_end:
            return -1
        m = _TITLE.search(self.page, at)
        if m is None:
            self.no_end.add("title")
        return m.start() if m and m[1].lower() == "/title" else -1


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order. Lenient: unclosed and stray tags, comments and raw elements are handled.

    Takes time proportional to the page. An element of RAW that isn't closed hides nothing, but a script, style, iframe or
    text area does so to the page's end.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []  # open elements, each with the path down to it and its length
    open_ = Counter()
    pieces: list[str] = []
    linked = total = anchors = 0
    head = -1  # where in the stack an open head or title is
    tags = _Tags(page)

    def flush() -> None:
        nonlocal linked, total
        if pieces:
            text = "".join(pieces)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text and not (open_["head"] or open_["title"]):
                out.append(Block(text, *(stack[-1][1:] if stack else ((), 0)), linked / max(1, total)))
            pieces.clear()
        linked = total = 0

    def cut(n: int) -> None:
        while len(stack) > n:
            open_[stack.pop()[0]] -= 1

    def add(piece: str) -> None:
        nonlocal linked, total
        pieces.append(piece)
        total += len(piece)
        if anchors:
            linked += len(piece)

    at = 0
    while True:
        found = tags.next(at)
        if found is None:
            if at < len(page):
                add(page[at:])
            break
        start, end, tag, closing, attributes = found
        if start > at:
            add(page[at:start])
        at = end
        if tag is None:
            continue
        if head >= 0 and (tag == "body" if closing else tag not in IN_HEAD):
            flush()
            cut(head)
            head, anchors = -1, 0
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = tags.close_of(tag, at)
                at = end if end >= 0 else len(page) if tag in SWALLOWS else at
            if tag not in INLINE:
                add(" ")
            continue
        if tag in INLINE:
            if tag == "br":
                add(" ")
            elif tag == "a":
                anchors = max(0, anchors - 1) if closing else 1
            continue
        flush()
        if closing:
            if open_[tag]:
                while stack[-1][0] != tag:
                    cut(len(stack) - 1)
                cut(len(stack) - 1)
            anchors = 0
            if len(stack) <= head:
                head = -1
        elif tag not in VOID:
            closes = CLOSES.get(tag, {"p"} if tag in BLOCK_CLOSES_P else ())
            while stack and stack[-1][0] in closes:
                cut(len(stack) - 1)
            if not attributes.endswith("/"):
                names = _names(tag, attributes)
                path, depth = stack[-1][1:] if stack else ((), 0)
                stack.append((tag, (path + names)[-NEAR:], depth + len(names)))
                open_[tag] += 1
                if tag in HEAD and head < 0:
                    head = len(stack) - 1
                # tags in a title that is closed are its text
                if tag == "title" and (end := tags.title_end(at)) >= 0:
                    at = end
    flush()
    return out


_slots: dict[str, int] = {}


def _slot(name: str) -> int:
    if name not in _slots:
        if len(_slots) > 1 << 16:
            _slots.clear()
        data = np.frombuffer(name.encode(), np.uint8)
        _slots[name] = int(hashes(data, np.array([0]), np.array([len(data)]))[0] % U64(PATH - 1))
    return _slots[name]


def vectors(found: list[Block], first: np.ndarray) -> np.ndarray:
    """A row per block: hashed tag path, hashed words, and lengths. `first` marks the first block of each page."""
    n = len(found)
    x = np.zeros((n, PATH + WORDS + NUMBERS), np.float32)
    if not n:
        return x
    paths: dict[tuple[tuple[str, ...], int], int] = {}
    which = [paths.setdefault((b.path, b.depth), len(paths)) for b in found]
    table = np.zeros((len(paths), PATH), np.float32)
    for (path, depth), i in paths.items():
        for near, name in enumerate(reversed(path)):
            table[i, _slot(name)] += 1.0 if near < 4 else 0.7
        table[i, PATH - 1] = min(depth, 100) / 10
    x[:, :PATH] = table[which]
    data, offsets = buffers(pa.array([b.text for b in found], pa.string()))
    data = lower_ascii(data)
    starts, ends, counts = spans(data, offsets, NOT_ALNUM)
    h = mix64(hashes(data, starts, ends) ^ U64(0x2127599BF4325C37))
    of = np.repeat(np.arange(n), counts)
    sign = np.where(h & U64(1 << 40), 1.0, -1.0)
    words = np.bincount(of * WORDS + (h % U64(WORDS)).astype(np.int64), sign, n * WORDS).reshape(n, WORDS)
    x[:, PATH : PATH + WORDS] = np.clip(words / np.sqrt(np.maximum(counts, 1))[:, None], -2, 2)
    size = np.diff(offsets)
    marks = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b".,;:!?", np.uint8)))])
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data < 58))])
    k = PATH + WORDS
    x[:, k] = np.log1p(size) / 8
    x[:, k + 1] = np.log1p(counts) / 6
    x[:, k + 2] = [b.linked for b in found]
    x[:, k + 3] = (marks[offsets[1:]] - marks[offsets[:-1]]) / np.maximum(counts, 1)
    x[:, k + 4] = (digits[offsets[1:]] - digits[offsets[:-1]]) / np.maximum(size, 1)
    x[:, k + 5] = size > 120
    page = np.cumsum(first) - 1
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, n))
    x[:, k + 6] = (np.arange(n) - start[page]) / length[page]
    x[:, k + 7] = first
    where = np.array(which)
    same = (where[1:] == where[:-1]) & ~first[1:]
    x[1:, k + 8] = x[:-1, k + 9] = same
    # share of the page's text that stands under the same path
    alike = np.unique(page * len(paths) + where, return_inverse=True)[1]
    x[:, k + 10] = np.bincount(alike, size)[alike] / np.bincount(page, size)[page]
    return x


class Lstm:
    """One direction of an LSTM layer; gates in the order input, forget, output, candidate."""

    def __init__(self, rng: np.random.Generator, inputs: int, hidden: int):
        self.w = (rng.standard_normal((inputs + hidden, 4 * hidden)) / np.sqrt(inputs + hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden : 2 * hidden] = 1
        self.hidden = hidden

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """x: time, batch, inputs; mask: time, batch. Masked steps leave the state as it is."""
        steps, batch, inputs = x.shape
        n = self.hidden
        h = np.zeros((batch, n), np.float32)
        c = np.zeros((batch, n), np.float32)
        out = np.zeros((steps, batch, n), np.float32)
        tape = []
        drive = x.reshape(steps * batch, inputs) @ self.w[:inputs] + self.b
        drive = drive.reshape(steps, batch, 4 * n)
        for t in range(steps):
            g = drive[t] + h @ self.w[inputs:]
            s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * n], -30, 30)))
            u = np.tanh(g[:, 3 * n :])
            i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
            m = mask[t][:, None]
            c2 = f * c + i * u
            tc = np.tanh(c2)
            h2 = o * tc
            if keep:
                tape.append((h, c, i, f, o, u, tc, m))
            c = m * c2 + (1 - m) * c
            h = m * h2 + (1 - m) * h
            out[t] = h
        return out, tape

    def backward(self, x: np.ndarray, tape: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps, batch, inputs = x.shape
        n = self.hidden
        all_ = np.empty((steps, batch, 4 * n), np.float32)
        dh, dc = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, u, tc, m = tape[t]
            dh = dh + d_out[t]
            dh2, dc2 = dh * m, dc * m
            do = dh2 * tc
            dc2 = dc2 + dh2 * o * (1 - tc * tc)
            dg = all_[t] = np.hstack([dc2 * u * i * (1 - i), dc2 * c * f * (1 - f), do * o * (1 - o), dc2 * i * (1 - u * u)])
            dh = dg @ self.w[inputs:].T + dh * (1 - m)
            dc = dc2 * f + dc * (1 - m)
        flat = all_.reshape(-1, 4 * n)
        before = np.concatenate([step[0] for step in tape])
        return np.concatenate([x.reshape(-1, inputs).T @ flat, before.T @ flat]), flat.sum(0)


class Labeller:
    """A bidirectional LSTM and a logistic output for each block."""

    def __init__(self, seed: int = 5, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        inputs = PATH + WORDS + NUMBERS
        self.ahead, self.back = Lstm(rng, inputs, hidden), Lstm(rng, inputs, hidden)
        self.v = (rng.standard_normal(2 * hidden) / np.sqrt(2 * hidden)).astype(np.float32)
        self.v0 = np.zeros(1, np.float32)

    @staticmethod
    def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(p) for p in pages)
        x = np.zeros((steps, len(pages), PATH + WORDS + NUMBERS), np.float32)
        mask = np.zeros((steps, len(pages)), np.float32)
        for j, p in enumerate(pages):
            x[: len(p), j] = p
            mask[: len(p), j] = 1
        return x, mask

    def scores(self, pages: list[np.ndarray], most: int = 1 << 14) -> list[np.ndarray]:
        """Probability of each block of each page to be article text; pages of similar length go together."""
        out: list = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            take = max(1, min(len(order), most // len(pages[order[-1]])))
            some, order = order[-take:], order[:-take]
            x, mask = self._pad([pages[i] for i in some])
            p = self._score(x, mask)[0]
            for j, i in enumerate(some):
                out[i] = p[: len(pages[i]), j]
        return out

    def _score(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        a, ta = self.ahead.forward(x, mask, keep)
        b, tb = self.back.forward(x[::-1], mask[::-1], keep)
        h = np.concatenate([a, b[::-1]], 2)
        z = h @ self.v + self.v0
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), h, ta, tb

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 8, batch: int = 16, rate: float = 0.01, seed: int = 3) -> None:
        """Back-propagation through time with Adam on the cross-entropy of every block."""
        rng = np.random.default_rng(seed)
        weights = [self.ahead.w, self.ahead.b, self.back.w, self.back.b, self.v, self.v0]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        n = self.ahead.hidden
        total = epochs * -(-len(pages) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                x, mask = self._pad([pages[i] for i in some])
                y = np.zeros_like(mask)
                for j, i in enumerate(some):
                    y[: len(labels[i]), j] = labels[i]
                p, h, ta, tb = self._score(x, mask, True)
                dz = (p - y) * mask / mask.sum()
                dh = dz[:, :, None] * self.v
                dwa, dba = self.ahead.backward(x, ta, dh[:, :, :n])
                dwb, dbb = self.back.backward(x[::-1], tb, dh[::-1, :, n:])
                grads = [dwa, dba, dwb, dbb, np.einsum("tb,tbh->h", dz, h), np.array([dz.sum()], np.float32)]
                step += 1
                for w, g, a, b in zip(weights, grads, first, second):
                    np.clip(g, -1, 1, out=g)
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    w -= rate * (1 - (step - 1) / total) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)


#: fixed values: words that menus, notices, forms and footers are made of, in four languages
FURNITURE = "home about contact login register subscribe newsletter cookies privacy policy terms copyright rights reserved share tweet reply comment comments advertisement sponsored menu search next previous related read more sign submit email password accept start über kontakt anmelden datenschutz impressum werbung suche mehr antworten kommentar accueil contact connexion abonnez confidentialité mentions publicité recherche suite répondre commentaire inicio acerca contacto entrar privacidad aviso publicidad buscar más responder comentario".split()
_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ch sch ung lich ein ver é è eau oi tion ment ción ía ó ñ ü ä".split()


def training_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """An invented page and the texts of its article blocks. Layout, class names, nesting and errors vary."""
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(_SYLLABLES[i] for i in rng.integers(0, len(_SYLLABLES), rng.integers(1, 4)))
    chance = lambda p: rng.random() < p

    def prose(low: int, high: int) -> str:
        words = [word() + (pick(",", ".", "") if chance(0.15) else "") for _ in range(int(np.exp(rng.uniform(np.log(low), np.log(high + 1)))))]
        if chance(0.06):  # texts of one word again and again, or full of symbols
            words = [w + pick("%%%", "###", " |", "!!") for w in words] if chance(0.5) else words[:1] * len(words)
        return (" ".join(words)).capitalize() + pick(".", ".", ".", "!", "")

    def furniture(low: int, high: int) -> str:
        return " ".join(pick(*FURNITURE) if chance(0.5) else word() for _ in range(rng.integers(low, high + 1)))

    attr = lambda *names: f' {pick("class", "class", "id")}="{pick(*names)}{pick("", "", "-" + word(), " " + word())}"'
    link = lambda t: f'<a href="/{word()}">{t}</a>'

    def menu() -> str:
        items = [link(furniture(1, 2) if chance(0.5) else word()) for _ in range(rng.integers(2, 9))]
        body = pick(f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>", " | ".join(items), "".join(f"<li>{i}" for i in items))
        return pick(f"<nav>{body}</nav>", f"<div{attr('nav', 'menu', 'navbar', 'topbar', 'breadcrumb', 'links')}>{body}</div>", f'<ul{attr("menu", "nav")}>{"".join(f"<li>{i}</li>" for i in items)}</ul>', f"<nav{attr('main', 'menu')}>{body}</nav>")

    def advert() -> str:
        body = prose(3, 25) if chance(0.7) else link(prose(2, 12))
        return f"<{(t := pick('div', 'div', 'aside', 'section', 'p'))}{attr('ad', 'ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner')}>{body if chance(0.6) else f'<p>{body}</p>'}</{t}>"

    def notice() -> str:
        return f"<div{attr('cookie', 'notice', 'banner', 'alert', 'consent', 'popup', 'message')}>{pick(prose(4, 30), furniture(4, 15))} {pick('', '<button>' + furniture(1, 2) + '</button>')}</div>"

    def form() -> str:
        return f'<form{pick("", attr("search", "login", "subscribe", "newsletter", "signup"))}>{pick("", f"<p>{prose(3, 20)}</p>")}<label>{furniture(1, 3)}</label><input name="q"><button>{furniture(1, 2)}</button></form>'

    def sidebar() -> str:
        parts = [f"<h3>{furniture(1, 3)}</h3>", "<ul>" + "".join(f"<li>{link(prose(2, 9))}</li>" for _ in range(rng.integers(2, 6))) + "</ul>", f"<p>{prose(3, 30)}</p>", advert(), form()]
        body = "".join(pick(*parts) for _ in range(rng.integers(1, 4)))
        return pick(f"<aside>{body}</aside>", f"<div{attr('sidebar', 'widget', 'related', 'recommended', 'secondary', 'social', 'share')}>{body}</div>", f"<aside{attr('side', 'sidebar')}>{body}</aside>")

    def comments() -> str:
        one = lambda: f"<{(t := pick('div', 'li', 'article', 'p'))}{attr('comment', 'reply', 'comment-body')}>{pick('', f'<span>{word()}</span> ')}{pick(prose(3, 60), f'<p>{prose(3, 60)}</p>')}{pick('', link('reply'))}</{t}>"
        return f"<{(t := pick('div', 'section', 'ol'))}{attr('comments', 'commentlist', 'discussion', 'responses', 'disqus')}>{pick('', f'<h3>{furniture(1, 3)}</h3>')}{''.join(one() for _ in range(rng.integers(1, 6)))}</{t}>"

    def footer() -> str:
        body = pick(f"&copy; {word()}.example.com &middot; {prose(3, 20)}", furniture(3, 14), f"<p>{furniture(2, 10)}</p><p>{prose(2, 20)}</p>", " &middot; ".join(link(furniture(1, 2)) for _ in range(4)))
        return pick(f"<footer>{body}</footer>", f"<div{attr('footer', 'bottom', 'copyright', 'colophon')}>{body}</div>", f"<footer{attr('site', 'page')}>{body}</footer>", f"<footer>{body}")

    def header() -> str:
        body = pick(link(word()), f"<p>{furniture(2, 6)}</p>", f"<h2>{prose(1, 5)}</h2>", f"<div>{word()} {word()}</div>") + pick("", menu(), form())
        return pick(f"<header>{body}</header>", f"<div{attr('header', 'masthead', 'branding', 'top')}>{body}</div>")

    texts: list[str] = []

    def article() -> str:
        def leaf(tag: str, text: str) -> str:
            texts.append(" ".join(text.split()))
            inner = f"<b>{text}<br>" if tag == "p" and chance(0.1) else text
            if tag == "p" and chance(0.15) and " " in inner:
                a, _, b = inner.partition(" ")
                inner = f"{a} {pick(link(b), f'<em>{b}</em>') if chance(0.3) and len(b) < 60 else b}"
            return f"<{tag}>{inner}" + ("" if tag == "p" and chance(0.25) else f"</{tag}>")

        out = [leaf(pick("h1", "h1", "h2"), prose(1, 14))] if chance(0.9) else []
        for _ in range(rng.integers(1, 14)):
            kind = rng.random()
            if kind < 0.8:
                out.append(leaf("p", prose(1, 250)))
            elif kind < 0.86:
                out.append(leaf(pick("h2", "h3"), prose(1, 8)))
            elif kind < 0.91:
                out.append("<ul>" + "".join(leaf("li", prose(1, 20)) for _ in range(rng.integers(1, 5))) + "</ul>")
            elif kind < 0.95:
                out.append("<blockquote>" + leaf("p", prose(5, 60)) + "</blockquote>")
            elif chance(0.6):
                out.append(pick(advert, notice)())
            else:
                out.append(leaf("pre", prose(3, 40)))
        body = "".join(out)
        if chance(0.5):  # nothing but the page around tells what is in it
            name = pick("", "", attr(word()), attr(word() + word()))
            return pick(f"<div{name}>{body}</div>", f"<div{name}><div>{body}</div></div>", f"<table{name}><tr><td>{body}</td></tr></table>", f"<td{name}>{body}</td>", f"<section{name}>{body}</section>", f"<center{name}>{body}</center>", body)
        return pick(f"<article>{body}</article>", f"<article>{body}</article>", f"<article{attr('post', 'story')}>{body}</article>", f"<main>{body}</main>", f"<div{attr('content', 'post', 'entry', 'article', 'story', 'text', 'body')}>{body}</div>", f"<main><article>{body}</article></main>", f"<section{attr('article', 'content', 'main')}>{body}</section>")

    before = [x for p, x in ((0.4, header), (0.9, menu), (0.3, notice), (0.15, form), (0.5, advert), (0.25, sidebar)) if chance(p)]
    after = [x for p, x in ((0.3, comments), (0.3, sidebar), (0.3, advert), (0.2, form), (0.2, notice), (0.2, menu), (0.9, footer)) if chance(p)]
    parts = [x() for x in before] + [article()] + [x() for x in after]
    page = f"<!DOCTYPE html><html><head><title>{prose(1, 8)}</title><script>var t='</p>';</script></head><body>{''.join(parts)}</body></html>"
    return (f"<div{attr('wrapper', 'page', 'container')}>{page}" if chance(0.2) else page), texts


@functools.lru_cache(maxsize=2)
def trained(pages: int = 1600, seed: int = 11) -> Labeller:
    """The labeller trained on `pages` invented pages; the same in each run."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, texts = training_page(rng)
        found = blocks(page)
        if not found:
            continue
        left = list(texts)
        y = np.zeros(len(found), np.float32)
        for i, b in enumerate(found):  # article texts come in page order
            if left and b.text == left[0]:
                y[i] = 1
                left.pop(0)
        first = np.zeros(len(found), bool)
        first[0] = True
        xs.append(vectors(found, first))
        ys.append(y)
    model = Labeller()
    model.train(xs, ys)
    return model


def extract_batch(model: Labeller, pages: list[str | None]) -> list[str]:
    """The article text of each page: the blocks labelled as such, joined by an empty line."""
    found = [blocks(p) if p else [] for p in pages]
    flat = [b for f in found for b in f]
    first = np.zeros(len(flat), bool)
    ends = np.cumsum([len(f) for f in found])
    starts = ends - [len(f) for f in found]
    first[starts[ends > starts]] = True
    x = vectors(flat, first)
    scores = model.scores([x[s:e] for s, e in zip(starts, ends)])
    return ["\n\n".join(b.text for b, p in zip(f, s) if p >= 0.5) for f, s in zip(found, scores)]


def extract(df: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: Labeller | None = None) -> DataFrame:
    """The main text of every whole page: `keep` columns, text, n_chars (code points).

    A bidirectional LSTM labels each leaf block from tag path and hashed words, with the whole page as context.
    Null, empty and text-less pages give an empty text. Pages are handled alone: ties and repeated rows come
    out alike, long pages are read whole, there is no shuffle, and other columns aren't read.
    """
    spark = ship(df.sparkSession)
    shared = spark.sparkContext.broadcast(model or trained())
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))
    schema = df.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = shared.value
        for b in batches:
            column = b.column(b.num_columns - 1)
            for i in range(0, len(column), 256):
                texts = extract_batch(labeller, column.slice(i, 256).to_pylist())
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return df.select(*keep, F.col(page).cast("string").alias("__page")).mapInArrow(run, schema)
