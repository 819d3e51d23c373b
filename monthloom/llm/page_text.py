"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: runs of text between the start or end tags of block elements, in page
order. Every block is a vector: which tags, classes, ids and roles lie on its path (hashed), its
own element, its words (hashed, all of them), and a few shares. A bidirectional LSTM in numpy
reads the vectors of a whole page and gives each block the probability of being main text, so
the words of a notice or of a comment are judged by what stands around them.

The labeller is fitted on the driver from at most `SAMPLE` pages of at most `SAMPLE_CHARS`
characters. Blocks whose role their markup names (`article`, `nav`, ...) are labelled by it. As
few pages name all roles, the same texts are also laid out anew in `DRAWN` pages of drawn
structure, with the names that class and id attributes use, or with none. The layout is data for
fitting only: no page of the table is judged by a rule.

Defined cases: a null or empty page has an empty text; markup that is not closed ends with its
parent, comments, scripts, styles, templates and the title are no blocks, and an unfinished tag
at the end is none either; character references are decoded once; white space is what Unicode
says; a page without a main block has an empty text; pages of any length are read whole, in
slices of `SLICE` blocks. Repeated rows give repeated rows. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm import words

SAMPLE = 300
SAMPLE_CHARS = 100_000
DRAWN = 1000
INVENTED = 5000
EPOCHS = 10
#: Share of blocks that a round of fitting shows without their words.
WORDLESS = 0.3
HIDDEN = 20
SLICE = 4096
#: Names a task remembers before it starts anew.
REMEMBERED = 200_000

PATH, OWN, WORDS, SHARES = 112, 24, 32, 7
WIDTH = PATH + OWN + WORDS + SHARES

# Fixed values of the HTML standard: elements that start and end a block, elements whose content
# is not shown as text, and start tags that end an open element of the same group.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label "
    "legend li main menu nav noscript ol optgroup option p pre search section select summary table "
    "tbody td textarea tfoot th thead tr ul".split()
)
HIDDEN_TEXT = frozenset("script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"),
}
PARENTS = frozenset("ul ol menu dl table tbody thead tfoot select".split())

# Markup that names the role of its content.
MAIN_MARKUP = frozenset("article main".split())
OTHER_MARKUP = frozenset("nav aside footer form header dialog button select".split())
OTHER_NAMES = frozenset("ad ads advert sidebar menu footer cookie notice comments".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_LABEL = re.compile(r"data-main=\"([01])\"")
_KIND = np.array([[chr(c) in ",;:.", chr(c) == "|", chr(c) in "0123456789"] for c in range(128)], dtype=np.uint8)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in HIDDEN_TEXT}


def _bucket(name: str, count: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % count


class Paths:
    """Distinct paths of open elements: presence of hashed names, and a label if one is known."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.present = [np.zeros(PATH, dtype=np.float32)]
        self.own = [0]
        self.label = [-1]

    def under(self, parent: int, tag: str, attributes: str) -> int:
        marks = [m[0] for m in _NAMES.finditer(attributes)] if attributes else []
        key = (parent, tag, *marks)
        found = self.number.get(key)
        if found is None:
            names = [p.lower() for m in _NAMES.finditer(attributes) for p in _PART.findall("".join(m.groups("")))]
            present = self.present[parent].copy()
            present[[_bucket(f"<{tag}", PATH), *(_bucket(n, PATH) for n in names)]] = 1.0
            found = self.number[key] = len(self.present)
            self.present.append(present)
            self.own.append(_bucket(tag, OWN))
            self.label.append(self._role(parent, tag, names, attributes))
        return found

    def _role(self, parent: int, tag: str, names: list[str], attributes: str) -> int:
        if given := _LABEL.search(attributes):  # only drawn pages have it
            return int(given[1])
        if tag in MAIN_MARKUP or "main" in names and "role" in attributes:
            return 1
        if tag in OTHER_MARKUP and not (tag == "header" and self.label[parent] == 1):
            return 0
        return 0 if OTHER_NAMES.intersection(names) else self.label[parent]


def blocks(page: str, paths: Paths) -> list[tuple[str, int, int]]:
    """(text, path, characters inside links) of each block, white space already single."""
    found: list[tuple[str, int, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and their paths
    outer: list[int] = []  # places of block elements on the stack
    count: dict[str, int] = {}
    linked, at, size = 0, 0, len(page)

    def close():
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                found.append((whole, stack[-1][1] if stack else 0, linked))
            text.clear()
        linked = 0

    def drop(place: int):
        """End the elements from `place` of the stack on."""
        for tag, _ in stack[place:]:
            count[tag] -= 1
        del stack[place:]
        while outer and outer[-1] >= place:
            outer.pop()

    def say(part: str):
        nonlocal linked
        if part:
            part = entities.unescape(part) if "&" in part else part
            text.append(part)
            if count.get("a"):
                linked += len(part)

    while at < size:
        token = _TOKEN.search(page, at)
        if token is None:
            say(page[at:])
            break
        say(page[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            if tag in BLOCK:
                close()
                if count.get(tag):
                    place = next(i for i in reversed(outer) if stack[i][0] == tag)
                    drop(place)
            elif count.get(tag):
                least = outer[-1] if outer else -1
                place = next((i for i in range(len(stack) - 1, least, -1) if stack[i][0] == tag), None)
                if place is not None:
                    drop(place)
            continue
        if tag in HIDDEN_TEXT:
            end = _END[tag].search(page, at)
            at = size if end is None else page.find(">", end.start()) + 1 or size
            continue
        if tag in BLOCK:
            close()
            if outer and stack[outer[-1]][0] == "p":
                drop(outer[-1])
            if tag in SIBLINGS:
                for i in reversed(outer):
                    if stack[i][0] in SIBLINGS[tag]:
                        drop(i)
                        break
                    if stack[i][0] in PARENTS and not (tag in ("tr",) and stack[i][0] == "tr"):
                        break
        elif tag == "br":
            text.append("\n")
        if tag not in VOID:
            path = paths.under(stack[-1][1] if stack else 0, tag, token[3])
            if tag in BLOCK:
                outer.append(len(stack))
            stack.append((tag, path))
            count[tag] = count.get(tag, 0) + 1
    close()
    return found


class Vectors:
    """Vectors of blocks; keeps what it has hashed."""

    def __init__(self):
        self.paths = Paths()
        self.known: dict[str, int] = {}

    def forget(self):
        if len(self.paths.present) > REMEMBERED // 10 or len(self.known) > REMEMBERED:
            self.__init__()

    def _word(self, word: str) -> int:
        """The word's bucket, and `WORDS` more if it begins with a capital."""
        found = self.known[word] = _bucket(word.lower(), WORDS) + WORDS * word[0].isupper()
        return found

    def of(self, part: list[tuple[str, int, int]]) -> np.ndarray:
        n = len(part)
        out = np.zeros((n, WIDTH), dtype=np.float32)
        if not n:
            return out
        paths, known = [b[1] for b in part], self.known
        distinct, place = np.unique(paths, return_inverse=True)
        out[:, :PATH] = np.array([self.paths.present[p] for p in distinct])[place]
        out[np.arange(n), PATH + np.array([self.paths.own[p] for p in paths])] = 1.0
        own = [b[0].split(" ") for b in part]
        count = np.array([len(x) for x in own])
        flat = [w for x in own for w in x]
        hashed = [known.get(w, -1) for w in flat]
        hashed = np.array([self._word(w) if h < 0 else h for w, h in zip(flat, hashed)] if -1 in hashed else hashed)
        row = np.repeat(np.arange(n), count)
        counts = np.bincount(row * WORDS + hashed % WORDS, minlength=n * WORDS).reshape(n, WORDS)
        counts = counts / np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        out[:, PATH + OWN : PATH + OWN + WORDS] = counts
        size = np.array([len(b[0]) for b in part])
        points = np.frombuffer("".join([b[0] for b in part]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = np.add.reduceat(_KIND[np.minimum(points, 127)], np.cumsum(size) - size, axis=0, dtype=np.int64)
        out[:, -SHARES:] = np.column_stack(
            [
                np.log1p(count) / 4,
                np.minimum(1.0, np.array([b[2] for b in part]) / size),
                [b[0][-1] in ".!?…。" for b in part],
                kind[:, 0] / size * 10,
                np.bincount(row, weights=hashed >= WORDS, minlength=n) / count,
                kind[:, 1] / size * 10,
                kind[:, 2] / size * 2,
            ]
        )
        return out


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _scan(pre, recurrent, first, step, active, keep=None):
    """Hidden states of sequences that run together, the longest first. Sequence s starts at row
    first[s] and goes on by `step`; at time t the first active[t] of them are not yet over."""
    size = recurrent.shape[0]
    h = np.zeros((len(first), size), dtype=np.float32)
    c = np.zeros_like(h)
    out = np.empty((len(pre), size), dtype=np.float32)
    for t, n in enumerate(active):
        rows = first[:n] + step * t
        z = pre[rows] + h[:n] @ recurrent
        gates = _sigmoid(z[:, : 3 * size])
        new = np.tanh(z[:, 3 * size :])
        before, last = c[:n].copy(), h[:n].copy()
        c[:n] = gates[:, size : 2 * size] * before + gates[:, :size] * new
        bent = np.tanh(c[:n])
        h[:n] = gates[:, 2 * size :] * bent
        out[rows] = h[:n]
        if keep is not None:
            keep.append((rows, gates, new, before, last, bent))
    return out


def _scan_back(grad_out, recurrent, kept, sequences):
    """Gradients of the sums before the gates, and of the recurrent weights."""
    size = recurrent.shape[0]
    dz = np.zeros((len(grad_out), 4 * size), dtype=np.float32)
    weights = np.zeros_like(recurrent)
    dh = np.zeros((sequences, size), dtype=np.float32)
    dc = np.zeros_like(dh)
    for rows, gates, new, before, last, bent in reversed(kept):
        n = len(rows)
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        grad = grad_out[rows] + dh[:n]
        cell = grad * o * (1 - bent * bent) + dc[:n]
        z = np.concatenate(
            [cell * new * i * (1 - i), cell * before * f * (1 - f), grad * bent * o * (1 - o), cell * i * (1 - new * new)],
            axis=1,
        )
        dz[rows] = z
        weights += last.T @ z
        dh[:n], dc[:n] = z @ recurrent.T, cell * f
    return dz, weights


def _active(length: np.ndarray) -> list[int]:
    """How many of the sequences, longest first, are not over at each time."""
    return (len(length) - np.searchsorted(length[::-1], np.arange(int(length.max(initial=0))), side="right")).tolist()


class Labeller:
    """The two directions' weights and the output; `fit` learns them, `judge` applies them."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {}
        for side in "fb":
            self.p[side + "w"] = rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            self.p[side + "u"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p[side + "b"] = np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)
            self.p[side + "v"] = rng.normal(0, 0.2, HIDDEN).astype(np.float32)
        self.p["c"] = np.zeros(1, dtype=np.float32)

    def _sides(self, first, length):
        return (("f", first, 1), ("b", first + length - 1, -1))

    def judge(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether each block is main text; `x` holds the pages one after the other."""
        order = np.argsort(-length, kind="stable")
        first, size = (np.cumsum(length) - length)[order], length[order]
        out = np.full(len(x), self.p["c"][0])
        for side, start, step in self._sides(first, size):
            p = {k[1:]: v for k, v in self.p.items() if k[0] == side}
            out += _scan(x @ p["w"] + p["b"], p["u"], start, step, _active(size)) @ p["v"]
        return out > 0

    def judge_long(self, slices, count: int) -> np.ndarray:
        """The same for one page whose vectors are made slice by slice: `slices(a, b)`."""
        out = np.full(count, self.p["c"][0])
        cuts = [(a, min(a + SLICE, count)) for a in range(0, count, SLICE)]
        for side, parts in (("f", cuts), ("b", cuts[::-1])):
            p = {k[1:]: v for k, v in self.p.items() if k[0] == side}
            h = c = np.zeros(HIDDEN, dtype=np.float32)
            for a, b in parts:
                pre = slices(a, b) @ p["w"] + p["b"]
                for k in range(b - a) if side == "f" else range(b - a - 1, -1, -1):
                    z = pre[k] + h @ p["u"]
                    gates = _sigmoid(z[: 3 * HIDDEN])
                    c = gates[HIDDEN : 2 * HIDDEN] * c + gates[:HIDDEN] * np.tanh(z[3 * HIDDEN :])
                    h = gates[2 * HIDDEN :] * np.tanh(c)
                    out[a + k] += h @ p["v"]
        return out > 0

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 3) -> Labeller:
        """`pages`: vectors and labels (1, 0, or -1 where unknown) of each; Adam on the log loss."""
        rng = np.random.default_rng(seed)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        steps, batches = 0, -(-len(pages) // 24)
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for part in np.array_split(order, batches):
                part = part[np.argsort([-len(pages[i][1]) for i in part], kind="stable")]
                x, y = (np.concatenate([pages[i][k] for i in part]) for k in (0, 1))
                length = np.array([len(pages[i][1]) for i in part])
                x[rng.random(len(x)) < WORDLESS, PATH + OWN : PATH + OWN + WORDS] = 0.0
                grads = self._gradients(x, y, np.cumsum(length) - length, length)
                steps += 1
                rate = 0.012 * (1 - epoch / epochs) + 0.001
                for k, g in grads.items():
                    g = np.clip(g, -1.0, 1.0)
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    step = (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6)
                    self.p[k] -= (rate * step).astype(np.float32)
        return self

    def _gradients(self, x, y, first, length):
        active, kept, hidden = _active(length), {}, {}
        out = np.full(len(x), self.p["c"][0])
        for side, start, step in self._sides(first, length):
            kept[side] = []
            pre = x @ self.p[side + "w"] + self.p[side + "b"]
            hidden[side] = _scan(pre, self.p[side + "u"], start, step, active, kept[side])
            out += hidden[side] @ self.p[side + "v"]
        known = y >= 0
        wrong = np.where(known, _sigmoid(out) - y, 0.0).astype(np.float32) / max(1, known.sum()) * 20
        grads = {"c": np.array([wrong.sum()], dtype=np.float32)}
        for side in "fb":
            grads[side + "v"] = hidden[side].T @ wrong
            back = wrong[:, None] * self.p[side + "v"][None, :]
            dz, grads[side + "u"] = _scan_back(back, self.p[side + "u"], kept[side], len(first))
            grads[side + "w"], grads[side + "b"] = x.T @ dz, dz.sum(axis=0)
        return grads


# Names and words that web pages use for their parts: the vocabulary of drawn layouts.
_NAMED = {
    "header": "header masthead top site-header page-header branding logo",
    "menu": "nav menu navbar main-menu topnav breadcrumbs navigation tabs",
    "notice": "cookie cookie-notice consent notice alert banner gdpr popup newsletter subscribe message",
    "advert": "ad ads advert advertisement sponsored promo ad-slot banner-ad adsbygoogle",
    "main": "content post entry story article article-body post-content main-content text body-text entry-content",
    "sidebar": "sidebar side widget related recommended popular aside more-stories rail",
    "form": "form search-form signup contact-form login search",
    "comments": "comments comment-list discussion responses reader-comments respond disqus",
    "footer": "footer bottom copyright site-footer legal foot colophon",
}
_TAGS = {
    "header": "header", "menu": "nav", "notice": "div", "advert": "div", "main": "article",
    "sidebar": "aside", "form": "form", "comments": "section", "footer": "footer",
}
_SAID = {
    "header": "Home Welcome Daily News Blog",
    "menu": "Home About Contact News Sport Archive Login Start Kontakt Accueil Inicio",
    "notice": "We use cookies Accept Privacy Subscribe to our newsletter Please enable JavaScript",
    "advert": "Advertisement Sponsored Buy now Offer Sale Anzeige Publicité Publicidad",
    "sidebar": "Related Popular Recent posts Tags Most read Archive",
    "form": "Search Email Password Send Submit Name Login Sign up",
    "comments": "Comments Reply says Posted by Report Like Anonymous",
    "footer": "© Copyright All rights reserved Privacy Terms Imprint Impressum ·",
}


class _Drawer:
    """Pages of drawn structure around given texts, with the label in an attribute."""

    def __init__(self, texts: list[str], seed: int):
        self.rng = np.random.default_rng(seed)
        self.words = [w for t in texts for w in t.split()][:50_000]
        # Invented words as well, so that few texts do not make their words a sign of main text.
        letters = np.array(list("etaoinsrhldcumfpgwybvk" + "éäßñ.,ETAS"))
        self.words += ["".join(self.rng.choice(letters, int(n))) for n in self.rng.integers(1, 10, INVENTED)]

    def chance(self, share: float) -> bool:
        return self.rng.random() < share

    def one(self, options):
        return options[int(self.rng.integers(len(options)))]

    def prose(self, most: int = 120) -> str:
        count = int(np.exp(self.rng.uniform(0, np.log(most)))) if self.chance(0.9) else 1
        at = int(self.rng.integers(len(self.words)))
        return entities.escape(" ".join(self.words[at : at + count]), quote=False) or "Word."

    def said(self, part: str) -> str:
        own = _SAID[part].split()
        at = int(self.rng.integers(len(own)))
        return self.one((self.prose(25), " ".join(own[at : at + int(self.rng.integers(1, 5))]), self.prose(4)))

    def open(self, part: str, bare: bool) -> tuple[str, str]:
        tag = self.one((_TAGS[part], "div", "div", "section")) if not bare else "div"
        mark = f' data-main="{int(part == "main")}"'
        if not bare and (tag != _TAGS[part] or tag == "div" or self.chance(0.3)):
            mark += f' {self.one(("class", "id", "class"))}="{self.one(_NAMED[part].split())}"'
        return f"<{tag}{mark}>", f"</{tag}>"

    def links(self, part: str) -> str:
        count = int(self.rng.integers(2, 9))
        item = lambda: f'<a href="/{self.prose(1)}">{self.said(part)}</a>'
        shape = self.one(("ul", "ul", "p", "span"))
        if shape == "ul":
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(count)) + "</ul>"
        return "".join(f"<{shape}>{item()}</{shape}>" for _ in range(count))

    def body(self, part: str) -> str:
        if part in ("header", "menu"):
            return (f"<h1>{self.said(part)}</h1>" if part == "header" and self.chance(0.5) else "") + self.links("menu")
        if part == "notice":
            return f"<p>{self.said(part)}</p>" * self.chance(0.8) + f"<button>{self.said(part)}</button>" + self.said(part)
        if part == "form":
            return f"<label>{self.said(part)}</label><input name=q><select><option>{self.said(part)}<option>{self.prose(2)}</select><button>{self.said(part)}</button>"
        if part == "comments":
            one = lambda: f'<div class="comment">{self.said(part)}<p>{self.prose()}</p></div>'
            return f"<h2>{self.said(part)}</h2>" + "".join(one() for _ in range(int(self.rng.integers(1, 6))))
        if part == "sidebar":
            return f"<h3>{self.said(part)}</h3>" + (self.links(part) if self.chance(0.6) else f"<p>{self.prose(60)}</p>")
        return self.said(part) if self.chance(0.5) else f"<p>{self.said(part)}</p>" + self.links(part) * self.chance(0.4)

    def main(self, bare: bool) -> str:
        begin, end = self.open("main", bare)
        out = [begin]
        title = self.prose(12)
        if self.chance(0.85):
            head = f"<{self.one(('h1', 'h1', 'h2'))}>{title}</h1>"
            out.append(f"<header>{head}</header>" if self.chance(0.1) and begin.startswith("<article") else head)
        if self.chance(0.4):
            out.append(f"<p><b>{title}<br>")
        again = self.prose() if self.chance(0.1) else None
        for _ in range(int(np.exp(self.rng.uniform(0, np.log(40))))):
            kind = self.rng.random()
            if kind < 0.8:
                out.append(f"<p>{again or self.prose()}" + "</p>" * self.chance(0.9))
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.prose(20)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.9:
                out.append(f"<h2>{self.prose(6)}</h2>")
            elif kind < 0.93:
                out.append(f"<blockquote>{self.prose(30)}</blockquote><pre>{self.prose(9)}</pre>")
            elif kind < 0.96:
                out.append(f"<table><tr><th>{self.prose(2)}<td>{self.prose(4)}</table>")
            elif not bare:
                out.append(self.part(self.one(("advert", "notice", "form", "sidebar")), False))
        if not bare and self.chance(0.15):
            out.append(self.part("comments", False))
        return "".join([*out, end])

    def part(self, name: str, bare: bool) -> str:
        begin, end = self.open(name, bare)
        return begin + self.body(name) + end

    def page(self) -> str:
        bare = self.chance(0.08)
        some = lambda name, share: [self.part(name, bare)] if self.chance(share) else []
        before = [x for n, s in (("notice", 0.3), ("header", 0.5), ("menu", 0.7), ("form", 0.2), ("advert", 0.45)) for x in some(n, s)]
        after = [x for n, s in (("sidebar", 0.4), ("advert", 0.2), ("comments", 0.4), ("form", 0.15), ("notice", 0.15), ("footer", 0.8)) for x in some(n, s)]
        early = [x for x in some("sidebar", 0.15)]
        wrap = self.one((("", ""), ("", ""), ("<div>", "</div>"), ('<div class="wrapper">', "</div>"), ("<div id=page>", "</div>"), ("<main>", "</main>")))
        head = "<html><head><title>x</title></head><body>"
        return head + "".join([*before, wrap[0], *early, self.main(bare), wrap[1], *after]) + "</body></html>"


def _labelled(pages: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """Vectors and labels of pages, at most `SLICE` blocks of each, and the texts of main blocks."""
    vectors, out, texts = Vectors(), [], []
    for page in pages:
        vectors.forget()
        found = blocks(page, vectors.paths)[:SLICE]
        label = np.array([vectors.paths.label[path] for _, path, _ in found])
        if (label >= 0).any():
            out.append((vectors.of(found), label))
        texts += [t for (t, _, _), y in zip(found, label) if y != 0]
    return out, texts


def fit(pages: DataFrame, html: str = "html") -> Labeller:
    """A labeller from a bounded sample of pages and drawn layouts of their texts."""
    usable = pages.select(F.col(html).alias("html")).where(F.length("html") <= SAMPLE_CHARS)
    total = pages.count()
    drawn = usable if total <= 4 * SAMPLE else usable.sample(min(1.0, 2 * SAMPLE / total), seed=5)
    sample = [r["html"] for r in drawn.limit(SAMPLE).collect()]
    real, texts = _labelled(sample)
    drawer = _Drawer(texts, seed=17)
    return Labeller().fit(real + _labelled([drawer.page() for _ in range(DRAWN)])[0])


def _extract_task(labeller: Labeller, keys: int):
    def flush(held, vectors):
        """Texts of the pages held; all their blocks together are few, or one page is long."""
        if len(held) == 1 and len(held[0]) > SLICE:
            page = held[0]
            main = labeller.judge_long(lambda a, b: vectors.of(page[a:b]), len(page))
        else:
            length = np.array([len(p) for p in held])
            main = labeller.judge(vectors.of([b for p in held for b in p]), length[length > 0])
        at = 0
        for page in held:
            yield "\n".join(b[0] for b, keep in zip(page, main[at : at + len(page)]) if keep)
            at += len(page)

    def task(batches):
        vectors = Vectors()
        for batch in batches:
            texts, held, size = [], [], 0
            for value in batch.column(keys):
                page = blocks(value.as_py() or "", vectors.paths)
                if held and size + len(page) > SLICE:
                    texts += flush(held, vectors)
                    held, size = [], 0
                held.append(page)
                size += len(page)
            texts += flush(held, vectors)
            vectors.forget()
            yield pa.record_batch(
                [*batch.columns[:keys], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*(f"k{i}" for i in range(keys)), "text", "n_chars"],
            )

    return task


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The columns `keep` of every page with its main `text` and `n_chars`, its code points."""
    labeller = fit(pages, html)
    keyed = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(html).alias("html"))
    kinds = ", ".join(f"k{i} {keyed.schema[i].dataType.simpleString()}" for i in range(len(keep)))
    found = words.map_arrow(keyed, _extract_task(labeller, len(keep)), f"{kinds}, text string, n_chars long")
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text", "n_chars")


def op12_recurrent_page_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
