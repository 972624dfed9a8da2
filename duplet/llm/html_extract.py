"""Main text of web pages: a bidirectional LSTM in numpy labels each leaf block with the whole page as its context.

A page is cut into leaf blocks: text between block-level tags, with the path of open tags and their class, id and role words. A
block's vector joins the mean vector of its hashed path, the mean vector of its hashed words, and a few shape features.
The network learns from pages that it invents by rule from a seed: boilerplate of many kinds around and inside articles, in
invented words, so that it relies on structure and shape, not on a vocabulary.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duplet.llm.common import map_arrow

# Element names of the HTML standard, by how they shape blocks.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg canvas textarea noframes xmp".split())
#: An opening tag of the key closes an open one of these, unless one of the BOUNDS lies between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
BOUNDS = frozenset("ul ol dl table select".split())
#: A parameter of the model: how many of the innermost block-level tags a block's path has.
LEVELS = 32
INLINE_ENDED_BY_BLOCK = frozenset("a abbr b cite code em font i mark q s small span strong sub sup time u".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: float = 0.0


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order: references decoded, white space in a block made one space, blank ones left out. Unclosed tags, cut tags and cut comments are taken as far as they go, however deep: a path has the LEVELS innermost ones."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    outer: list[tuple[str, tuple[str, ...]]] = []  # those of the stack that shape blocks
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(x for t, names in outer[-LEVELS:] for x in (t, *names)), min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if opened["a"]:
            linked += len(text)

    def close(i: int) -> None:
        gone = [t for t, _ in stack[i:]]
        opened.subtract(gone)
        del stack[i:]
        del outer[len(outer) - sum(t not in INLINE_ENDED_BY_BLOCK for t in gone) :]

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            if opened[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCK:
            flush()
            if opened["p"]:
                top = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p" or stack[i][0] not in INLINE_ENDED_BY_BLOCK)
                if stack[top][0] == "p":
                    close(top)
            if any(opened[t] for t in CLOSES.get(tag, ())):
                ends = CLOSES[tag] | BOUNDS
                top = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ends)
                if stack[top][0] in CLOSES[tag]:
                    close(top)
        elif tag == "br":
            parts.append(" ")
        if tag not in VOID:
            names = tuple(w.lower() for a in _NAMES.finditer(m[3]) for w in _WORDS.findall(a[1] or a[2] or a[3] or "")) if m[3] else ()
            stack.append((tag, names))
            if tag not in INLINE_ENDED_BY_BLOCK:
                outer.append(stack[-1])
            opened[tag] += 1
    flush()
    return out


PATHS, WORDS, PATH_DIM, WORD_DIM, SHAPE, HIDDEN = 2048, 512, 16, 4, 7, 16


@lru_cache(1 << 16)
def _hash(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


@lru_cache(1 << 12)
def _path_ids(path: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(_hash(x, PATHS) for x in (*path, *(f"{a}>{b}" for a, b in zip(path[:-1], path[1:], strict=True)), "$" + (path[-1] if path else "")))


def _shape(b: Block, i: int, n: int) -> list[float]:
    words = b.text.count(" ") + 1
    return [np.log1p(len(b.text)) / 6, min(words, 60) / 60, b.linked, float(b.text[-1] in ".!?…。"), i / n, sum(map(str.isdigit, b.text)) / len(b.text), float(words < 4)]


class Network:
    """Two LSTMs over the blocks of pages, one each way, and a logistic output. Padded batches, blocks first."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + SHAPE
        self.p = {"path": r.normal(0, 0.3, (PATHS, PATH_DIM)), "word": r.normal(0, 0.1, (WORDS, WORD_DIM)), "out": r.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
        for way in "fb":
            self.p["w" + way] = r.normal(0, 1 / np.sqrt(d + HIDDEN), (d + HIDDEN, 4 * HIDDEN))
            self.p["c" + way] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @staticmethod
    def batch(pages: list[list[Block]]) -> tuple:
        """(path ids, their cells), (word ids, their cells), shapes (T, B, SHAPE), mask (T, B); a cell is t * B + page."""
        t, n = max(map(len, pages)), len(pages)
        path, word = ([], []), ([], [])
        shape, mask = np.zeros((t, n, SHAPE), np.float32), np.zeros((t, n), np.float32)
        for j, page in enumerate(pages):
            for i, b in enumerate(page):
                ids = _path_ids(b.path)
                path[0].extend(ids)
                path[1].extend([i * n + j] * len(ids))
                few = [_hash(w, WORDS) for w in b.text.split()]
                word[0].extend(few)
                word[1].extend([i * n + j] * len(few))
                shape[i, j] = _shape(b, i, len(page))
                mask[i, j] = 1
        return tuple((np.array(a, np.int64), np.array(c, np.int64)) for a, c in (path, word)) + (shape, mask)

    @staticmethod
    def _mean(table: np.ndarray, ids: np.ndarray, cells: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        count = np.maximum(np.bincount(cells, minlength=size), 1).astype(np.float32)
        out = np.stack([np.bincount(cells, table[ids, k], minlength=size) for k in range(table.shape[1])], axis=1)
        return (out / count[:, None]).astype(np.float32), count

    def forward(self, path, word, shape, mask, keep: bool = False):
        t, n = mask.shape
        a, na = self._mean(self.p["path"], *path, t * n)
        b, nb = self._mean(self.p["word"], *word, t * n)
        x = np.concatenate([a.reshape(t, n, -1), b.reshape(t, n, -1), shape], axis=2)
        both, memory = [], {}
        for way in "fb":
            w, bias = self.p["w" + way], self.p["c" + way]
            from_x = x @ w[: x.shape[2]] + bias
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            hs, steps = np.zeros((t, n, HIDDEN), np.float32), []
            for i in range(t) if way == "f" else range(t - 1, -1, -1):
                z = from_x[i] + h @ w[x.shape[2] :]
                s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
                g = np.tanh(z[:, 3 * HIDDEN :])
                f, o, k = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
                m = mask[i][:, None]
                before = (h, c)
                fresh = f * c + k * g
                th = np.tanh(fresh)
                c = m * fresh + (1 - m) * c
                h = m * (o * th) + (1 - m) * h
                hs[i] = h
                if keep:
                    steps.append((i, before, f, o, k, g, th, m))
            both.append(hs)
            memory[way] = steps
        hidden = np.concatenate(both, axis=2)
        score = 1 / (1 + np.exp(-np.clip(hidden @ self.p["out"] + self.p["bias"], -30, 30)))
        return (score, x, hidden, memory, na, nb) if keep else score

    def step(self, path, word, shape, mask, labels, state: dict, rate: float) -> float:
        """One Adam step on cross entropy over the blocks of a batch; its loss."""
        score, x, hidden, memory, na, nb = self.forward(path, word, shape, mask, keep=True)
        total = mask.sum()
        d_score = (score - labels) * mask / total
        grads = {"out": np.einsum("tn,tnh->h", d_score, hidden), "bias": np.array([d_score.sum()])}
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            w = self.p["w" + way]
            gw, gb = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
            up = d_score[:, :, None] * self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            for i, (h0, c0), f, o, kk, g, th, m in reversed(memory[way]):
                dh = dh + up[i]
                live, rest = dh * m, dh * (1 - m)
                d_fresh = live * o * (1 - th**2) + dc * m
                z = np.concatenate([d_fresh * c0 * f * (1 - f), live * th * o * (1 - o), d_fresh * g * kk * (1 - kk), d_fresh * kk * (1 - g**2)], axis=1)
                gw[: x.shape[2]] += x[i].T @ z
                gw[x.shape[2] :] += h0.T @ z
                gb += z.sum(axis=0)
                dx[i] += z @ w[: x.shape[2]].T
                dh = z @ w[x.shape[2] :].T + rest
                dc = d_fresh * f + dc * (1 - m)
            grads["w" + way], grads["c" + way] = gw, gb
        flat = dx.reshape(-1, x.shape[2])
        for name, (ids, cells), count, lo, hi in (("path", path, na, 0, PATH_DIM), ("word", word, nb, PATH_DIM, PATH_DIM + WORD_DIM)):
            part = flat[cells, lo:hi] / count[cells][:, None]
            size = len(self.p[name])
            grads[name] = np.stack([np.bincount(ids, part[:, j], minlength=size) for j in range(hi - lo)], axis=1)
        state["n"] = state.get("n", 0) + 1
        for name, g in grads.items():
            m, v = state.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            state[name] = (m, v)
            self.p[name] = (self.p[name] - rate * (m / (1 - 0.9 ** state["n"])) / (np.sqrt(v / (1 - 0.99 ** state["n"])) + 1e-8)).astype(np.float32)
        p = np.clip(score, 1e-7, 1 - 1e-7)
        return float(-((labels * np.log(p) + (1 - labels) * np.log(1 - p)) * mask).sum() / total)

    def scores(self, pages: list[list[Block]], cells: int = 1 << 13) -> list[np.ndarray]:
        """For each page the probability of each block to belong to the main text. Pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            group = [order[at]]
            while at + len(group) < len(order) and len(pages[order[at + len(group)]]) * (len(group) + 1) <= cells:
                group.append(order[at + len(group)])
            score = self.forward(*self.batch([pages[i] for i in group]))
            for j, i in enumerate(group):
                out[i] = score[: len(pages[i]), j]
            at += len(group)
        return out


# ---- invented pages to learn from

_FRAMES = {
    "menu": ["nav", "ul.menu", "div#navigation", "div.topnav", "ul#main-menu", "div.breadcrumbs", "nav.pagination", "div.navbar"],
    "header": ["header", "div.header", "div#masthead", "div.site-header", "header.page-header", "div.logo"],
    "footer": ["footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.legal"],
    "side": ["aside", "div.sidebar", "div#sidebar", "aside.widget", "div.related", "section.recommended", "div.widget", "div.share", "div.social", "div.tags", "aside.most-read"],
    "advert": ["div.ad", "div.advert", "div.advertisement", "div.sponsored", "div#banner-ad", "aside.promo", "div.promo", "ins.ads", "section.sponsor", "div.ads"],
    "notice": ["div.notice", "div.cookie-banner", "div#cookie-notice", "div.alert", "div.consent", "div.popup", "div.modal", "dialog", "div.newsletter", "section.subscribe", "div.gdpr"],
    "form": ["form", "form.search", "form#login", "div.signup>form", "fieldset"],
    "comments": ["section.comments", "div#comments", "div.comment-list", "ol.commentlist", "div#disqus-thread", "section#responses>div.comment", "div.reader-comments"],
}
_MAIN = ["article", "main", "main>article", "div.content", "div#content", "div.post", "div.article-body", "div.entry-content", "section.article", "div#main>div.story", "article.post>div.body", "div.text", "div", "article>section", "div[role=main]"]


def _open(spec: str) -> tuple[str, str]:
    """<tags> and </tags> of a>b, each tag.class, tag#id or tag[role=x]."""
    tags, ends = [], []
    for one in spec.split(">"):
        m = re.fullmatch(r"(\w+)(?:([.#])([\w -]+)|\[role=(\w+)\])?", one)
        attr = f' role="{m[4]}"' if m[4] else f' {"class" if m[2] == "." else "id"}="{m[3]}"' if m[2] else ""
        tags.append(f"<{m[1]}{attr}>")
        ends.insert(0, f"</{m[1]}>")
    return "".join(tags), "".join(ends)


def invent(rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The blocks of an invented page and which of them are main text. Main text carries a mark that is cut again."""
    syllables = ["".join(rng.choice(list("bcdfghklmnprstvwz"), 1).tolist() + rng.choice(list("aeiouéäó"), 1).tolist() + rng.choice(list("nrstlmd"), int(rng.integers(0, 2))).tolist()) for _ in range(60)]
    word = lambda: "".join(syllables[i] for i in rng.integers(0, 60, int(rng.integers(1, 4))))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    sentence = lambda: words(4, 18).capitalize() + "."
    flip = lambda p: rng.random() < p
    close = lambda end: end if flip(0.85) else ""  # noqa: E731  pages are not always well formed
    mark = "\x02"

    def prose() -> str:
        text = " ".join(sentence() for _ in range(int(rng.integers(1, 6))))
        if flip(0.2):
            text += f' <a href="/x">{words(1, 4)}</a> {sentence()}'
        return f"<b>{text}" if flip(0.15) else f"<em>{words(1, 3)}</em> {text}" if flip(0.15) else text

    def furniture(kind: str) -> str:
        start, end = _open(str(rng.choice(_FRAMES[kind])))
        if kind in ("menu", "side", "header") and flip(0.75):
            items = [f'<a href="/{word()}">{words(1, 4)}</a>' for _ in range(int(rng.integers(1, 8)))]
            inner = "".join(f"<li>{x}</li>" for x in items) if "ul" in start or flip(0.5) else " ".join(items)
            inner = inner if "ul" in start or "<li>" not in inner else f"<ul>{inner}</ul>"
            if kind == "header" and flip(0.5):
                inner = f"<h1>{words(1, 4)}</h1>" + inner
            if kind == "side" and flip(0.5):
                inner = f"<h3>{words(1, 3)}</h3>" + inner
        elif kind == "footer":
            inner = f"&copy; {word()}.example {sentence()}" if flip(0.6) else f"<p>{sentence()}</p><ul><li><a>{words(1, 3)}</a></li></ul>"
        elif kind == "form":
            inner = f"<label>{words(1, 3)}</label><input><button>{word()}</button>" + (f"<p>{sentence()}</p>" if flip(0.4) else "")
        elif kind == "comments":
            each = [f'<div class="comment"><span class="author">{word()}</span><p>{sentence()} {sentence()}</p></div>' if flip(0.6) else f"<li><p>{sentence()}</p></li>" for _ in range(int(rng.integers(1, 6)))]
            inner = (f"<h3>{words(1, 3)}</h3>" if flip(0.5) else "") + "".join(each)
        else:
            inner = " ".join(sentence() for _ in range(int(rng.integers(1, 4))))
            inner = inner if flip(0.5) else f"<p>{inner}</p>"
            if flip(0.3):
                inner += f"<button>{word()}</button>"
        return start + inner + end

    body = [mark + words(2, 9)] if flip(0.85) else []
    body = [f"<h1>{x}{close('</h1>')}" for x in body]
    for _ in range(int(rng.integers(1, 12))):
        r = rng.random()
        body.append(
            f"<p>{mark}{prose()}{close('</p>')}" if r < 0.7
            else f"<h2>{mark}{words(1, 7)}</h2>" if r < 0.78
            else "<ul>" + "".join(f"<li>{mark}{words(2, 12)}{close('</li>')}" for _ in range(int(rng.integers(1, 5)))) + "</ul>" if r < 0.84
            else f"<blockquote><p>{mark}{sentence()}</p></blockquote>" if r < 0.88
            else f"<pre>{mark}{words(3, 12)}</pre>" if r < 0.9
            else "<table>" + "".join(f"<tr><td>{mark}{word()}</td><td>{mark}{rng.integers(1, 999)}</td></tr>" for _ in range(int(rng.integers(1, 4)))) + "</table>" if r < 0.93
            else f"<figure><img><figcaption>{mark}{sentence()}</figcaption></figure>" if r < 0.95
            else furniture(str(rng.choice(["advert", "side", "notice", "form"])))
        )
    start, end = _open(str(rng.choice(_MAIN)))
    main = start + "".join(body) + close(end)
    if start == "<div>" and flip(0.5):
        main = f"{mark}{prose()}" + main
    top = [furniture(k) for k in ("header", "menu", "notice", "advert", "form") if flip(0.45)]
    low = [furniture(k) for k in ("side", "comments", "advert", "form", "notice", "footer", "menu") if flip(0.4)]
    rng.shuffle(top)
    page = f"<html><head><title>{words(2, 8)}</title></head><body>" + "".join(top) + main + "".join(low)
    if flip(0.1):
        page = page[: int(rng.integers(len(page) // 3, len(page)))]
    found = blocks(page)
    truth = [int(mark in b.text) for b in found]
    for b in found:
        b.text = b.text.replace(mark, "").strip() or "-"
    return found, truth


@lru_cache(2)
def train(pages: int = 1600, epochs: int = 4, batch: int = 32, rate: float = 0.015, seed: int = 29) -> Network:
    """A network that learned from that many invented pages; the same arguments give the same network."""
    rng = np.random.default_rng(seed)
    made = [invent(rng) for _ in range(pages)]
    net, state, steps = Network(seed), {}, 0
    for _ in range(epochs):
        order = sorted(range(pages), key=lambda i: (len(made[i][0]), rng.random()))
        groups = [order[i : i + batch] for i in range(0, pages, batch)]
        rng.shuffle(groups)
        for g in groups:
            path, word, shape, mask = Network.batch([made[i][0] for i in g])
            labels = np.zeros_like(mask)
            for j, i in enumerate(g):
                labels[: len(made[i][1]), j] = made[i][1]
            net.step(path, word, shape, mask, labels, state, rate * (1 - steps / (epochs * len(groups))))
            steps += 1
    return net


def extract(pages: DataFrame, net: Network | None = None, threshold: float = 0.5) -> DataFrame:
    """(page_id, url, text, n_chars, blocks): the blocks of each whole page that score threshold or more, in page order, joined by two line feeds; n_chars counts code points, blocks counts those kept.

    Null and empty pages, and pages without main text: an empty text. Repeated rows: each by itself. No rows: no rows.
    Extra columns are left out. The network is of fixed size and travels with the task.
    """
    kept = pages.sparkSession.sparkContext.broadcast(net or train())

    def run(batches):
        for b in batches:
            found = [blocks(x or "") for x in b.column(2).to_pylist()]
            scores = kept.value.scores(found)
            picked = [[x.text for x, s in zip(page, score, strict=True) if s >= threshold] for page, score in zip(found, scores, strict=True)]
            texts = ["\n\n".join(x) for x in picked]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array([len(x) for x in picked], pa.int32())], ["page_id", "url", "text", "n_chars", "blocks"])

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long, blocks int").withColumn("text", F.coalesce("text", F.lit("")))
