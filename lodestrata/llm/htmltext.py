"""Main text of pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block is a vector: the mean of learnt vectors of the hashed marks on its
tag path, the mean of those of its hashed words, and a few numbers (length, links, place, punctuation). A
bidirectional LSTM in numpy reads the whole sequence both ways, so that every label depends on all of the page, and
a logistic output says main text or not. Blocks labelled main are joined in page order by a line feed.

The model is trained once a process on pages that ``synthetic_page`` makes from a seed: articles in many kinds of
markup among menus, headers, footers, sidebars, notices, adverts, forms, related links and reader comments.

Cases: a null or empty page and one without main blocks give an empty text; broken and truncated markup is read as
far as it goes; very long pages are read whole; repeated rows give equal results; empty tables give empty results;
other columns pass through untouched.
"""

from __future__ import annotations

import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import whole
from .pageparse import Block, blocks

MARKS, WORDS, WIDTH, HIDDEN = 2048, 4096, 12, 20
_WORD = re.compile(r"[^\W\d_]+")
RESULT = "struct<text: string, n_chars: bigint, n_blocks: int, n_kept: int>"


# --- training pages ---------------------------------------------------------------------------------------------


def _words(rng: random.Random, n: int, own: list[str]) -> str:
    return " ".join(rng.choice(own) for _ in range(n))


def _sentences(rng: random.Random, n: int, own: list[str]) -> str:
    return " ".join(_words(rng, rng.randint(1, 14), own).capitalize() + rng.choice(".....!?") for _ in range(n))


def _odd(rng: random.Random, own: list[str]) -> str:
    """Prose in forms that say nothing of its place: one word, one word over and over, very long, junk, or digits."""
    word = rng.choice(own)
    return rng.choice((
        lambda: word.capitalize() + rng.choice((".", "", "!!", ",")), lambda: word.capitalize() + ".", lambda: _words(rng, 2, own).capitalize() + ".", lambda: " ".join([rng.choice((word, word[:1]))] * rng.choice((2, 20, 200, 2000))), lambda: _sentences(rng, rng.choice((20, 60)), own),
        lambda: " ".join(w + rng.choice(("%%%", "***", "$$$", "###", "!!", "")) for w in _words(rng, rng.randint(2, 60), own).split()), lambda: " ".join(str(rng.randrange(10**6)) for _ in range(rng.randint(1, 9))),
        lambda: f"{word}@{word}.example.com {rng.getrandbits(64):x}",
    ))()


def _class(rng: random.Random, *names: str) -> str:
    name = rng.choice(names)
    name = rng.choice((name, f"site-{name}", f"{name}-box", f"{name} block", f"main {name}" if rng.random() < 0.1 else name))
    return rng.choice((f' class="{name}"', f' id="{name}"', f" class='{name}'"))


def _links(rng: random.Random, own: list[str]) -> str:
    items = [f'<a href="/{rng.choice(own)}">{_words(rng, rng.randint(1, 4), own)}</a>' for _ in range(rng.randint(2, 9))]
    return rng.choice((lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<p>{x}</p>" for x in items)))()


def _prose(rng: random.Random, own: list[str]) -> str:
    return f"<p>{_sentences(rng, rng.randint(1, 4), own)}</p>" if rng.random() < 0.5 else _sentences(rng, rng.randint(1, 3), own)


def _noise(rng: random.Random, own: list[str], kinds: str) -> str:
    """One piece of a page that isn't main text."""
    kind = rng.choice(kinds.split())
    body = _links(rng, own) if rng.random() < 0.4 else _prose(rng, own)
    if kind == "nav":
        return f"<nav>{_links(rng, own)}</nav>" if rng.random() < 0.6 else f"<div{_class(rng, 'nav', 'menu', 'navigation', 'breadcrumbs', 'navbar', 'toc')}>{_links(rng, own)}</div>"
    if kind == "header":
        inner = f"<{(h := rng.choice(('h1', 'h2', 'p', 'div')))}>{_words(rng, rng.randint(1, 6), own)}</{h}>" + (_links(rng, own) if rng.random() < 0.5 else "")
        return f"<header>{inner}</header>" if rng.random() < 0.7 else f"<div{_class(rng, 'header', 'masthead', 'banner', 'topbar')}>{inner}</div>"
    if kind == "footer":
        inner = rng.choice(("&copy; ", "Copyright ", "")) + rng.choice((f"{rng.choice(own)}.example &middot; ", "2024 ", "")) + body
        return f"<footer>{inner}</footer>" if rng.random() < 0.7 else f"<div{_class(rng, 'footer', 'copyright', 'colophon', 'bottom')}>{inner}</div>"
    if kind == "aside":
        return f"<aside{_class(rng, 'sidebar', 'rail', 'related') if rng.random() < 0.4 else ''}>{body}</aside>" if rng.random() < 0.6 else f"<div{_class(rng, 'sidebar', 'widget', 'related', 'recommended', 'trending', 'popular', 'rail', 'tags')}>{body}</div>"
    if kind == "notice":
        return f"<{(t := rng.choice(('div', 'section', 'p')))}{_class(rng, 'cookie', 'notice', 'consent', 'alert', 'gdpr', 'banner', 'newsletter', 'subscribe', 'popup', 'modal', 'paywall', 'warning')}>{_prose(rng, own) if t != 'p' else _sentences(rng, 2, own)}</{t}>"
    if kind == "ad":
        return f"<{(t := rng.choice(('div', 'section', 'aside', 'p')))}{_class(rng, 'ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'sponsor', 'banner')}>{_sentences(rng, rng.randint(1, 3), own)}</{t}>"
    if kind == "form":
        return f"<form{_class(rng, 'search', 'login', 'signup', 'contact') if rng.random() < 0.6 else ''}><label>{_words(rng, 2, own)}</label><input name=q><p>{_sentences(rng, 1, own)}</p><button>{_words(rng, 1, own)}</button></form>"
    if kind == "share":
        return f"<div{_class(rng, 'share', 'social', 'byline', 'meta', 'pagination', 'author')}>{_links(rng, own) if rng.random() < 0.6 else _words(rng, 5, own)}</div>"
    inner = "".join(rng.choice((f"<div class='comment'><b>{rng.choice(own)}</b><p>{_sentences(rng, rng.randint(1, 4), own)}</p></div>", f"<li>{_sentences(rng, rng.randint(1, 3), own)}</li>", f"<article><p>{_sentences(rng, rng.randint(1, 3), own)}</p></article>")) for _ in range(rng.randint(1, 5)))
    head = f"<h{(n := rng.randint(2, 4))}>{rng.choice(('Comments', _words(rng, 2, own)))}</h{n}>" if rng.random() < 0.5 else ""
    return f"<{(t := rng.choice(('section', 'div', 'ol', 'aside')))}{_class(rng, 'comments', 'comment', 'responses', 'discussion', 'replies', 'disqus')}>{head}{inner}</{t}>"


def _article(rng: random.Random, own: list[str]) -> list[str]:
    """The inner markup of an article, piece by piece."""
    out = [f"<h1>{_words(rng, rng.randint(2, 10), own)}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 8, 14))):
        kind = rng.random()
        if kind < 0.72:
            text = _odd(rng, own) if rng.random() < 0.35 else _sentences(rng, rng.choice((1, 1, 2, 4, 8)), own)
            if rng.random() < 0.15:
                text = f'<a href="/x">{text}</a>' if rng.random() < 0.15 else f"<b>{text}<br>"
            out.append(f"<p{_class(rng, 'lead', 'text', 'intro') if rng.random() < 0.1 else ''}>{text}" + ("</p>" if rng.random() < 0.85 else ""))
        elif kind < 0.82:
            out.append(f"<h{(n := rng.randint(2, 4))}>{_words(rng, rng.randint(1, 7), own)}</h{n}>")
        elif kind < 0.9:
            out.append(f"<{(t := rng.choice(('ul', 'ol')))}>" + "".join(f"<li>{_words(rng, rng.randint(1, 9), own)}</li>" for _ in range(rng.randint(1, 5))) + f"</{t}>")
        else:
            t = rng.choice(("blockquote", "pre", "figcaption", "div", "section", "td"))
            body = _sentences(rng, rng.randint(1, 3), own)
            out.append(f"<table><tr><td>{body}</td><td>{_words(rng, 2, own)}</td></tr></table>" if t == "td" else f"<{t}>{body}</{t}>")
    return out


def synthetic_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page and, for each of its blocks, whether it is main text."""
    letters = ["".join(rng.choice("abcdefghijklmnoprstuvwäéñöß") for _ in range(rng.randint(1, 3))) for _ in range(30)]
    own = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    if rng.random() < 0.3:
        own += "comments search about contact home share privacy terms login subscribe cookie read more news".split()
    inner = _article(rng, own)
    mark = "\x02"
    body = []
    for piece in inner:
        body.append(re.sub(r">(?=[^<])", ">" + mark, piece))
        if rng.random() < 0.06:
            body.append(_noise(rng, own, "ad share aside notice form"))
    if rng.random() < 0.12:
        body.append(_noise(rng, own, "comments share"))
    tag, names = rng.choice((("article", ""), ("article", ""), ("article", ""), ("main", ""), ("div", _class(rng, "content", "post", "entry", "article", "story", "text")), ("section", _class(rng, "content", "article", "post")), ("article", _class(rng, "post", "content", "entry")), ("div", "")))
    main = f"<{tag}{names}>{''.join(body)}</{tag}>"
    if rng.random() < 0.25:
        main = f"<{(t := rng.choice(('main', 'div')))}{_class(rng, 'wrapper', 'page', 'container', 'main') if t == 'div' else ''}>{main}{_noise(rng, own, 'aside comments') if rng.random() < 0.4 else ''}</{t}>"
    top = [_noise(rng, own, k) for k in ("nav header", "ad notice", "form aside nav", "header notice") if rng.random() < 0.55]
    rng.shuffle(top)
    bottom = [_noise(rng, own, k) for k in ("comments", "aside share ad", "notice form nav", "footer") if rng.random() < (0.8 if k == "footer" else 0.35)]
    page = f"<!DOCTYPE html><html><head><title>{_words(rng, 4, own)}</title><script>var a=1</script></head><body>{''.join(top)}{main}{''.join(bottom)}" + ("</body></html>" if rng.random() < 0.8 else "")
    found = blocks(page)
    labels = [mark in b.text for b in found]
    for b in found:
        b.text = " ".join(b.text.replace(mark, " ").split())
    return page.replace(mark, ""), [x for x, b in zip(labels, found, strict=True) if b.text]


# --- features ---------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1 << 16)
def _path(path: tuple[str, ...]) -> tuple[int, ...]:
    """Hashed marks of a path, those of its last element once more as such."""
    own = list(path)
    last = [f"@{path[-1]}"] if path else ["@"]
    return tuple(zlib.crc32(x.encode()) % MARKS for x in (*own, *last))


class _Hashed(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        return got


_HASHED = _Hashed()


def _numbers(sequence: list[Block], words: list[int]) -> np.ndarray:
    n = len(sequence)
    out = np.empty((n, 7))
    for i, (b, w) in enumerate(zip(sequence, words, strict=True)):
        size = len(b.text)
        out[i] = min(size, 2000) / 500, np.log1p(size) / 6, b.linked, b.text[-1] in ".!?…。", w / max(1, size) * 5, i / n, 1 / n
    return out


def encode(pages: list[list[Block]]) -> tuple[np.ndarray, ...]:
    """For all blocks of all pages: marks and their bounds, words and their bounds, numbers."""
    marks, mark_at, words, word_at, numbers = [], [0], [], [0], []
    for sequence in pages:
        counts = []
        for b in sequence:
            marks.extend(_path(b.path))
            mark_at.append(len(marks))
            own = _WORD.findall(b.text.lower())
            words.extend(map(_HASHED.__getitem__, own))
            if not own:
                words.append(0)
            word_at.append(len(words))
            counts.append(len(own))
        if sequence:
            numbers.append(_numbers(sequence, counts))
    return np.array(marks, np.int64), np.array(mark_at), np.array(words, np.int64), np.array(word_at), np.concatenate(numbers) if numbers else np.empty((0, 7))


def _means(table: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if len(bounds) < 2:
        return np.empty((0, table.shape[1]))
    return np.add.reduceat(table[ids], bounds[:-1], axis=0) / np.diff(bounds)[:, None]


# --- the network ------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(x: np.ndarray, alive: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states of one direction: x holds the input parts of the gates, time by page by 4 h."""
    steps, pages, _ = x.shape
    h = c = np.zeros((pages, HIDDEN))
    out = np.zeros((steps, pages, HIDDEN))
    kept = []
    for t in range(steps):
        z = x[t] + h @ u
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        new = f * c + i * g
        squashed = np.tanh(new)
        kept.append((h, c, i, f, o, g, squashed))
        on = alive[t][:, None]
        c, h = np.where(on, new, c), np.where(on, o * squashed, h)
        out[t] = h
    return out, kept


def _backward(d_out: np.ndarray, alive: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    steps, pages, _ = d_out.shape
    dx = np.zeros((steps, pages, 4 * HIDDEN))
    du = np.zeros_like(u)
    dh = dc = np.zeros((pages, HIDDEN))
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, squashed = kept[t]
        on = alive[t][:, None]
        total = dh + d_out[t]
        own = np.where(on, total, 0)
        cell = np.where(on, dc, 0) + own * o * (1 - squashed**2)
        dz = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), own * squashed * o * (1 - o), cell * i * (1 - g**2)], axis=1)
        dx[t] = dz
        du += h.T @ dz
        dh = dz @ u.T + np.where(on, 0, total)
        dc = np.where(on, cell * f, dc)
    return dx, du


class Labeller:
    """The bidirectional LSTM with its vectors for marks and words."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.rng = np.random.default_rng(seed + 1)
        width = 2 * WIDTH + 7
        self.p = {
            "marks": rng.normal(0, 0.3, (MARKS, WIDTH)), "words": rng.normal(0, 0.02, (WORDS, WIDTH)), "w1": rng.normal(0, width**-0.5, (width, 4 * HIDDEN)), "w2": rng.normal(0, width**-0.5, (width, 4 * HIDDEN)),
            "u1": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), "u2": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), "b1": np.zeros(4 * HIDDEN), "b2": np.zeros(4 * HIDDEN),
            "v": rng.normal(0, 0.1, 2 * HIDDEN + width), "c": np.zeros(1),
        }

    def run(self, pages: list[list[Block]], labels: list[list[bool]] | None = None) -> tuple[list[np.ndarray], dict | None]:
        """Chances of being main text, page by page; with labels, the gradients too."""
        p = self.p
        sizes = np.array([len(s) for s in pages])
        if not sizes.sum():
            return [np.empty(0) for _ in pages], None
        marks, mark_at, words, word_at, numbers = encode(pages)
        told = np.ones((len(numbers), 1))
        if labels is not None:  # half of the blocks are learnt without their words, which pages have in common by chance only
            told[self.rng.random(len(numbers)) < 0.5] = 0
        x = np.hstack([_means(p["marks"], marks, mark_at), _means(p["words"], words, word_at) * told, numbers])
        starts = np.cumsum(sizes) - sizes
        page = np.repeat(np.arange(len(pages)), sizes)
        step = np.arange(len(x)) - starts[page]
        back = sizes[page] - 1 - step
        steps = int(sizes.max())
        alive = np.arange(steps)[:, None] < sizes[None, :]
        states, keeps = [], []
        for w, u, b, place in ((p["w1"], p["u1"], p["b1"], step), (p["w2"], p["u2"], p["b2"], back)):
            gates = np.zeros((steps, len(pages), 4 * HIDDEN))
            gates[place, page] = x @ w + b
            out, kept = _forward(gates, alive, u)
            states.append(out[place, page])
            keeps.append(kept)
        seen = np.hstack([*states, x])
        chance = _sigmoid(seen @ p["v"] + p["c"])
        parts = np.split(chance, np.cumsum(sizes)[:-1])
        if labels is None:
            return parts, None
        y = np.concatenate([np.array(row, float) for row in labels])
        dz = (chance - y) / len(pages)
        grads = {"v": seen.T @ dz, "c": np.array([dz.sum()])}
        d_seen = dz[:, None] * p["v"]
        d_x = d_seen[:, 2 * HIDDEN :].copy()
        for n, (w, u, b, place) in enumerate((("w1", "u1", "b1", step), ("w2", "u2", "b2", back))):
            d_out = np.zeros((steps, len(pages), HIDDEN))
            d_out[place, page] = d_seen[:, n * HIDDEN : (n + 1) * HIDDEN]
            d_gates, grads[u] = _backward(d_out, alive, p[u], keeps[n])
            own = d_gates[place, page]
            grads[w], grads[b] = x.T @ own, own.sum(axis=0)
            d_x += own @ p[w].T
        d_x[:, WIDTH : 2 * WIDTH] *= told
        for name, ids, bounds, at in (("marks", marks, mark_at, 0), ("words", words, word_at, WIDTH)):
            counts = np.diff(bounds)
            grads[name] = np.zeros_like(p[name])
            np.add.at(grads[name], ids, np.repeat(d_x[:, at : at + WIDTH] / counts[:, None], counts, axis=0))
        return parts, grads

    def fit(self, pages: list[list[Block]], labels: list[list[bool]], epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 0) -> None:
        """Adam over shuffled batches, the rate falling to a tenth."""
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        rng = np.random.default_rng(seed)
        rounds, done = epochs * -(-len(pages) // batch), 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                _, grads = self.run([pages[i] for i in pick], [labels[i] for i in pick])
                done += 1
                now = rate * (1 - 0.9 * done / rounds)
                for k, g in (grads or {}).items():
                    g = np.clip(g, -1, 1)
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g**2 - second[k])
                    step = now * (first[k] / (1 - 0.9**done)) / (np.sqrt(second[k] / (1 - 0.99**done)) + 1e-8)
                    # Sums that differ in their last bits, as with other numbers of threads, give the same weights.
                    self.p[k] = np.round(self.p[k] - step, 6)

    def main_blocks(self, pages: list[list[Block]], batch: int = 256) -> list[list[str]]:
        """The texts of the blocks labelled main; pages of like length are read together."""
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        out: list[list[str]] = [[] for _ in pages]
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            for i, chance in zip(pick, self.run([pages[i] for i in pick])[0], strict=True):
                out[i] = [b.text for b, c in zip(pages[i], chance, strict=True) if c >= 0.5]
        return out


@lru_cache(maxsize=2)
def trained(pages: int = 1800, seed: int = 5, epochs: int = 8) -> Labeller:
    rng = random.Random(seed)
    made = [synthetic_page(rng) for _ in range(pages)]
    model = Labeller(seed)
    model.fit([blocks(p) for p, _ in made], [y for _, y in made], epochs)
    return model


def extract(model: Labeller, pages: list[str | None]) -> list[tuple[str, int, int]]:
    """Main text, number of blocks and number kept, page by page."""
    parsed = [blocks(p) for p in pages]
    return [("\n".join(kept), len(own), len(kept)) for own, kept in zip(parsed, model.main_blocks(parsed), strict=True)]


def main_text(model: Labeller, page: Column) -> Column:
    """A struct of text, n_chars, n_blocks and n_kept for a column of pages."""

    @F.arrow_udf(RESULT)
    def extracted(column: pa.Array) -> pa.Array:
        rows = []
        for at in range(0, len(column), 512):
            rows += [{"text": t, "n_chars": len(t), "n_blocks": n, "n_kept": k} for t, n, k in extract(model, column.slice(at, 512).to_pylist())]
        return pa.array(rows, pa.struct([("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int32()), ("n_kept", pa.int32())]))

    return extracted.asNondeterministic()(whole(page))
