"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Each leaf block is main text or not. Its features are the elements around it and the names in
their class, id and role attributes, pairs of neighbouring elements, and its text (length, share
of links, punctuation, capitals, digits, place on the page). Neighbouring blocks are linked by
transition weights. The weights are trained on pages whose blocks are labelled (gradient of the
log-likelihood by forward and backward sums, in numpy); a page is decoded by Viterbi.

The labelled pages come with the module (`training_pages`): layouts in many variants (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments around and inside articles of
several kinds of markup) filled with invented words, made from a seed; `PAGES` bounds them. `train`
takes any other labelled pages.

Rows: a null html is an empty page; a page without main text gives an empty text. Pages are read
whole. Repeated rows are read each. Text outside any element counts as a block. An empty table gives
an empty result. Extra columns are ignored. All work is in the task that reads the page; nothing is
shuffled.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import column
from .html_blocks import Block, blocks_of

PAGES = 1200
ROUNDS = 250
RATE = 0.1
PENALTY = 3e-5
SEED = 5

_WORDS = re.compile(r"\w+")
_STOPS = re.compile(r"[.!?…:;]")


def block_features(block: Block, place: int, count: int) -> list[str]:
    tags = [t for t in block.tags if t not in ("html", "body")]
    found = {f"in {t}" for t in tags}
    found.update(f"{a}>{b}" for a, b in zip(["body", *tags], tags))
    found.update(f"named {n}" for n in block.names)
    text = block.text
    words = len(_WORDS.findall(text))
    found.add(f"at {tags[-1] if tags else 'body'}")
    found.add(f"words {min(words, 255).bit_length()}")
    found.add(f"links {int(block.links * 4)}")
    found.add("stopped" if text[-1] in ".!?…\"”»" else "open")
    found.add(f"stops {min(len(_STOPS.findall(text)), 3)}")
    if any(c in text for c in "©®™»›"):
        found.add("sign")
    if sum(c.isdigit() for c in text) * 4 > len(text):
        found.add("digits")
    if text.isupper():
        found.add("capitals")
    found.add(f"part {min(3, 4 * place // max(count, 1))}")
    found.add(f"deep {min(len(tags), 6)}")
    return sorted(found)


class Chain:
    """Weights of features (main against other), and of neighbouring labels."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, step: np.ndarray):
        self.weights, self.start, self.step = weights, start, step

    def label(self, blocks: list[Block]) -> list[bool]:
        """The most likely labels of a page's blocks, by Viterbi."""
        if not blocks:
            return []
        get = self.weights.get
        (oo, om), (mo, mm) = self.step.tolist()
        back = []
        other, main = self.start.tolist()
        for i, b in enumerate(blocks):
            if i:
                a, c = other + oo, main + mo
                d, e = other + om, main + mm
                back.append((c > a, e > d))
                other, main = max(a, c), max(d, e)
            main += sum(get(f, 0.0) for f in block_features(b, i, len(blocks)))
        labels = [main > other]
        for pointers in reversed(back):
            labels.append(pointers[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[bool]]]) -> Chain:
    """Fit the chain to labelled pages, by full-batch Adam on the penalised log-likelihood."""
    numbers: dict[str, int] = {}
    lists = [[[numbers.setdefault(f, len(numbers)) for f in block_features(b, i, len(blocks))]
              for i, b in enumerate(blocks)] for blocks, _ in pages]
    n, steps = len(pages), max(map(len, lists))
    ends = np.array([len(p) for p in lists])
    where = np.array([(p, i) for p, page in enumerate(lists) for i in range(len(page))])
    flat = np.array([f for page in lists for b in page for f in b])
    owner = np.repeat(np.arange(len(where)), [len(b) for page in lists for b in page])
    gold = np.zeros((n, steps), np.int64)
    for p, (_, labels) in enumerate(pages):
        gold[p, :len(labels)] = labels
    there = np.arange(steps)[None, :] < ends[:, None]
    w, start, step = np.zeros(len(numbers)), np.zeros(2), np.zeros((2, 2))
    params = [w, start, step]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
    steps_gold = np.zeros((2, 2))
    for p in range(n):
        np.add.at(steps_gold, (gold[p, :ends[p] - 1], gold[p, 1:ends[p]]), 1)
    start_gold = np.bincount(gold[:, 0], minlength=2)
    for turn in range(1, ROUNDS + 1):
        emit = np.zeros((n, steps, 2))
        emit[where[:, 0], where[:, 1], 1] = np.bincount(owner, w[flat], len(where))
        ahead = np.zeros((n, steps, 2))
        ahead[:, 0] = start + emit[:, 0]
        for t in range(1, steps):
            new = np.logaddexp.reduce(ahead[:, t - 1, :, None] + step, axis=1) + emit[:, t]
            ahead[:, t] = np.where(there[:, t, None], new, ahead[:, t - 1])
        whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
        after = np.zeros((n, steps, 2))
        for t in range(steps - 2, -1, -1):
            new = np.logaddexp.reduce(step + (emit[:, t + 1] + after[:, t + 1])[:, None], axis=2)
            after[:, t] = np.where(there[:, t + 1, None], new, 0.0)
        odds = np.exp(ahead + after - whole[:, None, None])
        both = np.exp(ahead[:, :-1, :, None] + step + (emit[:, 1:] + after[:, 1:])[:, :, None]
                      - whole[:, None, None, None]) * there[:, 1:, None, None]
        miss = (odds[..., 1] - gold)[where[:, 0], where[:, 1]]
        slopes = [np.bincount(flat, miss[owner], len(numbers)) / n + PENALTY * w,
                  (odds[:, 0].sum(0) - start_gold) / n,
                  (both.sum((0, 1)) - steps_gold) / n + PENALTY * step]
        for x, g, (m, v) in zip(params, slopes, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.99 ** turn)) + 1e-8)
    return Chain({f: float(w[i]) for f, i in numbers.items()}, start, step)


class _Maker:
    """One labelled page after the other, from a seed."""

    SYLLABLES = "ba de ki lo mu ra se ti no pa ve lu go ne ri sa tu vo me la ka so pi du fe".split()

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.labels: dict[str, bool] = {}

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(self.SYLLABLES) for _ in range(r.randint(1, 4)))
                        for _ in range(r.randint(low, high)))

    def say(self, main: bool, low: int, high: int, stop: float = 0.9) -> str:
        """A text of one label, never used with the other."""
        r = self.r
        while True:
            if high > 12:
                text, n = "", r.randint(low, high)
                while n > 0:
                    k = min(n, r.randint(1, 18))
                    text += self.words(k, k).capitalize() + r.choice(".....!?") + " "
                    n -= k
            else:
                text = self.words(low, high).capitalize() + ("." if r.random() < stop else "")
            if not main and r.random() < 0.1:
                text = r.choice(["© ", "» ", "2024 ", "| "]) + text
            text = text.strip()
            if self.labels.setdefault(text, main) == main:
                return escape(text, quote=False)

    def linked(self) -> str:
        """A paragraph of the article with a link in it."""
        text, link = self.words(4, 9).capitalize(), self.words(1, 4)
        self.labels[f"{text} {link}."] = True
        return f'<p>{text} <a href="/{link[:2]}">{link}</a>.</p>'

    def named(self, *names: str) -> str:
        """An attribute with one of the names, sometimes with more around it."""
        r = self.r
        if r.random() < 0.04:
            return ""
        name = r.choice(names)
        name = r.choice([name, name, name, f"{name}-{self.words(1, 1)}", f"{self.words(1, 1)} {name}",
                         f"site-{name}", f"{name}-wrap", f"main {name}" if r.random() < 0.1 else name])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def any(self, *makers):
        return self.r.choice(makers)()

    def items(self, low: int, high: int, linked: bool = True) -> str:
        make = lambda: self.say(False, 1, 4, 0.1)
        return "".join(f'<li><a href="/{i}">{make()}</a></li>' if linked else f"<li>{make()}</li>"
                       for i in range(self.r.randint(low, high)))

    def menu(self) -> str:
        links = f"<ul>{self.items(3, 9)}</ul>"
        if self.r.random() < 0.3:
            links = " ".join(f'<a href="#">{self.say(False, 1, 3, 0.1)}</a>' for _ in range(1))
        return self.any(lambda: f"<nav{self.named('nav', 'menu', 'navigation')}>{links}</nav>",
                        lambda: f"<nav>{links}</nav>",
                        lambda: f"<div{self.named('menu', 'nav', 'navbar', 'breadcrumb', 'breadcrumbs')}>{links}</div>")

    def header(self) -> str:
        inner = f"<h2>{self.say(False, 1, 5, 0.1)}</h2>" if self.r.random() < 0.5 else ""
        inner += f"<p>{self.say(False, 2, 9, 0.3)}</p>" if self.r.random() < 0.5 else \
            f"<a href='/'>{self.say(False, 1, 3, 0)}</a>"
        return self.any(lambda: f"<header{self.named('header', 'masthead', 'top')}>{inner}</header>",
                        lambda: f"<header>{inner}{self.menu()}</header>",
                        lambda: f"<div{self.named('header', 'masthead', 'banner', 'topbar')}>{inner}</div>")

    def footer(self) -> str:
        inner = self.any(lambda: self.say(False, 4, 30), lambda: f"<p>{self.say(False, 3, 40)}</p>",
                         lambda: f"<ul>{self.items(2, 6)}</ul><p>{self.say(False, 3, 9)}</p>",
                         lambda: f"&copy; {self.say(False, 2, 9)}")
        return self.any(lambda: f"<footer>{inner}</footer>",
                        lambda: f"<footer{self.named('footer', 'bottom')}>{inner}</footer>",
                        lambda: f"<div{self.named('footer', 'copyright', 'legal', 'bottom')}>{inner}</div>")

    def sidebar(self) -> str:
        inner = f"<h3>{self.say(False, 1, 4, 0.1)}</h3>" + self.any(
            lambda: f"<ul>{self.items(2, 7)}</ul>", lambda: f"<p>{self.say(False, 5, 60)}</p>")
        return self.any(lambda: f"<aside>{inner}</aside>",
                        lambda: f"<aside{self.named('sidebar', 'related', 'widget')}>{inner}</aside>",
                        lambda: f"<div{self.named('sidebar', 'widget', 'related', 'recommended', 'share', 'social')}>{inner}</div>",
                        lambda: f"<section{self.named('related', 'sidebar', 'more', 'popular')}>{inner}</section>")

    def notice(self) -> str:
        inner = self.any(lambda: f"<p>{self.say(False, 5, 40)}</p>", lambda: self.say(False, 4, 30),
                         lambda: f"<p>{self.say(False, 5, 30)}</p><button>{self.say(False, 1, 2, 0)}</button>")
        return f"<{(t := self.r.choice(['div', 'div', 'section', 'aside']))}{self.named('notice', 'cookie', 'cookies', 'consent', 'alert', 'warning', 'banner', 'popup', 'modal', 'gdpr', 'message')}>{inner}</{t}>"

    def advert(self) -> str:
        inner = self.any(lambda: self.say(False, 4, 30), lambda: f"<p>{self.say(False, 4, 40)}</p>",
                         lambda: f'<a href="#">{self.say(False, 2, 12)}</a>')
        return f"<{(t := self.r.choice(['div', 'div', 'div', 'aside', 'section']))}{self.named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'sponsor', 'adbox')}>{inner}</{t}>"

    def form(self) -> str:
        inner = f"<label>{self.say(False, 1, 4, 0.1)}</label><input><button>{self.say(False, 1, 2, 0)}</button>"
        if self.r.random() < 0.5:
            inner = f"<p>{self.say(False, 4, 30)}</p>" + inner
        return self.any(lambda: f"<form>{inner}</form>",
                        lambda: f"<form{self.named('search', 'newsletter', 'subscribe', 'login')}>{inner}</form>",
                        lambda: f"<div{self.named('newsletter', 'subscribe', 'signup')}><form>{inner}</form></div>")

    def comments(self) -> str:
        r = self.r
        def one() -> str:
            inner = self.any(lambda: f"<p>{self.say(False, 3, 60)}</p>", lambda: self.say(False, 3, 40),
                             lambda: f"<b>{self.say(False, 1, 2, 0)}</b><p>{self.say(False, 3, 60)}</p>")
            return self.any(lambda: f"<div{self.named('comment', 'reply', 'response')}>{inner}</div>",
                            lambda: f"<article{self.named('comment')}>{inner}</article>",
                            lambda: f"<li>{inner}</li>", lambda: inner)
        every = "".join(one() for _ in range(r.randint(1, 5)))
        title = f"<h3>{self.say(False, 1, 3, 0.1)}</h3>" if r.random() < 0.6 else ""
        return f"<{(t := r.choice(['section', 'div', 'ol', 'ul', 'div']))}{self.named('comments', 'comment', 'discussion', 'responses', 'replies', 'disqus', 'thread')}>{title}{every}</{t}>"

    def article(self, inside: bool) -> str:
        r, out = self.r, []
        title = f"<h1>{self.say(True, 2, 12, 0.3)}</h1>"
        out.append(f"<header>{title}</header>" if r.random() < 0.15 and inside else
                   title if r.random() < 0.85 else "")
        for _ in range(r.choice([1, 2, 3, 4, 6, 8, 12])):
            out.append(r.choices([
                lambda: f"<p>{self.say(True, 1, 120)}</p>", lambda: f"<p>{self.say(True, 1, 6, 0.8)}</p>",
                lambda: f"<p>{self.say(True, 5, 80)}<br>", lambda: f"<p><b>{self.say(True, 1, 60)}<br>",
                lambda: f"<h2>{self.say(True, 1, 8, 0.2)}</h2>",
                lambda: f"<ul>{''.join(f'<li>{self.say(True, 1, 20)}</li>' for _ in range(r.randint(1, 5)))}</ul>",
                lambda: f"<blockquote>{self.say(True, 3, 60)}</blockquote>",
                lambda: f"<table><tr><td>{self.say(True, 1, 4, 0.2)}</td><td>{self.say(True, 1, 5, 0.2)}</td></tr></table>",
                lambda: f"<pre>{self.say(True, 3, 30)}</pre>", lambda: f"<div>{self.say(True, 5, 90)}</div>",
                lambda: f"<figure><img><figcaption>{self.say(True, 2, 15)}</figcaption></figure>",
                self.linked,
            ], [12, 4, 2, 4, 3, 2, 1, 1, 1, 2, 1, 2])[0]())
            if r.random() < 0.25:
                out.append(self.any(self.advert, self.notice, self.sidebar, self.form))
        if r.random() < 0.15:
            out.append(self.comments())
        return "".join(out)

    def page(self) -> str:
        r = self.r
        box = lambda inner: self.any(
            lambda: f"<article>{inner}</article>", lambda: f"<article>{inner}</article>",
            lambda: f"<article{self.named('post', 'story', 'entry', 'article')}>{inner}</article>",
            lambda: f"<main><article>{inner}</article></main>", lambda: f"<main>{inner}</main>",
            lambda: f"<div{self.named('content', 'article', 'post', 'story', 'entry', 'body', 'text')}>{inner}</div>",
            lambda: f"<main{self.named('content', 'main')}><div{self.named('post', 'entry', 'article')}>{inner}</div></main>",
            lambda: f"<section{self.named('content', 'article', 'story')}>{inner}</section>",
            lambda: inner)
        before = r.sample([self.menu, self.header, self.notice, self.advert, self.form, self.sidebar],
                          r.randint(0, 4))
        behind = r.sample([self.comments, self.footer, self.sidebar, self.advert, self.form,
                           self.notice, self.menu], r.randint(0, 4))
        body = "".join(m() for m in before) + (box(self.article(True)) if r.random() < 0.96 else "") \
            + "".join(m() for m in behind) + (self.footer() if r.random() < 0.7 else "")
        if r.random() < 0.2:
            body = f"<div{self.named('page', 'wrapper', 'container', 'site')}>{body}</div>"
        tail = "</body></html>" if r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}{tail}"


def training_pages(pages: int = PAGES, seed: int = SEED) -> list[tuple[list[Block], list[bool]]]:
    """Labelled pages: the blocks of each, and whether each block is main text."""
    maker, out = _Maker(seed), []
    while len(out) < pages:
        blocks = blocks_of(maker.page())
        # A block that runs two texts together (inline neighbours) has the label of its first.
        known = [next((v for v in (maker.labels.get(b.text),) if v is not None), None)
                 for b in blocks]
        if blocks and all(k is not None for k in known):
            out.append((blocks, known))
    return out


def main_text(html: str | None, chain: Chain) -> str:
    blocks = blocks_of(html or "")
    return " ".join(b.text for b, main in zip(blocks, chain.label(blocks)) if main)


@lru_cache(maxsize=1)
def default_chain() -> Chain:
    return train(training_pages())


def extract(pages: DataFrame, chain: Chain | None = None, html: str = "html",
            page_id: str = "page_id") -> DataFrame:
    """`page_id`, `text`, `blocks` (of the page) and `main_blocks` of every row."""
    cell = pages.sparkSession.sparkContext.broadcast(chain or default_chain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, mains = [], [], []
            for value in batch.column(1):
                blocks = blocks_of(value.as_py() or "")
                labels = cell.value.label(blocks)
                texts.append(" ".join(b.text for b, main in zip(blocks, labels) if main))
                counts.append(len(blocks))
                mains.append(sum(labels))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                 pa.array(mains, pa.int64()), batch.column(2)],
                names=["page_id", "text", "blocks", "main_blocks", "url"])

    url = column("url") if "url" in pages.columns else F.lit(None)
    return pages.select(column(page_id).cast("long").alias("page_id"),
                        column(html).cast("string").alias("html"),
                        url.cast("string").alias("url")).mapInArrow(
        run, "page_id long, text string, blocks long, main_blocks long, url string")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).select("page_id", "url", "text",
                                 F.length("text").cast("long").alias("n_chars"))
