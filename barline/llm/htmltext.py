"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

``blocks`` cuts a page into leaf blocks (text between block-level boundaries) with the tags, class and id words of their
ancestors. A block's features are those ancestors and properties of its text; the chain's labels are content and
boilerplate. The field is trained by maximum likelihood on ``TRAIN_PAGES`` labelled pages that a grammar of page layouts
writes (a documented bound: it doesn't depend on the table), and decoded by Viterbi in every task.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import per_row

TRAIN_PAGES, STEPS, RATE, L2, SEED = 600, 600, 1.0, 0.001, 11
TAG = re.compile(r"""<!--.*?(?:-->|\Z)
    |<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)
    |<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)
    |<[!?/][^>]*+(?:>|\Z)""", re.S | re.X)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")
#: Raw text up to the closing tag or, as browsers have it, the page's end.
RAW = set("script style title textarea xmp".split())
#: Left out up to the closing tag; without one, or closed in their own tag, they are ordinary elements.
ASIDE = set("noscript iframe noembed noframes template svg select".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark output q rp rt ruby s
    samp small span strike strong sub sup time tt u var wbr br math semantics mrow mi mn mo ms mtext mfrac msqrt mroot msup
    msub msubsup munder mover munderover mstyle mpadded mspace""".split())
#: A start tag of the key closes an open element of the value, if no element of the last set lies between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table body html article section div nav aside main header footer form".split())


@dataclass
class Block:
    text: str
    path: list[tuple[str, tuple[str, ...]]]
    linked: int


def _words_of(attrs: str) -> tuple[str, ...]:
    return tuple({w.lower() for m in NAMES.finditer(attrs) for w in NAME_WORD.findall(m[1] or m[2] or m[3] or "")})


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: references decoded, white space of a block squeezed, markup and raw elements gone."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                out.append(Block(text, [x for x in stack if x[0] not in INLINE],
                                 sum(len(p.strip()) for p, linked in parts if linked)))
            parts = []

    def pop_to(i: int) -> None:
        nonlocal links
        links -= sum(x[0] == "a" for x in stack[i:])
        del stack[i:]

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        upto = m.start() if m else len(page)
        if upto > at:
            parts.append((html.unescape(page[at:upto]), links > 0))
        if not m:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name or not m[0].endswith(">"):
            continue
        if m["close"] or m["close2"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name not in INLINE:
                        flush()
                    pop_to(i)
                    break
            else:
                if name == "p":
                    flush()
            continue
        own = (m["attrs"] or m["attrs2"] or "").endswith("/")
        if name in RAW or name in ASIDE and not own:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            close = page.find(">", end.end()) if end else -1
            if name in RAW or close >= 0:
                at = close + 1 if close >= 0 else len(page)
                continue
        if name == "br":
            parts.append((" ", False))
            continue
        if name not in INLINE:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] in CLOSES.get(name, ()):
                    pop_to(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        attrs = m["attrs"] or m["attrs2"] or ""
        if name not in VOID and not (attrs.endswith("/") and (name in INLINE or name in ASIDE)):
            stack.append((name, _words_of(attrs) if attrs else ()))
            links += name == "a"
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    """Feature names of each block: ancestors' tags and name words, tag, text shape, links, place on the page."""
    out = []
    for i, b in enumerate(found):
        words = b.text.count(" ") + 1
        dense = b.linked / len(b.text)
        tag = b.path[-1][0] if b.path else "none"
        f = {f"in={t}" for t, _ in b.path} | {f"name={w}" for _, ws in b.path for w in ws}
        f |= {f"tag={tag}", f"words={min(words.bit_length(), 7)}", f"links={0 if dense == 0 else 1 if dense < .5 else 2}",
              f"end={b.text[-1] in '.!?:;…'}", f"sign={'©' in b.text}", "bias"}
        if i == 0:
            f.add("first")
        if i == len(found) - 1:
            f.add("last")
        out.append(sorted(f))
    return out


class Field:
    """A trained field: weight per feature for content against boilerplate, and transitions."""

    def __init__(self, weights: dict[str, float], moves: list[list[float]]):
        self.weights, self.moves = weights, moves

    def decode(self, sequence: list[list[str]]) -> list[bool]:
        """Viterbi: the likeliest labels, True for content."""
        w, m = self.weights, self.moves
        off = on = 0.0
        back = []
        for i, names in enumerate(sequence):
            score = sum([w.get(f, 0.0) for f in names])
            if i:
                stay, enter = on + m[1][1], off + m[0][1]
                leave, keep = on + m[1][0], off + m[0][0]
                back.append((leave > keep, stay >= enter))
                off, on = max(leave, keep), max(stay, enter) + score
            else:
                on = score
        labels, last = [], on >= off
        for came_off, came_on in reversed(back):
            labels.append(last)
            last = came_on if last else came_off
        return ([*labels, last] if sequence else [])[::-1]


def train(pages: list[tuple[list[list[str]], list[bool]]], steps: int = STEPS, rate: float = RATE,
          l2: float = L2) -> Field:
    """Maximum conditional likelihood with a penalty on squares, by full-batch adaptive gradient steps.

    All chains are padded to one length and the forward and backward passes run over the positions for all at once.
    """
    index = {f: i for i, f in enumerate(sorted({f for seq, _ in pages for fs in seq for f in fs}))}
    n, length = len(pages), max(len(seq) for seq, _ in pages)
    rows, cols = [], []
    gold, real = np.zeros((n, length), dtype=int), np.zeros((n, length), dtype=bool)
    for p, (seq, labels) in enumerate(pages):
        for t, fs in enumerate(seq):
            rows += [p * length + t] * len(fs)
            cols += [index[f] for f in fs]
            gold[p, t], real[p, t] = labels[t], True
    rows, cols = np.array(rows), np.array(cols)
    w, m = np.zeros(len(index)), np.zeros((2, 2))
    gw, gm = np.full(len(index), 1e-8), np.full((2, 2), 1e-8)
    pairs = real[:, 1:]
    seen = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)])
    for _ in range(steps):
        node = np.zeros((n, length, 2))
        node[:, :, 1] = np.bincount(rows, w[cols], n * length).reshape(n, length)
        fore, rear = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        fore[:, 0] = node[:, 0]
        for t in range(1, length):
            step = np.logaddexp(fore[:, t - 1, :1] + m[0], fore[:, t - 1, 1:] + m[1]) + node[:, t]
            fore[:, t] = np.where(real[:, t, None], step, fore[:, t - 1])
        total = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
        for t in range(length - 2, -1, -1):
            ahead = rear[:, t + 1] + node[:, t + 1]
            step = np.logaddexp(ahead[:, :1] + m[:, 0], ahead[:, 1:] + m[:, 1])
            rear[:, t] = np.where(real[:, t + 1, None], step, 0)
        on = np.where(real, np.exp(np.minimum(fore[:, :, 1] + rear[:, :, 1] - total[:, None], 0)), 0)
        expected = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                s = fore[:, :-1, a] + m[a, b] + node[:, 1:, b] + rear[:, 1:, b] - total[:, None]
                expected[a, b] = np.exp(np.minimum(s, 0))[pairs].sum()
        slope = np.bincount(cols, ((gold == 1) & real).ravel()[rows] - on.ravel()[rows], len(index)) / n - l2 * w / n
        move = (seen - expected) / n - l2 * m / n
        gw += slope * slope
        gm += move * move
        w += rate * slope / np.sqrt(gw)
        m += rate * move / np.sqrt(gm)
    return Field({f: float(w[i]) for f, i in index.items()}, m.tolist())


# Layouts of the labelled pages: names that sites give to parts of a page (plain words, fixed values).
PARTS = {
    "menu": (["nav", "div", "ul"], "nav navbar navigation menu topnav breadcrumb breadcrumbs toc skip pagination"),
    "header": (["header", "div"], "header masthead site-header logo branding topbar page-header"),
    "footer": (["footer", "div"], "footer site-footer page-footer copyright colophon legal"),
    "sidebar": (["aside", "div", "section"], "sidebar side rail widget related recommended trending popular teaser"),
    "notice": (["div", "section", "p"], "notice cookie cookies consent gdpr alert popup modal overlay banner disclaimer"),
    "advert": (["div", "aside", "section"], "ad ads advert advertisement sponsor sponsored promo promotion adsense"),
    "form": (["form", "div"], "form newsletter subscribe signup login search register contact"),
    "comments": (["section", "div", "ol"], "comments comment replies reply discussion responses respond commentlist"),
    "share": (["div", "ul"], "share sharing social follow tags meta"),
}
CONTENT = ["article", "main", "div class=content", "div id=content", "div class=post-body", "div class=entry-content",
           "section class=article-body", "div class=story", "article class=post", "div id=main-text", "div class=text"]
SYLLABLES = "ka lo mi ren sta tu vor el an is de pra que shi on ber nal".split()


def labelled_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[str, list[bool]]]:
    """Pages of varied layouts with the label of each leaf block."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def words(k: int) -> str:
        s = " ".join("".join(pick(SYLLABLES) for _ in range(int(rng.integers(1, 4)))) for _ in range(max(1, k)))
        return s.capitalize()

    def sentence_block() -> str:
        k = int(2 ** rng.uniform(0, 6.5))
        return words(k) + pick([".", ".", ".", ".", "!", "?", "", ":"])

    def opened(spec: str) -> tuple[str, str]:
        tag, _, attr = spec.partition(" ")
        key, _, value = attr.partition("=")
        return (f'<{tag} {key}="{value}">' if attr else f"<{tag}>"), f"</{tag}>"

    out = []
    for _ in range(n):
        labels: list[bool] = []

        def put(text: str, label: bool) -> str:
            labels.append(label)
            return text

        def part(kind: str) -> str:
            tags, names = PARTS[kind]
            tag, name = pick(tags), pick(names.split())
            attr = f' {pick(["class", "class", "id"])}="{name}"' if tag in ("div", "section", "ul", "ol", "p") or \
                rng.random() < .5 else ""
            if tag == "p":
                return f"<p{attr}>{put(sentence_block(), False)}</p>"
            inner = ""
            for _ in range(int(rng.integers(1, 5))):
                style = "li" if tag in ("ul", "ol") else pick(["p", "a", "div", "bare", "h3", "li", "article"])
                if kind == "comments":
                    style = "li" if tag == "ol" else pick(["p", "div", "article"])
                if kind in ("menu", "share") or style == "a":
                    text = f'<a href="/x">{put(words(int(rng.integers(1, 4))), False)}</a>'
                    inner += f"<li>{text}</li>" if rng.random() < .7 or tag in ("ul", "ol") else f"<div>{text}</div>"
                elif style == "bare":
                    inner += f"<div>{put(pick(['', '© ']) + sentence_block(), False)}</div>"
                elif style == "article":
                    inner += f"<article><p>{put(sentence_block(), False)}</p></article>"
                else:
                    inner += f"<{style}>{put(pick(['', '', '© ']) + sentence_block(), False)}</{style}>"
            if kind == "form":
                inner += f"<label>{put(words(2), False)}</label>"
                return f"<form{attr}>{inner}</form>" if tag == "form" else f"<div{attr}><form>{inner}</form></div>"
            return f"<{tag}{attr}>{inner}</{tag}>"

        page, bare = "", rng.random() < .06
        for kind in ("header", "menu", "notice", "advert", "form", "share"):
            if not bare and rng.random() < .55:
                page += part(kind)
        if not bare and rng.random() < .2:
            page += part("sidebar")
        first, last = ("", "") if bare else opened(pick(CONTENT))
        if not bare and rng.random() < .25:
            page += "<main>"
        page += first
        if rng.random() < .8:
            page += f"<h1>{put(words(int(rng.integers(1, 10))), True)}</h1>"
        for _ in range(int(rng.integers(1, 10))):
            style = pick(["p"] * 9 + ["h2", "li", "blockquote", "div", "td", "pre", "figcaption", "section"])
            inner = put(sentence_block(), True)
            if rng.random() < .15:
                inner = f'<a href="/y">{inner}</a>' if rng.random() < .2 else f"<b>{inner}</b>"
            page += {"li": f"<ul><li>{inner}</li></ul>", "td": f"<table><tr><td>{inner}</td></tr></table>",
                     "section": f"<section><p>{inner}</p></section>", "figcaption": f"<figure><figcaption>{inner}"
                     "</figcaption></figure>"}.get(style, f"<{style}>{inner}</{style}>")
            if not bare and rng.random() < .12:
                page += part(pick(["advert", "sidebar", "form", "share", "notice"]))
        if not bare and rng.random() < .2:
            page += part("comments")
        page += last
        for kind in ("comments", "share", "sidebar", "advert", "form", "notice", "footer"):
            if not bare and rng.random() < .4:
                page += part(kind)
        out.append((f"<html><head><title>{words(3)}</title></head><body>{page}</body></html>", labels))
    return out


@functools.cache
def trained() -> Field:
    """The field of the labelled pages; the same in every run."""
    pages = []
    for page, labels in labelled_pages():
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError("a training page parses into other blocks than it was written with")
        pages.append((features(found), labels))
    return train(pages)


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    keep = field.decode(features(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page's main text.

    Null or empty pages, and pages without content, have the empty text. Null and repeated ids keep their rows; an
    empty table gives none; other columns are not read. Broken markup and pages cut short are read as far as they go.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def make():
        field = shared.value

        def fn(ids, urls, htmls):
            texts = [main_text(h, field) for h in htmls]
            return ids, urls, texts, list(map(len, texts))
        return fn
    return per_row(pages.select("page_id", "url", "html"), "page_id bigint, url string, text string, n_chars bigint", make)


#: DuckDB statement of the main text for pages laid out as the driver's: an article with h1 and p blocks, references
#: to the five characters below and no other markup inside it but b and br.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(p|h1)>'), lambda x: trim(regexp_replace(
  replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*(>|$)', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""
