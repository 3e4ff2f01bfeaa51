"""Operator 6, main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read once into leaf blocks: runs of text between the tags of block elements, each with its open ancestors.
Scripts, styles, markup, comments of the markup, titles, selections and drawings are no text; what stands inside noscript,
object, canvas, video or audio is text like any other.  A block's features are its
ancestors' tags and kinds (from words in class, id and role), its own tag, and its text: length, share of linked text,
closing punctuation, signs.  The field has two labels, main text and the rest; weights of features and of label pairs
are fitted by gradient steps on the log-likelihood (forward-backward) of labelled pages, and Viterbi decodes.

Labelled pages come from ``labelled_pages``: a seeded generator of pages in many layouts, where every block carries its
label.  Training is small (``PAGES`` pages), on the driver, and reads nothing from the table.

Scale: a narrow pass; weights are broadcast (their number depends on the fixed feature names only).

Defined cases: null or empty html has an empty text; character references are decoded, white space (of any kind)
inside a block becomes one space, ``br`` is white space; blocks are joined in page order by two newlines; broken markup is read as far as
it goes (unknown end tags are skipped; an unclosed comment, script, style, title or text area runs to the end, any other
element without its end tag hides nothing); formulas are text, but not their annotations; other columns are left behind or
carried along, one named ``text`` or ``n_chars`` is replaced.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cadenza.llm.common import CHUNK_BYTES, text_batches

PAGES, EPOCHS, SEED = 400, 6, 42

# Element kinds of HTML.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - {"body", "html", "button", "label", "caption", "dd", "dt", "li", "legend", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LIMIT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}}
MEANING = set("article aside blockquote details dialog figure footer form header main menu nav search section table".split())
KINDS = {
    "main": "article body content entry main maincontent post story text prose paragraph",
    "menu": "breadcrumb breadcrumbs links menu nav navbar navigation navlist pager pagination tabs toc toolbar topbar",
    "head": "banner branding brand header logo masthead sitehead title-bar",
    "foot": "bottom colophon copyright foot footer legal",
    "side": "aside complementary recent rail related recommended sidebar side widget widgets",
    "advert": "ad ads adbox adslot advert advertisement adverts advertising outbrain promo promoted promotion sponsor sponsored taboola",
    "notice": "alert bar consent cookie cookies dialog disclaimer gdpr modal newsletter notice notification overlay paywall popup privacy signup subscribe subscription warning",
    "reader": "comment commentlist comments discussion disqus feedback replies reply respond responses reviews thread",
    "share": "author-box byline follow meta metadata share sharing social tags toolbox",
    "form": "contactform form login register search searchbox searchform",
}
_KIND = {w: k for k, words in KINDS.items() for w in words.split()}

#: Elements whose content is no text of the page; those of RAW_TEXT hold text alone and run to the end of the page if they do not end.
HIDDEN = "script style template textarea title select svg annotation-xml annotation iframe".split()
RAW_TEXT, FOREIGN = {"script", "style", "title", "textarea"}, {"svg", "annotation", "annotation-xml"}
_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in HIDDEN}
_SCAN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<raw>" + "|".join(HIDDEN) + r")(?=[\s/>])(?:[^>=]++|=\s*\"[^\"]*+\"|=\s*'[^']*+'|=)*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_LABEL = re.compile(r"data-label=[\"']?([01])")
_WORDS = re.compile(r"[a-z]+(?:-[a-z]+)?")


def _kinds(rest: str) -> set[str]:
    found = set()
    for m in _NAMED.finditer(rest):
        for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower()):
            for x in (w, *w.split("-")):
                if x in _KIND:
                    found.add(_KIND[x])
    return found


class Block:
    __slots__ = ("frames", "label", "linked", "text")

    def __init__(self, frames, text, linked, label):
        self.frames, self.text, self.linked, self.label = frames, text, linked, label


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, those without text left out."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], str | None]] = []
    parts: list[str] = []
    linked, link = 0, 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                label = next((f[2] for f in reversed(stack) if f[2] is not None), "0")
                out.append(Block(tuple(stack), text, linked, int(label)))
            parts.clear()
        linked = 0

    def close(names, limit=()):
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in limit:
                return

    endless: set[str] = set()  # names without an end tag from here on

    def past(name, m):
        """The end of a hidden element."""
        if name in FOREIGN and m[0].endswith("/>"):
            return m.end()
        if name not in endless:
            end = _END[name].search(page, m.end())
            if end:
                return end.end()
            endless.add(name)
        return len(page) if name in RAW_TEXT else m.end()

    at = 0
    while m := _SCAN.search(page, at):
        if m.start() > at:
            t = page[at : m.start()]
            parts.append(entities.unescape(t) if "&" in t else t)
            if link:
                linked += len(t)
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["raw"]:
                at = past(m["raw"].lower(), m)
                parts.append(" ")
            continue
        tag, end, rest = tag.lower(), m["end"] or m["end2"], m["rest"] or ""
        if tag in BLOCK:
            flush()
            link = 0
            if end:
                close({tag})
                continue
            if tag in CLOSES_P:
                close({"p"}, BLOCK - {"p"})
            if tag in SAME:
                close(SAME[tag], LIMIT[tag])
            label = _LABEL.search(rest)
            stack.append((tag, frozenset(_kinds(rest)) if rest else frozenset(), label[1] if label else None))
        elif tag == "a":
            link = 0 if end else 1
        elif tag in ("br", "hr", "img", "input", "option"):
            if tag == "hr":
                flush()
            else:
                parts.append(" ")
    if at < len(page):
        parts.append(entities.unescape(page[at:]))
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    out, n = [], len(found)
    for i, b in enumerate(found):
        f = ["bias"]
        near = near_kind = None
        for tag, kinds, _ in b.frames:
            if tag in MEANING:
                f.append(f"in:{tag}")
                near = tag
            for k in kinds:
                f.append(f"kind:{k}")
            if kinds or tag in MEANING:
                near_kind = min(kinds) if kinds else tag
        f.append(f"near:{near}")
        f.append(f"last:{near_kind}")
        own = b.frames[-1][0] if b.frames else "none"
        f.append(f"own:{own}")
        words = b.text.count(" ") + 1
        size = min(words.bit_length(), 7)
        f.append(f"words:{size}")
        share = 0 if not b.linked else 1 if b.linked * 2 < len(b.text) else 2
        f.append(f"linked:{share}")
        f.append(f"own:{own}/linked:{share}")
        if b.text[-1] in ".!?…\"”»)。！？":
            f.append("stop")
            if words > 8:
                f.append("sentence")
        if "©" in b.text or "(c)" in b.text.lower():
            f.append("copyright")
        if "|" in b.text or "·" in b.text or "»" in b.text:
            f.append("divider")
        if i == 0:
            f.append("first")
        if i == n - 1:
            f.append("final")
        if not near and not near_kind:
            f.append(f"plain/words:{size}/linked:{share}")
        out.append(list(dict.fromkeys(f)))
    return out


class Field:
    """Weights of features for main text against the rest, and of pairs of neighbouring labels."""

    def __init__(self):
        self.w: dict[str, float] = {}
        self.pair = np.zeros((2, 2))

    def emissions(self, feats: list[list[str]]) -> list[float]:
        get = self.w.get
        return [sum(get(x, 0.0) for x in f) for f in feats]

    def decode(self, feats: list[list[str]]) -> list[int]:
        """Viterbi."""
        e = self.emissions(feats)
        if not e:
            return []
        (p00, p01), (p10, p11) = self.pair.tolist()
        a, b, back = 0.0, e[0], []
        for x in e[1:]:
            t0, t1 = a + p00 >= b + p10, a + p01 > b + p11
            back.append((0 if t0 else 1, 0 if t1 else 1))
            a, b = (a + p00 if t0 else b + p10), (a + p01 if t1 else b + p11) + x
        y = [int(b > a)]
        for k in reversed(back):
            y.append(k[y[-1]])
        return y[::-1]

    def expected(self, e: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward: chance of label 1 at each block, and expected counts of label pairs."""
        n = len(e)
        score = np.zeros((n, 2))
        score[:, 1] = e
        fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
        fwd[0] = score[0]
        for t in range(1, n):
            x = fwd[t - 1][:, None] + self.pair
            top = x.max(axis=0)
            fwd[t] = top + np.log(np.exp(x - top).sum(axis=0)) + score[t]
        for t in range(n - 2, -1, -1):
            x = self.pair + (score[t + 1] + bwd[t + 1])[None, :]
            top = x.max(axis=1)
            bwd[t] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
        z = np.logaddexp(*fwd[-1])
        pairs = np.zeros((2, 2))
        for t in range(1, n):
            pairs += np.exp(fwd[t - 1][:, None] + self.pair + (score[t] + bwd[t])[None, :] - z)
        return np.exp(fwd[:, 1] + bwd[:, 1] - z), pairs

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> Field:
        squares: dict[str, float] = {}
        pair_squares = np.full((2, 2), 1e-6)
        for _ in range(epochs):
            for feats, labels in pages:
                if not feats:
                    continue
                p, pairs = self.expected(self.emissions(feats))
                grad: dict[str, float] = {}
                for f, y, q in zip(feats, labels, p.tolist(), strict=True):
                    for x in f:
                        grad[x] = grad.get(x, 0.0) + y - q
                for x, g in grad.items():
                    g -= decay * self.w.get(x, 0.0)
                    squares[x] = squares.get(x, 1e-6) + g * g
                    self.w[x] = self.w.get(x, 0.0) + rate * g / squares[x] ** 0.5
                seen = np.zeros((2, 2))
                for a, b in zip(labels, labels[1:], strict=False):
                    seen[a, b] += 1
                g = seen - pairs - decay * self.pair
                pair_squares += g * g
                self.pair += rate * g / np.sqrt(pair_squares)
        return self


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    """Pages whose blocks carry data-label: 1 for main text."""
    r = random.Random(seed)
    syllables = "an ba co de el fi go ha in jo ka lo mi no or pe qui ra su ta un ve wo ya zu".split()

    def word():
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def words(a, b, stop=True):
        t = " ".join(word() for _ in range(r.randint(a, b)))
        return t.capitalize() + (r.choice(".....!?") if stop else "")

    def sentences(k):
        return " ".join(words(3, 16) for _ in range(k))

    def named(*names):
        x = r.choice(names)
        return f' {r.choice(("class", "class", "id"))}="{x}"' if x else ""

    def anchors(k, wrap="li"):
        items = "".join(f"<{wrap}><a href='/{word()}'>{words(1, 3, False)}</a></{wrap}>" for _ in range(k))
        return f"<ul>{items}</ul>" if wrap == "li" else items

    def rest(body, tag, *names):
        return f'<{tag}{named(*names)} data-label="0">{body}</{tag}>'

    def menu():
        return rest(anchors(r.randint(2, 9), r.choice(("li", "li", "span", "div"))), r.choice(("nav", "nav", "div", "ul")), "menu", "nav", "navbar", "breadcrumb", "", "site-navigation")

    def header():
        body = f"<{(h := r.choice(('h1', 'div', 'p', 'a')))}>{words(1, 4, False)}</{h}>" + r.choice(("", f"<p>{words(3, 9)}</p>"))
        return rest(body + r.choice(("", menu())), r.choice(("header", "header", "div")), "header", "masthead", "site-header", "banner", "logo")

    def footer():
        body = r.choice((f"&copy; {word()} &middot; {words(3, 12)}", f"<p>© 2020 {words(2, 6)}</p>", f"<p>{sentences(r.randint(1, 3))}</p>" + anchors(3), anchors(5)))
        return rest(body, r.choice(("footer", "footer", "footer", "div")), "footer", "site-footer", "copyright", "legal")

    def advert():
        return rest(r.choice((sentences(1), f"<p>{sentences(2)}</p>", f"<a href='#'>{words(2, 8)}</a>")), r.choice(("div", "div", "aside", "p", "section")), "ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement")

    def notice():
        return rest(f"<p>{sentences(r.randint(1, 2))}</p><button>{words(1, 2, False)}</button>", r.choice(("div", "section", "dialog")), "cookie-consent", "cookie-banner", "newsletter", "notice", "subscribe", "gdpr", "popup", "alert")

    def side():
        body = f"<h3>{words(1, 3, False)}</h3>" + r.choice((anchors(4), f"<p>{sentences(2)}</p>", f"<ul><li>{words(4, 9)}</li><li>{words(4, 9)}</li></ul>"))
        return rest(body, r.choice(("aside", "aside", "div")), "sidebar", "related", "widget", "recent", "") if r.random() < 0.7 else rest(body, "div", "sidebar", "related-posts", "widget")

    def reader():
        one = lambda: f"<{(t := r.choice(('li', 'div', 'article')))} class='comment'><b>{word()}</b> <p>{sentences(r.randint(1, 3))}</p></{t}>"
        return rest(f"<h3>{words(1, 2, False)}</h3>" + "".join(one() for _ in range(r.randint(1, 5))), r.choice(("section", "div", "ol")), "comments", "comment-list", "discussion", "responses", "disqus")

    def form():
        return rest(f"<label>{words(1, 3, False)}</label><input name=q><button>{words(1, 1, False)}</button>" + r.choice(("", f"<p>{sentences(1)}</p>")), "form", "search", "login", "", "contact-form")

    def share():
        return rest(anchors(3, "span"), "div", "share", "social", "sharing", "tags", "meta")

    def paragraph():
        x = r.random()
        if x < 0.62:
            return f"<p>{sentences(r.choice((1, 1, 2, 3, 5)))}{r.choice(('', '', '</p>'))}"
        if x < 0.68:
            return f"<p><b>{sentences(1)}<br>"
        if x < 0.74:
            return f"<h{(k := r.randint(2, 4))}>{words(1, 6, False)}</h{k}>"
        if x < 0.80:
            return f"<ul><li>{words(1, 8, False)}</li><li>{words(2, 9)}</li></ul>"
        if x < 0.85:
            return f"<blockquote>{r.choice(('', '<p>'))}{sentences(2)}</blockquote>"
        if x < 0.89:
            return f"<pre>{words(3, 12, False)}</pre>"
        if x < 0.93:
            return f"<table><tr><th>{word()}</th><th>{word()}</th></tr><tr><td>{word()}</td><td>{words(1, 4, False)}</td></tr></table>"
        if x < 0.96:
            return f"<figure><img src=x><figcaption>{words(3, 9)}</figcaption></figure>"
        return f"<p>{words(1, 3)} <a href='/x'>{words(1, 5, False)}</a> {sentences(1)}</p>"

    def main():
        title = f"<h1>{words(2, 9, False)}</h1>"
        title = r.choice((title, title, title, f"<header>{title}</header>"))
        body = [title, *[paragraph() for _ in range(r.randint(0, 12))]]
        for inside in (advert, share, side, notice):
            if r.random() < 0.12:
                body.insert(r.randint(1, len(body)), inside())
        tag, names = r.choice((("article", ("", "", "post", "entry")), ("article", ("",)), ("main", ("", "content")), ("div", ("content", "article-body", "post-content", "entry-content", "main", "story")), ("section", ("content", "post")), ("div", ("",))))
        if r.random() < 0.12:  # no element of its own: the label is the body's
            return "".join(body[r.randint(0, 1) :]) or sentences(2)
        text = f'<{tag}{named(*names)} data-label="1">{"".join(body)}</{tag}>'
        if r.random() < 0.2:
            text = f'<main>{text}</main>'
        return text

    pages = []
    for _ in range(n):
        before = [f() for f in (notice, header, menu, advert, form, side) if r.random() < 0.45]
        r.shuffle(before)
        after = [f() for f in (share, advert, side, reader, form, notice) if r.random() < 0.4]
        r.shuffle(after)
        after += [footer()] if r.random() < 0.85 else []
        body = "".join(before) + main() + "".join(after)
        if r.random() < 0.3:
            body = f"<div{named('page', 'wrapper', 'container', 'site')}>{body}</div>"
        pages.append(f"<html><head><title>{words(1, 5)}</title></head><body data-label='1'>{body}</body></html>")
    return pages


def trained(pages: list[str] | None = None) -> Field:
    read = [blocks(p) for p in (labelled_pages() if pages is None else pages)]
    return Field().fit([(features(b), [x.label for x in b]) for b in read])


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, y in zip(found, field.decode(features(found)), strict=True) if y)


def _extract(sent, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = sent.value
        for batch in text_batches(batches, CHUNK_BYTES, "html"):
            texts = [main_text(h, field) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return run


def extracted(pages: DataFrame, columns: list[str] | None = None, field: Field | None = None) -> DataFrame:
    """``columns`` of pages (default: all but html) with text string and n_chars long."""
    keep = [f for f in pages.schema.fields if f.name in ([c for c in pages.columns if c != "html"] if columns is None else columns) and f.name not in ("text", "n_chars")]
    names = [f.name for f in keep]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    sent = pages.sparkSession.sparkContext.broadcast(field or trained())
    return pages.select(*dict.fromkeys([*names, "html"])).mapInArrow(_extract(sent, names), f"{kinds}text string, n_chars long")
