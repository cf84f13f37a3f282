"""Composed web pages with known main text, to train and test the extractor."""

from __future__ import annotations

import html

import numpy as np

_SYLLABLES = "an be ci da el fo ga hi in ja ko la me no or pa qu ra se ta un ve wi xa yo ze th er on st ch".split()
_PLAIN = "a b c box wrap inner outer col row x1 x2 unit cell grid layer block part piece".split()


def vocabulary(rng: np.random.Generator, size: int = 4000) -> list[str]:
    return ["".join(rng.choice(_SYLLABLES, int(rng.integers(1, 5)))) for _ in range(size)]


class _Writer:
    def __init__(self, rng: np.random.Generator, vocab: list[str]) -> None:
        self.rng, self.vocab = rng, vocab
        self.article: set[str] = set()
        self.named = rng.random() < 0.75  # pages whose attributes say what a part is
        self.semantic = rng.random() < 0.7

    def pick(self, *options: str) -> str:
        return options[int(self.rng.integers(len(options)))]

    def words(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        return " ".join(self.vocab[i] for i in self.rng.integers(0, len(self.vocab), n).tolist())

    def prose(self, low: int, high: int) -> str:
        out, left = [], int(self.rng.integers(low, high + 1))
        while left > 0:
            k = min(left, int(self.rng.integers(3, 18)))
            s = self.words(k, k)
            if k > 6 and self.rng.random() < 0.5:
                s = s.replace(" ", ", ", 1)
            out.append(s[:1].upper() + s[1:] + self.pick(".", ".", ".", "!", "?", " &", "***"))
            left -= k
        return " ".join(out)

    def keep(self, text: str) -> str:
        self.article.add(" ".join(text.split()))
        return html.escape(text, quote=False)

    def attr(self, *names: str) -> str:
        name = self.pick(*names) if self.named else self.pick(*_PLAIN)
        if self.rng.random() < 0.15:
            return ""
        extra = " " + self.pick(*_PLAIN) if self.rng.random() < 0.3 else ""
        return f' {self.pick("class", "class", "id")}="{name}{extra}"'

    def part(self, tag: str, names: tuple[str, ...], inner: str) -> str:
        tag = tag if self.semantic else "div"
        return f"<{tag}{self.attr(*names)}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(int(self.rng.integers(low, high + 1)))]
        if self.rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.pick(" | ", " ", " &middot; ").join(items)

    def form(self) -> str:
        return f'<form{self.attr("search", "login", "contact", "subscribe")} action="/x"><label>{self.words(1, 5)}</label><input name="q"><p>{self.words(2, 12)}</p><textarea>{self.words(1, 5)}</textarea><button>{self.words(1, 2)}</button></form>'

    def comments(self) -> str:
        each = lambda: f'<{self.pick("div", "li", "p", "article")}{self.attr("comment", "reply", "comment-body")}>' + self.pick("<b>{}</b> ", "<span>{}</span> ", "{} ").format(self.words(1, 2)) + self.prose(4, 45)
        head = f"<h3>{self.words(1, 3)}</h3>"
        body = ""
        for _ in range(int(self.rng.integers(1, 7))):
            x = each()
            body += x + f"</{x[1:].split(' ')[0].split('>')[0]}>"
        return self.part("section", ("comments", "comment-list", "disqus", "discussion"), head + body)

    def advert(self) -> str:
        return f'<{(t := self.pick("div", "div", "aside", "section", "p"))}{self.attr("ad", "ads", "advert", "sponsored", "promo", "banner")}>{self.pick(self.prose(3, 20), self.words(2, 8), "<a href=x>" + self.words(2, 9) + "</a>")}</{t}>'

    def notice(self) -> str:
        inner = self.pick("<p>{}</p>", "{}").format(self.prose(5, 30)) + (f"<button>{self.words(1, 2)}</button>" if self.rng.random() < 0.5 else "")
        return self.part("div", ("cookie-notice", "cookie-banner", "notice", "consent", "alert", "newsletter", "popup"), inner)

    def side(self) -> str:
        return self.part("aside", ("sidebar", "side", "related", "widget", "popular"), f"<h3>{self.words(1, 3)}</h3>" + self.pick(self.links(3, 9), f"<p>{self.prose(6, 30)}</p>", f"<p>{self.prose(6, 30)}</p>" + self.links(2, 6)))

    def foot(self) -> str:
        return self.part("footer", ("footer", "site-footer", "bottom"), self.pick(f"&copy; {self.words(1, 3)} &middot; {self.prose(3, 15)}", f"<p>&copy; {self.prose(3, 25)}</p>", self.links(2, 6) + f"<p>{self.words(3, 12)}</p>"))

    def head(self) -> str:
        return self.part("header", ("header", "masthead", "site-header", "branding"), self.pick(f'<a href="/">{self.words(1, 3)}</a>', f"<h1>{self.words(1, 3)}</h1><p>{self.words(2, 8)}</p>", f"<div>{self.words(1, 4)}</div>") + (self.links(2, 6) if self.rng.random() < 0.4 else ""))

    def menu(self) -> str:
        return self.part("nav", ("nav", "menu", "navbar", "breadcrumb"), self.links(3, 10))

    def paragraph(self) -> str:
        text = self.prose(*((1, 8), (5, 40), (20, 120), (60, 200))[int(self.rng.integers(4))])
        shown = self.keep(text)
        if self.rng.random() < 0.2:
            first, _, rest = shown.partition(" ")
            shown = f'<a href="/r">{first}</a> {rest}'.strip() if rest else shown
        shape = self.rng.random()
        if shape < 0.1:
            return f"<p><b>{shown}<br>"
        if shape < 0.3:
            return f"<p>{shown}"
        if shape < 0.36 and not self.semantic:
            return f"<div>{shown}</div>"
        return f"<p>{shown}</p>"

    def body(self) -> str:
        out = [f"<h1>{self.keep(self.words(2, 12))}</h1>"] if self.rng.random() < 0.85 else []
        for _ in range(int(self.rng.integers(1, 4)) if self.rng.random() < 0.3 else int(self.rng.integers(3, 16))):
            kind = self.rng.random()
            if kind < 0.76:
                out.append(self.paragraph())
            elif kind < 0.82:
                out.append(f"<h2>{self.keep(self.words(1, 7))}</h2>")
            elif kind < 0.87:
                out.append("<ul>" + "".join(f"<li>{self.keep(self.prose(2, 20))}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>")
            elif kind < 0.90:
                out.append(f"<blockquote><p>{self.keep(self.prose(5, 40))}</p></blockquote>")
            elif kind < 0.92:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.keep(self.words(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif kind < 0.94:
                out.append(f"<pre>{self.keep(self.words(4, 20))}</pre>")
            elif kind < 0.96:
                out.append(f"<figure><img src=x><figcaption>{self.keep(self.words(3, 12))}</figcaption></figure>")
            elif kind < 0.98:
                out.append(self.advert())
            else:
                out.append(self.pick(self.notice(), self.form(), self.part("div", ("share", "social"), self.links(2, 4))))
        return "".join(out)


def training_page(rng: np.random.Generator, vocab: list[str] | None = None) -> tuple[str, set[str]]:
    """A page and the blocks of its article (white space collapsed)."""
    w = _Writer(rng, vocab or vocabulary(rng))
    maybe = lambda share, make: make() if rng.random() < share else ""
    inside = w.body()
    if rng.random() < 0.3:
        inside = f'<div{w.attr("content", "text", "entry", "post-body")}>{inside}</div>'
    tag = w.pick("article", "article", "main", "section", "div", "td") if w.semantic else "div"
    article = f'<{tag}{w.attr("content", "article", "post", "entry", "story", "main-content", "page")}>{inside}</{tag}>'
    if tag == "td":
        article = f"<table><tr>{maybe(0.5, lambda: '<td>' + w.links(3, 8) + '</td>')}{article}</tr></table>"
    middle = maybe(0.2, w.side) + article + maybe(0.3, w.comments) + maybe(0.35, w.side)
    if rng.random() < 0.4:
        middle = f'<{(t := w.pick("main", "div") if w.semantic else "div")}{w.attr("main", "container", "wrapper", "page")}>{middle}</{t}>'
    top = [maybe(0.5, w.head), maybe(0.75, w.menu), maybe(0.3, w.notice), maybe(0.5, w.advert), maybe(0.12, w.form)]
    low = [maybe(0.2, w.advert), maybe(0.15, w.form), maybe(0.15, w.notice), maybe(0.8, w.foot)]
    rng.shuffle(top)
    head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{w.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";go(1);</script></head><body>'
    tail = "</body></html>" if rng.random() < 0.85 else ""
    return head + "".join(top) + "<!-- part -->" + middle + "".join(low) + tail, w.article
