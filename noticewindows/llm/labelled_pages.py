"""Labelled pages to train the extraction model on: layouts put together by a seeded rule.

Each page is HTML in which ``data-label`` marks what a reader calls content; everything else is not.  Names of classes
and ids follow common usage.  The texts are invented and carry no meaning.
"""

from __future__ import annotations

import random

SYLLABLES = "ka ro mi tes lan or ve nu shi pol dra en".split()
CONTENT_BOXES = (
    "article", "main", "section", "div id=content", "div class=post", "div class=entry-content", "div class=article-body",
    "div class=story", "div id=main", "div class=text", "div class=page-content", "article class=post", "main id=main", "div",
)
WRAPPERS = ("div id=page", "div class=container", "div class=wrapper", "main", "div id=wrap", "div class=row", "div")
MENUS = ("nav", "ul class=menu", "div id=nav", "div class=navbar", "div class=breadcrumbs", "nav class=main-menu", "div role=navigation", "ul class=tabs")
HEADERS = ("header", "div id=header", "div class=topbar", "header class=site-header", "div class=masthead", "div class=logo")
FOOTERS = ("footer", "div id=footer", "div class=site-footer", "div class=copyright", "footer class=footer", "div class=legal")
SIDES = ("aside", "div class=sidebar", "div id=sidebar", "div class=widget", "aside class=related", "div class=recommended", "div id=secondary", "div class=related-posts", "section class=more-stories")
ADVERTS = ("div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "div class=banner", "div class=sponsored", "aside class=promo", "div id=ad-top", "section class=ad", "p class=ad", "ins class=adsbygoogle", "div class=ad-slot")
NOTICES = ("div class=cookie-notice", "div class=cookies", "div id=consent", "div class=notice", "div class=alert", "div class=popup", "div class=modal", "div class=newsletter", "div class=subscribe", "div role=alert", "div role=dialog", "section class=notice", "p class=notice", "div class=banner-cookie", "div class=paywall", "div class=gdpr")
FORMS = ("form", "form class=search", "form id=login", "form class=newsletter", "div class=search", "fieldset", "div class=login-form")
COMMENTS = ("div class=comments", "div id=comments", "section class=comment-list", "ol class=commentlist", "div class=comment", "section id=comments", "div class=responses", "div class=reader-comments", "aside class=comments", "ul class=comments", "section class=comments", "div class=discussion", "div id=disqus_thread", "div class=comment-thread", "div id=respond", "section class=reviews")
EXTRAS = ("div class=share", "ul class=social", "div class=tags", "div class=pagination", "div class=author-bio", "div class=sharing-buttons")


def _open(box: str) -> str:
    tag, _, attribute = box.partition(" ")
    name, _, value = attribute.partition("=")
    return f'<{tag} {name}="{value}">' if name else f"<{tag}>"


def _close(box: str) -> str:
    return f"</{box.partition(' ')[0]}>"


class _Page:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def word(self) -> str:
        return "".join(self.random.choice(SYLLABLES) for _ in range(self.random.randint(1, 4)))

    def words(self, low: int, high: int, stop: bool = True) -> str:
        text = " ".join(self.word() for _ in range(self.random.randint(low, high)))
        return text.capitalize() + self.random.choice([".", ".", ".", "!", "?"] if stop else ["", "", "."])

    def links(self) -> str:
        items = [f'<a href="/x">{self.words(1, 3, False)}</a>' for _ in range(self.random.randint(2, 7))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.random.random() < 0.7 else " ".join(items)

    def box(self, boxes: tuple[str, ...], inside: str) -> str:
        box = self.random.choice(boxes)
        return _open(box) + inside + _close(box)

    def plain(self, low: int, high: int) -> str:
        text = self.words(low, high)
        return self.random.choice([text, f"<p>{text}</p>", f"<span>{text}</span>"])

    def unnamed(self, inside: str) -> str:
        """A box without a telling name: none at all, or a made-up one."""
        name = self.random.choice(["", "", f' class="{self.word()}"', f' id="{self.word()}{self.random.randint(1, 99)}"'])
        return f"<div{name}>{inside}</div>"

    def heading(self) -> str:
        tag = self.random.choice(["h2", "h2", "h3", "h4", "strong"])
        return f"<{tag}>{self.words(1, 3, False)}</{tag}>"

    def form(self) -> str:
        return self.box(FORMS, f"<label>{self.words(1, 2, False)}</label><input name=q><button>{self.words(1, 2, False)}</button>" + self.random.choice(["", f"<p>{self.words(4, 12)}</p>", "<select><option>Ka<option>Ro</select>"]))

    def comments(self) -> str:
        rows = [self.random.choice([f"<p>{self.words(3, 60)}</p>", f'<div class="comment"><b>{self.word()}</b><p>{self.words(3, 60)}</p></div>', f"<li>{self.words(3, 40)}</li>"]) for _ in range(self.random.randint(1, 5))]
        return self.box(COMMENTS, self.random.choice(["", self.heading()]) + "".join(rows) + self.random.choice(["", self.form()]))

    def other(self, kind: int | None = None) -> str:
        kind = self.random.randrange(9) if kind is None else kind
        return (
            lambda: self.box(MENUS, self.links()),
            lambda: self.box(HEADERS, self.random.choice([self.links(), self.plain(1, 6), f"<h1>{self.words(1, 4, False)}</h1>"])),
            lambda: self.box(FOOTERS, self.random.choice([self.links(), self.plain(3, 20), "&copy; " + self.words(2, 14)])),
            lambda: self.box(SIDES, self.random.choice(["", self.heading()]) + self.random.choice([self.links(), self.plain(5, 40)])),
            lambda: self.box(ADVERTS, self.random.choice([self.plain(2, 16), f'<a href="/ad">{self.words(3, 9)}</a>'])),
            lambda: self.box(NOTICES, self.plain(4, 40) + self.random.choice(["", f"<button>{self.words(1, 2, False)}</button>"])),
            self.form,
            self.comments,
            lambda: self.box(EXTRAS, self.random.choice([self.links(), self.plain(1, 25)])),
        )[kind]()

    def block(self) -> str:
        pick = self.random.random()
        if pick < 0.62:
            text = self.words(1, 4, False) if self.random.random() < 0.2 else self.words(4, 110)
            return f"<p>{text}" + self.random.choice(["</p>", "</p>", "", "<br>" + self.words(3, 30) + "</p>"])
        if pick < 0.70:
            return f"<h2>{self.words(1, 8, False)}</h2>"
        if pick < 0.84:
            return "<ul>" + "".join(f"<li>{self.words(1, 15)}</li>" for _ in range(self.random.randint(2, 5))) + "</ul>"
        if pick < 0.88:
            return f"<blockquote><p>{self.words(5, 40)}</p></blockquote>"
        if pick < 0.92:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 4, False)}</td><td>{self.words(1, 9, False)}</td></tr>" for _ in range(3)) + "</table>"
        if pick < 0.96:
            return f'<p>{self.words(5, 40)} <a href="/y">{self.words(1, 3, False)}</a> {self.words(5, 30)}</p>'
        return self.random.choice([f"<div>{self.words(5, 60)}</div>", f"<figure><img src=x><figcaption>{self.words(3, 12)}</figcaption></figure>", f"<pre>{self.words(4, 20)}</pre>", f"<section><h2>{self.words(1, 5)}</h2><p>{self.words(5, 60)}</p></section>"])

    def article(self) -> str:
        title = f"<h1>{self.words(2, 12, False)}</h1>"
        parts = [self.random.choice([title, title, f"<header>{title}</header>", ""])]
        for _ in range(self.random.choice([1, 1, 2, 2, 3, 4, 5, 6, 8, 10, 12])):
            block = self.block()
            parts.append(self.unnamed(block) if self.random.random() < 0.15 else block)
        marked = [f'<x-label data-label="content">{p}</x-label>' for p in parts if p]
        for _ in range(self.random.choice([0, 0, 1, 2, 3, 4])):
            marked.insert(self.random.randint(1, len(marked)), self.other(self.random.choice([3, 4, 5, 6, 7, 8])))
        if self.random.random() < 0.25:
            marked.append(self.comments())
        if self.random.random() < 0.65:
            return self.box(CONTENT_BOXES, "".join(marked))
        inside = "".join(marked)  # a page that names nothing: up to four plain boxes around one another
        for _ in range(self.random.randint(1, 4)):
            inside = self.unnamed(inside)
        return inside

    def html(self) -> str:
        if self.random.random() < 0.08:  # a fragment without a page around it
            inside = self.random.choice([self.words(2, 60), self.block(), self.block() + self.block()])
            inside = self.box(("div", "section", "body"), inside) if self.random.random() < 0.5 else inside
            return f'<x-label data-label="content">{inside}</x-label>'
        top = [self.other(self.random.choice([0, 1, 4, 5])) for _ in range(self.random.randint(0, 3))]
        low = [self.other(self.random.choice([2, 3, 4, 6, 7, 8])) for _ in range(self.random.randint(0, 4))]
        if self.random.random() < 0.15:  # little more than the text
            top, low = top[:1], low[:1]
            return f"<html><body>{''.join(top)}{self.article()}{''.join(low)}</body></html>"
        middle = self.article()
        if self.random.random() < 0.4:
            middle = self.box(WRAPPERS, middle + self.random.choice(["", self.other(3), self.comments()]))
        return "<html><body>" + "".join(top) + middle + "".join(low) + self.other(2) + "</body></html>"


def labelled_pages(n: int = 1500, seed: int = 1) -> list[tuple[int, str]]:
    """``n`` pages as (number, html)."""
    return [(i, _Page(seed * 1_000_003 + i).html()) for i in range(n)]
