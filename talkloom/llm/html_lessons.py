"""Marked pages to learn from, composed by rule: layouts, names and texts are drawn anew for each page.

A page comes with the texts that are its content.  Words are made up, so that
nothing but form, names and place can be learnt; reader comments have the turns
of speech that such comments have.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

_SYLLABLES = [a + b for a in "b c d f g l m n p r s t v st tr".split() for b in "a e i o u er an".split()]
_PRAISE = ["great post", "thanks for this", "i agree", "i disagree with you", "you are right", "lol", "my view is the same", "thank you so much", "where did you read this", "i like it", "this is wrong"]
_ACTIONS = ["reply", "report", "share", "like", "flag", "permalink"]


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.content = rng, set()

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self) -> str:
        text = self.words(4, 18)
        return f"{text[0].upper()}{text[1:]}{self.rng.choice(['.', '.', '.', '?', '!'])}"

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))

    def mine(self, text: str) -> str:
        """Text of the article."""
        self.content.add(text)
        return text

    def pick(self, *of: str) -> str:
        return self.rng.choice(of)

    def unknown(self) -> str:
        """A class name that says nothing."""
        return self.pick(f"{self.word()[:4]}-{self.word()}", self.word(), f"{self.word()[:3]}{self.rng.randrange(99)}", f"{self.pick('col', 'box', 'row', 'wrap', 'x')}-{self.word()[:4]}")

    def links(self, name: str, low: int = 3, high: int = 9) -> str:
        tag = self.pick("ul", "ol", "div")
        item = "li" if tag != "div" else self.pick("span", "div", "p")
        items = "".join(f"<{item}><a href='/{self.word()}'>{self.words(1, 4)}</a></{item}>" for _ in range(self.rng.randint(low, high)))
        return f"<{tag}{name}>{items}</{tag}>"

    def named(self, tag: str, name: str, inside: str) -> str:
        key = self.pick("class", "class", "id")
        return f'<{tag} {key}="{name}">{inside}</{tag}>' if name else f"<{tag}>{inside}</{tag}>"

    def paragraphs(self) -> str:
        out = []
        for _ in range(self.rng.choice([0, 1, 1, 2, 3, 5, 9])):
            kind = self.rng.random()
            if kind < 0.62:
                text = self.mine(self.prose() if self.rng.random() < 0.8 else self.words(1, 6))
                out.append(f"<p>{text}</p>")
            elif kind < 0.7:
                out.append(f"<h{self.rng.randint(2, 4)}>{self.mine(self.words(1, 7))}</h2>")
            elif kind < 0.82:
                name = self.pick("", "", "", ' class="steps"', ' class="menu-items"', ' class="link-list"', ' class="widget-parts"', f' class="{self.unknown()}"')
                out.append(f"<ul{name}>" + "".join(f"<li>{self.mine(self.sentence() if self.rng.random() < 0.7 else self.words(2, 8))}</li>" for _ in range(self.rng.randint(2, 6))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{self.mine(self.prose(1, 3))}</p></blockquote>")
            elif kind < 0.95:
                out.append(f"<div>{self.mine(self.prose(1, 4))}</div>")
            else:
                out.append(self.named("div", self.unknown(), f"<p>{self.mine(self.prose(1, 5))}</p><p>{self.mine(self.prose(1, 5))}</p>"))
        return "".join(out)

    def comments(self) -> str:
        name = self.pick("comments", "comment-list", "replies", "discussion", self.unknown(), "thread", "respond", "disqus_thread", self.unknown())
        item = self.pick("comment", "reply", self.unknown(), self.unknown(), "")
        tag, out = self.pick("div", "li", "div", "li", "div", "li", "div", "article"), []
        for _ in range(self.rng.randint(1, 7)):
            who = self.word().title()
            said = f"{self.pick(*_PRAISE)}{self.pick('!', '.', '', '!!')} {self.prose(0, 2) if self.rng.random() < 0.6 else ''}".strip()
            text = self.pick(f"<p>{who}: {said}</p>", f"<b>{who} says:</b><p>{said}</p>", f"<span>{who}</span> <span>{self.rng.randint(2, 9)} days ago</span><p>{said}</p>", f"<p>@{who} {said}</p>")
            if self.rng.random() < 0.4:
                text += f"<div><a href='#'>{self.pick(*_ACTIONS)}</a> <a href='#'>{self.pick(*_ACTIONS)}</a></div>"
            out.append(self.named(tag, item, text))
        head = f"<h3>{self.rng.randint(1, 40)} {self.pick('comments', 'replies', 'responses')}</h3>" if self.rng.random() < 0.5 else ""
        return self.named(self.pick("section", "div", "ol"), name, head + "".join(out))

    def aside(self) -> str:
        """Something in or beside an article that is not of it."""
        kind = self.rng.randrange(6)
        if kind == 0:
            return self.named("div", self.pick("ad", "ads", "advert", "promo", "sponsored", "banner", "ad-box", "ad_slot"), self.prose(1, 4))
        if kind == 1:
            return self.named("div", self.pick("share", "social", "sharing", "share-bar", self.unknown()), self.links("", 2, 5))
        if kind == 2:
            return self.named("div", self.pick("related", "recommended", "more", "teaser", self.unknown()), f"<h3>{self.words(1, 3)}</h3>" + self.links("", 3, 6))
        if kind == 3:
            return self.named(self.pick("aside", "div"), self.pick("sidebar", "widget", "newsletter", "popup", "subscribe"), f"<h4>{self.words(1, 3)}</h4><p>{self.prose(1, 2)}</p>")
        if kind == 4:
            return f"<form><label>{self.words(1, 3)}</label><input name='q'><button>{self.word()}</button></form>"
        return f"<aside><p>{self.prose(1, 3)}</p></aside>"

    def html(self) -> str:
        top, bottom = [], []
        if self.rng.random() < 0.8:
            top.append(self.pick(f"<header><h2>{self.words(1, 3)}</h2><p>{self.words(2, 8)}</p></header>", self.named("div", self.pick("header", "masthead", "top", self.unknown()), f"<a href='/'>{self.words(1, 3)}</a>")))
        if self.rng.random() < 0.9:
            top.append(self.pick(f"<nav>{self.links('')}</nav>", self.links(' class="menu"'), self.links(' id="navbar"'), self.links(f' class="{self.unknown()}"')))
        if self.rng.random() < 0.4:
            top.append(self.named("div", self.pick("cookie-notice", "cookies", "consent", "gdpr", "notice"), f"<p>{self.prose(1, 2)}</p><button>{self.word()}</button>"))
        if self.rng.random() < 0.5:
            top.append(self.named("div", self.pick("ad", "ads", "banner", "advertisement", "ad", "ads"), self.prose(1, 3)))
        inside = f"<h1>{self.mine(self.pick(self.words(2, 9), self.sentence()))}</h1>{self.paragraphs()}"
        for _ in range(self.rng.randrange(3)):
            inside += self.aside() + (self.paragraphs() if self.rng.random() < 0.5 else "")
        within = self.rng.random() < 0.4
        if within:
            inside += self.comments()
        kind = self.rng.random()
        if kind < 0.35:
            body = f"<article>{inside}</article>"
        elif kind < 0.5:
            body = f"<main>{inside}</main>"
        elif kind < 0.8:
            body = self.named(self.pick("div", "section", "td"), self.pick("content", "post", "entry", "article-body", "main-text", "story", "post-content"), inside)
        elif kind < 0.92:
            body = self.named("div", self.unknown(), inside)
        else:
            body = f"<div>{inside}</div>"
        if not within and self.rng.random() < 0.3:
            bottom.append(self.comments())
        if self.rng.random() < 0.5:
            bottom.append(self.aside())
        if self.rng.random() < 0.9:
            bottom.append(self.pick(f"<footer><p>&copy; {self.words(2, 9)}</p>{self.links('', 0, 4)}</footer>", self.named("div", self.pick("footer", "bottom", "contentinfo", self.unknown()), f"<p>&copy; {self.rng.randint(1999, 2030)} {self.words(1, 6)}</p>" + self.links("", 1, 5))))
        self.rng.shuffle(bottom)
        return f"<html><body>{''.join(top)}{body}{''.join(bottom)}</body></html>"


def pages(n: int = 400, seed: int = 5) -> Iterator[tuple[str, set[str]]]:
    """(html, texts of its content's blocks) of ``n`` pages."""
    for k in range(n):
        page = _Page(random.Random(seed * 1_000_003 + k))
        html = page.html()
        yield html, page.content
