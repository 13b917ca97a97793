"""Main text of pages in many layouts, whose names come, go and change."""

import random
from html.parser import HTMLParser

import pytest

from hunkflow.llm import html_text

TREE = html_text.grow(*html_text.labelled_blocks())


class _Page:
    """A page as (words, linked, article?, element, name) blocks in boxes."""

    def __init__(self, rng):
        self.rng, self.n, self.want, self.rest = rng, 0, [], []

    def text(self, words, article):
        self.n += 1
        t = " ".join(f"b{self.n}w{i}" for i in range(words))
        (self.want if article else self.rest).append(t)
        return t

    def links(self, tag="li"):
        rows = "".join(f'<{tag}><a href="/{i}">{self.text(self.rng.randrange(1, 4), False)}</a></{tag}>' for i in range(self.rng.randrange(4, 9)))
        return f"<ul>{rows}</ul>" if tag == "li" else rows

    def article(self, tag):
        out = f"<h1>{self.text(self.rng.randrange(4, 10), True)}</h1>"
        for _ in range(self.rng.randrange(3, 8)):
            out += f"<{tag}>{self.text(self.rng.randrange(25, 120), True)}</{tag}>"
        return out

    def build(self, names):
        rng, name = self.rng, lambda own: f' class="{names(own)}"' if names(own) else ""
        tag = rng.choice(["p", "p", "div"])
        top = rng.choice([f"<nav>{self.links()}</nav>", f"<div{name('nav')}>{self.links()}</div>", f"<div{name('menu')}>{self.links('div')}</div>"])
        body = self.article(tag)
        if rng.random() < 0.5:
            inner = f"<{tag}>{self.text(rng.randrange(30, 90), True)}</{tag}>"
            body += f"<div{name('*')}>{inner}</div><{tag}>{self.text(40, True)}</{tag}>"
        if names("ad"):  # only names tell these from text
            body += f"<div{name('advert')}>{self.text(rng.randrange(8, 40), False)}</div><{tag}>{self.text(50, True)}</{tag}>"
        wrap = rng.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<div id=w{1}>{0}</div>", "<div{2}>{0}</div>"])
        page = top + wrap.format(body, rng.randrange(9), name("article"))
        if names("comments"):
            page += f"<section{name('comments')}>" + "".join(f"<p>{self.text(rng.randrange(5, 60), False)}</p>" for _ in range(3)) + "</section>"
        page += rng.choice(["<aside>{}</aside>", "<div{1}>{0}</div>"]).format(self.links(rng.choice(["li", "div"])), name("sidebar"))
        return page + f"<div{name('footer')}>{self.text(rng.randrange(2, 7), False)}</div>"


def _kept(own):
    return {"*": "intro"}.get(own, own)


def _hyphenated(rng):
    def names(own):
        if own == "*":
            return rng.choice(["ad-hoc", "notice-of-rights", "comment-theory", "signup-rates", "popular-science", "menu-engineering"])
        return rng.choice([f"{own}-wrapper", f"main-{own}", f"{own}-box-{rng.randrange(99)}", f"site {own}List".replace("List", "-list")])

    return names


@pytest.mark.parametrize("how", ["kept", "removed", "renamed", "hyphenated"])
def test_layouts(how):
    hit = got = want = 0
    for seed in range(80):
        rng = random.Random(seed)
        page = _Page(rng)
        names = {"kept": _kept, "removed": lambda own: "", "renamed": lambda own: "" if own in ("ad", "comments") else f"x{hash(own) % 97}q", "hyphenated": _hyphenated(rng)}[how]
        html = page.build(names)
        found = html_text.main_text(html, TREE).split("\n\n")
        hit, got, want = hit + len(set(found) & set(page.want)), got + len(found), want + len(page.want)
    assert hit / got >= 0.95 and hit / want >= 0.95, (hit / got, hit / want)


@pytest.mark.parametrize("name", ["ad-hoc", "notice-of-rights", "comment-theory", "signup-rates"])
def test_sections_with_telling_words_stay(name):
    w = lambda n, k: " ".join(f"{k}{i}" for i in range(n))
    page = f'<article><h1>T</h1><p>{w(60, "a")}</p><div class="{name}"><p>{w(60, "b")}</p></div><p>{w(50, "c")}</p></article>'
    assert html_text.main_text(page, TREE).split("\n\n") == ["T", w(60, "a"), w(60, "b"), w(50, "c")]


def test_unnamed_articles_stay():
    w = lambda n, k: " ".join(f"{k}{i}" for i in range(n))
    nav = "<ul>" + "<li><a href=x>L</a></li>" * 5 + "</ul>"
    parts = [w(60, k) for k in "abc"]
    assert html_text.main_text(f"{nav}<h1>T</h1>" + "".join(f"<div>{p}</div>" for p in parts), TREE).split("\n\n") == ["T", *parts]
    kept = html_text.main_text(f"{nav}<div id=wrap><h1>T</h1><div>{parts[0]}</div><div>{parts[1]}</div><p>Posted by Ann</p></div>", TREE).split("\n\n")
    assert kept[:3] == ["T", *parts[:2]]
    formula = f"<article><p>{w(30, 'a')} <math><mi>x</mi><mo>=</mo></math> {w(9, 'b')}</p><noscript>Please enable JavaScript</noscript></article>"
    assert html_text.main_text(formula, TREE) == f"{w(30, 'a')} x = {w(9, 'b')}".replace(" x = ", " x= ")


class _Reader(HTMLParser):
    """Another reading of simple pages: the text of each innermost block."""

    def __init__(self):
        super().__init__()
        self.blocks, self.text = [], ""

    def close_block(self):
        if self.text.split():
            self.blocks.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag != "a":
            self.close_block()

    def handle_endtag(self, tag):
        if tag != "a":
            self.close_block()

    def handle_data(self, data):
        self.text += data


def test_blocks_equal_another_reading():
    for seed in range(80):
        rng = random.Random(seed)
        html = _Page(rng).build(_hyphenated(rng))
        reader = _Reader()
        reader.feed(html)
        reader.close_block()
        assert [b[0] for b in html_text.blocks(html)] == reader.blocks
