"""Labelled pages for the weights of ``html_text``: built from a rule, every stretch known to be content or not."""

from __future__ import annotations

import random


def _words(r: random.Random, low: int, high: int) -> str:
    syllables = ("ba", "ri", "ton", "mel", "su", "ka", "dor", "ne", "vi", "lo")
    return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(low, high)))


def _links(r: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{_words(r, 1, 3)}</a></li>' for i in range(n))


def _around(r: random.Random) -> list[str]:
    """Stretches that are not content, in either semantic or class-only markup."""
    w = _words
    return [
        f"<nav><ul>{_links(r, 6)}</ul></nav>",
        f'<div class="menu"><ul>{_links(r, 8)}</ul></div>',
        f'<div id="top"><a href="/">{w(r, 1, 3)}</a> <a href="/a">{w(r, 1, 2)}</a> <a href="/b">{w(r, 1, 2)}</a></div>',
        f'<header><a href="/">{w(r, 1, 4)}</a><p>{w(r, 2, 8)}</p></header>',
        f'<div class="ad">{w(r, 5, 15)}</div>',
        f'<aside><h3>{w(r, 1, 4)}</h3><ul>{_links(r, 5)}</ul></aside>',
        f'<div class="sidebar"><h3>{w(r, 1, 4)}</h3><p>{w(r, 5, 25)}</p></div>',
        f'<div class="cookie-notice"><p>{w(r, 8, 20)}</p><button>ok</button></div>',
        f'<form action="/s"><label>{w(r, 1, 3)}</label><input name="q"><p>{w(r, 3, 8)}</p></form>',
        f'<section class="comments"><h2>{w(r, 1, 3)}</h2>' + "".join(f"<div><b>{w(r, 1, 2)}</b><p>{w(r, 5, 30)}</p></div>" for _ in range(3)) + "</section>",
        f"<footer>&copy; {w(r, 1, 3)} &middot; {w(r, 4, 15)}</footer>",
        f'<div class="footer"><p>{w(r, 5, 15)}</p><a href="/c">{w(r, 1, 2)}</a></div>',
        "<table><tr>" + "".join(f'<td><a href="/t{i}">{w(r, 1, 3)}</a></td>' for i in range(7)) + "</tr></table>",
        "<table>" + "".join(f'<tr><td>{w(r, 1, 2)}</td><td><a href="/t{i}">{w(r, 1, 3)}</a></td></tr>' for i in range(4)) + "</table>",
    ]


def _article(r: random.Random) -> list[tuple[str, bool]]:
    """An article in several parts, with a stretch that is not content now and then."""
    tag = r.choice(["article", "main", 'div class="post"', 'div id="content"', "div"])
    parts = [(f"<{tag}><h1>{_words(r, 4, 10)}</h1>", True)]
    for _ in range(r.randint(3, 9)):
        parts.append((r.choice(["<p>{}</p>", "<p><b>{}<br><p>", "<p>{} <a href='/x'>link</a></p>", "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<div>{}</div>", "{}<br><br>", "<table><tr><td>{}</td></tr></table>", "<div><span>{}</span></div>"]).format(_words(r, 3, 60)), True))
        if r.random() < 0.15:
            parts.append((r.choice(_around(r)[4:9]), False))
    return [*parts, (f"</{tag.split()[0]}>", True)]


def labelled_pages(n: int = 60, seed: int = 7) -> list[list[tuple[str, bool]]]:
    pages = []
    for i in range(n):
        r = random.Random(seed * 1000 + i)
        around = _around(r)
        before, after = r.sample([*around[:9], *around[12:]], r.randint(1, 4)), r.sample(around[4:], r.randint(1, 5))
        head = f"<!DOCTYPE html><html><head><title>{_words(r, 3, 8)}</title><style>p{{}}</style></head><body>"
        pages.append([(head, False), *((x, False) for x in before), *_article(r), *((x, False) for x in after), ("</body></html>", False)])
    return pages
