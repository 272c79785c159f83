"""Generated pages whose blocks are known: what the extraction's classifier is fitted to."""

from __future__ import annotations

import random

STEMS = "ka lo mi ru te san vel dor pin gra ul est ova rin".split()
#: Names that sites give to their parts.
ARTICLE_NAMES = ["post-content", "entry-content", "article-body", "story", "content", "text", "", "", "c12", "x-a"]
QUIET_NAMES = ["share-price", "notice-period", "comment-count-study", "ad-hoc-report", "reply-letter", "side-effects", "menu-of-the-day", "social-history", "lead", "intro", "q3", "figure-1"]
NOISE_NAMES = ["ad", "ads", "advert", "sidebar", "widget", "related", "share-buttons", "social", "comments", "comment-list", "newsletter", "cookie-notice", "promo-box", "banner", "breadcrumb", "menu", "footer-links", "subscribe", "popup", "pagination", "login-form", "ad-xkq", "related-reads", "comment-4f9a", "share-strip", "promo-zq", "sidebar-lorem", "js-newsletter-hook", "menu-vertical", "cookie-law"]
NOISE_TAGS = ["nav", "footer", "aside", "form"]


def _word(rnd: random.Random) -> str:
    return "".join(rnd.choice(STEMS) for _ in range(rnd.randint(1, 4)))


def _words(rnd: random.Random, low: int, high: int) -> str:
    return " ".join(_word(rnd) for _ in range(rnd.randint(low, high)))


def _named(name: str) -> str:
    return f' class="{name}"' if name else ""


def _noise(rnd: random.Random, marked: bool = False) -> str:
    """A part that is not article: marked by an element, a name or (unless ``marked``) not at all, of links, short lines or prose."""
    kind, body = rnd.random() * (0.93 if marked else 1), []
    for _ in range(rnd.randint(1, 7)):
        shape = rnd.random()
        if shape < 0.45:
            body.append(f"<li><a href=/x>{_words(rnd, 1, 5)}</a></li>")
        elif shape < 0.6:
            body.append(f"<h3>{_words(rnd, 1, 4)}</h3>")
        elif shape < 0.8:
            body.append(f"<p>{_words(rnd, 2, 8)}</p>")
        else:
            body.append(f"<p>{_words(rnd, 8, 40)}.</p>")
    if kind < 0.35:
        tag = rnd.choice(NOISE_TAGS)
        return f"<{tag}{_named(rnd.choice(NOISE_NAMES + [''] * 20))}>{''.join(body)}</{tag}>"
    if kind < 0.8:
        return f"<div{_named(rnd.choice(NOISE_NAMES))}>{''.join(body)}</div>"
    if kind < 0.9:
        return f"<header{_named(rnd.choice(['', 'masthead', 'top']))}>{''.join(body)}</header>"
    if kind < 0.93:
        return f"<div{rnd.choice([' hidden', ' style="display: none"', ' aria-hidden=true'])}>{''.join(body)}</div>"
    links = "".join(f"<li><a href=/y>{_words(rnd, 1, 4)}</a></li>" for _ in range(rnd.randint(3, 9)))
    return f"<ul{_named(rnd.choice(['', 'u1']))}>{links}</ul>"


def _plain(rnd: random.Random) -> str:
    """An unmarked part beside a marked article."""
    lines = "".join(f"<p>{_words(rnd, 2, 25)}{rnd.choice(['.', ''])}</p>" for _ in range(rnd.randint(1, 3)))
    return f"<div{_named(rnd.choice(['', 'c7', 'row']))}>{lines}</div>"


def _article(rnd: random.Random) -> tuple[str, list[str]]:
    body, kept = [], []

    def block(tag: str, text: str, name: str = "") -> None:
        body.append(f"<{tag}{_named(name)}>{text}</{tag}>")
        kept.append(text)

    block(rnd.choice(["h1", "h2"]), _words(rnd, 2, 9))
    for _ in range(rnd.randint(1, 14)):
        shape = rnd.random()
        name = rnd.choice(QUIET_NAMES) if rnd.random() < 0.25 else ""
        if shape < 0.55:
            block("p", _words(rnd, 5, 60) + rnd.choice([".", ".", ".", "!", "?", ":", ""]), name)
        elif shape < 0.65:
            block(rnd.choice(["h2", "h3"]), _words(rnd, 1, 6))
        elif shape < 0.72:
            block("blockquote", _words(rnd, 6, 30) + ".", rnd.choice(["reply", "quote", "", name]))
        elif shape < 0.8:
            body.append("<ul>")
            linked = rnd.choice([0, 0, 0.3, 1])  # of the items, those that are all link
            for _ in range(rnd.randint(2, 5)):
                if rnd.random() < linked:
                    kept.append(_words(rnd, 1, 6))
                    body.append(f"<li><a href=/w>{kept[-1]}</a></li>")
                else:
                    block("li", _words(rnd, 1, 12) + rnd.choice([".", "", ""]))
            body.append("</ul>")
        elif shape < 0.86:
            body.append("<table>")
            for _ in range(rnd.randint(2, 4)):
                body.append("<tr>")
                for _ in range(3):
                    block("td", rnd.choice([str(rnd.randint(1, 999)), _words(rnd, 1, 3)]))
                body.append("</tr>")
            body.append("</table>")
        elif shape < 0.9:
            block("p", _words(rnd, 1, 4) + rnd.choice([".", "", "!"]))
        elif shape < 0.93:  # a line that is all link
            kept.append(_words(rnd, 1, 9))
            body.append(f"<p><a href=/z>{kept[-1]}</a></p>")
        else:
            body.append(f"<div{_named(rnd.choice(QUIET_NAMES))}>")
            block("p", _words(rnd, 8, 40) + ".")
            body.append("</div>")
        if rnd.random() < 0.12:
            body.append(_noise(rnd, marked=True))
    return "".join(body), kept


def made_page(rnd: random.Random) -> tuple[str, list[str]]:
    """(html, texts of the article's blocks in order); half of the pages mark their article by an element."""
    body, kept = _article(rnd)
    if (kind := rnd.random()) < 0.5:
        tag = rnd.choice(["article", "article", "main"])
        body = f"<{tag}{_named(rnd.choice(ARTICLE_NAMES))}>{body}</{tag}>"
    elif kind < 0.95:
        body = f"<div{_named(rnd.choice(ARTICLE_NAMES))}>{body}</div>"
    part = lambda: _plain(rnd) if kind < 0.5 and rnd.random() < 0.2 else _noise(rnd)
    before = "".join(part() for _ in range(rnd.randint(0, 3)))
    after = "".join(part() for _ in range(rnd.randint(0, 4)))
    return f"<html><head><title>t</title></head><body>{before}{body}{after}</body></html>", kept
