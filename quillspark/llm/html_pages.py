"""Labelled pages: made-up sites whose every piece of text is known to be article or not.

A page is a list of (fragment, label): True for article text, False for other
text, None for markup.  Layouts, container names and the wording of boilerplate
vary, so that weights learnt from the pages follow the role of a tag or class
name and not one site's template.
"""

from __future__ import annotations

import random

Page = list[tuple[str, bool | None]]

_SYLLABLES = "ka lo mi ten sor ul ver ath ind ome pra lin est or qui ban".split()
#: (tag, class or id values) of boxes beside the article
_BOXES = [
    ("nav", ["", "main-nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "pagination"]),
    ("header", ["", "site-header", "masthead", "page-header"]),
    ("footer", ["", "site-footer", "page-footer"]),
    ("aside", ["", "sidebar", "widget", "related"]),
    ("form", ["", "search", "login", "newsletter", "comment-form"]),
    ("menu", [""]),
    ("dialog", ["", "modal"]),
    ("noscript", [""]),
    ("template", [""]),
    ("select", [""]),
    ("button", ["", "btn"]),
    ("svg", [""]),
    ("iframe", ["", "ad-frame"]),
    ("div", ["ad", "ads", "advert", "advertisement", "ad-slot", "ad-banner", "adsbygoogle", "sponsored", "sponsor", "promo", "banner"]),
    ("div", ["sidebar", "side-bar", "widget", "widget-area", "menu", "main-menu", "nav", "navigation", "navbar", "topbar", "toolbar", "breadcrumb", "breadcrumbs", "pagination", "pager"]),
    ("div", ["header", "site-header", "masthead", "footer", "site-footer", "copyright", "skip-link"]),
    ("div", ["cookie", "cookies", "cookie-notice", "cookie-banner", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "paywall"]),
    ("div", ["comments", "comment", "comment-list", "reader-comments", "user-comments", "disqus", "respond", "replies", "responses", "discussion"]),
    ("section", ["comments", "reader-comments", "related", "related-posts", "recommended", "newsletter", "subscribe", "share", "social", "promo", "ads", "notice", "replies"]),
    ("div", ["share", "sharing", "social", "social-share", "related", "related-posts", "recommended", "more-stories", "newsletter", "newsletter-signup", "subscribe", "signup", "tags"]),
    ("ul", ["menu", "nav", "breadcrumb", "breadcrumbs", "pagination", "share", "social", "comment-list", "comments"]),
    ("ol", ["comments", "comment-list", "breadcrumb", "breadcrumbs"]),
    ("p", ["notice", "cookie-notice", "copyright", "ad", "promo"]),
    ("span", ["ad", "ads", "share", "sponsored"]),
]
_ROLES = ["navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"]
_CONTAINERS = [("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"), ("div", "entry-content"), ("div", "post-content"), ("section", "story"), ("div", "main")]
#: Containers whose names share words with boxes
_CONTAINERS += [("div", x) for x in "page page-content page-body site-main site-content content-area reader-content user-content blog-posts post-list link-list read-more-text side-by-side form-text list-page login-help search-text top-story bar-chart-text".split()]
_WRAPPERS = ["", "", '<div id="page">', '<div class="site">', '<div id="wrapper">', '<div class="container has-sidebar">', '<div class="page site-wrap"><div class="row">']


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def _box(rng: random.Random) -> Page:
    tag, names = rng.choice(_BOXES)
    name = rng.choice(names)
    attr = f' {rng.choice(["class", "class", "id"])}="{name}"' if name else ""
    if tag == "div" and rng.random() < 0.1:
        attr = f' role="{rng.choice(_ROLES)}"'
    elif tag == "div" and rng.random() < 0.1:
        attr = rng.choice([" hidden", ' aria-hidden="true"', ' style="display:none"', ' class="x" hidden'])
    out: Page = [(f"<{tag}{attr}>", None)]
    style = rng.randrange(4) if tag not in ("p", "span") else 3  # a paragraph holds no blocks: the first would end it
    if style == 0:
        for _ in range(rng.randint(2, 8)):
            out += [('<li><a href="#">', None), (_words(rng, rng.randint(1, 3)), False), ("</a></li>", None)]
    elif style == 1:
        for _ in range(rng.randint(1, 4)):
            out += [("<p>", None), (_words(rng, rng.randint(3, 40)), False), ("</p>", None)]
    elif style == 2:
        out += [("<div><a>", None), (_words(rng, 2), False), ("</a> ", None), (_words(rng, rng.randint(2, 12)), False), ("</div>", None)]
    else:
        out.append((_words(rng, rng.randint(2, 15)), False))
    return out + [(f"</{tag}>", None)]


def _article(rng: random.Random) -> Page:
    tag, name = rng.choice(_CONTAINERS)
    out: Page = [(f"<{tag}" + (f' class="{name}"' if name else "") + ">", None)]
    if rng.random() < 0.8:
        out += [('<div class="article-header">' if rng.random() < 0.1 else "", None), ("<h1>", None), (_words(rng, rng.randint(2, 9)), True), ("</h1>", None)]
    for _ in range(rng.randint(1, 12)):
        kind = rng.randrange(13)
        if kind < 7:
            out += [("<p>", None), (_words(rng, rng.randint(1, 60)), True)]
            if rng.random() < 0.3:
                out += [(rng.choice([" <b>", " <em>", ' <a href="x">', " <span>"]), None), (_words(rng, rng.randint(1, 4)), True), (rng.choice(["</b> ", "</em> ", "</a> ", "<br>"]), None), (_words(rng, 5), True)]
            out.append((rng.choice(["</p>", "</p>", "</p>", ""]), None))
        elif kind == 7:
            out += [("<h2>", None), (_words(rng, 3), True), ("</h2>", None)]
        elif kind == 8:
            out.append(("<ul>", None))
            for _ in range(rng.randint(2, 5)):
                out += [("<li>", None), (_words(rng, rng.randint(2, 12)), True), ("</li>", None)]
            out.append(("</ul>", None))
        elif kind == 9:
            out += [("<blockquote>", None), (_words(rng, 14), True), ("</blockquote>", None)]
        elif kind == 10:
            out += [("<table><tr><td>", None), (_words(rng, 2), True), ("</td><td>", None), (_words(rng, 2), True), ("</td></tr></table>", None)]
        elif kind == 11 and rng.random() < 0.5:
            out += _box(rng)
        elif kind == 12:
            out += [(rng.choice(["<div>", "<div>", '<div class="row">', "<section>"]), None), ("<p>", None), (_words(rng, rng.randint(3, 40)), True), ("</p>", None), ("</div>", None)]
            if out[-5][0] == "<section>":
                out[-1] = ("</section>", None)
        else:
            out += [("<pre><code>", None), (_words(rng, 8), True), ("</code></pre>", None)]
    return out + [(f"</{tag}>", None)]


def _line(rng: random.Random) -> Page:
    """A short line of text that no name tells (a date, rights, a slogan)."""
    tag = rng.choice(["div", "div", "div", "section"])
    return [(f"<{tag}>", None), (_words(rng, rng.randint(1, 6)), False), (f"</{tag}>", None)]


def labelled_pages(n: int = 1500, seed: int = 11) -> list[Page]:
    rng = random.Random(seed)
    pages = []
    for _ in range(n):
        page: Page = [("<html><head><title>", None), (_words(rng, 4), False), ("</title></head><body>" + rng.choice(_WRAPPERS), None)]
        for _ in range(rng.randint(1, 4)):
            page += _box(rng)
        if rng.random() < 0.3:  # a stray line that no box names
            page += [("<div><a>", None), (_words(rng, 2), False), ("</a></div>", None)]
        if rng.random() < 0.3:
            page += _line(rng)
        page += _article(rng)
        if rng.random() < 0.4:
            page += _line(rng)
        if rng.random() < 0.2:
            page += [("<div><a>", None), (_words(rng, 2), False), ("</a></div>", None)]
        for _ in range(rng.randint(1, 4)):
            page += _box(rng)
        pages.append(page + [("</body></html>", None)] if rng.random() < 0.9 else page)
    return pages
