"""Labelled web pages for training: made-up sites of many layouts, each with the blocks of its main text."""

from __future__ import annotations

import random
from html import escape

_SYLLABLES = "an er on th ed sh ing re le ou en que el des ber ein lich tion ado ment ar os ne ka mi to ver heit ción eau ß ü é ha st nd".split()
_MENU = "Home About Contact Products News Blog Shop Login Search Help Archive Team Jobs Sports World Politics Culture".split()


def labelled_pages(count: int = 360, seed: int = 11) -> list[tuple[str, list[str]]]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))

    def sentence(a: int = 3, b: int = 18) -> str:
        return " ".join(word() + (r.random() < 0.1) * "," for _ in range(r.randint(a, b))).capitalize() + r.choice(["."] * 8 + ["", "?", "!"])

    def prose(a: int, b: int) -> str:
        return " ".join(sentence() for _ in range(r.randint(a, b)))

    menu = lambda: r.choice([r.choice(_MENU), word(), word().capitalize()])
    anchor = lambda text: f'<a href="/{word()}">{escape(text)}</a>'
    items = lambda a, b: "".join(f"<li>{anchor(menu())}</li>" for _ in range(r.randint(a, b)))
    headline = lambda: f"<h{(n := r.choice('2345'))}>{sentence(1, 3)}</h{n}>" * (r.random() < 0.5)
    paragraphs = lambda a, b: "".join(f"<p>{escape(prose(1, 3))}</p>" for _ in range(r.randint(a, b)))
    bare = lambda a, b: escape(prose(a, b))

    def nav() -> str:
        return r.choice([
            lambda: f"<nav><ul>{items(3, 8)}</ul></nav>", lambda: f'<div class="{r.choice(["menu", "nav", "navbar", "navigation", "main-menu", "topnav"])}"><ul>{items(3, 8)}</ul></div>',
            lambda: f'<ul id="{r.choice(["menu", "nav"])}">{items(3, 8)}</ul>', lambda: "<nav>" + " | ".join(anchor(menu()) for _ in range(r.randint(3, 7))) + "</nav>",
            lambda: f'<div class="{r.choice(["breadcrumb", "breadcrumbs"])}">' + " &gt; ".join(anchor(menu()) for _ in range(3)) + f" &gt; {word()}</div>",
            lambda: f'<div role="navigation"><ul>{items(3, 6)}</ul></div>', lambda: f"<nav><p>{bare(1, 2)}</p><ul>{items(2, 5)}</ul></nav>",
        ])()

    def header() -> str:
        return r.choice([lambda: f"<header>{headline()}<p>{bare(1, 2)}</p></header>", lambda: f"<header><h1>{sentence(1, 4)}</h1>{nav()}</header>", lambda: f'<div class="{r.choice(["header", "banner", "masthead", "site-header", "top"])}"><h1>{sentence(1, 3)}</h1><p>{bare(1, 1)}</p></div>', lambda: f'<div id="header"><span>{sentence(2, 6)}</span></div>', lambda: f"<header>{anchor(sentence(1, 3))}</header>"])()

    def ad() -> str:
        name = r.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "sponsor", "ad-slot"])
        inner = r.choice([lambda: bare(1, 3), lambda: f"<p>{bare(1, 3)}</p>", lambda: f"{headline()}<p>{bare(1, 2)}</p>{anchor(sentence(1, 3))}", lambda: f"<span>{bare(1, 2)}</span>"])()
        return f'<{(t := r.choice(["div", "div", "aside", "section"]))} {r.choice(["class", "class", "id"])}="{name}">{inner}</{t}>'

    def notice() -> str:
        name = r.choice(["cookie", "cookies", "cookie-banner", "cookie-notice", "consent", "notice", "alert", "newsletter", "popup", "modal", "subscribe", "gdpr", "privacy-notice", "paywall", "disclaimer"])
        inner = r.choice([lambda: bare(1, 3), lambda: f"<p>{bare(1, 3)}</p><button>{word()}</button>", lambda: f"<p>{bare(1, 2)} {anchor(word())}</p>"])()
        return f'<div {r.choice(["class", "id", "class"])}="{name}">{inner}</div>'

    def aside() -> str:
        inner = r.choice([lambda: f"{headline()}<ul>{items(3, 7)}</ul>", lambda: f"{headline()}{paragraphs(1, 3)}", lambda: bare(1, 2), lambda: f"<p>{anchor(prose(1, 1))}</p><p>{anchor(prose(1, 1))}</p>"])()
        return r.choice(["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="sidebar">{}</div>', '<div class="widget">{}</div>', '<section class="related">{}</section>', '<div class="related-posts">{}</div>', '<div class="share social">{}</div>', '<div class="tags">{}</div>', '<div class="author-bio">{}</div>', '<aside class="sidebar">{}</aside>', '<div class="recommended">{}</div>', '<div role="complementary">{}</div>']).format(inner)

    def form() -> str:
        return r.choice([lambda: f'<form action="/{word()}"><label>{word()}</label><input name="q"><button>{word()}</button></form>', lambda: f"<form><p>{bare(1, 2)}</p><input><button>{word()} {word()}</button></form>", lambda: f'<form class="search"><fieldset><legend>{sentence(1, 3)}</legend><label>{sentence(1, 3)}</label><textarea>{word()}</textarea></fieldset></form>', lambda: f'<div class="{r.choice(["search", "login", "form"])}"><form>{bare(1, 1)}<select><option>{word()}</option></select></form></div>'])()

    def comments() -> str:
        one = lambda: r.choice([lambda: f"<p>{bare(1, 3)}</p>", lambda: f'<div class="comment"><span class="author">{word()}</span><p>{bare(1, 4)}</p></div>', lambda: f"<li>{bare(1, 3)}</li>", lambda: f'<article class="comment"><p>{bare(1, 3)}</p></article>'])()
        inner = headline() + "".join(one() for _ in range(r.randint(1, 5)))
        return r.choice(['<div class="comments">{}</div>', '<section id="comments">{}</section>', '<div id="disqus_thread" class="comment-list">{}</div>', '<section class="comments">{}</section>', '<div class="responses reader-comments">{}</div>', '<ol class="commentlist">{}</ol>', '<div class="discussion replies">{}</div>']).format(inner)

    def footer() -> str:
        inner = r.choice([lambda: f"&copy; {word()}.example.com &middot; {bare(1, 3)}", lambda: f"<p>&copy; 20{r.randint(10, 26)} {word()}</p><ul>{items(2, 5)}</ul>", lambda: bare(1, 2), lambda: f"<p>{bare(1, 3)}</p>", lambda: f"<div><ul>{items(2, 6)}</ul></div><p>{bare(1, 2)}</p>"])()
        return r.choice(["<footer>{}</footer>"] * 3 + ['<div class="footer">{}</div>', '<div id="footer">{}</div>', '<div class="site-footer copyright">{}</div>', '<div role="contentinfo">{}</div>']).format(inner)

    def article() -> tuple[str, list[str]]:
        made: list[str] = []
        kept: list[str] = []

        def put(before: str, text: str, after: str) -> None:
            kept.append(" ".join(text.split()))
            made.append(before + escape(text, quote=False) + after)

        title = r.choice([sentence(2, 9), prose(1, 2)[:60]]).strip()
        style = r.random()
        if r.random() < 0.85:
            put("<h1>", title, "</h1>")
        if style < 0.25:
            put("<p><b>", prose(1, 8), "<br>")
        for _ in range(r.randint(0 if style < 0.25 else 1, 9)):
            x = r.random()
            if x < 0.62:
                put("<p>", prose(1, 5) if r.random() < 0.8 else sentence(1, 3), "</p>")
            elif x < 0.68:
                put("<p><b>", prose(1, 5), "<br>")
            elif x < 0.76:
                put(f"<h{(n := r.choice('234'))}>", sentence(1, 6), f"</h{n}>")
            elif x < 0.82:
                t = r.choice(["ul", "ol"])
                made.append(f"<{t}>")
                for _ in range(r.randint(2, 5)):
                    put("<li>", sentence(2, 12), "</li>")
                made.append(f"</{t}>")
            elif x < 0.86:
                put("<blockquote>", prose(1, 2), "</blockquote>")
            elif x < 0.89:
                put("<pre>", f"{word()} = {word()}({r.randint(0, 99)});", "</pre>")
            elif x < 0.92:
                made.append("<table>")
                for _ in range(2):
                    made.append("<tr>")
                    for _ in range(2):
                        put("<td>", sentence(1, 3), "</td>")
                    made.append("</tr>")
                made.append("</table>")
            elif x < 0.95:
                made.append("<figure>")
                put('<img src="x.png"><figcaption>', sentence(3, 9), "</figcaption>")
                made.append("</figure>")
            else:
                a, b, c = prose(1, 1), word(), sentence(2, 6)
                kept.append(f"{a} {b} {c}")
                made.append(f"<p>{escape(a, quote=False)} {anchor(b)} {escape(c, quote=False)}</p>")
            if r.random() < 0.06:
                made.append(r.choice([ad, notice, aside])())
        if not kept:
            put("<p>", prose(1, 3), "</p>")
        wrap = r.choice(["<article>{}</article>"] * 4 + ["<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="content">{}</div>', '<div class="post">{}</div>', '<div class="article-body">{}</div>', '<div class="entry-content">{}</div>', '<section class="story">{}</section>', '<div role="main">{}</div>', '<div class="main text">{}</div>', "<div><div>{}</div></div>"])
        return wrap.replace("{}", "".join(made)), kept

    pages = []
    for k in range(count):
        body, kept = article()
        before = [f() for f in (nav, header, notice, ad, form, aside) if r.random() < (0.75 if f in (nav, ad) else 0.3)]
        after = [f() for f in (aside, comments, ad, form, notice, nav) if r.random() < (0.4 if f is comments else 0.25)]
        if k % 4:
            r.shuffle(before)
        if r.random() < 0.9:
            after.append(footer())
        inside = r.random()
        if inside < 0.2 and body.endswith("</article>"):  # rests inside the article element
            body = body[: -len("</article>")] + r.choice([comments, aside, ad, footer, form])() + "</article>"
        elif inside < 0.28 and "<article>" in body:
            body = body.replace("<article>", f"<article>{r.choice([ad, nav, notice])()}", 1)
        if r.random() < 0.2:
            before, after = ['<div id="page" class="container wrapper">', *before], [*after, "</div>"]
        head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{sentence(2, 6)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        pages.append((head + "".join(before) + f"<!-- {word()} -->" * (r.random() < 0.5) + body + "".join(after) + r.choice(["</body></html>", ""]), kept))
    return pages
