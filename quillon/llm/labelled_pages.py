"""Labelled pages for training, made by rule: many layouts, each part marked as main text or not."""

from __future__ import annotations

import random

SYLLABLES = "ba co de fi gu ha je ki lo mu na pe qui ro sa te ul va wen xo".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def one(self, *options):
        return self.r.choice(options)

    def maybe(self, part, odds=0.5):
        return part() if self.r.random() < odds else ""

    def many(self, part, low, high):
        return "".join(part() for _ in range(self.r.randint(low, high)))

    def word(self):
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4))) + self.one("", "", "", "", ",", "&amp;", "###", "!!")

    def words(self, low, high):
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low=3, high=18):
        return self.words(low, high).capitalize() + self.one(".", ".", ".", "!", "?")

    def prose(self):
        if self.r.random() < 0.1:  # some texts have no sentences
            return " ".join([self.word()] * self.r.randint(1, 6)) + " " + self.words(5, 60)
        return " ".join(self.sentence() for _ in range(self.one(1, 1, 2, 3, 5, 8)))

    # --- main text ---

    def paragraph(self):
        kind = self.r.random()
        if kind < 0.1:
            return f"<p>{self.sentence(1, 2)}</p>"
        if kind < 0.2:
            return f"<p><b>{self.prose()}<br>"  # left open, as pages have it
        if kind < 0.35:
            return f'<p>{self.prose()} <a href="/x">{self.words(1, 4)}</a> {self.prose()}</p>'
        if kind < 0.42:
            return f"<p>{self.prose()} <i>{self.words(1, 3)}</i> {self.sentence()}"
        if kind < 0.5:
            return f"<p>{self.prose()} {self.inline()} {self.maybe(self.prose)}</p>"
        return f"<p>{self.prose()}</p>"

    def inline(self):
        """Elements within a line that mean little, or that few pages have."""
        return self.one(
            lambda: f"<math><mi>{self.word()}</mi><mo>=</mo><mn>{self.r.randint(1, 99)}</mn></math>",
            lambda: f"<span>{self.words(1, 6)}</span>",
            lambda: f"<code>{self.words(1, 3)}</code>",
            lambda: f"<x-term>{self.words(1, 3)}</x-term>",
            lambda: f"<sup>{self.r.randint(1, 99)}</sup>",
            lambda: f'<object data="a">{self.words(1, 6)}</object>',
        )()

    def body(self):
        extra = [
            lambda: "<ul>" + self.links(2, 4) + "</ul>",
            lambda: f'<object data="a">{self.sentence()}</object>',
            lambda: f"<noscript>{self.sentence()}</noscript>",
            lambda: f"<figure><svg><text>{self.words(1, 3)}</text></svg></figure>",
            lambda: f"<div>{self.prose()}</div>",
            lambda: f"<math><mi>{self.word()}</mi><mo>+</mo><mi>{self.word()}</mi></math>",
            lambda: f"<h2>{self.words(1, 6)}</h2>",
            lambda: "<ul>" + self.many(lambda: f"<li>{self.sentence(2, 12)}</li>", 2, 6) + "</ul>",
            lambda: f"<blockquote>{self.prose()}</blockquote>",
            lambda: f"<pre>{self.words(4, 30)}</pre>",
            lambda: f'<figure><img src="a"><figcaption>{self.sentence()}</figcaption></figure>',
            lambda: "<table>" + self.many(lambda: f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 3)}</td></tr>", 2, 5) + "</table>",
        ]
        parts = [self.paragraph() for _ in range(self.one(1, 2, 3, 5, 9))]
        parts += [self.r.choice(extra)() for _ in range(self.one(0, 0, 1, 2))]
        self.r.shuffle(parts)
        return "".join(parts)

    def article(self):
        title = self.maybe(lambda: f"<{self.one('h1', 'h1', 'h2')}>{self.words(2, 9)}{self.one('', '.')}</h1>".replace("<h2>", "<h1>"), 0.85)
        inner = title + (self.body() if self.r.random() < 0.85 else f"<p>{self.sentence(1, 6)}</p>")
        inside = self.maybe(lambda: self.mark0(self.one(self.advert, self.share, self.related)()), 0.25)
        if inside:
            inner += inside + self.body() if self.r.random() < 0.6 else inside
        inner += self.maybe(lambda: self.mark0(self.comments()), 0.2)
        named = self.one("", "content", "post-body", "entry-content", "story", "article-text", "prose", "main", "x12", "col-8", "text")
        attrs = f' {self.one("class", "id")}="{named}"' if named else ""
        form = self.one("article", "article", "article", "main", "div", "div", "section", "table")
        if form == "table":
            made = f'<table><tr><td{attrs} data-main="1">{inner}</td></tr></table>'
        else:
            made = f'<{form}{attrs} data-main="1">{inner}</{form}>'
        return self.wrapped(made) if self.r.random() < 0.3 else made

    def wrapped(self, part):
        """Boxes around a part, as grids of columns have them."""
        for _ in range(self.r.randint(1, 3)):
            name = self.one("", "wrap", "wrapper", "row", "col", "col-8", "grid", "container", "inner", "x7")
            part = f'<div class="{name}">{part}</div>' if name else f"<div>{part}</div>"
        return part

    def loose(self):
        """Main text in no element of its own: paragraphs among the page's other parts, or bare text."""
        kind = self.r.random()
        if kind < 0.6:
            return self.maybe(lambda: f"<h1>{self.words(2, 9)}</h1>", 0.7) + self.body()
        breaks = self.one("<br>", "<br><br>", "\n\n", "<hr>")
        return self.maybe(lambda: f"<h1>{self.words(2, 9)}</h1>", 0.3) + breaks.join(self.prose() for _ in range(self.one(1, 2, 4)))

    # --- the rest ---

    def mark0(self, part):
        return part.replace(">", ' data-main="0">', 1) if part else part

    def links(self, low=3, high=8, tag="li"):
        return self.many(lambda: f'<{tag}><a href="/{self.word()}">{self.words(1, 3)}</a></{tag}>', low, high)

    def menu(self):
        return self.one(
            lambda: f"<nav><ul>{self.links()}</ul></nav>",
            lambda: f"<nav>{self.links(tag='span')}</nav>",
            lambda: f'<div class="{self.one("menu", "navbar", "topnav", "breadcrumb")}"><ul>{self.links()}</ul></div>',
            lambda: f"<ul>{self.links(4, 9)}</ul>",
            lambda: f'<div role="navigation">{self.links(tag="div")}</div>',
        )()

    def header(self):
        return self.one(
            lambda: f'<header><a href="/">{self.words(1, 3)}</a>{self.maybe(self.menu)}</header>',
            lambda: f'<div id="header"><h1>{self.words(1, 4)}</h1><p>{self.sentence(3, 8)}</p></div>',
            lambda: f'<header class="masthead"><h1>{self.words(1, 3)}</h1><p>{self.sentence(3, 8)}</p></header>',
            lambda: f'<div class="topbar">{self.words(1, 5)}</div>',
        )()

    def footer(self):
        return self.one(
            lambda: f"<footer>&copy; {self.word()}.example &middot; {self.prose()}</footer>",
            lambda: f"<footer><p>{self.sentence()}</p><ul>{self.links()}</ul></footer>",
            lambda: f'<div class="{self.one("footer", "site-footer", "copyright")}"><p>{self.sentence()}</p>{self.maybe(lambda: self.links(tag="span"))}</div>',
            lambda: f'<div id="footer">&copy; 2020 {self.words(1, 4)}. {self.sentence()}</div>',
        )()

    def advert(self):
        name = self.one("ad", "ads", "advert", "sponsored", "ad-slot", "promo", "advertisement")
        return self.one(
            lambda: f'<div class="{name}">{self.prose()}</div>',
            lambda: f'<div class="{name}"><p>{self.prose()}</p><a href="/buy">{self.words(1, 3)}</a></div>',
            lambda: f'<aside class="{name}"><p>{self.sentence()}</p></aside>',
            lambda: f'<div id="{name}-1"><h3>{self.words(2, 5)}</h3><p>{self.prose()}</p></div>',
            lambda: f'<ins class="adsbygoogle">{self.sentence()}</ins>',
        )()

    def aside(self):
        return self.one(
            lambda: f"<aside><h3>{self.words(1, 4)}</h3><ul>{self.links()}</ul></aside>",
            lambda: f"<aside><p>{self.prose()}</p></aside>",
            lambda: f'<div class="sidebar"><h3>{self.words(1, 4)}</h3><p>{self.prose()}</p><ul>{self.links()}</ul></div>',
            lambda: f'<div id="right-sidebar"><div class="widget"><h4>{self.words(1, 3)}</h4><p>{self.sentence()}</p></div></div>',
        )()

    def related(self):
        return f'<div class="{self.one("related", "recommended", "more-stories")}"><h3>{self.words(1, 3)}</h3><ul>{self.links()}</ul></div>'

    def share(self):
        return f'<div class="{self.one("share", "social")}">{self.links(2, 4, "span")}</div>'

    def notice(self):
        name = self.one("cookie-notice", "cookie-banner", "notice", "consent", "alert", "gdpr-popup")
        return self.one(
            lambda: f'<div class="{name}"><p>{self.prose()}</p><button>OK</button></div>',
            lambda: f'<div id="{name}">{self.sentence()} <a href="/p">{self.words(1, 2)}</a></div>',
            lambda: f'<section class="{name}" role="dialog"><p>{self.sentence()}</p></section>',
        )()

    def form(self):
        return self.one(
            lambda: f'<form action="/s"><label>{self.words(1, 3)}</label><input name="q"><button>{self.word()}</button></form>',
            lambda: f'<form class="newsletter"><h3>{self.words(1, 4)}</h3><p>{self.prose()}</p><input><button>{self.word()}</button></form>',
            lambda: f"<form><p>{self.sentence()}</p><select><option>{self.word()}</option></select></form>",
        )()

    def comments(self):
        one = self.one(
            lambda: f'<div class="comment"><b>{self.word()}</b><p>{self.prose()}</p></div>',
            lambda: f"<li><p>{self.word()}</p><p>{self.prose()}</p></li>",
            lambda: f'<article class="comment-body"><p>{self.prose()}</p></article>',
            lambda: f"<li>{self.prose()}</li>",
            lambda: f"<p>{self.prose()}</p>",
            lambda: f"<div>{self.prose()}</div>",
        )
        inner = "".join(one() for _ in range(self.r.randint(1, 5)))
        return self.one(
            lambda: f'<section id="comments"><h2>{self.words(1, 3)}</h2>{inner}</section>',
            lambda: f'<div class="comments">{inner}</div>',
            lambda: f'<ol class="commentlist">{inner}</ol>',
            lambda: f'<ul id="{self.one("comments", "replies", "comment-list")}">{inner}</ul>',
            lambda: f'<div id="disqus_thread">{inner}</div>',
            lambda: f'<div class="{self.one("discussion", "replies", "user-feedback", "fb-comments")}">{inner}</div>',
            lambda: f'<section class="reader-comments"><h3>{self.words(1, 3)}</h3>{inner}</section>',
        )()

    def page(self):
        head = '<head><meta charset="utf-8"><title>t</title><style>p{margin:0}</style><script>var t="</p>";</script></head>'
        before = [x for x in (self.header, self.menu, self.notice, self.advert, self.form) if self.r.random() < 0.45]
        after = [x for x in (self.comments, self.aside, self.advert, self.related, self.form, self.footer, self.notice, self.menu) if self.r.random() < 0.45]
        self.r.shuffle(before)
        if self.r.random() < 0.15:  # nothing but the text, or little else
            before, after = before[:1] if self.r.random() < 0.3 else [], []
        if self.r.random() < 0.2:
            main, rest = self.loose(), "".join(self.mark0(x()) for x in after)
            around = "".join(self.mark0(x()) for x in before)
            if not (around or rest) and self.r.random() < 0.3 and not main.startswith("<"):
                return f'<span data-main="1">{main}</span>'
            return f'<!DOCTYPE html><html>{head}<body data-main="1">{around}{main}{rest}</body></html>'
        parts = "".join(x() for x in before)
        main, rest = self.article(), "".join(x() for x in after)
        if self.r.random() < 0.35:  # a wrapper around some of it
            main, rest = f'<div class="{self.one("wrapper", "page", "container", "row", "col")}">{main}{rest}</div>', ""
        end = self.one("</body></html>", "</body></html>", "")
        return f"<!DOCTYPE html><html>{head}<body>{parts}{main}{rest}{end}"


def pages(n: int = 480, seed: int = 7) -> list[str]:
    """Pages whose elements with data-main="1" hold main text, but for those in them with data-main="0"."""
    return [Maker(seed * 1000 + i).page() for i in range(n)]
