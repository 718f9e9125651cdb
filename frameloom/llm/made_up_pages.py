"""Made-up pages with a label for each block, to train and test the block labeller. No page of any table is used."""

from __future__ import annotations

import random

from . import html_blocks

SYLLABLES = "an be ca de er fo ga hi in jo ka lu mi no or pa qui re sa ti un ve wo za ble tion ing ment ed ly ous ist ria mon tel vor sch ung eau que ción ado".split()
COMMON = "the of and to in is that for it was on are with as der die das und ist von mit ein le la les des et que est dans pour el los por una con del para no se".split()
#: Words of boilerplate, in place of invented ones, and class names by what they stand for.
PHRASES = {
    "nav": ["Home", "About", "Contact", "News", "Sports", "Login", "Sign up", "Archive", "Blog", "Shop", "Help", "Products", "Startseite", "Accueil", "Inicio", "Menu", "Search", "More", "Next", "Previous", "World", "Business", "Careers"],
    "footer": ["© 2023 Example Inc. All rights reserved.", "Privacy Policy", "Terms of Service", "Imprint", "Contact us", "Cookie settings", "Powered by software", "Sitemap", "Datenschutz", "Mentions légales", "Copyright 2021"],
    "notice": ["We use cookies to improve your experience.", "Accept all", "This site uses cookies.", "By continuing you agree to our policy.", "Your browser is out of date.", "Breaking: read the latest", "Wir verwenden Cookies.", "Please enable JavaScript.", "Got it", "Notice: the service will be down tonight."],
    "form": ["Subscribe to our newsletter", "Your email", "Submit", "Name", "Send", "Password", "Search this site", "Enter your email address", "Leave a message", "Sign in", "I agree to the terms"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Limited offer", "50% off today only", "Shop the sale", "Anzeige", "Publicité", "Click here to win"],
    "side": ["Related articles", "Most popular", "Trending", "You may also like", "Tags", "Recent posts", "Share this", "Follow us", "Categories", "Read more", "Archives", "Latest news"],
    "comment": ["Reply", "3 comments", "Comments", "Leave a comment", "Anonymous says:", "I agree with this.", "Great article!", "posted 2 hours ago", "Like", "Report", "First!"],
    "header": ["Daily Example", "Example News", "The Example", "Welcome to our site", "Tuesday, 4 May", "Your daily source", "Example.com"],
}
CLASSES = {
    "nav": ["nav", "menu", "navbar", "main-menu", "breadcrumb", "breadcrumbs", "topnav", "navigation", "pagination", "pager", "site-nav", "nav-list"],
    "footer": ["footer", "site-footer", "copyright", "page-footer", "colophon", "bottom", "legal", "foot"],
    "notice": ["cookie", "cookie-banner", "notice", "consent", "alert", "gdpr", "banner", "popup", "modal", "message", "warning", "announcement", "overlay", "paywall"],
    "form": ["form", "newsletter", "subscribe", "signup", "search", "login", "search-form", "contact-form"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "adsbygoogle", "sponsor", "promotion", "banner-ad", "commercial"],
    "side": ["sidebar", "side", "widget", "related", "right-column", "aside", "share", "social", "recommended", "popular", "tags", "teaser", "more-stories"],
    "comment": ["comments", "comment", "comment-list", "disqus", "replies", "comment-body", "responses", "user-comments", "discussion", "reviews"],
    "header": ["header", "masthead", "site-header", "top", "branding", "logo", "page-header", "head", "topbar"],
    "article": ["article", "content", "post", "entry", "story", "article-body", "post-content", "main", "text", "body", "entry-content", "page-content"],
}
ELEMENTS = {"nav": "nav", "footer": "footer", "notice": "div", "form": "form", "ad": "aside", "side": "aside", "comment": "section", "header": "header", "article": "article"}


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.html, self.n = rng, [], 0
        self.opaque = rng.random() < 0.12  # class names that say nothing
        self.loose = rng.random() < 0.3  # ends left out

    def word(self) -> str:
        r = self.rng
        return r.choice(COMMON) if r.random() < 0.35 else "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))

    def prose(self, low: int, high: int) -> str:
        r, out = self.rng, []
        for _ in range(r.randint(low, high)):
            w = [self.word() for _ in range(r.randint(3, 16))]
            out.append(" ".join(w).capitalize() + r.choice([".", ".", ".", "!", "?"]))
        text = " ".join(out)
        if r.random() < 0.15:
            text = text.replace(" ", r.choice([" &amp; ", "&nbsp;", " *** ", "\n "]), 2)
        return text

    def attributes(self, kind: str) -> str:
        r = self.rng
        if self.opaque:
            return f' class="c{r.randint(100, 999)}"' if r.random() < 0.7 else ""
        if r.random() < 0.12 and kind != "ad":
            return ""
        name = r.choice(CLASSES[kind])
        return f' {r.choice(["class", "class", "id"])}="{name}{r.choice(["", "", f" x{r.randint(1, 99)}", f" {r.choice(CLASSES[kind])}"])}"'

    def mark(self, kept: int) -> str:
        """Text of a block starts with a private character for its label."""
        return "\ue001" if kept else "\ue000"

    def element(self, tag: str, text: str, kept: int, attributes: str = "") -> None:
        r = self.rng
        words = text.split(" ")
        if len(words) > 8 and r.random() < 0.3:
            k = r.randrange(len(words))
            words[k] = r.choice(["<b>{}</b>", '<a href="/x">{}</a>', "<em>{}</em>", "{}<br>"]).format(words[k])
            text = " ".join(words)
        end = "" if tag in ("p", "li") and self.loose else f"</{tag}>"
        self.html.append(f"<{tag}{attributes}>{self.mark(kept)}{text}{end}")

    def box(self, kind: str) -> None:
        """A part that isn't main text, by its own element or a div."""
        r = self.rng
        own = r.random() < 0.55 or kind in ("form",) or self.opaque and r.random() < 0.8
        tag = ELEMENTS[kind] if own and not (kind == "ad" and not self.opaque and r.random() < 0.7) else r.choice(["div", "div", "section", "div"])
        attributes = self.attributes(kind)
        if not attributes and tag in ("div", "section"):
            attributes = f' class="{r.choice(CLASSES[kind])}"'
        self.html.append(f"<{tag}{attributes}>")
        wrap = r.random() < 0.3
        if wrap:
            self.html.append(f'<div class="{r.choice(["inner", "container", "wrap", "row"])}">')
        if kind in ("nav", "header") and r.random() < 0.85 or kind in ("side", "footer") and r.random() < 0.5:
            if kind == "header":
                self.element(r.choice(["div", "h1", "p", "span"]) if r.random() < 0.8 else "h2", r.choice(PHRASES["header"]) if r.random() < 0.6 else self.prose(1, 1), 0)
            if kind in ("side", "footer"):
                self.element(r.choice(["h2", "h3", "h4", "p"]), r.choice(PHRASES[kind]), 0)
            self.html.append("<ul>")
            for _ in range(r.randint(2, 9)):
                text = r.choice(PHRASES["nav"]) if r.random() < 0.4 else " ".join(self.word() for _ in range(r.randint(1, 5)))
                self.html.append(f'<li>{self.mark(0)}<a href="/{self.word()}">{text}</a>{"" if self.loose else "</li>"}')
            self.html.append("</ul>")
        elif kind == "form":
            for _ in range(r.randint(1, 4)):
                self.element(r.choice(["label", "p", "div", "button", "legend"]), r.choice(PHRASES["form"]) if r.random() < 0.7 else self.prose(1, 1), 0)
        elif kind == "comment":
            if r.random() < 0.7:
                self.element(r.choice(["h2", "h3", "h4"]), r.choice(PHRASES["comment"]), 0)
            items = r.choice(["div", "li", "article"])
            for _ in range(r.randint(1, 5)):
                self.html.append(f"<{items}{self.attributes('comment') if r.random() < 0.6 else ''}>")
                if r.random() < 0.5:
                    self.element("span" if r.random() < 0.3 else "div", r.choice(PHRASES["comment"]), 0)
                for _ in range(r.randint(1, 2)):
                    self.element("p", self.prose(1, 4), 0)
                self.html.append(f"</{items}>")
        else:
            for _ in range(r.randint(1, 4)):
                text = r.choice(PHRASES[kind]) if r.random() < 0.45 else self.prose(1, 3)
                tag2 = r.choice(["p", "div", "span", "h3", "li", ""])
                if tag2:
                    self.element(tag2, text, 0)
                else:
                    self.html.append(f"<br>{self.mark(0)}{text}<hr>")
        if wrap:
            self.html.append("</div>")
        self.html.append(f"</{tag}>")

    def article(self) -> None:
        r = self.rng
        how = r.random()
        tag = "article" if how < 0.45 or self.opaque else "main" if how < 0.6 else "div" if how < 0.95 else ""
        if tag:
            attributes = self.attributes("article") if r.random() < 0.7 else ""
            if tag == "div" and not attributes:
                attributes = f' class="{r.choice(CLASSES["article"])}"'
            self.html.append(f"<{tag}{attributes}>")
        if r.random() < 0.85:
            in_header = r.random() < 0.15 and tag
            self.html.append("<header>" if in_header else "")
            self.element("h1" if r.random() < 0.8 else "h2", self.prose(1, 1), 1)
            if r.random() < 0.2:
                self.element("p", "By " + self.word().capitalize() + " " + self.word().capitalize(), 1)
            self.html.append("</header>" if in_header else "")
        inner = r.random() < 0.25
        if inner:
            self.html.append(f'<div class="{r.choice(CLASSES["article"])}">' if not self.opaque else "<div>")
        for _ in range(r.choice([1, 2, 3, 4, 6, 8, 12, 16, 24, 40])):
            what = r.random()
            if what < 0.72:
                broken = r.random() < 0.12
                self.element("p", ("<b>" if broken else "") + self.prose(1, 7) + ("<br>" if broken else ""), 1)
            elif what < 0.80:
                self.element(r.choice(["h2", "h3"]), self.prose(1, 1).rstrip("."), 1)
            elif what < 0.85:
                kind = r.choice(["ul", "ol"])
                self.html.append(f"<{kind}>")
                for _ in range(r.randint(2, 5)):
                    self.element("li", self.prose(1, 1), 1)
                self.html.append(f"</{kind}>")
            elif what < 0.88:
                self.html.append("<blockquote>")
                self.element("p", self.prose(1, 2), 1)
                self.html.append("</blockquote>")
            elif what < 0.90:
                self.html.append("<table><tr>")
                for _ in range(r.randint(2, 4)):
                    self.element("td", self.prose(1, 1), 1)
                self.html.append("</tr></table>")
            elif what < 0.92:
                self.html.append('<figure><img src="x.png">')
                self.element("figcaption", self.prose(1, 1), 1)
                self.html.append("</figure>")
            elif what < 0.95:
                self.box(r.choice(["ad", "side", "form", "notice", "ad"]))
            else:
                self.element("pre" if r.random() < 0.5 else "div", self.prose(1, 2), 1)
        if inner:
            self.html.append("</div>")
        if tag and r.random() < 0.15:
            self.box(r.choice(["side", "comment", "form"]))
        if tag:
            self.html.append(f"</{tag}>")

    def page(self) -> str:
        r = self.rng
        before = [k for k in ("notice", "header", "nav", "ad", "form", "nav") if r.random() < (0.6 if k == "nav" else 0.35)]
        after = [k for k in ("comment", "side", "ad", "form", "notice", "nav", "footer") if r.random() < (0.75 if k == "footer" else 0.3)]
        if r.random() < 0.2:
            r.shuffle(before)
        if r.random() < 0.3:
            before.append("side")
        self.html.append(f"<!DOCTYPE html><html><head><title>{self.prose(1, 1)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>")
        wrap = r.random() < 0.4
        self.html.append(f'<div id="{r.choice(["page", "wrapper", "container", "root", "app"])}">' if wrap else "")
        for k in before:
            self.box(k)
        if r.random() > 0.04:
            self.article()
        for k in after:
            self.box(k)
        self.html.append("</div>" if wrap else "")
        self.html.append("" if r.random() < 0.15 else "</body></html>")
        return "".join(self.html)


def labelled_page(rng: random.Random) -> list[tuple[html_blocks.Block, int]]:
    """The blocks of a made-up page with 1 for main text and 0 for the rest."""
    return with_labels(_Page(rng).page())


def with_labels(page: str) -> list[tuple[html_blocks.Block, int]]:
    out = []
    for b in html_blocks.blocks(page):
        label = int("\ue001" in b.text)
        text = " ".join(b.text.replace("\ue001", "").replace("\ue000", "").split())
        if text:
            out.append((html_blocks.Block(b.path, text, b.linked), label))
    return out
