"""Labelled web pages to train the extraction on: random layouts whose blocks are known to be article or not."""

from __future__ import annotations

import numpy as np

SYLLABLES = [c + v for c in ("b", "d", "f", "k", "l", "m", "n", "p", "r", "s", "t", "v", "st", "tr", "sh", "") for v in ("a", "e", "i", "o", "u", "an", "er", "on", "é", "ü")]
#: Attribute words of containers, by what they hold.
NAMES = {
    "article": "content post article entry story main body text page primary center blog news prose copy single".split() + [""],
    "ad": "ad ads advert advertisement advertising adbox adsense sponsored sponsor promo promotion banner outbrain taboola native-ad ad-slot".split(),
    "aside": "sidebar aside related widget popular trending recommended tags rail right-rail left-col complementary teaser more-stories see-also links toc".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal newsletter subscribe signup paywall dialog toast sticky disclaimer announcement hint overlay".split(),
    "comments": "comments comment discussion replies reply respond responses disqus thread reader-comments cmt feedback reviews user-comments commentlist".split(),
    "share": "share social byline meta breadcrumb breadcrumbs pagination pager author-box toolbar tools print rating dateline caption-bar".split(),
    "footer": "footer copyright legal bottom foot colophon contentinfo site-info".split(),
    "header": "header masthead top branding logo menu nav navbar navigation site-head topbar skip-link search-bar".split(),
}
CUES = {
    "ad": ["Advertisement", "Sponsored", "Buy now", "Special offer"],
    "notice": ["We use cookies", "Accept all cookies", "Subscribe to our newsletter", "Sign up now", "This site uses cookies to improve your experience"],
    "comments": ["Comments", "Leave a reply", "Reply", "3 comments", "Load more comments", "says:", "Log in to comment"],
    "aside": ["Related posts", "Popular", "Read more", "See also", "Recent posts", "Most read"],
    "share": ["Share", "Tweet", "Print", "Home", "Previous", "Next", "By the editors"],
    "footer": ["All rights reserved", "Privacy policy", "Terms of use", "Contact", "©"],
    "header": ["Home", "About", "Contact", "Search", "Login", "News"],
    "form": ["Search", "Email", "Your name", "Submit", "Password", "Send"],
}


class Pages:
    def __init__(self, seed: int = 11):
        self.rng = np.random.default_rng(seed)
        self.vocabulary = ["".join(self.pick(SYLLABLES) for _ in range(int(self.rng.integers(1, 5)))) for _ in range(4000)]

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.pick(self.vocabulary) for _ in range(int(self.rng.integers(lo, hi + 1)))).capitalize()

    def prose(self, lo: int = 1, hi: int = 8) -> str:
        return " ".join(self.words(1, 24) + self.pick([".", ".", ".", "?", "!", ""]) for _ in range(int(self.rng.integers(lo, hi + 1))))

    def attribute(self, kind: str, named: bool = False) -> str:
        if not named and self.chance(0.12):
            return self.pick(["", f' class="{self.pick(self.vocabulary)}"'])
        name = self.pick(NAMES[kind])
        more = self.pick(["", "", "-box", "-wrapper", " clearfix", "_inner", " col-4", "-1"])
        return f' {self.pick(["class", "class", "id"])}="{name}{more}"' if name else ""

    def short(self, kind: str) -> str:
        return self.pick(CUES[kind]) if self.chance(0.45) else self.words(1, 9) + self.pick(["", ".", ""])

    def links(self, kind: str) -> str:
        items = "".join(f'<li><a href="/{self.pick(self.vocabulary)}">{self.short(kind)}</a></li>' for _ in range(int(self.rng.integers(2, 9))))
        return self.pick([f"<ul>{items}</ul>", items.replace("<li>", "").replace("</li>", " "), f"<ul>{items}"])

    def other(self, kind: str, marked) -> str:
        """A part of a page that isn't article."""
        if kind == "header":
            inner = self.links(kind) if self.chance(0.7) else f"<p>{self.short(kind)}</p>"
            return self.pick([f"<nav>{inner}</nav>", f"<header><a href='/'>{self.words(1, 3)}</a>{inner}</header>", f"<div{self.attribute(kind)}>{inner}</div>"])
        if kind == "footer":
            inner = f"{self.pick(['&copy; ', '', 'Copyright '])}{self.pick(self.vocabulary)}.example.com &middot; {self.prose(1, 2)}" + (self.links(kind) if self.chance(0.4) else "")
            return self.pick([f"<footer>{inner}</footer>", f"<footer><p>{inner}</p></footer>", f"<div{self.attribute(kind)}>{inner}</div>"])
        if kind == "form":
            return f"<form action='/s'><label>{self.short(kind)}</label><input type='text'><select><option>{self.words(1, 2)}</option></select><button>{self.short(kind)}</button>{'<p>' + self.prose(1, 2) + '</p>' if self.chance(0.3) else ''}</form>"
        if kind == "comments":
            one = [f"<{t}{self.attribute(kind)}><{u}>{self.words(1, 2)}{' says:' if self.chance(0.3) else ''}</{u}><p>{self.prose(1, 4)}</p></{t}>" for t, u in [(self.pick(["div", "li", "article"]), self.pick(["h4", "b", "span", "cite", "p"]))] * int(self.rng.integers(1, 5))]
            return f"<{(t := self.pick(['section', 'div', 'ol']))} {self.pick(['class', 'id'])}=\"{self.pick(NAMES[kind])}\"><h3>{self.short(kind)}</h3>{''.join(one)}</{t}>"
        text = f"<p>{self.prose(1, 3)}</p>" if self.chance(0.35) else self.prose(1, 2) if self.chance(0.4) else self.links(kind) if kind in ("aside", "share") else self.short(kind)
        head = f"<h{self.pick('234')}>{self.short(kind)}</h{self.pick('234')}>" if self.chance(0.3) else ""
        tag = "aside" if kind == "aside" and self.chance(0.6) else self.pick(["div", "div", "section", "p" if not head and "<" not in text else "div"])
        return f"<{tag}{self.attribute(kind, named='<a' not in text)}>{head}{text}</{tag}>"

    def page(self) -> tuple[str, list[str]]:
        """A page's html and the marks that its article blocks hold, each of which begins one block."""
        marks: list[str] = []

        def main(text: str) -> str:
            marks.append(f"qz{len(marks)}qz")
            return marks[-1] + " " + text

        def paragraph() -> str:
            if self.chance(0.05):
                return f"<p{self.pick([' data-x=it&#39;s', ' data-n=1', ' style=\"margin:0\"'])}>{main(self.prose(1, 3))} {self.pick(['<svg/>', '<svg><title>icon</title></svg>', '<math><mi>x</mi><mo>=</mo><mn>2</mn></math>', '<object>alt</object>'])} {self.prose(1, 2)}</p>"
            kind = self.pick(["p"] * 9 + ["b", "br", "h2", "ul", "blockquote", "pre", "table", "div", "link", "figure"])
            if kind == "b":
                return f"<p><b>{main(self.prose(1, 2))}<br><p>{main(self.prose())}</p>"
            if kind == "br":
                return f"<p>{main(self.prose())}<br>{self.prose(1, 3)}</p>"
            if kind == "link":
                return f"<p>{main(self.prose(1, 3))} <a href='/x'>{self.words(1, 5)}</a> <em>{self.words(1, 4)}</em> {self.prose(1, 3)}</p>"
            if kind == "ul":
                return "<ul>" + "".join(f"<li>{main(self.prose(1, 2))}</li>" for _ in range(int(self.rng.integers(2, 5)))) + "</ul>"
            if kind == "table":
                return "<table><tr>" + "".join(f"<td>{main(self.words(1, 4))}</td>" for _ in range(4)) + "</tr></table>"
            if kind == "blockquote":
                return f"<blockquote><p>{main(self.prose(1, 3))}</p></blockquote>"
            if kind == "figure":
                return f"<figure><img src='a.png'><figcaption>{main(self.prose(1, 1))}</figcaption></figure>"
            return f"<{kind}>{main(self.words(1, 8) if kind == 'h2' else self.prose(1, self.pick([1, 2, 4, 12])))}</{kind}>"

        title, bare = self.words(2, 12), self.chance(0.12)
        parts = [f"<h1>{main(title)}</h1>"] if self.chance(0.9) and not bare else []
        if bare:  # an article of one short block
            parts.append(self.pick(["<p>{}</p>", "<p>{}</p>", "{}", "<div>{}</div>"]).format(main(self.prose(1, 2))))
        for _ in range(0 if bare else int(self.rng.integers(1, self.pick([2, 5, 14])))):
            parts.append(paragraph())
            if self.chance(0.1):
                parts.append(self.other(self.pick(["ad", "notice", "share", "aside", "form"]), None))
        if not bare and self.chance(0.25):
            parts.append(self.other(self.pick(["share", "comments"]), None))
        tag = self.pick(["article", "article", "article", "main", "div", "section"])
        body = f"<{tag}{self.attribute('article')}>" + "".join(parts) + f"</{tag}>"
        before = [self.other(self.pick(["header", "header", "ad", "notice", "share", "form"]), None) for _ in range(int(self.rng.integers(0, 4)))]
        after = [
            self.other(self.pick(["aside", "comments", "ad", "share", "form", "footer", "notice"]), None) for _ in range(int(self.rng.integers(0, 4)))
        ] + [self.other("footer", None)] * self.chance(0.8)
        if self.chance(0.4 if bare else 0.03):  # a fragment
            return body if self.chance(0.5) else f"<html><body>{body}</body></html>", marks
        html = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>' + "".join(before) + body + "".join(after) + "</body></html>"
        return html, marks
