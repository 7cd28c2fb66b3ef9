"""Labelled pages to learn page structure from, written by chance from common layouts: (html, main text).

The words are invented anew for every page, so that only structure can be learned: which elements and names hold an article
and which hold menus, headers, footers, sidebars, notices, adverts, forms or reader comments.
"""
from __future__ import annotations

import random
from html import escape

# Names that pages give to their parts.
NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs links pager pagination tabs topnav mainmenu toc skip social share tags",
    "header": "header masthead banner topbar site-header page-header brand logo head top",
    "footer": "footer foot bottom copyright colophon legal site-footer page-footer imprint credits",
    "sidebar": "sidebar side rail widget aside related recommended trending popular more-stories secondary left-column right-column teaser",
    "notice": "cookie cookies consent notice gdpr privacy popup modal alert newsletter subscribe paywall cookie-banner message overlay warning disclaimer",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adslot banner-ad adsense ad-box ad-container commercial",
    "form": "form search login signup contact search-form register poll",
    "comments": "comments comment discussion replies reply respond responses thread comment-list user-comments feedback disqus",
}
TAGS = {"menu": "nav nav div ul", "header": "header header div", "footer": "footer footer div", "sidebar": "aside aside div section", "notice": "div div section aside p",
        "advert": "div div aside section p", "form": "form form form div", "comments": "section div div ol"}
MAIN_NAMES = "article main content post entry story body text article-body post-content entry-content page-content article-content main-content story-body"
ALPHABETS = ("the and ti on er re in at st ou th en ng ly", "der sch ich ü en ei te ge ver ung ß", "é le que ai eau re tion ou è", "ción el que ar es os ñ ado mi", "да не ст по ре ка ни го", "的 是 一 在 人 有 我")


class _Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.syllables = self.rng.choice(ALPHABETS).split()
        self.main: list[str] = []
        self.junk = self.rng.random() < 0.1
        self.loud = self.rng.random() < 0.05
        self.close = self.rng.random() < 0.85  # whether optional end tags are written
        self.names = self.rng.random() < 0.8  # whether parts are named

    def pick(self, words: str) -> str:
        return self.rng.choice(words.split())

    def chance(self, share: float) -> bool:
        return self.rng.random() < share

    def word(self) -> str:
        w = "".join(self.rng.choice(self.syllables) for _ in range(self.rng.randrange(1, 4)))
        return w + self.rng.choice(["%%%", "***", "&", "$$$"]) if self.junk and self.chance(0.4) else w

    def sentence(self, words: int) -> str:
        out = [self.word() for _ in range(max(1, words))]
        for k in range(3, len(out) - 1, 7):
            out[k] += ","
        text = " ".join(out)
        return text.upper() + "!!" if self.loud else text[:1].upper() + text[1:] + self.rng.choice([".", ".", ".", "?", "!"])

    def prose(self, sentences: int) -> str:
        return " ".join(self.sentence(self.rng.choice([1, 3, 8, 12, 20])) for _ in range(max(1, sentences)))

    def mark(self, text: str) -> str:
        """Text with inline elements at word bounds."""
        words = [escape(w) for w in text.split(" ")]
        for _ in range(self.rng.randrange(3) if self.chance(0.5) else 0):
            k, tag = self.rng.randrange(len(words)), self.pick("b i em strong span a code")
            words[k] = f"<a href='/{k}'>{words[k]}</a>" if tag == "a" else f"<{tag}>{words[k]}</{tag}>"
        if self.chance(0.05):
            words.insert(self.rng.randrange(len(words)), "<!-- x -->")
        return self.rng.choice([" ", " ", "\n"]).join(words)

    def named(self, kind: str) -> str:
        if not self.names:
            return ""
        name = self.pick(NAMES[kind])
        return self.rng.choice([f' class="{name}"', f" id='{name}'", f' class="{self.word()} {name}"', f' class="{name}-{self.word()}"', f" class={name}"])

    def noise(self, kind: str) -> str:
        tag = self.pick(TAGS[kind])
        # without a telling tag, a name has to tell
        naming = self.named(kind) or ("" if tag in ("nav", "header", "footer", "aside", "form") else f' class="{self.pick(NAMES[kind])}"')
        body = getattr(self, f"_{kind}")(tag)
        return f"<{tag}{naming}>{body}</{tag}>"

    def _links(self, n: int, wrap: str = "li") -> str:
        end = f"</{wrap}>" if self.close or wrap != "li" else ""
        return "".join(f'<{wrap}><a href="/{self.word()}">{escape(" ".join(self.word() for _ in range(self.rng.randrange(1, 5))))}</a>{end}' for _ in range(n))

    def _menu(self, tag: str) -> str:
        n = self.rng.randrange(2, 12)
        if tag == "ul":
            return self._links(n)
        return self.rng.choice([lambda: f"<ul>{self._links(n)}</ul>", lambda: self._links(n, "span"), lambda: self._links(n, "div")])()

    def _header(self, tag: str) -> str:
        some = [f"<h1>{escape(self.sentence(2))}</h1>" if self.chance(0.3) else f'<a href="/">{escape(self.word())}</a>', f"<p>{escape(self.sentence(5))}</p>",
                f"<div>{escape(self.word())}</div>", f"<nav><ul>{self._links(4)}</ul></nav>"]
        return "".join(self.rng.sample(some, self.rng.randrange(1, 4)))

    def _footer(self, tag: str) -> str:
        some = [f"&copy; {escape(self.word())} &middot; {escape(self.sentence(3))}", f"<p>{escape(self.prose(2))}</p>", f"<ul>{self._links(4)}</ul>", f"<p>&copy; 20{self.rng.randrange(10, 30)} {escape(self.word())}</p>"]
        return "".join(self.rng.sample(some, self.rng.randrange(1, 3)))

    def _sidebar(self, tag: str) -> str:
        some = [f"<h3>{escape(self.sentence(3))}</h3><ul>{self._links(self.rng.randrange(2, 8))}</ul>", f"<p>{escape(self.prose(self.rng.randrange(1, 4)))}</p>",
                f"<div><h4>{escape(self.sentence(2))}</h4><p>{escape(self.prose(2))}</p></div>"]
        return "".join(self.rng.sample(some, self.rng.randrange(1, 4)))

    def _notice(self, tag: str) -> str:
        text = escape(self.prose(self.rng.randrange(1, 4)))
        return text if tag == "p" or self.chance(0.4) else f"<p>{text}</p>" + ("<button>OK</button>" if self.chance(0.5) else "")

    def _advert(self, tag: str) -> str:
        text = escape(self.prose(self.rng.randrange(1, 4)))
        return text if tag == "p" or self.chance(0.6) else f'<p>{text}</p><a href="/x">{escape(self.sentence(2))}</a>'

    def _form(self, tag: str) -> str:
        field = "".join(f"<label>{escape(self.word())}</label><input name=x>" for _ in range(self.rng.randrange(1, 4)))
        more = f"<p>{escape(self.prose(self.rng.randrange(1, 3)))}</p>" if self.chance(0.5) else ""
        return self.rng.choice([field, f"<div>{field}</div>"]) + more + self.rng.choice(["<button>Go</button>", "<select><option>a<option>b</select>", "<textarea>t</textarea>"])

    def _comments(self, tag: str) -> str:
        out = f"<h3>{escape(self.sentence(2))}</h3>" if tag != "ol" and self.chance(0.6) else ""
        for _ in range(self.rng.randrange(1, 6)):
            inner = "li" if tag == "ol" else self.pick("div article p li")
            text = escape(self.prose(self.rng.randrange(1, 6)))
            name = self.rng.choice(["", ' class="comment"', ' class="reply"', f' id="comment-{self.rng.randrange(99)}"'])
            out += f"<{inner}{name}>{text}</{inner}>" if inner == "p" or self.chance(0.4) else f"<{inner}{name}><div class=author>{escape(self.word())}</div><p>{text}</p></{inner}>"
        return out

    def block(self, text: str, tag: str) -> str:
        self.main.append(text)
        end = "" if tag in ("p", "li") and not self.close else f"</{tag}>"
        start = "<p><b>" if tag == "p" and self.chance(0.1) else f"<{tag}>"
        return start + self.mark(text) + ("<br>" if start != f"<{tag}>" else end)

    def article(self, inside: bool) -> str:
        out = self.block(self.sentence(self.rng.randrange(1, 9)), "h1") if self.chance(0.8) else ""
        if out and self.chance(0.15):
            out = f"<header>{out}</header>"
        for _ in range(self.rng.choice([1, 1, 2, 4, 8, 15])):
            draw = self.rng.random()
            if draw < 0.72:
                out += self.block(self.prose(self.rng.choice([1, 1, 2, 5, 9])) if self.chance(0.85) else self.word(), "p")
            elif draw < 0.8:
                out += self.block(self.sentence(4), self.pick("h2 h3"))
            elif draw < 0.86:
                out += "<ul>" + "".join(self.block(self.sentence(self.rng.randrange(1, 9)), "li") for _ in range(self.rng.randrange(2, 5))) + "</ul>"
            elif draw < 0.9:
                out += "<blockquote>" + self.block(self.prose(2), "p") + "</blockquote>"
            elif draw < 0.93:
                out += "<table>" + "".join("<tr>" + "".join(self.block(self.word(), "td") for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
            elif draw < 0.95:
                out += "<figure><img src=a>" + self.block(self.sentence(5), "figcaption") + "</figure>"
            elif inside:
                out += self.noise(self.pick("advert advert sidebar menu notice form"))
            else:
                out += self.block(self.prose(3), "p")
        if inside and self.chance(0.3):
            out += self.noise(self.pick("comments menu sidebar footer"))
        return out

    def page(self) -> tuple[str, str]:
        before = [self.noise(self.pick("menu menu header notice advert sidebar form")) for _ in range(self.rng.randrange(4))]
        body = self.article(self.chance(0.4))
        name = self.rng.choice(["", f' class="{self.pick(MAIN_NAMES)}"', f' id="{self.pick(MAIN_NAMES)}"'])
        shape = self.rng.choice(["article", "article", "main", "both", "div", "section", "td", "none"])
        body = {"article": f"<article{name}>{body}</article>", "main": f"<main{name}>{body}</main>", "both": f"<main><article{name}>{body}</article></main>",
                "div": f"<div{name}>{body}</div>", "section": f"<section{name}>{body}</section>", "td": f"<table><tr><td>{body}</td></tr></table>", "none": body}[shape]
        if self.chance(0.3):
            wrap = self.rng.choice(["wrapper", "container", "page", "row", "site", "layout", "grid"])
            body = f'<div class="{wrap}">{body}{self.noise(self.pick("sidebar advert comments")) if self.chance(0.5) else ""}</div>'
        after = [self.noise(self.pick("footer footer comments sidebar advert notice form menu")) for _ in range(self.rng.randrange(4))]
        head = f"<head><meta charset=utf-8><title>{escape(self.sentence(4))}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>" if self.chance(0.8) else ""
        gap = self.rng.choice(["", "", "\n", "\n  "])
        html = f"<!DOCTYPE html><html>{head}<body>{gap.join([*before, body, *after])}" + ("</body></html>" if self.chance(0.9) else "")
        return html, " ".join(" ".join(self.main).split())


def labelled_pages(n: int = 1500, seed: int = 0) -> list[tuple[str, str]]:
    """``n`` pages with their main texts, the same for the same seed."""
    return [_Writer(seed * 1_000_003 + k).page() for k in range(n)]
