"""Labelled pages to train the extraction model on, written by a generator: no page of a corpus is needed.

A page is a body with an article and blocks around and inside it; an element that starts a block carries a mark that
says whether its text belongs to the article. Words are random letters, so only structure can be learned.
"""

from __future__ import annotations

import random

#: What pages name their parts, by kind: element names, then class and id words. Common public naming habits.
KINDS = {
    "menu": ("nav nav ul div div", "nav menu navbar navigation topnav breadcrumb breadcrumbs pagination pager tabs links sitemap toolbar dropdown mainmenu submenu skip"),
    "header": ("header header div div", "header masthead topbar branding logo site siteheader page global top hero tagline title"),
    "footer": ("footer footer div div section", "footer site global page sitefooter bottom copyright legal colophon imprint credits foot"),
    "sidebar": ("aside aside div div section", "sidebar side rail widget widgets related recommended trending popular more stories tagcloud tags archive archives toc recirculation readnext also links secondary"),
    "notice": ("div div section aside p", "cookie cookies consent notice alert gdpr newsletter subscribe subscription signup popup modal overlay paywall warning message privacy banner dialog toast announcement disclaimer"),
    "advert": ("div div aside ins section p", "adsbygoogle adunit adbox adcontainer adwrapper adslot googleads ad ads advert adverts advertisement adsense sponsor sponsored sponsors promo promotion promoted dfp banner commercial adslot outbrain taboola"),
    "form": ("form form form div", "form search login register contact signup comment email input searchbox"),
    "comments": ("section section div ol ul", "comments comment commentlist thread respond replies reply discussion disqus reader readers feedback responses thread reviews usercomments"),
    "share": ("div ul section", "share social sharing follow buttons icons facebook twitter likes print"),
}
ARTICLE = ("article article main div div section", "article content post entry story body text main page articlebody postbody entrycontent storybody maincontent prose markdown")


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, least: int, most: int, ends: bool = True) -> str:
        r = self.r
        found = ["".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(2, 9))) for _ in range(r.randint(least, most))]
        found[0] = found[0].capitalize()
        text = "".join(w + (r.choice([".", ",", ".", ";"]) if r.random() < 0.12 else "") + " " for w in found).strip()
        return text.rstrip(".,;") + "." if ends else text

    def names(self, words: str, chance: float = 0.8) -> str:
        r, some = self.r, words.split()
        if r.random() > chance:
            return ""
        name = r.choice(some) if r.random() < 0.6 else r.choice("-_ ").join(r.sample(some, 2))
        name += r.choice(["", "", "-1", "-box", "-wrap", "-container", "-area", "-inner"])
        return f' {r.choice(["class", "class", "class", "id"])}="{name}"'

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{text}</a>'

    def open(self, names: tuple[str, str], keep: bool, chance: float = 0.8) -> tuple[str, str]:
        tag = self.r.choice(names[0].split())
        plain = tag in ("div", "section", "p", "ul", "ol")
        return f'<{tag} data-testid="{"keep" if keep else "drop"}"{self.names(names[1], 1.0 if plain and not keep else chance)}>', f"</{tag}>"

    def boilerplate(self, kind: str) -> str:
        r = self.r
        start, end = self.open(KINDS[kind], False)
        tag = start[1:].split()[0]
        if kind in ("menu", "share") or kind == "sidebar" and r.random() < 0.5:
            items = "".join(f"<li>{self.link(self.words(1, 3, False))}</li>" for _ in range(r.randint(3, 9)))
            inner = items if tag in ("ul", "ol") else f"<ul>{items}</ul>" if r.random() < 0.7 else " ".join(self.link(self.words(1, 2, False)) for _ in range(r.randint(3, 8)))
        elif kind == "form":
            inner = f"<label>{self.words(1, 3, False)}</label><input name='q'>" * r.randint(1, 3) + f"<p>{self.words(2, 9)}</p>" * r.randint(0, 1) + "<button>Go</button>"
        elif kind == "comments":
            unit = "li" if tag in ("ul", "ol") else r.choice(["div", "article", "p"])
            own = lambda: self.names("comment reply review post", 0.6)
            inner = "".join(f"<{unit}{own()}>" + (f"<b>{self.words(1, 2, False)}</b>" if r.random() < 0.5 else "") + (self.words(5, 60) if unit == "p" else f"<p>{self.words(5, 60)}</p>") + f"</{unit}>" for _ in range(r.randint(1, 6)))
            inner = (f"<h3>{self.words(1, 3, False)}</h3>" if r.random() < 0.5 and unit != "li" else "") + inner
        elif kind in ("header", "footer"):
            inner = r.choice([self.words(2, 12, False), f"<p>{self.words(4, 25)}</p>", f"<h1>{self.words(1, 4, False)}</h1>" if kind == "header" else "&copy; " + self.words(2, 10), f"<p>{self.words(3, 12)} {self.link(self.words(1, 3, False))}</p>"])
            inner += self.boilerplate("menu") if r.random() < 0.3 else ""
        else:
            text = self.words(4, 40)
            inner = text if tag == "p" or r.random() < 0.5 else (f"<h4>{self.words(1, 4, False)}</h4>" if r.random() < 0.5 else "") + f"<p>{text}</p>" * r.randint(1, 2)
            inner += self.link(self.words(1, 2, False)) if r.random() < 0.3 else ""
        return start + inner + end

    def content(self) -> str:
        r, parts = self.r, []
        for _ in range(r.choice([1, 1, 2, 2, 3, 4, 5, 7, 10, 14])):
            kind = r.random()
            if r.random() < 0.12:  # short lines of an article may be mostly links
                inner = f"{self.words(1, 3, False)} {self.link(self.words(1, 3, False))} {self.words(1, 4)}" if r.random() < 0.7 else self.link(self.words(1, 5, False))
                parts.append(f"<p>{inner}</p>" if r.random() < 0.7 else f"<ul><li>{inner}</li><li>{self.words(1, 6)}</li></ul>")
                continue
            text = self.words(1, 5) if r.random() < 0.12 else self.words(5, 14) if r.random() < 0.25 else self.words(12, 120)
            if r.random() < 0.2:
                text += " " + self.link(self.words(1, 4, False)) + " " + self.words(3, 20)
            if kind < 0.7:
                parts.append(r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br><p>{self.words(8, 60)}</p>", f"<div>{text}</div>" if r.random() < 0.3 else f"<p>{text}"]))
            elif kind < 0.8:
                parts.append(f"<h{r.randint(2, 4)}>{self.words(1, 8, False)}</h{r.randint(2, 4)}>")
            elif kind < 0.88:
                parts.append("<ul>" + "".join(f"<li>{self.words(2, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.93:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.97:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 4, False)}</td><td>{self.words(1, 6, False)}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>")
            else:
                parts.append(f"<figure><img src='x'><figcaption>{self.words(3, 14)}</figcaption></figure>")
        head = f"<h1>{self.words(2, 10, False)}</h1>" if r.random() < 0.85 else ""
        if head and r.random() < 0.35:
            head = f'<header data-testid="keep">{head}</header>'
        for _ in range(r.randint(0, 2) if r.random() < 0.5 else 0):
            parts.insert(r.randint(0, len(parts)), self.boilerplate(r.choice(["advert", "notice", "share", "sidebar", "form"])))
        return head + "".join(parts)

    def page(self) -> str:
        r, kinds = self.r, list(KINDS)
        start, end = self.open(ARTICLE, True)
        article = start + self.content() + end
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            names = r.choice(["wrapper container row layout grid site page main", "content main primary column col"])
            around = "".join(self.boilerplate(r.choice(kinds)) for _ in range(r.choice([0, 0, 1, 2])))
            article = f'<div data-testid="keep"{self.names(names, 0.7)}>' + (article + around if r.random() < 0.6 else around + article) + "</div>"
        before = [self.boilerplate(k) for k in r.sample(kinds, r.randint(0, 4))]
        after = [self.boilerplate(k) for k in r.sample(kinds, r.randint(0, 4))]
        return "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>" + "".join(before) + article + "".join(after) + "</body></html>"


def pages(n: int, seed: int = 1) -> list[str]:
    writer = Writer(seed)
    return [writer.page() for _ in range(n)]
