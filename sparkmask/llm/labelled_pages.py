"""Pages of many layouts whose article is marked; what belongs to an article is learned from them.

The article lies between [[[ and ]]], parts of the site inside it between {{{ and }}}.  Layouts, names and lengths are
drawn, so that no tag or name decides alone.
"""

import random

# Elements and names that sites use around an article, and for what holds one.
AROUND = {
    "menu": ("nav div ul menu", "nav menu navbar navigation main-nav top-menu breadcrumb breadcrumbs site-nav pagination pager toolbar"),
    "header": ("header div", "header masthead site-header banner branding logo top-bar"),
    "footer": ("footer div", "footer site-footer contentinfo bottom legal copyright imprint"),
    "side": ("aside div section", "sidebar side-bar complementary widget related related-posts recommended more-stories trending popular archive"),
    "advert": ("div section aside", "ad ads advert adverts advertisement advertising ad-slot sponsor sponsored promo banner-ad"),
    "notice": ("div section dialog", "cookie cookies consent notice cookie-notice cookie-banner alert popup modal overlay gdpr"),
    "share": ("div ul span", "share social social-share share-buttons follow"),
    "form": ("form div", "newsletter subscribe signup login search search-box contact-form comment-form"),
    "comments": ("section div ol", "comments comment reader-comments disqus discussion replies reply comment-list"),
}
HOLDERS = ("article main div section td", "content article post story entry body text post-body article-body entry-content main-content hentry")
WRAPPERS = "wrapper container page site layout row col wrap inner outer has-sidebar with-sidebar sidebar-left no-ads"
INNER = "intro lead summary chapter part figure fig quote note example table section-1 step-2 details appendix"
SYLLABLES = "ba ce di fo gu la me ni po ru sta tre vi wo xen yar zol".split()
SHORT = ("button", "label", "select", "a")


class Layout:
    """Draws one page."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4))) for _ in range(self.r.randint(low, high)))

    def names(self, given: str, most: int = 2) -> str:
        """Attributes with up to so many of these names, or none."""
        own = " ".join(self.r.sample(given.split(), self.r.randint(1, most)))
        return f' {self.r.choice(("class", "class", "id"))}="{own}"'

    def links(self, n: int) -> str:
        item = self.r.choice(("<li>{}</li>", "{} ", "<span>{}</span> | "))
        return "".join(item.format(f'<a href="/{self.words(1, 1)}">{self.words(1, 4)}</a>') for _ in range(n))

    def inside(self, kind: str) -> str:
        if kind in ("menu", "share"):
            return self.links(self.r.randint(2, 9)) if self.r.random() < 0.7 else f"<p>{self.words(2, 80)}</p>"
        if kind == "form":
            return f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button><p>{self.words(2, 9)}</p>"
        if kind == "comments":
            return "".join(f"<div><b>{self.words(1, 2)}</b><p>{self.words(2, 70)}</p></div>" for _ in range(self.r.randint(1, 9)))
        if kind == "side":
            return f"<h3>{self.words(1, 3)}</h3>" + self.r.choice((self.links(5), f"<p>{self.words(5, 300)}</p>"))
        return self.r.choice(("<p>{}</p>", "{}", "<a href='/'>{}</a>")).format(self.words(2, 25))

    def part(self, kind: str) -> str:
        """A part of the site; its element or its name tells, or both."""
        tags, names = AROUND[kind]
        own = self.r.choice(tags.split())
        named = own in "div section span ul ol".split() or self.r.random() < 0.5
        return f"<{own}{self.names(names) if named else ''}>{self.inside(kind)}</{own}>"

    def block(self, depth: int = 0) -> str:
        """A block of the article, at times in elements whose names sound like the site's."""
        r = self.r.random()
        if r < 0.55 or depth > 2:
            text = self.words(1, 60)
            if self.r.random() < 0.3:
                text += f' <a href="/x">{self.words(1, 4)}</a> <i>{self.words(1, 3)}</i> {self.words(1, 20)}'
            return f"<p>{text}</p>"
        if r < 0.68:
            return f"<h2>{self.words(1, 6)}</h2>"
        if r < 0.78:
            kind = self.r.choice(("ul", "ol"))
            return f"<{kind}>" + "".join(f"<li>{self.words(1, 15)}</li>" for _ in range(self.r.randint(1, 5))) + f"</{kind}>"
        if r < 0.82:
            return f"<table><tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr></table>"
        if r < 0.86:
            return f"<blockquote>{self.words(3, 30)}</blockquote>"
        site = self.r.choice(" ".join(n for _, n in AROUND.values()).split())
        name = self.r.choice(("", "", f' class="{self.r.choice(INNER.split())}"', f' id="{self.r.choice(INNER.split())}"', f' id="{site}-{self.words(1, 1)}"', f' class="{self.words(1, 1)}-{site}"', f' id="{self.words(1, 1)}"'))
        own = self.r.choice(("div", "section", "figure"))
        return f"<{own}{name}>" + "".join(self.block(depth + 1) for _ in range(self.r.randint(1, 3))) + f"</{own}>"

    def article(self) -> str:
        out = [f"<h1>{self.words(2, 9)}</h1>"] if self.r.random() < 0.8 else []
        for _ in range(self.r.randint(2, 9)):
            out.append(self.block())
            if self.r.random() < 0.35:
                out.append("{{{" + self.part(self.r.choice(("menu", "advert", "side", "share", "form", "notice", "comments", "footer"))) + "}}}")
        if out[0].startswith("<h1>") and self.r.random() < 0.2:
            out[0] = f"<header>{out[0]}<p>{self.words(2, 9)}</p></header>"
        return "[[[" + "".join(out) + "]]]"

    def page(self) -> str:
        own = self.r.choice(HOLDERS[0].split() + ["article", "article", "main"])
        held = f"<{own}{self.names(HOLDERS[1]) if self.r.random() < 0.6 else ''}>{self.article()}</{own}>"
        before = [self.part(k) for k in ("notice", "header", "menu", "advert", "side") if self.r.random() < 0.6]
        after = [self.part(k) for k in ("share", "comments", "side", "form", "advert", "footer") if self.r.random() < 0.6]
        if self.r.random() < 0.2:  # parts without a name
            before.append(f"<div>{self.links(4)}</div>")
            after.append(self.r.choice((f"<p>&copy; {self.words(1, 3)}</p>", f"<div>{self.links(4)}</div>")))
        if own == "td":
            held = f"<table><tr>{held}</tr></table>"
        if self.r.random() < 0.5:
            held = f"<div{self.names(WRAPPERS)}>" + held + "".join(after[:2]) + "</div>"
            after = after[2:]
        whole = "".join(before) + held + "".join(after)
        if self.r.random() < 0.5:
            whole = f"<div{self.names(WRAPPERS)}>{whole}</div>"
        head = f"<html><head><title>{self.words(1, 5)}</title><style>p{{}}</style></head><body"
        return head + (self.names(WRAPPERS) if self.r.random() < 0.4 else "") + f">{whole}</body></html>"


def pages(n: int = 600, seed: int = 1) -> list[str]:
    return [Layout(seed * 1_000_003 + i).page() for i in range(n)]
