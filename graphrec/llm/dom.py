"""A page as a small tree of blocks with figures for each, and pages composed anew for training."""

from __future__ import annotations

import html
import random
import re

#: Elements inside a line of text, and those that only wrap text or markup (noscript, object, formulas, parts of drawings); elements without an end tag.
INLINE = set("noscript object embed math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose maction msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mlabeledtr mtd semantics annotation annotation-xml".split())
INLINE |= set("g path rect circle ellipse line polyline polygon text tspan textpath use defs symbol image lineargradient radialgradient stop clippath mask filter pattern marker desc metadata foreignobject animate animatetransform".split())
INLINE |= set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source map area".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no page text: raw text, which runs to its end tag or to the end of the page, and others, which hide what is between their tags only where both are there.
RAW = set("script style title textarea iframe xmp noembed noframes".split())
HIDDEN = set("template svg audio video canvas".split())
CONTROLS = set("button select option optgroup datalist input label legend fieldset".split())
#: What an opening tag ends, within what.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
#: Groups of words in class, id and role that tell a part's purpose.
PURPOSES = {
    "content": "article content post entry story body main text blogpost prose",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pager pagination tabs skip",
    "header": "header masthead topbar branding logo site-header banner",
    "footer": "footer copyright colophon legal bottom",
    "sidebar": "sidebar aside widget rail related recommended popular trending more complementary",
    "notice": "notice cookie cookies consent gdpr alert popup modal newsletter subscribe subscription overlay paywall",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion dfp",
    "comments": "comment comments commentlist reply replies respond discussion disqus reader feedback",
    "form": "form search login signup share social sharing contact",
}
#: Elements that tell a purpose by themselves.
TELLING = {"article": "content", "main": "content", "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form"}
_BY_TAG = {t: list(PURPOSES).index(p) for t, p in TELLING.items()}
_PURPOSE = {w: i for i, words in enumerate(PURPOSES.values()) for w in words.split()}
TAGS = ("article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "nav menu", "header", "footer", "aside", "form " + " ".join(sorted(CONTROLS)), "ul ol dl", "li dt dd", "table tbody tr td th", "blockquote pre figure figcaption", "#text")
_TAG = {t: i for i, ts in enumerate(TAGS) for t in ts.split()}
FEATURES = len(TAGS) + 3 * len(PURPOSES) + 26

#: A quote opens a value only right after `=`; elsewhere it is a character like others. Comments end as browsers end them.
#: A tag that does not end so within 300 attributes and values of 65536 characters (a value never closed) ends at the
#: next `>`: this bounds how often a page full of open quotes is read.
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]{1,65536}+|=\s*+(?:"[^"]{0,65536}+"|'[^']{0,65536}+'|[^\s>"'][^\s>]*+)?){0,300}+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TRUTH = re.compile(r'data-y="(\d)"')
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)?")
_UNQUOTED = re.compile(r"""=\s*[^\s"']+$""")
_RAW_END = {t: re.compile(f"</{t}\\b[^>]*>", re.I) for t in RAW}


def _raw_end(tag: str, source: str, at: int) -> int:
    end = _RAW_END[tag].search(source, at)
    return end.end() if end else len(source)


def _hidden_ends(source: str) -> dict[int, int]:
    """Where the content of hidden elements begins: where their end tags end. Those that close themselves, and those without an end tag, are left out."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {t: [] for t in HIDDEN}
    at = 0
    while m := _TOKEN.search(source, at):
        at, tag = m.end(), (m[2] or m[5] or "").lower()
        if tag in RAW and not (m[1] or m[4]):
            at = _raw_end(tag, source, at)
        elif tag in HIDDEN:
            attributes = m[3] or m[6] or ""
            if m[1] or m[4]:
                if opened[tag]:
                    ends[opened[tag].pop()] = at
            elif not attributes.endswith("/") or _UNQUOTED.search(attributes):
                opened[tag].append(at)
    return ends


class Page:
    """tag, parent, names (words of class, id and role), truth (in composed pages) by node; blocks: (node, text)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.names, self.truth = ["#root"], [-1], [()], [None]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)

    def _open(self, tag: str, parent: int, names: tuple = (), truth: str | None = None) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(names)
        self.truth.append(truth)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack, held, linked, in_link, at, hidden = [0], [], 0, False, 0, None
        tags = self.tag
        #: Places in the stack of the open elements of each tag.
        places: dict[str, list[int]] = {}

        def cut(to: int) -> None:
            while len(stack) > to:
                places[tags[stack.pop()]].pop()

        def last(names: set[str]) -> int:
            return max((places[t][-1] for t in names if places.get(t)), default=0)

        def flush() -> None:
            nonlocal held, linked
            if held:
                text = " ".join(html.unescape("".join(held)).split())
                if text:
                    self.blocks.append((stack[-1], text, min(linked, len(text))))
                held, linked = [], 0

        while True:
            m = _TOKEN.search(source, at)
            text = source[at : m.start()] if m else source[at:]
            if text:
                held.append(text)
                if in_link:
                    linked += len(text.strip())
            if m is None:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing = bool(m[1] or m[4])
            if tag in RAW:
                if not closing:
                    at = _raw_end(tag, source, at)
                continue
            if tag in HIDDEN:
                if not closing:
                    hidden = _hidden_ends(source) if hidden is None else hidden
                    at = hidden.get(at, at)
                continue
            if tag in INLINE:
                if tag == "a":
                    in_link = not closing
                elif tag == "br":
                    held.append(" ")
                continue
            flush()
            if closing:
                if places.get(tag):
                    cut(places[tag][-1])
                continue
            if tag not in CONTROLS and len(stack) > 1 and tags[stack[-1]] == "p":
                cut(len(stack) - 1)
            if tag in ENDS:
                ends, within = ENDS[tag]
                if last(ends) > last(within):
                    cut(last(ends))
            if tag in ("html", "body", "head") and tag in tags:
                continue
            attributes = m[3] or m[6] or ""
            names = tuple(_WORD.findall(" ".join(x.strip("\"'") for x in _NAMES.findall(attributes)).lower().replace("_", " "))) if "=" in attributes else ()
            truth = _TRUTH.search(attributes)
            node = self._open(tag, stack[-1], names, truth[1] if truth else None)
            if tag not in VOID:
                places.setdefault(tag, []).append(len(stack))
                stack.append(node)
        flush()
        # Text beside blocks of the same parent becomes a node of its own.
        parents = set(self.parent)
        self.blocks = [(self._open("#text", n) if n in parents else n, t, k) for n, t, k in self.blocks]

    def features(self, blank: bool = False) -> list[list[float]]:
        """Figures of every node: its kind and names, its ancestors' names, densities of its subtree, its siblings.

        With `blank` as if names were missing and semantic tags were plain ones.
        """
        n, parent, tag = len(self.tag), self.parent, self.tag
        chars, links, commas, stops, words, blocks, paragraphs, size, first = ([0] * n for _ in range(9))
        children: list[list[int]] = [[] for _ in range(n)]
        before, total = 0, 0
        for node, text, linked in self.blocks:
            chars[node] += len(text)
            links[node] += linked
            commas[node] += text.count(",")
            stops[node] += text.count(".") + text.count("!") + text.count("?")
            words[node] += text.count(" ") + 1
            blocks[node] += 1
            paragraphs[node] += len(text) > 80
            first[node] = before
            before += len(text)
        total = max(before, 1)
        own = chars[:]
        order = list(range(n))
        depth = [0] * n
        for v in order[1:]:
            children[parent[v]].append(v)
            depth[v] = depth[parent[v]] + 1 if parent[v] < v else 1
        for v in self._bottom_up(children):
            p = parent[v]
            if p >= 0:
                for x in (chars, links, commas, stops, words, blocks, paragraphs):
                    x[p] += x[v]
                size[p] += size[v] + 1
                if chars[v] and (first[p] == 0 or first[v] < first[p]) and not own[p]:
                    first[p] = first[v]
        place = [0] * n
        for c in children:
            for i, v in enumerate(c):
                place[v] = i
        longest = max((len(t) for _, t, _ in self.blocks), default=1)
        count, kinds = len(PURPOSES), len(TAGS)
        purposes = [[0] * count for _ in range(n)]
        if not blank:
            for v, names in enumerate(self.names):
                if tag[v] in _BY_TAG:
                    purposes[v][_BY_TAG[tag[v]]] = 1
                for w in names:
                    if w in _PURPOSE:
                        purposes[v][_PURPOSE[w]] = 1
                    elif "-" in w:
                        for x in w.split("-"):
                            if x in _PURPOSE:
                                purposes[v][_PURPOSE[x]] = 1
        above: list[list[int]] = [[0] * count for _ in range(n)]
        out: list[list[float]] = [[]] * n
        todo = [0]
        while todo:
            v = todo.pop()
            p, c = parent[v], children[v]
            todo.extend(c)
            if p >= 0:
                above[v] = [a or b for a, b in zip(above[p], purposes[p])]
            kind = [0.0] * kinds
            t = tag[v]
            if blank and t in ("article", "main", "section", "nav", "header", "footer", "aside"):
                t = "div"
            if t in _TAG:
                kind[_TAG[t]] = 1.0
            inside = [0] * count
            for x in c:
                inside = [a or b for a, b in zip(inside, purposes[x])]
            siblings = children[p] if p >= 0 else [v]
            i = place[v]
            left, right = (siblings[i - 1] if i else -1), (siblings[i + 1] if i + 1 < len(siblings) else -1)
            size_ = size[v] + 1
            k = chars[v]
            around = chars[p] if p >= 0 else k
            out[v] = [
                *kind, *purposes[v], *above[v], *inside,
                float(depth[v]), float(k), k / total, k / size_, links[v] / (k or 1), commas[v] / (words[v] or 1), stops[v] / (words[v] or 1), k / (words[v] or 1), words[v] / (blocks[v] or 1), float(blocks[v]), float(paragraphs[v]), paragraphs[v] / (blocks[v] or 1), float(size[v]), float(len(c)),
                float(len(siblings)), i / len(siblings), k / (around or 1), chars[left] / total if left >= 0 else -1.0, chars[right] / total if right >= 0 else -1.0, links[left] / (chars[left] or 1) if left >= 0 else -1.0, links[right] / (chars[right] or 1) if right >= 0 else -1.0,
                first[v] / total, own[v] / (k or 1), k / longest, (links[p] / (around or 1)) if p >= 0 else 0.0, float(t[:1] == "h" and t[1:].isdigit()),
            ]
        return out

    @staticmethod
    def _bottom_up(children: list[list[int]]) -> list[int]:
        order, todo = [], [0]
        while todo:
            v = todo.pop()
            order.append(v)
            todo.extend(children[v])
        return order[::-1]

    def weak_labels(self) -> list[int | None]:
        """1 in the article, 0 in what its tag or names tell to be something else, None where nothing tells or both lie within."""
        n = len(self.tag)
        label: list[int | None] = [None] * n
        for v in sorted(range(1, n), key=lambda v: (self.tag[v] == "#text", v)):
            t, mine = self.tag[v], None
            if t in ("nav", "footer", "aside", "form", "menu") or t in CONTROLS:
                mine = 0
            elif any(_PURPOSE.get(w, 0) > 0 for w in self.names[v]):
                mine = 0
            elif t in ("article", "main") or any(_PURPOSE.get(w) == 0 for w in self.names[v]):
                mine = 1
            elif t == "header":
                mine = 0
            above = label[self.parent[v]]
            label[v] = above if mine is None or above == 0 else mine
        return self._unmixed(label)

    def true_labels(self) -> list[int | None]:
        label: list[int | None] = [None] * len(self.tag)
        for v in range(1, len(self.tag)):
            label[v] = int(self.truth[v]) if self.truth[v] else label[self.parent[v]]
        return self._unmixed(label)

    def _unmixed(self, label: list[int | None]) -> list[int | None]:
        zero, one = [False] * len(label), [False] * len(label)
        for v in range(len(label) - 1, 0, -1):
            zero[v] |= label[v] == 0
            one[v] |= label[v] == 1
            zero[self.parent[v]] |= zero[v]
            one[self.parent[v]] |= one[v]
        return [None if zero[v] and one[v] else x for v, x in enumerate(label)]


def decode(page: Page, odds: list[float], hole_cost: float = 6.0, wrap_cost: float = 0.5) -> list[str]:
    """The page's content blocks: the best labelling of the tree in which no ancestor contradicts a descendant.

    A node is content, dropped, or a wrapper of both. Below a dropped node all is dropped; below content all is content
    but for dropped subtrees, each of which costs hole_cost; a wrapper costs wrap_cost and binds nothing below it; only a
    wrapper's children may be content anew. A label's score is the node's log-odds of being content, its negative for
    dropped, nothing for wrappers and nodes without text; the best sum is found from the leaves up.
    """
    n, parent = len(page.tag), page.parent
    children: list[list[int]] = [[] for _ in range(n)]
    for v in range(1, n):
        children[parent[v]].append(v)
    text = [False] * n
    for v, _, _ in page.blocks:
        text[v] = True
    content, dropped, wrapper = [0.0] * n, [0.0] * n, [0.0] * n
    for v in page._bottom_up(children):
        for c in children[v]:
            text[v] |= text[c]
        own = max(-6.0, min(6.0, odds[v])) if text[v] else 0.0
        content[v] = own + sum(max(content[c], dropped[c] - hole_cost) for c in children[v])
        dropped[v] = sum(dropped[c] for c in children[v]) - own
        wrapper[v] = sum(max(content[c], dropped[c], wrapper[c]) for c in children[v]) - wrap_cost if children[v] else float("-inf")
    kept: set[int] = set()
    todo = [0]
    while todo:
        v = todo.pop()
        if children[v] and (page.tag[v] in ("#root", "html", "body") or wrapper[v] > max(content[v], dropped[v])):
            todo.extend(children[v])
        elif content[v] > dropped[v]:
            inside = [v]
            while inside:
                x = inside.pop()
                kept.add(x)
                inside.extend(c for c in children[x] if content[c] >= dropped[c] - hole_cost)
    return [t for v, t, _ in page.blocks if v in kept]


def compose(rng: random.Random, prose: list[str], scraps: list[str]) -> str:
    """A page of another make from the texts of real ones: every block's part is known (data-y)."""
    pick, chance = rng.choice, rng.random
    cut = lambda a, b: " ".join(pick(prose).split()[: rng.randint(a, b)])
    scrap = lambda: pick(scraps) if scraps and chance() < 0.7 else cut(1, 5)

    def element(tag: str, inner: str, names: tuple[str, ...] = (), y: int | None = None) -> str:
        name = pick(names) if names and chance() < 0.85 else ""
        mark = f' {pick(("class", "id"))}="{name}"' if name else ""
        return f"<{tag}{mark}" + (f' data-y="{y}"' if y is not None else "") + f">{inner}</{tag}>"

    e = html.escape
    link = lambda t: f'<a href="#">{e(t)}</a>'
    items = lambda a, b: "<ul>" + "".join(f"<li>{link(scrap())}</li>" for _ in range(rng.randint(a, b))) + "</ul>"

    def menu() -> str:
        inner = items(3, 9) if chance() < 0.7 else " ".join(link(scrap()) for _ in range(rng.randint(3, 8)))
        return element(pick(("nav", "div", "nav")), inner, ("nav", "menu", "navbar", "main-nav", "breadcrumb", "toc"), 0)

    def header() -> str:
        return element(pick(("header", "div")), f"<p>{e(scrap())}</p>" + (f"<h1>{e(cut(1, 4))}</h1>" if chance() < 0.4 else f"<span>{e(cut(2, 8))}</span>"), ("header", "site-header", "masthead", "topbar"), 0)

    def footer() -> str:
        return element(pick(("footer", "div", "footer")), "&copy; " + e(scrap()) + (f"<p>{e(cut(4, 25))}</p>" if chance() < 0.5 else "") + (items(2, 5) if chance() < 0.4 else ""), ("footer", "site-footer", "copyright", "bottom"), 0)

    def side() -> str:
        parts = "".join(element("div", f"<h3>{e(cut(1, 3))}</h3>" + (items(2, 6) if chance() < 0.6 else f"<p>{e(cut(5, 40))}</p>"), ("widget", "box", "related", "popular")) for _ in range(rng.randint(1, 3)))
        return element(pick(("aside", "div")), parts, ("sidebar", "rail", "widget-area", "related", "more"), 0)

    def notice() -> str:
        return element("div", f"<p>{e(cut(6, 35))}</p>" + (f"<button>{e(cut(1, 2))}</button>" if chance() < 0.6 else ""), ("notice", "cookie-notice", "alert", "newsletter", "consent", "popup"), 0)

    def advert() -> str:
        inner = e(cut(4, 25))
        return element(pick(("div", "div", "section", "aside")), inner if chance() < 0.6 else f"<p>{link(inner)}</p>", ("ad", "ads", "advert", "sponsored", "promo", "ad-slot"), 0)

    def form() -> str:
        return element("form", f"<label>{e(cut(1, 4))}</label><input>" + (f"<p>{e(cut(4, 15))}</p>" if chance() < 0.4 else "") + f"<button>{e(cut(1, 2))}</button>", ("search", "login", "form", "signup"), 0)

    def share() -> str:
        return element("div", " ".join(link(cut(1, 1)) for _ in range(3)), ("share", "social", "sharing"), 0)

    def comments() -> str:
        one = lambda: element(pick(("div", "li", "article")), (f"<b>{e(cut(1, 2))}</b> " if chance() < 0.5 else "") + f"<p>{e(cut(4, 80))}</p>" + (link(cut(1, 1)) if chance() < 0.5 else ""), ("comment", "comment-body", "reply", "media"))
        return element(pick(("section", "div", "ol")), (f"<h3>{e(cut(1, 3))}</h3>" if chance() < 0.6 else "") + "".join(one() for _ in range(rng.randint(1, 6))), ("comments", "comment-list", "discussion", "responses", "comments-area"), 0)

    def content() -> str:
        title, short = f"<h1>{e(cut(1, 12))}</h1>", chance() < 0.25
        if chance() < 0.2:
            title = f"<header>{title}" + (f"<p>{e(cut(1, 5))}</p>" if chance() < 0.6 else "") + "</header>"
        parts = [title] if chance() < 0.9 else []
        for _ in range(1 if short else rng.randint(1, 9)):
            roll, text = chance(), e(pick(prose) if chance() < 0.8 and not short else cut(1, 12))
            if roll < 0.78:
                parts.append(f"<p>{'<b>' if chance() < 0.1 else ''}{text}</p>")
            elif roll < 0.83:
                parts.append(f"<h2>{e(cut(2, 8))}</h2>")
            elif roll < 0.88:
                parts.append("<ul>" + "".join(f"<li>{e(cut(2, 20))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif roll < 0.91:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif roll < 0.94:
                row = lambda tag: "<tr>" + "".join(f"<{tag}>{e(cut(1, 4))}</{tag}>" for _ in range(3)) + "</tr>"
                parts.append(pick((f"<pre>{e(cut(3, 20))}</pre>", f"<figure><img><figcaption>{e(cut(2, 12))}</figcaption></figure>", f"<table>{row('th')}{row('td') * rng.randint(1, 3)}</table>", f"<dl><dt>{e(cut(1, 2))}</dt><dd>{e(cut(2, 12))}</dd></dl>")))
            elif roll < 0.96:
                parts.append(f"<p>{e(cut(2, 10))} {link(cut(1, 4))} {e(cut(3, 30))}</p>")
            else:
                parts.append(f"<div>{text}</div>")
        if chance() < 0.3:
            parts.insert(rng.randint(1, len(parts)), pick((advert, share, notice, side))())
        if chance() < 0.25:
            parts.append(pick((share, comments, side, form))())
        inner = "".join(parts)
        if chance() < 0.3:
            inner = element("div", inner, ("inner", "text", "wrap"))
        return element(pick(("article", "main") if short else ("article", "main", "div", "div", "section")), inner, ("content", "post", "entry-content", "article-body", "story", "main", "post-content"), 1)

    head = [f() for f in (header, menu, notice, advert, form) if chance() < 0.5]
    rng.shuffle(head)
    middle = [content()]
    if chance() < 0.4:
        middle.insert(rng.randint(0, 1), side())
    if chance() < 0.4:
        middle.append(comments())
    if chance() < 0.3:
        middle.append(advert())
    body = "".join(middle)
    if chance() < 0.4:
        body = element("div", body, ("wrapper", "container", "page", "row"))
    return "<html><body>" + "".join(head) + body + "".join(f() for f in (notice, form, footer) if chance() < (0.8 if f is footer else 0.2)) + "</body></html>"
