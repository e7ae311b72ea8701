"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at block-level tags. Each block is described by its
words and link density, those of its neighbours, and what encloses it; a decision
tree, trained on the small labelled table below, keeps or drops it. What the name of
an element says counts with the share of the page's words that it encloses and
whether it holds the headline, so a name on a wrapper of the whole page (`has-sidebar`,
`comments-open`) drops nothing. Scripts without spaces count characters. A page is one
row and one task handles it alone, so the work follows the input and needs no
shuffle.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import lean

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What ends a tag, or opens a quoted value in it.
_TAG_END = re.compile(r"=\s*([\"'])|>")
#: Elements without main text, and how they end; `head` needs no rule, as all that may stand in it is void or raw.
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in "script style noscript template svg textarea select iframe object title button datalist".split()}
#: A slash that is not the end of an unquoted value.
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-zß-öø-ÿ]+|[A-Z]+(?![a-z])")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp nobr blink picture source input label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that enclose blocks and may carry a hint; `p` and list items do too, but are closed by the next of their kind.
CONTAINERS = frozenset("div section article main nav header footer aside form ul ol dl table tbody tr td figure blockquote fieldset details dialog menu address center body p li span".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A paragraph or list inside one of these does not close anything outside it.
BOUNDARIES = frozenset("article nav aside footer form header section main".split())
BOUNDED = frozenset("p li span ul ol".split())
#: What names say, in the languages of the web's larger parts.
#: What a tag or a name says of all it encloses, whatever comes between.
STRONG = frozenset("nav navbar navigation menu menubar footer aside form dialog comment comments commentlist respond disqus kommentar kommentare commentaire commentaires comentario comentarios commenti comentários reacties kommentarii kommentariy otzyvy cookie cookies consent gdpr breadcrumb breadcrumbs pagination pager search login signup subscribe newsletter fusszeile formular formulaire formulario recherche suche suchen buscar buscador cerca anmelden connexion iniciar brotkrumen infolettre boletin podval poisk".split())
#: What an article inside outweighs.
WEAK = frozenset("header masthead sidebar side rail widget widgets ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner notice notices alert warning popup modal overlay toolbar share sharing social related recommended recommendations teaser trending popular copyright legal disclaimer tags meta byline skip toc footnotes complementary contentinfo kopfzeile seitenleiste werbung anzeige anzeigen hinweis hinweise teilen verwandte empfohlen impressum entete publicité publicite pub annonce annonces avis partager connexes mentions encabezado cabecera lateral publicidad anuncio anuncios aviso avisos compartir relacionados recomendados pubblicità pubblicita annuncio avviso condividi correlati anúncio propaganda reclame advertentie delen reklama".split())
MAIN_NAMES = frozenset("article content main story post entry body text maincontent bodytext artikel inhalt beitrag contenu texte contenido artículo articulo cuerpo contenuto articolo conteúdo artigo inhoud".split())

#: What may stand beside such a word in a name without changing what it says (`site-footer`, `comments-area`); any other word does (`comments-open`, `has-sidebar`, `search-results`).
NEUTRAL = frozenset("site page main global primary secondary left right top bottom list area section box block container wrapper wrap inner outer item items bar body text content row col column group panel unit slot zone module links link form field the my".split())
#: Characters of scripts without spaces, about two and about five to a word.
_UNSPACED = (re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"), 2), (re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]"), 5)

FEATURES = ("words", "link_density", "previous_words", "previous_link_density", "next_words", "next_link_density", "strong", "weak", "in_article", "main_name", "heading", "page_has_article", "sentence_end", "copyright", "soft", "share", "holds_main")


def n_words(text: str) -> int:
    """Words between spaces, and those that characters of scripts without spaces come to."""
    n = text.count(" ") + 1
    return n if text.isascii() else n + sum(len(c.findall(text)) // size for c, size in _UNSPACED)


def _says(tag: str, attributes: str) -> tuple[bool, bool, bool, bool, bool]:
    """(strong, named, soft, weak, main): by its tag or as hidden; by a whole name; by a part of a name, or a form; and the weaker kinds.

    A whole name holds nothing but such words and neutral ones.
    """
    strong, named, soft, weak, main = tag in STRONG and tag != "form", False, tag == "form", tag == "header", False
    if tag != "body":
        for m in _NAMES.finditer(attributes):
            for name in (m[2] or m[3] or m[4] or "").split():
                parts = [part.lower() for part in _PARTS.findall(name)]
                whole = all(p in STRONG or p in WEAK or p in NEUTRAL for p in parts)
                for part in parts:
                    named |= whole and part in STRONG
                    soft |= not whole and (part in STRONG or part in WEAK)
                    weak |= whole and part in WEAK
                    main |= part in MAIN_NAMES
        if tag == "form":
            named = False
        strong |= "hidden" in attributes and bool(_HIDDEN.search(attributes))
        strong |= "none" in attributes and bool(_HIDDEN.search(attributes))
    return strong, named, soft, weak, main


class _Scanner:
    """Cuts a page in one pass; what a search has not found once is not searched again, so broken markup costs no more than sound."""

    def __init__(self, page: str):
        self.page, self.missing, self.quotes = page, set(), True

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.missing.add(what)
        return k

    def tag_end(self, at: int) -> int:
        """The > that ends a tag, outside quoted values as long as all of those are closed; -1 without one."""
        plain = self.find(">", at)
        if plain < 0 or not self.quotes:
            return plain
        while True:
            m = _TAG_END.search(self.page, at)
            if m and not m[1]:
                return m.start()
            at = self.find(m[1], m.end()) + 1 if m else 0
            if not at:
                self.quotes = False
                return plain

    def raw_end(self, tag: str, at: int) -> int:
        """What follows the closing tag of a raw element; -1 without one."""
        if tag in self.missing:
            return -1
        m = _RAW_END[tag].search(self.page, at)
        if m is None:
            self.missing.add(tag)
        return m.end() if m else -1

    def tokens(self) -> Iterator[tuple[str, bool, str]]:
        """(text, False, "") for text after an empty tag name, else (tag, closes, attributes) as ("<tag", ...)."""
        page, at = self.page, 0
        while at < len(page):
            if page[at] != "<":
                k = self.find("<", at)
                k = len(page) if k < 0 else k
                yield page[at:k], False, ""
                at = k
                continue
            if page.startswith("<!--", at):
                #: `<!-->` and `<!--->` are comments already.
                k = at + 2 if page.startswith("-->", at + 2) else at + 3 if page.startswith("-->", at + 3) else self.find("-->", at + 4)
                at = len(page) if k < 0 else k + 3
                continue
            close = page.startswith("</", at)
            name = _NAME.match(page, at + 1 + close)
            if name is None:
                k = self.find(">", at) if page[at + 1 : at + 2] in ("!", "?", "/") and at + 1 < len(page) else -1
                if k < 0:
                    yield "<", False, ""
                    k = at
                at = k + 1
                continue
            end = self.tag_end(name.end())
            if end < 0:
                yield "<", False, ""
                at += 1
                continue
            tag, attributes, at = name[0].lower(), page[name.end() : end], end + 1
            if tag in _RAW_END:
                #: Without a closing tag only the tag itself goes; a script or style is open to the end.
                if not close and not _SELF_CLOSED.search(attributes):
                    k = self.raw_end(tag, at)
                    at = k if k >= 0 else len(page) if tag in ("script", "style") else at
                if tag in ("title", "textarea", "select", "iframe", "object", "button"):
                    yield "<" + tag, close, ""
                continue
            yield "<" + tag, close, attributes


class _Suspects:
    """Elements that their names speak against, each with the words it encloses (without links) and whether it holds the headline or main element."""

    def __init__(self):
        self.parent, self.named, self.words, self.holds = [-1], [False], [0], [False]

    def add(self, parent: int, named: bool, holds: bool) -> int:
        for values, value in ((self.parent, parent), (self.named, named), (self.words, 0), (self.holds, holds)):
            values.append(value)
        return len(self.parent) - 1

    def judged(self) -> list[tuple[bool, float, bool]]:
        """(dropped by its name, share of the page's words, holds the headline) of every element; one that holds the headline and most of the page stays."""
        for k in range(len(self.parent) - 1, 0, -1):
            up = self.parent[k]
            self.words[up] += self.words[k]
            self.holds[up] |= self.holds[k]
        out: list[tuple[bool, float, bool]] = [(False, 1.0, True)]
        for k in range(1, len(self.parent)):
            share = self.words[k] / self.words[0] if self.words[0] else 0.0
            named = self.named[k] and not (self.holds[k] and share > 0.5)
            out.append((named or out[self.parent[k]][0], share, self.holds[k]))
        return out


def blocks(page: str) -> tuple[list[str], list[tuple]]:
    """Texts of the flat blocks in page order and what each is: (words, linked words, strong, weak, in article, main name, heading, soft, share, holds main)."""
    texts: list[str] = []
    facts: list[tuple] = []
    stack: list[tuple] = []
    places: dict[str, list[int]] = defaultdict(list)
    boundaries: list[int] = []
    suspects = _Suspects()
    #: Strong, weak, in article, main name, soft, innermost suspect.
    state = (False, False, False, False, False, 0)
    heading, link = False, False
    parts: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                n = n_words(text)
                around = " ".join(html.unescape(" ".join(linked)).split()) if linked else ""
                in_links = min(n, n_words(around)) if around else 0
                texts.append(text)
                facts.append((n, in_links, *state[:4], heading, *state[4:]))
                suspects.words[state[5]] += n - in_links
            parts, linked = [], []

    def leave(k: int) -> None:
        """Close all that was opened since place k of the stack."""
        nonlocal state
        if state != stack[k][1]:
            flush()
        state = stack[k][1]
        for tag, _ in stack[k:]:
            places[tag].pop()
            if tag in BOUNDARIES:
                boundaries.pop()
        del stack[k:]

    for token, close, attributes in _Scanner(page).tokens():
        if token[0] != "<" or token == "<":
            parts.append(token)
            if link:
                linked.append(token)
            continue
        tag = token[1:]
        if tag in _RAW_END:
            flush()
            continue
        if tag == "a":
            link = not close
        elif tag == "br":
            parts.append(" ")
        if tag not in INLINE and tag != "br":
            flush()
        if tag in HEADINGS:
            heading = not close
            if tag == "h1":
                suspects.holds[state[5]] = True
        if tag in VOID or attributes.endswith("/") and tag not in CONTAINERS:
            continue
        if tag in CONTAINERS:
            if close:
                if places[tag] and not (tag in BOUNDED and boundaries and boundaries[-1] > places[tag][-1]):
                    leave(places[tag][-1])
                heading = heading and tag == "span"
            else:
                if tag in ("p", "li") and stack and stack[-1][0] == tag:
                    leave(len(stack) - 1)
                strong, named, soft, weak, main = _says(tag, attributes)
                before = state
                now_article = state[2]
                if tag in ("article", "main") and not strong and not named:
                    now_article = True
                    weak_now = weak
                elif tag == "header" and state[2]:
                    weak_now, weak = state[1], False
                else:
                    weak_now = weak or state[1]
                suspect, opens_main = state[5], tag in ("article", "main") and not strong
                if named or soft or weak:
                    suspect = suspects.add(suspect, named, opens_main)
                elif opens_main:
                    suspects.holds[suspect] = True
                fresh = (strong or state[0], weak_now, now_article, main or state[3], soft or state[4], suspect)
                if fresh != state:
                    flush()
                state = fresh
                places[tag].append(len(stack))
                if tag in BOUNDARIES:
                    boundaries.append(len(stack))
                stack.append((tag, before))
    flush()
    judged = suspects.judged()
    out = []
    for n, in_links, strong, weak, article, main, heading, soft, suspect in facts:
        dropped, share, holds = judged[suspect]
        share, holds = (share, holds) if weak or soft else (1.0, True)
        out.append((n, in_links, strong or dropped, weak, article, main, heading, soft, share, holds))
    return texts, out


def features(facts: list[tuple], texts: list[str]) -> np.ndarray:
    out = np.zeros((len(facts), len(FEATURES)))
    if not facts:
        return out
    base = np.array(facts, float)
    out[:, 0] = base[:, 0]
    out[:, 1] = base[:, 1] / base[:, 0]
    out[1:, 2:4] = out[:-1, 0:2]
    out[:-1, 4:6] = out[1:, 0:2]
    out[:, 6:11] = base[:, 2:7]
    out[:, 11] = base[:, 4].max()
    out[:, 12] = [t[-1] in ".!?:;\"'”’»)…。！？」』）।۔؟" for t in texts]
    out[:, 13] = ["©" in t or "copyright" in t.lower() or "all rights reserved" in t.lower() for t in texts]
    out[:, 14:] = base[:, 7:]
    return out


class Tree:
    """A decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 1):
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        node = len(self.value)
        for column, value in zip((self.feature, self.threshold, self.left, self.right, self.value), (-1, 0.0, -1, -1, float(y.mean())), strict=True):
            column.append(value)
        best = None
        if depth and 0 < y.mean() < 1:
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, t = x[order, f], y[order]
                n, k = len(t), np.arange(1, len(t))
                ones = np.cumsum(t)[:-1]
                p, q = ones / k, (t.sum() - ones) / (n - k)
                impurity = (k * p * (1 - p) + (n - k) * q * (1 - q)) / n
                impurity[(v[1:] == v[:-1]) | (k < least) | (n - k < least)] = np.inf
                i = int(np.argmin(impurity)) if len(impurity) else 0
                if len(impurity) and np.isfinite(impurity[i]) and (best is None or impurity[i] < best[0] - 1e-12):
                    best = (impurity[i], f, (v[i] + v[i + 1]) / 2)
        if best:
            _, f, threshold = best
            low = x[:, f] <= threshold
            self.feature[node], self.threshold[node] = f, threshold
            self.left[node] = self._grow(x[low], y[low], depth - 1, least)
            self.right[node] = self._grow(x[~low], y[~low], depth - 1, least)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right, value = (np.array(c) for c in (self.feature, self.threshold, self.left, self.right, self.value))
        at = np.zeros(len(x), int)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return value[at]
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])


_LONG = "The river had risen in the night and by morning the lower fields were under water, so the farmers moved the sheep to the hill before they had eaten."
_MIDDLE = "Nobody in the village could remember such a flood in spring."
_LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in "Home News Sport Weather Contact".split())
#: The labelled table: pages in which every block that starts with a `+` is main text and every other is not.
LABELLED_PAGES = (
    f"<body><nav><ul>{_LINKS}</ul></nav><div class=ad>{_MIDDLE}</div><article><h1>+Flood in the valley</h1><p>+{_LONG}<p>+No.<p>+{_MIDDLE}</article><footer>&copy; Valley News. {_MIDDLE}</footer>",
    f"<body><header><a href=/>Valley News</a><p>{_MIDDLE}</header><main><h1>+Flood</h1><p>+{_LONG}</p><h2>+After</h2><p>+Short one</p><ul><li>+Sheep</li><li>+Cows and dogs</li></ul><p>+<a href=/x>See the map</a></p></main><aside><h3>Related</h3><p>{_LONG}</p></aside><footer><p>{_LONG}</p></footer>",
    f"<body><div class=menu>{_LINKS}</div><div id=content><h1>+Flood in the valley</h1><p>+{_LONG}</p><p>+{_MIDDLE}</p><p>+It rained.</p><p>+{_LONG}</p></div><div id=sidebar><p>{_LONG}</p><a href=/a>More stories of this kind</a></div><div id=footer>Copyright 2020 Valley News</div>",
    f"<body><table><tr><td><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a></td></tr><tr><td><h2>+Flood in the valley</h2><p>+{_LONG}</p><p>+{_LONG}</p><p>+{_MIDDLE}</p></td></tr><tr><td>Copyright Valley News. All rights reserved.</td></tr></table>",
    f"<body><div class=cookie-notice>{_LONG}</div><article><header><h1>+Flood</h1></header><p>+{_LONG}</p><div class=advert>{_LONG}</div><p>+{_MIDDLE}</p><div class=share><a href=/s>Share this</a></div><section class=comments><h3>Comments</h3><div><p>{_LONG}</p><p>I agree.</p></div></section></article><form><p>{_MIDDLE}</p></form>",
    f"<body><div><a href=/>Start</a> | <a href=/b>Back</a></div><div>Log in</div><div>+{_LONG}</div><div>+{_LONG} {_MIDDLE}</div><div>+{_MIDDLE}</div><div><a href=/n>Next</a></div><div>Page 1</div>",
    f"<body><div class=header><p>{_LONG}</p></div><div class=post><p>+{_MIDDLE}</p><p>+{_LONG}</p><p>+Yes, she said.</p></div><div class=comments><p>{_LONG}</p><p>{_MIDDLE}</p></div><div class=banner>{_MIDDLE}</div>",
    f"<body><p>{_MIDDLE[:20]}</p><h1>+Flood in the valley</h1><p>+{_LONG}</p><p>+{_LONG}</p><p>+{_LONG}</p><p><a href=/1>Terms</a> <a href=/2>Privacy</a> <a href=/3>Help</a></p><p>&copy; 2020</p>",
    f"<body><div class=notice>{_MIDDLE}</div><article class=story><p>+{_MIDDLE}</p><p>+&copy; marks were painted on the wall, {_LONG}</p><p>+End</p></article><div class=widget><p>{_MIDDLE}</p></div><div role=navigation><p>{_LONG}</p></div>",
    f"<body><div class=sidebar><article><p>+{_LONG}</p><p>+Why?</p></article><p>{_MIDDLE}</p><p>{_LONG}</p></div><aside><article><p>{_LONG}</p><p>{_MIDDLE}</p></article></aside>",
    f"<body><main><p>+{_LONG}</p><ul>" + "".join(f"<li>+<a href=/{i}>Source number {i}</a></li>" for i in range(3)) + f"</ul><p>+{_MIDDLE}</p></main><p>{_LONG}</p><p>{_MIDDLE}</p><p>Advertisement</p>",
    f"<article><p>+{_MIDDLE}</p></article>",
    f"<article><p>+Flood.</p></article>",
    f"<nav>{_LINKS}</nav><article><h1>+Flood</h1><p>+{_LONG}<p>+{_MIDDLE}<p>+The end",
    f"<nav>{_LINKS}</nav><article><h1>+Flood</h1><p>+<a href=/all>All of it is here</a></article>",
    f"<body><p>+{_LONG}</p>",
    f"<body><p>+{_MIDDLE}</p><p>+{_LONG}</p><p>+{_MIDDLE}</p>",
    f"<main><p>+Two words</p><form><p>{_LONG}</p></form><p>+One</p></main>",
    f"<body><div class=content><h2>+Flood</h2><p>+{_MIDDLE}</p></div>",
    f"<body><div class=comments><p>{_LONG}</p><p>{_MIDDLE}</p></div>",
    f"<body><div class=logo>Valley News</div><div>Welcome to our pages.</div><ul>{_LINKS}</ul><div class=post-content><h1>+Flood</h1><p>+{_MIDDLE}</p><p>+No sign of it</p><ul><li>+Sheep</li><li>+Cows and a dog</li></ul><pre>+x = 1</pre><p>+{_MIDDLE}</p></div><ul>{_LINKS}</ul><p>Thank you.</p>",
    f"<body><div>Welcome.</div><ul>{_LINKS}</ul><div>Search here.</div><ul>{_LINKS}</ul><div>+{_LONG}</div><div>+{_LONG}</div><div><a href=/>{_LONG}</a></div><ul>{_LINKS}</ul><div>Made by hand.</div><ul>{_LINKS}</ul>",
    f"<body><div id=main-content><p>+{_LONG}</p><p>+Some more</p><p>+{_LONG}</p><p>+End of story</p></div><div class=copyright>{_LONG}</div>",
    f"<body><ul>{_LINKS}</ul><p>Back to top.</p><ul>{_LINKS}</ul><p>{_MIDDLE[:25]}.</p><ul>{_LINKS}</ul>",
    f"<body><nav><p>{_LONG}</p></nav><footer><p>{_LONG}</p><p>{_LONG}</p></footer>",
    *(f"{before}<article><p>+{_LONG[:a]}<p>+{_LONG[:b]}</article>{after}" for a in (3, 9, 29, 90) for b in (3, 9, 29, 90) for before in ("", f"<nav>{_LINKS}</nav>") for after in ("", f"<footer>{_MIDDLE}</footer>", f"<nav>{_LINKS}</nav>", "<a href=/>More stories from the valley and the hills</a>")),
    *(f"<article><p>+{_LONG[:a]}<p>+{mark}<p>+{_LONG[:b]}</article><p>{mark}</p>" for mark in ("All rights reserved.", "&copy; 2020", "Copyright Valley News.") for a, b in ((3, 90), (90, 29))),
    *(f"<div class=content><p>+{_LONG}<p>+{_LONG[:a]}</div>{after}" for a in (3, 9, 29, 90) for after in (f"<ul>{_LINKS}</ul>", "<a href=/>More stories from the valley and the hills</a>")),
    *(
        f"{opening}<p>+{_LONG}</p><{box}><p>{_LONG[:a]}</p><p>{_LONG[:b]}</p></{box.split()[0]}><p>+{_LONG[:b]}</p>{closing}"
        for opening, closing in (("<article>", "</article>"), ("<div class=content>", "</div>"), ("<div>", "</div>"))
        for box in ("nav", "form", "aside", "footer", "div class=comments", "div class=ad", "div class=newsletter", "div class=related", "div class=notice", "div class=sidebar")
        for a, b in ((3, 90), (29, 147), (147, 29))
    ),
    *(f"<ul>{_LINKS}</ul><div class=content><h1>+{_LONG[:a]}</h1><p>+{_LONG[:b]}<p>+{_LONG}</div><ul>{_LINKS}</ul>" for a in (9, 29) for b in (3, 9, 29, 90)),
)


#: The same in three more languages, with and without names.
_OTHERS = (
    ("Der Fluss war in der Nacht gestiegen, und am Morgen standen die unteren Felder unter Wasser, so dass die Bauern ihre Schafe auf den Hügel trieben.", "Niemand im Dorf konnte sich an eine solche Flut erinnern.", "kommentare", "werbung", "inhalt"),
    ("La rivière avait monté dans la nuit et au matin les champs du bas étaient sous l'eau, si bien que les fermiers menèrent les moutons sur la colline.", "Personne au village ne se souvenait d'une telle crue.", "commentaires", "publicite", "contenu"),
    ("El río había crecido por la noche y por la mañana los campos bajos estaban bajo el agua, de modo que los campesinos llevaron las ovejas a la colina.", "Nadie en el pueblo recordaba una crecida semejante.", "comentarios", "publicidad", "contenido"),
)
LABELLED_PAGES += tuple(
    page
    for long, middle, comments, ad, content in _OTHERS
    for page in (
        f"<body><nav><ul>{_LINKS}</ul></nav><div class={ad}>{middle}</div><article><h1>+{middle[:20]}</h1><p>+{long}<p>+{middle}</article><footer>&copy; {middle}</footer>",
        f"<body><ul>{_LINKS}</ul><div class={content}><h1>+{middle[:20]}</h1><p>+{long}</p><p>+{middle}</p></div><div class={comments}><p>{long}</p><p>{middle}</p></div><div id={ad}>{long}</div>",
        f"<body><div><a href=/>{middle[:9]}</a></div><div>+{long}</div><div>+{long} {middle}</div><div>+{middle}</div><ul>{_LINKS}</ul><form><p>{middle}</p><button>{middle[:7]}</button></form>",
    )
)


_JAPANESE = "夜のうちに川の水かさが増し、朝には低い畑がすっかり水に浸かったので、農夫たちは朝食もとらずに羊を丘へ連れて行った。村の誰もこれほどの春の洪水を覚えていなかった。"
_STORY = f"<h1>+Flood in the valley</h1><p>+{_LONG}</p><p>+{_MIDDLE}</p><p>+{_LONG}</p>"
_REPLIES = f"<h3>Comments</h3><div><p>{_LONG}</p><p>I agree.</p></div><div><p>{_MIDDLE}</p></div>"
#: Names on wrappers of the page or of its article, and the same words on parts of it.
LABELLED_PAGES += tuple(
    f"{before}{opening}{inside}{story}{closing}{after}"
    for opening, closing in (
        ('<div id=page class="menu-closed">', "</div>"), ('<div class="site-main has-sidebar">', "</div>"), ("<div id=content class=search-results>", "</div>"), ("<form id=form1>", "</form>"),
        ('<article class="post type-post comments-open">', "</article>"), ('<article class="newsletter-archive post">', "</article>"), ("<div class=no-banner>", "</div>"), ("<section class=with-related-posts>", "</section>"),
    )
    for before, inside, after in (
        ("", "", ""),
        (f"<nav>{_LINKS}</nav>", "", f"<footer><p>{_MIDDLE}</p></footer>"),
        ("", f"<ul>{_LINKS}</ul>", f"<div id=comments class=comments-area>{_REPLIES}</div>"),
        (f"<div class=site-header><p>{_MIDDLE}</p></div>", f"<div class=ad-slot>{_LONG}</div>", f"<div class=sidebar-left>{_LONG}</div>"),
        (f"<div class=site-header><h1>Valley News</h1><p>{_MIDDLE}</p></div>", "", f"<div class=comments>{4 * _REPLIES}</div>"),
    )
    for story in (_STORY, _STORY[_STORY.index("<p>") :] if not after else _STORY)
)
LABELLED_PAGES += tuple(
    f"<div class={wrapper}>{_STORY}<div class={name}><p>{_LONG}</p><p>{_MIDDLE}</p></div></div>{_REPLIES.replace('<h3>', '<div class=comment-list><h3>')}</div>"
    for wrapper in ("page", "has-sidebar", "entry-content")
    for name in ("related-stories", "cookie-settings", "newsletter-inline", "share-this", "comments-closed", "promo-large")
)
LABELLED_PAGES += (
    f"<div><a href=/>ホーム</a> <a href=/n>ニュース</a></div><div>+{_JAPANESE}</div><div>+{_JAPANESE[:40]}</div>",
    f"<div>+{_JAPANESE}</div><div>+{_JAPANESE}</div>",
    f"<ul><li><a href=/>ホーム</a><li><a href=/n>ニュース</a></ul><h1>+谷の洪水</h1><p>+{_JAPANESE}</p><p>+{_JAPANESE[:36]}</p><div class=comments><p>{_JAPANESE}</p></div>",
)


@lru_cache(maxsize=1)
def model() -> Tree:
    x, y = [], []
    for page in LABELLED_PAGES:
        texts, facts = blocks(page)
        marks = [t.startswith("+") for t in texts]
        texts = [t.removeprefix("+") for t in texts]
        x.append(features(facts, texts))
        y += marks
    return Tree(np.concatenate(x), np.array(y, float))


def main_texts(pages: list[str | None]) -> list[str]:
    """The main text of each page: kept blocks in page order, one to a line."""
    cut = [blocks(p or "") for p in pages]
    x = np.concatenate([features(facts, texts) for texts, facts in cut] or [np.zeros((0, len(FEATURES)))])
    keep = model().predict(x) >= 0.5 if len(x) else np.zeros(0, bool)
    out, i = [], 0
    for texts, _ in cut:
        out.append("\n".join(t for t, k in zip(texts, keep[i : i + len(texts)], strict=True) if k))
        i += len(texts)
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            texts = main_texts(part.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points of text).

    References are decoded, white space inside a block becomes one space, blocks
    are joined by one line feed; nothing else is dropped or cut. A null, empty or
    text-free page gives an empty text. Repeated rows give repeated rows, null ids
    and urls stay null, other columns are ignored, no rows give no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lean(_extract), "page_id long, url string, text string, n_chars long")
