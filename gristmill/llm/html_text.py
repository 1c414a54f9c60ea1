"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A page becomes a tree of block-level elements; inline markup only adds text to its block. Each block has
features of its subtree (length, link density, punctuation), tag, attribute tokens of itself and its
ancestors, depth and siblings. Boosted trees give the probability that a block bears main text. Decoding
picks the most likely labelling of the whole tree in which a block bears main text exactly if it has text
of its own that counts or a child that does; so no kept block hangs below a dropped one.

The trees are trained here on ``PAGES`` generated pages whose main text is known (``sample_page``), not on
the corpus. Features are computed for a batch of pages at once.

Text: character references are decoded, white space inside a block becomes one space (so does <br>), blocks
are joined in page order by one newline. A null or empty page gives an empty text; so does a page without
main text. A head without an end tag ends at the first thing that cannot stand in it, and text in <math> counts.
Pages of any length and depth are read whole, in time that grows in proportion to them however broken
their markup is; a tag that never ends is text. Repeated rows and ties are treated alike; extra columns pass
through ``extract``.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read

PAGES = 700
TREES = 60
LEVELS = 4
BINS = 32
MARK = "\ue000"  # stands before main text in generated pages

# Elements by their role in HTML.
BLOCKS = (
    "body article aside header footer nav main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre form fieldset legend label figure figcaption address details summary hr menu dialog search iframe"
).split()
SILENT = set("script style template head title noscript svg select textarea button object audio video canvas datalist".split())
RAW = set("script style title textarea noscript".split())
HEAD = set("base basefont bgsound link meta title style script noscript noframes template head html".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set(BLOCKS) - {"body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "label", "legend", "iframe"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "thead": {"table"}, "tbody": {"table"}}

# What attribute tokens (class, id, role) say, as beginnings of words.
WORDS = {
    "nav": "nav menu breadcrumb crumb pagination pager toc skip",
    "header": "header masthead topbar branding logo banner",
    "footer": "footer foot copyright colophon legal bottom",
    "side": "sidebar side aside widget rail complementary",
    "ad": "ad ads advert sponsor promo dfp adsense",
    "notice": "notice cookie consent gdpr alert popup modal overlay newsletter subscribe signup paywall message",
    "comment": "comment disqus respond reply discussion reaction",
    "related": "related recommend more share social trending popular tag author-box",
    "form": "form search login contact",
    "body": "content article post entry story main text body prose page-content",
}
HINTS = [(k, re.compile(r"(?:^|[^a-z])(?:" + "|".join(v.split()) + r")(?:s|ing|ments?|bar|list|box|section|-|_|\b)", re.I)) for k, v in WORDS.items()]
TAGS = {t: i for i, t in enumerate(BLOCKS)}
GROUPS = ["article main", "nav menu", "header", "footer", "aside", "form fieldset label legend search dialog", "p", "h1 h2", "h3 h4 h5 h6", "ul ol dl", "li dt dd", "table thead tbody tfoot tr td th caption", "section div", "blockquote pre figure figcaption address", "body"]
GROUP_OF = np.array([next((1 << g for g, names in enumerate(GROUPS) if t in names.split()), 0) for t in BLOCKS], np.int64)

# A tag whose attributes hold no < or >, as nearly all do, a comment, other markup, or text; none of them looks past the next < for its end.
TOKEN = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"']|\"[^\"<>]*+\"|'[^'<>]*+')*+)>|<!--.*?(?:-->|$)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+>|[^<]+", re.S)
OPEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)")
MARKS = re.compile(r"[>\"']")
ATTRIBUTES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def hint_mask(attributes: str) -> int:
    return _short_hint_mask(attributes) if len(attributes) < 300 else _hint_mask(attributes)


def _hint_mask(attributes: str) -> int:
    said = " ".join(a or b or c for a, b, c in ATTRIBUTES.findall(attributes))
    return sum(1 << k for k, (_, pattern) in enumerate(HINTS) if said and pattern.search(said))


_short_hint_mask = lru_cache(maxsize=20_000)(_hint_mask)


class Tags:
    """Ends of tags in one page whose attributes hold < or >, or whose quotes stay open, found in linear time in all.

    A tag ends at the first > outside quotes. What follows a mark (>, " or ') outside quotes does not depend on where
    its tag began, so it is found once for each mark.
    """

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.ends: dict[int, int] = {}  # by mark outside quotes: the end of its tag, or -1
        self.near = (0, 0)  # no mark lies between these places

    def mark(self, at: int) -> int:
        """The first mark from ``at``, or -1."""
        start, found = self.near
        if not start <= at <= found:
            m = MARKS.search(self.html, at)
            self.near = (at, m.start() if m else len(self.html))
        return self.near[1] if self.near[1] < len(self.html) else -1

    def end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` is closed, or -1 if it never is."""
        met, place, out = [], self.mark(at), -1
        while place >= 0:
            if place in self.ends:
                out = self.ends[place]
                break
            met.append(place)
            if self.html[place] == ">":
                out = place
                break
            close = self.html.find(self.html[place], place + 1)
            if close < 0:
                break
            m = MARKS.search(self.html, close + 1)
            place = m.start() if m else -1
        for place in met:
            self.ends[place] = out
        return out


class Batch:
    """Blocks of many pages in document order; a block's parent comes before it."""

    def __init__(self):
        self.tag, self.parent, self.depth, self.hint, self.page = [], [], [], [], []
        self.chars, self.linked, self.words, self.stops = [], [], [], []
        self.runs: list[tuple[int, list[str]]] = []  # (block, pieces), in page order
        self.pages = 0

    def block(self, tag: str, parent: int, hint: int) -> int:
        k = len(self.tag)
        self.tag.append(TAGS[tag])
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.hint.append(hint)
        self.page.append(self.pages)
        for column in (self.chars, self.linked, self.words, self.stops):
            column.append(0)
        return k

    def add(self, html: str) -> None:
        root = self.block("body", -1, 0)
        stack: list[tuple[str, int]] = [("body", root)]  # open elements and the block their text belongs to
        places: dict[str, list[int]] = {}  # where in the stack elements of a name are
        outer: list[int] = []  # where blocks other than paragraphs are
        run: list[str] | None = None
        links = silent = 0
        chars, linked, words, stops, runs, tags = self.chars, self.linked, self.words, self.stops, self.runs, TAGS
        at, end, match, slow = 0, len(html), TOKEN.match, Tags(html)

        def push(name: str, k: int) -> None:
            nonlocal links, silent
            places.setdefault(name, []).append(len(stack))
            if name in tags and name != "p":
                outer.append(len(stack))
            links += name == "a"
            silent += name in SILENT
            stack.append((name, k))

        def cut(to: int) -> None:
            """Close all elements from a place in the stack on."""
            nonlocal links, silent, run
            while len(stack) > to:
                name, _ = stack.pop()
                places[name].pop()
                links -= name == "a"
                silent -= name in SILENT
                if name in tags:
                    run = None
                    if name != "p":
                        outer.pop()

        def nearest(names) -> int:
            return max((places[x][-1] for x in names if places.get(x)), default=0)

        while at < end:
            m = match(html, at) if at <= slow.last or html[at] != "<" or html.startswith("<!--", at) else None
            if m is None:
                # A tag with < or > in its attributes, one that never ends, or a < in text.
                found = OPEN_TAG.match(html, at)
                close = slow.end(found.end()) if found and at <= slow.last else -1
                if close < 0:
                    stop = html.find("<", at + 1) if at <= slow.last else -1
                    stop = end if stop < 0 else stop
                    name, text, at = None, html[at:stop], stop
                else:
                    name, ends, attributes, at = found[2], found[1], html[found.end() : close], close + 1
            else:
                at = m.end()
                ends, name, attributes = m.groups()
                text = m[0] if name is None and html[m.start()] != "<" else None
            if name is None:
                if text is None:
                    continue
                if stack[-1][0] == "head" and not text.isspace():
                    cut(len(stack) - 1)
                if silent:
                    continue
                k = stack[-1][1]
                if run is None:
                    if text.isspace():
                        continue
                    run = []
                    runs.append((k, run))
                run.append(text)
                n = len(text)
                chars[k] += n
                words[k] += text.count(" ") + 1
                stops[k] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
                if links:
                    linked[k] += n
                continue
            name = name.lower()
            if ends:
                if name in VOID:
                    if name == "br" and run is not None:
                        run.append(" ")
                    continue
                place = nearest((name,))
                # A stray end of an inline or paragraph element does not close the block around it.
                block = outer[-1] if outer else 0
                block = block if name == "p" or name in tags else max(block, nearest(("p",)))
                if place and (place > block or name in tags and name != "p"):
                    cut(place)
                continue
            if stack[-1][0] == "head" and name not in HEAD:
                # The end tag of a head may be left out: whatever cannot stand in it ends it.
                cut(len(stack) - 1)
            if name == "body":
                self.hint[root] |= hint_mask(attributes)
                continue
            if name == "html":
                continue
            if name in VOID:
                if name == "br":
                    if run is not None:
                        run.append(" ")
                elif name == "hr":
                    run = None
                continue
            if name in tags:
                run = None
                if name in CLOSES_P and (place := nearest(("p",))) > (outer[-1] if outer else 0):
                    cut(place)
                # Several may be open inside each other, as a cell in its row.
                while name in SAME and (place := nearest(SAME[name])) > nearest(HOLDS.get(name, ())):
                    cut(place)
                push(name, root if silent else self.block(name, stack[-1][1], hint_mask(attributes) if attributes else 0))
            else:
                if attributes.endswith("/"):
                    continue
                if name in RAW:
                    # Raw text ends at its own end tag only.
                    close = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
                    at = close.start() if close else end
                push(name, stack[-1][1])
        self.pages += 1

    def arrays(self) -> dict[str, np.ndarray]:
        a = {k: np.array(getattr(self, k), np.int64) for k in ("tag", "parent", "depth", "hint", "page", "chars", "linked", "words", "stops")}
        # Blocks stand in document order, so those below one follow it.
        size = [1] * len(self.parent)
        for k in range(len(size) - 1, -1, -1):
            if self.parent[k] >= 0:
                size[self.parent[k]] += size[k]
        a["end"] = np.arange(len(size)) + np.array(size, np.int64)
        return a


def node_features(a: dict) -> np.ndarray:
    """One row of features for each block: own, subtree, ancestors, siblings."""
    n, parent, begin, end = len(a["tag"]), a["parent"], np.arange(len(a["tag"])), a["end"]
    group = GROUP_OF[a["tag"]]
    mask = (a["hint"] << len(GROUPS)) | group

    def below_all(x: np.ndarray) -> np.ndarray:
        """Sums over each block and all below it."""
        total = np.r_[0, np.cumsum(x)]
        return total[end] - total[begin]

    sub = {k: below_all(a[k]).astype(float) for k in ("chars", "linked", "words", "stops")}
    sub["blocks"], sub["paras"] = (end - begin).astype(float), below_all(a["tag"] == TAGS["p"]).astype(float)
    bits = len(GROUPS) + len(HINTS)
    below = [below_all((mask >> b) & 1) > 0 for b in range(bits)]
    own, over = mask.tolist(), [0] * n
    for k, p in enumerate(parent.tolist()):
        if p >= 0:
            over[k] = over[p] | own[p]
    above = np.array(over, np.int64)
    up = np.maximum(parent, 0)
    place, count = np.zeros(n), np.bincount(up[parent >= 0], minlength=n).astype(float)
    order = np.argsort(parent, kind="stable")
    starts = np.r_[True, parent[order][1:] != parent[order][:-1]]
    place[order] = np.arange(n) - np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    root = np.maximum.accumulate(np.where(parent < 0, np.arange(n), 0))
    one = lambda x: np.maximum(x, 1.0)
    columns = [
        np.log1p(sub["chars"]), sub["linked"] / one(sub["chars"]), sub["stops"] / one(sub["words"]), sub["words"] / one(sub["blocks"]), np.log1p(sub["paras"]),
        np.log1p(a["chars"]), a["linked"] / one(a["chars"].astype(float)), sub["chars"] / one(sub["chars"][up]), sub["chars"] / one(sub["chars"][root]), sub["chars"] / one(sub["blocks"]),
        np.minimum(a["depth"], 30).astype(float), place / one(count[up]), np.minimum(count[up], 50.0), np.minimum(count, 50.0),
    ]
    for m in (mask, above):
        columns += [((m >> b) & 1).astype(float) for b in range(bits)]
    columns += [x.astype(float) for x in below]
    return np.stack(columns, axis=1)


class Boosted:
    """Gradient-boosted regression trees for log-odds, grown level by level over binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, levels: int = LEVELS, rate: float = 0.2) -> Boosted:
        n, f = x.shape
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS)[1:-1])) for k in range(f)]
        binned = self._bin(x)
        odds = y.mean()
        self.start = float(np.log(odds / (1 - odds)))
        self.trees = []
        score = np.full(n, self.start)
        flat = binned + np.arange(f) * BINS
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, int)
            feature, cut = np.zeros(2**levels - 1, int), np.full(2**levels - 1, BINS)
            for level in range(levels):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    if len(rows) >= 20:
                        where = flat[rows].ravel()
                        gs = np.bincount(where, np.repeat(g[rows], f), f * BINS).reshape(f, BINS).cumsum(1)
                        hs = np.bincount(where, np.repeat(h[rows], f), f * BINS).reshape(f, BINS).cumsum(1)
                        gt, ht = gs[:, -1:], hs[:, -1:]
                        gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                        gain[(hs < 0.2) | (ht - hs < 0.2)] = 0
                        best = int(np.argmax(gain))
                        if gain.flat[best] > 1e-3:
                            feature[k], cut[k] = divmod(best, BINS)
                    node[rows] = 2 * k + 1 + (binned[rows, feature[k]] > cut[k])
            leaf = node - (2**levels - 1)
            value = -np.bincount(leaf, g, 2**levels) / (np.bincount(leaf, h, 2**levels) + 1) * rate
            score += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(self.cuts)], axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        rows, score = np.arange(len(x)), np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(LEVELS):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            score += value[node - (2**LEVELS - 1)]
        return score


def decode_tree(a: dict, odds: np.ndarray) -> np.ndarray:
    """The likeliest labels in which a block is on exactly if it has own text or a block below it is on.

    A block without own text that is on needs a child that is on; a block below one that is off is off.
    """
    n, parent, bare = len(odds), a["parent"].tolist(), (a["chars"] == 0).tolist()
    yes, no = (-np.logaddexp(0, -odds)).tolist(), (-np.logaddexp(0, odds)).tolist()
    gain, least = [0.0] * n, [-math.inf] * n  # over the children: what being on may add, the best single child
    better = [0.0] * n  # on against off
    for k in range(n - 1, -1, -1):
        extra = least[k] if bare[k] and gain[k] <= 0 else gain[k]
        better[k], up = yes[k] + extra - no[k], parent[k]
        if up >= 0:
            gain[up] += max(better[k], 0.0)
            least[up] = max(least[up], better[k])
    label = np.zeros(n, bool)
    for k, up in enumerate(parent):
        if up < 0:
            label[k] = better[k] > 0
        elif label[up]:
            # Under a bare block that is on for its best child only, that child is on though off is likelier by itself.
            label[k] = better[k] > 0 or bare[up] and gain[up] <= 0 and better[k] >= least[up]
    return label


def sample_page(rng: random.Random) -> str:
    """A generated page; text after MARK is main text."""
    syllables = "an be con de er fi ge ha in ka lo mi na or pa qui re sta ti um ve wo xe ya zu é ö ñ".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def say(low: int, high: int) -> str:
        out = [word() for _ in range(rng.randint(low, high))]
        style = rng.random()
        if style < 0.06:
            out = [w + rng.choice(["###", "%%%", "***", "&amp;&amp;"]) for w in out]
        elif style < 0.1:
            return " | ".join(out)
        elif style < 0.13:
            return "!! ".join(out).upper()
        for k in range(4, len(out), 7):
            out[k] += rng.choice(",.,?")
        return " ".join(out).capitalize() + rng.choice([".", ".", ".", ""])

    def named(options: str, noise: float = 0.3) -> str:
        tag, _, name = rng.choice(options.split()).partition(".")
        name = name.replace("+", " ")
        if rng.random() < noise:
            name = f"{name} {word()}-{rng.randint(1, 99)}".strip()
        return f'<{tag}' + (f' {rng.choice(["class", "class", "id"])}="{name}"' if name else "") + ">", f"</{tag}>"

    def links(n: int) -> str:
        item = lambda: f'<a href="/{word()}">{say(1, 3)}</a>'
        return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>" if rng.random() < 0.7 else " ".join(item() for _ in range(n))

    def wrapped(options: str, inner: str) -> str:
        a, b = named(options)
        return a + inner + b

    paras = lambda n, low, high: "".join(f"<p>{say(low, high)}</p>" if rng.random() < 0.8 else f"<div>{say(low, high)}</div>" for _ in range(n))
    nav = lambda: wrapped("nav nav.menu div.nav div.menu ul.navigation div.breadcrumb div.main-menu nav.pagination", links(rng.randint(2, 9)))
    ad = lambda: wrapped("div.ad div.ads div.advert div.ad-slot aside.ad div.sponsored div.promo section.advertisement div.ad+banner", rng.choice([say(2, 25), paras(1, 3, 30), f'<a href="#">{say(2, 12)}</a>']))
    notice = lambda: wrapped("div.cookie-notice div.notice div.alert div.consent div.popup div.gdpr-banner section.notice div.newsletter p.notice", rng.choice([say(5, 40), paras(rng.randint(1, 2), 5, 30) + "<button>OK</button>"]))
    form = lambda: wrapped("form form.search form.login div.contact-form form.subscribe", f"<label>{say(1, 4)}</label><input name=q>" + rng.choice(["", f"<p>{say(3, 20)}</p>"]) + f"<button>{word()}</button>")
    side = lambda: wrapped("aside aside.sidebar div.sidebar div.widget section.sidebar div.related aside.related div.share div.recommended", rng.choice(["", f"<h3>{say(1, 4)}</h3>"]) + rng.choice([links(rng.randint(2, 8)), paras(rng.randint(1, 3), 3, 40)]))
    comments = lambda: wrapped("section.comments div.comments div.comment-list ol.commentlist div.disqus section.reader-comments div.discussion", rng.choice(["", f"<h3>{word()}</h3>", f"<h2>{say(1, 3)}</h2>"]) + "".join(wrapped("div.comment li.comment article.comment div.reply p div", rng.choice([say(2, 50), paras(rng.randint(1, 2), 2, 50)])) for _ in range(rng.randint(1, 6))) + rng.choice(["", form()]))
    header = lambda: wrapped("header header.site-header div.header div.masthead div.topbar", rng.choice([f"<h1>{say(1, 4)}</h1>", f"<p>{say(2, 8)}</p>", say(1, 6), ""]) + rng.choice(["", nav()]))
    footer = lambda: wrapped("footer footer.site-footer div.footer div.copyright div.site-footer footer.bottom", rng.choice([f"&copy; {word()}.example.com &middot; {say(2, 25)}", paras(rng.randint(1, 2), 2, 20), links(4), say(2, 30)]))

    def main() -> str:
        out = [f"<h{rng.choice('112')}>{MARK}{say(2, 14)}</h1>".replace("</h1>", "</h1>")] if rng.random() < 0.85 else []
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            kind, text = rng.random(), MARK + say(1, rng.choice([3, 12, 60, 120]))
            if kind < 0.7:
                out.append(f"<p>{text}</p>" if rng.random() < 0.8 else f"<p><b>{text}<br>")
            elif kind < 0.76:
                out.append(f'<p>{text} <a href="/{word()}">{say(1, 3)}</a> {say(1, 20)}</p>')
            elif kind < 0.81:
                out.append("<ul>" + "".join(f"<li>{MARK}{say(1, 15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.85:
                out.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.89:
                out.append(f"<h{rng.choice('234')}>{MARK}{say(1, 8)}</h2>")
            elif kind < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{say(1, 5)}</td><td>{MARK}{say(1, 5)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.93:
                out.append(f"<pre>{text}</pre>")
            elif kind < 0.97:
                out.append(f"<div>{text}</div>")
            else:
                out.append(rng.choice([ad, side, form, notice])())
        for _ in range(rng.choice([0, 0, 0, 1])):
            out.append(rng.choice([comments, side, ad])())
        inner = "".join(out)
        if rng.random() < 0.25:
            inner = rng.choice([header, lambda: ""])() * (rng.random() < 0.2) + wrapped("div.content div.body div section.text div.article-body", inner)
        return wrapped("article article article article.post main main.content div.content div.post div.article div.entry-content div.story section.article div.main-content body.x".replace(" body.x", ""), inner)

    parts = [header] * (rng.random() < 0.4) + [nav] * (rng.random() < 0.75) + [notice] * (rng.random() < 0.3) + [ad] * (rng.random() < 0.6) + [side] * (rng.random() < 0.2) + [form] * (rng.random() < 0.15)
    rng.shuffle(parts)
    after = [comments] * (rng.random() < 0.3) + [side] * (rng.random() < 0.35) + [form] * (rng.random() < 0.2) + [ad] * (rng.random() < 0.3) + [notice] * (rng.random() < 0.15) + [nav] * (rng.random() < 0.1)
    rng.shuffle(after)
    body = "".join(p() for p in parts) + (main() if rng.random() < 0.96 else "") + "".join(p() for p in after) + (footer() if rng.random() < 0.85 else "")
    if rng.random() < 0.3:
        body = wrapped("div div.container div.wrapper div.page main", body)
    return f"<!DOCTYPE html><html><head><title>{say(2, 9)}</title><script>var a='</p>';</script></head><body>{body}</body></html>"


@lru_cache(maxsize=1)
def trained() -> Boosted:
    rng, batch = random.Random(3), Batch()
    for _ in range(PAGES):
        batch.add(sample_page(rng))
    a = batch.arrays()
    y = np.zeros(len(a["tag"]))
    for k, run in batch.runs:
        if MARK in "".join(run):
            y[k] = 1
    for k in range(len(y) - 1, -1, -1):
        if a["parent"][k] >= 0:
            y[a["parent"][k]] = max(y[a["parent"][k]], y[k])
    return Boosted().fit(node_features(a), y)


def texts(model: Boosted, pages: list[str | None]) -> list[str]:
    batch = Batch()
    for html in pages:
        batch.add(html or "")
    a = batch.arrays()
    label = decode_tree(a, model.log_odds(node_features(a)))
    out: list[list[str]] = [[] for _ in pages]
    for k, run in batch.runs:
        if label[k] and (text := " ".join(entities.unescape("".join(run)).split())):
            out[batch.page[k]].append(text)
    return ["\n".join(x) for x in out]


def extract(pages: DataFrame, html: str = "html", text: str = "text", at_once: int = 1 << 22) -> DataFrame:
    """``pages`` with the main text of each page. Batches are split so that about ``at_once`` characters of HTML are in work."""
    model = pages.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            out, waiting, size = [], [], 0
            for page in series:
                waiting.append(page)
                size += len(page or "")
                if size >= at_once:
                    out += texts(model.value, waiting)
                    waiting, size = [], 0
            if waiting:
                out += texts(model.value, waiting)
            yield pd.Series(out, dtype=object)

    return bounded_batches(pages).withColumn(text, main_text(F.col(html)))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return told.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
