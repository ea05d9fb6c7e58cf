"""Main text of web pages: gradient-boosted trees over DOM nodes, then hierarchical decoding.

Each element gets features of its subtree (text, link and tag density, punctuation), attribute
tokens, depth, its ancestors and its siblings. Boosted trees, trained here on made-up pages of many
layouts with known labels, give the probability that it is main content. A dynamic programme over
the tree then picks the likeliest labels without contradictions: below what is out everything is out,
and main content lies in what is in, or in a wrapper that holds both.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import byte_chunks, table, trimmed

_OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_ATTRS = re.compile(r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+""")
#: Characters of a tag that is not one after all; where there are more, quotation marks count no longer in that page.
LONG = 1000
_ATTR = re.compile(r"""(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Fixed values of HTML: elements without content, with raw content, that honour '/>', that no block lies in, that end an open paragraph, and that end a like sibling.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style template textarea title iframe".split())
FOREIGN = {"svg", "math"}
INLINE = {*FOREIGN, "button", "select"}
BLOCK = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SIBLING = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

#: Tags and attribute tokens that are features of their own.
TAGS = "html head body div p span a b article main section nav header footer aside form ul ol li h1 h2 h3 table tr td blockquote pre figure".split()
AGAINST = set("nav navbar navigation menu header footer sidebar side aside ad ads advert advertisement adbox sponsor sponsored promo banner cookie consent notice alert popup modal comment comments reply discussion disqus share social related recommended widget breadcrumb breadcrumbs login signup subscribe newsletter search form copyright legal toolbar pagination masthead topbar gdpr".split())
FOR = set("article content main post entry body text story page prose".split())
NAMES = ["depth", "place", "siblings", "alike", "sibling_text", "text", "own", "links", "tags", "marks", "mean_block", "against", "for", "above_against", "above_for", "against_share", "from_start", *TAGS, *(f"under_{t}" for t in ("article", "main", "nav", "header", "footer", "aside", "form"))]


class _Markup:
    """The pieces of a page's markup, found one after the other in time linear in the page.

    A tag ends at the first > outside quotation marks, or where the next tag cuts it off; without an end it
    is text, as is a < that no name follows.
    """

    def __init__(self, source: str) -> None:
        self.source, self.after, self.quotes = source, 0, True  # after: the first > from the last place on

    def find(self, look: int) -> tuple[int, int, bool, str, str] | None:
        """The first piece from look on: (where it begins, where it ends, whether it is an end tag, name in lower case or '', attributes)."""
        source = self.source
        while (start := source.find("<", look)) >= 0:
            look = start + 1
            m = _OPEN.match(source, start)
            if m is None:
                continue
            if m[1]:
                end = source.find("-->", m.end())
                end = end + 3 if end >= 0 else len(source)
            else:
                if self.after < m.end() and (found := source.find(">", m.end())) < 0:
                    return None
                elif self.after < m.end():
                    self.after = found
                end = self.after + 1
                if m[3]:
                    stop = _ATTRS.match(source, m.end()).end() if self.quotes else -1
                    if stop >= 0 and source[stop : stop + 1] == ">":
                        end = stop + 1
                    else:
                        self.quotes = self.quotes and stop - start < LONG
                        other = source.find("<", m.end(), end)
                        end = other if other >= 0 else end
            return start, end, m[2] == "/", (m[3] or "").lower(), source[m.end() : end]
        return None


class Page:
    """Elements in document order; texts as (element, text), with None where a block begins or ends."""

    def __init__(self, source: str, poor: set[str] = AGAINST) -> None:
        """poor: attribute tokens that speak against an element, which against counts."""
        self.poor = poor
        self.tag, self.parent, self.against, self.good = ["html"], [-1], [0], [0]
        self.texts: list[tuple[int, str | None]] = []
        #: Elements that are open, and for each name where it stands among them.
        self.stack, self.places = [0], defaultdict(list)
        at, n, markup, endless = 0, len(source), _Markup(source), set()
        while piece := markup.find(at):
            start, end, closing, name, attrs = piece
            if start > at:
                self._text(source[at:start])
            at = end
            raw = "" if not name else self._end(name) if closing else self._start(name, attrs)
            if raw and raw not in endless:
                last = re.compile(rf"</{raw}\b[^>]*>", re.I).search(source, at)
                if last:
                    at = last.end()
                elif raw in ("script", "style"):
                    return
                else:
                    endless.add(raw)
        if at < n:
            self._text(source[at:])

    def _end(self, name: str) -> str:
        if self.places[name]:
            self._cut(self.places[name][-1])
        if name in BLOCK:
            self.texts.append((self.stack[-1], None))
        return ""

    def _start(self, name: str, attrs: str) -> str:
        """Opens an element; returns its name if what follows is raw."""
        places = self.places
        if name in RAW:
            return name
        if attrs.endswith("/>") and (name in FOREIGN or any(places[f] for f in FOREIGN)):
            return ""
        if name in BLOCK:
            # Where an icon or a control has no end tag, the next block ends it.
            if first := [places[x][0] for x in INLINE if places[x]]:
                self._cut(min(first))
            self.texts.append((self.stack[-1], None))
            if name not in ("li", "td", "th", "tr", "dd", "dt"):
                self._close({"p"}, {"td", "th", "div", "article", "section", "blockquote", "li"})
        if name in SIBLING:
            self._close(SIBLING[name], SCOPE.get(name, {"div", "article", "section", "td", "body"}))
        if name == "br":
            self.texts.append((self.stack[-1], " "))
        if name in VOID or name == "html" or name == "body" and self.body:
            return ""
        self.body = self.body or name == "body"
        tokens = {t.lower() for a in _ATTR.finditer(attrs) for t in _TOKEN.findall(a[2] or a[3] or a[4] or "")}
        self.tag.append(name)
        self.parent.append(self.stack[-1])
        self.against.append(len(tokens & self.poor))
        self.good.append(len(tokens & FOR))
        places[name].append(len(self.stack))
        self.stack.append(len(self.tag) - 1)
        return ""

    body = False

    def _text(self, text: str) -> None:
        self.texts.append((self.stack[-1], entities.unescape(text) if "&" in text else text))

    def _cut(self, k: int) -> None:
        """Closes the open elements from the k-th on."""
        while len(self.stack) > k:
            self.places[self.tag[self.stack.pop()]].pop()

    def _close(self, what: set[str], scope: set[str]) -> None:
        """Closes the innermost open element of what, unless one of scope lies in it."""
        innermost = lambda names: max((self.places[x][-1] for x in names if self.places[x]), default=0)
        if (k := innermost(what)) and k >= innermost(scope):
            self._cut(k)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = np.array(self.parent)
        own, marks, blocks = np.zeros(n), np.zeros(n), np.zeros(n)
        first = np.zeros(n)
        seen = 0
        for i, t in self.texts:
            if t and not t.isspace():
                k = len(t)
                own[i] += k
                marks[i] += t.count(".") + t.count(",")
                blocks[i] += 1
                seen += k
        is_link = np.array([t == "a" for t in self.tag])
        text, link, tags, mark, block, bad = own.copy(), np.where(is_link, own, 0.0), np.ones(n), marks.copy(), blocks.copy(), np.array([a > 0 for a in self.against], float)
        order = range(n - 1, 0, -1)
        children = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
        p_list = self.parent
        for i in order:
            p = p_list[i]
            text[p] += text[i]
            link[p] += link[i] if not is_link[p] else 0
            tags[p] += tags[i]
            mark[p] += mark[i]
            block[p] += block[i]
            bad[p] += bad[i]
        link = np.where(is_link, text, link)
        depth, place, count = np.zeros(n), np.zeros(n), np.zeros(n, int)
        above_bad, above_good, under = np.zeros(n), np.zeros(n), {t: np.zeros(n) for t in ("article", "main", "nav", "header", "footer", "aside", "form")}
        alike: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            p = p_list[i]
            depth[i] = depth[p] + 1
            place[i] = count[p]
            count[p] += 1
            above_bad[i] = above_bad[p] + (self.against[p] > 0)
            above_good[i] = above_good[p] + (self.good[p] > 0)
            first[i] = i
            for t, u in under.items():
                u[i] = u[p] or self.tag[p] == t
            key = (p, self.tag[i])
            alike[key] = alike.get(key, 0) + 1
        p0 = np.maximum(parent, 0)
        siblings = children[p0]
        same = np.array([1.0] + [float(alike[p_list[i], self.tag[i]]) for i in range(1, n)])
        one = {t: np.array([x == t for x in self.tag], float) for t in TAGS}
        total = max(text[0], 1.0)
        cols = [depth, place / np.maximum(siblings, 1), np.log1p(siblings), same / np.maximum(siblings, 1), text[p0] / np.maximum(siblings, 1) / 100, np.log1p(text), np.log1p(own),
                link / np.maximum(text, 1), tags * 20 / np.maximum(text, 20), mark * 50 / np.maximum(text, 50), text / np.maximum(block, 1) / 100, np.array(self.against, float), np.array(self.good, float),
                above_bad, above_good, text / total, first / n, *(one[t] for t in TAGS), *under.values()]
        return np.stack(cols, axis=1)

    def decode(self, p: np.ndarray) -> np.ndarray:
        """Which elements are in: the likeliest labels where out has only out below it, and in has in or out."""
        n = len(self.tag)
        p = np.clip(p, 1e-4, 1 - 1e-4)
        yes, no = np.log(p), np.log(1 - p)
        own = np.zeros(n)
        for i, t in self.texts:
            if t and not t.isspace():
                own[i] = 1
        is_in, out, both = yes.copy(), no.copy(), no - own * 2.0  # a wrapper loses the text of its own
        for i in range(n - 1, 0, -1):
            q = self.parent[i]
            is_in[q] += max(is_in[i], out[i])
            out[q] += out[i]
            both[q] += max(is_in[i], out[i], both[i])
        state = np.zeros(n, np.int8)  # 0 wrapper, 1 in, 2 out
        state[0] = int(np.argmax([both[0], is_in[0], out[0]]))
        for i in range(1, n):
            above = state[self.parent[i]]
            if above == 2:
                state[i] = 2
            elif above == 1:
                state[i] = 1 if is_in[i] >= out[i] else 2
            else:
                state[i] = int(np.argmax([both[i], is_in[i], out[i]]))
        return state == 1

    def written(self, chosen: np.ndarray) -> str:
        blocks, now = [], []
        for i, t in [*self.texts, (0, None)]:
            if t is None:
                if words := "".join(now).split():
                    blocks.append(" ".join(words))
                now = []
            elif chosen[i]:
                now.append(t)
        return "\n".join(blocks)


class Trees:
    """Boosted regression trees on the logistic loss over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 24) -> None:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        self.bias, self.trees, self.rate, self.depth = float(np.log(y.mean() / (1 - y.mean()))), [], rate, depth
        f = np.full(len(y), self.bias)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), int)
            feature, cut = np.zeros(2**depth - 1, int), np.full(2**depth - 1, 255)
            for level in range(depth):
                base, k = 2**level - 1, 2**level
                best = np.full(k, 1e-6)
                for j in range(x.shape[1]):
                    m = len(self.edges[j]) + 1
                    if m < 2:
                        continue
                    key = (node - base) * m + b[:, j]
                    gs, hs = np.bincount(key, g, k * m).reshape(k, m).cumsum(1), np.bincount(key, h, k * m).reshape(k, m).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    at = gain[:, :-1].argmax(1)
                    top = gain[np.arange(k), at]
                    better = top > best
                    best[better], feature[base : base + k][better], cut[base : base + k][better] = top[better], j, at[better]
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**depth - 1)
            value = np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1) * rate
            self.trees.append((feature, cut, value))
            f += value[leaf]

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        rows = np.arange(len(x))
        f = np.full(len(x), self.bias)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            f += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-f))


def made_up_page(rng: random.Random) -> str:
    """A page in which the elements of the article carry the attribute data-in, and those of no use that lie in it data-out."""
    syllables = ["ka", "lo", "mir", "ten", "sa", "pol", "ri", "du", "ven", "tor", "al", "es", "ni", "gro"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(4, 14).capitalize() + "."
    para = lambda k=4: " ".join(sentence() for _ in range(rng.randint(1, k)))
    pick = rng.choice

    def attrs(*names: str) -> str:
        name = pick(names)
        style = rng.random()
        return f' class="{name}"' if style < 0.5 else f' id="{name}"' if style < 0.8 else f' class="{word()} {name}-{word()}"'

    links = lambda k, item: "".join(f'<{item}><a href="/{word()}">{words(1, 2)}</a></{item}>' for _ in range(k))
    plain = rng.random() < 0.3  # semantic tags, hardly any attributes

    def nav() -> str:
        body = f"<ul>{links(rng.randint(3, 8), 'li')}</ul>"
        return f"<nav>{body}</nav>" if plain or rng.random() < 0.5 else f"<div{attrs('menu', 'nav', 'navbar', 'navigation', 'breadcrumbs')}>{body}</div>"

    def aside() -> str:
        body = f"<h3>{words(1, 3)}</h3>" + pick([f"<ul>{links(rng.randint(2, 6), 'li')}</ul>", f"<p>{para(2)}</p>", f"<p>{words(3, 9)}</p>"])
        return f"<aside>{body}</aside>" if rng.random() < 0.4 else f"<div{attrs('sidebar', 'widget', 'related', 'side')}>{body}</div>"

    def ad() -> str:
        return f"<{pick(['div', 'div', 'section'])}{attrs('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner')}>{pick([para(2), words(2, 12), f'<p>{para(2)}</p>'])}</div>"

    def notice() -> str:
        return f"<div{attrs('cookie', 'notice', 'consent', 'alert', 'popup')}><p>{para(2)}</p>{pick(['', '<a href=#>' + word() + '</a>'])}</div>"

    def form() -> str:
        return f"<form{attrs('search', 'newsletter', 'login', 'subscribe', 'signup')}><label>{words(1, 3)}</label><input type=text><p>{words(2, 8)}</p></form>"

    def comments() -> str:
        one = lambda: f"<{pick(['li', 'div', 'article'])}{attrs('comment', 'reply')}><b>{word()}</b><p>{para(3)}</p></div>".replace("</div>", "</div>")
        return f"<{(t := pick(['section', 'div', 'ol']))}{attrs('comments', 'discussion', 'commentlist')}><h3>{words(1, 2)}</h3>{''.join(f'<div{attrs("comment", "reply")}><b>{word()}</b><p>{para(3)}</p></div>' for _ in range(rng.randint(1, 5)))}</{t}>"

    def article() -> str:
        parts = [f"<h1 data-in>{words(2, 9)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.72:
                inner = pick([para(6), f"<b data-in>{para(2)}</b>", f'{para(2)} <a data-in href="/x">{words(1, 3)}</a> {para(2)}', f"<b data-in>{para(3)}<br>", words(1, 3), para(2)])
                parts.append(f"<p data-in>{inner}{pick(['</p>', '</p>', ''])}")
            elif kind < 0.8:
                parts.append(f"<h2 data-in>{words(1, 6)}</h2>")
            elif kind < 0.87:
                parts.append("<ul data-in>" + "".join(f"<li data-in>{words(2, 14)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.91:
                parts.append(f"<blockquote data-in><p data-in>{para(3)}</p></blockquote>")
            elif kind < 0.94:
                parts.append("<table data-in>" + "".join(f"<tr data-in><td data-in>{words(1, 4)}</td><td data-in>{words(1, 4)}</td></tr>" for _ in range(2)) + "</table>")
            else:
                parts.append(pick([ad, aside, form])())
        body = "".join(parts)
        if rng.random() < 0.25:
            body += comments()
        if rng.random() < 0.2:
            body += f"<div{attrs('share', 'social')}>{links(3, 'span')}</div>"
        wrap = rng.random()
        if plain or wrap < 0.5:
            return f"<article data-in>{body}</article>"
        tag = pick(["div", "div", "main", "section"])
        return f"<{tag} data-in{attrs('content', 'post', 'entry', 'article', 'story', 'main')}>{body}</{tag}>"

    header = lambda: f"<header><h2>{words(1, 4)}</h2>{nav() if rng.random() < 0.5 else ''}</header>" if rng.random() < 0.5 else f"<div{attrs('header', 'masthead', 'topbar')}>{words(1, 6)}</div>"
    footer = lambda: f"<footer>{pick([f'&copy; {words(1, 3)} &middot; {para(3)}', f'<p>{para(2)}</p>', f'<ul>{links(3, 'li')}</ul>'])}</footer>" if plain or rng.random() < 0.6 else f"<div{attrs('footer', 'copyright', 'legal')}>{pick([para(2), words(3, 9)])}</div>"
    before = [f() for f, share in ((header, 0.5), (nav, 0.8), (notice, 0.3), (ad, 0.5), (form, 0.2), (aside, 0.25)) if rng.random() < share]
    after = [f() for f, share in ((aside, 0.35), (comments, 0.3), (ad, 0.3), (form, 0.2), (notice, 0.15), (footer, 0.85)) if rng.random() < share]
    middle = article()
    if rng.random() < 0.3:
        middle = f"<div{attrs('wrapper', 'container', 'page', 'row')}>{middle}{''.join(after[:1])}</div>"
        after = after[1:]
    return f"<html><head><title>{words(2, 6)}</title></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>"


def _labels(source: str) -> tuple[Page, np.ndarray]:
    """A made-up page and which of its elements are in."""
    marked = Page(re.sub(r" data-in", ' role="zzin"', source), {"zzin"})
    return Page(source), np.array(marked.against, float)


def trained(pages: int = 250, seed: int = 7) -> Trees:
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, y = _labels(made_up_page(rng))
        xs.append(page.features())
        ys.append(y)
    return Trees(np.concatenate(xs), np.concatenate(ys))


def main_text(source: str | None, trees: Trees) -> str:
    page = Page(source or "")
    return page.written(page.decode(trees.probability(page.features())))


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """Main text of the whole html of pages(page_id, url, html, ...), one row for each row.

    Returns page_id, url, text (blocks joined by newlines, white space in a block as one space) and n_chars (code points). A null or empty html, and one
    without main content, gives an empty text. After a tag of over LONG characters that does not end, quotation
    marks no longer keep what follows in that page together, which keeps time linear. Null ids and urls stay null; repeated rows give repeated results; other columns are ignored.
    """
    trees = trees or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            texts = []
            for _, sources in byte_chunks(batch.column(2)):
                made = [Page(h.decode()) for h in sources]
                x = [m.features() for m in made]
                p = trees.probability(np.concatenate(x))
                ends = np.cumsum([len(r) for r in x])
                texts += [m.written(m.decode(p[e - len(r) : e])) for m, r, e in zip(made, x, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
