"""Main text of web pages: gradient-boosted trees over DOM nodes and a hierarchical decoding.

Nodes are block elements and the runs of text in them. Features: subtree size and link density, words a
block, punctuation, attribute tokens (own and inherited), kind of tag (own and inherited), depth, place
among siblings and the siblings' sizes. Spark ML's GBTClassifier learns which nodes hold main text; decoding
then picks the labelling of the whole tree that is likeliest under the rule that a node can only hold main text
if its parent does, so that no ancestor contradicts a descendant.

Labels. Pages that mark their article (article or main) are their own labels: what stands in it is main text but for navigation,
footers, asides and forms there. Names (class, id, role) are features and never labels. A bounded sample of the pages
(`sample` of least hash, a parameter) is used in several guises, so that the trees can't lean on the one
tag that gave the label: with the tag renamed, with unnamed divisions for all tags, with tag and name features blanked, with
boilerplate (notices, comments, adverts, link lists, asides, forms) made of the page's own prose put into it, and with whatever
an article may hold: linked paragraphs and lists, bare lines, quotes, tables, sections whose names hold a telling word among others.

Text. Markup, scripts, styles, form controls and comments go when a page is read; character references
are decoded; white space (and br) in a block is one space; blocks are joined by two line feeds. Controls and
embedded content go up to their own end tag; where that is missing, up to the next block tag, the end of what they
stand in or the next tag that HTML ends them at. Only script, style, textarea, title and comments run to the page's end.

Defined cases: null or empty html, or no main text: an empty string; unclosed and misnested tags are closed
where HTML closes them; without labelled pages a page's blocks outside navigation, headers, footers, asides,
forms and marked boilerplate are its main text; repeated rows each give a row; an empty table gives an
empty result; other columns are kept only if asked for.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from costloom.llm.common import opened, row_schema, shared_dir, shipped, slices, text_batches

SAMPLE = 300
TREES, DEPTH, STEP = 20, 5, 0.3
# Kinds of tags and words in class, id and role that tell what an element is for.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr picture source".split())
RAW = "script|style|title|textarea"
DROPPED = set("noscript template svg iframe object select button option canvas audio video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
KINDS = {"article": 0, "main": 0, "nav": 1, "menu": 1, "header": 2, "footer": 3, "aside": 4, "form": 5, "fieldset": 5, "dialog": 5, "p": 6, "blockquote": 6, "pre": 6, "ul": 8, "ol": 8, "li": 8, "dl": 8} | {f"h{i}": 7 for i in range(1, 7)}
NEGATIVE = set("ad ads adv advert adverts advertisement adsense banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus dropdown footer gdpr header login masthead menu modal nav navbar navigation newsletter notice alert popup promo promoted related recommended reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget pagination pager".split())
POSITIVE = set("article articlebody body content entry main maincontent page post story text".split())
FILLERS = set("bar block body bottom box center col column container content area desktop div foot footer group head header inner item items left link links list main mobile outer page panel primary right row secondary section site small text the top unit view wrap wrapper".split())  # say nothing beside the others
LEGAL = set("copyright rights reserved imprint impressum privacy terms disclaimer datenschutz agb mentions confidentialité privacidad aviso cookies sitemap contact kontakt".split())  # in a page's last lines
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
RESTARTS = {"button": "button", "option": "option", "optgroup": "option", "select": "select"}  # tags that end an open element
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
WIDTH = 34
ANCESTRY, TAGS = [0, 11, 13, 14], [0, 1, 2, 3, 4, 5, 10, 11, 12, 13, 14, 15, 28]

_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|(?P<start><(?P<raw>{RAW})(?=[\s/>])[^>]*>).*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_DROPPED = re.compile(rf"<(?:{'|'.join(sorted(DROPPED))})(?=[\s/>])", re.I)
_NAMED = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")


def dropped_spans(source: str) -> dict[int, int]:
    """Where each dropped element ends, by the place of its start tag."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int, int]] = []  # tag, its place, block tags before it
    count = dict.fromkeys(["svg", "foreignobject"], 0)
    blocks: list[int] = []
    place = 0

    def pop(tag: str, at: int, own_end: int | None = None) -> None:
        """Ends the innermost such element, and what is open in it, at a tag (its own end tag: after it)."""
        while True:
            name, start, before = stack.pop()
            count[name] -= 1
            if name in DROPPED:
                own = name == tag and own_end is not None
                ends[start] = own_end if own else min([at, *blocks[before : before + 1]])
            if name == tag:
                return

    while m := _TOKEN.search(source, place):
        at, place = m.start(), m.end()
        if m["raw"] and count["svg"] and m["start"].endswith("/>"):
            place = m.end("start")
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag or tag == "head":
            continue
        in_svg = count["svg"] > count["foreignobject"]
        if m["end"] or m["end2"]:
            if tag in BLOCKS:
                blocks.append(at)
            if count.get(tag):
                pop(tag, at, m.end())
            continue
        if tag in BLOCKS:
            blocks.append(at)
            if in_svg:  # HTML ends drawings there
                pop("svg", at)
        if count.get(RESTARTS.get(tag)):
            pop(RESTARTS[tag], at)
        if m[0].endswith("/>") and (in_svg or tag == "svg"):
            ends[at] = m.end()
        elif tag not in VOID and tag not in INLINE:
            stack.append((tag, at, len(blocks)))
            count[tag] = count.get(tag, 0) + 1
    while stack:
        pop(stack[-1][0], len(source))
    return ends


def told(attrs: str) -> tuple[int, int]:
    """How many names in class, id and role speak against main text, and for it. A name does so as a whole: `share` and `share-box`, not `market-share`."""
    against = of = 0
    for m in _NAMED.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = set(_PART.findall(name))
            if parts and parts <= NEGATIVE | POSITIVE | FILLERS:
                against += bool(parts & NEGATIVE)
                of += bool(parts & POSITIVE) and not parts & NEGATIVE
    return against, of


class Page:
    """The nodes of a page in page order, as columns; node 0 is the page."""

    def __init__(self, source: str):
        self.parent, self.kind, self.neg, self.pos, self.text, self.linked, self.mark = [0], [9], [0], [0], [""], [0], [""]
        self.tags, stack = ["#page"], [0]
        run, link_chars, in_link, at = [], 0, False, 0

        def flush():
            nonlocal run, link_chars
            block = " ".join(entities.unescape("".join(run)).split())
            if block:
                self._add(stack[-1], "#text", "", block, min(link_chars, len(block)))
            run, link_chars = [], 0

        dropped = dropped_spans(source) if _DROPPED.search(source) else {}
        while m := _TOKEN.search(source, at):
            if m.start() > at:
                run.append(source[at : m.start()])
                link_chars += (m.start() - at) * in_link
            at = m.end()
            tag = (m["tag"] or m["tag2"] or "").lower()
            if not tag or tag == "head":
                continue
            closing = bool(m["end"] or m["end2"])
            if tag in DROPPED:
                at = at if closing else dropped.get(m.start(), at)
                continue
            if tag == "br":
                run.append(" ")
            elif tag in INLINE:
                if tag == "a":
                    in_link = not closing
            else:
                flush()
                in_link = False
                if closing:
                    depth = next((i for i in range(len(stack) - 1, 0, -1) if self.tags[stack[i]] == tag), 0)
                    if depth:
                        del stack[depth:]
                elif tag not in VOID:
                    self._close(stack, tag)
                    stack.append(self._add(stack[-1], tag, m["attrs"] or m["attrs2"] or "", "", 0))
        run.append(source[at:])
        flush()

    def _close(self, stack: list[int], tag: str) -> None:
        """Elements that HTML ends where this one begins."""
        if self.tags[stack[-1]] == "p":
            stack.pop()
        for i in range(len(stack) - 1, 0, -1):
            open_tag = self.tags[stack[i]]
            if open_tag in CLOSES.get(tag, ()):
                del stack[i:]
                return
            if open_tag in ("ul", "ol", "dl", "table", "div", "section", "article"):
                return

    def _add(self, parent: int, tag: str, attrs: str, text: str, linked: int) -> int:
        against, of = told(attrs) if attrs else (0, 0)
        self.parent.append(parent)
        self.tags.append(tag)
        self.kind.append(KINDS.get(tag, 9))
        self.neg.append(against)
        self.pos.append(of)
        self.text.append(text)
        self.linked.append(linked)
        self.mark.append("keep" if 'data-x="keep"' in attrs else "drop" if 'data-x="drop"' in attrs else "")
        return len(self.parent) - 1

    def features(self) -> np.ndarray:
        n = len(self.parent)
        parent, kind = np.array(self.parent), np.array(self.kind)
        neg, pos = np.array(self.neg, float), np.array(self.pos, float)
        chars = np.array([len(t) for t in self.text], float)
        links, leaves = np.array(self.linked, float), (chars > 0).astype(float)
        words = np.array([t.count(" ") + 1 if t else 0 for t in self.text], float)
        points = np.array([len(_PUNCTUATION.findall(t)) if t else 0 for t in self.text], float)
        legal = np.array([len(LEGAL.intersection(_LETTERS.findall(t.lower()))) + ("©" in t) if 0 < len(t) < 400 else 0 for t in self.text], float)
        depth, in_neg, in_pos, in_article, in_tag = (np.zeros(n) for _ in range(5))
        inside = np.zeros(n)
        size, place, last = np.zeros(n), np.zeros(n), np.full(n, -1)
        before, after = np.zeros(n), np.zeros(n)
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for a in (chars, links, leaves, words, points, legal):
                a[p] += a[i]
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            in_neg[i], in_pos[i] = in_neg[p] + neg[i], in_pos[p] + pos[i]
            in_article[i] = in_article[p] or kind[i] == 0
            in_tag[i] = in_tag[p] or kind[i] in (1, 3, 4, 5) or (kind[i] == 2 and not in_article[p])
            inside[i] = kind[i] == 2 and bool(in_article[p])
            place[i] = size[p]
            size[p] += 1
            if last[p] >= 0:
                before[i], after[last[p]] = chars[last[p]], chars[i]
            last[p] = i
        f = np.zeros((n, WIDTH), np.float32)
        f[np.arange(n), kind] = 1
        f[:, 10:16] = np.stack([neg, pos, in_neg, in_pos, in_article, in_tag], 1)
        f[:, 16] = np.log1p(chars)
        f[:, 17] = links / np.maximum(chars, 1)
        f[:, 18] = np.log1p(words / np.maximum(leaves, 1))
        f[:, 19] = points / np.maximum(words, 1)
        f[:, 20] = depth
        f[:, 21] = place / np.maximum(size[parent], 1)
        f[:, 22] = np.log1p(size[parent])
        f[:, 23] = chars / np.maximum(chars[parent], 1)
        f[:, 24] = chars / max(chars[0], 1)
        f[:, 25], f[:, 26] = np.log1p(before), np.log1p(after)
        f[:, 27] = np.log1p(leaves)
        f[:, 28] = inside
        f[:, 29] = legal / np.maximum(leaves, 1)
        f[:, 30], f[:, 31], f[:, 32] = f[parent, 17], f[parent, 18], f[parent, 24]
        f[:, 33] = (place == size[parent] - 1) & (size[parent] > 1)
        return f

    def plain(self, features: np.ndarray) -> np.ndarray:
        """By rule alone: 1 for nodes outside everything that marks itself as boilerplate."""
        return ((features[:, 12] == 0) & (features[:, 15] == 0)).astype(float)

    def labels(self) -> np.ndarray | None:
        """1 for nodes that hold main text, by the page's own marks; None if it has none."""
        n = len(self.parent)
        keep, drop, held = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n)
        for i in range(1, n):
            p, k = self.parent[i], self.kind[i]
            keep[i] = keep[p] or self.mark[i] == "keep"
            drop[i] = drop[p] or self.mark[i] == "drop" or k in (1, 3, 4, 5)
            held[i] = keep[i] and not drop[i] and bool(self.text[i])
        if not held.any():
            return None
        for i in range(n - 1, 0, -1):
            held[self.parent[i]] = max(held[self.parent[i]], held[i])
        return held

    def decode(self, p: np.ndarray) -> list[str]:
        """Blocks of the likeliest labelling in which only children of holders hold main text."""
        n = len(self.parent)
        p = np.clip(p, 1e-4, 1 - 1e-4)
        yes, no, best = np.log(p), np.log(1 - p), np.zeros(n)
        for i in range(n - 1, 0, -1):
            best[i] = yes[i] > no[i]
            yes[self.parent[i]] += max(yes[i], no[i])
            no[self.parent[i]] += no[i]
        held = np.ones(n, bool)
        for i in range(1, n):
            held[i] = held[self.parent[i]] and best[i]
        return [t for t, h in zip(self.text, held) if t and h]


class Boosted:
    """The trees of a fitted classifier as arrays."""

    def __init__(self, trees: list, weights: list[float]):
        self.trees, self.weights = trees, weights

    @classmethod
    def of(cls, model) -> Boosted:
        return cls([cls._read(t.toDebugString) for t in model.trees], list(model.treeWeights))

    @staticmethod
    def _read(description: str):
        """Feature, threshold, children and value by node, from a tree's printed form."""
        lines = [x.strip() for x in description.splitlines() if x.strip()][1:]
        nodes, at = [], 0

        def node() -> int:
            nonlocal at
            line, k = lines[at], len(nodes)
            at += 1
            nodes.append([0, 0.0, k, k, 0.0])
            if line.startswith("Predict"):
                nodes[k][4] = float(line.split(":")[1])
                return k
            m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
            nodes[k][:2] = int(m[1]), float(m[2])
            nodes[k][2] = node()
            at += 1  # the Else line
            nodes[k][3] = node()
            return k

        node()
        return tuple(np.array(c) for c in zip(*nodes))

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH + 1):
                at = np.where(x[np.arange(len(x)), feature[at]] <= threshold[at], left[at], right[at])
            total += weight * value[at]
        return 1 / (1 + np.exp(-2 * total))


_ARTICLE = re.compile(r"<(article|main)\b([^>]*)>", re.I)
_END = re.compile(r"</(article|main)\s*>", re.I)
_BOILERPLATE = [
    '<div class="{}" data-x="drop">{}</div>', '<section id="{}" data-x="drop"><h3>{}</h3><p>{}</p><p>{}</p></section>', '<aside data-x="drop"><p>{}</p></aside>',
    '<form data-x="drop"><p>{}</p><label>{}</label></form>', '<div id="{}" data-x="drop"><ul><li>{}</li><li>{}</li></ul></div>', '<div class="{}" data-x="drop"><p>{}</p><p>{}</p></div>',
    '<div class="{}" data-x="drop"><ul><li><a href="/">{}</a></li><li><a href="/">{}</a></li></ul></div>', '<ul class="{}" data-x="drop"><li><a href="/">{}</a></li><li><a href="/">{}</a></li></ul>',
    '<nav class="{}"><a href="/">{}</a> <a href="/">{}</a></nav>', '<nav><a href="/">{}</a></nav>', '<nav><ul><li><a href="/">{}</a></li><li><a href="/">{}</a></li></ul></nav>', "<footer>{}</footer>", "<aside>{}</aside>",
    '<div class="{}" data-x="drop"><div class="author">{}</div><div>{}</div></div>',
]
# what may stand in an article, whatever it looks like
_KEPT = [
    '<p><a href="/">{}</a></p>', '<p><a href="/">{}</a> {}</p>', '<ul><li><a href="/">{}</a></li><li><a href="/">{}</a></li></ul>', '<ol><li><a href="/">{}</a></li></ol>', " {} ", " {} <p>{}</p>", "<div>{}</div>",
    '<div class="{name}"><p>{}</p><p>{}</p></div>', '<section id="{name}"><p>{}</p><p>{}</p></section>', '<section id="{name}"><h2>{}</h2><p>{}</p></section>', '<div class="{name}">{}</div>', '<ul class="{name}"><li>{}</li><li>{}</li></ul>',
    "<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li><li>{}</li></ul>", "<h2>{}</h2>", "<h3>{}</h3><p>{}</p>", "<p>{}</p>", "<table><tr><td>{}</td><td>{}</td></tr></table>",
    "<figure><img src=i><figcaption>{}</figcaption></figure>", "<pre>{}</pre>", "<dl><dt>{}</dt><dd>{}</dd></dl>", "<div><div><p>{}</p></div></div>", "<header><h2>{}</h2></header>",
]
_LAST = ["All rights reserved. Imprint", "&copy; 2023 {}", "Copyright {} - Privacy - Terms", "Imprint | Privacy", "Impressum Datenschutz AGB", "<a href=/>Contact</a> <a href=/>Terms</a>", "{} All rights reserved.", "Privacy. {}"]
_FIRST = ["{}", "<a href=/>{}</a> <a href=/>{}</a> <a href=/>{}</a>", "<ul><li><a href=/>{}</a></li><li><a href=/>{}</a></li><li><a href=/>{}</a></li></ul>"]
_STRUCTURE = re.compile(r"<(/?)(?:nav|header|footer|aside|section|form|div|article|main)\b([^>]*)>", re.I)


def guises(source: str, rng: random.Random) -> list[str]:
    """A labelled page in the forms it is learned in. Labels come from where things stand, never from what they are called."""
    marked = _ARTICLE.sub(r'<\1 data-x="keep"\2>', source)
    if marked == source:
        return []
    prose = [re.sub(r"<[^>]*>", " ", x)[:400] for x in re.split(r"(?=<p\b)", marked)[1:]] or ["."]
    tokens, others = sorted(NEGATIVE), sorted({w for x in prose for w in re.findall("[a-z]{3,9}", x.lower())} - NEGATIVE - POSITIVE - FILLERS) or ["x"]

    def words() -> str:
        text = rng.choice(prose)
        return text if rng.random() < 0.5 else " ".join(text.split()[: rng.randrange(2, 9)])

    def named() -> str:
        """A name that may hold a telling word, but isn't one."""
        pair = [rng.choice(tokens), rng.choice(others)]
        rng.shuffle(pair)
        return "-".join(pair) if rng.random() < 0.7 else rng.choice(others)

    def filled(shape: str) -> str:
        parts = [words() for _ in range(shape.count("{}"))]
        if '="{}"' in shape:
            parts[0] = rng.choice(tokens)
        return shape.replace("{name}", named()).format(*parts)

    def dressed(text: str) -> str:
        """With boilerplate anywhere, and with all sorts of blocks in the article."""
        start, end = _ARTICLE.search(text), None
        for end in _END.finditer(text):
            pass
        last = end.start() if end else len(text)
        pieces = re.split(r"(?=<p\b)", text[start.end() : last])
        for _ in range(rng.randrange(1, 5)):
            k = rng.randrange(len(pieces))
            pieces[k] += filled(rng.choice(_KEPT))
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(pieces))
            pieces[k] += filled(rng.choice(_BOILERPLATE))
        rest = text[last:].replace("</body>", filled(rng.choice(_BOILERPLATE)) + "</body>") if rng.random() < 0.7 else text[last:]
        return text[: start.end()] + "".join(pieces) + rest

    def renamed(text: str) -> str:
        name = rng.choice(['<div class="post-content" data-x="keep">', '<div id="main" data-x="keep">', '<div data-x="keep">', '<section data-x="keep">', '<td data-x="keep">'])
        return _END.sub("</" + name[1:].split(" ")[0] + ">", _ARTICLE.sub(name, text))

    def bare(text: str, flat: bool) -> str:
        """Divisions that aren't named, between first and last lines of a page; flat: each paragraph is one, and nothing holds them."""
        text = text[text.lower().find("<body") :] if "<body" in text.lower() else text
        inner = _STRUCTURE.sub(lambda m: f"<{m[1]}div{' data-x=' + chr(34) + k + chr(34) if (k := 'keep' if 'keep' in m[2] else 'drop' if 'data-x' in m[2] else '') else ''}>", text)
        if flat:
            first, last = inner.find('<div data-x="keep">'), inner.rfind("</div>", 0, max(inner.rfind("<div>"), 1))
            body = inner[first + 19 : last] if 0 <= first < last else inner[first + 19 :]
            inner = inner[:first] + re.sub(r"<(p|h\d)\b[^>]*>", '<div data-x="keep">', re.sub(r"</(p|h\d)\s*>", "</div>", body)) + (inner[last + 6 :] if 0 <= first < last else "")
        top = "".join(f'<div data-x="drop">{filled(rng.choice(_FIRST)[:200])}</div>' for _ in range(rng.randrange(2)))
        return top + inner + f'<div data-x="drop">{rng.choice(_LAST).replace("{}", words()[:60])}</div>'

    return [marked, dressed(marked), dressed(marked), renamed(marked), renamed(dressed(marked)), bare(marked, False), bare(dressed(marked), False), bare(marked, True)]


def training_nodes(pages: DataFrame, id_col: str, html_col: str, sample: int) -> DataFrame:
    """features, label of the sampled pages' nodes."""
    picked = pages.filter(F.lower(html_col).rlike("<(article|main)[ >]")).select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html"))
    ids = picked.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)  # a top-k of ids
    picked = picked.join(F.broadcast(ids), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rng, xs, ys = random.Random(i), [], []
                for k, form in enumerate(guises(source, rng)):
                    page = Page(form)
                    labels = page.labels()
                    if labels is None:
                        continue
                    x = page.features()
                    for blank in ([], ANCESTRY, TAGS) if k == 0 else ([],):
                        copy = x.copy()
                        copy[:, blank] = 0
                        xs.append(copy)
                        ys.append(labels)
                if xs:
                    x = np.concatenate(xs).astype(np.float64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, WIDTH, dtype=np.int32)), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([lists, pa.array(np.concatenate(ys))], ["x", "label"])

    return picked.mapInArrow(run, "x array<double>, label double")


def fitted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE):
    """Fits the trees in Spark: its model; None where no page is labelled or labels don't differ."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    shared_dir(pages.sparkSession)
    nodes = training_nodes(pages, id_col, html_col, sample).select(array_to_vector("x").alias("features"), "label").checkpoint()
    if nodes.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1, maxBins=32).fit(nodes)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Boosted | None:
    model = fitted(pages, id_col, html_col, sample)
    return Boosted.of(model) if model else None


def main_text(pages: DataFrame, model: Boosted | None, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (the id unless said), text, n_chars of each page."""
    text_batches(pages.sparkSession)
    keep = keep or [id_col]
    shared = shipped(pages.sparkSession, model)  # TREES trees of DEPTH levels
    schema = row_schema([pages.schema[c] for c in keep], "text string, n_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boosted = opened(shared)
        for b in slices(batches, len(keep), 4 << 20):
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                forms = [Page(s or "") for s in part.column(len(keep)).to_pylist()]
                xs = [f.features() for f in forms]
                if boosted is None:
                    ps = [f.plain(x) for f, x in zip(forms, xs)]
                else:
                    p = boosted.probability(np.concatenate(xs))
                    ps = np.split(p, np.cumsum([len(x) for x in xs])[:-1])
                texts = ["\n\n".join(f.decode(p)) for f, p in zip(forms, ps)]
                cols = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html_col).alias("__html")).mapInArrow(run, schema)
