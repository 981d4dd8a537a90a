"""Main-text extraction: gradient-boosted trees over DOM nodes with hierarchical decoding.

Every container of a page, and every element with a telling class, id or role, is a node; paragraphs, headings
and the like without one follow their container.  A node's features
are its tag, the groups of words in its attributes and those of its ancestors, depth, text and
link shares of its subtree, text per tag, and statistics of its siblings.  Boosted trees give each node
the odds of being main text.  Decoding picks the likeliest labelling of the whole tree in which
nothing below a dropped node is kept, by one pass up and one pass down the tree.

The trees are trained on about ``TRAIN_PAGES`` pages that mark their article with ``article`` or ``main``
(chosen by hash from those alone; all where there are fewer; at least half as many, or all, where
pages repeat or hold such a tag only in a comment or script): each as it is, labelled by those landmarks, and in ``LAYOUTS`` other layouts built from
its own texts, in which containers have other tags and names and notices, adverts, forms, side columns
and reader comments are added.  Pages are scored whatever their markup.

The text: of kept nodes, character references decoded, white space inside a block turned into one
space and trimmed, blocks in page order joined by a line feed; ``br`` is white space.

Defined results: null and empty pages, and pages without main text, give an empty text; broken markup is read as far as
it can be; where no page marks its article, only elements that never hold text are dropped; rows that
repeat are extracted alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .boosting import Boosted
from .html_tree import BLOCK, DROPPED, Tree, attribute, attribute_words

TRAIN_PAGES = 240
LAYOUTS = 3
#: Pages without this mark no article; some with it (in a comment, say) do not either.
LANDMARK = r"(?i)<(article|main)[\s/>]"
TAG_GROUPS = ({"nav", "menu"}, {"header", "hgroup"}, {"footer"}, {"aside"}, {"form", "fieldset", "legend", "label"},
              {"article"}, {"main"}, {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"},
              {"table", "tbody", "tr", "td", "th"}, {"div", "section"}, {"blockquote", "pre", "figure", "figcaption"}, {"span", "a"})
# Words of class, id and role attributes, by what they usually name.
WORD_GROUPS = (
    "nav navigation navbar menu menubar breadcrumb breadcrumbs toc pager pagination tabs skip links sitemap",
    "header masthead topbar top logo branding site hero toolbar",
    "footer foot bottom copyright colophon legal contentinfo imprint",
    "sidebar side aside rail widget widgets related recommended recommendations more popular trending recent archive "
    "complementary teaser teasers tags column",
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion promoted "
    "commercial banner dfp outbrain taboola affiliate",
    "cookie cookies consent gdpr privacy notice notices alert popup modal overlay newsletter subscribe subscription paywall "
    "disclaimer warning announcement dialog message",
    "form search login signin signup register input contact feedback survey poll",
    "comment comments disqus reply replies respond discussion review reviews thread commentlist responses",
    "share sharing social follow tweet facebook twitter like",
    "article content post entry main body story text prose markdown hentry page blog",
    "meta byline author date time published category categories dateline caption credit")
_WORD_GROUP = {w: i for i, words in enumerate(WORD_GROUPS) for w in words.split()}
_TAG_GROUP = {t: i for i, tags in enumerate(TAG_GROUPS) for t in tags}
#: Without a name of their own, and below something else than the body, these follow their parents.
INHERITS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figure figcaption tr td th tbody thead tfoot caption hr "
                     "address center".split())
_SPACE = re.compile(r"\s+")
N_TAGS, N_WORDS, N_SHAPE = len(TAG_GROUPS), len(WORD_GROUPS), 17
N_FEATURES = N_SHAPE + 2 * N_TAGS + 2 * N_WORDS


class Page:
    """A page's tree with the figures of each element and the elements that are nodes."""

    def __init__(self, source: str):
        self.tree = tree = Tree(source)
        n = len(tree.tags)
        self.dropped = [False] * n
        self.depth, self.words, self.own = [0] * n, [0] * n, [0] * n
        link = [0] * n
        in_link = [False] * n
        is_node = [False] * n
        for i, tag in enumerate(tree.tags):
            p = tree.parents[i]
            if i:
                self.dropped[i] = self.dropped[p] or tag in DROPPED
                self.depth[i] = self.depth[p] + 1
                in_link[i] = in_link[p] or tag == "a"
            bits = 0
            if tree.attributes[i]:
                for w in attribute_words(tree.attributes[i]):
                    if w in _WORD_GROUP:
                        bits |= 1 << _WORD_GROUP[w]
                    elif w.endswith("s") and w[:-1] in _WORD_GROUP:
                        bits |= 1 << _WORD_GROUP[w[:-1]]
            self.words[i] = bits
            follows = i and tag in INHERITS and tree.tags[p] not in ("html", "body")
            is_node[i] = not self.dropped[i] and (bits != 0 or tag in BLOCK and not follows)
        marks = [0] * n
        before, seen = [0] * n, 0
        placed = -1
        for element, text in tree.texts:
            if element > placed:
                for i in range(placed + 1, element + 1):
                    before[i] = seen
                placed = element
            if text is None or self.dropped[element]:
                continue
            size = len(text) if not text.isspace() else 0
            self.own[element] += size
            seen += size
            marks[element] += text.count(",") + text.count(".")
            if in_link[element]:
                link[element] += size
        for i in range(placed + 1, n):
            before[i] = seen
        text, tags, paragraphs, links, heads = self.own[:], [1] * n, [0] * n, link, [0] * n
        for i in range(n - 1, 0, -1):
            p, tag = tree.parents[i], tree.tags[i]
            if self.dropped[i]:
                continue
            if tag == "p":
                paragraphs[i] += 1
            elif tag == "h1":
                heads[i] += 1
            text[p] += text[i]
            tags[p] += tags[i]
            links[p] += links[i]
            marks[p] += marks[i]
            paragraphs[p] += paragraphs[i]
            heads[p] += heads[i]
        self.nodes = [i for i in range(n) if is_node[i] or i == 0]
        # what ancestors are called: bits of tags and words above
        above_tags, above_words = [0] * n, [0] * n
        children: dict[int, list[int]] = {}
        for i in range(1, n):
            p = tree.parents[i]
            g = _TAG_GROUP.get(tree.tags[p])
            above_tags[i] = above_tags[p] | (1 << g if g is not None else 0)
            above_words[i] = above_words[p] | self.words[p]
            if is_node[i]:
                children.setdefault(p, []).append(i)
        sums = {p: (len(c), sum(text[i] for i in c), sum(tree.tags[i] == "p" for i in c), {i: k for k, i in enumerate(c)})
                for p, c in children.items()}
        total = max(seen, 1)
        x = np.zeros((len(self.nodes), N_FEATURES), np.float32)
        for row, i in enumerate(self.nodes):
            siblings, sibling_text, sibling_p, places = sums.get(tree.parents[i], (1, text[i], 0, {i: 0}))
            t = text[i]
            x[row, :N_SHAPE] = (
                self.depth[i], math.log1p(t), links[i] / t if t else 0.0, math.log1p(t / tags[i]), math.log1p(self.own[i]),
                paragraphs[i], 100 * marks[i] / t if t else 0.0, math.log1p(siblings), places.get(i, 0) / siblings,
                sibling_p / siblings, math.log1p((sibling_text - t) / max(siblings - 1, 1)), t / total,
                before[i] / total, heads[i], math.log1p(tags[i]), t == 0, t / max(sibling_text, 1))
            g = _TAG_GROUP.get(tree.tags[i])
            if g is not None:
                x[row, N_SHAPE + g] = 1
            for base, bits, width in ((N_SHAPE + N_TAGS, above_tags[i], N_TAGS), (N_SHAPE + 2 * N_TAGS, self.words[i], N_WORDS),
                                      (N_SHAPE + 2 * N_TAGS + N_WORDS, above_words[i], N_WORDS)):
                while bits:
                    low = bits & -bits
                    x[row, base + low.bit_length() - 1] = 1
                    bits ^= low
        self.features = x

    def decode(self, log_odds: np.ndarray | None) -> list[bool]:
        """Keep or drop per element: the likeliest labelling without a kept element below a dropped one."""
        tree, n = self.tree, len(self.tree.tags)
        odds = [0.0] * n  # elements that are no nodes follow their parents
        if log_odds is not None:
            for i, z in zip(self.nodes, log_odds.tolist()):
                odds[i] = z
            for i in range(n):
                if tree.tags[i] in ("html", "body"):
                    odds[i] = 0.0
        # gain of keeping an element (and the best below) over dropping all of it
        gain = odds[:]
        for i in range(n - 1, 0, -1):
            if not self.dropped[i] and gain[i] > 0:
                gain[tree.parents[i]] += gain[i]
        keep = [True] * n
        for i in range(1, n):
            node_like = odds[i] != 0.0
            keep[i] = keep[tree.parents[i]] and not self.dropped[i] and (gain[i] > 0 if node_like else gain[i] >= 0)
        return keep

    def blocks(self, keep: list[bool]) -> list[str]:
        """The texts of kept elements, block by block."""
        out, part = [], []
        for element, text in self.tree.texts:
            if text is None:
                if part:
                    out.append("".join(part))
                    part = []
            elif keep[element]:
                part.append(text)
        out.append("".join(part))
        joined = (_SPACE.sub(" ", b).strip() for b in out)
        return [b for b in joined if b]


def landmark_labels(page: Page, built: bool = False) -> np.ndarray | None:
    """1 for nodes inside an article or main (or holding one), 0 for others; None without such a landmark.
    ``data-part`` of built layouts says it outright."""
    tree = page.tree
    label = [0] * len(tree.tags)
    holds = [False] * len(tree.tags)
    found = False
    for i, tag in enumerate(tree.tags):
        p = tree.parents[i]
        given = attribute(tree.attributes[i], "data-part") if built and "data-part" in tree.attributes[i] else None
        if given:
            label[i] = int(given == "main")
        elif tag in ("article", "main"):
            label[i] = 1
        else:
            label[i] = label[p] if i and tag not in ("nav", "aside", "footer", "form") else 0
        found |= bool(label[i])
    for i in range(len(tree.tags) - 1, 0, -1):
        if label[i] or holds[i]:
            holds[tree.parents[i]] = True
    if not found:
        return None
    return np.array([label[i] or holds[i] for i in page.nodes], np.float32)


def layout(blocks: list[str], rest: list[str], rng: random.Random) -> str:
    """A page of the given main blocks in a layout of its own, with made-up surroundings of the same texts."""
    esc = entities.escape
    some = lambda: rng.choice(rest or blocks)
    words = lambda n: " ".join(some().split()[:n])
    prose = lambda: " ".join(rng.choice(blocks).split()[:rng.randint(5, 60)])

    def box(tags: str, names: str, inner: str, part: str = "rest") -> str:
        tag = rng.choice(tags.split())
        name = rng.choice(names.split())
        where = rng.choice(("class", "class", "id"))
        bare = rng.random() < 0.15 and tag not in ("div", "section", "span", "td")
        named = "" if bare else f' {where}="{rng.choice(("", "", "site-", "x-", "block "))}{name}"'
        return f'<{tag}{named} data-part="{part}">{inner}</{tag}>'

    items = lambda n, link=True: "".join(
        f'<li><a href="/{i}">{esc(words(2))}</a></li>' if link else f"<li>{esc(words(6))}</li>" for i in range(n))
    paragraphs = lambda n: "".join(f"<p>{esc(prose())}</p>" for _ in range(n))
    menu = lambda: box("nav div ul", "menu nav navbar navigation breadcrumb", f"<ul>{items(rng.randint(3, 8))}</ul>")
    surroundings = {
        "menu": menu,
        "header": lambda: box("header div", "header masthead topbar site-header banner",
                              f"<a href='/'>{esc(words(3))}</a>" + (menu() if rng.random() < 0.5 else f"<p>{esc(words(8))}</p>")),
        "ad": lambda: box("div aside section p", "ad ads advert advertisement sponsored promo ad-banner", rng.choice(("", "<p>")) + esc(prose())),
        "notice": lambda: box("div section p", "cookie-notice consent notice alert newsletter popup",
                              f"<p>{esc(prose())}</p>" + rng.choice(("", "<button>OK</button>"))),
        "form": lambda: box("form", "search form login subscribe", f"<label>{esc(words(4))}</label><input name='q'><p>{esc(words(9))}</p>"),
        "side": lambda: box("aside div section", "sidebar related widget popular recent rail", f"<h3>{esc(words(3))}</h3>" + rng.choice(
            (f"<ul>{items(rng.randint(3, 6), rng.random() < 0.7)}</ul>", paragraphs(rng.randint(1, 3))))),
        "share": lambda: box("div ul", "share social follow", items(3)),
    }
    after = {"comments": lambda: box("div section ol", "comments comment-list disqus reviews discussion", "".join(
        box("div li article", "comment reply review", f"<p>{esc(words(2))}</p>" + paragraphs(rng.randint(1, 2)))
        for _ in range(rng.randint(1, 4)))), "side": surroundings["side"], "form": surroundings["form"],
        "footer": lambda: box("footer div", "footer site-footer copyright legal", f"<p>&copy; {esc(prose())}</p>")}
    body = []
    for k, b in enumerate(blocks):
        body.append(f"<h1>{esc(b)}</h1>" if k == 0 and rng.random() < 0.8 else
                    f"<h2>{esc(b)}</h2>" if len(b) < 60 and rng.random() < 0.5 else f"<p>{esc(b)}</p>")
        if rng.random() < 0.12:
            body.append(rng.choice([surroundings[x] for x in ("ad", "share", "side", "notice")])())
    inner = "".join(body)
    if rng.random() < 0.3:
        inner = f'<div data-part="main">{inner}</div>'
    if rng.random() < 0.3:
        inner += after["comments"]()
    main = box("article main div div section td", "content post-content entry article-body story main post text", inner, "main")
    top = [surroundings[x]() for x in surroundings if rng.random() < 0.55]
    bottom = [f() for f in after.values() if rng.random() < 0.6]
    rng.shuffle(top)
    page = "".join(top) + main + "".join(bottom)
    if rng.random() < 0.3:
        page = f'<div class="{rng.choice(("wrapper", "container", "page", "layout"))}">{page}</div>'
    return f"<html><body>{page}</body></html>"


def _training_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Features and labels of the sampled pages and of their other layouts."""
    for batch in batches:
        for key, source in zip(batch["key"], batch["html"]):
            page = Page(source)
            labels = landmark_labels(page)
            if labels is None:
                continue
            shown = [(page, labels)]
            main = dict(zip(page.nodes, labels))
            inside = [page.tree.tags[i] in ("article", "main") for i in range(len(page.tree.tags))]
            for i in range(1, len(inside)):
                inside[i] = inside[i] or inside[page.tree.parents[i]]
            blocks = page.blocks([k and main.get(i, 1) == 1 and not page.dropped[i] for i, k in enumerate(inside)])
            rest = page.blocks([not k and not page.dropped[i] for i, k in enumerate(inside)])
            rng = random.Random(int(key))
            for _ in range(LAYOUTS if blocks else 0):
                built = Page(layout(blocks, rest, rng))
                shown.append((built, landmark_labels(built, True)))
            for p, y in shown:
                yield pd.DataFrame({"key": [key], "x": [p.features.tobytes()], "y": [y.astype(np.float32).tobytes()]})


def learn(pages: DataFrame, html_col: str = "html", train_pages: int = TRAIN_PAGES) -> Boosted | None:
    """The node classifier of a bounded sample of the pages that mark their article; None where none does."""
    rows = pages.where(F.col(html_col).rlike(LANDMARK)).select(F.xxhash64(html_col, F.lit(11)).alias("key"),
                                                               F.col(html_col).alias("html"))
    share = min(1.0, train_pages / max(rows.count(), 1))
    while True:
        picked = rows.where(F.pmod("key", F.lit(1_000_000_000)) < F.lit(1_000_000_000) * share).dropDuplicates(["key"])
        found = picked.mapInPandas(_training_rows, "key long, x binary, y binary").toPandas()
        n = found["key"].nunique()
        if share >= 1 or 2 * n >= train_pages:
            break
        # copies, or landmarks only in comments and scripts: take more pages
        share = min(1.0, share * min(64.0, max(2.0, train_pages / max(n, 1))))
    if not len(found):
        return None
    found = found.sort_values(["key", "x"], kind="stable")
    x = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in found["x"]])
    y = np.concatenate([np.frombuffer(b, np.float32) for b in found["y"]])
    return Boosted(x, y)


def extract(pages: DataFrame, model: Boosted | None, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` (a column of that name is replaced)."""

    @F.pandas_udf("string")
    def texts(sources: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(sources), 256):
            pages = [Page(s or "") for s in sources.iloc[at:at + 256]]
            odds = [None] * len(pages)
            if model is not None and pages:
                z = model.log_odds(np.concatenate([p.features for p in pages]))
                odds = np.split(z, np.cumsum([len(p.nodes) for p in pages])[:-1])
            out += ["\n".join(p.blocks(p.decode(z))) for p, z in zip(pages, odds)]
        return pd.Series(out, dtype=object)

    return pages.withColumn("text", texts(F.col(html_col)))
