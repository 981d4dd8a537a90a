"""Language, quality and HTML models: held-out accuracy, hand-made cases, and brute force for the formulas."""

import html as entities
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import boosting, html_extract, language, quality
from lexspark.llm.common import crc_mod, table
from lexspark.llm.html_tree import Tree, attribute_words

from . import fixtures as fx

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


# --- language -----------------------------------------------------------------

@pytest.fixture(scope="module")
def learned(spark):
    docs = table(spark, SF, "documents")
    return language.learn(docs.where(crc_mod(F.col("doc_id"), 4) != 2))


def test_held_out_languages(spark, learned):
    docs = table(spark, SF, "documents").where(crc_mod(F.col("doc_id"), 4) == 2)
    rows = language.identify(docs, learned).select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixture_finds_both_languages(spark, learned):
    rows = {r.lang: r.text for r in table(spark, SF, "documents").where("length(text) > 3000").collect()}
    chosen, share, _ = learned.mixture(rows["en"][:2000] + " " + rows["de"][:1000])
    found = dict(zip([learned.languages[i] for i in chosen], share))
    assert set(found) == {"en", "de"} and found["en"] == pytest.approx(2 / 3, abs=0.08)


def test_em_is_monotone(learned):
    rng = np.random.default_rng(0)
    p, n = rng.random((40, 3)), rng.integers(1, 9, 40).astype(float)
    share, value = language.Model._em(p, n)
    assert share.sum() == pytest.approx(1)
    assert value >= float(n @ np.log(p @ np.full(3, 1 / 3)))


def test_no_letter_is_und(spark, learned):
    docs = fx.documents(spark, [(1, None, None, None), (2, "", None, None), (3, "12 ²½ 🙂 ...", None, None), (4, "中", None, None)])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, learned).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in learned.languages
    nothing = language.learn(fx.empty(spark))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(fx.empty(spark), learned).collect() == []


# --- quality ------------------------------------------------------------------

def test_held_out_quality(spark):
    docs = table(spark, LARGER, "documents").join(table(spark, LARGER, "labels"), "doc_id")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    machine = quality.learn(docs.where(~held_out).withColumn("label", F.col("quality")))
    rows = quality.score(docs.where(held_out), machine).select("quality", "score").collect()
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in rows]) > 0.98
    odd = quality.score(fx.documents(spark), machine).collect()
    assert len(odd) == len(fx.texts()) and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(fx.empty(spark), machine).collect() == []


def test_pair_term_equals_all_pairs():
    machine = quality.Machine()
    rng = np.random.default_rng(1)
    machine.w = rng.normal(size=quality.N_FEATURES).astype(np.float32)
    ids, x = np.array([3, 9, 20, 7]), np.array([0.5, 1.0, -2.0, 0.25], np.float32)
    z, _ = machine.raw_scores(ids, x, np.array([0, 4]))
    pairs = sum(float(machine.v[ids[a]] @ machine.v[ids[b]]) * x[a] * x[b] for a in range(4) for b in range(a))
    assert z[0] == pytest.approx(machine.bias + float(machine.w[ids] @ x) + pairs, rel=1e-4)


def test_nothing_to_learn(spark):
    assert quality.learn(fx.empty(spark).withColumn("label", F.lit(1))) is None
    assert {r.score for r in quality.score(fx.documents(spark), None).collect()} == {0.5}


# --- HTML ---------------------------------------------------------------------

def test_pages_of_the_tables(spark):
    pages = table(spark, SF, "pages")
    model = html_extract.learn(pages)
    for r in html_extract.extract(pages, model).collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        for mark in ("<h1>", "</h1>", "<p>", "</p>"):
            inner = inner.replace(mark, "\0")
        blocks = [" ".join(b.replace("<br>", " ").replace("<b>", "").split()) for b in inner.split("\0")]
        assert r.text == "\n".join(entities.unescape(b) for b in blocks if b)


@pytest.fixture(scope="module")
def node_model(spark):
    return html_extract.learn(table(spark, SF, "pages"))


def test_other_layouts(spark, node_model):
    rng = random.Random(8)
    hits = total = 0
    for _ in range(60):
        blocks = [" ".join(fx.words(rng, rng.randint(5, 60))) for _ in range(rng.randint(2, 8))]
        page = html_extract.Page(html_extract.layout(blocks, ["Home of all menus", "About us and more"], rng))
        got = page.blocks(page.decode(node_model.log_odds(page.features)))
        hits += len(set(got) & set(blocks))
        total += max(len(got), len(blocks))
    assert hits / total > 0.9


def test_decoding_is_the_best_consistent_labelling():
    rng = random.Random(5)
    for _ in range(30):
        source = "".join(rng.choice(["<div class=post>", "</div>", "<section>", "</section>", "x"]) for _ in range(9))
        page = html_extract.Page(source)
        odds = np.array([rng.uniform(-2, 2) for _ in page.nodes])
        keep = page.decode(odds)
        parents, n = page.tree.parents, len(page.tree.tags)
        assert all(keep[parents[i]] for i in range(1, n) if keep[i])
        value = lambda k: sum(z for i, z in zip(page.nodes, odds) if k[i] and i)
        best = max(value(k) for bits in range(2 ** (n - 1))
                   if all((k := [True] + [bool(bits >> j & 1) for j in range(n - 1)])[parents[i]] or not k[i] for i in range(1, n)))
        assert value(keep) == pytest.approx(best)


def test_broken_markup_and_references(spark):
    sources = ["<p>a&amp;b &eacute;&#233;&nbsp;c<p>d<br>e<!-- x --><script>if (a<b) '</p>'</script><style>p{}</style>f", "", None, "plain",
            "<div title='a>b'>x</div><div title=\"open>y", "<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>", "<" * 50, "</p></div>"]
    df = spark.createDataFrame(list(enumerate(sources)), "page_id long, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_extract.extract(df, None).collect()}
    assert got[0] == "a&b éé c\nd ef" and got[1] == got[2] == "" and got[3] == "plain"
    assert got[4].startswith("x") and got[5] == "1\n2\n3\n4"
    assert html_extract.extract(df.limit(0), None).collect() == []
    assert html_extract.learn(df) is None


def test_few_of_many_pages_mark_their_article(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(html_extract, "Boosted", lambda x, y: taken.append((x, y)) or "model")
    marked = [(f"<div class=menu>menu {i}</div><{tag}><p>Text {i}.</p></{tag}>",) for i in range(6)
              for tag in ("article", "MAIN\nid=x")]
    unmarked = [(f"<div class=menu>menu {i}</div><div><p>Text {i}.</p></div>",) for i in range(6000)]
    hidden = [(f"<!-- <article> --><div>Text {i}</div>",) for i in range(3000)]
    sizes = []
    for rows in (marked, marked + unmarked, marked + unmarked + hidden):
        assert html_extract.learn(spark.createDataFrame(rows, "html string"), train_pages=20) == "model"
        sizes.append(len(taken[-1][1]))
    assert len(set(sizes)) == 1  # the same twelve pages
    html_extract.learn(spark.createDataFrame(marked * 200 + unmarked, "html string"), train_pages=20)
    assert 10 / 12 * sizes[0] / 2 < len(taken[-1][1]) <= sizes[0]  # copies count once
    assert html_extract.learn(spark.createDataFrame(unmarked + hidden, "html string"), train_pages=20) is None


def test_deep_and_long_pages():
    page = html_extract.Page("<div>" * 3000 + "x" + "<p>y " * 2000)
    assert page.blocks(page.decode(None))[0] == "x"


def test_attribute_words():
    assert attribute_words(' class="siteFooter nav-bar" id=x data-y="ad"') == ["site", "footer", "nav", "bar", "x"]
    assert Tree("<a href='x>y'>t</a>").texts == [(1, "t")]


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(np.float32)
    model = boosting.Boosted(x[:2000], y[:2000])
    assert ((model.log_odds(x[2000:]) > 0) == (y[2000:] == 1)).mean() > 0.95


def test_broken_pages_take_linear_time():
    import time
    from lexspark.llm.html_tree import Tree
    for source in ("<a " * 350_000, "<span>" * 60_000 + "</b>" * 60_000, "<p><section>" + "<span>" * 30_000 + "<div>" * 30_000,
                   "<!-- x > " + "<b " * 300_000, "<a \"" * 100_000 + ">"):
        start = time.time()
        Tree(source)
        assert time.time() - start < 3, source[:20]


def test_copies_of_a_labelled_text_are_one_training_row(spark, monkeypatch):
    from lexspark.llm import quality
    seen = []
    train = quality.Machine.train
    monkeypatch.setattr(quality.Machine, "train", lambda self, rows, labels, weights=None, seed=7: seen.append((len(rows), list(weights)))
                        or train(self, rows, labels, weights, seed))
    rows = [(i, "hot text", None, None) for i in range(3000)] + [(9000 + i, f"text number {i}", None, None) for i in range(20)]
    labelled = fx.documents(spark, rows, clash=False).withColumn("label", F.when(F.col("doc_id") < 9000, 1).otherwise(F.col("doc_id") % 2))
    quality.learn(labelled)
    assert seen[0][0] == 21 and sorted(seen[0][1])[-1] == 3000


def test_mixture_against_plain_em(spark):
    """The language set and proportions of an EM and a selection written out one text at a time."""
    import math
    import random
    rng = random.Random(6)
    own = {"aa": "abcd", "bb": "cdef", "cc": "wxyz"}
    word = lambda lang: "".join(rng.choice(own[lang]) for _ in range(rng.randint(2, 6)))
    rows = [(i, " ".join(word(lang) for _ in range(80)), lang, None) for i, lang in enumerate(list(own) * 20)]
    mixed = [" ".join(word(rng.choice(langs)) for _ in range(60)) for langs in (["aa"], ["aa", "cc"], ["bb", "cc"], ["aa", "bb", "cc"]) for _ in range(4)]
    model = language.learn(fx.documents(spark, rows, clash=False))
    docs = fx.documents(spark, [(i, t, None, None) for i, t in enumerate([*mixed, "very long " * 30_000, *mixed])])
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}

    def em(p, n):
        share = [1 / len(p[0])] * len(p[0])
        for _ in range(language.ROUNDS if len(share) > 1 else 0):
            sums = [0.0] * len(share)
            for row, k in zip(p, n):
                total = sum(a * b for a, b in zip(row, share))
                for j in range(len(share)):
                    sums[j] += k * share[j] * row[j] / total
            share = [s / sum(n) for s in sums]
        return share, sum(k * math.log(sum(a * b for a, b in zip(row, share))) for row, k in zip(p, n))

    for i, text in enumerate(mixed):
        codes = language._codes(text).tolist()
        used = sorted(set(codes))
        n, p = [codes.count(u) for u in used], [[model.p[u][j] for j in range(3)] for u in used]
        everything, _ = em(p, n)
        chosen = [max(range(3), key=lambda j: sum(k * math.log(row[j]) for row, k in zip(p, n)))]
        share, best = em([[row[j] for j in chosen] for row in p], n)
        for nxt in sorted(range(3), key=lambda j: -everything[j]):
            if nxt in chosen:
                continue
            tried = [*chosen, nxt]
            tried_share, value = em([[row[j] for j in tried] for row in p], n)
            if value - best <= language.PENALTY * math.log(max(sum(n), 2)):
                break
            chosen, share, best = tried, tried_share, value
        want = sorted(zip((-s for s in share), (model.languages[j] for j in chosen)))
        assert got[i].lang_set == [lang for _, lang in want]
        assert all(abs(a + b) < 1e-9 for a, (b, _) in zip(got[i].lang_shares, want))
        assert got[i].lang_pred == want[0][1] and got[len(mixed) + 1 + i][1:] == got[i][1:]
