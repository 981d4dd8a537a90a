import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from lexspark.llm import collocations as op, hashing, packed_sums

from . import fixtures as fx


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", fx.ascii_lower(text)):
        yield [w for w in re.split(r"[\x20\x09]+", piece) if w]


def counts(rows):
    f = defaultdict(Counter)
    for text, lang in rows:
        for w in pieces(text):
            for n in (1, 2, 3):
                f[lang or "und"].update(" ".join(w[i:i + n]) for i in range(len(w) - n + 1))
    return f


def brute(rows, least=10, cover=50, top=2000):
    out = []
    for lang, f in counts(rows).items():
        n = sum(c for p, c in f.items() if " " not in p)
        candidates = {p: a for p, a in f.items() if " " in p and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            w = p.split(" ")
            if len(w) == 3:
                for part in (" ".join(w[:2]), " ".join(w[1:])):
                    longer[part] = max(longer[part], a)
        found = []
        for p, a in candidates.items():
            if p in longer and 100 * longer[p] >= cover * a:
                continue
            w = p.split(" ")
            cuts = [(1_000_000 * a * a // (l * r), k, l, r) for k in range(1, len(w))
                    for l, r in [(f[" ".join(w[:k])], f[" ".join(w[k:])])]]
            score, _, l, r = min(cuts)
            found.append((-score, -a, p.encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(seed=1):
    import random
    rng = random.Random(seed)
    vocabulary = fx.words(rng, 30) + ["x", "é", "中文"]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    rows = []
    for i in range(300):
        text = rng.choice(" \t  ").join(rng.choice(lines) + rng.choice([".", ",  ", "\n", "", "?!", "\t"]) for _ in range(rng.randint(0, 6)))
        rows.append((i % 250, text.upper() if i % 9 == 0 else text, rng.choice(["en", "en", "fr", None, "und", "e\tn"]), None))
    rows += [(None, None, "en", None), (5, "", "de", None), (6, " .,;\n", "de", None), (7, "z " * 30_000, "en", None), (8, "solo", "xx", None)]
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    assert got(op.collocations(fx.documents(spark, rows))) == brute([(r[1], r[2]) for r in rows])
    assert got(op.collocations(fx.documents(spark, rows), least=3, cover_percent=80, top=5)) == \
        brute([(r[1], r[2]) for r in rows], 3, 80, 5)


def test_many_blocks_parts_and_levels(spark, monkeypatch):
    rows = corpus(2)
    for module, name, value in ((op, "BLOCK_BYTES", 700), (op, "FLUSH_BYTES", 3000), (op, "TRIGGER", 3),
                                (packed_sums, "PART_BYTES", 40_000), (packed_sums, "FAN", 3)):
        monkeypatch.setattr(module, name, value)
    assert len(packed_sums.widths(packed_sums.part_count(2 * sum(len(r[1] or "") for r in rows)))) > 1  # several levels
    docs = fx.documents(spark, rows).repartition(5)
    assert got(op.collocations(docs)) == brute([(r[1], r[2]) for r in rows])


def test_empty_table(spark):
    assert got(op.collocations(fx.empty(spark))) == []


@pytest.mark.parametrize("trigger", [1, 2, 5, 1000])
def test_parse_counts_each_occurrence_once(trigger):
    rows = [r[1] for r in corpus(3)]
    text, begin, end, row = op.parse(*hashing.text_buffer(pa.array(rows)), trigger)
    chunks = pa.table([pa.array(["a"] * len(begin), pa.large_string()), pa.array([text[a:b].tobytes().decode() for a, b in zip(begin, end)],
                       pa.large_string()), pa.array([1] * len(begin))], schema=packed_sums.TABLE_SCHEMA)
    grams, _ = op.ngrams(chunks)
    assert Counter(grams.to_pylist()) == counts([(r, "a") for r in rows])["a"]


def test_equal_passages_are_cut_alike():
    passage = " ".join(f"w{i}" for i in range(400))
    text, begin, end, row = op.parse(*hashing.text_buffer(pa.array([f"{passage} a b", f"c d e {passage}"])))
    chunks = [{text[a:b].tobytes() for a, b, r in zip(begin, end, row) if r == k} for k in (0, 1)]
    assert len(chunks[0] & chunks[1]) >= len(chunks[0]) - 3 and len(chunks[0]) > 10
