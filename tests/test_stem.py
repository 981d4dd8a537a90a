"""Stemmer cases: FIXTURES.md hand traces (one or more per step) and examples
from the published Snowball English vocabulary."""

import pytest

from lexspark.functions.stem import stem

FIXTURE_CASES = {
    # ST1 exceptions
    "skies": "sky", "dying": "die", "only": "onli", "early": "earli", "news": "news",
    # ST2 short words
    "by": "by",
    # ST4 region prefixes
    "general": "general", "generate": "generat",
    # ST6 step 1a (and ST13 for textures)
    "caresses": "caress", "ties": "tie", "cries": "cri", "textures": "textur", "gas": "gas",
    # ST7 exception 2
    "inning": "inning", "proceeds": "proceed",
    # ST8 step 1b
    "running": "run", "hoping": "hope", "hopping": "hop", "binding": "bind", "compressed": "compress",
    # ST9 step 1c
    "happy": "happi", "say": "say",
    # ST10-ST12
    "national": "nation", "specification": "specif",
    # R2 blocks er
    "buffers": "buffer", "rendering": "render",
    # ST5 blocks ST13
    "use": "use",
}

VOCABULARY_CASES = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign",
    "consistency": "consist", "consistently": "consist", "consolation": "consol",
    "consolatory": "consolatori", "consolidate": "consolid", "consolingly": "consol",
    "consonant": "conson", "conspicuously": "conspicu", "conspiracy": "conspiraci",
    "conspirator": "conspir", "constable": "constabl", "constance": "constanc", "constancy": "constanc",
    "knackeries": "knackeri", "knaves": "knave", "kneaded": "knead", "knees": "knee",
    "knightly": "knight", "knitted": "knit", "knitting": "knit", "knives": "knive",
    "knocker": "knocker", "knopp": "knopp",
}


@pytest.mark.parametrize("word,expected", sorted({**FIXTURE_CASES, **VOCABULARY_CASES}.items()))
def test_stem(word, expected):
    assert stem(word) == expected


def test_non_ascii_letters_are_consonants():
    # é is not a vowel for the stemmer, É is not case-folded
    assert stem("queréelle") == "queréell"
    assert stem("Çmentre") == "Çmentr"


def test_y_handling():
    assert stem("yes") == "yes"
    assert stem("sayings") == "say"
    assert stem("crying") == "cri"


def test_none_and_short():
    assert stem(None) is None
    assert stem("a") == "a"
    assert stem("") == ""


def test_batches_are_stemmed_in_slices(monkeypatch):
    """A large Arrow batch is taken in slices, whose documents keep their own terms."""
    import pyarrow as pa
    from lexspark.operators import stemming
    monkeypatch.setattr(stemming, "SLICE_DOCS", 3)
    terms = [[{"term": "running", "freq": n + 1}, {"term": "runs", "freq": 1}, {"term": f"{n}", "freq": 2}] if n % 4 else []
             for n in range(10)]
    batch = pa.RecordBatch.from_pydict({"doc_key": list(range(10)), "term_count": [9] * 10, "terms": pa.array(
        terms, pa.list_(pa.struct([("term", pa.string()), ("freq", pa.int64())])))})
    out = list(stemming._stem_batches(iter([batch])))
    assert [b.num_rows for b in out] == [3, 3, 3, 1]
    got = {r["doc_key"]: {(t["term"], t["freq"]) for t in r["terms"]} for b in out for r in b.to_pylist()}
    assert got == {n: {("run", n + 2), (f"{n}", 2)} if n % 4 else set() for n in range(10)}


def test_words_that_no_step_changes_are_not_taken_through_the_steps(monkeypatch):
    from lexspark.functions import stem as module
    monkeypatch.setattr(module, "_regions", None)
    assert [stem(w) for w in ("gamma", "yoyo", "x86", "'tango", "café")] == ["gamma", "yoyo", "x86", "tango", "café"]


def test_the_longest_suffix_counts():
    from lexspark.functions import stem as module
    for name in ("STEP1A", "STEP1B", "STEP2", "STEP3", "STEP4"):
        table, by_last = getattr(module, name), getattr(module, f"_{name}")
        for s in table:
            assert module._longest_suffix(f"xx{s}", by_last) == max((t for t in table if f"xx{s}".endswith(t)), key=len)
        assert module._longest_suffix("", by_last) is None
