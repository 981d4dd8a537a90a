import hashlib
from array import array

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexspark.llm import bpe as op
from lexspark.llm.catalog import vocabulary_path

from . import fixtures as fx

PATH = vocabulary_path()
CASES = ["<|endoftext|>", "a <|endoftext|><|endoftext|> b<|endoftext|", " \n  a's  \n\nxx 'll don't  　x​", "x" * 5000,
         "🙂🙂 ́e", "\x00\x01 \x85 tab\tend ", "  lead", "trail  \n "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encoded(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_and_text_match_the_library(spark, library):
    rows = [(i, t, None, None) for i, t in enumerate(CASES + fx.texts() * 2)]
    docs = fx.documents(spark, rows)
    ids = op.encode(docs, PATH)
    got = {r.id: list(r.ids) for r in ids.collect()}
    assert got == {i: encoded(library, t) for i, t, *_ in rows}
    assert {r.id: r.text for r in op.decode(ids, PATH).collect()} == {
        i: library.decode(encoded(library, t), skip_special_tokens=False) for i, t, *_ in rows}


@pytest.mark.parametrize("bits", [9, 4, 1])
def test_joins_are_repaired_whatever_the_chunk_size(library, monkeypatch, bits):
    monkeypatch.setattr(op, "CHUNK_BITS", bits)
    own = op.Codec(PATH)
    for text in CASES + fx.texts():
        raw = (text or "").encode()
        cuts = op.cut_places(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        assert own.encode(raw, cuts).tolist() == encoded(library, text)


def test_digests(spark, library):
    docs = fx.documents(spark, [(1, "token by token", None, None), (2, None, None, None), (None, "x", None, None)])
    got = {r.id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op.round_trip(docs, PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in ((1, "token by token"), (2, ""), (None, "x")):
        ids = encoded(library, t)
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(t))
    assert op.round_trip(fx.empty(spark), PATH).collect() == []


def test_every_code_point_splits_alike(library):
    own = op.codec(PATH)
    points = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i <= 0xDFFF]
    for k in range(0, len(points), 256):
        text = "".join(f"a{x}b {x}{x} 1{x} ." for x in points[k:k + 256])
        assert own.parts.encode_ordinary(text) == encoded(library, text), hex(k)


def test_chunks_are_encoded_once(monkeypatch):
    own = op.Codec(PATH)
    calls = []
    real = own.parts.encode_ordinary
    monkeypatch.setattr(own, "_ids", lambda raw: calls.append(len(raw)) or array("i", real(raw.decode())))
    raw = (" ".join(fx.texts()[:12]) * 2).encode()
    cuts = op.cut_places(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    own.encode(raw, cuts)
    first = sum(calls)
    own.encode(raw, cuts)
    assert sum(calls) - first < first / 3  # the second time only joins are encoded


def test_chunks_are_reused_in_other_scripts():
    """A second encoding of a text re-encodes little of it, whatever its script."""
    import random

    import numpy as np

    from lexspark.llm import bpe, catalog, hashing
    import pyarrow as pa
    rng = random.Random(2)
    cyrillic = " ".join("".join(chr(rng.randint(0x430, 0x44F)) for _ in range(rng.randint(2, 9))) for _ in range(8000))
    chinese = "".join("".join(chr(rng.randint(0x5000, 0x8FFF)) for _ in range(rng.randint(4, 14))) + rng.choice("，。、") for _ in range(4000))
    spaced = " ".join("é　 x" + chr(rng.randint(0x2000, 0x200A)) + "ó y" for _ in range(3000))
    for text in (cyrillic, chinese, spaced):
        own = bpe.Codec(catalog.vocabulary_path())
        raw = text.encode()
        cuts = bpe.cut_places(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        first, done = own.encode(raw, cuts), []
        plain, own._ids = own._ids, lambda part: done.append(len(part)) or plain(part)
        assert own.encode(raw, cuts) == first == plain(raw)
        assert sum(done) < len(raw) / 3 or text is spaced
    assert hashing.text_buffer(pa.array(["x"]))[1].tolist() == [0, 1]
