"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over ``WINDOW`` bytes cuts every text into chunks of about
``1 << CHUNK_BITS`` bytes; the cuts follow the content, so passages shared by documents give equal
chunks whatever surrounds them.  A task encodes each chunk once and keeps the ids of
the ``CACHE_BYTES`` last used bytes of chunks.

Joins are repaired.  A printable ASCII character followed by a space or a line
feed always ends a pre-token, whatever stands around it, so encodings on both sides of
such a place agree with the encoding of the whole.  A chunk therefore contributes
the ids between its first and its last such place; what lies from the last one of the
left chunk to the first one of the right chunk is re-encoded as one piece.  Where a chunk has none,
the piece grows over it until both sides agree.

The ids equal those of the tokenizer file with ``add_special_tokens=False``: a special
token's string in a text is that token, and texts between are encoded apart.  The work is done by
``tiktoken`` with the file's ranks and the byte-level split pattern; a test compares it with the
``tokenizers`` library over every code point.

Defined results: null and empty texts have no ids and decode to the empty text; rows that
repeat are encoded alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import hashing

WINDOW = 16
CHUNK_BITS = 9
CACHE_BYTES = 16 << 20
BATCH_BYTES = 1 << 20
# Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable ones for
    themselves, the others for the letters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one task for one vocabulary file."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.parts = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = special
        self.special_split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in special.items()}
        self.cache: OrderedDict[bytes, tuple] = OrderedDict()
        self.cached_bytes = 0

    def _ids(self, raw: bytes) -> array:
        return array("i", self.parts.encode_ordinary(raw.decode()))

    def _chunk(self, raw: bytes) -> tuple[bytes, array | None, bytes]:
        """Head, ids of the middle and tail of a chunk; a chunk without a safe place is all head."""
        known = self.cache.get(raw)
        if known is not None:
            self.cache.move_to_end(raw)
            return known
        a = np.frombuffer(raw, np.uint8)
        safe = safe_places(a)
        if len(safe):
            first, last = int(safe[0]), int(safe[-1])
            known = raw[:first], self._ids(raw[first:last]), raw[last:]
        else:
            known = raw, None, b""
        self.cache[raw] = known
        self.cached_bytes += len(raw)
        while self.cached_bytes > CACHE_BYTES:
            self.cached_bytes -= len(self.cache.popitem(last=False)[0])
        return known

    def _plain(self, raw: bytes, cuts: list[int]) -> array:
        ids = array("i")
        join = []  # what waits for the next safe place
        begin = 0
        for end in [*cuts, len(raw)]:
            head, middle, tail = self._chunk(raw[begin:end])
            begin = end
            join.append(head)
            if middle is not None:
                ids += self._ids(b"".join(join))
                ids += middle
                join = [tail]
        return ids + self._ids(b"".join(join))

    def encode(self, raw: bytes, cuts: list[int]) -> array:
        """Ids of a text (UTF-8) that was cut at ``cuts``."""
        if not self.special_split or not any(s.encode() in raw for s in self.special):
            return self._plain(raw, cuts)
        ids, begin = array("i"), 0
        for part in self.special_split.split(raw.decode()):
            if part in self.special:
                ids.append(self.special[part])
                begin += len(part.encode())
            elif part:
                own = part.encode()
                ids += self._plain(own, [c - begin for c in cuts if begin < c < begin + len(own)])
                begin += len(own)
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


# The last bytes of white space beyond ASCII, and full stops and commas of CJK texts, in UTF-8.
_SPACE_ENDS = np.isin(np.arange(256), [0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F])
_CJK_MARKS = ("\u3001", "\u3002", "\uff0c", "\uff01", "\uff1f", "\uff1a", "\uff1b")


def safe_places(a: np.ndarray) -> np.ndarray:
    """Places where a pre-token surely ends: before a space or line feed that follows anything but white
    space, and between a CJK mark and an ideograph."""
    solid = ((a > 0x20) & (a < 0x7F)) | ((a >= 0x80) & ~_SPACE_ENDS[a])
    safe = np.zeros(len(a) + 1, bool)
    safe[1:-1] = ((a[1:] == 0x20) | (a[1:] == 0x0A)) & solid[:-1]
    if len(a) > 3:
        ideograph = (a[3:] >= 0xE5) & (a[3:] <= 0xE8)
        for mark in _CJK_MARKS:
            x, y, z = mark.encode()
            safe[3:-1] |= ideograph & (a[:-3] == x) & (a[1:-2] == y) & (a[2:-1] == z)
    return np.flatnonzero(safe)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The task's codec of a vocabulary file (a Python worker keeps it)."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def cut_places(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Per text the places where its chunks end: the rolling hash of the bytes before is 0 in its
    CHUNK_BITS top bits, and a character ends."""
    hashes = hashing.rolling(data, WINDOW)
    ends = np.flatnonzero(hashes >> np.uint64(64 - CHUNK_BITS) == 0) + WINDOW
    ends = ends[ends < len(data)]
    ends = ends[(data[ends] & 0xC0) != 0x80]
    bounds = np.searchsorted(ends, offsets)
    out = []
    for i, begin in enumerate(offsets[:-1]):
        own = ends[bounds[i]:bounds[i + 1]] - begin
        out.append(own[own >= WINDOW].tolist())  # the hashed bytes lie in this text
    return out


def _encoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[array]]]:
    own = codec(path)
    for batch in hashing.chunks(batches, "text", BATCH_BYTES):
        data, offsets = hashing.text_buffer(batch.column("text"))
        raw = data.tobytes()
        yield batch.column("id"), [own.encode(raw[s:e], cuts) for s, e, cuts in
                                   zip(offsets[:-1].tolist(), offsets[1:].tolist(), cut_places(data, offsets))]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``id, ids ARRAY<INT>`` per row; ``path`` is a byte-level BPE file all executors have.  With ``decoded``
    also ``decoded_sha256`` of the text that the ids give back."""
    def run(batches):
        own = codec(path)
        for keys, ids in _encoded(path, batches):
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([np.frombuffer(x, np.int32) for x in ids])
            columns = [keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if decoded:
                columns.append(pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids]))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "decoded_sha256"][:len(columns)])
    return _input(docs, id_col, text_col).mapInArrow(
        run, _schema(docs, id_col, "ids array<int>" + ", decoded_sha256 string" * decoded))


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id, text`` per row of ``encoded`` (null ids: empty)."""
    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, _schema(encoded, id_col, "text string"))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` per row: encoded and decoded in one task."""
    def run(batches):
        own, names = codec(path), None
        for keys, ids in _encoded(path, batches):
            names = names or {i: str(i) for i in own.bytes_of}
            digests = [hashlib.sha256(",".join(map(names.__getitem__, x)).encode()).hexdigest() for x in ids]
            decoded = [hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(x) for x in ids], pa.int64()), pa.array(digests),
                                              pa.array(decoded)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return _input(docs, id_col, text_col).mapInArrow(
        run, _schema(docs, id_col, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _schema(docs: DataFrame, id_col: str, rest: str) -> str:
    return f"id {docs.schema[id_col].dataType.simpleString()}, {rest}"
