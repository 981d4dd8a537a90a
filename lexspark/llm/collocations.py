"""Phrase collocations by prefix-free parsing.

A phrase of 2 to ``MAX_WORDS`` words scores by how much oftener it occurs than its two
parts would by chance.  Counting every n-gram of the corpus one by one would move each word
several times, so the texts are parsed first:

1. Texts are cut into pieces at punctuation and pieces into words.  A chunk ends
   wherever the hash of the ``OVERLAP`` words ahead is 0 mod ``TRIGGER``; it keeps those words, and the next
   chunk begins with them.  The cuts depend on the words alone, so equal passages are cut
   alike.  Distinct chunks with their frequency form the dictionary (``packed_sums``).
2. n-grams are counted inside each distinct chunk and weighted by its frequency.
   One that starts in the overlap belongs to the next chunk, so each occurrence counts once.
   The sums of all n-grams go through a second packed exchange, and those that
   reach ``LEAST`` are kept: no part of a candidate is rarer than the candidate.
3. Spark joins give the candidates the counts of their parts, the score (decimal
   arithmetic, exact) and the longer candidates around them, and the best ``TOP`` of each language, found
   per slice of the phrases first.

Everything is per language.  Task memory is bounded by ``BLOCK_BYTES``, ``FLUSH_BYTES`` and the parts of the
exchange, plus one text.

Defined results: a null or empty text has no words; a null language is ``und``; a language without
words or without candidates gives no row; rows that repeat an id are separate texts; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from . import hashing, packed_sums, segments

MAX_WORDS = 3
OVERLAP = MAX_WORDS - 1
TRIGGER = 16            # mean words between two cuts of a long piece
LEAST = 10              # occurrences of a candidate
COVER_PERCENT = 50      # share of a phrase within one longer candidate that drops it
TOP = 2000
BLOCK_BYTES = 1 << 19   # text parsed at once
FLUSH_BYTES = 12 << 20  # distinct chunks, or n-grams, that a task holds before it sends them
SLICES = 4              # slices of the phrases ranked before the whole

_PIECE_END = segments.byte_class(*((ord(c), ord(c)) for c in ".,;:!?"), (0x0A, 0x0D))
_WORD = ~(_PIECE_END | segments.byte_class((0x20, 0x20), (0x09, 0x09)))


def parse(data: np.ndarray, offsets: np.ndarray, trigger: int = TRIGGER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of the rows' texts: canonical bytes, begin and end of each chunk in them, and its row.
    A chunk that another one continues ends with a space."""
    data = segments.lower(data)
    starts, ends, at = segments.runs(data, offsets, _WORD)
    if not len(starts):
        return data[:0], starts, starts, starts
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ended = np.concatenate([[0], np.cumsum(_PIECE_END[data])])
    piece = np.append(True, (row[1:] != row[:-1]) | (ended[starts[1:]] != ended[ends[:-1]]))  # first word of a piece
    text, begin, end = segments.spaced_words(data, starts, ends)
    hashes = segments.row_hashes(text, np.append(begin, len(text)))  # each word with its space
    with np.errstate(over="ignore"):
        ahead = hashes.copy()
        for k in range(1, OVERLAP):
            ahead[:-k] = ahead[:-k] * np.uint64(0xA3B195354A39B70D) + hashes[k:]
    cut = piece | (hashing.mix(ahead) % np.uint64(trigger) == 0)
    number = np.cumsum(piece)
    n = len(starts)
    for k in range(1, OVERLAP):  # the words ahead must lie in the same piece
        cut[n - k:] = piece[n - k:]
        cut[:n - k] &= piece[:n - k] | (number[k:] == number[:n - k])
    first = np.flatnonzero(cut)
    following = np.append(first[1:], n)
    goes_on = np.append(~piece[first[1:]], False)
    last = np.where(goes_on, following + OVERLAP, following) - 1
    return text, begin[first], end[last] + goes_on, row[first]


def ngrams(chunks: pa.Table | pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """Every n-gram that the chunks of ``(lang, text, n)`` own, and the chunk it comes from."""
    data, offsets = hashing.text_buffer(chunks.column("text"))
    starts, ends, at = segments.runs(data, offsets, _WORD)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    goes_on = data[offsets[1:] - 1] == 0x20
    owned = np.arange(len(starts)) < (at[1:] - OVERLAP * goes_on)[row]
    from_word, to_word = [], []
    for n in range(1, MAX_WORDS + 1):
        whole = np.flatnonzero(owned[:len(row) - n + 1] & (row[:len(row) - n + 1] == row[n - 1:]))
        from_word.append(whole)
        to_word.append(whole + n - 1)
    first, last = np.concatenate(from_word), np.concatenate(to_word)
    lengths = ends[last] - starts[first]
    return segments.as_array(segments.gather(data, starts[first], lengths), lengths), row[first]


def _sent(tables: Iterator[pa.Table], parts: int, flush: int) -> Iterator[pa.RecordBatch]:
    """The tables, summed over about ``flush`` bytes of distinct keys at a time, as packed rows."""
    width, seed = packed_sums.widths(parts)[0], TaskContext.get().partitionId() * 1_000_003
    held, size = [], 0
    for table in tables:
        held.append(table)
        size += table.nbytes
        if size > flush:
            yield from packed_sums.send(packed_sums.summed(held), parts, width, seed)
            held, size, seed = [], 0, seed + 1
    if held:
        yield from packed_sums.send(packed_sums.summed(held), parts, width, seed)


def _send_chunks(parts: int):
    block, flush, trigger = BLOCK_BYTES, FLUSH_BYTES, TRIGGER

    def chunks(batch: pa.RecordBatch) -> pa.Table:
        text, begin, end, row = parse(*hashing.text_buffer(batch.column("text")), trigger)
        return pa.table([batch.column("lang").cast(pa.large_string()).take(pa.array(row)),
                         segments.as_array(segments.gather(text, begin, end - begin), end - begin),
                         pa.array(np.ones(len(row), np.int64))], schema=packed_sums.TABLE_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(map(chunks, hashing.chunks(batches, "text", block)), parts, flush)
    return run


def _send_ngrams(parts: int):
    """The n-grams of a part of the dictionary, a slice of its chunks at a time."""
    block, flush = BLOCK_BYTES, FLUSH_BYTES

    def counted(piece: pa.RecordBatch) -> pa.Table:
        grams, row = ngrams(piece)
        at = pa.array(row)
        return pa.table([piece.column("lang").take(at), grams, piece.column("n").take(at)], schema=packed_sums.TABLE_SCHEMA)

    def run(chunks: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from _sent(map(counted, hashing.chunks(chunks.combine_chunks().to_batches(), "text", block)), parts, flush)
    return run


def _frequent(least: int):
    def run(sums: pa.Table) -> Iterator[pa.RecordBatch]:
        kept = sums.filter(pc.greater_equal(sums.column("n"), least))
        yield from kept.cast(pa.schema([("lang", pa.string()), ("text", pa.string()), ("n", pa.int64())])).to_batches()
    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> DataFrame:
    """``lang, phrase, n_words, f``: the phrases of 1 to MAX_WORDS words that occur ``least`` times or more."""
    rows = _rows(docs, text_col, lang_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a chunk repeats its overlap; the n-grams of a word hold it MAX_WORDS * (MAX_WORDS + 1) / 2 times
    chunk_parts, gram_parts = packed_sums.part_count(2 * size), packed_sums.part_count(size * MAX_WORDS * (MAX_WORDS + 1) // 2)
    chunks = rows.mapInArrow(_send_chunks(chunk_parts), packed_sums.ROW)
    grams = packed_sums.sum_keys(chunks, chunk_parts, _send_ngrams(gram_parts), packed_sums.ROW)
    found = packed_sums.sum_keys(grams, gram_parts, _frequent(least), "lang string, text string, n long")
    n_words = F.size(F.split(F.col("text"), " "))
    return found.select("lang", F.col("text").alias("phrase"), n_words.alias("n_words"), F.col("n").alias("f"))


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _best(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                 cover_percent: int = COVER_PERCENT, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language."""
    counts = materialize(phrase_counts(docs, text_col, lang_col, least), "phrase-counts")
    total = _rows(docs, text_col, lang_col).groupBy("lang").agg(
        F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09.,;:!?\x0A-\x0D]+"))).alias("n"))
    words = F.split(F.col("phrase"), " ")
    part = lambda first, n: F.array_join(F.slice(words, first, n), " ")
    candidates = counts.where("n_words > 1").withColumnRenamed("f", "a")
    # candidates around a phrase: every longer one tells the shorter ones within it
    inside: list[Column] = []
    for longer in range(3, MAX_WORDS + 1):
        for n in range(2, longer):
            inside += [F.when(F.col("n_words") == longer, part(s, n)) for s in range(1, longer - n + 2)]
    around = candidates.where("n_words > 2").select("lang", F.explode(F.array(*inside)).alias("phrase"), "a") \
        .where("phrase is not null").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(around, ["lang", "phrase"], "left") \
        .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover_percent)).drop("longer")
    cuts = F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))
    cut = kept.withColumn("k", cuts).withColumn("first", part(1, F.col("k"))) \
        .withColumn("rest", part(F.col("k") + 1, F.col("n_words") - F.col("k")))
    known = counts.select("lang", "phrase", "f")
    cut = cut.join(known.withColumnsRenamed({"phrase": "first", "f": "l"}), ["lang", "first"]) \
             .join(known.withColumnsRenamed({"phrase": "rest", "f": "r"}), ["lang", "rest"])
    big = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(cast(1000000 as decimal(7, 0)) * {big('a')} * {big('a')}) div ({big('l')} * {big('r')})")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.score", "s.l", "s.r")
    # the best of each slice first, so that the last ranking of a language sees at most SLICES * top rows
    sliced = _best(scored.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES))), ["lang", "slice"], top)
    return _best(sliced, ["lang"], top).join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
