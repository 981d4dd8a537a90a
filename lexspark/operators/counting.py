"""Terms of whole texts counted inside the row, in Arrow batches.

A text is cut into the tokens of ``functions.analyze`` by the class of each character (white space, number, letter,
symbol); the classes come from the same JVM patterns, asked once for every code point.  Characters, tokens and
counts are whole numpy and Arrow columns: no step runs per token.  No dictionary table, no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.analyze import NUMBER_PATTERN, WHITE_SPACE_CLASS

CODE_POINTS = 0x110000
SPACE, NUMBER, LETTER, SYMBOL = range(4)
#: Characters of texts that are counted at a time (a longer text is counted alone).
SLICE_CHARS = 2 << 20


_runs: list[tuple[np.ndarray, np.ndarray]] = []  # asked once: the patterns of a JVM do not change


def char_classes(spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    """The class of every code point as runs: (classes, lengths).  One small job."""
    if not _runs:
        _runs.append(_asked(spark))
    return _runs[0]


def _asked(spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    kind = (F.when(char.rlike(f"^{NUMBER_PATTERN}"), NUMBER).when(char.rlike(r"^\p{IsAlphabetic}"), LETTER)
            .when(char.rlike(f"^[{WHITE_SPACE_CLASS}]"), SPACE).otherwise(SYMBOL))
    points = spark.range(CODE_POINTS, numPartitions=8).where("id not between 55296 and 57343")  # no surrogates
    found = points.select("id", kind.alias("kind")).where(F.col("kind") != SYMBOL).toArrow()
    classes = np.full(CODE_POINTS, SYMBOL, np.uint8)
    classes[found.column("id").to_numpy()] = found.column("kind").to_numpy()
    first = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]])
    return classes[first], np.diff(np.r_[first, CODE_POINTS])


def _counter(runs: tuple[np.ndarray, np.ndarray], rename: Callable[[str], str] | None, most: int):
    """The function of a task over batches ``(doc_key, text)``; whole in itself, so that plain terms need no package
    on the executors."""
    SPACE, NUMBER, LETTER, SYMBOL = range(4)

    def tokens(joined: str, classes):
        """The tokens of a text, folded, and the characters they start at."""
        import numpy as np
        import pyarrow as pa
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = classes[points]
        letter, number = kind == LETTER, kind == NUMBER
        run = letter | number
        after_run = np.r_[False, run[:-1]]
        starts = (kind == SYMBOL) | (run & ~after_run)
        # a run of letters and numbers that begins with numbers is cut before its first letter
        turns = np.flatnonzero(letter & np.r_[False, number[:-1]])
        if len(turns):
            run_starts = np.flatnonzero(run & ~after_run)
            letters = np.r_[0, np.cumsum(letter)]
            starts[turns[letters[turns] == letters[run_starts[np.searchsorted(run_starts, turns, "right") - 1]]]] = True
        starts = np.flatnonzero(starts)
        data = np.frombuffer(joined.encode("utf-8").lower(), np.uint8)  # of bytes, only ASCII letters
        keep = kind != SPACE
        if len(data) == len(points):
            before, kept = np.cumsum(keep), keep
        else:
            width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
            before, kept = np.cumsum(np.where(keep, width, 0)), np.repeat(keep, width)
        before = np.r_[0, before]
        offsets = np.r_[before[starts], before[-1]].astype(np.int32)
        found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[kept])))
        return found, starts

    def counted(keys, texts: list[str], classes):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        found, starts = tokens("\n".join(texts), classes)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        sizes = np.diff(np.searchsorted(starts, begins))
        words = found.dictionary_encode()
        names = words.dictionary
        if rename is not None:
            names = pa.array([rename(w) for w in names.to_pylist()], pa.string()).dictionary_encode()
            of_word, names = names.indices.to_numpy(), names.dictionary
        order = pc.sort_indices(names).to_numpy()  # codes in the order of the strings
        code = np.empty(len(names), np.int64)
        code[order] = np.arange(len(names))
        if rename is not None:
            code = code[of_word]
        n = max(len(names), 1)
        pairs, freq = np.unique(np.repeat(np.arange(len(texts)), sizes) * n + code[words.indices.to_numpy()], return_counts=True)
        row, term = np.divmod(pairs, n)
        ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
        entries = pa.StructArray.from_arrays([names.take(pa.array(order[term])), pa.array(freq.astype(np.int64))], names=["term", "freq"])
        return pa.RecordBatch.from_arrays([keys, pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), entries)],
                                          names=["doc_key", "term_count", "terms"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        classes = np.repeat(*runs)
        for batch in batches:
            keys, column = batch.column("doc_key"), batch.column("text")
            at, texts, chars = 0, [], 0
            for i in range(batch.num_rows):
                text = column[i].as_py() or ""
                if texts and chars + len(text) > most:
                    yield counted(keys.slice(at, len(texts)), texts, classes)
                    at, texts, chars = i, [], 0
                texts.append(text)
                chars += len(text) + 1
            if texts:
                yield counted(keys.slice(at, len(texts)), texts, classes)

    return count


def count_terms(docs: DataFrame, rename: Callable[[str], str] | None = None) -> DataFrame:
    """``doc_terms(doc_key, term_count, terms ARRAY<STRUCT<term, freq>>)`` of ``docs(doc_key, text)``: each distinct
    term of a text (by its name under ``rename``) with its count, sorted; a null text has none."""
    key_type = docs.schema["doc_key"].dataType.simpleString()
    count = _counter(char_classes(docs.sparkSession), rename, SLICE_CHARS)
    return docs.select("doc_key", F.make_valid_utf8("text").alias("text")).mapInArrow(
        count, f"doc_key {key_type}, term_count bigint, terms array<struct<term:string,freq:bigint>>")
