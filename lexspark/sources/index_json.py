"""Reading JSON indexes (S9) and importing the legacy layout (S10).

Schemas are explicit; nothing is inferred.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.index import Index, doc_freq_of
from ..operators.sizing import broadcast_if_small
from ..session import materialize

DOC_LINE_SCHEMA = "path string, count bigint, tf map<string,bigint>"
DF_LINE_SCHEMA = "term string, df bigint"
LEGACY_SCHEMA = "map<string, map<string,bigint>>"


def _index_from_docs(docs: DataFrame, doc_freq: DataFrame | None, stemmed: bool) -> Index:
    documents = docs.select(F.col("path").alias("doc_key"), F.col("count").alias("term_count"))
    postings = (docs.select(F.col("path").alias("doc_key"), F.col("count").alias("term_count"),
                            F.explode("tf").alias("term", "freq"))
                .select("doc_key", "term", "freq", "term_count"))
    if doc_freq is None:
        doc_freq = doc_freq_of(postings)
    # each JSON document already holds its term map: the forward index is a
    # projection of the same rows (no shuffle)
    doc_terms = docs.select(
        F.col("path").alias("doc_key"), F.col("count").alias("term_count"),
        F.array_sort(F.transform(F.map_entries(F.coalesce("tf", F.create_map().cast("map<string,bigint>"))),
                                 lambda e: F.struct(e["key"].alias("term"), e["value"].alias("freq")))).alias("terms"))
    return Index(documents=documents, postings=postings, doc_freq=doc_freq, stemmed=stemmed, doc_terms=doc_terms)


def read_json_index(spark: SparkSession, path: str, stemmed: bool = True) -> Index:
    """The JSON-lines form written by ``sinks.index_json.write_json_index``."""
    path = path.rstrip("/")
    docs = spark.read.schema(DOC_LINE_SCHEMA).json(f"{path}/docs")
    df = spark.read.schema(DF_LINE_SCHEMA).json(f"{path}/df")
    return _index_from_docs(docs, df, stemmed)


_CHUNK = "file string, start long, place long, text string, flips int, deep_0 int, deep_1 int"


def _sums(text: str) -> tuple[int, int, int]:
    """Whether the quotes of a text turn inside and outside of strings (1: they do), and the opening less the closing
    braces outside strings if it begins outside, and inside, of one."""
    parts = text.replace("\\\\", "").replace('\\"', "").split('"')
    balance = lambda outside: outside.count("{") - outside.count("}")
    return (len(parts) - 1) % 2, balance("".join(parts[0::2])), balance("".join(parts[1::2]))


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks: the pieces of a batch that follow each other in one byte range, as one text."""
    place = 0
    for batch in batches:
        files = batch.column("file").dictionary_encode()
        codes, starts = files.indices.to_numpy(), batch.column("start").to_numpy()
        cuts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])]) if len(codes) else []
        rows = []
        for at, end in zip(cuts, [*cuts[1:], len(codes)]):
            text = ",".join(batch.column("value").slice(at, end - at).to_pylist())
            rows.append((files.dictionary[codes[at]].as_py(), int(starts[at]), place, text, *_sums(text)))
            place += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CHUNK_TYPES)] if rows else
                                         [pa.array([], t) for t in _CHUNK_TYPES], names=_CHUNK_NAMES)


_CHUNK_NAMES = [c.split()[0] for c in _CHUNK.split(", ")]
_CHUNK_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text cut at commas, by byte ranges of the files (``file`` and ``start``), in chunks of an Arrow batch of
    pieces that follow each other, with the sums of ``_sums``: a row per chunk."""
    # an escape never crosses a comma, and there are none outside strings
    raw = (spark.read.option("lineSep", ",").text(path)
           .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"))
    return materialize(raw.mapInArrow(_join_pieces, _CHUNK), "json-pieces")


def _states(chunks: DataFrame) -> DataFrame:
    """Per chunk, in the order of the text: its number, whether it begins inside a string and the braces open there.
    Prefix sums over one row per chunk, without its text."""
    order = Window.orderBy(F.length("file"), "file", "start", "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda name: F.coalesce(F.sum(name).over(before), F.lit(0))
    key = ["file", "start", "place"]
    rows = chunks.select(*key, "flips", "deep_0", "deep_1", F.row_number().over(order).cast("long").alias("chunk"),
                         (so_far("flips") % 2).cast("int").alias("begins"))
    rows = rows.withColumn("deep", F.when(F.col("begins") == 1, F.col("deep_1")).otherwise(F.col("deep_0")))
    return materialize(rows.select(*key, "chunk", "begins", "deep", so_far("deep").cast("int").alias("depth")), "json-states")


_PARSED = ("at long, place int, kind string, section string, path string, edge boolean, count long, "
           "terms array<struct<term:string,n:long>>, text string, depth int")


def _number(value) -> int | None:
    return value if type(value) is int and 0 <= value < 1 << 63 else None


def _members(text: str, depth: int, balance: int) -> list[dict]:
    """The documents and terms of whole segments, text between commas outside strings, that begin where ``depth`` braces
    are open.  The keys above the first one are not known here (null)."""
    text = text.strip(", \t\r\n")
    if not text and not depth:
        return []
    # the text made whole: the keys above it are empty, the braces open after it are closed
    root = json.loads('{"":' * (depth - 1) + "{" * (depth > 0) + text + "}" * (depth + balance), object_pairs_hook=list, strict=False)
    rows = []
    for i, (section, entries) in enumerate(root):
        name = None if depth >= 2 and i == 0 else section
        flat = []
        for j, (key, value) in enumerate(entries if isinstance(entries, list) else []):
            if not isinstance(value, list):
                flat.append((key, _number(value)))
                continue
            opened = not (depth >= 3 and i == 0 and j == 0)
            terms = [(t, _number(n)) for _, held in value if isinstance(held, list) for t, n in held]
            count = [_number(n) for field, n in value if field == "count"]
            rows.append({"kind": "doc", "section": name, "path": key if opened else None, "edge": not opened,
                         "count": count[-1] if count else None, "terms": terms})
        rows.append({"kind": "terms", "section": name, "terms": flat})  # also tells where a section begins
    last = [r for r in rows if r["kind"] == "doc"][-1:]
    for r in last:
        r["edge"] = True  # it may go on in the next chunk
    return rows


def _cut(at: int, begins: int, depth: int, flips: int, deep: int, text: str) -> list[dict]:
    """The rows of a chunk: its members, and what belongs to a segment (``seam``) that a string with commas carries
    over its begin or end, as text."""
    ends = (begins + flips) % 2
    if not begins and not ends:
        return _members(text, depth, deep)
    pieces, rows = text.split(","), []
    low, high, state = 0, len(pieces), begins
    while state and low < len(pieces):
        state ^= _sums(pieces[low])[0]
        low += 1
    if low:
        rows.append({"kind": "seam", "place": -1, "text": ",".join(pieces[:low])})
        depth += _sums(rows[0]["text"])[2]
    if state:  # all of it is inside one string
        return rows
    while ends and high > low:
        high -= 1
        ends ^= _sums(pieces[high])[0]
    body = ",".join(pieces[low:high])
    balance = _sums(body)[1]
    rows += _members(body, depth, balance)
    if high < len(pieces):
        rows.append({"kind": "seam", "text": ",".join(pieces[high:]), "depth": depth + balance})
    return rows


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``_cut`` for chunks ``(at, begins, depth, flips, deep, text)``."""
    term = pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64())]))
    schema = pa.schema([("at", pa.int64()), ("place", pa.int32()), ("kind", pa.string()), ("section", pa.string()),
                        ("path", pa.string()), ("edge", pa.bool_()), ("count", pa.int64()), ("terms", term),
                        ("text", pa.string()), ("depth", pa.int32())])
    names = [f.name for f in schema]
    for batch in batches:
        for i in range(batch.num_rows):  # a row is a chunk
            chunk = [batch.column(c)[i].as_py() for c in ("at", "begins", "depth", "flips", "deep", "text")]
            found = [{"place": place, **row, "at": chunk[0]} for place, row in enumerate(_cut(*chunk))]
            columns = []
            for field in schema:
                values = [row.get(field.name) for row in found]
                if field.name == "terms":
                    flat = [pair for v in values for pair in v or ()]
                    entries = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.string()),
                                                          pa.array([p[1] for p in flat], pa.int64())], names=["term", "n"])
                    ends = np.cumsum([0] + [len(v or ()) for v in values]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), entries))
                else:
                    columns.append(pa.array(values, field.type))
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all chunks (at even places ``at``) and of the seams between them (odd)."""
    chunks = _pieces(spark, path)
    rows = chunks.join(broadcast_if_small(_states(chunks)), ["file", "start", "place"])
    rows = rows.select((F.col("chunk") * 2).alias("at"), "begins", "depth", "flips", "deep", "text")
    rows = materialize(rows.mapInArrow(_parse, _PARSED), "json-parsed")
    # a seam is the end of a chunk and the begins of those after it, until its string ends: a few pieces of text
    order = Window.orderBy("at", "place").rowsBetween(Window.unboundedPreceding, 0)
    seams = rows.where("kind = 'seam'").select("at", "place", "text", "depth", F.last(
        F.when(F.col("depth").isNotNull(), F.col("at")), ignorenulls=True).over(order).alias("of"))
    seams = seams.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("at", "place", "text"))).alias("p"), F.max("depth").alias("depth"))
    seams = seams.select((F.col("of") + 1).alias("at"), F.lit(0).alias("begins"), "depth", F.array_join("p.text", ",").alias("text"))
    seams = seams.mapInArrow(_with_sums, "at long, begins int, depth int, flips int, deep int, text string")
    return rows.where("kind <> 'seam'").unionByName(materialize(seams.mapInArrow(_parse, _PARSED), "json-seams"))


def _with_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [_sums(t)[:2] for t in batch.column("text").to_pylist()]
        flips, deep = (pa.array([s[i] for s in sums], pa.int32()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("begins"), batch.column("depth"), flips, deep,
                                          batch.column("text")], names=["at", "begins", "depth", "flips", "deep", "text"])


def read_json_object_index(spark: SparkSession, path: str, stemmed: bool = True) -> Index:
    """The single-object form ``{"docs": {...}, "df": {...}}``: one file, several files of an object each, or the
    ordered fragments of one object (``sinks.index_json.write_json_object_index``).

    Files are read in byte ranges, however few lines they have.  Text is cut at commas; whether a chunk begins inside a
    string and how many braces are open there follow from prefix sums over a row per chunk, after which each
    chunk is parsed alone.  Only the documents at the ends of chunks are put together again; no row is a posting."""
    rows = _parsed(spark, path)
    # what each place leaves open, from one row per place: the section and the document that were begun last
    last = lambda value, test: F.max_by(value, F.when(test, F.col("place")))
    doc = F.struct("at", "place")
    ends = rows.groupBy("at").agg(last(F.col("section"), F.col("section").isNotNull()).alias("section"),
                                  last(doc, F.col("path").isNotNull()).alias("doc"))
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    carry = broadcast_if_small(materialize(ends.select("at", *[
        F.last(c, ignorenulls=True).over(before).alias(f"{c}_before") for c in ("section", "doc")]), "json-carry"))
    rows = rows.join(carry, "at").withColumn("section", F.coalesce("section", "section_before"))
    docs = rows.where("section = 'docs' AND kind = 'doc'")
    owner = F.coalesce(F.when(F.col("path").isNotNull(), doc), F.col("doc_before"))
    edges = (docs.where("edge").groupBy(owner.alias("doc"))
             .agg(F.max("path").alias("path"), F.max("count").alias("count"), F.flatten(F.collect_list("terms")).alias("terms")))
    whole = docs.where("NOT edge").select("path", "count", "terms")
    docs = whole.unionByName(materialize(edges.select("path", "count", "terms"), "json-edges"))
    df = rows.where("section = 'df' AND kind = 'terms'").select(F.inline("terms")).where("n IS NOT NULL").select(
        "term", F.col("n").alias("df"))
    return _index_from_docs(docs.select("path", "count", F.map_from_entries("terms").alias("tf")), df, stemmed)


def read_legacy_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(path, count, tf)`` from ``{path: {TERM: freq}}`` objects, one per line (a single-line
    file holding the whole map works too); a document without terms has an empty map.  Terms are
    kept as stored (the legacy files are upper-case and unstemmed)."""
    raw = spark.read.text(path)
    maps = raw.where(F.length(F.trim("value")) > 0).select(F.from_json("value", LEGACY_SCHEMA).alias("m"))
    docs = maps.select(F.explode("m").alias("path", "tf"))
    count = F.aggregate(F.map_values(F.coalesce("tf", F.create_map().cast("map<string,bigint>"))),
                        F.lit(0).cast("bigint"), lambda a, x: a + x)
    return docs.select("path", count.alias("count"), "tf")


def legacy_index(spark: SparkSession, path: str) -> Index:
    """A full ``Index`` from a legacy file: lengths are the sums of the counts."""
    return _index_from_docs(read_legacy_documents(spark, path), None, stemmed=False)
