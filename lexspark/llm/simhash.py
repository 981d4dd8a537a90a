"""SimHash fingerprints (DataFrame functions only).

A text's terms are its words, each with the word that follows it; a term weighs as much as it has characters.
Each term is hashed to ``BITS`` bits, and every bit of the hash votes with the term's weight for or
against that bit of the fingerprint, repeats counted.  Texts that share most of their terms so agree in most
bits: the share of equal bits estimates the angle between the weighted term vectors.

Votes are sums over the exploded terms of a row: two 32-bit counters share a long (the
bits i and i + 32 of a hash), so a text has ``BITS / 2`` sums, in generated code.  Rows keep a
partition key of their own, so neither the votes nor what follows shuffles again.

``edited`` pairs each document with the next one by descending id.  The rows are range-sorted
into a table, where a place in the partition numbers them; runs of ``RUN_ROWS`` places form
the windows in which a row sees the next, and the first row of a run is sent to the
run before as a guest.  No window holds more than a run, whatever the ids.

``near`` finds all fingerprints within a Hamming radius: the bits are cut into blocks, and a table
per choice of blocks (all but ``radius`` of them) keys each fingerprint by the bits of those blocks, moved to the front.
Two fingerprints within the radius agree in at least one such table; a pair counts only in the first.  A key's
fingerprints are kept in salted arrays of about ``ARRAY_ROWS`` that are searched inside the row, so pairs are
never written out, and equal fingerprints are one class.  A family of g different fingerprints that share a
key costs g**2 comparisons, dealt over g / ARRAY_ROWS arrays.

Defined results: a null text counts as empty (texts may hold up to 2**30 characters); a text without words has fingerprint 0; a null id
comes after all others; equal ids go by a hash of their text; a single document is its own next one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

BITS = 128              # a multiple of 64
#: Up to 16 letters and digits, or other signs; longer runs are several words.
WORD = r"[\p{L}\p{M}\p{N}]{1,16}|[^\s\p{L}\p{M}\p{N}]{1,16}"
RUN_ROWS = 1 << 8
RADIUS = 3
BLOCKS = 4              # BITS / BLOCKS divides 64
ARRAY_ROWS = 512
_LANES = (1 << 32) | 1
_LOW = (1 << 32) - 1
_WORDS = range(BITS // 64)
FINGERPRINT = [f"f{w}" for w in _WORDS]


def _or(bits: list[Column]) -> Column:
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2])] + bits[len(bits) // 2 * 2:]
    return bits[0]


def fingerprints(rows: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys, f0, f1, ...``: the fingerprint of each row of ``rows``, which ``keys`` tell apart.  Rows that
    are clustered by some of the keys already are not shuffled."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
    # the outer form keeps a text without words, as one null word of weight 0
    placed = rows.select(*keys, words.alias("words")).select(*keys, "words", F.posexplode_outer("words").alias("place_", "word"))
    following = F.get(F.col("words"), F.col("place_") + 1)
    weight = F.coalesce(F.char_length("word"), F.lit(0)) + F.coalesce(F.char_length(following), F.lit(0))
    terms = placed.select(*keys, weight.cast("long").alias("weight"), F.xxhash64("word", following).alias("h0"))
    for w in _WORDS[1:]:
        terms = terms.withColumn(f"h{w}", F.xxhash64(f"h{w - 1}"))
    votes = [F.sum(F.shiftrightunsigned(f"h{w}", i).bitwiseAND(F.lit(_LANES)) * F.col("weight")).alias(f"v{w}_{i}")
             for w in _WORDS for i in range(32)]
    summed = terms.groupBy(*keys).agg(F.sum("weight").alias("total"), *votes)

    def bit(vote: Column, place: int) -> Column:
        return F.shiftleft(F.when(vote * 2 > F.col("total"), F.lit(1)).otherwise(F.lit(0)).cast("long"), place)

    return summed.select(*keys, *[_or(
        [bit(F.col(f"v{w}_{i}").bitwiseAND(F.lit(_LOW)), i) for i in range(32)]
        + [bit(F.shiftrightunsigned(f"v{w}_{i}", 32), i + 32) for i in range(32)]).alias(f"f{w}") for w in _WORDS])


def as_text(prefix: str = "") -> Column:
    """A fingerprint as lowercase hex."""
    return F.lower(F.concat(*[F.lpad(F.hex(prefix + f), 16, "0") for f in FINGERPRINT]))


def distance(a: list[Column], b: list[Column]) -> Column:
    """Bits in which two fingerprints differ."""
    differ = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)]
    return sum(differ[1:], differ[0])


def likeness(a: str, b: str) -> Column:
    """Share of equal bits of the fingerprints with these prefixes."""
    return 1 - distance([F.col(a + f) for f in FINGERPRINT], [F.col(b + f) for f in FINGERPRINT]).cast("double") / BITS


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, run, place, guest``: the documents by descending id in runs; the row after
    a run's last one (after the very last: the first of all) is in the run as its guest."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text"), F.col("tie")]
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.monotonically_increasing_id().alias("tie"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    table = materialize(ordered.select("id", "text").withColumn("place", F.monotonically_increasing_id()), "simhash-order")
    run = lambda place: F.floor(place / RUN_ROWS)
    # the first row of a partition comes after the last one of the partition before: a row per partition
    part = F.shiftright("place", 33)
    edges = table.groupBy(part.alias("part")).agg(F.min("place").alias("place"), F.max("place").alias("last"))
    before, everything = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("place", F.coalesce(F.lag("last").over(before), F.last("last").over(everything)).alias("previous"))
    joined = table.join(F.broadcast(edges), "place", "left")
    previous = F.coalesce("previous", F.when(F.col("place") % RUN_ROWS == 0, F.col("place") - 1))
    own = F.struct(run(F.col("place")).alias("run"), F.lit(False).alias("guest"))
    guest = F.struct(run(previous).alias("run"), F.lit(True).alias("guest"))
    both = F.when(previous.isNull(), F.array(own)).otherwise(F.array(own, guest))
    return joined.select("id", "text", "place", F.inline(both))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, edited_sha256, f*, e_f*, n_f*`` per document: the fingerprints of its text, of its edited
    text (the last third is the beginning of the next document) and of the next document's text."""
    rows = in_order(docs, id_col, text_col).repartition("run")
    in_run = Window.partitionBy("run").orderBy("guest", "place")
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    changed = F.concat(F.left("text", n - third), F.left(F.lead("text").over(in_run), third))
    rows = rows.withColumn("edited", changed)
    texts = F.when(F.col("guest"), F.array("text")).otherwise(F.array("text", "edited"))
    kinds = rows.select("run", "guest", "place", "id", n.alias("n_chars"), F.unhex(F.sha2(F.col("edited").cast("binary"), 256))
                        .alias("digest"), F.posexplode(texts).alias("kind", "text"))
    keys = ["run", "guest", "place", "id", "n_chars", "digest"]
    marked = fingerprints(kinds, [*keys, "kind"])
    of_kind = lambda f, k: F.max(F.when(F.col("kind") == k, F.col(f)))
    marked = marked.groupBy(*keys).agg(*[of_kind(f, 0).alias(f) for f in FINGERPRINT],
                                       *[of_kind(f, 1).alias(f"e_{f}") for f in FINGERPRINT])
    following = marked.select("*", *[F.lead(f).over(in_run).alias(f"n_{f}") for f in FINGERPRINT])
    return following.where(~F.col("guest")).select(
        "id", F.col("n_chars").cast("long").alias("n_chars"), F.lower(F.hex("digest")).alias("edited_sha256"),
        *[p + f for p in ("", "e_", "n_") for f in FINGERPRINT])


def near(marked: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``f*, copies, n_near`` per different fingerprint of ``marked(f*)``: the rows that have it, and those
    with another one at most ``radius`` bits away."""
    size, per_word = BITS // blocks, 64 * blocks // BITS
    if size > 64 or 64 % size or not 0 <= radius < blocks:
        raise ValueError("blocks must divide the words of a fingerprint evenly, and exceed the radius")
    classes = materialize(marked.groupBy(*FINGERPRINT).agg(F.count(F.lit(1)).alias("copies")), "simhash-classes")
    mask = F.lit((1 << size) - 1 if size < 64 else -1).cast("long")
    block = lambda f, b: F.shiftrightunsigned(f[b // per_word], b % per_word * size).bitwiseAND(mask)
    own = [F.col(f) for f in FINGERPRINT]
    choices = list(combinations(range(blocks), blocks - radius))
    tables = classes.select("*", F.inline(F.array(*[
        F.struct(F.lit(sum(1 << b for b in c)).alias("table"), F.lit((2 << c[-1]) - 1).alias("upto"), *[block(own, b).alias(f"k{i}") for i, b in enumerate(c)])
        for c in choices])))
    key = ["table", *[f"k{i}" for i in range(blocks - radius)]]
    shared = tables.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    rows = materialize(tables.join(shared, key), "simhash-tables")
    salt = F.pmod(F.xxhash64(*FINGERPRINT), F.ceil(F.col("members") / ARRAY_ROWS))
    arrays = rows.withColumn("salt", salt).groupBy(*key, "salt").agg(
        F.collect_list(F.struct(*FINGERPRINT, "copies")).alias("others")).drop("salt")

    def counts(other: Column) -> Column:
        theirs = [other[f] for f in FINGERPRINT]
        differ = distance(own, theirs)
        # equal blocks; the pair counts in the table that has the first of them
        equal = [F.when(block(own, b) == block(theirs, b), F.lit(1 << b)).otherwise(F.lit(0)) for b in range(blocks)]
        equal = sum(equal[1:], equal[0])
        first = F.col("table") == equal.bitwiseAND(F.col("upto"))
        return F.when((differ > 0) & (differ <= radius) & first, other["copies"]).otherwise(F.lit(0)).cast("long")

    found = rows.join(arrays, key).select(*FINGERPRINT, F.aggregate(
        "others", F.lit(0).cast("long"), lambda total, other: total + counts(other)).alias("found"))
    found = found.groupBy(*FINGERPRINT).agg(F.sum("found").alias("n_near"))
    return classes.join(found, FINGERPRINT, "left").select(
        *FINGERPRINT, "copies", F.coalesce("n_near", F.lit(0)).alias("n_near"))
