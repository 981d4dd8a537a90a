r"""Secret scan (DataFrame functions only): three base patterns plus a randomness test battery.

Base spans, leftmost and non-overlapping per kind, positions in code points:
``assign`` (a credential name, ``:`` or ``=``, a value of 6+ characters), ``access``
(``AKIA`` key ids of 20+ characters) and ``hex`` (24+ lower-case hex digits).

The battery adds ``random`` spans.  A candidate is a run of 20+ characters of
``[A-Za-z0-9+/_-]`` (with up to two ``=``) that mixes digits and letters.  Its
encoding is the narrowest of hex, base32, one-case alphanumeric and base64 that holds it.  A string
of one case with ``-``, ``_``, ``+`` or ``/`` (a dashed key, a prefixed token) is tested without them, if
20 characters are left, in strata of their own.
Against "drawn uniformly from that alphabet" three tests give a p-value each:
chi-squared over equal cells of the alphabet (Wilson-Hilferty), Wald-Wolfowitz
runs above and below the alphabet's middle, and lag-one serial correlation.
Fisher's method combines them.  Keys and tokens have p-values spread evenly,
words, paths and numbered names pile up near zero.

Length-aware false-discovery control: per stratum (encoding, length class) the distinct
candidates with p > 1/2 estimate how many are random; the estimated share of the
others among those with p > t must be at most ``FDR``, and t is the smallest
cut on a grid that reaches it, whether or not a candidate lies between it and the next.  Short strings,
which the tests hardly tell apart, so get a cut of their own.  Where fewer than ``SPARSE`` candidates
have p > 1/2, that estimate is too uncertain: t is at least ``FLOOR`` (more for short
strings), and the smallest cut from there on at which the upper limit of the estimate (a Poisson count's,
about 97.5 %) reaches ``FDR``.  So a single key is tested by itself, at every size of the corpus,
and a sparse stratum full of other strings still raises its cut.  Copies of a string count once.
The strata are bounded (encodings x length classes x grid).

Defined results: null and empty texts have no spans; rows that repeat (id, text)
share one result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

# The base patterns; a kind's place in the list breaks ties of start.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE)))
# Narrowest first: name, pattern, alphabet.
DIGITS, UPPERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", UPPERS + "234567"),
    ("lower36", "^[a-z0-9]+$", DIGITS + UPPERS.lower()),
    ("upper36", "^[A-Z0-9]+$", DIGITS + UPPERS),
    ("base64", "^(?=.*[a-z])(?=.*[A-Z]).+$", UPPERS + UPPERS.lower() + DIGITS + "+/"),
)
LEAST_CHARACTERS = 20
FDR = 0.05
GRID = 20  # cuts at 0, 1/GRID, 2/GRID, ...
SPARSE = 200  # random candidates in the upper half that an estimate needs
# Smallest cut of a sparse stratum, in steps of the grid: of length classes below LONG (32 characters), and of others.
LONG, FLOOR = 10, (2, 1)


def _matches(rows: DataFrame, kind: str) -> DataFrame:
    """``row, kind, start, end, token`` of every match: the text between matches gives the places."""
    pattern = F.lit(PATTERNS[kind])
    found = (rows.where(F.col("text").rlike(PATTERNS[kind]))
             .select("row", F.split("text", PATTERNS[kind], -1).alias("gaps"),
                     F.regexp_extract_all("text", pattern, F.lit(0)).alias("tokens"))
             .select("row", F.transform("gaps", lambda g: F.char_length(g)).alias("gaps"), "tokens")
             .select("row", F.posexplode(F.arrays_zip("gaps", "tokens"))))
    found = found.dropDuplicates(["row", "pos"])  # rows that repeat
    token = F.col("col.tokens")
    so_far = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("col.gaps") + F.coalesce(F.char_length(token), F.lit(0))).over(so_far)
    found = found.select("row", F.lit(KINDS.index(kind)).alias("kind"), (end - F.char_length(token)).alias("start"),
                         end.alias("end"), token.alias("token")).where(F.col("token").isNotNull())
    if kind == "assign":
        found = found.where(F.char_length(F.regexp_replace("token", ASSIGN_VALUE, "")) >= 6)
    return found


def _normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(candidates: DataFrame) -> DataFrame:
    """Adds ``encoding``, ``n`` and ``p`` to ``candidates(token, ...)``; drops tokens of no encoding."""
    mixed = F.col("token").rlike("[0-9]") & F.col("token").rlike("[A-Za-z]")

    def chosen(text: Column, mark: str, body: Column) -> Column:
        found = F.lit(None).cast("struct<name:string,alphabet:string,body:string>")
        for name, pattern, alphabet in reversed(ENCODINGS):
            found = F.when(text.rlike(pattern), F.struct(F.lit(name + mark).alias("name"), F.lit(alphabet).alias("alphabet"),
                                                         body.alias("body"))).otherwise(found)
        return found

    trimmed = F.rtrim(F.col("token"), F.lit("="))
    whole = chosen(F.col("token"), "", F.translate(trimmed, "-_", "+/"))
    # one-case strings with separators: what is between them, in strata of their own
    joined = F.translate(trimmed, "-_+/", "")
    split = F.when(F.char_length(joined) >= LEAST_CHARACTERS, chosen(joined, " in parts", joined))
    body = F.col("enc.body")
    c = (candidates.withColumn("enc", F.when(mixed, F.coalesce(whole, split))).where("enc is not null")
         .withColumn("encoding", F.col("enc.name"))
         .withColumn("x", F.transform(F.split(body, ""), lambda ch: F.instr(F.col("enc.alphabet"), ch) - 1))
         .withColumn("size", F.length("enc.alphabet")).withColumn("n", F.size("x")))
    add = lambda values, f: F.aggregate(values, F.lit(0.0), lambda acc, v: acc + f(v))
    # chi-squared over equal cells, wide enough to expect 3 in each
    c = c.withColumn("cells", F.when(F.col("n") < 27, 4).when(F.col("size") == 36, 9).otherwise(8))
    per_cell = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda k: F.size(F.filter(
        "x", lambda v: F.floor(v * F.col("cells") / F.col("size")) == k)))
    expected, df = F.col("n") / F.col("cells"), F.col("cells") - 1
    c = c.withColumn("chi2", add(per_cell, lambda o: (o - expected) * (o - expected) / expected))
    var = 2 / (9 * df)
    p_chi = _normal_tail((F.pow(F.col("chi2") / df, F.lit(1 / 3)) - (1 - var)) / F.sqrt(var))
    # runs of symbols below and above the alphabet's middle
    c = c.withColumn("high", F.transform("x", lambda v: F.when(v * 2 >= F.col("size"), 1).otherwise(0)))
    following = F.zip_with(F.slice("high", 1, F.col("n") - 1), F.slice("high", 2, F.col("n") - 1),
                           lambda a, b: F.when(a != b, 1).otherwise(0))
    c = (c.withColumn("runs", 1 + add(following, lambda v: v)).withColumn("n1", add(F.col("high"), lambda v: v))
         .withColumn("n2", F.col("n") - F.col("n1")))
    mean = 2 * F.col("n1") * F.col("n2") / F.col("n") + 1
    spread = (mean - 1) * (mean - 2) / (F.col("n") - 1)
    p_runs = F.when(spread > 0, 2 * _normal_tail(F.abs(F.col("runs") - mean) / F.sqrt(spread))).otherwise(0.0)
    # lag-one serial correlation
    c = c.withColumn("mean", add(F.col("x"), lambda v: v) / F.col("n"))
    c = c.withColumn("dev", F.transform("x", lambda v: v - F.col("mean")))
    products = F.zip_with(F.slice("dev", 1, F.col("n") - 1), F.slice("dev", 2, F.col("n") - 1), lambda a, b: a * b)
    squares = add(F.col("dev"), lambda v: v * v)
    serial = (add(products, lambda v: v) / squares + 1 / F.col("n")) * F.sqrt(F.col("n"))
    p_serial = F.when(squares > 0, 2 * _normal_tail(F.abs(serial))).otherwise(0.0)
    # Fisher: -2 sum ln p is chi-squared with 6 degrees of freedom, whose tail is a closed form
    half = -sum((F.log(F.greatest(p, F.lit(1e-12))) for p in (p_chi, p_runs, p_serial)), F.lit(0.0))
    return (c.withColumn("half", half)
            .withColumn("p", F.exp(-F.col("half")) * (1 + F.col("half") + F.col("half") * F.col("half") / 2))
            .drop("enc", "x", "size", "cells", "chi2", "high", "runs", "n1", "n2", "mean", "dev", "half"))


def cuts(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """``encoding, length_class, cut`` of ``tested(encoding, length_class, string, p)``: the smallest grid cut
    per stratum whose estimated share of strings that are not random is at most ``fdr``; strata without one
    are absent.  Rows of equal ``string`` (a hash) count once."""
    step = F.least(F.floor(F.col("p") * GRID), F.lit(GRID - 1))
    strings = tested.select("encoding", "length_class", "string", step.alias("bin")).distinct()
    above = F.array(*(F.count(F.when(F.col("bin") >= k, 1)) for k in range(GRID)))
    tried = (strings.groupBy("encoding", "length_class").agg(above.alias("counts"))
             .withColumn("upper", F.col("counts")[GRID // 2])
             .select("*", F.posexplode("counts").alias("bin", "above")).where("above > 0"))
    sparse = F.col("upper") < SPARSE
    floor = F.when(F.col("length_class") < LONG, FLOOR[0]).otherwise(FLOOR[1])
    random = F.when(sparse, 2 * F.pow(F.sqrt(F.col("upper") + 1.0) + 1, F.lit(2))).otherwise(
        F.least(2 * F.col("upper"), F.col("counts")[0]))
    wrong = F.greatest(F.lit(0.0), F.col("above") - random * (1 - F.col("bin") / GRID))
    return (tried.where((wrong / F.col("above") <= fdr) & (~sparse | (F.col("bin") >= floor)))
            .groupBy("encoding", "length_class").agg((F.min("bin") / GRID).alias("cut")))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """``row(id, h), kind, start, end`` of every span; ``kind`` is a place in KINDS."""
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("row"),
                       F.col(text_col).alias("text"))
    found = None
    for kind in KINDS:
        part = _matches(rows, kind)
        found = part if found is None else found.unionByName(part)
    found = materialize(found.distinct(), "secret-matches")
    base = found.where(F.col("kind") < KINDS.index("random")).select("row", "kind", "start", "end")
    tested = battery(found.where(F.col("kind") == KINDS.index("random"))) \
        .withColumn("length_class", F.floor(2 * F.log2("n")))
    tested = materialize(tested.select("row", "kind", "start", "end", "encoding", "length_class",
                                       F.xxhash64("token").alias("string"), "p"), "secret-battery")
    added = tested.join(F.broadcast(cuts(tested, fdr)), ["encoding", "length_class"]).where("p >= cut") \
                  .select("row", "kind", "start", "end")
    return base.unionByName(added)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """``id, n_assign, n_access, n_hex, n_random, base_sha256, spans`` per row."""
    spans = secret_spans(docs, id_col, text_col, fdr)
    per_row = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end"))).alias("found"))
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("row"))
    found = F.coalesce(F.col("found"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    base = F.filter(found, lambda s: s["kind"] < KINDS.index("random"))
    names = F.array(*map(F.lit, KINDS))
    # A candidate inside a base span says nothing new.
    new = F.filter(found, lambda s: (s["kind"] < KINDS.index("random")) | ~F.exists(
        base, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return rows.join(per_row, "row", "left").select(
        F.col("row.id").alias("id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(new).alias("spans"))
