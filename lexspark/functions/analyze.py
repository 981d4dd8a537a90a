"""The analyzer: one tokenizer for documents and queries.

A token is, at each position after white space is skipped:
  * a maximal run of numerals (Unicode categories Nd, Nl, No), else
  * a letter (Unicode Alphabetic) followed by letters and numerals, else
  * any single other non-white-space character (punctuation and symbols are terms).
Only ASCII letters are lower-cased.  Words may then be stemmed (see ``stem``).

Everything here is a built-in Spark column expression (JVM regex, codegen),
so tokenizing never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---------------------------------------------------------------------------
# Fixed values (they define the token boundaries and must stay as they are).
# Unicode White_Space code points: U+0009..U+000D, U+0020, U+0085, U+00A0,
# U+1680, U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WHITE_SPACE_CLASS = (r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                     r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
NUMBER_PATTERN = r"\p{N}+"
WORD_PATTERN = r"\p{IsAlphabetic}[\p{IsAlphabetic}\p{N}]*"
SYMBOL_PATTERN = r"[^" + WHITE_SPACE_CLASS + r"]"
TOKEN_PATTERN = NUMBER_PATTERN + "|" + WORD_PATTERN + "|" + SYMBOL_PATTERN
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
# ---------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_ascii(text: Column | str) -> Column:
    """Lower-case ASCII letters only (``É`` stays ``É``); not ``lower()``."""
    return F.translate(_col(text), ASCII_UPPER, ASCII_LOWER)


def _fold_token(token: Column) -> Column:
    """``fold_ascii`` of one token: one of ASCII letters alone is lower-cased byte by byte, which is much cheaper."""
    return F.when(F.octet_length(token) == F.char_length(token), F.lower(token)).otherwise(fold_ascii(token))


def token_array(text: Column | str) -> Column:
    """ARRAY<STRING> of case-folded tokens in text order; NULL text gives [].  Folding an ASCII letter moves no
    token boundary, so the tokens are folded, not the text."""
    return F.transform(raw_token_array(text), _fold_token)


def raw_token_array(text: Column | str) -> Column:
    """Tokens before case folding (for inspection)."""
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))


def token_kind(token: Column | str) -> Column:
    """'number', 'word' or 'symbol', decided by the first character."""
    t = _col(token)
    return (F.when(t.rlike(r"^\p{N}"), F.lit("number"))
            .when(t.rlike(r"^\p{IsAlphabetic}"), F.lit("word"))
            .otherwise(F.lit("symbol")))


def is_word(token: Column | str) -> Column:
    return _col(token).rlike(r"^\p{IsAlphabetic}")


def term_counts(df, tokens: str, out: str = "term_counts"):
    """Add ``out`` = ARRAY<STRUCT<term STRING, freq BIGINT>>: the distinct tokens of
    each row with their counts, computed inside the row (sort + run lengths), so
    per-document term frequencies need no shuffle.
    """
    s = f"__{out}_sorted"
    starts = f"__{out}_starts"
    df = df.withColumn(s, F.sort_array(F.col(tokens)))
    # 0-based positions where a new run of equal tokens starts.
    df = df.withColumn(starts, F.filter(
        F.transform(F.col(s), lambda t, i: F.when((i == 0) | (t != F.get(F.col(s), i - 1)), i)), lambda i: i.isNotNull()))
    df = df.withColumn(
        out,
        F.transform(
            F.col(starts),
            lambda p, j: F.struct(
                F.get(F.col(s), p).alias("term"),
                (F.coalesce(F.get(F.col(starts), j + 1), F.size(F.col(s))) - p).cast("bigint").alias("freq"))))
    return df.drop(s, starts)


def explode_rows(df, array_col: str, alias: str = "p", position: str | None = None):
    """Explode ``array_col`` into rows, dropping rows of empty arrays.

    Uses the *outer* generator plus a null filter after it: for a plain
    ``explode`` the optimizer infers a ``size(array) > 0`` filter below the
    generator and inlines the whole array expression into it, which evaluates
    the tokenizer twice (and, with lambdas, once per element).
    """
    others = [c for c in df.columns if c != array_col]
    if position:
        out = df.select(*others, F.posexplode_outer(array_col).alias(position, alias))
    else:
        out = df.select(*others, F.explode_outer(array_col).alias(alias))
    return out.where(F.col(alias).isNotNull())

