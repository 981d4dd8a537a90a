"""The Porter2 English stemmer as a chain of SQL steps over distinct words, written from the
published description (regions, steps 1a to 5, exception lists); it shares nothing with the engine's.
"""

from __future__ import annotations

# The published suffix and exception lists.
EXCEPTIONS = ("skis ski skies sky dying die lying lie tying tie idly idl gently gentl ugly ugli early earli only onli "
              "singly singl sky sky news news howe howe atlas atlas cosmos cosmos bias bias andes andes").split()
STOP_AFTER_1A = "inning outing canning herring earring proceed exceed succeed".split()
STEP2 = ("tional tion enci ence anci ance abli able entli ent izer ize ization ize ational ate ation ate ator ate alism al "
         "aliti al alli al fulness ful ousli ous ousness ous iveness ive iviti ive biliti ble bli ble fulli ful lessli less").split()
STEP3 = "tional tion ational ate alize al icate ic iciti ic ical ic".split()
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()


def _map(pairs: list[str]) -> str:
    return "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in zip(pairs[::2], pairs[1::2])) + "}"


def _longest(suffixes: list[str]) -> str:
    """The longest of the suffixes that ends ``w`` (a search from the left finds it first), or ''."""
    return f"regexp_extract(w, '({'|'.join(suffixes)})$', 1)"


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_CUT = "left(w, length(w) - length(x))"
_SHORT_END = "(regexp_matches(w, '[^aeiouy][aeiouy][^aeiouywxY]$') OR regexp_matches(w, '^[aeiouy][^aeiouy]$'))"


def stem_ctes(terms: str) -> str:
    """CTEs ending in ``stems(raw, stem)`` for the words of the query ``terms`` (a column ``term``)."""
    return rf"""
    st_words AS MATERIALIZED (SELECT DISTINCT term AS raw FROM ({terms}) WHERE length(term) >= 3 AND regexp_matches(term, '^\p{{L}}')),
    st_marked AS (SELECT raw, regexp_replace(regexp_replace(raw, '^y', 'Y'), '([aeiouy])y', '\1Y', 'g') AS w FROM st_words),
    st_r1 AS (
      SELECT raw, w, CASE WHEN starts_with(w, 'gener') OR starts_with(w, 'arsen') THEN 5 WHEN starts_with(w, 'commun') THEN 6
                          WHEN regexp_matches(w, '[aeiouy][^aeiouy]')
                          THEN length(regexp_extract(w, '^[^aeiouy]*[aeiouy]+[^aeiouy]')) ELSE length(w) END AS r1 FROM st_marked),
    st_regions AS (
      SELECT raw, w, r1, CASE WHEN regexp_matches(substr(w, r1 + 1), '[aeiouy][^aeiouy]')
                              THEN r1 + length(regexp_extract(substr(w, r1 + 1), '^[^aeiouy]*[aeiouy]+[^aeiouy]'))
                              ELSE length(w) END AS r2 FROM st_r1),
    st_1a AS (
      SELECT raw, r1, r2, CASE WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2)
               WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
               WHEN regexp_matches(w, '(us|ss)$') THEN w
               WHEN regexp_matches(w, '[aeiouy].+s$') THEN left(w, length(w) - 1) ELSE w END AS w FROM st_regions),
    st_1b_found AS (SELECT *, {_longest(["eed", "eedly", "ed", "edly", "ing", "ingly"])} AS x FROM st_1a),
    st_1b_cut AS (
      SELECT raw, r1, r2, CASE WHEN x IN ('eed', 'eedly') THEN CASE WHEN length(w) - length(x) >= r1 THEN {_CUT} || 'ee' ELSE w END
                               WHEN x <> '' AND regexp_matches({_CUT}, '[aeiouy]') THEN {_CUT} ELSE w END AS w,
             x NOT IN ('', 'eed', 'eedly') AND regexp_matches({_CUT}, '[aeiouy]') AS cut FROM st_1b_found),
    st_1b AS (
      SELECT raw, r1, r2, CASE WHEN NOT cut THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e'
               WHEN regexp_matches(w, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(w, length(w) - 1)
               WHEN length(w) <= r1 AND {_SHORT_END} THEN w || 'e' ELSE w END AS w FROM st_1b_cut),
    st_1c AS (
      SELECT raw, r1, r2, CASE WHEN regexp_matches(w, '^.+[^aeiouy][yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w
      FROM st_1b),
    st_2_found AS (SELECT *, {_longest([*STEP2[::2], "ogi", "li"])} AS x FROM st_1c),
    st_2 AS (
      SELECT raw, r1, r2, CASE WHEN x = '' OR length(w) - length(x) < r1 THEN w
               WHEN x = 'ogi' THEN CASE WHEN ends_with(w, 'logi') THEN left(w, length(w) - 1) ELSE w END
               WHEN x = 'li' THEN CASE WHEN regexp_matches(w, '[cdeghkmnrt]li$') THEN left(w, length(w) - 2) ELSE w END
               ELSE {_CUT} || {_map(STEP2)}[x] END AS w FROM st_2_found),
    st_3_found AS (SELECT *, {_longest([*STEP3[::2], "ful", "ness", "ative"])} AS x FROM st_2),
    st_3 AS (
      SELECT raw, r1, r2, CASE WHEN x = '' OR length(w) - length(x) < r1 THEN w
               WHEN x IN ('ful', 'ness') THEN {_CUT}
               WHEN x = 'ative' THEN CASE WHEN length(w) - 5 >= r2 THEN {_CUT} ELSE w END
               ELSE {_CUT} || {_map(STEP3)}[x] END AS w FROM st_3_found),
    st_4_found AS (SELECT *, {_longest([*STEP4, "ion"])} AS x FROM st_3),
    st_4 AS (
      SELECT raw, r1, r2, CASE WHEN x = '' OR length(w) - length(x) < r2 THEN w
               WHEN x = 'ion' AND NOT regexp_matches(w, '[st]ion$') THEN w ELSE {_CUT} END AS w FROM st_4_found),
    st_5_short AS (SELECT *, left(w, length(w) - 1) AS y FROM st_4),
    st_5 AS (
      SELECT raw, CASE WHEN ends_with(w, 'e') AND (length(y) >= r2 OR length(y) >= r1 AND NOT {_SHORT_END.replace("(w,", "(y,")}) THEN y
                       WHEN ends_with(w, 'll') AND length(y) >= r2 THEN y ELSE w END AS w FROM st_5_short),
    stems AS MATERIALIZED (
      SELECT f.raw, CASE WHEN f.raw IN ({_quoted(EXCEPTIONS[::2])}) THEN {_map(EXCEPTIONS)}[f.raw]
                         WHEN a.w IN ({_quoted(STOP_AFTER_1A)}) THEN a.w ELSE replace(f.w, 'Y', 'y') END AS stem
      FROM st_5 f JOIN st_1a a ON a.raw = f.raw)"""
