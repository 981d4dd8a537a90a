"""English stemmer (the published Porter2 / Snowball English algorithm).

``stem(word)`` is a pure function on one lower-cased word.  In Spark it is
applied once per *distinct* word of a corpus (see ``operators.stemming``), never
once per token occurrence.  Vowels are the ASCII letters ``aeiouy``; every other
character, including non-ASCII letters and digits, counts as a non-vowel.
"""

from __future__ import annotations

import re

# ---------------------------------------------------------------------------
# The rule tables of the Snowball English stemmer.
VOWELS = frozenset("aeiouy")
VOWELS_WXY = frozenset("aeiouywxY")
VALID_LI = frozenset("cdeghkmnrt")

# Whole words with a fixed stem (checked before anything else).
EXCEPTION1 = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
# Whole words left alone after step 1a.
EXCEPTION2 = frozenset(["inning", "outing", "canning", "herring", "earring",
                        "proceed", "exceed", "succeed"])
# Prefixes after which region R1 starts.
R1_PREFIXES = ("gener", "commun", "arsen")

STEP1A = {"sses": "ss", "ied": None, "ies": None, "s": None, "us": "us", "ss": "ss"}
STEP1B = ("eed", "eedly", "ed", "edly", "ing", "ingly")
STEP1B_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful",
    "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble",
    "ogi": "og",        # only after l
    "fulli": "ful", "lessli": "less",
    "li": "",           # only after one of VALID_LI
}
STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al",
    "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "",
    "ative": "",        # only in R2
}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
         "ent", "ism", "ate", "iti", "ous", "ive", "ize",
         "ion")         # ion only after s or t
# ---------------------------------------------------------------------------


def _by_last(suffixes) -> dict[str, tuple[str, ...]]:
    """The suffixes by their last character, longest first."""
    ordered = sorted(suffixes, key=len, reverse=True)
    return {c: tuple(s for s in ordered if s[-1] == c) for c in {s[-1] for s in ordered}}


_STEP1A, _STEP1B, _STEP2, _STEP3, _STEP4 = map(_by_last, (STEP1A, STEP1B, STEP2, STEP3, STEP4))
#: The last characters of the words that some step changes.
_ENDINGS = frozenset("'eylY").union(_STEP1A, _STEP1B, _STEP2, _STEP3, _STEP4)
_VOWEL = re.compile(f"[{''.join(sorted(VOWELS))}]")
_TO_CONSONANT = re.compile("[^{0}]*[{0}]+[^{0}]".format("".join(sorted(VOWELS))))  # through the first consonant after a vowel


def _longest_suffix(word: str, by_last: dict[str, tuple[str, ...]]) -> str | None:
    for s in by_last.get(word[-1:], ()):
        if word.endswith(s):
            return s
    return None


def _is_vowel(c: str) -> bool:
    return c in VOWELS


def _has_vowel(w: str, end: int) -> bool:
    """Whether a vowel stands before ``end``."""
    return _VOWEL.search(w, 0, end) is not None


def _short_syllable_before(w: str, end: int) -> bool:
    """Short syllable ending at ``end``: non-vowel (not w, x, Y) after a vowel after a
    non-vowel, or a vowel then a non-vowel at the very start of the word."""
    if end >= 3 and w[end - 1] not in VOWELS_WXY and _is_vowel(w[end - 2]) and not _is_vowel(w[end - 3]):
        return True
    return end == 2 and not _is_vowel(w[1]) and _is_vowel(w[0])


def _regions(w: str) -> tuple[int, int]:
    n = len(w)
    if w.startswith(R1_PREFIXES):
        p1 = len(next(p for p in R1_PREFIXES if w.startswith(p)))
    else:
        found = _TO_CONSONANT.match(w)
        if found is None:
            return n, n
        p1 = found.end()
    found = _TO_CONSONANT.match(w, p1)
    return p1, n if found is None else found.end()


def _step1a(w: str) -> str:
    if "'" in w:
        for apostrophe in ("'s'", "'s", "'"):
            if w.endswith(apostrophe):
                w = w[: -len(apostrophe)]
                break
    suf = _longest_suffix(w, _STEP1A)
    if suf is None:
        return w
    start = len(w) - len(suf)
    if suf == "sses":
        return w[:start] + "ss"
    if suf in ("ied", "ies"):
        return w[:start] + ("i" if start >= 2 else "ie")
    if suf == "s":
        # delete if a vowel occurs before the letter preceding the s
        if start >= 1 and _has_vowel(w, start - 1):
            return w[:start]
    return w


def _step1b(w: str, p1: int) -> str:
    suf = _longest_suffix(w, _STEP1B)
    if suf is None:
        return w
    start = len(w) - len(suf)
    if suf in ("eed", "eedly"):
        return w[:start] + "ee" if start >= p1 else w
    if not _has_vowel(w, start):
        return w
    w = w[:start]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(STEP1B_DOUBLES):
        return w[:-1]
    if len(w) == p1 and _short_syllable_before(w, len(w)):
        return w + "e"
    return w


def _step1c(w: str) -> str:
    if len(w) >= 3 and w[-1] in ("y", "Y") and not _is_vowel(w[-2]):
        return w[:-1] + "i"
    return w


def _step2(w: str, p1: int) -> str:
    suf = _longest_suffix(w, _STEP2)
    if suf is None:
        return w
    start = len(w) - len(suf)
    if start < p1:
        return w
    if suf == "ogi":
        return w[:start] + "og" if start >= 1 and w[start - 1] == "l" else w
    if suf == "li":
        return w[:start] if start >= 1 and w[start - 1] in VALID_LI else w
    return w[:start] + STEP2[suf]


def _step3(w: str, p1: int, p2: int) -> str:
    suf = _longest_suffix(w, _STEP3)
    if suf is None:
        return w
    start = len(w) - len(suf)
    if start < p1:
        return w
    if suf == "ative" and start < p2:
        return w
    return w[:start] + STEP3[suf]


def _step4(w: str, p2: int) -> str:
    suf = _longest_suffix(w, _STEP4)
    if suf is None:
        return w
    start = len(w) - len(suf)
    if start < p2:
        return w
    if suf == "ion":
        return w[:start] if start >= 1 and w[start - 1] in ("s", "t") else w
    return w[:start]


def _step5(w: str, p1: int, p2: int) -> str:
    if w.endswith("e"):
        start = len(w) - 1
        if start >= p2 or (start >= p1 and not _short_syllable_before(w, start)):
            return w[:start]
        return w
    if w.endswith("l"):
        start = len(w) - 1
        if start >= p2 and start >= 1 and w[start - 1] == "l":
            return w[:start]
    return w


def stem(word: str | None) -> str | None:
    """Stem of one lower-cased word."""
    if word is None:
        return None
    if word in EXCEPTION1:
        return EXCEPTION1[word]
    if len(word) < 3:
        return word
    # prelude: drop a leading apostrophe, mark consonant y as Y
    w = word[1:] if word.startswith("'") else word
    if w[-1:] not in _ENDINGS and "Y" not in w:
        return w
    y_found = False
    if "y" in w:
        chars = list(w)
        for i, c in enumerate(chars):
            if c == "y" and (i == 0 or chars[i - 1] in VOWELS):
                chars[i] = "Y"
                y_found = True
        w = "".join(chars)
    p1, p2 = _regions(w)
    w = _step1a(w)
    if w not in EXCEPTION2:
        w = _step1b(w, p1)
        w = _step1c(w)
        w = _step2(w, p1)
        w = _step3(w, p1, p2)
        w = _step4(w, p2)
        w = _step5(w, p1, p2)
    if y_found:
        w = w.replace("Y", "y")
    return w
