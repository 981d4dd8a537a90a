"""A small HTML tree for feature extraction: elements in page order, with their texts."""

from __future__ import annotations

import html as entities
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style noscript template svg math iframe object canvas head title select option button "
                    "textarea input audio video noembed noframes xmp".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary "
                  "table tbody td tfoot th thead tr ul caption".split())
#: A start tag of the key closes an open element of the set, unless one of the stop set is in between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "body": ({"head"}, set())}
SCOPE = frozenset("table td th caption button html body article section div li dd".split())
P_CLOSERS = BLOCK - frozenset("html body dd dt li td th tr tbody thead tfoot caption legend summary".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
_UNCLOSED = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}


class Tree:
    """Elements in page order: ``tags``, ``parents``, ``attributes`` (source text), and ``texts``: pairs of
    (element, decoded text) in page order, with (element, None) where a block begins or ends."""

    def __init__(self, source: str):
        self.tags, self.parents, self.attributes = ["html"], [-1], [""]
        self.texts: list[tuple[int, str | None]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack = [0]
        self._open = {"html": [0]}  # places in the stack of each open tag
        tags = self.tags
        at, n = 0, len(source)
        last = source.rfind(">") + 1  # beyond it only comments and declarations are left
        while at < n:
            m = _TAG.search(source, at, last) if at < last else None
            if m and source.startswith("<!--", m.start()) and not m[0].endswith("-->"):
                m = _UNCLOSED.search(source, m.start())
            m = m or _UNCLOSED.search(source, max(at, last))
            begin = m.start() if m else n
            if begin > at:
                text = source[at:begin]
                if not text.isspace() or not self.texts or self.texts[-1][1] is not None:
                    self.texts.append((stack[-1], entities.unescape(text) if "&" in text else text))
            if not m:
                return
            at = m.end()
            tag = None if m.re is _UNCLOSED else m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self._close(stack, tag)
                continue
            if tag in ("html", "body") and tag in tags:
                continue
            if tag in P_CLOSERS:
                self._imply(stack, {"p"}, SCOPE)
            if tag in CLOSES:
                self._imply(stack, *CLOSES[tag])
            element = len(tags)
            tags.append(tag)
            self.parents.append(stack[-1])
            self.attributes.append(m[3])
            if tag in BLOCK:
                self.texts.append((element, None))
            elif tag == "br":
                self.texts.append((stack[-1], " "))
            if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
                continue
            if tag in RAW:
                end = _RAW_END[tag].search(source, at)
                stop = end.start() if end else n
                self.texts.append((element, source[at:stop]))
                at = source.find(">", stop) + 1 if end else n
                if at == 0:
                    return
                continue
            self._open.setdefault(tag, []).append(len(stack))
            stack.append(element)

    def _nearest(self, tags: set | frozenset) -> int:
        """Place in the stack of the innermost open element with one of the tags, 0 if none is open."""
        return max((places[-1] for t in tags if (places := self._open.get(t))), default=0)

    def _imply(self, stack: list[int], closed: set, stops: set | frozenset) -> None:
        i = self._nearest(closed)
        if i and i >= self._nearest(stops):
            self._pop(stack, i)

    def _close(self, stack: list[int], tag: str) -> None:
        places = self._open.get(tag)
        if places and places[-1]:
            self._pop(stack, places[-1])

    def _pop(self, stack: list[int], i: int) -> None:
        gone = [self.tags[e] for e in stack[i:]]
        if any(tag in BLOCK for tag in gone):
            self.texts.append((self.parents[stack[i]], None))
        for tag in gone:
            self._open[tag].pop()
        del stack[i:]


def attribute_words(source: str) -> list[str]:
    """The words of class, id, role and similar attributes, lower-cased, split at case changes too."""
    words = []
    for m in _ATTRIBUTE.finditer(source):
        if m[1].lower() in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
            value = m[2] or m[3] or m[4] or ""
            words += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    return words


def attribute(source: str, name: str) -> str | None:
    for m in _ATTRIBUTE.finditer(source):
        if m[1] == name:
            return m[2] or m[3] or m[4] or ""
    return None
