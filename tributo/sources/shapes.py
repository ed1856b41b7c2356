"""Documents of one shape differ in texts and attribute values alone, so each is read by where the first one's values stood.

A document is cut into its markup and its values. For a markup that comes again, marks are put in the values' places and that
document is read in full, once: every mark in what was found says which value belongs there. Where a value decides what is
looked up, as a model code does, the places are kept for that value. Whatever can't be cut safely is read in full.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable
from itertools import accumulate
from operator import itemgetter

#: Texts that hold more than white space, and attribute values that do; what stays between them is markup.
_TEXT = re.compile(r">(\s*[^<\s][^<]*)<")
_VALUE = re.compile(r"""=\s*("\s*[^"<\s\0][^"<\0]*"|'\s*[^'<\s\0][^'<\0]*')""")
#: Bytes that XML refuses, rewrites or reads as references, and characters that it refuses or that marks are made of.
_AWKWARD = bytes(b for b in range(32) if b not in b"\t\n") + b"&"
_RARE = re.compile("[\ue000\ue001\ufffe\uffff]")
_MARK = re.compile("\ue000([0-9]+)\ue001")
_DECLARED = re.compile(r"\ufeff?<\?xml\s[^>]*\?>")
_ENCODING = re.compile(r"""encoding\s*=\s*["']([^"']*)""")
_OTHER = re.compile("[<\0][!?]")
_SPACE_NAME = re.compile(r"\sxmlns(:[^\s=]*)?\s*$")
#: Bounds of what a cache keeps: places, characters of markup, hashes of markup seen once.
KEPT, KEPT_CHARS, SEEN = 2_000, 16_000_000, 200_000

Pick = Callable[[list], tuple]


def cut(content: bytes) -> tuple[str, list[str]] | None:
    """The markup, with a mark for each value, and the values: texts in order, then attributes. None where that isn't safe."""
    if len(content.translate(None, _AWKWARD)) < len(content):
        return None
    try:
        text = content.decode()
    except UnicodeDecodeError:
        return None
    if "]]>" in text or not text.isascii() and _RARE.search(text):
        return None
    parts = _TEXT.split(text)
    values, markup = parts[1::2], "\0".join(parts[::2])
    if "=" in markup:
        parts = _VALUE.split(markup)
        for v in parts[1::2]:
            if "\n" in v or "\t" in v:
                return None
            values.append(v[1:-1])
        markup = "\1".join(parts[::2])
    return markup, values


def _picker(places: list[int]) -> Pick:
    if len(places) > 1:
        return itemgetter(*places)
    return (lambda values: (values[places[0]],)) if places else lambda values: ()


class Rows:
    """Where lists of rows come from: the lists' ends, and for each column the places of its values."""

    def __init__(self, lists: list[list[dict]], place: Callable[[str | None], int]):
        rows = [row for each in lists for row in each]
        self.n, self.ends = len(rows), list(accumulate(map(len, lists)))
        below = {c for row in rows[:1] for c, v in row.items() if isinstance(v, list)}
        self.columns = {c: _picker([place(row[c]) for row in rows]) for c in (rows[0] if rows else ()) if c not in below}
        self.nested = {c: Rows([row[c] for row in rows], place) for c in below}


class Places:
    """Where each part of what was found in a document with marks comes from."""

    def __init__(self, doc: dict, n: int):
        #: What follows the n values of a document: None, what is the same in all, and what is put together from values.
        self.same: list[str | None] = [None]
        joined: list[list[str | int]] = []

        def place(v: str | None) -> int:
            if v is None:
                return n
            if whole := _MARK.fullmatch(v):
                return int(whole[1])
            if _MARK.search(v):
                joined.append([int(p) if i % 2 else p for i, p in enumerate(_MARK.split(v))])
                return -len(joined)
            self.same.append(v)
            return n + len(self.same) - 1

        def pairs(row: dict[str, str | None]) -> tuple[list[str], Pick]:
            held = {name: place(v) for name, v in row.items() if v is not None}
            return list(held), _picker(list(held.values()))

        self.kind = doc["kind"]
        self.maps = {c: pairs(doc[c]) for c in ("fields", "extras")}
        self.lists = {c: Rows([doc[c]], place) for c in ("items", "payments")}
        self.joined = joined[::-1]

    def values(self, values: list[str]) -> list[str | None]:
        """What the pickers pick from."""
        values = [v.strip() for v in values]
        return [*values, *self.same, *["".join([values[p] if isinstance(p, int) else p for p in parts]) for parts in self.joined]]


class _Shape:
    """A markup: which of its values decide what is looked up, and the places by them."""

    def __init__(self, markup: str, values: list[str], deciding: Callable[[ET.Element], bool]):
        self.markup, self.n = markup, len(values)
        self.texts = markup.count("\0")
        self.places: dict[tuple[str, ...], Places | None] = {}
        pieces = markup.split("\1")
        declared = markup.startswith(("<?", "\ufeff<?"))
        #: Names of name spaces and what a declaration says.
        self.watched = [self.texts + i for i, piece in enumerate(pieces[:-1]) if _SPACE_NAME.search(piece) or declared and not any("?>" in p for p in pieces[: i + 1])]
        #: Neither comments, sections nor instructions, which cut texts in pieces; a text ends with the "<" of what follows.
        self.readable = len(_OTHER.findall(markup)) == declared and not _RARE.search(markup)
        if self.readable:
            try:
                root = ET.fromstring(self.marked(values))
            except (ET.ParseError, ValueError, LookupError):
                self.readable = False
            else:
                self.watched += sorted({int(i) for e in root.iter() if deciding(e) for i in _MARK.findall(e.text or "")})
        self.deciding = _picker(self.watched)

    def marked(self, values: list[str]) -> bytes:
        """The document with marks for all values but those watched."""
        told = set(self.watched)
        shown = [v if i in told else f"\ue000{i}\ue001" for i, v in enumerate(values)]
        quoted = [f"={q}{v}{q}" for v in shown[self.texts :] for q in ("'" if '"' in v else '"',)]
        texts, attributes = iter(shown), iter(quoted)
        return re.sub("[\0\1]", lambda m: f">{next(texts)}<" if m[0] == "\0" else next(attributes), self.markup).encode()

    def read(self, values: list[str], read: Callable[[bytes], dict]) -> Places | None:
        content = self.marked(values)
        declared = _DECLARED.match(content.decode())
        if declared and (encoding := _ENCODING.search(declared[0])) and encoding[1].lower() != "utf-8":
            return None
        doc = read(content)
        return Places(doc, self.n) if doc["error"] is None else None


class Shapes:
    """The shapes that came before, of documents that ``read`` reads; deciding tells elements whose text does more than being found."""

    def __init__(self, read: Callable[[bytes], dict], deciding: Callable[[ET.Element], bool]):
        self.read, self.deciding = read, deciding
        self.shapes: dict[str, _Shape] = {}
        self.seen: set[int] = set()
        self.kept = self.chars = 0

    def find(self, content: bytes) -> tuple[Places, list[str | None]] | None:
        """Places for a document, and what they pick from; None where it is to be read in full, as the first of a shape is."""
        if (got := cut(content)) is None:
            return None
        markup, values = got
        if (shape := self.shapes.get(markup)) is None:
            if (key := hash(markup)) not in self.seen:
                if len(self.seen) >= SEEN:
                    self.seen.clear()
                self.seen.add(key)
                return None
            self._room(len(markup))
            shape = self.shapes[markup] = _Shape(markup, values, self.deciding)
        if not shape.readable:
            return None
        told = shape.deciding(values)
        if told not in shape.places:
            self._room(len(markup))
            shape.places[told] = shape.read(values, self.read)
        places = shape.places[told]
        return None if places is None else (places, places.values(values))

    def _room(self, chars: int) -> None:
        if self.kept >= KEPT or self.chars + chars > KEPT_CHARS:
            self.shapes.clear()
            self.kept = self.chars = 0
        self.kept += 1
        self.chars += chars
