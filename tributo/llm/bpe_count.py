"""Token counts of a word-level byte-pair vocabulary, by heap-and-linked-list merging."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, texts

#: Words whose counts a worker remembers before it starts over.
CACHE_WORDS = 400_000

# Code points that the library's tables take otherwise than Python's and regex's do. Letters of a later
# Unicode version with their lower case, and unassigned points that aren't letters.
LATER_LOWER = {0xA7CB: 0x0264, 0xA7DC: 0x019B}
NO_LETTERS = (0x32808, 0x3285C, 0x32988, 0x3D808, 0x3D85C, 0x3D988, 0x3E808, 0x3E85C, 0x3E988, 0x3F808, 0x3F85C, 0x3F988)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Tokens left of a word: its symbols less the merges done.

    A heap has the adjacent pairs by rank, then place; links join what is left. A popped pair that no longer stands
    where it was pushed is skipped.
    """
    n = len(symbols)
    if n < 2:
        return n
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        symbols[i], symbols[j] = left + right, ""
        merges += 1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get((symbols[i], symbols[after[j]]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[after[j]]))
        if (p := before[i]) >= 0 and (r := ranks.get((symbols[p], symbols[i]))) is not None:
            heapq.heappush(heap, (r, p, symbols[p], symbols[i]))
    return n - merges


class Counter:
    """Counts as the library of the vocabulary file does: special strings, NFC, white space, lower case, words, merges."""

    def __init__(self, spec: str):
        import regex

        loaded = json.loads(spec)
        model = loaded["model"]
        if model["type"] != "BPE" or model.get("unk_token") is not None or model.get("byte_fallback"):
            raise ValueError("a byte-level BPE vocabulary without unknown token is needed")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.vocab = model["vocab"]
        self.letters = byte_letters()
        self.special = [t["content"] for t in loaded["added_tokens"] if t["special"]]
        normal = loaded["normalizer"]
        if [n["type"] for n in normal.get("normalizers", [normal])] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("texts are normalised by NFC, white space and lower case; the file asks for something else")
        split = [p for p in loaded["pre_tokenizer"].get("pretokenizers", [loaded["pre_tokenizer"]]) if p["type"] == "Split"]
        if len(split) != 1:
            raise ValueError("one pattern that splits texts into words is needed")
        self.words = regex.compile(split[0]["pattern"]["Regex"])
        self.odd = regex.compile("[" + "".join(map(chr, (*LATER_LOWER, *NO_LETTERS))) + "]")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, int] = {}

    def merged(self, word: str) -> int:
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.suffix
        return count_merged([s for s in symbols if s in self.vocab], self.ranks)

    def word(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            found = self.merged(word)
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = found
        return found

    def piece(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # Character by character, as the library lower-cases; a whole string would turn a final sigma.
        text = text.lower() if text.isascii() or "Σ" not in text else "".join(c.lower() for c in text)
        if not text.isascii() and self.odd.search(text):
            # What isn't a letter is split as private characters are that the text doesn't have, then put back.
            text = text.translate(LATER_LOWER)
            spare = list(islice((c for c in chain(range(0xE000, 0xF900), range(0xF0000, 0xFFFFE)) if chr(c) not in text), len(NO_LETTERS)))
            back = dict(zip(spare, NO_LETTERS, strict=True))
            return sum(self.merged(w.translate(back)) for w in self.words.findall(text.translate(dict(zip(NO_LETTERS, spare, strict=True)))))
        known, total = self.known, 0
        for w in self.words.findall(text):
            n = known.get(w)
            total += self.word(w) if n is None else n
        return total

    def count(self, text: str) -> int:
        if self.cut is not None and any(s in text for s in self.special):
            parts = self.cut.split(text)
            return sum(map(self.piece, parts)) + len(parts) - 1
        return self.piece(text)


@lru_cache(maxsize=2)
def _counter(spec: str) -> Counter:
    return Counter(spec)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every whole text; one row for each row of docs.

    vocabulary is the path of the vocabulary file on the driver; its content, of fixed size, goes to the executors.
    A null or empty text has 0 bytes and tokens. Repeated rows are counted each, a null doc_id stays null, other columns
    are left out; a very long text is counted word by word, whole.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value)
        for batch in batches:
            rows = batch.column("text").to_pylist()
            tokens = [counter.count(t) for t in rows]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array([len(t.encode()) for t in rows], pa.int64()),
                    "n_tokens": pa.array(tokens, pa.int64()),
                    "over_limit": pa.array([n > limit for n in tokens], pa.bool_()),
                }
            )

    return map_arrow(texts(docs), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
