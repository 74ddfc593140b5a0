"""Evaluation texts leaking into training text: one pass of an Aho-Corasick automaton over words.

An item's question (and a long answer) is cut into tiles of 7 words, one behind the other. A
shared run of 13 words, wherever it begins, holds one whole tile (13 = 2 * 7 - 1), so the tiles
are all the patterns that are needed: each word of an item stands in the automaton once. Where
a tile matches, the shared run is grown to both sides on the words of the item. An answer too
short for a run is a pattern as a whole, but only counts as a sign beside a leaked question.

The automaton reads words as numbers of a few digits each, so its nodes have few children and a
match that begins at a word's first digit is one of whole words; its place in the sequence of
words gives the offsets in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Letters of the items in one automaton: about 25,000 items, 210 MB in each Python worker. More items make further passes, each over all texts, so that memory stays bounded.
MAX_PATTERN_CHARS = 10_000_000
LEAKS = "doc_id long, item_id long, part string, start_char int, end_char int, n_words int"


#: Digits of word numbers, and what stands for a word that no item has.
DIGITS = [chr(48 + i) for i in range(64)]
UNKNOWN = " "


def words_of(text: str | None) -> list[str]:
    return [w.lower() for w in WORD.findall(text or "")]


class Index:
    """Tiles and short answers of some items as one automaton over word numbers."""

    def __init__(self, items: list[tuple[int, str | None, str | None]], n_words: int):
        self.n_words, self.size = n_words, (n_words + 1) // 2
        self.numbers: dict[str, int] = {}
        #: Word numbers of each part that may leak: (item, part, words).
        self.parts: list[tuple[int, str, list[int]]] = []
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item_id, question, answer in items:
            for part, text in (("question", question), ("answer", answer)):
                own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
                short = part == "answer" and 0 < len(own) < n_words
                if not short and len(own) < n_words:
                    continue
                no = len(self.parts)
                self.parts.append((item_id, "short answer" if short else part, own))
                if short:
                    places.setdefault(tuple(own), []).append((no, 0))
                else:
                    for at in range(0, len(own) - self.size + 1, self.size):
                        places.setdefault(tuple(own[at : at + self.size]), []).append((no, at))
        self.width = 1
        while len(DIGITS) ** self.width <= len(self.numbers):
            self.width += 1
        #: Low digits first: they tell most words apart.
        self.codes = {w: "".join(DIGITS[n // len(DIGITS) ** i % len(DIGITS)] for i in range(self.width)) for w, n in self.numbers.items()}
        code_of = list(self.codes.values())  # numbers start at 1
        self.automaton = ahocorasick.Automaton()
        for tile, where in places.items():
            self.automaton.add_word("".join([code_of[n - 1] for n in tile]), (len(tile), where))
        if places:
            self.automaton.make_automaton()

    def stretches(self, doc: list[str]) -> list[tuple[int, str, int, int]]:
        """(item, part, first word, last word) of all that the document shares with the items."""
        if not len(self.automaton):
            return []
        text = [self.numbers.get(w, 0) for w in doc]
        unknown = UNKNOWN * self.width
        written = "".join([self.codes.get(w, unknown) for w in doc])
        runs: dict[tuple[int, str], list[tuple[int, int]]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        grown: dict[tuple[int, int], int] = {}  # part and offset between text and part -> end of the run there
        for last, (length, where) in self.automaton.iter(written):
            end, over = divmod(last + 1, self.width)
            if over:  # between two words
                continue
            end -= 1
            start = end - length + 1
            for no, at in where:
                item, part, own = self.parts[no]
                if part == "short answer":
                    short.setdefault(item, []).append((start, end))
                    continue
                if end <= grown.get((no, start - at), -1):
                    continue
                held = runs.setdefault((item, part), [])
                a, i = start, at
                while a and i and text[a - 1] == own[i - 1]:
                    a, i = a - 1, i - 1
                z, j = end + 1, at + length
                while z < len(text) and j < len(own) and text[z] == own[j]:
                    z, j = z + 1, j + 1
                grown[no, start - at] = z - 1
                if z - a >= self.n_words:
                    held.append((a, z - 1))
        out = []
        leaked = set()
        for (item, part), held in runs.items():
            open_ = None
            for a, z in sorted(set(held)):
                if open_ and a <= open_[1] + 1:
                    open_[1] = max(open_[1], z)
                else:
                    open_ = [a, z]
                    out.append((item, part, open_))
            if held:
                leaked.add(item)
        out += [(item, "short answer", s) for item, where in short.items() if item in leaked for s in sorted(set(where))]
        return [(item, part, a, z) for item, part, (a, z) in out]


_built: dict[int, Index] = {}


def built(bid: int, items: Broadcast, n_words: int) -> Index:
    """The automaton of a broadcast, built once in each Python worker."""
    if bid not in _built:
        _built.clear()
        _built[bid] = Index(items.value, n_words)
    return _built[bid]


def scanner(bid: int, items: Broadcast, n_words: int):
    """A mapInArrow function from (doc_id, text) to one row per leaked stretch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = built(bid, items, n_words)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                found = list(WORD.finditer(text))
                doc = [m.group().lower() for m in found]
                rows += [(doc_id, item, part, found[a].start(), found[z].end(), z - a + 1) for item, part, a, z in index.stretches(doc)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)],
                names=["doc_id", "item_id", "part", "start_char", "end_char", "n_words"],
            )

    return scan


def leaks(docs: DataFrame, items: DataFrame, n_words: int = 13) -> DataFrame:
    """doc_id, item_id, part, start_char, end_char, n_words of every stretch a document shares with an item.

    docs: doc_id, text; items: item_id, question, answer. part is question or answer for a
    stretch of at least n_words consecutive words (adjoining ones merged), `short answer` for every
    place of a shorter answer in a document that leaks a stretch of the same item. Offsets are
    those of the original text. Null and empty texts and items without enough words match
    nothing; items that share text each match. The items, a parameter of the run, are read in
    portions of MAX_PATTERN_CHARS letters, each of which is sent to the tasks and makes one pass.
    """
    out = None
    portion: list[tuple] = []
    size = 0

    def flush() -> None:
        nonlocal out, portion, size
        sent = docs.sparkSession.sparkContext.broadcast(portion)
        one = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scanner(sent._jbroadcast.id(), sent, n_words), LEAKS)
        out = one if out is None else out.unionByName(one)
        portion, size = [], 0

    for r in items.select("item_id", "question", "answer").toLocalIterator():
        chars = len(r["question"] or "") + len(r["answer"] or "")
        if portion and size + chars > MAX_PATTERN_CHARS:
            flush()
        portion.append((r["item_id"], r["question"], r["answer"]))
        size += chars
    if portion or out is None:
        flush()
    return out
