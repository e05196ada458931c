"""Evaluation passages inside a corpus (problem 8).

The items' words go into one generalised suffix automaton. Every document is
streamed through it once, word by word; at each word the automaton tells the
longest match that ends there, and its state knows the items that hold it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
#: Words of items in one automaton (about 400 bytes each). Larger item sets are cut into blocks of whole items, one pass over the documents each.
BLOCK_WORDS = 200_000
WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS):
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int]] = []
        for item, text in items:
            last = 0
            for w in words_of(text):
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                ends.append((last, item))
        held: list[set[int]] = [set() for _ in self.next]
        for state, item in ends:
            while state > 0 and item not in held[state]:
                held[state].add(item)
                state = self.link[state]
        #: By state: the items that hold the last min_words words of a match there. Those are the items of the
        #: shortest suffix state that is still long enough.
        self.items: list[tuple[int, ...]] = []
        for state in range(len(self.next)):
            top = state
            while top > 0 and self.length[self.link[top]] >= min_words:
                top = self.link[top]
            self.items.append(tuple(sorted(held[top])))

    def _new(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def matches(self, ids: list[int | None], min_words: int) -> Iterator[tuple[int, int, int]]:
        """(state, last word, length) wherever the longest match that ends there has min_words words or more. A word that no item
        has ends every match, so only the runs between such words that are long enough are streamed; each holds one of every
        min_words-th words."""
        follow, link, length = self.next, self.link, self.length
        n, done = len(ids), -1
        for probe in range(min_words - 1, n, min_words):
            if ids[probe] is None or probe < done:
                continue
            start = end = probe
            while start > 0 and ids[start - 1] is not None:
                start -= 1
            while end < n and ids[end] is not None:
                end += 1
            done = end
            if end - start < min_words:
                continue
            state = size = 0
            for at in range(start, end):
                c = ids[at]
                while c not in follow[state] and state:
                    state = link[state]
                    size = length[state]
                if c in follow[state]:
                    state = follow[state][c]
                    size += 1
                    if size >= min_words:
                        yield state, at, size


_SPAN = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32())])


_AUTOMATA: dict[tuple[str, int], Automaton] = {}


def _automaton(bc, min_words: int) -> Automaton:
    """The automaton of a broadcast block (key, items), built once per worker, which keeps the last two."""
    key, block = bc.value
    if (key, min_words) not in _AUTOMATA:
        while len(_AUTOMATA) > 1:
            _AUTOMATA.pop(next(iter(_AUTOMATA)))
        _AUTOMATA[key, min_words] = Automaton(block, min_words)
    return _AUTOMATA[key, min_words]


def _scan(bc, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(bc, min_words)
        number = auto.vocabulary.get
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                open_: dict[int, list[int]] = {}
                for state, at, size in auto.matches(list(map(number, WORDS.findall(text.lower()))), min_words):
                    for item in auto.items[state]:
                        lo, got = at - min_words + 1, open_.get(item)
                        if got and got[1] >= at:  # the same stretch goes on
                            got[1] = at + 1
                        else:
                            if got:
                                out.append((doc, item, *got))
                            open_[item] = [lo, at + 1]
                out += [(doc, item, *got) for item, got in open_.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_SPAN)], schema=_SPAN)

    return run


def blocks_of(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK_WORDS words; an item is never cut. Read row by row, so the driver holds one block."""
    block, size = [], 0
    for r in items.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        n = len(words_of(r.text))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += n
    yield block


def spans(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, start_word, end_word): the stretches of a document, in words, whose every min_words consecutive words stand so
    in the item. Rows without doc_id or text hold nothing. One pass over doc_id and text per block of items, no shuffle."""
    rows = documents.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    out = None
    for block in blocks_of(items):
        shipped = documents.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))  # BLOCK_WORDS words at most
        part = rows.mapInArrow(_scan(shipped, min_words), "doc_id long, item_id long, start_word int, end_word int")
        out = part if out is None else out.unionByName(part)
    return out


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(item_id, doc_id), once for each pair."""
    return spans(documents, items, min_words).select("item_id", "doc_id").distinct()


def clean(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_share: float = 0.5) -> DataFrame:
    """(doc_id, text, n_removed): leaked stretches are cut out of the text; a document of which more than max_share of the words
    leaked gets the text null. Only documents with leaks are returned."""
    hit = spans(documents, items, min_words).groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("cuts"))
    rows = documents.select(F.col("doc_id").cast("long"), "text").join(hit, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                places = [m.span() for m in WORDS.finditer(r["text"])]
                gone = sorted({w for c in r["cuts"] for w in range(c["start_word"], min(c["end_word"], len(places)))})
                if len(gone) > max_share * len(places):
                    out.append((r["doc_id"], None, len(gone)))
                    continue
                kept, at, i = [], 0, 0
                while i < len(gone):
                    j = i
                    while j + 1 < len(gone) and gone[j + 1] == gone[j] + 1:
                        j += 1
                    kept.append(r["text"][at : places[gone[i]][0]])
                    at, i = places[gone[j]][1], j + 1
                out.append((r["doc_id"], "".join(kept) + r["text"][at:], len(gone)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["doc_id", "text", "n_removed"])

    return rows.mapInArrow(run, "doc_id long, text string, n_removed long")
