"""Evaluation passages that stand in training documents.

The corpus is cut into shards, each as large as a task holds at once. A task
turns the words of its shard into numbers, sorts the suffixes that begin with
``min_words`` words of the evaluation vocabulary (any other cannot begin a
match) into a suffix array, and finds every test suffix in it by binary search.
The neighbours of the place found give the longest verbatim match, and the range
of suffixes that share ``min_words`` words gives all documents that hold the
passage. Words are compared without case, punctuation, markup and blanks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
#: Words of a shard's suffix array at most, but for one longer document.
SHARD_WORDS = 2_000_000
#: Characters of evaluation texts that one pass over the corpus carries; more take more passes.
EVAL_CHARS = 32_000_000

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_LINK = re.compile(r"\]\([^()\s]*\)")
_NUMBERED = re.compile(r"(?m)^[ \t>*#/|+-]*\d+[ \t]*[.):|][ \t]")
_INVISIBLE = re.compile("[­​-‍⁠﻿�]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text, without case, punctuation, markup, line prefixes and blanks."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub("]", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    return _WORD.findall(_NUMBERED.sub(" ", text).lower())


#: Words that are compared at a time where a match is followed to its end.
STRIDE = 64


class EvalIndex:
    """The test suffixes of one block of evaluation items: the numbers of all words in one array, and where the suffixes begin in it."""

    def __init__(self, vocabulary: dict[str, int], flat: np.ndarray, begins: np.ndarray, items: list, min_words: int) -> None:
        self.vocabulary, self.flat, self.begins, self.items, self.min_words = vocabulary, flat, begins, items, min_words

    @classmethod
    def build(cls, items: list[tuple[int, str | None]], min_words: int) -> EvalIndex:
        split = [(i, w) for i, t in items if len(w := words(t)) >= min_words]
        vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws in split for w in ws}), start=1)}
        # a 0 stands before and after each item
        flat = np.zeros(1 + sum(len(w) + 1 for _, w in split) + STRIDE, dtype=np.int32)
        begins, owners, at = [np.zeros(0, dtype=np.int64)], [], 1
        for item, ws in split:
            flat[at : at + len(ws)] = [vocabulary[w] for w in ws]
            begins.append(np.arange(at, at + len(ws) - min_words + 1))
            owners += [item] * len(begins[-1])
            at += len(ws) + 1
        return cls(vocabulary, flat, np.concatenate(begins), owners, min_words)

    def parts(self) -> tuple:
        """What ``EvalIndex(*parts)`` is made of."""
        return self.vocabulary, self.flat, self.begins, self.items, self.min_words

    def matches(self, docs: list[int | None], texts: list[str | None]) -> Iterator[tuple[int | None, int, int, int]]:
        """(document's position in the shard, item, longest match in words, word offset in the document)."""
        if not self.items:
            return
        get = self.vocabulary.get
        pieces, starts, at = [], [], 0
        for text in texts:
            w = words(text)
            starts.append(at)
            pieces.append(np.fromiter((get(x, 0) for x in w), dtype=np.int32, count=len(w)))
            at += len(w) + 1
            pieces.append(np.zeros(1, dtype=np.int32))
        if not at:
            return
        seq = np.concatenate([*pieces, np.zeros(self.min_words + STRIDE, dtype=np.int32)])
        # a suffix counts if its first min_words words are all of the vocabulary
        zeros = np.concatenate([[0], np.cumsum(seq == 0)])
        begin = np.flatnonzero(zeros[self.min_words : self.min_words + at] == zeros[:at])
        if not len(begin):
            return
        order = self._suffix_array(seq, begin)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        starts_of = np.array(starts)
        head = self.flat[self.begins[:, None] + np.arange(self.min_words)]
        low = self._search(seq, order, head, "left")
        high = self._search(seq, order, head, "right")
        for k in np.flatnonzero(high > low):
            places = order[low[k] : high[k]]
            # a match that goes on to the left belongs to the suffix before
            before = self.flat[self.begins[k] - 1]
            places = places[(seq[places - 1] != before) | (places == 0) | (before == 0)]
            if not len(places):
                continue
            lengths = self._common(seq, places, int(self.begins[k]))
            owner = np.searchsorted(starts_of, places, side="right") - 1
            for d, n, p in zip(owner.tolist(), lengths.tolist(), places.tolist()):
                key = (d, self.items[k])
                if found.get(key, (0, 0))[0] < n:
                    found[key] = (n, p - starts[d])
        for (d, item), (n, offset) in found.items():
            yield d, item, n, offset

    def _suffix_array(self, seq: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The places of ``begin`` in the order of the words that follow, up to the first ``min_words``, then by place.

        Ranks of 1, 2, 4 ... words come from pairs of ranks, as in prefix doubling.
        """
        rank, width = seq.astype(np.int64), 1
        while width * 2 <= self.min_words:
            _, doubled = np.unique(rank[:-width] * (rank.max() + 1) + rank[width:], return_inverse=True)
            rank, width = np.concatenate([doubled, np.zeros(width, dtype=np.int64)]), width * 2
        rest = self.min_words - width
        return begin[np.lexsort((rank[np.minimum(begin + rest, len(rank) - 1)], rank[begin]))]

    def _search(self, seq: np.ndarray, order: np.ndarray, heads: np.ndarray, side: str) -> np.ndarray:
        """Binary search of all heads at once."""
        low = np.zeros(len(heads), dtype=np.int64)
        high = np.full(len(heads), len(order), dtype=np.int64)
        reach = np.arange(heads.shape[1])
        while (open_ := low < high).any():
            mid = (low + high) // 2
            there = seq[order[np.minimum(mid, len(order) - 1)][:, None] + reach]
            unlike = there != heads
            first = unlike.argmax(axis=1)
            row = np.arange(len(heads))
            same = ~unlike.any(axis=1)
            less = there[row, first] < heads[row, first]
            right = (less | same) if side == "right" else less & ~same
            low = np.where(open_ & right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)
        return low

    def _common(self, seq: np.ndarray, places: np.ndarray, begin: int) -> np.ndarray:
        """Words that the suffix at ``begin`` shares with the text at each place."""
        lengths, reach, open_ = np.zeros(len(places), dtype=np.int64), np.arange(STRIDE), np.arange(len(places))
        while len(open_):
            done = int(lengths[open_[0]])  # all open places have come equally far
            suffix = self.flat[begin + done : begin + done + STRIDE]
            unlike = (seq[places[open_, None] + done + reach] != suffix) | (suffix == 0)
            ended = unlike.any(axis=1)
            lengths[open_] += np.where(ended, unlike.argmax(axis=1), STRIDE)
            open_ = open_[~ended]
        return lengths


def _blocks(items: DataFrame, item_col: str, text_col: str, eval_chars: int) -> Iterator[list[tuple[int, str | None]]]:
    """The distinct evaluation items in blocks of at most ``eval_chars``, but for one longer item."""
    block, size = [], 0
    for row in items.select(item_col, text_col).distinct().toLocalIterator():
        text = row[1] or ""
        if block and size + len(text) > eval_chars:
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += len(text)
    if block:
        yield block


def leaked_passages(
    documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
    min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS, eval_chars: int = EVAL_CHARS,
) -> DataFrame:
    """(doc, item, words, word_offset): each document that holds ``min_words`` consecutive words of an item.

    ``words`` is the longest match and ``word_offset`` where it begins. Null and
    empty texts, and items of fewer words, hold nothing. A document counts once
    for each item however often its row occurs; the longest match stays.
    """
    rows = documents.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).filter("text is not null")
    doc_kind, item_kind = rows.schema["doc"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    out = f"doc {doc_kind}, item {item_kind}, words int, word_offset int"
    found = None
    for block in _blocks(items, item_col, text_col, eval_chars):
        # plain values, which executors read without the package
        shared = documents.sparkSession.sparkContext.broadcast(EvalIndex.build(block, min_words).parts())
        item_type = pa.array([block[0][0]]).type

        def search(batches: Iterator[pa.RecordBatch], shared=shared, item_type=item_type) -> Iterator[pa.RecordBatch]:
            index = EvalIndex(*shared.value)
            docs, texts, size = [], [], 0

            def flush() -> pa.RecordBatch:
                hits = [(docs[d], *rest) for d, *rest in index.matches(docs, texts)]
                columns = list(zip(*hits)) or [[], [], [], []]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc", "item", "words", "word_offset"])

            kinds = [None, item_type, pa.int32(), pa.int32()]
            for batch in batches:
                kinds[0] = batch.schema.field(0).type
                for start in range(0, batch.num_rows, 500):
                    piece = batch.slice(start, 500)
                    docs += piece.column(0).to_pylist()
                    texts += piece.column(1).to_pylist()
                    size += piece.nbytes // 7
                    if size >= shard_words:
                        yield flush()
                        docs, texts, size = [], [], 0
            if docs:
                yield flush()

        part = rows.mapInArrow(search, out)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = documents.sparkSession.createDataFrame([], out)
    best = found.groupBy("doc", "item").agg(F.max_by(F.struct("words", "word_offset"), F.struct("words", -F.col("word_offset"))).alias("m"))
    return best.select(F.col("doc").alias(doc_col), F.col("item").alias(item_col), "m.words", "m.word_offset")


def clean_documents(documents: DataFrame, leaked: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """The documents that hold no passage."""
    return documents.join(leaked.select(doc_col).distinct(), doc_col, "left_anti")
