"""Ranked lexical search, reversed: the documents stream through an index of the items."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickertide.llm.tables import stage
from tickertide.llm.words import ALNUM, as_signed, ragged, split_words

TOP = 10
POSTINGS = 4_000_000  # (item, term) pairs of one broadcast index, 12 bytes each
ROWS, CELLS = 2_000, 1 << 21  # texts split at once; cells of a document by item score table
LAST = np.iinfo(np.int64).max

_HITS = "doc_id long, n long, terms binary, counts binary"


class _Index(NamedTuple):
    """Postings of a block of items: of each term (sorted hashes) the items that hold it."""

    ids: pa.Array
    terms: np.ndarray
    first: np.ndarray
    items: np.ndarray


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, postings: int = POSTINGS) -> DataFrame:
    """The ``top`` documents (doc_id, text) of each item (item_id, text) by BM25 in whole numbers.

    The items' terms form an inverted index that is broadcast, in blocks of about ``postings``
    pairs, so its size does not follow the number of items. Each task streams the term counts
    of its documents through it and keeps a heap of ``top`` documents for each item; the heaps
    of all tasks are then merged. Corpus counts cover all documents.

    Items that share an item_id are one item with the terms of all; those without one, or
    without terms, have no rows. Each row of ``docs`` is a document, repeated ones too; one
    without doc_id counts in the statistics and is not ranked. Null and empty texts have no
    terms. Other columns are ignored; empty tables give no rows.

    Returns item_id, rank, doc_id, score.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    named = items.where("item_id is not null").select("item_id", "text")
    terms = stage(named.mapInArrow(_item_terms, f"item_id {kind}, term long").distinct(), "item-terms")
    blocks = max(1, -(-terms.count() // postings))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = []
    for number in range(blocks):
        part = terms if blocks == 1 else terms.where(block == number)
        found.append(_search(docs, _index(part), kind, top))
    heaps = stage(reduce(DataFrame.unionByName, found), "item-heaps")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = split_words(batch["text"], ALNUM)
        yield pa.RecordBatch.from_arrays(
            [batch["item_id"].take(pa.array(words.text)), pa.array(as_signed(words.hash))], names=["item_id", "term"]
        )


def _index(terms: DataFrame) -> _Index:
    rows = terms.toArrow()  # one block
    ids = rows["item_id"].combine_chunks().dictionary_encode()
    item = ids.indices.to_numpy()
    term = rows["term"].to_numpy().view(np.uint64)
    order = np.lexsort((item, term))
    unique, first = np.unique(term[order], return_index=True)
    return _Index(ids.dictionary, unique, np.append(first, len(term)), item[order].astype(np.int32))


def _search(docs: DataFrame, index: _Index, kind: str, top: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    hits = stage(docs.select("doc_id", "text").mapInArrow(_count_terms(shared), _HITS), "item-hits")
    n, length = hits.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(index.terms), np.int64)
    # One row for each term of the block.
    for term, count in hits.mapInArrow(_count_documents, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        df[term] = count
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    weighted = docs.sparkSession.sparkContext.broadcast(weights)
    schema = f"item_id {kind}, doc_id long, score long"
    return hits.where("doc_id is not null").mapInArrow(_score(shared, weighted, n, length, top), schema)


def _count_terms(shared):
    """Of each document with terms: their number, and the counts of those that are in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.terms
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                words = split_words(part["text"], ALNUM)
                n = np.diff(words.first)
                place = np.searchsorted(known, words.hash)
                hit = np.zeros(len(place), bool)
                inside = place < len(known)
                hit[inside] = known[place[inside]] == words.hash[inside]
                pair, count = np.unique((words.text[hit] << 32) | place[hit], return_counts=True)
                edges = np.searchsorted(pair >> 32, np.arange(len(n) + 1))
                term, count = (pair & 0xFFFFFFFF).astype("<i4"), count.astype("<i4")
                rows = np.flatnonzero(n > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"].cast(pa.int64()).take(pa.array(rows)),
                        pa.array(n[rows].astype(np.int64)),
                        pa.array([term[edges[r] : edges[r + 1]].tobytes() for r in rows], pa.binary()),
                        pa.array([count[edges[r] : edges[r + 1]].tobytes() for r in rows], pa.binary()),
                    ],
                    names=["doc_id", "n", "terms", "counts"],
                )

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of a binary column, and how many each row has."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<i4"), np.array([len(v) // 4 for v in values], np.int64)


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        counted = np.bincount(_flat(batch["terms"])[0])
        if len(counted) > len(total):
            total, counted = counted, total
        total[: len(counted)] += counted
    term = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(total[term])], names=["term", "n"])


def _score(shared, weighted, documents: int, length: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights = shared.value, weighted.value
        heaps = _Heaps(len(index.ids), top)
        step = max(1, CELLS // max(1, len(index.ids)))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                doc_id = part["doc_id"].to_numpy()
                # Python numbers: the product may pass 64 bits.
                m = np.array([10 + 90 * n * documents // length for n in part["n"].to_pylist()], np.int64)
                term, size = _flat(part["terms"])
                tf = _flat(part["counts"])[0].astype(np.int64)
                doc = np.repeat(np.arange(len(size)), size)
                gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                spans = index.first[term + 1] - index.first[term]
                cell = np.repeat(doc * len(index.ids), spans) + index.items[ragged(index.first[term], spans)]
                scores = np.zeros(len(size) * len(index.ids), np.int64)
                np.add.at(scores, cell, np.repeat(gain, spans))
                heaps.push(doc_id, scores.reshape(len(size), -1))
        item, doc_id, score = heaps.rows()
        yield pa.RecordBatch.from_arrays(
            [index.ids.take(pa.array(item)), pa.array(doc_id), pa.array(score)], names=["item_id", "doc_id", "score"]
        )

    return run


class _Heaps:
    """Of each item the best documents so far: highest score first, then the smallest doc_id."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.score = np.zeros((items, top), np.int64)
        self.doc = np.full((items, top), LAST)

    def push(self, doc_id: np.ndarray, scores: np.ndarray) -> None:
        """Add documents with their scores for every item; only what beats a heap's last is sorted."""
        least, last = self.score[:, -1], self.doc[:, -1]
        better = (scores > least) | ((scores == least) & (scores > 0) & (doc_id[:, None] < last))
        row, item = np.nonzero(better)
        if not len(row):
            return
        touched, place = np.unique(item, return_inverse=True)
        every = np.concatenate((place, np.repeat(np.arange(len(touched)), self.top)))
        score = np.concatenate((scores[row, item], self.score[touched].ravel()))
        doc = np.concatenate((doc_id[row], self.doc[touched].ravel()))
        order = np.lexsort((doc, -score, every))
        start = np.searchsorted(every[order], np.arange(len(touched)))
        best = order[(start[:, None] + np.arange(self.top)).ravel()]
        self.score[touched] = score[best].reshape(-1, self.top)
        self.doc[touched] = doc[best].reshape(-1, self.top)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, at = np.nonzero(self.score > 0)
        return item, self.doc[item, at], self.score[item, at]
