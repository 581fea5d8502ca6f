"""Phrases of two to four words that stick together, counted in tiles of frequency-ranked ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickertide.llm.tables import stage
from tickertide.llm.words import as_signed, byte_class, mix, ragged, slices, split_words

LEAST, TOP, CONTAINED = 30, 2000, 80
LONGEST = 4
HEAD = 1 << 19  # grams of a length that are ranked and broadcast, 12 bytes each
TILE_BITS, GRID_BITS = 9, 3  # dense tiles of 512 x 512 pairs, among the first 8 x 8
DENSE_SHARE = 16  # a tile turns dense when a chunk has a pair for every so many cells
CHUNK, SPARSE = 1 << 20, 1 << 20  # pairs counted at once, distinct sparse pairs kept
ROWS, CODED_ROWS = 2_000, 500  # texts whose words are counted at once, or coded and paired
OUT_ROWS = 1 << 16  # counts sent at once
TAIL = 1 << 62  # ids from here on are hashes
FILTER_BITS = 24  # a bitmap of fixed size, however many grams there are
NONE = -1

#: ``[^\x20\x09]+`` within pieces cut at ``[.,;:!?\x0A-\x0D]``
_BREAKS = byte_class(*[(ord(c), ord(c)) for c in ".,;:!?"], (0x0A, 0x0D))
_WORD = ~(_BREAKS | byte_class((0x20, 0x20), (0x09, 0x09)))
_ODD = np.uint64(0x9E3779B97F4A7C15)

_COUNTS = "lang string, word string, key long, n long"
_PAIRS = "left long, right long, n long"


class _Ranks(NamedTuple):
    """The head of the frequent grams of one length, and a filter for those beyond it."""

    keys: np.ndarray  # sorted hashes
    ranks: np.ndarray
    beyond: np.ndarray | None  # bitmap of hashes; None if the head holds all

    def ids(self, keys: np.ndarray) -> np.ndarray:
        """Of each hash its rank, or a tail id, or NONE if the gram can't be frequent."""
        out = np.full(len(keys), NONE, np.int64)
        if len(self.keys):
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == keys
            out[hit] = self.ranks[at[hit]]
        if self.beyond is not None:
            bit = (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            tail = (out == NONE) & ((self.beyond[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)
            out[tail] = (keys[tail] >> np.uint64(2)).astype(np.int64) | TAIL
        return out


def _joined_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of the gram made of two ids."""
    return mix(left.astype(np.uint64) * _ODD + mix(right.astype(np.uint64)))


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, contained: int = CONTAINED, head: int = HEAD
) -> DataFrame:
    """The ``top`` phrases of two to four words of each language of ``docs`` (text, lang).

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at blanks and tabs. A
    phrase occurs ``least`` times or more (a). Cutting it in two parts of l and r occurrences
    scores floor(2000000 a / (l + r)); the lowest cut counts. A phrase inside a longer one
    with at least ``contained`` percent of its occurrences is dropped.

    Frequent words are ranked by frequency, over all languages. Pairs of ranks are counted in
    tiles: crowded ones by direct address, the others as sorted coordinates. Frequent pairs are ranked
    in turn and count as symbols, so triples are pairs of a pair and a word, and so on. Only the
    first ``head`` grams of a length are ranked and broadcast; those beyond keep their hash
    as id and are recognised by a bitmap of fixed size, whose false hits fall to the threshold.

    Null and blank texts have no words; a null lang is ``und``. Each row counts, repeated ones
    too. Other columns are ignored; an empty table gives no rows. Hashes of 64 bits stand for
    words; a collision could change a count.

    Returns lang, rank, phrase, a, l, r, n, score.
    """
    spark = docs.sparkSession
    text = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = stage(
        text.mapInArrow(_count_words, _COUNTS).groupBy("lang", "word", "key").agg(F.sum("n").alias("n")), "word-counts"
    )
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    words = counted.where(F.col("n") >= least).select("lang", "word", "key", F.col("n").alias("f"))
    words, ranks = _ranked(words, head)
    known = [spark.sparkContext.broadcast(ranks)]
    coded = stage(text.mapInArrow(_encode(known[0]), "ids binary"), "word-ids")

    grams = [words.select("id", "f", F.array("id").alias("gram"), "lang")]
    for _ in range(2, LONGEST + 1):
        pairs = coded.mapInArrow(_count_pairs(known), _PAIRS).groupBy("left", "right").agg(F.sum("n").alias("f"))
        pairs = pairs.where(F.col("f") >= least).mapInArrow(_add_keys, "left long, right long, f long, key long")
        pairs, ranks = _ranked(pairs, head)
        known.append(spark.sparkContext.broadcast(ranks))
        shorter = grams[-1].select(F.col("id").alias("left"), F.col("gram").alias("begin"), "lang")
        longer = pairs.join(shorter, "left").select(
            "id", "f", F.concat("begin", F.array("right")).alias("gram"), "lang"
        )
        grams.append(stage(longer, "grams"))
    return _best(grams, words, totals, top, contained)


# --- words -----------------------------------------------------------------------


def _lang_codes(langs: pa.Array) -> np.ndarray:
    """A hash of the language of each row."""
    coded = langs.dictionary_encode()
    codes = [int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") for v in coded.dictionary.to_pylist()]
    return np.array(codes, np.uint64)[coded.indices.to_numpy()]


def _words(part: pa.RecordBatch):
    """The words of a batch, and a key of each that tells languages apart."""
    words = split_words(part["text"], _WORD)
    return words, mix(words.hash ^ _lang_codes(part["lang"])[words.text])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, ROWS):
        words, keys = _words(part)
        unique, first, n = np.unique(keys, return_index=True, return_counts=True)
        start, size = words.start[first], words.end[first] - words.start[first]
        raw = words.data[ragged(start, size)].copy()
        raw[(raw >= 65) & (raw <= 90)] += 32
        offsets = np.concatenate(([0], np.cumsum(size)))
        text = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
        lang = part["lang"].take(pa.array(words.text[first]))
        yield pa.RecordBatch.from_arrays(
            [lang, text.cast(pa.string()), pa.array(as_signed(unique)), pa.array(n)], names=["lang", "word", "key", "n"]
        )


def _encode(ranks):
    """The word ids of each text; NONE for words that can't be frequent and between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, CODED_ROWS):
            words, keys = _words(part)
            ids = ranks.value.ids(keys)
            breaks = np.concatenate(([0], np.cumsum(_BREAKS[words.data[words.offset[0] : words.offset[-1]]])))
            low = words.offset[0]
            gap = np.zeros(len(ids) + 1, bool)  # before each word: does a piece end there?
            if len(ids):
                gap[1:-1] = breaks[words.start[1:] - low] > breaks[words.end[:-1] - low]
            place = np.arange(len(ids)) + np.cumsum(gap[:-1])
            spread = np.full(len(ids) + int(gap.sum()), NONE, np.int64)
            spread[place] = ids
            edge = np.append(place, len(spread))[words.first]
            wide = "<i8" if ranks.value.beyond is not None else "<i4"
            rows = [spread[a:b].astype(wide).tobytes() for a, b in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    return run


# --- pairs in tiles --------------------------------------------------------------


def _symbols(batches: Iterator[pa.RecordBatch], known) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs to count: the id of a gram and that of the word after it, where both can be frequent."""
    ranks = [k.value for k in known]
    wide = "<i8" if ranks[0].beyond is not None else "<i4"
    gap = np.full(1, NONE, wide).tobytes()
    for part in slices(batches, CODED_ROWS):
        words = np.frombuffer(gap.join([*part["ids"].to_pylist(), gap * len(ranks)]), wide).astype(np.int64)
        grams = words
        for length, rank in enumerate(ranks):
            if length:
                ids = np.full(len(grams) - 1, NONE, np.int64)
                ok = (grams[:-1] != NONE) & (grams[1:] != NONE)
                after = words[length:]
                ids[ok] = rank.ids(_joined_keys(grams[:-1][ok], after[ok]))
                grams = ids
        # Both parts of a frequent gram that lack one word are frequent.
        ok = (grams[:-1] != NONE) & (grams[1:] != NONE)
        yield grams[:-1][ok], words[len(ranks) :][ok]


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of several slices of texts at once, since a tile is crowded by the pairs of one call."""
    left, right, size = [], [], 0
    for l, r in pairs:
        left.append(l)
        right.append(r)
        size += len(l)
        if size >= CHUNK // 2:
            yield np.concatenate(left), np.concatenate(right)
            left, right, size = [], [], 0
    if size:
        yield np.concatenate(left), np.concatenate(right)


def _count_pairs(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = _Tiles()
        for left, right in _gathered(_symbols(batches, known)):
            for low in range(0, len(left), CHUNK):
                yield from tiles.add(left[low : low + CHUNK], right[low : low + CHUNK])
        yield from tiles.close()

    return run


class _Tiles:
    """Counts of (left, right): dense tiles by direct address, sorted coordinates for the rest."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.sparse = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.waiting, self.rows = [], 0

    def add(self, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        side, grid = 1 << TILE_BITS, 1 << GRID_BITS
        near = (left < side * grid) & (right < side * grid)
        l, r = left[near], right[near]
        tile = ((l >> TILE_BITS << GRID_BITS) | (r >> TILE_BITS)).astype(np.uint8)
        order = np.argsort(tile, kind="stable")
        cell = ((l & (side - 1)) << TILE_BITS | (r & (side - 1)))[order]
        edges = np.concatenate(([0], np.cumsum(np.bincount(tile, minlength=grid * grid))))
        thin = [np.flatnonzero(~near)]
        at = np.flatnonzero(near)[order]
        for number, (low, high) in enumerate(zip(edges, edges[1:])):
            if number in self.dense or (high - low) * DENSE_SHARE >= side * side:
                counts = self.dense.setdefault(number, np.zeros(side * side, np.int64))
                counts += np.bincount(cell[low:high], minlength=side * side)
            elif high > low:
                thin.append(at[low:high])
        thin = np.concatenate(thin)
        self.waiting.append((left[thin], right[thin], np.ones(len(thin), np.int64)))
        self.rows += len(thin)
        if self.rows >= SPARSE:
            self._merge()
            if self.rows >= SPARSE // 2:
                yield from self._flush()

    def _merge(self) -> None:
        columns = [list(c) for c in zip(self.sparse, *self.waiting)]
        self.sparse, self.waiting = (), []
        n, right, left = (np.concatenate(columns.pop()) for _ in range(3))  # each column goes once it is joined
        order = np.lexsort((right, left))
        left, right, n = left[order], right[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])))[: len(left)])
        self.sparse = (left[first], right[first], np.add.reduceat(n, first) if len(first) else n)
        self.rows = len(first)

    def _flush(self) -> Iterator[pa.RecordBatch]:
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in self.sparse], names=["left", "right", "n"])
        self.sparse, self.rows = (np.zeros(0, np.int64),) * 3, 0
        for low in range(0, max(1, batch.num_rows), OUT_ROWS):
            yield batch.slice(low, OUT_ROWS)

    def close(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        yield from self._flush()
        for number, counts in self.dense.items():
            cell = np.flatnonzero(counts)
            left = (number >> GRID_BITS << TILE_BITS) + (cell >> TILE_BITS)
            right = ((number & ((1 << GRID_BITS) - 1)) << TILE_BITS) + (cell & ((1 << TILE_BITS) - 1))
            self.sparse = (left, right, counts[cell])
            yield from self._flush()


def _add_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = _joined_keys(batch["left"].to_numpy(), batch["right"].to_numpy())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(as_signed(key))], names=[*batch.schema.names, "key"])


# --- ranks -----------------------------------------------------------------------


def _ranked(frequent: DataFrame, head: int) -> tuple[DataFrame, _Ranks]:
    """``frequent`` (..., key, f) with ids, the most frequent ones (``head`` at most) ranked from 0, and the ranks to broadcast."""
    frequent = stage(frequent, "frequent")
    columns, count, cut = frequent.columns, frequent.count(), 0
    first = frequent
    while count > head and first.count() > head:  # any cut does that leaves ``head`` rows or fewer
        cut = cut * 2 or frequent.agg(F.percentile_approx("f", 1 - head / count)).first()[0]
        first = frequent.where(F.col("f") > cut)
    rows = first.select("key", "f").toArrow()  # at most ``head`` pairs of longs
    keys = rows["key"].to_numpy().view(np.uint64)
    keys = keys[np.lexsort((keys, -rows["f"].to_numpy()))]
    order = np.argsort(keys)
    found = _Ranks(keys[order], order.astype(np.int32), _bitmap(frequent) if count > head else None)
    shared = frequent.sparkSession.sparkContext.broadcast(found)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = shared.value.ids(batch["key"].to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids)], names=[*batch.schema.names, "id"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frequent.schema.fields)
    return stage(frequent.mapInArrow(number, f"{schema}, id long"), "ranked").select(*columns, "id"), found


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """The leading bits of all keys, as a bitmap of ``FILTER_BITS`` bits."""
    lead = F.call_function("shiftrightunsigned", F.col("key"), F.lit(64 - FILTER_BITS))
    octet = (lead / 8).cast("long").alias("octet")
    bits = frequent.select(octet, F.call_function("shiftleft", F.lit(1), (lead % 8).cast("int")).alias("bit"))
    rows = bits.groupBy("octet").agg(F.bit_or("bit").alias("bits")).toArrow()  # a row for each of 2 MB at most
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    out[rows["octet"].to_numpy()] = rows["bits"].to_numpy()
    return out


# --- scores ----------------------------------------------------------------------


def _best(grams: list[DataFrame], words: DataFrame, totals: DataFrame, top: int, contained: int) -> DataFrame:
    columns = ["gram", "f", "lang"]
    phrases = reduce(DataFrame.unionByName, [g.select(*columns) for g in grams[1:]])
    parts = reduce(DataFrame.unionByName, [g.select("gram", "f") for g in grams[:-1]])
    n = F.size("gram")

    inner = F.filter(
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.greatest(F.lit(2), n - 1)),
                lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda at: F.slice("gram", at, size)),
            )
        ),
        lambda g: F.size(g) < n,
    )
    covered = (
        phrases.where(n > 2)
        .select(F.explode(inner).alias("gram"), "f")
        .groupBy("gram")
        .agg(F.max("f").alias("longer"))
    )
    kept = phrases.join(covered, "gram", "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("f").cast("decimal(20,0)") * contained)
    )
    cuts = kept.select(*columns, F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    left = parts.select(F.col("gram").alias("begin"), F.col("f").alias("l"))
    right = parts.select(F.col("gram").alias("end"), F.col("f").alias("r"))
    cut = (
        cuts.withColumns({"begin": F.slice("gram", 1, F.col("k")), "end": F.slice("gram", F.col("k") + 1, n - F.col("k"))})
        .join(left, "begin")
        .join(right, "end")
    )
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(7,0)) * CAST(f AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + r) AS BIGINT)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")
    scored = cut.groupBy(*columns).agg(lowest).select(*columns, "c.score", "c.l", "c.r")
    # The words are only needed where ties may reach into the list.
    about = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"))
    first = stage(scored.withColumn("about", F.rank().over(about)).where(F.col("about") <= top), "first-phrases")
    spelled = (
        first.select("gram", F.posexplode("gram").alias("at", "id"))
        .join(words.select("id", "word"), "id")
        .groupBy("gram")
        .agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelling"))  # four words at most
        .select("gram", F.array_join(F.col("spelling.word"), " ").alias("phrase"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    listed = first.join(spelled, "gram").withColumnRenamed("f", "a")
    ranked = listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )
