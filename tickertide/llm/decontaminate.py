"""Benchmark passages in documents, found by winnowed fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickertide.llm.tables import small, stage
from tickertide.llm.words import ALNUM, as_signed, gram_hashes, slices, split_words

FILTER_BITS = 24  # a bitmap of fixed size, whatever the benchmark
BROADCAST_ROWS = 100_000  # of about 150 bytes each

_PRINTS = "array<struct<print:long,span:int,pos:int,around:binary>>"


class _Scheme:
    """Grams of k words, the least of each run of w grams: a shared run of k + w - 1 words
    always shares a chosen gram. Around each are the words of the windows that hold it."""

    def __init__(self, window: int, k: int):
        self.window, self.k, self.w = window, k, window - k + 1
        self.lead = self.w - 1
        self.width = self.lead + window

    def chosen(self, words) -> np.ndarray:
        """Start positions of the fingerprints of all texts of a batch."""
        n = len(words.hash) - self.window + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        grams = gram_hashes(words.hash, self.k)
        least, at = grams[:n].copy(), np.arange(n)
        for j in range(1, self.w):
            lower = grams[j : j + n] <= least
            at = np.where(lower, np.arange(j, j + n), at)
            least = np.where(lower, grams[j : j + n], least)
        whole = words.text[:n] == words.text[self.window - 1 :]
        mark = np.zeros(len(words.hash), bool)
        mark[at[whole]] = True
        return np.flatnonzero(mark)

    def around(self, words, at: np.ndarray, before: int, after: int) -> np.ndarray:
        """Word hashes from ``before`` words ahead of each position; 0 outside of its text."""
        out = np.zeros((len(at), self.width), np.uint64)
        low, high = words.first[words.text[at]], words.first[words.text[at] + 1]
        for j in range(-before, after):
            p = at + j
            ok = (p >= low) & (p < high)
            out[ok, self.lead + j] = words.hash[p[ok]]
        return out


def _rows(words, found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
    """Per text, its fingerprints as a list column."""
    at = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    prints, span = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (1, 2))
    around = [row.tobytes() for f in found for row in f[3]]
    text = words.text[at]
    order = np.argsort(text, kind="stable")
    ends = np.searchsorted(text[order], np.arange(len(words.first)), "left")
    values = pa.StructArray.from_arrays(
        [
            pa.array(as_signed(prints.astype(np.uint64))[order]),
            pa.array(span.astype(np.int32)[order]),
            pa.array((at - words.first[text]).astype(np.int32)[order]),
            pa.array([around[i] for i in order], pa.binary()),
        ],
        names=["print", "span", "pos", "around"],
    )
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def _benchmark_prints(benchmark: DataFrame, scheme: _Scheme) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            words = split_words(batch["text"], ALNUM)
            length = np.diff(words.first)
            at = scheme.chosen(words)
            found = [(at, gram_hashes(words.hash, scheme.k)[at], np.full(len(at), scheme.window),
                      scheme.around(words, at, scheme.lead, scheme.window))]
            for span in range(1, scheme.window):
                at = words.first[:-1][length == span]
                if len(at):
                    found.append((at, gram_hashes(words.hash, span)[at], np.full(len(at), span),
                                  scheme.around(words, at, 0, span)))
            wording = [
                hashlib.md5(words.hash[a:b].tobytes()).hexdigest()
                for a, b in zip(words.first, words.first[1:])
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["item_id"], pa.array(wording), _rows(words, found)], ["item_id", "wording", "prints"]
            )

    item = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(
        run, f"item_id {item}, wording string, prints {_PRINTS}"
    )


def _filter(prints: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bitmap of the benchmark's fingerprints, and the lengths of its short items."""
    bit = F.pmod("print", F.lit(1 << FILTER_BITS))
    rows = (
        prints.groupBy(F.floor(bit / 64).cast("int").alias("at"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits"))
        .collect()  # at most 2**18 rows
    )
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for at, value in rows:
        bits[at] = value
    return bits.view(np.uint64), sorted(r[0] for r in prints.select("span").distinct().collect())


def _document_prints(docs: DataFrame, scheme: _Scheme, bits: np.ndarray, spans: list[int]) -> DataFrame:
    def known(prints: np.ndarray) -> np.ndarray:
        bit = prints & np.uint64((1 << FILTER_BITS) - 1)
        return (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            words = split_words(batch["text"], ALNUM)
            found = []
            for span in spans:
                if span == scheme.window:
                    at = scheme.chosen(words)
                    prints = gram_hashes(words.hash, scheme.k)[at]
                else:
                    prints = gram_hashes(words.hash, span)
                    at = np.flatnonzero(words.text[: len(prints)] == words.text[span - 1 :]) if len(prints) else np.zeros(0, np.int64)
                    prints = prints[at]
                hit = known(prints)
                at, prints = at[hit], prints[hit]
                before, after = (scheme.lead, scheme.window) if span == scheme.window else (0, span)
                found.append((at, prints, np.full(len(at), span), scheme.around(words, at, before, after)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.array(np.diff(words.first)), _rows(words, found)],
                ["doc_id", "text_key", "n_words", "prints"],
            )

    doc = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run, f"doc_id {doc}, text_key long, n_words long, prints {_PRINTS}"
    )


def _extend(pairs: DataFrame, scheme: _Scheme) -> DataFrame:
    """From fingerprints that meet to the words that all shared windows around them cover."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            n = batch.num_rows
            if not n:
                continue
            ours, theirs = (
                np.frombuffer(b"".join(batch[c].to_pylist()), np.uint64).reshape(n, scheme.width)
                for c in ("around", "item_around")
            )
            pos, span = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "span"))
            same = (ours == theirs) & (ours != 0)
            left = np.cumprod(same[:, scheme.lead - 1 :: -1], axis=1).sum(1) if scheme.lead else np.zeros(n, int)
            right = np.cumprod(same[:, scheme.lead :], axis=1).sum(1)
            keep = left + right >= span
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].filter(pa.array(keep)),
                    batch["text_key"].filter(pa.array(keep)),
                    batch["wording"].filter(pa.array(keep)),
                    pa.array((pos - left)[keep]),
                    pa.array((pos + right)[keep]),
                ],
                ["doc_id", "text_key", "wording", "start", "stop"],
            )

    doc = pairs.schema["doc_id"].dataType.simpleString()
    return pairs.mapInArrow(run, f"doc_id {doc}, text_key long, wording string, start long, stop long")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """Words of ``docs`` (doc_id, text) inside a passage of ``benchmark`` (item_id, text).

    A passage is ``window`` words of an item in a row, or a whole item of fewer words.
    Both sides keep the least hash of each run of ``window - k + 1`` grams of ``k`` words,
    so every shared passage shares a fingerprint. Document fingerprints go through a
    bitmap of the benchmark's, of fixed size, then meet the benchmark's by a join, and each
    meeting is extended word by word. Shorter items are looked up by their whole length.

    Null and empty texts have no words and no passage. Repeated items count once per item_id;
    items without an id make their words hit but are not counted. Each input row of ``docs``
    gives one row, also for repeated rows. Other columns are ignored.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated.
    """
    scheme = _Scheme(window, k)
    items = stage(_benchmark_prints(benchmark, scheme), "benchmark-prints")
    prints = (
        items.select("wording", F.explode("prints").alias("p"))
        .select("wording", "p.print", "p.span", F.col("p.around").alias("item_around"))
        .distinct()
    )
    prints = stage(prints, "benchmark-distinct")
    bits, spans = _filter(prints)
    read = stage(_document_prints(docs, scheme, bits, spans), "document-prints")
    met = (
        read.select("doc_id", "text_key", F.explode("prints").alias("p"))
        .select("doc_id", "text_key", "p.print", "p.span", "p.pos", "p.around")
        .join(small(prints, BROADCAST_ROWS), ["print", "span"])
    )
    hits = stage(_extend(met, scheme).distinct(), "benchmark-hits")
    key = ["doc_id", "text_key"]
    spans_of = hits.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    covered = F.aggregate(
        "spans",
        start,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["upto"], s["start"]))).alias("n"),
            F.greatest(a["upto"], s["stop"]).alias("upto"),
        ),
        lambda a: a["n"],
    )
    hit_words = spans_of.select(*key, covered.alias("n_hit"))
    ids = items.where("item_id is not null").select("wording", F.col("item_id").cast("string").alias("item")).distinct()
    hit_items = (
        hits.select(*key, "wording")
        .distinct()
        .join(small(ids, BROADCAST_ROWS), "wording")
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    rows = read.select(*key, "n_words").alias("r")
    for other, name in ((hit_words, "w"), (hit_items, "i")):
        right = other.alias(name)
        rows = rows.join(
            right.withColumnsRenamed({"doc_id": f"{name}_doc", "text_key": f"{name}_key"}),
            F.col("doc_id").eqNullSafe(F.col(f"{name}_doc")) & F.col("text_key").eqNullSafe(F.col(f"{name}_key")),
            "left",
        )
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
