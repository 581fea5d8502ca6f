"""N-gram language model with deleted interpolation, counted and scored by chunks of texts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tickertide.llm.tables import stage
from tickertide.llm.words import NON_SPACE, mix, split_words

CHUNK_TOKENS = 2_000_000
PART_KEYS = 3_000_000
RUN_TOKENS = 1 << 17  # tokens of a chunk whose estimates are held at once, up to the end of a text
END = np.uint64(0x5851F42D4C957F2D)  # the hash of the token at the end of a text
BEGIN = np.uint64(0x14057B7EF767814F)  # the context of its first token


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers by byte planes, so that small numbers and small steps take little room."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8").astype(np.uint64)


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed), dtype=np.uint64)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and the place of each one among them, in half the room of ``np.unique``."""
    order = np.argsort(x)
    ordered = x[order]
    first = np.ones(len(x), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    unique = ordered[first]
    del ordered
    place = np.empty(len(x), np.int32)
    place[order] = np.cumsum(first, dtype=np.int32) - 1
    return unique, place


def _chunks(docs: DataFrame) -> DataFrame:
    """Texts as numbers of words: one row for about CHUNK_TOKENS tokens.

    ``words`` are the hashes of the distinct words, the most frequent first, and ``tokens``
    the place of each token among them; each text ends with END.
    """

    def emit(number, ids, held, lengths, hashes):
        words, inverse = _distinct(np.concatenate(hashes))
        order = np.argsort(-np.bincount(inverse), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        chunk = ((TaskContext.get().partitionId() if TaskContext.get() else 0) << 32) + number
        return pa.RecordBatch.from_arrays(
            [
                pa.array([chunk], pa.int64()),
                pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)),
                pa.array([np.concatenate(held).tolist()], pa.list_(pa.bool_())),
                pa.array([np.concatenate(lengths)], pa.list_(pa.int64())),
                pa.array([len(inverse)], pa.int64()),
                pa.array([_pack(words[order])], pa.binary()),
                pa.array([_pack(rank[inverse])], pa.binary()),
            ],
            ["chunk", "ids", "held", "lengths", "n", "words", "tokens"],
        )

    def run(batches: Iterator[pa.RecordBatch]):
        number, size, parts = 0, 0, ([], [], [], [])
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                words = split_words(part["text"], NON_SPACE)
                length = np.diff(words.first) + 1
                tokens = np.full(int(length.sum()), END)
                tokens[np.arange(len(words.hash)) + words.text] = words.hash
                for store, value in zip(
                    parts, (part["doc_id"], part["held_out"].to_numpy(zero_copy_only=False), length, tokens)
                ):
                    store.append(value)
                size += len(tokens)
                if size >= CHUNK_TOKENS:
                    yield emit(number, *parts)
                    number, size, parts = number + 1, 0, ([], [], [], [])
        if size:
            yield emit(number, *parts)

    doc = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run,
        f"chunk long, ids array<{doc}>, held array<boolean>, lengths array<long>, n long, words binary, tokens binary",
    )


class _Chunk:
    """The tokens of a chunk, and its distinct n-grams of each order in order of their keys."""

    def __init__(self, row: dict, order: int):
        words, place = _unpack(row["words"]), _unpack(row["tokens"]).astype(np.int32)
        self.lengths = lengths = np.array(row["lengths"], np.int64)
        self.text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.learned = ~np.repeat(np.array(row["held"], bool), lengths)
        by_key = np.argsort(words)
        rank = np.empty(len(words), np.int32)
        rank[by_key] = np.arange(len(words))
        self.keys, self.inverse = [words[by_key]], [rank[place]]
        if order < 2:
            return
        token = words[place]
        within = np.arange(len(token), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
        del place
        context = None
        for n in range(2, order + 1):
            earlier = np.full(len(token), BEGIN)
            earlier[n - 1 :] = token[: len(token) - n + 1]
            earlier[within < n - 1] = BEGIN
            context = earlier if n == 2 else mix(context * np.uint64(3) + earlier)
            key = mix(context)
            key += token * np.uint64(0x9E3779B97F4A7C15)
            if n == order:
                del token, earlier, context
            unique, inverse = _distinct(mix(key))
            self.keys.append(unique)
            self.inverse.append(inverse)

    def counts(self, n: int) -> np.ndarray:
        """How often the training texts hold each n-gram of order n + 1."""
        return np.bincount(self.inverse[n][self.learned], minlength=len(self.keys[n]))


def _edges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of keys begins in sorted keys."""
    bounds = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


def _partial_counts(chunks: DataFrame, order: int, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for row, _ in _rows(batches):
            chunk = _Chunk(row, order)
            for n, keys in enumerate(chunk.keys):
                counts, edges = chunk.counts(n), _edges(keys, parts)
                out = [
                    (row["chunk"], n, p, _pack_sorted(keys[a:b]), _pack(counts[a:b]))
                    for p, (a, b) in enumerate(zip(edges, edges[1:]))
                    if b > a
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                    ["chunk", "order", "part", "keys", "counts"],
                )

    return chunks.mapInArrow(run, "chunk long, order int, part int, keys binary, counts binary")


def _total_counts(partial: DataFrame) -> DataFrame:
    """For each chunk and range of keys, the counts over all chunks in the order of its keys."""

    def merge(group: pa.Table) -> pa.Table:
        keys = [_unpack_sorted(k) for k in group["keys"].to_pylist()]
        counts = np.concatenate([_unpack(c) for c in group["counts"].to_pylist()]).astype(np.int64)
        unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, counts, len(unique)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        rows = len(keys)
        known, tokens = [0] * rows, [0] * rows
        known[0], tokens[0] = int((total > 0).sum()), int(total.sum())
        return pa.table(
            {
                "chunk": group["chunk"],
                "order": group["order"],
                "part": group["part"],
                "totals": pa.array([_pack(total[inverse[e - len(k) : e]]) for k, e in zip(keys, ends)], pa.binary()),
                "known": pa.array(known, pa.int64()),
                "tokens": pa.array(tokens, pa.int64()),
            }
        )

    return partial.groupBy("order", "part").applyInArrow(
        merge, "chunk long, order int, part int, totals binary, known long, tokens long"
    )


def _with_totals(chunks: DataFrame, totals: DataFrame, order: int) -> DataFrame:
    """Chunks with the total counts of their n-grams, one packed list for each order."""

    def attach(chunk: pa.Table, found: pa.Table) -> pa.Table:
        rows = found.sort_by([("order", "ascending"), ("part", "ascending")]).to_pylist()
        lists = [
            _pack(np.concatenate([_unpack(r["totals"]) for r in rows if r["order"] == n])) for n in range(order)
        ]
        return chunk.append_column("totals", pa.array([lists], pa.list_(pa.binary())))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema) + ", totals array<binary>"
    slim = totals.select("chunk", "order", "part", "totals")
    return chunks.groupBy("chunk").cogroup(slim.groupBy("chunk")).applyInArrow(attach, schema)


class _Run(NamedTuple):
    """Of whole texts of a chunk, per token: maximum-likelihood estimates of each order, and the bucket of the context."""

    texts: slice
    tokens: slice
    unigram: np.ndarray
    p: list[np.ndarray]
    bucket: np.ndarray


def _runs(lengths: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Texts and their tokens, about RUN_TOKENS at a time; no text is cut."""
    ends = np.cumsum(lengths)
    low = at = 0
    while low < len(lengths):
        high = max(low + 1, int(np.searchsorted(ends, at + RUN_TOKENS, "right")))
        yield slice(low, high), slice(at, int(ends[high - 1]))
        low, at = high, int(ends[high - 1])


def _estimates(row: dict, chunk: _Chunk, order: int, size: int, types: int, less: int) -> Iterator[_Run]:
    totals = [_unpack(t).astype(np.int64) for t in row["totals"]]
    for texts, tokens in _runs(chunk.lengths):
        count = [t[i[tokens]] for t, i in zip(totals, chunk.inverse)]
        lengths = chunk.lengths[texts]
        first = np.cumsum(lengths) - lengths
        p = [np.full(len(count[0]), 1 / (types + 1)), np.maximum(count[0] - less, 0) / max(1, size - less)]
        context = np.zeros(len(count[0]), np.int64)
        for n in range(1, order):
            context[1:] = count[n - 1][:-1]  # what ends one token earlier
            context[first] = row["begins"]
            p.append(np.where(context > less, np.maximum(count[n] - less, 0) / np.maximum(context - less, 1), 0.0))
        seen = np.maximum(context - less, 0)
        bucket = np.where(seen > 0, np.log2(np.maximum(seen, 1)).astype(np.int64) + 1, 0)
        yield _Run(texts, tokens, count[0], p, bucket)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.Schema]]:
    """One row at a time, since a chunk is big, and the schema."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0], batch.schema


def _levels(p: np.ndarray) -> np.ndarray:
    """Estimates in quarter octaves; 0 for none."""
    return np.where(p > 0, np.clip(np.floor(4 * np.log2(np.maximum(p, 1e-30))) + 400, 1, 400), 0).astype(np.int64)


def _held_out_cells(joined: DataFrame, order: int, size: int, types: int) -> DataFrame:
    """Counts of training tokens by bucket and estimates, each token deleted from the counts."""

    def run(batches: Iterator[pa.RecordBatch]):
        for row, _ in _rows(batches):
            chunk, found = _Chunk(row, order), []
            for e in _estimates(row, chunk, order, size, types, 1):
                use = chunk.learned[e.tokens]
                cell = e.bucket[use]
                for p in e.p[1:]:
                    cell = cell * 401 + _levels(p[use])
                cells, at = np.unique(cell, return_inverse=True)
                found.append((cells, [np.bincount(at, minlength=len(cells))] + [np.bincount(at, p[use], len(cells)) for p in e.p[1:]]))
            cells, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            n, *sums = (np.bincount(at, np.concatenate(x), len(cells)) for x in zip(*(x for _, x in found)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells), pa.array(n.astype(np.int64)), pa.array(list(np.stack(sums, 1)), pa.list_(pa.float64()))],
                ["cell", "n", "sums"],
            )

    parts = joined.mapInArrow(run, "cell long, n long, sums array<double>")
    return parts.groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(order)))


def _mixture(cells: pa.Table, order: int, types: int, rounds: int = 60) -> np.ndarray:
    """Weights by bucket and order, by expectation-maximisation; rarer buckets back buckets up."""
    weights = np.zeros((64, order + 1))
    weights[:] = 1 / (order + 1)
    weights[0, 2:] = 0
    weights[0] /= weights[0].sum()
    if not cells.num_rows:
        weights[:] = 0
        weights[:, 0] = 1
        return weights
    n = cells["n"].to_numpy().astype(float)
    p = np.stack([np.full(len(n), 1 / (types + 1))] + [cells[f"s{i}"].to_numpy() / n for i in range(order)], 1)
    bucket = cells["cell"].to_numpy() // 401**order
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / share.sum(1))[:, None]
        mass = np.stack([np.bincount(bucket, share[:, i], 64) for i in range(order + 1)], 1)
        weights = np.where(mass.sum(1, keepdims=True) > 0, mass, weights)
        weights /= weights.sum(1, keepdims=True)
    # Every estimate may be 0 but the uniform one.
    weights[:, 0] = np.maximum(weights[:, 0], 1e-6)
    return weights / weights.sum(1, keepdims=True)


def _scored(joined: DataFrame, order: int, size: int, types: int, weights: np.ndarray, doc: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for row, kinds in _rows(batches):
            chunk = _Chunk(row, order)
            for e in _estimates(row, chunk, order, size, types, 0):
                p = sum(weights[e.bucket, i] * e.p[i] for i in range(order + 1))
                text = chunk.text[e.tokens] - e.texts.start
                texts = e.texts.stop - e.texts.start
                base = np.log10((e.unigram + 1) / (size + types + 1))
                per_text = lambda x: np.bincount(text, x, texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"][e.texts], kinds.field("ids").type.value_type),
                        pa.array(row["held"][e.texts], pa.bool_()),
                        pa.array(chunk.lengths[e.texts]),
                        pa.array(per_text(e.unigram > 0).astype(np.int64)),
                        pa.array(np.full(texts, size, np.int64)),
                        pa.array(per_text(base)),
                        pa.array(per_text(np.log10(p))),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return joined.mapInArrow(
        run,
        f"doc_id {doc}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def score_language(docs: DataFrame, held_out, order: int = 2) -> DataFrame:
    """Score ``docs`` (doc_id, text) by an n-gram model of those for which ``held_out`` is false.

    Tokens are the words between ASCII white space, A-Z in lower case, and one end. Texts are
    handled in chunks of about two million tokens. A chunk sends its distinct n-grams with
    their counts, split by ranges of their hashes, and gets the counts over all chunks back
    in the same order; an n-gram of every text is one entry of each chunk, so no key is hot.

    The probability of a token mixes the maximum-likelihood estimates of each order, and a
    uniform one over the known words and one unknown. The weights depend on how often the
    context was seen, by powers of two. They are learned by expectation-maximisation on all
    training tokens, each held out of the counts it is predicted by (deleted estimation), summed
    in quarter-octave cells of the estimates.

    Null texts count as empty and have the end alone. Each input row gives one row, repeated
    rows count each; other columns are ignored. Without training tokens all scores are 0.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    doc = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    chunks = stage(_chunks(rows), "lm-chunks")
    tokens = chunks.agg(F.sum("n")).first()[0] or 0
    parts = int(max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-tokens // PART_KEYS)))
    totals = stage(_total_counts(_partial_counts(chunks, order, parts)), "lm-totals")
    size, types = totals.where("order = 0").agg(F.sum("tokens"), F.sum("known")).first()
    size, types = int(size or 0), int(types or 0)
    begins = chunks.select(F.explode("held").alias("held")).where("not held").count()
    joined = stage(
        _with_totals(chunks, totals, order).withColumn("begins", F.lit(begins).cast("long")), "lm-joined"
    )
    weights = _mixture(_held_out_cells(joined, order, size, types).toArrow(), order, types)
    return _scored(joined, order, size, types, weights, doc)


def every_seventh():
    """Rows that are held out: crc32 of the id as text, modulo 7, is 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
