"""Token ids of documents in grammar-compressed binary files with random access."""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickertide.llm.words import NON_SPACE, byte_class, ragged, split_words

SHARD_IDS = 1 << 18
LEAST_COUNT = 8
SPAN = 20
BUCKET_BITS = 17
SLOT_BITS = 20
CACHE_UNITS = 1_500_000
ROWS = 2_000
MAGIC = b"TTRP0001"
_HEADER = struct.Struct("<8sIIIIIIQ")

#: Bytes of the letters A-Z, a-z and U+00C0 to U+024F, and the pairs among them that are none
#: (the signs for times and divided by) or turn into two characters in lower case.
_LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xBF), (0xC3, 0xC9))
_NOT_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))

_FILES = "part int, number int, before long, ids long, payload binary"
_DOCUMENTS = "part int, doc_id long, inside long, n_tokens long, ids_crc32 long, shard int, n_symbols long"


# --- encoding --------------------------------------------------------------------


class _Known:
    """Runs of ids by hash. A direct-address table answers for most hashes, a sorted list for the rest."""

    def __init__(self):
        self.slot_key, self.slot_run = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)
        self.keys, self.runs = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray, learn) -> np.ndarray:
        """Of each hash the number of its run. ``learn`` gets the places of new hashes, each once, and
        returns their ids, one run after the other, and the lengths of the runs."""
        slot = self._slot(keys)
        runs = self.slot_run[slot]
        other = np.flatnonzero(self.slot_key[slot] != keys)
        if not len(other):
            return runs
        unique, first, inverse = np.unique(keys[other], return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        inside = at < len(self.keys)
        new = np.ones(len(unique), bool)
        new[inside] = self.keys[at[inside]] != unique[inside]
        found = np.empty(len(unique), np.int32)
        found[~new] = self.runs[at[~new]]
        if new.any():
            ids, length = learn(other[first[new]])
            found[new] = np.arange(len(self.start), len(self.start) + len(length))
            self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(length) - length))
            self.length = np.concatenate((self.length, length))
            self.ids = np.concatenate((self.ids, ids))
            self.keys = np.insert(self.keys, at[new], unique[new])
            self.runs = np.insert(self.runs, at[new], found[new])
        slot = self._slot(unique)
        self.slot_key[slot], self.slot_run[slot] = unique, found
        runs[other] = found[inverse]
        return runs

    def spell(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = self.length[runs]
        return self.ids[ragged(self.start[runs], length)], length


class _WordEncoder:
    """Token ids of texts, for BPE that lower-cases, drops white space and ends each word with a token of its own.

    No token then crosses white space, so each word is encoded once and kept, up to
    ``CACHE_UNITS`` words. In words of ASCII and Latin letters up to U+024F, letters and other
    signs never share a token either (apostrophes and added tokens aside): those words are put
    together from their parts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Lowercase()
        bytes_as_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_as_letters])
        vocabulary, suffix = self.whole.get_vocab(), self.whole.model.end_of_word_suffix
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.careful = byte_class((0x27, 0x27), (0xC2, 0xC2), (0xCA, 0xFF))
        for token in self.whole.get_added_tokens_decoder().values():
            self.careful[token.content.encode()[0]] = True
        self.words, self.parts = _Known(), _Known()

    def _encode_whole(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.whole.encode_batch_fast(units, add_special_tokens=False)]
        length = np.array([len(ids) for ids in found], np.int64)
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(length.sum())), length

    def _encode_letters(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = [" ".join(units[at : at + 50]) for at in range(0, len(units), 50)]
        found = [np.array(e.ids, np.uint32) for e in self.letters.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        return ids, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)

    def _learn_words(self, words):
        def learn(at: np.ndarray):
            column, counts = _strings(words, at)
            careful = self.careful[counts.data]
            for lead, second in _NOT_LETTERS:
                careful[:-1] |= (counts.data[:-1] == lead) & (counts.data[1:] == second)
            careful = np.diff(np.concatenate(([0], np.cumsum(careful)))[counts.offset]) > 0
            odd_ids, odd_length = self._encode_whole(column.filter(pa.array(careful)).to_pylist())
            plain = column.filter(pa.array(~careful))
            letters, others = split_words(plain, _LETTERS, True), split_words(plain, ~_LETTERS, False)
            order = np.argsort(np.concatenate((letters.start, others.start)), kind="stable")
            run = np.concatenate((
                self.parts.find(letters.hash, lambda a: self._encode_letters(_strings(letters, a, fold=True)[0].to_pylist())),
                self.parts.find(others.hash, lambda a: self._encode_whole(_strings(others, a)[0].to_pylist())),
            ))[order]
            plain_ids, length = self.parts.spell(run)
            word = np.concatenate((letters.text, others.text))[order]
            plain_length = np.bincount(word, length, minlength=len(plain)).astype(np.int64)
            lengths = np.empty(len(at), np.int64)
            lengths[careful], lengths[~careful] = odd_length, plain_length
            ids = np.empty(int(lengths.sum()), np.uint32)
            start = np.cumsum(lengths) - lengths
            ids[ragged(start[careful], odd_length)] = odd_ids
            ids[ragged(start[~careful], plain_length)] = plain_ids
            return ids, lengths

        return learn

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column, one after the other, and how many each has."""
        if len(self.words.start) > CACHE_UNITS:
            self.words, self.parts = _Known(), _Known()
        words = split_words(column, NON_SPACE, False)
        ids, length = self.words.spell(self.words.find(words.hash, self._learn_words(words)))
        upto = np.concatenate(([0], np.cumsum(length)))
        return ids, np.diff(upto[words.first])


class _Bytes(NamedTuple):
    data: np.ndarray
    offset: np.ndarray


def _strings(words, at: np.ndarray, fold: bool = False) -> tuple[pa.Array, _Bytes]:
    """Some words of a batch as a string column, and its bytes."""
    size = words.end[at] - words.start[at]
    raw = words.data[ragged(words.start[at], size)].copy()
    if fold:
        raw[(raw >= 65) & (raw <= 90)] += 32
    offset = np.concatenate(([0], np.cumsum(size)))
    column = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offset), pa.py_buffer(raw)])
    return column, _Bytes(raw, offset)


_encoders: dict[str, _WordEncoder] = {}


def _encoder(path: str) -> _WordEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = _WordEncoder(path)
    return _encoders[path]


# --- grammar ---------------------------------------------------------------------


def _bucket(keys: np.ndarray, salt: int) -> np.ndarray:
    odd = np.uint64(0x9E3779B97F4A7C15 + 2 * salt)
    return (keys.view(np.uint64) * odd >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _winners(at: np.ndarray, number: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Of overlapping places those of the more frequent pair; in runs of one pair every other."""
    rank = np.empty(len(counts), np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
    mine = 2 * rank[number] + (at & 1).astype(np.int32)
    score = np.full(n + 2, -1, np.int32)
    score[at + 1] = mine
    return (mine > score[at]) & (mine > score[at + 2])


def repair(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST_COUNT):
    """Replace frequent pairs of neighbours by new symbols until no pair occurs ``least`` times.

    ``ends`` are the ends of the documents in ``ids``; no pair crosses one. A round counts the
    pairs by direct address: each bucket counts one of its pairs exactly, others wait for a
    round with another hash. Pairs at least a ``SPAN``-th as frequent as the most frequent one
    are replaced. Only places whose pair may still become frequent are looked at again.
    Returns the symbols, the documents' ends in them, and the rules (left, right) by round;
    the r-th rule makes the symbol ``base + r``.
    """
    symbols = ids.astype(np.int32)
    closing = np.zeros(len(ids), bool)
    closing[ends - 1] = True
    live = np.flatnonzero(~closing[:-1])
    rules: list[np.ndarray] = []
    made = 0
    holder = np.zeros(1 << BUCKET_BITS, np.int64)
    for salt in itertools.count():
        key = (symbols[live].astype(np.int64) << 32) | symbols[live + 1]
        bucket = _bucket(key, salt)
        enough = np.flatnonzero(np.bincount(bucket, minlength=len(holder))[bucket] >= least)
        live, key, bucket = live[enough], key[enough], bucket[enough]
        if not len(live):
            break
        holder[bucket] = key
        held = holder[bucket] == key
        counts = np.bincount(bucket[held], minlength=len(holder))
        floor = max(least, int(counts.max()) // SPAN)
        chosen = np.flatnonzero(counts >= floor)
        if len(chosen):
            number = np.full(len(holder), -1, np.int32)
            number[chosen] = np.arange(len(chosen), dtype=np.int32)
            number = number[bucket]
            number[~held] = -1
            pairs, counts = holder[chosen], counts[chosen]
        else:  # no held pair is frequent: look at all of them
            pairs, number, counts = np.unique(key, return_inverse=True, return_counts=True)
            live, number = live[counts[number] >= least], number[counts[number] >= least]
            if not len(live):
                break
        some = np.flatnonzero(number >= 0)
        at, number = live[some], number[some]
        won = _winners(at, number, counts, len(symbols))
        place, number = at[won], number[won]
        wins = np.bincount(number, minlength=len(counts)) > 0
        used = np.flatnonzero(wins)
        symbols[place] = base + made - 1 + np.cumsum(wins, dtype=np.int32)[number]
        closing[place] = closing[place + 1]
        gone = np.zeros(len(symbols), bool)
        gone[place + 1] = True
        alive = np.zeros(len(symbols), bool)
        alive[live] = alive[place] = True
        before = place[place > 0] - 1
        alive[np.where(gone[before], before - 1, before)] = True  # a new symbol is their right neighbour
        alive &= ~closing
        symbols, closing, alive = symbols[~gone], closing[~gone], alive[~gone]
        live = np.flatnonzero(alive)
        rules.append(np.stack((pairs[used] >> 32, pairs[used] & 0xFFFFFFFF)))
        made += len(used)
    return symbols, np.flatnonzero(closing) + 1, rules


def pack_shard(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, least: int = LEAST_COUNT) -> bytes:
    """One file: doc ids, the documents' ends in symbols, rules with expansion lengths, symbols."""
    base = int(ids.max(initial=0)) + 1
    symbols, symbol_ends, rules = repair(ids, ends, base, least)
    pairs = np.concatenate(rules, axis=1) if rules else np.zeros((2, 0), np.int64)
    sizes = np.ones(base + pairs.shape[1], np.int64)
    made = base
    for level in rules:
        sizes[made : made + level.shape[1]] = sizes[level[0]] + sizes[level[1]]
        made += level.shape[1]
    wide = 2 if made <= 1 << 16 else 4
    parts = [
        _HEADER.pack(MAGIC, len(doc_ids), base, pairs.shape[1], len(rules), wide, len(symbols), len(ids)),
        np.array([0 if d is None else d for d in doc_ids], "<i8"),
        np.array([d is None for d in doc_ids], "u1"),
        symbol_ends.astype("<u4"),
        np.array([level.shape[1] for level in rules], "<u4"),
        pairs.astype("<u4"),
        sizes[base:].astype("<u4"),
        symbols.astype(f"<u{wide}"),
    ]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


class Shard:
    """A file of ``pack_shard``, opened. Expansion lengths lead to any token without decoding the rest."""

    def __init__(self, payload: bytes):
        magic, docs, self.base, n_rules, n_levels, wide, n_symbols, self.n_ids = _HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self._at, self._payload = _HEADER.size, payload
        doc_ids, absent = self._take("<i8", docs), self._take("u1", docs)
        self.doc_ids = [None if a else int(d) for d, a in zip(doc_ids, absent)]
        self.symbol_ends = self._take("<u4", docs).astype(np.int64)
        levels = self._take("<u4", n_levels)
        self.left, self.right = self._take("<u4", 2 * n_rules).reshape(2, -1).astype(np.int64)
        self.sizes = np.concatenate((np.ones(self.base, np.int64), self._take("<u4", n_rules)))
        self.symbols = self._take(f"<u{wide}", n_symbols).astype(np.int64)
        #: The ids that lie before each symbol, and all of them at last.
        self.upto = np.concatenate(([0], np.cumsum(self.sizes[self.symbols])))
        self._expand_rules(levels)

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._payload, kind, n, self._at)
        self._at += out.nbytes
        return out

    def _expand_rules(self, levels: np.ndarray) -> None:
        """The expansion of every symbol as a run of ``flat``; a round only uses earlier ones."""
        self.start = np.concatenate((np.arange(self.base), self.base + np.cumsum(self.sizes[self.base :]) - self.sizes[self.base :]))
        self.flat = np.empty(int(self.base + self.sizes[self.base :].sum()), np.uint32)
        self.flat[: self.base] = np.arange(self.base)
        done = 0
        for count in levels:
            both = np.stack((self.left[done : done + count], self.right[done : done + count]), axis=1).ravel()
            low = self.start[self.base + done]
            part = self.flat[ragged(self.start[both], self.sizes[both])]
            self.flat[low : low + len(part)] = part
            done += int(count)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.start[symbols], self.sizes[symbols])]

    def starts(self) -> np.ndarray:
        """Of each document the ids of the shard that lie before it; all of them at last."""
        return np.concatenate(([0], self.upto[self.symbol_ends]))

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self._expand(self.symbols[self.symbol_ends[k - 1] if k else 0 : self.symbol_ends[k]])

    def between(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop`` of the shard; only the symbols that cover them are expanded."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        low = int(np.searchsorted(self.upto, start, "right")) - 1
        high = int(np.searchsorted(self.upto, stop, "left"))
        return self._expand(self.symbols[low:high])[start - self.upto[low] : stop - self.upto[low]]


# --- tables ----------------------------------------------------------------------


def write_token_files(
    docs: DataFrame, folder: str, path: str, end_id: int, shard_ids: int = SHARD_IDS, least: int = LEAST_COUNT
) -> None:
    """Encode every whole text of ``docs`` (doc_id, text), append ``end_id``, and write the ids below ``folder``.

    ``path`` names a tokenizer that drops white space. Documents are dealt into ranges of
    doc_id and cut into shards of at least ``shard_ids`` ids (the last of a range may have less; no document is cut).
    Each shard is Re-Pair compressed by itself and becomes one row of a Parquet table, whose
    committer makes the write safe against lost executors: part and number give its place,
    ``before`` the ids of the part before it, ``payload`` the file.

    A null or empty text is its end id alone. Rows without doc_id come first; rows that share
    one are ordered by a hash of the text, which also splits an id that many rows
    share over several ranges. Other columns are ignored; an empty table gives no file.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    slim = slim.withColumn("digest", F.xxhash64("text"))
    order = ["doc_id", "digest"]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, found, sizes, total = [], [], [], 0

        def close():
            ids = np.concatenate(found)
            payload = pack_shard(doc_ids, ids, np.cumsum(sizes), least)
            row = [[part], [number], [before], [len(ids)], [payload]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=_names(_FILES))

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                rows = batch.slice(low, ROWS)
                ids, length = _encoder(path).encode(rows["text"])
                at = 0
                for doc_id, n in zip(rows["doc_id"].to_pylist(), length.tolist()):
                    doc_ids.append(doc_id)
                    found += [ids[at : at + n], end]
                    sizes.append(n + 1)
                    at, total = at + n, total + n + 1
                    if total >= shard_ids:
                        yield close()
                        number, before = number + 1, before + total
                        doc_ids, found, sizes, total = [], [], [], 0
        if doc_ids:
            yield close()

    ranged.mapInArrow(run, _FILES).write.option("compression", "zstd").parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the files below ``folder``, decoded shard by shard.

    Returns doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard (its
    number within its part), part, and n_symbols (symbols that stand for it).
    """
    files = spark.read.schema(_FILES).parquet(folder)
    sums = files.groupBy("part").agg(F.sum("ids").alias("ids"))
    before = F.coalesce(F.expr("sum(ids) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    # One row for each range of the writing shuffle.
    offsets = F.broadcast(sums.select("part", before.alias("part_start")))
    decoded = files.select("part", "number", "before", "payload").mapInArrow(_decode, _DOCUMENTS)
    return decoded.join(offsets, "part").select(
        "doc_id",
        (F.col("part_start") + F.col("inside")).alias("start"),
        "n_tokens",
        "ids_crc32",
        "shard",
        "part",
        "n_symbols",
    )


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            part, number, before, payload = (batch[c][row].as_py() for c in ("part", "number", "before", "payload"))
            shard = Shard(payload)
            n, starts = len(shard.doc_ids), shard.starts()
            ids = memoryview(shard.between(0, shard.n_ids).astype("<u4").view(np.uint8))
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), starts[1:].tolist())]
            columns = [
                pa.array(np.full(n, part, np.int32)),
                pa.array(shard.doc_ids, pa.int64()),
                pa.array(before + starts[:-1]),
                pa.array(np.diff(starts)),
                pa.array(crc, pa.int64()),
                pa.array(np.full(n, number, np.int32)),
                pa.array(np.diff(shard.symbol_ends, prepend=0)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=_names(_DOCUMENTS))


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]
