"""Token sequences packed best-fit decreasing, with lower bounds that certify each cell."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tickertide.llm.tables import stage
from tickertide.llm.words import NON_SPACE, ragged, slices, split_words

CACHE_UNITS = 400_000
AT_ONCE = 50  # joined texts of 500 units that are encoded at once
CELL_ITEMS = 10_000
POOL = 8  # cells of pieces in a cell of bins that are exchanged
IDLE = 2  # rounds of exchange that save no bin, before it ends
#: White space outside of ASCII, next to which a text can't be cut without care.
WIDE_SPACE = "[\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


class _Encoder:
    """Token ids of whole texts.

    No token of a byte-level BPE with this pre-tokenizer spans the end of a word and the
    space after it. So each word, with the space before it, is encoded once and kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A token of the vocabulary is written with one character for each byte.
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, at in self.tokenizer.get_vocab().items():
            self.bytes_of[at] = len(token)
        self._forget()

    def _forget(self):
        self.known, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, hashes: np.ndarray, units: list[bytes]):
        """Encode new units; those that begin with a space and end with a word in one go."""
        plain = np.array([u[0] in _SPACES and u[-1] not in _SPACES for u in units])
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        joined = int(plain.sum())
        texts = [b"".join(units[i] for i in order[a : min(a + 500, joined)]).decode() for a in range(0, joined, 500)]
        found = [
            np.array(e.ids, np.uint32)
            for a in range(0, len(texts), AT_ONCE)
            for e in self.tokenizer.encode_batch_fast(texts[a : a + AT_ONCE], add_special_tokens=False)
        ]
        ids = np.concatenate([*found, np.zeros(0, np.uint32)])
        upto = np.cumsum(self.bytes_of[ids])
        sizes = np.cumsum([len(units[i]) for i in order[:joined]])
        ends = np.searchsorted(upto, sizes) + 1
        alone = [self._one(units[i].decode()) for i in order[joined:]]
        ends = np.concatenate((ends, len(ids) + np.cumsum(list(map(len, alone))))).astype(np.int64)
        length = np.diff(ends, prepend=0)
        known = np.concatenate((self.known, hashes[order]))
        start = np.concatenate((self.start, ends - length + len(self.ids)))
        length = np.concatenate((self.length, length))
        sort = np.argsort(known)
        self.known, self.start, self.length = known[sort], start[sort], length[sort]
        self.ids = np.concatenate((self.ids, ids, *alone))

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column; null is empty."""
        column = pc.fill_null(column, "")
        careful = pc.match_substring_regex(column, WIDE_SPACE).to_numpy(zero_copy_only=False).copy()
        if careful.any():
            units = split_words(pc.if_else(pa.array(careful), "", column), NON_SPACE, False, True)
        else:
            units = split_words(column, NON_SPACE, False, True)
        unique, first, inverse = np.unique(units.hash, return_index=True, return_inverse=True)
        if len(unique) > CACHE_UNITS:
            careful[:] = True
        else:
            if len(unique) + len(self.known) > CACHE_UNITS:
                self._forget()
            new = first[~np.isin(unique, self.known, assume_unique=True)]
            if len(new):
                raw = [units.data[a:b].tobytes() for a, b in zip(units.start[new], units.end[new])]
                self._learn(units.hash[new], raw)
            place = np.searchsorted(self.known, unique)
        for low in range(0, len(column), 100):
            high = min(len(column), low + 100)
            if not careful[low:high].all():
                at = place[inverse[units.first[low] : units.first[high]]]
                flat = self.ids[ragged(self.start[at], self.length[at])]
                ends = np.concatenate(([0], np.cumsum(self.length[at])))[units.first[low : high + 1] - units.first[low]]
            for text in range(low, high):
                if careful[text]:
                    yield self._one(column[text].as_py())
                else:
                    yield flat[ends[text - low] : ends[text - low + 1]]


_SPACES = frozenset(b" \t\n\v\f\r")
_encoders: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """The token sequence of each document (doc_id, text), cut from its end into pieces of ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]):
        for part in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for at, ids in enumerate(encoder(path).encode(part["text"])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                edges = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    row.append(at)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    doc = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {doc}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. The open bins are kept by free space, and a bit mask of
    the free spaces in use gives the tightest that fits."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fits = mask >> size
        if fits:
            space = size + ((fits & -fits).bit_length() - 1)
            at = free[space].pop()
            if not free[space]:
                mask &= ~(1 << space)
        else:
            space, at, opened = capacity, opened, opened + 1
        bins[item], offsets[item] = at, capacity - space
        if space > size:
            free[space - size].append(at)
            mask |= 1 << (space - size)
    return bins, offsets


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """The most of the bounds by dual feasible functions; ``count`` holds how many items there are
    of each length from 0 to ``capacity``.

    The first family, for each a up to half the capacity: an item above ``capacity - a``
    counts as a whole bin, one below a as none, the rest as their length. The second, for
    k = 1 to 20: lengths are rounded to multiples of 1/k, exact multiples of 1/(k + 1) kept.
    """
    size = np.arange(capacity + 1)
    number, total = np.cumsum(count), np.cumsum(count * size)
    a = np.arange(capacity // 2 + 1)
    whole = number[-1] - number[capacity - a]
    rest = total[capacity - a] - np.where(a > 0, total[np.maximum(a - 1, 0)], 0)
    best = int((whole - (-rest // capacity)).max())
    for k in range(1, 21):
        exact = (k + 1) * size % capacity == 0
        value = np.where(exact, size * k, (k + 1) * size // capacity * capacity)  # of k * capacity
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def _cell_packer(capacity: int, again: bool, columns: list[str]):
    def pack(cell: pa.Table) -> pa.Table:
        lengths, place = cell["length"].to_numpy().astype(np.int64), cell["place"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        if again:
            held = np.unique(cell["sequence_id"].to_numpy(), return_inverse=True)[1]
            if bins.max() >= held.max():  # the exchange gained nothing
                bins, offsets = held, cell["offset"].to_numpy()
        # A bin is named by the least place of its pieces, so no two bins share a name.
        name = np.full(bins.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(name, bins, place)
        filled = np.bincount(bins, weights=lengths)[bins]
        gap = len(name) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        # A cell at its bound is certified, and only bins that are not half full go on, to share
        # with those of other cells; of a cell above its bound, all bins with room do.
        goes_on = (filled < capacity - capacity // 64) & (gap > 0) | (filled * 8 < capacity * 7)
        out = {c: cell[c] for c in columns}
        out |= {
            "place": cell["place"],
            "sequence_id": pa.array(name[bins]),
            "offset": pa.array(offsets.astype(np.int64)),
            "open": pa.array(goes_on),
        }
        return pa.table(out)

    return pack


def pack_sequences(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    cell_items: int = CELL_ITEMS,
) -> DataFrame:
    """Pack the token sequences of ``docs`` (doc_id, text) into few bins of ``capacity`` tokens.

    A document is the ids of its whole text (null: empty) and ``end_id``. Only a longer one
    is cut, into full pieces after a first one that may be shorter. A full piece is a bin of
    its own. The other pieces are dealt at random into cells of about ``cell_items``, and each
    cell is packed best-fit decreasing. Lower bounds from dual feasible functions certify a
    cell whose bins reach them. The bins with room (over 1/64) of all other cells, and bins not half
    full, are exchanged: dealt anew into cells of POOL x ``cell_items``, in which bins of many
    cells meet, and packed again; a cell that doesn't save a bin keeps what it had. The exchange
    ends when all bins together reach the bound of the whole table, or IDLE rounds save none, or a
    single cell held all that is open. Every input row is packed, also repeated ones; other
    columns are ignored; an empty table gives no rows.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and least_sequences, the
    bound of the whole table: no packing has fewer sequences.
    """
    pieces = stage(
        token_pieces(docs, tokenizer_path, capacity, end_id).withColumn("place", F.monotonically_increasing_id()),
        "pack-pieces",
    )
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    none = F.lit(0).cast("long")
    whole = F.col("length") == capacity
    full = pieces.where(whole).select(*columns, F.col("place").alias("sequence_id"), none.alias("offset"))
    count = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most one row for each length
        count[length] = n
    bound, items = lower_bound(count, capacity), int(count[:capacity].sum())
    doc = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {doc}, piece int, start long, length long, ids_crc32 long, "
        "place long, sequence_id long, offset long, open boolean"
    )
    going = pieces.where(~whole).select(*columns, "place", F.col("place").alias("sequence_id"), none.alias("offset"))
    done, closed, level, idle, before = [full], int(count[capacity]), 0, 0, None
    while items:
        cells = -(-items // (cell_items * (POOL if level else 1)))
        # A bin moves as a whole; its first piece stands for it when bins are counted.
        cell = F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(cells))
        packed = stage(
            going.withColumn("cell", cell).groupBy("cell").applyInArrow(
                _cell_packer(capacity, level > 0, columns), schema
            ),
            "pack-cells",
        )
        shut, first = ~F.col("open"), F.col("offset") == 0
        bins, closing, items = packed.agg(
            F.count(F.when(first, 1)), F.count(F.when(first & shut, 1)), F.count(F.when(~shut, 1))
        ).first()
        idle = idle + 1 if bins == before else 0
        if cells == 1 or closed + bins == bound or idle == IDLE:
            done.append(packed.select(*columns, "sequence_id", "offset"))
            break
        done.append(packed.where(shut).select(*columns, "sequence_id", "offset"))
        going, level, closed, before = packed.where(~shut).drop("open"), level + 1, closed + closing, bins - closing
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.withColumn("least_sequences", F.lit(bound).cast("long"))
