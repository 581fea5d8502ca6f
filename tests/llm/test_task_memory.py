"""What one task holds at once."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tickertide.llm import language_model as lm
from tickertide.llm import packing, phrases
from tickertide.llm.queries import tokenizer_path

RANDOM = np.random.default_rng(5)


class Frame:
    """Stands for a table: gives back the function that a task runs."""

    def mapInArrow(self, run, schema):
        return run


def peak(batches) -> tuple[int, list[pa.RecordBatch]]:
    tracemalloc.start()
    try:
        found = list(batches)
        return tracemalloc.get_traced_memory()[1], found
    finally:
        tracemalloc.stop()


def test_scores_of_a_chunk_take_little_room():
    tokens, texts = 600_000, 600
    words = lm.mix(np.arange(50_000, dtype=np.uint64))
    place = RANDOM.integers(0, len(words), tokens)
    place[: len(words)] = np.arange(len(words))
    row = {
        "ids": list(range(texts)),
        "held": [False] * texts,
        "lengths": [tokens // texts] * texts,
        "words": lm._pack(words),
        "tokens": lm._pack(place),
        "begins": texts,
    }
    chunk = lm._Chunk(row, 2)
    row["totals"] = [lm._pack(chunk.counts(n)) for n in range(2)]
    batch = pa.RecordBatch.from_pylist([row])
    run = lm._scored(Frame(), 2, tokens, len(words), np.full((64, 3), 1 / 3), "bigint")
    taken, found = peak(run(iter([batch])))
    rows = pa.Table.from_batches(found)
    assert rows["doc_id"].to_pylist() == row["ids"]
    assert set(rows["n_known"].to_pylist()) == {tokens // texts}
    # The first text, token by token.
    seen = np.bincount(place, minlength=len(words))
    base = np.log10((seen[place[: tokens // texts]] + 1) / (tokens + len(words) + 1)).sum()
    assert np.isclose(rows["base_score"][0].as_py(), base)
    assert taken < 85 * tokens  # 63 bytes a token; 110 with whole-chunk estimates


def test_pairs_leave_in_small_batches():
    texts, length = 2000, 500
    ids = RANDOM.integers(0, 40_000, (texts, length)).astype("<i4")
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in ids], pa.binary())], ["ids"])
    known = [SimpleNamespace(value=phrases._Ranks(np.zeros(0, np.uint64), np.zeros(0, np.int32), None))]
    taken, found = peak(phrases._count_pairs(known)(iter([batch])))
    counts = pa.Table.from_batches(found)
    assert sum(counts["n"].to_pylist()) == texts * (length - 1)
    assert max(b.num_rows for b in found) <= 1 << 16  # all of them in one before
    assert taken < 85 * texts * length  # 68 bytes a pair; 104 before


def test_units_of_a_batch_are_encoded_a_few_at_once(monkeypatch):
    """The packing's encoder, with far more new units than it may encode at once."""
    path = tokenizer_path()
    encoder = packing._Encoder(path)
    seen = []
    tokenizer = encoder.tokenizer

    class Counting:
        def __getattr__(self, name):
            return getattr(tokenizer, name)

        def encode_batch_fast(self, texts, **options):
            seen.append(sum(len(t.split()) for t in texts))
            return tokenizer.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counting()
    texts = [" ".join(f"w{i}k{j}" for j in range(100)) for i in range(600)]
    found = list(encoder.encode(pa.array(texts)))
    assert max(seen) <= packing.AT_ONCE * 500 < sum(seen)
    for at in (0, 17, 599):
        assert found[at].tolist() == tokenizer.encode(texts[at], add_special_tokens=False).ids
    assert packing.CACHE_UNITS <= 500_000
