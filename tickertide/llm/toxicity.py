"""Toxic texts by a subsequence string kernel, Nystrom landmarks and a linear SVM."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickertide.llm.words import NON_SPACE, gram_hashes, mix, ragged, slices, split_words

LETTERS = 32  # 0 none, 1-26 a-z, 27-30 other letters, 31 the begin of a word
PIECE = 24  # longer words are seen through overlapping pieces of so many letters
REACH = 8  # letters that a subsequence may span
DECAY = 0.6  # for each letter it skips
CACHE_WORDS = 500_000
CELLS = 500_000  # words x subsequences that are in memory at once

_LETTER = np.zeros(256, np.int64)
_LETTER[65:91] = _LETTER[97:123] = np.arange(1, 27)
_LETTER[0x80:0xC0] = 27 + np.arange(64) % 4  # the last bytes of a character tell letters apart


@cache
def _triples(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places i < j < k of the three-letter subsequences of a word, and their weights."""
    found = [
        (i, j, k)
        for i in range(length)
        for k in range(i + 2, min(length, i + REACH))
        for j in range(i + 1, k)
    ]
    i, j, k = np.array(found, np.int64).reshape(-1, 3).T
    return i, j, k, DECAY ** (k - i - 2.0)


class _Spelled(NamedTuple):
    """Letters of words by length: (index of the word, matrix of letters)."""

    groups: list[tuple[np.ndarray, np.ndarray]]
    count: int


def spell(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> _Spelled:
    """The letters of byte spans, with a mark for the begin; other bytes are skipped."""
    at = np.repeat(np.arange(len(start)), end - start)
    letters = _LETTER[data[ragged(start, end - start)]]
    keep = letters > 0
    at, letters = at[keep], letters[keep]
    length = np.bincount(at, minlength=len(start))
    first = np.cumsum(length) - length
    groups: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for n in np.unique(length[length >= 3]):
        own = np.flatnonzero(length == n)
        rows = letters[first[own][:, None] + np.arange(n)]
        rows = np.concatenate((np.full((len(own), 1), 31), rows), axis=1)
        for a in range(0, max(1, n + 1 - PIECE // 2), PIECE // 2) if n + 1 > PIECE else (0,):
            part = rows[:, a : a + PIECE]
            if part.shape[1] >= 3:
                groups.setdefault(part.shape[1], []).append((own, part))
    merged = [
        (np.concatenate([x[0] for x in g]), np.concatenate([x[1] for x in g])) for g in groups.values()
    ]
    return _Spelled(merged, len(start))


def subsequences(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (words x subsequences) and their weights."""
    i, j, k, weight = _triples(letters.shape[1])
    return (letters[:, i] * LETTERS + letters[:, j]) * LETTERS + letters[:, k], weight


def self_kernel(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """K(x, x): equal subsequences of a word are added before they are squared."""
    order = np.argsort(codes, axis=1)
    codes = np.take_along_axis(codes, order, 1)
    begins = np.ones(codes.shape, bool)
    begins[:, 1:] = codes[:, 1:] != codes[:, :-1]
    at = np.flatnonzero(begins)
    sums = np.add.reduceat(weight[order].ravel(), at)
    return np.bincount(at // codes.shape[1], sums**2, minlength=len(codes))


def against(spelled: _Spelled, table: np.ndarray, empty: float = 0.0) -> np.ndarray:
    """Per word, its normalised feature vector times ``table`` (codes, or codes x columns).

    A word seen in pieces takes the largest value of each column; one of fewer than three
    letters has ``empty``.
    """
    out = np.full((spelled.count, *table.shape[1:]), -np.inf)
    for own, letters in spelled.groups:
        step = max(1, CELLS // len(_triples(letters.shape[1])[0]))
        for a in range(0, len(own), step):
            codes, weight = subsequences(letters[a : a + step])
            norm = np.sqrt(self_kernel(codes, weight))
            if table.ndim == 1:
                value = (table[codes] @ weight) / norm
            else:
                value = np.zeros((len(codes), table.shape[1]))
                for column in range(codes.shape[1]):
                    value += table[codes[:, column]] * weight[column]
                value /= norm[:, None]
            np.maximum.at(out, own[a : a + step], value)
    return np.where(np.isinf(out), empty, out)


def word_vectors(spelled: _Spelled) -> np.ndarray:
    """Dense normalised feature vectors, for a few words."""
    out = np.zeros((spelled.count, LETTERS**3))
    for own, letters in spelled.groups:
        codes, weight = subsequences(letters)
        for row, at in enumerate(own):
            np.add.at(out[at], codes[row], weight)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class Model(NamedTuple):
    """Decision value of a word: weights of subsequences, bias; slope and offset of the score."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    name: int


def _units(words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and runs of three or more single letters as words of their own ("i d i o t")."""
    text, start, end, key = words.text, words.start, words.end, words.hash
    single = (end - start == 1) & (_LETTER[words.data[start]] > 0) if len(start) else np.zeros(0, bool)
    joined = np.zeros(len(start), bool)
    joined[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1])
    begin = np.flatnonzero(~joined & single)
    stop = np.flatnonzero(single & ~np.append(joined[1:], False))
    long = stop - begin >= 2
    begin, stop = begin[long], stop[long]
    if not len(begin):
        return text, start, end, key
    run = np.concatenate([gram_hashes(key[a : b + 1], b - a + 1) for a, b in zip(begin, stop)])
    order = np.argsort(np.concatenate((text, text[begin])), kind="stable")
    both = (np.concatenate(x)[order] for x in ((text, text[begin]), (start, start[begin]), (end, end[stop]), (key, run)))
    return tuple(both)


def _with_letters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> _Spelled:
    """Two copies of each word, a letter put in after a third and after two thirds of it."""
    made = []
    for part in (1, 2):
        for a, b in zip(start, end):
            cut = a + max(1, (b - a) * part // 3)
            letter = 97 + int(data[a:b].sum() + part * 7) % 26
            made.append(data[a:cut].tobytes() + bytes([letter]) + data[cut:b].tobytes())
    stop = np.cumsum([len(m) for m in made]).astype(np.int64)
    return spell(np.frombuffer(b"".join(made), np.uint8), stop - np.array([len(m) for m in made]), stop)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton steps; the last weight is the bias."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost[active]
        new = np.linalg.solve(penalty + xa.T @ (xa * ca[:, None]), xa.T @ (ca * y[active]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = 0.5 * w + 0.5 * new if _ > 15 else new
    return w


def _logistic(value: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a score, with the smoothed targets of Platt."""
    up, down = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack((value, np.ones(len(value))), 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(2) * 1e-3, x.T @ (p - target) + 1e-3 * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def _independence(text: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """What a text counts for: near copies of each other, told by equal least hashes, count as one."""
    weight = np.zeros(n)
    for seed in range(8):
        hashed = mix(keys + np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64)))
        least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, text, hashed)
        _, group, size = np.unique(least, return_inverse=True, return_counts=True)
        weight += 1 / size[group] / 8
    return weight


def train(texts: list[str | None], labels: list[int], landmarks: int = 192, negatives: int = 12_000, penalty: float = 10.0) -> Model | None:
    """Learn from whole labelled texts, of which a toxic one has at least one toxic word.

    Words that only toxic texts hold, more often than chance allows, are positive. A toxic text
    without one has its word of the highest decision value for a witness, at a lower cost. Words
    of clean texts are negative: an even draw and the hardest ones. Positive words also count
    with a letter put in. Landmarks are the words of strongest association and the clean ones most like them.
    """
    label = np.array(labels)
    if not (label == 1).any() or not (label == 0).any():
        return None
    words = split_words(pa.array(texts, pa.string()), NON_SPACE)
    text, start, end, key = _units(words)
    unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    pairs = np.unique(text.astype(np.int64) * len(unique) + inverse)
    text, word = pairs // len(unique), pairs % len(unique)
    weight = _independence(text, unique[word], len(label))
    toxic, clean = (
        np.bincount(word, weight[text] * (label[text] == v), minlength=len(unique)) for v in (1, 0)
    )
    bond = np.log((toxic + 0.5) / (weight[label == 1].sum() + 1)) - np.log((clean + 0.5) / (weight[label == 0].sum() + 1))
    spelled = lambda at: spell(words.data, start[first[at]], end[first[at]])
    strong = np.lexsort((unique, -bond))[: landmarks // 3]
    negative = np.flatnonzero(clean > 0)
    drawn = negative[np.argsort(mix(unique[negative]))]
    usual = negative[np.lexsort((unique[negative], -clean[negative]))][: negatives // 3]
    against_set = np.unique(np.concatenate((usual, drawn[:negatives])))
    alike = against(spelled(against_set), word_vectors(spelled(strong)).T).max(1)
    alike += 1e-3 * np.log1p(clean[against_set])
    near = against_set[np.argsort(-alike, kind="stable")[: landmarks - len(strong)]]
    marks = np.concatenate((strong, near))
    base = word_vectors(spelled(marks))
    value, vector = np.linalg.eigh(base @ base.T)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    # Nystrom features of a word: its kernel with the landmarks times the root.
    table = base.T @ root
    del base  # as large as the table
    own = word[(label[text] == 1) & (clean[word] == 0)]
    own_text = text[(label[text] == 1) & (clean[word] == 0)]
    # Toxic beyond chance: so many toxic texts and no clean one, over all words of the sample.
    chance = weight[text][label[text] == 1].sum() / weight[text].sum()
    sure = (clean == 0) & (toxic * -np.log(chance) >= np.log(len(unique)) + 3)
    decided = bond
    for _ in range(3):
        settled = np.zeros(len(label), bool)
        settled[own_text[sure[own]]] = True
        open_ = ~settled[own_text]
        o_word, o_text = own[open_], own_text[open_]
        best = np.lexsort((o_word, decided[o_word], o_text))
        last = best[np.append(o_text[best][1:] != o_text[best][:-1], True)] if len(best) else best
        doubtful = np.unique(o_word[last])
        positive = np.unique(np.concatenate((np.flatnonzero(sure), doubtful)))
        at = np.concatenate((positive, against_set))
        x = against(spelled(at), table)
        bent = against(_with_letters(words.data, start[first[positive]], end[first[positive]]), table)
        x = np.concatenate((x, bent))
        y = np.concatenate((np.ones(len(positive)), -np.ones(len(against_set)), np.ones(len(bent))))
        share = penalty * len(against_set) / max(1, len(positive))
        cost = np.where(y > 0, share, penalty)
        cost[len(positive) : len(at)] *= np.clip(clean[against_set], 1, 20)
        cost[: len(positive)] = np.where(sure[positive], share, share / 20)
        cost[len(at) :] *= np.where(np.tile(sure[positive], 2), 0.25, 0.0)
        w = _svm(x, y, cost)
        weights, bias = table @ w[:-1], float(w[-1])
        decided = against(spelled(np.arange(len(unique))), weights) + bias
        hard = negative[np.argsort(-decided[negative], kind="stable")[: negatives // 8]]
        against_set = np.unique(np.concatenate((against_set, hard)))
    top = np.full(len(label), bias)
    np.maximum.at(top, text, decided[word])
    slope, offset = _logistic(top, label)
    return Model(weights.astype(np.float32), bias, slope, offset, int(mix(np.array([len(unique), abs(hash(bias))], np.uint64)).sum(dtype=np.uint64) >> np.uint64(1)))


_known: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _decide(model: Model, data, start, end, key) -> tuple[np.ndarray, np.ndarray]:
    """Decision values of the distinct words of a batch; a worker keeps those it has seen."""
    unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    hashes, values = _known.get(model.name, (np.zeros(0, np.uint64), np.zeros(0)))
    if len(hashes) + len(unique) > CACHE_WORDS:
        hashes, values = np.zeros(0, np.uint64), np.zeros(0)
    new = ~np.isin(unique, hashes, assume_unique=True)
    if new.any():
        at = first[new]
        fresh = against(spell(data, start[at], end[at]), model.weights) + model.bias
        hashes, values = np.concatenate((hashes, unique[new])), np.concatenate((values, fresh))
        order = np.argsort(hashes)
        hashes, values = hashes[order], values[order]
    _known.clear()
    _known[model.name] = hashes, values
    return values[np.searchsorted(hashes, unique)], inverse


def _scores(model: Model | None, column: pa.Array) -> np.ndarray:
    if model is None:
        return np.zeros(len(column))
    words = split_words(column, NON_SPACE)
    text, start, end, key = _units(words)
    value, inverse = _decide(model, words.data, start, end, key)
    top = np.full(len(column), model.bias)
    np.maximum.at(top, text, value[inverse])
    return 1 / (1 + np.exp(-np.clip(model.slope * top + model.offset, -500, 500)))


def score_texts(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (doc_id, text) with their toxicity from 0 to 1 as rows (doc_id, score).

    A text has the decision value of its most toxic word; null and empty texts, and those
    without letters, have the value of a word without letters.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for part in slices(batches):
            score = pa.array(_scores(model, part["text"]))
            yield pa.RecordBatch.from_arrays([part["doc_id"], score], ["doc_id", "score"])

    doc = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc}, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> DataFrame:
    """The rows of ``docs`` whose text isn't predicted toxic, with all their columns."""
    model = train_on_labels(docs, labels, per_class)

    def run(batches: Iterator[pa.RecordBatch]):
        for part in slices(batches):
            yield part.filter(pa.array(_scores(model, part["text"]) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that labels are never learned from: crc32 of the id as text, modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_on_labels(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Model | None:
    """Train on at most ``per_class`` texts of each label (doc_id, toxic), the first by a hash
    of the id, none of them held out. Ids labelled both ways count as toxic."""
    marked = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("label"))
    )
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = marked.where("label = 1").orderBy(*order).limit(per_class).union(
        marked.where("label = 0").orderBy(*order).limit(per_class)
    )
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")  # 2 * per_class ids
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.first("label").alias("label"))
    )

    def fit(batches: Iterator[pa.RecordBatch]):
        texts, marks = [], []
        for batch in batches:
            texts += batch["text"].to_pylist()
            marks += batch["label"].to_pylist()
        if model := train(texts, marks):
            parts = [[model.weights.tobytes()], [model.bias], [model.slope], [model.offset], [model.name]]
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], list(Model._fields))

    # The sample is bounded, so one task trains; the driver gets the weights alone.
    whole = rows.repartition(1).sortWithinPartitions("doc_id").select("text", "label")
    found = whole.mapInArrow(fit, "weights binary, bias double, slope double, offset double, name long").collect()
    if not found:
        return None
    weights, *rest = found[0]
    return Model(np.frombuffer(bytes(weights), np.float32), *rest)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> DataFrame:
    """Score ``docs`` (doc_id, text) as ``labels`` (doc_id, toxic) mark toxic texts.

    Words are compared by the gap-weighted three-letter subsequences they share, so letters
    put between those of an insult, and other endings of it, leave it close to the insult.
    Without labels of both kinds every score is 0. Each input row gives one row; other columns
    are ignored.

    Returns doc_id, held_out, score, predicted.
    """
    scored = score_texts(docs, train_on_labels(docs, labels, per_class))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
