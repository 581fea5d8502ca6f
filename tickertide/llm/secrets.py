"""Secrets in texts: fixed formats, and spans tagged by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickertide.llm.words import Words, byte_class, split_words

#: Fixed values.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ["assign", "access", "hex", "crf"]

_DIGIT, _LOWER, _UPPER = byte_class((48, 57)), byte_class((97, 122)), byte_class((65, 90))
_HEX = _DIGIT | byte_class((97, 102), (65, 70))
_JOIN = byte_class((43, 43), (45, 47), (95, 95))
TOKEN = _DIGIT | _LOWER | _UPPER | _JOIN | byte_class((0x80, 0xFF))
_SIGN = byte_class((58, 58), (61, 61))
_QUOTE = byte_class((34, 34), (39, 39))
_LINE = byte_class((10, 10))
_CODE = byte_class((40, 41), (59, 59), (91, 91), (93, 93), (123, 123), (125, 125))
_TYPE = np.zeros(256, np.uint8)
for _i, _class in enumerate((_LOWER, _UPPER, _DIGIT, _JOIN), 1):
    _TYPE[_class] = _i

#: Sizes of the feature groups: length and kinds of letters; share of digits and hex; changes of
#: kind inside the token; gap before; word before; word after; the text around.
GROUPS = (128, 12, 6, 8, 1024, 512, 16)
OFFSETS = np.concatenate(([0], np.cumsum(GROUPS)))
SLICE = 100  # texts that are tagged at once, about what a core's cache holds
MARGIN = 6  # tokens of context on either side of a training window


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, stop, where the secret itself begins) of the fixed formats."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end(), m.start()) for m in LONG_HEX.finditer(text)]
    return out


def _packed(bits: int, *classes: np.ndarray) -> np.ndarray:
    """A table that counts several classes of bytes at once, ``bits`` bits for each."""
    return sum(c.astype(np.uint64) << np.uint64(bits * i) for i, c in enumerate(classes))


_IN_TOKEN = _packed(20, _DIGIT, _LOWER, _UPPER)
_IN_TOKEN_TOO = _packed(20, _JOIN, _HEX)
_IN_GAP = _packed(16, _SIGN, _QUOTE, _LINE, _CODE)


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[end] - sums[start]


def _counts(packed: np.ndarray, bits: int, fields: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return [((packed >> np.uint64(bits * i)) & mask).astype(np.int64) for i in range(fields)]


def features(words: Words) -> np.ndarray:
    """Feature numbers (tokens x groups). Counts are modulo 2**20 in tokens, 2**16 in gaps."""
    n = len(words.start)
    if not n:
        return np.zeros((0, len(GROUPS)), np.int64)
    low = int(words.offset[0])
    data = words.data[low : int(words.offset[-1])]
    start, end = words.start - low, words.end - low
    length = end - start
    digit, lower, upper = _counts(_spans(_IN_TOKEN[data], start, end), 20, 3)
    kinds = _TYPE[data]
    change = np.zeros(len(data), np.uint64)
    change[1:] = (kinds[1:] != kinds[:-1]) & (kinds[1:] > 0) & (kinds[:-1] > 0)
    change[start] = 0
    join, hexes, changes = _counts(_spans(_IN_TOKEN_TOO[data] + (change << np.uint64(40)), start, end), 20, 3)
    before_it = np.maximum(np.concatenate(([0], end[:-1])), words.offset[words.text] - low)
    sign, quote, line, code = _counts(_spans(_IN_GAP[data], before_it, start), 16, 4)
    size = np.searchsorted([4, 8, 12, 16, 24, 32, 48], length, "right")
    shape = size * 16 + (digit > 0) * 8 + (lower > 0) * 4 + (upper > 0) * 2 + (join > 0)
    share = np.where(digit == 0, 0, np.where(digit == length, 5, 1 + np.minimum(3, digit * 4 // np.maximum(length, 1))))
    first = np.zeros(n, bool)
    begins = words.first[:-1][np.diff(words.first) > 0]
    first[begins] = True
    before = np.zeros(n, np.int64)
    before[1:] = (words.hash[:-1] & np.uint64(1023)).astype(np.int64)
    after = np.zeros(n, np.int64)
    after[:-1] = (words.hash[1:] & np.uint64(511)).astype(np.int64)
    before[first] = 0
    after[np.append(first[1:], True)] = 0
    gap = (sign > 0) * 1 + (quote > 0) * 2 + (line > 0) * 4
    texts = len(words.first) - 1
    total = np.maximum(np.bincount(words.text, minlength=texts), 1)
    with_digit = np.bincount(words.text, digit > 0, texts) / total
    signs = np.bincount(words.text, sign + code, texts) / total
    around = np.searchsorted([0.02, 0.1, 0.3], with_digit) * 4 + np.searchsorted([0.02, 0.1, 0.3], signs)
    groups = (shape, share * 2 + (hexes == length), np.searchsorted([1, 2, 3, 5, 9], changes, "right"), gap, before, after, around[words.text])
    return np.stack(groups, 1) + OFFSETS[:-1]


class Field(NamedTuple):
    """Weights of features for begin and inside, relative to outside; scores of state pairs."""

    emit: np.ndarray  # features x 2
    move: np.ndarray  # from x to: outside, begin, inside


def _forward_backward(emit: np.ndarray, move: np.ndarray):
    """Marginals of states and of state pairs of windows that begin and end outside."""
    n, length, _ = emit.shape
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    lse = lambda x, axis: np.logaddexp.reduce(x, axis)
    alpha[:, 0] = move[0] + emit[:, 0]
    for t in range(1, length):
        alpha[:, t] = lse(alpha[:, t - 1, :, None] + move, 1) + emit[:, t]
    beta[:, -1] = move[:, 0]
    for t in range(length - 2, -1, -1):
        beta[:, t] = lse(move + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    z = lse(alpha[:, -1] + beta[:, -1], 1)
    state = np.exp(alpha + beta - z[:, None, None])
    pairs = np.zeros((3, 3))
    pairs[0] += state[:, 0].sum(0)
    pairs[:, 0] += state[:, -1].sum(0)
    for t in range(1, length):
        pairs += np.exp(alpha[:, t - 1, :, None] + move + (emit[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(0)
    return state, pairs


def train(texts: list[str], steps: int = 120, rate: float = 0.3, ridge: float = 0.02) -> Field | None:
    """Learn from windows around the formats' matches, and as many elsewhere; None without any."""
    words = split_words(pa.array(texts, pa.string()), TOKEN)
    found = features(words)
    tag = np.zeros(len(found), np.int64)
    for i, text in enumerate(texts):
        a, b = words.first[i], words.first[i + 1]
        for _, _, stop, secret in base_spans(text):
            low, high = (words.offset[i] + len(text[:x].encode()) for x in (secret, stop))
            inside = np.flatnonzero((words.start[a:b] < high) & (words.end[a:b] > low)) + a
            tag[inside] = 2
            tag[inside[:1]] = 1
    seeds = np.flatnonzero(tag > 0)
    if not len(seeds):
        return None
    others = np.linspace(0, len(tag) - 1, 4 * len(seeds)).astype(int)
    matched = np.zeros(len(texts), bool)
    matched[words.text[seeds]] = True
    first = _fit(found, tag, np.concatenate((seeds, others[matched[words.text[others]]])), steps, rate, ridge)
    # What looks like a secret behind a sign, but has no known format, teaches nothing.
    like = (tag == 0) & (decode(first, words, found) > 0) & ((found[:, 3] - OFFSETS[3]) & 1 > 0)
    near = np.convolve(like, np.ones(2 * MARGIN + 1), "same") > 0.5
    return _fit(found, tag, np.concatenate((seeds, others[~near[others]])), steps, rate, ridge)


def _fit(found: np.ndarray, tag: np.ndarray, centers: np.ndarray, steps: int, rate: float, ridge: float) -> Field:
    """Maximise the penalised likelihood of the tags in windows around ``centers``."""
    width = 2 * MARGIN + 1
    centers = np.unique(centers)
    at = np.clip(centers[:, None] + np.arange(-MARGIN, MARGIN + 1), 0, len(tag) - 1)
    x, y = found[at], tag[at]
    emit, move = np.zeros((OFFSETS[-1], 2)), np.zeros((3, 3))
    seen = np.zeros((OFFSETS[-1], 2))
    for s in (1, 2):
        np.add.at(seen[:, s - 1], x[y == s].ravel(), 1.0)
    pairs = np.zeros((3, 3))
    padded = np.pad(y, ((0, 0), (1, 1)))
    np.add.at(pairs, (padded[:, :-1].ravel(), padded[:, 1:].ravel()), 1.0)
    square = [np.zeros_like(emit), np.zeros_like(move)]
    for _ in range(steps):  # full gradients, scaled by AdaGrad
        score = np.zeros((*y.shape, 3))
        score[..., 1:] = emit[x].sum(2)
        state, expected = _forward_backward(score, move)
        push = np.stack([np.bincount(x.ravel(), np.repeat(state[..., s].ravel(), x.shape[2]), OFFSETS[-1]) for s in (1, 2)], 1)
        for weight, gradient, total in ((emit, seen - push, square[0]), (move, pairs - expected, square[1])):
            gradient = gradient / len(centers) - ridge / width * weight / 100
            total += gradient**2
            weight += rate * gradient / np.sqrt(total + 1e-12)
    return Field(emit.astype(np.float32), move)


def decode(field: Field, words: Words, found: np.ndarray) -> np.ndarray:
    """The best tags of all texts by Viterbi; each text begins and ends outside.

    A token whose score falls behind outside by more than any two moves can make good is
    outside on the best path. The chain is cut there, and only what lies between is searched.
    """
    tag = np.zeros(len(found), np.int64)
    if not len(found):
        return tag
    emit = np.zeros((len(found), 2), np.float32)
    for group in range(found.shape[1]):
        emit += field.emit[found[:, group]]
    move = field.move
    gain = max(move[p, s] + move[s, n] - move[p, 0] - move[0, n] for p in range(3) for s in (1, 2) for n in range(3))
    maybe = emit.max(1) + gain >= 0
    edge = np.ones(len(found), bool)
    edge[1:] = ~maybe[:-1] | (words.text[1:] != words.text[:-1])
    first = np.flatnonzero(maybe & edge)
    last = np.flatnonzero(maybe & np.append(edge[1:] | ~maybe[1:], True))
    lengths = last - first + 1
    for length in np.unique(lengths):
        own = first[lengths == length]
        score = np.zeros((len(own), 3))
        back = np.zeros((length, len(own), 3), np.int8)
        for t in range(length):
            before = score[:, :, None] + move if t else np.broadcast_to(move[0], (len(own), 1, 3))
            back[t] = before.argmax(1)
            score = before.max(1)
            score[:, 1:] += emit[own + t]
        state = (score + move[:, 0]).argmax(1)
        for t in range(length - 1, -1, -1):
            tag[own + t] = state
            state = back[t][np.arange(len(own)), state].astype(np.int64)
    return tag


def _sample(docs: DataFrame, rows: int, max_bytes: int) -> list[str]:
    """Texts to learn from: such with a match of the formats, and any, the first by a hash."""
    may = F.col("text").rlike(
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"""
    )
    fit = docs.select("text").where(F.octet_length("text").between(1, max_bytes))
    order = [F.xxhash64("text"), "text"]
    with_match = fit.where(F.col("text").rlike("[0-9]") & may).orderBy(*order).limit(rows)
    any_text = fit.orderBy(*order).limit(rows // 2)
    return sorted({r["text"] for part in (with_match, any_text) for r in part.collect()})


def _tagged(field: Field | None, words: Words, texts: list[str | None]) -> Iterator[list[tuple[str, int, int]]]:
    tag = decode(field, words, features(words)) if field else np.zeros(len(words.start), np.int64)
    begins = np.flatnonzero(tag == 1)
    ends = np.append(np.flatnonzero(np.diff((tag > 0).astype(np.int8), append=0) == -1), len(tag))
    marked = np.flatnonzero((tag > 0) & ((tag == 1) | (np.concatenate(([0], tag[:-1])) == 0)))
    stops = np.minimum(ends[np.searchsorted(ends, marked)], np.append(begins, len(tag))[np.searchsorted(begins, marked, "right")] - 1)
    which = words.text[marked] if len(marked) else marked
    low, high = np.searchsorted(which, np.arange(len(texts))), np.searchsorted(which, np.arange(len(texts)), "right")
    for i, text in enumerate(texts):
        base = base_spans(text) if text else []
        spans = [(kind, a, b) for kind, a, b, _ in base]
        for m in range(low[i], high[i]):
            origin = words.offset[i]
            piece = words.data[origin : words.end[stops[m]]].tobytes()
            a = len(piece[: words.start[marked[m]] - origin].decode())
            b = a + len(piece[words.start[marked[m]] - origin :].decode())
            if not any(a < stop and start < b for _, start, stop in spans[: len(base)]):
                spans.append(("crf", a, b))
        yield spans


def find_secrets(docs: DataFrame, train_rows: int = 1500, train_bytes: int = 32_768) -> DataFrame:
    """Secrets in ``docs`` (doc_id, text): counts and digest of the formats, all spans.

    Words are tagged as begin of a secret, inside or outside by a linear-chain conditional
    random field over their shape, the words and signs next to them and the kind of text they
    stand in. It learns from what the formats match in at most ``train_rows`` texts with a match
    and half as many of any kind, of at most ``train_bytes`` bytes each, the first by a hash. Tagged
    spans that touch a format's match add nothing and are left out. Null texts count as empty;
    each input row gives one row, also for repeated rows; other columns are ignored. Where no
    format matches there is nothing to learn and no span.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans.
    """
    texts = _sample(docs, train_rows, train_bytes)
    field = train(texts) if texts else None

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                texts = part["text"].to_pylist()
                counts, base, every = [], [], []
                for spans in _tagged(field, split_words(part["text"], TOKEN), texts):
                    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                    counts.append([sum(s[0] == k for s in spans) for k in KINDS[:3]])
                    base.append(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k != "crf"))
                    every.append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)), pa.array(base), pa.array(every)],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"],
                )

    doc = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {doc}, n_assign long, n_access long, n_hex long, base string, spans string"
    )
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans"
    )
