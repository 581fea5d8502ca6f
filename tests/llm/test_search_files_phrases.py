"""Ranked search, token files and phrases against brute force, with odd rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickertide.llm import phrases as phrases_module
from tickertide.llm.lexical_search import ranked_search
from tickertide.llm.oracle import PHRASES, RANKED_SEARCH
from tickertide.llm.phrases import collocations
from tickertide.llm.queries import tokenizer_path
from tickertide.llm.token_files import Shard, pack_shard, read_token_files, repair, write_token_files
from tickertide.session import scratch_dir

RANDOM = random.Random(7)
WORDS = ["".join(RANDOM.choice("abcdeé") for _ in range(RANDOM.randint(1, 5))) for _ in range(120)]
# The last columns have names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, n long, term long, ids binary, part int, key long, score long"


def say(n):
    return " ".join(RANDOM.choice(WORDS) for _ in range(n))


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def docs_of(spark, rows):
    return spark.createDataFrame([(*row, -1, -2, b"x", -3, -4, -5) for row in rows], SCHEMA).repartition(3)


def odd_rows():
    same = say(40)
    return [
        (1, None, "en"), (2, "", "en"), (3, " \t\n ", None), (4, "One, two", "en"), (5, "one\r\ntwo;", "de"),
        (6, same, "en"), (7, same, "en"), (7, same, "en"), (8, same.upper(), "en"), (9, "É x " * 30, "fr"),
        (10, "a" * 70_000, "en"), (11, say(9_000), "en"), (None, same, "en"), (None, None, None),
        (12, "<|startoftext|>a<|endoftext|> b", "en"), (13, "é  x y\x00z", ""),
    ]


def many_rows(n=150):
    rows = odd_rows()
    for i in range(100, 100 + n):
        text = say(RANDOM.randint(1, 60)) + RANDOM.choice([" new york city ", ", new york.", " the very same five words! ", "\n"])
        rows.append((i, text * RANDOM.randint(1, 3), RANDOM.choice(["en", "de", None])))
    return rows


# --- ranked search ---------------------------------------------------------------


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def search_by_hand(docs, items, top):
    counted = [(d, Counter(terms_of(t))) for d, t, _ in docs if terms_of(t)]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        if item is not None:
            wanted[item] |= set(terms_of(text))
    out = []
    for item, terms in wanted.items():
        found = []
        for doc, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n) // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms if t in c
            )
            if score > 0 and doc is not None:
                found.append((-score, doc))
        out += [(item, rank + 1, doc, -score) for rank, (score, doc) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("postings", [4_000_000, 40])
def test_ranked_search(spark, postings):
    rows = many_rows()
    items = [(i, say(RANDOM.randint(1, 12))) for i in range(20)]
    items += [(20, None), (21, "!!"), (22, "unheard of zzzz"), (3, "One New york"), (None, "one"), (0, items[0][1])]
    asked = spark.createDataFrame([(*i, 9) for i in items], "item_id long, text string, term long")
    got = ranked_search(docs_of(spark, rows), asked, top=4, postings=postings)
    assert sorted(map(tuple, got.collect())) == search_by_hand(rows, items, 4)


def test_ranked_search_of_names_and_nothing(spark):
    docs = docs_of(spark, [(1, "one two", "en"), (2, "two", "en"), (3, "six", None)])
    asked = spark.createDataFrame([("a", "two"), ("b", "Six")], "item_id string, text string")
    assert sorted((r.item_id, r.rank, r.doc_id) for r in ranked_search(docs, asked).collect()) == [
        ("a", 1, 2), ("a", 2, 1), ("b", 1, 3),
    ]
    assert ranked_search(docs.limit(0), asked).collect() == []
    assert ranked_search(docs, asked.limit(0)).collect() == []


# --- token files -----------------------------------------------------------------


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for least in (2, 8):
        for size, letters in ((1, 2), (50, 1), (4_000, 3), (20_000, 300)):
            ids = rng.integers(0, letters, size).astype(np.uint32)
            ends = np.unique(np.append(rng.integers(1, size + 1, 9), size))
            shard = Shard(pack_shard(list(range(len(ends))), ids, ends, least))
            starts = np.concatenate(([0], ends))
            assert np.array_equal(shard.starts(), starts)
            for k in range(len(ends)):
                assert np.array_equal(shard.document(k), ids[starts[k] : ends[k]])
            for _ in range(20):
                a, b = sorted(rng.integers(0, size + 1, 2))
                assert np.array_equal(shard.between(a, b), ids[a:b])
            symbols, symbol_ends, _ = repair(ids, ends, letters, least)
            inside = np.ones(len(symbols), bool)
            inside[symbol_ends - 1] = False
            # Pairs whose places overlap in a run (aaa) count once.
            pairs = Counter(zip(symbols[:-1][inside[:-1]].tolist(), symbols[1:][inside[:-1]].tolist()))
            assert all(c < least or a == b for (a, b), c in pairs.items())
            if letters == 3:
                assert len(symbols) < size / 2.5


def test_wide_symbols_and_foreign_bytes():
    ids = np.array([70_000, 5, 70_000, 5] * 20, np.uint32)
    shard = Shard(pack_shard([None], ids, np.array([80]), 4))
    assert shard.doc_ids == [None] and np.array_equal(shard.document(0), ids) and len(shard.symbols) < 20
    with pytest.raises(ValueError):
        Shard(b"\0" * 100)


@pytest.mark.parametrize("shard_ids", [1, 500, 1 << 18])
def test_token_files(spark, shard_ids):
    from tokenizers import Tokenizer

    path, rows = tokenizer_path("word_bpe_49k.json"), many_rows(60)
    folder = scratch_dir(spark, "files")
    write_token_files(docs_of(spark, rows), folder, path, 1, shard_ids, least=4)
    got = read_token_files(spark, folder).collect()
    tokenizer = Tokenizer.from_file(path)
    expected = Counter()
    for doc_id, text, _ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected[(doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    at = 0
    for row in sorted(got, key=lambda r: r.start):  # gapless, in order of doc_id, null first
        assert row.start == at
        at += row.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


def test_words_put_together_from_parts():
    """Signs, foreign letters, combining marks and added tokens beside letters."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tickertide.llm.token_files import _WordEncoder

    path = tokenizer_path("word_bpe_49k.json")
    letters = ["a", "Z", "the", "É", "ñ", "ß", "İ", "ſ", "ŉ", "Ǆ", "ȿ", "ɐ", "Å", "Ω", "e\u0301", "\u0338", "\u0307", "ªº"]
    signs = ["'", "'s", "'re", "-", "...", "×", "÷", "7", "12", "<", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "§", "\u00a0", "_", "…", "日本"]
    encoder, tokenizer, rng = _WordEncoder(path), Tokenizer.from_file(path), random.Random(1)
    texts = [a + b + c for a in letters for b in signs for c in ("", "x", "é")] + [b + a for a in letters for b in signs]
    texts += ["".join(rng.choice([*letters, *signs, " "]) for _ in range(rng.randint(1, 12))) for _ in range(4_000)]
    for part in (texts, texts[::-1], [None, "", " \n"]):
        ids, length = encoder.encode(pa.array(part, pa.string()))
        at = 0
        for text, n in zip(part, length):
            assert ids[at : at + n].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text
            at += n


def test_no_token_files(spark):
    folder = scratch_dir(spark, "files")
    write_token_files(docs_of(spark, odd_rows()).limit(0), folder, tokenizer_path("word_bpe_49k.json"), 1)
    assert read_token_files(spark, folder).collect() == []


# --- phrases ---------------------------------------------------------------------


def phrases_by_hand(rows, least, top, contained):
    grams, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                grams.update((lang, *words[i : i + n]) for i in range(len(words) - n + 1))
    frequent = {g: a for g, a in grams.items() if len(g) > 2 and a >= least}
    longer = defaultdict(int)
    for (lang, *g), a in frequent.items():
        for n in range(2, len(g)):
            for i in range(len(g) - n + 1):
                part = (lang, *g[i : i + n])
                longer[part] = max(longer[part], a)
    lists = defaultdict(list)
    for (lang, *g), a in frequent.items():
        if 100 * longer[(lang, *g)] >= contained * a and longer[(lang, *g)]:
            continue
        cuts = []
        for k in range(1, len(g)):
            l, r = grams[(lang, *g[:k])], grams[(lang, *g[k:])]
            cuts.append((2000000 * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        lists[lang].append((-score, -a, " ".join(g).encode(), l, r))
    out = []
    for lang, found in lists.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top]):
            out.append((lang, rank + 1, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("head,least", [(1 << 19, 4), (25, 4), (25, 30), (1, 6)])
def test_phrases(spark, monkeypatch, head, least):
    monkeypatch.setattr(phrases_module, "DENSE_SHARE", 1 << 16)  # small chunks fill tiles too
    rows = many_rows(120)
    got = collocations(docs_of(spark, rows), least=least, top=40, head=head)
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, least, 40, 80)


def test_phrases_of_nothing(spark):
    docs = docs_of(spark, odd_rows())
    assert collocations(docs.limit(0)).collect() == []
    assert collocations(docs.where("text is null")).collect() == []


def test_tiles_spill_and_add_up():
    rng = np.random.default_rng(5)
    old = phrases_module.SPARSE
    phrases_module.SPARSE = 3_000
    try:
        tiles, total, batches = phrases_module._Tiles(), Counter(), []
        for size in (200_000, 1_000, 70_000):
            left, right = (rng.zipf(1.3, size) % 5_000 for _ in range(2))
            left[::50] |= 1 << 62
            total.update(zip(left.tolist(), right.tolist()))
            batches += tiles.add(left, right)
        batches += tiles.close()
    finally:
        phrases_module.SPARSE = old
    assert tiles.dense and len(batches) > 3
    got = Counter()
    for batch in batches:
        for a, b, n in zip(*(batch[c].to_pylist() for c in ("left", "right", "n"))):
            got[(a, b)] += n
    assert got == total


# --- SQL twins -------------------------------------------------------------------


@pytest.mark.parametrize("name", ["search", "phrases"])
def test_sql_twins(spark, tmp_path, name):
    rows = many_rows(200)
    docs = docs_of(spark, rows)
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    items = spark.createDataFrame([(i, say(5)) for i in range(15)], "item_id long, text string")
    items.toPandas().to_parquet(tmp_path / "benchmark.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    if name == "search":
        got, sql = ranked_search(docs.withColumn("doc_id", F.col("doc_id")), items), RANKED_SEARCH
    else:
        got, sql = collocations(docs), PHRASES
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(cursor.fetchall())
