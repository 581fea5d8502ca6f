"""Toxicity, URL filter and near vectors against brute force or planted rows; the pipeline."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tickertide.llm import near_vectors as nv
from tickertide.llm.near_vectors import multi_sequence, near_vectors
from tickertide.llm.toxicity import (
    DECAY,
    REACH,
    keep_clean,
    self_kernel,
    spell,
    subsequences,
    toxicity,
    train,
)
from tickertide.llm.url_filter import judge_pages

RANDOM = random.Random(11)
WORDS = ["".join(RANDOM.choice("aeioulnrstdm") for _ in range(RANDOM.randint(2, 9))) for _ in range(1500)]
BAD = ["grumbok", "zwackel", "fiffenpuk"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label int"


def say(n):
    return " ".join(RANDOM.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 0.5, 9) for d, t in rows], DOCS).repartition(3)


def brute_kernel(one, two):
    """Sum over the subsequences of three letters that both words hold."""

    def weights(word):
        out = Counter()
        letters = "^" + word
        for i in range(len(letters)):
            for k in range(i + 2, min(len(letters), i + REACH)):
                for j in range(i + 1, k):
                    out[letters[i] + letters[j] + letters[k]] += DECAY ** (k - i - 2)
        return out

    a, b = weights(one), weights(two)
    return sum(a[u] * b[u] for u in a)


def test_self_kernel():
    for word in ("aaaa", "banana", "idiot", "xyz"):
        data = np.frombuffer(word.encode(), np.uint8)
        ((_, letters),) = spell(data, np.array([0]), np.array([len(data)])).groups
        assert self_kernel(*subsequences(letters))[0] == pytest.approx(brute_kernel(word, word))


def labelled():
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = say(RANDOM.randint(5, 60)).split()
        if toxic:
            words.insert(RANDOM.randrange(len(words)), RANDOM.choice(BAD) + RANDOM.choice(["", "s", "en", "!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


ODD = [(9000, None), (9001, ""), (9002, "a b c"), (9003, "é" * 50), (9004, "x" * 60_000), (None, "z"), (9005, "z"), (9005, "z")]


def test_toxicity(spark):
    rows, labels = labelled()
    planted = [
        (8000, say(20) + " GRUMBOK " + say(20)),
        (8001, say(20) + " zwa-ckel " + say(20)),
        (8002, say(5) + " g r u m b o k " + say(5)),
        (8003, say(20) + " zwacxkel " + say(20)),
        (8004, say(400)),
    ]
    marks = spark.createDataFrame(labels + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    frame = docs(spark, rows + planted + ODD)
    got = toxicity(frame, marks).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
    assert Counter((r["doc_id"], r["held_out"]) for r in got) == Counter((d, held(d)) for d, _ in rows + planted + ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by_id = {r["doc_id"]: r["predicted"] for r in got}
    tested = [(d, t) for d, t in labels if held(d)]
    assert sum(by_id[d] == t for d, t in tested) >= 0.95 * len(tested)
    assert [by_id[d] for d, _ in planted] == [1, 1, 1, 1, 0]
    assert not any(by_id[d] for d, _ in ODD)
    kept = keep_clean(frame, marks)
    assert kept.schema.simpleString() == frame.schema.simpleString()
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if not r["predicted"])


def test_toxicity_without_labels(spark):
    frame = docs(spark, ODD)
    marks = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity(frame, marks).collect()} == {0.0}
    assert toxicity(frame.limit(0), marks.limit(0)).count() == 0
    assert train(["a b"], [1]) is None


def test_url_filter(spark):
    rows = [
        (1, "http://a.com/x", '<a href="http://b.org/">'),
        (2, "http://spam.org/z", "<a HREF='//n.net/es/1'>"),
        (3, "http://n.net/es/1", None),
        (4, "http://b.org/q", ""),
        (5, None, "x"),
        (6, "foo", None),
        (7, "HTTP://WWW.Example.com/en/p?x", ""),
        (8, "http://q.example.com/en/1#a", ""),
        (9, "http://com?x/", ""),
        (10, "http://xcom/es/", "//"),
        (11, "http://n.net/de", ""),
        (11, "http://n.net/de", ""),
        (12, "://É.Net/fr/", ""),
    ]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, host string, n int")
    got = {r["page_id"]: tuple(r)[1:] for r in judge_pages(pages).collect()}
    assert judge_pages(pages).count() == len(rows)
    assert got[1] == ("a.com", "/x", "com/", "allow")
    assert got[2] == ("spam.org", "/z", None, "block")  # it links to a blocked page
    assert got[3] == ("n.net", "/es/1", "net/es/", "block")
    assert got[4][2:] == (None, "allow")  # an allowed page links to it
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("www.example.com", "/en/p", "www.example.com/en/", "allow")
    assert got[8] == ("q.example.com", "/en/1", "example.com/en/", "block")
    assert got[9] == ("com", "", None, "allow") and got[10][2] is None
    assert got[11][2:] == (None, "block") and got[12][:3] == ("É.net", "/fr/", "net/fr/")
    assert judge_pages(pages.limit(0)).count() == 0


def test_multi_sequence_is_sorted():
    rng = np.random.default_rng(3)
    one, two = rng.random(7), rng.random(5)
    got = multi_sequence(one, two, 35)
    sums = [one[i] + two[j] for i, j in got]
    assert len(set(got)) == 35 and sums == sorted(sums)


@pytest.mark.parametrize("block", [4096, 16])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(nv, "BLOCK", block)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 16))
    rows = [(i, (centers[i % 30] + rng.normal(size=16) * rng.choice([0.05, 0.3])).tolist(), i % 3) for i in range(400)]
    rows += [(1000 + i, [1.0] + [0.0] * 15, 1) for i in range(50)] + [(2000, [2.0] + [0.0] * 15, 1)]
    dead = [
        (3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [float("nan")] * 16, 1), (3004, [None] * 16, 1),
        (3005, [1.0] + [0.0] * 15, None), (3006, [float("inf")] * 16, 1), (3007, [1.0, 2.0], 1), (3007, [1.0, 2.0], None),
    ]
    frame = spark.createDataFrame(
        [(*r, 7, "x") for r in rows + dead], "vec_id long, embedding array<double>, label int, links int, point string"
    )
    got = {r["vec_id"]: r for r in near_vectors(frame, codewords=8).collect()}
    assert near_vectors(frame).count() == len(rows) + len(dead)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    links = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(links, False)
    n = links.sum(1)
    found = np.array([got[r[0]]["n_links"] for r in rows])
    assert (found <= n).all() and found.sum() >= 0.97 * n.sum()
    assert all(got[d]["n_links"] == 0 and got[d]["component_id"] == d and got[d]["kept"] for d, *_ in dead)
    assert got[1049]["component_id"] == 1000 and got[2000]["component_id"] == 1000 and not got[2000]["kept"]
    assert near_vectors(frame.limit(0)).count() == 0


@pytest.mark.parametrize("linked", [0, 1, 5])
def test_cells_do_not_rest_on_the_links_of_the_probes(linked):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 32))
    x /= np.sqrt((x * x).sum(1))[:, None]
    index = nv.Index(x, 32)
    # The few links that the probes have lie at home.
    index.fit(x[:1000], [(0, linked, float(linked))] if linked else [], 0.995, 0.93)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1)[:, None] * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * side / np.sqrt((side * side).sum(1))[:, None]
    found = [cell in visited for cell, visited in zip(index.home(y), index.visits(x, index.cells))]
    assert index.cells >= 16 and np.mean(found) >= 0.985
    assert np.allclose([(a * x).sum(1) for a in nv.partners(x, 0.93)], 0.93)


def by_hand(rows, least=0.93):
    """Linked pairs of rows (id, vector, label), of equal length and label."""
    unit = [(i, np.array(v) / np.linalg.norm(v), label) for i, v, label in rows]
    return {
        (i, j) for i, a, k in unit for j, b, m in unit if i != j and k == m and len(a) == len(b) and a @ b >= least
    }


def test_both_ends_count_a_link(spark, monkeypatch):
    monkeypatch.setattr(nv, "LEAST_CELLS", 1)
    monkeypatch.setattr(nv, "BLOCK", 64)
    rng = np.random.default_rng(21)
    x = rng.normal(size=(600, 24))
    x /= np.sqrt((x * x).sum(1))[:, None]
    near = nv.partners(x, 0.932)[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate((x, near)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in near_vectors(frame, recall=0.6).collect()}
    pairs = by_hand(rows)
    assert {(i, i + 600) for i in range(600)} <= pairs
    one = [got[i]["n_links"] for i in range(600)]
    assert one == [got[i + 600]["n_links"] for i in range(600)]
    assert 0.6 * 600 <= sum(one) < 600  # so few cells that some links are found by neither end
    assert all((got[i + 600]["component_id"] == i) == (n == 1) for i, n in enumerate(one))


@pytest.mark.parametrize("kind", ["double", "float"])
def test_vectors_of_many_lengths(spark, kind):
    rng = np.random.default_rng(22)
    rows = []
    for width, n in ((1, 3), (2, 30), (3, 2), (8, 200), (9, 150)):
        for _ in range(n):
            v = rng.normal(size=width).astype(np.float32)
            for scale in (1.0, 1.01):
                rows.append((len(rows), [float(a) for a in v + (scale - 1) * rng.normal(size=width)], width % 2))
    rows.append((len(rows), rows[-1][1] + [0.0], 1))
    if kind == "float":
        rows = [(i, [float(np.float32(a)) for a in v], k) for i, v, k in rows]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    got = near_vectors(frame, recall=1.0).collect()
    pairs = by_hand(rows)
    assert {r["vec_id"]: r["n_links"] for r in got} == {
        i: sum(a == i for a, _ in pairs) for i, *_ in rows
    }
    part = {i: i for i, *_ in rows}
    for _ in rows:
        for a, b in pairs:
            part[a] = part[b] = min(part[a], part[b])
    assert {r["vec_id"]: r["component_id"] for r in got} == part


def test_units_of_huge_and_tiny_vectors():
    x = np.array([[3.0, 4.0], [3e200, 4e200], [3e-320, 4e-320]])
    assert np.allclose(nv._unit(x), [0.6, 0.8], atol=1e-3)


def test_rare_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(nv, "PROBES", 50)  # a few of them have a link, all at home
    rng = np.random.default_rng(12)
    x = rng.normal(size=(5000, 32))
    x /= np.sqrt((x * x).sum(1))[:, None]
    side = rng.normal(size=(8, 32))
    side -= (side * x[:8]).sum(1)[:, None] * x[:8]
    near = 0.935 * x[:8] + np.sqrt(1 - 0.935**2) * side / np.sqrt((side * side).sum(1))[:, None]
    easy = x[100:200] + 1e-6
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate((x, near, easy)))]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    links = {r["vec_id"]: r["n_links"] for r in got.where("n_links > 0").collect()}
    pairs = [(i, 5000 + i) for i in range(8)]
    assert set(links) == {i for p in pairs for i in p if i in links} | {*range(100, 200), *range(5008, 5108)}
    assert sum(p[0] in links for p in pairs) + sum(p[1] in links for p in pairs) >= 15


def test_pipeline(spark, tmp_path):
    rows, labels = labelled()
    clean = [(d, t) for (d, t), (_, toxic) in zip(rows, labels) if not toxic]
    passage = say(40)
    rows += [
        (5000, clean[0][1] + " again"),  # a near copy if the text is long enough
        (5001, clean[1][1]),
        (5002, say(20) + " " + passage + " " + say(5)),
        (5003, say(30) + " write to ann@mail.example.com now"),
        (5003, None),
    ]
    root = str(tmp_path / "sf")
    docs(spark, rows).drop("score", "label").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    frame = spark.read.parquet(f"{root}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, frame, root)
        if name != "best_fit_packing":
            assert out.schema.simpleString() == frame.schema.simpleString()
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        seen[name] = frame.select("doc_id").collect()
    ids = {name: {r["doc_id"] for r in found} for name, found in seen.items()}
    toxic_ids = {d for d, toxic in labels if toxic}
    assert len(ids["toxicity"] & toxic_ids) <= 0.1 * len(toxic_ids)
    assert {d for d, _ in clean} - ids["toxicity"] == set()
    assert 5001 not in ids["ngram_jaccard_join"] and clean[1][0] in ids["ngram_jaccard_join"]
    assert ids["benchmark_decontamination"] == ids["ngram_jaccard_join"] - {5002}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "pii")).collect()}
    assert "[EMAIL]" in texts[5003] and "@" not in texts[5003]
    assert ids["best_fit_packing"] == ids["pii"] == ids["benchmark_decontamination"]
