"""Quality network and toxicity automaton: brute force, held-out accuracy and odd tables."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.llm import quality, toxicity
from framelake.llm.text import texts


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_edit_distance():
    terms = [toxicity.Term(w, False, 1.0) for w in ("loser", "losers", "idiot", "scum", "pathetic")]
    terms += [toxicity.Term(w, True, 1.0) for w in ("lowei", "veqü")]
    automaton = toxicity.LexiconAutomaton(terms)
    rng = random.Random(3)
    for _ in range(4000):
        w = list(rng.choice(terms).text)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = [rng.choice("losercdiptü")] * rng.randrange(2)
            if rng.random() < 0.3 and len(w) > 1:
                k = rng.randrange(len(w) - 1)
                w[k], w[k + 1] = w[k + 1], w[k]
        w = "".join(w)
        near = [osa(w, t.text) for t in terms if not t.stem and osa(w, t.text) <= t.edits]
        near += [0 for t in terms if t.stem and w.startswith(t.text)]
        found, edits = automaton.match(w)
        assert (found >= 0, edits if found >= 0 else None) == (bool(near), min(near, default=None)), w


def test_quotation_is_not_abuse():
    automaton = toxicity.LexiconAutomaton([toxicity.Term("moron", False, 2.0)])
    x = toxicity.features(["you are such a MOR0N now", 'the word "moron" is old', "a plain line", "", None, "what m*ron wrote"], automaton)
    assert x[0, 0] > 0 and x[0, 4] > 0 and x[0, 3] == 0
    assert x[1, 3] > 0 and x[1, :3].sum() == 0
    assert not x[2:5].any()
    assert x[5, 3] > 0


@pytest.fixture(scope="module")
def toxic_tables(make_docs, spark):
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        body = [rng.choice(plain) for _ in range(40)]
        y = int(i % 5 == 0)
        if y:
            body.insert(rng.randrange(40), rng.choice(["grumblefoo", "snarkbag"]) if i % 10 else "zonkel" + rng.choice(plain))
            if i % 15 == 0:
                body.insert(3, "grumblfoo")
        rows.append((i, " ".join(body)))
        labels.append((i, y))
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(toxic_tables):
    docs, labels = toxic_tables
    model = toxicity.fit(docs, labels, "toxic", F.col("doc_id") % 3 != 0)
    assert {"grumblefoo", "snarkbag"} <= {t.text for t in model.automaton.terms}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in got if i % 3 == 0]
    assert sum((got[i] >= 0.5) == (i % 5 == 0) for i in held) / len(held) > 0.97
    misspelt = toxicity.score(docs.limit(2).withColumn("text", F.lit("w1 w2 grumblefo w3")), model).collect()
    assert all(r.score > 0.5 for r in misspelt)


def test_inflected_terms_are_met_misspelt(spark):
    """The stem of three forms outranks them; misspelt first letters need the words themselves."""
    forms = ["stupid", "stupidly", "stupids"]
    rows = [(f"line {i} is {forms[i % 3]} again", 1) for i in range(30)] + [(f"line {i} is fine again", 0) for i in range(30)]
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "text string, y int"))
    assert any(t.stem and "stupid".startswith(t.text) for t in terms)
    automaton = toxicity.LexiconAutomaton(terms)
    for word in ("sutpid", "tsupid", "xtupid", "tupidly", "sutpids"):
        found, edits = automaton.match(word)
        assert found >= 0 and edits == 1, word
    assert automaton.match("stupidest")[1] == 0 and automaton.match("fine")[0] == -1


def test_toxicity_odd_tables(odd_docs, make_docs, spark, toxic_tables):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    empty = toxicity.fit(odd_docs, none, "toxic", F.lit(True))
    assert {r.score for r in toxicity.score(odd_docs.withColumnRenamed("lang", "score"), empty).collect()} == {0.0}
    model = toxicity.fit(*toxic_tables, "toxic", F.lit(True))
    assert all(0 <= r.score < 0.5 for r in toxicity.score(odd_docs, model).collect())
    assert toxicity.score(make_docs([]), model).count() == 0
    repeated = spark.createDataFrame([(5, 1), (5, None), (5, 0), (None, 1), (1, 0)], "doc_id long, toxic int")
    assert toxicity.score(odd_docs, toxicity.fit(odd_docs, repeated, "toxic", F.lit(True))).count() == 8


def test_chunks_cover_every_byte():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 511, 512, 513, 896, 897, 5000]
    bodies = [rng.integers(1, 127, n).astype(np.uint8).tobytes() for n in sizes]
    chunks, row = quality.chunks_of(texts(pa.array([b.decode("latin-1") for b in bodies])))
    for r, body in enumerate(bodies):
        mine = chunks[row == r]
        rebuilt = b"".join(c.tobytes()[: quality.STEP] for c in mine[:-1]) + mine[-1].tobytes().rstrip(b"\0")
        assert rebuilt == body
        assert len(mine) == quality.chunk_counts(np.array([len(body)]))[0]


def test_pooling_equals_plain_loops():
    rng = np.random.default_rng(2)
    embed = rng.normal(size=(256, quality.EMBED)).astype(np.float32)
    filters = rng.normal(size=(quality.WIDTH * quality.EMBED, quality.FILTERS)).astype(np.float32)
    bias = rng.normal(size=quality.FILTERS).astype(np.float32)
    chunks = rng.integers(0, 256, (3, quality.CHUNK)).astype(np.uint8)
    got = quality.pooled(chunks, embed, filters, bias, block=2)
    for c in range(3):
        answers = [
            embed[chunks[c, a : a + quality.WIDTH]].reshape(-1) @ filters
            for a in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)
        ]
        assert np.allclose(got[c], np.maximum(np.max(answers, axis=0) + bias, 0), atol=1e-4)


def test_quality_on_held_out_rows_and_any_slicing(make_docs, spark):
    rng = random.Random(8)
    syllables = ["ra", "ti", "on", "the", "er", "ing", "lo", "mu"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(3))
    rows = []
    for i in range(400):
        body = [word() for _ in range(120)]
        rows.append((i, " ".join(f"{w}###" for w in body) if i % 4 == 0 else " ".join(body)))
    docs, labels = make_docs(rows), spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)], "doc_id long, quality int")
    network = quality.fit(docs, labels, "quality", F.col("doc_id") % 3 != 1, per_class=60)
    got = {r.doc_id: r for r in quality.judged(quality.score(docs, network)).collect()}
    held = [i for i in got if i % 3 == 1]
    assert sum(got[i].predicted == (i % 4 != 0) for i in held) / len(held) > 0.97
    alone = quality.probabilities(network, texts(pa.array([rows[7][1]])))
    assert abs(alone[0] - got[7].score) < 1e-6


def test_quality_odd_tables(odd_docs, make_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(odd_docs, none, "quality", F.lit(True)) is None
    assert {r.score for r in quality.score(odd_docs, None).collect()} == {0.5}
    few = spark.createDataFrame([(1, 0), (4, 1), (5, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    network = quality.fit(odd_docs, few, "quality", F.lit(True))
    scored = quality.score(odd_docs.withColumnRenamed("lang", "score"), network)
    assert scored.columns == ["doc_id", "text", "source", "n_chars", "score"]
    assert all(0 <= r.score <= 1 for r in scored.collect())
    assert quality.score(make_docs([]), network).count() == 0
