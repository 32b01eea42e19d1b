"""Jaccard join, repeated passages, decontamination and the pipeline against brute force."""

from __future__ import annotations

import os
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.llm import decontaminate, jaccard, suffixes
from framelake.llm.scratch import noted


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = plain_words(text)
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return Counter((i, len(sets[k]), min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows))


def edited(rng, body, n):
    body = list(body)
    for _ in range(n):
        body[rng.randrange(len(body))] = f"edit{rng.randrange(40)}"
    return body


def near_copies(seed, families, size, length, edits):
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"w{rng.randrange(60)}" for _ in range(length)]
        for _ in range(size):
            rows.append((len(rows), " ".join(edited(rng, base, rng.randrange(edits + 1)))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [2, 48])
def test_components_brute_force(make_docs, monkeypatch, small):
    """With small groups of two rows almost everything takes the way of large groups."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    rows = near_copies(3, 3, 30, 60, 4) + near_copies(4, 2, 12, 12, 1)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    rows += [(900, "a b"), (901, "A  b"), (902, "a"), (903, None), (904, ""), (905, " \n"), (905, "a b"), (None, "a b c d"), (None, None)]
    got = jaccard.jaccard_components(make_docs(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_components_of_large_families(make_docs, monkeypatch):
    """Families whose members differ much from each other, with a passage in common, and a chain of links."""
    monkeypatch.setattr(jaccard, "SMALL", 6)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(7)))) for i in range(90)]
    chain = [f"c{i}" for i in range(120)]
    for k in range(40):
        chain[k * 3] = f"x{k}"
        rows.append((200 + k, " ".join(chain)))
    shared = [f"s{i}" for i in range(30)]
    rows += [(300 + k, " ".join(shared + [f"own{k}x{i}" for i in range(rng.randrange(30))])) for k in range(40)]
    got = jaccard.jaccard_components(make_docs(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def brute_components_at(rows, shingle, threshold):
    """The same for any rule, as (doc_id, n_shingles, component_id)."""
    a, b = threshold
    split = [plain_words(t) for _, t in rows]
    sets = [{tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set() for w in split]
    label = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and b * both >= a * len(sets[x] | sets[y]):
                label = [label[y] if v == label[x] else v for v in label]
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[label[k]].append(i)
    return Counter((i, len(sets[k]), min((x for x in least[label[k]] if x is not None), default=None)) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("small", [2])
@pytest.mark.parametrize("shingle,threshold", [(5, (4, 5)), (2, (3, 5))])
def test_components_of_other_rules(make_docs, monkeypatch, small, shingle, threshold):
    monkeypatch.setattr(jaccard, "SMALL", small)
    rows = near_copies(5, 3, 25, 70, 5) + near_copies(6, 2, 10, 12, 1)
    rows = [(k, t) for k, (_, t) in enumerate(rows)] + [(900, "a b c d"), (901, "A b  c d"), (902, "a"), (903, None), (None, "a b c d e f")]
    got = jaccard.jaccard_components(make_docs(rows), shingle=shingle, threshold=threshold).collect()
    expected = brute_components_at(rows, shingle, threshold)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected != brute_components(rows)


def test_pipeline_links_at_five_words_and_four_fifths(make_docs, spark):
    """Two changed words leave 50 of 62 shingles of five words, but only 54 of 62 of three words."""
    base = [f"w{i}" for i in range(60)]
    near = [f"x{i}" if i in (0, 30) else w for i, w in enumerate(base)]
    apart = [f"x{i}" if i in (10, 30, 50) else w for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(apart))]
    assert len({c for _, _, c in brute_components(rows)}) == 3
    expected = {i for i, _, c in brute_components_at(rows, 5, (4, 5)) if i == c}
    assert expected == {1, 3}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, make_docs(rows), "").collect()} == expected


def test_few_texts_are_shuffled_for_their_tokens(make_docs, spark):
    rows = [(i, f"text {i}") for i in range(4_000)] + [(None, "no id")]
    docs = make_docs(rows).select("doc_id", "text")
    wanted = spark.createDataFrame([(10 * i, 10 * i) for i in range(40)] + [(-1, None)], "u long, first_id long")
    some = jaccard._perhaps(docs, wanted)
    kept = {r["doc_id"] for r in some.collect()}
    assert {None, *range(0, 400, 10)} <= kept and len(kept) < 60
    # The texts reach the sieve without an exchange: only the map's rows are shuffled and sent.
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert jaccard._perhaps(docs, wanted.limit(0)).count() == 0


def test_sets_of_pairs_come_in_passes(make_docs, spark, monkeypatch):
    """Many passes give the same components, and neither signatures nor sets of tokens are left on disk."""
    monkeypatch.setattr(jaccard, "PASS_TOKENS", 150, raising=False)
    monkeypatch.setattr(jaccard, "PASS_SHARE", 1_000, raising=False)
    passes = []
    monkeypatch.setattr(jaccard, "_tokens_of", lambda *a, f=jaccard._tokens_of: passes.append(a) or f(*a))
    rows = [(k, t) for k, (_, t) in enumerate(near_copies(7, 2, 10, 60, 1))] + [(0, "another text of the first id")]
    with noted() as paths:
        got = jaccard.jaccard_components(make_docs(rows), shingle=5, threshold=(4, 5)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components_at(rows, 5, (4, 5))
    assert len(passes) > 3
    left = [p for p in paths if os.path.isdir(p.removeprefix("file:"))]
    assert left and not {"s0", "toks", "signatures"} & {c for p in left for c in spark.read.parquet(p).columns}


def test_components_odd_tables(odd_docs, make_docs):
    assert jaccard.jaccard_components(odd_docs.withColumnRenamed("lang", "n_shingles")).count() == 8
    assert jaccard.jaccard_components(make_docs([])).count() == 0
    kept = jaccard.nearest_kept(odd_docs, jaccard.jaccard_components(odd_docs))
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, None: 2})


def brute_passages(rows):
    holders = defaultdict(set)
    split = {i: plain_words(t) for i, t in rows}
    for i, w in split.items():
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add(i)
    out = {}
    for i, w in split.items():
        hit, gone = set(), set()
        for k in range(len(w) - 49):
            who = holders[tuple(w[k : k + 50])]
            if len(who) > 1:
                hit.update(range(k, k + 50))
                if min(who) != i:
                    gone.update(range(k, k + 50))
        if hit:
            out[i] = (len(hit), len(gone))
    return out


def test_passages_brute_force(make_docs):
    rng = random.Random(6)
    passages = [[f"p{k}w{rng.randrange(30)}" for _ in range(n)] for k, n in enumerate((49, 50, 51, 80, 130))]
    rows = []
    for i in range(80):
        body = [f"t{rng.randrange(500)}" for _ in range(rng.randrange(120))]
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = p
        if i % 9 == 0:
            body += ["same"] * 120
        rows.append((i, " ".join(w.upper() if rng.random() < 0.2 else w for w in body)))
    docs = make_docs(rows)
    found = suffixes.repeated_passages(docs).collect()
    assert {r.doc_id: (r.n_repeated, r.n_removable) for r in found} == brute_passages(rows)
    cut = {r.doc_id: r.text for r in suffixes.without_spans(docs, suffixes.repeated_passages(docs)).collect()}
    gone = {r.doc_id: r.n_removable for r in found}
    assert {i: len(plain_words(t)) for i, t in cut.items()} == {i: len(plain_words(t)) - gone.get(i, 0) for i, t in rows}
    shares = suffixes.repeated_passages(docs, share=20).collect()
    assert {r.doc_id for r in shares} <= {r.doc_id for r in found}


@pytest.mark.parametrize("share", [1, 5, 20])
def test_passages_of_hot_grams(make_docs, share):
    """One gram that all documents have, in a passage of all, in passages of two documents each, and in periodic text."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(70)]
    rows = []
    for i in range(60):
        pair = [f"q{i // 2}w{k}" for k in range(40)]
        own = [f"o{i}w{rng.randrange(90)}" for _ in range(30)]
        body = [*own, *pair, *common[20:40], *pair, *own[::-1]] + (common if i % 3 else []) + (["same", "again"] * 40 if i % 7 == 0 else [])
        rows.append((i, " ".join(body)))
    expected = brute_passages(rows)
    assert len(expected) == len(rows)
    for s in (share, suffixes.SHARE):
        found = suffixes.repeated_passages(make_docs(rows), share=s).collect()
        assert {r.doc_id: (r.n_repeated, r.n_removable) for r in found} == expected


def test_passages_odd_tables(odd_docs, make_docs):
    assert suffixes.repeated_passages(odd_docs).count() == 0
    assert suffixes.repeated_passages(make_docs([])).count() == 0
    long = " ".join(f"v{i}" for i in range(60))
    spans = suffixes.repeated_passages(make_docs([(1, long), (1, long), (2, long), (None, long)])).collect()
    assert {(r.doc_id, r.n_repeated, r.n_removable) for r in spans} == {(1, 60, 0), (2, 60, 60)}


def brute_overlaps(rows, items, window):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    windows = defaultdict(set)
    for item, text in items:
        w = tokens(text)
        size = min(window, len(w))
        if size and item is not None:
            for k in range(len(w) - size + 1):
                windows[tuple(w[k : k + size])].add(str(item))
    out = {}
    for i, text in rows:
        w, hit, met = tokens(text), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if (names := windows.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    met |= names
        out[i] = (len(w), len(hit), sorted(met))
    return out


@pytest.mark.parametrize("window,item_words", [(10, 200_000), (4, 60), (1, 200_000)])
def test_overlaps_brute_force(make_docs, spark, window, item_words):
    rng = random.Random(11)
    some = lambda n: [rng.choice(["a", "B", "c1", "é", "dd"]) for _ in range(n)]
    items = [(k, rng.choice([" ", ", ", "\n"]).join(some(rng.choice([0, 1, 2, 5, 9, 10, 14, 30])))) for k in range(25)]
    items += [(None, "a b c1 a b"), (77, None), (78, "..."), (12, items[3][1])]
    rows = []
    for i in range(60):
        body = some(rng.randrange(25))
        if i % 2:
            body += (items[rng.randrange(25)][1]).replace(",", " ").split() + some(5)
        rows.append((i, rng.choice([" ", "; "]).join(body)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.overlaps(make_docs(rows), bench, window=window, item_words=item_words).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.hit_items) for r in found} == brute_overlaps(rows, items, window)


def test_overlaps_remove_spans_only(make_docs, spark):
    item = " ".join(f"q{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rest = " ".join(f"own{i}" for i in range(40))
    rows = [(1, f"{rest} «{item.upper()}!» end"), (2, rest), (3, item), (4, " ".join(item.split()[:9]))]
    got = {r.doc_id: r for r in decontaminate.overlaps(make_docs(rows), bench).collect()}
    # The opening mark is not ASCII and belongs to the first word.
    assert got[1].clean_text == f"{rest} «Q0 !» end"
    assert got[1].n_hit == 13 and not got[1].over_coverage
    assert got[2].clean_text == rest and got[3].over_coverage and got[4].n_hit == 0


def test_overlaps_odd_tables(odd_docs, make_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.overlaps(odd_docs.withColumnRenamed("lang", "n_hit"), none)
    assert found.columns == ["doc_id", "text", "source", "n_chars", *decontaminate.ADDED]
    assert {(r.n_hit, r.text == r.clean_text) for r in found.collect() if r.text is not None} == {(0, True)}
    assert decontaminate.overlaps(make_docs([]), none).count() == 0


@pytest.fixture(scope="module")
def corpus(make_docs, spark, tmp_path_factory):
    """Good and bad texts, common lines, near copies and benchmark passages of three sources."""
    rng = random.Random(21)
    syllables = ["ra", "ti", "on", "ther", "er", "ing", "lo", "mu", "ve", "sa"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(3))
    common = "This line stands at the end of very many documents here."
    item = " ".join(word() for _ in range(20))
    rows, kind = [], {}
    for i in range(240):
        body = [word() for _ in range(90)]
        kind[i] = "bad" if i % 6 == 0 else "near" if i % 6 == 1 and i > 6 else "leak" if i % 6 == 2 else "clean"
        if kind[i] == "bad":
            body = [f"{w}###" for w in body]
        if kind[i] == "near":
            body = rows[i - i % 6 + 1 - 6][1].split("\n")[0].split()
            if i % 12 == 1:
                body[40] = word()
        if kind[i] == "leak":
            body[30:30] = item.split()
        rows.append((i, " ".join(body) + ("\n" + common if i % 3 else ""), f"s{i % 3}"))
    folder = tmp_path_factory.mktemp("corpus")
    make_docs(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(kind[i] != "bad")) for i in kind], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, kind, common, item


def test_pipeline_stages(corpus, spark):
    folder, rows, kind, common, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        seen.append({r.doc_id: r for r in out.collect()})
        docs = spark.createDataFrame(list(seen[-1].values()), out.schema)
    quality, lines, near, leaks, mixed = seen
    assert {i for i, k in kind.items() if k != "bad"} == set(quality)
    assert set(lines) == set(quality)
    last = max(i for i in quality if i % 3)
    assert {i for i, r in lines.items() if common in r.text} == {last}
    assert all(r.n_chars == len(r.text) for r in lines.values())
    expected = brute_components([(i, r.text) for i, r in lines.items()])
    assert set(near) == {i for i, _, c in expected if i == c} and len(near) < len(lines)
    assert set(leaks) == set(near)
    assert not any(item in r.text for r in leaks.values()) and any(item in r.text for r in near.values())
    assert all(leaks[i].text == near[i].text for i in near if kind[i] != "leak")
    assert {i: r.text for i, r in mixed.items()} == {i: r.text for i, r in leaks.items()}
    assert len({(r.mix_slot, r.mix_order) for r in mixed.values()}) == len(mixed)
    whole = {r.doc_id: (r.text, r.mix_slot, r.mix_order) for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {i: (r.text, r.mix_slot, r.mix_order) for i, r in mixed.items()}


def test_pipeline_odd_tables(odd_docs, make_docs, spark, tmp_path):
    spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd_docs.withColumn("score", F.lit(1)), make_docs([])):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, str(tmp_path)).count() <= 8
