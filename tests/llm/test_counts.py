"""Token counts, line dedup, host rules, license scans and mixing on small tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framelake.llm import hosts, licenses, lines, mixing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
BLANKS = " \t\n\x0b\x0c\r"


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_token_counts_equal_whole_texts(make_docs):
    whole = Tokenizer.from_file(PATH)
    bodies = [None, "", "  ", "a  b\n\nc", "It's <|startoftext|>x <|endoftext|> y", "ΣΑΣ ΟΔΟΣ İstanbul", "é ́x", "日本語 テスト", "a\tb c d",
              "don't we'll\nI'M", "x" * 5000, " ".join(f"w{i}" for i in range(4000))]
    rng = random.Random(4)
    alphabet = "abAB1' \n\t́éßΣ<|>endoftext日​\x1c\x85"
    bodies += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    got = by_id(tokens.token_counts(make_docs(list(enumerate(bodies))), PATH, limit=100, batch_bytes=500))
    for i, body in enumerate(bodies):
        n = len(whole.encode(body or "", add_special_tokens=False))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((body or "").encode()), n > 100), body


def test_token_counts_odd_tables(odd_docs, make_docs):
    rows = tokens.token_counts(odd_docs.withColumnRenamed("lang", "n_tokens"), PATH).collect()
    assert Counter(r.doc_id for r in rows) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 2, None: 2})
    assert tokens.token_counts(make_docs([]), PATH).count() == 0
    with pytest.raises(ValueError):
        tokens.token_counts(odd_docs, public_tokenizers.path("byte_bpe_50k.json"))


def brute_lines(rows, min_chars, min_docs):
    key = lambda line: ascii_lower(line.strip(BLANKS))
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = {}
    for i, text in rows:
        parts = (text or "").split("\n")
        kept = [p for p in parts if not (len(holders[key(p)]) >= min_docs and max(holders[key(p)]) != i)]
        out[i] = ("\n".join(kept), len(parts), len(parts) - len(kept))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (5, 3)])
def test_line_dedup_brute_force(make_docs, batches, fanout):
    rng = random.Random(7)
    pool = [f"{'Shared' if i % 2 else 'SHARED'} line number {i % 9} of the pool é" for i in range(18)] + ["short", "", " \t"]
    rows = [(i, None if i == 3 else "\n".join(rng.choice(["", "  ", "\x0b"]) + rng.choice(pool) + rng.choice(["", " \r"]) for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    got = by_id(lines.dedup_lines(make_docs(rows), min_chars=12, min_docs=5, batches=batches, fanout=fanout))
    expected = brute_lines(rows, 12, 5)
    assert {i: (r.text, r.n_lines, r.n_dropped) for i, r in got.items()} == expected
    assert any(v[2] for v in expected.values())


def test_line_dedup_odd_tables(odd_docs, make_docs, spark):
    cut = lines.dedup_lines(odd_docs.withColumnRenamed("lang", "n_lines"), min_chars=1, min_docs=2)
    assert cut.columns == ["doc_id", "text", "source", "n_chars", "n_lines", "n_dropped"]
    assert cut.count() == 8
    assert {r.text for r in cut.where("doc_id = 5").collect()} == {"A b"}
    assert lines.dedup_lines(make_docs([])).count() == 0


def test_runs_tell_new_lines_and_stay_few(spark):
    runs = lines.LineRuns(spark, fanout=2)
    for b in range(7):
        rows = [(k, k, 100 * b + k) for k in range(b, b + 3)]
        path = runs.add(spark.createDataFrame(rows, "k1 long, k2 long, doc_id long"))
        fresh = spark.read.parquet(path) if path in runs.all_paths() else None
        if fresh is not None:
            assert {r.k1 for r in fresh.where("fresh").collect()} == ({0, 1, 2} if b == 0 else {b + 2})
    assert len(runs.all_paths()) == 3
    total = {r.k1: (r.n, r["last"]) for r in runs.totals().collect()}
    assert total[3] == (3, 303) and total[8] == (1, 608) and total[0] == (1, 0)


def brute_counts(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = {i + k for i in range(len(ws) - 2) if tri[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    full = [p for p in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", p)]
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(hit))


def test_host_rules_brute_force(make_docs):
    rng = random.Random(2)
    texts = ["\n".join(" ".join(rng.choice(["a", "b", "é#", "dd", "x|"]) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(8))) for _ in range(80)]
    texts += [None, "", "\n \n \n", "same same same same", "q w e\nq w e\n q w e"]
    rows = [(i, t, f"h{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    got = by_id(hosts.judge_documents(make_docs(rows)))
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in hosts.COUNTS) == brute_counts(t), t
        n, *_, repeats = brute_counts(t)
        assert got[i].base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (got[i].base_failed and got[i].kept)


def test_rejected_host_loses_only_failing_documents(make_docs):
    clean = " ".join(f"plain{i}" for i in range(60))
    symbols = " ".join(f"plain{i}#" for i in range(60))
    rows = [(i, symbols if i % 10 else clean, "bad") for i in range(200)] + [(1000 + i, symbols if i == 7 else clean, "good") for i in range(200)]
    got = by_id(hosts.judge_documents(make_docs(rows)))
    assert {i for i, r in got.items() if not r.kept} == {i for i in range(200) if i % 10}


def test_host_rules_odd_tables(odd_docs, make_docs):
    assert hosts.judge_documents(odd_docs.withColumnRenamed("lang", "kept")).count() == 8
    assert hosts.judge_documents(make_docs([])).count() == 0


def test_license_sequences(make_docs):
    s = licenses.SENTENCES
    mit = f"Copyright (c) 2024 Somebody\n\n{s['mit-grant']}:\n\n{s['mit-notice']}.\n\n{s['mit-asis']}. {s['mit-liability']}."
    wrapped = re.sub(r"((?:\S+ ){9}\S+) ", r"\1\n", f"MIT License\n\n{mit}")
    bsd2 = f"{s['bsd-grant']}:\n1. {s['bsd-source']}.\n2. {s['bsd-binary']}."
    cases = {
        1: (wrapped, "MIT"), 2: (f"Text without end\n{s['gpl3-line']}.", "GPL-3.0-only"), 3: (bsd2, "BSD-2-Clause"),
        4: (bsd2.replace("1. ", "").replace("2. ", ""), "BSD-2-Clause"),
        5: (bsd2.replace("1. ", "").replace("2. ", "") + f"\n{s['bsd-names']}.", "BSD-3-Clause"),
        6: (f"{s['mit-notice']}. {s['mit-grant']}:", ""), 7: ("The license is mit.", ""), 8: (None, ""), 9: ("", ""),
        10: (f"{s['cc-by-nc-line']}.\n{s['apache2-line']}.", "Apache-2.0,CC-BY-NC-4.0"),
    }
    got = by_id(licenses.scan_licenses(make_docs([(i, t) for i, (t, _) in cases.items()])))
    assert {i: ",".join(r.licenses) for i, r in got.items()} == {i: v for i, (_, v) in cases.items()}


def test_license_odd_tables(odd_docs, make_docs):
    found = licenses.scan_licenses(odd_docs.withColumnRenamed("lang", "licenses"))
    assert found.count() == 8 and found.where("size(licenses) > 0").count() == 0
    assert licenses.scan_licenses(make_docs([])).count() == 0


@pytest.mark.parametrize("share", [{0: 1, 1: 1, 2: 1}, {0: 500, 1: 300, 2: 199, 3: 1}, {0: 7}, {i: i + 1 for i in range(30)}])
def test_edf_keeps_every_window(share):
    cycle = mixing.edf_cycle(share)
    length, got = cycle.length, Counter()
    assert length == sum(share.values()) == len(cycle.blocks)
    for i, k, release, deadline, slot in cycle.blocks:
        assert release <= slot < deadline
        got[i] += 1
        assert got[i] == k
        assert all(abs(got[j] * length - share[j] * (slot + 1)) < length for j in share)


def test_mixing_places_every_document_once(make_docs):
    rng = random.Random(1)
    rows = [(i, "t", rng.choices(["a", "b", "c", None], [60, 25, 10, 5])[0]) for i in range(700)]
    rows.append((5, "t", "a"))
    df = mixing.mix_sources(make_docs(rows), {"a": 0.5, "b": 0.3, "c": 0.2}, block_docs=4, cycle=10).collect()
    assert Counter((r.doc_id, r.source) for r in df) == Counter((i, s) for i, _, s in rows)
    assert len({(r.mix_slot, r.mix_order) for r in df}) == len(df)
    slots = {r.mix_slot: (r.source, r.mix_phase) for r in df}
    assert sorted(slots) == list(range(len(slots)))
    blocks = Counter(r.source for r in df)
    for phase in {p for _, p in slots.values()}:
        inside = sorted(s for s, (_, p) in slots.items() if p == phase)
        present = {slots[s][0] for s in inside}
        share = {x: max(1, round(10 * {"a": 0.5, "b": 0.3, "c": 0.2}.get(x, 0))) for x in blocks if x in present}
        total, got = sum(share.values()), Counter()
        for n, s in enumerate(inside, 1):
            got[slots[s][0]] += 1
            assert all(abs(got[x] - n * share[x] / total) < 1 for x in share)


@pytest.mark.parametrize("weights", [[0.13958] + [0.0452864] * 19, [0.9] + [0.00004] * 2500, [1 / 3, 0.5**0.5, 2e-7]])
def test_schedule_keeps_unrounded_weights(weights):
    """Also from a carried state, and with weights far below a thousandth."""
    whole = mixing.whole_weights(weights)
    assert all(a * whole[0] == b for a, b in zip([Fraction(str(w)) / Fraction(str(weights[0])) for w in weights], whole))
    sizes, total, n = [10**9] * len(weights), sum(whole), 30_000
    schedule, got, blocks = mixing.Schedule(sizes, whole), Counter(), []
    for part in (n // 3, n - n // 3):
        schedule = mixing.Schedule(sizes, whole, schedule.state)
        blocks += list(schedule.run(part))
    assert blocks == list(mixing.Schedule(sizes, whole).run(n))
    for t, (i, k, _, release, deadline, slot) in enumerate(blocks, 1):
        assert slot == t - 1 and release <= slot < deadline and k == got[i]
        got[i] += 1
        assert abs(got[i] * total - whole[i] * t) < total
        if t % 1000 == 0:
            assert all(abs(got[j] * total - whole[j] * t) < total for j in range(len(whole)))


def test_mixing_keeps_unrounded_weights(make_docs, monkeypatch):
    """A share of a rounded to thousandths is over a block off after 3,000 slots; slots of many intervals fit together."""
    monkeypatch.setattr(mixing, "INTERVAL", 500)
    weights = {"a": 0.1405, "b": 0.8595}
    rows = [(i, "t", "a" if i < 900 else "b") for i in range(6000)]
    found = mixing.mix_sources(make_docs(rows), weights, block_docs=1).where("mix_phase = 0").orderBy("mix_slot").collect()
    assert [r.mix_slot for r in found] == list(range(len(found))) and len(found) > 3000
    got = Counter()
    for t, r in enumerate(found, 1):
        got[r.source] += 1
        assert all(abs(got[s] - w * t) < 1 for s, w in weights.items())


def test_mixing_odd_tables(odd_docs, make_docs):
    assert mixing.mix_sources(odd_docs.withColumnRenamed("lang", "mix_slot")).count() == 8
    assert mixing.mix_sources(make_docs([])).count() == 0
    ordered = mixing.in_mixed_order(mixing.mix_sources(make_docs([(i, "t", f"s{i % 3}") for i in range(100)]), block_docs=2)).collect()
    assert [(r.mix_slot, r.mix_order) for r in ordered] == sorted((r.mix_slot, r.mix_order) for r in ordered)


def test_digest_is_hex(make_docs, spark, tmp_path):
    from framelake.llm.queries import op2_line_dedup

    make_docs([(1, None), (2, "x\ny")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(op2_line_dedup(spark, str(tmp_path)))
    assert got[1].kept_sha256 == hashlib.sha256(b"").hexdigest() and got[2].kept_sha256 == hashlib.sha256(b"x\ny").hexdigest()
