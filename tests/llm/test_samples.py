"""Fill-in-middle samples and packed windows against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framelake.llm import fim, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_sample(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    low, high = sorted(x % (len(units) + 1) for x in (h1, h2))
    a, b, c = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    alphabet = ["a", "B", "z", " ", "\n", "é", "日", "😀", "<", ">", "P", "S", "M", "1", "\0", "ß", "<P", "S>", "<M>"]
    return ["".join(rng.choice(alphabet[: -1 if rng.random() < 0.9 else None]) for _ in range(rng.randrange(50))) for _ in range(n)]


@pytest.mark.parametrize("stretch", [1 << 21, 7])
def test_samples_equal_plain_version_and_round_trip(make_docs, stretch):
    rows = list(enumerate(["", "<P>", "plain <M> x", "é", "abc", *odd_texts(200)]))
    out = fim.fill_in_middle(make_docs(rows), stretch=stretch).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(rows)
    forms = Counter()
    for r in out:
        text = rows[r.doc_id][1]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_sample(r.doc_id, text), text
        assert r.back == text
        forms[r.form] += 1
    assert min(forms.values()) > 3 and len(forms) == 3


def test_exception_index_converts_both_ways():
    for text in ["", "abc", "é", "aé日😀b", *odd_texts(40, 5)]:
        data = np.frombuffer(text.encode(), np.uint8)
        index = fim.Exceptions.of(data)
        cuts = np.array([len(text[:i].encode()) for i in range(len(text) + 1)], np.int64)
        assert index.chars(cuts).tolist() == list(range(len(text) + 1))
        assert index.bytes(np.arange(len(text) + 1)).tolist() == cuts.tolist()
        assert len(index.at) == sum(len(c.encode()) > 1 for c in text)


def test_long_text_in_stretches_equals_whole():
    text = ("word é日 " * 400_000).encode()
    data = np.frombuffer(text, np.uint8)
    draws = np.array([123_456_789, 987_654_321])
    whole = fim.cuts_of_many(data, np.array([0, len(data)]), draws[:, None])
    assert [int(x[0]) for x in whole] == [int(x[0]) for x in fim.cuts_of_long(data, draws, 1 << 16)]


def test_samples_odd_tables(odd_docs, make_docs):
    out = fim.fill_in_middle(odd_docs.withColumnRenamed("lang", "h1").withColumnRenamed("source", "output")).collect()
    assert Counter(r.doc_id for r in out) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 2, None: 2})
    assert {r.output for r in out if r.doc_id == 5} == {brute_sample(5, "A b")[4]}
    assert fim.fill_in_middle(make_docs([])).count() == 0


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def test_pieces_encode_as_whole_texts(whole):
    rng = random.Random(8)
    alphabet = ["a", "b", " ", " ", "\n", "\t", "'s", "é", "日", "\xa0", "　", "\x1c", "\x85", "\0", "1", ".", "<|endoftext|>", "​", "\r\n"]
    alphabet += [",", "!", "?.", "b,", "é."]
    encoder = packing.Encoder(whole.to_str(), np.uint16, remembered=50)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(2000)]
    texts += [" ".join(rng.choice(["a", "bé,", "it's", "1.\nX"]) for _ in range(rng.randrange(9))) for _ in range(200)]
    rng.shuffle(texts)
    for text, ids in [(t, i) for a in range(0, 2200, 20) for t, i in zip(texts[a : a + 20], encoder(pa.array(texts[a : a + 20])))]:
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def checked_sequences(rows, docs, whole, window):
    """Every token in one piece, sequences gapless; returns them as lists of (doc_id, length)."""
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.length > 0
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append(r)
    for doc_id, text in docs:
        parts = sorted(of_doc[doc_id], key=lambda r: r.start)
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        assert [i for r in parts for i in np.frombuffer(r.ids, "<u4")] == ids
        assert [r.start for r in parts] == np.cumsum([0, *(r.length for r in parts[:-1])]).tolist()
        assert {r.doc_tokens for r in parts} == {len(ids)}
    sequences = []
    for parts in of_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0, *(r.length for r in parts[:-1])]).tolist()
        total = sum(r.length for r in parts)
        assert total <= window and total & (total - 1) == 0
        sequences.append([(r.doc_id, r.length) for r in parts])
    return sequences


def topic_docs(n):
    rng = random.Random(1)
    topics = [[f"t{t}x{rng.randrange(10**6)}" for _ in range(30)] for t in range(8)]
    return [(i, " ".join(rng.choice(topics[i % 8]) for _ in range(rng.randrange(1, 40)))) for i in range(n)]


@pytest.mark.parametrize("shard_docs", [5, 4096])
def test_packing_keeps_every_token_once(make_docs, whole, shard_docs):
    docs = topic_docs(150) + [(900, None), (901, ""), (902, " ".join(f"long{i}" for i in range(3000))), (903, "same"), (904, "same")]
    rows = packing.pack_documents(make_docs(docs), PATH, window=256, shard_docs=shard_docs).collect()
    sequences = checked_sequences(rows, docs, whole, 256)
    short = [s for s in sequences if sum(n for _, n in s) < 256]
    assert len(short) <= 8 * 4


def test_windows_hold_lexical_neighbours(make_docs, whole):
    """Of the documents that share a window with a seed, far more are of its topic than by chance (one in eight)."""
    docs = topic_docs(400)
    sequences = checked_sequences(packing.pack_documents(make_docs(docs).coalesce(1), PATH, window=2048).collect(), docs, whole, 2048)
    near = [a % 8 == b % 8 for s in sequences for (a, _), (b, _) in zip(s, s[1:])]
    assert sum(near) > 0.5 * len(near)


def test_scores_equal_plain_bm25():
    rng = np.random.default_rng(2)
    pieces = [packing.Piece(i, 0, 0, rng.integers(0, 60, rng.integers(1, 30)).astype(np.uint16)) for i in range(40)]
    index = packing.ShardIndex(pieces, 64)
    sets, mean = [Counter(p.ids.tolist()) for p in pieces], np.mean([len(p.ids) for p in pieces])
    df = Counter(t for s in sets for t in s)
    for q in (0, 7, 39):
        expected = [
            sum(
                max(0.0, np.log((40 - df[t] + 0.5) / (df[t] + 0.5))) * s[t] * 2.2 / (s[t] + 1.2 * (0.25 + 0.75 * len(p.ids) / mean))
                for t in sets[q] if t in s
            )
            for s, p in zip(sets, pieces)
        ]
        assert np.allclose(index.scores(q), expected)


def test_packing_odd_tables(odd_docs, make_docs):
    pieces = packing.pack_documents(odd_docs.withColumnRenamed("lang", "ids").withColumnRenamed("source", "k1"), PATH)
    rows = pieces.collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 2, None: 2})
    assert {r.doc_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    joined = packing.windows(pieces).collect()
    assert sum(r.n_tokens for r in joined) == sum(r.length for r in rows) == sum(len(r.ids) // 4 for r in joined)
    assert packing.pack_documents(make_docs([]), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(odd_docs, public_tokenizers.path("word_bpe_49k.json"))
