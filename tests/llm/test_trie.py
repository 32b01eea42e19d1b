"""The conversation trie against a plain version, with many shards and conversations cut into rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm import trie

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def plain(rows, upto=4):
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv_id].append((turn is not None, turn or 0, digest, role, text))
    own = {k: [x[3:] for x in sorted(v)] for k, v in turns.items()}
    members = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % upto
        path = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, d == len(path)))
    out = {}
    for node in sorted(members, key=len, reverse=True):
        low = min(c for c, _ in members[node])
        below = [n for n in members if len(n) == len(node) + 1 and n[: len(node)] == node]
        words = len(node[-1][1].split()) if node else 0
        saved = (len(members[node]) - 1) * words + sum(out[n][5] for n in below)
        leaves = sum(out[n][4] for n in below) if below else 1
        out[node] = [low, len(node), len(members[node]), len(below), leaves, saved, ",".join(str(c) for c in sorted(c for c, e in members[node] if e))]
    return Counter((v[0], v[1], out[n[:-1]][0] if n else None, v[2], v[3], v[4], v[5], hashlib.sha256(v[6].encode()).hexdigest()) for n, v in out.items())


def found(spark, rows, **options):
    turns, ids = trie.share_openings(trie.numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    result = trie.prefix_trie(turns, ids, **options)
    joined = result.nodes.join(trie.ends_digest(result.ends), ["conv_id", "depth"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))
    )
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r) for r in joined.select(*names).collect())


def conversations(n, most, words, seed):
    """Random walks over few texts, so that paths are shared, with copies of one conversation in a third of the ids."""
    rng = random.Random(seed)
    hot = [("user" if t % 2 else None, " ".join(["x"] * (t + 1))) for t in range(most)]
    rows = []
    for i in range(n):
        c = rng.randrange(10 * n)
        if i % 3 == 0:
            rows += [(c, t, *turn) for t, turn in enumerate(hot[: rng.choice([most, most, most // 2])])]
        else:
            rows += [(c, t, "user", rng.choice(words)) for t in range(rng.randrange(1, most + 1))]
    return rows


@pytest.mark.parametrize("levels,shards", [(64, 1), (64, 7), (3, 5), (2, 9), (1, 4)])
def test_trie_equals_plain_version(spark, levels, shards):
    rows = conversations(60, 9, ["a", "b c", "", "d e f"], seed=levels + shards)
    assert found(spark, rows, levels=levels, shards=shards) == plain(rows)


def test_equal_conversations_over_many_shards(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 4000, 20) for t in range(5)]
    rows += [(c, t, "user", f"turn {t}") for c in range(4000, 4200, 20) for t in range(7)]
    for levels in (64, 2):
        assert found(spark, rows, levels=levels, shards=12) == plain(rows)


def test_nulls_ties_and_turnless_conversations(spark):
    rows = [
        (1, None, None, None), (1, 0, "a", None), (1, 0, "a", "x"), (1, 0, "a", "x"), (None, 0, "a", "lost"), (20, 3, "u", "p"), (20, None, "u", "q r"),
        (21, 0, "u", "own"), (25, 0, "u", "z"), (33, 0, "u", "z"), (-7, 1, "u", "z"), (-20, 1, "u", "y"), (2**40, 5, "u", "z"),
    ]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, levels=1, shards=3) == plain(rows)
    assert not found(spark, [])


def test_ends_of_a_hot_node_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "ENDS", 7)
    rows = [(c, 0, "user", "same") for c in range(0, 2000, 20)]
    assert found(spark, rows, shards=3) == plain(rows)


def test_one_long_conversation_is_cut(spark):
    rows = [(20, t, "user", f"t{t}") for t in range(700)] + [(40, t, "user", f"t{t}") for t in range(500)] + [(60, t, "user", f"t{t % 600}") for t in range(650)]
    assert found(spark, rows, levels=16, shards=4) == plain(rows)


def test_other_columns_do_not_matter(spark):
    table = spark.createDataFrame([(1, 0, "u", "a b")], SCHEMA)
    for name in ("digest", "place", "words", "stretch", "key", "h"):
        table = table.withColumn(name, F.lit("other"))
    turns, ids = trie.share_openings(trie.numbered_turns(table))
    assert trie.prefix_trie(turns, ids).nodes.count() == 1 + turns.count()
