"""Conversation prefix trie."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowsentry.llm import trie
from flowsentry.llm.queries import rebuilt
from oracle_check import check

SCHEMA = "conv_id long, turn int, role string, text string, node string, conv string"


def brute(convs):
    """{id: [(role, text), ...]} to the contract's rows, as a set."""
    members = defaultdict(list)
    for c, own in convs.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    out = set()
    for node, ids in members.items():
        below = [n for n in members if n[:len(node)] == node]
        ends = sorted(c for c in ids if len(convs[c]) == len(node))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        leaves = sum(1 for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in members))
        out.add((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), sum(len(m) == len(node) + 1 for m in below), leaves, saved,
                 hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def found(spark, rows, again=False):
    numbered = trie.turns(rows, "conv_id", "turn", "role", "text").cache()
    convs = numbered.filter("pos = 0").select("conv")
    built = trie.build(spark, rebuilt(numbered, convs) if again else numbered, convs)
    got = built.nodes.join(built.end_digests(), "node", "left")
    empty = hashlib.sha256(b"").hexdigest()
    rows = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256 or empty) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def conversations(rng, n, longest):
    texts = ["", "hi", "hé", "a", "b"]
    convs = {}
    for c in rng.sample(range(-40, 400), n):
        if convs and rng.random() < 0.5:
            own = list(rng.choice(list(convs.values())))
            own = own[:rng.randint(0, len(own))] + [("user", rng.choice(texts))] * rng.randint(0, 2)
        else:
            own = [(rng.choice(["user", "assistant", ""]), rng.choice(texts)) for _ in range(rng.randint(1, longest))]
        convs[c] = own or [("user", "hi")]
    return convs


@pytest.mark.parametrize("seed,shard_turns,shard_convs", [(1, 1 << 16, 1 << 12), (2, 10, 3), (3, 4, 2), (4, 1, 1)])
def test_trie_matches_brute_force(spark, monkeypatch, seed, shard_turns, shard_convs):
    monkeypatch.setattr(trie, "SHARD_TURNS", shard_turns)  # conversations above it are walked as a stream
    monkeypatch.setattr(trie, "SHARD_CONVERSATIONS", shard_convs)
    monkeypatch.setattr(trie, "PIECE", 2)
    convs = conversations(random.Random(seed), 40, 9)
    rows = [(c, t, r or None, x or None, "n", "c") for c, own in convs.items() for t, (r, x) in enumerate(own)]
    random.Random(seed).shuffle(rows)
    assert found(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(convs)


def test_hot_conversation_and_edges(spark):
    """Many copies of one conversation, null ids, null turns, repeated rows, and an empty table."""
    rows = [(c, t, "user", f"t{t}", "", "") for c in range(300) for t in range(3)]
    rows += [(500, None, "user", "first", "", ""), (500, 1, "user", "x", "", ""), (500, 1, "user", "x", "", ""), (None, 0, "user", "x", "", "")]
    want = {c: [("user", f"t{t}") for t in range(3)] for c in range(300)} | {500: [("user", "first"), ("user", "x"), ("user", "x")]}
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert found(spark, df) == brute(want)
    assert found(spark, df.limit(0)) == set()


def test_rebuilt_conversations(spark):
    import zlib
    convs = conversations(random.Random(9), 60, 12)
    want = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        want[c] = convs.get(base, [])[:h] + own[h:]
    assert any(not v for v in want.values())  # some have no turn left
    rows = [(c, t, r, x, "", "") for c, own in convs.items() for t, (r, x) in enumerate(own)]
    assert found(spark, spark.createDataFrame(rows, SCHEMA), again=True) == brute(want)


def test_ties_have_one_order(spark):
    """Turns of one number stand in the order of their digests, however the rows are dealt."""
    rows = [(c, 0, "user", x, "", "") for c in (1, 2) for x in ("p", "q", "r")]
    a = found(spark, spark.createDataFrame(rows, SCHEMA).repartition(1))
    assert a == found(spark, spark.createDataFrame(rows[::-1], SCHEMA).repartition(4))
    assert {r[3] for r in a} == {2}


def test_nodes_with_their_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", "", ""), (2, 0, "user", "a", "", ""), (2, 1, "assistant", "b", "", "")], SCHEMA)
    numbered = trie.turns(rows, "conv_id", "turn", "role", "text")
    built = trie.build(spark, numbered, numbered.filter("pos = 0").select("conv"))
    shown = built.with_turns(rows.select("conv_id", F.col("turn").alias("pos"), "role", "text"), "conv_id", "pos", "role", "text")
    assert {(r.conv_id, r.depth, r.role, r.text) for r in shown.collect()} == {(1, 0, None, None), (1, 1, "user", "a"), (2, 2, "assistant", "b")}


def test_query_matches_sql(spark):
    assert check(spark, "/root/testdata/sf0.001", ["op11_conversation_trie"], verbose=False)["op11_conversation_trie"][0] == "OK"
