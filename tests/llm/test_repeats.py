"""Quality rules by suffix arrays."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.llm import repeats
from flowsentry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(text, least, window):
    """Everything from the definitions: all substrings of words that occur twice."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    occurs, covered, seen, longest, maximal = {}, set(), set(), 0, 0
    for a in range(len(w)):
        for n in range(least, len(w) - a + 1):
            occurs.setdefault(tuple(w[a:a + n]), []).append(a)
    for s, at in occurs.items():
        if len(at) < 2:
            continue
        covered.update(x for a in at for x in range(a, a + len(s)))
        longest = max(longest, len(s))
        left = {w[a - 1] if a else ("", a) for a in at}
        right = {w[a + len(s)] if a + len(s) < len(w) else ("", a) for a in at}
        maximal += len(left) > 1 and len(right) > 1
    windows = {}
    for a in range(len(w) - window + 1):
        windows.setdefault(tuple(w[a:a + window]), []).append(a)
    for at in windows.values():
        if len(at) > 1:
            seen.update(x for a in at for x in range(a, a + window))
    lines, dup, before = t.split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in before
            before.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(seen), len(covered), longest, maximal, covered)


def row(r):
    x = r.rules
    return (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.n_covered, x.longest, x.n_repeats,
            {p for s in x.spans for p in range(s.first, s.last)})


def texts(rng, n):
    out = [None, "", " \t\n\v\f\r", "one", "\n\n", "a b   c", "É É É É É É É É É É É", "x\x00y x\x00y", "# * $%&|<>", "l\nl\n l\nl"]
    for _ in range(n):
        v = rng.randint(1, 5)
        w = [str(rng.randrange(v)) for _ in range(rng.choice([3, 8, 20, 45]))]
        if rng.random() < 0.5:
            w += ["É"] + w[rng.randint(0, len(w) - 1):]
        out.append("".join(x + rng.choice([" ", "\n", "  ", "\t"]) for x in w))
    return out


@pytest.mark.parametrize("block,seed", [(1 << 17, 1), (30, 2), (1, 3)])
def test_rules_match_brute_force(spark, monkeypatch, block, seed):
    monkeypatch.setattr(repeats, "BLOCK_WORDS", block)
    rng = random.Random(seed)
    some = texts(rng, 60)
    rows = [(i, t, "kept", 7) for i, t in enumerate(some)] + [(None, some[20], "kept", 7), (3, some[20], "kept", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, rules int").repartition(3)
    got = repeats.with_rules(docs, "text").collect()
    assert len(got) == len(rows) and {r.n_words for r in got} == {"kept"}
    for r in got:
        assert row(r) == brute(r.text, 5, 8), r.text


@pytest.mark.parametrize("least,window", [(5, 8), (8, 5), (6, 13)])
def test_other_lengths(least, window):
    rng = random.Random(least)
    for _ in range(60):
        w = [str(rng.randrange(2)) for _ in range(rng.randint(0, 50))]
        got = repeats.repetition(w, np.array([0, len(w)]), least, window)
        want = brute(" ".join(w), least, window)
        assert (got["n_repeat_words"][0], got["n_covered"][0], got["longest"][0], got["n_repeats"][0]) == want[4:8]


def test_long_periodic_text(spark):
    n = 120_000
    docs = spark.createDataFrame([(1, "a b c " * n), (2, " ".join(f"w{i}" for i in range(n)))], "doc_id long, text string")
    got = {r.doc_id: r.rules for r in repeats.with_rules(docs, "text").collect()}
    assert (got[1].n_covered, got[1].longest, [tuple(s) for s in got[1].spans]) == (3 * n, 3 * n - 3, [(0, 3 * n)])
    assert (got[2].n_covered, got[2].longest, got[2].spans) == (0, 0, [])


def test_empty_table_and_limits(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.with_rules(docs, "text").count() == 0
    with pytest.raises(ValueError):
        repeats.with_rules(docs, "text", least=4)
    line = "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 "
    said = " ".join(f"x{i}" for i in range(60))
    rows = [(1, line * 30), (2, said), (3, said + " " + line + " y " + line), (4, "a b c d e f " * 4), (5, "short text")]
    got = repeats.with_rules(spark.createDataFrame(rows, "doc_id long, text string"), "text", spans=False)
    kept = {r.doc_id: (r.f, r.v) for r in got.select("doc_id", repeats.base_failed(F.col("rules")).alias("f"), repeats.verdict(F.col("rules")).alias("v")).collect()}
    assert kept == {1: (True, False), 2: (False, True), 3: (False, True), 4: (True, False), 5: (True, True)}


def test_query_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 4000").collect()}
    got = [r for r in QUERIES["op12_repetition_rules"](spark, SF).collect() if r.doc_id in docs]
    assert len(got) == len(docs) > 100
    for r in got:
        want = brute(docs[r.doc_id], 5, 8)
        n = want[0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_covered, r.longest, r.n_repeats) == want[:8]
        failed = n < 20 or 100 * want[4] > 30 * n
        assert (r.base_failed, r.kept) == (failed, not failed and 100 * want[5] <= 50 * n and want[6] <= 100)
