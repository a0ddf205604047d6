"""Importance resampling: weights, scores and exact ranks."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from flowsentry.llm import resample
from oracle_check import check

LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, max_run):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i:i + n]) for n in range(1, max_run + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent, least, buckets, max_run, seed):
    def cells(text):
        return [zlib.crc32(f.encode()) % buckets for f in features(text, max_run)[1]]

    s, t = Counter(c for _, x in docs for c in cells(x)), Counter(c for x in target for c in cells(x))
    S, T, out = sum(s.values()), sum(t.values()), []
    for i, x in docs:
        own = cells(x)
        w = sum(math.floor(1000 * math.log((t[c] + 1) * (S + buckets) / ((s[c] + 1) * (T + buckets)))) for c in own)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, features(x, 1)[0]])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[:percent * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def corpus(rng, n):
    words = ["The", "of", "É", "straße", "x1", "don't", "a-b", "data", "spark", "größe"] + [f"w{i}" for i in range(50)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 19, 20, 21, 60])))) for i in range(n)]


@pytest.mark.parametrize("max_run,buckets,percent", [(1, 10_000, 10), (2, 97, 35), (3, 70_000, 100)])
@pytest.mark.parametrize("samples", [resample.SAMPLES, 7])
def test_draw_matches_brute_force(spark, monkeypatch, max_run, buckets, percent, samples):
    monkeypatch.setattr(resample, "SAMPLES", samples)
    rng = random.Random(max_run)
    docs = corpus(rng, 400)
    docs += [(7, docs[7][1]), (900, None), (901, ""), (None, docs[5][1]), (None, docs[6][1] + " spark")]
    docs += [(950, "hot row " * 15)] * 150  # ties in everything
    target = ["Spark data größe", None, "", "straße of spark"]
    df = spark.createDataFrame([(i, x, 1, "s") for i, x in docs], "doc_id long, text string, rank int, score string").repartition(6)
    aim = spark.createDataFrame([(x,) for x in target], "words string")
    got = resample.resample(spark, df, aim, id_col="doc_id", text_col="text", target_text="words", seed="2024", percent=percent, min_words=20,
                            buckets=buckets, max_run=max_run)
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    want = brute(docs, target, percent, 20, buckets, max_run, "2024")
    assert got.columns == ["id", "n_features", "weight", "score", "rank"]
    assert rows == want


def test_empty_tables_and_empty_target(spark):
    docs = spark.createDataFrame(corpus(random.Random(1), 30), "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    args = dict(id_col="doc_id", text_col="text", target_text="text", seed="s", percent=50, min_words=1)
    assert resample.resample(spark, none, docs, **args).count() == 0
    got = sorted((tuple(r) for r in resample.resample(spark, docs, none, **args).collect()), key=str)
    assert got == brute([tuple(r) for r in docs.collect()], [], 50, 1, 10_000, 1, "s")


def test_long_text_and_bounded_memo(spark, monkeypatch):
    monkeypatch.setattr(resample, "MEMO_BYTES", 1000)
    docs = [(1, " ".join(f"w{i % 5000}" for i in range(200_000))), (2, "x" * 300_000 + " y")]
    got = resample.resample(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("w1 w2",)], "text string"),
                            id_col="doc_id", text_col="text", target_text="text", seed="0", percent=100, min_words=1)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, ["w1 w2"], 100, 1, 10_000, 1, "0")


def test_query_matches_sql(spark):
    assert check(spark, "/root/testdata/sf0.001", ["op13_importance_resampling"], verbose=False)["op13_importance_resampling"][0] == "OK"
