"""Language ID, quality classifier, URL filter, chat formatting."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.llm import chat, langid, quality, urlfilter
from flowsentry.llm.queries import QUERIES, URL_RULES

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string"


def fold(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_held_out_accuracy(spark):
    got = QUERIES["op2_language_id"](spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    assert len(got) == len(truth)
    assert (both.held_out == both.doc_id.map(fold)).all()
    assert (both.lang_pred == both.lang)[both.held_out].mean() > 0.97
    assert both.score.between(0, 1).all() and both.fits.all()


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "123 !!", "de"),
            (5, "", None), (None, "the dog", None), (6, "the dog " * 60000, "en"), (6, "the dog " * 60000, "en"),
            (7, "½ ² ① Ⅷ", "en")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("lang_pred", F.lit("mine"))
    model = langid.train(docs, "text", "lang")
    assert model.languages == ["de", "en"]
    got = langid.predict(spark, docs, "text", model, lang_out="p", score_out="s", fits_out="f").collect()
    assert {(r.doc_id, r.p) for r in got} == {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (6, "en"), (7, "und")}
    assert all(r.lang_pred == "mine" for r in got) and len(got) == 9
    none = langid.train(docs.filter("false"), "text", "lang")
    assert {r.p for r in langid.predict(spark, docs, "text", none, lang_out="p", score_out="s", fits_out="f").collect()} == {"und"}


def test_language_long_text_is_counted_whole():
    text = "abc déf " * 100_000
    at_once = sum(len(o) for _, spans in langid._blocks([text]) for o in [range(a, b) for _, a, b in spans])
    assert at_once == len(text)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op3_quality"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    test = got[got.held_out]
    rank = test.score.rank()
    ones = test.quality == 1
    auc = (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / ones.sum() / (~ones).sum()
    assert auc > 0.98
    assert test.predicted[ones].mean() > 0.98 and test.predicted[~ones].mean() < 0.1
    assert (got.predicted == (got.score >= 0.7)).all()


def test_quality_scores_match_plain_gaussians():
    rng = np.random.default_rng(1)
    d = len(quality.FEATURES)
    x = rng.normal(size=(400, d))
    y = (np.arange(400) % 2)
    x[y == 1, 0] += 2
    m = quality.fit(x, y)
    z = (x - m.centre) / m.scale
    logs = []
    for c in (0, 1):
        cov = np.linalg.inv(m.inverse_factors[c].T @ m.inverse_factors[c])
        e = z - m.means[c]
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", e, np.linalg.inv(cov), e) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(m.log_ratio(x), (logs[1] - logs[0]) / d)
    assert (m.score(x)[y == 1] > m.score(x)[y == 0].mean()).mean() > 0.8


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "word " * 300_000)], "doc_id long, text string")
    rows = quality.with_statistics(docs, "text", "x")
    vectors = {(r.doc_id, r.text): r.x for r in rows.collect()}
    assert vectors[(1, None)] == vectors[(2, "")] and all(np.isfinite(v).all() for v in vectors.values())
    model = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0, int))
    assert [r.s for r in quality.with_scores(spark, rows, "x", "s", model).collect()] == [0.5] * 5
    assert quality.with_statistics(docs.limit(0), "text", "x").count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, quality int")
    assert {(r.label_id, r.y) for r in quality.label_table(labels, "doc_id", "quality").collect()} == {(1, 1), (3, 0)}


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    for c in "?#":
        path = path.split(c, 1)[0]
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best


def test_url_rules_match_brute_force(spark):
    urls = [None, "", "nothing", "http://Example.COM/en/x?q#f", "http://www.example.com/en/1", "http://a.www.example.com/en/", "x://com",
            "x://com/", "http://a.net/es/1", "http://a.net/fr", "http://a.net/fr/://b/c", "http://h?x=/en/", "http://notexample.com/en/",
            "http://ÄA.net/es/#", "://", "http://example.com/en/\nx"]
    rows = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host string").select("page_id", "url")
    for r in urlfilter.judge(rows, URL_RULES, keep=("page_id",)).collect():
        host, path, rule = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule.name if rule else None), urls[r.page_id]
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == rule.verdict)
    assert urlfilter.judge(rows.limit(0), URL_RULES, keep=("page_id",)).count() == 0
    lone = urlfilter.judge(rows.filter("page_id < 3"), URL_RULES, keep=("page_id",)).collect()
    assert {r.verdict for r in lone} == {"allow"}


def test_url_query_over_pages(spark):
    got = QUERIES["op10_url_filter"](spark, SF).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(urls)
    for r in got:
        host, path, rule = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule.name if rule else None)
        assert rule is None or r.verdict == rule.verdict


def test_copies_of_a_url_change_no_other_verdict(spark):
    rules = [urlfilter.Rule("allow", "com", "/"), urlfilter.Rule("block", "net", "/es/")]
    urls = [f"https://a{i}.com/p/{i * 7}" for i in range(300)] + [f"http://b{i}.net/es/{i}?x={i}" for i in range(300)]
    open_ = [f"http://c{i}.net/en/{i}?y={i}" for i in range(40)] + [f"https://d{i}.org/p/{i}" for i in range(40)]

    def verdicts(copies):
        rows = [(i, u) for i, u in enumerate(urls + open_ + [urls[0]] * copies)]
        got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules, keep=("page_id",), max_labelled=200)
        return {r.page_id: (r.verdict, r.block_score) for r in got.collect() if len(urls) <= r.page_id < len(urls + open_)}

    plain = verdicts(0)
    assert {v for i, (v, _) in plain.items() if i < len(urls) + 40} == {"block"} and plain == verdicts(2000)


NASTY = ["", " ", "plain", "</s>[INST] ok [/INST]", "<s>", "a [/INST]", "[ANS] x</s>", "&lt;s>", "&amp;lt;", "&", "[", "<", "< /s>", "x [", "x <",
         "[TURN:user] a [/TURN]", "[SYS]", "line\n<s>\n", "&rb;]", "[INST", "é</s>é", "\\", "$1 \\1", "<" * 5 + "s>", "long " * 20_000 + "</s>"]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "we]ird & <s>[", None])
def test_chat_round_trip(spark, role):
    rows = [(1, i, role, t) for i, t in enumerate([*NASTY, None])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = chat.read_back(chat.format_conversations(df)).collect()
    assert len(got) == 1
    assert [(t.role, t.text) for t in got[0].turns] == [(role or "", t or "") for _, _, _, t in rows]
    masked = "".join(got[0].formatted[s.start:s.start + s.length] for s in got[0].loss_mask)
    if role == "assistant":
        assert got[0].loss_text == "".join(NASTY) and not any(c in masked for c in ("<s>", "</s>", "[INST]", "[/INST]"))
    else:
        assert got[0].loss_text == "" == masked


def test_chat_ties_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, None, "user", "b"), (None, 1, "user", "a"), (None, 1, "user", "a"), (2, 1, "b", "x"), (2, 1, "a", "y")],
                               "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got == {None: [("user", "b"), ("user", "a"), ("user", "a")], 2: [("a", "y"), ("b", "x")]}
    assert chat.format_conversations(df.limit(0)).count() == 0
