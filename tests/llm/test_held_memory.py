"""What the pipeline's operators hold at once: tables on disk, texts in memory."""

import os
import time

import numpy as np
import pyarrow as pa


def test_jaccard_keeps_no_table_that_is_spent(spark):
    from flowsentry.llm import jaccard
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 500, 60) for _ in range(30)]
    texts = [" ".join(f"w{x}" for x in np.where(rng.random(60) < 0.01 * (i % 3), 999, base[i % 30])) for i in range(150)] + [None, "", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    join = jaccard.Join(spark, docs, "doc_id", "text", 4, 85)
    out = join.run()
    folder = join.ws.base.replace("file:", "")
    assert os.listdir(folder) == [f"result-{join.round}"]
    sets = [{tuple(t.split()[i:i + 4]) for i in range(max(1, len(t.split()) - 3))} if t and t.split() else set() for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if all(comp[comp[i]] == comp[i] for i in comp):
            break
    assert {r["id"]: r["component"] for r in out.collect()} == dict(enumerate(comp))


def test_jaccard_steps_leave_no_shuffle_files(spark):
    from flowsentry.llm import jaccard
    docs = spark.createDataFrame([(i, f"a b c {i}") for i in range(200)], "doc_id long, text string")
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    held = lambda: {f for f in (files.apply(i).getName() for files in [disk.getAllFiles()] for i in range(files.size())) if f.startswith("shuffle_")}
    join = jaccard.Join(spark, docs, "doc_id", "text", 4, 85)
    before = held()
    kept = join.save(docs.repartition(5, "text").groupBy("text").count(), "counted")
    ends = time.time() + 20
    while held() - before and time.time() < ends:
        time.sleep(0.2)
    assert not held() - before and kept.count() == 200


def test_only_wanted_classes_reach_the_shuffle(spark):
    from flowsentry.llm import jaccard
    rows = spark.range(5000).selectExpr("id as cid", "id % 7 as n")
    got = jaccard.among(rows, rows.filter("cid % 100 = 3").select("cid"), "cid")
    assert got.columns == rows.columns
    found = {r["cid"] for r in got.collect()}
    assert found >= {i for i in range(5000) if i % 100 == 3} and len(found) < 100


def test_texts_are_indexed_in_pieces(spark, monkeypatch):
    from flowsentry.llm import decontam
    monkeypatch.setattr(decontam, "PIECE_BYTES", 64)
    item = "one two three four five six seven eight nine ten"
    texts = [f"a b {item} c" if i % 3 == 0 else None if i % 7 == 0 else f"lone words {i} " * (i % 5) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("x", item)], "item_id string, text string")
    got = {r["id"]: r for r in decontam.contamination(spark, docs, items, id_col="doc_id", text_col="text", item_id="item_id", item_text="text").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i]["n_words"] == len((t or "").split())
        assert [(s["first"], s["last"]) for s in got[i]["spans"]] == ([(2, 12)] if i % 3 == 0 else [])


def test_python_tasks_get_small_batches(spark):
    from flowsentry.llm.common import arrow_rows
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    with arrow_rows(spark, 10):
        assert max(r["n"] for r in spark.range(100).coalesce(1).mapInArrow(sizes, "n long").collect()) == 10
    assert spark.conf.get(name) == usual


def test_stages_bound_batches_whoever_writes_their_result(spark, tmp_path, monkeypatch):
    """Python tasks get BATCH_ROWS rows at most and have one worker, also if a stage's result is written later."""
    import corpus_pipeline
    from pyspark.sql.classic.dataframe import DataFrame
    rng = np.random.default_rng(5)
    words = "the of and to in that with from which their about river house stone paper under after".split()
    rows = [(i, " ".join(rng.choice(words, 40)) + ".", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    sf = str(tmp_path)
    spark.createDataFrame([("x", " ".join(words[:12])), ("y", rows[7][1])], "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, float(i % 2)) for i in range(300)], "doc_id long, quality double").write.parquet(f"{sf}/labels.parquet")
    plain, name = DataFrame.mapInArrow, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)

    def checked(self, func, *args, **kwargs):
        def run(batches):
            def bounded():
                for b in batches:
                    assert b.num_rows <= 50, f"{b.num_rows} rows in a batch"
                    yield b
            return func(bounded())
        return plain(self, run, *args, **kwargs)

    monkeypatch.setattr(corpus_pipeline, "BATCH_ROWS", 50)
    monkeypatch.setattr(DataFrame, "mapInArrow", checked)
    try:
        for step, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert str(out._jdf.queryExecution().executedPlan()).count("MapInArrow") <= 1, step
            found = {r.doc_id for r in out.select("doc_id").collect()}
            out.write.format("noop").mode("overwrite").save()
            if step == "decontamination":
                assert 7 not in found and found
    finally:
        spark.conf.set(name, usual)
