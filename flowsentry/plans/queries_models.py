"""Catalogue part 4: neighbour-based models on ``embeddings`` (M4–M6, M9).

``embeddings`` rows are 64-dim vectors with a class 0–9; class 9 plays the
attack class.  The novelty split (X1) is keyed on ``vec_id``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safe import c
from ..operators import splits
from ..operators.knn import as_vector, knn
from ..operators.lof import fit_lof
from ..sources import fixtures
from .catalog import register

K = 5
K_LOF = 10


def emb(spark, sf):
    e = fixtures.read_table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"),
                    F.when(F.col("label") == 9, 1).otherwise(0).alias("Label"))


def emb_split(spark, sf):
    return splits.novelty_split(emb(spark, sf), ["vec_id"])


def novelty_cte(src: str, key: str, name: str = "ns") -> str:
    """X1 over ``src`` (with a 0/1 ``Label``), as CTE ``name`` (key, Label, split)."""
    h = f"md5(concat_ws('|', '42', 'split', CAST({key} AS VARCHAR)))"
    return f"""{name}r AS (SELECT {key}, "Label", row_number() OVER (PARTITION BY "Label" ORDER BY
  {h}, {key}) AS rk, COUNT(*) OVER (PARTITION BY "Label") AS n FROM {src}),
{name}b AS (SELECT *, CAST(ceil((1.0::DOUBLE - 0.6::DOUBLE) * n) AS BIGINT) AS tmp FROM {name}r),
{name}s AS (SELECT *, n - tmp AS tr, tmp - CAST(ceil((1.0::DOUBLE - 0.25::DOUBLE) * tmp) AS BIGINT)
  AS va FROM {name}b),
{name} AS (SELECT {key}, "Label", split FROM (SELECT {key}, "Label", CASE WHEN rk <= tr THEN
  (CASE WHEN "Label" = 0 THEN 'train' ELSE '_drop' END) WHEN rk <= tr + va THEN 'val'
  ELSE 'test' END AS split FROM {name}s) WHERE split <> '_drop')"""


EMB_CTE = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
  CASE WHEN label = 9 THEN 1 ELSE 0 END AS "Label" FROM embeddings)"""

KNN_SQL = f"""WITH {EMB_CTE},
d AS (SELECT a.vec_id AS q, b.vec_id AS r, list_distance(a.v, b.v) AS dist
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
rk AS (SELECT q, r, dist, row_number() OVER (PARTITION BY q ORDER BY dist, r) AS rank FROM d)
SELECT q, r, CAST(rank AS BIGINT) AS rank, ROUND(dist, 6) AS dist FROM rk WHERE rank <= {K}"""


@register("m4_knn_exact", KNN_SQL)
def m4_knn_exact(spark, sf):
    """M4: exact 5 nearest neighbours of every embedding (self excluded)."""
    v = as_vector(emb(spark, sf), "vec_id", "embedding")
    nb = knn(v, v, K, "euclidean", exclude_self=True)
    return nb.select("q", "r", F.col("rank").cast("long").alias("rank"),
                     F.round("dist", 6).alias("dist"))


@register("m4_knn_approx")
def m4_knn_approx(spark, sf):
    """M4, approximate mode: neighbours of every embedding by calibrated random projections."""
    v = as_vector(emb(spark, sf), "vec_id", "embedding")
    nb = knn(v, v, K, "euclidean", exclude_self=True, mode="approx", recall=0.95)
    return nb.select("q", "r", F.col("rank").cast("long").alias("rank"),
                     F.round("dist", 6).alias("dist"))


def _lof_sql(tail: str) -> str:
    return f"""WITH {EMB_CTE}, {novelty_cte('e', 'vec_id')},
tr AS (SELECT e.* FROM e JOIN ns USING (vec_id) WHERE ns.split = 'train'),
qs AS (SELECT e.*, ns.split FROM e JOIN ns USING (vec_id) WHERE ns.split <> 'train'),
nbt AS (SELECT * FROM (SELECT a.vec_id AS q, b.vec_id AS r, list_distance(a.v, b.v) AS dist,
          row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id)
          AS rank FROM tr a JOIN tr b ON a.vec_id <> b.vec_id) WHERE rank <= {K_LOF}),
kd AS (SELECT q AS r, dist AS kdist FROM nbt WHERE rank = {K_LOF}),
lrd AS (SELECT n.q AS r, 1.0 / (AVG(GREATEST(n.dist, kd.kdist)) + 1e-10) AS lrd
        FROM nbt n JOIN kd USING (r) GROUP BY n.q),
trs AS (SELECT n.q AS vec_id, -(AVG(l.lrd) / (1.0 / (AVG(GREATEST(n.dist, kd.kdist)) + 1e-10)))
        AS score FROM nbt n JOIN kd USING (r) JOIN lrd l USING (r) GROUP BY n.q),
nbq AS (SELECT * FROM (SELECT a.vec_id AS q, b.vec_id AS r, list_distance(a.v, b.v) AS dist,
          row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id)
          AS rank FROM qs a, tr b) WHERE rank <= {K_LOF}),
qsc AS (SELECT n.q AS vec_id, -(AVG(l.lrd) / (1.0 / (AVG(GREATEST(n.dist, kd.kdist)) + 1e-10)))
        AS score FROM nbq n JOIN kd USING (r) JOIN lrd l USING (r) GROUP BY n.q)
{tail}"""


def _lof(spark, sf):
    s = emb_split(spark, sf)
    return s, fit_lof(s.filter(c("split") == "train"), "embedding", ["vec_id"],
                      n_neighbors=K_LOF, metric="euclidean")


@register("m5_lof_fit", _lof_sql("SELECT vec_id, ROUND(score, 6) AS score FROM trs"))
def m5_lof_fit(spark, sf):
    """M5: training LOF factors (negated) of the normal training embeddings."""
    _, model = _lof(spark, sf)
    return model.train_scores().select("vec_id", F.round("score", 6).alias("score"))


@register("m6_lof_novelty", _lof_sql(
    "SELECT q.vec_id, q.split, q.\"Label\", ROUND(s.score, 6) AS score FROM qs q "
    "JOIN qsc s USING (vec_id)"))
def m6_lof_novelty(spark, sf):
    """M6: novelty scores of the val/test embeddings against the training rows."""
    s, model = _lof(spark, sf)
    rows = s.filter(c("split") != "train")
    out = model.score(rows, keep=["split", "Label"])
    return out.select("vec_id", "split", "Label", F.round("score", 6).alias("score"))


SMOTE_SQL = f"""WITH {EMB_CTE},
m AS (SELECT vec_id, v FROM e WHERE "Label" = 1),
cnt AS (SELECT CAST(SUM(CASE WHEN "Label" = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n1,
               CAST(SUM(CASE WHEN "Label" = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n0 FROM e),
nb AS (SELECT * FROM (SELECT a.vec_id AS q, b.v AS nv, row_number() OVER (PARTITION BY a.vec_id
         ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
       FROM m a JOIN m b ON a.vec_id <> b.vec_id) WHERE rank <= {K}),
br AS (SELECT vec_id, v, row_number() OVER (ORDER BY
         md5(concat_ws('|', '42', 'smote-base', CAST(vec_id AS VARCHAR))), vec_id) AS rk FROM m),
cp AS (SELECT br.*, (n0 - n1) // n1 + CASE WHEN rk <= (n0 - n1) % n1 THEN 1 ELSE 0 END AS ncp
       FROM br, cnt),
rw AS (SELECT vec_id, v, unnest(range(ncp)) AS copy FROM cp),
dr AS (SELECT vec_id, v, copy,
  CAST(('0x' || substr(md5(concat_ws('|', '42', 'smote-nb', CAST(vec_id AS VARCHAR),
       CAST(copy AS VARCHAR))), 1, 8)) AS BIGINT) % {K} + 1 AS nb_rank,
  CAST(('0x' || substr(md5(concat_ws('|', '42', 'smote-u', CAST(vec_id AS VARCHAR),
       CAST(copy AS VARCHAR))), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM rw)
SELECT dr.vec_id AS origin, CAST(copy AS INT) AS copy, CAST(nb_rank AS INT) AS nb_rank,
  ROUND(u, 9) AS u, ROUND(dr.v[1] + u * (nb.nv[1] - dr.v[1]), 6) AS v_first,
  ROUND(dr.v[64] + u * (nb.nv[64] - dr.v[64]), 6) AS v_last, 1 AS "Label"
FROM dr JOIN nb ON nb.q = dr.vec_id AND nb.rank = dr.nb_rank"""


@register("m9_smote", SMOTE_SQL)
def m9_smote(spark, sf):
    """M9: synthetic class-9 embeddings until both classes are equally large."""
    from ..operators.smote import smote
    s = smote(emb(spark, sf), "vec_id", "embedding", k_neighbors=K)
    return s.select("origin", "copy", "nb_rank", F.round("u", 9).alias("u"),
                    F.round(F.col("vec")[0], 6).alias("v_first"),
                    F.round(F.col("vec")[63], 6).alias("v_last"), "Label")


def _emb_wide(spark, sf):
    s = emb_split(spark, sf)
    return s.select("vec_id", "Label", "split",
                    *[F.col("embedding")[i].alias(f"e{i}") for i in range(64)])


EMB_FEATS = [f"e{i}" for i in range(64)]


@register("m2_iforest_scores")
def m2_iforest_scores(spark, sf):
    """M1 + M2 + M3: forest fitted on the normal training embeddings, val/test
    rows scored and thresholded at the 'auto' offset (−0.5)."""
    from ..operators.iforest import fit_isolation_forest
    from ..operators.metrics import predict_by_threshold
    w = _emb_wide(spark, sf)
    model = fit_isolation_forest(w.filter(c("split") == "train"), EMB_FEATS, ["vec_id"])
    s = model.score(w.filter(c("split") != "train"), keep=["vec_id", "Label", "split"])
    return s.withColumn("y_pred", predict_by_threshold(F.col("score"), -0.5))


@register("m7_ocsvm_scores")
def m7_ocsvm_scores(spark, sf):
    """M7: one-class SVM (random Fourier features, ν = 0.1) fitted on the normal
    training embeddings; decision values of the val/test rows."""
    from ..operators.ocsvm import fit_ocsvm
    w = _emb_wide(spark, sf)
    model = fit_ocsvm(w.filter(c("split") == "train"), EMB_FEATS, ["vec_id"], nu=0.1)
    s = model.score(w.filter(c("split") != "train"), keep=["vec_id", "Label", "split"])
    return s.withColumn("y_pred", F.when(F.col("score") < 0, -1).otherwise(1))


@register("m8_boost_predictions")
def m8_boost_predictions(spark, sf):
    """M8: boosted trees (reference defaults) fitted on a stratified training
    split of the embeddings; predictions for the test rows."""
    from ..operators.boost import fit_boost
    e = emb(spark, sf)
    s = splits.stratified_split(e, ["vec_id"]).select(
        "vec_id", "Label", "split", *[F.col("embedding")[i].alias(f"e{i}") for i in range(64)])
    model = fit_boost(s.filter(c("split") == "train"), EMB_FEATS)
    return model.predict(s.filter(c("split") == "test"), keep=["vec_id", "Label"])
