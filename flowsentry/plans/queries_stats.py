"""Catalogue part 2: class balance, fitted statistics, filters, prep, metrics.

Fitted steps are fitted on the novelty split's training rows of ``flows``
(X1) and applied to the other rows, as the jobs do.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..functions.safe import c
from ..operators import metrics, splits, stats
from ..operators.filters import fit_filters
from ..operators.prep import PrepModel, Scaler
from ..sources import fixtures
from . import oracle_fixtures as OF
from .catalog import X1_CTE, register

q = OF.q
W = OF.with_flows
FEATS = fixtures.FLOW_FEATURES


def _x1(spark, sf):
    return splits.novelty_split(fixtures.flows(spark, sf), ["flow_id"])


def kept_x1(spark, sf):
    """X1 of flows that are kept for the several passes of a fit: they are built once."""
    return splits.novelty_split(fixtures.flows(spark, sf).persist(StorageLevel.MEMORY_AND_DISK), ["flow_id"])


def _train(spark, sf):
    return _x1(spark, sf).filter(c("split") == "train")


TRAIN_CTE = X1_CTE + ",\ntrain AS (SELECT f.* FROM flows f JOIN x1 USING (flow_id) " \
                     "WHERE x1.split = 'train')"
SPLIT_CTE = X1_CTE + ",\nxs AS (SELECT f.*, x1.split FROM flows f JOIN x1 USING (flow_id))"


def _unpivot(agg: str, names, value_exprs: dict[str, str]) -> str:
    """One row per column from a one-row aggregate CTE ``agg``."""
    parts = []
    for i, n in enumerate(names):
        vals = ", ".join(f"{e.format(i=i)} AS {k}" for k, e in value_exprs.items())
        parts.append(f"SELECT {i} AS pos, '{n}' AS \"column\", {vals} FROM {agg}")
    return "\nUNION ALL ".join(parts)


# ---------------------------------------------------------------- A1, A2


def _distribution_sql(src: str, label: str) -> str:
    return f"""SELECT CAST({label} AS INT) AS class, CASE WHEN {label} = 0 THEN 'normal/benign'
  WHEN {label} = 1 THEN 'outlier/attack' ELSE '?' END AS name, COUNT(*) AS n,
  ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS pct
  FROM {src} WHERE {label} IS NOT NULL GROUP BY {label}"""


@register("a1_class_distribution", W() + _distribution_sql("flows", '"Label"'))
def a1_class_distribution(spark, sf):
    return stats.class_distribution(fixtures.flows(spark, sf))


@register("a1_class_distribution_labels", _distribution_sql("labels", "toxic"))
def a1_class_distribution_labels(spark, sf):
    lab = fixtures.read_table(spark, sf, "labels")
    return stats.class_distribution(lab, label="toxic")


def _verdict_sql(src: str, label: str) -> str:
    return f"""SELECT n0, n1, ROUND(ratio, 6) AS ratio, ROUND(pct, 6) AS contamination_pct,
  CASE WHEN n_classes < 2 THEN 'single class' WHEN ratio <= 1.5 THEN 'balanced'
       WHEN ratio <= 4 THEN 'slightly imbalanced' ELSE 'strongly imbalanced' END AS verdict
FROM (SELECT n0, n1, n_classes,
        CASE WHEN LEAST(n0, n1) = 0 THEN CAST('inf' AS DOUBLE)
             ELSE CAST(GREATEST(n0, n1) AS DOUBLE) / LEAST(n0, n1) END AS ratio,
        CASE WHEN n0 + n1 = 0 THEN NULL ELSE 100.0 * n1 / (n0 + n1) END AS pct
      FROM (SELECT COUNT(*) FILTER (WHERE {label} = 0) AS n0,
                   COUNT(*) FILTER (WHERE {label} = 1) AS n1,
                   COUNT(DISTINCT {label}) AS n_classes FROM {src}))"""


@register("a2_balance_verdict", W() + _verdict_sql("flows", '"Label"'))
def a2_balance_verdict(spark, sf):
    return stats.balance_verdict(fixtures.flows(spark, sf))


@register("a2_balance_verdict_labels", _verdict_sql("labels", "toxic"))
def a2_balance_verdict_labels(spark, sf):
    return stats.balance_verdict(fixtures.read_table(spark, sf, "labels"), label="toxic")


@register("a3_split_profile", W() + ", " + SPLIT_CTE + f""" SELECT split, COUNT(*) AS rows,
  {len(FEATS)} AS features, ROUND(AVG(CAST("Label" AS DOUBLE)), 6) AS outlier_share
  FROM xs GROUP BY split""")
def a3_split_profile(spark, sf):
    return stats.split_profile(_x1(spark, sf), len(FEATS))


# ---------------------------------------------------------------- A4–A7


def _fill(n: str) -> str:
    return f"COALESCE(CASE WHEN isfinite({q(n)}) THEN {q(n)} + 0.0 END, 0.0)"


def _filter_sql() -> str:
    d = len(FEATS)
    var_agg = ", ".join(f"var_samp({_fill(n)}) AS v{i}" for i, n in enumerate(FEATS))
    pairs = [(i, j) for j in range(d) for i in range(j)]
    eq_agg = ", ".join(f"bool_and({_fill(FEATS[i])} IS NOT DISTINCT FROM {_fill(FEATS[j])})"
                       f" AS e_{i}_{j}" for i, j in pairs)
    corr_agg = ", ".join(f"corr({_fill(FEATS[i])}, {_fill(FEATS[j])}) AS r_{i}_{j}"
                         for i, j in pairs)
    var_rows = _unpivot("va", FEATS, {"v": "v{i}"})
    eq_rows = "\nUNION ALL ".join(f"SELECT {i} AS i, {j} AS j, e_{i}_{j} AS eq FROM ea"
                                  for i, j in pairs)
    corr_rows = "\nUNION ALL ".join(f"SELECT {i} AS i, {j} AS j, r_{i}_{j} AS r FROM ca"
                                    for i, j in pairs)
    return W() + ", " + TRAIN_CTE + f""",
va AS (SELECT {var_agg} FROM train),
ea AS (SELECT {eq_agg} FROM train),
ca AS (SELECT {corr_agg} FROM train),
v AS ({var_rows}),
s1 AS (SELECT pos, "column", NOT (v IS NOT NULL AND NOT isnan(v) AND v <= 0.0) AS keep1 FROM v),
eqr AS ({eq_rows}),
dup AS (SELECT DISTINCT e.j FROM eqr e JOIN s1 a ON a.pos = e.i JOIN s1 b ON b.pos = e.j
        WHERE a.keep1 AND b.keep1 AND e.eq),
s2 AS (SELECT s1.*, s1.keep1 AND dup.j IS NULL AS keep2 FROM s1 LEFT JOIN dup ON dup.j = s1.pos),
cr AS ({corr_rows}),
hc AS (SELECT DISTINCT cr.j FROM cr JOIN s2 a ON a.pos = cr.i JOIN s2 b ON b.pos = cr.j
       WHERE a.keep2 AND b.keep2 AND NOT isnan(cr.r) AND abs(cr.r) > 0.95),
rep AS (SELECT s2.pos, s2."column", s2.keep2 AND hc.j IS NULL AS kept,
          CASE WHEN NOT s2.keep1 THEN 'low_variance' WHEN NOT s2.keep2 THEN 'duplicate'
               WHEN hc.j IS NOT NULL THEN 'high_correlation' END AS reason
        FROM s2 LEFT JOIN hc ON hc.j = s2.pos)
"""


FILTER_SQL = _filter_sql()


def _filter_report(spark, sf):
    train = kept_x1(spark, sf).filter(c("split") == "train")
    fm = fit_filters(train, FEATS, ["flow_id"])
    return spark.createDataFrame(fm.report_rows(),
                                 "pos int, column string, kept boolean, reason string")


@register("a7_filter_report", FILTER_SQL + "SELECT pos, \"column\", kept, reason FROM rep")
def a7_filter_report(spark, sf):
    """A4 → A5 → A6 fitted on the training rows; one row per input column."""
    return _filter_report(spark, sf)


@register("a4_low_variance", FILTER_SQL + "SELECT pos, \"column\" FROM rep "
          "WHERE reason = 'low_variance'")
def a4_low_variance(spark, sf):
    return _filter_report(spark, sf).filter(F.col("reason") == "low_variance") \
        .select("pos", "column")


@register("a5_duplicate_columns", FILTER_SQL + "SELECT pos, \"column\" FROM rep "
          "WHERE reason = 'duplicate'")
def a5_duplicate_columns(spark, sf):
    return _filter_report(spark, sf).filter(F.col("reason") == "duplicate") \
        .select("pos", "column")


@register("a6_high_correlation", FILTER_SQL + "SELECT pos, \"column\" FROM rep "
          "WHERE reason = 'high_correlation'")
def a6_high_correlation(spark, sf):
    return _filter_report(spark, sf).filter(F.col("reason") == "high_correlation") \
        .select("pos", "column")


# ---------------------------------------------------------------- A8–A10


def _stat_sql(exprs: dict[str, str], sig: bool = False) -> str:
    agg = ", ".join(f"{e.format(x=f'CASE WHEN isfinite({q(n)}) THEN {q(n)} END')} AS {k}{i}"
                    for i, n in enumerate(FEATS) for k, e in exprs.items())
    fmt = "printf('%.5e', {k}{{i}})" if sig else "ROUND({k}{{i}}, 6)"
    rows = _unpivot("sa", FEATS, {k: fmt.format(k=k) for k in exprs})
    return W() + ", " + TRAIN_CTE + f", sa AS (SELECT {agg} FROM train)\n{rows}"


@register("a8_means", _stat_sql({"mean": "AVG({x})"}))
def a8_means(spark, sf):
    m = stats.column_means(_train(spark, sf), FEATS)
    return _per_column(spark, {"mean": [m[n] for n in FEATS]})


@register("a9_quartiles", _stat_sql({"q1": "quantile_cont({x}, 0.25)",
                                     "median": "quantile_cont({x}, 0.5)",
                                     "q3": "quantile_cont({x}, 0.75)"}, sig=True))
def a9_quartiles(spark, sf):
    qs = stats.quartiles(_train(spark, sf), FEATS)
    return _per_column(spark, {"q1": [qs[n][0] for n in FEATS],
                               "median": [qs[n][1] for n in FEATS],
                               "q3": [qs[n][2] for n in FEATS]}, sig=True)


@register("a10_mean_std", _stat_sql({"mean": "AVG({x})",
                                     "std": "CASE WHEN stddev_pop({x}) > 0 THEN "
                                            "stddev_pop({x}) ELSE 1.0 END"}, sig=True))
def a10_mean_std(spark, sf):
    ms = stats.mean_std(_train(spark, sf), FEATS)
    return _per_column(spark, {"mean": [ms[n][0] for n in FEATS],
                               "std": [ms[n][1] for n in FEATS]}, sig=True)


def _per_column(spark, values: dict[str, list], sig: bool = False):
    """Fitted per-column statistics (d rows) as a DataFrame; values rounded to
    6 decimals, or written with 6 significant digits (``sig``) where the
    magnitude or interpolation ties make fixed decimals engine-dependent."""
    keys = list(values)
    rows = [(i, n, *[None if values[k][i] is None else float(values[k][i]) for k in keys])
            for i, n in enumerate(FEATS)]
    schema = "pos int, column string, " + ", ".join(f"{k} double" for k in keys)
    df = spark.createDataFrame(rows, schema)
    fmt = (lambda k: F.format_string("%.5e", F.col(k))) if sig else \
        (lambda k: F.round(F.col(k), 6))
    return df.select("pos", "column", *[fmt(k).alias(k) for k in keys])


# ---------------------------------------------------------------- F1–F3, F7



def _imputed_sql(src_cte: str, where: str, cols, extra: str = "") -> str:
    means = ", ".join(f"AVG(CASE WHEN isfinite({q(n)}) THEN {q(n)} END) AS m{i}"
                      for i, n in enumerate(cols))
    out = ", ".join(
        f"ROUND(GREATEST(CASE WHEN isfinite(d.{q(n)}) THEN d.{q(n)} ELSE m.m{i} END, 0.0), 6)"
        f" AS {q(n)}" for i, n in enumerate(cols))
    return (W(OF.FLOWS_DIRTY) + ", " + TRAIN_CTE + f", m AS (SELECT {means} FROM train)"
            f" SELECT d.flow_id, d.\"Label\"{extra}, {out} FROM {src_cte} d, m WHERE {where}")


@register("f1_impute_clamp", _imputed_sql("flows_dirty", "d.domain = 'gen'", FEATS))
def f1_impute_clamp(spark, sf):
    """F1 fitted on clean training rows, applied to dirty target-domain rows."""
    model = PrepModel.fit(_train(spark, sf), FEATS, ["flow_id"], apply_filters=False)
    target = fixtures.flows_dirty(spark, sf).filter(c("domain") == "gen")
    out = model.transform(target)
    return out.select("flow_id", "Label", *[F.round(c(n), 6).alias(n) for n in FEATS])


_SC = ["Flow Duration", "Packet Length Mean", "Fwd IAT Mean", "Init_Win_bytes_backward",
       "SYN Flag Count", "Active Max"]


def _scaled_sql(kind: str) -> str:
    if kind == "robust":
        fit = ", ".join(f"quantile_cont({q(n)}, 0.25) AS a{i}, quantile_cont({q(n)}, 0.5) AS "
                        f"b{i}, quantile_cont({q(n)}, 0.75) AS c{i}" for i, n in enumerate(_SC))
        expr = [f"ROUND((d.{q(n)} - p.b{i}) / CASE WHEN p.c{i} - p.a{i} = 0 THEN 1.0 "
                f"ELSE p.c{i} - p.a{i} END, 6) AS {q(n)}" for i, n in enumerate(_SC)]
    else:
        fit = ", ".join(f"AVG({q(n)}) AS a{i}, stddev_pop({q(n)}) AS b{i}"
                        for i, n in enumerate(_SC))
        expr = [f"ROUND((d.{q(n)} - p.a{i}) / CASE WHEN p.b{i} > 0 THEN p.b{i} ELSE 1.0 END, 6)"
                f" AS {q(n)}" for i, n in enumerate(_SC)]
    return (W() + ", " + SPLIT_CTE + f", tr AS (SELECT * FROM xs WHERE split = 'train'), "
            f"sp AS (SELECT {fit} FROM tr) SELECT d.flow_id, d.split, {', '.join(expr)} "
            "FROM xs d, sp p WHERE d.split <> 'train'")


def _scaled(spark, sf, kind):
    x1 = _x1(spark, sf)
    sc = Scaler.fit(x1.filter(c("split") == "train"), _SC, kind=kind)
    out = sc.transform(x1.filter(c("split") != "train").select("flow_id", "split", *_SC))
    return out.select("flow_id", "split", *[F.round(c(n), 6).alias(n) for n in _SC])


@register("f2_robust_scale", _scaled_sql("robust"))
def f2_robust_scale(spark, sf):
    return _scaled(spark, sf, "robust")


@register("f3_standard_scale", _scaled_sql("standard"))
def f3_standard_scale(spark, sf):
    return _scaled(spark, sf, "standard")


@register("f7_prep_filters_impute", None)
def f7_prep_filters_impute(spark, sf):
    """F7 without PCA: filters + imputer fitted on train, applied to val/test."""
    x1 = kept_x1(spark, sf)
    model = PrepModel.fit(x1.filter(c("split") == "train"), FEATS, ["flow_id"])
    out = model.transform(x1.filter(c("split") != "train"), keep=["flow_id", "Label", "split"])
    return out.select("flow_id", "Label", "split",
                      *[F.round(c(n), 6).alias(n) for n in model.output_columns])


# ---------------------------------------------------------------- metrics

# Stand-in score for the metric operators (higher = more normal).
def toy_score():
    return -F.abs(c("Packet Length Mean") - F.lit(25.5))



TOY_SCORE_SQL = '-abs("Packet Length Mean" - 25.5)'
FRACTIONS = [0.01, 0.05, 0.1, 0.2]
SWEEP = [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3]


def _scored(spark, sf):
    f = fixtures.flows(spark, sf)
    x1 = splits.novelty_split(f, ["flow_id"])
    return x1.select("flow_id", "split", toy_score().alias("score"),
                     F.when(c("Label") == 0, 1).otherwise(-1).alias("y_det"))


SCORED_CTE = SPLIT_CTE + f""",
sc AS (SELECT flow_id, split, {TOY_SCORE_SQL} AS score,
       CASE WHEN "Label" = 0 THEN 1 ELSE -1 END AS y_det FROM xs)"""


def _offset_sql(frac: float) -> str:
    return f"(SELECT quantile_cont(score, {frac}) FROM sc WHERE split = 'train')"


@register("a11_threshold", W() + ", " + SCORED_CTE + " " + "\nUNION ALL ".join(
    f"SELECT CAST({f} AS DOUBLE) AS fraction, ROUND({_offset_sql(f)}, 6) AS offset"
    for f in FRACTIONS))
def a11_threshold(spark, sf):
    s = _scored(spark, sf)
    offs = metrics.score_percentile(s.filter(c("split") == "train"), "score", FRACTIONS)
    rows = [(float(f), float(o)) for f, o in zip(FRACTIONS, offs)]
    return spark.createDataFrame(rows, "fraction double, offset double") \
        .select("fraction", F.round("offset", 6).alias("offset"))


PRED_CTE = SCORED_CTE + f""",
pr AS (SELECT *, CASE WHEN score < {_offset_sql(0.1)} THEN -1 ELSE 1 END AS y_pred FROM sc
       WHERE split <> 'train'),
cells AS (SELECT s.split, t.y_true, p.y_pred FROM (SELECT DISTINCT split FROM pr) s,
          (VALUES (1), (-1)) t(y_true), (VALUES (1), (-1)) p(y_pred)),
conf AS (SELECT cells.split, cells.y_true, cells.y_pred, COUNT(pr.flow_id) AS n FROM cells
         LEFT JOIN pr ON pr.split = cells.split AND pr.y_det = cells.y_true
         AND pr.y_pred = cells.y_pred GROUP BY ALL),
pc AS (SELECT split, cls, tp, support, pred_n,
         CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS prec,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM (
         SELECT a.split, a.cls, a.tp, a.support, b.pred_n FROM
           (SELECT split, y_true AS cls, SUM(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS tp,
                   SUM(n) AS support FROM conf GROUP BY ALL) a
           JOIN (SELECT split, y_pred AS cls, SUM(n) AS pred_n FROM conf GROUP BY ALL) b
           USING (split, cls))),
pcf AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END
        AS f1 FROM pc)"""


def _predicted(spark, sf):
    s = _scored(spark, sf)
    off = metrics.score_percentile(s.filter(c("split") == "train"), "score", [0.1])[0]
    return s.filter(c("split") != "train").withColumn(
        "y_pred", metrics.predict_by_threshold(c("score"), off))


@register("m3_predict_threshold", W() + ", " + PRED_CTE +
          " SELECT flow_id, split, ROUND(score, 6) AS score, y_pred FROM pr")
def m3_predict_threshold(spark, sf):
    p = _predicted(spark, sf)
    return p.select("flow_id", "split", F.round("score", 6).alias("score"), "y_pred")


@register("a12_confusion", W() + ", " + PRED_CTE +
          " SELECT split, y_true, y_pred, CAST(n AS BIGINT) AS n FROM conf")
def a12_confusion(spark, sf):
    return metrics.confusion(_predicted(spark, sf), "y_det", "y_pred", [1, -1], by=["split"])


@register("a13_macro_f1", W() + ", " + PRED_CTE +
          " SELECT split, ROUND(AVG(f1), 6) AS macro_f1 FROM pcf GROUP BY split")
def a13_macro_f1(spark, sf):
    conf = metrics.confusion(_predicted(spark, sf), "y_det", "y_pred", [1, -1], by=["split"])
    return metrics.macro_f1(conf, by=["split"]).select(
        "split", F.round("macro_f1", 6).alias("macro_f1"))


@register("a14_report", W() + ", " + PRED_CTE + """
SELECT split, CAST(cls AS VARCHAR) AS "row", ROUND(prec, 6) AS precision, ROUND(rec, 6) AS recall,
       ROUND(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM pcf
UNION ALL SELECT split, 'accuracy', NULL, NULL, ROUND(SUM(tp) / SUM(support), 6),
       CAST(SUM(support) AS BIGINT) FROM pcf GROUP BY split
UNION ALL SELECT split, 'macro avg', ROUND(AVG(prec), 6), ROUND(AVG(rec), 6), ROUND(AVG(f1), 6),
       CAST(SUM(support) AS BIGINT) FROM pcf GROUP BY split
UNION ALL SELECT split, 'weighted avg', ROUND(SUM(prec * support) / SUM(support), 6),
       ROUND(SUM(rec * support) / SUM(support), 6), ROUND(SUM(f1 * support) / SUM(support), 6),
       CAST(SUM(support) AS BIGINT) FROM pcf GROUP BY split""")
def a14_report(spark, sf):
    conf = metrics.confusion(_predicted(spark, sf), "y_det", "y_pred", [1, -1], by=["split"])
    r = metrics.report(conf, by=["split"])
    return r.select("split", "row", *[F.round(k, 6).alias(k) for k in ("precision", "recall",
                                                                       "f1")], "support")


def _sweep_sql(tail: str) -> str:
    offs = ",\n".join(f"(CAST({cv} AS DOUBLE), {_offset_sql(cv)})" for cv in SWEEP)
    return W() + ", " + SCORED_CTE + f""",
g(contamination, "offset") AS (VALUES {offs}),
v AS (SELECT * FROM sc WHERE split = 'val'),
conf AS (SELECT g.contamination, g."offset", t.y_true, p.y_pred,
           (SELECT COUNT(*) FROM v WHERE v.y_det = t.y_true AND
              (CASE WHEN v.score < g."offset" THEN -1 ELSE 1 END) = p.y_pred) AS n
         FROM g, (VALUES (1), (-1)) t(y_true), (VALUES (1), (-1)) p(y_pred)),
pc AS (SELECT contamination, cls,
         CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS prec,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM (
         SELECT a.contamination, a.cls, a.tp, a.support, b.pred_n FROM
           (SELECT contamination, y_true AS cls,
                   SUM(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS tp,
                   SUM(n) AS support FROM conf GROUP BY ALL) a
           JOIN (SELECT contamination, y_pred AS cls, SUM(n) AS pred_n FROM conf GROUP BY ALL) b
           USING (contamination, cls))),
mf AS (SELECT contamination, ROUND(AVG(CASE WHEN prec + rec > 0 THEN 2 * prec * rec /
         (prec + rec) ELSE 0.0 END), 6) AS macro_f1 FROM pc GROUP BY contamination)
{tail}"""


def _sweep(spark, sf):
    s = _scored(spark, sf)
    out = metrics.sweep(s.filter(c("split") == "val"), "score", "y_det",
                        s.filter(c("split") == "train"), SWEEP)
    return out.select("contamination", F.round("macro_f1", 6).alias("macro_f1"))


@register("h2_contamination_sweep", _sweep_sql("SELECT contamination, macro_f1 FROM mf"))
def h2_contamination_sweep(spark, sf):
    return _sweep(spark, sf)


@register("h4_best_by_f1", _sweep_sql("SELECT contamination, macro_f1 FROM mf "
                                      "ORDER BY macro_f1 DESC, contamination LIMIT 1"))
def h4_best_by_f1(spark, sf):
    return metrics.best_by(_sweep(spark, sf), "macro_f1", "contamination")


# ---------------------------------------------------------------- X9, X10, J6

_FIN_DIRTY = " AND ".join(f"isfinite({q(n)})" for n in FEATS)


def _x9_sql(tail: str) -> str:
    cols = ", ".join(f"GREATEST({q(n)}, 0.0) AS {q(n)}" for n in FEATS)
    return (W(OF.FLOWS_DIRTY) + ", " + TRAIN_CTE +
            f", ex AS (SELECT flow_id, \"Label\", {cols} FROM flows_dirty WHERE domain = 'gen'"
            f" AND \"Label\" = 0 AND {_FIN_DIRTY}) {tail}")


def _x9(spark, sf):
    from ..config import ExperimentConfig
    from .jobs import extra_normals
    model = PrepModel.fit(_train(spark, sf), FEATS, ["flow_id"], apply_filters=False)
    extra = fixtures.flows_dirty(spark, sf).filter(c("domain") == "gen") \
        .drop("domain", "first_day")
    return model, extra_normals(extra, model, ExperimentConfig())


@register("x9_extra_normals", _x9_sql("SELECT * FROM ex"))
def x9_extra_normals(spark, sf):
    """Normals of the target domain, cleaned, through the fitted prep (no refit)."""
    _, ex = _x9(spark, sf)
    return ex


@register("x10_append", _x9_sql("SELECT flow_id, 'train' AS source FROM train UNION ALL "
                                "SELECT flow_id, 'extra' AS source FROM ex"))
def x10_append(spark, sf):
    """Training rows stacked with the extra normals."""
    from ..operators import splits as sp
    model, ex = _x9(spark, sf)
    train = model.transform(_train(spark, sf), keep=["flow_id", "Label"])
    both = sp.append(train.withColumn("source", F.lit("train")),
                     ex.withColumn("source", F.lit("extra")))
    return both.select("flow_id", "source")


def _j6_sql() -> str:
    fin = " AND ".join([f"isfinite({q(n)})" for n in FEATS] + ['"Label" IS NOT NULL'])
    dist = """SELECT '{st}' AS stage, CAST("Label" AS INT) AS class, COUNT(*) AS n,
      ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS pct FROM {src} GROUP BY "Label" """
    return (W(OF.FLOWS_DIRTY) + f", cl AS (SELECT * FROM flows_dirty WHERE {fin}) " +
            dist.format(st="before", src="flows_dirty") + " UNION ALL " +
            dist.format(st="after", src="cl"))


@register("j6_balance_report", _j6_sql())
def j6_balance_report(spark, sf):
    """Class distribution before and after dropping invalid rows."""
    from .jobs import balance_report
    rep = balance_report(fixtures.flows_dirty(spark, sf))
    return rep["before"].select(F.lit("before").alias("stage"), "class", "n", "pct") \
        .unionByName(rep["after"].select(F.lit("after").alias("stage"), "class", "n", "pct"))


@register("s6_result_sink", W() + ", " + PRED_CTE + """
SELECT split, CAST(cls AS VARCHAR) AS "row", ROUND(prec, 6) AS precision, ROUND(rec, 6) AS recall,
       ROUND(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM pcf""")
def s6_result_sink(spark, sf):
    """Per-class report rows written to Parquet below the shared folder and read back."""
    from ..session import scratch_path
    from ..sources.sinks import read_result, write_results
    conf = metrics.confusion(_predicted(spark, sf), "y_det", "y_pred", [1, -1], by=["split"])
    rep = metrics.report(conf, by=["split"]).filter(F.col("row").isin("1", "-1"))
    path = scratch_path(spark, "results")
    write_results({"report": rep.select("split", "row", *[F.round(k, 6).alias(k) for k in
                                                          ("precision", "recall", "f1")],
                                        "support")}, path)
    return read_result(spark, path, "report")


@register("j6_balance_smote_arff")
def j6_balance_smote_arff(spark, sf):
    """J6 with SMOTE: the cleaned flows balanced by SMOTE, written as ARFF (S3),
    read back (S1) and its class distribution reported."""
    from ..session import scratch_path
    from ..sources import arff
    from .jobs import balance_report
    f = fixtures.flows(spark, sf).drop("first_day", "domain")
    path = scratch_path(spark, "balanced-arff")
    balance_report(f, smote_key="flow_id", features=FEATS, arff_path=path)
    return stats.class_distribution(arff.read_arff(spark, path))


@register("x11_cap_training_rows", W() + ", " + TRAIN_CTE + """ SELECT flow_id FROM (
  SELECT flow_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', 'fit-cap',
         CAST(flow_id AS VARCHAR))), flow_id) AS rk FROM train) WHERE rk <= 2000""")
def x11_cap_training_rows(spark, sf):
    """X11: the ≤ 2,000 hash-chosen training rows a capped fit would use."""
    return splits.sample_n(_train(spark, sf), 2000, ["flow_id"], purpose="fit-cap") \
        .select("flow_id")
