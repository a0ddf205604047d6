"""Named queries over the driver tables, each with a DuckDB oracle where SQL can state it.

Every query reads the ``flows`` input derived from ``lineitem`` (or another
driver table) in full, and runs the library operator named by its ID.
"""

from __future__ import annotations

import functools
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as feat
from ..functions.safe import c
from ..operators import clean, splits
from ..session import scratch_path, shared_dir, tune_session
from ..sources import arff, fixtures
from . import oracle_fixtures as OF
from .oracle_features import SQL_FEATURES, feature_select, group_select

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            tune_session(spark)
            shared_dir(spark)
            return fn(spark, sf)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


q = OF.q
W = OF.with_flows
ALL = ", ".join(q(n) for n in OF.ALL_COLS)
HASH = "md5(concat_ws('|', '42', '{p}', CAST(flow_id AS VARCHAR)))"

# ---------------------------------------------------------------- sources


@register("s1_arff_roundtrip", W() + f"SELECT {ALL} FROM flows")
def s1_arff_roundtrip(spark, sf):
    """S3 then S1: write flows as ARFF below the shared folder, read it back."""
    path = scratch_path(spark, "arff")
    arff.write_arff(fixtures.flows(spark, sf), path)
    back = arff.read_arff(spark, path)
    # ARFF has numeric and string attributes only: restore the key and date types.
    return back.withColumn("flow_id", c("flow_id").cast("long")) \
        .withColumn("first_day", F.to_date("first_day"))


@register("s4_strip_names", W() + f"SELECT {ALL} FROM flows")
def s4_strip_names(spark, sf):
    f = fixtures.flows(spark, sf)
    padded = f.toDF(*[f"  {n} " for n in f.columns])      # stand-in: padded names
    return clean.strip_names(padded)


# ---------------------------------------------------------------- P ops

_NONFIN = ", ".join(
    f"CASE WHEN isfinite({q(n)}) THEN {q(n)} ELSE NULL END AS {q(n)}"
    if n in OF.FLOW_FEATURES else q(n) for n in OF.ALL_COLS)
_ALLFIN = " AND ".join(
    [f"isfinite({q(n)})" for n in OF.FLOW_FEATURES] +
    ["flow_id IS NOT NULL", "first_day IS NOT NULL", "domain IS NOT NULL",
     '"Label" IS NOT NULL'])


@register("p1_drop_invalid", W(OF.FLOWS_DIRTY) + f"SELECT {ALL} FROM flows_dirty WHERE {_ALLFIN}")
def p1_drop_invalid(spark, sf):
    return clean.drop_invalid(fixtures.flows_dirty(spark, sf))


@register("p2_nonfinite_to_null", W(OF.FLOWS_DIRTY) + f"SELECT {_NONFIN} FROM flows_dirty")
def p2_nonfinite_to_null(spark, sf):
    return clean.nonfinite_to_missing(fixtures.flows_dirty(spark, sf))


@register("p3_drop_empty", W(OF.FLOWS_DIRTY) + f"SELECT {_NONFIN} FROM flows_dirty")
def p3_drop_empty(spark, sf):
    return clean.drop_empty(fixtures.flows_dirty(spark, sf))


@register("p4_trim", W() + f'SELECT {ALL} FROM flows WHERE "Active Max" <= 60')
def p4_trim(spark, sf):
    return clean.trim_by_feature(fixtures.flows(spark, sf), "Active Max", 60.0)


_WL = ["Flow Duration", "Packet Length Mean", "SYN Flag Count", "pkt_rate"]


@register("p5_whitelist", W() + "SELECT flow_id, \"Flow Duration\", \"Packet Length Mean\", "
          "\"SYN Flag Count\", " + SQL_FEATURES["pkt_rate"][1] + " AS pkt_rate, \"Label\" "
          "FROM flows")
def p5_whitelist(spark, sf):
    f = feat.add_domain_features(fixtures.flows(spark, sf), [], whitelist=_WL)
    return clean.whitelist(f, _WL, keep=["flow_id"])


@register("p7_align", W(OF.FLOWS_MISSING) + "SELECT flow_id, " + ", ".join(
    f"CAST(NULL AS DOUBLE) AS {q(n)}" if n in ("ECE Flag Count", "Idle Mean") else q(n)
    for n in OF.FLOW_FEATURES) + " FROM flows_missing")
def p7_align(spark, sf):
    return clean.align(fixtures.flows_missing_cols(spark, sf), fixtures.FLOW_FEATURES,
                       keep=["flow_id"])


@register("p8_class_filter", W() + 'SELECT flow_id, "Label" FROM flows WHERE "Label" = 1')
def p8_class_filter(spark, sf):
    return clean.class_filter(fixtures.flows(spark, sf), 1).select("flow_id", "Label")


@register("p9_detector_labels", W() + 'SELECT flow_id, CASE WHEN "Label" = 0 THEN 1 ELSE -1 END '
          'AS y_det FROM flows')
def p9_detector_labels(spark, sf):
    return fixtures.flows(spark, sf).select("flow_id",
                                            clean.detector_label(c("Label")).alias("y_det"))


@register("p10_plot_labels", W() + 'SELECT flow_id, CASE WHEN (CASE WHEN "Label" = 0 THEN 1 '
          'ELSE -1 END) = -1 THEN 1 ELSE 0 END AS y_plot FROM flows')
def p10_plot_labels(spark, sf):
    f = fixtures.flows(spark, sf).select("flow_id", clean.detector_label(c("Label")).alias("y"))
    return f.select("flow_id", clean.plot_label(c("y"), detector_coding=True).alias("y_plot"))


@register("p11_text_label", W(OF.FLOWS_TEXT) + "SELECT flow_id, CASE WHEN \"Label\" = 'BENIGN' "
          "THEN 0 ELSE 1 END AS \"Label\" FROM flows_text")
def p11_text_label(spark, sf):
    return clean.normalise_label(fixtures.flows_text_label(spark, sf)).select("flow_id", "Label")


_VIZ = ["Flow Duration", "Flow IAT Std", "Active Max", "Idle Mean", "Init_Win_bytes_forward"]


def _viz_sql() -> str:
    means = ", ".join(f"AVG(CASE WHEN isfinite({q(n)}) THEN {q(n)} END) AS {q('m_' + n)}"
                      for n in _VIZ)
    cols = ", ".join(
        f"ROUND(GREATEST(CASE WHEN isfinite(d.{q(n)}) THEN d.{q(n)} ELSE m.{q('m_' + n)} END,"
        f" 0.0), 6) AS {q(n)}" for n in _VIZ)
    return (W(OF.FLOWS_DIRTY) + f", m AS (SELECT {means} FROM flows_dirty WHERE domain = 'train')"
            ", g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"Label\" ORDER BY "
            + HASH.format(p="viz") + ", flow_id) AS rk FROM flows_dirty WHERE domain = 'gen') "
            f"WHERE rk <= 1000) SELECT d.flow_id, d.\"Label\", {cols} FROM g d, m")


@register("p12_viz_prepare", _viz_sql())
def p12_viz_prepare(spark, sf):
    from ..operators import stats
    d = fixtures.flows_dirty(spark, sf)
    fill = stats.column_means(clean.nonfinite_to_missing(d.filter(c("domain") == "train")), _VIZ)
    out = clean.viz_prepare(d.filter(c("domain") == "gen").drop("domain", "first_day"),
                            _VIZ, fill, keep=["flow_id"], per_class=1000, key_cols=["flow_id"])
    return out.select("flow_id", "Label", *[F.round(c(n), 6).alias(n) for n in _VIZ])


# ---------------------------------------------------------------- D features

_GROUP_QUERY = {
    "d_packet_shape": "Eng_Packet_Shape",
    "d_fwd_header_load": "Eng_Fwd_Header_Load",
    "d_temporal_burstiness": "Eng_Temporal_Burstiness",
    "d_flag_density": "Eng_Flag_Density",
    "d_flow_indicators": "Eng_Flow_Indicators",
    "d_flow_rates": "Eng_Flow_Rates",
    "d_bruteforce": "Eng_BruteForce",
}


def _group_query(group: str) -> Query:
    def run(spark, sf):
        f = fixtures.flows(spark, sf)
        out = feat.add_domain_features(f, [group])
        return out.select("flow_id", "Label", *feat.feature_columns(group))
    run.__doc__ = f"D48 for the {group} group."
    return run


for _name, _group in _GROUP_QUERY.items():
    register(_name, W() + f'SELECT flow_id, "Label", {group_select(_group)} FROM flows')(
        _group_query(_group))


@register("d48_all_dirty", W(OF.FLOWS_DIRTY) + f"SELECT {ALL}, {group_select(None)} "
          "FROM flows_dirty")
def d48_all_dirty(spark, sf):
    """All groups on raw values that still hold NaN, NULL and +-Inf."""
    return feat.add_domain_features(fixtures.flows_dirty(spark, sf), ["all"])


_MIXED = ["Eng_Flow_Rates", "pkt_len_cv", "is_short_flow", "active_idle_ratio",
          "ece_flag_count_density", "no_such_feature"]
_MIXED_OUT = ["pkt_len_cv", "is_short_flow", "pkt_rate", "fwd_pkt_rate", "bwd_pkt_rate",
              "byte_rate", "fwd_byte_rate"]
_MISSING_ALL = ", ".join(q(n) for n in OF.ALL_COLS if n not in ("ECE Flag Count", "Idle Mean"))


@register("d48_mixed_request", W(OF.FLOWS_MISSING) + f"SELECT {_MISSING_ALL}, "
          f"{feature_select(_MIXED_OUT)} FROM flows_missing")
def d48_mixed_request(spark, sf):
    """Groups and single names mixed; unknown and unproducible names skipped."""
    return feat.add_domain_features(fixtures.flows_missing_cols(spark, sf), _MIXED)


# ---------------------------------------------------------------- splits


def _rank_sql(src: str, purpose: str, where: str = "TRUE", part: str = '"Label"') -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY "
            f"{HASH.format(p=purpose)}, flow_id) AS rk, "
            f"count(*) OVER (PARTITION BY {part}) AS n FROM {src} WHERE {where}")


X1_CTE = f"""x1r AS ({_rank_sql('flows', 'split', '"Label" IN (0, 1)')}),
x1b AS (SELECT *, CAST(ceil((1.0::DOUBLE - 0.6::DOUBLE) * n) AS BIGINT) AS tmp FROM x1r),
x1s AS (SELECT *, n - tmp AS tr, tmp - CAST(ceil((1.0::DOUBLE - 0.25::DOUBLE) * tmp) AS BIGINT)
      AS va FROM x1b),
x1 AS (SELECT flow_id, "Label", split FROM (
  SELECT flow_id, "Label", CASE WHEN rk <= tr THEN (CASE WHEN "Label" = 0 THEN 'train'
         ELSE '_drop' END) WHEN rk <= tr + va THEN 'val' ELSE 'test' END AS split FROM x1s)
  WHERE split <> '_drop')"""
X1_SQL = W() + ", " + X1_CTE + ' SELECT flow_id, "Label", split FROM x1'


@register("x1_novelty_split", X1_SQL)
def x1_novelty_split(spark, sf):
    out = splits.novelty_split(fixtures.flows(spark, sf), ["flow_id"])
    return out.select("flow_id", "Label", "split")


def _largest_remainder_sql(total: str, cnt: str, src: str, name: str) -> str:
    """CTE text: per class of ``src`` the largest-remainder share of ``total``."""
    return f"""{name} AS (
  SELECT *, base + CASE WHEN rr <= left_over THEN 1 ELSE 0 END AS alloc FROM (
    SELECT *, row_number() OVER (ORDER BY rem DESC, "Label") AS rr,
           tot - SUM(base) OVER () AS left_over FROM (
      SELECT "Label", {cnt} AS cnt, {total} AS tot,
             ({total} * {cnt}) // NULLIF(SUM({cnt}) OVER (), 0) AS base,
             ({total} * {cnt}) % NULLIF(SUM({cnt}) OVER (), 0) AS rem FROM {src})))"""


X2_SQL = W() + f""", cc AS (SELECT "Label", COUNT(*) AS n_c FROM flows GROUP BY "Label"),
tot AS (SELECT CAST(floor(0.6::DOUBLE * SUM(n_c)) AS BIGINT) AS n_train FROM cc),
cc2 AS (SELECT cc.*, tot.n_train FROM cc, tot),
{_largest_remainder_sql('n_train', 'n_c', 'cc2', 'tr')},
tmp AS (SELECT "Label", cnt - alloc AS t_c, cnt AS n_c, alloc AS tr_c FROM tr),
tot2 AS (SELECT CAST(ceil((1.0::DOUBLE - 0.25::DOUBLE) * SUM(t_c)) AS BIGINT) AS n_test FROM tmp),
tmp2 AS (SELECT tmp.*, tot2.n_test FROM tmp, tot2),
{_largest_remainder_sql('n_test', 't_c', 'tmp2', 'te')},
al AS (SELECT te."Label", tmp.tr_c, tmp.t_c - te.alloc AS va_c FROM te JOIN tmp USING ("Label")),
r AS ({_rank_sql('flows', 'split')})
SELECT r.flow_id, r."Label", CASE WHEN rk <= tr_c THEN 'train' WHEN rk <= tr_c + va_c
       THEN 'val' ELSE 'test' END AS split FROM r JOIN al USING ("Label")"""


@register("x2_stratified_split", X2_SQL)
def x2_stratified_split(spark, sf):
    out = splits.stratified_split(fixtures.flows(spark, sf), ["flow_id"])
    return out.select("flow_id", "Label", "split")


X3_SQL = W() + """, r AS (SELECT flow_id, "Label", row_number() OVER (ORDER BY first_day, flow_id)
  AS pos, COUNT(*) OVER () AS n FROM flows),
b AS (SELECT *, CAST(floor(n * 0.6::DOUBLE) AS BIGINT) AS tr FROM r),
c AS (SELECT *, tr + ((n - tr) - CAST(floor((n - tr) * (1.0::DOUBLE - 0.25::DOUBLE)) AS BIGINT))
  AS ve FROM b)
SELECT flow_id, "Label", CASE WHEN pos <= tr THEN 'train' WHEN pos <= ve THEN 'val'
  ELSE 'test' END AS split FROM c"""


@register("x3_positional_split", X3_SQL)
def x3_positional_split(spark, sf):
    out = splits.positional_split(fixtures.flows(spark, sf), fixtures.ORDER_COLS)
    return out.select("flow_id", "Label", "split")


@register("a16_single_class", X3_SQL.replace(
    "SELECT flow_id, \"Label\", CASE WHEN pos", ", s AS (SELECT flow_id, \"Label\", CASE WHEN pos")
    + ") SELECT split, CAST(COUNT(DISTINCT \"Label\") AS BIGINT) AS n_classes, "
      "COUNT(DISTINCT \"Label\") < 2 AS single_class FROM s GROUP BY split")
def a16_single_class(spark, sf):
    s = splits.positional_split(fixtures.flows(spark, sf), fixtures.ORDER_COLS)
    prof = s.groupBy("split").agg(F.count_distinct("Label").cast("long").alias("n_classes"))
    return prof.withColumn("single_class", F.col("n_classes") < 2)


X4_SQL = X2_SQL.replace(
    "SELECT r.flow_id, r.\"Label\", CASE WHEN rk", ", sp AS (SELECT r.flow_id, r.\"Label\", "
    "CASE WHEN rk") + """),
trn AS (SELECT flow_id, "Label" FROM sp WHERE split = 'train'),
k AS (SELECT LEAST(CAST(trunc((0.05::DOUBLE * SUM(CASE WHEN "Label" = 0 THEN 1 ELSE 0 END))
      / (1 - 0.05::DOUBLE)) AS BIGINT), SUM(CASE WHEN "Label" = 1 THEN 1 ELSE 0 END)) AS need
      FROM trn),
ra AS (SELECT flow_id, "Label", row_number() OVER (ORDER BY
      md5(concat_ws('|', '42', 'contamination', CAST(flow_id AS VARCHAR))), flow_id) AS rk
      FROM trn WHERE "Label" = 1)
SELECT flow_id, "Label" FROM trn WHERE "Label" = 0
UNION ALL SELECT flow_id, "Label" FROM ra, k WHERE rk <= need"""


@register("x4_contamination", X4_SQL)
def x4_contamination(spark, sf):
    s = splits.stratified_split(fixtures.flows(spark, sf), ["flow_id"])
    train = s.filter(c("split") == "train").select("flow_id", "Label")
    return splits.contamination(train, 0.05, ["flow_id"])


@register("x5_sample_n", W() + "SELECT flow_id FROM (SELECT flow_id, row_number() OVER (ORDER BY "
          + HASH.format(p="sample") + ", flow_id) AS rk FROM flows) WHERE rk <= 500")
def x5_sample_n(spark, sf):
    return splits.sample_n(fixtures.flows(spark, sf), 500, ["flow_id"]).select("flow_id")


def _fewshot_sql(cls: int) -> str:
    return W() + f"""SELECT flow_id, "Label", CASE WHEN "Label" = {cls} AND rk <= GREATEST(1,
  CAST(trunc(n * 0.1::DOUBLE) AS BIGINT)) THEN 'few' ELSE 'holdout' END AS part FROM (
  SELECT flow_id, "Label", row_number() OVER (PARTITION BY "Label" ORDER BY
         {HASH.format(p='fewshot')}, flow_id) AS rk,
         COUNT(*) OVER (PARTITION BY "Label") AS n FROM flows WHERE domain = 'gen')"""


@register("x7_fewshot_normals", _fewshot_sql(0))
def x7_fewshot_normals(spark, sf):
    gen = fixtures.flows(spark, sf).filter(c("domain") == "gen")
    return splits.fewshot_split(gen, 0, 0.1, ["flow_id"]).select("flow_id", "Label", "part")


@register("x8_fewshot_attacks", _fewshot_sql(1))
def x8_fewshot_attacks(spark, sf):
    gen = fixtures.flows(spark, sf).filter(c("domain") == "gen")
    return splits.fewshot_split(gen, 1, 0.1, ["flow_id"]).select("flow_id", "Label", "part")


@register("x12_per_class_sample", W() + "SELECT flow_id, domain, \"Label\" FROM (SELECT *, "
          "row_number() OVER (PARTITION BY domain, \"Label\" ORDER BY "
          + HASH.format(p="view") + ", flow_id) AS rk FROM flows) WHERE rk <= 1000")
def x12_per_class_sample(spark, sf):
    s = splits.sample_n(fixtures.flows(spark, sf), 1000, ["flow_id"], purpose="view",
                        group_cols=["domain", "Label"])
    return s.select("flow_id", "domain", "Label")

from . import queries_stats  # noqa: E402,F401  (registers part 2)
from . import queries_jobs  # noqa: E402,F401  (registers part 3)
from . import queries_models  # noqa: E402,F401  (registers part 4)
