"""DuckDB text of the ``flows`` test input and its variants (``FIXTURES.md``).

Oracle queries start with ``WITH <ctes>`` from here and then state the
operator under test in plain SQL.
"""

from __future__ import annotations

from ..sources.fixtures import FLOW_FEATURES


def q(name: str) -> str:
    return '"' + name + '"'


PACKETS = """p AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag,
         CAST(l_shipdate AS DATE) AS day,
         l_linestatus = 'O' AS fwd,
         l_quantity AS q,
         20 + 4 * l_linenumber AS hdr,
         CAST(ROUND(l_discount * 100) AS INT) AS disc,
         CAST(ROUND(l_tax * 100) AS INT) AS tax,
         DATEDIFF('day', CAST(LAG(l_shipdate) OVER (PARTITION BY l_orderkey
                  ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_linestatus) AS DATE),
                  CAST(l_shipdate AS DATE)) AS gap
  FROM lineitem)"""

_FLOW_EXPR = {
    "Soma Fwd Packets": "CAST(SUM(CASE WHEN fwd THEN 1 ELSE 0 END) AS DOUBLE)",
    "Subflow Bwd Packets": "CAST(SUM(CASE WHEN fwd THEN 0 ELSE 1 END) AS DOUBLE)",
    "Soma Length of Fwd Packets": "CAST(SUM(CASE WHEN fwd THEN q ELSE 0 END) AS DOUBLE)",
    "Subflow Fwd Bytes": "CAST(SUM(CASE WHEN fwd THEN q ELSE 0 END) AS DOUBLE)",
    "Subflow Bwd Bytes": "CAST(SUM(CASE WHEN fwd THEN 0 ELSE q END) AS DOUBLE)",
    "Packet Length Mean": "ROUND(AVG(q), 6)",
    "Packet Length Std": "ROUND(COALESCE(STDDEV_SAMP(q), 0), 6)",
    "Min Packet Length": "MIN(q)",
    "Max Packet Length": "MAX(q)",
    "Fwd Packet Length Mean": "ROUND(COALESCE(AVG(CASE WHEN fwd THEN q END), 0), 6)",
    "Fwd Packet Length Std": "ROUND(COALESCE(STDDEV_SAMP(CASE WHEN fwd THEN q END), 0), 6)",
    "Bwd Packet Length Mean": "ROUND(COALESCE(AVG(CASE WHEN fwd THEN NULL ELSE q END), 0), 6)",
    "Bwd Packet Length Std":
        "ROUND(COALESCE(STDDEV_SAMP(CASE WHEN fwd THEN NULL ELSE q END), 0), 6)",
    "Fwd Header Length": "CAST(SUM(CASE WHEN fwd THEN hdr ELSE 0 END) AS DOUBLE)",
    "Bwd Header Length": "CAST(SUM(CASE WHEN fwd THEN 0 ELSE hdr END) AS DOUBLE)",
    "act_data_pkt_fwd": "CAST(SUM(CASE WHEN fwd AND q > 10 THEN 1 ELSE 0 END) AS DOUBLE)",
    "min_seg_size_forward": "CAST(COALESCE(MIN(CASE WHEN fwd THEN hdr END), 0) AS DOUBLE)",
    "Flow Duration": "CAST(COALESCE(SUM(gap), 0) AS DOUBLE) * 86400000000",
    "Flow IAT Mean": "ROUND(COALESCE(AVG(gap), 0), 6)",
    "Flow IAT Std": "ROUND(COALESCE(STDDEV_SAMP(gap), 0), 6)",
    "Flow IAT Min": "CAST(COALESCE(MIN(gap), 0) AS DOUBLE)",
    "Flow IAT Max": "CAST(COALESCE(MAX(gap), 0) AS DOUBLE)",
    "Fwd IAT Mean": "ROUND(COALESCE(AVG(CASE WHEN fwd THEN gap END), 0), 6)",
    "Fwd IAT Std": "ROUND(COALESCE(STDDEV_SAMP(CASE WHEN fwd THEN gap END), 0), 6)",
    "Bwd IAT Mean": "ROUND(COALESCE(AVG(CASE WHEN fwd THEN NULL ELSE gap END), 0), 6)",
    "Bwd IAT Std": "ROUND(COALESCE(STDDEV_SAMP(CASE WHEN fwd THEN NULL ELSE gap END), 0), 6)",
    "Active Mean": "ROUND(COALESCE(AVG(CASE WHEN gap <= 180 THEN gap END), 0), 6)",
    "Active Std": "ROUND(COALESCE(STDDEV_SAMP(CASE WHEN gap <= 180 THEN gap END), 0), 6)",
    "Active Max": "CAST(COALESCE(MAX(CASE WHEN gap <= 180 THEN gap END), 0) AS DOUBLE)",
    "Idle Mean": "ROUND(COALESCE(AVG(CASE WHEN gap > 180 THEN gap END), 0), 6)",
    "SYN Flag Count": "CAST(SUM(CASE WHEN tax = 0 THEN 1 ELSE 0 END) AS DOUBLE)",
    "PSH Flag Count": "CAST(SUM(CASE WHEN disc >= 8 THEN 1 ELSE 0 END) AS DOUBLE)",
    "ACK Flag Count": "CAST(SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS DOUBLE)",
    "RST Flag Count": "CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE)",
    "URG Flag Count": "CAST(SUM(CASE WHEN tax = 8 THEN 1 ELSE 0 END) AS DOUBLE)",
    "FIN Flag Count": "CAST(SUM(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) AS DOUBLE)",
    "ECE Flag Count": "CAST(0 AS DOUBLE)",
    "Fwd PSH Flags": "CAST(SUM(CASE WHEN fwd AND disc >= 8 THEN 1 ELSE 0 END) AS DOUBLE)",
    "Fwd URG Flags": "CAST(SUM(CASE WHEN fwd AND tax = 8 THEN 1 ELSE 0 END) AS DOUBLE)",
    "Init_Win_bytes_forward":
        "CAST(COALESCE(MIN(CASE WHEN fwd THEN l_partkey END), -1) AS DOUBLE)",
    "Init_Win_bytes_backward":
        "CAST(COALESCE(MIN(CASE WHEN fwd THEN NULL ELSE l_partkey END), -1) AS DOUBLE)",
}

FLOWS = "flows AS (\n  SELECT l_orderkey AS flow_id, MIN(day) AS first_day,\n" \
        "         CASE WHEN l_orderkey % 3 = 0 THEN 'gen' ELSE 'train' END AS domain,\n" + \
        ",\n".join(f"         {_FLOW_EXPR[n]} AS {q(n)}" for n in FLOW_FEATURES) + \
        ",\n         CAST(CASE WHEN AVG(q) > 36 THEN 1 ELSE 0 END AS INT) AS \"Label\"\n" \
        "  FROM p GROUP BY l_orderkey)"

_DIRTY = {
    "Flow Duration": "CASE WHEN flow_id % 97 = 0 THEN CAST('inf' AS DOUBLE) "
                     "ELSE \"Flow Duration\" END",
    "Flow IAT Std": "CASE WHEN flow_id % 101 = 0 THEN CAST('nan' AS DOUBLE) "
                    "ELSE \"Flow IAT Std\" END",
    "Packet Length Std": "CASE WHEN \"Soma Fwd Packets\" + \"Subflow Bwd Packets\" = 1 "
                         "THEN CAST(NULL AS DOUBLE) ELSE \"Packet Length Std\" END",
    "Active Max": "CASE WHEN flow_id % 89 = 0 THEN CAST('-inf' AS DOUBLE) "
                  "ELSE \"Active Max\" END",
}

ALL_COLS = ["flow_id", "first_day", "domain", *FLOW_FEATURES, "Label"]

FLOWS_DIRTY = "flows_dirty AS (\n  SELECT " + ", ".join(
    f"{_DIRTY[n]} AS {q(n)}" if n in _DIRTY else q(n) for n in ALL_COLS) + " FROM flows)"

FLOWS_TEXT = "flows_text AS (\n  SELECT " + ", ".join(
    "CASE WHEN \"Label\" = 0 THEN 'BENIGN' ELSE 'ATTACK' END AS \"Label\"" if n == "Label"
    else q(n) for n in ALL_COLS) + " FROM flows)"

FLOWS_MISSING = "flows_missing AS (\n  SELECT " + ", ".join(
    q(n) for n in ALL_COLS if n not in ("ECE Flag Count", "Idle Mean")) + " FROM flows)"


def with_flows(*extra: str) -> str:
    """``WITH p, flows[, extra…]`` prefix (no trailing comma)."""
    parts = [PACKETS, FLOWS, *extra]
    return "WITH " + ",\n".join(parts) + "\n"
