"""Engineered flow features (D1–D47) and the request resolver.

Every feature is a Catalyst expression; a request becomes one ``select`` that
keeps the input columns and appends only the requested features, so the
whole step stays inside one whole-stage-codegen span with no UDF.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .safe import c, clip_low, flag, safe_div

log = logging.getLogger(__name__)

# Source column names the features are defined on.
FP = "Soma Fwd Packets"
BP = "Subflow Bwd Packets"
FB = "Soma Length of Fwd Packets"
BB = "Subflow Bwd Bytes"
SFB = "Subflow Fwd Bytes"


@dataclass(frozen=True)
class Feature:
    name: str
    group: str
    needs: tuple[str, ...]           # source columns (or earlier features)
    build: Callable[[dict[str, Column]], Column]


def _tp(e):
    return e[FP] + e[BP]


def _ratio(name, group, num, den):
    return Feature(name, group, (num, den), lambda e: safe_div(e[num], e[den]))


_FLAGS = ["SYN", "PSH", "ACK", "RST", "URG", "FIN", "ECE"]

# Group names, feature names and their order (the catalogue).
GROUPS: dict[str, list[Feature]] = {
    "Eng_Packet_Shape": [
        _ratio("bytes_ratio_bwd_fwd", "Eng_Packet_Shape", BB, FB),
        _ratio("pkts_ratio_bwd_fwd", "Eng_Packet_Shape", BP, FP),
        _ratio("avg_pkt_size_fwd", "Eng_Packet_Shape", FB, FP),
        _ratio("avg_pkt_size_bwd", "Eng_Packet_Shape", BB, BP),
        Feature("pkt_size_ratio_bwd_fwd", "Eng_Packet_Shape", (BB, BP, FB, FP),
                lambda e: safe_div(safe_div(e[BB], e[BP]), safe_div(e[FB], e[FP]))),
        _ratio("pkt_len_cv", "Eng_Packet_Shape", "Packet Length Std", "Packet Length Mean"),
        _ratio("pkt_len_min_max_ratio", "Eng_Packet_Shape",
               "Min Packet Length", "Max Packet Length"),
    ],
    "Eng_Fwd_Header_Load": [
        _ratio("fwd_header_to_payload_ratio", "Eng_Fwd_Header_Load", "Fwd Header Length", FB),
        _ratio("bwd_header_to_payload_ratio", "Eng_Fwd_Header_Load", "Bwd Header Length", BB),
        _ratio("fwd_header_per_pkt", "Eng_Fwd_Header_Load", "Fwd Header Length", FP),
        _ratio("bwd_header_per_pkt", "Eng_Fwd_Header_Load", "Bwd Header Length", BP),
        _ratio("fwd_data_pkt_ratio", "Eng_Fwd_Header_Load", "act_data_pkt_fwd", FP),
    ],
    "Eng_Temporal_Burstiness": [
        _ratio("fwd_iat_cv", "Eng_Temporal_Burstiness", "Fwd IAT Std", "Fwd IAT Mean"),
        _ratio("bwd_iat_cv", "Eng_Temporal_Burstiness", "Bwd IAT Std", "Bwd IAT Mean"),
        _ratio("flow_iat_cv", "Eng_Temporal_Burstiness", "Flow IAT Std", "Flow IAT Mean"),
        Feature("duration_per_pkt", "Eng_Temporal_Burstiness", ("Flow Duration", FP, BP),
                lambda e: safe_div(e["Flow Duration"], _tp(e))),
        _ratio("active_idle_ratio", "Eng_Temporal_Burstiness", "Active Mean", "Idle Mean"),
        _ratio("active_cv", "Eng_Temporal_Burstiness", "Active Std", "Active Mean"),
    ],
    "Eng_Flag_Density": [
        Feature(f"{f.lower()}_flag_count_density", "Eng_Flag_Density",
                (FP, BP, f"{f} Flag Count"),
                (lambda src: (lambda e: safe_div(e[src], _tp(e))))(f"{f} Flag Count"))
        for f in _FLAGS
    ] + [
        Feature("fwd_psh_density", "Eng_Flag_Density", (FP, BP, "Fwd PSH Flags"),
                lambda e: safe_div(e["Fwd PSH Flags"], e[FP])),
        Feature("fwd_urg_density", "Eng_Flag_Density", (FP, BP, "Fwd URG Flags"),
                lambda e: safe_div(e["Fwd URG Flags"], e[FP])),
    ],
    "Eng_Flow_Indicators": [
        Feature("is_unidirectional", "Eng_Flow_Indicators", (BP,),
                lambda e: flag(e[BP] == 0)),
        Feature("is_short_flow", "Eng_Flow_Indicators", ("Flow Duration",),
                lambda e: flag(e["Flow Duration"] < 100000)),
        Feature("init_win_ratio", "Eng_Flow_Indicators",
                ("Init_Win_bytes_forward", "Init_Win_bytes_backward"),
                lambda e: safe_div(clip_low(e["Init_Win_bytes_forward"]),
                                   clip_low(e["Init_Win_bytes_backward"]))),
        _ratio("subflow_bytes_ratio", "Eng_Flow_Indicators", BB, SFB),
        Feature("init_win_fwd_is_zero", "Eng_Flow_Indicators", ("Init_Win_bytes_forward",),
                lambda e: flag(e["Init_Win_bytes_forward"] <= 0)),
        _ratio("fwd_min_seg_to_header", "Eng_Flow_Indicators",
               "min_seg_size_forward", "Fwd Header Length"),
    ],
    "Eng_Flow_Rates": [
        Feature("pkt_rate", "Eng_Flow_Rates", ("Flow Duration", FP, BP),
                lambda e: safe_div(_tp(e), e["Flow Duration"])),
        Feature("fwd_pkt_rate", "Eng_Flow_Rates", ("Flow Duration", FP, BP),
                lambda e: safe_div(e[FP], e["Flow Duration"])),
        Feature("bwd_pkt_rate", "Eng_Flow_Rates", ("Flow Duration", FP, BP),
                lambda e: safe_div(e[BP], e["Flow Duration"])),
        Feature("byte_rate", "Eng_Flow_Rates", ("Flow Duration", FB, BB),
                lambda e: safe_div(e[FB] + e[BB], e["Flow Duration"])),
        Feature("fwd_byte_rate", "Eng_Flow_Rates", ("Flow Duration", FB, BB),
                lambda e: safe_div(e[FB], e["Flow Duration"])),
    ],
    "Eng_BruteForce": [
        _ratio("fwd_pktlen_cv", "Eng_BruteForce",
               "Fwd Packet Length Std", "Fwd Packet Length Mean"),
        _ratio("bwd_pktlen_cv", "Eng_BruteForce",
               "Bwd Packet Length Std", "Bwd Packet Length Mean"),
        Feature("pktlen_range_ratio", "Eng_BruteForce",
                ("Max Packet Length", "Min Packet Length", "Packet Length Mean"),
                lambda e: safe_div(e["Max Packet Length"] - e["Min Packet Length"],
                                   e["Packet Length Mean"])),
        _ratio("fwd_bwd_pktlen_ratio", "Eng_BruteForce",
               "Fwd Packet Length Mean", "Bwd Packet Length Mean"),
        Feature("byte_symmetry", "Eng_BruteForce", (SFB, BB),
                lambda e: safe_div(F.abs(e[SFB] - e[BB]), e[SFB] + e[BB])),
        Feature("bytes_per_pkt", "Eng_BruteForce", (SFB, BB, FP, BP),
                lambda e: safe_div(e[SFB] + e[BB], _tp(e))),
        _ratio("iat_min_max_ratio", "Eng_BruteForce", "Flow IAT Min", "Flow IAT Max"),
        Feature("active_burst_ratio", "Eng_BruteForce", ("Active Mean", "Idle Mean"),
                lambda e: safe_div(e["Active Mean"], e["Active Mean"] + e["Idle Mean"])),
        Feature("header_overhead", "Eng_BruteForce",
                ("Fwd Header Length", "Bwd Header Length", SFB, BB),
                lambda e: safe_div(e["Fwd Header Length"] + e["Bwd Header Length"],
                                   e[SFB] + e[BB])),
    ],
}

FEATURES: dict[str, Feature] = {f.name: f for fs in GROUPS.values() for f in fs}


def register_group(group: str, features: Iterable[tuple[str, Iterable[str], Callable[[dict[str, Column]], Column]]]) -> None:
    """Add a feature group: (name, source columns, builder) each, where the builder gets the
    columns by name.  The group can then be requested like the package's own (D48)."""
    own = [Feature(name, group, tuple(needs), build) for name, needs, build in features]
    taken = [f.name for f in own if f.name in FEATURES] + [n for n in (group, *[f.name for f in own]) if n in GROUPS or n == "all"]
    if taken or len({f.name for f in own}) < len(own):
        raise ValueError(f"names in use already: {taken or 'repeated feature names'}")
    GROUPS[group] = own
    FEATURES.update({f.name: f for f in own})


def unregister_group(group: str) -> None:
    for f in GROUPS.pop(group):
        del FEATURES[f.name]


def feature_columns(group: str | None = None) -> list[str]:
    if group is None:
        return list(FEATURES)
    return [f.name for f in GROUPS[group]]


def resolve(names: Iterable[str] | None, whitelist: Iterable[str] | None = None,
            strict: bool = False) -> list[str]:
    """Names (groups, single features, or ``all``) → ordered feature list.

    Unknown names warn and are ignored (``strict``: raise, as the jobs do).  A
    whitelist pulls in the features it names.  Order follows the catalogue.
    """
    if strict:
        bad = [n for n in (names or []) if n != "all" and n not in GROUPS and n not in FEATURES]
        if bad:
            raise ValueError(f"unknown domain features or groups: {bad}. "
                             f"Groups: {list(GROUPS)}; features: {list(FEATURES)}")
    wanted: set[str] = set()
    for n in list(names or []) + [w for w in (whitelist or []) if w in FEATURES]:
        if n == "all":
            wanted.update(FEATURES)
        elif n in GROUPS:
            wanted.update(f.name for f in GROUPS[n])
        elif n in FEATURES:
            wanted.add(n)
        elif whitelist is None or n not in set(whitelist):
            log.warning("unknown feature or group %r ignored", n)
    return [f for f in FEATURES if f in wanted]


def add_domain_features(df: DataFrame, features: Iterable[str] | None,
                        whitelist: Iterable[str] | None = None, strict: bool = False
                        ) -> DataFrame:
    """Append the requested engineered features in one projection.

    A feature whose source columns are absent is skipped with a warning.  An
    input column is never replaced or dropped (a feature named like an input
    column is skipped).
    """
    order = resolve(features, whitelist, strict)
    if not order:
        return df
    have = set(df.columns)
    env = {name: c(name) for name in df.columns}
    out: list[Column] = []
    for name in order:
        feat = FEATURES[name]
        missing = [s for s in feat.needs if s not in have]
        if missing:
            log.warning("feature %s not produced, missing source columns %s", name, missing)
            continue
        if name in have:
            log.warning("feature %s collides with an input column; input kept", name)
            continue
        out.append(feat.build(env).alias(name))
    if not out:
        return df
    return df.select(*[c(n) for n in df.columns], *out)
