"""Plain-SQL statement of the engineered features, for the DuckDB oracle."""

from __future__ import annotations

from .oracle_fixtures import q


def sd(num: str, den: str) -> str:
    """num / (den + 1) with non-finite and missing results → 0."""
    e = f"(({num}) / (({den}) + 1.0))"
    return f"(CASE WHEN isfinite({e}) THEN {e} ELSE 0.0 END)"


def ind(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 1 ELSE 0 END)"


def clip0(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN {x} " \
           f"WHEN {x} < 0 THEN 0.0 ELSE {x} END)"


FP, BP, FB, BB, SFB = (q("Soma Fwd Packets"), q("Subflow Bwd Packets"),
                       q("Soma Length of Fwd Packets"), q("Subflow Bwd Bytes"),
                       q("Subflow Fwd Bytes"))
TP = f"({FP} + {BP})"
DUR = q("Flow Duration")

SQL_FEATURES: dict[str, tuple[str, str]] = {
    # name: (group, expression)
    "bytes_ratio_bwd_fwd": ("Eng_Packet_Shape", sd(BB, FB)),
    "pkts_ratio_bwd_fwd": ("Eng_Packet_Shape", sd(BP, FP)),
    "avg_pkt_size_fwd": ("Eng_Packet_Shape", sd(FB, FP)),
    "avg_pkt_size_bwd": ("Eng_Packet_Shape", sd(BB, BP)),
    "pkt_size_ratio_bwd_fwd": ("Eng_Packet_Shape", sd(sd(BB, BP), sd(FB, FP))),
    "pkt_len_cv": ("Eng_Packet_Shape", sd(q("Packet Length Std"), q("Packet Length Mean"))),
    "pkt_len_min_max_ratio": ("Eng_Packet_Shape",
                              sd(q("Min Packet Length"), q("Max Packet Length"))),
    "fwd_header_to_payload_ratio": ("Eng_Fwd_Header_Load", sd(q("Fwd Header Length"), FB)),
    "bwd_header_to_payload_ratio": ("Eng_Fwd_Header_Load", sd(q("Bwd Header Length"), BB)),
    "fwd_header_per_pkt": ("Eng_Fwd_Header_Load", sd(q("Fwd Header Length"), FP)),
    "bwd_header_per_pkt": ("Eng_Fwd_Header_Load", sd(q("Bwd Header Length"), BP)),
    "fwd_data_pkt_ratio": ("Eng_Fwd_Header_Load", sd(q("act_data_pkt_fwd"), FP)),
    "fwd_iat_cv": ("Eng_Temporal_Burstiness", sd(q("Fwd IAT Std"), q("Fwd IAT Mean"))),
    "bwd_iat_cv": ("Eng_Temporal_Burstiness", sd(q("Bwd IAT Std"), q("Bwd IAT Mean"))),
    "flow_iat_cv": ("Eng_Temporal_Burstiness", sd(q("Flow IAT Std"), q("Flow IAT Mean"))),
    "duration_per_pkt": ("Eng_Temporal_Burstiness", sd(DUR, TP)),
    "active_idle_ratio": ("Eng_Temporal_Burstiness", sd(q("Active Mean"), q("Idle Mean"))),
    "active_cv": ("Eng_Temporal_Burstiness", sd(q("Active Std"), q("Active Mean"))),
    "syn_flag_count_density": ("Eng_Flag_Density", sd(q("SYN Flag Count"), TP)),
    "psh_flag_count_density": ("Eng_Flag_Density", sd(q("PSH Flag Count"), TP)),
    "ack_flag_count_density": ("Eng_Flag_Density", sd(q("ACK Flag Count"), TP)),
    "rst_flag_count_density": ("Eng_Flag_Density", sd(q("RST Flag Count"), TP)),
    "urg_flag_count_density": ("Eng_Flag_Density", sd(q("URG Flag Count"), TP)),
    "fin_flag_count_density": ("Eng_Flag_Density", sd(q("FIN Flag Count"), TP)),
    "ece_flag_count_density": ("Eng_Flag_Density", sd(q("ECE Flag Count"), TP)),
    "fwd_psh_density": ("Eng_Flag_Density", sd(q("Fwd PSH Flags"), FP)),
    "fwd_urg_density": ("Eng_Flag_Density", sd(q("Fwd URG Flags"), FP)),
    "is_unidirectional": ("Eng_Flow_Indicators", ind(f"{BP} = 0")),
    "is_short_flow": ("Eng_Flow_Indicators", ind(f"{DUR} < 100000")),
    "init_win_ratio": ("Eng_Flow_Indicators",
                       sd(clip0(q("Init_Win_bytes_forward")), clip0(q("Init_Win_bytes_backward")))),
    "subflow_bytes_ratio": ("Eng_Flow_Indicators", sd(BB, SFB)),
    "init_win_fwd_is_zero": ("Eng_Flow_Indicators", ind(f"{q('Init_Win_bytes_forward')} <= 0")),
    "fwd_min_seg_to_header": ("Eng_Flow_Indicators",
                              sd(q("min_seg_size_forward"), q("Fwd Header Length"))),
    "pkt_rate": ("Eng_Flow_Rates", sd(TP, DUR)),
    "fwd_pkt_rate": ("Eng_Flow_Rates", sd(FP, DUR)),
    "bwd_pkt_rate": ("Eng_Flow_Rates", sd(BP, DUR)),
    "byte_rate": ("Eng_Flow_Rates", sd(f"{FB} + {BB}", DUR)),
    "fwd_byte_rate": ("Eng_Flow_Rates", sd(FB, DUR)),
    "fwd_pktlen_cv": ("Eng_BruteForce",
                      sd(q("Fwd Packet Length Std"), q("Fwd Packet Length Mean"))),
    "bwd_pktlen_cv": ("Eng_BruteForce",
                      sd(q("Bwd Packet Length Std"), q("Bwd Packet Length Mean"))),
    "pktlen_range_ratio": ("Eng_BruteForce",
                           sd(f"{q('Max Packet Length')} - {q('Min Packet Length')}",
                              q("Packet Length Mean"))),
    "fwd_bwd_pktlen_ratio": ("Eng_BruteForce",
                             sd(q("Fwd Packet Length Mean"), q("Bwd Packet Length Mean"))),
    "byte_symmetry": ("Eng_BruteForce", sd(f"abs({SFB} - {BB})", f"{SFB} + {BB}")),
    "bytes_per_pkt": ("Eng_BruteForce", sd(f"{SFB} + {BB}", TP)),
    "iat_min_max_ratio": ("Eng_BruteForce", sd(q("Flow IAT Min"), q("Flow IAT Max"))),
    "active_burst_ratio": ("Eng_BruteForce",
                           sd(q("Active Mean"), f"{q('Active Mean')} + {q('Idle Mean')}")),
    "header_overhead": ("Eng_BruteForce",
                        sd(f"{q('Fwd Header Length')} + {q('Bwd Header Length')}",
                           f"{SFB} + {BB}")),
}


def group_select(group: str | None) -> str:
    """Comma list of ``expr AS "name"`` for one group (None = all)."""
    return ",\n  ".join(f"{e} AS {q(n)}" for n, (g, e) in SQL_FEATURES.items()
                        if group is None or g == group)


def feature_select(names) -> str:
    return ",\n  ".join(f"{SQL_FEATURES[n][1]} AS {q(n)}" for n in names)
