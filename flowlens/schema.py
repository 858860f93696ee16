"""Column names of the flow table and the header guard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

# The metadata prefix of every flow table, in order.
METADATA_COLUMNS = [
    "source_relpath",
    "source_filename",
    "source_modality",
    "source_group",
    "source_split_folder",
    "assigned_split",
    "split_strategy",
    "sample_name",
    "sample_core_name",
    "protocol_scope",
    "protocol_hint",
    "device",
    "scenario",
    "attack_name",
    "attack_family",
    "attack_variant",
    "is_attack",
    "is_benign",
    "label",
    "source_row_index",
]

# Flow features that describe a protocol or flag and are never perturbed.
SEMANTIC_LOCKS = [
    "Protocol Type",
    "fin_flag_number",
    "syn_flag_number",
    "rst_flag_number",
    "psh_flag_number",
    "ack_flag_number",
    "ece_flag_number",
    "cwr_flag_number",
    "HTTP",
    "HTTPS",
    "DNS",
    "Telnet",
    "SMTP",
    "SSH",
    "IRC",
    "TCP",
    "UDP",
    "DHCP",
    "ARP",
    "ICMP",
    "IGMP",
    "IPv",
    "LLC",
]

PROTOCOLS = ["wifi", "mqtt", "bluetooth"]


def flow_schema(features: Sequence[str]) -> T.StructType:
    """Explicit read schema: text metadata, integer labels, bigint row index, double features."""
    ints = {"is_attack", "is_benign", "label"}
    fields = []
    for name in METADATA_COLUMNS:
        kind: T.DataType = T.StringType()
        if name in ints:
            kind = T.IntegerType()
        elif name == "source_row_index":
            kind = T.LongType()
        fields.append(T.StructField(name, kind))
    return T.StructType(fields + [T.StructField(f, T.DoubleType()) for f in features])


def feature_columns(columns: Sequence[str]) -> list[str]:
    """Everything after the metadata prefix; raises when the header is not a valid flow header."""
    prefix = list(columns[: len(METADATA_COLUMNS)])
    if prefix != METADATA_COLUMNS:
        raise ValueError(f"flow header must start with the metadata columns, got {prefix}")
    features = list(columns[len(METADATA_COLUMNS) :])
    if not features:
        raise ValueError("flow header has no feature columns")
    if len(set(features)) != len(features):
        raise ValueError("flow header repeats a feature column")
    leaked = sorted(set(features) & set(METADATA_COLUMNS))
    if leaked:
        raise ValueError(f"metadata columns among the features: {leaked}")
    return features


def require_columns(have: Sequence[str], want: Sequence[str]) -> None:
    missing = [c for c in want if c not in set(have)]
    if missing:
        raise ValueError(f"missing columns: {missing}")
