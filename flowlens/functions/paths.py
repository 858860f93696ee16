"""Metadata that can be read off a capture path: split, protocol, attack family, device, label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.hashing import md5_bucket


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lower_parts(path: Column | str) -> Column:
    return F.split(F.lower(_c(path)), "/")


def is_capture_path(path: Column | str) -> Column:
    """A CSV file below an ``attacks`` or ``profiling`` folder and a ``csv`` folder."""
    parts = lower_parts(path)
    grouped = F.array_contains(parts, "attacks") | F.array_contains(parts, "profiling")
    return grouped & F.array_contains(parts, "csv") & F.lower(_c(path)).endswith(".csv")


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def strip_extensions(name: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(name), r"(?i)\.csv$", ""), r"(?i)\.pcap$", "")


def trim_split_suffix(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), r"(?i)_(train|test)$", "")


def split_folder(path: Column | str) -> Column:
    parts = lower_parts(path)
    return (
        F.when(F.array_contains(parts, "train"), F.lit("train"))
        .when(F.array_contains(parts, "test"), F.lit("test"))
        .otherwise(F.lit("unspecified"))
    )


def source_group(path: Column | str) -> Column:
    parts = lower_parts(path)
    return (
        F.when(F.array_contains(parts, "attacks"), F.lit("attacks"))
        .when(F.array_contains(parts, "profiling"), F.lit("profiling"))
        .otherwise(F.lit("other"))
    )


def modality(path: Column | str) -> Column:
    first = F.get(F.split(_c(path), "/"), F.lit(0))
    low = F.lower(first)
    return (
        F.when(low.contains("bluetooth"), F.lit("bluetooth"))
        .when(low.contains("wifi") | low.contains("mqtt"), F.lit("wifi_mqtt"))
        .otherwise(first)
    )


def protocol_hint(modality_col: Column | str, core: Column | str) -> Column:
    low = F.lower(_c(core))
    return (
        F.when(_c(modality_col) == "bluetooth", F.lit("bluetooth"))
        .when(low.contains("mqtt") | low.contains("broker"), F.lit("mqtt"))
        .when(_c(modality_col) == "wifi_mqtt", F.lit("wifi"))
        .otherwise(F.lit("unknown"))
    )


# Name prefixes that carry the family, checked in this order.
FAMILY_PREFIXES = [
    ("TCP_IP-DDoS-", "DDoS"),
    ("TCP_IP-DoS-", "DoS"),
    ("MQTT-DDoS-", "DDoS"),
    ("MQTT-DoS-", "DoS"),
    ("Recon-", "Recon"),
]
# Words that carry the family when no prefix does; the variant is then the whole name.
FAMILY_WORDS = [
    (("Spoof", "spoof"), "Spoofing"),
    (("Malformed",), "Malformed"),
    (("Benign", "benign"), "Benign"),
]


def attack_family(name: Column | str) -> Column:
    """``struct(family, variant)`` of an attack name."""
    n = F.coalesce(_c(name), F.lit(""))
    family = F.when(n == "", F.lit("Benign"))
    variant = F.when(n == "", F.lit(""))
    for prefix, fam in FAMILY_PREFIXES:
        family = family.when(n.startswith(prefix), F.lit(fam))
        variant = variant.when(n.startswith(prefix), F.substring(n, len(prefix) + 1, 1 << 20))
    for words, fam in FAMILY_WORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | n.contains(word)
        family = family.when(hit, F.lit(fam))
    return F.struct(family.otherwise(F.lit("Other")).alias("family"), variant.otherwise(n).alias("variant"))


def device_scenario(core: Column | str) -> Column:
    """``struct(device, scenario)`` of a profiling capture."""
    n = _c(core)
    known = n.isin("Active", "Idle", "ActiveBroker")
    device = F.when(known, n)
    scenario = F.when(known, n)
    for link in ("LAN", "WAN"):
        cut = F.split(n, f"_{link}_", 2)
        device = device.when(n.contains(f"_{link}_"), F.get(cut, F.lit(0)))
        scenario = scenario.when(n.contains(f"_{link}_"), F.concat(F.lit(f"{link}_"), F.get(cut, F.lit(1))))
    power = n.endswith("_Power")
    device = device.when(power, F.regexp_replace(n, "_Power$", ""))
    scenario = scenario.when(power, F.lit("Power"))
    return F.struct(device.otherwise(n).alias("device"), scenario.otherwise(F.lit("Profiling")).alias("scenario"))


def assign_split(path: Column | str, test_percent: int) -> Column:
    """``struct(split, strategy)``: the folder when it names a split, else an md5 bucket of the path."""
    folder = split_folder(path)
    foldered = folder.isin("train", "test")
    hashed = F.when(md5_bucket(path, 100) < test_percent, F.lit("test")).otherwise(F.lit("train"))
    return F.struct(
        F.when(foldered, folder).otherwise(hashed).alias("split"),
        F.when(foldered, F.lit("folder")).otherwise(F.lit(f"profile_hash_{test_percent}")).alias("strategy"),
    )


def with_path_metadata(df: DataFrame, path: str = "source_relpath", test_percent: int = 20) -> DataFrame:
    """Attach every path-derived metadata column."""
    p = F.col(path)
    df = df.withColumns(
        {
            "source_filename": file_name(p),
            "source_modality": modality(p),
            "source_group": source_group(p),
            "source_split_folder": split_folder(p),
            "assigned_split": assign_split(p, test_percent)["split"],
            "split_strategy": assign_split(p, test_percent)["strategy"],
            "sample_name": strip_extensions(file_name(p)),
            "sample_core_name": trim_split_suffix(strip_extensions(file_name(p))),
        }
    )
    core, mod = F.col("sample_core_name"), F.col("source_modality")
    in_attacks = F.col("source_group") == "attacks"
    benign_named = F.lower(core).contains("benign")
    attack_device = (
        F.when(mod == "bluetooth", F.lit("Bluetooth_Device"))
        .when(F.lower(core).contains("mqtt"), F.lit("MQTT_Device"))
        .otherwise(F.lit("WiFi_IoMT_Device"))
    )
    is_attack = (in_attacks & ~benign_named).cast("int")
    return df.withColumns(
        {
            "protocol_scope": mod,
            "protocol_hint": protocol_hint(mod, core),
            "device": F.when(in_attacks, attack_device).otherwise(device_scenario(core)["device"]),
            "scenario": F.when(in_attacks, F.lit("Attack")).otherwise(device_scenario(core)["scenario"]),
            "attack_name": F.when(in_attacks, core).otherwise(F.lit("Benign")),
            "attack_family": F.when(in_attacks, attack_family(core)["family"]).otherwise(F.lit("Benign")),
            "attack_variant": F.when(in_attacks, attack_family(core)["variant"]).otherwise(F.lit("")),
            "is_attack": is_attack,
            "is_benign": F.lit(1) - is_attack,
            "label": is_attack,
        }
    )
