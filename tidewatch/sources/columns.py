"""Column naming and schema-only column choices; none of these starts a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch import fixed_values as fixed

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def clean_name(name: str, spaces: bool = True, slashes: bool = True) -> str:
    name = name.strip()
    if spaces:
        name = name.replace(" ", "_")
    if slashes:
        name = name.replace("/", "_")
    return name


def clean_names(df: DataFrame, spaces: bool = True, slashes: bool = True) -> DataFrame:
    """Strip names, turn blanks and slashes into underscores, and keep the first of equal names."""
    return keep_first_names(df, [clean_name(c, spaces, slashes) for c in df.columns])


def keep_first_names(df: DataFrame, names: list[str]) -> DataFrame:
    """Rename by position, then keep the first column of every name."""
    positions = {}
    for i, name in enumerate(names):
        positions.setdefault(name, i)
    by_position = df.toDF(*[f"__p{i}" for i in range(len(names))])
    return by_position.select(*[by_position[f"__p{i}"].alias(name) for name, i in positions.items()])


def rename_variants(df: DataFrame, variants: dict[str, str] = fixed.WSN_RENAMES) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in variants.items() if old in df.columns})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def fractional_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def feature_columns(df: DataFrame, exclude: list[str]) -> list[str]:
    """Numeric columns in table order, without the excluded names."""
    return [c for c in numeric_columns(df) if c not in set(exclude)]


def cicids_features(df: DataFrame) -> list[str]:
    return feature_columns(df, fixed.CICIDS_NOT_FEATURES)


def wsn_features(df: DataFrame) -> list[str]:
    return feature_columns(df, fixed.WSN_NOT_FEATURES)


def nsl_features(df: DataFrame) -> list[str]:
    return feature_columns(df, ["label", "difficulty", "attack_category", "target"])


def present(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted names that exist, in the wanted order."""
    have = set(df.columns)
    return [c for c in wanted if c in have]


PORT_NAMES = [
    "port_diff", "port_sum", "is_well_known_src", "is_well_known_dst", "is_high_port_src",
    "is_high_port_dst",
]
TIME_NAMES = ["hour", "day_of_week", "month", "is_weekend", "is_business_hours", "is_night"]
ADDRESS_PARTS = ["oct1", "oct2", "oct3", "oct4", "class", "is_private"]
ADDRESS_NAMES = [f"{p}_{part}" for p in ("src_ip", "dst_ip") for part in ADDRESS_PARTS]
TEXT_NAMES = [
    "payload_length", "payload_word_count", "is_chrome", "is_firefox", "is_msie", "is_mobile",
    "firewall_log_length",
]


def cyber_features(df: DataFrame) -> list[str]:
    """Numbers, ports, time, addresses, encoded categories, text: whichever exist, in that order."""
    encoded = [f"{c}_encoded" for c in fixed.CYBER_CATEGORICAL]
    return present(
        df,
        fixed.CYBER_NUMERIC + PORT_NAMES + TIME_NAMES + ADDRESS_NAMES + ["same_subnet"]
        + encoded + TEXT_NAMES,
    )


def cyber_mixed_features(df: DataFrame) -> tuple[list[str], list[int]]:
    """Numbers and derived numbers, then the raw categories, with the positions of the latter."""
    numbers = present(
        df,
        fixed.CYBER_NUMERIC + PORT_NAMES + TIME_NAMES + ADDRESS_NAMES + ["same_subnet"] + TEXT_NAMES,
    )
    categories = present(df, fixed.CYBER_CATEGORICAL)
    return numbers + categories, list(range(len(numbers), len(numbers) + len(categories)))
