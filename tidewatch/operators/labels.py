"""Raw labels to categories, binary targets and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed_values as fixed
from tidewatch.functions.numeric import as_column
from tidewatch.functions.text import strip, strip_lower
from tidewatch.operators.encode import fit_codes, levels_of


def lookup(c: Column, mapping: dict[str, str], default: Column) -> Column:
    """A small fixed map as a literal, so the lookup stays inside the scan stage."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), default)


def not_normal(category: Column | str, normal: str = "Normal") -> Column:
    """0 for the normal category, 1 for every other one."""
    return F.when(as_column(category) == normal, F.lit(0)).otherwise(F.lit(1))


def general_category(label: Column | str) -> Column:
    mapping = fixed.label_to_category(fixed.NSL_KDD_CATEGORIES) | fixed.GENERAL_OVERRIDES
    return lookup(strip_lower(label), mapping, F.lit("Unknown"))


def add_general_category(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn("attack_category", general_category(label))


def label_cicids(df: DataFrame, label: str | None = None, binary: bool = True) -> DataFrame:
    """An unmapped label keeps its own name as category and counts as an attack.

    The result goes to ``target``: Spark ignores case, so ``label`` would
    overwrite the raw ``Label``.
    """
    if label is None:
        label = next(n for n in fixed.CICIDS_LABEL_NAMES if n in df.columns)
    df = df.withColumn(label, strip(label))
    mapping = fixed.label_to_category(fixed.CICIDS_CATEGORIES)
    df = df.withColumn("attack_category", lookup(F.col(label), mapping, F.col(label)))
    return df.withColumn("target", not_normal("attack_category", "Benign") if binary else F.col("attack_category"))


def label_nsl_kdd(df: DataFrame, label: str = "label") -> DataFrame:
    category = lookup(strip_lower(label), fixed.label_to_category(fixed.NSL_KDD_CATEGORIES), F.lit("DoS"))
    return df.withColumn(label, strip_lower(label)).withColumn("attack_category", category).withColumn(
        "target", not_normal("attack_category")
    )


def label_wsn(df: DataFrame, label: str = "Attack_type") -> DataFrame:
    category = lookup(strip(label), fixed.label_to_category(fixed.WSN_CATEGORIES), F.lit("Normal"))
    return df.withColumn("attack_category", category).withColumn("target", not_normal("attack_category"))


def label_cyber(df: DataFrame, label: str = "Attack Type", binary: bool = True) -> tuple[DataFrame, bool]:
    """Returns the labelled table and whether it got a binary ``target``.

    Without a single normal row a binary target would be constant, so the
    categories have to serve as classes instead; finding out takes one count.
    """
    category = lookup(strip(label), fixed.label_to_category(fixed.CYBER_CATEGORIES), F.lit("Intrusion"))
    df = df.withColumn("attack_category", category)
    if binary and df.agg(F.count_if(F.col("attack_category") == "Normal")).first()[0] > 0:
        return df.withColumn("target", not_normal("attack_category")), True
    return df, False


def encode_label(df: DataFrame, column: str, output: str) -> DataFrame:
    return fit_codes(df, [column], {column: output}).transform(df)


def unmapped_labels(df: DataFrame, label: str, known: DataFrame, known_label: str) -> DataFrame:
    """Distinct labels the dimension table does not have; labels are reduced before the join."""
    seen = df.select(strip_lower(label).alias("unmapped_label")).where("unmapped_label IS NOT NULL").distinct()
    return seen.join(known, seen.unmapped_label == known[known_label], "left_anti")


def normal_or_attack(label: Column | str) -> Column:
    return F.when(F.lower(as_column(label)) == "normal", F.lit("normal")).otherwise(F.lit("attack"))


class LabelCodes:
    """Optional mapping, optional normal/attack reduction, then alphabetical codes."""

    def __init__(self, binary: bool = False, mapping: dict[str, str] | None = None):
        self.binary = binary
        self.mapping = mapping
        self.classes: list[str] = []

    def _text(self, label: str) -> Column:
        text = F.col(label).cast("string")
        if self.mapping:
            text = lookup(text, self.mapping, F.lit("Unknown"))
        text = F.coalesce(text, F.lit("Unknown"))
        return normal_or_attack(text) if self.binary else text

    def fit(self, df: DataFrame, label: str) -> "LabelCodes":
        self.classes = levels_of(df.select(self._text(label).alias("label")), ["label"])["label"]
        return self

    def encode(self, df: DataFrame, label: str, output: str) -> DataFrame:
        position = F.array_position(F.array(*[F.lit(c) for c in self.classes]), self._text(label))
        return df.withColumn(output, F.nullif(position.cast("int"), F.lit(0)) - 1)

    def decode(self, df: DataFrame, code: str, output: str) -> DataFrame:
        names = F.array(*[F.lit(c) for c in self.classes])
        return df.withColumn(output, F.get(names, F.col(code).cast("int")))
