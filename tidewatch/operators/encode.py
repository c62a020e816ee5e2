"""Category codes, one-hot columns and scaling, fitted on one table and applied to any."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.numeric import finite_sql, quoted, sql_double, sql_string
from tidewatch.functions.text import or_unknown, strip
from tidewatch.operators.fitted import FittedColumns
from tidewatch.operators.prefix import numbered
from tidewatch.session import cut_lineage


def _distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value): the distinct values of all columns, from one pass."""
    return (
        df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("name"), F.col(quoted(c)).cast("string").alias("value")) for c in columns
        ])).alias("p"))
        .select("p.*").where("value IS NOT NULL").distinct()
    )


def levels_of(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted distinct values per column, for class names and one-hot columns: the driver holds them all."""
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in _distinct(df, columns).toLocalIterator():
        found[r.name].append(r.value)
    return {c: sorted(v) for c, v in found.items()}


class JoinedCodes:
    """Codes of any number of values, looked up by a join with the dictionary (name, value, code)."""

    def __init__(self, dictionary: DataFrame, outputs: dict[str, str], unknown: int | None):
        self.dictionary, self.outputs, self.unknown = dictionary, outputs, unknown
        self.expressions = {output: None for output in outputs.values()}

    def transform(self, df: DataFrame) -> DataFrame:
        for c, output in self.outputs.items():
            known = self.dictionary.where(F.col("name") == c).select(F.col("value").alias("__value"), F.col("code").cast("int").alias("__code"))
            code = F.col("__code") if self.unknown is None else F.coalesce("__code", F.lit(self.unknown))
            df = df.join(known, F.col(quoted(c)).cast("string") == F.col("__value"), "left").withColumn(output, code).drop("__value", "__code")
        return df

    def save(self, path: str) -> None:
        self.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
        notes = [(c, output, self.unknown) for c, output in self.outputs.items()]
        self.dictionary.sparkSession.createDataFrame(notes, "name string, output string, unknown int").write.mode("overwrite").parquet(f"{path}/outputs")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "JoinedCodes":
        notes = spark.read.parquet(f"{path}/outputs").collect()
        return cls(spark.read.parquet(f"{path}/dictionary"), {r["name"]: r.output for r in notes}, notes[0].unknown if notes else None)

    def size(self, column: str) -> int:
        return self.dictionary.where(F.col("name") == column).count()


def fit_codes(
    df: DataFrame, columns: list[str], outputs: dict[str, str] | None = None, unknown: int | None = None
) -> JoinedCodes:
    """Code = rank of the value among the sorted distinct ones; other values get ``unknown``."""
    dictionary = numbered(_distinct(df, columns), ["name"], "value", "code")
    return JoinedCodes(cut_lineage(dictionary), outputs or {c: f"{c}_encoded" for c in columns}, unknown)


def code_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code) for any number of distinct values; join it to the table to encode."""
    values = df.select(F.col(quoted(column)).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    return numbered(values, [], "value", "code").select("value", "code")


def encode_with_dictionary(df: DataFrame, column: str, dictionary: DataFrame, output: str, unknown: int = -1) -> DataFrame:
    known = dictionary.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
    return (
        df.join(known, df[column].cast("string") == F.col("__value"), "left")
        .withColumn(output, F.coalesce("__code", F.lit(unknown)))
        .drop("__value", "__code")
    )


def clean_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing becomes ``Unknown``, the rest is stripped."""
    return df.withColumns({c: strip(or_unknown(quoted(c))) for c in columns})


def fit_onehot(df: DataFrame, columns: list[str], prefix: bool = True) -> FittedColumns:
    """One 0/1 column per value; a value that was not seen gives only zeros. For columns with many values take :func:`fit_sparse_onehot`."""
    levels = levels_of(df, columns)
    return FittedColumns(
        {
            (f"{c}_{v}" if prefix else v): f"CAST(coalesce(CAST({quoted(c)} AS STRING) = {sql_string(v)}, false) AS INT)"
            for c in columns for v in levels[c]
        },
        levels,
    )


class SparseOnehot:
    """One sparse vector for all columns: a column's code by join, moved by the values of the columns before it, is the place of its 1."""

    def __init__(self, codes: JoinedCodes, sizes: dict[str, int], output: str):
        self.codes, self.sizes, self.output = codes, sizes, output

    def transform(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        out = self.codes.transform(df)
        places = [self.codes.outputs[c] for c in self.sizes]
        # A value that was not seen has the place after the last one, which the encoder leaves out.
        out = out.withColumns({p: F.coalesce(p, F.lit(n)).cast("double") for p, n in zip(places, self.sizes.values())})
        vectors = [f"{p}__vector" for p in places]
        known = spark.range(1).select(*[F.lit(float(max(n, 1) - 1)).alias(p) for p, n in zip(places, self.sizes.values())])
        encoder = OneHotEncoder(inputCols=places, outputCols=vectors, handleInvalid="keep", dropLast=True).fit(known)
        out = VectorAssembler(inputCols=vectors, outputCol=self.output).transform(encoder.transform(out))
        return out.drop(*places, *vectors)

    @property
    def width(self) -> int:
        return sum(max(n, 1) for n in self.sizes.values())


def fit_sparse_onehot(df: DataFrame, columns: list[str], output: str = "onehot") -> SparseOnehot:
    """Columns with any number of values as one sparse vector column; missing values and those not seen have no 1."""
    codes = fit_codes(df, columns, {c: f"__place_{i}" for i, c in enumerate(columns)})
    counted = {r["name"]: r["count"] for r in codes.dictionary.groupBy("name").count().collect()}
    return SparseOnehot(codes, {c: counted.get(c, 0) for c in columns}, output)


STATISTICS = {"n": "count", "mean": "avg", "std": "stddev_pop", "min": "min", "max": "max"}


def column_statistics(df: DataFrame, columns: list[str], wanted: tuple[str, ...] = tuple(STATISTICS)) -> dict[str, dict[str, float]]:
    """Count, mean, population deviation, minimum and maximum of every column, from one pass."""
    values = df.selectExpr(*[f"{finite_sql(f'double({quoted(c)})')} AS v{i}" for i, c in enumerate(columns)])
    row = values.selectExpr(*[
        f"{STATISTICS[name]}(v{i}) AS {name}_{i}" for i in range(len(columns)) for name in wanted
    ]).first()
    return {c: {name: row[f"{name}_{i}"] for name in wanted} for i, c in enumerate(columns)}


def fit_scaler(
    df: DataFrame, columns: list[str], method: str | None = "standard", outputs: dict[str, str] | None = None
) -> FittedColumns:
    """``standard``: (x - mean) / population deviation; ``minmax``: (x - min) / range; ``None``: unchanged.

    A constant column is divided by 1, so it becomes 0.
    """
    outputs = outputs or {c: c for c in columns}
    if method is None:
        return FittedColumns({outputs[c]: f"double({quoted(c)})" for c in columns})
    if method not in ("standard", "minmax"):
        raise ValueError(f"unknown scaling method: {method}")
    centre_name, width_name = ("mean", "std") if method == "standard" else ("min", "max")
    stats = column_statistics(df, columns, (centre_name, width_name))
    expressions = {}
    for c in columns:
        centre, width = stats[c][centre_name] or 0.0, stats[c][width_name] or 0.0
        if method == "minmax":
            width -= centre
        expressions[outputs[c]] = (
            f"(double({quoted(c)}) - {sql_double(centre)}) / {sql_double(width or 1.0)}"
        )
    return FittedColumns(expressions, stats)


class TablePreparation:
    """Categories first (one-hot or codes with -1 for unseen), then scaled numbers; no gaps remain."""

    def __init__(self, scaling: str | None = "standard", categories: str = "onehot"):
        self.scaling = scaling
        self.categories = categories
        self.steps: list[FittedColumns] = []
        self.features: list[str] = []

    def fit(self, df: DataFrame, exclude: tuple[str, ...] = ()) -> "TablePreparation":
        from tidewatch.sources.columns import numeric_columns, string_columns

        texts = [c for c in string_columns(df) if c not in exclude]
        numbers = [c for c in numeric_columns(df) if c not in exclude]
        self.texts = texts
        filled = df.na.fill("Unknown", texts) if texts else df
        self.steps, self.features = [], []
        if texts:
            if self.categories == "onehot":
                step = fit_onehot(filled, texts)
            else:
                step = fit_codes(filled, texts, {c: f"{c}_code" for c in texts}, unknown=-1)
            self.steps.append(step)
            self.features += list(step.expressions)
        if numbers:
            scaled = {c: f"{c}_scaled" for c in numbers}
            raw = fit_scaler(df, numbers, self.scaling, scaled)
            swept = {
                out: f"coalesce(CASE WHEN abs({e}) < double('Infinity') THEN {e} END, 0D)"
                for out, e in raw.expressions.items()
            }
            self.steps.append(FittedColumns(swept, raw.statistics))
            self.features += list(swept)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.na.fill("Unknown", self.texts) if self.texts else df
        for step in self.steps:
            out = step.transform(out)
        return out
