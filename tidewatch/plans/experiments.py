"""Whole runs: raw files of one dataset to compared models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import fixed_values as fixed
from tidewatch.models.boosting import CategoryBoosting
from tidewatch.models.saved import Scorer
from tidewatch.models.training import Trained, train_all
from tidewatch.operators import clean, labels, splits
from tidewatch.operators.encode import fit_codes, fit_scaler
from tidewatch.operators.features import LogColumns, fit_log_features
from tidewatch.operators.fitted import FittedColumns
from tidewatch.session import cut_lineage
from tidewatch.sources import columns, readers


@dataclass
class Prepared:
    """Cleaned and labelled rows with a unique ``key``, their feature columns and the target."""

    data: DataFrame
    features: list[str]
    classes: int
    dataset: str


def _keyed(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as a table in the shared folder: the fits that follow read it instead of the raw files."""
    keyed = splits.with_content_key(df, "key") if key is None else df.withColumn("key", F.col(key).cast("string"))
    return cut_lineage(keyed)


def _target(df: DataFrame, binary: bool) -> tuple[DataFrame, int]:
    """The target as codes, and the number of classes."""
    if binary:
        return df, 2
    codes = fit_codes(df, ["attack_category"], {"attack_category": "target"})
    return codes.transform(df), codes.size("attack_category")


def prepare_cicids(spark: SparkSession, folder: str, types: dict[str, str] | None = None, default_type: str | None = None,
                   binary: bool = True, sample_frac: float | None = None) -> Prepared:
    """Clean names, repair numbers, fill text, drop copies and constant columns, label."""
    raw = cut_lineage(clean.mark_missing(
        readers.read_csv_folder(spark, folder, types=types, default_type=default_type, sample_frac=sample_frac)))
    repaired = clean.fill_unknown(clean.impute_median(raw))
    unique = _keyed(clean.drop_duplicate_rows(repaired))
    labelled, classes = _target(labels.label_cicids(unique), binary)
    features = [c for c in columns.cicids_features(labelled) if c != "target"]
    kept = clean.drop_constant_columns(labelled, features)
    return Prepared(kept, [c for c in features if c in kept.columns], classes, "CICIDS2017")


def prepare_nsl_kdd(spark: SparkSession, train_path: str, test_path: str, binary: bool = True) -> Prepared:
    """Two files; categories are coded over both. ``part`` tells which file a row is from."""
    train, test = readers.read_nsl_kdd(spark, train_path, test_path)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    labelled = _keyed(labels.label_nsl_kdd(both))
    coded = fit_codes(labelled, fixed.NSL_KDD_TEXT_COLUMNS, {c: c for c in fixed.NSL_KDD_TEXT_COLUMNS}).transform(labelled)
    coded, classes = _target(coded, binary)
    return Prepared(coded, columns.nsl_features(coded), classes, "NSL-KDD")


def prepare_wsn(spark: SparkSession, path: str, schema=None, binary: bool = True, sample_frac: float | None = None) -> Prepared:
    read = readers.read_wsn(spark, path, schema)
    # The id only names a row while it is unique; otherwise the whole row does.
    unique = read.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty() and read.where("id IS NULL").isEmpty()
    raw = splits.sample(_keyed(read, "id" if unique else None), "key", sample_frac)
    labelled, classes = _target(labels.label_wsn(raw), binary)
    features = columns.wsn_features(labelled)
    return Prepared(clean.impute_median(labelled, features), features, classes, "WSN-DS")


def prepare_cyber(spark: SparkSession, path: str, schema=None, binary: bool = True, sample_frac: float | None = None) -> Prepared:
    """Without normal rows the run falls back to the attack types as classes."""
    raw = splits.sample(_keyed(readers.read_cyber(spark, path, schema)), "key", sample_frac)
    labelled, binary = labels.label_cyber(raw, binary=binary)
    labelled, classes = _target(labelled, binary)
    made = fit_log_features(labelled).transform(labelled)
    return Prepared(made, columns.cyber_features(made), classes, "Cyber-Security")


@dataclass
class Scaled:
    """``key``, ``label``, ``split`` and ``features`` for every row, and the steps that made the vector."""

    rows: DataFrame
    scaler: FittedColumns
    assembler: VectorAssembler
    raw_columns: list[str]

    def part(self, name: str) -> DataFrame:
        return self.rows.where(F.col("split") == name)

    def steps(self) -> PipelineModel:
        """Scaling and assembling of unscaled rows."""
        return PipelineModel([self.scaler.stage(self.raw_columns), self.assembler])

    def scorer(self, model) -> PipelineModel:
        """The steps and one of Spark's classifiers as one saveable model for unscaled rows."""
        return PipelineModel([*self.steps().stages, model])

    def any_scorer(self, model) -> Scorer:
        """The steps and a model of any kind."""
        return Scorer(self.steps(), model)


def split_and_scale(prepared: Prepared, test_size: float = 0.2, val_size: float = 0.1, seed: int = 42) -> Scaled:
    """Exact stratified split, scaling fitted on the training rows, one vector per row."""
    safe = {c: f"f{i}" for i, c in enumerate(prepared.features)}  # names a vector assembler can address
    part = [c for c in ("part",) if c in prepared.data.columns]
    wide = prepared.data.select("key", F.col("target").cast("double").alias("label"), *part,
                                *[F.col(f"`{c}`").alias(safe[c]) for c in prepared.features])
    # Features are computed once; the split, the scaler and every model read the stored table.
    stored = cut_lineage(clean.fill_zero(wide, list(safe.values())))
    if part:  # the test file is given; the rest is divided 90/10
        in_train_file = F.col("part") == "train"
        divided = splits.split(stored, "key", "label", val_size, 0, seed, among=in_train_file)
        name = F.when(~in_train_file, "test").when(F.col("split") == "test", "val").otherwise("train")
        data = divided.withColumn("split", name)
    else:
        data = splits.split(stored, "key", "label", test_size, val_size, seed)
    slim = data.select("key", "label", "split", *safe.values())
    scaler = fit_scaler(slim.where("split = 'train'"), list(safe.values()))
    assembler = VectorAssembler(inputCols=list(safe.values()), outputCol="features")
    rows = assembler.transform(scaler.transform(slim)).select("key", "label", "split", "features")
    return Scaled(rows, scaler, assembler, slim.columns)


def run(prepared: Prepared, models: dict[str, object], average: str = "weighted", save_to: str | None = None) -> tuple[Trained, Scaled]:
    """Fit all models on the training rows and compare them on the test rows; the best one is saved with its steps if a path is given."""
    scaled = split_and_scale(prepared)
    scaled.rows = cut_lineage(scaled.rows)
    trained = train_all(models, scaled.part("train"), scaled.part("test"), prepared.dataset, average)
    if save_to and trained.best():
        scaled.any_scorer(trained.models[trained.best()]).save(prepared.data.sparkSession, save_to)
    return trained, scaled


def boost_raw_categories(prepared: Prepared, rounds: int = 500, depth: int = 8, rate: float = 0.1, seed: int = 42, patience: int | None = None):
    """Boosted trees on numbers and raw categories; the validation rows pick the number of rounds.

    Returns the model and the scored test rows.
    """
    wanted, positions = columns.cyber_mixed_features(prepared.data)
    numbers = [c for i, c in enumerate(wanted) if i not in positions]
    categories = [c for i, c in enumerate(wanted) if i in positions]
    safe = {c: f"n{i}" for i, c in enumerate(numbers)} | {c: f"c{i}" for i, c in enumerate(categories)}
    data = splits.split(prepared.data, "key", "target", 0.2, 0.1, seed)
    slim = data.select(
        "key", F.col("target").cast("double").alias("label"), "split",
        *[F.col(f"`{c}`").cast("double").alias(safe[c]) for c in numbers],
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("Unknown")).alias(safe[c]) for c in categories],
    ).withColumn("held_out", F.col("split") == "val")
    slim = cut_lineage(slim)
    booster = CategoryBoosting(
        prepared.classes, [safe[c] for c in numbers], [safe[c] for c in categories], "key", rounds, depth, rate, "held_out", patience, seed=seed)
    model = booster.fit(slim.where("split <> 'test'"))
    return model, model.transform(slim.where("split = 'test'"))


def run_all(experiments: dict[str, object]) -> tuple[list[Trained], dict[str, str]]:
    """Every experiment (a function returning ``Trained``); one that fails is reported and left out."""
    done, failed = [], {}
    for name, experiment in experiments.items():
        try:
            done.append(experiment())
        except Exception as problem:  # noqa: BLE001 - the other datasets still run
            failed[name] = f"{type(problem).__name__}: {problem}"
    return done, failed


def combined_results(spark: SparkSession, done: list[Trained]) -> DataFrame:
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [t.results(spark) for t in done])


# The derived flows keep their fields under these names.
FLOW_COLUMNS = LogColumns(
    numeric=("src_port", "dst_port", "anomaly_score"), categorical=("protocol",), time="ts", source_ip="src_ip",
    destination_ip="dst_ip", source_port="src_port", destination_port="dst_port", payload="payload", device="device_info",
)
FLOW_FEATURES = (
    ["src_port", "dst_port", "anomaly_score"] + columns.PORT_NAMES + columns.TIME_NAMES + columns.ADDRESS_NAMES
    + ["same_subnet", "protocol_encoded", "payload_length", "payload_word_count", "is_chrome", "is_firefox", "is_msie", "is_mobile"]
)
