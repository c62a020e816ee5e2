"""Scans of the four log formats."""

from __future__ import annotations

from csv import reader as csv_fields
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import fixed_values as fixed
from tidewatch.operators import splits
from tidewatch.session import cut_lineage
from tidewatch.sources.columns import clean_name, clean_names, keep_first_names, rename_variants

#: A scan for headers takes a file below this size as one task's work, whatever the session's settings.
WHOLE_FILE = 1 << 44
#: Lines that such a task reads at once; it ends with the first one that is not blank.
HEADER_LINES = 16


def nsl_kdd_schema() -> T.StructType:
    def kind(name: str) -> T.DataType:
        if name in fixed.NSL_KDD_TEXT_COLUMNS or name == "label":
            return T.StringType()
        if name in fixed.NSL_KDD_LONG_COLUMNS:
            return T.LongType()
        return T.DoubleType() if name.endswith("_rate") else T.IntegerType()

    return T.StructType([T.StructField(c, kind(c)) for c in fixed.NSL_KDD_COLUMNS])


def read_nsl_kdd(spark: SparkSession, train_path: str, test_path: str) -> tuple[DataFrame, DataFrame]:
    """Two headerless files with 43 fixed columns."""
    scan = spark.read.schema(nsl_kdd_schema())
    return scan.csv(train_path), scan.csv(test_path)


def read_csv(spark: SparkSession, path: str, schema=None, encoding: str = "UTF-8") -> DataFrame:
    """One header file; types are inferred (a second pass) unless a schema is given."""
    scan = spark.read.option("header", True).option("encoding", encoding)
    return (scan.schema(schema) if schema else scan.option("inferSchema", True)).csv(path)


def _first_lines(batches):
    """The path of the task's file and its first line that is not blank; reading ends there."""
    path = header = None
    for batch in batches:
        if header is None and batch.num_rows:
            path = batch.column("path")[0].as_py()
            header = next((line for line in batch.column("line").to_pylist() if line.strip()), None)
        if header is not None:
            break
    if path is not None:
        yield pa.RecordBatch.from_pydict({"path": [path], "header": pa.array([header], pa.string())})


def csv_headers(spark: SparkSession, folder: str, pattern: str = "*.csv", encoding: str = "UTF-8") -> list[tuple[str, tuple[str, ...] | None, str]]:
    """(path, header, problem) of every matching file, from one job with a task per file that reads its start only.

    A file of blank lines has no header. A file that cannot be read is an error, as it may be readable the next time.
    """
    scan = spark.newSession()  # settings of its own, so that the caller's stay as they are
    scan.conf.set("spark.sql.files.maxPartitionBytes", WHOLE_FILE)
    scan.conf.set("spark.sql.files.openCostInBytes", WHOLE_FILE)
    scan.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", HEADER_LINES)
    lines = scan.read.option("pathGlobFilter", pattern).option("encoding", encoding).text(folder)
    firsts = lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).mapInArrow(_first_lines, "path string, header string")
    found = sorted((unquote(r.path), r.header) for r in firsts.collect())
    return [(path, tuple(next(csv_fields([line]))), "") if line else (path, None, "empty") for path, line in found]


def skipped_files(spark: SparkSession, folder: str, pattern: str = "*.csv", encoding: str = "UTF-8") -> DataFrame:
    """(path, problem) of the files that ``read_csv_folder`` leaves out; Spark lists no files of zero bytes."""
    found = [(p, problem) for p, header, problem in csv_headers(spark, folder, pattern, encoding) if header is None]
    return spark.createDataFrame(found, "path string, problem string")


def read_csv_folder(
    spark: SparkSession,
    folder: str,
    pattern: str = "*.csv",
    types: dict[str, str] | None = None,
    default_type: str | None = None,
    sample_frac: float | None = None,
    seed: int = 42,
    encoding: str = "UTF-8",
) -> DataFrame:
    """Every matching file, combined by cleaned column name; a column a file lacks is null there.

    Files are grouped by header so that each group is one scan. With ``types`` or
    ``default_type`` nothing is inferred and the data is read once. Files without a
    header are left out and named by ``skipped_files``; a file that cannot be read is
    an error; rows that do not fit give nulls. ``sample_frac`` keeps exactly that share of each file.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, header, _ in csv_headers(spark, folder, pattern, encoding):
        if header is not None:
            groups.setdefault(header, []).append(path)
    if not groups:
        raise FileNotFoundError(f"no readable {pattern} below {folder}")

    parts = []
    for header, files in groups.items():
        names = [clean_name(h) for h in header]
        scan = spark.read.option("header", True).option("encoding", encoding)
        if types or default_type:
            kinds = [(types or {}).get(n, default_type or "string") for n in names]
            scan = scan.schema(", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
        else:
            scan = scan.option("inferSchema", True)
        part = keep_first_names(scan.csv(files), names)
        if sample_frac and 0 < sample_frac < 1:
            keyed = splits.with_content_key(part.withColumn("__file", F.input_file_name()), "__key")
            part = splits.sample(cut_lineage(keyed), "__key", sample_frac, seed, "__file").drop("__file", "__key")
        parts.append(part)

    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part, allowMissingColumns=True)
    return combined


def read_wsn(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Sensor readings: blanks in names become underscores, known variants are renamed."""
    return rename_variants(clean_names(read_csv(spark, path, schema), slashes=False))


def read_cyber(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Attack log with free text, so a quoted field may span lines."""
    scan = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = (scan.schema(schema) if schema else scan.option("inferSchema", True)).csv(path)
    return clean_names(df, spaces=False, slashes=False)
