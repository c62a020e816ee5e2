"""Queries: scans, naming, missing values, duplicates, samples, labels and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidewatch import fixed_values as fixed
from tidewatch.functions.numeric import to_number
from tidewatch.functions.text import or_empty, or_unknown, strip_lower
from tidewatch.operators import clean, labels, profile, splits
from tidewatch.operators.encode import fit_codes, levels_of
from tidewatch.plans import derived
from tidewatch.plans.derived import FLOWS_SQL, flows
from tidewatch.plans.registry import query, rounded, table
from tidewatch.session import scratch_path
from tidewatch.sources import columns, readers, writers

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# --- scans and naming -------------------------------------------------------

@query("nsl_kdd_scan", f"""
    WITH d AS ({derived.from_events(derived.NSL_KDD)})
    SELECT part, lower(trim(label)) AS label, service, count(*) AS n,
           cast(sum(src_bytes) AS bigint) AS src_bytes, round(avg(serror_rate), 6) AS mean_rate
    FROM (SELECT 'test' AS part, * FROM d WHERE difficulty < 4 UNION ALL SELECT 'train', * FROM d WHERE difficulty >= 4)
    GROUP BY ALL""")
def nsl_kdd_scan(spark, folder):
    """Headerless train and test files, written from the derived table and read with the fixed schema."""
    train_path, test_path = write_nsl_kdd(spark, folder)
    train, test = readers.read_nsl_kdd(spark, train_path, test_path)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", strip_lower("label").alias("label"), "service").agg(
        F.count(F.lit(1)).alias("n"), F.sum("src_bytes").alias("src_bytes"),
        F.round(F.avg("serror_rate"), 6).alias("mean_rate"),
    )


def write_nsl_kdd(spark, folder) -> tuple[str, str]:
    data = derived.spark_from_events(spark, folder, derived.NSL_KDD)
    base = scratch_path(spark, "nsl")
    options = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    data.where("difficulty >= 4").write.options(**options).csv(f"{base}/train")
    data.where("difficulty < 4").write.options(**options).csv(f"{base}/test")
    return f"{base}/train", f"{base}/test"


CICIDS_TYPES = {"Flow_ID": "string", "Source_IP": "string", "Label": "string"}


def write_cicids(spark, folder) -> str:
    """A folder of header files: some lack one column and name the others in another order."""
    data = derived.spark_from_events(spark, folder, derived.CICIDS)
    base = scratch_path(spark, "cicids")
    whole = data.select(*[F.col(c).alias(derived.CICIDS_HEADER[c]) for c in data.columns])
    writer = {"header": True, "nanValue": "NaN", "ignoreTrailingWhiteSpace": False, "ignoreLeadingWhiteSpace": False}
    even = F.col("`Flow ID`").cast("long") % 2 == 0
    whole.where(even).write.options(**writer).csv(base)
    fewer = whole.where(~even).select(*reversed([c for c in whole.columns if c != " Source IP"]))
    fewer.write.mode("append").options(**writer).csv(base)
    return base


@query("csv_folder_scan", f"""
    SELECT "Label" AS label, count(*) AS n, count(CASE WHEN cast("Flow_ID" AS bigint) % 2 = 0 THEN "Source_IP" END) AS with_source,
           count("Flow_Bytes_s") AS with_bytes, count(*) FILTER (isinf("Flow_Bytes_s")) AS infinite,
           cast(sum("Flow_Duration") AS double) AS duration
    FROM ({derived.from_events(derived.CICIDS)}) GROUP BY ALL""")
def csv_folder_scan(spark, folder):
    """A folder of header files with differing headers, combined by cleaned column name."""
    df = readers.read_csv_folder(spark, write_cicids(spark, folder), types=CICIDS_TYPES, default_type="double")
    return df.groupBy(F.col("Label").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count("Source_IP").alias("with_source"),
        F.count("Flow_Bytes_s").alias("with_bytes"),
        F.count_if(F.abs("Flow_Bytes_s") == float("inf")).alias("infinite"), F.sum("Flow_Duration").alias("duration"),
    )


@query("skipped_files", "SELECT DISTINCT l_returnflag AS flag, 'empty' AS problem FROM lineitem")
def skipped_files(spark, folder):
    """Files of line items beside an empty file for each return flag: the empty ones are named."""
    base = scratch_path(spark, "skipped")
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag")
    items.write.option("header", True).csv(f"{base}/flag=all")
    flags = items.select(F.col("l_returnflag").alias("flag")).distinct()
    flags.withColumn("value", F.lit("")).write.mode("append").partitionBy("flag").text(base)
    found = readers.skipped_files(spark, base, "part-*")
    return found.select(F.regexp_extract("path", "flag=([^/]+)", 1).alias("flag"), "problem")


def write_wsn(spark, folder) -> str:
    data = derived.spark_from_events(spark, folder, derived.WSN).withColumnsRenamed(derived.WSN_HEADER)
    path = scratch_path(spark, "wsn")
    data.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def wsn_schema() -> str:
    names = {"id": "long"} | fixed.WSN_FEATURES | {"Attack_type": "string"}
    return ", ".join(f"`{derived.WSN_HEADER.get(c, c)}` {t}" for c, t in names.items())


@query("wsn_scan", f"""
    SELECT "Attack_type" AS attack_type, count(*) AS n, cast(sum("who_CH") AS bigint) AS who_ch,
           round(avg("Expaned_Energy"), 6) AS energy
    FROM ({derived.from_events(derived.WSN)}) GROUP BY ALL""")
def wsn_scan(spark, folder):
    df = readers.read_wsn(spark, write_wsn(spark, folder), wsn_schema())
    return df.groupBy(F.col("Attack_type").alias("attack_type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("who_CH").alias("who_ch"),
        F.round(F.avg("Expaned_Energy"), 6).alias("energy"),
    )


def write_cyber(spark, folder) -> str:
    data = derived.spark_from_events(spark, folder, derived.CYBER)
    path = scratch_path(spark, "cyber")
    padded = data.withColumnsRenamed({"Attack Type": " Attack Type "})
    padded.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


CYBER_SCHEMA = ", ".join(f"`{c}` {'long' if c == 'Row' else 'string'}" for c in derived.CYBER).replace(
    "`Attack Type`", "` Attack Type `"
)


@query("cyber_scan", f"""
    SELECT "Attack Type" AS attack_type, "Protocol" AS protocol, count(*) AS n, count("Payload Data") AS with_payload,
           cast(sum(length("Payload Data")) AS bigint) AS payload_chars
    FROM ({derived.from_events(derived.CYBER)}) GROUP BY ALL""")
def cyber_scan(spark, folder):
    """Quoted free text with commas and quotes, padded header names."""
    df = readers.read_cyber(spark, write_cyber(spark, folder), CYBER_SCHEMA)
    return df.groupBy(F.col("Attack Type").alias("attack_type"), F.col("Protocol").alias("protocol")).agg(
        F.count(F.lit(1)).alias("n"), F.count("Payload Data").alias("with_payload"),
        F.sum(F.length("Payload Data")).alias("payload_chars"),
    )


@query("processed_roundtrip", "SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top_price FROM orders GROUP BY ALL")
def processed_roundtrip(spark, folder):
    """A processed table through both sinks (header CSV, then Parquet) and back."""
    orders = table(spark, folder, "orders")
    base = scratch_path(spark, "processed")
    writers.save_processed(orders, f"{base}/csv", "csv")
    from_csv = readers.read_csv(spark, f"{base}/csv", orders.schema)
    writers.save_processed(from_csv, f"{base}/parquet")
    return spark.read.parquet(f"{base}/parquet").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top_price")
    )


@query("clean_columns", """
    SELECT o_orderkey AS "Flow_ID", o_totalprice AS "Flow_Bytes_s", o_orderstatus AS "who_CH", o_custkey AS "Label" FROM orders""")
def clean_columns(spark, folder):
    """Padded, blank and slashed names, one of them twice: the first column of a name stays."""
    raw = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias(" Flow ID"), F.col("o_totalprice").alias("Flow Bytes/s"),
        F.col("o_orderstatus").alias("who CH "), F.col("o_custkey").alias(" Label"), F.col("o_orderdate").alias("Label"),
    )
    return columns.clean_names(raw)


@query("feature_matrix", """
    SELECT l_orderkey AS flow, cast(l_quantity AS float) AS "Quantity", cast(l_extendedprice AS float) AS "Price",
           cast(l_discount AS float) AS "Discount", cast(l_linenumber AS int) AS target FROM lineitem""")
def feature_matrix(spark, folder):
    """Numeric columns that are no identifiers, as 32-bit floats, next to an integer target."""
    raw = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("flow"), F.col("l_partkey").alias("Source Port"), F.col("l_quantity").alias("Quantity"),
        F.col("l_extendedprice").alias("Price"), F.col("l_discount").alias("Discount"), F.col("l_returnflag").alias("Flag"),
        F.col("l_linenumber").alias("target"),
    )
    wanted = columns.feature_columns(raw, fixed.CICIDS_NOT_FEATURES + ["flow", "target"])
    return raw.select("flow", *[F.col(c).cast("float").alias(c) for c in wanted], F.col("target").cast("int").alias("target"))


@query("union_by_name", """
    SELECT event_id AS id, event_type AS kind, value, cast(NULL AS varchar) AS segment FROM events
    UNION ALL SELECT c_custkey, cast(NULL AS varchar), c_acctbal, c_mktsegment FROM customer""")
def union_by_name(spark, folder):
    events = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")
    customers = table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("value"), F.col("c_custkey").alias("id"))
    return events.unionByName(customers, allowMissingColumns=True)


@query("distinct_union", """
    SELECT p_brand AS value FROM part UNION SELECT o_orderpriority FROM orders UNION SELECT c_mktsegment FROM customer""")
def distinct_union(spark, folder):
    parts = [("part", "p_brand"), ("orders", "o_orderpriority"), ("customer", "c_mktsegment")]
    frames = [table(spark, folder, t).select(F.col(c).alias("value")) for t, c in parts]
    return reduce(lambda a, b: a.union(b), frames).distinct()


# --- missing values ---------------------------------------------------------

@query("coerce_numbers", f"""
    SELECT "Row" AS flow_id, try_cast("Source Port" AS double) AS source_port, try_cast("Anomaly Scores" AS double) AS anomaly
    FROM ({derived.from_events(derived.CYBER)})""")
def coerce_numbers(spark, folder):
    df = derived.spark_from_events(spark, folder, derived.CYBER)
    return df.select(F.col("Row").alias("flow_id"), to_number("Source Port").alias("source_port"),
                     to_number("Anomaly Scores").alias("anomaly"))


@query("missing_cells", f"""
    WITH f AS ({FLOWS_SQL}), m AS (SELECT * REPLACE (CASE WHEN isinf(anomaly_score) THEN NULL ELSE anomaly_score END AS anomaly_score) FROM f)
    SELECT 'ts' AS column_name, count(*) - count(ts) AS missing FROM m UNION ALL
    SELECT 'src_ip', count(*) - count(src_ip) FROM m UNION ALL SELECT 'protocol', count(*) - count(protocol) FROM m UNION ALL
    SELECT 'anomaly_score', count(*) - count(anomaly_score) FROM m UNION ALL SELECT 'payload', count(*) - count(payload) FROM m UNION ALL
    SELECT 'flow_id', 0 UNION ALL SELECT 'dst_ip', 0 UNION ALL SELECT 'src_port', 0 UNION ALL SELECT 'dst_port', 0 UNION ALL
    SELECT 'device_info', 0 UNION ALL SELECT 'raw_label', 0""")
def missing_cells(spark, folder):
    """Missing cells per column once infinities count as missing."""
    return clean.missing_per_column(clean.mark_missing(flows(spark, folder)))


@query("missing_total", f"""
    WITH f AS ({FLOWS_SQL})
    SELECT 'before' AS stage, cast(sum((ts IS NULL)::int + (src_ip IS NULL)::int + (protocol IS NULL)::int + (payload IS NULL)::int
           + (anomaly_score IS NULL OR isinf(anomaly_score))::int) AS bigint) AS missing_cells FROM f
    UNION ALL SELECT 'after', cast(sum((ts IS NULL)::int) AS bigint) FROM f""")
def missing_total(spark, folder):
    """The whole table before and after repair (timestamps have no default and stay missing)."""
    marked = clean.mark_missing(flows(spark, folder))
    repaired = clean.fill_unknown(clean.impute_median(marked, ["anomaly_score"]))
    before = clean.missing_cells(marked).withColumn("stage", F.lit("before"))
    return before.unionByName(clean.missing_cells(repaired).withColumn("stage", F.lit("after")))


@query("median_impute", f"""
    WITH f AS ({FLOWS_SQL}), m AS (SELECT flow_id, CASE WHEN isinf(anomaly_score) THEN NULL ELSE anomaly_score END AS v FROM f)
    SELECT flow_id, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM m)), 6) AS anomaly_score FROM m""")
def median_impute(spark, folder):
    """Missing and infinite values take the median of the finite ones."""
    repaired = clean.impute_median(flows(spark, folder), ["anomaly_score"])
    return rounded(repaired.select("flow_id", "anomaly_score"), ["anomaly_score"])


@query("median_impute_with_infinite", f"""
    WITH f AS ({FLOWS_SQL}), q AS (SELECT quantile_cont(anomaly_score, 0.5) AS m FROM f)
    SELECT flow_id, round(CASE WHEN anomaly_score IS NULL OR isinf(anomaly_score) THEN m ELSE anomaly_score END, 6) AS anomaly_score
    FROM f, q""")
def median_impute_with_infinite(spark, folder):
    """Infinities take part in the median and are replaced by it afterwards."""
    as_text = flows(spark, folder).withColumn("anomaly_score", F.col("anomaly_score").cast("string"))
    repaired = clean.fit_coercing_imputer(as_text, ["anomaly_score"]).transform(as_text)
    return rounded(repaired.select("flow_id", "anomaly_score"), ["anomaly_score"])


@query("column_medians", "SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in LINE_NUMBERS) + " FROM lineitem")
def column_medians(spark, folder):
    found = clean.medians(table(spark, folder, "lineitem"), LINE_NUMBERS)
    return spark.createDataFrame([tuple(found.values())], [*found])


@query("fill_defaults", f"""
    SELECT flow_id, coalesce(protocol, 'Unknown') AS protocol, coalesce(src_ip, '0.0.0.0') AS src_ip, coalesce(payload, '') AS payload
    FROM ({FLOWS_SQL})""")
def fill_defaults(spark, folder):
    df = flows(spark, folder)
    return df.select("flow_id", or_unknown("protocol").alias("protocol"),
                     F.coalesce("src_ip", F.lit("0.0.0.0")).alias("src_ip"), or_empty("payload").alias("payload"))


@query("zero_sweep", f"""
    SELECT flow_id, CASE WHEN anomaly_score IS NULL OR isinf(anomaly_score) THEN 0 ELSE anomaly_score END AS anomaly_score
    FROM ({FLOWS_SQL})""")
def zero_sweep(spark, folder):
    return clean.fill_zero(flows(spark, folder), ["anomaly_score"]).select("flow_id", "anomaly_score")


# --- duplicates, constants, samples -----------------------------------------

@query("dedup_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem")
def dedup_rows(spark, folder):
    return clean.drop_duplicate_rows(
        table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


@query("duplicate_counts", """
    SELECT count(*) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_quantity, l_tax FROM lineitem)) AS rows_after,
           count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_quantity, l_tax FROM lineitem)) AS rows_removed
    FROM lineitem""")
def duplicate_counts(spark, folder):
    return clean.duplicate_counts(table(spark, folder, "lineitem").select("l_returnflag", "l_quantity", "l_tax"))


@query("constant_columns", """
    SELECT 'l_quantity' AS column_name, count(DISTINCT l_quantity) <= 1 AS is_constant FROM lineitem UNION ALL
    SELECT 'l_tax', count(DISTINCT l_tax) <= 1 FROM lineitem UNION ALL
    SELECT 'zero', count(DISTINCT l_tax * 0) <= 1 FROM lineitem UNION ALL SELECT 'nothing', true""")
def constant_columns(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_quantity", "l_tax", (F.col("l_tax") * 0).alias("zero"), F.lit(None).cast("double").alias("nothing"))
    return clean.constant_flags(df, df.columns)


_HASH = "md5(concat({key}, ':42'))"


@query("hash_sample", f"""
    SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY {_HASH.format(key='o_orderkey')})
        <= (SELECT round_even(0.1 * count(*), 0) FROM orders)""")
def hash_sample(spark, folder):
    """Exactly round(0.1 n) rows, the same ones on every run."""
    return splits.sample(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 0.1)


@query("class_sample", f"""
    SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {_HASH.format(key='event_id')})
        <= round_even(0.25 * count(*) OVER (PARTITION BY event_type), 0)""")
def class_sample(spark, folder):
    return splits.sample(table(spark, folder, "events").select("event_id", "event_type"), "event_id", 0.25, label="event_type")


# --- labels -----------------------------------------------------------------

def _case(column: str, mapping: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {default} END"


_NSL_MAP = fixed.label_to_category(fixed.NSL_KDD_CATEGORIES)
_EVERY_LABEL = sorted(_NSL_MAP) + ["mystery", " Neptune ", "NORMAL"]
_RAW_NSL = f"CASE event_id % {len(_EVERY_LABEL)} " + " ".join(
    f"WHEN {i} THEN '{v}'" for i, v in enumerate(_EVERY_LABEL)) + " END"


@query("general_categories", f"""
    SELECT event_id, {_case("lower(trim(raw))", _NSL_MAP | fixed.GENERAL_OVERRIDES, "'Unknown'")} AS attack_category
    FROM (SELECT event_id, {_RAW_NSL} AS raw FROM events)""")
def general_categories(spark, folder):
    raw = table(spark, folder, "events").select("event_id", F.expr(_RAW_NSL).alias("label"))
    return labels.add_general_category(raw).select("event_id", "attack_category")


@query("label_map_default", f"""
    WITH f AS (SELECT flow_id, trim(raw_label) AS l, lower(trim(raw_label)) AS low FROM ({FLOWS_SQL}))
    SELECT flow_id, CASE low WHEN 'benign' THEN 'Normal' WHEN 'normal' THEN 'Normal' WHEN 'dos' THEN 'DoS' WHEN 'probe' THEN 'Probe'
           ELSE 'Unknown' END AS category, CASE low WHEN 'benign' THEN 0 WHEN 'normal' THEN 0 ELSE 1 END AS target FROM f""")
def label_map_default(spark, folder):
    return add_flow_labels(flows(spark, folder)).select("flow_id", "category", "target")


FLOW_CATEGORIES = {"benign": "Normal", "normal": "Normal", "dos": "DoS", "probe": "Probe"}


def add_flow_labels(df):
    category = labels.lookup(strip_lower("raw_label"), FLOW_CATEGORIES, F.lit("Unknown"))
    return df.withColumn("category", category).withColumn("target", labels.not_normal("category"))


@query("cicids_labels", f"""
    WITH c AS (SELECT "Flow_ID" AS flow_id, trim("Label") AS "Label" FROM ({derived.from_events(derived.CICIDS)}))
    SELECT flow_id, "Label" AS label, {_case('"Label"', fixed.label_to_category(fixed.CICIDS_CATEGORIES), '"Label"')} AS attack_category,
           CASE WHEN "Label" = 'BENIGN' THEN 0 ELSE 1 END AS target FROM c""")
def cicids_labels(spark, folder):
    df = labels.label_cicids(derived.spark_from_events(spark, folder, derived.CICIDS))
    return df.select(F.col("Flow_ID").alias("flow_id"), F.col("Label").alias("label"), "attack_category", "target")


@query("nsl_kdd_labels", f"""
    SELECT label, attack_category, CASE attack_category WHEN 'Normal' THEN 0 ELSE 1 END AS target, count(*) AS n FROM (
        SELECT lower(trim(raw)) AS label, {_case("lower(trim(raw))", _NSL_MAP, "'DoS'")} AS attack_category
        FROM (SELECT {_RAW_NSL} AS raw FROM events)) GROUP BY ALL""")
def nsl_kdd_labels(spark, folder):
    raw = table(spark, folder, "events").select(F.expr(_RAW_NSL).alias("label"))
    return labels.label_nsl_kdd(raw).groupBy("label", "attack_category", "target").agg(F.count(F.lit(1)).alias("n"))


WSN_CATEGORY = _case('trim("Attack_type")', fixed.label_to_category(fixed.WSN_CATEGORIES), "'Normal'")


@query("wsn_labels", f"""
    SELECT id, attack_category, CASE attack_category WHEN 'Normal' THEN 0 ELSE 1 END AS target FROM (
        SELECT id, {WSN_CATEGORY} AS attack_category
        FROM ({derived.from_events(derived.WSN)}))""")
def wsn_labels(spark, folder):
    df = labels.label_wsn(derived.spark_from_events(spark, folder, derived.WSN))
    return df.select("id", "attack_category", "target")


_CYBER_CATEGORY = _case('trim("Attack Type")', fixed.label_to_category(fixed.CYBER_CATEGORIES), "'Intrusion'")


@query("cyber_labels", f"""
    SELECT "Row" AS flow_id, {_CYBER_CATEGORY} AS attack_category, CASE {_CYBER_CATEGORY} WHEN 'Normal' THEN 0 ELSE 1 END AS target
    FROM ({derived.from_events(derived.CYBER)})""")
def cyber_labels(spark, folder):
    df, _ = labels.label_cyber(derived.spark_from_events(spark, folder, derived.CYBER))
    return df.select(F.col("Row").alias("flow_id"), "attack_category", "target")


@query("cyber_labels_without_normal", f"""
    WITH c AS (SELECT "Row" AS flow_id, {_CYBER_CATEGORY} AS attack_category FROM ({derived.from_events(derived.CYBER)})
               WHERE trim("Attack Type") <> 'Benign')
    SELECT flow_id, attack_category, cast(dense_rank() OVER (ORDER BY attack_category) - 1 AS int) AS target FROM c""")
def cyber_labels_without_normal(spark, folder):
    """Without normal rows the categories become the classes."""
    attacks = derived.spark_from_events(spark, folder, derived.CYBER).where("trim(`Attack Type`) <> 'Benign'")
    df, binary = labels.label_cyber(attacks)
    df = df if binary else labels.encode_label(df, "attack_category", "target")
    return df.select(F.col("Row").alias("flow_id"), "attack_category", "target")


@query("unmapped_labels", f"""
    SELECT DISTINCT lower(trim(raw_label)) AS unmapped_label FROM ({FLOWS_SQL})
    WHERE lower(trim(raw_label)) NOT IN ('benign', 'normal', 'dos', 'probe')""")
def unmapped_labels(spark, folder):
    known = spark.createDataFrame([(k,) for k in FLOW_CATEGORIES], "known string")
    return labels.unmapped_labels(flows(spark, folder), "raw_label", known, "known")


@query("label_encode", """
    SELECT p_partkey, p_type, cast(dense_rank() OVER (ORDER BY p_type) - 1 AS int) AS code FROM part""")
def label_encode(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_type")
    return fit_codes(df, ["p_type"], {"p_type": "code"}).transform(df)


@query("label_codes_binary", f"""
    SELECT flow_id, CASE WHEN lower(raw_label) = 'normal' THEN 1 ELSE 0 END AS code,
           CASE WHEN lower(raw_label) = 'normal' THEN 'normal' ELSE 'attack' END AS decoded FROM ({FLOWS_SQL})""")
def label_codes_binary(spark, folder):
    """Alphabetical codes of normal/attack (attack is 0) and back."""
    df = flows(spark, folder).select("flow_id", "raw_label")
    codes = labels.LabelCodes(binary=True).fit(df, "raw_label")
    return codes.decode(codes.encode(df, "raw_label", "code"), "code", "decoded").select("flow_id", "code", "decoded")


@query("label_codes_mapped", """
    WITH m AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'web' WHEN 'view' THEN 'web' WHEN 'error' THEN 'fault' ELSE 'Unknown' END AS k FROM events)
    SELECT event_id, cast(dense_rank() OVER (ORDER BY k) - 1 AS int) AS code, k AS decoded FROM m""")
def label_codes_mapped(spark, folder):
    df = table(spark, folder, "events").select("event_id", "event_type")
    codes = labels.LabelCodes(mapping={"click": "web", "view": "web", "error": "fault"}).fit(df, "event_type")
    return codes.decode(codes.encode(df, "event_type", "code"), "code", "decoded").select("event_id", "code", "decoded")


# --- profiles ---------------------------------------------------------------

@query("full_profile", """
    WITH t AS (SELECT CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp'
                      WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS kind FROM (DESCRIBE SELECT * FROM events))
    SELECT 'samples' AS item, NULL::varchar AS name, count(*) AS n FROM events UNION ALL SELECT 'classes', NULL, count(DISTINCT event_type) FROM events UNION ALL
    SELECT 'features', NULL, count(*) - 2 FROM t UNION ALL SELECT 'type', kind, count(*) FROM t GROUP BY kind UNION ALL
    SELECT 'class', event_type::varchar, count(*) FROM events GROUP BY event_type""")
def full_profile(spark, folder):
    """Size, types and distribution of a table in one answer."""
    return profile.full_profile(table(spark, folder, "events"), "event_type")


@query("column_profile", """
    SELECT count(*) AS n_samples, 4 AS n_features, count(DISTINCT event_type) AS n_classes FROM events""")
def column_profile(spark, folder):
    return profile.dataset_profile(table(spark, folder, "events"), "event_type")


@query("class_distribution", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY ALL")
def class_distribution(spark, folder):
    return profile.class_distribution(table(spark, folder, "events"), "event_type")


@query("top_labels", "SELECT p_type AS label, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, label LIMIT 10")
def top_labels(spark, folder):
    return profile.class_distribution(table(spark, folder, "part"), "p_type", top=10)


@query("distinct_counts", """
    SELECT 'l_orderkey' AS column_name, count(DISTINCT l_orderkey) AS n_distinct FROM lineitem UNION ALL
    SELECT 'l_quantity', count(DISTINCT l_quantity) FROM lineitem UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem""")
def distinct_counts(spark, folder):
    return profile.distinct_counts(table(spark, folder, "lineitem"), ["l_orderkey", "l_quantity", "l_returnflag"])


@query("normal_and_attack_counts", f"""
    SELECT count(*) FILTER (lower(trim(raw_label)) IN ('benign', 'normal')) AS normal,
           count(*) FILTER (lower(trim(raw_label)) NOT IN ('benign', 'normal')) AS attack FROM ({FLOWS_SQL})""")
def normal_and_attack_counts(spark, folder):
    return profile.conditional_counts(add_flow_labels(flows(spark, folder)), normal=F.col("target") == 0, attack=F.col("target") == 1)


@query("class_means", f"""
    SELECT raw_label, round(avg(src_port), 6) AS mean_src_port,
           round(avg(CASE WHEN isinf(anomaly_score) THEN NULL ELSE anomaly_score END), 6) AS mean_anomaly_score
    FROM ({FLOWS_SQL}) GROUP BY ALL""")
def class_means(spark, folder):
    df = profile.class_means(flows(spark, folder), "raw_label", ["src_port", "anomaly_score"])
    return rounded(df, ["mean_src_port", "mean_anomaly_score"])


@query("class_shares", f"""
    WITH c AS (SELECT raw_label, coalesce(protocol, 'Unknown') AS category, count(*) AS n FROM ({FLOWS_SQL}) GROUP BY 1, 2)
    SELECT *, round(n / sum(n) OVER (PARTITION BY raw_label), 6) AS share FROM c""")
def class_shares(spark, folder):
    return rounded(profile.class_shares(flows(spark, folder), "raw_label", or_unknown("protocol")), ["share"])


@query("category_levels", """
    SELECT 'o_orderpriority' AS name, o_orderpriority AS value FROM orders GROUP BY ALL UNION ALL
    SELECT 'o_orderstatus', o_orderstatus FROM orders GROUP BY ALL""")
def category_levels(spark, folder):
    found = levels_of(table(spark, folder, "orders"), ["o_orderpriority", "o_orderstatus"])
    return spark.createDataFrame([(c, v) for c, vs in found.items() for v in vs], "name string, value string")
