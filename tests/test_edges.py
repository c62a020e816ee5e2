"""Small inline frames: missing and infinite values, odd addresses, unseen categories, single classes."""

import math

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import clock, network, numeric, rowwise, text
from tidewatch.operators import clean, encode, labels, metrics, outliers, splits
from tidewatch.operators.select import fit_selection
from tidewatch.sources import columns

INF, NAN = float("inf"), float("nan")


def values(df, column):
    return [r[column] for r in df.collect()]


def test_missing_and_infinite_values(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None), (NAN, "b"), (INF, "c"), (-INF, "d"), (None, "e"), (4.0, "f")], "x double, s string")
    assert clean.missing_cells(clean.mark_missing(df)).first()[0] == 5
    assert values(clean.impute_median(df, ["x"]), "x") == [1.0, 2.0, 2.0, 2.0, 2.0, 2.0, 4.0]
    assert values(clean.fill_zero(df, ["x"]), "x") == [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 4.0]
    assert values(clean.fill_unknown(df), "s")[1] == "Unknown"


def test_median_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert values(clean.impute_median(df, ["x"]), "x") == [0.0, 0.0]


def test_infinite_values_take_part_in_the_coercing_median(spark):
    df = spark.createDataFrame([("1",), ("3",), ("inf",), ("Infinity",), ("oops",), (None,)], "x string")
    out = values(clean.fit_coercing_imputer(df.withColumn("x", F.col("x")), ["x"]).transform(df), "x")
    # Values 1, 3, inf, inf: the median lies between 3 and inf.
    assert out[:2] == [1.0, 3.0] and all(math.isinf(v) for v in out[2:])


def test_integers_survive_imputation(spark):
    df = spark.createDataFrame([(1,), (None,), (4,)], "n int")
    assert values(clean.impute_median(df), "n") == [1.0, 2.5, 4.0]


def test_addresses(spark):
    ips = ["0.0.0.0", "10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.1.1", "127.0.0.1", "128.0.0.1", "191.0.0.1", "192.0.0.1",
           "223.0.0.1", "224.0.0.1", "255.0.0.1", "300.1.1.1", "1.2", "bad", None]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "i int, ip string")
    made = network.address_features("ip", "p")
    out = df.select("i", *[c.alias(n) for n, c in made.items()]).orderBy("i").collect()
    assert [r.p_class for r in out] == [0, 0, 1, 1, 2, 0, 1, 1, 2, 2, 3, 3, 0, 0, 0, 0]
    assert [r.p_is_private for r in out] == [0, 1, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
    assert [(r.p_oct1, r.p_oct2, r.p_oct3, r.p_oct4) for r in out[13:]] == [(1, 2, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]


def test_ports(spark):
    df = spark.createDataFrame([(p, 0) for p in (0, 1023, 1024, 49152, 49153, 65535)], "s long, d long")
    out = df.select(*[c.alias(n) for n, c in network.port_features("s", "d").items()]).collect()
    assert [r.is_well_known_src for r in out] == [1, 1, 0, 0, 0, 0]
    assert [r.is_high_port_src for r in out] == [0, 0, 0, 0, 1, 1]


def test_times(spark):
    rows = ["2024-01-05 06:00:00", "2024-01-06 07:00:00", "2024-01-08 09:00:00", "2024-01-05 17:59:00", "2024-01-05 18:00:00",
            "2024-01-05 21:00:00", "2024-01-05 22:00:00", "not a time", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").withColumn("ts", clock.parse_time("t"))
    out = df.select("i", *[c.alias(n) for n, c in clock.time_features("ts").items()]).orderBy("i").collect()
    assert [r.hour for r in out] == [6, 7, 9, 17, 18, 21, 22, 0, 0]
    assert [r.day_of_week for r in out] == [4, 5, 0, 4, 4, 4, 4, 0, 0]
    assert [r.is_weekend for r in out] == [0, 1, 0, 0, 0, 0, 0, 0, 0]
    assert [r.is_business_hours for r in out] == [0, 0, 1, 1, 0, 0, 0, 0, 0]
    assert [r.is_night for r in out] == [1, 0, 0, 0, 0, 0, 1, 1, 1]


def test_words_and_stripping(spark):
    rows = ["", "   ", " a b  c ", "a\tb\nc", None, "x y z", "　w\x1f"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    out = df.select("i", text.word_count("s").alias("n"), text.strip("s").alias("t")).orderBy("i").collect()
    expected = [0 if r is None else len(r.split()) for r in rows]
    assert [r.n for r in out] == expected == [0, 0, 3, 3, 0, 3, 1]
    assert [r.t for r in out] == [None if r is None else r.strip() for r in rows]


def test_row_features_skip_pairs_out_of_range(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0)], "a double, b double, c double")
    made = rowwise.interaction_features(["a", "b", "c"], pairs=[(0, 1), (0, 7)])
    assert list(made) == ["x0_times_x1", "x0_over_x1"]
    row = df.select(*[c.alias(n) for n, c in rowwise.row_statistics(["a", "b", "c"]).items()]).first()
    assert row.row_median == 2.0 and row.row_max == 4.0 and abs(row.row_std - 1.247219) < 1e-6
    assert list(rowwise.ratio_features(["a", "b"], [(0, 1), (5, 0)])) == ["ratio_0_1"]
    # A denominator of exactly -epsilon would divide by zero: null instead of an error.
    odd = spark.createDataFrame([(1.0, -1e-8)], "a double, b double")
    assert odd.select(numeric.shifted_ratio("a", "b").alias("r")).first().r is None


def test_unseen_padded_and_missing_categories(spark):
    train = spark.createDataFrame([("a",), (" b ",), (None,)], "c string")
    test = spark.createDataFrame([("a",), ("zzz",), (None,), ("b",)], "c string")
    codes = encode.fit_codes(encode.clean_categories(train, ["c"]), ["c"], {"c": "code"}, unknown=-1)
    assert values(codes.transform(encode.clean_categories(test, ["c"])), "code") == [1, -1, 0, 2]
    onehot = encode.fit_onehot(train.na.drop(), ["c"]).transform(test)
    assert [tuple(r[1:]) for r in onehot.collect()] == [(0, 1), (0, 0), (0, 0), (0, 0)]


def test_quotes_in_categories(spark):
    df = spark.createDataFrame([("it's",), ('say "x"',), ("back\\slash",)], "c string")
    codes = encode.fit_codes(df, ["c"], {"c": "code"})
    assert sorted(values(codes.transform(df), "code")) == [0, 1, 2]


def test_codes_have_no_limit(spark):
    df = spark.range(50_000).select(F.format_string("v%05d", "id").alias("c"), (F.col("id") % 3).cast("string").alias("d"))
    coded = encode.fit_codes(df, ["c", "d"]).transform(df)
    assert coded.where("c_encoded <> cast(substr(c, 2) AS int) OR d_encoded <> cast(d AS int)").count() == 0
    assert coded.select("c_encoded").distinct().count() == coded.count() == 50_000
    dictionary = encode.code_dictionary(df, "c")
    assert dictionary.count() == 50_000
    assert encode.encode_with_dictionary(df, "c", dictionary, "code").agg(F.sum("code")).first()[0] == 50_000 * 49_999 // 2


def test_sparse_one_hot_of_many_values(spark):
    df = spark.range(50_000).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("c"), (F.col("id") % 3).alias("d"))
    found = encode.fit_sparse_onehot(df, ["c", "d"])
    assert found.width == 50_003
    other = spark.createDataFrame([("v00007", 2), ("v49999", 9), ("never", None), (None, 0)], "c string, d long")
    rows = {(r.c, r.d): r.onehot for r in found.transform(other).collect()}
    assert all(v.size == 50_003 for v in rows.values())
    assert {k: v.indices.tolist() for k, v in rows.items()} == {("v00007", 2): [7, 50_002], ("v49999", 9): [49_999], ("never", None): [], (None, 0): [50_000]}
    assert encode.fit_sparse_onehot(df.limit(0), ["c"]).transform(other).count() == 4
    assert len(encode.fit_onehot(df, ["d"]).expressions) == 3
    codes = encode.fit_codes(df, ["d"], unknown=-1)
    from tidewatch.session import scratch_path

    path = scratch_path(spark, "codes")
    codes.save(path)
    again = encode.JoinedCodes.load(spark, path).transform(other)
    assert sorted((r.c or "", r.d_encoded) for r in again.collect()) == [("", 0), ("never", -1), ("v00007", 2), ("v49999", -1)]


def test_variance_ratio_of_constant_and_shifted_columns(spark):
    from tidewatch.operators.select import anova_f

    made = spark.range(30_000).select(
        (F.col("id") % 3).alias("y"), F.lit(0.1).alias("a"), (F.xxhash64("id") % 1000 / 1000).alias("b"), F.lit(None).cast("double").alias("d"))
    made = made.withColumn("c", F.col("b") + 1e9)
    score = {r.feature: r.score for r in anova_f(made, ["a", "b", "c", "d"], "y").collect()}
    assert score["a"] is None and score.get("d") is None and score["b"] > 0 and abs(score["c"] / score["b"] - 1) < 1e-3


def test_content_keys_tell_microseconds_and_gaps_apart(spark):
    rows = [("2020-01-01 00:00:00.000001", None, b"a", "x"), ("2020-01-01 00:00:00.000002", None, b"a", "x"), ("2020-01-01 00:00:00.000002", "", b"a", "x"),
            ("2020-01-01 00:00:00.000002", "-", b"a", "x"), ("2020-01-01 00:00:00.000002", None, b"b", "x"), ("2020-01-01 00:00:00.000002", "x", b"a", None)]
    df = spark.createDataFrame(rows, "t string, s string, b binary, e string")
    for kind in ("timestamp", "timestamp_ntz"):
        keyed = splits.with_content_key(df.withColumn("t", F.col("t").cast(kind)))
        assert keyed.select("row_key").distinct().count() == len(rows)


def test_neighbour_votes_do_not_multiply_rows(spark):
    from pyspark.ml.functions import array_to_vector

    from tidewatch.models.classifiers import NearestNeighbors

    rows = [(str(i % 10), [float(i % 20), float(i % 3)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, x array<double>, label int").select("key", array_to_vector("x").alias("features"), "label")
    scored = NearestNeighbors("key", 3).fit(df).transform(df)
    assert scored.count() == 40 and scored.columns == ["key", "features", "label", "prediction", "probability"]


def test_one_rare_row_is_copied_by_many_tasks(spark):
    from tidewatch.operators.balance import smote

    df = spark.range(20_001).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"), (F.col("id") == 0).cast("int").alias("y"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    made = smote(df, "id", "x", "y").where("copy > 0").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in made) == 19_999 and len(made) >= 4


def test_quantiles_by_halving(spark, monkeypatch):
    from tidewatch.operators import quantiles

    monkeypatch.setattr(quantiles, "FINEST_ACCURACY", 0)
    values = [float(v) for v in [-1e300, -5, -5, -5, 0, 1e-300, 1, 2, 3, 1e300] * 7]
    got = quantiles.exact_quantiles(spark.createDataFrame([(v,) for v in values], "a double"), ["a"], [0.0, 0.3, 0.5, 0.9, 1.0], counted_values=0)
    import numpy as np

    assert got["a"] == [float(v) for v in np.quantile(values, [0.0, 0.3, 0.5, 0.9, 1.0])]



def test_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, None, 1.0), (1.0, None, None, 2.0)], "a double, b double, c double, d double")
    flags = {r.column_name: r.is_constant for r in clean.constant_flags(df, df.columns).collect()}
    assert flags == {"a": True, "b": True, "c": True, "d": False}
    assert clean.drop_constant_columns(df, df.columns).columns == ["d"]


def test_scaling_a_constant_column(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 3.0)], "a double, b double")
    assert values(encode.fit_scaler(df, ["a", "b"], "standard").transform(df), "b") == [-1.0, 1.0]
    assert values(encode.fit_scaler(df, ["a", "b"], "minmax").transform(df), "a") == [0.0, 0.0]
    with pytest.raises(ValueError):
        encode.fit_scaler(df, ["a"], "robust")


def test_preparation_puts_categories_first(spark):
    df = spark.createDataFrame([("x", 1.0, "k"), ("y", 3.0, "k"), (None, None, "k")], "c string, n double, key string")
    prep = encode.TablePreparation("standard", "label").fit(df, exclude=("key",))
    assert prep.features == ["c_code", "n_scaled"]
    rows = prep.transform(df).select(*prep.features).collect()
    assert [tuple(r) for r in rows] == [(1, -1.0), (2, 1.0), (0, 0.0)]


def test_names_are_cleaned_and_deduplicated(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int").toDF(" Label", "Flow Bytes/s", "who CH", "Label ")
    out = columns.clean_names(df)
    assert out.columns == ["Label", "Flow_Bytes_s", "who_CH"] and out.first() == (1, 2, 3)
    assert columns.clean_names(df, slashes=False).columns[1] == "Flow_Bytes/s"


def test_outlier_methods(spark):
    df = spark.createDataFrame([(float(i),) for i in [*range(9), 1000]], "x double")
    clipped = values(outliers.fit_clipper(df, ["x"], "iqr").transform(df), "x")
    assert max(clipped) == 6.75 + 1.5 * 4.5 and clipped[:9] == [float(i) for i in range(9)]
    assert outliers.fit_clipper(df, ["x"], "isolation_forest").transform(df).collect() == df.collect()
    with pytest.raises(ValueError):
        outliers.fit_clipper(df, ["x"], "other")


def test_label_maps_differ_where_they_should(spark):
    df = spark.createDataFrame([(r,) for r in ["httptunnel", " WORM ", "nonsense", None]], "label string")
    assert values(labels.add_general_category(df), "attack_category") == ["U2R", "R2L", "Unknown", "Unknown"]
    assert values(labels.label_nsl_kdd(df), "attack_category") == ["R2L", "DoS", "DoS", "DoS"]
    web = spark.createDataFrame([("Web Attack – XSS",), ("Web Attack - XSS",), (" BENIGN",), (None,)], "Label string")
    out = labels.label_cicids(web)
    assert values(out, "attack_category") == ["Web Attack", "Web Attack - XSS", "Benign", None]
    assert values(out, "target") == [1, 1, 0, 1]
    wsn = spark.createDataFrame([("Scheduling ",), ("other",)], "Attack_type string")
    assert values(labels.label_wsn(wsn), "attack_category") == ["TDMA", "Normal"]


def predictions(spark, pairs):
    return metrics.confusion(spark.createDataFrame(pairs, "y int, p int"), "y", "p")


def test_scores_at_the_extremes(spark):
    perfect = metrics.summary_scores(predictions(spark, [(0, 0), (1, 1), (2, 2)])).first()
    assert perfect.accuracy == perfect.f1_macro == perfect.cohen_kappa == perfect.mcc == 1.0
    one = metrics.summary_scores(predictions(spark, [(0, 0), (1, 0), (1, 0)])).first()
    assert one.mcc == 0.0 and one.cohen_kappa == 0.0 and abs(one.precision_macro - 1 / 6) < 1e-12
    extra = {r.cls: r for r in metrics.class_scores(predictions(spark, [(0, 0), (0, 3), (1, 0)])).collect()}
    assert extra[3].support == 0 and extra[3].recall == 0.0 and extra[1].precision == 0.0


def test_detection_collapses_attack_classes(spark):
    row = metrics.detection_scores(predictions(spark, [(0, 0), (0, 2), (1, 2), (2, 1), (2, 0)])).first()
    assert (row.true_negatives, row.false_positives, row.true_positives, row.false_negatives) == (1, 1, 2, 1)


def test_confusion_share_of_a_class_that_never_occurs(spark):
    shares = metrics.normalised_confusion(predictions(spark, [(0, 0), (0, 1)])).collect()
    assert {(r.y_true, r.y_pred): r.share for r in shares} == {(0, 0): 0.5, (0, 1): 0.5}


def test_report_names_and_quirks(spark):
    report = {r["class"]: r for r in metrics.class_report(predictions(spark, [(0, 0), (1, 1), (1, 0)]), ["ok", "bad"]).collect()}
    assert set(report) == {"ok", "bad", "accuracy", "macro avg", "weighted avg"}
    assert report["accuracy"].support == report["accuracy"].f1 and report["weighted avg"].support == 3.0


def test_quota_goes_to_largest_remainders():
    assert splits.proportional_quota({"a": 1, "b": 2, "c": 7}, 5) == {"a": 1, "b": 1, "c": 3}
    assert splits.proportional_quota({"a": 1}, 1) == {"a": 1}


def test_split_of_tiny_classes(spark):
    rows = [(i, c) for i, c in enumerate(["a"] * 1 + ["b"] * 2 + ["c"] * 7 + ["d"] * 100)]
    df = spark.createDataFrame(rows, "id long, c string")
    out = splits.split(df, "id", "c")
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"test": 22, "val": 11, "train": 77}
    assert splits.split(df.limit(0), "id", "c").count() == 0
    single = splits.split(df.where("c = 'd'"), "id", "c")
    assert single.where("split = 'test'").count() == 20


def test_unknown_methods_are_named(spark):
    from tidewatch.operators.balance import resample

    df = spark.createDataFrame([(1, [0.0], 0)], "id long, v array<double>, y int")
    with pytest.raises(ValueError, match="unknown resampling method"):
        resample(df, "id", "v", "y", "other")
    with pytest.raises(ValueError, match="unknown selection method"):
        fit_selection(df, ["y"], "y", "other")


def test_cuts_do_not_depend_on_how_prefixes_are_divided(spark, monkeypatch):
    df = spark.range(3000).select("id", F.when(F.col("id") % 9 == 0, "a").otherwise("b").alias("y"))
    def parts():
        return {r.id: r.split for r in splits.split(df, "id", "y").collect()}

    whole = parts()
    monkeypatch.setattr(splits, "PREFIX_DIGITS", 1)
    monkeypatch.setattr(splits, "SORTED_ROWS", 2)
    assert parts() == whole
