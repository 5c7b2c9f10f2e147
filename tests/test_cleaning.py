import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.logs import golden_log
from tracewell.operators import cleaning, columns, evaluation, features, profile, vocabulary
from tracewell.operators.likeness import alike
from tracewell.operators.outliers import handle_outliers
from tracewell.functions.columns import left_pad, letters, similarity


@pytest.fixture
def small(spark):
    return spark.createDataFrame(
        [(1, "a", 10.0), (2, None, 20.0), (3, "b", None), (4, "a", 1000.0), (5, "b", -5.0)], "id int, kind string, x double"
    )


def ids(df):
    return sorted(row["id"] for row in df.collect())


def test_null_rules(small):
    assert ids(cleaning.remove_by_membership(small, "kind", ["a"])) == [2, 3, 5]
    assert ids(cleaning.remove_by_membership(small, "kind", ["a"], "not_in")) == [1, 4]
    assert ids(cleaning.remove_by_condition(small, "x > 15")) == [1, 3, 5]
    assert ids(cleaning.filter_range(small, "x", range_min=0, range_max=100)) == [1, 2, 3]
    assert ids(cleaning.filter_range(small, "kind", ["a"])) == [1, 4]
    hit = cleaning.replace_where(small, ["kind"], [("kind", "!=", "a")], "z")
    assert [r["kind"] for r in hit.orderBy("id").collect()] == ["a", "z", "z", "a", "z"]


def test_modes_are_checked(small):
    for call in (
        lambda: cleaning.remove_by_membership(small, "kind", [], "maybe"),
        lambda: cleaning.handle_nulls(small, "kind", "medium"),
        lambda: cleaning.handle_nulls(small, "x", "guess"),
        lambda: cleaning.filter_range(small, "x", range_min=0, on_outside="guess"),
        lambda: handle_outliers(small, "x", 10, on_outside="guess"),
        lambda: columns.rename_column(small, "missing", "y"),
        lambda: columns.merge_columns(small, ["x"], "y"),
        lambda: columns.convert_column(small, "x", "blob"),
        lambda: columns.convert_column(small, "kind", "str", on_fail="max"),
        lambda: cleaning.remove_duplicates(small, ["kind"]),
        lambda: cleaning.predicate([("x", "~", 1)]),
    ):
        with pytest.raises(ValueError):
            call()


def test_range_fill_modes(small):
    def values(mode, **more):
        done = cleaning.filter_range(small, "x", range_min=0, range_max=100, on_outside=mode, **more)
        return [r["x"] for r in done.orderBy("id").collect()]

    assert values("nan") == [10.0, 20.0, None, None, None]
    assert values("default", default_value=7.0) == [10.0, 20.0, None, 7.0, 7.0]
    assert values("max") == [10.0, 20.0, None, 1000.0, 1000.0]
    assert values("medium") == [10.0, 20.0, None, 256.25, 256.25]
    assert values("show") == [1000.0, -5.0]


def test_outliers_use_the_size_of_a_negative_mean(spark):
    rows = spark.createDataFrame([(i, float(-10 - i % 2)) for i in range(10)] + [(10, -100.0)], "id int, x double")
    assert ids(handle_outliers(rows, "x", 80, on_outside="show")) == [10]
    filled = handle_outliers(rows, "x", 80, on_outside="medium").where("id = 10").collect()[0]["x"]
    assert filled == -11.0


def test_outliers_keep_rows_without_a_group(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, "a", 50.0), (4, None, 9e9)], "id int, g string, x double")
    assert ids(handle_outliers(rows, "x", 100, groupby="g")) == [1, 2, 4]


def test_time_outliers_keep_their_type(spark):
    day = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, day + dt.timedelta(days=i)) for i in range(9)], "id int, t timestamp_ntz")
    filled = handle_outliers(rows, "t", 30, on_outside="min")
    assert dict(filled.dtypes)["t"] == "timestamp_ntz"
    assert [r["t"].day for r in filled.orderBy("id").collect()] == [1, 1, 3, 4, 5, 6, 7, 1, 1]


def test_convert_always_converts(spark):
    rows = spark.createDataFrame([("1",), ("2",)], "x string")
    assert dict(columns.convert_column(rows, "x", "numeric").dtypes)["x"] == "double"
    assert dict(columns.convert_column(rows, "x", "numeric", on_fail="nothing").dtypes)["x"] == "double"
    bad = spark.createDataFrame([("1",), ("?",)], "x string")
    assert dict(columns.convert_column(bad, "x", "numeric", on_fail="nothing").dtypes)["x"] == "string"


def test_constant_columns_count_null_as_a_value(spark):
    rows = spark.createDataFrame([("a", "x", None), ("b", "x", "y")], "k string, same string, gap string")
    assert columns.drop_constant_columns(rows).columns == ["k", "gap"]
    assert columns.drop_constant_columns(rows, null_threshold=0.4).columns == ["k"]
    assert columns.drop_constant_columns(rows, protect=["same"]).columns == ["k", "same", "gap"]


def test_names_may_not_collide(spark):
    with pytest.raises(ValueError, match="collide"):
        columns.normalise_names(spark.createDataFrame([(1, 2)], "`A b` int, `a_B` int"))


def test_letters(spark):
    numbers = {1: "A", 26: "Z", 27: "AA", 52: "AZ", 702: "ZZ", 703: "AAA", 18278: "ZZZ", 18279: "AAAA", 10**10: "AFIPYQJP"}
    rows = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", letters(F.col("n")).alias("s")).collect()

    def spelled(n):
        text = ""
        while n:
            n, rest = divmod(n - 1, 26)
            text = chr(65 + rest) + text
        return text

    assert {r["n"]: r["s"] for r in rows} == {n: spelled(n) for n in numbers}


def test_corrections(spark):
    rows = spark.createDataFrame([("SMAL",), ("small ",), (None,), ("LARGE",)], "size string")
    found = cleaning.suggest_corrections(rows, "size", ["SMALL", "LARGE"], 75)
    assert {(r[0], r[1], r[2]) for r in found.collect()} == {("SMAL", "SMALL", 80.0), ("small ", "SMALL", 100.0)}
    done = cleaning.apply_corrections(rows, "size", {" smal": "small"})
    assert sorted(r["size"] or "" for r in done.collect()) == ["", "LARGE", "SMALL", "SMALL"]


@pytest.mark.parametrize("threshold", [0, 40, 50, 65, 70, 85, 99, 100])
def test_like_texts_equal_the_full_product(spark, threshold):
    rng = random.Random(threshold)
    words = {"".join(rng.choice("abc ") for _ in range(rng.randint(0, 14))) for _ in range(160)} | {"", "a" * 30, "a" * 27 + "bb"}
    words |= {w[: rng.randint(0, len(w))] + rng.choice(["", "x"]) + w[rng.randint(0, len(w)) :] for w in list(words)}
    every = spark.createDataFrame([(w,) for w in sorted(words)], "left string")
    some = every.where("hash(left) % 3 <> 0").withColumnRenamed("left", "right")
    found = {tuple(r) for r in alike(every, some, threshold).distinct().collect()}
    score = similarity(F.col("left"), F.col("right"))
    assert found == {tuple(r) for r in every.crossJoin(some).select("left", "right", score.alias("score")).where(F.col("score") >= threshold).collect()}


def test_corrections_from_many_valid_values(spark):
    valid = spark.range(100_000).selectExpr("concat('Part ', lpad(id, 6, '0'), ' ', chr(65 + id % 26), chr(65 + id % 25)) AS v")
    rows = spark.createDataFrame([("part 012345 VU",), ("Part 0123456VU",), ("nothing like it",), ("Part 099999 DY",)], "name string")
    found = {r[0]: (r[1], round(r[2], 2)) for r in cleaning.suggest_corrections(rows, "name", valid, 90).collect()}
    assert found["part 012345 VU"] == ("Part 012345 VU", 100.0) and found["Part 0123456VU"] == ("Part 012345 VU", 92.86)
    assert "nothing like it" not in found and len(found) <= 3


def test_similarity_of_empty_texts(spark):
    row = spark.range(1).select(similarity(F.lit(""), F.lit("")).alias("a"), similarity(F.lit(""), F.lit("x")).alias("b")).collect()[0]
    assert (row["a"], row["b"]) == (100.0, 0.0)


def test_padding_keeps_the_newest(spark):
    row = spark.range(1).select(
        left_pad(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2, F.lit("-")).alias("long"),
        left_pad(F.array(F.lit("a")), 3, F.lit("-")).alias("short"),
    ).collect()[0]
    assert (row["long"], row["short"]) == (["b", "c"], ["-", "-", "a"])


def test_unseen_category_gets_its_own_code(spark):
    seen = spark.createDataFrame([("a",), ("b",)], "k string")
    fitted = {"k": vocabulary.category_codes(seen, "k")}
    new = spark.createDataFrame([("b",), ("zzz",), (None,)], "k string")
    assert sorted(r["k"] for r in vocabulary.label_encode(new, ["k"], fitted).collect()) == [1, 2, 2]
    assert sorted(r["k"] for r in vocabulary.label_encode(new, ["k"], fitted, unseen="zero").collect()) == [0, 0, 1]


def test_most_common_ties_go_to_the_first_seen(spark):
    rows = spark.createDataFrame([(["b", "a", "a", "b"],)], "s array<string>")
    assert rows.select(features.most_common(F.col("s"))).collect()[0][0] == "b"


def test_class_report_of_an_absent_class(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b")], "label string, prediction string")
    report = {r["class"]: r for r in evaluation.class_report(evaluation.confusion(rows)).collect()}
    assert (report["b"]["precision"], report["b"]["recall"], report["b"]["f1"], report["b"]["support"]) == (0.0, 0.0, 0.0, 0)


def test_vote_ties(spark):
    rows = spark.createDataFrame([("c", "b", "a"), ("c", "c", "a")], "x string, y string, z string")
    votes = rows.select(evaluation.majority_vote([F.col("x"), F.col("y"), F.col("z")]).alias("v")).collect()
    assert [r["v"] for r in votes] == ["a", "c"]


def test_scaling_goes_back(spark):
    rows = spark.createDataFrame([(float(x),) for x in (0, 1, 10, 1000)], "s double")
    figures = features.scaling_figures(rows, "s")
    back = features.unscaled(features.scaled(rows, "s", figures, "z"), "z", figures, "t").collect()
    assert all(abs(r["s"] - r["t"]) < 1e-6 for r in back)


def test_profile_of_the_example_log(spark):
    row = profile.process_metrics(golden_log(spark)).collect()[0]
    assert (row["total_cases"], row["total_events"], row["unique_activities"], row["most_common_activity"]) == (6, 23, 5, "a")
    assert row["max_duration_seconds"] == 3 * 86400


def test_row_order_does_not_matter(spark):
    log = golden_log(spark)
    mixed = log.events.orderBy(F.rand(3)).repartition(5)
    first = cleaning.anonymise(log.events, "activity", ["ts", "case_id"]).groupBy("activity").count().collect()
    second = cleaning.anonymise(mixed, "activity", ["ts", "case_id"]).groupBy("activity").count().collect()
    assert sorted(first) == sorted(second)


def test_profile_report_has_every_section(spark):
    from tracewell.plans.profiling import profile_report

    log = golden_log(spark)
    assert list(profile_report(log, summary_only=True)) == ["summary"]
    report = profile_report(log.with_events(log.events.withColumn("n", F.length("activity"))))
    rows = {name: section.collect() for name, section in report.items()}
    assert rows["summary"][0]["rows"] == 23
    assert rows["datetime:ts"][0]["distinct_values"] == 15
    assert rows["missing_cells"] == []
    assert rows["duplicate_rows"][0]["duplicates"] == 0
    assert {r["column"] for r in rows["cardinality"] if r["is_constant"]} == {"n"}
