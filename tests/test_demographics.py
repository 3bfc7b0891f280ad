import pytest

from equiframe.operators import demographics as demo


def test_names():
    assert demo.demographic_columns(["visits", "patient_gender", "town", "age", "colour"]) == ["patient_gender", "age"]
    names = ["demographics.x", "stage", "Language", "case.id", "demographic.age_at_index"]
    assert demo.demographic_columns(names) == ["demographics.x", "stage", "Language", "demographic.age_at_index"]
    assert demo.demographic_columns(names, exact_token=True) == ["demographics.x", "Language", "demographic.age_at_index"]
    assert demo.existing_columns([("a", 1, 2), "b", "c"], ["a", "c"]) == ["a", "c"]
    assert demo.split_charted(["demographic.x", "y"]) == (["demographic.x"], ["y"])


def test_age_edges(spark):
    ages = [-1, 0, 12, 13, 17, 18, 30, 45, 60, 75, 120, 121, None]
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    got = {r["age"]: r["age_group"] for r in demo.bin_age(df).collect()}
    assert [got[a] for a in ages] == [
        None, "child", "child", "teen", "teen", "young adult", "adult", "mid-age", "senior", "elder", "elder",
        None, None]
    kept = [r["age"] for r in demo.filter_valid_age(df, "age").collect()]
    assert -1 not in kept and 121 not in kept and None in kept and 120 in kept
    assert demo.process_age_columns(df).columns == ["age", "age_group"]
    right = {r["age"]: r["b"] for r in demo.bin_column(df, "age", new_col="b").collect()}
    assert right[0] is None and right[12] == "0-20" and right[60] == "41-60" and right[120] == "100+"


def test_nan_age_has_no_chart_group(spark):
    df = spark.createDataFrame([(float("nan"),), (80.0,), (-3.0,)], "age double")
    rows = df.select(demo.chart_age_group("age").alias("g")).collect()
    assert [r["g"] for r in rows] == ["Unknown", ">75", "Unknown"]


def test_top_groups_breaks_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "aabbccd"], "k string")
    assert sorted(r["k"] for r in demo.top_groups(df, "k", 2).collect()) == list("aabb")


def test_merge_families(spark):
    df = spark.createDataFrame(
        [(1, 1, 0, 1, 5), (2, 0, 0, None, 5), (3, 0, 1, 0, 5), (4, None, None, 1, 5)],
        "id int, `demographic.race_a b` int, `demographic.race_c` int, `demographic.gender_x` int, "
        "`demographic.age_y` int")
    out, mapping, report = demo.merge_onehot(df)
    assert mapping == {"demographic.gender": "demographic.gender_mapped", "demographic.race": "demographic.race_mapped",
                       "demographic.age": "demographic.age_mapped"}
    rows = out.orderBy("id").collect()
    assert [r["demographic.race_mapped"] for r in rows] == ["a b", "unknown", "c", "unknown"]
    assert [r["demographic.gender_mapped"] for r in rows] == ["1", "unknown", "0", "1"]
    assert "demographic.age_y" in out.columns  # one value only, so it stays
    assert "demographic.race_c" not in out.columns
    facts = {r["family"]: r for r in report.collect()}
    assert facts["demographic.race"]["collisions"] == 0 and not facts["demographic.age"]["dropped"]


def test_collisions_first_flag_wins(spark):
    df = spark.createDataFrame([(1, 1), (0, 1)], "race_a int, race_b int")
    out, _, report = demo.merge_onehot(df, ["race"])
    assert sorted(r["race_mapped"] for r in out.collect()) == ["a", "b"]
    assert report.first()["collisions"] == 1
    restored = demo.restore_group(df, "race_", "group")
    assert [r["group"] for r in restored.collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        demo.restore_group(df, "none_", "group")


def test_recommend_and_prefixes(spark):
    df = spark.createDataFrame(
        [(i % 2, 1 - i % 2, ["m", "f", None][i % 3], i, f"v{i}") for i in range(40)],
        "`demographic.race_a` int, `demographic.race_b` int, gender string, age int, family_name string")
    _, fit = demo.recommend_demographic(df)
    assert [r["column"] for r in fit.collect()] == ["gender", "demographic.race_mapped"]
    assert [(r["prefix"], r["members"]) for r in demo.onehot_prefixes(df).collect()] == [("demographic.race", 2)]
    totals = demo.onehot_totals(df, ["demographic.race_a", "demographic.race_b"]).collect()
    assert {r["column"]: r["total"] for r in totals} == {"demographic.race_a": 20, "demographic.race_b": 20}
