from equiframe.operators import findings as say
from equiframe.operators.outcome import disparities, output_fairness
from equiframe.operators.prepare import recommend
from equiframe.operators.profile import groupwise_missing
from equiframe.operators.significance import anova, group_moments, ks_pairs
from equiframe.plans.audit import audit_report, write_report


def test_every_kind_of_finding(spark):
    rows = [("a" if i % 2 else "b", float(i % 2) * 5 + i % 7, None if i % 4 == 0 else 1.0 + i, i % 2, (i // 3) % 2)
            for i in range(200)]
    source = rows
    df = spark.createDataFrame(rows, "race string, x double, gap double, y int, p int")
    plan = recommend(df)
    by_group = output_fairness(df, "y", "p", "race")
    importance = spark.createDataFrame([("x", 0.2, 0.0), ("gap", -0.1, 0.0)],
                                       "feature string, importance_mean double, importance_std double")
    said = say.with_summary(say.combine(
        say.encoding_findings(plan), say.scaling_findings(plan), say.missing_findings(plan),
        say.group_missing_findings(groupwise_missing(df, "gap", "race"), "gap"),
        say.significance_findings(anova(df, "x", "race"), group_moments(df, "x", "race")),
        say.distribution_findings(ks_pairs(df, "x", "race")),
        say.outcome_findings(by_group, disparities(by_group)),
        say.importance_findings(importance),
    ), 5)
    rows = said.collect()
    assert {r["section"] for r in rows} == {
        "encoding", "scaling", "missing", "group missing", "test", "distribution", "outcome", "outcome gap",
        "importance", "summary"}
    text = {r["section"]: r["message"] for r in rows}
    assert "25.0%" in text["missing"]
    high, low = (sum(x) / len(x) for x in ([r[1] for r in source if r[0] == g] for g in "ab"))
    assert f"Group a is highest ({high:.2f}), group b lowest ({low:.2f})" in text["test"]
    assert [r["message"] for r in rows if r["section"] == "importance"] == [
        "x drives predictions: shuffling it costs 0.2000 of accuracy."]
    lacking = [r for r in rows if r["section"] == "group missing" and r["severity"] == "warning"]
    assert [r["group"] for r in lacking] == ["b"]
    assert all(r["message"] for r in rows)


def test_report(spark, tmp_path):
    rows = [("a" if i % 2 else "b", i % 3, float(i), f"t{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "race string, level int, x double, note string")
    report = audit_report(df, ["level", "x", "note"])
    found = {r["feature"]: r for r in report["findings"].collect()}
    assert "chi-square" in found["level"]["message"] and "anova" in found["x"]["message"]
    assert "no group test" in found["note"]["message"]
    assert {r["attribute"] for r in report["distributions"].collect()} == {"level", "x", "note"}
    write_report(report, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "recommendations")).count() == 4
