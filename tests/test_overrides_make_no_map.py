import contextlib
import io

from lathwork.plans import catalog


def test_the_plan_of_override_issues_makes_no_map_and_looks_nothing_up(spark, sf_dir):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        catalog.QUERIES["override_issues"](spark, sf_dir).explain("extended")
    plan = said.getvalue().split("== Physical Plan ==")[1]
    assert "map(" not in plan and "element_at" not in plan and "l_quantity" in plan


def test_a_map_that_is_stored_is_looked_up_and_a_name_that_it_lacks_is_no_issue(spark):
    from lathwork.operators import scenario

    df = spark.createDataFrame([({"wwrOverride": 2.0, "acSafetyMargin": None, "other": -1.0},), ({},), (None,), ({"lightLossFactor": 0.0, "projectNorthDeg": float("nan")},)], "m map<string, double>")
    assert [r[0] for r in df.select(scenario.override_issues("m")).collect()] == [["wwrOverride"], [], [], ["projectNorthDeg", "lightLossFactor"]]
