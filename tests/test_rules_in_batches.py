"""The rule bank over batches, and texts worked on once for each combination."""

import contextlib
import io
import random

from pyspark.sql import functions as F

from lathwork.operators import faces, rules
from lathwork.plans import building


def by_hand(e, bank, margin=0.08):
    scored = []
    for r in bank:
        if all(k in e for k in r.get("required_all", [])) and (not r.get("required_any") or any(k in e for k in r["required_any"])):
            total = r.get("base", 0.0)
            for k, w in r["signals"].items():
                total += (e.get(k) or 0.0) * w
            scored.append((-min(max(total, 0.0), 1.0), r["category"], r["rule_id"], r["threshold"], [k for k in r["signals"] if k in e]))
    scored = sorted(x for x in scored if x[0] < 0)
    if not scored:
        return "unknown", 0.0, 0.0, None, None
    top = scored[0]
    other = next((x for x in scored if x[1] != top[1]), None)
    gap = -top[0] + (other[0] if other else 0.0)
    sure = round(-top[0], 9) >= top[3] and (other is None or round(gap, 9) >= margin)
    return (top[1] if sure else "unknown"), -top[0], gap, (top[2] if sure else None), top[4]


def test_batches_score_as_by_hand(spark):
    r = random.Random(5)
    keys = sorted({k for x in faces.RULE_BANK for k in x["signals"]})
    rows = [(i, {k: r.choice([1.0, 0.65, 0.8, None]) for k in r.sample(keys, r.randint(0, 14))}) for i in range(300)] + [(300, None), (301, {}), (302, {"no key of any rule": 1.0})]
    df = spark.createDataFrame(rows, "id int, evidence map<string,double>")
    got = {x.id: x for x in rules.classify(df, "id", faces.RULE_BANK).collect()}
    for i, e in rows:
        x = got[i]
        assert (x.category, x.score, x.margin, x.rule_id, x.trace) == by_hand(e or {}, faces.RULE_BANK)
    # the same with some keys in an array beside the map
    apart = keys[::2]
    moved = df.select("id", F.map_filter("evidence", lambda k, v: ~k.isin(*apart) | v.isNull()).alias("evidence"), F.array(*(F.element_at("evidence", F.lit(k)) for k in apart)).alias("s"))
    assert {x.id: x for x in rules.classify(moved, "id", faces.RULE_BANK, strengths=("s", apart)).collect()} == got


def test_no_pattern_is_left_in_the_plan_of_classified_faces(spark, sf_dir):
    f = building.model_faces(spark, sf_dir).drop("part", "legacy_part").withColumn("legacy_part", F.lit("walls"))
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        faces.classified(f, building.floor_levels(f)).explain("extended")
    assert "RLIKE" not in said.getvalue().split("== Optimized Logical Plan ==")[1].upper()
