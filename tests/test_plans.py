"""Steps that must read their input once, by their plans."""

from __future__ import annotations

from scorebook.operators import relations, validate
from scorebook.plans import validate_queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_bodies_are_walked_once(spark):
    bodies = spark.range(3).selectExpr("id", "'card' as body_kind", "cast(null as string) as run_id", "'{}' as body")
    assert plan(validate.errors(bodies)).count("MapInArrow") == 1


def test_bodies_are_judged_in_their_rows(spark):
    """A shuffle of a body's values cost more than the walk."""
    bodies = spark.range(3).selectExpr("id", "'card' as body_kind", "cast(null as string) as run_id", "'{}' as body")
    assert "Exchange" not in plan(validate.errors(bodies)) and "Window" not in plan(validate.errors(bodies))


def test_bodies_are_made_once_for_their_badges(spark):
    """An order's lines are gathered once, and not by supplier first, as a distinct count beside the lists would."""
    made = plan(validate_queries.der_badges(spark, "/root/testdata/sf0.001"))
    assert made.count("partial_collect_list(") == 1 and "merge_collect_list(" not in made


def test_withheld_bodies_are_read_once(spark):
    bodies = spark.range(3).selectExpr("id as version_id", "'{}' as body")
    hidden = spark.createDataFrame([], "from_version_id long, relation string, ns string, name string, seq long, version_id long, content_hash string")
    evals = spark.createDataFrame([], "version_id long, eval_record_id long, judgements long, ns string, name string")
    assert plan(relations.withhold(bodies, hidden, evals)).count("Range (0, 3") == 1
