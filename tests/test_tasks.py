"""How the work of a query is dealt to tasks, and how often a plan reads the same text."""

import pytest

import __spark_entry__ as entrypoint
from staylens.plans import p08_extraction as P8
from staylens.session import spread
from staylens.sources.adapters import Tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_months_are_the_broadcast_side(spark, sf_dir):
    """The days of hotels are never gathered for a join with twelve months."""
    plan = plan_of(entrypoint.queries()["src13_season_days"](spark, sf_dir))
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_tasks_follow_rows(spark):
    assert spread(spark.range(100), 100, 10).rdd.getNumPartitions() == 10


def test_hotel_pages_are_dealt_by_rows(spark, sf_dir):
    """Days of hotels are few bytes and much work: they are not broadcast, and pages are written and read in tasks by their number."""
    plan = plan_of(P8.hotel_payload(Tables(spark, sf_dir)))
    assert "REPARTITION_BY_NUM" in plan and "ShuffledHashJoin" in plan


@pytest.mark.parametrize("name", ["sc42_markdown_blocks", "sc16_posts_to_events"])
def test_cards_are_dealt_by_rows_and_dates_read_once(spark, sf_dir, name):
    plan = plan_of(entrypoint.queries()[name](spark, sf_dir))
    assert "REPARTITION_BY_NUM" in plan and plan.count("regexp_extract(") < 60
