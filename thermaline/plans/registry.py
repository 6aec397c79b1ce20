"""All registered queries over the driver tables."""

from __future__ import annotations

from thermaline.operators import runner
from thermaline.operators.rules import RULES
from thermaline.plans.base import QUERIES, Query, history, query, rounded, weather


def rule_key(rule_id: str) -> str:
    return "rule_" + rule_id.lower().replace("-", "_")


def _rule_query(rule_id: str) -> Query:
    return lambda spark, d: rounded(runner.run_rule(
        history(spark, d), rule_id, weather=weather(spark, d) if RULES[rule_id].weather else None))


for _id in RULES:
    query(rule_key(_id))(_rule_query(_id))


@query("rules_all")
def rules_all(spark, d):
    return rounded(runner.run_rules(history(spark, d), weather=weather(spark, d))
                   .select("building_id", "equipment_id", "rule_id", "status", "fault_hours"))


from thermaline.plans import queries_analytics, queries_core  # noqa: E402,F401

__all__ = ["QUERIES"]
