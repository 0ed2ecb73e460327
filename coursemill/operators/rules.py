"""Role rules, availability trees, flags and patches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles by rank.
RANKS = {"student": 1, "ta": 2, "teacher": 3}


def rank(role: Column) -> Column:
    return F.coalesce(*[F.when(role == r, F.lit(n)) for r, n in RANKS.items()], F.lit(0))


def role_of(n: Column) -> Column:
    return F.coalesce(*[F.when(n == v, F.lit(r)) for r, v in RANKS.items()])


def condition_holds(operator: Column, value: Column, have: Column) -> Column:
    """contains: a member of the ;-separated list; regex: found somewhere. Negated forms need the attribute too, which the caller's join sees to."""
    listed = (have != "") & F.array_contains(F.split(have, ";"), value)
    found = F.rlike(have, value)
    return F.when(operator == "contains", listed).when(operator == "not_contains", ~listed).when(operator == "regex", found).when(operator == "not_regex", ~found).otherwise(F.lit(False))


def fired_rules(rules: DataFrame, conditions: DataFrame, attributes: DataFrame) -> DataFrame:
    """rules(rule_id, target_role, enabled), conditions(rule_id, attribute, operator, value), attributes(user_id, attribute, value) -> (user_id, rule_id, target_role).

    All of a rule's conditions have to hold; a rule without conditions never fires, and one
    whose attribute a user lacks doesn't either.
    """
    live = rules.where("enabled").select("rule_id", "target_role")
    need = conditions.groupBy("rule_id").agg(F.count("*").alias("need"))
    c = conditions.withColumn("_c", F.monotonically_increasing_id()).select("rule_id", "_c", "attribute", "operator", F.col("value").alias("want"))
    hit = attributes.join(c, "attribute").where(condition_holds(F.col("operator"), F.col("want"), F.col("value")))
    met = hit.groupBy("user_id", "rule_id").agg(F.count_distinct("_c").alias("met"))
    return met.join(need, "rule_id").where("met = need").join(live, "rule_id").select("user_id", "rule_id", "target_role")


def roles_by_rules(rules: DataFrame, conditions: DataFrame, attributes: DataFrame) -> DataFrame:
    """(user_id, role): the highest role of the rules that fire for a user."""
    best = fired_rules(rules, conditions, attributes).groupBy("user_id").agg(F.max(rank(F.col("target_role"))).alias("r"))
    return best.select("user_id", role_of(F.col("r")).alias("role"))


def higher_role(members: DataFrame, more: DataFrame) -> DataFrame:
    """(course_id, user_id, role): members of both, each with the higher of its roles."""
    both = members.select("course_id", "user_id", "role").unionByName(more.select("course_id", "user_id", "role"))
    return both.groupBy("course_id", "user_id").agg(role_of(F.max(rank(F.col("role")))).alias("role"))


def _holds(node, now: int) -> bool | None:
    """What a tree of date conditions says now; None if any part of it can't be told."""
    if not isinstance(node, dict) or not isinstance(node.get("c"), list):
        return None
    found = []
    for leaf in node["c"]:
        if isinstance(leaf, dict) and "op" in leaf:
            value = _holds(leaf, now)
        elif isinstance(leaf, dict) and leaf.get("type") == "date" and type(leaf.get("t")) is int and leaf.get("d") in (">=", "<"):
            value = now >= leaf["t"] if leaf["d"] == ">=" else now < leaf["t"]
        else:
            value = None
        if value is None:
            return None
        found.append(value)
    joined = {"&": all, "!&": all, "|": any, "!|": any}.get(node.get("op"))
    if joined is None:
        return None
    return joined(found) != node["op"].startswith("!")


def permissive(tree: Column, now: int) -> Column:
    """Does a JSON availability tree let everyone in at this time? Anything unknown or unreadable says no."""

    @F.pandas_udf("boolean")
    def of(trees: pd.Series) -> pd.Series:
        def one(t: str | None) -> bool:
            try:
                return bool(t is not None and _holds(json.loads(t), now))
            except (ValueError, RecursionError):
                return False

        return trees.map(one).astype(bool)

    return of(tree)


def visible(shown: Column, tree: Column, now: int) -> Column:
    """Shown, and without an availability tree or with one that lets everyone in."""
    none = tree.isNull() | (F.trim(tree) == "") | (F.trim(tree) == "$@NULL@$")
    return F.coalesce(shown == 1, F.lit(False)) & (none | permissive(tree, now))


def domain_allowed(name: Column, domains: Column) -> Column:
    """No list, or an empty one, lets every name in."""
    return F.coalesce(F.size(domains) == 0, F.lit(True)) | F.coalesce(F.exists(domains, lambda d: name.endswith(F.concat(F.lit("@"), F.lower(d)))), F.lit(False))


def resolved_flag(scoped: Column, everywhere: Column, default: bool) -> Column:
    """The setting of the course or user, else the global one, else the default."""
    return F.coalesce(scoped, everywhere, F.lit(default))


def patched(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """base with the fields of patch that aren't null."""
    fields = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    return base.join(p, key, "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns])


def needs_resync(exists: Column, before: Column, latest: Column) -> Column:
    """Not where nothing was synced yet (that is a creation); where a first or a later change shows."""
    return F.coalesce(exists & F.when(before.isNull(), latest.isNotNull()).otherwise(latest > before), F.lit(False))
