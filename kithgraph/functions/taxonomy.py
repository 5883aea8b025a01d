"""The relationship types: tier, cost, whether a tie may be stored and walked, and how it reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tiers of types and costs of tiers (fixed values of the model).
TIERS = {
    "cofounder": 1, "anchor_colleague": 1, "same_firm_partner": 1, "linkedin_1st": 1,
    "board_member": 2, "co_investor": 2, "coauthor": 2, "instagram_mutual": 2, "x_mutual": 2, "podcast_guest": 2,
    "investor_of": 3, "cohost": 3, "colleague": 3, "family_member": 3, "bandmate": 3, "teammate": 3, "co_inventor": 3,
    "shared_portfolio": 4, "co_star": 4,
    "co_speaker": 5, "notable_affiliation": 5, "org_membership": 5,
    "co_mention": 6, "cooccurrence": 99,
}
# How a type reads (fixed values of the model).
LABELS = {
    "cofounder": "co-founded a company together",
    "anchor_colleague": "colleagues at the anchor organisation",
    "same_firm_partner": "partners at the same firm",
    "linkedin_1st": "a direct LinkedIn connection",
    "board_member": "served on the same board",
    "co_investor": "invested in the same round",
    "coauthor": "published together",
    "instagram_mutual": "follow each other on Instagram",
    "x_mutual": "follow each other on X",
    "podcast_guest": "sat down together on the podcast",
    "investor_of": "invested in their company",
    "cohost": "co-host the same show",
    "colleague": "worked at the same organization",
    "family_member": "are family",
    "bandmate": "played in the same band",
    "teammate": "played on the same team",
    "co_inventor": "co-invented a patent",
    "shared_portfolio": "back the same portfolio company",
    "co_star": "appeared in the same film/show",
    "co_speaker": "spoke at the same event",
    "notable_affiliation": "share a documented affiliation",
    "co_mention": "were co-mentioned in a source (not a confirmed relationship)",
    "org_membership": "documented member of the org",
    "cooccurrence": "appeared on the same page",
}
COSTS = {1: 1.0, 2: 2.0, 3: 3.0, 4: 4.5, 5: 7.0, 6: 14.0}
WEAK = ("co_mention",)
NOT_TIES = ("org_membership", "cooccurrence")
ORG_TIES = {"firm": "same_firm_partner", "company": "colleague", "nonprofit": "board_member", "event": "co_speaker"}
UNKNOWN_LABEL = "share a documented connection"
COLUMNS = "rtype string, tier int, label string, structural boolean, weak boolean, cost double"


def rows() -> list[tuple[str, int, str, bool, bool, float]]:
    out = []
    for rtype, tier in TIERS.items():
        strong = rtype not in WEAK and rtype != "cooccurrence"
        out.append((rtype, tier, LABELS[rtype], strong, rtype in WEAK, COSTS.get(tier, float("inf"))))
    return out


def relationship_types(spark: SparkSession) -> DataFrame:
    """The dimension table: one row for each of the fixed types."""
    return spark.createDataFrame(rows(), COLUMNS)


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def tier(rtype: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(TIERS), rtype), F.lit(5))


def label(rtype: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(LABELS), rtype), F.lit(UNKNOWN_LABEL))


def is_weak(rtype: Column) -> Column:
    return rtype.isin(*WEAK)


def is_structural(rtype: Column) -> Column:
    """Unknown types are not: the rule fails closed."""
    return rtype.isin(*[t for t in TIERS if t not in WEAK and t != "cooccurrence"])


def edge_cost(rtype: Column, include_weak: bool = True) -> Column:
    """Infinite for what may not be walked."""
    known = {t: COSTS[k] for t, k in TIERS.items() if k in COSTS and (include_weak or t not in WEAK)}
    return F.coalesce(F.try_element_at(_map(known), rtype), F.lit(float("inf")))


def org_tie(org_type: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(ORG_TIES), org_type), F.lit("colleague"))


def warmth_score(total: Column, hops: Column) -> Column:
    return F.when((hops <= 0) & (total <= 0), 1.0).when(total == float("inf"), 0.0).otherwise(F.round(1 / (1 + total), 3))


def adjusted_cost(rtype: Column, nudge: Column, floor: float = 0.5) -> Column:
    """Stored cost after a bounded nudge: never down to the next warmer tier."""
    below = F.coalesce(F.try_element_at(_map(COSTS), tier(rtype) - 1), F.lit(0.0))
    return F.greatest(edge_cost(rtype) - nudge, below + floor)


def tier_sql(rtype: str) -> str:
    return "case " + rtype + " " + " ".join(f"when '{t}' then {k}" for t, k in TIERS.items()) + " else 5 end"


def cost_sql(rtype: str) -> str:
    return "case " + rtype + " " + " ".join(f"when '{t}' then {COSTS[k]}" for t, k in TIERS.items() if k in COSTS) + " else cast('infinity' as double) end"


def label_sql(rtype: str) -> str:
    return "case " + rtype + " " + " ".join(f"when '{t}' then '{x}'" for t, x in LABELS.items()) + f" else '{UNKNOWN_LABEL}' end"
