"""Evidence for accounts, combined into confidences and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What one piece of evidence of each tier is worth, and the marks verdicts go by.
WEIGHTS = {1: 0.55, 2: 0.45, 3: 0.78, 4: 0.38, 5: 0.0}
ACCEPT, REVIEW = 0.75, 0.35
AUTHORITATIVE_FLOOR, CEILING, TOP_UP = 0.80, 0.99, 0.03


def confidence(counts: dict[int, Column], authoritative: Column) -> Column:
    """1 less the product of what each tier present leaves open, with a top-up for repeated evidence, floored and capped.

    One expression over five counters: tiers multiply in ascending order, so that every engine gets the same double.
    """
    open_ = F.lit(1.0)
    top_up = F.lit(0.0)
    for tier, w in WEIGHTS.items():
        open_ = open_ * F.when(counts[tier] > 0, F.lit(1.0) - F.lit(w)).otherwise(F.lit(1.0))
        if w > 0:
            top_up = top_up + F.when(counts[tier] > 1, F.lit(TOP_UP) * F.least(counts[tier] - 1, F.lit(2))).otherwise(F.lit(0.0))
    c = F.lit(1.0) - open_ + top_up
    c = F.when(authoritative & (c < AUTHORITATIVE_FLOOR), F.lit(AUTHORITATIVE_FLOOR)).otherwise(c)
    return F.round(F.least(c, F.lit(CEILING)), 3)


def verdict(conf: Column, only_name_match: Column) -> Column:
    return F.when(only_name_match, "reject").when(conf >= ACCEPT, "accept").when(conf >= REVIEW, "review").otherwise("reject")


def claim_confidence(evidence: DataFrame, keys: list[str], tier: str = "tier", authoritative: str = "authoritative") -> DataFrame:
    """keys, n_evidence, best_tier, confidence, verdict: one row a claim, from one row a piece of evidence.

    A partial and a final hash aggregation over five counters, whatever the skew of the keys.
    """
    t = F.col(tier)
    g = evidence.groupBy(*keys).agg(*[F.count_if(t == k).alias(f"t{k}") for k in WEIGHTS], F.coalesce(F.bool_or(F.col(authoritative)), F.lit(False)).alias("auth"), F.count(t).alias("n_evidence"), F.min(t).cast("int").alias("best_tier"))
    counts = {k: F.col(f"t{k}") for k in WEIGHTS}
    only5 = (counts[5] > 0) & (counts[1] + counts[2] + counts[3] + counts[4] == 0)
    return g.withColumn("confidence", confidence(counts, F.col("auth"))).withColumn("verdict", verdict(F.col("confidence"), only5)).select(*keys, "n_evidence", "best_tier", "confidence", "verdict")


def coverage(claims: DataFrame, entity: str, platform: str = "platform", targets: int = 8) -> DataFrame:
    """Share of the target platforms with an accepted account, for each entity."""
    got = F.count_distinct(F.when(F.col("verdict") == "accept", F.col(platform)))
    return claims.groupBy(entity).agg(F.round(got / F.lit(float(targets)), 3).alias("coverage"))


def back_links(links: DataFrame, claims: DataFrame, entity: str, mutual: bool = True) -> DataFrame:
    """(entity, src, dst) of claims whose page links to another claim of the same entity; mutual: and back.

    links: entity, src, dst; claims: entity, key. Equi-joins only.
    """
    known = claims.select(entity, F.col("key").alias("dst")).distinct()
    one = links.select(entity, "src", "dst").filter("src <> dst").distinct().join(known, [entity, "dst"], "left_semi")
    return one.join(one.select(entity, F.col("src").alias("dst"), F.col("dst").alias("src")), [entity, "src", "dst"], "left_semi") if mutual else one
