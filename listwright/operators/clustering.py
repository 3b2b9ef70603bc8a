"""Arrival-order leader clustering and survivor selection.

A key joins the earliest leader it is alike to, or becomes a leader. This is the
lexicographically first maximal independent set, decided in rounds (Blelloch, Fineman, Shun,
SPAA 2012). A round compares the members of a token block only with the block's first undecided
keys ("pivots"), never all with all, so a block of near copies collapses onto its first key. A
key may be judged once it is a pivot in all its blocks, i.e. once it met every earlier candidate.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, functions as F

from listwright.functions.text import completeness
from listwright.operators.scratch import scratch_root, stage
from listwright.operators.similarity import (
    Rule, alike, block_heads, gram_ranks, postings, spread_out, with_tokens,
)

PIVOTS = 64
PIVOT_GROWTH = 4
STEPS_PER_TABLE = 4
MAX_POINTS = 10  # completeness runs from 0 to 10

_OPEN, _LEADER, _DUPLICATE = 0, 1, 2


def distinct_keys(rows: DataFrame) -> DataFrame:
    """One row per fuzzy key with its first arrival, which also serves as the key's id."""
    return rows.groupBy(F.col("fuzzy_key").alias("key")).agg(F.min("ord").alias("id"))


def leader_edges(keys: DataFrame, ratio: int = 85, pivots: int | None = None) -> DataFrame:
    """(l_id, r_id) for every key (key, id) and each earlier leader it is alike to.

    Keys without an edge are the leaders. `pivots` (PIVOTS where None) are met in the first round.
    """
    pivots = pivots or PIVOTS
    rule = Rule((("key", ratio),))
    root = scratch_root(keys.sparkSession)
    keys = stage(keys, f"{root}/keys")
    nodes = stage(with_tokens(spread_out(keys), rule, gram_ranks(keys, rule)), f"{root}/nodes")
    states = nodes.select("id", F.lit(_OPEN).alias("state"))
    edge_parts = []
    for number in count():
        states, edges, still_open = _round(nodes, states, rule, pivots, f"{root}/round-{number}")
        edge_parts.append(edges)
        if not still_open:
            return reduce(DataFrame.unionByName, edge_parts)
        pivots *= PIVOT_GROWTH


def _round(nodes, states, rule, pivots, path):
    tagged = nodes.join(states, "id")
    followers = postings(tagged.where(F.col("state") != _LEADER), "id", rule, "l")
    open_keys = tagged.where(F.col("state") == _OPEN)
    heads = stage(block_heads(postings(open_keys, "id", rule, "r"), pivots), f"{path}/heads")
    met = alike(followers, heads, rule, F.col("r_id") < F.col("l_id"))
    pairs = stage(met.distinct(), f"{path}/pairs")
    judged = (
        heads.groupBy(F.col("r_id").alias("id"))
        .agg(F.count("*").alias("met"), F.max("r_needed").alias("needed"))
        .where(F.col("met") == F.col("needed")).select("id", F.lit(True).alias("judged"))
    )
    decided = states.join(judged, "id", "left").select(
        "id", "state", F.coalesce("judged", F.lit(False)).alias("judged"))
    table, moving = 0, True
    while moving:
        for _ in range(STEPS_PER_TABLE):
            decided = _decide(decided, pairs)
        decided, table = stage(decided, f"{path}/state-{table}"), table + 1
        left, moving = decided.agg(
            F.count_if(F.col("state") == _OPEN), F.bool_or("moved")).first()
        moving = moving and left > 0
    old = states.where(F.col("state") == _LEADER).select("id")
    fresh = decided.where(F.col("state") == _LEADER).join(old, "id", "left_anti")
    edges = pairs.join(fresh.select(F.col("id").alias("r_id")), "r_id", "left_semi")
    return decided.select("id", "state"), edges.select("l_id", "r_id"), left > 0


def _decide(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """One step: next to a leader -> duplicate; judged and no open or leading neighbour -> leader."""
    seen = (
        pairs.join(states.select(F.col("id").alias("r_id"), "state"), "r_id")
        .groupBy(F.col("l_id").alias("id"))
        .agg(F.bool_or(F.col("state") == _LEADER).alias("led"),
             F.bool_or(F.col("state") == _OPEN).alias("waiting"))
    )
    led, waiting = F.coalesce("led", F.lit(False)), F.coalesce("waiting", F.lit(False))
    state = (
        F.when(F.col("state") != _OPEN, F.col("state"))
        .when(led, _DUPLICATE)
        .when(F.col("judged") & ~waiting, _LEADER)
        .otherwise(_OPEN)
    )
    return states.join(seen, "id", "left").select(
        "id", state.alias("state"), "judged", (state != F.col("state")).alias("moved"))


def fuzzy_pairs(rows: DataFrame, ratio: int = 85) -> DataFrame:
    """(ord, leader_ord): every distinct key with each earlier leader it is alike to."""
    return leader_edges(distinct_keys(rows), ratio).select(
        F.col("l_id").alias("ord"), F.col("r_id").alias("leader_ord"))


def with_leaders(keys: DataFrame, ratio: int) -> DataFrame:
    """Add `leader_ord`, the id of the earliest leader, to the keys (key, id, ...)."""
    first = leader_edges(keys.select("key", "id"), ratio).groupBy(
        F.col("l_id").alias("id")).agg(F.min("r_id").alias("leader_ord"))
    return keys.join(first, "id", "left").withColumn(
        "leader_ord", F.coalesce("leader_ord", "id"))


def fuzzy_clusters(rows: DataFrame, ratio: int = 85) -> DataFrame:
    """(key, ord, leader_ord): each distinct key with the earliest leader it is alike to."""
    keys = stage(distinct_keys(rows), f"{scratch_root(rows.sparkSession)}/first-arrivals")
    return with_leaders(keys, ratio).select("key", F.col("id").alias("ord"), "leader_ord")


def dedup_batch(rows: DataFrame, ratio: int = 85, survivor: str = "arrival") -> DataFrame:
    """One surviving row per cluster, with `leader_ord` as the output order.

    survivor='arrival': a slot starts with its leader and is replaced by more complete members
    until a member with another key takes it; then it stays. In closed form: the first member
    with a foreign key that beats every earlier leader-key member, else the first of the most
    complete leader-key members. survivor='best': the most complete member, first on ties.

    Completeness has eleven values, so the choice needs only the first arrival per value, key
    and cluster: plain minima that are combined before the shuffle, no window over a cluster.
    """
    points = range(MAX_POINTS + 1)
    scored = rows.select("fuzzy_key", "ord", completeness().alias("points"))
    profile = scored.groupBy(F.col("fuzzy_key").alias("key")).agg(
        F.min("ord").alias("id"),
        *[F.min(F.when(F.col("points") == p, F.col("ord"))).alias(f"p{p}") for p in points])
    profile = stage(profile, f"{scratch_root(rows.sparkSession)}/profile")
    clusters = with_leaders(profile, ratio)
    own = F.col("id") == F.col("leader_ord")
    slots = clusters.groupBy("leader_ord").agg(
        *[F.min(F.when(own, F.col(f"p{p}"))).alias(f"own{p}") for p in points],
        *[F.min(F.when(~own, F.col(f"p{p}"))).alias(f"other{p}") for p in points])

    def best(prefixes):
        picks = [F.least(*[F.col(f"{x}{p}") for x in prefixes]) if len(prefixes) > 1
                 else F.col(f"{prefixes[0]}{p}") for p in reversed(points)]
        return F.coalesce(*picks)

    if survivor == "best":
        kept = best(["own", "other"])
    else:
        never = F.lit(2**63 - 1)
        challengers = []
        for p in points:
            guard = F.coalesce(F.least(*[F.col(f"own{q}") for q in range(p, MAX_POINTS + 1)], never),
                               never)
            challengers.append(F.when(F.col(f"other{p}") < guard, F.col(f"other{p}")))
        kept = F.coalesce(F.least(*challengers), best(["own"]))
    chosen = slots.select(kept.alias("ord"), "leader_ord")
    return rows.join(chosen, "ord")
