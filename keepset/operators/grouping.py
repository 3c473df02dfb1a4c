"""Greedy star groups: in rank order, whoever is unclaimed leads and claims its unclaimed neighbours; no chains.

The leaders are the lexicographically first maximal independent set, and a member belongs to its best-ranked leader, so the sweep
can be done in rounds over tables: who has a leader before it is a member; who has only members before it leads. Once few edges are
left between open records, one task sweeps these in order, so that long chains take no round for each link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepset.runtime import Scratch, ship

#: Edges between records that are still open which one task settles in order; beyond it rounds over tables go on.
FEW = 500_000


def _swept(batches):
    """id and state of the open records of few edges: in rank order, whoever is unclaimed leads and claims."""
    import pandas as pd

    held = list(batches)
    if not held:
        return
    edges = pd.concat(held, ignore_index=True)
    claimed = set(edges.loc[edges["led"], "dst"])
    state = dict.fromkeys([*edges["dst"], *edges.loc[~edges["led"], "src"]], "leader")
    for (_, src), own in edges[~edges["led"]].groupby(["src_rank", "src"], sort=True):
        if src not in claimed:
            claimed.update(own["dst"])
    for record in claimed:
        state[record] = "member"
    yield pd.DataFrame({"id": list(state), "state": list(state.values())}, columns=["id", "state"])


def star_groups(records: DataFrame, edges: DataFrame, scratch: Scratch, twins: DataFrame | None = None, few: int = FEW) -> DataFrame:
    """(id, leader) of every record; alone records lead themselves.

    records: id, rank (unique, 1 is best). edges: (src, dst), dst is on the list of src; only the better-ranked side's list counts.
    twins: (id, key); records of equal key are one node, stood for by the best-ranked of them.
    """
    if twins is not None:
        keyed = records.join(twins, "id")
        best = keyed.groupBy("key").agg(F.min_by("id", "rank").alias("node"), F.min("rank").alias("node_rank"))
        of = scratch.table(keyed.join(best, "key").select("id", "node", "node_rank"), "star_nodes")
        named = of.select("id", "node")
        lifted = edges.join(named.toDF("src", "a"), "src").join(named.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src <> dst").distinct()
        nodes = of.select(F.col("node").alias("id"), F.col("node_rank").alias("rank")).distinct()
        leaders = star_groups(nodes, lifted, scratch, few=few)
        return of.join(leaders.toDF("node", "leader"), "node").select("id", "leader")
    ship(records.sparkSession)
    rank = records.select(F.col("id"), F.col("rank"))
    ranked = edges.join(rank.toDF("src", "src_rank"), "src").join(rank.toDF("dst", "dst_rank"), "dst")
    down = scratch.table(ranked.where("src_rank < dst_rank").select("src", "dst", "src_rank").distinct(), "star_edges")
    touched = down.select(F.col("src").alias("id")).union(down.select("dst")).distinct()
    state = scratch.table(touched.select("id", F.lit("open").alias("state")), "star_state_0")
    k = 0
    while True:  # each round settles the best-ranked open record at least
        k += 1
        seen = down.join(state.toDF("src", "src_state"), "src").groupBy(F.col("dst").alias("id")).agg(F.max(F.col("src_state") == "leader").alias("led"), F.max(F.col("src_state") == "open").alias("waits"))
        led, waits = F.coalesce("led", F.lit(False)), F.coalesce("waits", F.lit(False))
        new = F.when(F.col("state") != "open", F.col("state")).when(led, "member").when(~waits, "leader").otherwise("open")
        state = scratch.table(state.join(seen, "id", "left").select("id", new.alias("state")), f"star_state_{k}")
        scratch.drop(f"star_state_{k - 1}")
        still = state.where("state = 'open'")
        if still.isEmpty():
            break
        left = down.join(still.select(F.col("id").alias("dst")), "dst").join(state.where("state <> 'member'").toDF("src", "src_state"), "src")
        left = scratch.table(left.select("src", "dst", "src_rank", (F.col("src_state") == "leader").alias("led")), f"star_left_{k}")
        scratch.drop(f"star_left_{k - 1}")
        if left.limit(few + 1).count() <= few:  # long chains end here
            kind = records.schema["id"].dataType.simpleString()
            ended = left.repartition(1).mapInPandas(_swept, f"id {kind}, state string")
            done = F.coalesce("ended", F.when(F.col("state") == "open", "leader").otherwise(F.col("state")))
            state = scratch.table(state.join(ended.withColumnRenamed("state", "ended"), "id", "left").select("id", done.alias("state")), "star_state_last")
            break
    chosen = down.join(state.where("state = 'leader'").select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min_by("src", "src_rank").alias("by"))
    found = state.join(chosen, "id", "left").select("id", F.when(F.col("state") == "member", F.col("by")).otherwise(F.col("id")).alias("leader"))
    return records.select("id").join(found, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))
