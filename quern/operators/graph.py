"""PageRank, Monte-Carlo PageRank and HITS as loops of joins and aggregates over edge lists.

The vectors of each step are written; sums and largest moves are observed while that happens, so a step is one job. The tables of steps that are over are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quern.operators.prefix import numbered, uniform
from quern.sources.tables import remove, settle

TELEPORT, EPSILON, HITS_EPSILON = 0.15, 1e-4, 1e-3


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    """Rows (node_id, out): distinct targets of nodes that have any."""
    return edges.select("src", "dst").distinct().groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("out"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without targets."""
    return nodes.join(edges.select(F.col("src").alias("node_id")), "node_id", "left_anti")


def observed(df: DataFrame, *sums: Column) -> tuple[DataFrame, dict[str, float]]:
    """``df`` settled, and aggregates over its rows, taken in the same job; nulls as 0."""
    seen = Observation()
    out = settle(df.observe(seen, *sums))
    return out, {k: v or 0.0 for k, v in seen.get.items()}


def pagerank(edges: DataFrame, nodes: DataFrame, start: object, teleport: float = TELEPORT, epsilon: float | None = EPSILON, steps: int = 1000) -> DataFrame:
    """Rows (node_id, score): all mass starts on node ``start``; until no score moves by more than ``epsilon``, or for ``steps`` steps.

    The mass on nodes without targets goes to all nodes alike, as a scalar, so no step needs more than the edges.
    """
    links = settle(edges.select("src", "dst").distinct())
    sums = (F.count("*").alias("n"), F.sum("score").alias("whole"), F.sum(F.when(F.col("out").isNull(), F.col("score"))).alias("loose"))
    begin = F.when(F.col("node_id") == F.lit(start), 1.0).otherwise(0.0)
    ranks, mass = observed(nodes.join(out_degree(links), "node_id", "left").select("node_id", "out", begin.alias("score")), *sums)
    for _ in range(steps):
        base = (teleport * (mass["whole"] - mass["loose"]) + mass["loose"]) / max(mass["n"], 1)
        flow = links.join(ranks.filter("score > 0 AND out > 0").select(F.col("node_id").alias("src"), (F.col("score") / F.col("out")).alias("part")), "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum("part").alias("part"))
        score = F.coalesce("part", F.lit(0.0)) * (1 - teleport) + base
        moved = F.max(F.abs(F.col("score") - F.col("old"))).alias("moved")
        new, mass = observed(ranks.select("node_id", "out", F.col("score").alias("old")).join(flow, "node_id", "left").select("node_id", "out", score.alias("score"), "old"), *sums, moved)
        remove(ranks)
        ranks = new
        if epsilon is not None and mass["moved"] <= epsilon:
            break
    remove(links)
    return ranks.select("node_id", "score")


def drawn(count: Column, *parts: Column | int) -> Column:
    """A number from 0 to below ``count``, by a digest of the parts; the same however rows are dealt out, and in other engines."""
    return F.pmod(uniform(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), count)


def monte_carlo(edges: DataFrame, nodes: DataFrame, cyclic: bool, complete: bool, walks: int = 1, teleport: float = TELEPORT, seed: int = 0) -> DataFrame:
    """Rows (node_id, score): shares of random walks that end at a node, or, if ``complete``, of all their visits.

    ``walks`` from each node, if ``cyclic``, or as many from random nodes. Walks go on with probability 1 - teleport. At a node without targets, walks jump to a random node, or end
    if ``complete``. Nodes, and each node's targets, are numbered by digests; a step joins walks with the target of the number they drew, so no list of targets is held together.
    """
    keyed = settle(nodes.select("node_id", uniform(F.col("node_id")).alias("key")))
    n = keyed.count()
    order = settle(numbered(keyed, [], "key", ["node_id"], n).select("node_id", "nr"))
    links = settle(edges.select(F.col("src").alias("node_id"), "dst", uniform(F.col("dst")).alias("key")).distinct())
    out = settle(links.groupBy("node_id").agg(F.count("*").alias("out")))
    most = out.agg(F.max("out")).first()[0] or 0
    targets = settle(numbered(links, ["node_id"], "key", ["dst"], most).select("node_id", "nr", "dst"))
    remove(keyed, links)
    walkers = order.sparkSession.range(n * walks).select(F.col("id").alias("walk"))
    first = F.pmod("walk", F.lit(n)) if cyclic else drawn(F.lit(n), F.col("walk"), seed, -1)
    go = lambda step: drawn(F.lit(100), F.col("walk"), seed, step, 1) < round(100 * (1 - teleport))
    alive, left = observed(walkers.select("walk", first.alias("nr")).join(order, "nr").select("walk", "node_id"), F.count("*").alias("n"))
    steps = []
    while left["n"]:
        step = len(steps)
        steps.append(alive)
        at = alive.filter(go(step)).join(out, "node_id", "left")
        picked = at.filter("out IS NOT NULL").withColumn("nr", drawn(F.col("out"), F.col("walk"), seed, step, 2))
        on = picked.join(targets, ["node_id", "nr"]).select("walk", F.col("dst").alias("node_id"))
        if not complete:
            jump = at.filter("out IS NULL").select("walk", drawn(F.lit(n), F.col("walk"), seed, step, 3).alias("nr")).join(order, "nr").select("walk", "node_id")
            on = on.unionByName(jump)
        alive, left = observed(on, F.count("*").alias("n"))
    visits = nodes.select("node_id").limit(0)
    for step, table in enumerate(steps):
        visits = visits.unionByName((table if complete else table.filter(~go(step))).select("node_id"))
    counts, total = observed(visits.groupBy("node_id").agg(F.count("*").alias("n")), F.sum("n").alias("n"))
    remove(order, out, targets, alive, *steps)
    return nodes.join(counts, "node_id", "left").select("node_id", (F.coalesce("n", F.lit(0)) / (total["n"] or 1)).alias("score"))


def squared_error(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (sse): squared differences to the scores of the nodes in ``truth``."""
    return scores.join(truth.withColumnRenamed("score", "true"), "node_id").agg(F.sum(F.pow(F.col("score") - F.col("true"), 2)).alias("sse"))


def base_set(edges: DataFrame, root: DataFrame, declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges with an end in ``root`` (node_id), and nodes: their ends, and nodes of the root that are declared."""
    links = edges.select("src", "dst").distinct()
    near = links.join(root.select(F.col("node_id").alias("src")), "src", "left_semi").select("src", "dst").union(links.join(root.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst")).distinct()
    own = root if declared is None else root.join(declared, "node_id", "left_semi")
    return near, nodes_of(near).union(own.select("node_id")).distinct()


def hits(edges: DataFrame, nodes: DataFrame, epsilon: float | None = HITS_EPSILON, steps: int | None = None) -> DataFrame:
    """Rows (node_id, hub, authority): both from the last step's vectors at once, each over its length; until nothing moves by more than ``epsilon``, or for ``steps`` steps."""
    links = settle(edges.select("src", "dst").distinct())
    now = settle(nodes.select("node_id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority")))
    squares = (F.sum(F.col("h") * F.col("h")).alias("h"), F.sum(F.col("a") * F.col("a")).alias("a"))
    last = now
    for _ in range(1000 if steps is None else steps):
        hub = links.join(now.select(F.col("node_id").alias("dst"), "authority"), "dst").groupBy(F.col("src").alias("node_id")).agg(F.sum("authority").alias("h"))
        authority = links.join(now.select(F.col("node_id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum("hub").alias("a"))
        joined = now.join(hub, "node_id", "left").join(authority, "node_id", "left")
        raw, norm = observed(joined.select("node_id", F.col("hub").alias("h0"), F.col("authority").alias("a0"), F.coalesce("h", F.lit(0.0)).alias("h"), F.coalesce("a", F.lit(0.0)).alias("a")), *squares)
        remove(last)
        h, a = F.col("h") / (norm["h"] ** 0.5 or 1.0), F.col("a") / (norm["a"] ** 0.5 or 1.0)
        new = raw.select("node_id", h.alias("hub"), a.alias("authority"), F.greatest(F.abs(h - F.col("h0")), F.abs(a - F.col("a0"))).alias("moved"))
        now, last = new.select("node_id", "hub", "authority"), raw
        if steps is None and (new.agg(F.max("moved")).first()[0] or 0.0) <= epsilon:
            break
    remove(links)
    return now
