"""Full hierarchies from parent-child links (problem 3).

Nodes are spread over partitions, none of which gets more than its even share. In
each partition every chain
of parents is contracted to its exit, the first ancestor that lies elsewhere. The
exits alone form a smaller quotient forest, which is solved the same way, until it
is no larger than one share; then each level's fragments are expanded by one join
with the level above. A cycle shows up as soon as its contracted form lies
within one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.common import cut, tasks

#: Nodes of one partition: an even share of all of them, but at least so many
#: (below, a further level costs more than it spreads) and at most so many (with
#: their paths they fill some 100 MB).
LEAST_NODES, FRAGMENT_NODES = 500, 200_000

_OPEN, _CYCLE, _BELOW = 0, 1, 2
_SOLVED = "hierarchy string, node bigint, exit bigint, steps int, way string, state int"


def _contract(pdf):
    """Each node's exit from the fragment, the steps to it and the way down from it.

    ``way`` names the nodes from the one below the exit down to the node. In a
    local cycle the exit is the smallest node of the cycle and the way starts at
    the node where the cycle is entered.
    """
    import pandas as pd

    out = []
    for hierarchy, part in pdf.groupby("hierarchy", sort=False):
        parent = dict(zip(part["node"], part["exit"]))
        own = dict(zip(part["node"], zip(part["steps"], part["way"])))
        solved: dict = {}
        for start in parent:
            chain, at, place = [], start, {}
            while at in parent and at not in solved and at not in place:
                place[at] = len(chain)
                chain.append(at)
                at = parent[at]
            if at in place:
                ring = chain[place[at] :]
                least = min(ring)
                for node in ring:
                    solved[node] = (least, 0, own[node][1], _CYCLE)
                chain = chain[: place[at]]
            for node in reversed(chain):
                steps, way = own[node]
                above = solved.get(parent[node])
                if above is None:
                    solved[node] = (parent[node], steps, way, _OPEN)
                else:
                    solved[node] = (above[0], above[1] + steps, f"{above[2]}/{way}", _OPEN if above[3] == _OPEN else _BELOW)
        out.append(pd.DataFrame([(hierarchy, n, *s) for n, s in solved.items()], columns=["hierarchy", "node", "exit", "steps", "way", "state"]))
    return pd.concat(out) if out else pd.DataFrame(columns=["hierarchy", "node", "exit", "steps", "way", "state"])


def _fragments(rows: DataFrame, n: int, limit: int, level: int) -> DataFrame:
    """``rows`` with the partition of each node.

    Half of the nodes are heads, chosen by a hash that changes with the level;
    another node lies with its parent, so a head and its children that are no
    heads share a fragment. Children of a parent with very many of them stay
    apart, so that no fragment outgrows the limit.
    """
    parts = -(-n // limit)
    if parts == 1:
        return rows.withColumn("fragment", F.lit(0))
    hash_of = lambda c: F.xxhash64("hierarchy", c, F.lit(level))
    crowded = rows.groupBy("hierarchy", "exit").count().where(F.col("count") > max(50, limit // 10)).select("hierarchy", "exit", F.lit(True).alias("crowded"))
    rows = rows.join(crowded, ["hierarchy", "exit"], "left")
    alone = F.col("crowded").isNotNull() | (F.pmod(hash_of("node"), F.lit(2)) == 0)
    anchor = F.when(alone, F.col("node")).otherwise(F.col("exit"))
    return rows.withColumn("fragment", F.pmod(F.xxhash64("hierarchy", anchor), F.lit(2 * parts)).cast("int")).drop("crowded")


def _solve(rows: DataFrame, limit: int, level: int, sizes: list[int]) -> DataFrame:
    """Rows of pointers (node to exit) solved up to the roots or cycles."""
    n = rows.count()
    sizes.append(n)
    local = cut(_fragments(rows, n, limit, level).groupBy("fragment").applyInPandas(lambda pdf: _contract(pdf), _SOLVED))
    if n <= limit:
        return local
    exits = local.where(F.col("state") == _OPEN).select("hierarchy", F.col("exit").alias("node")).distinct()
    quotient = cut(local.where(F.col("state") == _OPEN).join(exits, ["hierarchy", "node"], "left_semi"))
    if quotient.isEmpty():
        return cut(_below_settled(local, local))
    upper = _solve(quotient.drop("state"), limit, level + 1, sizes)
    above = upper.select("hierarchy", F.col("node").alias("exit"), F.col("exit").alias("top"), F.col("steps").alias("more"), F.col("way").alias("up"), F.col("state").alias("kind"))
    inner = local.join(upper.select("hierarchy", "node"), ["hierarchy", "node"], "left_anti").join(above, ["hierarchy", "exit"], "left")
    grown = (F.col("state") == _OPEN) & F.col("top").isNotNull()
    inner = inner.select(
        "hierarchy",
        "node",
        F.when(grown, F.col("top")).otherwise(F.col("exit")).alias("exit"),
        F.when(grown, F.col("more") + F.col("steps")).otherwise(F.col("steps")).cast("int").alias("steps"),
        F.when(grown, F.concat_ws("/", "up", "way")).otherwise(F.col("way")).alias("way"),
        F.when(grown & (F.col("kind") != _OPEN), F.lit(_BELOW)).otherwise(F.col("state")).alias("state"),
    )
    # what was contracted between two nodes of a cycle is on the cycle, too
    hidden = upper.where(F.col("state") == _CYCLE).select("hierarchy", "node").join(quotient, ["hierarchy", "node"])
    hidden = hidden.select("hierarchy", F.explode(F.transform(F.split("way", "/"), lambda x: x.cast("long"))).alias("node"), F.lit(True).alias("ring")).distinct()
    both = inner.unionByName(upper).join(hidden, ["hierarchy", "node"], "left")
    ring = F.col("ring").isNotNull()
    state = F.when(ring, F.lit(_CYCLE)).otherwise(F.col("state"))
    both = both.select("hierarchy", "node", "exit", "steps", F.when(ring, F.col("node").cast("string")).otherwise(F.col("way")).alias("way"), state.alias("state"))
    return cut(_below_settled(both, local))


def _below_settled(rows: DataFrame, local: DataFrame) -> DataFrame:
    """``rows`` whose exit lies on or below a cycle within one fragment: below it, too."""
    settled = local.where(F.col("state") != _OPEN).select("hierarchy", F.col("node").alias("exit"), F.col("exit").alias("top"), F.col("way").alias("up"))
    joined = rows.join(settled, ["hierarchy", "exit"], "left")
    hit = (F.col("state") == _OPEN) & F.col("top").isNotNull()
    return joined.select(
        "hierarchy",
        "node",
        F.when(hit, F.col("top")).otherwise(F.col("exit")).alias("exit"),
        "steps",
        F.when(hit, F.concat_ws("/", "up", "way")).otherwise(F.col("way")).alias("way"),
        F.when(hit, F.lit(_BELOW)).otherwise(F.col("state")).alias("state"),
    )


def full_hierarchies(links: DataFrame, limit: int | None = None, sizes: list[int] | None = None) -> DataFrame:
    """``(hierarchy, node_id, root_id, depth, path, state, n_descendants)``.

    ``links`` has ``hierarchy``, ``child`` and ``parent``; repeated links count
    once and a node has at most one parent in a hierarchy (of several the
    smallest is taken). Links with a null end or hierarchy are dropped. ``tree``:
    the ancestors end in a root; ``cycle``: a node is its own ancestor (also by
    a link to itself); ``below_cycle``: otherwise. Outside trees root_id and
    depth are -1 and the path is empty. Descendants are counted from the paths,
    which are part of the result, with partial sums before the shuffle, so a
    root above a third of all nodes is no hot group. ``limit`` is the number of
    nodes of one partition (see :data:`LEAST_NODES`); ``sizes``, a list, gets the
    number of nodes of each level of the recursion.
    """
    links = links.select("hierarchy", F.col("child").cast("long").alias("child"), F.col("parent").cast("long").alias("parent")).dropna()
    pointers = cut(links.groupBy("hierarchy", F.col("child").alias("node")).agg(F.min("parent").alias("exit")))
    rows = pointers.select("hierarchy", "node", "exit", F.lit(1).alias("steps"), F.col("node").cast("string").alias("way"))
    if limit is None:
        limit = min(FRAGMENT_NODES, max(LEAST_NODES, -(-pointers.count() // tasks(links.sparkSession))))
    solved = _solve(rows, limit, 0, [] if sizes is None else sizes)
    roots = pointers.select("hierarchy", F.col("exit").alias("node")).distinct().join(pointers, ["hierarchy", "node"], "left_anti")
    roots = roots.select("hierarchy", "node", F.col("node").alias("exit"), F.lit(0).alias("steps"), F.lit("").alias("way"), F.lit(_OPEN).alias("state"))
    nodes = solved.unionByName(roots)
    tree = F.col("state") == _OPEN
    # every node once for each node on its way, and once for its root or cycle
    on_way = nodes.where(F.col("state") != _CYCLE).select("hierarchy", "node", "exit", tree.alias("tree"), F.split("way", "/").alias("way"))
    above = F.filter(F.transform("way", lambda x: x.try_cast("long")), lambda x: x.isNotNull() & (x != F.col("node")))
    above = F.when(F.col("tree") & (F.col("node") != F.col("exit")), F.concat(F.array("exit"), above)).otherwise(above)
    counts = on_way.select("hierarchy", F.explode(above).alias("node")).groupBy("hierarchy", "node").agg(F.count("*").alias("below"))
    rings = nodes.where(~tree).groupBy("hierarchy", "exit").agg(F.count("*").alias("members"))
    out = nodes.join(counts, ["hierarchy", "node"], "left").join(rings, ["hierarchy", "exit"], "left")
    descendants = F.when(F.col("state") == _CYCLE, F.col("members") - 1).otherwise(F.coalesce("below", F.lit(0)))
    path = F.concat_ws("/", F.col("exit").cast("string"), F.when(F.col("way") != "", F.col("way")))
    return out.select(
        "hierarchy",
        F.col("node").alias("node_id"),
        F.when(tree, F.col("exit")).otherwise(F.lit(-1)).cast("long").alias("root_id"),
        F.when(tree, F.col("steps")).otherwise(F.lit(-1)).cast("int").alias("depth"),
        F.when(tree, path).otherwise(F.lit("")).alias("path"),
        F.when(tree, "tree").when(F.col("state") == _CYCLE, "cycle").otherwise("below_cycle").alias("state"),
        descendants.cast("long").alias("n_descendants"),
    )
