import random

import pytest

from quillgraph.operators.hierarchy import full_hierarchies


def brute(links):
    parent = {}
    for h, c, p in links:
        if None not in (h, c, p):
            parent[h, c] = min(p, parent.get((h, c), p))
    nodes = {*parent} | {(h, p) for (h, _), p in parent.items()}
    out, below = {}, dict.fromkeys(nodes, 0)
    for h, n in nodes:
        chain, at = [], (h, n)
        while at in parent and (not chain or at not in chain):
            chain.append(at)
            at = (h, parent[at])
        for a in {*chain[1:], at} - {(h, n)}:
            below[a] += 1
        ways = [x[1] for x in chain]
        if at not in parent:
            out[h, n] = (at[1], len(chain), "/".join(map(str, [at[1], *reversed(ways)])), "tree")
        else:
            out[h, n] = (-1, -1, "", "cycle" if at == (h, n) else "below_cycle")
    return sorted((h, n, *v, below[h, n]) for (h, n), v in out.items())


@pytest.mark.parametrize("limit", [60, 10_000])
def test_against_brute_force(spark, limit):
    rng = random.Random(3)
    links = [("a", i, rng.randrange(max(0, i - 6), i)) for i in range(1, 120)]
    links += [("b", i, i + 1) for i in range(60)] + [("b", 60, 40), ("b", 200, 20), ("b", 300, 300), ("b", 301, 300)]
    links += [("c", i, 0) for i in range(1, 60)] + [("c", 0, 0)]
    links += [("d", -i, -i // 2 - 1) for i in range(3, 60)]
    links += links[:20] + [("a", None, 3), ("a", 3, None), (None, 1, 2)]
    df = spark.createDataFrame(links, "hierarchy string, child long, parent long")
    assert sorted(tuple(r) for r in full_hierarchies(df, limit).collect()) == brute(links)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "hierarchy string, child long, parent long, node long, exit long, way string")
    assert full_hierarchies(df).count() == 0
    df = spark.createDataFrame([("x", 2, 1, 5, 6, "w")], df.schema)
    assert sorted(r.path for r in full_hierarchies(df).collect()) == ["1", "1/2"]


def test_contracts_and_recurses_on_test_data(spark):
    import os

    from quillgraph.common import table
    from quillgraph.plans.problems import hierarchical_links

    data = "/root/testdata/sf0.1"
    if not os.path.exists(data):
        pytest.skip("no test data")
    links = hierarchical_links(table(spark, data, "relations"))
    sizes: list[int] = []
    got = sorted(tuple(r) for r in full_hierarchies(links, sizes=sizes).collect())
    assert len(sizes) >= 2 and sizes == sorted(sizes, reverse=True) and sizes[-1] <= 0.5 * sizes[0]
    assert got == brute([tuple(r) for r in links.collect()])
