"""Duplicates by embedding against a comparison of all pairs."""

import random

import numpy as np

from quillgraph.operators import resolution as R

SCHEMA = "entity_id bigint, entity_type string, mention_count bigint, name string, description string, embedding array<float>"


def _all_pairs(rows, threshold):
    found = set()
    for x in rows:
        for y in rows:
            a, b = ({w for w in r[3].lower().split() if len(w) >= 3 and w not in R.EMBEDDING_STOP} for r in (x, y))
            u, v = np.float32(x[5]).astype(float), np.float32(y[5]).astype(float)
            if x[0] < y[0] and x[1] == y[1] and a & b and R.jaro_winkler(x[3].lower(), y[3].lower()) >= 0.6 and len(u) == len(v):
                wx, wy = x[3].lower().split(), y[3].lower().split()
                cap = 0.96 if wx[-1] == wy[-1] and wx[0] != wy[0] else 1.0
                if min(cap, u @ v / np.linalg.norm(u) / np.linalg.norm(v)) >= threshold:
                    found.add((x[0], y[0]))
    return found


def test_every_shared_token_makes_candidates(spark):
    pick = random.Random(5)
    words = ["noor", "silke", "solbury", "galpa", "gimenko", "institute", "university", "climate", "studies", "records"]
    rows = []
    for i in range(120):
        name = " ".join(pick.sample(words, pick.randint(2, 5)))
        rows.append((i, pick.choice(["Person", "Organization"]), 1, name, "", [pick.gauss(1, 1) for _ in range(pick.choice([8, 8, 4]))]))
    # the common word is the only one that they share, and neither's rarest
    rows += [(200, "Person", 1, "noor silka solburi", "", [1.0, 2.0]), (201, "Person", 1, "noor silkasolburi", "", [1.0, 2.1])]
    rows += [(202, "Person", 1, "noor zzza zzzb", "", [1.0, -2.0])]
    # only tokens of the stop list, or shorter than 3 letters, are shared
    rows += [(300, "Organization", 1, "institute of aaab", "", [1.0, 2.0]), (301, "Organization", 1, "institute of aaac", "", [1.0, 2.0])]
    for threshold in (0.6, 0.9):
        want = _all_pairs(rows, threshold)
        assert len(want) > 20 and (200, 201) in want and (300, 301) not in want
        for block in (1024, 7):
            got = [tuple(sorted(r)) for r in R.by_embedding(spark.createDataFrame(rows, SCHEMA), threshold, block=block).collect()]
            assert len(got) == len(set(got)) and set(got) == want
