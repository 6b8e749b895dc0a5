"""Cycles go on until they converge."""

from quillgraph.operators import memory as M
from quillgraph.plans import memory as P


def test_more_than_five_cycles(spark, monkeypatch):
    done = []

    def cycle(entities, relations, mentions, chunk_times, now):
        done.append(1)
        counted = {"entities_before": 10, "entities_after": 9, "relations_before": 1, "relations_after": 1, "merged": 1}
        return entities, relations, mentions, counted | {"compression": 0.1 if len(done) < 7 else 0.0}

    monkeypatch.setattr(M, "consolidation_cycle", cycle)
    for name in ("entities", "relations", "mentions", "_times"):
        monkeypatch.setattr(P, name, lambda s, d: None)
    rows = P.consolidation_cycles(spark, "").orderBy("cycle").collect()
    # the mean of the cycles before the 9th, 0.1, 0.0 and 0.0, is below 0.05
    assert len(rows) == 9 and rows[-1].converged and not any(r.converged for r in rows[:-1])
