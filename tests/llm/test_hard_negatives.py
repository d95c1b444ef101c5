"""Hard negatives against brute force: ties, repeated rows, nulls, hot labels, blocks and parts of a few rows."""

import math

import duckdb
import numpy as np
import pytest

from codeloom.llm import hard_negatives
from codeloom.llm.common import table

SCHEMA = "vec_id long, label int, embedding array<double>, cell string, `group` int, q long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def wanted(rows, factor=256):
    """(anchor, positive, rank, negative, positive score, negative score, positive rank) by brute force."""
    ok = [(i, y, [math.floor(factor * c) for c in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))
    out = []
    for a, y, v in {(i, y, tuple(v)) for i, y, v in ok if i % 100 == 0}:
        scored = [(-dot(v, w), i, z) for i, z, w in ok if i != a]
        alike, unlike = sorted((s, i) for s, i, z in scored if z == y), sorted((s, i) for s, i, z in scored if z != y)
        for p, (ps, pid) in enumerate(alike[:5], 1):
            fit = [(s, i) for s, i in unlike if 80 * -ps <= 100 * -s <= 100 * -ps]
            out += [(a, pid, r, i, -ps, -s, p) for r, (s, i) in enumerate(fit[:5], 1)]
    return sorted(out)


@pytest.mark.parametrize("queries, block", [(4096, 16384), (2, 40)])
def test_as_by_brute_force(spark, monkeypatch, queries, block):
    monkeypatch.setattr(hard_negatives, "QUERIES", queries)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5))
    rows = [(i, int(rng.choice([0, 0, 0, 1, 2, 3])), (centres[i % 6] * (1 + i % 3) + rng.normal(size=5) * 0.3).tolist()) for i in range(900)]
    rows += [(1000 + i, 1, rows[200][2]) for i in range(12)] + [(1100, 0, rows[200][2])] * 3 + [(300, 2, rows[301][2]), (300, 0, rows[302][2])]
    rows += [(1200, None, [1.0] * 5), (1201, 0, None), (1202, 0, [1.0, None, 2.0]), (1203, 1, [float("nan")] * 5), (1204, 1, [float("inf")] * 5), (None, 1, [1.0] * 5)]
    rows += [(1300, 0, [0.5]), (1301, 0, []), (1400, 77, [1.0] * 5), (1500, 1, [1e9] * 5), (1501, 1, [1e9] * 5), (1502, 2, [0.9e9] * 5), (1600, 3, [0.0] * 5)]
    found = sorted(map(tuple, hard_negatives.mined(frame(spark, rows)).collect()))
    want = wanted(rows)
    assert found == want
    assert len({a for a, *_ in want}) > 8 and any(r[0] == 1500 for r in want)


def test_no_rows(spark):
    assert hard_negatives.mined(frame(spark, [])).count() == 0
    assert hard_negatives.mined(frame(spark, [(1, 1, [1.0])])).count() == 0  # no anchor
    assert hard_negatives.mined(frame(spark, [(100, 1, [1.0]), (101, 2, [1.0])])).count() == 0  # no positive
    assert hard_negatives.mined(frame(spark, [(100, 1, [1.0]), (101, 1, [-1.0]), (102, 2, [-1.0])])).count() == 0  # a positive below 0


def test_sends_little_of_clustered_data(spark):
    """Sixty tight clusters of mixed labels: few rows reach a group, and the rows are those of brute force."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, int(rng.integers(0, 3)), (centres[i % 60] + rng.normal(size=16) * 0.004).tolist()) for i in range(6000)]
    sent = []
    met = hard_negatives.met

    def counted(asked, celled, routes, sizes, on, *rest):
        groups = asked.select("group").distinct().count()
        sent.append(celled.join(routes, on).count() / (groups * celled.count()))
        return met(asked, celled, routes, sizes, on, *rest)

    hard_negatives.met = counted
    hard_negatives.PIVOTS, pivots = 64, hard_negatives.PIVOTS
    try:
        found = sorted(map(tuple, hard_negatives.mined(frame(spark, rows)).collect()))
    finally:
        hard_negatives.met, hard_negatives.PIVOTS = met, pivots
    assert found == wanted(rows)
    assert sent[0] < 0.1 and sent[1] < 0.25


def test_query_as_by_sql(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 10)), rng.normal(size=4).tolist()) for i in range(1, 700)] + [(700, 9, [1.0, 0.5, 0.0, -1.0])] * 2
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    out = hard_negatives.op12_hard_negatives(spark, str(tmp_path))
    shifted = [(i, (y + 1) % 10 if i % 7 == 0 else y, v) for i, y, v in rows]
    found = sorted(map(tuple, out.collect()))
    assert found == wanted(shifted) == sorted(con.execute(hard_negatives.OP12_SQL).fetchall())
    assert table(spark, str(tmp_path), "embeddings").count() == len(rows)
