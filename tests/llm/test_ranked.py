"""Ranked search against brute force and SQL: ties, repeated and empty texts, long texts, segments of a few documents, all terms or the items' alone."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from codeloom.llm import ranked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text.translate(LOWER)) if text else []


def wanted(docs, items, k=50):
    counted = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc, c in counted:
            m = 100 - 50 + 50 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=lambda x: x[:2])


def data(seed=2):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "Ünd", "ünd", "x1", "Ärger", "a", "été", "été", "z_z", "İ", "K", "日本語", *(f"w{i}" for i in range(120))]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(rng.choice([1, 5, 40, 200]))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(80)] + [(7, docs[7][1]), (None, docs[3][1]), (None, docs[3][1]), (2000, None), (2001, ""), (2002, " .-_\n"), (2003, text(60_000)), (2004, "w1\x00w2\x7fw3")]
    rng.shuffle(docs)
    items = [(i, text(rng.choice([1, 3, 30]))) for i in range(25)] + [(100, docs[5][1]), (101, None), (102, ""), (103, "unknown words"), (None, "the w1"), (104, "w1 w2"), (104, "w2 w3"), (105, "W1 THE K Kelvin")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, item long")
    return d, spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, segment string")


@pytest.mark.parametrize("segment, vocabulary, terms", [(2048, 200_000, 1_000_000), (7, 3, 20)])
def test_as_by_brute_force(spark, monkeypatch, segment, vocabulary, terms):
    monkeypatch.setattr(ranked, "SEGMENT", segment)
    monkeypatch.setattr(ranked, "VOCABULARY", vocabulary)
    monkeypatch.setattr(ranked, "TERMS", terms)
    docs, items = data()
    d, i = frames(spark, docs, items)
    found = sorted(map(tuple, ranked.ranked(d, i).collect()), key=lambda x: x[:2])
    assert found == wanted(docs, items)
    few = sorted(map(tuple, ranked.ranked(d.repartition(9), i, 3).collect()), key=lambda x: x[:2])
    assert few == wanted(docs, items, 3)


def test_bytes_bound_what_they_stand_for():
    f = np.arange(ranked.TOP)
    b = ranked.quantised(f)
    assert (ranked.LEAST[b] <= f).all() and (f <= ranked.MOST[b]).all()
    tf = np.array([1, 2, 10**6, 1]), np.array([1, 10**6, 10**6, 10**8])
    assert (ranked.saturated(*tf, 10, 1000) < ranked.TOP).all()


def test_bounds_leave_most_documents_out(spark, monkeypatch):
    """Exact scores are computed for those documents alone whose bound reaches the k-th."""
    asked = []
    rescored = ranked.rescored
    monkeypatch.setattr(ranked, "rescored", lambda index, wanted, shared: asked.append(wanted.count()) or rescored(index, wanted, shared))
    rng = random.Random(4)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.4)) % 500}" for _ in range(rng.choice([20, 60, 200])))) for i in range(3000)]
    items = [(i, " ".join(f"w{int(rng.paretovariate(0.4)) % 500}" for _ in range(30))) for i in range(20)]
    found = sorted(map(tuple, ranked.ranked(*frames(spark, docs, items), 10).collect()), key=lambda x: x[:2])
    assert found == wanted(docs, items, 10)
    assert asked[0] < 0.05 * len(docs) * len(items)


def test_one_index_for_many_searches(spark):
    docs, items = data(9)
    d, i = frames(spark, docs, items)
    index = ranked.Index(d)
    assert sorted(map(tuple, ranked.search(index, ranked.asked_terms(i), 5).collect()), key=lambda x: x[:2]) == wanted(docs, items, 5)
    again = [(1, "the of w5"), (2, "日本語")]
    assert sorted(map(tuple, ranked.search(index, ranked.asked_terms(frames(spark, docs, again)[1]), 5).collect()), key=lambda x: x[:2]) == wanted(docs, again, 5)


def test_no_rows(spark):
    docs, items = data()
    d, i = frames(spark, docs, items)
    assert ranked.ranked(d.where("doc_id < 0"), i).count() == 0
    assert ranked.ranked(d, i.where("item_id < 0")).count() == 0
    assert ranked.ranked(d.where("text = ''"), i).count() == 0


def test_query_as_by_sql(spark, tmp_path):
    docs, items = data(6)
    d, i = frames(spark, docs, items)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    i.write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = sorted(map(tuple, ranked.op13_ranked_search(spark, str(tmp_path)).collect()), key=lambda x: x[:2])
    assert found == wanted(docs, items) == sorted(con.execute(ranked.OP13_SQL).fetchall(), key=lambda x: x[:2])
