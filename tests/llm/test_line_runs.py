"""What the runs of line dedup hold: decided keys are never written again."""

import random

import pytest
from pyspark.sql import functions as F

from wardstat.llm import lines


def batch(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, h1 long, h2 long")


def test_a_decided_key_is_not_written_again(spark):
    runs = lines.LineRuns(spark, fanout=100, buckets=4, min_docs=3, newest_first=True)
    try:
        runs.add(batch(spark, [(9, 1, 1), (8, 1, 1), (7, 1, 1), (9, 2, 2), (8, 3, 3), (8, 3, 3)]))
        runs.add(batch(spark, [(6, 1, 1), (6, 2, 2), (5, 2, 2), (5, 4, 4)]))
        runs.add(batch(spark, [(4, 1, 1), (4, 2, 2), (3, 3, 3), (3, 4, 4)]))
        held = [sorted(map(tuple, r.select("h1", "n_docs", "keeper").collect())) for r in runs.runs()]
        assert held == [[(1, 3, 9), (2, 1, 9), (3, 1, 8)],  # 1 is decided here
                        [(2, 3, 9), (4, 1, 5)],             # 2 is decided here, with the keeper of its first run
                        [(3, 2, 8), (4, 2, 5)]]
        assert sorted(map(tuple, runs.shared(3).collect())) == [(1, 1, 9), (2, 2, 9)]
        assert sorted(r["h1"] for r in runs.shared(2).collect()) == [1, 2, 3, 4]
        with pytest.raises(ValueError, match="up to 3"):
            runs.shared(4)
    finally:
        runs.drop()


@pytest.mark.parametrize("newest_first", [True, False])
@pytest.mark.parametrize("fanout", [2, 3, 100])
def test_keepers_and_counts_over_many_batches(spark, newest_first, fanout):
    rng = random.Random(fanout)
    docs = {d: {rng.randrange(25) for _ in range(rng.randrange(6))} for d in range(60)}
    order = sorted(docs, reverse=True) if newest_first else sorted(docs)
    runs = lines.LineRuns(spark, fanout, buckets=3, min_docs=3, newest_first=newest_first)
    try:
        for at in range(0, 60, 12):
            runs.add(batch(spark, [(d, k, k) for d in order[at:at + 12] for k in docs[d]]))
        want = {k: [d for d in docs if k in docs[d]] for k in range(25)}
        got = {r["h1"]: r["keeper"] for r in runs.shared(3).collect()}
        assert got == {k: max(d) for k, d in want.items() if len(d) >= 3}
    finally:
        runs.drop()


def test_a_common_line_costs_one_row(spark):
    """However many batches hold it."""
    runs = lines.LineRuns(spark, fanout=100, buckets=4, min_docs=3, newest_first=True)
    try:
        for b in range(5):
            runs.add(batch(spark, [(100 - 10 * b - i, 7, 7) for i in range(10)]))
        assert [r.count() for r in runs.runs()] == [1, 0, 0, 0, 0]
        assert runs.shared(3).select(F.col("keeper")).first()[0] == 100
    finally:
        runs.drop()
