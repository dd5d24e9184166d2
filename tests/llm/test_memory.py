"""What holds the memory of executors and the driver down."""

from __future__ import annotations

import corpus_pipeline
from quartzline.llm import components, spot_signatures


def test_spot_report_takes_one_worker_a_step(spark):
    rows = [(i, " ".join(f"the word{i + j} and" for j in range(20))) for i in range(3000)] + [(None, "a null id"), (7, None)]
    report = spot_signatures.successors_report(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = report._jdf.queryExecution().executedPlan().toString()
    # a second Python step beside the packing took a worker more for each task, and pandas in each of them
    assert "ArrowEvalPython" not in plan
    found = report.collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in found if r.doc_id is not None) == sorted((False, i) for i, _ in rows if i is not None)
    assert len(found) == len(rows) and not hasattr(spot_signatures, "pd")


def test_components_stop_at_stars(spark, monkeypatch):
    rounds = []
    written = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df: rounds.append(1) or written(df))
    edges = [(100, 100 + i) for i in range(1, 9)] + [(3, 300), (3, 301), (5, 5)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.component) for r in found.collect()} == {(100 + i, 100) for i in range(9)} | {(3, 3), (300, 3), (301, 3)}
    assert len(rounds) == 1  # a second round only confirmed the first
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedup_ends_in_a_small_plan(spark):
    words = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(words[i % 5 :])) for i in range(20)] + [(3, "another text of that id"), (None, "x"), (30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.deduplicated(spark, docs, "")
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in kept.collect())) == [(False, 0), (False, 30), (True, 0)]
    # the driver plans anew after each exchange; the whole operator was in the plan, in both uses of the join
    assert kept._jdf.queryExecution().sparkPlan().toString().count("Join") <= 2
