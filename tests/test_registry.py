"""Registered queries against their SQL counterparts on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare_one, duck

SF = "/root/testdata/sf0.001"
NAMES = [
    "objective_metrics", "job_metrics_nearest", "swf_parse", "sacct_parse", "pbs_parse", "qstat_json_parse",
    "replay_csv_import", "quality_report", "queue_at_submit", "observed_queue", "queue_resampled", "feature_table",
    "user_lookbacks_causal", "tsafrir", "fairshare", "chronological_folds", "trace_profile", "wait_kl", "slowdown_ks",
    "queue_corr", "recommend", "psi", "naive_baselines", "feedback_report", "regression_gate", "sliding_counts",
    "gen_burst", "incremental_poll", "stream_ingest", "stream_queue",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    status, rows, detail = compare_one(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert status == "ok" and rows > 0, detail


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_models_are_registered_whole(spark, monkeypatch):
    """The operators' own columns, repeats, trees and search space, nothing less."""
    from types import SimpleNamespace

    from checks import queries
    from cairntrace.operators import learning

    calls = {}

    def noted(name, result):
        def call(*args, **settings):
            calls[name] = (len(args), settings)
            return result

        return call

    scored = SimpleNamespace(score=lambda df: df)
    for name, result in (("fit_runtime", scored), ("fit_resource", (None, None)), ("tune", None), ("importance", None)):
        monkeypatch.setattr(learning, name, noted(name, result))
    monkeypatch.setattr(queries, "_learning_split", lambda jobs: (None, None, None))
    monkeypatch.setattr(queries, "_settled_features", lambda jobs: None)
    monkeypatch.setattr(queries.coerce, "training_frame", lambda df: df)
    monkeypatch.setattr(queries.accuracy, "evaluate_quantiles", lambda *args: None)
    monkeypatch.setattr(queries.fx, "jobs", lambda spark, sf_dir: SimpleNamespace(withColumn=lambda *args: None))
    monkeypatch.setattr(queries.quality, "dataset_fingerprint", noted("files", None))
    for name in ("runtime_model", "resource_model", "tuning", "importance", "dataset_fingerprint"):
        queries.QUERIES[name](None, "folder")
    assert calls == {"fit_runtime": (2, {}), "fit_resource": (1, {}), "tune": (1, {}), "importance": (2, {}), "files": (2, {})}


def test_every_table_has_a_fingerprint(spark):
    import os

    from checks.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = QUERIES["dataset_fingerprint"](spark, folder).collect()
    assert {r["filename"] for r in rows} >= {f for f in os.listdir(folder) if os.path.isfile(f"{folder}/{f}")}
    assert len(rows) >= len(os.listdir(folder))
