"""End-to-end run of the three strategies on a short schedule (sf0.001)."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def test_three_strategies_short_schedule(spark):
    from groupcast.constants import CANDIDATE_FEATURES
    from groupcast.operators.panel import feature_panel
    from groupcast.plans.prepare import prepare
    from groupcast.plans.strategies import StrategyConfig, run_strategies

    prep = prepare(feature_panel(spark, SF_SMALL), CANDIDATE_FEATURES[:4])
    cfg = StrategyConfig(num_rounds=2, epochs_per_round=1, global_warmup_rounds=0, head_finetune_epochs=1,
                         recluster_interval=1, local_epochs=1)
    history = []
    records, results = run_strategies(prep, cfg, history)
    res = {r.strategy: r for r in results.collect()}
    assert set(res) == {"Local", "Global FedAvg", "Clustered"}
    n_clients = prep.clients.count()
    # every strategy reports every client once in its final records
    assert all(r.num_samples > 0 for r in res.values())
    assert res["Local"].num_samples == res["Global FedAvg"].num_samples == res["Clustered"].num_samples
    stages = {(r.strategy, r.stage): r["count"] for r in records.groupBy("strategy", "stage").count().collect()}
    assert stages[("Local", "personalized")] == n_clients
    assert stages[("Global FedAvg", "federated")] == 2 * n_clients
    assert [h.first().stage for h in history] == ["initial_clustering", "dynamic_recluster"]
    assert history[0].first().total_clients == n_clients
    assert records.filter(F.col("rmse").isNull()).count() == 0


def _prep(spark, n=4):
    from groupcast.constants import CANDIDATE_FEATURES
    from groupcast.operators.panel import feature_panel
    from groupcast.plans.prepare import prepare

    return prepare(feature_panel(spark, SF_SMALL), CANDIDATE_FEATURES[:n])


def test_stopped_run_goes_on_with_equal_results(spark, tmp_path, monkeypatch):
    from groupcast.plans import strategies as st

    prep = _prep(spark, 2)
    cfg = st.StrategyConfig(num_rounds=2, epochs_per_round=1, global_warmup_rounds=1, head_finetune_epochs=1, recluster_interval=1,
                            local_epochs=1, max_clusters=3, strategies=["Global FedAvg", "Clustered"])

    def values(records):
        return sorted((r.strategy, r.stage, r["round"] or 0, r.client_id, r.bubble, r.num_samples, round(r.rmse, 9)) for r in records.collect())

    whole, _ = st.run_strategies(prep, cfg, folder=f"file://{tmp_path}/whole")
    commit, taken = st.RoundLog.commit, []

    def dies(self, phase, step, **tables):
        if phase == "dynamic" and step == 2:
            raise KeyboardInterrupt  # the driver is lost before the last round counts
        taken.append((phase, step))
        return commit(self, phase, step, **tables)

    monkeypatch.setattr(st.RoundLog, "commit", dies)
    try:
        st.run_strategies(prep, cfg, folder=f"file://{tmp_path}/part")
        raise AssertionError("the run should have stopped")
    except KeyboardInterrupt:
        pass
    again = []
    monkeypatch.setattr(st.RoundLog, "commit", lambda self, phase, step, **t: again.append((phase, step)) or commit(self, phase, step, **t))
    history = []
    rest, _ = st.run_strategies(prep, cfg, history, folder=f"file://{tmp_path}/part")
    assert not set(taken) & set(again) and ("dynamic", 2) in again
    assert values(rest) == values(whole)
    assert [h.first().stage for h in history] == ["initial_clustering", "dynamic_recluster"]


def test_bubbles_without_personal_heads(spark):
    """K9 over the clusters' bubbles and K12 with all layers: isolated clients start from their own parameters."""
    from groupcast.plans import strategies as st

    prep = _prep(spark, 2)
    cfg = st.StrategyConfig(num_rounds=1, epochs_per_round=1, global_warmup_rounds=0, local_epochs=1, max_clusters=4,
                            personalize_head=False, strategies=["Clustered"])
    ctx, log = st.Context(prep), st.RoundLog(spark)
    records = st.run_clustered(ctx, cfg, log)
    assign = {r.client_id: r for r in log.steps("clusters")[0]["assign"].collect()}
    got = {r.client_id: r for r in records.collect()}
    assert set(got) == set(assign) and len(got) == records.count()
    alone = st.run_local(ctx, cfg, log)
    own = {r.client_id: r.rmse for r in alone.collect()}
    for c, r in got.items():
        assert r.stage == ("personalized" if assign[c].is_isolated else "federated")
        if assign[c].is_isolated:
            assert abs(r.rmse - own[c]) < 1e-9 * max(1, own[c])


def test_rounds_over_any_assignment(spark):
    """Two bubbles at once give what each gives alone."""
    from groupcast.plans import strategies as st

    prep = _prep(spark, 2)
    cfg = st.StrategyConfig(num_rounds=2, epochs_per_round=1)
    ctx = st.Context(prep)
    region = F.substring_index("client_id", "_", 1)
    names = [r[0] for r in ctx.clients.select(region).distinct().orderBy(region).limit(2).collect()]
    both = ctx.clients.filter(region.isin(names)).select("client_id", (region == names[0]).cast("int").alias("bubble"))

    def rmse(assign):
        return {(r.client_id, r["round"]): r.rmse for r in st.run_averaged(ctx, cfg, st.RoundLog(spark), assign).collect()}

    together = rmse(both)
    apart = {k: v for b in (0, 1) for k, v in rmse(both.filter(F.col("bubble") == b)).items()}
    assert set(together) == set(apart)
    assert all(abs(together[k] - apart[k]) < 1e-9 * max(1, apart[k]) for k in apart)
