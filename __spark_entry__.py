"""

Every query reads the driver's parquet tables (or data Spark derives from
them) in full. Floating results are rounded in both the Spark query and the
SQL text so the value hashes compare; every computed column is aliased to
the same name on both sides.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

# The package sits next to this file; make it importable wherever the
# driver loads the entry file from.
_ROOT = os.path.dirname(os.path.abspath(__file__))
if _ROOT not in sys.path:
    sys.path.insert(0, _ROOT)

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupcast.constants import CANDIDATE_FEATURES, HOLIDAYS_MM_DD, SEQ_LEN, TRAIN_RATIO, VAL_RATIO

SF_SMOKE = "/root/testdata/sf0.001"


def _r(c: str, nd: int = 6):
    return F.round(F.col(c), nd).alias(c)


def _d(c: str = "date"):
    return F.date_format(F.col(c), "yyyy-MM-dd").alias(c)


# ============================================================== Spark queries
def q_panel_daily(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.operators.panel import build_panel, tpch_panel_rows

    p = build_panel(tpch_panel_rows(spark, sf))
    return p.select("client_id", "item_id", _d(), _r("quantity"), _r("sell_price"))


def q_panel_dense(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.operators.panel import build_panel, densify_calendar, tpch_panel_rows

    d = densify_calendar(build_panel(tpch_panel_rows(spark, sf)))
    return d.select("client_id", "item_id", _d(), _r("quantity"), _r("sell_price"))


def _features(spark, sf, source="tpch"):
    from groupcast.operators.panel import feature_panel

    return feature_panel(spark, sf, source)


def q_panel_features(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf)
    return f.select("client_id", "item_id", _d(), _r("quantity"), *[_r(c) for c in CANDIDATE_FEATURES], _r("target_7d"))


def q_events_features(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf, "events")
    return f.select("client_id", "item_id", _d(), _r("quantity"), *[_r(c) for c in CANDIDATE_FEATURES], _r("target_7d"))


def q_chrono_split(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.plans.selection import split_rows

    s = split_rows(_features(spark, sf))
    return s.select("client_id", "item_id", _d(), F.col("rn").cast("long").alias("rn"), "split", _r("y"))


def q_feature_ranking(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.plans.selection import feature_ranking

    r = feature_ranking(spark, sf)
    return r.select(F.col("rank").cast("long").alias("rank"), "feature", F.round("f_score", 3).alias("f_score"), "selected")


def q_feature_pvalues(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.plans.selection import feature_ranking

    r = feature_ranking(spark, sf)
    return r.select(F.col("rank").cast("long").alias("rank"), "feature", F.round("f_score", 3).alias("f_score"),
                    F.round("p_value", 9).alias("p_value"), "significant", "selected")


def _prep(spark, sf, cols=None, source="tpch"):
    from groupcast.plans.prepare import prepare

    return prepare(_features(spark, sf, source), list(cols or CANDIDATE_FEATURES))


def q_split_summary(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.operators.split import split_summary
    from groupcast.plans.selection import split_rows

    return split_summary(split_rows(_features(spark, sf)))


def q_selection_summary(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.operators.select import selection_summary
    from groupcast.plans.selection import split_rows

    s = selection_summary(split_rows(_features(spark, sf)).filter(F.col("split") == "train"))
    return s.select("total_samples", "num_clients", "min_samples", "max_samples", _r("mean_samples"))


def q_scaler_standard(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.operators.scale import standard_long

    p = _prep(spark, sf)
    return standard_long(p.x_stats, p.feature_cols).select("client_id", "feature", _r("center"), _r("scale"))


def q_scaler_robust(spark: SparkSession, sf: str) -> DataFrame:
    p = _prep(spark, sf)
    return p.y_stats.select("client_id", _r("y_center"), _r("y_scale"), _r("y_q25"), _r("y_q75"))


def q_sequences(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.functions.arrays import array_sum

    p = _prep(spark, sf)
    s = p.sequences.select(
        "client_id", "item_id", "split", _d("target_date"), F.round("y", 6).alias("y"),
        F.round(array_sum("x"), 6).alias("x_sum"), F.round(F.col("x")[0], 6).alias("x_first"),
        F.round(F.element_at("x", -1), 6).alias("x_last"),
    )
    return s


def _naive_client(spark, sf):
    from groupcast.operators.metrics import client_metrics, naive_mae
    from groupcast.plans.prepare import naive_predictions

    p = _prep(spark, sf)
    pred = naive_predictions(p)
    tr = p.targets.filter(F.col("split") == "train").select("client_id", "item_id", F.col("date").alias("target_date"), F.col("y").alias("y_true"))
    return client_metrics(pred, naive_mae(tr))


def q_naive_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = _naive_client(spark, sf)
    return m.select("client_id", "num_samples", *[_r(c) for c in ["mae", "rmse", "smape", "wmape", "mase"]])


def q_naive_strategy(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.operators.metrics import weighted_metrics

    m = _naive_client(spark, sf).withColumn("strategy", F.lit("naive"))
    w = weighted_metrics(m, ["strategy"])
    return w.select("strategy", "num_samples", *[_r(c) for c in ["mae", "rmse", "smape", "wmape", "mase"]])


def _noisy_profiles(spark, sf, split="train"):
    from groupcast.constants import PIPELINE_EPSILON
    from groupcast.operators.profiles import profile_clients

    p = _prep(spark, sf)
    return profile_clients(p.blocks.filter(F.col("split") == split), epsilon=PIPELINE_EPSILON)


def _long(df, col, key="client_id"):
    return df.select(key, F.posexplode(col).alias("pos", "value")).select(
        key, F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


def q_profiles_noisy(spark: SparkSession, sf: str) -> DataFrame:
    return _long(_noisy_profiles(spark, sf), "importance")


def q_importance_gbt(spark: SparkSession, sf: str) -> DataFrame:
    """H2: boosted trees per client, as many and as deep as the original's defaults."""
    from groupcast.operators.profiles import importance_gbt

    i = importance_gbt(_prep(spark, sf).train)
    return i.select("client_id", F.col("pos").cast("long").alias("pos"), _r("importance"))


def q_profile_top3(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.operators.profiles import top_features

    t = top_features(_noisy_profiles(spark, sf), "importance", 3)
    return t.select("client_id", F.col("rank").cast("long").alias("rank"), F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


def _normalised(spark, sf, split="train"):
    from groupcast.operators.cluster import normalise_profiles, with_scope

    return normalise_profiles(with_scope(_noisy_profiles(spark, sf, split)), "importance", "dist")


def q_profiles_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return _long(_normalised(spark, sf), "dist")


def q_profiles_ema(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.operators.cluster import ema_profiles

    old = _normalised(spark, sf, "train")
    new = _normalised(spark, sf, "val")
    return _long(ema_profiles(new, old, 0.8, "dist"), "dist")


def q_emd_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.operators.cluster import emd_pairs

    return emd_pairs(_normalised(spark, sf)).select("client_a", "client_b", F.round("emd", 6).alias("emd"))


def _emb(spark, sf):
    from groupcast.functions.arrays import normalise_distribution
    from groupcast.sources.tables import read_table

    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    return e.select("vec_id", "label", F.lit("all").alias("scope"), normalise_distribution("embedding").alias("dist"))


def q_embedding_emd(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from groupcast.functions.arrays import array_cdf, array_l1

    e = _emb(spark, sf)
    cent = e.groupBy("label").agg(vector_to_array(Summarizer.mean(array_to_vector("dist"))).alias("centroid"))
    j = e.join(cent, "label")
    return j.select("vec_id", "label", F.round(array_l1(array_cdf("dist"), array_cdf("centroid")), 6).alias("emd"))


def q_embedding_dbi(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.operators.cluster import davies_bouldin_df

    d = davies_bouldin_df(_emb(spark, sf), "dist", "label")
    return d.select(F.round("dbi", 6).alias("dbi"), F.col("num_labels").cast("long").alias("num_labels"))


def q_client_clusters(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.constants import MAX_CLUSTERS_PIPELINE
    from groupcast.operators.cluster import cluster_profiles

    return cluster_profiles(_normalised(spark, sf), "dist", max_clusters=MAX_CLUSTERS_PIPELINE)


def q_cluster_record(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.operators.cluster import cluster_record

    return cluster_record(q_client_clusters(spark, sf), "initial_clustering", 0)


def _train_ctx(spark, sf):
    from groupcast.operators.params import init_params

    p = _prep(spark, sf)
    return p, init_params(p.clients, p.dim, 42)


def q_params_init(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.operators.params import params_table

    _, params = _train_ctx(spark, sf)
    t = params_table(params)
    return t.select("client_id", "layer", F.col("pos").cast("long").alias("pos"), F.round("value", 8).alias("value"))


def q_params_average(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.operators.params import average_params, params_table
    from groupcast.operators.blocks import train_counts

    p, params = _train_ctx(spark, sf)
    n = train_counts(p.train)
    avg = average_params(params.join(n, "client_id").withColumn("bubble", F.lit(0)), "bubble", "n")
    t = params_table(avg.withColumnRenamed("bubble", "client_id"))
    return t.select("layer", F.col("pos").cast("long").alias("pos"), F.round("value", 8).alias("value"))


def q_predict_init(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.operators.train import predict

    p, params = _train_ctx(spark, sf)
    pr = predict(p.eval, params, p.y_stats)
    sc = F.greatest(F.col("y_scale"), F.lit(1e-8))
    return pr.select("client_id", "item_id", _d("target_date"),
                     F.round(F.col("p_scaled") * sc + F.col("y_center"), 6).alias("y_pred"),
                     F.round(F.col("y") * sc + F.col("y_center"), 6).alias("y_true"))


def q_loss_init(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.operators.metrics import huber_smape_loss
    from groupcast.operators.train import predict

    p, params = _train_ctx(spark, sf)
    lo = huber_smape_loss(predict(p.eval, params, p.y_stats), ["client_id"])
    return lo.select("client_id", F.round("loss", 6).alias("loss"), "num_samples")


def q_train_step(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.functions.arrays import array_sum
    from groupcast.operators.train import gradient_step

    p, params = _train_ctx(spark, sf)
    st = gradient_step(p.train, params, p.y_stats, lr=0.001)
    return st.select("client_id", F.round(array_sum("body"), 6).alias("body_sum"), F.round("a", 8).alias("a"),
                     F.round("b", 8).alias("b"), "n")


def q_profiles_raw(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.constants import DEFAULT_EPSILON
    from groupcast.operators.profiles import profile_all_raw
    from groupcast.plans.selection import split_rows

    prof, _ = profile_all_raw(split_rows(_features(spark, sf)), list(CANDIDATE_FEATURES), "y", epsilon=DEFAULT_EPSILON)
    return _long(prof, "importance")


SAMPLE_PER_CLIENT = 500  # the sampling operator's own parameter: the sample is the result


def q_sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    from groupcast.constants import SEED
    from groupcast.operators.split import sample_per_client
    from groupcast.plans.selection import split_rows

    s = sample_per_client(split_rows(_features(spark, sf)), SAMPLE_PER_CLIENT, SEED, ["client_id", "item_id", "date"])
    return s.select("client_id", "item_id", _d(), _r("y"))


def q_split_summary_selected(spark: SparkSession, sf: str) -> DataFrame:
    """E2 as the original reports it: rows complete in the selected
    features (top 12 by the train-only F test) and the target."""
    from groupcast.operators.select import selected_features
    from groupcast.operators.split import split_summary
    from groupcast.plans.selection import feature_ranking, split_rows

    chosen = selected_features(feature_ranking(spark, sf, with_pvalue=False))
    return split_summary(split_rows(_features(spark, sf), chosen))


def _region(col: str = "client_id"):
    return F.substring_index(F.col(col), "_", 1)


def _sent(spark, sf):
    """One averaging round over the regions as bubbles: every client starts from
    its region's average of the initial parameters (K7, C5)."""
    from groupcast.operators.params import average_params, send_params
    from groupcast.operators.blocks import train_counts

    p, params = _train_ctx(spark, sf)
    n = train_counts(p.train)
    assign = p.clients.select("client_id", _region().alias("bubble"))
    averaged = average_params(params.join(n, "client_id").join(assign, "client_id"), "bubble", "n")
    return p, params, n, assign, averaged, send_params(assign, averaged)


def q_params_shared(spark: SparkSession, sf: str) -> DataFrame:
    """The shared layers of the regions' averages."""
    from groupcast.operators.params import params_table, shared_part

    *_, averaged, _ = _sent(spark, sf)
    t = shared_part(params_table(averaged.withColumnRenamed("bubble", "client_id")))
    return t.select(F.col("client_id").alias("bubble"), "layer", F.col("pos").cast("long").alias("pos"), F.round("value", 8).alias("value"))


def q_params_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Own heads under the region's body."""
    from groupcast.operators.params import overlay_params, params_table

    _, params, _, _, _, sent = _sent(spark, sf)
    t = params_table(overlay_params(params, sent))
    return t.select("client_id", "layer", F.col("pos").cast("long").alias("pos"), F.round("value", 8).alias("value"))


def q_fedavg_round(spark: SparkSession, sf: str) -> DataFrame:
    """K9: one round over the regions: send, one full-batch step per client, average."""
    from groupcast.functions.arrays import array_sum
    from groupcast.operators.params import average_params
    from groupcast.operators.train import gradient_step

    p, _, _, assign, _, sent = _sent(spark, sf)
    fitted = gradient_step(p.train, sent, p.y_stats, lr=0.001)
    out = average_params(fitted.join(assign, "client_id"), "bubble", "n")
    return out.select("bubble", F.round(array_sum("body"), 6).alias("body_sum"), F.round("a", 8).alias("a"), F.round("b", 8).alias("b"), "n")


def q_update_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """I14 after one step from the regions' averages."""
    from groupcast.operators.train import gradient_step
    from groupcast.plans.strategies import update_vectors

    p, _, _, assign, averaged, sent = _sent(spark, sf)
    u = update_vectors(gradient_step(p.train, sent, p.y_stats, lr=0.001), assign, averaged)
    rows = u.select("client_id", F.posexplode("importance").alias("pos", "value"))
    return rows.select("client_id", F.col("pos").cast("long").alias("pos"), F.round("value", 8).alias("value"))


def _first_round(spark, sf):
    """A round's context over the regions as bubbles, defaults throughout (3 epochs, mini-batches of 1024)."""
    from groupcast.plans.rounds import RoundLog
    from groupcast.plans.strategies import Context, StrategyConfig

    ctx = Context(_prep(spark, sf))
    return ctx, StrategyConfig(num_rounds=1), RoundLog(spark), ctx.clients.select(
        "client_id", F.pmod(F.xxhash64(_region()), F.lit(2**31 - 1)).cast("int").alias("bubble"))


def q_bubble_round(spark: SparkSession, sf: str) -> DataFrame:
    """K9 (K4, K7, C5, E7, L7): one real averaging round of every bubble through ``fit``, scored on its clients."""
    from groupcast.plans.strategies import run_averaged

    ctx, cfg, log, assign = _first_round(spark, sf)
    records = run_averaged(ctx, cfg, log, assign)
    return records.select("client_id", "bubble", "round", "epochs", "num_samples", "train_samples", *[_r(c) for c in ["rmse", "smape", "mae", "wmape", "mase", "loss"]])


def q_tuned_heads(spark: SparkSession, sf: str) -> DataFrame:
    """K6: the heads after the default epochs of head tuning on the regions' averages of the initial parameters."""
    from groupcast.constants import HEAD_FINETUNE_EPOCHS
    from groupcast.operators.train import fit

    p, *_, sent = _sent(spark, sf)
    tuned = fit(p.train, sent, p.y_stats, HEAD_FINETUNE_EPOCHS, "head")
    return tuned.select("client_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "n")


def _evaluated(spark, sf):
    from groupcast.operators.train import evaluate, naive_from_train

    p, params = _train_ctx(spark, sf)
    return p, evaluate(p.eval, params, p.y_stats, naive_from_train(p.train, p.y_stats))


def q_evaluate_init(spark: SparkSession, sf: str) -> DataFrame:
    """Loss and metrics of the initial parameters."""
    _, m = _evaluated(spark, sf)
    return m.select("client_id", "num_samples", *[_r(c) for c in ["mae", "rmse", "smape", "wmape", "mase", "loss"]])


def _round(spark, sf):
    from groupcast.operators.blocks import train_counts
    from groupcast.sources.records import round_metrics

    p, m = _evaluated(spark, sf)
    n = train_counts(p.train).withColumnRenamed("n", "train_samples")
    return round_metrics(m.join(n, "client_id").withColumns(
        {"strategy": F.lit("initial"), "stage": F.lit("federated"), "round": F.lit(0), "bubble": _region()}))


def q_round_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per region the sample-weighted metrics of the initial parameters."""
    r = _round(spark, sf)
    return r.select("strategy", "stage", "bubble", "num_samples", "train_samples", _r("rmse"), _r("smape"),
                    F.array_join("clients", ",").alias("clients"))


def q_flatten_history(spark: SparkSession, sf: str) -> DataFrame:
    """The nested per-client lists of the rounds, one row per client."""
    from groupcast.sources.records import flatten_history

    f = flatten_history(_round(spark, sf))
    return f.select("strategy", "stage", "bubble", "client_id", "num_samples", "train_samples", _r("rmse"), _r("smape"))


def _two_strategies(spark, sf):
    from groupcast.operators.metrics import strategy_metrics

    _, m = _evaluated(spark, sf)
    cols = ["client_id", "num_samples", "mae", "rmse", "smape", "wmape", "mase"]
    both = m.select(*cols, F.lit("initial").alias("strategy")).unionByName(
        _naive_client(spark, sf).select(*cols, F.lit("naive").alias("strategy")))
    names = spark.createDataFrame([("initial",), ("naive",), ("none",)], "strategy string")
    return strategy_metrics(both, names)


def q_strategy_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """L9 + L11: metrics per strategy; a strategy without records has zeros."""
    from groupcast.sources.records import compare_strategies

    return compare_strategies(_two_strategies(spark, sf)).select("strategy", *[_r(c) for c in ["rmse", "smape", "mae", "wmape", "mase"]])


# ------------------------------------------------ files and records, written and read back
def _folder(spark, name):
    import uuid

    from groupcast.session import checkpoint_folder

    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _client_files(spark, sf, kind):
    """The panel as client files in a shared folder; ``kind`` is a column of it."""
    from groupcast.sources.client_export import write_client_files

    cols = ["item_id", "date", "quantity", *CANDIDATE_FEATURES, "target_7d"]
    folder = _folder(spark, "clients")
    write_client_files(_features(spark, sf).select("client_id", kind.alias("kind"), *cols), folder)
    return folder


def _panel_columns(df):
    return df.select("client_id", "item_id", _d(), _r("quantity"), *[_r(c) for c in CANDIDATE_FEATURES], _r("target_7d"))


def q_clients_sqlite(spark: SparkSession, sf: str) -> DataFrame:
    """The panel through SQLite client files."""
    from groupcast.sources.client_files import read_client_sqlite

    return _panel_columns(read_client_sqlite(spark, _client_files(spark, sf, F.lit("sqlite"))))


def q_clients_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Through CSV pairs with renamed columns."""
    from groupcast.sources.client_files import read_client_csv

    return _panel_columns(read_client_csv(spark, _client_files(spark, sf, F.lit("csv"))))


def q_clients_parquet(spark: SparkSession, sf: str) -> DataFrame:
    """A4: through parquet client files."""
    from groupcast.sources.client_files import read_client_parquet

    return _panel_columns(read_client_parquet(spark, _client_files(spark, sf, F.lit("parquet"))))


def _kind_of_region():
    r = _region()
    return F.when(r.startswith("A"), F.when(r == "ASIA", "csv").otherwise("sqlite")).when(r == "EUROPE", "csv").otherwise("parquet")


def q_client_sources(spark: SparkSession, sf: str) -> DataFrame:
    """A1, A5: which clients have a database, and the source picked for each client."""
    from groupcast.sources.client_files import discover_clients, pick_source, source_listing

    folder = _client_files(spark, sf, _kind_of_region())
    chosen = pick_source(source_listing(spark, folder))
    db = discover_clients(spark, folder).withColumn("has_db", F.lit(True))
    return chosen.join(db, "client_id", "left").select("client_id", "kind", F.coalesce("has_db", F.lit(False)).alias("has_db"))


def q_load_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Clients of three kinds as one panel of complete rows."""
    from groupcast.sources.client_files import load_panel

    p = load_panel(spark, _client_files(spark, sf, _kind_of_region()), list(CANDIDATE_FEATURES))
    return p.select("client_id", "item_id", _d(), *[_r(c) for c in CANDIDATE_FEATURES], _r("y"))


def q_profiles_file(spark: SparkSession, sf: str) -> DataFrame:
    """The profiles through their JSON file."""
    from groupcast.sources.records import read_profiles_json, write_profiles_json

    path = _folder(spark, "profiles")
    write_profiles_json(_noisy_profiles(spark, sf), path)
    return _long(read_profiles_json(spark, path), "importance")


def q_cluster_history(spark: SparkSession, sf: str) -> DataFrame:
    """The last record of an appended history, member by member."""
    from groupcast.constants import MAX_CLUSTERS_PIPELINE
    from groupcast.operators.cluster import cluster_profiles, cluster_record
    from groupcast.session import settle
    from groupcast.sources.records import append_cluster_history, read_cluster_history, read_history_records

    clusters = settle(cluster_profiles(_normalised(spark, sf), "dist", max_clusters=MAX_CLUSTERS_PIPELINE))
    path = _folder(spark, "history")
    append_cluster_history(cluster_record(clusters, "initial_clustering", 0), path, reset=True)
    append_cluster_history(cluster_record(clusters, "dynamic_recluster", 20), path)
    last = read_history_records(spark, path).filter("sequence = 2").select(
        F.lit("all").alias("scope"), "sequence", "stage", "round", "k_star", "total_clients", "num_clusters", "num_isolated_clients",
        F.col("cluster_size_stats.max").alias("largest"))
    members = read_cluster_history(spark, path).withColumn("scope", F.lit("all"))
    return members.join(last, "scope").drop("scope")


def q_clusters_from_file(spark: SparkSession, sf: str) -> DataFrame:
    """The profiles' JSON file clustered."""
    from groupcast.constants import MAX_CLUSTERS_PIPELINE
    from groupcast.plans.clustering import cluster_from_file
    from groupcast.sources.records import write_profiles_json

    path = _folder(spark, "profiles")
    write_profiles_json(_noisy_profiles(spark, sf), path)
    return cluster_from_file(spark, path, MAX_CLUSTERS_PIPELINE)[0]


def q_first_clustering(spark: SparkSession, sf: str) -> DataFrame:
    """I16: profiles of the train blocks, clustered."""
    from groupcast.constants import PIPELINE_EPSILON, SEED
    from groupcast.plans.clustering import first_clustering

    return first_clustering(_prep(spark, sf).train, PIPELINE_EPSILON, SEED)[1]


def q_params_files(spark: SparkSession, sf: str) -> DataFrame:
    """All clients' parameters, and each region's shared part, through their files."""
    from groupcast.sources.records import read_params, write_params

    p, params = _train_ctx(spark, sf)
    path = _folder(spark, "params")
    write_params(params, p.clients.select("client_id", _region().alias("bubble"), F.lit(False).alias("is_isolated")), path)
    cols = ["owner_id", "layer", F.col("pos").cast("long").alias("pos"), F.round("value", 8).alias("value")]
    return read_params(spark, path, "clients").select(F.lit("client").alias("kind"), *cols).unionByName(
        read_params(spark, path, "bubbles").select(F.lit("bubble").alias("kind"), *cols))


def q_metrics_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A10: two metrics tables of unlike shapes through one CSV."""
    from groupcast.sources.records import write_metrics_csv

    m = _naive_client(spark, sf).select("client_id", "num_samples", "mae", "rmse", "smape", "wmape", "mase")
    path = _folder(spark, "metrics")
    total = m.groupBy().agg(F.sum("num_samples").alias("num_samples"), F.count("*").alias("clients"))
    write_metrics_csv([m, total], path)
    got = spark.read.option("header", True).csv(path)
    whole = ["num_samples", "clients"]
    zero = F.lit(0)  # the total has no errors, the clients no count
    return got.select(F.coalesce("client_id", F.lit("total")).alias("client_id"), *[F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in whole],
                      *[F.round(F.coalesce(F.col(c).cast("double"), zero.cast("double")), 6).alias(c) for c in ["mae", "rmse", "smape", "wmape", "mase"]])


def q_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report's line of the strategies."""
    from groupcast.sources.records import render_report

    return render_report(_two_strategies(spark, sf), ["initial", "naive", "none"])


def q_results_record(spark: SparkSession, sf: str) -> DataFrame:
    """The run's results record, strategy by strategy."""
    from groupcast.sources.records import results_record

    r = results_record(spark, "run", _two_strategies(spark, sf))
    return r.select("run_id", "evaluation_split", "metric_weight", F.explode("results").alias("strategy", "m")).select(
        "run_id", "evaluation_split", "metric_weight", "strategy", *[F.round(F.col(f"m.{c}"), 6).alias(c) for c in ["rmse", "smape", "mae", "wmape", "mase"]])


def q_scaler_all_rows(spark: SparkSession, sf: str) -> DataFrame:
    """the scalers fitted on the rows of all splits."""
    from groupcast.operators.scale import fit_robust, fit_standard, standard_long

    p = _prep(spark, sf)
    x = standard_long(fit_standard(p.split, p.feature_cols, "all"), p.feature_cols)
    y = fit_robust(p.split, "y", "all").select("client_id", F.lit("y").alias("feature"), F.col("y_center").alias("center"), F.col("y_scale").alias("scale"))
    return x.unionByName(y).select("client_id", "feature", _r("center"), _r("scale"))


LONG_WINDOW = 1000  # rows: longer than the val and test runs, so clients fall back


def q_sequence_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of LONG_WINDOW rows: per client and set the sequences, and those that stand in for none; and the
    sequences of a client's rows taken as one run."""
    from groupcast.operators.blocks import series_blocks
    from groupcast.plans.prepare import prepare

    p = prepare(_features(spark, sf), list(CANDIDATE_FEATURES)[:2], seq_len=LONG_WINDOW)
    one_run = series_blocks(p.split, ["dayofweek"], "y", LONG_WINDOW, keys=["client_id"]).withColumn("is_fallback", F.lit(False))
    parts = [("train", p.train), ("eval", p.eval), ("one_run", one_run)]
    counted = [d.groupBy("client_id", F.lit(name).alias("part"), "is_fallback").agg(F.sum("n").cast("long").alias("n")) for name, d in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: rank the 16 candidate features by F test on train rows (sf0.001)."""
    return q_feature_pvalues(spark, SF_SMOKE)


def _llm():
    """Queries and SQL of the optional subpackage, if it is there."""
    try:
        from groupcast.llm import queries as llm
    except ImportError:
        return {}, {}
    return llm.queries(), llm.oracle_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        **_llm()[0],
        "panel_daily": q_panel_daily,
        "panel_dense": q_panel_dense,
        "panel_features": q_panel_features,
        "events_features": q_events_features,
        "chrono_split": q_chrono_split,
        "feature_ranking": q_feature_ranking,
        "feature_pvalues": q_feature_pvalues,
        "split_summary": q_split_summary,
        "selection_summary": q_selection_summary,
        "scaler_standard": q_scaler_standard,
        "scaler_robust": q_scaler_robust,
        "sequences": q_sequences,
        "naive_metrics": q_naive_metrics,
        "naive_strategy": q_naive_strategy,
        "profiles_noisy": q_profiles_noisy,
        "profile_top3": q_profile_top3,
        "importance_gbt": q_importance_gbt,
        "profiles_normalised": q_profiles_normalised,
        "profiles_ema": q_profiles_ema,
        "emd_pairs": q_emd_pairs,
        "embedding_emd": q_embedding_emd,
        "embedding_dbi": q_embedding_dbi,
        "client_clusters": q_client_clusters,
        "cluster_record": q_cluster_record,
        "params_init": q_params_init,
        "params_average": q_params_average,
        "predict_init": q_predict_init,
        "loss_init": q_loss_init,
        "train_step": q_train_step,
        "profiles_raw": q_profiles_raw,
        "sample_rows": q_sample_rows,
        "params_shared": q_params_shared,
        "params_overlay": q_params_overlay,
        "fedavg_round": q_fedavg_round,
        "bubble_round": q_bubble_round,
        "tuned_heads": q_tuned_heads,
        "update_vectors": q_update_vectors,
        "evaluate_init": q_evaluate_init,
        "round_metrics": q_round_metrics,
        "flatten_history": q_flatten_history,
        "strategy_comparison": q_strategy_comparison,
        "clients_sqlite": q_clients_sqlite,
        "clients_csv": q_clients_csv,
        "clients_parquet": q_clients_parquet,
        "client_sources": q_client_sources,
        "load_panel": q_load_panel,
        "profiles_file": q_profiles_file,
        "cluster_history": q_cluster_history,
        "clusters_from_file": q_clusters_from_file,
        "first_clustering": q_first_clustering,
        "params_files": q_params_files,
        "metrics_csv": q_metrics_csv,
        "report": q_report,
        "results_record": q_results_record,
        "scaler_all_rows": q_scaler_all_rows,
        "sequence_fallback": q_sequence_fallback,
        "split_summary_selected": q_split_summary_selected,
    }


# ============================================================== DuckDB oracles
_HOL = ", ".join(f"'{h}'" for h in HOLIDAYS_MM_DD)
_T = repr(float(TRAIN_RATIO))
_TV = repr(float(TRAIN_RATIO + VAL_RATIO))

_TPCH_ROWS = """
rows_ AS (
  SELECT r.r_name || '_' || c.c_mktsegment AS client_id, p.p_type AS item_id,
         CAST(o.o_orderdate AS DATE) AS date, l.l_quantity AS quantity,
         l.l_extendedprice / NULLIF(l.l_quantity, 0) AS unit_price
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""

_EVENTS_ROWS = """
rows_ AS (
  SELECT event_type AS client_id, CAST(user_id AS VARCHAR) AS item_id, CAST(ts AS DATE) AS date,
         1.0 AS quantity, CAST(value AS DOUBLE) AS unit_price
  FROM events)"""

_PANEL = """
panel AS (
  SELECT client_id, item_id, date, sum(quantity) AS quantity, avg(unit_price) AS sell_price
  FROM rows_ GROUP BY client_id, item_id, date),
nxt AS (
  SELECT *, lead(date) OVER (PARTITION BY client_id, item_id ORDER BY date) AS nd, max(date) OVER () AS last_day FROM panel),
dense AS (
  SELECT client_id, item_id, CAST(date + CAST(k AS INTEGER) AS DATE) AS date,
         CASE WHEN k = 0 THEN quantity ELSE 0.0 END AS quantity, sell_price
  FROM (SELECT *, unnest(generate_series(0, coalesce(date_diff('day', date, nd) - 1, date_diff('day', date, last_day)))) AS k FROM nxt))"""

_FEATS = f"""
feat AS (
  SELECT client_id, item_id, date, quantity,
    CAST(isodow(date) - 1 AS DOUBLE) AS dayofweek,
    CAST(month(date) AS DOUBLE) AS month,
    CASE WHEN isodow(date) >= 6 THEN 1.0 ELSE 0.0 END AS is_weekend,
    CASE WHEN strftime(date, '%m-%d') IN ({_HOL}) THEN 1.0 ELSE 0.0 END AS is_holiday,
    lag(quantity, 7) OVER w AS lag_7,
    lag(quantity, 14) OVER w AS lag_14,
    lag(quantity, 28) OVER w AS lag_28,
    CASE WHEN count(*) OVER w7 = 7 THEN avg(quantity) OVER w7 END AS rolling_mean_7,
    CASE WHEN count(*) OVER w7 = 7 THEN stddev_samp(quantity) OVER w7 END AS rolling_std_7,
    CASE WHEN count(*) OVER w28 = 28 THEN avg(quantity) OVER w28 END AS rolling_mean_28,
    CASE WHEN count(*) OVER w28 = 28 THEN stddev_samp(quantity) OVER w28 END AS rolling_std_28,
    coalesce((sell_price - lag(sell_price) OVER w) / NULLIF(lag(sell_price) OVER w, 0), 0.0) AS price_change_rate,
    sell_price,
    CAST(weekofyear(date) AS DOUBLE) AS week_of_year,
    CASE WHEN day(date) = 1 THEN 1.0 ELSE 0.0 END AS is_month_start,
    CASE WHEN date = last_day(date) THEN 1.0 ELSE 0.0 END AS is_month_end,
    CASE WHEN count(*) OVER f7 = 7 THEN sum(quantity) OVER f7 END AS target_7d
  FROM dense
  WINDOW w AS (PARTITION BY client_id, item_id ORDER BY date),
         w7 AS (PARTITION BY client_id, item_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
         w28 AS (PARTITION BY client_id, item_id ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING),
         f7 AS (PARTITION BY client_id, item_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING))"""


def _split_cte(cols: list[str]) -> str:
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in cols + ["target_7d"])
    return f"""
complete AS (SELECT *, CAST(target_7d AS DOUBLE) AS y FROM feat WHERE {notnull}),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY client_id, item_id ORDER BY date) AS rn,
         count(*) OVER (PARTITION BY client_id, item_id) AS n_item
  FROM complete),
split AS (
  SELECT *, CASE WHEN rn <= floor(n_item * {_T}::DOUBLE) THEN 'train'
                 WHEN rn <= floor(n_item * {_TV}::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM numbered)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts)


def _base(source: str = "tpch") -> list[str]:
    return [_TPCH_ROWS if source == "tpch" else _EVENTS_ROWS, _PANEL]


def _r6(c: str, nd: int = 6) -> str:
    return f"round({c}, {nd}) AS {c}"


_FEAT_SELECT = ", ".join(["client_id", "item_id", "CAST(date AS VARCHAR) AS date", _r6("quantity")] + [_r6(c) for c in CANDIDATE_FEATURES] + [_r6("target_7d")])


def _fscore_sql(cols: list[str]) -> str:
    aggs = ", ".join(["count(*) AS n", "var_pop(y) AS vy"] + [f"covar_pop({c}, y) AS c{i}, var_pop({c}) AS v{i}" for i, c in enumerate(cols)])
    union = " UNION ALL ".join(f"SELECT '{c}' AS feature, c{i} AS cov, v{i} AS vx, n, vy FROM stats" for i, c in enumerate(cols))
    return f"""
stats AS (SELECT {aggs} FROM split WHERE split = 'train'),
long_ AS ({union}),
scored AS (
  SELECT feature, n,
    CASE WHEN vx * vy = 0 OR vx * vy IS NULL THEN 0.0
         WHEN cov * cov / (vx * vy) >= 1 THEN 1.7976931348623157e308
         ELSE (cov * cov / (vx * vy)) / (1 - cov * cov / (vx * vy)) * (n - 2) END AS f_score
  FROM long_)"""


def _pvalue_sql() -> str:
    """P(F(1, n - 2) > F) of ``scored``: the continued fraction as a recursion over its coefficients."""
    lgamma_ratio = "0.5 * ln(a + 12) - 1 / (8 * (a + 12)) + 1 / (192 * (a + 12) ** 3) - 1 / (640 * (a + 12) ** 5)" + "".join(
        f" - ln((a + {i + 0.5}) / (a + {i}))" for i in range(12))
    return f"""
side AS (SELECT feature, f_score, f_score AS f, n - 2.0 AS nu, (n - 2.0) / 2 AS a FROM scored WHERE f_score > 0 AND f_score < 1e300),
near AS (SELECT *, nu / (nu + f) AS x, f / (nu + f) AS y, nu / (nu + f) < (a + 1) / (a + 2.5) AS low,
                exp({lgamma_ratio} - 0.5 * ln(pi()) + a * ln(nu / (nu + f)) + 0.5 * ln(f / (nu + f))) AS front FROM side),
args AS (SELECT feature, low, front, CASE WHEN low THEN a ELSE 0.5 END AS p, CASE WHEN low THEN 0.5 ELSE a END AS q, CASE WHEN low THEN x ELSE y END AS z,
                400 + CASE WHEN low THEN ceil(24 * sqrt(nu / f)) ELSE 0 END AS steps FROM near),
frac AS (
  SELECT feature, low, front, p, q, z, steps, 1 AS k, 1.0::DOUBLE AS c, 1 / (1 - (p + q) * z / (p + 1)) AS d, 1 / (1 - (p + q) * z / (p + 1)) AS h FROM args
  UNION ALL
  SELECT feature, low, front, p, q, z, steps, k + 1, 1 + co / c, 1 / (1 + co * d), h * (1 + co / c) / (1 + co * d)
  FROM (SELECT *, CASE WHEN (k + 1) % 2 = 0
                       THEN ((k + 1) // 2) * (q - (k + 1) // 2) * z / ((p + 2 * ((k + 1) // 2) - 1) * (p + 2 * ((k + 1) // 2)))
                       ELSE -(p + (k + 1) // 2) * (p + q + (k + 1) // 2) * z / ((p + 2 * ((k + 1) // 2)) * (p + 2 * ((k + 1) // 2) + 1)) END AS co
        FROM frac WHERE k < steps) z_),
tail AS (SELECT feature, CASE WHEN low THEN front * h / p ELSE 1 - front * h / p END AS p_value FROM frac WHERE k = steps),
tested AS (SELECT s.feature, s.f_score, coalesce(t.p_value, CASE WHEN s.f_score > 0 THEN 0.0 ELSE 1.0 END) AS p_value
           FROM scored s LEFT JOIN tail t ON t.feature = s.feature)"""


def _scaled_cte(cols: list[str]) -> str:
    xa = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(cols))
    xs = ", ".join(f"(s.{c} - x.m{i}) / CASE WHEN x.s{i} = 0 OR x.s{i} IS NULL THEN 1.0 ELSE x.s{i} END AS {c}" for i, c in enumerate(cols))
    rowsum = " + ".join(cols)
    return f"""
xstats AS (SELECT client_id, {xa} FROM split WHERE split = 'train' GROUP BY client_id),
ystats AS (
  SELECT client_id, quantile_cont(y, 0.5) AS y_center,
         CASE WHEN quantile_cont(y, 0.75) - quantile_cont(y, 0.25) = 0 THEN 1.0
              ELSE quantile_cont(y, 0.75) - quantile_cont(y, 0.25) END AS y_scale,
         quantile_cont(y, 0.25) AS y_q25, quantile_cont(y, 0.75) AS y_q75
  FROM split WHERE split = 'train' GROUP BY client_id),
scaled AS (
  SELECT s.client_id, s.item_id, s.split, s.date, s.rolling_mean_7 AS raw_rm7, {xs},
         (s.y - r.y_center) / r.y_scale AS ys, s.y AS y_raw
  FROM split s JOIN xstats x ON s.client_id = x.client_id JOIN ystats r ON s.client_id = r.client_id),
seqs AS (
  SELECT client_id, item_id, split, date AS target_date, ys AS y, y_raw, raw_rm7,
         count(*) OVER wq AS cnt, sum({rowsum}) OVER wq AS x_sum,
         first_value({cols[0]}) OVER wq AS x_first, last_value({cols[-1]}) OVER wq AS x_last
  FROM scaled
  WINDOW wq AS (PARTITION BY client_id, item_id, split ORDER BY date ROWS BETWEEN {SEQ_LEN} PRECEDING AND 1 PRECEDING)),
valid AS (SELECT * FROM seqs WHERE cnt = {SEQ_LEN})"""


_NAIVE = """
counts AS (SELECT client_id, sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS n_test FROM valid GROUP BY client_id),
ev AS (SELECT v.* FROM valid v JOIN counts c ON v.client_id = c.client_id
       WHERE v.split = CASE WHEN c.n_test > 0 THEN 'test' ELSE 'val' END),
naive AS (
  SELECT client_id, CASE WHEN count(*) > 1 THEN greatest(sum(d) / (count(*) - 1), 1e-8) ELSE 1e-8 END AS naive_mae
  FROM (SELECT client_id, abs(y_raw - lag(y_raw) OVER (PARTITION BY client_id ORDER BY item_id, target_date)) AS d
        FROM valid WHERE split = 'train') t GROUP BY client_id),
pm AS (
  SELECT e.client_id, count(*) AS num_samples,
         avg(abs(7.0 * raw_rm7 - y_raw)) AS mae,
         sqrt(avg((7.0 * raw_rm7 - y_raw) * (7.0 * raw_rm7 - y_raw))) AS rmse,
         100.0 * avg(2.0 * abs(7.0 * raw_rm7 - y_raw) / (abs(y_raw) + abs(7.0 * raw_rm7) + 1e-8)) AS smape,
         sum(abs(7.0 * raw_rm7 - y_raw)) / (sum(abs(y_raw)) + 1e-8) AS wmape
  FROM ev e GROUP BY e.client_id),
cm AS (SELECT pm.*, pm.mae / coalesce(n.naive_mae, 1e-8) AS mase FROM pm LEFT JOIN naive n ON pm.client_id = n.client_id)"""

_M5 = ["mae", "rmse", "smape", "wmape", "mase"]


def _split_summary_sql() -> str:
    L = SEQ_LEN
    return f"""
per AS (SELECT client_id, item_id, split, count(*) AS n, greatest(count(*) - {L}, 0) AS seqs FROM split GROUP BY client_id, item_id, split),
agg AS (
  SELECT client_id, sum(n) AS raw_rows,
    sum(CASE WHEN split = 'train' THEN n ELSE 0 END) AS train_rows,
    sum(CASE WHEN split = 'val' THEN n ELSE 0 END) AS val_rows,
    sum(CASE WHEN split = 'test' THEN n ELSE 0 END) AS test_rows,
    sum(CASE WHEN split = 'train' THEN seqs ELSE 0 END) AS tr_s,
    sum(CASE WHEN split = 'val' THEN seqs ELSE 0 END) AS val_sequences,
    sum(CASE WHEN split = 'test' THEN seqs ELSE 0 END) AS te_s,
    count(DISTINCT item_id) AS num_items
  FROM per GROUP BY client_id)"""


def _profile_sql(cols: list[str], split: str, tag: str, eps: float, clip: float = 0.15, seed: int = 42) -> str:
    vec = "[" + ", ".join(cols) + "]"
    scale = repr(clip / eps)
    return f"""
rv_{tag} AS (SELECT client_id, item_id, split, date, ys, {vec} AS v FROM scaled),
sx_{tag} AS (
  SELECT client_id, split, ys AS y, flatten(list(v) OVER wq) AS x, count(*) OVER wq AS cnt FROM rv_{tag}
  WINDOW wq AS (PARTITION BY client_id, item_id, split ORDER BY date ROWS BETWEEN {SEQ_LEN} PRECEDING AND 1 PRECEDING)),
ex_{tag} AS (SELECT client_id, y, unnest(x) AS xv, unnest(range(len(x))) AS pos FROM sx_{tag} WHERE cnt = {SEQ_LEN} AND split = '{split}'),
st_{tag} AS (SELECT client_id, pos, covar_pop(xv, y) AS c, var_pop(xv) AS vx, var_pop(y) AS vy FROM ex_{tag} GROUP BY client_id, pos),
r2_{tag} AS (SELECT client_id, pos, CASE WHEN vx * vy > 0 THEN least(c * c / (vx * vy), 1.0) ELSE 0.0 END AS r2 FROM st_{tag}),
imp_{tag} AS (
  SELECT client_id, pos, CASE WHEN sum(r2) OVER (PARTITION BY client_id) > 0 THEN r2 / sum(r2) OVER (PARTITION BY client_id)
                              ELSE r2 END AS imp FROM r2_{tag}),
nrm_{tag} AS (SELECT client_id, sqrt(sum(imp * imp)) AS nv FROM imp_{tag} GROUP BY client_id),
clip_{tag} AS (
  SELECT i.client_id, i.pos, CASE WHEN n.nv > {clip} THEN i.imp * ({clip} / n.nv) ELSE i.imp END AS v
  FROM imp_{tag} i JOIN nrm_{tag} n ON i.client_id = n.client_id),
noisy_{tag} AS (
  SELECT client_id, pos, v + (-{scale} * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5))) AS value
  FROM (SELECT *, (CAST(('0x' || substr(md5(client_id || '|' || CAST(pos AS VARCHAR) || '|' || '{seed}'), 1, 8)) AS BIGINT) + 0.5)
                  / 4294967296.0 AS u FROM clip_{tag}) t),
pp_{tag} AS (SELECT client_id, pos, greatest(value, 0.0) AS p FROM noisy_{tag}),
tot_{tag} AS (SELECT client_id, sum(p) AS s, count(*) AS d FROM pp_{tag} GROUP BY client_id),
norm_{tag} AS (
  SELECT a.client_id, a.pos, CASE WHEN t.s > 0 THEN a.p / t.s ELSE 1.0 / t.d END AS value
  FROM pp_{tag} a JOIN tot_{tag} t ON a.client_id = t.client_id)"""


_EMB = """
eb AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings),
ebp AS (SELECT vec_id, label, pos, greatest(CAST(v AS DOUBLE), 0.0) AS p FROM eb),
ebt AS (SELECT vec_id, sum(p) AS s, count(*) AS d FROM ebp GROUP BY vec_id),
en AS (SELECT a.vec_id, a.label, a.pos, CASE WHEN t.s > 0 THEN a.p / t.s ELSE 1.0 / t.d END AS val
       FROM ebp a JOIN ebt t ON a.vec_id = t.vec_id),
cent AS (SELECT label, pos, avg(val) AS c FROM en GROUP BY label, pos)"""


def _train_sql(cols: list[str], seed: int = 42) -> str:
    dim = SEQ_LEN * len(cols)
    vec = "[" + ", ".join(cols) + "]"

    def u(key: str, pos: str) -> str:
        return (f"((CAST(('0x' || substr(md5(client_id || '|{key}|' || CAST({pos} AS VARCHAR) || '|{seed}'), 1, 8)) AS BIGINT)"
                " + 0.5) / 4294967296.0)")

    return f"""
seqx AS (
  SELECT client_id, item_id, split, date AS target_date, ys AS y, flatten(list({vec}) OVER wq) AS x, count(*) OVER wq AS cnt
  FROM scaled WINDOW wq AS (PARTITION BY client_id, item_id, split ORDER BY date ROWS BETWEEN {SEQ_LEN} PRECEDING AND 1 PRECEDING)),
sq AS (SELECT * FROM seqx WHERE cnt = {SEQ_LEN}),
cnts AS (SELECT client_id, sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS n_test FROM sq GROUP BY client_id),
evs AS (SELECT s.* FROM sq s JOIN cnts c ON s.client_id = c.client_id
        WHERE s.split = CASE WHEN c.n_test > 0 THEN 'test' ELSE 'val' END),
trs AS (SELECT * FROM sq WHERE split = 'train'),
cl AS (SELECT DISTINCT client_id FROM split),
pw AS (SELECT client_id, pos, (2 * {u('body.w', 'pos')} - 1) * (1.0 / sqrt({dim})) AS w
       FROM (SELECT client_id, unnest(range({dim})) AS pos FROM cl) t),
ph AS (SELECT client_id, 2 * {u('head.a', '0')} - 1 AS a, 2 * {u('head.b', '0')} - 1 AS b FROM cl),
evx AS (SELECT client_id, item_id, target_date, y, unnest(x) AS xv, unnest(range(len(x))) AS pos FROM evs),
evsc AS (SELECT e.client_id, e.item_id, e.target_date, e.y, sum(e.xv * w.w) AS score FROM evx e
         JOIN pw w ON e.client_id = w.client_id AND e.pos = w.pos GROUP BY e.client_id, e.item_id, e.target_date, e.y),
evp AS (SELECT s.*, h.a * s.score + h.b AS p, r.y_center AS c, greatest(r.y_scale, 1e-8) AS sc FROM evsc s
        JOIN ph h ON s.client_id = h.client_id JOIN ystats r ON s.client_id = r.client_id),
trx AS (SELECT client_id, item_id, target_date, y, unnest(x) AS xv, unnest(range(len(x))) AS pos FROM trs),
trsc AS (SELECT e.client_id, e.item_id, e.target_date, e.y, sum(e.xv * w.w) AS score FROM trx e
         JOIN pw w ON e.client_id = w.client_id AND e.pos = w.pos GROUP BY e.client_id, e.item_id, e.target_date, e.y),
trp AS (SELECT s.*, h.a, h.a * s.score + h.b AS p, r.y_center AS c, greatest(r.y_scale, 1e-8) AS sc FROM trsc s
        JOIN ph h ON s.client_id = h.client_id JOIN ystats r ON s.client_id = r.client_id),
trg AS (SELECT *, greatest(-1.0, least(1.0, p - y))
          + 0.1 * 2.0 * (sign((p * sc + c) - (y * sc + c)) * (abs(y * sc + c) + abs(p * sc + c) + 1e-8)
                         - abs((p * sc + c) - (y * sc + c)) * sign(p * sc + c))
                / ((abs(y * sc + c) + abs(p * sc + c) + 1e-8) * (abs(y * sc + c) + abs(p * sc + c) + 1e-8)) * sc AS g
        FROM trp),
gw AS (SELECT t.client_id, x.pos, avg(t.g * t.a * x.xv) AS gb FROM trg t JOIN trx x
       ON t.client_id = x.client_id AND t.item_id = x.item_id AND t.target_date = x.target_date GROUP BY t.client_id, x.pos),
gh AS (SELECT client_id, avg(g * score) AS ga, avg(g) AS gbias, count(*) AS n FROM trg GROUP BY client_id)"""


def _region_start(sql: str) -> str:
    """The same SQL from the regions' averages of the initial parameters."""
    start = """
trn AS (SELECT client_id, split_part(client_id, '_', 1) AS bubble, count(*) AS n FROM trs GROUP BY client_id),
pwa AS (SELECT bubble, pos, sum(w * n) / sum(n) AS w FROM pw0 JOIN trn ON pw0.client_id = trn.client_id GROUP BY bubble, pos),
pha AS (SELECT bubble, sum(a * n) / sum(n) AS a, sum(b * n) / sum(n) AS b FROM ph0 JOIN trn ON ph0.client_id = trn.client_id GROUP BY bubble),
pw AS (SELECT c.client_id, a.pos, a.w FROM cl c JOIN pwa a ON a.bubble = split_part(c.client_id, '_', 1)),
ph AS (SELECT c.client_id, a.a, a.b FROM cl c JOIN pha a ON a.bubble = split_part(c.client_id, '_', 1)),
evx AS ("""
    return sql.replace("pw AS (", "pw0 AS (").replace("ph AS (", "ph0 AS (").replace("evx AS (", start.strip("\n"))


_CLUSTERS = """
cdf AS (SELECT client_id, pos, sum(value) OVER (PARTITION BY client_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
        FROM norm_t),
idx AS (SELECT client_id, row_number() OVER (ORDER BY client_id) AS i FROM (SELECT DISTINCT client_id FROM norm_t) t),
emd AS (SELECT a.client_id AS ca, b.client_id AS cb, sum(abs(a.c - b.c)) AS d FROM cdf a JOIN cdf b ON a.pos = b.pos AND a.client_id < b.client_id
        GROUP BY a.client_id, b.client_id),
pairs AS (SELECT x.i AS i, y.i AS j, d FROM emd JOIN idx x ON x.client_id = ca JOIN idx y ON y.client_id = cb),
dist2 AS (SELECT i, j, d FROM pairs UNION ALL SELECT j, i, d FROM pairs),
cnt AS (SELECT count(*) AS n FROM idx),
lk(k, labels) AS (
  SELECT CAST(n AS BIGINT), CAST(range(1, n + 1) AS BIGINT[]) FROM cnt
  UNION ALL
  SELECT k - 1, list_transform(labels, lambda x: CASE WHEN x = m.b THEN m.a ELSE x END)
  FROM (SELECT k, labels, arg_min(struct_pack(a := a, b := b), struct_pack(d := d, a := a, b := b)) AS m
        FROM (SELECT k, labels, least(labels[i], labels[j]) AS a, greatest(labels[i], labels[j]) AS b, avg(d) AS d
              FROM lk, pairs WHERE k > 2 AND labels[i] <> labels[j] GROUP BY ALL) z GROUP BY k, labels) y),
cand AS (SELECT k, labels, unnest(labels) AS lab, unnest(range(1, len(labels) + 1)) AS i FROM lk, cnt
         WHERE k BETWEEN 2 AND greatest(2, least(n - 1, {most}))),
cvec AS (SELECT c.k, c.lab, c.i, v.pos, v.value FROM cand c JOIN idx x ON x.i = c.i JOIN norm_t v ON v.client_id = x.client_id),
ccen AS (SELECT k, lab, pos, avg(value) AS c FROM cvec GROUP BY k, lab, pos),
cspr AS (SELECT k, lab, avg(d) AS s FROM (SELECT v.k, v.lab, v.i, sqrt(sum((v.value - c.c) * (v.value - c.c))) AS d FROM cvec v
         JOIN ccen c ON c.k = v.k AND c.lab = v.lab AND c.pos = v.pos GROUP BY v.k, v.lab, v.i) t GROUP BY k, lab),
cgap AS (SELECT a.k, a.lab AS la, b.lab AS lb, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS m FROM ccen a
         JOIN ccen b ON a.k = b.k AND a.pos = b.pos AND a.lab <> b.lab GROUP BY a.k, a.lab, b.lab),
cdbi AS (SELECT k, avg(r) AS dbi FROM (SELECT g.k, g.la, max(CASE WHEN g.m > 0 THEN (x.s + y.s) / g.m ELSE 0.0 END) AS r FROM cgap g
         JOIN cspr x ON x.k = g.k AND x.lab = g.la JOIN cspr y ON y.k = g.k AND y.lab = g.lb GROUP BY g.k, g.la) t GROUP BY k),
csin AS (SELECT k, sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS singles FROM (SELECT k, lab, count(*) AS c FROM cand GROUP BY k, lab) t GROUP BY k),
best AS (SELECT d.k FROM cdbi d JOIN csin s ON d.k = s.k
         ORDER BY d.dbi + 0.03 * greatest(0, d.k - 2) + 0.15 * s.singles, d.k LIMIT 1),
lim AS (SELECT avg(d) + 0.75 * stddev_pop(d) AS lim FROM pairs WHERE d > 0),
walk(t, labels) AS (
  SELECT CAST(1 AS BIGINT), labels FROM lk WHERE k = (SELECT k FROM best)
  UNION ALL
  SELECT t + 1, CASE WHEN len(list_filter(labels, lambda x: x = labels[t])) = 1 AND m.d <= (SELECT lim FROM lim)
                     THEN list_concat(list_concat(labels[1:t - 1], [m.c]), labels[t + 1:]) ELSE labels END
  FROM (SELECT t, labels, min(struct_pack(d := d, c := c)) AS m
        FROM (SELECT t, labels, labels[b.j] AS c, avg(b.d) AS d FROM walk, dist2 b WHERE t <= len(labels) AND b.i = t
              AND labels[b.j] <> labels[t] GROUP BY ALL) z GROUP BY t, labels) y),
fin AS (SELECT unnest(labels) AS lab, unnest(range(1, len(labels) + 1)) AS i FROM walk ORDER BY t DESC LIMIT (SELECT n FROM cnt)),
grp AS (SELECT lab, min(i) AS first, count(*) AS size FROM fin GROUP BY lab),
num AS (SELECT lab, size, dense_rank() OVER (ORDER BY first) - 1 AS cluster_id FROM grp)"""


_EVALUATED = """
trn AS (SELECT client_id, count(*) AS train_samples FROM trs GROUP BY client_id),
naive AS (
  SELECT client_id, CASE WHEN count(*) > 1 THEN greatest(sum(d) / (count(*) - 1), 1e-8) ELSE 1e-8 END AS naive_mae
  FROM (SELECT client_id, abs(y_raw - lag(y_raw) OVER (PARTITION BY client_id ORDER BY item_id, target_date)) AS d
        FROM valid WHERE split = 'train') t GROUP BY client_id),
evu AS (SELECT client_id, p - y AS es, p * sc + c AS pu, y * sc + c AS tu FROM evp),
evm0 AS (
  SELECT client_id, count(*) AS num_samples, avg(abs(pu - tu)) AS mae, sqrt(avg((pu - tu) * (pu - tu))) AS rmse,
         100.0 * avg(2.0 * abs(pu - tu) / (abs(tu) + abs(pu) + 1e-8)) AS smape, sum(abs(pu - tu)) / (sum(abs(tu)) + 1e-8) AS wmape,
         avg(CASE WHEN abs(es) <= 1 THEN 0.5 * es * es ELSE abs(es) - 0.5 END)
           + 0.1 * avg(2.0 * abs(pu - tu) / (abs(tu) + abs(pu) + 1e-8)) AS loss
  FROM evu GROUP BY client_id),
evm AS (SELECT e.*, t.train_samples, e.mae / coalesce(n.naive_mae, 1e-8) AS mase FROM evm0 e
        LEFT JOIN naive n ON e.client_id = n.client_id LEFT JOIN trn t ON e.client_id = t.client_id)"""


def _sample_sql(n: int, seed: int = 42) -> str:
    key = f"client_id || '|' || item_id || '|' || CAST(date AS VARCHAR) || '|{seed}'"
    return f"""
hs AS (SELECT *, (CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0 AS u FROM split),
samp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY u, client_id, item_id, date) AS rk FROM hs) z
         WHERE rk <= {n})"""


def _raw_profile_sql(cols: list[str], eps: float, clip: float = 0.15, seed: int = 42) -> str:
    vec = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in cols) + "]"
    return f"""
rx AS (SELECT client_id, y, unnest({vec}) AS xv, unnest(range({len(cols)})) AS pos FROM split),
rst AS (SELECT client_id, pos, covar_pop(xv, y) AS c, var_pop(xv) AS vx, var_pop(y) AS vy FROM rx GROUP BY client_id, pos),
rr2 AS (SELECT client_id, pos, CASE WHEN vx * vy > 0 THEN least(c * c / (vx * vy), 1.0) ELSE 0.0 END AS r2 FROM rst),
rimp AS (SELECT client_id, pos, CASE WHEN sum(r2) OVER (PARTITION BY client_id) > 0 THEN r2 / sum(r2) OVER (PARTITION BY client_id)
                                     ELSE r2 END AS imp FROM rr2),
rnrm AS (SELECT client_id, sqrt(sum(imp * imp)) AS nv FROM rimp GROUP BY client_id),
rclip AS (SELECT i.client_id, i.pos, CASE WHEN n.nv > {clip} THEN i.imp * ({clip} / n.nv) ELSE i.imp END AS v
          FROM rimp i JOIN rnrm n ON i.client_id = n.client_id),
rnoisy AS (
  SELECT client_id, pos, v + (-{repr(clip / eps)} * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5))) AS value
  FROM (SELECT *, (CAST(('0x' || substr(md5(client_id || '|' || CAST(pos AS VARCHAR) || '|' || '{seed}'), 1, 8)) AS BIGINT) + 0.5)
                  / 4294967296.0 AS u FROM rclip) t)"""


def _selected_split_sql(cols: list[str], top_k: int = 12) -> str:
    flags = ", ".join(f"max(CASE WHEN feature = '{c}' AND rk <= {top_k} THEN 1 ELSE 0 END) AS s_{c}" for c in cols)
    cond = " AND ".join(f"(sel.s_{c} = 0 OR f.{c} IS NOT NULL)" for c in cols)
    return f"""
ranked AS (SELECT feature, row_number() OVER (ORDER BY f_score DESC, feature) AS rk FROM scored),
sel AS (SELECT {flags} FROM ranked),
complete2 AS (SELECT f.*, CAST(f.target_7d AS DOUBLE) AS y FROM feat f, sel WHERE f.target_7d IS NOT NULL AND {cond}),
numbered2 AS (
  SELECT *, row_number() OVER (PARTITION BY client_id, item_id ORDER BY date) AS rn,
         count(*) OVER (PARTITION BY client_id, item_id) AS n_item
  FROM complete2),
split2 AS (
  SELECT *, CASE WHEN rn <= floor(n_item * {_T}::DOUBLE) THEN 'train'
                 WHEN rn <= floor(n_item * {_TV}::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM numbered2)"""


def oracle_sql() -> dict[str, str]:
    # ``0.0 + round(..)`` turns DuckDB's -0.0 into 0.0, as Spark's round does.
    own = {k: v.replace("round(", "0.0 + round(") for k, v in _oracle_sql().items()}
    return {**own, **_llm()[1]}


def _oracle_sql() -> dict[str, str]:
    from groupcast.constants import MAX_CLUSTERS_PIPELINE, PIPELINE_EPSILON

    c16 = list(CANDIDATE_FEATURES)
    prof = [*_base(), _FEATS, _split_cte(c16), _scaled_cte(c16), _profile_sql(c16, "train", "t", PIPELINE_EPSILON)]
    tr = [*_base(), _FEATS, _split_cte(c16), _scaled_cte(c16), _train_sql(c16)]
    tr_region = [*tr[:-1], _region_start(_train_sql(c16))]
    metrics = ["rmse", "smape", "mae", "wmape", "mase"]
    strategies = _with(*tr, _EVALUATED, _NAIVE.replace("naive AS (", "naive0 AS (").replace("LEFT JOIN naive n", "LEFT JOIN naive0 n"),
                       "res AS (SELECT strategy, " + ", ".join(f"sum({m} * num_samples) / sum(num_samples) AS {m}" for m in metrics)
                       + " FROM (SELECT 'initial' AS strategy, num_samples, rmse, smape, mae, wmape, mase FROM evm"
                       " UNION ALL SELECT 'naive', num_samples, rmse, smape, mae, wmape, mase FROM cm) z GROUP BY strategy"
                       " UNION ALL SELECT 'none', 0.0, 0.0, 0.0, 0.0, 0.0)")
    panel = _with(*_base(), _FEATS) + f" SELECT {_FEAT_SELECT} FROM feat"
    kind = ("CASE WHEN client_id LIKE 'ASIA%' OR client_id LIKE 'EUROPE%' THEN 'csv' WHEN client_id LIKE 'A%' THEN 'sqlite' ELSE 'parquet' END")
    clusters = (
        _with(*prof, _CLUSTERS.replace("{most}", str(MAX_CLUSTERS_PIPELINE)),
              "found AS (SELECT x.client_id, n.cluster_id, n.size, (SELECT count(*) FROM num) AS k_star, c.n AS n_clients"
              " FROM fin f JOIN idx x ON x.i = f.i JOIN num n ON n.lab = f.lab, cnt c)").replace("WITH ", "WITH RECURSIVE ", 1))
    assigned = (clusters + " SELECT 'all' AS scope, client_id, CAST(cluster_id AS INTEGER) AS cluster_id, CAST(size AS INTEGER) AS cluster_size,"
                " size = 1 AS is_isolated, CAST(k_star AS INTEGER) AS k_star, CAST(n_clients AS INTEGER) AS n_clients FROM found")
    all_stats = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(c16))
    params = ("SELECT client_id, 'body.w' AS layer, CAST(pos AS BIGINT) AS pos, w AS value FROM pw"
              " UNION ALL SELECT client_id, 'head.a', 0, a FROM ph UNION ALL SELECT client_id, 'head.b', 0, b FROM ph")
    return {
        "clients_sqlite": panel,
        "clients_csv": panel,
        "clients_parquet": panel,
        "client_sources": _with(*_base()) + f" SELECT DISTINCT client_id, {kind} AS kind, {kind} = 'sqlite' AS has_db FROM panel",
        "load_panel": _with(*_base(), _FEATS, _split_cte(c16)) + " SELECT client_id, item_id, CAST(date AS VARCHAR) AS date, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in c16) + ", round(y, 6) AS y FROM split",
        "profiles_file": _with(*prof) + " SELECT client_id, pos, round(value, 6) AS value FROM noisy_t",
        "clusters_from_file": assigned,
        "first_clustering": assigned,
        "cluster_history": clusters.rstrip() + ", many AS (SELECT cluster_id, row_number() OVER (ORDER BY min(client_id)) - 1 AS bubble FROM found"
        " WHERE size > 1 GROUP BY cluster_id)"
        " SELECT f.client_id, CAST(m.bubble AS INTEGER) AS bubble, f.size = 1 AS is_isolated, 2 AS sequence, 'dynamic_recluster' AS stage, 20 AS round,"
        " CAST(f.k_star AS INTEGER) AS k_star, CAST(f.n_clients AS INTEGER) AS total_clients, CAST(f.k_star AS INTEGER) AS num_clusters,"
        " CAST((SELECT count(*) FROM found WHERE size = 1) AS INTEGER) AS num_isolated_clients, CAST((SELECT max(size) FROM found) AS INTEGER) AS largest"
        " FROM found f LEFT JOIN many m ON m.cluster_id = f.cluster_id",
        "params_files": _with(*tr, f"pl AS ({params})", "rep AS (SELECT split_part(client_id, '_', 1) AS bubble, min(client_id) AS client_id FROM ph GROUP BY 1)")
        + " SELECT 'client' AS kind, client_id AS owner_id, layer, pos, round(value, 8) AS value FROM pl"
        " UNION ALL SELECT 'bubble', rep.bubble, layer, pos, round(value, 8) FROM pl JOIN rep ON rep.client_id = pl.client_id WHERE layer = 'body.w'",
        "metrics_csv": _with(*_base(), _FEATS, _split_cte(c16), _scaled_cte(c16), _NAIVE)
        + " SELECT client_id, CAST(num_samples AS BIGINT) AS num_samples, CAST(0 AS BIGINT) AS clients, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in ["mae", "rmse", "smape", "wmape", "mase"]) + " FROM cm"
        " UNION ALL SELECT 'total', CAST(sum(num_samples) AS BIGINT), count(*), 0.0, 0.0, 0.0, 0.0, 0.0 FROM cm",
        "report": strategies + " SELECT format('{} | rmse {:.4f} | smape {:.4f} | mae {:.4f} | wmape {:.4f} | mase {:.4f}', strategy, rmse, smape, mae, wmape, mase) AS line FROM res",
        "results_record": strategies + " SELECT 'run' AS run_id, 'test' AS evaluation_split, 'evaluation sequence count' AS metric_weight, strategy, "
        + ", ".join(f"round({m}, 6) AS {m}" for m in metrics) + " FROM res",
        "scaler_all_rows": _with(*_base(), _FEATS, _split_cte(c16), f"st AS (SELECT client_id, {all_stats}, quantile_cont(y, 0.5) AS q2,"
                                 " quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr FROM split GROUP BY client_id)")
        + " " + " UNION ALL ".join(f"SELECT client_id, '{c}' AS feature, round(m{i}, 6) AS center, round(CASE WHEN s{i} = 0 THEN 1.0 ELSE s{i} END, 6) AS scale FROM st"
                                   for i, c in enumerate(c16))
        + " UNION ALL SELECT client_id, 'y', round(q2, 6), round(CASE WHEN iqr = 0 THEN 1.0 ELSE iqr END, 6) FROM st",
        "sequence_fallback": _with(*_base(), _FEATS, _split_cte(c16[:2]),
                                   f"runs AS (SELECT client_id, split, greatest(count(*) - {LONG_WINDOW}, 0) AS s FROM split GROUP BY client_id, item_id, split)",
                                   "per AS (SELECT client_id, coalesce(sum(s) FILTER (WHERE split = 'train'), 0) AS tr, coalesce(sum(s) FILTER (WHERE split = 'val'), 0) AS va,"
                                   " coalesce(sum(s) FILTER (WHERE split = 'test'), 0) AS te FROM runs GROUP BY client_id)")
        + " SELECT client_id, 'train' AS part, tr = 0 AS is_fallback, CAST(CASE WHEN tr = 0 THEN 1 ELSE tr END AS BIGINT) AS n FROM per"
        " UNION ALL SELECT client_id, 'eval', te = 0 AND va = 0, CAST(CASE WHEN te > 0 THEN te WHEN va > 0 THEN va ELSE 1 END AS BIGINT) FROM per"
        f" UNION ALL SELECT client_id, 'one_run', false, CAST(count(*) - {LONG_WINDOW} AS BIGINT) FROM split GROUP BY client_id HAVING count(*) > {LONG_WINDOW}",
        "panel_daily": _with(_TPCH_ROWS, _PANEL) + " SELECT client_id, item_id, CAST(date AS VARCHAR) AS date, round(quantity, 6) AS quantity, round(sell_price, 6) AS sell_price FROM panel",
        "panel_dense": _with(_TPCH_ROWS, _PANEL) + " SELECT client_id, item_id, CAST(date AS VARCHAR) AS date, round(quantity, 6) AS quantity, round(sell_price, 6) AS sell_price FROM dense",
        "panel_features": _with(*_base(), _FEATS) + f" SELECT {_FEAT_SELECT} FROM feat",
        "events_features": _with(*_base("events"), _FEATS) + f" SELECT {_FEAT_SELECT} FROM feat",
        "chrono_split": _with(*_base(), _FEATS, _split_cte(c16)) + " SELECT client_id, item_id, CAST(date AS VARCHAR) AS date, rn, split, round(y, 6) AS y FROM split",
        "feature_ranking": _with(*_base(), _FEATS, _split_cte(c16), _fscore_sql(c16))
        + " SELECT row_number() OVER (ORDER BY f_score DESC, feature) AS rank, feature, round(f_score, 3) AS f_score,"
        " row_number() OVER (ORDER BY f_score DESC, feature) <= 12 AS selected FROM scored",
        "feature_pvalues": _with(*_base(), _FEATS, _split_cte(c16), _fscore_sql(c16), _pvalue_sql()).replace("WITH ", "WITH RECURSIVE ", 1)
        + " SELECT row_number() OVER (ORDER BY p_value, f_score DESC, feature) AS rank, feature, round(f_score, 3) AS f_score,"
        " round(p_value, 9) AS p_value, p_value <= 0.1 AS significant,"
        " row_number() OVER (ORDER BY p_value, f_score DESC, feature) <= 12 AS selected FROM tested",
        "split_summary": _with(*_base(), _FEATS, _split_cte(c16), _split_summary_sql())
        + " SELECT client_id, CAST(raw_rows AS BIGINT) AS raw_rows, CAST(train_rows AS BIGINT) AS train_rows,"
        " CAST(val_rows AS BIGINT) AS val_rows, CAST(test_rows AS BIGINT) AS test_rows,"
        " CAST(CASE WHEN tr_s > 0 THEN tr_s ELSE 1 END AS BIGINT) AS train_sequences,"
        " CAST(val_sequences AS BIGINT) AS val_sequences,"
        " CAST(CASE WHEN te_s > 0 THEN te_s WHEN val_sequences > 0 THEN val_sequences ELSE 1 END AS BIGINT) AS test_sequences,"
        " CAST(num_items AS BIGINT) AS num_items FROM agg",
        "split_summary_selected": _with(*_base(), _FEATS, _split_cte(c16), _fscore_sql(c16), _selected_split_sql(c16),
                                        _split_summary_sql().replace("FROM split GROUP BY", "FROM split2 GROUP BY"))
        + " SELECT client_id, CAST(raw_rows AS BIGINT) AS raw_rows, CAST(train_rows AS BIGINT) AS train_rows,"
        " CAST(val_rows AS BIGINT) AS val_rows, CAST(test_rows AS BIGINT) AS test_rows,"
        " CAST(CASE WHEN tr_s > 0 THEN tr_s ELSE 1 END AS BIGINT) AS train_sequences,"
        " CAST(val_sequences AS BIGINT) AS val_sequences,"
        " CAST(CASE WHEN te_s > 0 THEN te_s WHEN val_sequences > 0 THEN val_sequences ELSE 1 END AS BIGINT) AS test_sequences,"
        " CAST(num_items AS BIGINT) AS num_items FROM agg",
        "selection_summary": _with(*_base(), _FEATS, _split_cte(c16))
        + " SELECT CAST(sum(c) AS BIGINT) AS total_samples, CAST(count(*) AS BIGINT) AS num_clients,"
        " CAST(min(c) AS BIGINT) AS min_samples, CAST(max(c) AS BIGINT) AS max_samples, round(avg(c), 6) AS mean_samples"
        " FROM (SELECT client_id, count(*) AS c FROM split WHERE split = 'train' GROUP BY client_id) t",
        "scaler_standard": _with(*_base(), _FEATS, _split_cte(c16), _scaled_cte(c16))
        + " " + " UNION ALL ".join(
            f"SELECT client_id, '{c}' AS feature, round(m{i}, 6) AS center,"
            f" round(CASE WHEN s{i} = 0 OR s{i} IS NULL THEN 1.0 ELSE s{i} END, 6) AS scale FROM xstats"
            for i, c in enumerate(c16)),
        "scaler_robust": _with(*_base(), _FEATS, _split_cte(c16), _scaled_cte(c16))
        + " SELECT client_id, round(y_center, 6) AS y_center, round(y_scale, 6) AS y_scale,"
        " round(y_q25, 6) AS y_q25, round(y_q75, 6) AS y_q75 FROM ystats",
        "sequences": _with(*_base(), _FEATS, _split_cte(c16), _scaled_cte(c16))
        + " SELECT client_id, item_id, split, CAST(target_date AS VARCHAR) AS target_date, round(y, 6) AS y,"
        " round(x_sum, 6) AS x_sum, round(x_first, 6) AS x_first, round(x_last, 6) AS x_last FROM valid",
        "naive_metrics": _with(*_base(), _FEATS, _split_cte(c16), _scaled_cte(c16), _NAIVE)
        + " SELECT client_id, num_samples, " + ", ".join(f"round({m}, 6) AS {m}" for m in _M5) + " FROM cm",
        "naive_strategy": _with(*_base(), _FEATS, _split_cte(c16), _scaled_cte(c16), _NAIVE)
        + " SELECT 'naive' AS strategy, CAST(sum(num_samples) AS BIGINT) AS num_samples, "
        + ", ".join(f"round(sum({m} * num_samples) / sum(num_samples), 6) AS {m}" for m in _M5) + " FROM cm",
        "profiles_noisy": _with(*prof) + " SELECT client_id, pos, round(value, 6) AS value FROM noisy_t",
        "profile_top3": _with(*prof)
        + " SELECT client_id, rank, pos, round(value, 6) AS value FROM (SELECT client_id, pos, value,"
        " row_number() OVER (PARTITION BY client_id ORDER BY value DESC, pos) AS rank FROM noisy_t) z WHERE rank <= 3",
        "profiles_normalised": _with(*prof) + " SELECT client_id, pos, round(value, 6) AS value FROM norm_t",
        "profiles_ema": _with(*prof, _profile_sql(c16, "val", "v", PIPELINE_EPSILON))
        + " SELECT n.client_id, n.pos, round(CASE WHEN o.value IS NOT NULL THEN 0.8 * o.value + 0.2 * n.value ELSE n.value END, 6) AS value"
        " FROM norm_v n LEFT JOIN norm_t o ON n.client_id = o.client_id AND n.pos = o.pos",
        "emd_pairs": _with(*prof, """
cdf AS (SELECT client_id, pos, sum(value) OVER (PARTITION BY client_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
        FROM norm_t)""")
        + " SELECT a.client_id AS client_a, b.client_id AS client_b, round(sum(abs(a.c - b.c)), 6) AS emd"
        " FROM cdf a JOIN cdf b ON a.pos = b.pos AND a.client_id < b.client_id GROUP BY a.client_id, b.client_id",
        "embedding_emd": _with(_EMB, """
ec AS (SELECT vec_id, label, pos, sum(val) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
       FROM en),
cc AS (SELECT label, pos, sum(c) OVER (PARTITION BY label ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM cent)""")
        + " SELECT e.vec_id, e.label, round(sum(abs(e.c - k.c)), 6) AS emd FROM ec e JOIN cc k ON e.label = k.label AND e.pos = k.pos"
        " GROUP BY e.vec_id, e.label",
        "embedding_dbi": _with(_EMB, """
dd AS (SELECT e.vec_id, e.label, sqrt(sum((e.val - c.c) * (e.val - c.c))) AS d FROM en e JOIN cent c ON e.label = c.label AND e.pos = c.pos
       GROUP BY e.vec_id, e.label),
ss AS (SELECT label, avg(d) AS s FROM dd GROUP BY label),
mm AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS m FROM cent a JOIN cent b
       ON a.pos = b.pos AND a.label <> b.label GROUP BY a.label, b.label),
rr AS (SELECT la, max(CASE WHEN m > 0 THEN (sa.s + sb.s) / m ELSE 0.0 END) AS d FROM mm
       JOIN ss sa ON sa.label = mm.la JOIN ss sb ON sb.label = mm.lb GROUP BY la)""")
        + " SELECT round(avg(d), 6) AS dbi, CAST(count(*) AS BIGINT) AS num_labels FROM rr",
        "profiles_raw": _with(*_base(), _FEATS, _split_cte(c16), _raw_profile_sql(c16, 10.0))
        + " SELECT client_id, CAST(pos AS BIGINT) AS pos, round(value, 6) AS value FROM rnoisy",
        "sample_rows": _with(*_base(), _FEATS, _split_cte(c16), _sample_sql(SAMPLE_PER_CLIENT))
        + " SELECT client_id, item_id, CAST(date AS VARCHAR) AS date, round(y, 6) AS y FROM samp",
        "params_shared": _with(*tr_region) + " SELECT bubble, 'body.w' AS layer, CAST(pos AS BIGINT) AS pos, round(w, 8) AS value FROM pwa",
        "params_overlay": _with(*tr_region) + " SELECT client_id, 'body.w' AS layer, CAST(pos AS BIGINT) AS pos, round(w, 8) AS value FROM pw"
        " UNION ALL SELECT client_id, 'head.a', 0, round(a, 8) FROM ph0 UNION ALL SELECT client_id, 'head.b', 0, round(b, 8) FROM ph0",
        "fedavg_round": _with(*tr_region) + " SELECT h.bubble, round(b.body_sum, 6) AS body_sum, round(h.a, 8) AS a, round(h.b, 8) AS b, CAST(h.n AS BIGINT) AS n FROM"
        " (SELECT split_part(p.client_id, '_', 1) AS bubble, sum((p.a - 0.001 * g.ga) * g.n) / sum(g.n) AS a,"
        " sum((p.b - 0.001 * g.gbias) * g.n) / sum(g.n) AS b, sum(g.n) AS n FROM ph p JOIN gh g ON p.client_id = g.client_id GROUP BY 1) h"
        " JOIN (SELECT split_part(w.client_id, '_', 1) AS bubble, sum((w.w - 0.001 * g.gb) * n.n) / any_value(t.n) AS body_sum FROM pw w"
        " JOIN gw g ON w.client_id = g.client_id AND w.pos = g.pos JOIN gh n ON n.client_id = w.client_id"
        " JOIN (SELECT split_part(client_id, '_', 1) AS bubble, sum(n) AS n FROM gh GROUP BY 1) t ON t.bubble = split_part(w.client_id, '_', 1)"
        " GROUP BY 1) b ON h.bubble = b.bubble",
        "update_vectors": _with(*tr_region) + f" SELECT client_id, CAST(pos AS BIGINT) AS pos, round(greatest(-0.001 * gb, 0.0), 8) AS value FROM gw"
        f" UNION ALL SELECT client_id, CAST(pos + {SEQ_LEN * len(c16)} AS BIGINT), round(greatest(0.001 * gb, 0.0), 8) FROM gw",
        "evaluate_init": _with(*tr, _EVALUATED) + " SELECT client_id, num_samples, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(smape, 6) AS smape,"
        " round(wmape, 6) AS wmape, round(mase, 6) AS mase, round(loss, 6) AS loss FROM evm",
        "round_metrics": _with(*tr, _EVALUATED) + " SELECT 'initial' AS strategy, 'federated' AS stage, split_part(client_id, '_', 1) AS bubble,"
        " CAST(sum(num_samples) AS BIGINT) AS num_samples, CAST(sum(train_samples) AS BIGINT) AS train_samples,"
        " round(sum(rmse * num_samples) / sum(num_samples), 6) AS rmse, round(sum(smape * num_samples) / sum(num_samples), 6) AS smape,"
        " string_agg(client_id, ',' ORDER BY client_id) AS clients FROM evm GROUP BY split_part(client_id, '_', 1)",
        "flatten_history": _with(*tr, _EVALUATED) + " SELECT 'initial' AS strategy, 'federated' AS stage, split_part(client_id, '_', 1) AS bubble,"
        " client_id, num_samples, train_samples, round(rmse, 6) AS rmse, round(smape, 6) AS smape FROM evm",
        "strategy_comparison": _with(*tr, _EVALUATED, *[_NAIVE.replace("naive AS (", "naive0 AS (").replace("LEFT JOIN naive n", "LEFT JOIN naive0 n")])
        + " SELECT strategy, " + ", ".join(f"round(sum({m} * num_samples) / sum(num_samples), 6) AS {m}" for m in ["rmse", "smape", "mae", "wmape", "mase"])
        + " FROM (SELECT 'initial' AS strategy, num_samples, rmse, smape, mae, wmape, mase FROM evm"
        " UNION ALL SELECT 'naive', num_samples, rmse, smape, mae, wmape, mase FROM cm) z GROUP BY strategy"
        " UNION ALL SELECT 'none', 0.0, 0.0, 0.0, 0.0, 0.0",
        "client_clusters": _with(*prof, _CLUSTERS.replace("{most}", str(MAX_CLUSTERS_PIPELINE))).replace("WITH ", "WITH RECURSIVE ", 1)
        + " SELECT 'all' AS scope, x.client_id, CAST(n.cluster_id AS INTEGER) AS cluster_id, CAST(n.size AS INTEGER) AS cluster_size,"
        " n.size = 1 AS is_isolated, CAST((SELECT count(*) FROM num) AS INTEGER) AS k_star, CAST(c.n AS INTEGER) AS n_clients"
        " FROM fin f JOIN idx x ON x.i = f.i JOIN num n ON n.lab = f.lab, cnt c",
        "params_init": _with(*tr) + " SELECT client_id, 'body.w' AS layer, CAST(pos AS BIGINT) AS pos, round(w, 8) AS value FROM pw"
        " UNION ALL SELECT client_id, 'head.a', 0, round(a, 8) FROM ph UNION ALL SELECT client_id, 'head.b', 0, round(b, 8) FROM ph",
        "params_average": _with(*tr, "tn AS (SELECT client_id, count(*) AS n FROM trs GROUP BY client_id)")
        + " SELECT 'body.w' AS layer, CAST(pos AS BIGINT) AS pos, round(sum(w * n) / sum(n), 8) AS value FROM pw JOIN tn"
        " ON pw.client_id = tn.client_id GROUP BY pos"
        " UNION ALL SELECT 'head.a', 0, round(sum(a * n) / sum(n), 8) FROM ph JOIN tn ON ph.client_id = tn.client_id"
        " UNION ALL SELECT 'head.b', 0, round(sum(b * n) / sum(n), 8) FROM ph JOIN tn ON ph.client_id = tn.client_id",
        "predict_init": _with(*tr) + " SELECT client_id, item_id, CAST(target_date AS VARCHAR) AS target_date,"
        " round(p * sc + c, 6) AS y_pred, round(y * sc + c, 6) AS y_true FROM evp",
        "loss_init": _with(*tr) + " SELECT client_id, round(avg(CASE WHEN abs(p - y) <= 1 THEN 0.5 * (p - y) * (p - y)"
        " ELSE abs(p - y) - 0.5 END) + 0.1 * avg(2.0 * abs((p * sc + c) - (y * sc + c))"
        " / (abs(y * sc + c) + abs(p * sc + c) + 1e-8)), 6) AS loss, count(*) AS num_samples FROM evp GROUP BY client_id",
        "train_step": _with(*tr) + " SELECT h.client_id, round(b.body_sum, 6) AS body_sum, round(p.a - 0.001 * h.ga, 8) AS a,"
        " round(p.b - 0.001 * h.gbias, 8) AS b, h.n FROM gh h JOIN ph p ON h.client_id = p.client_id"
        " JOIN (SELECT w.client_id, sum(w.w - 0.001 * g.gb) AS body_sum FROM pw w JOIN gw g ON w.client_id = g.client_id"
        " AND w.pos = g.pos GROUP BY w.client_id) b ON h.client_id = b.client_id",
    }
