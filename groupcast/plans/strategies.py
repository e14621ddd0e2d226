"""The three training strategies.

Local      every client alone, all layers, from its own start.
Averaged   rounds of averaging within the bubbles of any assignment; one bubble of all clients for the baseline.
Clustered  profile -> cluster -> warm-up -> rounds per bubble -> isolated clients. With personal heads the rounds share
           the body and recluster on update vectors, and heads are tuned after; without, all layers are averaged.

The driver only holds the round counter. A fit is one job over all clients (``bubble`` is a column); parameters,
assignments and per-round records are small tables, committed round by round (plans/rounds.py), so a run
that was stopped goes on after its last complete round and ends with the same results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupcast.constants import (
    EPOCHS_PER_ROUND,
    GLOBAL_WARMUP_ROUNDS,
    HEAD_FINETUNE_EPOCHS,
    LEARNING_RATE,
    MAX_CLUSTERS_PIPELINE,
    NUM_ROUNDS,
    PIPELINE_EPSILON,
    RECLUSTER_INTERVAL,
    SEED,
)
from groupcast.operators.blocks import train_counts
from groupcast.operators.cluster import cluster_profiles, cluster_record, normalise_profiles, with_scope
from groupcast.operators.metrics import METRICS, strategy_metrics
from groupcast.operators.params import average_params, first_owner_params, init_params, overlay_params, send_params
from groupcast.operators.train import BATCH_SIZE, evaluate, fit, naive_from_train
from groupcast.plans.clustering import first_clustering
from groupcast.plans.prepare import Prepared
from groupcast.plans.rounds import RoundLog
from groupcast.session import settle
from groupcast.streaming.ema_stream import EmaStream

OWNER = "client_id"
RECORD_COLS = ["strategy", "stage", "round", "bubble", "epochs", "client_id", "num_samples", "train_samples", *METRICS, "loss"]


@dataclass
class StrategyConfig:
    num_rounds: int = NUM_ROUNDS
    epochs_per_round: int = EPOCHS_PER_ROUND
    global_warmup_rounds: int = GLOBAL_WARMUP_ROUNDS
    head_finetune_epochs: int = HEAD_FINETUNE_EPOCHS
    recluster_interval: int = RECLUSTER_INTERVAL
    local_epochs: int | None = None  # default num_rounds * epochs_per_round
    lr: float = LEARNING_RATE
    batch_size: int | None = BATCH_SIZE  # None: one full-batch step per epoch
    max_clusters: int | None = MAX_CLUSTERS_PIPELINE
    epsilon: float = PIPELINE_EPSILON
    seed: int = SEED
    personalize_head: bool = True
    strategies: list[str] = field(default_factory=lambda: ["Local", "Global FedAvg", "Clustered"])

    @property
    def local(self) -> int:
        return self.local_epochs if self.local_epochs is not None else self.num_rounds * self.epochs_per_round


class Context:
    """Inputs shared by all strategies, written once to the checkpoint folder."""

    def __init__(self, prep: Prepared):
        self.prep = prep
        self.train = settle(prep.train)
        self.eval = settle(prep.eval)
        self.y_stats = settle(prep.y_stats.select(OWNER, "y_center", "y_scale"))
        self.clients = settle(prep.clients)
        self.counts = settle(train_counts(self.train))
        self.naive = settle(naive_from_train(self.train, self.y_stats))
        self.dim = prep.dim

    @property
    def spark(self):
        return self.clients.sparkSession

    def fit(self, cfg: StrategyConfig, params: DataFrame, epochs: int, trainable: str = "all", seed: int = 0) -> DataFrame:
        return fit(self.train, params, self.y_stats, epochs, trainable, cfg.lr, cfg.batch_size, cfg.seed + seed, self.counts)

    def records(self, params: DataFrame, strategy: str, stage: str, rnd: int | None, epochs: int | None,
                bubble_of: DataFrame | None) -> DataFrame:
        """L7 + record layout: per-client metrics of ``params`` on eval."""
        m = evaluate(self.eval, params, self.y_stats, self.naive)
        m = m.join(params.select(OWNER, F.col("n").alias("train_samples")), OWNER, "left")
        if bubble_of is not None:
            m = m.join(bubble_of.select(OWNER, "bubble"), OWNER, "left")
        else:
            m = m.withColumn("bubble", F.lit(None).cast("int"))
        return m.select(
            F.lit(strategy).alias("strategy"), F.lit(stage).alias("stage"), F.lit(rnd).cast("int").alias("round"),
            F.col("bubble").cast("int").alias("bubble"), F.lit(epochs).cast("int").alias("epochs"), OWNER,
            "num_samples", F.col("train_samples").cast("long").alias("train_samples"), *METRICS, "loss")


def _with_body(client_params: DataFrame, assign: DataFrame, bodies: DataFrame) -> DataFrame:
    """Overlay the body of each assigned client with its bubble's; keep own head."""
    sent = send_params(assign, bodies.select("bubble", "body"))
    return overlay_params(client_params.select(OWNER, "body", "a", "b").join(assign.select(OWNER), OWNER, "left_semi"), sent)


def _spread(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table (a global parameter vector)
    to every row: an equi-join on a constant key whose build side is one
    row by construction (an aggregate without grouping)."""
    return rows.withColumn("_k", F.lit(0)).join(F.broadcast(one_row.withColumn("_k", F.lit(0))), "_k").drop("_k")


def one_bubble(clients: DataFrame) -> DataFrame:
    return clients.select(OWNER, F.lit(0).alias("bubble"))


def global_start(ctx: Context, cfg: StrategyConfig, assign: DataFrame) -> DataFrame:
    """The first client's initial parameters for every bubble of the assignment."""
    first = first_owner_params(init_params(ctx.clients, ctx.dim, cfg.seed)).select("body", "a", "b")
    return _spread(assign.select("bubble").distinct(), first)


def averaging_round(ctx: Context, cfg: StrategyConfig, assign: DataFrame, common: DataFrame, rnd: int) -> tuple[DataFrame, DataFrame]:
    """K7 + K4 + C5: every client fits all layers from its bubble's parameters; the bubble's next are the
    weighted mean. Returns (every client's fit, the bubbles' next parameters)."""
    fitted = ctx.fit(cfg, send_params(assign, common), cfg.epochs_per_round, seed=rnd)
    return fitted, average_params(fitted.join(assign.select(OWNER, "bubble"), OWNER), "bubble", "n")


def run_local(ctx: Context, cfg: StrategyConfig, log: RoundLog) -> DataFrame:
    """Local: every client fits all layers from its own start."""
    def make():
        fitted = ctx.fit(cfg, init_params(ctx.clients, ctx.dim, cfg.seed), cfg.local)
        return {"records": ctx.records(fitted, "Local", "personalized", None, cfg.local, None)}

    return log.once("local", 0, make)["records"]


def warmup(ctx: Context, cfg: StrategyConfig, log: RoundLog) -> tuple[DataFrame, DataFrame]:
    """K8: rounds over all clients as one bubble. Returns its parameters (bubble 0) and every client's last
    fit; without rounds, the first client's start and the clients' own."""
    assign = one_bubble(ctx.clients)
    done = log.steps("warmup")
    if not cfg.global_warmup_rounds:
        return settle(global_start(ctx, cfg, assign)), settle(init_params(ctx.clients, ctx.dim, cfg.seed))
    state = done[max(done)] if done else {"common": settle(global_start(ctx, cfg, assign))}
    for r in range(max(done, default=0) + 1, cfg.global_warmup_rounds + 1):
        fitted, nxt = averaging_round(ctx, cfg, assign, state["common"], r)
        state = log.commit("warmup", r, clients=fitted, common=nxt)
    return state["common"], state["clients"]


def run_bubbles(ctx: Context, cfg: StrategyConfig, log: RoundLog, assign: DataFrame, start: DataFrame,
                strategy: str, phase: str = "bubbles") -> DataFrame:
    """K9: ``num_rounds`` rounds of averaging all layers within every bubble of ``assign`` (client_id, bubble) at
    once, from ``start`` (bubble, body, a, b); each bubble's parameters are scored on its clients every round."""
    done = log.steps(phase)
    common = done[max(done)]["common"] if done else start
    recs = [t["records"] for t in done.values()]
    for r in range(max(done, default=0) + 1, cfg.num_rounds + 1):
        fitted, nxt = averaging_round(ctx, cfg, assign, common, r)
        nxt = settle(nxt)
        sent = send_params(assign, nxt).join(fitted.select(OWNER, "n"), OWNER)
        state = log.commit(phase, r, common=nxt, records=ctx.records(sent, strategy, "federated", r, cfg.epochs_per_round, assign))
        common = state["common"]
        recs.append(state["records"])
    return _union(recs)


def run_averaged(ctx: Context, cfg: StrategyConfig, log: RoundLog, assign: DataFrame | None = None) -> DataFrame:
    """The averaging baseline: K9 over one bubble of all clients, or over any assignment."""
    assign = one_bubble(ctx.clients) if assign is None else assign
    return run_bubbles(ctx, cfg, log, assign, global_start(ctx, cfg, assign), "Global FedAvg", "averaged")


def _union(dfs: list[DataFrame]) -> DataFrame | None:
    dfs = [d for d in dfs if d is not None]
    if not dfs:
        return None
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def update_vectors(fitted: DataFrame, assign: DataFrame, common: DataFrame) -> DataFrame:
    """delta = local body - bubble body; positive parts || negative parts."""
    ref = assign.select(OWNER, "bubble").join(common.select("bubble", F.col("body").alias("_ref")), "bubble")
    d = fitted.select(OWNER, "body").join(ref, OWNER).select(
        OWNER, F.zip_with("body", "_ref", lambda a, b: a - b).alias("_d"))
    return d.select(OWNER, F.concat(F.transform("_d", lambda v: F.greatest(v, F.lit(0.0))),
                                    F.transform("_d", lambda v: F.greatest(-v, F.lit(0.0)))).alias("importance"))


def _assign_from_clusters(clusters: DataFrame) -> DataFrame:
    return clusters.select(OWNER, F.col("cluster_id").alias("bubble"), "cluster_size", "is_isolated")


def reassigned(client_state: DataFrame, assign: DataFrame) -> DataFrame:
    """The bodies of the new bubbles: the mean of their members', for a bubble of one that of all clients."""
    everyone = average_params(client_state.withColumn("bubble", F.lit(0)), "bubble", "n", with_head=False)
    per = average_params(client_state.join(assign.select(OWNER, "bubble"), OWNER), "bubble", "n", with_head=False)
    sizes = assign.groupBy("bubble").agg(F.count(F.lit(1)).alias("_sz"))
    both = _spread(per.join(sizes, "bubble"), everyone.select(F.col("body").alias("_g")))
    return both.select("bubble", F.when(F.col("_sz") == 1, F.col("_g")).otherwise(F.col("body")).alias("body"))


def run_dynamic(ctx: Context, cfg: StrategyConfig, log: RoundLog, first: dict[str, DataFrame], glob: DataFrame,
                client_state: DataFrame) -> tuple[list[DataFrame], list[DataFrame], dict[str, DataFrame]]:
    """Rounds that share the body within bubbles (isolated clients are bubbles of one), reclustering on smoothed
    update vectors every ``recluster_interval`` rounds. Returns (records, cluster records, last state)."""
    done = log.steps("dynamic")
    assign = first["assign"]
    state = {
        "clients": client_state, "assign": assign,
        "common": settle(_spread(assign.select("bubble").distinct(), glob.select("body"))), "shared": glob.select("body"),
    }
    if done:
        state = done[max(done)]
    recs, history = [], []
    for t in done.values():
        recs.append(t["records"])
        history += [t["history"]] if "history" in t else []
    for r in range(max(done, default=0) + 1, cfg.num_rounds + 1):
        assign, common = state["assign"], state["common"]
        fitted = ctx.fit(cfg, _with_body(state["clients"], assign, common), cfg.epochs_per_round, seed=r)
        nxt = settle(average_params(fitted.join(assign.select(OWNER, "bubble"), OWNER), "bubble", "n", with_head=False))
        scored = _with_body(fitted, assign, nxt).join(fitted.select(OWNER, "n"), OWNER)
        tables = {
            "clients": fitted, "common": nxt.select("bubble", "body"), "assign": assign, "shared": state["shared"],
            "records": ctx.records(scored, "Clustered", "federated", r, cfg.epochs_per_round, assign),
        }
        if cfg.recluster_interval > 0 and r % cfg.recluster_interval == 0 and r < cfg.num_rounds:
            moved = normalise_profiles(with_scope(update_vectors(fitted, assign, common)), "importance", "dist")
            smoothed = EmaStream(ctx.spark, f"{log.folder}/ema").update(moved, r)
            clusters = settle(cluster_profiles(smoothed, "dist", cfg.max_clusters))
            assign = settle(_assign_from_clusters(clusters))
            tables |= {
                "assign": assign, "common": reassigned(fitted, assign),
                "shared": average_params(fitted.withColumn("bubble", F.lit(0)), "bubble", "n", with_head=False).select("body"),
                "history": cluster_record(clusters, "dynamic_recluster", r, r // cfg.recluster_interval + 1),
            }
        state = log.commit("dynamic", r, **tables)
        recs.append(state["records"])
        history += [state["history"]] if "history" in state else []
    return recs, history, state


def tune_heads(ctx: Context, cfg: StrategyConfig, log: RoundLog, state: dict[str, DataFrame]) -> DataFrame | None:
    """K6: heads of clients in bubbles of several, on their bubble's body."""
    if cfg.head_finetune_epochs <= 0:
        return None
    multi = state["assign"].filter(~F.col("is_isolated"))

    def make():
        tuned = ctx.fit(cfg, _with_body(state["clients"], multi, state["common"]), cfg.head_finetune_epochs, "head")
        return {"records": ctx.records(tuned, "Clustered", "head_finetune", None, cfg.head_finetune_epochs, state["assign"])}

    return log.once("heads", 0, make)["records"]


def train_isolated(ctx: Context, cfg: StrategyConfig, log: RoundLog, isolated: DataFrame, clients: DataFrame,
                   shared: DataFrame | None) -> DataFrame:
    """Isolated clients alone. With a shared body (one row) their heads on it; without, all layers
    from their own parameters."""
    def make():
        if shared is None:
            start, kind = clients.select(OWNER, "body", "a", "b").join(isolated.select(OWNER), OWNER, "left_semi"), "all"
        else:
            start, kind = _with_body(clients, one_bubble(isolated), shared.select(F.lit(0).alias("bubble"), "body")), "head"
        tuned = ctx.fit(cfg, start, cfg.local, kind)
        return {"records": ctx.records(tuned, "Clustered", "personalized", None, cfg.local, None)}

    return log.once("isolated", 0, make)["records"]


def run_clustered(ctx: Context, cfg: StrategyConfig, log: RoundLog, history: list | None = None) -> DataFrame:
    """K10-K12 via I16: the full clustered strategy. ``history`` (a list)
    receives the cluster records (I12/I13) if given."""
    def cluster():
        # I16; the first profiles are the smoothed vectors' first round
        prof, clusters, record = first_clustering(ctx.train, cfg.epsilon, cfg.seed, cfg.max_clusters, ctx.prep.seq_len)
        EmaStream(ctx.spark, f"{log.folder}/ema").update(normalise_profiles(with_scope(prof), "importance", "dist"), 0)
        return {"assign": _assign_from_clusters(clusters), "history": record.withColumn("sequence", F.lit(1))}

    first = log.once("clusters", 0, cluster)
    glob, client_state = warmup(ctx, cfg, log)
    if cfg.personalize_head:
        recs, later, state = run_dynamic(ctx, cfg, log, first, glob, client_state)
        heads = tune_heads(ctx, cfg, log, state)
        alone = train_isolated(ctx, cfg, log, state["assign"].filter("is_isolated"), state["clients"], state["shared"])
    else:
        multi = first["assign"].filter(~F.col("is_isolated"))
        start = _spread(multi.select("bubble").distinct(), glob.select("body", "a", "b"))
        recs, later, heads = [run_bubbles(ctx, cfg, log, multi, start, "Clustered")], [], None
        alone = train_isolated(ctx, cfg, log, first["assign"].filter("is_isolated"), client_state, None)
    if history is not None:
        history += [first["history"], *later]
    return _union([_union(recs), heads, alone])


def final_records(records: DataFrame, num_rounds: int) -> DataFrame:
    """Per strategy, head-tune records if any, else last-round
    records; plus personalised ones."""
    has_head = records.filter(F.col("stage") == "head_finetune").groupBy("strategy").agg(F.lit(True).alias("_h"))
    r = records.join(has_head, "strategy", "left")
    keep = (
        (F.col("stage") == "personalized")
        | ((F.col("stage") == "head_finetune"))
        | ((F.col("stage") == "federated") & F.col("_h").isNull() & (F.col("round") == num_rounds))
    )
    return r.filter(keep).drop("_h")


def run_strategies(prep: Prepared, cfg: StrategyConfig, history: list | None = None, folder: str | None = None):
    """All strategies from the same prepared sequences. With ``folder`` (shared by the cluster) a stopped
    run, called again, goes on after its last committed round. Returns (records, results) DataFrames."""
    ctx = Context(prep)
    log = RoundLog(ctx.spark, folder)
    parts = []
    if "Local" in cfg.strategies:
        parts.append(run_local(ctx, cfg, log))
    if "Global FedAvg" in cfg.strategies:
        parts.append(run_averaged(ctx, cfg, log))
    if "Clustered" in cfg.strategies:
        parts.append(run_clustered(ctx, cfg, log, history))
    records = _union(parts)
    if records is None:
        raise ValueError("no strategy produced records (check cfg.strategies and cfg.num_rounds)")
    spark = records.sparkSession
    names = spark.createDataFrame([(s,) for s in cfg.strategies], "strategy string")
    results = strategy_metrics(final_records(records, cfg.num_rounds), names)
    return records, results
