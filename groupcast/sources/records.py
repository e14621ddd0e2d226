"""JSON / CSV / text records of a run.

All writers take DataFrames and a target folder; on a cluster the folder
is shared storage. Single-document outputs (config, results) are one-row
DataFrames.
"""

from __future__ import annotations

import datetime as dt
import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupcast.constants import HISTORY_SCHEMA_VERSION
from groupcast.sources.commit_log import CommitLog

PROFILE_MAP = T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))


# --------------------------------------------------------------------- A7
def write_profiles_json(profiles: DataFrame, path: str, col: str = "importance") -> None:
    """Profiles as one JSON object {client: [values]} (the map is bounded
    by the number of clients)."""
    one = profiles.agg(F.map_from_entries(F.collect_list(F.struct("client_id", col))).alias("m"))
    one.select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_profiles_json(spark: SparkSession, path: str) -> DataFrame:
    """{client: [values]} -> (client_id, importance)."""
    txt = spark.read.text(path, wholetext=True)
    m = txt.select(F.from_json("value", PROFILE_MAP).alias("m"))
    return m.select(F.explode("m").alias("client_id", "importance"))


# --------------------------------------------------------------------- A8, I13
_RECORD = """sequence int, stage string, round int, k_star int, total_clients int, num_clusters int,
 num_multi_client_bubbles int, num_isolated_clients int, cluster_sizes array<int>,
 cluster_size_stats struct<min: int, max: int, mean: double>,
 multi_client_bubbles array<struct<bubble_id: int, size: int, clients: array<string>>>,
 isolated_clients array<string>, assignments map<string, int>"""
_HISTORY = f"schema_version int, description string, records array<struct<{_RECORD}>>, {_RECORD}"


def _history_entries(spark: SparkSession, path: str) -> list[tuple[int, dict]]:
    """(sequence, entry) of an appended history since it was last started anew."""
    entries = CommitLog(spark, path).read()
    start = max((n for n, e in entries if e.get("reset")), default=0)
    return [(n - start, e) for n, e in entries if n > start]


def read_history_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of a clustering file, in any of its layouts: ``records``, a
    single record, or the older ``assignments`` with ``isolated_clients``; or of an appended history, whose log
    numbers them."""
    entries = _history_entries(spark, path)
    names = [f.name for f in T.StructType.fromDDL(_RECORD).fields]
    if entries:
        docs = spark.read.schema(f"_pos int, {_RECORD}").json(sorted({f"{path.rstrip('/')}/data/{e['data']}" for _, e in entries}))
        docs = docs.withColumn("_data", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).drop("sequence")
        claims = spark.createDataFrame([(n, e["data"], e["position"]) for n, e in entries], "sequence int, _data string, _pos int")
        return docs.join(claims, ["_data", "_pos"]).select(*names)
    doc = spark.read.schema(_HISTORY).option("multiLine", True).json(path)
    single = F.array(F.struct(*names))
    return doc.select(F.explode(F.coalesce("records", single)).alias("r")).select("r.*")


def read_cluster_history(spark: SparkSession, path: str) -> DataFrame:
    """(client_id, bubble, is_isolated) of the last record of a clustering file.

    Records without member lists and without assignments cannot tell who is where and stop the job."""
    last = read_history_records(spark, path).orderBy(F.col("sequence").desc_nulls_last()).limit(1)
    bubbles = F.filter(F.coalesce("multi_client_bubbles", F.array().cast("array<struct<bubble_id:int,size:int,clients:array<string>>>")),
                       lambda b: b["clients"].isNotNull())
    listed = F.flatten(F.transform(bubbles, lambda b, i: F.transform(
        b["clients"], lambda c: F.struct(c.alias("client_id"), i.alias("bubble"), F.lit(False).alias("is_isolated")))))
    alone = F.coalesce("isolated_clients", F.array().cast("array<string>"))
    isolated = F.transform(alone, lambda c: F.struct(
        c.alias("client_id"), F.lit(None).cast("int").alias("bubble"), F.lit(True).alias("is_isolated")))
    mapped = F.transform(F.map_entries("assignments"), lambda e: F.struct(
        e["key"].alias("client_id"), e["value"].alias("bubble"), F.lit(False).alias("is_isolated")))
    counted = F.coalesce(F.size("multi_client_bubbles"), F.lit(-1))
    lists = (counted == F.size(bubbles)) & (counted >= 0)
    kind = "array<struct<client_id:string,bubble:int,is_isolated:boolean>>"
    members = (
        F.when(lists, listed.cast(kind))
        .when(F.col("assignments").isNotNull(), F.filter(mapped, lambda m: ~F.array_contains(alone, m["client_id"])).cast(kind))
        .otherwise(F.raise_error(F.lit("cluster record without members: bubbles list no clients and there are no assignments")).cast(kind))
    )
    rows = last.select(F.explode(F.concat(members, isolated.cast(kind))).alias("m")).select("m.*")
    # A bubble of one client is an isolated client too; who is listed twice counts once.
    size = F.count("bubble").over(Window.partitionBy("bubble"))
    alone_too = rows.withColumn("is_isolated", F.col("is_isolated") | (F.col("bubble").isNotNull() & (size == 1)))
    one = alone_too.groupBy("client_id").agg(F.max("is_isolated").alias("is_isolated"), F.min("bubble").alias("bubble"))
    return one.select("client_id", F.when(~F.col("is_isolated"), F.col("bubble")).alias("bubble"), "is_isolated")


def append_cluster_history(records: DataFrame, path: str, reset: bool = False) -> DataFrame:
    """Add records to the history at ``path``, each with the next sequence number, in the order they come in (by
    their own sequence). The records are written first, then each claims its number in the history's log, so
    several writers at once give 1..n. ``reset`` starts a new history. Returns the added records."""
    log = CommitLog(records.sparkSession, path)
    data = log.data_path()
    order = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("sequence"))  # one row per clustering
    added = records.drop("scope").withColumn("_pos", order.cast("int")).withColumn("schema_version", F.lit(HISTORY_SCHEMA_VERSION))
    added.drop("sequence").write.json(data)
    if reset:
        log.append({"reset": True})
    name = data.rsplit("/", 1)[-1]
    for pos in range(1, records.sparkSession.read.schema("_pos int").json(data).count() + 1):
        log.append({"data": name, "position": pos})
    mine = [n for n, e in _history_entries(records.sparkSession, path) if e.get("data") == name]
    return read_history_records(records.sparkSession, path).filter(F.col("sequence").isin(mine))


# --------------------------------------------------------------------- A9, A10, A14
def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines under ``path``."""
    df.write.mode("overwrite").json(path)


def write_metrics_csv(parts: list[DataFrame], path: str) -> None:
    """A10: rows of unlike shapes as one CSV table; its header, the first line of every part, is the sorted union of
    their columns. Parts are written in parallel and show only when the job commits, so a job that fails leaves no
    part. No rows give a file without lines."""
    if not parts:
        raise ValueError("no metrics table given")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    header = not whole.isEmpty()
    whole.select(*sorted(whole.columns)).write.mode("overwrite").option("header", header).csv(path)


def write_config(spark: SparkSession, config: dict, path: str) -> DataFrame:
    """One-row config; values keep their JSON types."""
    row = spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)
    return row


# --------------------------------------------------------------------- A11
def write_params(client_params: DataFrame, assign: DataFrame, path: str) -> None:
    """Per-client full parameters, and per bubble the shared part only,
    taken from the bubble's representative (lowest client id)."""
    from groupcast.operators.params import params_table, shared_part

    long = params_table(client_params)
    long.withColumn("kind", F.lit("client")).withColumnRenamed("client_id", "owner_id").write.mode("overwrite").parquet(os.path.join(path, "clients"))
    multi = assign.filter(~F.col("is_isolated"))
    rep = multi.groupBy("bubble").agg(F.min("client_id").alias("client_id"))
    b = shared_part(long).join(rep, "client_id").select(F.col("bubble").cast("string").alias("owner_id"), "layer", "pos", "value")
    b.write.mode("overwrite").parquet(os.path.join(path, "bubbles"))


def read_params(spark: SparkSession, path: str, kind: str = "clients") -> DataFrame:
    return spark.read.parquet(os.path.join(path, kind))


# --------------------------------------------------------------------- A12
def new_run_id(now: dt.datetime | None = None) -> str:
    return (now or dt.datetime.now()).strftime("%Y%m%d_%H%M%S_%f")


def run_manifest(spark: SparkSession, run_id: str, run_dir: str, files: dict[str, str]) -> DataFrame:
    """One row per named output, path = run_dir / relative."""
    rows = [(run_id, name, rel) for name, rel in files.items()]
    df = spark.createDataFrame(rows, "run_id string, name string, relative string")
    return df.withColumn("path", F.concat_ws("/", F.lit(run_dir.rstrip("/")), F.col("relative")))


def register_run(manifest: DataFrame, registry: str) -> int:
    """Add a run's manifest to the registry: its rows are written first, then an entry of the registry's log
    names them. Returns the entry's number."""
    log = CommitLog(manifest.sparkSession, registry)
    path = log.data_path()
    manifest.write.parquet(path)
    return log.append({"data": path.rsplit("/", 1)[-1], "runs": sorted(r.run_id for r in manifest.select("run_id").distinct().collect())})


def latest_run(spark: SparkSession, registry: str) -> DataFrame:
    """The manifest rows of the newest run in the registry (of one registered twice, the later entry's)."""
    entries = CommitLog(spark, registry).read()
    if not entries:
        raise ValueError("no run is registered")
    newest, _, data = max((run, n, e["data"]) for n, e in entries for run in e["runs"])
    return spark.read.parquet(f"{registry.rstrip('/')}/data/{data}").filter(F.col("run_id") == newest)


# --------------------------------------------------------------------- A13
def render_report(results: DataFrame, order: list[str]) -> DataFrame:
    """One text line per strategy, 4 decimals, in the given order."""
    pos = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("strategy"))
    line = F.format_string("%s | rmse %.4f | smape %.4f | mae %.4f | wmape %.4f | mase %.4f",
                           "strategy", "rmse", "smape", "mae", "wmape", "mase")
    return results.select(pos.alias("_o"), line.alias("line")).orderBy("_o").select("line")


def compare_strategies(results: DataFrame) -> DataFrame:
    """Strategy x metric table (the comparison chart's numbers)."""
    from groupcast.operators.metrics import METRICS

    long = results.select("strategy", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("s"))
    return long.select("strategy", "s.metric", "s.value").groupBy("strategy").pivot("metric", METRICS).agg(F.first("value"))


def flatten_history(rounds: DataFrame) -> DataFrame:
    """One row per client of records that nest ``per_client_metrics``; records
    that have a client of their own (and no list) stay as they are."""
    nested = "per_client_metrics"
    if nested not in rounds.columns:
        return rounds
    inner = rounds.schema[nested].dataType.elementType.names
    outer = [c for c in rounds.columns if c not in (nested, "clients", *inner)]
    own = [c for c in inner if c in rounds.columns]
    listed = rounds.filter(F.size(nested) > 0).select(*outer, F.explode(nested).alias("c")).select(*outer, "c.*")
    single = rounds.filter(F.col(nested).isNull() | (F.size(nested) == 0))
    if "client_id" not in rounds.columns:
        return listed
    return listed.unionByName(single.filter(F.col("client_id").isNotNull()).select(*outer, *own), allowMissingColumns=True)


def round_metrics(records: DataFrame) -> DataFrame:
    """Per (strategy, round, bubble): sample-weighted rmse / smape and
    the nested per-client list."""
    w = F.col("num_samples").cast("double")
    fed = records.filter(F.col("stage") == "federated")
    return fed.groupBy("strategy", "stage", "round", "bubble").agg(
        F.sum("num_samples").cast("long").alias("num_samples"),
        F.sum("train_samples").cast("long").alias("train_samples"),
        (F.sum(F.col("rmse") * w) / F.sum(w)).alias("rmse"),
        (F.sum(F.col("smape") * w) / F.sum(w)).alias("smape"),
        F.sort_array(F.collect_list("client_id")).alias("clients"),
        F.sort_array(F.collect_list(F.struct("client_id", "num_samples", "train_samples", "rmse", "smape"))).alias("per_client_metrics"),
    )


def results_record(spark: SparkSession, run_id: str, results: DataFrame) -> DataFrame:
    """Run id, results map, split and weight names (one row)."""
    from groupcast.operators.metrics import METRICS

    res = results.agg(F.map_from_entries(F.collect_list(F.struct(
        "strategy", F.struct(*[F.col(m) for m in METRICS])))).alias("results"))
    return res.select(F.lit(run_id).alias("run_id"), "results", F.lit("test").alias("evaluation_split"),
                      F.lit("evaluation sequence count").alias("metric_weight"))
