"""Clustering entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groupcast.constants import MAX_CLUSTERS_PIPELINE, SEQ_LEN
from groupcast.operators.cluster import cluster_profiles, cluster_record, normalise_profiles, with_scope
from groupcast.session import settle


def cluster_from_profiles(profiles: DataFrame, max_clusters: int | None = None, stage: str = "initial_clustering",
                          round_num: int = 0) -> tuple[DataFrame, DataFrame]:
    """Profiles (client_id, importance[]) -> (assignments, v3 record)."""
    dist = normalise_profiles(with_scope(profiles), "importance", "dist")
    assign = settle(cluster_profiles(dist, "dist", max_clusters))
    return assign, cluster_record(assign, stage, round_num)


def cluster_from_file(spark: SparkSession, profiles_path: str, max_clusters: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Profiles JSON ({client: [values]}) -> client -> cluster map and
    its record (with member lists, so it can be loaded back)."""
    from groupcast.sources.records import read_profiles_json

    return cluster_from_profiles(read_profiles_json(spark, profiles_path), max_clusters)


def first_clustering(train: DataFrame, epsilon: float, seed: int = 42, max_clusters: int | None = MAX_CLUSTERS_PIPELINE,
                     seq_len: int = SEQ_LEN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """I16: train blocks -> profile -> cluster -> record (round 0). Returns profiles too."""
    from groupcast.operators.profiles import profile_clients

    prof = settle(profile_clients(train, epsilon, seed=seed, seq_len=seq_len))
    assign, rec = cluster_from_profiles(prof, max_clusters)
    return prof, assign, rec
