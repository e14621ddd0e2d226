"""Numbers of a log with several writers, and what is built on it."""

from concurrent.futures import ThreadPoolExecutor

from groupcast.sources.commit_log import CommitLog, create_new


def test_create_new_only_once(spark, tmp_path):
    path = f"file://{tmp_path}/d/x"
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda k: create_new(spark, path, str(k)), range(8)))
    assert sum(got) == 1
    assert (tmp_path / "d" / "x").read_text() == str(got.index(True))
    assert [p.name for p in (tmp_path / "d").iterdir()] == ["x"]


def test_two_writers_give_numbers_without_gaps(spark, tmp_path):
    folder = f"file://{tmp_path}/log"

    def write(who):
        log = CommitLog(spark, folder)
        return [log.append({"who": who, "k": k}) for k in range(6)]

    with ThreadPoolExecutor(2) as pool:
        a, b = pool.map(write, ["a", "b"])
    assert sorted(a + b) == list(range(1, 13)) and a == sorted(a) and b == sorted(b)
    said = CommitLog(spark, folder).read()
    assert [n for n, _ in said] == list(range(1, 13))
    assert [e["k"] for _, e in said if e["who"] == "a"] == list(range(6))


def test_histories_of_two_writers(spark, tmp_path):
    from groupcast.operators.cluster import cluster_record
    from groupcast.sources.records import append_cluster_history, read_cluster_history, read_history_records

    path = f"file://{tmp_path}/history"
    clusters = spark.createDataFrame(
        [("all", "a", 0, 2, False, 2, 3), ("all", "b", 0, 2, False, 2, 3), ("all", "c", 1, 1, True, 2, 3)],
        "scope string, client_id string, cluster_id int, cluster_size int, is_isolated boolean, k_star int, n_clients int")
    append_cluster_history(cluster_record(clusters, "old", 0), path)
    append_cluster_history(cluster_record(clusters, "initial_clustering", 0), path, reset=True)
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda r: append_cluster_history(cluster_record(clusters, f"w{r}", r), path).first().sequence, [1, 2]))
    assert sorted(done) == [2, 3]
    got = {r.sequence: r.stage for r in read_history_records(spark, path).collect()}
    assert got[1] == "initial_clustering" and {got[2], got[3]} == {"w1", "w2"} and len(got) == 3
    assert {r.client_id: r.is_isolated for r in read_cluster_history(spark, path).collect()} == {"a": False, "b": False, "c": True}


def test_registry_of_two_writers(spark, tmp_path):
    from groupcast.sources.records import latest_run, register_run, run_manifest

    registry = f"file://{tmp_path}/registry"
    with ThreadPoolExecutor(2) as pool:
        numbers = list(pool.map(lambda r: register_run(run_manifest(spark, r, f"/runs/{r}", {"config": "c.json"}), registry), ["20260101", "20260102"]))
    assert sorted(numbers) == [1, 2]
    assert [r.path for r in latest_run(spark, registry).collect()] == ["/runs/20260102/c.json"]
