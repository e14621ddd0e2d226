"""The smoothed vectors of a stream that is stopped and started again."""

import pytest

from groupcast.streaming.ema_stream import EmaStream, smooth

ROUNDS = [
    {"a": [1.0, 0.0], "b": [0.5, 0.5]},
    {"a": [0.0, 1.0], "b": [1.0, 0.0], "c": [0.2, 0.8]},
    {"a": [0.25, 0.75], "c": [0.1, 0.2, 0.7]},  # b is silent, c changes its length
    {"a": [0.6, 0.4], "b": [0.0, 1.0], "c": [0.3, 0.3, 0.4]},
]


def test_restarted_stream_goes_on_with_equal_vectors(spark, tmp_path):
    folder = f"file://{tmp_path}/ema"

    def frame(vectors):
        return spark.createDataFrame([("all", c, v) for c, v in vectors.items()], "scope string, client_id string, dist array<double>")

    want, state = [], {}
    for vectors in ROUNDS:
        state |= {c: smooth(state.get(c), v, 0.8) for c, v in vectors.items()}
        want.append({c: state[c] for c in vectors})
    stream = EmaStream(spark, folder)
    assert stream.rounds() == []
    for k, vectors in enumerate(ROUNDS):
        if k == 2:
            stream = EmaStream(spark, folder)  # another driver, the same folder
        got = {r.client_id: r.dist for r in stream.update(frame(vectors), k).collect()}
        assert got.keys() == want[k].keys()
        for c, v in got.items():
            assert v == pytest.approx(want[k][c], rel=1e-12)
        if k in (1, 3):  # sent again before anything else: nothing changes
            again = {r.client_id: r.dist for r in EmaStream(spark, folder).update(frame(vectors), k).collect()}
            assert again == got
    assert stream.rounds() == [0, 1, 2, 3]
