import numpy as np
import pytest
from pyspark.sql import functions as F

from armature.operators import smoothing as S

SCHEMA = "dataset string, episode_index long, frame_index long, action array<double>"


def sequential(x, stages):
    states = [None] * len(stages)
    out = []
    for v in x:
        for i, (kind, p) in enumerate(stages):
            if states[i] is not None:
                v = p * v + (1 - p) * states[i] if kind == "ema" else states[i] + np.clip(v - states[i], -p, p)
            states[i] = v
        out.append(v)
    return np.array(out)


def episodes(seed=3, dim=2):
    rng = np.random.default_rng(seed)
    data = {}
    for episode, length in enumerate([1, 5, 16, 17, 40, 200]):
        steps = rng.normal(0, 6, (length, dim))
        ramp = np.where(rng.random((length, dim)) < 0.3, 40.0, 0.0)
        data[episode] = np.round(np.cumsum(steps, axis=0) + ramp, 3)
    data[9] = np.repeat(np.arange(64.0)[:, None] * 50, dim, axis=1)  # never caught up
    return data


def table(spark, data):
    rows = [("d", e, t, [float(v) for v in row]) for e, x in data.items() for t, row in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize(
    "stages", [[("ema", 0.4)], [("limit", 5.0)], [("ema", 0.4), ("limit", 5.0)], [("ema", 0.05), ("limit", 1.0)]]
)
@pytest.mark.parametrize("size", [8, 1000])
def test_matches_the_sequential_filter(spark, stages, size):
    data = episodes()
    got = S.recurrence(table(spark, data), "action", "out", stages, dim=2, size=size)
    by_episode = {}
    for r in got.collect():
        by_episode.setdefault(r.episode_index, {})[r.frame_index] = r.out
    assert by_episode.keys() == data.keys()
    for e, x in data.items():
        have = np.array([by_episode[e][t] for t in range(len(x))])
        np.testing.assert_allclose(have, sequential(x, stages), rtol=0, atol=1e-8)


def test_small_arrow_batches_carry_state(spark):
    data = episodes()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = S.recurrence(table(spark, data), "action", "out", [("ema", 0.4), ("limit", 5.0)], dim=2).collect()
        blocked = S.recurrence(
            table(spark, data), "action", "out", [("ema", 0.4), ("limit", 5.0)], dim=2, size=16
        ).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {e: sequential(x, [("ema", 0.4), ("limit", 5.0)]) for e, x in data.items()}
    for r in [*rows, *blocked]:
        np.testing.assert_allclose(r.out, want[r.episode_index][r.frame_index], rtol=0, atol=1e-8)


def test_worked_examples(spark):
    data = {0: np.array([[0.0], [10.0], [10.0]]), 1: np.array([[0.0], [100.0]])}
    got = S.smooth(table(spark, data), "action", "medium", dim=1)
    values = {(r.episode_index, r.frame_index): r.smoothed[0] for r in got.collect()}
    assert [round(values[0, t], 9) for t in range(3)] == [0.0, 4.0, 6.4]
    assert values[1, 1] == 5.0
    custom = S.smooth(table(spark, data), "action", "custom", dim=1, alpha=0.4, max_delta=5.0)
    assert sorted(map(str, custom.collect())) == sorted(map(str, got.collect()))
    for bad in ("custom", "strong"):
        with pytest.raises(ValueError):
            S.smooth(table(spark, data), "action", bad, dim=1)


def test_limited_steps_stay_below_the_limit(spark):
    got = S.limit_velocity(table(spark, episodes()), "action", 2.0, dim=2, size=8)
    series = {}
    for r in got.orderBy("frame_index").collect():
        series.setdefault(r.episode_index, []).append(r.limited)
    for values in series.values():
        if len(values) > 1:
            assert np.abs(np.diff(np.array(values), axis=0)).max() <= 2.0 + 1e-9


def test_advance_modes_differ_only_in_the_rows_seen(spark):
    rows = [("r", 0, c, s, [float(c * 100 + s)]) for c in range(3) for s in range(16)]
    pred = spark.createDataFrame(rows, "run string, episode_index long, chunk long, step int, action array<double>")
    full = S.smooth_predictions(pred, advance="horizon", dim=1)
    sent = S.smooth_predictions(pred, advance="executed", dim=1)
    assert full.count() == 48 and sent.count() == 24
    x = np.array([[float(c * 100 + s)] for c in range(3) for s in range(8)])
    want = sequential(x, [("ema", 0.4), ("limit", 5.0)])
    have = np.array([r.smoothed for r in sent.orderBy("chunk", "step").collect()])
    np.testing.assert_allclose(have, want)
    with pytest.raises(ValueError):
        S.smooth_predictions(pred, advance="never")


def test_newest_chunk_wins(spark):
    rows = [("r", 0, c, s, [float(c)]) for c in range(3) for s in range(16)]
    pred = spark.createDataFrame(rows, "run string, episode_index long, chunk long, step int, action array<double>")
    every_four = S.execute_chunks(pred, k=8, stride=4)
    got = {r.frame_index: r.chunk for r in every_four.collect()}
    assert got == {t: min(t // 4, 2) for t in range(16)}
    assert every_four.filter(F.get("action", F.lit(0)) != F.col("chunk")).count() == 0


@pytest.mark.parametrize("piece", [1, 4, 256])
@pytest.mark.parametrize("stages", [[("ema", 0.3), ("limit", 2.0)], [("limit", 50.0)], [("ema", 0.01)]])
def test_pieces_match_the_sequential_filter(monkeypatch, piece, stages):
    monkeypatch.setattr(S, "PIECE", piece)
    data = [*episodes(dim=3).values(), np.tile(np.arange(30.0)[:, None] * -9, (1, 3))]
    lens = np.array([len(d) for d in data])
    starts = np.cumsum(lens) - lens
    states = [np.zeros((len(data), 3)) for _ in stages]
    got = S.advance(np.concatenate(data), starts, lens, np.zeros(len(data), bool), states, stages)
    for i, (start, d) in enumerate(zip(starts, data, strict=True)):
        want = sequential(d, stages)
        np.testing.assert_allclose(got[start : start + len(d)], want, rtol=0, atol=1e-8)
        np.testing.assert_allclose(states[-1][i], want[-1], atol=1e-8)
