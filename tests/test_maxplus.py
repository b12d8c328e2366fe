"""The resolver and the low-pass against plain loops."""

import math

import numpy as np
import pytest

from stridegrid.operators import recurrences as R
from stridegrid.operators import tracking as TK
from stridegrid.operators.maxplus import Frames, entries, forward, picks, product
from stridegrid.plans.blocks import Line

COST = TK._path_cost(1000.0)


def timeline(seed, n):
    """Frames of 0 to 3 candidates: (x, y, reward or None)."""
    rng = np.random.default_rng(seed)
    out, x = [], 400.0
    for t in range(n):
        x += rng.normal(0, 25) + (300 if t % 37 == 0 else 0)
        frame = [(x, 300.0, 0.1 + rng.normal(0, 0.15))] if rng.random() < 0.85 else []
        frame += [(rng.uniform(0, 1900), 300.0, rng.normal(-0.1, 0.2)) for _ in range(rng.integers(0, 3))]
        out.append([(a, b, None if rng.random() < 0.1 else float(r)) for a, b, r in frame])
    return out


def plain(frames):
    """The best path by one loop over frames; the last number of a frame is absence."""
    best, backs = None, []
    for t, now in enumerate(frames):
        gain = [-math.inf if r is None else r for _, _, r in now] + [0.0]
        if t == 0:
            best, backs = gain, [[-1] * len(gain)]
            continue
        before, scores, back = frames[t - 1], [], []
        for j in range(len(gain)):
            options = []
            for i, v in enumerate(best):
                if i == len(before) and j == len(now):
                    cost = 0.0
                elif i == len(before) or j == len(now):
                    cost = 0.10
                else:
                    jump = math.hypot(now[j][0] - before[i][0], now[j][1] - before[i][1]) / 1000.0
                    cost = 0.6 * jump + (0.45 if jump > 0.12 else 0.0)
                options.append(v - cost)
            back.append(options.index(max(options)))
            scores.append(max(options) + gain[j])
        best = scores
        backs.append(back)
    now, path = best.index(max(best)), []
    for back in backs[::-1]:
        path.append(now)
        now = back[now]
    return path[::-1]


def arrays(frames):
    return Frames.of(*([[c[k] for c in f] for f in frames] for k in (0, 1)), [[math.nan if c[2] is None else c[2] for c in f] for f in frames], COST)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 333])
def test_lanes_find_the_path_of_one_loop(n):
    frames = timeline(n, n)
    held = arrays(frames)
    score, back = forward(held, held.gain[0])
    whole = (held.gain[0][:, None] + product(held)).max(axis=0)
    assert np.allclose(score, whole) and np.isfinite(score[-1])
    path = picks(held, back, int(score.argmax()))
    assert np.minimum(path, held.size).tolist() == plain(frames)
    assert entries(held, back)[int(score.argmax())] == path[0]


@pytest.mark.parametrize("block", [7, 200, 65_536])
def test_resolver_does_not_depend_on_the_block_size(spark, block):
    runs = {1: timeline(1, 430), 2: timeline(2, 7), 3: timeline(3, 1), 4: [[], [], []]}
    rows = []
    for run, frames in runs.items():
        for t, frame in enumerate(frames):
            rows += [(run, 3 * t, i, x - 40, y, x + 40, y, None if r is None else r + 0.62) for i, (x, y, r) in enumerate(frame)]
            rows += [(run, 3 * t, None, *[None] * 5)] if not frame else []
    schema = "run_id int, frame_index long, cand_idx int, x1 double, y1 double, x2 double, y2 double, gallery double, shape double, distractor double"
    df = spark.createDataFrame([(*r, None, None) for r in rows], schema)
    out = TK.viterbi_resolve(df, 1000.0, Line(block=block), hard_floor=-9.0).orderBy("run_id", "frame_index").toPandas()
    for run, frames in runs.items():
        got = out[out.run_id == run]
        want = [-1 if p == len(f) else p for p, f in zip(plain(frames), frames)]
        assert got.cand_idx.tolist() == want and (got.frame_index == 3 * np.arange(len(frames))).all()
        assert ((got.state == "present") == (got.cand_idx >= 0)).all()


def test_an_empty_table_resolves_to_nothing(spark):
    schema = "run_id int, frame_index long, cand_idx int, x1 double, y1 double, x2 double, y2 double, gallery double, shape double, distractor double"
    assert TK.viterbi_resolve(spark.createDataFrame([], schema), 1000.0).count() == 0


@pytest.mark.parametrize("n", [1, 5, 128, 129, 1000])
@pytest.mark.parametrize("fps, cutoff", [(30.0, 6.0), (120.0, 1.0)])
def test_chunks_filter_as_one_loop_does(n, fps, cutoff):
    b, a = R.lowpass_coefficients(fps, cutoff)
    held = R.ChunkFilter.of(b, a)
    x = np.cumsum(np.random.default_rng(n).normal(size=(n, 3)), axis=0)
    z, want = np.outer(held.settled, x[0]), []
    for row in x:
        y = b[0] * row + z[0]
        z = b[1:, None] * row - a[1:, None] * y + np.vstack([z[1:], np.zeros((1, 3))])
        want.append(y)
    assert np.allclose(held.run(x), want, rtol=0, atol=(1e-10 if cutoff > 2 else 1e-7) * np.abs(x).max())
    assert np.allclose(held.run(np.ones((n, 1))), 1.0, atol=1e-7)
