"""How often the segment stream goes to its state, and what it makes of odd frames."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest

from stridegrid.streaming import segments
from stridegrid.streaming.segments import SegmentProcessor, clear_strips


class Handle:
    """States of one key in memory that count the calls."""

    def __init__(self):
        self.calls = Counter()

    def _state(self, name, **methods):
        def counted(method, call):
            def run(*args):
                self.calls[f"{name}.{method}"] += 1
                return call(*args)

            return run

        return type("State", (), {k: staticmethod(counted(k, v)) for k, v in methods.items()})

    def getValueState(self, name, schema):
        held = []
        return self._state(name, exists=lambda: bool(held), get=lambda: held[0], update=lambda v: held.__setitem__(slice(None), [v]), clear=held.clear)

    def getListState(self, name, schema):
        held = []
        return self._state(
            name, exists=lambda: bool(held), get=lambda: iter(list(held)), put=lambda v: held.__setitem__(slice(None), v), appendList=held.extend, clear=held.clear
        )

    def getMapState(self, name, *schemas):
        held = {}
        return self._state(
            name, containsKey=lambda k: k in held, getValue=held.get, updateValue=held.__setitem__, iterator=lambda: iter(list(held.items()))
        )


def video(frames=160, cut_every=40):
    rng = np.random.default_rng(2)
    rows = []
    for f in range(frames):
        for d in range(rng.integers(1, 5)):
            x, y = rng.uniform(0, 300, 2)
            rows.append((f, d, x, y, x + 80, y + 200, f % cut_every == cut_every - 1, float(d), float(f % 5)))
    rows += [(f, 0, *[np.nan] * 4, True, np.nan, np.nan) for f in (frames, frames + 1)]
    return pd.DataFrame(rows, columns=["frame", "det_id", "x1", "y1", "x2", "y2", "scene_change", "tab_a", "tab_b"]).assign(video_id=1)


def fed(parts):
    handle, p = Handle(), SegmentProcessor(list(parts[0].columns), 2, None)
    p.init(handle)
    out = [o for part in parts for o in p.handleInputRows((1,), iter([part]), None)]
    return sorted(pd.concat(out).itertuples(index=False, name=None)), handle.calls


def test_segments_inside_a_micro_batch_stay_out_of_the_state():
    rows = video()
    once, calls = fed([rows])
    assert {r[3] for r in once} == {0, 1, 2, 3}
    assert calls["open.appendList"] == 0 and calls["book.update"] == 0 and calls["place.update"] == 1
    assert calls["people.iterator"] == calls["people.containsKey"] == 0
    people = len({r[4] for r in once})
    assert 0 < calls["people.updateValue"] <= people  # once each
    borders = [0, 25, 90, 200, 333, len(rows)]
    apart, calls = fed([rows.iloc[a:b] for a, b in zip(borders, borders[1:])])
    assert apart == once and calls["open.appendList"] > 0 and calls["book.update"] > 0
    assert fed([rows.iloc[i : i + 1] for i in range(len(rows))])[0] == once


@pytest.mark.parametrize("pairs", [1, 40, 1_000_000])
def test_strips_are_compared_frame_by_frame(monkeypatch, pairs):
    monkeypatch.setattr(segments, "PAIRS", pairs)
    rows = video().iloc[:-2]
    frame, det, boxes = rows.frame.to_numpy(), rows.det_id.to_numpy(), rows[["x1", "y1", "x2", "y2"]].to_numpy()
    want = []
    for i in range(len(rows)):
        x, y, w, h = boxes[i, 0], boxes[i, 1], boxes[i, 2] - boxes[i, 0], boxes[i, 3] - boxes[i, 1]
        strip = (x + 0.30 * w, y + 0.55 * h, x + 0.70 * w, y + 0.92 * h)
        whole, clear = (strip[2] - strip[0]) * (strip[3] - strip[1]), True
        for j in np.flatnonzero((frame == frame[i]) & (det != det[i])):
            wide = min(strip[2], boxes[j, 2]) - max(strip[0], boxes[j, 0])
            high = min(strip[3], boxes[j, 3]) - max(strip[1], boxes[j, 1])
            clear &= max(wide, 0) * max(high, 0) / whole <= 0.15
        want.append(clear)
    assert clear_strips(frame, det, boxes).tolist() == want and not all(want)
    assert len(clear_strips(frame[:0], det[:0], boxes[:0])) == 0
