"""Plain one-reading-at-a-time loops that the distributed operators are compared with."""

import numpy as np


def slope(points, min_span_ms):
    """Least-squares slope per minute of (ms, value) pairs, None without three over the least span."""
    points = np.array([p for p in points if p[1] is not None], dtype=float).reshape(-1, 2)
    if len(points) < 3 or np.ptp(points[:, 0]) < min_span_ms or np.ptp(points[:, 0]) == 0:
        return None
    minutes = (points[:, 0] - points[0, 0]) / 60_000
    return float(np.polyfit(minutes, points[:, 1], 1)[0])


def rates(rows, cfg):
    """Rows (ms, air, heater) in arrival order, sorted by time; pairs of rates."""
    result = []
    for at, (now, _, _) in enumerate(rows):
        sample = [rows[at]]
        for earlier in reversed(rows[:at]):
            if earlier[0] < now - cfg.window_ms or sample[-1][0] - earlier[0] > cfg.max_gap_ms:
                break
            sample.append(earlier)
        sample.reverse()
        result.append(tuple(slope([(r[0], r[c]) for r in sample], cfg.span_ms) for c in (1, 2)))
    return result


def top(values):
    return max((v for v in values if v is not None), default=None)


def sessions(rows, cfg, heater_rates=None):
    """Sessions of rows (ms, air, heater) in arrival order; late rows are stored but not looked at.

    First the rows that set or reset the detector are marked, from the rows alone; then a session
    is whatever lies between a set row met while none is open and the next reset row.
    """
    heater_rates = heater_rates or [None] * len(rows)
    marks, run, warm, newest = [], [], None, None
    for at, (now, _, heater) in enumerate(rows):
        if newest is not None and now <= newest:
            continue
        hot = heater is not None and heater >= cfg.start_c
        run = (run if run and now - newest <= cfg.max_gap_ms else []) + [now] if hot else []
        cold = heater is not None and heater < cfg.end_c
        reset = cold and (warm is None or now - warm >= cfg.hold_ms)
        warm = now if heater is not None and heater >= cfg.end_c else warm
        marks.append((at, run[0] if len(run) == cfg.start_samples else None, reset, warm))
        newest = now
    found, members = [], None
    for at, start, reset, warm in marks:
        now = rows[at][0]
        if members is None and start is not None:
            members = [i for i in range(at + 1) if start <= rows[i][0] <= now]
            found.append({"start": start, "end": None})
        elif members is not None:
            members.append(at)
        if members is None:
            continue
        air, heater = zip(*(rows[i][1:] for i in members))
        found[-1] |= {"hot": warm, "rows": len(members), "air": top(air), "heater": top(heater),
                      "rate": top(heater_rates[i] for i in members)}
        if reset:
            found[-1]["end"], members = warm, None
    return found
