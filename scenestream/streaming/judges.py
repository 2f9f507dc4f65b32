"""The rules as judges of frames: the conditions and orders of the batch rules, with their state by track, pair or wire."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from math import sqrt

import pyarrow as pa

from ..operators import tripwire as tw
from .frames import Frame, Judge, Key, Memory, _dicts, _values

# How long a track is remembered at least: a longer gap between two processed frames ends what stands on frames in a row.
KEEP_MS = 60_000


def _ready(fired: int | None, ms: int, wait_ms: int) -> bool:
    return fired is None or ms - fired >= wait_ms


class Unbroken(Judge):
    """Seen in ``confirm`` processed frames in a row."""

    state = "seq bigint, run bigint, fired bigint"

    def __init__(self, confirm: int, wait_ms: int):
        self.confirm, self.wait_ms, self.keep_ms = confirm, wait_ms, max(3 * wait_ms, KEEP_MS)

    def frame(self, frame: Frame, rows: list[dict], memory: Memory) -> Iterable[dict]:
        for r in rows:
            was = memory.get("track", r["track_id"]) or {}
            joined = was.get("seq") is not None and was["seq"] == frame.prev_seq
            run, fired = was["run"] + 1 if joined else 1, was.get("fired")
            fire = run >= self.confirm and _ready(fired, frame.ms, self.wait_ms)
            memory.put(frame.ms, "track", r["track_id"], seq=frame.seq, run=run, fired=frame.ms if fire else fired)
            if fire:
                yield r


class Staying(Judge):
    """Visible without a break for ``limit_ms``, on ``confirm`` sightings in a row."""

    state = "seq bigint, since bigint, run bigint, fired bigint"
    adds = "dwell_ms bigint"

    def __init__(self, limit_ms: int, confirm: int, wait_ms: int):
        self.limit_ms, self.confirm, self.wait_ms, self.keep_ms = limit_ms, confirm, wait_ms, max(3 * wait_ms, KEEP_MS)

    def frame(self, frame: Frame, rows: list[dict], memory: Memory) -> Iterable[dict]:
        for r in rows:
            was = memory.get("track", r["track_id"]) or {}
            same = was.get("seq") is not None and was["seq"] == frame.prev_seq
            since, fired = was["since"] if same else frame.ms, was.get("fired")
            held = frame.ms - since >= self.limit_ms
            run = (was.get("run") or 0) + 1 if held else 0
            fire = held and run >= self.confirm and _ready(fired, frame.ms, self.wait_ms)
            memory.put(frame.ms, "track", r["track_id"], seq=frame.seq, since=since, run=run, fired=frame.ms if fire else fired)
            if fire:
                yield {**r, "dwell_ms": frame.ms - since}


class Visits(Judge):
    """One row for each unbroken visibility of a track, once a processed frame of its camera, or a long silence, shows that it is over."""

    state = "since bigint, seq bigint, frames bigint"
    adds = "start_ms bigint, end_ms bigint, n_frames bigint"

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def frame(self, frame: Frame, rows: list[dict], memory: Memory) -> Iterable[dict]:
        here = {r["track_id"]: r for r in rows}
        for key, was in sorted(memory.part("track")):
            if key[1] not in here:
                memory.drop(key)
                yield from self.forgotten(key, was)
        for t in here:
            was = memory.get("track", t) or {"since": frame.ms, "frames": 0}
            memory.put(frame.ms, "track", t, since=was["since"], seq=frame.seq, frames=was["frames"] + 1)


    def forgotten(self, key: Key, was: dict) -> Iterable[dict]:
        yield {"track_id": key[1], "start_ms": was["since"], "end_ms": was["seen"], "n_frames": was["frames"], "frame_seq": was["seq"], "frame_ms": was["seen"]}


class Close(Judge):
    """A person and a vehicle nearer than ``distance`` on ``confirm`` shared frames in a row; state by pair."""

    state = "run bigint, fired bigint"
    adds = "p_track bigint, v_track bigint, p_idx bigint, v_idx bigint, p_class string, v_class string, p_x double, p_y double, v_x double, v_y double, dist double"

    def __init__(self, distance: float, confirm: int, wait_ms: int, keep_ms: int):
        self.distance, self.confirm, self.wait_ms, self.keep_ms = distance, confirm, wait_ms, keep_ms

    def frame(self, frame: Frame, rows: list[dict], memory: Memory) -> Iterable[dict]:
        persons = [r for r in rows if r["class_name"] == "person"]
        vehicles = sorted((r for r in rows if r["class_name"] != "person"), key=lambda r: r["cx"])
        by_track = {r["track_id"]: r for r in vehicles}
        for p in persons:
            # Vehicles in the strip around the person, and those it was near to before: only these can start or end a run.
            seen = {v["track_id"]: v for v in _strip(vehicles, p["cx"], self.distance)}
            seen |= {t: by_track[t] for t in map(int, memory.running_names("pair", p["track_id"])) if t in by_track}
            for v in sorted(seen.values(), key=lambda v: v["det_idx"]):
                dx, dy = p["cx"] - v["cx"], p["y2"] - v["y2"]
                dist = sqrt(dx * dx + dy * dy)
                was = memory.get("pair", p["track_id"], str(v["track_id"])) or {}
                run, fired = (was.get("run") or 0) + 1 if dist < self.distance else 0, was.get("fired")
                fire = run >= self.confirm and _ready(fired, frame.ms, self.wait_ms)
                if run or was:
                    memory.put(frame.ms, "pair", p["track_id"], str(v["track_id"]), run=run, fired=frame.ms if fire else fired)
                if fire:
                    yield {
                        "frame_seq": frame.seq, "frame_ms": frame.ms, "camera_id": p["camera_id"], "dist": dist, "p_track": p["track_id"], "v_track": v["track_id"],
                        "p_idx": p["det_idx"], "v_idx": v["det_idx"], "p_class": p["class_name"], "v_class": v["class_name"],
                        "p_x": p["cx"], "p_y": p["y2"], "v_x": v["cx"], "v_y": v["y2"],
                    }


def _strip(by_x: list[dict], x: float, radius: float) -> Iterable[dict]:
    """Rows (sorted by cx) within ``radius`` of ``x`` along the x axis, a rounding error more."""
    lo, hi = 0, len(by_x)
    edge = x - radius * (1 + 1e-9) - 1e-9
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if by_x[mid]["cx"] < edge else (lo, mid)
    end = x + radius * (1 + 1e-9) + 1e-9
    while lo < len(by_x) and by_x[lo]["cx"] <= end:
        yield by_x[lo]
        lo += 1


def _company(rows: list[dict], radius: float) -> list[list[dict]]:
    """For each row the others nearer than ``radius``, by their place on the x axis."""
    by_x = sorted(rows, key=lambda r: r["cx"])
    near = []
    for r in rows:
        others = []
        for o in _strip(by_x, r["cx"], radius):
            dx, dy = r["cx"] - o["cx"], r["cy"] - o["cy"]
            if o["det_idx"] != r["det_idx"] and sqrt(dx * dx + dy * dy) < radius:
                others.append(o)
        near.append(others)
    return near


class FirstInFrame(Judge):
    """Persons of a frame in order; the first one confirmed and not cooling down fires and ends its frame.

    A processed frame with fewer than ``least`` persons ends all runs.
    """

    state = "run bigint, fired bigint"

    def __init__(self, least: int, confirm: int, wait_ms: int, keep_ms: int):
        self.least, self.confirm, self.wait_ms, self.keep_ms = least, confirm, wait_ms, keep_ms

    def hits(self, frame: Frame, rows: list[dict], memory: Memory) -> list[tuple[bool, dict]]:
        raise NotImplementedError

    def frame(self, frame: Frame, rows: list[dict], memory: Memory) -> Iterable[dict]:
        hits = self.hits(frame, rows, memory)
        if len(rows) < self.least:
            for key, was in memory.running("run"):
                memory.put(was["seen"], *key, run=0, fired=was["fired"])
            return
        for hit, out in hits:
            was = memory.get("run", out["track_id"]) or {}
            run, fired = (was.get("run") or 0) + 1 if hit else 0, was.get("fired")
            fire = run >= self.confirm and _ready(fired, frame.ms, self.wait_ms)
            if run or was:
                memory.put(frame.ms, "run", out["track_id"], run=run, fired=frame.ms if fire else fired)
            if fire:
                yield out
                return


class Crowding(FirstInFrame):
    adds = "heads bigint, nearby bigint"

    def __init__(self, max_count: int, radius: float, confirm: int, wait_ms: int, keep_ms: int):
        super().__init__(max_count + 1, confirm, wait_ms, keep_ms)
        self.max_count, self.radius = max_count, radius

    def hits(self, frame: Frame, rows: list[dict], memory: Memory) -> list[tuple[bool, dict]]:
        if len(rows) < self.least:
            return []
        near = _company(rows, self.radius)
        return [(len(o) + 1 > self.max_count, {**r, "heads": len(rows), "nearby": len(o) + 1}) for r, o in zip(rows, near)]


class Fighting(FirstInFrame):
    """Fast persons with others near; wrists are remembered while a person stays in view."""

    state = "run bigint, fired bigint, seq bigint, ms bigint, cx double, cy double, hands array<double>"
    adds = "heads bigint, involved_count bigint, avg_speed double, top_speed double, has_pose boolean"

    def __init__(self, radius: float, min_speed: float, min_persons: int, confirm: int, wait_ms: int, keep_ms: int):
        super().__init__(min_persons, confirm, wait_ms, keep_ms)
        self.radius, self.min_speed, self.min_persons = radius, min_speed, min_persons

    def hits(self, frame: Frame, rows: list[dict], memory: Memory) -> list[tuple[bool, dict]]:
        own, limb = {}, {}
        for r in rows:
            was = memory.get("track", r["track_id"])
            was = was if was and was["seq"] == frame.prev_seq else None
            hands = [h for h in zip((r["h1_x"], r["h2_x"]), (r["h1_y"], r["h2_y"])) if h[0] is not None]
            old = list(zip(was["hands"][::2], was["hands"][1::2])) if was and was["hands"] else []
            dt = (frame.ms - was["ms"]) / 1000.0 if was else 0
            dx, dy = (r["cx"] - was["cx"], r["cy"] - was["cy"]) if was else (0.0, 0.0)
            own[r["det_idx"]] = sqrt(dx * dx + dy * dy) / dt if dt > 0 else 0.0
            moves = [sqrt((a - c) * (a - c) + (b - d) * (b - d)) for a, b in hands for c, d in old]
            limb[r["det_idx"]] = max(moves) / dt if dt > 0 and moves else 0.0
            kept = [c for h in hands for c in h] if hands else was["hands"] if was else None
            memory.put(frame.ms, "track", r["track_id"], seq=frame.seq, ms=frame.ms, cx=r["cx"], cy=r["cy"], hands=kept)
        if len(rows) < self.least:
            return []
        out = []
        for r, others in zip(rows, _company(rows, self.radius)):
            i, n = r["det_idx"], len(others) + 1
            top = max(own[i], limb[i] * 0.6)
            total = sum((own[o["det_idx"]] for o in others), 0.0)
            posed = any(limb[o["det_idx"]] > 0 for o in [r, *others])
            row = {**r, "heads": len(rows), "involved_count": n, "avg_speed": (own[i] + total) / n, "top_speed": top, "has_pose": posed}
            out.append((len(others) >= self.min_persons - 1 and top > self.min_speed, row))
        return out


class Falling(Judge):
    """Lying, fallen by key points, or suddenly wider and lower than at the sighting before."""

    state = "seq bigint, ratio double, cy double, run bigint, fired bigint"
    adds = "sign string, ratio_change double, y_drop double"

    def __init__(self, ratio_threshold: float, min_ratio_change: float, min_y_drop: float, confirm: int, wait_ms: int, keep_ms: int):
        self.ratio_threshold, self.min_ratio_change, self.min_y_drop = ratio_threshold, min_ratio_change, min_y_drop
        self.confirm, self.wait_ms, self.keep_ms = confirm, wait_ms, keep_ms

    def frame(self, frame: Frame, rows: list[dict], memory: Memory) -> Iterable[dict]:
        for r in rows:
            was = memory.get("track", r["track_id"]) or {}
            same = was.get("seq") is not None and was["seq"] == frame.prev_seq
            ratio, before = r["ratio"], was.get("ratio") if same else None
            run, fired, fire = was.get("run") or 0, was.get("fired"), False
            change = drop = sign = None
            if ratio is not None:
                if before is not None:
                    change, drop = ratio - before, r["cy"] - was["cy"]
                sign = "pose" if r["fallen"] else "lying" if ratio > 1.3 else "drop" if before is not None else None
            if sign:
                hit = sign != "drop" or (ratio > self.ratio_threshold and change > self.min_ratio_change and drop > self.min_y_drop)
                run = run + 1 if hit else 0
                fire = hit and run >= self.confirm and _ready(fired, frame.ms, self.wait_ms)
            keep = (ratio, r["cy"]) if ratio is not None else (before, was.get("cy") if same else None)
            memory.put(frame.ms, "track", r["track_id"], seq=frame.seq, ratio=keep[0], cy=keep[1], run=run, fired=frame.ms if fire else fired)
            if fire:
                yield {**r, "sign": sign, "ratio_change": change, "y_drop": drop}


# --- wires ----------------------------------------------------------------------------------------

Place = tuple[float, float]


def _side(p: Place, a: Place, b: Place) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _on(q: Place, a: Place, b: Place) -> bool:
    return min(a[0], b[0]) <= q[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= q[1] <= max(a[1], b[1])


def move_sign(was: Place, now: Place, a: Place, b: Place) -> int:
    """Side of the wire a-b on which a move ends that meets it; 0 when it does not, or ends on its line."""
    end, start = _side(now, a, b), _side(was, a, b)
    wa, wb = _side(a, was, now), _side(b, was, now)
    meets = (start * end < 0 and wa * wb < 0) or (start == 0 and _on(was, a, b)) or (wa == 0 and _on(a, was, now)) or (wb == 0 and _on(b, was, now))
    return (1 if end > 0 else -1) if meets and end != 0 else 0


def _direction(sign: int, orientation: str) -> str:
    return "in" if (sign > 0) == (orientation == "left_to_right") else "out"


class Wires(Judge):
    """Directed crossings: the first of each wire in each life of a track, and changes of side of boxes without a track.

    ``wires`` are configuration rows as of ``tripwire.wires``. The last 30 places of a track and the wires it has crossed are
    remembered for a life, the boxes of the frame before for three seconds, the firings of a class at a wire for its cooldown.
    """

    state = "places array<double>, crossed array<string>, boxes array<double>, names array<string>, at bigint"
    adds = "tripwire_id string, name string, direction string, cooldown_ms bigint, method string"

    def __init__(self, wires: Sequence[tuple]):
        self.wires: dict[str, list[dict]] = {}
        for w in wires:
            names = ("camera_id", "tripwire_id", "name", "ax", "ay", "bx", "by", "direction", "cooldown_ms")
            wire = dict(zip(names, w))
            self.wires.setdefault(w[0], []).append({**wire, "a": (wire["ax"], wire["ay"]), "b": (wire["bx"], wire["by"])})
        longest = max((w["cooldown_ms"] for ws in self.wires.values() for w in ws), default=0)
        self.keep_ms = max(tw.LIFE_GAP_MS, longest) + 1

    def frames(self, frames: list[Frame], starts: list[int], rows: pa.RecordBatch, memory: Memory) -> Iterable[dict]:
        """Columns are read once for all frames; a track and the boxes behind go into the memory once, with their last change."""
        if not len(rows):
            return
        wires = self.wires.get(rows.column("camera_id")[0].as_py(), [])
        track, names = (_values(rows.column(c)) for c in ("track_id", "class_name"))
        boxes = list(zip(*(_values(rows.column(c)) for c in _BOX)))
        lives: dict[int, list] = {}  # when a track was seen, its places, the wires it has crossed
        fired: list[tuple[int, dict, int, str]] = []
        at, behind = None, []
        if was := memory.get("behind"):
            at, behind = was["at"], [was["boxes"][k : k + len(_BOX)] for k in range(0, len(was["boxes"]), len(_BOX))]
        for frame, a, z in zip(frames, starts, starts[1:]):
            if a == z:
                continue
            loose = []
            for i in range(a, z):
                if track[i] >= 0:
                    for w, sign in self._tracked(frame.ms, track[i], boxes[i], wires, lives, memory):
                        memory.put(frame.ms, "mark", 0, f"{w['tripwire_id']}|{names[i]}", at=frame.ms)
                        fired.append((i, w, sign, "tracked"))
                else:
                    loose.append(i)
            if loose and at is not None and frame.ms - at < tw.UNTRACKED_LIFE_MS:
                fired += ((i, w, sign, "untracked") for i, w, sign in self._loose(frame.ms, loose, boxes, names, behind, wires, memory))
            at, behind = frame.ms, [boxes[i] for i in loose] or boxes[a:z]
        for t, (seen, places, crossed) in lives.items():
            memory.put(seen, "track", t, places=places, crossed=crossed)
        if at is not None:
            memory.put(at, "behind", boxes=[float(v) for b in behind for v in b], at=at)
        for r, (_, w, sign, method) in zip(_dicts(rows.take(pa.array([f[0] for f in fired], pa.int64()))), fired):
            own = {"direction": _direction(sign, w["direction"]), "method": method, **({"track_id": -1} if method == "untracked" else {})}
            yield {**r, **{n: w[n] for n in ("tripwire_id", "name", "cooldown_ms")}, **own}

    def _tracked(self, ms: int, track: int, box: tuple, wires: list[dict], lives: dict[int, list], memory: Memory) -> Iterable[tuple[dict, int]]:
        """Wires crossed for the first time, with the side."""
        foot, x, mid = box[5:]
        life = lives.get(track)
        if life is None:
            was = memory.get("track", track)
            life = lives[track] = [was["seen"], list(was["places"]), list(was["crossed"])] if was else [None, [], []]
        seen, places, crossed = life
        moves = []
        if seen is not None and ms - seen <= tw.LIFE_GAP_MS:
            _, px, pmid, pfoot = places[-4:]
            moves = [(px, pfoot, foot), (px, pmid, mid)]
        else:
            places, crossed = life[1:] = [], []
        life[0] = ms
        places += (float(ms), x, mid, foot)
        if len(places) > 4 * tw.HISTORY_ROWS:
            del places[:4]
        first, px, pmid, pfoot = places[:4]
        if tw.HISTORY_MIN_MS < ms - first < tw.HISTORY_MAX_MS:
            moves += [(px, pfoot, foot), (px, pmid, mid)]
        hits = []
        for w in wires:
            if w["tripwire_id"] in crossed:
                continue
            (ax, ay), (bx, by) = a, b = w["a"], w["b"]
            for px, py, y in moves:
                start, end = (bx - ax) * (py - ay) - (by - ay) * (px - ax), (bx - ax) * (y - ay) - (by - ay) * (x - ax)
                # Most moves lie on one side, with no end of the wire on them.
                if start * end > 0 and not (px <= ax <= x or x <= ax <= px or px <= bx <= x or x <= bx <= px):
                    continue
                sign = move_sign((px, py), (x, y), a, b)
                if sign:
                    crossed.append(w["tripwire_id"])
                    hits.append((w, sign))
                    break
        return hits

    def _loose(self, ms: int, loose: list[int], boxes: list[tuple], names: list[str], old: list, wires: list[dict], memory: Memory) -> Iterable[tuple[int, dict, int]]:
        """Boxes without a track that changed sides, the first of its class at each wire."""
        found: dict[tuple[str, str], tuple[int, dict, int]] = {}
        for i in loose:
            det, kind, x1, y1, x2, y2, cx, _ = boxes[i]
            match = _nearest(boxes[i], [o for o in old if o[1] == kind])
            if match is None or match[2] < max(x2 - x1, y2 - y1, 1.0) * 0.05:
                continue
            for w in wires:
                now, was = _side((cx, y2), w["a"], w["b"]), _side((match[0], match[1]), w["a"], w["b"])
                if now > 0 > was or now < 0 < was:
                    key = (w["tripwire_id"], names[i])
                    if key not in found or det < boxes[found[key][0]][0]:
                        found[key] = (i, w, 1 if now > 0 else -1)
        for key, (i, w, sign) in sorted(found.items()):
            name = f"{key[0]}|{key[1]}"
            mark, last = memory.get("mark", 0, name), memory.get("loose", 0, name)
            wait = max(1, min(w["cooldown_ms"], tw.UNTRACKED_WAIT_MS))
            if mark and not _ready(mark["at"], ms, w["cooldown_ms"]):
                continue
            if _ready(last["at"] if last else None, ms, wait):
                memory.put(ms, "loose", 0, name, at=ms)
                yield i, w, sign


_BOX = ("det_idx", "class_id", "x1", "y1", "x2", "y2", "cx", "cy")


def _nearest(r: tuple, old: list) -> tuple[float, float, float] | None:
    """Foot and distance of the box before: best overlap of 0.01 or more, else the nearest centre within three box sizes, else any overlap."""
    over, near = None, None
    _, _, ax, ay, bx, by, mx, my = r
    size = max(bx - ax, by - ay, 1.0)
    for idx, _, x1, y1, x2, y2, cx, cy in old:
        dx, dy = cx - mx, cy - my
        shift = sqrt(dx * dx + dy * dy)
        ov = max(0.0, min(bx, x2) - max(ax, x1)) * max(0.0, min(by, y2) - max(ay, y1))
        if ov > 0:
            areas = (bx - ax) * (by - ay) + (x2 - x1) * (y2 - y1)
            over = max(over, (ov / (areas - ov), -idx, cx, y2, shift)) if over else (ov / (areas - ov), -idx, cx, y2, shift)
        if shift < size * 3:
            near = min(near, (shift, idx, cx, y2, shift)) if near else (shift, idx, cx, y2, shift)
    best = over if over and over[0] >= 0.01 else near or over
    return best[2:] if best else None
