"""Hand fixtures, and folds against plain loops on random sequences."""

import bisect
import math
import random
import time
from collections import Counter

import pytest
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seqloom.functions import arrays
from seqloom.operators import metrics, postprocess, quantiles, sampling, segments, series

NAMES = {"n": "none", "l": "left", "r": "right", "h": "hazard", "b": "both"}


def track(spark, *texts):
    rows = [(f"s{k}", k, 2 * i, NAMES[c]) for k, t in enumerate(texts) for i, c in enumerate(t)]
    return spark.createDataFrame(rows, "sequence_id string, track_id long, frame_id long, label string")


def text(df, k=0, label="label"):
    back = {v: a for a, v in NAMES.items()}
    return "".join(back[r[label]] for r in df.where(F.col("track_id") == k).orderBy("frame_id").collect())


@pytest.mark.parametrize("window,want", [(7, "nlllllllln"), (5, "nnllllllnl"), (3, "nnllllllll"), (11, "nlnlllnlln"), (6, "nlllllllln")])
def test_mode_smoothing(spark, window, want):
    assert text(series.mode_smooth(track(spark, "nlnlllnlln"), window)) == want


def test_durations(spark):
    short = series.minimum_duration(track(spark, "nnnnnllnnnnn"), 3)
    assert text(short) == "n" * 12
    assert [r.original_label for r in short.orderBy("frame_id").collect()][5:7] == ["left", "left"]
    assert text(series.maximum_duration(track(spark, "nllllln"), 3)) == "nlllnnn"


@pytest.mark.parametrize("gap,want", [(2, "nnllllllln"), (1, "nnlnnlllln")])
def test_episodes(spark, gap, want):
    assert text(series.episodes(track(spark, "nnlnnllnln"), gap, 3)) == want


def test_both_signals_are_flagged(spark):
    q = postprocess.quality_flags(track(spark, "nnbbbnn"))
    assert [r.flagged for r in q.orderBy("frame_id").collect()] == [False, False, True, True, True, False, False]


def test_event_matching(spark):
    p = series.events(track(spark, "nnnlllnlrrnn"))
    t = series.events(track(spark, "nnllllnnrrrr"))
    got = metrics.match_events(p, t, series.KEY, 2.0, 1).first()
    loop = greedy([("left", 3, 5), ("left", 7, 7), ("right", 8, 9)], [("left", 2, 5), ("right", 8, 11)], 2.0, 1)
    assert got.tp == loop
    got = metrics.match_events(p, t, series.KEY, 0.5, 1).first()
    assert (got.tp, got.fp, got.fn) == (2, 1, 0)


def greedy(pred, true, iou, tol):
    used, tp = set(), 0
    for label, s, e in pred:
        for k, (m, a, b) in enumerate(true):
            shared = max(0, min(e, b) - max(s, a) + 1)
            over = shared / (e - s + 1 + b - a + 1 - shared)
            if k not in used and m == label and (over >= iou or (abs(s - a) <= tol and abs(e - b) <= tol)):
                used.add(k)
                tp += 1
                break
    return tp


def runs(t):
    out, i = [], 0
    while i < len(t):
        j = i
        while j + 1 < len(t) and t[j + 1] == t[i]:
            j += 1
        if t[i] != "n":
            out.append((NAMES[t[i]], i, j))
        i = j + 1
    return out


def test_event_matching_equals_a_loop(spark):
    r = random.Random(5)
    texts = [("".join(r.choice("nnllrh") for _ in range(n)), "".join(r.choice("nnllrh") for _ in range(n))) for n in [1, 2, *[r.randint(3, 40) for _ in range(60)]]]
    p, t = series.events(track(spark, *[a for a, _ in texts])), series.events(track(spark, *[b for _, b in texts]))
    got = {x.track_id: (x.tp, x.n_pred, x.n_true) for x in metrics.match_events(p, t, series.KEY, 0.5, 1).collect()}
    for k, (a, b) in enumerate(texts):
        want = (greedy(runs(a), runs(b), 0.5, 1), len(runs(a)), len(runs(b)))
        assert got.get(k, (0, 0, 0)) == want


def test_matching_of_a_long_track(spark):
    """Some 50,000 events of one track in seconds, equal to the loop over all pairs near each other."""
    r = random.Random(15)
    a = "".join(r.choice("nnllrh") * r.randint(1, 3) for _ in range(100_000))
    b = "".join(c if r.random() < 0.9 else r.choice("nlrh") for c in a)
    p, t = series.events(track(spark, a)), series.events(track(spark, b))
    began = time.perf_counter()
    got = metrics.match_events(p, t, series.KEY, 0.5, 2).first()
    took = time.perf_counter() - began
    pred, true = runs(a), runs(b)
    starts, used, tp = [s for _, s, _ in true], set(), 0
    for label, s, e in pred:
        for k in range(max(0, bisect.bisect(starts, s - 12) - 2), bisect.bisect(starts, e + 3)):
            m, x, y = true[k]
            shared = max(0, min(e, y) - max(s, x) + 1)
            near = shared / (e - s + 1 + y - x + 1 - shared) >= 0.5 or (abs(s - x) <= 2 and abs(e - y) <= 2)
            if k not in used and m == label and near:
                used.add(k)
                tp += 1
                break
    assert (got.n_pred, got.n_true, got.tp) == (len(pred), len(true), tp) and len(pred) > 40_000 and took < 60


@pytest.mark.parametrize("n,m,want", [(10, 4, [0, 3, 6, 9]), (7, 3, [0, 3, 6]), (25, 10, [0, 2, 5, 8, 10, 13, 16, 18, 21, 24])])
def test_resample(spark, n, m, want):
    got = series.resample(track(spark, "n" * n), 1.0, m / n).orderBy("new_idx").collect()
    assert [r.frame_id // 2 for r in got] == want


def test_propagation(spark):
    f = track(spark, "nnlnnn").withColumn("label", F.when(F.col("frame_id") == 4, "left").when(F.col("frame_id") == 8, "none"))
    assert text(series.propagate(f)) == "llllnn"


@pytest.mark.parametrize("overlap,want", [("first", "llllrr"), ("last", "llrrrr")])
def test_overlapping_segments(spark, overlap, want):
    spine = spark.createDataFrame([(0, i) for i in range(6)], "track_id long, pos long")
    seg = spark.createDataFrame([(0, 0, "left", 0, 3), (0, 1, "right", 2, 5)], "track_id long, seg_ord int, label string, start_frame int, end_frame int")
    got = segments.to_frames(spine, seg, ["track_id"], overlap=overlap).orderBy("pos").collect()
    assert "".join(r.label[0] for r in got) == want


def viterbi(labels):
    states, log = series.STATES, lambda p: math.log(p) if p else -math.inf
    total = 1.3
    emit = [[log((1.0 if s == (x if x in states else "hazard") else 0.1) / total) for s in states] for x in labels]
    score, back = [math.log(0.25) + e for e in emit[0]], []
    for e in emit[1:]:
        ways = [[score[r] + log(series.TRANSITIONS[r][s]) for r in range(4)] for s in range(4)]
        back.append([w.index(max(w)) for w in ways])
        score = [max(w) + e[s] for s, w in enumerate(ways)]
    at = score.index(max(score))
    path = [at]
    for b in reversed(back):
        at = b[at]
        path.append(at)
    return [states[s] for s in reversed(path)]


def test_hmm_equals_a_loop(spark):
    r = random.Random(6)
    texts = ["l", "nl", *["".join(r.choice("nnlrhb") for _ in range(r.randint(1, 60))) for _ in range(40)], "l" * 900]
    got = series.hmm_smooth(track(spark, *texts)).orderBy("track_id", "frame_id").collect()
    want = [x for t in texts for x in viterbi([NAMES[c] for c in t])]
    assert [x.label for x in got] == want


def test_hmm_of_a_long_track(spark):
    """Some hundred blocks; work grows with the track, so this takes seconds."""
    r = random.Random(16)
    t = "".join(r.choice("nnllrhb") * r.randint(1, 4) for _ in range(16_000))
    began = time.perf_counter()
    got = [x.label for x in series.hmm_smooth(track(spark, t)).orderBy("frame_id").collect()]
    assert got == viterbi([NAMES[c] for c in t])
    assert len(t) > 35_000 and time.perf_counter() - began < 40


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 256, 300])
def test_blocks_of_arrays(spark, n):
    got = spark.range(1).select(series.in_blocks(F.array(*map(F.lit, range(n))) if n else F.array().cast("array<int>")).alias("b")).first().b
    assert [x for b in got for x in b] == list(range(n)) and all(0 < len(b) <= series.FOLD for b in got)


def repair_loop(segs, n):
    out, cursor, last = [], 0, n - 1
    for i, (label, s, e) in enumerate(segs):
        if cursor > last:
            break
        s = min(max(cursor if s is None else s, cursor), last)
        e = last if i == len(segs) - 1 else min(max(s if e is None else e, s), last)
        out.append([label, s, e])
        cursor = e + 1
    if not out:
        return [["none", 0, last]]
    out[-1][2] = last
    return out


@pytest.mark.parametrize("bins", [4096, 3])
def test_exact_quantiles(spark, monkeypatch, bins):
    """Against numpy: groups of one value, ties, negative and very unequal values, nulls and infinities."""
    monkeypatch.setattr(quantiles, "BINS", bins)
    r = np.random.default_rng(4)
    groups = {"one": [3.5], "ties": [1.0] * 40 + [2.0] * 41, "normal": r.normal(size=501).tolist(), "far": [1e300, -1e300, *r.random(30).tolist()], "powers": [10.0**k for k in range(-20, 20)], None: r.integers(-5, 5, 60).astype(float).tolist()}
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None, float("nan"), float("inf")]] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q9": 0.9, "q10": 1.0}
    got = {x.g: x for x in quantiles.quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, share in shares.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, share), rel=1e-9, abs=1e-9), (g, name)
    whole = quantiles.quantiles(df.where("g = 'normal'"), [], "v", {"m": 0.5}).first().m
    assert whole == pytest.approx(np.median(groups["normal"]))
    assert quantiles.quantiles(df.limit(0), [], "v", {"m": 0.5}).collect() == []


def test_segment_repair_equals_a_loop(spark):
    r = random.Random(7)
    bound = lambda: None if r.random() < 0.2 else r.randint(-5, 30)
    cases = [([(r.choice(["left", "none", "hazard"]), bound(), bound()) for _ in range(r.randint(0, 6))], r.randint(1, 25)) for _ in range(150)]
    df = spark.createDataFrame([(k, s, n) for k, (s, n) in enumerate(cases)], f"k int, s {segments.TYPE}, n int")
    got = {x.k: [list(y) for y in x.out] for x in df.select("k", segments.repair(F.col("s"), F.col("n")).alias("out")).collect()}
    for k, (s, n) in enumerate(cases):
        assert got[k] == repair_loop(s, n)
        assert got[k][-1][2] == n - 1


def test_training_windows_equal_a_loop(spark):
    r = random.Random(8)
    tracks = [[r.choice([0, 0, 0, 1, 2]) for _ in range(r.randint(1, 50))] for _ in range(40)]
    tracks.append([r.choice([0] * 30 + [1, 2]) for _ in range(20_000)])
    df = spark.createDataFrame([(f"s{k}", k, i, c) for k, t in enumerate(tracks) for i, c in enumerate(t)], "sequence_id string, track_id long, frame_id long, true_code int")
    got = {}
    for x in series.training_windows(df, 8, 3, 0.6, True).collect():
        got.setdefault(x.track_id, []).append((x.start, x.code))
    for k, t in enumerate(tracks):
        want, start = [], 0
        while start <= len(t) - 8:
            w = t[start : start + 8]
            n = Counter(w)
            top = min(c for c in n if n[c] == max(n.values()))
            if n[top] / 8 >= 0.6:
                want.append((start, top))
            start += 1 if any(w) else 3
        assert sorted(got.get(k, [])) == want


def test_runs_cover_a_track(spark):
    r = random.Random(9)
    t = "".join(r.choice("nlr") for _ in range(200))
    e = series.events(track(spark, t)).orderBy("start").collect()
    assert [(x.label, x.start, x.end) for x in e] == runs(t)


def test_answers_with_braces(spark):
    rows = [('<answer>{"label": "left", "start_frame": 3, "end_frame": 7}</answer> {x}',), ('<think>hm</think> so {"segments": [{"label": "right", "start_frame": 0, "end_frame": 4}], "a": {"b": 1}} and }',), ("nothing",), ("{broken",), (None,)]
    got = [r.p for r in spark.createDataFrame(rows, "t string").select(segments.parse_segments(F.col("t")).alias("p")).collect()]
    assert (got[0].label, got[0].start_frame, got[0].end_frame) == ("left", 3, 7)
    assert got[1].segments[0].label == "right" and got[1].reasoning == "hm"
    assert got[2:] == [None, None, None]


def test_recording_split_keeps_recordings_whole(spark):
    df = spark.createDataFrame([(k % 4, f"r{k % 23}", k) for k in range(500)], "cam int, rec string, id long")
    s = sampling.recording_split(df, ["cam", "rec"], F.col("id"))
    assert s.count() == 500
    assert s.groupBy("cam", "rec").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    m = sampling.mirrored_training(s, lambda x: x)
    assert m.where("is_flipped and split <> 'train'").isEmpty()


def test_weighted_draws_follow_weights(spark):
    df = spark.range(200).withColumn("w", F.when(F.col("id") < 20, 9.0).otherwise(1.0))
    d = sampling.weighted_resample(df, 5000, F.col("w"), "id")
    assert d.count() == 5000
    assert abs(d.where("id < 20").count() / 5000 - 0.5) < 0.05


def test_windows_of_short_tracks_average_all_their_frames(spark):
    frames = spark.createDataFrame([("a", 1, 2 * k, k) for k in range(3)] + [("b", 2, 2 * k, k) for k in range(9)], "sequence_id string, track_id long, frame_id long, pos long")
    starts = series.sliding_windows(frames, 4, 3).select("sequence_id", "track_id", "start")
    probs = starts.withColumn("p", F.when(F.col("start") == 0, F.array(F.lit(0.2), F.lit(0.8))).otherwise(F.array(F.lit(1.0), F.lit(0.0))))
    got = {(r.sequence_id, r.pos): (r.code, r.confidence, r.covered) for r in series.overlap_average(frames, probs, 4, 2).collect()}
    assert all(got["a", k] == (1, 0.8, True) for k in range(3))
    assert [got["b", k] for k in range(9)] == [(1, 0.8, True)] * 3 + [(0, 0.6, True)] + [(0, 1.0, True)] * 3 + [(0, 0.0, False)] * 2


@pytest.mark.parametrize("n", [3, 4, 97, 1000, 100_003])
def test_periodogram_of_any_length(spark, n):
    x = np.random.default_rng(n).normal(size=n) + np.sin(np.arange(n))
    df = spark.createDataFrame(pd.DataFrame({"a": [x.tolist()]}))
    got = np.array(df.select(arrays.periodogram(F.col("a")).alias("p")).first().p)
    k = np.arange(1, (n - 1) // 2 + 1)
    some = k if n <= 1000 else np.array([1, 2, 17, 15_915, 50_001])
    want = [abs(((x - x.mean()) * np.exp(-2j * np.pi * j * np.arange(n) / n)).sum()) for j in some]
    assert len(got) == len(k) and np.allclose(got[some - 1], want, rtol=1e-6, atol=1e-6)


def test_places_in_groups_of_any_size(spark):
    r = random.Random(17)
    rows = [(r.choice("aab"), r.choice([None, "x", "y", "z"]), k % 7, k) for k in range(1500)]
    df = spark.createDataFrame(rows, "g string, s string, v int, k int").repartition(6)
    got = sampling.placed(df, ["g"], ["v", "s", "k"], "place").collect()
    for g in "ab":
        mine = sorted((x.place, x.v, x.s is not None, x.s or "", x.k) for x in got if x.g == g)
        assert [p for p, *_ in mine] == list(range(1, len(mine) + 1)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_arrays_of_short_series(spark):

    df = spark.createDataFrame([(k, [float(x % 2) for x in range(k)]) for k in range(6)], "k int, a array<double>")
    got = df.select("k", arrays.periodogram(F.col("a")).alias("p"), arrays.periodicity(F.col("a"), 4.0).alias("x"), arrays.mean(F.col("a")).alias("m"), arrays.deviation(F.col("a")).alias("d")).collect()
    for r in got:
        a = np.array([float(x % 2) for x in range(r.k)])
        want = np.abs(np.fft.rfft(a - a.mean()))[1 : (r.k - 1) // 2 + 1] if r.k >= 3 else []
        assert np.allclose(r.p, want)
        assert (r.m, r.d) == (None, None) if not r.k else np.allclose((r.m, r.d), (a.mean(), a.std()))
        assert r.k >= 4 or not r.x.is_periodic


def test_ranks_by_parts_equal_a_window(spark):
    rows = [(k, None if k % 7 == 0 else "ab"[k % 3 == 0], float(k % 50)) for k in range(3000)] + [(None, "a", 0.5), (None, "a", 0.5), (11, "b", 1.0)]
    df = spark.createDataFrame(rows, "key long, label string, x double")
    order = lambda k: (k is not None, ((k or 0) * sampling.MULT + 42) % sampling.PRIME)
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    kept = sampling.take(df, ["label"], 10, "key")
    assert kept.columns == df.columns
    want = [r for g in by.values() for r in sorted(g, key=lambda r: order(r[0]))[:10]]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))
    split = sampling.stratified_split(df, 0.25, "label", "key").groupBy("label").agg(F.count_if(F.col("split") == "val").alias("v"), F.count("*").alias("n")).collect()
    assert all(r.v == r.n // 4 and r.n == len(by[r.label]) for r in split)
    none = df.limit(0)
    assert sampling.take(none, ["label"], 3, "key").count() == sampling.stratified_split(none, 0.2, "label", "key").count() == 0


@pytest.mark.parametrize("parts", [4, 64])
def test_rows_are_numbered_by_ranges(spark, parts):
    df = spark.createDataFrame([(float(k % 5) if k % 2 else k / 7, k) for k in range(500)] + [(None, -1)], "x double, k long")
    got = sampling.numbered(df, "x", "n", "k", parts=parts).collect()
    want = sorted(((r.x is not None, r.x or 0, r.k) for r in got))
    assert [(r.x is not None, r.x or 0, r.k) for r in sorted(got, key=lambda r: r.n)] == want
    assert sorted(r.n for r in got) == list(range(1, 502))
    assert sampling.numbered(df.limit(0), "x", "n").count() == 0


def test_partners_are_next_in_hash_order(spark):
    rows = [(k, "ab"[k % 5 == 0], [float(k)]) for k in range(400)] + [(1000, "c", [7.0])]
    got = {r.key: r.mixed[0] for r in sampling.mix_partners(spark.createDataFrame(rows, "key long, label string, v array<double>"), ["label"], "key", "v").collect()}
    for label in "abc":
        ring = sorted((r for r in rows if r[1] == label), key=lambda r: (r[0] * sampling.MULT + 42) % sampling.PRIME)
        for r, mate in zip(ring, ring[1:] + ring[:1]):
            assert abs(got[r[0]] - (0.7 * r[2][0] + 0.3 * mate[2][0])) < 1e-9


def test_draws_fall_on_rows_of_any_weight(spark):
    df = spark.createDataFrame([(k, 0.0 if k % 4 == 0 else 10000.0 if k == 5 else 1e-6 if k % 4 == 1 else 1.0) for k in range(4000)], "key long, w double")
    got = sampling.weighted_resample(df, 5000, F.col("w"), "key")
    assert got.columns == ["draw", "key", "w"] and got.count() == got.select("draw").distinct().count() == 5000
    shares = {r.key: r["count"] for r in got.groupBy("key").count().collect()}
    assert all(k % 4 for k in shares) and abs(shares[5] / 5000 - 10000 / 12000) < 0.03
    assert sampling.weighted_resample(df.withColumn("w", F.lit(0.0)), 10, F.col("w"), "key").count() == 0
