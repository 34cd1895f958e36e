"""Ordered-series operators: everything that runs along a track.

Tracks are partitioned by KEY and ordered by ORDER throughout, so that a chain of these operators needs
one shuffle. Arrays hold one track at most (tens to thousands of frames), never a recording.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .sampling import placed

KEY = ("sequence_id", "track_id")
ORDER = "frame_id"
NONE = "none"


def along(by=KEY, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def position(df: DataFrame, name: str = "frame_idx", by=KEY, order: str = ORDER) -> DataFrame:
    """Number the frames of each track from 0."""
    return df.withColumn(name, (F.row_number().over(along(by, order)) - 1).cast("long"))


def run_ids(df: DataFrame, label: str, name: str = "run", by=KEY, order: str = ORDER) -> DataFrame:
    """Number the maximal runs of equal labels (gaps and islands)."""
    w = along(by, order)
    new = (~F.col(label).eqNullSafe(F.lag(label).over(w))) | (F.row_number().over(w) == 1)
    return df.withColumn("__new", new.cast("int")).withColumn(name, F.sum("__new").over(w).cast("long")).drop("__new")


def events(df: DataFrame, label: str = "label", by=KEY, order: str = ORDER) -> DataFrame:
    """Maximal runs of one label other than none: event_ord, label, start, end (positions), num_frames."""
    runs = run_ids(position(df, "__pos", by, order), label, "__run", by, order)
    found = runs.where(F.col(label) != NONE).groupBy(*by, "__run").agg(F.first(label).alias("label"), F.min("__pos").alias("start"), F.max("__pos").alias("end"), F.count("*").alias("num_frames"))
    return found.withColumn("event_ord", F.row_number().over(Window.partitionBy(*by).orderBy("start")).cast("long")).drop("__run")


def first_mode(values: Column) -> Column:
    """The most frequent value of an array; of equals the one seen first."""
    counts = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-F.array_position(values, v)).alias("p"), v.alias("v")))
    return F.array_max(counts)["v"]


def mode_smooth(df: DataFrame, window: int = 7, label: str = "label", by=KEY, order: str = ORDER) -> DataFrame:
    """Each label becomes the most frequent of a centred window, cut at the ends; the first in the window
    wins ties. Even windows grow by one; tracks shorter than the window stay. original_label and smoothed
    tell what changed."""
    size = window + 1 - window % 2
    w = along(by, order).rowsBetween(-(size // 2), size // 2)
    n = F.count("*").over(Window.partitionBy(*by))
    got = F.when(n < size, F.col(label)).otherwise(first_mode(F.collect_list(label).over(w)))
    return df.withColumn("__got", got).withColumn("original_label", F.col(label)).withColumn(label, F.col("__got")).withColumn("smoothed", F.col("__got") != F.col("original_label")).drop("__got")


def rapid_change(df: DataFrame, before: int = 5, least: int = 3, label: str = "label", by=KEY, order: str = ORDER) -> Column:
    """Whether the row and the `before` rows before it hold `least` different labels; never the first row."""
    w = along(by, order)
    return (F.size(F.collect_set(label).over(w.rowsBetween(-before, 0))) >= least) & (F.row_number().over(w) > 1)


def minimum_duration(df: DataFrame, least: int = 3, label: str = "label", by=KEY, order: str = ORDER) -> DataFrame:
    """Runs of a signal shorter than `least` frames become none."""
    runs = run_ids(df, label, "__run", by, order)
    short = (F.count("*").over(Window.partitionBy(*by, "__run")) < least) & (F.col(label) != NONE)
    return _enforced(runs, short, label)


def maximum_duration(df: DataFrame, most: int = 50, label: str = "label", by=KEY, order: str = ORDER) -> DataFrame:
    """Frames of a signal after the first `most` of a run become none."""
    runs = run_ids(df, label, "__run", by, order)
    late = (F.row_number().over(Window.partitionBy(*by, "__run").orderBy(order)) > most) & (F.col(label) != NONE)
    return _enforced(runs, late, label)


def _enforced(runs: DataFrame, hit: Column, label: str) -> DataFrame:
    """Hit rows become none; their label before is kept, the first one if several constraints hit."""
    first = F.coalesce("original_label", F.when(F.col("__hit"), F.col(label))) if "original_label" in runs.columns else F.when(F.col("__hit"), F.col(label))
    was = F.col("constraint_enforced") if "constraint_enforced" in runs.columns else F.lit(False)
    out = runs.withColumn("__hit", hit).withColumn("original_label", first).withColumn("constraint_enforced", was | F.col("__hit"))
    return out.withColumn(label, F.when(F.col("__hit"), NONE).otherwise(F.col(label))).drop("__hit", "__run")


def episodes(df: DataFrame, max_gap: int = 2, least: int = 3, signals=("left", "right", "hazard"), label: str = "label", by=KEY, order: str = ORDER) -> DataFrame:
    """Per signal: matching frames at most max_gap others apart form an episode; if it has `least` of them,
    all its frames get the label. Signals are taken in order, so that a later one wins."""
    w, out = along(by, order), position(df, "__pos", by, order)
    names = []
    for k, signal in enumerate(signals):
        hit = F.col(label) == signal
        prev = F.last(F.when(hit, F.col("__pos")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        starts = (hit & (prev.isNull() | (F.col("__pos") - prev - 1 > max_gap))).cast("int")
        out = out.withColumn("__s", starts).withColumn("__e", F.sum("__s").over(w))
        part = Window.partitionBy(*by, "__e")
        last = F.max(F.when(hit, F.col("__pos"))).over(part)
        out = out.withColumn(f"__in{k}", (F.col("__e") > 0) & (F.col("__pos") <= last) & (F.count_if(hit).over(part) >= least))
        names.append((f"__in{k}", signal))
    got = F.col(label)
    for name, signal in names:
        got = F.when(F.col(name), signal).otherwise(got)
    return out.withColumn("original_label", F.col(label)).withColumn(label, got).drop("__pos", "__s", "__e", *[n for n, _ in names])


def propagate(df: DataFrame, label: str = "label", by=KEY, order: str = ORDER) -> DataFrame:
    """Missing labels: the last one before, else the next one, else none; `direct` tells which were there."""
    w = along(by, order)
    back = F.last(label, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(label, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("direct", F.col(label).isNotNull()).withColumn("__got", F.coalesce(back, ahead, F.lit(NONE))).withColumn(label, F.col("__got")).drop("__got")


def carry_anchors(df: DataFrame, anchor: str, correction: str, label: str = "label", by=KEY, order: str = ORDER) -> DataFrame:
    """The active label starts with the first row and is set anew at each anchor, to its correction or its
    own label."""
    w = along(by, order)
    own = F.coalesce(correction, label)
    set_here = F.when(F.col(anchor) | (F.row_number().over(w) == 1), own)
    return df.withColumn("__set", set_here).withColumn("active_label", F.last("__set", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__set")


def stride_sample(df: DataFrame, stride: int, start: int = 0, least: int = 1, by=KEY, order: str = ORDER) -> DataFrame:
    """Every stride-th frame from a position on, of tracks that give at least `least`."""
    p = position(df, "__pos", by, order).where((F.col("__pos") >= start) & ((F.col("__pos") - start) % stride == 0))
    return p.withColumn("__n", F.count("*").over(Window.partitionBy(*by))).where(F.col("__n") >= least).drop("__pos", "__n")


def resample(df: DataFrame, source_fps: float, target_fps: float, longest: int | None = None, by=KEY, order: str = ORDER) -> DataFrame:
    """Evenly spaced frames, as many as the target rate gives (half to even, one at least); new_idx."""
    p = position(df, "__pos", by, order).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    m = F.greatest(F.lit(1), F.bround(F.col("__n") * F.lit(target_fps / source_fps), 0).cast("int"))
    m = F.least(m, F.col("__n").cast("int"), *([F.lit(longest)] if longest else []))
    # The grid is laid out once per track and matched by position.
    step = (F.col("__n") - 1).cast("double") / (F.col("__m") - 1)
    at = lambda i: F.when(i == F.col("__m") - 1, F.when(F.col("__m") == 1, F.lit(0).cast("long")).otherwise(F.col("__n") - 1)).otherwise(F.floor(i * F.when(F.col("__m") > 1, step)))
    grid = p.groupBy(*by).agg(F.first("__n").alias("__n")).withColumn("__m", m)
    grid = grid.select(*by, F.posexplode(F.transform(F.sequence(F.lit(0), F.col("__m") - 1), at)).alias("new_idx", "__pos"))
    return p.drop("__n").join(grid, [*by, "__pos"]).drop("__pos")


def blocks(df: DataFrame, size: int, label: str = "label", by=KEY, order: str = ORDER) -> DataFrame:
    """Blocks of frames that follow each other, the last one maybe short; a block has its first label."""
    p = position(df, "__pos", by, order).withColumn("block", F.floor(F.col("__pos") / size))
    return p.groupBy(*by, "block").agg(F.min_by(label, "__pos").alias("label"), F.min(order).alias("first_frame"), F.max(order).alias("last_frame"), F.count("*").alias("num_frames"))


def sliding_windows(df: DataFrame, size: int, stride: int, by=KEY, order: str = ORDER) -> DataFrame:
    """Windows of frames and their centre frames; a track shorter than a window is one."""
    tracks = df.groupBy(*by).agg(F.array_sort(F.collect_list(order)).alias("f"))
    last = F.greatest(F.size("f") - size, F.lit(0))
    each = tracks.withColumn("start", F.explode(F.sequence(F.lit(0), last, F.lit(stride))))
    frames = F.slice("f", F.col("start") + 1, F.lit(size))
    return each.select(*by, "start", frames.alias("frames"), F.get(frames, F.floor(F.size(frames) / 2).cast("int")).alias("centre_frame"))


def overlap_average(frames: DataFrame, probs: DataFrame, size: int, classes: int, by=KEY, pos: str = "pos", digits: int = 6) -> DataFrame:
    """frames with code, confidence and covered: the mean of the probabilities p of all windows (start, p) of
    `size` frames that cover a frame, and its first largest class. A track shorter than a window has one, as if
    filled up with its last frame. Frames that no window covers are class 0 with confidence 0."""
    each = probs.withColumn(pos, F.explode(F.sequence(F.col("start"), F.col("start") + (size - 1))))
    means = each.groupBy(*by, F.col(pos).cast("long").alias(pos)).agg(F.array(*[F.round(F.avg(F.get("p", F.lit(c))), digits) for c in range(classes)]).alias("__m"))
    out = frames.join(means, [*by, pos], "left")
    code = F.coalesce((F.array_position("__m", F.array_max("__m")) - 1).cast("int"), F.lit(0))
    return out.withColumn("code", code).withColumn("confidence", F.coalesce(F.array_max("__m"), F.lit(0.0))).withColumn("covered", F.col("__m").isNotNull()).drop("__m")


def training_windows(df: DataFrame, size: int, stride: int, purity: float = 0.0, training: bool = False, code: str = "true_code", by=KEY, order: str = ORDER) -> DataFrame:
    """Windows with their majority code (smallest of equals) and its share. In training, impure windows are
    left out, and the step is 1 while a window holds a signal (code > 0): then which starts are taken is a fold
    over each track's starts, block by block; a window's majority is worked out for those that are taken only."""
    tracks = df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, code))), lambda x: x[code]).alias("c"))
    many = F.size("c") - size
    starts = F.when(many >= 0, F.sequence(F.lit(0), many)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.slice(F.col("c"), i + 1, F.lit(size))
    best = lambda w: F.array_max(F.transform(F.array_distinct(w), lambda v: F.struct(F.size(F.filter(w, lambda x: x == v)).alias("n"), (-v).alias("v"))))
    if training:
        # Whether a window holds a signal: the next signal from its start on lies inside it.
        w = along(by, order)
        ahead = F.min(F.when(F.col(code) > 0, F.col("__i"))).over(w.rowsBetween(0, size - 1)).isNotNull()
        marked = position(df, "__i", by, order).withColumn("__go", F.when(ahead, 1).otherwise(stride))
        tracks = marked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, code, "__go"))).alias("x"))
        tracks = tracks.select(*by, F.transform("x", lambda x: x[code]).alias("c"), F.transform("x", lambda x, i: F.struct(i.alias("i"), x["__go"].alias("go"))).alias("go"))
        none = F.array().cast("array<int>")

        def step(s: Column, x: Column) -> Column:
            taken = F.struct((x["i"] + x["go"]).cast("int").alias("next"), F.concat(s["out"], F.array(x["i"])).alias("out"))
            return F.when(x["i"] == s["next"], taken).otherwise(s)

        def block(s: Column, xs: Column) -> Column:
            ran = F.aggregate(xs, F.struct(s["next"].alias("next"), none.alias("out")), step)
            return F.struct(ran["next"].alias("next"), F.concat(s["out"], F.array(ran["out"])).alias("out"))

        zero = F.struct(F.lit(0).alias("next"), F.array().cast("array<array<int>>").alias("out"))
        able = F.when(many >= 0, F.slice("go", F.lit(1), many + 1)).otherwise(F.slice("go", F.lit(1), F.lit(0)))
        chosen = F.flatten(F.aggregate(in_blocks(able), zero, block)["out"])
    else:
        chosen = F.filter(starts, lambda i: i % stride == 0)
    each = tracks.withColumn("start", F.explode(chosen)).withColumn("b", best(window(F.col("start"))))
    out = each.select(*by, "start", (-F.col("b.v")).alias("code"), (F.col("b.n") / F.lit(float(size))).alias("purity"))
    return out.where(F.col("purity") >= purity) if training else out


def context(df: DataFrame, around: int, value: str, by=KEY, order: str = ORDER) -> DataFrame:
    """Each frame's neighbours up to `around` before and after, with their number and its own place."""
    w = along(by, order)
    seen = F.collect_list(value).over(w.rowsBetween(-around, around))
    return df.withColumn("context", seen).withColumn("context_size", F.size("context")).withColumn("target_pos", F.least(F.row_number().over(w) - 1, F.lit(around)))


def merged_windows(df: DataFrame, hit: Column, width: int, by=KEY, order: str = ORDER) -> DataFrame:
    """Windows of half a width around hits, cut at the ends, merged where they overlap or touch."""
    p = position(df, "__pos", by, order).withColumn("__n", F.count("*").over(Window.partitionBy(*by))).where(hit)
    p = p.select(*by, F.greatest(F.col("__pos") - width // 2, F.lit(0)).alias("__s"), F.least(F.col("__pos") + width // 2, F.col("__n") - 1).alias("__e"))
    w = Window.partitionBy(*by).orderBy("__s", "__e")
    new = F.col("__s") > F.coalesce(F.max("__e").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(-1))
    g = p.withColumn("__new", new.cast("int")).withColumn("__g", F.sum("__new").over(w))
    return g.groupBy(*by, "__g").agg(F.min("__s").alias("start"), F.max("__e").alias("end")).drop("__g")


def trim_to_hit(df: DataFrame, hit: Column, by=KEY, order: str = ORDER) -> DataFrame:
    """Frames from the first hit on; tracks without one drop out."""
    return df.withColumn("first_hit", F.min(F.when(hit, F.col(order))).over(Window.partitionBy(*by))).where(F.col(order) >= F.col("first_hit"))


def back_label(df: DataFrame, batch: str, label: str = "label", by=KEY) -> DataFrame:
    """A whole track gets its first batch's label that is no error, else none."""
    got = F.min_by(label, F.when(F.col(label) != "error", F.col(batch))).over(Window.partitionBy(*by))
    return df.withColumn("track_label", F.coalesce(got, F.lit(NONE)))


def difference_energy(df: DataFrame, value: str, by=KEY, order: str = ORDER) -> DataFrame:
    """Absolute differences of neighbours: their sum and population variance for each track."""
    d = df.withColumn("__d", F.abs(F.col(value) - F.lag(value).over(along(by, order))))
    return d.groupBy(*by).agg(F.coalesce(F.sum("__d"), F.lit(0.0)).alias("energy"), F.coalesce(F.var_pop("__d"), F.lit(0.0)).alias("variance"))


def moving_average(df: DataFrame, value: str, size: int = 3, by=KEY, order: str = ORDER) -> DataFrame:
    """The mean of each `size` values that follow each other, at the last one."""
    w = along(by, order)
    return df.withColumn("average", F.avg(value).over(w.rowsBetween(1 - size, 0))).withColumn("__n", F.row_number().over(w)).where(F.col("__n") >= size).drop("__n")


def length_batches(df: DataFrame, tolerance: int, most: int, by=KEY) -> DataFrame:
    """Tracks of like length in batches of at most `most`: bucket, batch, num_frames. A bucket of any size is
    ranked by ranges."""
    n = df.groupBy(*by).agg(F.count("*").alias("num_frames")).withColumn("bucket", F.floor(F.col("num_frames") / tolerance))
    return placed(n, ["bucket"], ["num_frames", *by], "__place").withColumn("batch", F.floor((F.col("__place") - 1) / most)).drop("__place")


#: Fixed values of the hidden Markov smoother: states, transitions from each, and weights of what is seen.
STATES = ("none", "left", "right", "hazard")
TRANSITIONS = ((0.8, 0.1, 0.1, 0.0), (0.1, 0.8, 0.05, 0.05), (0.1, 0.05, 0.8, 0.05), (0.1, 0.3, 0.3, 0.3))
SEEN, OTHER = 1.0, 0.1


#: Frames of a block in folds along a track. A fold copies what it has collected at each step, so what grows is
#: a block first, then the list of blocks; work stays in proportion to the track.
FOLD = 128


def in_blocks(values: Column, size: int = FOLD) -> Column:
    """An array as an array of blocks, the last one maybe short."""
    many = F.ceil(F.size(values) / size).cast("int")
    starts = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.slice(values, k * size + 1, F.lit(size)))


def hmm_smooth(df: DataFrame, label: str = "label", by=KEY, order: str = ORDER) -> DataFrame:
    """The most likely state sequence (Viterbi) in logarithms, so long tracks do not underflow; the first
    state wins ties. A forward fold over each track's frames keeps the states' scores and, for each frame, the
    states before in one number of two bits a state; a backward fold follows them. Both run block by block."""
    log = lambda p: F.lit(math.log(p) if p else -math.inf)
    n, total = len(STATES), SEEN + OTHER * (len(STATES) - 1)
    code = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, STATES)), F.when(c == "both", "hazard").otherwise(c)).cast("int"), F.lit(0))
    index = lambda c: F.greatest(code(c), F.lit(1)) - 1
    tracks = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, label))).alias("rows"))
    seen = tracks.withColumn("seen", F.transform("rows", lambda r: index(r[label])))
    emit = lambda c, s: F.when(c == s, log(SEEN / total)).otherwise(log(OTHER / total))
    scores = lambda each: F.struct(*[x.alias(f"s{k}") for k, x in enumerate(each)])
    best = lambda s: F.greatest(*[s[f"s{r}"] for r in range(n)])

    def first(values: list[Column], top: Column) -> Column:
        """Which of them is the largest, the first of equals."""
        out = F.lit(n - 1)
        for r in reversed(range(n - 1)):
            out = F.when(values[r] == top, r).otherwise(out)
        return out

    def forward(state: Column, c: Column) -> Column:
        ways = [[state["score"][f"s{r}"] + log(TRANSITIONS[r][s]) for r in range(n)] for s in range(n)]
        back = sum((F.shiftleft(first(w, F.greatest(*w)), 2 * s) for s, w in enumerate(ways)), F.lit(0))
        return F.struct(scores([F.greatest(*w) + emit(c, s) for s, w in enumerate(ways)]).alias("score"), F.concat(state["back"], F.array(back)).alias("back"))

    def forward_block(state: Column, block: Column) -> Column:
        none = F.array().cast("array<int>")
        ran = F.aggregate(block, F.struct(state["score"].alias("score"), none.alias("back")), forward)
        return F.struct(ran["score"].alias("score"), F.concat(state["back"], F.array(ran["back"])).alias("back"))

    def backward(path: Column, back: Column) -> Column:
        before = F.call_function("shiftright", back, F.get(path, F.lit(0)) * 2).bitwiseAND(3)
        return F.concat(F.array(before), path)

    def backward_block(state: Column, block: Column) -> Column:
        """The states before each frame of the block; the state that it starts from stands first of all."""
        path = F.aggregate(F.reverse(block), F.array(state["at"]), backward)
        return F.struct(F.get(path, F.lit(0)).alias("at"), F.concat(F.array(F.slice(path, F.lit(1), F.size(block))), state["paths"]).alias("paths"))

    start = F.struct(scores([emit(F.get("seen", F.lit(0)), s) + math.log(1 / n) for s in range(n)]).alias("score"), F.array().cast("array<array<int>>").alias("back"))
    rest = in_blocks(F.slice("seen", F.lit(2), F.size("seen")))
    scored = seen.select(*by, "rows", F.aggregate(rest, start, forward_block).alias("s"))
    last = first([F.col(f"s.score.s{r}") for r in range(n)], best(F.col("s.score")))
    zero = F.struct(last.alias("at"), F.array().cast("array<array<int>>").alias("paths"))
    path = F.concat(F.flatten(F.aggregate(F.reverse("s.back"), zero, backward_block)["paths"]), F.array(last))
    rows = scored.select(*by, F.explode(F.arrays_zip(F.col("rows"), path.alias("path"))).alias("z"))
    names = F.array(*map(F.lit, STATES))
    out = rows.select(*by, F.col(f"z.rows.{order}").alias(order), F.get(names, F.col("z.path")).alias(label), F.col(f"z.rows.{label}").alias("original_label"))
    return out.withColumn("smoothed", F.col(label) != F.col("original_label"))
