"""Label and answer expressions. The label domain is a parameter; its order is the code order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("none", "left", "right", "hazard")
#: Spellings that mean both sides at once, and placeholder labels of tables without truth.
BOTH = ("both", "signal", "multiple")
PLACEHOLDERS = ("none", "unknown", "unlabeled", "")


def harmonize_label(c: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """Null and unknown labels become the first label, the spellings of `both` the last."""
    clean = F.lower(F.trim(c))
    return F.when(clean.isin(*BOTH), labels[-1]).when(clean.isin(*labels), clean).otherwise(labels[0])


def narrow_label(c: Column) -> Column:
    """Only `both` is renamed; anything else stays."""
    return F.when(F.lower(F.trim(c)) == "both", "hazard").otherwise(c)


def label_code(c: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """The label's place in the domain, null if it has none."""
    clean = F.lower(F.trim(c))
    out = F.when(clean == "both", len(labels) - 1)
    for k, name in enumerate(labels):
        out = out.when(clean == name, k)
    return out


def label_name(c: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """The label at a place, null outside the domain."""
    return F.get(F.array(*map(F.lit, labels)), c.cast("int"))


def mirror_label(c: Column) -> Column:
    return F.when(c == "left", "right").when(c == "right", "left").otherwise(c)


def clamp_confidence(c: Column) -> Column:
    return F.least(F.greatest(F.coalesce(c.cast("double"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


def light_on(turn: Column, tail: Column) -> Column:
    """1 if either annotation shows a light."""
    return (F.lower(turn).isin("left", "right", "both", "hazard") | (F.lower(tail) == "on")).cast("int")


#: What an answer's JSON object looks like, in which order labels are looked for in other text, and
#: the words for a single image.
ANSWER = r'(?s)\{[^{}]*"label"[^{}]*\}'
NAMED = ("left", "right", "hazard", "both", "none")
SINGLE = ("single", "single_image", "image", "single-image")


def parse_answer(c: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """(label, reasoning, parsed) of a model's answer: the first flat JSON object with a label, else the
    first label named in the text (left, right, hazard, both, none), else none and "Parse failed"."""
    found = F.regexp_extract(c, ANSWER, 0)
    fields = F.from_json(found, "label string, reasoning string")
    label = F.lower(F.coalesce(fields["label"], F.lit("none")))
    label = F.when(label == "both", "hazard").when(label.isin(*labels), label).otherwise("none")
    readable = (found != "") & F.try_parse_json(found).isNotNull()
    text, named = F.lower(c), None
    for name in NAMED:
        hit = F.lit("hazard" if name == "both" else name)
        named = F.when(text.contains(name), hit) if named is None else named.when(text.contains(name), hit)
    return F.struct(
        F.when(readable, label).otherwise(F.coalesce(named, F.lit("none"))).alias("label"),
        F.when(readable, F.coalesce(fields["reasoning"], F.lit(""))).when(named.isNotNull(), "").otherwise("Parse failed").alias("reasoning"),
        F.coalesce(readable, F.lit(False)).alias("parsed"),
    )


def one_word_answer(c: Column, allowed: tuple[str, ...] = LABELS) -> Column:
    """The last word if it is allowed, else unclassified."""
    word = F.lower(F.regexp_replace(F.substring_index(F.trim(c), " ", -1), r"[^A-Za-z]", ""))
    return F.when(word.isin(*allowed), word).otherwise("unclassified")


def contained_answer(c: Column, allowed: tuple[str, ...] = LABELS) -> Column:
    """The first allowed label that the text contains, else unclassified."""
    out = None
    for name in allowed:
        out = F.when(F.lower(c).contains(name), name) if out is None else out.when(F.lower(c).contains(name), name)
    return out.otherwise("unclassified")


def phrase_labels(phrases: Column) -> Column:
    """(turn, tail) from detected phrases."""
    has = lambda word: F.exists(phrases, lambda p: F.lower(p).contains(word))
    turn = F.when(has("left") & has("right"), "both").when(has("left"), "left").when(has("right"), "right").otherwise("none")
    tail = F.when(has("brake") | has("taillight"), "on").otherwise("off")
    return F.struct(turn.alias("turn"), tail.alias("tail"))


def inference_mode(explicit: Column, model: Column, path: Column) -> Column:
    """video, single or unknown: as stated, else from the model's name, else from the path."""
    said = F.lower(F.trim(explicit))
    out = F.when(said == "video", "video").when(said.isin(*SINGLE), "single")
    for c in (model, path):
        low = F.lower(c)
        out = out.when(low.contains("video"), "video").when(low.contains("single") | low.contains("image"), "single")
    return out.otherwise("unknown")


def display_name(model: Column, mode: Column) -> Column:
    return F.concat(model, F.lit("_"), F.coalesce(F.nullif(mode, F.lit("")), F.lit("unknown")))


def seconds(frame: Column, fps: float) -> Column:
    """Frame index to seconds, two digits, half to even."""
    return F.bround(frame / F.lit(float(fps)), 2)


def number_or_zero(c: Column) -> Column:
    """A text as a number, 0 if it is none."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))
