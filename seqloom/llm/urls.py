"""URL filter: host and path rules first, then a character language-model ratio.

Two smoothed variable-order Markov models are estimated from the URLs that rules accept and from those
they reject. A character's probability after a context of k characters is interpolated (Witten-Bell) with
the one after k - 1; a context that was not seen passes the shorter one on. A URL's score is the mean over
its characters of ln(p accepted / p rejected); the cut is calibrated on a held-out fifth of the ruled URLs.

All counts cover all distinct URLs. The models are tables keyed by n-gram, joined and never collected; only
a bounded number of the commonest grams is broadcast. Each longer context is derived from the written counts
of the longest grams.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_skewed, materialise, quoted

#: host, path, verdict. A rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Longest context in characters, and the width and number of bins for calibration on each side of 0.
ORDER, BIN, BINS = 4, 0.02, 500
#: The commonest grams, which are broadcast: at most so many rows.
HOT = 1 << 15


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next /, ? or #, with A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def grams(text: Column, order: int = ORDER) -> Column:
    """Each character, an end mark after the last, with the `order` characters before it (padded). Linear in
    the text: a lambda would work out an array outside it again for each of its elements, so none is there."""
    chars = F.split(F.concat(F.lit("\x02" * order), text, F.lit("\x03")), "")
    many, out = F.length(text) + 1, chars
    for k in range(1, order + 1):
        out = F.zip_with(out, F.slice(chars, F.lit(k + 1), many), lambda a, b: F.concat(a, b))
    return F.slice(out, F.lit(1), many)


def model(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """counts(gram, a, r: how often among accepted and rejected) to (gram, ratio: ln of p accepted / p
    rejected). Grams that only occur in URLs without a rule count 0 and get a smoothed ratio too."""
    now = counts.groupBy(F.substring("gram", order + 1, 1).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    total = now.agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"), F.count("*").alias("v"))
    p = now.crossJoin(F.broadcast(total)).select("g", ((F.col("a") + 1) / (F.col("ta") + F.col("v"))).alias("pa"), ((F.col("r") + 1) / (F.col("tr") + F.col("v"))).alias("pr"))
    for k in range(1, order + 1):
        here = counts.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        here = here.select("g", "a", "r", F.substring("g", 1, k).alias("context"), F.substring("g", 2, k).alias("shorter"))
        seen = here.groupBy("context").agg(
            F.sum("a").alias("ca"), F.sum("r").alias("cr"), F.count_if(F.col("a") > 0).alias("ua"), F.count_if(F.col("r") > 0).alias("ur")
        )
        lower = p.select(F.col("g").alias("shorter"), "pa", "pr")

        def mixed(n: str, c: str, u: str, q: str) -> Column:
            return F.when(F.col(c) > 0, (F.col(n) + F.col(u) * F.col(q)) / (F.col(c) + F.col(u))).otherwise(F.col(q))

        p = here.join(seen, "context").join(lower, "shorter").select("g", mixed("a", "ca", "ua", "pa").alias("pa"), mixed("r", "cr", "ur", "pr").alias("pr"))
    return p.select(F.col("g").alias("gram"), F.ln(F.col("pa") / F.col("pr")).alias("ratio"))


def cut(scored: DataFrame) -> DataFrame:
    """One row with the score from which on a URL is accepted: where the mean of the two classes' shares
    of right verdicts is largest on the held-out rows (nearest 0 among equals); 0 if a class is missing."""
    at = F.least(F.greatest(F.floor(F.col("score") / BIN), F.lit(-BINS)), F.lit(BINS))
    bins = scored.groupBy(at.cast("long").alias("bin")).agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("r"))
    every, below = Window.partitionBy(), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 * BINS + 1 rows
    right = (F.sum("a").over(every) - F.coalesce(F.sum("a").over(below), F.lit(0))) / F.nullif(F.sum("a").over(every), F.lit(0)) + F.coalesce(F.sum("r").over(below), F.lit(0)) / F.nullif(F.sum("r").over(every), F.lit(0))
    # The cut lies halfway between the lowest bin that is accepted and the one before it.
    middle = (F.col("bin") + F.coalesce(F.lag("bin").over(Window.orderBy("bin")), F.col("bin") - 1) + 1) / 2 * BIN
    best = bins.select("bin", middle.alias("middle"), right.alias("right")).agg(F.max_by("middle", F.struct("right", -F.abs("middle"), "bin")).alias("middle"), F.max("right").alias("right"))
    return best.select(F.when(F.col("right").isNotNull(), F.col("middle")).otherwise(F.lit(0.0)).alias("cut"))


def scored(urls: DataFrame, ratios: DataFrame, order: int = ORDER) -> DataFrame:
    """urls(k1, k2, text, ...) with `score` in place of text: the mean ratio of its grams.

    The HOT commonest grams are broadcast, so that what every URL has is no join key; each URL goes on with
    the sum over those and a list of its others, and only the others are joined by key."""
    hot = ratios.orderBy(F.desc("n"), "gram").limit(HOT).select("gram", F.col("ratio").alias("told"))
    rest = [c for c in urls.columns if c != "text"]
    each = urls.select(*rest, F.explode(grams(F.col("text"), order)).alias("gram")).join(F.broadcast(hot), "gram", "left")
    partly = each.groupBy(*rest).agg(F.sum("told").alias("told"), F.count("*").alias("n"), F.collect_list(F.when(F.col("told").isNull(), F.col("gram"))).alias("others"))
    partly = materialise(partly)
    rare = partly.select("k1", "k2", F.explode("others").alias("gram")).join(ratios.select("gram", "ratio"), "gram")
    sums = rare.groupBy("k1", "k2").agg(F.sum("ratio").alias("ratio"))
    zero = F.lit(0.0)
    return partly.join(sums, ["k1", "k2"], "left").select(*rest, ((F.coalesce("told", zero) + F.coalesce("ratio", zero)) / F.col("n")).alias("score"))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple = RULES, order: int = ORDER) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score.

    The model reads whole urls, scheme, query and fragment included; rules read host and path. A null url
    counts as an empty one (its score is the end mark's); one without :// has an empty host and path and is
    judged like any other. A URL of any length is read whole. Repeated rows stay and get one verdict; extra columns are ignored; an empty
    table gives an empty result. Without ruled URLs all scores are 0 and all verdicts allow.
    """
    whole = pages.select(quoted(page_id).alias("page_id"), F.coalesce(quoted(url), F.lit("")).alias("text"))
    host, path, key = host_of(F.col("text")), path_of(F.col("text")), [F.xxhash64("text").alias("k1"), F.hash("text").alias("k2")]
    parts = whole.select("page_id", host.alias("host"), path.alias("path"), *key)
    urls = whole.groupBy("text").agg(F.count("*").alias("copies")).select(*key, "text", "copies", ruled(host, path, rules)["verdict"].alias("verdict"))
    # Written once: the counts and the scores read it, and the exchange deals the URLs over all tasks.
    urls = materialise(urls.withColumn("held", F.pmod("k1", F.lit(5)) == 0))
    learn = lambda v: F.count_if((F.col("verdict") == v) & ~F.col("held"))
    each = urls.select("verdict", "held", F.explode(grams(F.col("text"), order)).alias("gram"))
    counts = materialise(each.groupBy("gram").agg(F.count("*").alias("n"), learn("allow").alias("a"), learn("block").alias("r")))
    ratios = materialise(model(counts, order).join(counts.select("gram", "n"), "gram"))
    scores = materialise(scored(urls, ratios, order))
    limit = cut(scores.where("held and verdict is not null"))
    judged = parts.select("*", ruled(F.col("host"), F.col("path"), rules).alias("hit"))
    # A URL of very many pages meets them by broadcast.
    judged = join_skewed(judged, scores.select("k1", "k2", "score", "copies"), ["k1", "k2"], "copies", whole.count())
    own = F.when(F.col("score") >= F.col("cut"), "allow").otherwise("block")
    return judged.crossJoin(F.broadcast(limit)).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", own).alias("verdict"), "score")
