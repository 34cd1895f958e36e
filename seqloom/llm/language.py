"""Language identification by Bayesian evidence fusion.

ln posterior(language) = text likelihood + declared markup language + address hints + host prior, up to a
constant. The text likelihood comes from hashed byte trigrams; the prior of a host is smoothed towards its
domain's, that towards its suffix's, and that towards the whole table's, with counts from one grouped
aggregation over the text-only verdicts of all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, join_skewed, map_arrow, materialise, quoted

#: Hash buckets for trigrams, and smoothing.
GRAMS, ALPHA = 1 << 16, 0.5
#: The classifier is fitted on a sample of about this many labelled rows of each language, all of them where
#: there are fewer; languages whose counts a task holds at a time.
SAMPLE, HELD = 1_250, 64
#: Trigrams overlap and depend on each other: a text weighs as much as this many independent ones at most.
WEIGHT = 100.0
#: How often a declared language, and an address hint, is right; pseudo-counts that a prior lends downwards.
DECLARED, HINTED, LENT = 0.9, 0.8, 20.0
#: A verdict is accepted from this posterior on.
SURE = 0.5
#: Bytes in one step, for bounded memory on very long texts.
STEP = 1 << 20
#: Languages that country domains hint at.
SUFFIX_LANGUAGE = {"uk": "en", "us": "en", "au": "en", "ie": "en", "fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es"}

_OPENS = re.compile(r"(?i)<(script|style)\b")
_CLOSES = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}


class Ahead:
    """Where something comes next, for places that only move forward: a text is searched once, also where there
    is no more of it."""

    def __init__(self, search):
        self.search, self.found = search, (0, 0)

    def __call__(self, at: int) -> tuple[int, int] | None:
        """Start and end of the first one from a place on."""
        if self.found and (self.found == (0, 0) or self.found[0] < at):
            self.found = self.search(at)
        return self.found


def plain(html: str) -> str:
    """The text of a page: scripts, styles, comments and tags become spaces. One that is not closed is a tag, and
    a tag that is not closed is text. One scan forward, in proportion to the page whatever is in it."""

    def fixed(mark: str) -> Ahead:
        return Ahead(lambda at: (k, k + len(mark)) if (k := html.find(mark, at)) >= 0 else None)

    def matched(pattern: re.Pattern) -> Ahead:
        return Ahead(lambda at: m.span() if (m := pattern.search(html, at)) else None)

    closes = {name: matched(p) for name, p in _CLOSES.items()}
    comment, tag = fixed("-->"), fixed(">")
    out, copied, at = [], 0, html.find("<")
    while at >= 0:
        end = tag(at + 1)
        if not end:
            break  # nothing more is closed
        if m := _OPENS.match(html, at):
            end = closes.get(m[1].lower(), tag)(m.end()) or end
        elif html.startswith("<!--", at):
            end = comment(at + 4) or end
        out += [html[copied:at], " "]
        copied = end[1]
        at = html.find("<", copied)
    out.append(html[copied:])
    return "".join(out)


def gram_ids(data: bytes) -> Iterator[np.ndarray]:
    """Hashed byte trigrams of a text, step by step; texts of under three bytes have none."""
    for at in range(0, max(len(data) - 2, 0), STEP):
        b = np.frombuffer(data, np.uint8)[at : at + STEP + 2].astype(np.uint32)
        yield ((b[:-2] * np.uint32(2654435761) + b[1:-1] * np.uint32(40503) * np.uint32(257) + b[2:] * np.uint32(2246822519)) >> np.uint32(16)).astype(np.uint16)


def has_letters(text: str) -> bool:
    return any(map(str.isalpha, text))


class Model:
    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table  # table: (GRAMS, languages) of ln p

    def likelihood(self, text: str) -> list[float]:
        """The weighted ln likelihood of a whole text in each language; zeros if it has no letters."""
        total, n = np.zeros(len(self.languages)), 0
        if has_letters(text):
            for ids in gram_ids(text.lower().encode()):
                counts = np.bincount(ids, minlength=GRAMS) if len(ids) > GRAMS else None
                total += counts @ self.table if counts is not None else self.table[ids].sum(axis=0, dtype=np.float64)
                n += len(ids)
        return (total * min(1.0, WEIGHT / n) if n else total).tolist()


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from labelled texts: about `sample` rows of each language, chosen by a hash of their text. Every
    label becomes a class; the model takes 256 KB for each. Rows without a text or a label are passed over;
    an empty table gives a model without languages."""
    rows = labelled.select(quoted(text).alias("text"), quoted(lang).alias("lang")).where("text is not null and text <> '' and lang is not null")
    # One row for each language.
    shares = rows.groupBy("lang").agg((F.lit(sample * 1_000_003.0) / F.count("*")).alias("below"))
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.col("below")).select("text", "lang")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1)):
                into = sums.setdefault(name.as_py(), np.zeros(GRAMS, np.int64))
                for ids in gram_ids(t.as_py().lower().encode()):
                    into += np.bincount(ids, minlength=GRAMS)
            if len(sums) > HELD:
                yield from tables(sums)
                sums = {}
        yield from tables(sums)

    def tables(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "gram": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})

    counted = chosen.mapInArrow(grams, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # at most GRAMS rows for each language
    names = sorted(counted.column("lang").unique().to_pylist())
    table = np.zeros((GRAMS, len(names)))
    place = np.array([names.index(x) for x in counted.column("lang").unique().to_pylist()], np.int64)
    which = place[counted.column("lang").combine_chunks().dictionary_encode().indices.to_numpy()] if names else place
    table[counted.column("gram").to_numpy(), which] = counted.column("n").to_numpy()
    table = np.log((table + ALPHA) / (table.sum(axis=0) + ALPHA * GRAMS))
    return Model(names, table.astype(np.float32))


def with_likelihood(rows: DataFrame, text: str, name: str, model: Model, keep_text: bool, markup: str | None = None) -> DataFrame:
    """rows with the column name: the likelihood of text for each language. Where the boolean column
    markup is true, the text is a page and its tags are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rest = [f for f in rows.schema.fields if keep_text or f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(text)]
            if markup:
                texts = [plain(t) if m.as_py() else t for t, m in zip(texts, batch.column(markup))]
            found = [own.likelihood(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(found, pa.list_(pa.float64()))], names=[*(f.name for f in rest), name])

    return map_arrow(rows, run, T.StructType([*rest, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def best(scores: Column, languages: list[str]) -> Column:
    """The first language with the largest score."""
    return F.get(F.array(*map(F.lit, languages)), (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def host_priors(scored: DataFrame, languages: list[str]) -> DataFrame:
    """scored(host, domain, suffix, scores) to one row per host: host, prior (ln p for each language), n (rows)."""
    n = len(languages)
    known = F.array_max("scores") > F.array_min("scores")  # a text without letters says nothing
    votes = [F.count_if(known & (F.col("lang") == name)) for name in languages]
    hosts = materialise(scored.withColumn("lang", best(F.col("scores"), languages)).groupBy("host", "domain", "suffix").agg(F.array(*votes).alias("votes"), F.count("*").alias("n")))

    def summed(*by: str) -> DataFrame:
        return hosts.groupBy(*by).agg(F.array(*[F.sum(F.get("votes", F.lit(k))) for k in range(n)]).alias("own"))

    def smoothed(own: str, above: str) -> Column:
        total = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.zip_with(own, above, lambda x, p: (x + LENT * p) / (total + LENT))

    flat = F.array(*[F.lit(1.0 / n)] * n) if n else F.array().cast("array<double>")
    whole = summed().select(smoothed("own", flat).alias("whole"))
    suffixes = summed("suffix").crossJoin(F.broadcast(whole)).select("suffix", smoothed("own", "whole").alias("above"))
    domains = summed("domain", "suffix").join(suffixes, "suffix").select("domain", "suffix", smoothed("own", "above").alias("above"))
    return hosts.join(domains, ["domain", "suffix"]).select("host", F.transform(smoothed("votes", "above"), F.ln).alias("prior"), "n")


def fused(scores: Column, prior: Column, declared: Column, hint: Column, languages: list[str]) -> Column:
    """The posterior of each language. A declared language or hint that is null or unknown says nothing."""
    names = F.array(*map(F.lit, languages))
    wrong = max(len(languages) - 1, 1)

    def says(value: Column, right: float) -> Column:
        match = F.transform(names, lambda n: F.when(n == value, F.lit(float(np.log(right)))).otherwise(F.lit(float(np.log((1 - right) / wrong)))))
        return F.when(F.array_contains(names, value), match).otherwise(F.transform(names, lambda n: F.lit(0.0)))

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = add(add(scores, prior), add(says(declared, DECLARED), says(hint, HINTED)))
    powers = F.transform(total, lambda x: F.exp(x - F.array_max(total)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def identify(rows: DataFrame, model: Model, carry: list[str], text: str = "text", host: str = "host", url: str | None = None, declared: str | None = None, markup: str | None = None, keep_text: bool = False, sure: float = SURE) -> DataFrame:
    """rows' columns `carry` (and text if keep_text) with lang_id, posterior and accepted, one row for each
    row of rows.

    host: whose prior holds (null: one host of its own). url: its country domain, or a two-letter first
    path segment, is the hint. declared: the markup's language (first two letters count). A text without
    letters (null and empty ones too) has no likelihood and is never accepted; its lang_id is what the
    other evidence says, the first language if there is none. Ties go to the first language. Repeated rows
    stay; columns of clashing names are carried as they are; an empty table gives an empty result. Texts are
    scored once, whatever their length, and written with what is carried; the written rows meet the priors.
    """
    languages = model.languages
    hide, d, u, h, dom, suf, ll, pr, many, post = fresh(rows, "markup", "declared", "url", "host", "domain", "suffix", "scores", "prior", "n", "posterior")
    labels = F.split(F.col(h), r"\.")
    read = rows.select(
        *[quoted(c) for c in dict.fromkeys([*carry, text])],
        (quoted(markup) if markup else F.lit(False)).alias(hide),
        F.lower(F.substring(quoted(declared), 1, 2)).alias(d) if declared else F.lit(None).cast("string").alias(d),
        (quoted(url) if url else F.lit(None).cast("string")).alias(u),
        F.coalesce(quoted(host), F.lit("")).alias(h),
    )
    read = read.withColumn(suf, F.when(F.size(labels) > 1, F.element_at(labels, -1)).otherwise(F.lit("")))
    read = read.withColumn(dom, F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.lit("")))
    scored = materialise(with_likelihood(read, text, ll, model, keep_text, hide))
    priors = materialise(host_priors(scored.select(F.col(h).alias("host"), F.col(dom).alias("domain"), F.col(suf).alias("suffix"), F.col(ll).alias("scores")), languages))
    near = F.regexp_extract(F.coalesce(F.col(u), F.lit("")), r"://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1)
    country = F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv]), F.col(suf))
    hint = F.when(near != "", F.lower(near)).otherwise(F.when(F.col(u).isNotNull(), country))
    # Hosts of very many rows meet them by broadcast.
    joined = join_skewed(scored, priors.toDF(h, pr, many), h, many, scored.count())
    posterior = fused(F.col(ll), F.col(pr), F.col(d), hint, languages)
    out = joined.withColumn(post, posterior)
    heard = F.array_max(F.col(ll)) > F.array_min(F.col(ll)) if len(languages) > 1 else F.lit(True)
    kept = [quoted(c) for c in dict.fromkeys([*carry, *([text] if keep_text else [])])]
    return out.select(*kept, best(F.col(post), languages).alias("lang_id"), F.array_max(post).alias("posterior"), (heard & (F.array_max(post) >= sure)).alias("accepted"))


def keep_identified(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", sure: float = SURE) -> DataFrame:
    """docs whose language is identified: letters, and a posterior of at least `sure`; all columns stay.
    The model is fitted on a sample of docs' own labels."""
    if docs.where(quoted(text).isNotNull() & quoted(lang).isNotNull()).isEmpty():
        return docs.where(F.lit(False))  # nothing to learn from, so nothing can be identified
    model = fit(docs, text, lang)
    found = identify(docs, model, docs.columns, text, source, keep_text=True, sure=sure)
    return found.where("accepted").select(*[quoted(c) for c in docs.columns])
