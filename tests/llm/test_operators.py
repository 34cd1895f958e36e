"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on nulls, empty
and long texts, ties, repeated rows, empty tables and clashing column names."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import chat, common, exact, language, mixing, phrases, pieces, queries, simhash, suffixes, urls, wordpieces
from seqloom.llm.common import table
from seqloom.llm.vocabulary import SPACE, read_pieces

from ..oracle import compare

R = random.Random(3)
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed=None):
    r = random.Random(seed) if seed is not None else R
    return " ".join("".join(r.choice("aeinorst") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, repeated rows, equal texts, empty and long ones, and columns with clashing names."""
    long = words(60_000, 1)
    rows = [(1, "same text", "en", "a", 1), (2, "same text", "en", None, 1), (2, "same text", "en", None, 1), (None, "same text", None, "a", None), (None, None, None, None, None), (4, "", "en", "b", 0), (5, None, "de", "b", 0), (6, long, "en", "a", 1), (7, long, "en", "b", 1), (8, " \t\n", "fr", "b", 3), (9, "ünïcode ▁ text 中\n", "fr", "c", 1)]
    df = spark.createDataFrame(rows, DOC)
    for name in ("key", "__key", "Count", "fp", "__fp", "root", "size", "hash", "ids", "a.b", "n_bytes", "__text", "scores"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, sf_dir, queries.QUERIES[name], queries.SQL[name])


# 1


def test_url_parts_and_rules(spark):
    cases = {"HTTP://A.Example.ORG/es/x?y#z": ("a.example.org", "/es/x", "example.org/es/"), "https://example.org/en/17": ("example.org", "/en/17", "example.org/en/1"), "x://b.org": ("b.org", "", None), "x://notexample.org/en/1": ("notexample.org", "/en/1", "org/"), "x://q.com/fr/": ("q.com", "/fr/", "com/fr/"), "x://com/de/?": ("com", "/de/", "com/de/"), "no scheme /en/": ("", "", None), "a://b://c/d": ("b:", "//c/d", None), None: ("", "", None), "": ("", "", None), "h://x.net?q=/fr/": ("x.net", "", None), "h://ÄB.org/": ("Äb.org", "/", "org/")}
    df = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id long, url string").withColumn("score", F.lit(1)).withColumn("gram", F.lit(2))
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for k, want in enumerate(cases.values()):
        assert (got[k].host, got[k].path, got[k].rule) == want
        assert got[k].verdict == {"org/": "allow", "com/fr/": "allow", None: got[k].verdict}.get(want[2], "block")
        assert got[k].verdict in ("allow", "block")


def naive_model(texts, order=4):
    """(label, text) to ln ratios of all grams, by the recursion itself."""
    counts = {c: collections.Counter() for c in "ar"}
    for label, t in texts:
        s = "\2" * order + t + "\3"
        for i in range(order, len(s)):
            for k in range(order + 1):
                if label:
                    counts[label][s[i - k : i + 1]] += 1
    every = {s[i - order : i + 1] for _, t in texts for s in ["\2" * order + t + "\3"] for i in range(order, len(s))}
    alphabet = len({g[-1] for g in every})

    def p(c, gram):
        n = counts[c]
        ones = [g for g in n if len(g) == 1]
        out = (n[gram[-1]] + 1) / (sum(n[g] for g in ones) + alphabet)
        for k in range(1, order + 1):
            g = gram[order - k :]
            after = [h for h in n if len(h) == k + 1 and h[:-1] == g[:-1]]
            total = sum(n[h] for h in after)
            if total:
                out = (n[g] + len(after) * out) / (total + len(after))
        return out

    return {g: float(np.log(p("a", g) / p("r", g))) for g in every}


def test_url_model_equals_its_definition(spark):
    texts = [("a", "good.org/en/1"), ("a", "good.org/fr/2"), ("r", "bad.com/de/3"), (None, "odd.net/x"), ("r", "bad.com/de/33")]
    df = spark.createDataFrame(texts, "label string, text string").select("label", F.explode(urls.grams(F.col("text"))).alias("gram"))
    counts = df.groupBy("gram").agg(F.count_if(F.col("label") == "a").alias("a"), F.count_if(F.col("label") == "r").alias("r"))
    got = {r.gram: r.ratio for r in urls.model(counts).collect()}
    want = naive_model(texts)
    assert got.keys() == want.keys()
    assert all(abs(got[g] - want[g]) < 1e-9 for g in want)


def test_urls_tell_classes_apart(spark):
    rows = [(k, f"http://{'news' if k % 2 else 'spam'}{k % 9}.{'org' if k % 2 else 'com'}/{'en' if k % 2 else 'de'}/{k}") for k in range(400)]
    rows += [(1000, "http://news3.net/en/5"), (1001, "http://spam4.net/de/5")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1000] == "allow" and got[1001] == "block"


def test_urls_are_scored_whole(spark):
    rows = [(k, f"http://{'a.org' if k % 2 else 'b.com'}/de/{k}?q={'good' if k % 2 else 'evil'}") for k in range(200)]
    rows += [(1000, "http://c.net/x?q=good"), (1001, "http://c.net/x?q=evil"), (1002, "c?q=good"), (1003, "c?q=evil"), (1004, None), (1005, "")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == len(rows) and got[1004].score == got[1005].score
    for good, bad in ((1000, 1001), (1002, 1003)):
        assert got[good].score > got[bad].score and (got[good].host, got[good].path) == (got[bad].host, got[bad].path)
    assert got[1000].verdict == "allow" and got[1001].verdict == "block"


def judged_brute(texts):
    """(verdict, score) of each URL by plain loops: rules, the model of those not held out, the cut on the others."""

    def rule(t):
        head, sep, tail = t.partition("://")
        cut = next((i for i, c in enumerate(tail) if c in "/?#"), len(tail))
        host, path = "".join(c.lower() if c.isascii() else c for c in tail[:cut]), tail[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if sep and fits else None

    every = sorted({t or "" for t in texts})
    told = {t: rule(t) for t in every}
    held = {t: xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(t.encode(), 42) >> 63) for t in every}
    held = {t: h % 5 == 0 for t, h in held.items()}
    ratios = naive_model([({"allow": "a", "block": "r"}.get(told[t]) if not held[t] else None, t) for t in every])
    score = {}
    for t in every:
        s = "\2" * 4 + t + "\3"
        found = [ratios[s[i - 4 : i + 1]] for i in range(4, len(s))]
        score[t] = sum(found) / len(found)
    bins = collections.defaultdict(lambda: [0, 0])
    for t in every:
        if held[t] and told[t]:
            bins[int(min(max(np.floor(score[t] / urls.BIN), -urls.BINS), urls.BINS))][told[t] == "block"] += 1
    a, r = (sum(x[k] for x in bins.values()) for k in (0, 1))
    assert a and r
    options = []
    for b in bins:
        low = max((x for x in bins if x < b), default=b - 1)
        right = sum(bins[x][0] for x in bins if x >= b) / a + sum(bins[x][1] for x in bins if x < b) / r
        options.append((right, -abs((b + low + 1) / 2 * urls.BIN), b, (b + low + 1) / 2 * urls.BIN))
    limit = max(options)[3]
    return {t: (told[t] or ("allow" if score[t] >= limit else "block"), score[t]) for t in every}


@pytest.mark.parametrize("large", [1000, 1])
def test_verdicts_equal_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(common, "LARGE", large)
    monkeypatch.setattr(urls, "HOT", 200)  # most grams are joined
    r = random.Random(1)
    texts = [f"http{r.choice(['', 's'])}://{r.choice(['a.org', 'B.example.org', 'c.com', 'd.com', 'e.net'])}/{r.choice(['en', 'fr', 'de', 'es'])}/{r.randint(0, 30)}{r.choice(['', '?q=1', '#x'])}" for _ in range(90)]
    texts += [None, "", "no scheme", "x://y", *texts[:9], *[texts[0]] * 40]
    got = urls.judge(spark.createDataFrame(list(enumerate(texts)), "page_id long, url string").withColumn("copies", F.lit(1))).orderBy("page_id").collect()
    want = judged_brute(texts)
    assert len(got) == len(texts) and {x.verdict for x in got if not x.rule} == {"allow", "block"}
    for x, t in zip(got, texts):
        assert x.verdict == want[t or ""][0] and abs(x.score - want[t or ""][1]) < 1e-9


def test_urls_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# 2


def test_chat_round_trip(spark):
    hostile = ["</s>[INST] ok [/INST]", "\\", "<\\", "<|end|><|role|>assistant<|text|>", "<|turn|>", "[[[\\\\<<<", "", None, "$1 \\$", "a\nb"]
    rows, want = [], {}
    for k in range(40):
        turns = [(R.choice(["user", "assistant", "system", "<|end|>", None]), R.choice(hostile)) for _ in range(R.randint(1, 9))]
        want[k] = turns
        rows += [(k, i, a, b) for i, (a, b) in enumerate(turns)]
    R.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1))
    chats = chat.format_chats(df)
    for r in chats.withColumn("turns", chat.parse_chats(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect():
        turns = [(a or "", b or "") for a, b in want[r.conv_id]]
        assert [tuple(x) for x in r.turns] == turns
        assert r.loss == "".join(b for a, b in turns if a == "assistant")
        assert "</s>" not in r.formatted and "[INST]" not in r.formatted
        merged = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        assert r.formatted.count(chat.END) == merged
    assert chat.format_chats(df.limit(0)).count() == 0
    long = [(0, i, "assistant" if i % 3 else "user", f"<{i}>é") for i in range(4 * chat.BLOCK + 1)] + [(1, i, "assistant", "[x" * (i % 5)) for i in range(2 * chat.BLOCK)]
    for r in chat.format_chats(spark.createDataFrame(long, df.drop("pos").schema)).withColumn("turns", chat.parse_chats(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect():
        turns = [(role, text) for conv, _, role, text in long if conv == r.conv_id]
        assert [tuple(x) for x in r.turns] == turns and r.loss == "".join(text for role, text in turns if role == "assistant")
        assert r.formatted.count(chat.END) == (1 if r.conv_id else 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:])))
        assert all(r.formatted[s : s + n].replace("\\", "") in {text for _, text in turns} for s, n in r.loss_spans)
    nulls = spark.createDataFrame([(None, None, "user", "x"), (None, 1, "user", "y"), (None, None, "user", "x")], df.drop("pos").schema)
    assert chat.digest(chat.format_chats(nulls)).first().n_turns == 3


# 3


def greedy(word, entries):
    n, i, word = 0, 0, SPACE + word
    while i < len(word):
        for j in range(len(word), i, -1):
            if word[i:j] in entries:
                n, i = n + 1, j
                break
        else:
            n, i = n + len(word[i].encode()), i + 1
    return n


def test_token_counts(spark, odd, none):
    entries = {p for p, kind, _ in read_pieces() if kind == "piece"}
    a = wordpieces.Automaton(entries)
    for _ in range(3000):
        w = "".join(R.choice("aehtino▁中<0x>étr☃") for _ in range(R.randint(1, 14)))
        assert a.count(SPACE + w) == greedy(w, entries)
    small = wordpieces.Automaton(["a", "abcd", "bc", "ab", SPACE, "dx"])
    for w in ("abcd", "abcx", "abcabcd", "dx", "d", "xabcdx"):
        assert small.count(SPACE + w) == greedy(w, {"a", "abcd", "bc", "ab", SPACE, "dx"})
    got = wordpieces.token_counts(odd)
    assert got.count() == odd.count()
    for r, d in zip(got.orderBy("doc_id", "n_words").collect(), odd.withColumn("n", F.size(F.array_remove(F.split("text", r"[\s]+"), ""))).orderBy("doc_id", "n").collect()):
        assert r.n_tokens == sum(greedy(w.decode(), entries) for w in (d.text or "").encode().split())
    assert wordpieces.token_counts(none).count() == 0


# 4


def simhash_brute(text, k, seeds):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    out = ""
    for seed in seeds:
        h = [xxhash.xxh64_intdigest(x, seed) for x in sh]
        out += "".join("1" if sum(x >> (63 - b) & 1 for x in h) * 2 > len(h) else "0" for b in range(64))
    return int(out, 2)


def brute_components(ids, prints, differ):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= differ:
                root[find(i)] = find(j)
    low = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low.get(find(i)) for i in range(len(ids))]


def test_simhash_equals_brute_force(spark, odd, none):
    base = [words(60) for _ in range(12)]
    docs = [(k, " ".join(w if R.random() > 0.02 else "zz" for w in base[k % 12].split())) for k in range(150)] + [(500, "Zz Zz"), (501, None), (502, ""), (503, "zz zz")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    prints = [simhash_brute(t, 3, [42]) for _, t in docs]
    got = {r.doc_id: r for r in simhash.groups(df).collect()}
    want = brute_components([k for k, _ in docs], prints, 3)
    assert len(set(want)) < len(docs)
    for (k, _), p, c in zip(docs, prints, want):
        assert (got[k].fingerprint, got[k].component_id) == (f"{p:016x}", c)
    assert int.from_bytes(simhash.fingerprint(base[0], 5, 128), "big") == simhash_brute(base[0], 5, [42, 43])
    assert simhash.groups(odd).count() == odd.count()
    assert simhash.groups(none).count() == 0


def near_prints(n):
    """Fingerprints in chains of near ones, and others."""
    base, out = R.randbytes(8), []
    rows = [np.frombuffer(base, np.uint8)]
    for _ in range(n):
        x = np.unpackbits(rows[R.randrange(len(rows))].copy())
        for b in R.sample(range(64), R.randint(0, 6)):
            x[b] ^= 1
        rows.append(np.packbits(x))
        out.append(np.frombuffer(R.randbytes(8), np.uint8))
    return np.array(rows + out[: n // 4])


def roots(n, links):
    root = list(range(n))
    for _ in range(n):
        for x, y in links:
            root[x] = root[y] = min(root[x], root[y])
    return root


@pytest.mark.parametrize("grid", [simhash.Grid(64, 2, 3, groups=6), simhash.Grid(64, 1, 3, groups=5), simhash.Grid(64, 4, 3, groups=4)])
def test_links_lose_no_near_pair(grid):
    a = near_prints(300)
    near = [(i, j) for i in range(len(a)) for j in range(i) if np.unpackbits(a[i] ^ a[j]).sum() <= 3]
    keys = list(grid.cells(a))
    assert all(any(k[i] == k[j] for k in keys) for i, j in near)
    for k in keys[:3]:  # squares of one cell: near pairs that share the cell share a square
        squares = np.array(list(grid.finer(k, a)))
        assert all(set(squares[:, i]) & set(squares[:, j]) for i, j in near if k[i] == k[j])
    counts = grid.counts(a).astype(int)
    assert all(np.abs(counts[i] - counts[j]).sum() <= np.unpackbits(a[i] ^ a[j]).sum() for i in range(40) for j in range(i))
    n64 = a.view(np.uint64)
    want = brute_components(list(range(len(a))), [int(x) for x in n64.ravel()], 3)
    found = simhash.forest(n64, grid.counts(a), 3)
    assert roots(len(a), found) == want and len(found) == len(a) - len(set(want))


@pytest.mark.parametrize("most", [16384, 40, 6])
def test_large_cells_are_divided(spark, monkeypatch, most):
    """One cell for all: it is passed on, divided and dealt, and no near pair is lost."""
    monkeypatch.setattr(simhash, "MEET", most)
    a = np.unique(near_prints(120), axis=0)
    grid = simhash.Grid(64, 2, 3, groups=6)
    grid.keys = [[]]
    df = spark.createDataFrame([(bytes(x),) for x in a], "fp binary")
    at = {bytes(x): k for k, x in enumerate(a)}
    found = [(at[bytes(r.a)], at[bytes(r.b)]) for r in simhash.links(df, "fp", grid).collect()]
    assert roots(len(a), found) == brute_components(list(range(len(a))), [int(x) for x in a.view(np.uint64).ravel()], 3)


def test_near_duplicates_go_and_others_stay(spark):
    rows, near = [], []
    for k in range(60):
        w = words(300, 100 + k).split()
        rows.append((k, " ".join(w)))
        for v in range(2):  # 1.5 % of the words changed: similarity about 0.86
            x = [("changed" if random.Random(k * 7 + v + i).random() < 0.015 else y) for i, y in enumerate(w)]
            rows.append((1000 + 2 * k + v, " ".join(x)))
            near.append(1000 + 2 * k + v)
    rows += [(9000, None), (9001, ""), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("best", F.lit(1))
    got = sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect())
    assert got == [*range(60), 9000, 9001]
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def shingles_brute(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))}


def similar_brute(texts, similarity=0.8):
    """Of each component of pairs of that exact similarity, the smallest id."""
    sets = {i: shingles_brute(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in texts if root[i] == i)


@pytest.mark.parametrize("most, shingles", [(16384, 1 << 22), (3, 1 << 22), (16384, 700), (16384, 10)])
def test_near_duplicates_are_decided_by_shingle_sets(spark, monkeypatch, most, shingles):
    monkeypatch.setattr(simhash, "MEET", most)
    monkeypatch.setattr(simhash, "MEET_SHINGLES", shingles)
    r, texts = random.Random(9), {}
    for k in range(60):  # from similarity 0.5 to 0.95, many about 0.8
        w = words(240, 500 + k).split()
        texts[k] = " ".join(w)
        for v in range(4):
            texts[1000 + 4 * k + v] = " ".join(f"new{r.random()}" if r.random() < r.choice([0.01, 0.02, 0.025, 0.04, 0.06]) else y for y in w)
    line, w = " ".join(f"menu{i}" for i in range(6)), words(200, 900).split()
    for k in range(8):  # one line often repeated, other words all different; and a dense group
        texts[3000 + k] = " ".join([line] * 60 + words(150, 700 + k).split())
        texts[4000 + k] = " ".join([*w[: 20 * k], f"x{k}", *w[20 * k :]])
    texts |= {5000: "one two three four five", 5001: "One two\tthree four five", 5002: "few words", 5003: "Few  words"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.drop_near_duplicates(df).collect()) == similar_brute(texts)


def test_near_dedup_finds_a_similar_pair_without_a_common_minimum(spark):
    """Two texts of similarity 0.8, chosen so that none of the 24 bands of minimum hashes used before has them in one cell."""
    a = " ".join(f"w{k}" for k in range(12))
    texts = {1: a, 2: f"{a} x19112 y995", 3: " ".join(f"w{k}" for k in range(40, 54))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.drop_near_duplicates(df).collect()) == similar_brute(texts) == [1, 3]


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_cells_of_segments_lose_no_similar_pair(similarity):
    g = np.random.default_rng(3)
    for v in range(1500):
        common = int(g.integers(2, 400 if v % 4 == 0 else 40))
        more = int(common / similarity + 1e-9) - common  # as many shingles of one set only as there can be
        x = g.integers(0, 1 << 64, common + more, np.uint64, endpoint=False)
        k = int(g.integers(0, more + 1))
        a, b = np.unique(x[: common + k]), np.unique(np.r_[x[:common], x[common + k :]])
        if more:
            assert np.intersect1d(simhash.segment_cells(a, similarity), simhash.segment_cells(b, similarity)).size, (len(a), len(b))


@pytest.mark.parametrize("few", [2, 8, 64])
def test_pairs_within_the_bounds_connect_as_all_pairs_do(monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    g = np.random.default_rng(5)
    prints = g.integers(0, 256, (90, 32), np.uint8)
    for k in range(80):  # chains and dense groups
        if k % 3:
            prints[k + 1] = prints[k]
            prints[k + 1, g.integers(0, 32, 10)] ^= 129
    sizes, cells = g.integers(80, 110, 90), np.sort(g.choice([1, 1, 2, 3, 4, 5], 90))
    counts = simhash.prints_grid().counts(prints).astype(int)

    def near(i, j):
        far = np.unpackbits(prints[i] ^ prints[j]).sum()
        bounds = np.abs(counts[i] - counts[j]).sum() <= simhash.RADIUS and far <= simhash.RADIUS
        return cells[i] == cells[j] and min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j]) and bounds

    def connected(pairs):
        group = list(range(90))
        for i, j in pairs:
            group = [group[i] if x == group[j] else x for x in group]
        return {frozenset(k for k in range(90) if group[k] == x) for x in group}

    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if near(i, j)}
    got = {(min(x), max(x)) for x in zip(*(x.tolist() for x in simhash.near_pairs(cells, sizes, prints, 0.8)))}
    assert got <= want and connected(got) == connected(want) and len(connected(want)) < 90


def test_near_dedup_stage_on_given_documents(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents").dropDuplicates(["text"]).persist()
    got = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in got.collect()) == similar_brute({r.doc_id: r.text for r in docs.collect()})


def test_fingerprints_of_similar_sets_are_within_the_radius():
    for n in (4, 8, 40, 400):
        for v in range(60):
            g = np.random.default_rng(1000 * n + v)
            x = np.unique(g.integers(0, 1 << 63, 5 * n, dtype=np.uint64))
            y = x[: 4 * n]
            a, b = (np.frombuffer(simhash.set_print(z), np.uint8) for z in (x, y))
            counts = simhash.prints_grid().counts(np.stack((a, b))).astype(int)
            far = int(np.unpackbits(a ^ b).sum())
            assert np.abs(counts[0] - counts[1]).sum() <= far <= simhash.RADIUS


@pytest.mark.parametrize("total", [10, 100_000])
def test_joins_on_large_keys(spark, monkeypatch, total):
    """Keys of many rows, by broadcast or not: the same rows, those without a partner too."""
    monkeypatch.setattr(common, "LARGE", 3)
    rows = [(1, "a", k) for k in range(7)] + [(1, "b", k) for k in range(2)] + [(2, "a", 0), (3, "c", 0), (3, "c", 0)]
    one = spark.createDataFrame([(1, "a", 7, "x"), (1, "b", 2, "y"), (2, "a", 1, "z")], "k int, l string, n long, v string")
    for how in ("inner", "left"):
        got = common.join_skewed(spark.createDataFrame(rows, "k int, l string, i int"), one, ["k", "l"], "n", total, how).collect()
        found = {(1, "a"): "x", (1, "b"): "y", (2, "a"): "z"}
        want = [(*r, found.get(r[:2])) for r in rows if how == "left" or r[:2] in found]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_large_groups_change_no_result(spark, sf_dir, monkeypatch, odd):
    """Operators give the same rows where every key counts as a large one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    many = docs.unionByName(docs.where("doc_id % 4 = 0")).unionByName(odd.select(*docs.columns))
    runs = [exact.exact_duplicates, simhash.groups, suffixes.remove_repeats, simhash.drop_near_duplicates, language.keep_identified]
    plain = [sorted(map(repr, f(many).collect())) for f in runs]
    monkeypatch.setattr(common, "LARGE", 1)
    monkeypatch.setattr(suffixes, "LARGE", 1)
    for f, want in zip(runs, plain):
        assert sorted(map(repr, f(many).collect())) == want, f.__name__


def test_components_of_a_large_star(spark, monkeypatch):
    monkeypatch.setattr(common, "LARGE", 5)
    star = [(0, k) for k in range(1, 60)] + [(70, 71), (59, 60)]
    got = {(r.node, r.root) for r in simhash.components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {(k, 0) for k in range(1, 61)} | {(71, 70)}


def test_components_plan_one_step_at_a_time(spark, monkeypatch):
    """A plan's text is held by the driver after each of its stages, so no plan nests the steps; stars end it at once."""
    leaves = []

    def seen(df):
        leaves.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return common.materialise(df)

    monkeypatch.setattr(simhash, "materialise", seen)
    star = [(0, k) for k in range(1, 20)] + [(21, 20)]
    got = {(r.node, r.root) for r in simhash.components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {(k, 0) for k in range(1, 20)} | {(21, 20)}
    assert max(leaves) <= 12 and len(leaves) == 3
    assert simhash.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (200, 200)]
    e = spark.createDataFrame(chain, "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(e).collect()} == {(k, 0) for k in range(1, 41)} | {(101, 100)}


# 5


def test_mixing_on_odd_rows(spark, odd, none):
    got = mixing.mix_sizes(odd).collect()
    assert len(got) == odd.count()
    assert all(r.taken <= 3 * r["size"] and r.target <= 3 * r.source_size + 1e-6 for r in got)
    total = sum(r["size"] for r in got)
    assert abs(sum({r.source: r.target for r in got}.values()) - total) < 1e-6 * total
    assert mixing.mix_sizes(none).count() == 0
    assert mixing.mixed(odd).columns == odd.columns
    zero = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", "b", 0)], DOC)
    assert [r.target for r in mixing.mix_sizes(zero).collect()] == [0.0, 0.0]


def test_mixing_comes_near_its_targets(spark):
    df = spark.createDataFrame([(k, words(R.randint(1, 20)), "en", "hot" if k % 3 else f"s{k % 7}", 0) for k in range(1500)], DOC)
    got = mixing.mix_sizes(df).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for rows in by.values():
        assert abs(rows[0].target - sum(r.taken for r in rows)) <= max(r["size"] for r in rows) / 2
    again = mixing.mixed(df)
    assert again.count() == sum(r.times for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sizes(df).collect()))


@pytest.mark.parametrize("giant", [400, 3000, 20000])
def test_one_giant_text_does_not_empty_its_source(spark, giant):
    rows = [(k, words(20), "en", "giant" if k % 2 else "plain", 0) for k in range(400)] + [(1001, "w " * giant, "en", "giant", 0)]
    got = mixing.mix_sizes(spark.createDataFrame(rows, DOC)).collect()
    want = mixing_brute([(r.doc_id, r.source, r["size"]) for r in got])
    assert {r.doc_id: r.taken for r in got} == want
    for source in ("giant", "plain"):
        mine = [r for r in got if r.source == source]
        assert abs(mine[0].target - sum(r.taken for r in mine)) <= max(r["size"] for r in mine) / 2


def mixing_brute(rows):
    """Taken words by document: targets by repeated sharing, then document after document by rising hash."""
    size, weight = collections.Counter(), {}
    for _, source, n in rows:
        size[source] += n
    for k, source in enumerate(sorted(size)):
        weight[source] = (1, 2, 3)[k % 3]
    target, full = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in full)
        target = {s: 3.0 * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in size if x not in full) for s in size}
        over = {s for s in size if s not in full and target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    taken = {}
    for source in size:
        base = int(target[source] // size[source])
        room, going = target[source] - base * size[source], True
        for doc, n in sorted(((d, n) for d, s, n in rows if s == source), key=lambda x: int(hashlib.md5(str(x[0]).encode()).hexdigest()[:15], 16)):
            fits = going and (n <= room or 2 * room > n)
            going = going and n <= room
            room -= n if going else 0
            taken[doc] = n * min(3, base + fits)
    return taken


# 6


def suffix_brute(texts):
    n = collections.Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - 399):
            if n[t[i : i + 400]] > 1:
                gone[i : i + 400] = [True] * 400
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def suffix_check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("first", F.lit(1))
    got = [tuple(r) for r in suffixes.remove_repeats(df).orderBy("doc_id").select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert got == suffix_brute([(t or "").encode() for t in texts])


def test_suffix_dedup_equals_brute_force(spark):
    rnd = lambda n, al="abcdefgh ": "".join(R.choice(al) for _ in range(n))
    passage = rnd(520)
    texts = [rnd(R.randint(0, 600)) + (passage[R.randint(0, 60) : R.randint(380, 520)] if R.random() < 0.5 else "") + rnd(R.randint(0, 600)) for _ in range(60)]
    suffix_check(spark, [*texts, "ab" * 500, "x" * 900, None, "", "ab" * 500, rnd(40) * 30, rnd(400), texts[0], rnd(500, "éü日"), rnd(399)])


def test_suffix_dedup_divides_large_groups(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 8)
    rnd = lambda n: "".join(R.choice("abcdefgh ") for _ in range(n))
    passage = rnd(430)
    suffix_check(spark, [rnd(200) + passage[: R.randint(200, 430)] + rnd(250) for _ in range(60)])


def test_spans_of_copies_are_listed_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(suffixes, "materialise", lambda df, f=suffixes.materialise: seen.append(f(df)) or seen[-1])
    text = "".join(random.Random(5).choice("abcdefgh ") for _ in range(900))
    suffix_check(spark, [text] * 40)
    lists = [r.spans for df in seen if "spans" in df.columns for r in df.collect()]
    assert lists and all(len(x) == len(set(x)) for x in lists)


@pytest.mark.parametrize("step", [700, 1000])
def test_suffix_dedup_of_texts_in_steps(spark, monkeypatch, step):
    """Texts longer than what is hashed at a time, with repeats across the steps."""
    monkeypatch.setattr(suffixes, "STEP", step)
    monkeypatch.setattr(suffixes, "_TABLES", [])
    r = random.Random(step)
    rnd = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = rnd(900)
    suffix_check(spark, [rnd(k * 97) + passage[: 400 + 60 * k] + rnd(2500) for k in range(8)] + [rnd(5000), "ab" * 1500, passage * 3])
    # Every window of a long text is in one run.
    text = "".join(r.choice("abcdefgh ") for _ in range(6000))
    import pyarrow as pa

    covered = [w for _, _, _, first, span, _ in suffixes.text_runs(pa.array([text])) for f, n in zip(first, span) for w in range(f, f + n + 1)]
    assert sorted(covered) == list(range(len(text) - 399))


def test_common_prefixes_are_numbers():
    for _ in range(500):
        x, y = (bytes(R.choice(b"ab") for _ in range(R.randint(1, 30))) for _ in range(2))
        i, j, most = R.randint(0, len(x)), R.randint(0, len(y)), R.randint(1, 20)
        n = 0
        while n < most and i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
            n += 1
        assert suffixes.common_prefix(x, i, y, j, most) == n


def test_two_stage_sort():
    for _ in range(300):
        st = [bytes(R.choice(b"ab\0\xff") for _ in range(R.randint(1, 30))) for _ in range(R.randint(1, 5))]
        up = [R.randint(0, len(s) - 1) for s in st]
        assert [st[k][i:] for k, i in suffixes.two_stage_sort(st, up)] == sorted(s[i:] for s, u in zip(st, up) for i in range(u + 1))


def test_suffix_dedup_on_odd_rows(spark, odd, none):
    got = suffixes.remove_repeats(odd)
    assert got.count() == odd.count()
    assert [r.n_removed == r.n_bytes for r in got.where("doc_id in (6, 7)").collect()] == [True, True]
    assert suffixes.remove_repeats(none).count() == 0


# 7


def best_cut(v, text):
    """Plain Viterbi over the whole text."""
    s = pieces.marked(text)
    best, back = [0] + [None] * len(s), [None] * (len(s) + 1)
    known = {p: i for p, kind, i in read_pieces() if kind == "piece"}
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - v.reach), j):
            p = s[i:j]
            ways = [(v.score(known[p]), [known[p]])] if p in known else [(v.byte_score * len((SPACE if p == pieces.OWN_MARK else p).encode()), v.spelled(p))] if j == i + 1 else []
            for score, ids in ways:
                if best[j] is None or best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, (i, ids)
    out, at = [], len(s)
    while at:
        at, ids = back[at]
        out = ids + out
    return out


TEXTS = ["a", " a  b ", "▁", "x▁y ▁", "中文字", "line\nline\n\n end", "\0 a\0b", "   ", "tab\tand\U0001f600", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]


def test_encoding_is_the_best_cut():
    v = pieces.Vocabulary(read_pieces())
    r = random.Random(4)
    texts = TEXTS + ["".join(r.choice("aehtino  ▁中étr\n\0") for _ in range(r.randint(1, 80))) for _ in range(60)]
    for t, got in zip(texts, v.encode_all(texts)):
        ids = np.frombuffer(got, np.int32).tolist()
        assert ids == best_cut(v, t)
        assert v.decode(ids) == t


def test_giant_texts_in_chunks(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("aehtino ▁中r\n") for _ in range(r.randint(0, 400))) for _ in range(12)] + ["the" * 100, None, "", "in " * 90, "in " * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.lit("k"))
    v = pieces.Vocabulary(read_pieces())
    for chunk in (1, 64):
        got = {x.doc_id: (x.ids, x.key) for x in pieces.encode(df, chunk=chunk).collect()}
        assert got == {k: (np.frombuffer(v.encode(t or ""), np.int32).tolist(), "k") for k, t in enumerate(texts)}
    back = {x.doc_id: x.decoded for x in pieces.encode(df, chunk=64, decoded="decoded").collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    back = {x.doc_id: x.text for x in pieces.decode(pieces.encode(df, chunk=64)).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}


def test_ids_of_a_chunk_are_held_as_bytes():
    """Four bytes an id: lists of integers took hundreds of MB for a batch of chunks."""
    v = pieces.Vocabulary(read_pieces())
    for text in ("the quick brown fox " * 9, "x" * 90):
        s = pieces.marked(text)
        got = v.chunk_ids(s, len(s), [0], 0)
        assert isinstance(got, bytes) and got == v.encode(text)


def test_workers_forget_words_between_tasks(spark):
    """They outlive their tasks: what one keeps is held while later stages run."""
    texts = [words(6000, k) for k in range(20)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    rows = pieces.encode(docs).collect()
    assert [pieces.Vocabulary(read_pieces(pieces.DEFAULT)).encode(texts[0])] == [np.array(r.ids, np.int32).tobytes() for r in rows if r.doc_id == 0]

    def kept(batches):
        for batch in batches:
            n = max((len(v.recent) for v in pieces._READY.values()), default=0)
            yield batch.rename_columns(["n"]).set_column(0, "n", pa.array([n] * batch.num_rows, pa.int64()))

    held = max(r.n for r in spark.range(0, 64, 1, 8).mapInArrow(kept, "n long").collect())
    assert 0 < held <= pieces.KEEP


def test_slices_hold_all_rows():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in ((0, 2500), (2500, 2500), (2500, 2501))]
    out = list(common.sliced(iter(batches)))
    assert [b.num_rows for b in out] == [1000, 1000, 500, 1]
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(2501))


def test_encoding_odd_rows(spark, odd, none):
    back = pieces.decode(pieces.encode(odd, ids="pieces"), "pieces", "text")
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()))
    assert set(back.columns) == set(odd.columns)
    assert pieces.encode(none).count() == 0


def test_max_plus_products_are_associative():
    g = np.random.default_rng(1)
    a, b, c = (np.where(g.random((5, 5)) < 0.3, pieces.NONE, g.integers(-99, 0, (5, 5))) for _ in range(3))
    assert (pieces.times(pieces.times(a, b), c) == pieces.times(a, pieces.times(b, c))).all()
    assert [p.tolist() for p in pieces.prefixes([a, b, c], pieces.times)] == [a.tolist(), pieces.times(a, b).tolist(), pieces.times(pieces.times(a, b), c).tolist()]


# 8


def test_language_is_found_on_held_out_rows(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    model = language.fit(d.where("doc_id % 2 = 0"))
    got = language.identify(d.where("doc_id % 2 = 1"), model, ["doc_id", "lang"], host="source")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_id")).cast("int")).alias("right"), F.avg(F.col("accepted").cast("int")).alias("kept")).first()
    assert r.right > 0.97 and r.kept > 0.97


def test_evidence_decides_short_pages(spark):
    de, fr = "der und nicht die das auf mit sich des dem " * 9, "le et les des en un une que est dans " * 9
    docs = spark.createDataFrame([(k, de if k % 2 else fr, "de" if k % 2 else "fr", "s", 0) for k in range(40)], DOC)
    model = language.fit(docs)
    rows = [(1, "ok", "x.de.example", "http://x.de.example/a", "de", False), (2, "ok", "y.example", "http://y.example/fr/2", None, False), (3, "<p>" + de + "</p>", "z.fr", "http://z.fr/", "fr", True), (4, None, None, None, None, None), (5, "123", "z.fr", "http://z.fr/", "fr", False)]
    df = spark.createDataFrame(rows, "page_id long, text string, host string, url string, declared string, markup boolean")
    got = {r.page_id: r for r in language.identify(df, model, ["page_id"], url="url", declared="declared", markup="markup").collect()}
    assert (got[1].lang_id, got[2].lang_id, got[3].lang_id) == ("de", "fr", "de")
    assert not got[4].accepted and not got[5].accepted and got[5].lang_id == "fr"
    assert abs(sum(language.Model(["a"], np.zeros((language.GRAMS, 1))).likelihood("text"))) == 0


def identified_brute(rows, model):
    """Posterior of each (text, host, url, declared) by the formulas, in plain loops."""
    names, n = model.languages, len(model.languages)
    first = lambda x: max(range(n), key=lambda k: (x[k], -k))

    def score(text):
        if not any(map(str.isalpha, text or "")):
            return [0.0] * n
        b = text.lower().encode()
        grams = [((b[i] * 2654435761 + b[i + 1] * 40503 * 257 + b[i + 2] * 2246822519) % (1 << 32)) >> 16 for i in range(len(b) - 2)]
        total = [sum(float(model.table[g, k]) for g in grams) for k in range(n)]
        return [x * min(1.0, language.WEIGHT / len(grams)) for x in total] if grams else [0.0] * n

    def parts(host):
        labels = (host or "").split(".")
        return (labels[-1], ".".join(labels[-2:])) if len(labels) > 1 else ("", "")

    scores = [score(r[0]) for r in rows]
    votes = collections.defaultdict(lambda: [0] * n)
    for r, s in zip(rows, scores):
        suffix, domain = parts(r[1])
        for key in ((), (suffix,), (suffix, domain), (suffix, domain, r[1] or "")):
            votes[key]  # a host without votes has a prior, too
            if max(s) > min(s):
                votes[key][first(s)] += 1

    def prior(key):
        above = prior(key[:-1]) if key else [1 / n] * n
        return [(v + language.LENT * a) / (sum(votes[key]) + language.LENT) for v, a in zip(votes[key], above)]

    def says(value, right):
        return [np.log(right if x == value else (1 - right) / max(n - 1, 1)) for x in names] if value in names else [0.0] * n

    out = []
    for (_, host, url, declared), s in zip(rows, scores):
        suffix, domain = parts(host)
        path = (url or "").split("://", 1)[1].split("/", 1)[1:] if "://" in (url or "") else []
        segments = [x.split("?")[0].split("#")[0] for x in path[0].split("/")] if path else []
        near = next((x.lower() for x in segments if len(x) == 2 and x.isalpha()), None)
        hint = near or (language.SUFFIX_LANGUAGE.get(suffix) if url is not None else None)
        total = [a + np.log(b) + c + d for a, b, c, d in zip(s, prior((suffix, domain, host or "")), says((declared or "")[:2].lower() or None, language.DECLARED), says(hint, language.HINTED))]
        powers = [np.exp(x - max(total)) for x in total]
        post = [x / sum(powers) for x in powers]
        out.append((names[first(total)], max(post), bool(max(s) > min(s) and max(post) >= language.SURE)))
    return out


def test_fusion_equals_its_formulas(spark):
    r = random.Random(8)
    vocabulary = {"de": "der und nicht die das auf mit".split(), "fr": "le et les des en un une".split(), "es": "el y los de que una por".split()}
    text = lambda k: " ".join(r.choice(vocabulary[k]) for _ in range(r.choice([1, 2, 30])))
    docs = spark.createDataFrame([(k, text(x), x, "s", 0) for k in range(30) for x in vocabulary], DOC)
    model = language.fit(docs)
    hosts = ["a.x.de", "b.x.de", "y.de", "z.fr", "q.org", "host", "", None]
    rows = [(r.choice([None, "", "123", "ok", text("de"), text("fr"), text("es")]), h, None if r.random() < 0.3 else f"http://{h}/{r.choice(['', 'fr/1', 'ES', 'xx?q', 'page'])}", r.choice([None, "de", "FR-ca", "zz", ""])) for h in hosts for _ in range(9)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows + rows[:5])], "page_id long, text string, host string, url string, declared string").withColumn("scores", F.lit(1)).withColumn("prior", F.lit(2))
    got = language.identify(df, model, ["page_id", "scores"], url="url", declared="declared").orderBy("page_id").collect()
    for x, (name, post, accepted) in zip(got, identified_brute(rows + rows[:5], model), strict=True):
        assert abs(x.posterior - post) < 1e-9 and x.scores == 1
        assert (x.lang_id, x.accepted) == (name, accepted)


def test_every_label_is_a_language(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = [(100 * k + i, " ".join(alphabet[k % 26] + alphabet[k // 26] + alphabet[(k + j) % 26] for j in range(40)), f"l{k}", "s", 0) for k in range(80) for i in range(2)]
    df = spark.createDataFrame(rows, DOC)
    model = language.fit(df)
    assert model.languages == sorted(f"l{k}" for k in range(80))
    got = language.identify(df, model, ["doc_id", "lang"], host="source").collect()
    assert all(x.lang == x.lang_id for x in got)
    assert language.fit(df.limit(0)).languages == []


def test_language_on_odd_rows(spark, odd, none):
    kept = language.keep_identified(odd)
    assert kept.columns == odd.columns and kept.where("text is null or text = ''").isEmpty()
    assert language.keep_identified(none).count() == 0


# 9


def phrase_brute(text, most=None):
    """Plain LZ78 phrases; the dictionary is emptied after `most` of them."""
    known, out, w = set(), set(), ""
    for c in text:
        w += c
        if w not in known:
            out.add(w)
            known.add(w)
            w = ""
            if len(known) == most:
                known = set()
    low = {}
    for p in out:
        h = xxhash.xxh64_intdigest(p.encode())
        low[h % phrases.BINS] = min(low.get(h % phrases.BINS, 1 << 64), h // phrases.BINS)
    return "".join(f"{low[b] % 65535 + 1 if b in low else 0:04x}" for b in range(phrases.BINS))


def likeness_brute(a, b):
    """The share of agreeing four-digit bins among those that either has."""
    x, y = ([s[i : i + 4] for i in range(0, len(s), 4)] for s in (a, b))
    used = [(p, q) for p, q in zip(x, y) if p != "0000" or q != "0000"]
    return sum(p == q for p, q in used) / len(used) if used else 1.0


@pytest.mark.parametrize("step", [1 << 18, 7])
def test_a_parse_does_not_depend_on_the_cut(monkeypatch, step):
    monkeypatch.setattr(phrases, "STEP", step)
    monkeypatch.setattr(phrases, "MOST", 50)
    for text in ("".join(R.choice("abc ") for _ in range(3000)), "a" * 5000, words(400), "bé日\U0001f600" * 90):
        want = phrase_brute(text, 50)
        assert phrases.fingerprint(text) == want
        for _ in range(20):
            cuts = sorted(R.randint(0, len(text)) for _ in range(3))
            parse = phrases.Parse()
            for a, b in zip([0, *cuts], [*cuts, len(text)]):
                parse = parse.feed(text[a:b]).copy()
            assert parse.signature().tobytes().hex() == want


def test_a_dictionary_that_starts_anew():
    """More phrases than a dictionary holds, cut at two places."""
    g = np.random.default_rng(2)
    text = g.integers(0x4E00, 0x9000, 2 * phrases.MOST + 5000).astype("<u4").tobytes().decode("utf-32-le")
    want = phrase_brute(text, phrases.MOST)
    for cut in (0, len(text) // 3, phrases.MOST + 17):
        assert phrases.Parse().feed(text[:cut]).feed(text[cut:]).signature().tobytes().hex() == want


def test_phrase_fingerprints(spark, none):
    texts = {9: words(80), 7: "a" * 500, 5: None, 4: "", 3: "bé日", 2: words(200), 1: words(200)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("range", F.lit(1)).withColumn("to", F.lit(1))
    got = {r.doc_id: r for r in phrases.edited_fingerprints(df).collect()}
    order = sorted(texts, reverse=True)
    for k, n in zip(order, [*order[1:], order[0]]):
        t, nxt = texts[k] or "", texts[n] or ""
        e = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (got[k].fingerprint, got[k].edited_fingerprint) == (phrase_brute(t), phrase_brute(e))
        assert (got[k].near_edited, got[k].near_next) == (likeness_brute(phrase_brute(t), phrase_brute(e)), likeness_brute(phrase_brute(t), phrase_brute(nxt)))
    assert got[2].near_edited > 0.4 > got[2].near_next
    assert phrases.edited_fingerprints(none).count() == 0


def test_an_edited_text_that_equals_another(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST", 40)
    a, b = words(300, 7), words(300, 8)
    edited = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
    df = spark.createDataFrame([(9, a), (8, b), (7, edited), (6, a[:100])], "doc_id long, text string")
    got = {r.doc_id: r for r in phrases.edited_fingerprints(df).collect()}
    assert got[9].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[9].edited_fingerprint == got[7].fingerprint


def test_phrases_of_odd_rows(spark, odd):
    """By falling id, null last, ties by a hash of the text: each row's text is edited with the next row's."""
    rows = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text")).collect()
    want = []
    for r, n in zip(rows, [*rows[1:], rows[0]]):
        e = r.text[: len(r.text) - len(r.text) // 3] + n.text[: len(r.text) // 3]
        want.append((str(r.doc_id), len(r.text), hashlib.sha256(e.encode()).hexdigest(), phrase_brute(r.text), phrase_brute(e)))
    got = [(str(r.doc_id), *r[1:5]) for r in phrases.edited_fingerprints(odd).collect()]
    assert sorted(got) == sorted(want)


def test_phrase_ranges_join_up(spark, monkeypatch, odd):
    monkeypatch.setattr(phrases, "RANGE_ROWS", 3)
    texts = {k * 5: words(20) for k in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in phrases.edited_fingerprints(df).collect()}
    for k, t in texts.items():
        nxt = texts[k - 5 if k else 195]
        assert got[k] == hashlib.sha256((t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]).encode()).hexdigest()
    assert phrases.edited_fingerprints(odd).count() == odd.count()


# 10


def test_exact_dedup(spark, odd, none):
    got = exact.exact_duplicates(odd).collect()
    assert len(got) == odd.count()
    same = [r for r in got if r.text_sha256 == hashlib.sha256(b"same text").hexdigest()]
    assert len(same) == 4 and {r.keep_id for r in same} == {2} and {r.group_size for r in same} == {4} and sum(r.kept for r in same) == 1
    assert sum(r.kept for r in got) == 5
    kept = exact.drop_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [2, 5, 7, 8, 9]
    assert exact.exact_duplicates(none).count() == 0 and exact.drop_duplicates(none).count() == 0


def test_pieces_of_huge_texts(spark):
    rows = [(1, "abé" * 100), (2, "abé" * 100), (3, "abé" * 99 + "abe"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, exact.exact_duplicates(df).collect()))
    assert sorted(map(str, exact.exact_duplicates(df, huge_chars=7, piece_chars=5).collect())) == want


def test_fingerprints_compose():
    for n in (0, 1, 10, exact.STEP - 1, exact.STEP + 3, 3 * exact.STEP):
        x = R.randbytes(n)
        cut = R.randint(0, n)
        assert exact.combine(exact.fingerprint(x[:cut]), exact.fingerprint(x[cut:])) == exact.fingerprint(x)
        for k, p in enumerate(exact.PRIMES):
            h = 0
            for b in x[:2000]:
                h = (h * exact.BASES[k] + b) % p
            assert exact.fingerprint(x[:2000])[0][k] == h


def test_collisions_are_split(spark, monkeypatch):
    """Equal fingerprints of unequal texts are found by the comparison of their pieces."""
    real = exact.with_fingerprints

    def blind(df, text, name, huge_chars):
        out = real(df, text, name, huge_chars)
        return out.withColumn(name, F.lit(b"same"))

    monkeypatch.setattr(exact, "with_fingerprints", blind)
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_duplicates(df).collect()} == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


# The pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "encode_pieces"]
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name == "exact_dedup":
            want = before.groupBy("text").agg(F.max("doc_id").alias("doc_id"))
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in want.collect())
        if name == "near_dedup":
            assert sorted(r.doc_id for r in docs.collect()) == similar_brute({r.doc_id: r.text for r in before.collect()})
        if name == "mix_sources":
            want = {r.doc_id: r.times for r in mixing.mix_sizes(before).collect()}
            assert collections.Counter(r.doc_id for r in docs.collect()) == collections.Counter({k: v for k, v in want.items() if v})
    v = pieces.Vocabulary(read_pieces())
    text = {r.doc_id: r.text for r in before.collect()}
    assert all(v.decode(r.ids) == text[r.doc_id] and len(r.ids) == r.n_pieces for r in docs.collect())




def test_pipeline_of_odd_and_no_rows(spark, odd, none, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", odd.drop("__key")), ("none", none)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert (len(rows) == 0) == (name == "none")
        assert all(r.n_pieces == len(r.ids) > 0 for r in rows)
    assert mixing.mixed(none).count() == 0
    kept = exact.drop_duplicates(language.keep_identified(odd))
    assert {r.doc_id for r in rows} <= {r.doc_id for r in kept.collect()}
