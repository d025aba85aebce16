"""Hard negatives, centroids and quality rules against plain Python, and their edge cases."""

import math
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from compare import difference
from pyspark.sql import functions as F

from roadloom.llm import centroids, hardneg, quality, queries

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, label int, embedding array<double>, copy string"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_centroids"])
def test_same_as_sql(spark, name):
    assert difference(queries.QUERIES[name], queries.ORACLES[name], spark, SF) == ""


def test_packed_products_are_exact():
    rng = np.random.default_rng(1)
    for largest in (1, 5, 300, 1 << 20, 1 << 27):
        a, c = rng.integers(-largest, largest + 1, (7, 33)), rng.integers(-largest, largest + 1, (11, 33))
        packed = hardneg.Packed(c, int(a.min()), int(a.max()))
        assert (packed.scores(a) == a @ c.T).all() and (packed.fields > 1 or largest > 1 << 10)
    huge = hardneg.whole_numbers(np.array([[1e15, -3.5], [2.0, 1e14]]), 256.0)
    got = hardneg.Packed(huge, int(huge.min()), int(huge.max())).scores(huge)
    assert huge.dtype == object and got[0, 1] == huge[0, 0] * huge[1, 0] + huge[0, 1] * huge[1, 1]


def _brute_negatives(rows, anchors, positives=5, negatives=5):
    whole = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows]
    out = []
    for a in sorted({r[0] for r in rows if r[0] in anchors}):
        _, label, v = min((r for r in whole if r[0] == a), key=lambda r: (r[1], r[2]))
        scored = [(-sum(p * q for p, q in zip(v, w)), i, lab) for i, lab, w in whole if i != a and len(w) == len(v)]
        for s, i, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fits = sorted(x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)[:negatives]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fits)]
    return sorted(out)


def test_hard_negatives_in_small_tiles_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(3)), [float(x) for x in rng.normal(size=4) + 0.5]) for i in range(120)]
    rows += [(200 + i, i % 3, [0.9, 0.9, 0.9, 0.9]) for i in range(60)]  # one vector of a third of the rows
    rows += [(7, 1, rows[7][2]), (300, 0, [1.0, 2.0]), (301, 0, [1.5, 2.0]), (302, 1, [1.2, 2.0])]
    odd = [(400, None, [1.0] * 4), (401, 1, None), (402, 1, [1.0, None, 1.0, 1.0]), (403, 1, [float("nan")] * 4), (404, 1, [float("inf")] * 4), (405, 1, []), (None, 1, [1.0] * 4)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], VECTORS)
    anchors = {i for i, *_ in rows if i % 5 == 0}
    got = sorted(map(tuple, hardneg.hard_negatives(df, F.col("vec_id") % 5 == 0, anchor_block=7, block=11).collect()))
    assert got == _brute_negatives(rows, anchors) and len(got) > 100
    assert hardneg.hard_negatives(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    big = spark.createDataFrame([(0, 0, [3e6, 1.0], "x"), (1, 0, [2e7, 1.0], "x"), (2, 1, [2e7, 0.5], "x")], VECTORS)
    assert hardneg.hard_negatives(big, F.col("vec_id") == 0).first().negative_score == 256 * 256 * 3 * 10**6 * 2 * 10**7 + 256 * 128
    with pytest.raises(Exception, match="too large"):
        hardneg.hard_negatives(big.withColumn("embedding", F.array(F.lit(1e9), F.lit(1.0))), F.col("vec_id") == 0).count()


def _brute_clusters(rows, k, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])) + [r for r in kept if r[0] is None]
    centers = [r[1] for r in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        given = [near(v)[1] for _, v in kept]
        centers = [[sum(col) // len(col) for col in zip(*[v for (_, v), g in zip(kept, given) if g == n])] or c for n, c in enumerate(centers)]
    final = [near(v) for _, v in kept]
    inside = Counter()
    for d, n in final:
        inside[n] += d
    return sorted(((i, n, d, inside[n], sum(inside.values()), sha256(",".join(map(str, centers[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, final)), key=repr)


def test_centroids_match_plain_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(200)] + [(5, [0.1, 0.2, 0.3, 0.4]), (None, [9.0, 9.0, 9.0, 9.0])] + [(900 + i, [1.0, -1.0, 0.5, 0.0]) for i in range(100)]
    odd = [(400, None), (401, [1.0, None, 1.0, 1.0]), (402, [float("nan")] * 4), (403, [float("inf")] * 4), (404, [1.0] * 5), (405, [])]
    df = spark.createDataFrame([(i, 0, v, "x") for i, v in rows + odd], VECTORS)
    for k, rounds in ((8, 10), (3, 0), (2, 1)):
        got = sorted(map(tuple, centroids.cluster(df, k, rounds, dims=4).collect()), key=repr)
        assert got == _brute_clusters(rows + odd, k, rounds)
    few = spark.createDataFrame([(1, 0, [0.0] * 4, "x"), (2, 0, [0.0] * 4, "x")], VECTORS)
    assert {r.cluster for r in centroids.cluster(few, dims=4).collect()} == {0}  # equal centroids: the smaller number
    assert centroids.cluster(df.limit(0), dims=4).count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, 0, [1e12] * 4, "x")], VECTORS), dims=4).count()


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute_base(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_quality_counts_are_those_of_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality.assess(docs).collect()
    assert len(got) == len(texts)
    assert all(tuple(r[1:7]) == _brute_base(texts[r.doc_id]) for r in got)
    assert all(not (r.kept and r.base_failed) for r in got)


def test_quality_verdict_keeps_prose_and_drops_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = quality.assess(docs).where("not base_failed").join(marks, "doc_id").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert sum(not r.kept for r in good) <= 0.005 * len(good) and len(good) > 3000
    assert sum(not r.kept for r in bad) >= 0.85 * len(bad) and len(bad) > 250


def test_distances_are_jensen_shannon(spark):
    a, b = [3, 0, 5, 2], [1, 4, 4, 1]
    p, q = np.array(a) / sum(a), np.array(b) / sum(b)
    m = (p + q) / 2
    want = sum((x * np.log2(x / y) if x else 0) for x, y in [*zip(p, m), *zip(q, m)]) / 2
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    assert abs(df.select(quality.js_divergence(F.col("a"), F.col("b"), F.lit(10), F.lit(10))).first()[0] - want) < 1e-12
    assert df.select(quality.js_divergence(F.col("a"), F.col("b"), F.lit(0), F.lit(10))).first()[0] is None


def test_quality_of_odd_rows(spark):
    block = "one two three four five six seven eight nine"
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "word " * 30_000, "en"), (5, f"{block}\n{block}\n \n\n{block} ten", None), (None, "a b", ""), (None, "a b", "xx"), (6, "ÄÖ é ß 12 ﬁ #<>| 漢字 😀", "de"), (7, "a b c d e f g h " * 2 + "x" * 3, "en")]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, lang string, word string, row int")
    got = quality.assess(df).collect()
    assert sorted([tuple(r[:7]) for r in got], key=repr) == sorted([(i, *_brute_base(t)) for i, t, _ in rows], key=repr)
    assert not any(r.kept for r in got)
    assert quality.assess(df.limit(0)).count() == 0
    assert quality.assess(df.withColumn("lang", F.lit(None).cast("string"))).count() == len(rows)


def _words_distances(rows):
    """What words_distance must be: common words chosen and counted over all documents of a language."""
    out = {}
    for lang in {lang for *_, lang in rows}:
        texts = {i: Counter(WORD.findall((t or "").lower())) for i, t, g in rows if g == lang}
        weight = {i: min(sum(c.values()), 200) for i, c in texts.items()}
        held, every = Counter(), Counter()
        for i, c in texts.items():
            held.update(dict.fromkeys(c, weight[i]))
            every.update(c)
        total = sum(weight.values())
        bins = sorted((w for w in held if 2 * held[w] > total), key=lambda w: (-held[w], w))[:32]
        histogram = lambda c: np.array([*(c[w] for w in bins), sum(c.values()) - sum(c[w] for w in bins)], float)
        q = histogram(every)
        q /= q.sum()
        for i, c in texts.items():
            n = sum(c.values())
            if not n:
                continue
            p = histogram(c) / n
            kl = lambda x, m: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
            js = (kl(p, (p + q) / 2) + kl(q, (p + q) / 2)) / 2
            out[i] = math.sqrt(max(max(js, 0.0) - len(bins) / (8 * n * math.log(2)), 0.0))
    return out


def test_common_words_are_chosen_over_all_documents(spark):
    rng = np.random.default_rng(5)
    rows, often = [], np.linspace(0.42, 0.66, 60)

    def text(share, filler):
        words = [f"w{k}" for k in np.flatnonzero(rng.random(60) < share)] + [f"f{rng.integers(10**9)}" for _ in range(filler)]
        return " ".join(words[k] for k in rng.permutation(len(words)))

    # About half of the documents hold each word: of 1,500 long ones; of short ones only; of a few long ones among many short ones.
    rows += [(i, text(often, 220), "de") for i in range(1500)]
    rows += [(2000 + i, text(often, 40), "en") for i in range(200)]
    rows += [(3000 + i, text(often / 20, 7), "fr") for i in range(300)] + [(4000 + i, text(often + 0.3, 250), "fr") for i in range(40)]
    long = "x" * 5000
    rows += [(5000 + i, f"{long} AÄ {i} {text(often, 30)}", "es") for i in range(20)] + [(6000, None, "es"), (6001, "", "de"), (6002, " \n", "en"), (6003, "odd " * 9000, "en"), (6004, "none", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    want = _words_distances(rows)
    got = {r.doc_id: r.words_distance for r in quality.assess(df).collect()}
    assert len(got) == len(rows) and len(want) == len(rows) - 3  # three texts without a word
    assert all(got[i] is not None and abs(got[i] - want[i]) < 1e-9 for i in want)
