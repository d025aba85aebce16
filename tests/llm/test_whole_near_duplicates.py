"""Near-duplicates are the components of all pairs of exact similarity 0.8, in crowded buckets too."""

import random

from pyspark.sql import functions as F

from roadloom.llm import shingles, simhash


def groups(sets, similarity=0.8):
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= similarity * len(a | sets[j]) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def crowded():
    """Texts that share 150 words of boilerplate, with 20 to 60 words of their own; a third of them are edited copies."""
    rng = random.Random(11)
    shared = [f"s{i}" for i in range(150)]
    own = [[f"o{i}x{k}" for k in range(rng.randrange(20, 60))] for i in range(60)]
    texts = [" ".join(shared + o) for o in own]
    for o in own[:30]:
        more = list(o)
        for k in range(rng.randrange(1, 5)):
            more[rng.randrange(len(more))] = f"e{rng.randrange(10**9)}"
        texts.append(" ".join(shared[: 150 - rng.randrange(12)] + more + [f"t{rng.randrange(10**9)}" for _ in range(rng.randrange(9))]))
    rng.shuffle(texts)
    return texts


def test_crowded_buckets_lose_no_pairs(spark):
    texts = crowded()
    sets = [{*simhash.shingle_hashes(t, 5)} for t in texts]
    want = {i for i, r in enumerate(groups(sets)) if i == r}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == want and 40 < len(want) < 90


def test_blocks_and_leaders_change_nothing(spark):
    texts = crowded()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, text string").withColumn("row", F.col("key"))
    rows = shingles.with_sets(df, shingles.common_shingles(df, 5), 0.8, 5)
    ids = {r.node: r.key for r in rows.collect()}
    verified = lambda pairs: shingles.similar_pairs(pairs, rows, df, 0.8, 5)
    root = groups([{*simhash.shingle_hashes(t, 5)} for t in texts])
    want = {frozenset(i for i, r in enumerate(root) if r == x) for x in root}
    for block, rounds in ((256, 0), (3, 0), (5, 3)):
        got = {}
        for r in shingles.similar_components(rows, rows.unionByName(rows), verified, 0.8, None, block, rounds).collect():
            got.setdefault(r.component, set()).add(ids[r.node])
        assert {frozenset(g) for g in got.values()} == {w for w in want if len(w) > 1}


def test_the_given_documents_against_exact_similarity(spark):
    """All pairs of texts of sf0.01 that share a shingle, by exact sets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    order = sorted(texts)
    root = groups([{*simhash.shingle_hashes(texts[i], 5)} for i in order])
    want = {order[i] for i, r in enumerate(root) if r == i}
    got = simhash.drop_near_duplicates(docs).collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want) < len(order)


def test_repeated_lines_link_nothing(spark):
    line = " ".join(f"r{i}" for i in range(17))
    texts = [" ".join([line] * 50 + [f"{x}{i}" for i in range(60)]) for x in "abc"]
    texts.append(" ".join([line] * 9 + [f"a{i}" for i in range(60)]))
    words = [f"w{i}" for i in range(204)]
    texts += [" ".join(words), " ".join(words[:100] + ["x"] + words[101:]), " ".join(f"y{i}" if i % 40 == 20 else w for i, w in enumerate(words))]
    sets = [{*simhash.shingle_hashes(t, 5)} for t in texts]
    assert 0.75 < len(sets[4] & sets[6]) / len(sets[4] | sets[6]) < 0.8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == {0, 1, 2, 4, 6}
