"""Mixing, embeddings, nearest neighbours, archives, and the pipeline: against brute force, and odd rows."""

import hashlib
import math
import os

import numpy as np
import pytest
from compare import difference, duck
from pyspark.sql import functions as F

from roadloom.llm import ann, lattice, mixing, packing, warc
from roadloom.llm.common import scratch, stored
from roadloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert difference(QUERIES[name], ORACLES[name], spark, SF, duck(SF)) == ""


# mixing


def fair(sizes):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixture(spark):
    rows = [(i, f"s{i % 7}" if i % 11 else None, " ".join("w" * (1 + i % 5) for _ in range(i % 60))) for i in range(1500)] + [(5000 + i, "tiny", "a b c") for i in range(5)] + [(6000, "none", None), (None, "s1", "x y"), (7, "s0", "same"), (7, "s0", "same")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("target", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = mixing.mix_documents(docs, labels, rows_per_bucket=50).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[1] for r in rows}
    sizes, taken, largest, target = {}, {}, {}, {}
    for i, s, t in rows:
        n = len((t or "").split())
        sizes[s] = sizes.get(s, 0) + n
        largest[s] = max(largest.get(s, 0), n)
    for r in got:
        s = source[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert r.source_size == sizes[s] and r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    want = fair(sizes)
    assert all(math.isclose(target[s], want[s], abs_tol=1e-6) for s in sizes)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(mixing.mix_documents(docs, labels, rows_per_bucket=50).collect(), key=key)
    assert mixing.mix_documents(docs.limit(0), labels).count() == 0


def test_mixed_rows_are_what_the_mix_takes(spark, monkeypatch):
    rows = [(i, f"s{i % 5}" if i % 7 else None, " ".join("w" * (i % 40))) for i in range(300)] + [(None, "s1", "a b c"), (7, "s0", "same words"), (7, "s0", "same words"), (900, "s2", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    names = ("target", "taken", "_key", "_row", "row", "_copy", "times", "same", "offset", "_source", "quality")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1)).cast("string")) for c in names})
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    want = {}
    for r in mixing.mix_documents(docs, labels, rows_per_bucket=20).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + (r.taken // r.size if r.size else 0)
    for most in (mixing.MOST_BROADCAST, 0):
        monkeypatch.setattr(mixing, "MOST_BROADCAST", most)
        got = {}
        for r in mixing.mixed_rows(docs, labels, rows_per_bucket=20).collect():
            got[r.doc_id] = got.get(r.doc_id, 0) + 1
            assert all(r[c] == f"{c}{-1 if r.doc_id is None else r.doc_id}" for c in names)
        assert got == {k: n for k, n in want.items() if n}
    assert mixing.mixed_rows(docs.limit(0), labels).count() == 0


def test_pieces_keep_columns_of_any_name(spark):
    rows = [(i, 0, 1 + i % 9, "g", "r", -5, -6) for i in range(80)]
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long, _group string, _rank string, offset long, sequence_id long")
    got = packing.pack(pieces, 10).collect()
    assert {(r.doc_id, r._group, r._rank) for r in got} == {(i, "g", "r") for i in range(80)}
    ends = {}
    for r in got:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert min(ends) == 0 and all([a for a, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 10 for x in ends.values())


# embeddings


def vectors(spark, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(300, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for k in range(60):  # a crowd around one vector, and pairs at chosen cosines
        rows.append((1000 + k, (base[0] + rng.normal(size=64) * 0.02).tolist()))
    for k in range(100):
        unit = base[k + 1] / np.linalg.norm(base[k + 1])
        other = rng.normal(size=64)
        other -= other @ unit * unit
        c = 0.93 + 0.07 * k / 100
        rows.append((2000 + k, (c * unit + math.sqrt(1 - c * c) * other / np.linalg.norm(other)).tolist()))
    rows += [(3000 + k, base[5].tolist()) for k in range(20)] + [(4000, (base[5] * 7).tolist())]
    odd = [(5000, None), (5001, [0.0] * 64), (5002, [float("nan")] * 64), (5003, [None] * 64), (5004, [float("inf")] + [1.0] * 63), (5005, []), (5006, [1.0, 2.0]), (5007, [2.0, 4.0])]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"n": F.lit(1), "x": F.lit(2)}), dict(rows), dict(odd)


def test_embedding_links(spark):
    df, rows, odd = vectors(spark)
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    for block in (1024, 16):
        got = {r.vec_id: r for r in lattice.embedding_links(df, cell_block=block).collect()}
        found = sum(got[i].n_links for i in ids)
        assert link.sum() * 0.99 <= found <= link.sum()
        assert all(got[i].n_links <= n for i, n in zip(ids, link.sum(axis=1)))
        assert got[1000].component_id == 0 and got[3010].component_id == 5 and not got[4000].kept and got[0].n_links == 60
        assert all(got[i].n_links == 0 and got[i].kept for i in range(5000, 5006)) and got[5007].component_id == 5006
    assert lattice.embedding_links(df.limit(0)).count() == 0


def test_e8_decoding():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(200, 8)) * 2
    z = lattice.nearest_e8(y)
    assert np.all(((z * 2) % 1 == 0)) and lattice.roots().shape == (240, 8)
    near = z[:, None, :] + lattice.roots()[None]
    assert np.all(((y - z) ** 2).sum(1) <= ((y[:, None, :] - near) ** 2).sum(2).min(1) + 1e-9)


def cosine(a, b):
    a, b = (np.asarray(x, float) / np.abs(x).max() for x in (a, b))
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


def test_nearest_neighbours_are_exact(spark):
    df, rows, odd = vectors(spark, 2)
    rng = np.random.default_rng(8)
    tiny = {**{6000 + i: (v * 1e-200).tolist() for i, v in enumerate(rng.normal(size=(8, 64)))}, **{6100 + i: (v * 1e200).tolist() for i, v in enumerate(rng.normal(size=(8, 64)))}, 6200: [5e-324] * 64, 6201: [1.7e308] * 64}
    wide = {7000 + i: v.tolist() for i, v in enumerate(rng.normal(size=(20, 2000)))}
    df = df.select("vec_id", "embedding").unionByName(spark.createDataFrame([*tiny.items(), *wide.items(), (7050, wide[7003])], "vec_id long, embedding array<double>"))
    usable = {**rows, 5006: odd[5006], 5007: odd[5007], **tiny, **wide, 7050: wide[7003]}
    for sizes in ({"query_block": 7, "block": 64, "step": 16}, {}):
        got = {}
        for r in ann.nearest(df, F.col("vec_id") % 50 == 0, 5, **sizes).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        for q in (i for i in usable if i % 50 == 0):
            score = {i: cosine(usable[q], v) for i, v in usable.items() if i != q and len(v) == len(usable[q])}
            mine = sorted(got[q])
            assert [m[0] for m in mine] == list(range(1, min(5, len(score)) + 1))
            assert np.allclose([m[2] for m in mine], sorted(score.values(), reverse=True)[: len(mine)], atol=1e-13)
            assert all(abs(score[i] - x) < 1e-13 for _, i, x in mine) and len({i for _, i, _ in mine}) == len(mine)
            assert [i for _, i, _ in mine] == [i for _, i in sorted((-x, i) for _, i, x in mine)]
            # Ties in doubles go to the smaller id: a candidate left out is no nearer than the last, and if as near, larger.
            last = mine[-1]
            assert all(x < last[2] + 1e-13 and (usable[i] != usable[last[1]] or i > last[1]) for i, x in score.items() if i not in {m[1] for m in mine})
        assert set(got) == {i for i in usable if i % 50 == 0}
    assert ann.search_embeddings(df.limit(0)).count() == 0


def test_equal_vectors_and_repeated_ids(spark):
    """Against brute force over rows, where each row is a candidate and a query's id leaves out all rows of it."""
    rng = np.random.default_rng(15)
    same, other = rng.normal(size=8).tolist(), rng.normal(size=8).tolist()
    rows = [(i, same) for i in range(40, 160)] + [(50, same)] * 9 + [(41, same)] * 4 + [(i, other) for i in range(300, 310)] + [(301, other)] * 7 + [(400 + i, rng.normal(size=8).tolist()) for i in range(30)] + [(300, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search_embeddings(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = {i: min(v for j, v in rows if j == i) for i, _ in rows if i % 50 == 0}
    assert set(got) == set(queries)
    for q, v in queries.items():
        want = sorted((-round(cosine(v, x), 12), i) for i, x in rows if i != q)[:5]
        assert [(-round(s, 12), i) for _, i, s in sorted(got[q])] == want


def test_tile_bounds_hold_in_any_dimension():
    rng = np.random.default_rng(4)
    for d in (1, 3, 64, 1024, 5000):
        x, y = rng.normal(size=(20, d)), rng.normal(size=(30, d)) ** 3
        near, error = ann.bounds(ann.Quantised.of(x), ann.Quantised.of(y))
        exact = np.array([[cosine(a, b) for b in y] for a in x])
        assert (np.abs(near - exact) <= error + 1e-12).all() and error.max() < 0.2


def test_links_of_any_finite_size(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(6, 32))
    rows = [(i, (v * 10.0 ** (60 * (i - 3))).tolist()) for i, v in enumerate(base)] + [(10 + i, (v * 10.0 ** (-60 * (i - 3))).tolist()) for i, v in enumerate(base)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{i: (1, i) for i in range(6)}, **{10 + i: (1, i) for i in range(6)}}


# archives


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ENTRIES", 7)
    monkeypatch.setattr(warc, "PART_ENTRIES", 60)
    big = "<p>" + "same" * 40
    rows = [(i, f"http://www.h{i % 9}.example.com/p{i}?q=1#x", f"page {i} " * (i % 30)) for i in range(200)] + [(500, "u", big), (400, None, big), (450, "http://a b\r\nc", big), (600, "", "short"), (601, "", "short"), (700, None, None), (None, "x", big), (1, "http://dup", "again"), (1, "http://dup", "again"), (800, "http://[bad", "é𝄞")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    got = sorted((tuple(r) for r in warc.archive_pages(df).collect()), key=str)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = html == big and i != 400
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 400 if again else None))
    assert got == sorted(want, key=str)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_archives_with_more_repeated_payloads_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "MOST_BROADCAST", 3)
    rows = [(i, f"u{i}", f"payload {i % (40 if i > 150 else 7)} " * 20) for i in range(300)] + [(301, "v", "x" * 200), (None, "u", "payload 0 " * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in warc.archive_pages(df).collect()), key=str)
    first = {}
    for i, _, h in rows:
        first[h] = min(first.get(h, 1 << 60), 1 << 60 if i is None else i)
    want = [(i, len(h), hashlib.sha256(h.encode()).hexdigest(), "response" if i == first[h] else "revisit", None if i == first[h] else first[h]) for i, _, h in rows]
    assert got == sorted(want, key=str)


def test_look_up_reads_ranges_of_few_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").repartition(4)
    root = scratch(spark, "warc-test")
    warc.write_archives(pages, f"{root}/a")
    warc.write_index(spark, f"{root}/a", f"{root}/i")
    one = pages.where("page_id % 97 = 5").limit(3)
    one = spark.createDataFrame(one.collect(), pages.schema)
    found = warc.look_up(warc.keys_of(one).unionByName(spark.createDataFrame([("no such key",)], "key string")), f"{root}/i")
    folder = root.removeprefix("file:") + "/a"
    used, all_ = {r.archive for r in found.collect()}, [f for f in os.listdir(folder) if f.startswith("part")]
    assert len(used) <= 3 < 10 < len(all_)
    for f in all_:
        if f not in used:
            os.remove(f"{folder}/{f}")  # the others aren't opened
    assert {r.page_id for r in warc.read_ranges(spark, f"{root}/a", found).collect()} == {r.page_id for r in one.collect()}
    assert warc.surt("https://www.Example.com:8080/a?b") == "com,example,www:8080)/a?b"


def test_archives_in_a_store_that_only_spark_reads(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted(map(tuple, warc.archive_pages(pages).collect()))
    assert not warc._opens("viewfs://store/x") and not warc._opens("/no/such/folder")
    monkeypatch.setattr(warc, "_opens", lambda path: False)
    assert sorted(map(tuple, warc.archive_pages(pages).collect())) == want


def test_records_are_told_apart(spark):
    root = scratch(spark, "warc-test")
    rows = [(1, "http://a", "same " * 40), (1, "http://a", "same " * 40), (2, "http://b", "same " * 40)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"{root}/a", "2020-01-02T03:04:05Z")
    content = warc.archives(spark, f"{root}/a").first().content
    text = [data.decode() for _, _, data in warc.members(content)]
    assert len({t.split("WARC-Record-ID: ")[1].split()[0] for t in text}) == 3
    assert "WARC-Refers-To-Target-URI: http://a" in text[2] and "WARC-Date: 2020-01-02T03:04:05Z" in text[0] and "same" not in text[2]


# the whole


def test_pipeline(spark):
    """Stage by stage as run() does it; what run() itself returns is tested on odd rows below."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = {"": docs}
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        seen = after[name] = stored(stage(spark, seen, SF), name)
        assert name == "packing" or seen.columns == list(corpus_pipeline.COLUMNS), name
    assert after["language"].count() == docs.count()
    once = after["near_duplicates"]
    assert once.select("text").distinct().count() == once.count() <= docs.select("text").distinct().count()
    assert after["secrets"].count() == once.count()
    assert {r.doc_id for r in seen.select("doc_id").distinct().collect()} == {r.doc_id for r in after["mixture"].select("doc_id").distinct().collect()}


def test_pipeline_on_odd_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, "12 345", "en", None, 6), (4, "é" * 30_000 + " mot", "fr", "b", 30_004), (4, "é" * 30_000 + " mot", "fr", "b", 30_004), (None, "some words here", "en", "b", 15), (5, "The same words of a text.", None, "b", 25), (6, "the SAME words\tof a text.", "en", "c", 25), (7, "token=abcdefgh then", "en", "c", 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    model_of = corpus_pipeline.identified_language(spark, docs, sf)
    kept = corpus_pipeline.one_of_near_duplicates(spark, model_of, sf)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 4, 5, 7]
    clean = corpus_pipeline.without_secrets(spark, kept, sf)
    assert {r.text for r in clean.where("doc_id = 7").collect()} == {"[SECRET] then"}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} <= {None, 4, 5, 7}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
