"""Language, packing, chat, SimHash, secrets, toxicity: against brute force or exact round trips, and odd rows."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from roadloom.llm import chat, common, langid, packing, secrets, simhash, toxicity
from roadloom.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "12 345", "en", None, 6), (5, "é" * 30_000 + " word", "fr", "b", 30_005), (5, "é" * 30_000 + " word", "fr", "b", 30_005), (None, "some words here", "en", "b", 15), (6, "the same words of the same text", "en", "b", 31), (7, "THE same\twords of the same text", "en", "c", 31)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).withColumns({"_key": F.lit(1), "score": F.lit("x"), "value": F.lit(2)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# chat


def digests(rows):
    conv = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        conv.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    return {c: (len(ts), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ts).encode()).hexdigest(), sum(len(b) for a, b in ts if a == "assistant"), hashlib.sha256("".join(b for a, b in ts if a == "assistant").encode()).hexdigest()) for c, ts in conv.items()}


def test_chat_reads_back(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    want = digests(turns.unionByName(chat.planted(spark)).collect())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.format_documents(turns).collect()}
    assert got == want and -7 in got


def test_chat_grammar_holds_for_anything():
    rng = random.Random(1)
    bits = ["###", "</turn>", "\\", "\n", " ", "### User: ", "#", "</tu", "rn>", "x", '"', ": ", "é"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "", "odd # role\n", '"']), "".join(rng.choices(bits, k=rng.randrange(8)))) for _ in range(3)]
        assert [(a, b) for a, b, _ in chat.parse("".join(chat.render_turn(*t) for t in turns))] == turns
    with pytest.raises(ValueError):
        list(chat.parse("### User: a ### b\n</turn>\n"))


def test_chat_odd_rows(spark):
    rows = [(None, 0, None, None), (1, None, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    got = {r.conv_id: r.n_turns for r in chat.format_documents(df).collect()}
    assert got == {None: 1, 1: 3, -7: 2}
    assert chat.format_documents(df.limit(0)).count() == 1


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(pairs):
    root = {k: k for k, _ in pairs}
    changed = True
    ids = [i for i, _ in pairs]
    fp = dict(pairs)
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fp[a] ^ fp[b]).bit_count() <= 2 and root[a] < root[b]:
                    root[b], changed = root[a], True
    return root


def test_simhash_against_brute_force(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in simhash.simhash_documents(docs).collect()}
    want = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{v:016x}" for k, v in want}
    assert {k: r.component_id for k, r in got.items()} == brute_components(want)


def test_variants_find_all_pairs_of_two_bits(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    near = {x for b in base for x in [b, *(b ^ (1 << i) ^ (1 << j) for i, j in [rng.sample(range(64), 2) for _ in range(15)]), *(b ^ (1 << rng.randrange(64)) for _ in range(5))]}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in near], "fp long")
    got = {tuple(r) for r in simhash.linked_fingerprints(df).collect()}
    all_ = sorted(map(signed, near))
    want = {(a, b) for i, a in enumerate(all_) for b in all_[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want and len(want) > 400
    with pytest.raises(ValueError):
        simhash.linked_fingerprints(df, 3)


def test_variants_are_never_broadcast(spark):
    df = common.stored(spark.createDataFrame([(k,) for k in range(1, 50)], "fp long"), "fps")
    assert "Broadcast" not in simhash.linked_fingerprints(df)._jdf.queryExecution().executedPlan().toString()


def test_simhash_odd_rows(spark, odd, empty):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_documents(odd).collect()]
    assert len(got) == len(ODD) and {c for d, f, c in got if f == "0" * 16} == {1}
    assert {d: c for d, _, c in got if d in (6, 7)} == {6: 6, 7: 6}
    assert simhash.simhash_documents(empty).count() == 0
    kept = sorted((r.doc_id or -1) for r in simhash.drop_near_duplicates(odd).collect())
    assert kept == [-1, 1, 4, 5, 6]
    assert simhash.drop_near_duplicates(odd).columns == odd.columns and simhash.drop_near_duplicates(empty).count() == 0


def test_near_duplicates_keep_columns_of_any_name(spark):
    rows = [(i, f"words of text {i} that no other text here has at all", f"k{i}", i * 10, "n") for i in range(5)] + [(9, "words of text 3 that no other text here has at all", "k9", 90, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, `Row` long, digest string")
    assert sorted(map(tuple, simhash.drop_near_duplicates(df).collect())) == rows[:5]
    again = df.unionByName(df)
    assert sorted(map(tuple, simhash.drop_near_duplicates(again).collect())) == rows[:5]


def jaccard(a, b, width=5):
    a, b = ({*simhash.shingle_hashes(t, width)} for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"edit{rng.randrange(10**9)}"
    return out


def near_copies():
    """Sixty pairs of texts with a few words changed, one group of 150 copies of a text, and unrelated texts."""
    rng = random.Random(7)
    make = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for i in range(60):
        base = make(200)
        texts += [" ".join(base), " ".join(edited(rng, base, 1 + i % 6))]
    hot = make(300)
    texts += [" ".join(hot)] + [" ".join(edited(rng, hot, 3)) for _ in range(150)]
    return texts + [" ".join(make(rng.randrange(1, 300))) for _ in range(150)]


def test_near_duplicates_beyond_the_broadcast(spark, monkeypatch):
    texts = near_copies()[100:200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, simhash.drop_near_duplicates(df.unionByName(df)).collect()))
    monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, simhash.drop_near_duplicates(df.unionByName(df)).collect())) == want


def test_near_duplicates_against_exact_similarity(spark):
    texts = near_copies()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    near = [(i, jaccard(texts[i], texts[i + 1])) for i in range(0, 120, 2)]
    assert kept >= set(range(0, 120, 2)) and 120 in kept and kept >= set(range(271, len(texts)))
    alike = [i for i, j in near if j >= 0.8]
    assert len(alike) > 30 and sum(i + 1 not in kept for i in alike) >= 0.9 * len(alike)
    assert all(i + 1 in kept for i, j in near if j < 0.7)
    assert not kept & set(range(121, 271))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (300, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), **dict.fromkeys((100, 200, 300), 100)}


def test_components_with_hubs(spark):
    rng = random.Random(14)
    edges = [(5000, i) for i in range(1000, 1600)] + [(1, i) for i in range(2000, 2500)] + [(2001, 1001)] + [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(150)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


# language


def longest_phrases(text, training):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in training:
            j += 1
        i, n = max(j - 1, i + 1), n + 1
    return n


def test_automaton_parses_as_greedy_matching():
    rng = random.Random(3)
    for letters in (4, 400):
        train = [rng.randrange(1, letters) for _ in range(400)]
        automaton = langid.suffix_automaton(train, letters + 1)
        text = [rng.choice([rng.randrange(1, letters + 1), *train[i % 390 : i % 390 + 1]]) for i in range(300)]
        state, ends = np.zeros(1, np.int32), 0
        for c in text:
            got = automaton.step(state, np.array([c]))
            state, ends = got >> 1, ends + int(got[0] & 1)
        as_text = lambda x: "".join(map(chr, x))
        assert (automaton.table is None) == (letters == 400)
        assert ends + 1 == longest_phrases(as_text(text), as_text(train))


def test_predictions_against_plain_parsing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sample = langid.labelled_sample(docs, "text", "lang", "doc_id", 5, 2_000, 9)
    model = langid.LanguageModel.train(sample, 2_000)
    plain = lambda t: re.sub(r"[\W\d_]+", " ", " " + (t or "").lower())
    train = {k: "".join(plain(t) for t in langid.middles(ts, 2_000)) for k, ts in sample.items()}
    assert all(len(t) <= 2_100 for t in train.values()) and len(train) == 4
    rows = [r for r in docs.collect() if r.text and len(r.text) < 3_000][:25]
    langs, scores = model.predict([r.text for r in rows])
    for r, lang, score in zip(rows, langs, scores):
        t = plain(r.text)
        cost = {k: sum(longest_phrases(t[i : i + model.block], x) for i in range(0, len(t), model.block)) * math.log2(len(x) + 1) / len(t) for k, x in train.items()}
        best, second = sorted(cost.values())[:2]
        assert cost[lang] == pytest.approx(best) and score == pytest.approx(second / (best + second))


def test_scripts_of_many_letters_are_told_apart():
    rng = random.Random(8)
    scripts = {"a": range(0x4E00, 0x4F00), "b": range(0x5000, 0x5100), "c": range(0x61, 0x7B), "d": range(0x430, 0x450)}
    make = lambda s, n: "".join(chr(rng.choice(scripts[s])) for _ in range(n))
    model = langid.LanguageModel.train({s: [make(s, 3000)] for s in scripts}, 4000)
    assert model.predict([make(s, 200) for s in scripts])[0] == list(scripts)


def test_training_text_is_shared_among_documents():
    assert [len(t) for t in langid.middles(["x" * 10, "y" * 1000, "z" * 500], 310)] == [10, 150, 150]
    assert langid.middles(["abc", "d"], 100) == ["abc", "d"] and langid.middles([], 5) == [] and langid.middles(["aabcc"], 1) == ["b"]


def test_language_held_out_accuracy_and_odd_rows(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    got = langid.predict_documents(odd).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 4)} == {"und"}
    assert langid.predict_documents(empty).count() == 0
    through = langid.identify(odd, langid.train(docs)).columns
    assert through[-2:] == ["lang_pred", "score"] and "_key" in through


# packing


def test_ids_are_the_tokenizers(spark):
    own = packing.encoder(*packing.tokenizer_paths())
    texts = [r.text for r in documents(spark).collect()] + [None, "", " ", "a  b", " a\n b\n\n c \t d ", "x  y", "<|endoftext|> a", "it's  1 2\n", "\n", " a", "a "]
    ids, first = own.batch(packing.pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == own.slow.encode(t or "", add_special_tokens=False).ids


def test_fill_is_the_best_sum():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(1, 90)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
        got = packing.fill(room, counts)
        assert sum(k * n for k, n in got.items()) == max(sums) and all(n <= counts[k] for k, n in got.items())


def check_packing(rows, docs, window=2048):
    own = packing.encoder(*packing.tokenizer_paths())
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for places in by_sequence.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= window
    for doc_id, text in docs:
        ids = own.slow.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    return sum(r.length for r in rows) / (window * len(by_sequence))


def test_packing(spark, odd, empty):
    docs = documents(spark)
    assert check_packing(packing.pack_documents(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()]) > 0.98
    distinct = odd.dropDuplicates(["doc_id"])
    check_packing(packing.pack_documents(distinct).collect(), [(r.doc_id, r.text) for r in distinct.collect()])
    assert packing.pack_documents(odd).select("sequence_id", "offset").distinct().count() == packing.pack_documents(odd).count()
    assert packing.pack_documents(empty).count() == 0


# secrets


def plain_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secret_spans_against_plain_search(spark, odd, empty):
    rng = random.Random(5)
    key = lambda n, a: "".join(rng.choices(a, k=n))
    tricky = ["token=token:abcdefg", "é𝄞 PassWord : 'abc.def' AKIAAKIA" + "A1" * 10, "secret=ab secret=abcdef", "0" * 24 + "g" + "f" * 23, "api_key=" + "x" * 9 + "\napikey:'12345'", "AKIA" + "B" * 15 + " AKIA" + "B" * 16]
    tricky += [f"see {key(40, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789')} here" for _ in range(30)] + ["run aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 end"]
    docs = documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(tricky, 1_000_000)), "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in secrets.scan_documents(docs).collect()}
    for i, r in got.items():
        want = plain_spans(texts[i] or "")
        base = ",".join(s for s in r.spans.split(",") if not s.startswith("random"))
        assert base == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k + ":") for k in secrets.KINDS[:3])
    assert sum(got[i].n_random == 1 for i in range(1_000_006, 1_000_036)) >= 27
    assert got[1_000_036].n_random == 0
    assert {r.spans for r in secrets.scan_documents(odd).collect()} == {""} and secrets.scan_documents(empty).count() == 0


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def plain_battery(text):
    """(encoding, band, p under uniform symbols, p under ordinary text) of a candidate, in plain Python."""
    names = list(secrets.ENCODINGS)
    e = next(i for i, n in enumerate(names) if re.search(secrets.ENCODINGS[n][1], text))
    symbols, _, two, three, change, ends = secrets.ENCODINGS[names[e]]
    code = np.array([symbols.index(c) for c in (text if e == 2 else text.lower())], float)
    n, size = len(code), len(symbols)
    count = np.bincount(code.astype(int), minlength=size)
    chi = ((count - n / size) ** 2 / (n / size)).sum()
    df = size - 1
    uniform = tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    up = code > (size - 1) / 2
    turns, above = 1 + (up[1:] != up[:-1]).sum(), up.sum()
    mean = 2 * above * (n - above) / n
    variance = mean * (mean - 1) / (n - 1)
    runs = 2 * tail(abs(turns - mean - 1) / math.sqrt(variance)) if variance > 0 else 0.0
    x = code - (size - 1) / 2
    serial = 2 * tail(abs((x[1:] * x[:-1]).sum()) / (math.sqrt(n - 1) * (size**2 - 1) / 12))
    kind = sum((code >= b).astype(int) for b in ends)
    pairs, equal = n * (n - 1) / 2, (count * (count - 1)).sum() / 2
    fewer = (pairs * two - equal) / math.sqrt(pairs * two * (1 - two) + n * (n - 1) * (n - 2) * (three - two**2))
    more = ((kind[1:] != kind[:-1]).sum() - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change))
    return e, int(math.log2(n)), min(1.0, 3 * min(uniform, runs, serial)), tail((fewer + more) / math.sqrt(2))


def ordinary(rng):
    """Paths and identifiers made of the names in the standard library."""
    import sys

    names = sorted(n for n in sys.stdlib_module_names if len(n) > 3)
    some = [rng.choice(names).strip("_") for _ in range(rng.randrange(3, 6))]
    shape = rng.randrange(5)
    if shape == 0:
        return "/".join(some) + f"/v{rng.randrange(10)}"
    if shape == 1:
        return "".join(w.capitalize() for w in some) + str(rng.randrange(100))
    if shape == 2:
        return "_".join(some).upper() + "_2"
    if shape == 3:
        return "".join([some[0], *(w.capitalize() for w in some[1:])]) + f"_v{rng.randrange(5)}_" + some[0].capitalize()
    return "-".join(some) + f"-20{rng.randrange(10, 30)}-0{rng.randrange(1, 10)}"


def test_battery_and_cuts_against_plain_python(spark):
    rng = random.Random(9)
    alphabets = ["0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", secrets.ENCODINGS["base64"][0]]
    texts = ["".join(rng.choices(alphabets[i % 3], k=rng.randrange(20, 90))) for i in range(150)] + [ordinary(rng) for _ in range(150)] + ["a" * 40, "1" * 30, "ab" * 15]
    texts = [t for t in texts if len(t) >= 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select("doc_id", F.explode(secrets._candidates(F.col("text"))).alias("m")).select("doc_id", "m.*").collect()
    assert len(rows) == len(texts)
    groups = {}
    for r in rows:
        e, band, uniform, p = plain_battery(texts[r.doc_id])
        assert (r.encoding, r.band) == (e, band) and math.isclose(r.p, p, rel_tol=1e-3, abs_tol=2e-7) and math.isclose(r.uniform, uniform, rel_tol=1e-3, abs_tol=1e-6)
        groups.setdefault((e, band), []).append(p)
    want = []
    for g, ps in groups.items():
        bins = sorted(min(800, math.floor(-math.log10(max(p, 1e-300)) * 50)) for p in ps)
        good = [b for b in bins if 10 ** (-b / 50) <= 0.01 * sum(x >= b for x in bins) / len(bins)]
        want += [(*g, min(good))] if good else []
    got = secrets.false_discovery_cuts(df, secrets._candidates(F.col("text")))
    assert {x[:2] for x in got.bins} == {x[:2] for x in want} and all(abs(a[2] - b[2]) <= 1 for a, b in zip(got.bins, sorted(want)))


def test_keys_are_found_and_ordinary_strings_left(spark):
    rng = random.Random(10)
    keys = ["".join(rng.choices(secrets.ENCODINGS["base64"][0], k=rng.choice([32, 40, 64]))) for _ in range(200)]
    plain = [x for x in (ordinary(rng) for _ in range(3000)) if len(x) >= 20]
    for some in (keys + plain[:400], keys[:20] + plain):
        df = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(some)], "doc_id long, text string")
        got = {r.doc_id for r in secrets.scan_documents(df).where("n_random > 0").collect()}
        n = sum(t in keys for t in some)
        assert len(got & set(range(n))) >= 0.9 * n, len(got & set(range(n))) / n
        assert len(got - set(range(n))) <= 0.01 * (len(some) - n), [some[i] for i in got if i >= n]


def test_many_matches_in_a_text(spark):
    text = " ".join(f"{i:024x}" for i in range(5000)) + " x"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = secrets.scan_documents(df).first()
    want = ",".join(f"hex:{i * 25}:{i * 25 + 24}" for i in range(5000))
    assert r.n_hex == 5000 and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_redaction_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a token=abcdefgh end", ["kept"], 5), (2, None, None, None)], "doc_id long, text string, spans array<string>, _spans int")
    assert sorted(map(tuple, secrets.redacted(df).collect())) == [(1, "a [SECRET] end", ["kept"], 5), (2, None, None, None)]


def test_redaction(spark, odd):
    docs = spark.createDataFrame([(1, "a token=abcdefgh and 0123456789abcdef0123456789 end", "en", "s", 52), (2, "clean", "en", "s", 5)], DOC)
    got = {r.doc_id: r for r in secrets.redacted(docs).collect()}
    assert got[1].text == "a [SECRET] and [SECRET] end" and got[1].n_chars == len(got[1].text) and got[2].text == "clean"
    assert secrets.redacted(odd).count() == len(ODD)


# toxicity


def test_neighbours_are_exact():
    rng = np.random.default_rng(6)
    v = 30
    vocabulary = toxicity.Vocabulary(np.arange(v, dtype=np.int64))
    weight_of = rng.uniform(0.01, 3, v)
    draw = lambda: (lambda t: (np.sort(t), rng.integers(1, 5, len(t))))(rng.choice(v, rng.integers(1, 6), replace=False))
    examples = [(i, int(rng.random() < 0.5), *draw()) for i in range(500)] + [(900, 0, np.zeros(0, np.int64), np.zeros(0, np.int64))]
    model = toxicity.ToxicityModel.build(vocabulary, weight_of, examples)
    dense = np.zeros((len(examples), v))
    at = {e[0]: e for e in examples}
    for row, i in enumerate(model.ids):
        t, w = toxicity._weights(at[i][2], at[i][3], weight_of)
        dense[row, t] = w
    for _ in range(50):
        t, c = draw()
        q = np.zeros(v)
        q[t] = toxicity._weights(t, c, weight_of)[1]
        cosine = dense @ q
        where, got = model.neighbours(t, c)
        want = np.sort(cosine)[::-1][:15]
        assert np.allclose(got, want[want > 0]) and np.allclose(cosine[where], got)
        near = got**2
        assert np.isclose(model.vote(t, c)[0], (near @ model.toxic[where] + 0.5 * model.prior) / (near.sum() + 0.5))
    assert model.vote(t[:0], c[:0])[0] == model.prior and toxicity.ToxicityModel.build(vocabulary, weight_of, []).vote(t, c)[0] == 0.05


def test_words_of_texts():
    letters = toxicity.Letters()
    texts = ["The cat, the CAT!", None, "", "x" * 150 + " é9É", "12 3"]
    name, text = toxicity.words(*letters.encode(texts))
    assert text.tolist() == [0] * 4 + [3] * 5 + [3] * 3  # the last three are stems
    assert name[0] == name[2] and name[1] == name[3] != name[0] and name[4] == name[5] != name[6] and name[7] == name[8]
    assert name[9] == name[10] == name[11] != name[4]
    stems = toxicity.words(*letters.encode(["abcdef abcdeg abcde"]))[0]
    assert len(stems) == 5 and stems[3] == stems[4] != stems[2]


def test_toxicity_against_brute_force(spark):
    """Every step anew in plain Python: words, document frequencies, relevance, cosine, votes, calibration."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    label = {r.doc_id: r.toxic for r in labels.collect() if not held(r.doc_id)}
    apart = {r.doc_id for r in docs.where(F.xxhash64(F.lit("calibrates"), "doc_id") % 4 == 0).collect()}
    bags = {i: Counter(x for w in re.findall(r"[^\W\d_]+", t.lower()) for x in (w, *[w[:5] + "*"] * (len(w) > 5))) for i, t in texts.items()}
    df = Counter(w for b in bags.values() for w in b)
    inside = Counter(w for i in label for w in bags[i])
    terms = {w for w, n in inside.items() if 2 <= n <= 0.25 * len(label)}
    assert len(label) < 1_600  # all are indexed

    def model(ids):
        bad = [i for i in ids if label[i] == 1]
        in_bad, in_all, n = Counter(w for i in bad for w in bags[i]), Counter(w for i in ids for w in bags[i]), len(ids)
        weight = {}
        for w in terms:
            cells = [(in_bad[w], in_all[w] * len(bad) / n), (in_all[w] - in_bad[w], in_all[w] * (n - len(bad)) / n), (len(bad) - in_bad[w], (n - in_all[w]) * len(bad) / n), (n - len(bad) - in_all[w] + in_bad[w], (n - in_all[w]) * (n - len(bad)) / n)]
            g = max(0.0, 2 * sum(o * math.log(o / e) for o, e in cells if o))
            weight[w] = (math.log((len(texts) + 1) / (df[w] + 1)) + 1) * g / (g + 100)

        def vector(i):
            x = {w: (1 + math.log(c)) * weight[w] for w, c in bags[i].items() if w in terms}
            length = math.sqrt(sum(y * y for y in x.values()))
            return {w: y / length for w, y in x.items()} if length else {}

        index = {i: vector(i) for i in ids}
        prior = (len(bad) + 0.5) / (n + 10)

        def vote(i):
            q = vector(i)
            near = sorted(((sum(q[w] * y for w, y in x.items() if w in q), label[j]) for j, x in index.items()), key=lambda x: -x[0])[:15]
            return (sum(c * c * t for c, t in near) + 0.5 * prior) / (sum(c * c for c, _ in near) + 0.5)

        return vote

    part, whole = model([i for i in label if i not in apart]), model(list(label))
    logit = lambda p: math.log(p / (1 - p))
    check = sorted(i for i in label if i in apart)
    slope, offset = toxicity.logistic_fit(np.array([logit(part(i)) for i in check]), np.array([label[i] for i in check], float))
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    for i in sorted(texts)[::5]:
        assert abs(got[i] - 1 / (1 + math.exp(-slope * logit(whole(i)) - offset))) < 1e-6


def test_logistic_fit_is_a_maximum():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 2, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.7 * x - 0.8)))).astype(float)
    a, b = toxicity.logistic_fit(x, y)
    loss = lambda a, b: np.sum(np.logaddexp(0, a * x + b) - y * (a * x + b)) + 0.5 * (a - 1) ** 2 + 0.0005 * b * b
    assert all(loss(a, b) <= loss(a + da, b + db) for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))


def test_toxicity_held_out_and_odd_rows(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score_documents(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    bad, good = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in bad) / len(bad) > 0.9 and sum(r.predicted for r in good) / len(good) < 0.03
    for lang in {r.lang for r in bad}:
        some = [r.predicted for r in bad if r.lang == lang]
        assert sum(some) / len(some) >= 0.85, lang
    assert Counter(r.score for r in rows).most_common(1)[0][1] < 0.3 * len(rows)
    for lo, hi in ((0, 0.1), (0.1, 0.5), (0.5, 0.9), (0.9, 1.01)):  # calibrated: scores are shares of toxic documents
        some = [r for r in rows if lo <= r.score < hi]
        share, mean = (sum(x) / len(some) for x in ([r.toxic for r in some], [r.score for r in some]))
        assert abs(share - mean) < 0.01 + 3 * math.sqrt(max(mean * (1 - mean), 0.01) / len(some))
    got = toxicity.score_documents(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = labels.limit(0)
    assert toxicity.score_documents(odd, none).count() == len(ODD) and toxicity.score_documents(empty, none).count() == 0
