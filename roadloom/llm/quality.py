"""Quality rules: repetition rules, and divergence of a document's histograms from those of its language.

Two histograms describe a document: classes of its characters, and its language's commonest words with one bin for all
others. The reference of a language sums them over all its documents. The Jensen-Shannon distance (in bits, 0 to 1) to the
reference tells texts of symbols, of capitals, of no function words or of another language from prose. A short text is far
from any reference by chance, so guards of least length hold, and of the words' divergence what chance alone is expected to
give, one less than the bins by 8 n ln 2 for n words, is taken off.

DataFrame functions only. Texts are never shuffled: to find common words a task sums what its documents weigh by word, and
counts of a document's words shuffle as one row of numbers per document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .mixing import word_count

SPACES = " \t\n\x0b\x0c\r"
CLASSES = ("lower", "upper", "digit", "space", "sentence", "ascii", "other")
#: Languages with a reference of their own, those of most documents; common words of each.
MOST_LANGUAGES, COMMON = 256, 32
#: Words from which on a document weighs no more in the choice of common words; characters of the longest word that is kept as it is.
FULL_WEIGHT, LONGEST_NAME = 200, 100
#: Distances beyond these fail a document, and the least characters in words, or words, for the test to count.
MOST_CHARACTERS_DISTANCE, LEAST_CHARACTERS = 0.3, 200
MOST_WORDS_DISTANCE, LEAST_WORDS = 0.25, 50


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words in windows of `width` words that the text holds twice or more, the first one included.

    Windows are told apart by 64-bit hashes.
    """

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            near = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda e, j: near(e, j - 1) | near(e, j + 1)), lambda e: e["i"]))

        def total(at: Column) -> Column:
            after = F.concat(F.slice(at, 2, F.size(at)), F.array(F.lit((1 << 31) - 1)))
            return F.aggregate(F.zip_with(at, after, lambda a, b: F.least(b - a, F.lit(width))), F.lit(0), lambda x, y: x + y)

        return let(let(by_hash, twice), total)

    def at_each(w: Column, size: int) -> Column:
        """The hash of the window that begins at each place but the last size - 1."""
        full = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))
        return F.slice(full, 1, F.size(w) - (size - 1))

    def counted(w: Column) -> Column:
        # Few texts repeat half a window, and only those are searched for whole ones.
        differ = lambda h: F.size(F.array_distinct(h)) == F.size(h)
        return F.when(F.size(w) < width, 0).when(let(at_each(w, width // 2), differ), 0).otherwise(let(at_each(w, width), lambda h: F.when(differ(h), 0).otherwise(covered(h))))

    return let(words, counted).cast("long")


def character_classes(text: Column) -> Column:
    """A struct of the code points of each class of CLASSES, and of the symbols among them."""
    # Plain letters and spaces come in long runs; what is left is a small part of a text, and patterns run over that.
    blanks = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))

    def counted(rest: Column) -> Column:
        return F.struct(
            F.length(rest).alias("rest"), F.regexp_count(rest, F.lit(r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]")).alias("letters"), F.regexp_count(rest, F.lit(r"[\p{Lu}\p{Lt}]")).alias("upper"), F.regexp_count(rest, F.lit(r"\p{Nd}")).alias("digit"),
            F.regexp_count(rest, F.lit(r"[\x20\x09-\x0D]")).alias("space"), F.regexp_count(rest, F.lit(r"[.,;:!?'\"()-]")).alias("sentence"), F.regexp_count(rest, F.lit(r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]")).alias("marks"), F.regexp_count(rest, F.lit(r"[#*$%&|<>]")).alias("symbols"),
        )

    def summed(n: Column) -> Column:
        lower = F.length(text) - n["rest"] - blanks + n["letters"]
        other = n["rest"] - n["letters"] - n["upper"] - n["digit"] - n["space"] - n["marks"]
        parts = dict(zip(CLASSES, (lower, n["upper"], n["digit"], n["space"] + blanks, n["sentence"], n["marks"] - n["sentence"], other)))
        return F.struct(*[v.cast("long").alias(c) for c, v in parts.items()], n["symbols"].cast("long").alias("symbols"))

    return let(let(F.regexp_replace(text, r"[a-z\x20]+", ""), counted), summed)


def js_divergence(a: Column, b: Column, of_a: Column, of_b: Column) -> Column:
    """The Jensen-Shannon divergence, in bits, of two histograms: arrays of counts and what these add up to. NULL if one is empty."""

    def term(x: Column, y: Column) -> Column:
        p, q = x / of_a.cast("double"), y / of_b.cast("double")
        part = lambda u: F.when(u > 0, u * F.log2(2 * u / (p + q))).otherwise(0.0)
        return part(p) + part(q)

    total = F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda x, y: x + y)
    return F.when((of_a > 0) & (of_b > 0), F.greatest(total / 2, F.lit(0.0)))


def name_of(word: Column) -> Column:
    """word, or the digest of a long one, so that a text without spaces isn't shuffled."""
    return F.when(F.length(word) <= LONGEST_NAME, word).otherwise(F.sha2(word, 256))


def common_words(documents: DataFrame, weights: dict[int, int], common: int) -> DataFrame:
    """language, place (from 0), word: up to `common` words, in lower case, of each language, those that most of its documents hold.

    All documents count. One weighs as much as it has words, up to FULL_WEIGHT: short texts hold few words of any kind, and no
    long one stands for a language. weights has what the documents of each language weigh. Words that half of it or less holds are
    left out, so that passages or texts which many documents share don't count as the language's. Ties go in order of the words.
    """
    words = documents.where(F.col("language") > 0).select("language", words_of(F.lower("text")).alias("words"))
    held = words.select("language", F.least(F.size("words"), F.lit(FULL_WEIGHT)).alias("weight"), F.explode(F.array_distinct("words")).alias("word"))
    held = held.groupBy("language", name_of(F.col("word")).alias("word")).agg(F.sum("weight").alias("held"))
    weight = F.create_map(*[F.lit(x) for item in weights.items() for x in item])
    order = Window.partitionBy("language").orderBy(F.col("held").desc(), "word")
    ranked = held.where(2 * F.col("held") > F.try_element_at(weight, "language")).withColumn("place", F.row_number().over(order) - 1)
    return stored(ranked.where(F.col("place") < common).select("language", "place", "word"), "common-words")


def assess(documents: DataFrame, common: int = COMMON, languages: int = MOST_LANGUAGES) -> DataFrame:
    """documents(doc_id, text, lang) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    characters_distance, words_distance: one row per document.

    base_failed: under 20 words, or over 30 % of the words in repeated windows. Of the others, kept are those whose
    distances are within MOST_CHARACTERS_DISTANCE (for texts of LEAST_CHARACTERS characters in words or more) and
    MOST_WORDS_DISTANCE (of LEAST_WORDS words or more). Distances are NULL for a text without a character or a word.

    References of characters and words are of a document's lang. Documents of a null or empty lang, or of one beyond the
    `languages` of most documents, form one group that has a reference of characters only, as words of several languages
    have no common measure; their words_distance is NULL. A null text is empty: no words, base_failed. Null and repeated
    doc_ids, and equal texts, are rows of their own. Other columns are left out; an empty table gives an empty result.
    """
    lang = F.col("lang").cast("string")
    figures = (F.count("*").alias("n"), F.sum(F.least(word_count("text"), F.lit(FULL_WEIGHT))).alias("weight"))
    most = documents.where("lang is not null").groupBy(lang.alias("lang")).agg(*figures).orderBy(F.col("n").desc(), "lang").limit(languages)
    number, weights = F.lit(0), {}
    for i, r in enumerate(most.collect(), 1):
        number, weights[i] = F.when(lang == r["lang"], i).otherwise(number), r["weight"]
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), number.alias("language"))
    words = common_words(docs, weights, common) if weights else None

    measured = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "language", words_of(F.col("text")).alias("words"))
    measured = measured.select("row", "doc_id", "language", "words", character_classes(F.col("text")).alias("c"), duplicate_lines(F.col("text")).alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"))
    # Numbers only beside the row's own, so that the aggregate is one by hash.
    classes = [F.col("c")[name].alias(name) for name in (*CLASSES, "symbols")]
    numbers = ("language", "n_words", "n_dup_lines", "n_repeat_words", *CLASSES, "symbols")
    table = measured.select("row", "doc_id", "language", F.size("words").cast("long").alias("n_words"), "n_dup_lines", "n_repeat_words", *classes, F.posexplode_outer("words").alias("at", "word"))
    if words is None:
        table = table.withColumn("place", F.lit(None).cast("int"))
    else:
        # languages * common rows at most, and no word that is longer than all of them need be looked up.
        longest = words.agg(F.max(F.length("word"))).first()[0] or 0
        lower = name_of(F.lower("word"))
        table = table.withColumn("key", F.when(F.length(lower) <= longest, F.xxhash64("language", lower)))
        table = table.join(F.broadcast(words.select(F.xxhash64("language", "word").alias("key"), "place")), "key", "left")
    # Of the words that are not common, the first is kept, so that no document is lost.
    table = table.where("place is not null or at is null or at = 0")
    hits = [F.count_if(F.col("place") == k).alias(f"w{k}") for k in range(common)]
    table = stored(table.groupBy("row").agg(*[F.max(x).alias(x) for x in ("doc_id", *numbers)], *hits), "measured")

    # One row per language.
    total = lambda names: [F.sum(c) for c in names]
    references = table.groupBy("language").agg(F.array(*total(CLASSES)).alias("r_classes"), F.array(*total(f"w{k}" for k in range(common))).alias("r_words"), F.sum("n_words").alias("r_n"))
    if words is None:
        references = references.withColumn("bins", F.lit(None).cast("long"))
    else:
        references = references.join(words.groupBy("language").agg(F.count("*").alias("bins")), "language", "left")
    found = table.join(F.broadcast(references), "language").select(
        "doc_id", "n_words", "n_dup_lines", "n_repeat_words", "symbols", "r_classes", "r_words", "r_n", "bins",
        F.array(*CLASSES).alias("classes"), F.array(*[f"w{k}" for k in range(common)]).alias("words"), sum((F.col(c) for c in CLASSES), F.lit(0)).alias("chars"), (sum((F.col(c) for c in CLASSES if c != "space"), F.lit(0))).alias("word_chars"),
    )
    add = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    rest = lambda x, n: F.concat(x, F.array(n - add(x)))
    by_words = js_divergence(rest(F.col("words"), F.col("n_words")), rest(F.col("r_words"), F.col("r_n")), F.col("n_words"), F.col("r_n"))
    by_chars = js_divergence(F.col("classes"), F.col("r_classes"), F.col("chars"), add(F.col("r_classes")))
    by_chance = F.try_divide(F.col("bins") / (8 * math.log(2)), F.col("n_words"))
    scored = found.select(
        "doc_id", "n_words", "word_chars", F.col("symbols").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        F.sqrt(by_chars).alias("characters_distance"), F.sqrt(F.when(F.col("bins") > 0, F.greatest(by_words - by_chance, F.lit(0.0)))).alias("words_distance"),
    )
    odd = (F.col("word_chars") >= LEAST_CHARACTERS) & (F.col("characters_distance") > MOST_CHARACTERS_DISTANCE)
    strange = (F.col("n_words") >= LEAST_WORDS) & (F.col("words_distance") > MOST_WORDS_DISTANCE)
    verdict = ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)) & ~F.coalesce(strange, F.lit(False))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"), "characters_distance", "words_distance")
