"""Secret scans: fixed patterns, and a battery of randomness tests on other candidate strings. DataFrame functions only.

Candidates are all runs of 20 or more letters, digits and ``+ / _ -``. Each is read in the smallest encoding that holds it
(hex, lower or upper base36, or base64). Two hypotheses are tested in it:

- uniform random symbols: chi-squared of the symbol counts, runs above and below the middle of the alphabet, and serial
  correlation of neighbouring symbols. The p value is three times the least of the three, 1 at most; a string with less
  than ``LEAST_UNIFORM`` is none.
- ordinary text, such as identifiers, paths and numbers: the same chi-squared statistic, which counts pairs of equal
  symbols, against the many that such strings have, and runs of one kind of symbol (lower, upper, digit, other) against
  how seldom they change kind. The p value is the tail of the sum of the two normal scores: how likely ordinary text
  looks as random as this. What ordinary text is like is in ENCODINGS, by encoding.

Within each encoding and band of lengths, a Benjamini-Hochberg cut on the second p value over the candidates of all
documents bounds the share of ordinary strings among those that are reported as secrets. Short strings have little
evidence and so need many like them, or are left. The cut needs p values by rank only, so it is taken from a histogram.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Encoding: symbols in order, pattern of the whole string, then of ordinary text in it: the probabilities that two and
#: that three of its symbols are equal, and that neighbours are of different kinds; last, where kinds of symbols end.
ENCODINGS = {
    "hex": ("0123456789abcdef", r"^[0-9a-fA-F]+$", 0.1, 0.012, 0.25, (10,)),
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", r"^(?:[0-9a-z]+|[0-9A-Z]+)$", 0.06, 0.0045, 0.25, (10,)),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", r"^[A-Za-z0-9+/_-]+$", 0.055, 0.0037, 0.4, (26, 52, 62)),
}
LEAST_UNIFORM = 0.001
#: Matches that are numbered off together; a text's matches cost the square of this number only.
CHUNK = 64
#: p values are counted in bins of their decimal logarithm, this many to a power of ten, down to 1e-16.
BINS_PER_TEN, MOST_TENS = 50, 16


def _begin_end(text: Column, pattern: str) -> Column:
    """Array of (start, end, group) of a pattern's leftmost non-overlapping matches in code points, end exclusive; none of them empty."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.transform(F.slice(between, 1, F.size(found)), F.length).alias("gap"), F.transform(found, F.length).alias("size"), found.alias("text"))
    kind = "array<struct<start:int,end:int,text:string>>"

    def step(acc, m):
        begin = acc["at"] + m["gap"]
        end = begin + m["size"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), m["text"].alias("text")))).alias("out"))

    def placed(matches):
        # Each chunk counts from its own begin, and is moved by the lengths of those before it.
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / CHUNK).cast("int")), lambda i: F.slice(matches, i * CHUNK + 1, CHUNK))
        parts = F.transform(parts, lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step))
        ahead = lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        begins = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), ahead, lambda acc: acc["out"])
        moved = lambda x, by: F.transform(x["out"], lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["text"].alias("text")))
        return F.flatten(F.zip_with(parts, begins, moved))

    # A one-element array names the matches, so that they are found once.
    return F.element_at(F.transform(F.array(both), lambda x: F.when(F.size(x) > 0, placed(x)).otherwise(F.array().cast(kind))), 1)


def _spans(text: Column, kind: str) -> Column:
    """Spans (start, kind number, end) of one of the fixed kinds. A cheap test goes first, so that most texts are never split."""
    number = KINDS.index(kind)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    as_span = lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"))
    if kind == "assign":
        hits = F.filter(_begin_end(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 2)) >= 6)
        return F.when(text.rlike(ASSIGN), F.transform(hits, as_span)).otherwise(none)
    if kind == "access":
        hits = F.filter(_begin_end(text, ACCESS), lambda m: m["end"] - m["start"] >= 20)
        return F.when(text.contains("AKIA"), F.transform(hits, as_span)).otherwise(none)
    # A run of 24 or more is the same run whether shorter ones are matched first or not.
    return F.when(text.rlike(r"[0-9a-f]{24}"), F.transform(_begin_end(text, r"[0-9a-f]{24,}"), as_span)).otherwise(none)


def _two_sided(z: Column) -> Column:
    """P(|N(0, 1)| >= |z|), by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * F.exp(-x * x / 2) / 2.5066282746310002 * poly)


def _upper(z: Column) -> Column:
    """P(N(0, 1) >= z)."""
    half = _two_sided(z) / 2
    return F.when(z > 0, half).otherwise(1 - half)


def _tested(hits: Column) -> Column:
    """Candidates (start, end, text) with encoding number, length band, p value under uniform random symbols and under ordinary text.

    Each step names what the next one uses more than once.
    """
    known = list(ENCODINGS.values())
    of = lambda m, values: F.element_at(F.array(*map(F.lit, values)), m["encoding"] + 1)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    neighbours = lambda x, f: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), f)
    place = lambda m: [m["start"].alias("start"), m["end"].alias("end"), m["encoding"].alias("encoding")]

    def encoded(m):
        number = F.lit(len(known) - 1)
        for i in reversed(range(len(known) - 1)):
            number = F.when(m["text"].rlike(known[i][1]), F.lit(i)).otherwise(number)
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), number.alias("encoding"), m["text"].alias("text"))

    def coded(m):
        text = F.when(m["encoding"] == len(known) - 1, m["text"]).otherwise(F.lower(m["text"]))
        symbols = of(m, [k[0] for k in known])
        code = F.transform(F.split(text, ""), lambda c: F.instr(symbols, c).cast("double"))
        squares = F.transform(F.split(symbols, ""), lambda c: F.pow(F.length(text) - F.length(F.replace(text, c, F.lit(""))), F.lit(2.0)))
        return F.struct(*place(m), F.length(text).cast("double").alias("n"), F.length(symbols).cast("double").alias("size"), code.alias("code"), total(squares).alias("squares"))

    def counted(m):
        middle = (m["size"] + 1) / 2
        ends = F.array(*[F.array(*map(F.lit, (*k[5], 99, 99, 99)[:3])) for k in known])
        kind = lambda x: sum(((x > F.element_at(F.element_at(ends, m["encoding"] + 1), i)).cast("int") for i in (1, 2, 3)), F.lit(0))
        return F.struct(
            *place(m), m["n"].alias("n"), m["size"].alias("size"), m["squares"].alias("squares"),
            total(F.transform(m["code"], lambda x: (x > middle).cast("double"))).alias("above"),
            (1 + total(neighbours(m["code"], lambda a, b: ((a > middle) != (b > middle)).cast("double")))).alias("turns"),
            total(neighbours(m["code"], lambda a, b: (kind(a) != kind(b)).cast("double"))).alias("changes"),
            # Products of neighbours have mean 0 and variance ((size^2 - 1) / 12)^2 each.
            (total(neighbours(m["code"], lambda a, b: (a - middle) * (b - middle))) / (F.sqrt(m["n"] - 1) * ((m["size"] * m["size"] - 1) / 12))).alias("serial"),
        )

    def scored(m):
        n, two, three, change = m["n"], *(of(m, [k[i] for k in known]) for i in (2, 3, 4))
        # Wilson and Hilferty: the cube root of chi-squared over its freedom is nearly normal.
        spread = 2 / (9 * (m["size"] - 1))
        chi = m["squares"] * m["size"] / n - n
        uniform = (F.cbrt(F.greatest(chi, F.lit(0.0)) / (m["size"] - 1)) - (1 - spread)) / F.sqrt(spread)
        mean = 2 * m["above"] * (n - m["above"]) / n
        variance = F.greatest(mean * (mean - 1) / (n - 1), F.lit(0.0))
        runs = F.when(variance > 0, (m["turns"] - mean - 1) / F.sqrt(variance)).otherwise(40.0)
        # Pairs of equal symbols and changes of kind, against those of ordinary text.
        pairs = n * (n - 1) / 2
        fewer = (pairs * two - (m["squares"] - n) / 2) / F.sqrt(pairs * two * (1 - two) + 2 * pairs * (n - 2) * (three - two * two))
        more = (m["changes"] - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
        return F.struct(*place(m), n.alias("n"), uniform.alias("uniform"), runs.alias("runs"), m["serial"].alias("serial"), ((fewer + more) / F.sqrt(F.lit(2.0))).alias("unlike"))

    def judged(m):
        p = F.least(F.lit(1.0), 3 * F.least(_upper(m["uniform"]), _two_sided(m["runs"]), _two_sided(m["serial"])))
        return F.struct(*place(m), F.floor(F.log2(m["n"])).cast("int").alias("band"), p.alias("uniform"), _upper(m["unlike"]).alias("p"))

    out = hits
    for step in (encoded, coded, counted, scored, judged):
        out = F.transform(out, step)
    return out


def _candidates(text: Column) -> Column:
    """Spans with encoding number, length band and p value, of strings that the battery does not refute as random bytes."""
    none = F.array().cast("array<struct<start:int,end:int,encoding:int,band:int,uniform:double,p:double>>")
    return F.when(text.rlike(CANDIDATE), _tested(_begin_end(text, CANDIDATE))).otherwise(none)


def _bin(p: Column) -> Column:
    """0 for p = 1, growing as p falls."""
    return F.least(F.lit(MOST_TENS * BINS_PER_TEN), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS_PER_TEN)).cast("int")


@dataclass(frozen=True)
class Cuts:
    """For an encoding and length band, the least bin that the Benjamini-Hochberg procedure rejects as ordinary text."""

    bins: tuple[tuple[int, int, int], ...]

    def secret(self, m: Column) -> Column:
        out = F.lit(False)
        for encoding, band, least in self.bins:
            out = out | ((m["encoding"] == encoding) & (m["band"] == band) & (_bin(m["p"]) >= least))
        return out & (m["uniform"] >= LEAST_UNIFORM)


def false_discovery_cuts(found: DataFrame, candidates: Column, rate: float = 0.01) -> Cuts:
    """Cuts over the candidates of all documents. At most (encodings x length bands) rows reach the driver."""
    found = found.select(F.explode(candidates).alias("m")).select("m.encoding", "m.band", _bin(F.col("m.p")).alias("bin"))
    counts = found.groupBy("encoding", "band", "bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy("encoding", "band")
    ranked = counts.withColumn("rank", F.sum("n").over(group.orderBy(F.col("bin").desc()))).withColumn("of", F.sum("n").over(group))
    # The largest p value of a bin stands for all of it.
    rejected = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_TEN) <= rate * F.col("rank") / F.col("of"))
    rows = rejected.groupBy("encoding", "band").agg(F.min("bin").alias("least")).collect()
    return Cuts(tuple(sorted((r["encoding"], r["band"], r["least"]) for r in rows)))


def base_spans(text: Column) -> Column:
    """Spans (start, kind number, end) of the fixed kinds, by kind."""
    return F.concat(*[_spans(text, k) for k in KINDS[:3]])


def all_spans(base: Column, candidates: Column, cuts: Cuts) -> Column:
    """All spans (start, kind number, end) in order."""
    random = F.transform(F.filter(candidates, cuts.secret), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), m["end"].alias("end")))
    return F.array_sort(F.concat(base, random))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every document.

    Null text counts as empty and has no spans; base_sha256 is then that of the empty string. Repeated rows give equal
    results; an empty table gives an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    # One pass over the texts; what it finds is a narrow table.
    found = stored(docs.select("doc_id", base_spans(text).alias("base"), _candidates(text).alias("found")), "secrets")
    cuts = false_discovery_cuts(found, F.col("found"), rate)
    spans = found.select("doc_id", all_spans(F.col("base"), F.col("found"), cuts).alias("s"))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("s", lambda x: x["kind"] < 3)
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"), count("random"))


def redacted(docs: DataFrame, rate: float = 0.01, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by a mark, and n_chars set anew where text changed; all rows and other columns stay.

    Null, empty and clean texts stay as they are, as do their n_chars. An empty table gives an empty result.
    """
    whole, (name,) = F.coalesce("text", F.lit("")), fresh(docs, "spans")
    spans = all_spans(base_spans(whole), _candidates(whole), false_discovery_cuts(docs, _candidates(whole), rate))
    keyed = docs.withColumn(name, spans)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda at: F.substring(F.col("text"), at + 1, F.length("text") - at)

    def step(acc, s):
        new = s["start"] >= acc["at"]
        lead = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        # A span that begins inside the one before only makes it longer.
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["out"], lead, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(name, start, step, lambda acc: F.concat(acc["out"], rest(acc["at"])))
    text = F.when(F.size(name) > 0, clean).otherwise(F.col("text"))
    out = keyed.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
