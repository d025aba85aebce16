"""Toxicity by the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased words (runs of letters) and the first five letters of longer ones, so that a word's endings meet, as
far as an indexed example, ``least_df`` labelled documents or more and no more than a share ``widest`` of them hold them;
all terms of an example are indexed, of clean examples too. A term weighs (1 + ln tf) * idf, with document frequencies counted
over all documents, times its relevance g / (g + ``doubt``), g being the log-likelihood ratio statistic of the term and
the label in the training rows: words that tell nothing about the label weigh next to nothing, but no term is dropped for it.

Examples sit in an inverted index whose postings are cut into blocks of examples, each with its largest weight per term. A
document visits blocks in the order of their bound, the sum of its weights times the block's largest, and stops once no
bound reaches the k-th best cosine, so its neighbours are exact. Votes weigh by squared cosine and are shrunk towards the share
of toxic examples. A logistic curve turns a vote into a calibrated score: it is fitted on a quarter of the labelled rows by
a model that has neither indexed them nor used them for relevance; the model that scores is then made from all of them.

Labelled rows are a sample of about ``most_labelled``, of which at most ``most_examples`` are indexed, toxic ones up to half
of these, and a quarter calibrate, chosen by a hash of doc_id: the model's size does not grow with the corpus. All documents are scored from their
whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import extended, held_out, sample_order, stored
from .text_codes import Letters, by_size, words

BLOCK = 64


class Vocabulary:
    """Sorted names of terms; finds those of texts."""

    def __init__(self, names: np.ndarray):
        self.names = np.sort(names)
        self.letters = Letters()
        self._seen: np.ndarray | None = None

    def __getstate__(self):
        return {"names": self.names, "letters": self.letters, "_seen": None}

    def find(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count), sorted by text and term."""
        if not len(self.names):
            return (np.zeros(0, np.int64),) * 3
        if self._seen is None:
            self._seen = np.zeros(1 << 22, dtype=bool)
            self._seen[self.names & 0x3FFFFF] = True
        name, text = words(*self.letters.encode(texts))
        likely = self._seen[name & 0x3FFFFF]
        name, text = name[likely], text[likely]
        at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
        hit = self.names[at] == name
        pair, count = np.unique(text[hit] * len(self.names) + at[hit], return_counts=True)
        return pair // len(self.names), pair % len(self.names), count


def relevance(bad: np.ndarray, good: np.ndarray, all_bad: int, all_good: int, doubt: float = 100.0) -> np.ndarray:
    """g / (g + doubt) for terms of so many toxic and other documents out of all, g the log-likelihood ratio statistic."""
    both, n = bad + good, max(all_bad + all_good, 1)

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0.0)

    g = 2 * (part(bad, both * all_bad / n) + part(good, both * all_good / n) + part(all_bad - bad, (n - both) * all_bad / n) + part(all_good - good, (n - both) * all_good / n))
    return np.maximum(g, 0) / (np.maximum(g, 0) + doubt)


def logistic_fit(x: np.ndarray, y: np.ndarray, steps: int = 50, hold: float = 1.0) -> tuple[float, float]:
    """(slope, offset) of P(y) = 1 / (1 + exp(-(slope x + offset))) by Newton steps; slope is pulled towards 1 by hold."""
    slope, offset = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        d, w = y - p, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([d @ x - hold * (slope - 1), d.sum() - 1e-3 * offset])
        curve = np.array([[w @ (x * x) + hold, w @ x], [w @ x, w.sum() + 1e-3]])
        step = np.linalg.solve(curve, grad)
        step = step / max(1.0, float(np.abs(step).max()))
        slope, offset = slope + step[0], offset + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(slope), 1e-3), float(offset)


@dataclass
class ToxicityModel:
    vocabulary: Vocabulary
    weight_of: np.ndarray  # of terms: idf times relevance
    ids: np.ndarray  # of examples, in the order of the index
    toxic: np.ndarray
    entry_of: np.ndarray  # of each term's entries, and their end; an entry is a term in a block
    block: np.ndarray  # of each entry
    bound: np.ndarray  # of each entry: largest weight of the term in the block
    posting_of: np.ndarray  # of each entry's postings, and their end
    example: np.ndarray  # of each posting, by term and example
    weight: np.ndarray
    prior: float
    slope: float = 1.0
    offset: float = 0.0
    k: int = 15
    pull: float = 0.5

    @classmethod
    def build(cls, vocabulary, weight_of, examples: list[tuple], **params) -> ToxicityModel:
        """examples: (doc_id, toxic, terms, counts); one without terms is nobody's neighbour but counts in the prior."""
        n, blocks = len(examples), len(examples) // BLOCK + 1
        ends = [(e, *_weights(np.asarray(e[2], np.int64), np.asarray(e[3]), weight_of)) for e in examples]
        # Like examples stand together, so that bounds are tight.
        ends.sort(key=lambda x: (int(x[1][np.argmax(x[2])]) if len(x[1]) else -1, x[0][0]))
        flat = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)
        term, weight = flat([t for _, t, _ in ends], np.int64), flat([w for _, _, w in ends], float)
        example = np.repeat(np.arange(n), [len(t) for _, t, _ in ends])
        order = np.lexsort((example, term))
        term, weight, example = term[order], weight[order], example[order]
        entry, first, at = np.unique(term * blocks + example // BLOCK, return_index=True, return_inverse=True)
        bound = np.zeros(len(entry))
        np.maximum.at(bound, at, weight)
        toxic = np.array([x[0][1] for x in ends], dtype=float)
        ids = np.array([x[0][0] for x in ends], dtype=np.int64)
        return cls(vocabulary, weight_of, ids, toxic, np.searchsorted(entry // blocks, np.arange(len(weight_of) + 1)), entry % blocks, bound, np.append(first, len(term)), example, weight, float((toxic.sum() + 0.5) / (n + 10)), **params)

    def neighbours(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples, nearest first, ties to the earlier; those of cosine 0 are left out."""
        t, w = _weights(terms, counts, self.weight_of)
        entry, which = _ranges(self.entry_of[t], self.entry_of[t + 1])
        block, w = self.block[entry], w[which]
        upper = np.bincount(block, weights=self.bound[entry] * w, minlength=len(self.ids) // BLOCK + 1)
        order = np.argsort(-upper, kind="stable")
        best, at, done = np.zeros(0), np.zeros(0, np.int64), 0
        while done < len(order) and upper[order[done]] > 0 and (len(best) < self.k or upper[order[done]] >= best[self.k - 1] - 1e-12):
            now = np.zeros(len(order), dtype=bool)
            now[order[done : done + max(4, done)]] = True  # as many blocks again as were visited
            done += max(4, done)
            mine = np.flatnonzero(now[block])
            posting, which = _ranges(self.posting_of[entry[mine]], self.posting_of[entry[mine] + 1])
            score = np.bincount(self.example[posting], weights=self.weight[posting] * w[mine][which], minlength=len(self.ids))
            new = np.flatnonzero(score > (best[self.k - 1] - 1e-12 if len(best) >= self.k else 0))
            best, at = np.concatenate((best, score[new])), np.concatenate((at, new))
            top = np.lexsort((at, -best))[: self.k]
            best, at = best[top], at[top]
        return at, best

    def vote(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
        """The share of toxic neighbours by squared cosine, shrunk to the prior; and the neighbours' places."""
        if not len(terms):
            return self.prior, np.zeros(0, np.int64)
        at, cosine = self.neighbours(terms, counts)
        near = cosine**2
        return float((near @ self.toxic[at] + self.pull * self.prior) / (near.sum() + self.pull)), at

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(votes) + self.offset, -30, 30)))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[int]]]:
        """Scores from 0 to 1 and the ids of the nearest examples."""
        votes, evidence = np.full(len(texts), self.prior), [[] for _ in texts]
        for i, j in by_size(texts):
            text, term, count = self.vocabulary.find(texts[i:j])
            edges = np.flatnonzero(np.diff(text, prepend=-1, append=-1)) if len(text) else []
            for a, b in zip(edges[:-1], edges[1:]):
                votes[i + text[a]], at = self.vote(term[a:b], count[a:b])
                evidence[i + text[a]] = self.ids[at].tolist()
        return self.calibrated(votes), evidence


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of ranges [lo, hi), and the range that each belongs to."""
    size = hi - lo
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum()), np.repeat(np.arange(len(lo)), size)


def _weights(terms: np.ndarray, counts: np.ndarray, weight_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = (1 + np.log(counts)) * weight_of[terms]
    length = np.sqrt((w * w).sum())
    return terms, w / length if length else w


_COUNTS = ("bad", "good", "bad_apart", "good_apart")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name and toxic and other documents of the terms of each batch, those that calibrate apart, and indexed ones; columns text, toxic, apart, indexed."""
    letters = Letters()
    for batch in batches:
        texts = batch.column(0).to_pylist()
        toxic, apart, indexed = (batch.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (1, 2, 3))
        for i, j in by_size(texts):
            name, text = words(*letters.encode(texts[i:j]))
            order = np.lexsort((text, name))
            name, text = name[order], text[order]
            new = np.ones(len(name), dtype=bool)
            new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
            names, at = np.unique(name[new], return_inverse=True)
            t, c = toxic[i:j][text[new]], apart[i:j][text[new]]
            count = lambda kind: pa.array(np.bincount(at[kind], minlength=len(names)))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(names), count(t & ~c), count(~t & ~c), count(t & c), count(~t & c), count(indexed[i:j][text[new]])], names=["name", *_COUNTS, "indexed"])


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 12_000, most_examples: int = 1_600, least_df: int = 2, widest: float = 0.25, **params) -> ToxicityModel:
    """docs(doc_id, text), labels(doc_id, toxic); rows of labels with a null doc_id or label are left out, of repeated ones the larger counts."""
    spark = docs.sparkSession
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic")).withColumn("_u", sample_order("doc_id"))
    total = marked.count()
    some = marked.where(F.col("_u") < min(1.0, most_labelled / max(total, 1)))
    apart = F.xxhash64(F.lit("calibrates"), "doc_id") % 4 == 0
    # About most_labelled rows of 20 bytes: their number is set by that parameter.
    some = stored(some.select("doc_id", "toxic", apart.alias("apart"), F.row_number().over(Window.partitionBy("toxic").orderBy("_u", "doc_id")).alias("place")), "marked")
    bad = min(some.where("toxic").count(), most_examples // 2)
    indexed = F.col("place") <= F.when(F.col("toxic"), bad).otherwise(most_examples - bad)
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").withColumn("indexed", indexed), "labelled")
    sizes = np.array(rows.agg(*[F.count_if(F.expr(c)) for c in ("toxic and not apart", "not toxic and not apart", "toxic and apart", "not toxic and apart")]).first())
    counted = rows.select("text", "toxic", "apart", "indexed").mapInArrow(_term_counts, ", ".join(f"{c} long" for c in ("name", *_COUNTS, "indexed")))
    df = sum((F.col(c) for c in _COUNTS), F.lit(0))
    terms = counted.groupBy("name").agg(*[F.sum(c).alias(c) for c in (*_COUNTS, "indexed")])
    # Terms of the indexed examples: as bounded as these are.
    chosen = terms.where((F.col("indexed") > 0) & (df >= least_df) & (df <= max(widest * int(sizes.sum()), least_df))).drop("indexed").orderBy("name").toPandas()
    vocabulary = Vocabulary(chosen["name"].to_numpy(np.int64))
    shared = spark.sparkContext.broadcast(vocabulary)
    v = len(vocabulary.names)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(v, dtype=np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n += len(texts)
            for i, j in by_size(texts):
                seen += np.bincount(shared.value.find(texts[i:j])[1], minlength=v)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(seen[used], n))], names=["term", "n"])

    counts = docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(v + 1)
    frequency[counts["term"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)  # -1, all documents, is the last
    idf = np.log((frequency[-1] + 1) / (frequency[:-1] + 1)) + 1
    seen = chosen[[*_COUNTS]].to_numpy(float).T
    part, whole = relevance(seen[0], seen[1], *sizes[:2]), relevance(seen[0] + seen[2], seen[1] + seen[3], *(sizes[:2] + sizes[2:]))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            terms, counts, sizes = [], [], np.zeros(len(texts), dtype=np.int64)
            for i, j in by_size(texts):
                text, term, count = shared.value.find(texts[i:j])
                sizes[i:j] += np.bincount(text, minlength=j - i)
                terms.append(term)
                counts.append(count)
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int32))) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *lists], names=["doc_id", "toxic", "apart", "indexed", "place", "terms", "counts"])

    wanted = rows.where("indexed or apart").select("text", "doc_id", "toxic", "apart", "indexed", "place")
    table = stored(wanted.mapInArrow(vectors, "doc_id long, toxic boolean, apart boolean, indexed boolean, place int, terms array<int>, counts array<int>"), "examples")
    table = table.orderBy("toxic", "place", "doc_id").toArrow().combine_chunks()
    lists = [zip(*(_cut(table.column(c).combine_chunks()) for c in ("terms", "counts")))]
    examples = [(i, int(t), *x, a, k) for i, t, a, k, x in zip(*(table.column(c).to_pylist() for c in ("doc_id", "toxic", "apart", "indexed")), *lists)]
    held = [e for e in examples if e[5]]
    model = ToxicityModel.build(vocabulary, idf * whole, held, **params)
    check = [e for e in examples if e[4]]
    if any(e[1] for e in check) and not all(e[1] for e in check):
        without = ToxicityModel.build(vocabulary, idf * part, [e for e in held if not e[4]], **params)
        votes = np.array([without.vote(e[2], e[3])[0] for e in check])
        model.slope, model.offset = logistic_fit(_logit(votes), np.array([e[1] for e in check], dtype=float))
    return model


def _cut(column: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow column as arrays of 64-bit numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat, ends = column.values.to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def score_texts(docs: DataFrame, model: ToxicityModel, text: str = "text", least: float = 0.3) -> DataFrame:
    """docs with score, predicted and evidence (ids of the nearest examples) added in place of columns of those names; one pass, no shuffle.

    Null and empty texts and texts without a known term get the score of the prior; all other columns pass through.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted", "evidence")
    at = docs.columns.index(text)
    schema = extended(docs, score="double", predicted="int", evidence="array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, evidence = held.value.score(batch.column(at).to_pylist())
            added = [pa.array(scores, pa.float64()), pa.array((scores >= least).astype(np.int32)), pa.array(evidence, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every document; labels are learned from documents that are not held out."""
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic").where(~held_out("doc_id")), **params)
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return score_texts(rows, model).select("doc_id", "held_out", "score", "predicted", "evidence")
