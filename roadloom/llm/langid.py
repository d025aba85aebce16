"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language gives the longest match at every point of a text: the text is cut
greedily into the longest phrases that occur in the language's text. Fewer phrases per character mean a closer language;
phrase counts are normalised by the text's length and the bits that one pointer into the training text costs.

The automata are trained on a bounded sample: ``train_chars`` characters from the middles of ``docs_per_lang`` labelled
documents at most, of each of the ``most_langs`` languages with the most labelled texts, chosen by a hash of doc_id, so the
model's size is fixed by these parameters and not by the corpus. Each language has the alphabet of its own sample, however
large; letters that it lacks are phrases of their own. Every text is parsed whole, in blocks of ``block`` characters that
are walked side by side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import extended, held_out, releasing, sample_order
from .text_codes import SPACE, CodeTable, by_size

UNDETERMINED = "und"


#: An automaton's transitions are held as a full table up to this alphabet, else as a sorted list; results are the same.
DENSE = 128


class Automaton:
    """Transitions of a suffix automaton: next state * 2 + (1 if a phrase ends here), by state * alphabet + code.

    Where no transition exists, a phrase ends and the next one begins with the same code.
    """

    def __init__(self, begin: np.ndarray, keys: np.ndarray, values: np.ndarray, states: int):
        self.alphabet, self.begin = len(begin), begin
        if self.alphabet <= DENSE:
            self.table = np.tile(begin + 1, states)
            self.table[: self.alphabet] = begin  # at the root no phrase is there to end
            self.table[keys] = values
        else:
            order = np.argsort(keys)
            self.table, self.keys, self.values = None, keys[order], values[order]

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.alphabet + code
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.begin[code] + (state != 0))


def suffix_automaton(codes: list[int], alphabet: int) -> Automaton:
    """The suffix automaton of a text of codes below alphabet."""
    link, length, moves = [-1], [0], [{}]
    last = 0
    for c in codes:
        cur = len(moves)
        link.append(0)
        length.append(length[last] + 1)
        moves.append({})
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(moves)
                link.append(link[q])
                length.append(length[p] + 1)
                moves.append(dict(moves[q]))
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    # A last state holds a phrase of one unknown code. Only at the root, where a text begins, no phrase is there to end.
    unknown = len(moves)
    begin = np.array([moves[0].get(c, unknown) * 2 for c in range(alphabet)], dtype=np.int32)
    flat = [(s * alphabet + c, t * 2) for s, out in enumerate(moves) for c, t in out.items()]
    keys, values = np.array(flat, dtype=np.int64).reshape(-1, 2).T
    return Automaton(begin, keys, values.astype(np.int32), unknown + 1)


def middles(texts: list[str], chars: int) -> list[str]:
    """The middle of each text, cut to one length so that they have about so many characters together; short ones are whole."""
    left, most, sizes = chars, 0, sorted(len(t) for t in texts)
    for i, n in enumerate(sizes):
        most = max(left // (len(sizes) - i), 1)
        if n > most:
            break
        left -= n
    return [t if len(t) <= most else t[(len(t) - most) // 2 :][:most] for t in texts]


@dataclass
class LanguageModel:
    """Automata by language; picklable, and of a size set by the training bound."""

    codes: CodeTable
    langs: list[str]
    own: list[np.ndarray]  # from the common codes to a language's
    automata: list[Automaton]
    bits: list[float]
    block: int = 512

    @classmethod
    def train(cls, texts: dict[str, list[str]], train_chars: int, block: int = 512) -> LanguageModel:
        parts = {lang: middles(ts, train_chars) for lang, ts in sorted(texts.items())}
        codes = CodeTable.learned(t for ts in parts.values() for t in ts)
        langs, own, automata, bits = [], [], [], []
        for lang, ts in parts.items():
            seq = codes.encode(ts)[0]
            letters = np.setdiff1d(seq, [SPACE])
            if not len(letters):
                continue
            to = np.full(codes.size, len(letters) + 1, dtype=np.int64)  # the last code is for letters that it lacks
            to[SPACE], to[letters] = SPACE, np.arange(1, len(letters) + 1)
            langs.append(lang)
            own.append(to)
            automata.append(suffix_automaton(to[seq].tolist(), len(letters) + 2))
            bits.append(math.log2(len(seq) + 1))
        return cls(codes, langs, own, automata, bits, block)

    def costs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) phrase bits per character, and the number of letters of each text."""
        codes, first = self.codes.encode(texts)
        n = np.diff(first)
        letters = np.add.reduceat(codes != SPACE, first[:-1]) if len(texts) else np.zeros(0, int)
        per = np.where(letters > 0, -(-n // self.block), 0)
        doc = np.repeat(np.arange(len(texts)), per)
        k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        start = first[doc] + k * self.block
        size = np.minimum(self.block, first[doc + 1] - start)
        order = np.argsort(-size, kind="stable")
        start, size, doc = start[order], size[order], doc[order]
        going = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
        phrases = np.ones((len(self.langs), len(start)), dtype=np.int32)  # the last phrase of a block
        state = np.zeros((len(self.langs), len(start)), dtype=np.int32)
        for i, (to, automaton) in enumerate(zip(self.own, self.automata)):
            mine = to[codes]
            for t, m in enumerate(going):
                got = automaton.step(state[i, :m], mine[start[:m] + t])
                phrases[i, :m] += got & 1
                state[i, :m] = got >> 1
        out = np.zeros((len(texts), len(self.langs)))
        for i, b in enumerate(self.bits):
            out[:, i] = np.bincount(doc, weights=phrases[i], minlength=len(texts)) * b
        return out / np.maximum(n, 1)[:, None], letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs: list[str] = []
        scores: list[float] = []
        for i, j in by_size(texts):
            cost, letters = self.costs(texts[i:j])
            if not self.langs:
                langs += [UNDETERMINED] * (j - i)
                scores += [0.0] * (j - i)
                continue
            best = np.argmin(cost, axis=1)
            least = cost[np.arange(j - i), best]
            if len(self.langs) > 1:
                second = np.partition(cost, 1, axis=1)[:, 1]
                score = second / np.maximum(least + second, 1e-12)
            else:
                score = np.ones(j - i)
            langs += [self.langs[b] if n else UNDETERMINED for b, n in zip(best, letters)]
            scores += [float(s) if n else 0.0 for s, n in zip(score, letters)]
        return langs, scores


def labelled_sample(labelled: DataFrame, text: str, lang: str, key: str, docs_per_lang: int, chars: int, most_langs: int) -> dict[str, list[str]]:
    """The middles, of chars characters at most, of docs_per_lang texts at most of each language, by a hash of key."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), F.col(key).alias("_key")).withColumn("_u", sample_order("_key"))
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(most_langs).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4.0 * docs_per_lang / n))])
    near = rows.where(F.col("_u") < share[F.col("_lang")])
    first = Window.partitionBy("_lang").orderBy("_u", "_key", "_text")
    begin = F.greatest(F.floor((F.length("_text") - chars) / 2), F.lit(0)).cast("int")
    some = near.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= docs_per_lang).select("_lang", "_r", F.substring("_text", begin + 1, F.lit(chars)).alias("_text")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(some, key=lambda r: (r["_lang"], r["_r"])):
        out.setdefault(r["_lang"], []).append(r["_text"])
    return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_lang: int = 40, train_chars: int = 16_000, most_langs: int = 256) -> LanguageModel:
    return LanguageModel.train(labelled_sample(labelled, text, lang, key, docs_per_lang, train_chars, most_langs), train_chars)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred and score added, replacing columns of those names; one pass, no shuffle.

    Null text and text without a letter: lang_pred 'und', score 0. Equal costs: the language first by code point. Repeated
    rows give equal results; an empty table gives an empty one; all other columns pass through.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text)
    schema = extended(docs, lang_pred="string", score="double")

    def run(batches):
        for batch in batches:
            langs, scores = held.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(releasing(run), schema)


def predict_documents(docs: DataFrame, **params) -> DataFrame:
    """The query's form: learn from documents that are not held out, predict all from text alone."""
    slim = docs.select("doc_id", "text", "lang")
    model = train(slim.where(~held_out("doc_id")), **params)
    return identify(slim.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
