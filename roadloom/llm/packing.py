"""Packing token sequences by minimum bin slack.

A document's ids are cut at every ``window`` ids; what remains of it is shorter. Only the number of pieces of each length
matters to the packing, at most ``window`` numbers, so the plan is made from that histogram: the longest length left is
placed, and a subset-sum over a bitset finds the multiset of other lengths that comes closest to filling the window. The
pattern is applied as often as the counts allow, which uses up at least one length. Pieces then take their places by
their rank within their length, as a join of ranks with ranges.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import releasing, stored

WINDOW = 2048
END_ID = 1


def fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """Lengths and how many of each, at most counts, whose sum is the largest that is not above room."""
    full, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & full
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            at -= length * times
            out[length] = out.get(length, 0) + times
    return out


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> number in a sequence) and how many sequences follow each; at most one pattern per length is made."""
    counts, out = {k: v for k, v in histogram.items() if v > 0}, []
    while counts:
        longest = max(counts)
        if not 0 < longest <= window:
            raise ValueError("piece lengths lie between 1 and the window")
        counts[longest] -= 1
        pattern = fill(window - longest, {k: v for k, v in counts.items() if v})
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((pattern, times))
    return out


def ranges(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, one past the last rank, times, first sequence, offset of the first slot)."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n, first = pattern[length], used.get(length, 0)
            out.append((length, first, first + n * times, times, sequence, offset))
            used[length] = first + n * times
            offset += n * length
        sequence += times
    return out


def pack(pieces: DataFrame, window: int = WINDOW, rows_per_rank_group: int = 5_000) -> DataFrame:
    """pieces(doc_id, start, length, ...) -> all columns and sequence_id, offset, in place of columns of those names.

    pieces should be a stored table, as it is read more than once. Lengths must lie between 1 and window. The histogram
    that reaches the driver has at most `window` rows, the ranges that are broadcast at most 64 for each of them.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = ranges(plan(histogram, window))
    schema = "_length long, _from long, _to long, _times long, _first long, _slot long"
    groups = max(1, -(-max(histogram.values(), default=0) // rows_per_rank_group))
    kept = [F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset")]
    order = ["doc_id", "start", *[c for c in ("ids_crc32",) if c in pieces.columns]]
    dealt = pieces.select(F.struct(*kept).alias("_piece"), "length", *order, F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)).alias("_group"))
    sizes = dealt.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_group").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "_group"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    places = F.broadcast(spark.createDataFrame(rows, schema))
    hit = (ranked["length"] == places["_length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    k = F.col("_rank") - F.col("_from")
    return ranked.join(places, hit).select(
        "_piece.*",
        (F.col("_first") + k % F.col("_times")).alias("sequence_id"),
        (F.col("_slot") + F.floor(k / F.col("_times")).cast("long") * F.col("length")).alias("offset"),
    )


def _bytes(ids: list[int]) -> bytes:
    return pack_ids(f"<{len(ids)}I", *ids)


class TextEncoder:
    """Ids of the byte-level BPE of a tokenizers file.

    No token goes from another character into white space, so a text can be cut before each run of white space, and equal
    pieces share their ids: each batch of texts is split at spaces, and only its distinct words are encoded, with the same
    vocabulary as ranks, which gives the same ids faster. Texts with other white space beside a space are cut at the start
    of each run instead; texts that hold the string of a special token go through the tokenizers file whole.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        # The whole tokenizer is needed for texts with special tokens only, and is read again for the first of them.
        self.file = json_path
        self.slow: Tokenizer | None = None
        self.special = tuple(t.content for t in Tokenizer.from_file(json_path).get_added_tokens_decoder().values())

    def whole(self, text: str) -> np.ndarray:
        """Ids of one text."""
        if any(s in text for s in self.special):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.file)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with a space before it, end to end, and each word's first index (n + 1 values)."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        ids = self.fast.encode_to_numpy(" " + line, disallowed_special=()).astype("<u4")
        begins = np.concatenate(([0], np.cumsum(self.size[ids])))
        starts = np.concatenate(([0], np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)))
        return ids, np.searchsorted(begins, starts)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts end to end, and each text's first index (n + 1 values)."""
        texts = texts.fill_null("")
        split = pc.split_pattern(texts, " ")
        first = split.offsets.to_numpy().astype(np.int64)
        first = first - first[0]
        coded = split.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        loose = pc.or_(pc.equal(words, ""), pc.not_equal(pc.utf8_rtrim_whitespace(words), words)).to_numpy(zero_copy_only=False)
        hard = np.add.reduceat(loose[code], first[:-1]) > 0
        for s in self.special:
            hard |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        # The first word of a text has no space before it; a hard text is encoded whole in its place.
        names = words.take(pa.array(code[first[:-1]])).to_pylist()
        heads = [self.whole(texts[i].as_py() if h else w) for i, (h, w) in enumerate(zip(hard.tolist(), names))]
        keep = ~np.repeat(hard, np.diff(first))
        keep[first[:-1]] = False
        used = np.zeros(len(words), dtype=bool)
        used[code[keep]] = True
        pool, at = self.words(words.filter(pa.array(used)))
        size = np.zeros(len(words), dtype=np.int64)
        begin = np.zeros(len(words), dtype=np.int64)
        size[used], begin[used] = np.diff(at), at[:-1]
        # Heads follow the pool of words.
        pool = np.concatenate([pool, *heads])
        head_size = np.fromiter(map(len, heads), dtype=np.int64, count=len(heads))
        code[first[:-1]] = len(words) + np.arange(len(texts))
        keep[first[:-1]] = True
        code = code[keep]
        size, begin = np.concatenate((size, head_size)), np.concatenate((begin, at[-1] + np.cumsum(head_size) - head_size))
        each = size[code]
        end = np.cumsum(each)
        out = pool[np.repeat(begin[code] - (end - each), each) + np.arange(end[-1] if len(end) else 0)]
        pieces = np.concatenate(([0], np.cumsum(np.where(hard, 1, np.diff(first)))))
        return out, np.concatenate(([0], end))[pieces]


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str) -> TextEncoder:
    return TextEncoder(json_path, ranks_path)


def _ranges_of(ends: np.ndarray, size: int = 2_000_000):
    """Ranges of rows of about `size` bytes, given running sums; a larger row is a range of its own."""
    i, n = 0, len(ends)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, side="right")))
        yield i, j
        i = j


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_pieces(docs: DataFrame, paths: tuple[str, str] | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, start, length, ids_crc32, doc_tokens (and ids, binary, if asked for): pieces of at most window ids.

    A document's ids end with END_ID; a null text counts as empty and has that id alone.
    """
    json_path, ranks_path = paths or tokenizer_paths()
    end = _bytes([END_ID])
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")], *[T.StructField("ids", T.BinaryType())] * with_ids])

    def run(batches):
        own = encoder(json_path, ranks_path)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
            for i, j in _ranges_of(sizes):
                ids, first = own.batch(batch.column(1).slice(i, j - i))
                cols: list[list] = [[] for _ in schema]
                at: list[int] = []
                for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist()), i):
                    for s in range(0, b - a + 1, window):
                        part = ids[a + s : min(b, a + s + window)].tobytes()
                        if len(part) < 4 * window:
                            part += end
                        at.append(k)
                        for c, v in zip(cols[1:], (s, len(part) // 4, zlib.crc32(part), b - a + 1, part)):
                            c.append(v)
                arrays = [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, pa.int64()) for c in cols[1:5]], *[pa.array(c, pa.binary()) for c in cols[5:]]]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), schema)


def pack_documents(docs: DataFrame, paths: tuple[str, str] | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    Texts are tokenised once; the pieces are written to the shared folder without their ids. Repeated rows are documents of
    their own. An empty table gives an empty result.
    """
    return pack(stored(token_pieces(docs, paths, window), "pieces", rows_per_batch=1_000), window)
