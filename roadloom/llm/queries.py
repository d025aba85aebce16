"""The operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, centroids, chat, hardneg, langid, lattice, mixing, packing, quality, secrets, simhash, toxicity, warc


def _table(name: str, columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: spark.read.parquet(f"{sf}/{name}.parquet").select(*columns.split())


_documents = _table("documents", "doc_id text lang source")
_labels = _table("labels", "doc_id quality toxic")
_embeddings = _table("embeddings", "vec_id embedding")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": lambda s, d: chat.format_documents(_table("conversations", "conv_id turn role text")(s, d)),
    "op2_mix_sources": lambda s, d: mixing.mix_documents(_documents(s, d), _labels(s, d)),
    "op3_simhash": lambda s, d: simhash.simhash_documents(_documents(s, d)),
    "op4_language_id": lambda s, d: langid.predict_documents(_documents(s, d)),
    "op5_packing": lambda s, d: packing.pack_documents(_documents(s, d)),
    "op6_embedding_dedup": lambda s, d: lattice.embedding_links(_embeddings(s, d)),
    "op7_nearest_neighbours": lambda s, d: ann.search_embeddings(_embeddings(s, d)),
    "op8_secret_scan": lambda s, d: secrets.scan_documents(_documents(s, d)),
    "op9_toxicity": lambda s, d: toxicity.score_documents(_documents(s, d), _labels(s, d)),
    "op10_warc": lambda s, d: warc.archive_pages(_table("pages", "page_id url html")(s, d)),
    "op11_hard_negatives": lambda s, d: hardneg.mine_embeddings(_table("embeddings", "vec_id embedding label")(s, d)),
    "op12_centroids": lambda s, d: centroids.cluster(_embeddings(s, d)),
    "op13_quality_rules": lambda s, d: quality.assess(_documents(s, d)),
}

ORACLES: dict[str, str] = {}

#: Targets in order of cap / weight: those before the first fair share that fits its cap take their caps.
ORACLES["op2_mix_sources"] = """WITH sized AS (
  SELECT d.doc_id, d.source, CAST(len(regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CASE l.quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS weight
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id) l ON l.doc_id = d.doc_id),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
tried AS (SELECT k.source AS from_source, (SELECT sum(source_size) FROM sources) - coalesce((SELECT sum(3 * source_size) FROM sources b WHERE 3 * b.source_size * k.w < 3 * k.source_size * b.w), 0) AS rest,
  (SELECT sum(w) FROM sources) - coalesce((SELECT sum(w) FROM sources b WHERE 3 * b.source_size * k.w < 3 * k.source_size * b.w), 0) AS weights, k.source_size, k.w FROM sources k),
level AS (SELECT rest, weights FROM tried WHERE rest * w <= 3 * source_size * weights ORDER BY CAST(source_size AS DOUBLE) / w LIMIT 1),
targets AS (SELECT s.source, s.source_size, CASE WHEN l.rest * s.w <= 3 * s.source_size * l.weights THEN CAST(l.rest AS DOUBLE) * s.w / CAST(l.weights AS BIGINT) ELSE CAST(3 * s.source_size AS DOUBLE) END AS target FROM sources s CROSS JOIN level l),
keyed AS (SELECT z.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
  -ln((CAST(('0x' || substr(md5(CAST(z.doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE)) / CAST(z.weight AS DOUBLE) AS k
  FROM sized z JOIN targets t ON t.source IS NOT DISTINCT FROM z.source),
run AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, target - CAST(epochs * source_size AS DOUBLE) AS rest FROM keyed)
SELECT doc_id, size, source_size, target, size * (epochs + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS taken FROM run"""

_DOT = "list_reduce(list_transform(range(1, len({a}.v) + 1), lambda i: {a}.v[i] * {b}.v[i]), lambda p, q: p + q)"
_AS_DOUBLE = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"

ORACLES["op7_nearest_neighbours"] = f"""WITH e AS ({_AS_DOUBLE}), n AS (SELECT e.vec_id, e.v, sqrt({_DOT.format(a='e', b='e')}) AS norm FROM e),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, {_DOT.format(a='a', b='b')} / (a.norm * b.norm) AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""

ORACLES["op6_embedding_dedup"] = f"""WITH RECURSIVE e AS ({_AS_DOUBLE}), n AS (SELECT e.vec_id, e.v, sqrt({_DOT.format(a='e', b='e')}) AS norm FROM e),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE {_DOT.format(a='a', b='b')} / (a.norm * b.norm) >= CAST(0.95 AS DOUBLE)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT n.vec_id, (SELECT count(*) FROM links WHERE a = n.vec_id) AS n_links, least(n.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = n.vec_id), n.vec_id)) AS component_id,
  n.vec_id <= coalesce((SELECT min(b) FROM reach WHERE a = n.vec_id), n.vec_id) AS kept FROM n"""

ORACLES["op10_warc"] = """WITH d AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first_page FROM d WHERE bytes >= 100 GROUP BY digest)
SELECT d.page_id, d.bytes AS payload_bytes, d.digest AS payload_digest, CASE WHEN f.first_page <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_page <> d.page_id THEN f.first_page END AS refers_to
FROM d LEFT JOIN f ON f.digest = d.digest AND d.bytes >= 100"""

#: Known roles have names of their own; a text with a control string has each of them escaped by one more code point.
ORACLES["op1_chat_format"] = """WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
sized AS (SELECT *, length('### ') + length(CASE WHEN role IN ('user', 'assistant', 'system', 'tool') THEN role ELSE CAST(to_json(role) AS VARCHAR) END) + length(': ') + length(text) + length(chr(10) || '</turn>' || chr(10))
  + len(regexp_extract_all(text, '###|</turn>')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

_WHOLE = "list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT))"
_FINE = "vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_PRODUCT = "CAST(list_sum(list_transform(range(1, len({a}.v) + 1), lambda i: {a}.v[i] * {b}.v[i])) AS BIGINT)"

ORACLES["op11_hard_negatives"] = f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE.format(factor=256)} AS v FROM embeddings WHERE label IS NOT NULL AND {_FINE}),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, {_PRODUCT.format(a='a', b='b')} AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM scored WHERE same) WHERE k <= 5),
ranked AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5"""


def _rounds(k: int, rounds: int, dims: int) -> str:
    """Each round as SQL of its own: the nearest centroid by rank, and sums of components one by one."""
    far = "CAST(list_sum(list_transform(range(1, {0}), lambda i: (e.v[i] - c.v[i]) * (e.v[i] - c.v[i]))) AS BIGINT)".format(dims + 1)
    out = [f"""e AS MATERIALIZED (SELECT vec_id, {_WHOLE.format(factor=1024)} AS v FROM embeddings WHERE {_FINE} AND len(embedding) = {dims})""",
           f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, v FROM (SELECT sha256(concat('3:', vec_id)) AS h, v FROM e ORDER BY h LIMIT {k}))"]
    for t in range(rounds + 1):
        out.append(f"a{t} AS MATERIALIZED (SELECT vec_id, v, c, d FROM (SELECT e.vec_id, e.v, c.c, {far} AS d, row_number() OVER (PARTITION BY e.vec_id ORDER BY {far}, c.c) AS k FROM e CROSS JOIN c{t} c) WHERE k = 1)")
        if t < rounds:
            out.append(f"""s{t} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{t}) GROUP BY c, i),
m{t} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{t} GROUP BY c),
c{t + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{t} o LEFT JOIN m{t} m USING (c))""")
    return ",\n".join(out)


ORACLES["op12_centroids"] = f"""WITH {_rounds(8, 10, 64)},
inside AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a10 GROUP BY c)
SELECT a.vec_id, a.c AS cluster, a.d AS distance, i.cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM a10) AS inertia, sha256(array_to_string(c10.v, ',')) AS centroid_sha256
FROM a10 a JOIN inside i ON i.c = a.c JOIN c10 ON c10.c = a.c"""
