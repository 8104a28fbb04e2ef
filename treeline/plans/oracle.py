"""DuckDB SQL equivalents of the registered queries (same column names).

Views ``region nation customer supplier part orders lineitem events
documents embeddings pages benchmark labels conversations`` are assumed.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# Tokens of documents.text: lower-case, split on non letter/digit runs.
_TOKS = r"""toks AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t
  FROM documents)"""

_POSTINGS = _TOKS + r""",
post AS (
  SELECT doc_id, 0::INTEGER AS field, unnest(range(len(t)))::INTEGER AS pos, unnest(t) AS token, len(t)::BIGINT AS dl
  FROM toks)"""

ORACLE["x1_postings"] = "WITH " + _POSTINGS + "\nSELECT doc_id, field, pos, token, dl FROM post"


def _bm25_top(limit: int) -> str:
    return "WITH " + _POSTINGS + f""",
occ AS (
  SELECT a.doc_id, a.dl, count(*)::BIGINT AS tf
  FROM post a JOIN post b ON a.doc_id = b.doc_id AND a.field = b.field AND b.pos = a.pos + 1
  WHERE a.token = 'the' AND b.token = 'on'
  GROUP BY a.doc_id, a.dl),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM toks),
dfc AS (SELECT count(*) AS df FROM occ),
sc AS (
  SELECT doc_id, tf, dl,
         CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6
              ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END
         * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score
  FROM occ, st, dfc),
fts AS (SELECT doc_id, tf, dl, score FROM sc ORDER BY score DESC, doc_id LIMIT {limit})"""


ORACLE["x2_phrase_bm25"] = _bm25_top(20) + "\nSELECT doc_id, tf, dl, round(score, 6) AS score FROM fts"

_KNN = """knn_q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id = 0),
knn_d AS (
  SELECT q.query_id, e.vec_id AS id,
         list_sum(list_transform(range(1, len(e.embedding) + 1),
                  lambda i: (e.embedding[i]::DOUBLE - q.qv[i]::DOUBLE) * (e.embedding[i]::DOUBLE - q.qv[i]::DOUBLE))) AS distance
  FROM embeddings e, knn_q q),
knn_r AS (
  SELECT query_id, id, distance, 1.0 / (1.0 + distance) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank
  FROM knn_d)"""

ORACLE["x5_knn"] = "WITH " + _KNN + """
SELECT query_id, id, round(distance, 6) AS distance, round(score, 6) AS score, rank
FROM knn_r WHERE rank <= 10"""


def _hybrid(limit: int, semantic: bool) -> str:
    sem = f"""sem AS (
  SELECT id, score AS sem_score FROM knn_r
  WHERE rank <= {2 * limit} AND id IN (SELECT doc_id FROM documents))""" if semantic else \
        "sem AS (SELECT NULL::BIGINT AS id, NULL::DOUBLE AS sem_score WHERE false)"
    return _bm25_top(2 * limit) + ",\n" + _KNN + f""",
fr AS (
  SELECT doc_id AS id,
         1.0 - (row_number() OVER (ORDER BY score DESC, doc_id) - 1) / greatest(count(*) OVER (), 1) AS fts_score
  FROM fts),
{sem},
m AS (
  SELECT coalesce(fr.id, sem.id) AS id, coalesce(fts_score, 0.0) AS fts_score, coalesce(sem_score, 0.0) AS sem_score
  FROM fr FULL OUTER JOIN sem ON fr.id = sem.id),
h AS (SELECT id, fts_score, sem_score, 0.3 * fts_score + 0.7 * sem_score AS score FROM m
      ORDER BY score DESC, id LIMIT {limit})
SELECT id, round(fts_score, 6) AS fts_score, round(sem_score, 6) AS sem_score, round(score, 6) AS score FROM h"""


ORACLE["x6_hybrid"] = _hybrid(10, True)
ORACLE["x11_hybrid_no_vectors"] = _hybrid(10, False)
