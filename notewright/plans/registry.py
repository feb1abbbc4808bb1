"""All named queries of the engine and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notewright.functions.text import SPACE
from notewright.plans import queries as Q
from notewright.plans import sql as S

_QUERIES = [
    Q.content_filter, Q.watermark_scan, Q.latest_version, Q.row_violations, Q.wire_mapping, Q.target_parse, Q.normalize_text, Q.derive_title,
    Q.slugify, Q.note_id_order, Q.stem_guard, Q.phone_mask, Q.exact_dedup, Q.vector_norm, Q.similarity_pairs, Q.nearest_neighbor, Q.lsh_signature,
    Q.lsh_pairs, Q.semantic_dedup, Q.master_body, Q.assign_clusters, Q.cluster_centroids, Q.cluster_members, Q.manifest_notes, Q.manifest_counts,
    Q.run_span, Q.run_id, Q.fingerprint, Q.integrity_violations, Q.new_messages_anti, Q.previous_rebuild, Q.incremental_merge, Q.metadata_mismatch,
    Q.vault_files, Q.sidecar_paths, Q.write_skip_prune, Q.projection_stats, Q.basic_tokens, Q.wordpiece_ids, Q.token_hash_embed, Q.rate_limit_window,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with vectors to notes: normalized, deduplicated exactly and by vector, clustered."""
    return Q.manifest_notes(spark, sf_dir)


_REC = "WITH " + S.RECORDS
_BLANK = f"regexp_full_match(text, '{SPACE}*')"
_UNIT = "u AS (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))::FLOAT)::DOUBLE[] AS v, embedding::DOUBLE[] AS e FROM embeddings)"
_BIGS = ", ".join(f"({i}, {'NULL' if k is None else repr(k)}, {i_ if i_ is not None else 'NULL'}, {a if a is not None else 'NULL'}, {'NULL' if u is None else repr(u)})" for i, (k, i_, a, u) in enumerate(S.TARGET_ROWS))
_PREV = """prev AS (
  SELECT source_chat || ':' || source_msg_id AS id, source_chat, source_msg_id, CASE WHEN source_msg_id % 6 = 0 THEN '' ELSE 'some title' END AS title,
    CASE WHEN source_msg_id % 3 = 0 THEN ' ' || chr(10) ELSE '# t' || chr(10) || chr(10) || text END AS body FROM records WHERE source_msg_id <= (SELECT (min(source_msg_id) + max(source_msg_id)) // 2 FROM records))"""
_BODY = rf"nullif(regexp_replace(body, '^{SPACE}+|{SPACE}+$', '', 'g'), '')"
_PLAN = """WITH d AS (SELECT doc_id, 'topics/s/c:' || doc_id || CASE WHEN doc_id % 6 = 0 THEN '.txt' ELSE '.md' END AS path, text FROM documents),
p AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 3 <> 0 AND doc_id % 6 <> 0 THEN 'pruned' END
  WHEN doc_id % 3 <> 0 AND (doc_id % 2 = 0 OR text = 'old') THEN 'skipped' ELSE 'written' END AS status FROM d)
"""
#: The times that were admitted in the window are carried from event to event of a user.
_LIMITS = """WITH RECURSIVE e AS (
  SELECT user_id, event_id, sec, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS r
  FROM (SELECT user_id, event_id, epoch_us(ts::TIMESTAMP) / 1e6 AS sec FROM events WHERE user_id IS NOT NULL)
), walk AS (
  SELECT user_id, event_id, r, true AS allowed, [sec] AS seen FROM e WHERE r = 1
  UNION ALL
  SELECT user_id, event_id, r, len(seen) < 3, CASE WHEN len(seen) < 3 THEN list_append(seen, sec) ELSE seen END
  FROM (SELECT e.user_id, e.event_id, e.r, e.sec, list_filter(w.seen, lambda t: t > e.sec - 86400) AS seen FROM walk w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)
) SELECT user_id, event_id, allowed FROM walk"""
_TOKENS = "regexp_extract_all({0}, '[^\\s\\p{{P}}]+|\\p{{P}}')"
ORACLES: dict[str, str] = {
    "rate_limit_window": _LIMITS,
    "content_filter": f"{_REC} SELECT source_chat, source_msg_id FROM records WHERE kind = 'message' AND NOT {_BLANK} AND media_kind IS NULL",
    "watermark_scan": f"{_REC} SELECT source_chat, source_msg_id, length(text) AS n_chars FROM records WHERE source_msg_id > {S.WATERMARK} ORDER BY source_msg_id DESC LIMIT {S.NEWEST}",
    "latest_version": f"""{_REC} SELECT source_chat, source_msg_id // 3 AS source_msg_id, source_msg_id AS arrival FROM records
        QUALIFY row_number() OVER (PARTITION BY source_chat, source_msg_id // 3 ORDER BY edit_epoch DESC NULLS LAST, date_epoch DESC, source_msg_id) = 1""",
    "row_violations": f"""{_REC}, b AS (SELECT CASE WHEN source_msg_id % 17 = 0 THEN '  ' ELSE source_chat END AS source_chat, CASE WHEN source_msg_id % 29 = 0 THEN 0 ELSE source_msg_id END AS source_msg_id,
        date_epoch, CASE WHEN source_msg_id % 19 = 0 THEN 1 ELSE edit_epoch END AS edit_epoch, CASE WHEN source_msg_id % 23 = 0 THEN -1 ELSE reply_to END AS reply_to FROM records),
        v AS (SELECT source_chat, source_msg_id, CASE WHEN trim(source_chat) = '' THEN 'chat is blank' WHEN source_msg_id <= 0 THEN 'id is not positive' WHEN date_epoch = 0 THEN 'date is missing'
          WHEN edit_epoch < date_epoch THEN 'edited before date' WHEN reply_to <= 0 THEN 'reply id is not positive' END AS rule FROM b) SELECT * FROM v WHERE rule IS NOT NULL""",
    "wire_mapping": """SELECT doc_id + 1 AS source_msg_id, 1704067200 + doc_id AS date_epoch,
        CASE WHEN doc_id % 3 = 0 THEN 'name ' || doc_id WHEN doc_id % 4 = 0 THEN 'author' WHEN doc_id % 5 = 0 THEN 'user:' || doc_id WHEN doc_id % 5 = 1 THEN 'chat:' || doc_id WHEN doc_id % 5 = 2 THEN 'channel:' || doc_id END AS forwarded_from,
        CASE WHEN doc_id % 6 - 1 > 0 THEN doc_id % 6 - 1 END AS reply_to_source_msg_id, CASE WHEN doc_id % 2 = 0 THEN 1704067200 + doc_id + 60 END AS edit_epoch,
        CASE WHEN doc_id % 8 = 1 THEN 'photo' END AS media_kind FROM documents WHERE doc_id % 7 <> 0""",
    "target_parse": f"SELECT n::BIGINT AS n, kind, id::BIGINT AS id, access_hash::BIGINT AS access_hash, username FROM (VALUES {_BIGS}) t(n, kind, id, access_hash, username)",
    "normalize_text": S.upto(S.NORMAL, "SELECT source_msg_id, normalized FROM normal"),
    "derive_title": "WITH " + S.RECORDS.replace("SELECT source AS", "SELECT chr(10) || '> - 2) ' || text || '' AS unused, source AS").replace("text || CASE", "chr(10) || '> - 2) ' || text || CASE") + ",\n" + S.NORMAL + f"\nSELECT source_msg_id, {S.TITLE} AS title FROM normal",
    "slugify": "WITH n AS (SELECT doc_id::VARCHAR AS key, text AS name FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('extra {i}', '{n}')" for i, n in enumerate(S.NAMES)) + f") t(key, name)) SELECT key, {S.slug('name')} AS slug FROM n",
    "note_id_order": f"{_REC} SELECT CASE WHEN source_msg_id % 9 = 0 THEN source_chat || ':x' ELSE source_chat || ':' || source_msg_id END AS note_id, CASE WHEN source_msg_id % 9 <> 0 THEN source_msg_id END AS suffix FROM records",
    "stem_guard": "SELECT n::BIGINT AS n, ok FROM (VALUES " + ", ".join(f"({i}, {str(ok).lower()})" for i, ok in enumerate(S.STEM_OK + S.PATH_OK)) + ") t(n, ok)",
    "phone_mask": "SELECT c_custkey, CASE WHEN length(c_custkey::VARCHAR) > 4 THEN '***' || right(c_custkey::VARCHAR, 4) ELSE c_custkey::VARCHAR END AS masked FROM customer",
    "exact_dedup": S.upto(S.TITLED, "SELECT note_id, hash, m AS exact_master, note_id = m AS is_master FROM (SELECT *, first_value(note_id) OVER (PARTITION BY hash ORDER BY source_msg_id, source_chat) AS m FROM titled)"),
    "vector_norm": f"WITH {_UNIT} SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(list_dot_product(v, e), 4) AS along FROM u",
    "similarity_pairs": f"WITH {_UNIT} SELECT a.vec_id AS later, b.vec_id AS earlier, round(list_dot_product(a.v, b.v), 5) AS sim FROM u a JOIN u b ON b.vec_id < a.vec_id WHERE list_dot_product(a.v, b.v) >= 0.45",
    "nearest_neighbor": f"""WITH {_UNIT} SELECT a.vec_id, b.vec_id AS neighbour, round(list_dot_product(a.v, b.v), 5) AS sim FROM u a JOIN u b ON b.vec_id <> a.vec_id WHERE list_dot_product(a.v, b.v) >= 0.35
        QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) = 1""",
    "lsh_signature": S.signature_sql(),
    "lsh_pairs": f"WITH {_UNIT}, s AS (SELECT u.*, signature FROM u JOIN ({S.signature_sql()}) USING (vec_id)) SELECT a.vec_id AS later, b.vec_id AS earlier, round(list_dot_product(a.v, b.v), 5) AS sim FROM s a JOIN s b ON b.vec_id < a.vec_id AND bit_count(xor(a.signature, b.signature)) <= 1 WHERE list_dot_product(a.v, b.v) >= 0.1",
    "semantic_dedup": S.upto(S.SEMANTIC, "SELECT note_id, exact_master, semantic_master FROM semantic"),
    "master_body": S.upto(S.BODIES, "SELECT note_id, len(additions) AS n_additions, sha256(body) AS hash FROM bodies"),
    "assign_clusters": S.upto(S.CLUSTERS, "SELECT note_id, cluster_id FROM assigned"),
    "cluster_centroids": S.upto(S.NOTES, """SELECT c.id, c.name, c.slug, (SELECT count(*) FROM notes n WHERE n.cluster_id = c.id) AS n_notes, round(list_sum(st.c::DOUBLE[]), 4) AS centroid_sum
        FROM clusters c JOIN (SELECT unnest(state, recursive := true) FROM (SELECT state FROM steps ORDER BY q DESC LIMIT 1)) st ON st.id = c.id"""),
    "cluster_members": S.upto(S.NOTES, "SELECT cluster_id AS id, string_agg(id, ',' ORDER BY source_msg_id, id) AS note_ids FROM notes GROUP BY 1"),
    "manifest_notes": S.upto(S.NOTES, f"SELECT id, title, hash, embedding_id, cluster_id, {S.rfc('created')} AS created_at, {S.rfc('updated')} AS updated_at, duplicate_of FROM notes"),
    "manifest_counts": S.upto(S.NOTES, "SELECT count(*) AS notes, count(*) FILTER (duplicate_of = '') AS canonical_notes, count(*) FILTER (duplicate_of <> '') AS duplicate_notes, count(DISTINCT cluster_id) AS clusters FROM notes"),
    "run_span": f"{_REC} SELECT coalesce(min(date_epoch), 0) AS started, coalesce(max(date_epoch), 0) AS finished, coalesce(max(source_msg_id), 0) AS watermark FROM records",
    "run_id": f"{_REC} SELECT left(sha256('allfixture0bert_tokenized_mean_poolingincremental/streaming/32' || string_agg(source_chat || source_msg_id || text, '' ORDER BY source_msg_id, source_chat)), 16) AS run_id FROM records",
    "fingerprint": S.upto(S.NOTES, """SELECT sha256(array_to_string([1::VARCHAR, 'fixture', '0', 'bert_tokenized_mean_pooling', 64::VARCHAR], chr(0)) || chr(0)
        || (SELECT string_agg(array_to_string([id, hash, cluster_id, title, body, duplicate_of], chr(0)) || chr(0), '' ORDER BY id) FROM notes)
        || (SELECT string_agg(array_to_string([c.id, c.slug, c.name, (SELECT string_agg(n.id, chr(0) ORDER BY n.source_msg_id, n.id) FROM notes n WHERE n.cluster_id = c.id)], chr(0)) || chr(0), '' ORDER BY c.id) FROM clusters c)) AS fingerprint"""),
    "integrity_violations": S.upto(S.NOTES, """, bad AS (SELECT id, source_msg_id, CASE WHEN source_msg_id = 7 THEN 'nowhere' ELSE cluster_id END AS cluster_id, cluster_id AS true_cluster,
          CASE WHEN source_msg_id = 11 THEN 'nobody:1' ELSE duplicate_of END AS duplicate_of FROM notes)
        SELECT 'note has a blank field' AS rule, id AS key FROM bad WHERE source_msg_id = 13
        UNION ALL SELECT 'note''s cluster is missing', id FROM bad WHERE cluster_id NOT IN (SELECT id FROM clusters)
        UNION ALL SELECT 'duplicate of no canonical note', id FROM bad WHERE duplicate_of <> '' AND duplicate_of NOT IN (SELECT id FROM bad WHERE duplicate_of = '')
        UNION ALL SELECT 'duplicate in another cluster', b.id FROM bad b JOIN bad m ON m.id = b.duplicate_of AND m.duplicate_of = '' WHERE m.cluster_id <> b.cluster_id
        UNION ALL SELECT 'cluster lists a foreign note', id FROM bad WHERE cluster_id <> true_cluster
        UNION ALL SELECT 'cluster misses a note', id FROM bad WHERE cluster_id <> true_cluster""").replace("\n, bad AS", ",\nbad AS"),
    "new_messages_anti": f"{_REC} SELECT source_chat || ':' || source_msg_id AS note_id FROM records WHERE source_msg_id > (SELECT (min(source_msg_id) + max(source_msg_id)) // 2 FROM records)",
    "previous_rebuild": f"""{_REC}, {_PREV} SELECT p.source_msg_id, sha256(coalesce(r.text, {_BODY}, nullif(title, ''), p.id)) AS hash, r.edit_epoch FROM prev p LEFT JOIN (SELECT * FROM records WHERE edit_epoch IS NOT NULL) r ON r.source_msg_id = p.source_msg_id""",
    "incremental_merge": f"{_REC} SELECT source_msg_id, CASE WHEN source_msg_id <= (SELECT (min(source_msg_id) + max(source_msg_id)) // 2 FROM records) THEN 1.0 ELSE 2.0 END::DOUBLE AS first, sha256(text) AS hash FROM records",
    "metadata_mismatch": """SELECT doc_id, concat_ws(', ', CASE WHEN doc_id % 5 = 0 THEN 'model_id existing="m" current="m2"' END, CASE WHEN doc_id % 3 <> 1 THEN 'model_hash existing="h' || (doc_id % 3) || '" current="h1"' END,
        CASE WHEN doc_id % 7 = 0 THEN 'model_profile existing="bert_tokenized_mean_pooling" current="string_input_direct"' END) AS mismatches FROM documents""",
    "vault_files": S.upto(S.NOTES, ", " + S.INDEX + " SELECT path, sha256(content) AS hash FROM files"),
    "sidecar_paths": S.upto(S.NOTES, "SELECT '_meta/embeddings/' || id || '.json' AS path, id AS note_id, 64::BIGINT AS dimension FROM notes WHERE duplicate_of = ''"),
    "write_skip_prune": _PLAN + "SELECT path, status FROM p WHERE status IS NOT NULL",
    "projection_stats": _PLAN + "SELECT count(*) FILTER (status = 'written') AS written, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'pruned') AS pruned FROM p",
    "basic_tokens": f"SELECT doc_id, len({_TOKENS.format('text')}) AS n, sha256(array_to_string({_TOKENS.format('text')}, ' ')) AS hash FROM documents",
    "token_hash_embed": f"""WITH t AS (SELECT doc_id, unnest({_TOKENS.format('lower(text)')}) AS token FROM documents),
        c AS (SELECT doc_id, ('0x' || left(md5(token), 8))::BIGINT % 256 AS bucket, count(*) AS n FROM t GROUP BY 1, 2)
        SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c""",
}
