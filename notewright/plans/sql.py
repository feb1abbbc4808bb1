"""SQL with the meaning of the registered queries, for an engine that has the tables as views."""

from __future__ import annotations

from notewright.functions.text import CYRILLIC, SPACE
from notewright.functions.vectors import hyperplanes

DEDUP, CLUSTER = 0.40, 0.30
WATERMARK, NEWEST = 200, 300

RECORDS = """records AS (
  SELECT source AS source_chat, doc_id + 1 AS source_msg_id, 1704067200 + doc_id * 3600 AS date_epoch,
    text || CASE doc_id % 4 WHEN 0 THEN '  ' || chr(13) || chr(10) || chr(13) || chr(10) || ' ' || chr(9) || chr(10) || 'end' || chr(10)
      WHEN 1 THEN chr(13) || 'cafe' || chr(769) ELSE '' END AS text,
    CASE WHEN doc_id % 11 = 0 THEN 'service' ELSE 'message' END AS kind,
    CASE WHEN doc_id % 13 = 0 THEN 'photo' END AS media_kind,
    CASE WHEN doc_id % 5 = 0 THEN 1704067200 + doc_id * 3600 + 7200 END AS edit_epoch,
    CASE WHEN doc_id % 3 = 0 THEN doc_id END AS reply_to
  FROM documents)"""

NORMAL = f"""normal AS (
  SELECT *, source_chat || ':' || source_msg_id AS note_id,
    trim(regexp_replace(array_to_string(list_transform(string_split(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))), chr(10)),
      lambda x: CASE WHEN regexp_full_match(x, '{SPACE}*') THEN '' ELSE rtrim(x, ' ' || chr(9)) END), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS normalized
  FROM records)"""

LEAD = rf"^(?:{SPACE}*(?:>|[-*+](?:[ \t]|$)|[0-9]+[.)](?:[ \t]|$)))*{SPACE}*"
TITLE = rf"""coalesce(substr(list_filter(list_transform(string_split(normalized, chr(10)),
      lambda x: regexp_replace(regexp_replace(x, '{LEAD}', ''), '(?:[.:]|{SPACE})+$', '')), lambda x: x <> '')[1], 1, 72), 'untitled-' || source_msg_id)"""


def slug(x: str) -> str:
    both = CYRILLIC | {k.upper(): v for k, v in CYRILLIC.items()}
    single = {k: v for k, v in both.items() if len(v) == 1}
    out = f"translate({x}, '{''.join(single)}ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{''.join(single.values())}abcdefghijklmnopqrstuvwxyz')"
    for k, v in both.items():
        if len(v) != 1:
            out = f"replace({out}, '{k}', '{v}')"
    return f"coalesce(nullif(trim(regexp_replace({out}, '[^a-z0-9]+', '-', 'g'), '-'), ''), 'cluster-untitled')"


TITLED = f"titled AS (SELECT *, sha256(normalized) AS hash, {TITLE} AS title FROM normal)"
EMBEDDED = """embedded AS (
  SELECT t.*, list_transform(e.embedding, lambda x: (x::DOUBLE / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])))::FLOAT) AS v
  FROM titled t JOIN embeddings e ON e.vec_id = t.source_msg_id - 1)"""
EXACT = """exact AS (
  SELECT *, first_value(note_id) OVER (PARTITION BY hash ORDER BY source_msg_id, source_chat) AS exact_master FROM embedded)"""
SEMANTIC = f"""firsts AS (SELECT *, row_number() OVER (ORDER BY source_msg_id, source_chat) AS r FROM exact WHERE note_id = exact_master),
near AS (SELECT a.r AS later, b.r AS earlier, list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[]) AS sim FROM firsts a JOIN firsts b ON b.r < a.r
  WHERE list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[]) >= {DEDUP}),
lists AS (SELECT later, list(earlier) AS nb FROM near GROUP BY later),
walk AS (
  SELECT 0::BIGINT AS r, []::BIGINT[] AS masters
  UNION ALL
  SELECT w.r + 1, CASE WHEN list_has_any(coalesce(l.nb, []::BIGINT[]), w.masters) THEN w.masters ELSE list_append(w.masters, w.r + 1) END
  FROM walk w JOIN firsts f ON f.r = w.r + 1 LEFT JOIN lists l ON l.later = f.r),
chosen AS (SELECT unnest(masters) AS r FROM (SELECT masters FROM walk ORDER BY r DESC LIMIT 1)),
led AS (
  SELECT r, r AS master FROM chosen
  UNION ALL
  SELECT later, (min(struct_pack(far := -sim, earlier := earlier))).earlier FROM near JOIN chosen ON chosen.r = earlier
  WHERE later NOT IN (SELECT r FROM chosen) GROUP BY later),
semantic AS (
  SELECT e.*, m.note_id AS semantic_master FROM exact e JOIN firsts f ON f.note_id = e.exact_master JOIN led ON led.r = f.r JOIN firsts m ON m.r = led.master)"""
BODIES = """additions AS (
  SELECT semantic_master, list(normalized ORDER BY i, c) AS additions FROM (
    SELECT semantic_master, normalized, (min(struct_pack(i := source_msg_id, c := source_chat))).i AS i, (min(struct_pack(i := source_msg_id, c := source_chat))).c AS c
    FROM semantic WHERE note_id = exact_master AND note_id <> semantic_master AND normalized <> '' GROUP BY ALL) GROUP BY 1),
bodies AS (
  SELECT s.*, coalesce(a.additions, []) AS additions,
    '# ' || title || CASE WHEN normalized <> '' THEN chr(10) || chr(10) || normalized ELSE '' END
    || CASE WHEN a.additions IS NULL THEN '' ELSE chr(10) || chr(10) || '## Additions' || chr(10) || chr(10)
      || array_to_string(list_transform(a.additions, lambda x: '- ' || replace(x, chr(10), chr(10) || '  ')), chr(10)) END AS body
  FROM semantic s LEFT JOIN additions a USING (semantic_master) WHERE note_id = s.semantic_master)"""
CLUSTERS = f"""ms AS (
  SELECT note_id, v, 'cluster-' || {slug('source_chat')} || '-' || source_msg_id AS own, row_number() OVER (ORDER BY source_msg_id, source_chat) AS q FROM bodies),
steps AS (
  SELECT 0::BIGINT AS q, NULL::VARCHAR AS note_id, NULL::VARCHAR AS cluster_id, []::STRUCT(id VARCHAR, n BIGINT, total DOUBLE[], c FLOAT[])[] AS state
  UNION ALL
  SELECT q, note_id, coalesce(best, own),
    CASE WHEN best IS NULL THEN list_append(state, struct_pack(id := own, n := 1::BIGINT, total := v::DOUBLE[], c := v::FLOAT[]))
    ELSE list_transform(state, lambda s: CASE WHEN s.id = best THEN struct_pack(id := s.id, n := s.n + 1,
      total := list_transform(list_zip(s.total, v::DOUBLE[]), lambda z: z[1] + z[2]),
      c := list_transform(list_transform(list_zip(s.total, v::DOUBLE[]), lambda z: ((z[1] + z[2]) / (s.n + 1))::FLOAT), lambda m: (m::DOUBLE / sqrt(
        list_dot_product(list_transform(list_zip(s.total, v::DOUBLE[]), lambda z: ((z[1] + z[2]) / (s.n + 1))::FLOAT::DOUBLE),
                         list_transform(list_zip(s.total, v::DOUBLE[]), lambda z: ((z[1] + z[2]) / (s.n + 1))::FLOAT::DOUBLE))))::FLOAT)) ELSE s END) END
  FROM (
    SELECT m.q, m.note_id, m.own, m.v, s.state,
      (list_sort(list_filter(list_transform(s.state, lambda x: struct_pack(k := -list_dot_product(x.c::DOUBLE[], m.v::DOUBLE[]), id := x.id)), lambda x: x.k <= -{CLUSTER}))[1]).id AS best
    FROM steps s JOIN ms m ON m.q = s.q + 1)),
assigned AS (SELECT note_id, cluster_id FROM steps WHERE q > 0)"""
NOTES = f"""placed AS (SELECT s.*, a.cluster_id FROM semantic s JOIN assigned a ON a.note_id = s.semantic_master),
notes AS (
  SELECT p.note_id AS id, p.source_chat, p.source_msg_id, p.title, b.body, sha256(b.body) AS hash, 'fixture' AS embedding_id, p.cluster_id, p.v,
    p.date_epoch AS created, greatest(p.date_epoch, coalesce(p.edit_epoch, p.date_epoch)) AS updated,
    CASE WHEN p.note_id = p.semantic_master THEN '' ELSE p.semantic_master END AS duplicate_of
  FROM placed p JOIN bodies b ON b.note_id = p.semantic_master),
clusters AS (
  SELECT b.title AS name, a.cluster_id AS id, {slug('b.title')} || '-' || {slug('b.source_chat')} || '-' || b.source_msg_id AS slug
  FROM assigned a JOIN bodies b USING (note_id) WHERE a.cluster_id = 'cluster-' || {slug('b.source_chat')} || '-' || b.source_msg_id)"""

CHAIN = [RECORDS, NORMAL, TITLED, EMBEDDED, EXACT, SEMANTIC, BODIES, CLUSTERS, NOTES]


def upto(last: str, query: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(CHAIN[: CHAIN.index(last) + 1]) + "\n" + query


def rfc(epoch: str) -> str:
    return f"strftime(make_timestamp({epoch} * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


QUOTED = "'\"' || replace(replace({0}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"'"
LITERAL = "array_to_string(list_transform(string_split(body, chr(10)), lambda x: CASE WHEN x = '' THEN '' ELSE '  ' || x END), chr(10))"
MARKDOWN = (
    "'---' || chr(10) || 'id: ' || n.id || chr(10) || 'source_chat: ' || " + QUOTED.format("n.source_chat") + " || chr(10) || 'source_msg_id: ' || source_msg_id || chr(10) || 'title: ' || " + QUOTED.format("title")
    + " || chr(10) || 'body: |-' || chr(10) || " + LITERAL + " || chr(10) || 'hash: ' || hash || chr(10) || 'embedding_id: ' || embedding_id || chr(10) || 'cluster_id: ' || cluster_id || chr(10) || 'tags: []' || chr(10) || 'created_at: ' || "
    + rfc("created") + " || chr(10) || 'updated_at: ' || " + rfc("updated") + " || chr(10) || 'duplicate_of: ' || " + QUOTED.format("duplicate_of") + " || chr(10) || '---' || chr(10) || body"
)
INDEX = """dups AS (SELECT cluster_id, duplicate_of AS id, string_agg('    - `' || id || '`' || chr(10), '' ORDER BY source_msg_id, id) AS d FROM notes WHERE duplicate_of <> '' GROUP BY 1, 2),
entries AS (
  SELECT n.cluster_id, string_agg('- [' || title || '](' || n.id || '.md)' || chr(10) || coalesce('  - duplicates:' || chr(10) || d, ''), '' ORDER BY source_msg_id, n.id) AS e
  FROM notes n LEFT JOIN dups USING (cluster_id, id) WHERE duplicate_of = '' GROUP BY 1),
files AS (
  SELECT 'topics/' || c.slug || '/index.md' AS path, '# ' || c.name || chr(10) || chr(10) || '## Canonical notes' || chr(10) || chr(10) || e AS content FROM clusters c JOIN entries ON cluster_id = c.id
  UNION ALL
  SELECT 'topics/' || c.slug || '/' || n.id || '.md', """ + MARKDOWN + """ FROM notes n JOIN clusters c ON c.id = n.cluster_id WHERE duplicate_of = '')"""


def signature_sql(dim: int = 64) -> str:
    planes = ", ".join("[" + ", ".join(str(int(x)) for x in row) + "]" for row in hyperplanes(dim))
    return f"""SELECT vec_id, list_sum(list_transform(range(32), lambda p: CASE WHEN list_dot_product(embedding::DOUBLE[], planes[p + 1]::DOUBLE[]) >= 0 THEN 1::BIGINT << p ELSE 0 END))::BIGINT AS signature
FROM embeddings, (SELECT [{planes}] AS planes)"""


TARGETS = ["@name", " @ ", "username:@bob", "username: ", "chat:42", "chat:-1001234", "chat:-5", "user:7:99", "user:7", "user:-7:9", "channel:8:-3", "42", "-100777", "-100", "0", "plain", "a:b", "", "CHAT: 9 ", "99999999999999999999"]
#: Worked out by hand from the rules: kind, id, access hash, name.
TARGET_ROWS = [
    ("username", None, None, "name"), (None, None, None, None), ("username", None, None, "bob"), (None, None, None, None), ("chat", 42, None, None),
    ("channel_peer_id", 1234, None, None), (None, None, None, None), ("user", 7, 99, None), (None, None, None, None), (None, None, None, None),
    ("channel", 8, -3, None), ("chat", 42, None, None), ("channel_peer_id", 777, None, None), (None, None, None, None), (None, None, None, None),
    ("username", None, None, "plain"), ("username", None, None, "a:b"), (None, None, None, None), ("chat", 9, None, None), ("username", None, None, "99999999999999999999"),
]
NAMES = ["Привет, Мир!", "Étion", "Щука и ёж", "  --a  B--  ", "объём", "***", "Straße 12", "ЖЮ_x"]
STEMS = ["chat:1", " chat", "a/b", "a\\b", ".", "..", "", "a\u0007b", "ok name", "tab\t", "a\u0085"]
STEM_OK = [True, False, False, False, False, False, False, False, True, False, False]
PATHS = ["_meta/embeddings/a:1.json", "_meta/embeddings/x.txt", "topics/s/index.md", "topics/s/a:1.md", "topics/s/plain.md", "topics/index.md", "other/index.md", "topics/a:b/c.md"]
PATH_OK = [True, False, True, True, False, True, False, False]
