"""The operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import chat_format, decontaminate, langid, media_chunks, ngram_join, piece_bpe, quality_fm, secret_scan, shards, spelling, substring_dedup, suffix_dedup, turn_repair


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Place of the vocabulary of `op10` and of the pipeline: the public tokenizers installed beside Python."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated(table(spark, sf_dir, "documents")).drop("kept")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.format_turns(turns), dealt=True)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return quality_fm.score(docs, quality_fm.fit(docs, table(spark, sf_dir, "labels")))


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.store_and_read(table(spark, sf_dir, "documents"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.repair_digests(conversations, turn_repair.damage(conversations))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(spelling.word_counts(table(spark, sf_dir, "documents")))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    steps = [op1_language_id, op2_substring_dedup, op3_chat_format, op4_ngram_join, op5_secret_scan, op6_quality, op7_media_chunks, op8_shards, op9_decontaminate, op10_piece_bpe, op11_turn_repair, op12_spelling, op13_suffix_dedup, pipeline]
    return {f.__name__: f for f in steps}


#: Words, windows of 50 and their first documents, in plain SQL.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS m FROM win) WHERE doc_id > m),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM rep),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN cov USING (doc_id, p) GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


#: Every turn's marks, role and escaped text are counted; a conversation is valid if its roles follow the turn order.
OP3_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, 2 * length(role) - length(translate(role, '<[\\', '')) + 2 * length(text) - length(translate(text, '<[\\', '')) + 23 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, regexp_matches(string_agg(role || ',', '' ORDER BY turn, role), '^(system,)?(user,assistant,)+$') AS valid
FROM e GROUP BY conv_id
"""

#: Sets of five words, all pairs that share one, and what is reached over links; for tables of a few thousand rows.
OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') || chr(10) END AS s
  FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) ELSE [1] END) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 10 * k >= 8 * (p.n + q.n - k)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
same AS (SELECT array_to_string(w, ' ') AS t, count(*) AS n_copies FROM d WHERE len(w) > 0 GROUP BY 1)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = d.doc_id), d.doc_id)) AS class_id, coalesce(same.n_copies, 1) AS n_copies, coalesce((SELECT count(*) FROM l WHERE l.x = d.doc_id), 0) AS n_links
FROM d LEFT JOIN same ON same.t = array_to_string(d.w, ' ') AND len(d.w) > 0
"""

#: Matches and what lies between them give the places; RE2's first match is the longest one for these expressions.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
rules(k, kind, re, value, least) AS (VALUES
  (0, 'assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', '[:=]\x20*["'']?(.+)$', 12),
  (1, 'access', 'AKIA[A-Z0-9]+', '(.+)', 18),
  (2, 'hex', '[0-9a-f]+', '(.+)', 16),
  (3, 'jwt', 'eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', '(.+)', 1),
  (4, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----', '(.+)', 1)),
m AS (SELECT doc_id, k, kind, value, least, regexp_extract_all(t, re) AS ms, string_split_regex(t, re) AS ps FROM d, rules),
e AS (SELECT doc_id, k, kind, value, least, unnest(ms) AS found, unnest(ps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM m),
p AS (SELECT *, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id, k ORDER BY i) AS past FROM e),
s AS (SELECT doc_id, k, past - length(found) AS first, kind || ':' || (past - length(found)) || ':' || past AS span FROM p WHERE length(regexp_extract(found, value, 1)) >= least)
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY first, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY first, k), '') AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""

#: The picture's bytes in hexadecimal; the checksum takes the bits of the last 16 one by one.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, strlen(t) AS n_bytes, greatest(1, (strlen(t) + 191) // 192) AS lines, t || repeat(' ', 192 * greatest(1, (strlen(t) + 191) // 192) - strlen(t)) AS p FROM d),
m AS (SELECT *, 'P5' || chr(10) || '192 ' || lines || chr(10) || '255' || chr(10) || p AS media, regexp_extract_all(hex(encode(p)), '..') AS x FROM p),
b AS (SELECT doc_id, ('0x' || h)::INT AS v, c FROM (SELECT doc_id, h, count(*) AS c FROM (SELECT doc_id, unnest(x) AS h FROM m) GROUP BY ALL)),
a AS (SELECT doc_id, sum(v * c) / sum(c) AS mean, sum(c) AS n FROM b GROUP BY doc_id),
f AS (SELECT doc_id, any_value(mean) AS mean, sqrt(sum(c * (v - mean) * (v - mean)) / any_value(n)) AS std, list_transform(range(8), lambda g: coalesce(list_sum(list_transform(list_filter(list({'v': v, 'c': c}), lambda y: y.v // 32 = g), lambda y: y.c)), 0) / any_value(n)) AS shares FROM b JOIN a USING (doc_id) GROUP BY doc_id),
w AS (SELECT doc_id, flatten(list_transform(x[-16:], lambda h: list_transform(range(8), lambda i: (('0x' || h)::BIGINT >> i) & 1))) AS bits FROM m)
SELECT doc_id, n_bytes, strlen(p) AS payload_bytes, sha256(p) AS payload_sha256,
  xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1))), 4294967295) AS tail_crc32,
  strlen(media) AS media_bytes, sha256(media) AS media_sha256,
  printf('mean=%.4f;std=%.4f;hist=', mean, std) || array_to_string(list_transform(shares, lambda s: printf('%.4f', s)), ',') AS feature
FROM m JOIN f USING (doc_id) JOIN w USING (doc_id)
"""

def _step(state: str, cost: int | str, edit: str, line: str | None = None) -> str:
    """SQL for the state of a conversation after one edit; null if it cannot be reached."""
    lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {lines}}} END"


def _least(*states: str) -> str:
    return f"list_sort(list_filter([{', '.join(states)}], lambda x: x IS NOT NULL))[1]"


#: Turn by turn, the cheapest edits up to each state of the grammar: nothing, after a system, a user, an assistant turn.
OP11_SQL = rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS tab),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM conversations),
h AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, x: xor(s >> 8, tab[(xor(s, x) & 255) + 1])), 4294967295) % 20 AS h FROM k, crc),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER w AS p, left(role, 1) AS i, lag(left(role, 1)) OVER w AS before, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS e FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate' WHEN e NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
q AS (SELECT *, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra, fault IN ('blank', 'duplicate') AS gone FROM f),
r AS (SELECT conv_id, 0::BIGINT AS p, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR[]) AS s1, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR[]) AS s2, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR[]) AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, p, {_step("s0", 2, "D")}, {_least(_step("s1", 2, "D"), "CASE WHEN NOT gone AND i = 's' THEN " + _step("s0", "extra", "K", "role || ':' || text") + " END")},
    {_least(_step("i2", 2, "D"), *["CASE WHEN NOT gone THEN " + _step(s, "extra + 1", "R", "'user:' || text") + " END" for s in ("s0", "s1", "i3")], *["CASE WHEN NOT gone AND i = 'u' THEN " + _step(s, "extra", "K", "role || ':' || text") + " END" for s in ("s0", "s1", "i3")])},
    {_least(_step("i3", 2, "D"), "CASE WHEN NOT gone THEN " + _step("i2", "extra + 1", "R", "'assistant:' || text") + " END", "CASE WHEN NOT gone AND i = 'a' THEN " + _step("i2", "extra", "K", "role || ':' || text") + " END")}
  FROM (SELECT *, {_least("s3", _step("i2", 5, "I", "'assistant:'"))} AS i3 FROM (SELECT q.*, s0, s1, s2, s3, {_least("s2", *[_step(s, 5, "I", "'user:'") for s in ("s0", "s1", "s3")])} AS i2 FROM r JOIN q ON q.conv_id IS NOT DISTINCT FROM r.conv_id AND q.p = r.p + 1))),
z AS (SELECT conv_id, {_least("s0", "s3", _step("s2", 5, "I", "'assistant:'"), _step("s1", 10, "II", "'user:' || chr(10) || 'assistant:'"))} AS s FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) AS final FROM r) WHERE final = 1),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM q GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, s.c::BIGINT AS cost, s.a AS audit, sha256(array_to_string(s.t, chr(10))) AS repaired_sha256
FROM z LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM z.conv_id
"""


#: Words one deletion apart, or with one deletion in the same place, are one edit apart; the checksum goes by a table.
OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS tab),
runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT run, c, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM runs),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, x: xor(s >> 8, tab[(xor(s, x) & 255) + 1])), 4294967295) AS h FROM b, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
g AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, unnest(range(length(word)))::INT AS i FROM v)),
e AS (SELECT a.word, b.word AS near FROM g a JOIN g b ON a.i = b.i AND a.less = b.less AND a.word <> b.word UNION SELECT g.word, v.word FROM g JOIN v ON v.word = g.less UNION SELECT v.word, g.word FROM g JOIN v ON v.word = g.less),
m AS (SELECT e.word, count(*) AS n_near, max(v.n) AS most FROM e JOIN v ON v.word = e.near GROUP BY e.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * v.n THEN (SELECT min(e.near) FROM e JOIN v x ON x.word = e.near WHERE e.word = v.word AND x.n = most) END AS form, CASE WHEN most >= 10 * v.n THEN most END AS form_n FROM v LEFT JOIN m USING (word)),
r AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT r.word, f.form, steps + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, form, (SELECT max_by(root, steps) FROM r WHERE r.word = f.word) AS root, n, n_near, form_n FROM f
"""

#: Digests of all byte strings of 200, and the runs of bytes that those which occur twice cover.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT k, i, md5(b[i + 1:i + 200]) AS h FROM (SELECT k, b, unnest(range(octet_length(b) - 199)) AS i FROM d)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
g AS (SELECT k, i, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS g FROM (SELECT k, i, CASE WHEN i - lag(i) OVER (PARTITION BY k ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM r)),
s AS (SELECT k, g, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY k, g),
p AS (SELECT k, a, z, lag(z, 1, 0) OVER (PARTITION BY k ORDER BY a) AS past, row_number() OVER (PARTITION BY k ORDER BY a DESC) = 1 AS final FROM s),
t AS (SELECT k, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(hex(b[past + 1:a]), '' ORDER BY a) || any_value(hex(b[z + 1:octet_length(b)])) FILTER (final) AS kept FROM p JOIN d USING (k) GROUP BY k)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(unhex(kept), b)) AS kept_sha256
FROM d LEFT JOIN t USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op3_chat_format": OP3_SQL, "op4_ngram_join": OP4_SQL, "op5_secret_scan": OP5_SQL, "op7_media_chunks": OP7_SQL, "op11_turn_repair": OP11_SQL, "op12_spelling": OP12_SQL, "op13_suffix_dedup": OP13_SQL}
