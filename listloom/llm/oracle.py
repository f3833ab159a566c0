"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import math

from . import quality_rules as rules
from .license_scan import BLOCK, PHRASES, STEP, TEMPLATES, THRESHOLD

def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _op2() -> str:
    """Base phrases place by place, and every template against every block of words."""
    places = []
    for phrase in PHRASES:
        parts = phrase.split(" ")
        places.append(
            f"list_filter(range(0, greatest(0, len(w) - {len(parts) - 1})), lambda i: "
            + " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
            + ")"
        )
    rows = []
    for k, (label, text) in enumerate(TEMPLATES):
        own = sorted(set(text.split(" ")))
        rows.append(f"({k}, '{label}', {_list(own)}, {math.ceil(THRESHOLD * len(own) - 1e-9)})")
    has = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{v}' END" for k, v in enumerate(PHRASES.values()))
    ps = [f"p{k}" for k in range(len(PHRASES))]
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), found AS (
  SELECT *, {', '.join(f'{x} AS p{k}' for k, x in enumerate(places))} FROM texts
), base AS (
  SELECT *, list_concat({', '.join(ps)}) AS p, list_filter([{has}], lambda x: x IS NOT NULL) AS b FROM found
), templates(template, label, own, need) AS (VALUES {', '.join(rows)}),
blocks AS (
  SELECT uid, list_distinct(w[i + 1:i + {BLOCK}]) AS block
  FROM (SELECT uid, w, unnest(range(0, greatest(0, len(w) - 1 - {BLOCK - STEP}) + 1, {STEP})) AS i FROM texts)
), met AS (
  SELECT uid, label, len(list_intersect(own, block)) / len(own) AS share
  FROM blocks, templates WHERE len(list_intersect(own, block)) >= need
), labels AS (SELECT uid, list(DISTINCT label) AS found, max(share) AS share FROM met GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, len(p)::BIGINT AS n_base, list_min(p)::BIGINT AS first_word,
       list_max(p)::BIGINT AS last_word, array_to_string(list_sort(list_distinct(b)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(b, coalesce(found, [])))), ',') AS labels,
       CASE WHEN len(b) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM base LEFT JOIN labels USING (uid)
"""


OP3 = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
       text_sha256
FROM rows
"""


OP4 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, greatest(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')), ceil(strlen(text) / 16)::BIGINT) + 4 AS cost,
    17 + len(role) + len(regexp_replace(replace(text, '\', '\\'),
      '<(\||/?s>|</?SYS>|/?SYS>|bos>|eos>|pad>|start_of_turn>|end_of_turn>)|\[(/?INST\]|/?SYS\])', '<x\1\2', 'g')) AS size
  FROM turns
), placed AS (
  SELECT *, row_number() OVER w - 1 AS pos, coalesce(sum(cost) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    first_value(CASE WHEN role = 'system' THEN cost END) OVER w AS system_cost,
    first_value(CASE WHEN role = 'system' THEN size END) OVER w AS system_size
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), celled AS (SELECT *, floor(start / greatest(256, 512 - coalesce(system_cost, 0))) AS cell FROM placed),
cut AS (
  SELECT *, sum(coalesce(cell <> before OR cost > 256 OR cost_before > 256, false)::INT) OVER (PARTITION BY conv_id ORDER BY start) AS part
  FROM (SELECT *, lag(cell) OVER v AS before, lag(cost) OVER v AS cost_before FROM celled WINDOW v AS (PARTITION BY conv_id ORDER BY start))
), parts AS (
  SELECT conv_id, part, min(start) AS begins, sum(cost) AS own_cost, sum(size) AS own_size,
    CASE WHEN min(pos) > 0 THEN any_value(system_cost) END AS kept_cost, CASE WHEN min(pos) > 0 THEN any_value(system_size) END AS kept_size
  FROM cut GROUP BY conv_id, part
), allowed AS (SELECT *, least(256, greatest(0, 1024 - coalesce(kept_cost, 0) - own_cost)) AS allowance FROM parts),
past AS (
  SELECT a.conv_id, a.part, sum(c.size) AS past_size FROM allowed a JOIN cut c ON a.conv_id = c.conv_id
    AND c.start < a.begins AND c.start >= a.begins - a.allowance AND NOT (c.pos = 0 AND c.role = 'system')
  GROUP BY a.conv_id, a.part
), sizes AS (
  SELECT conv_id, sum(own_size + coalesce(kept_size, 0) + coalesce(past_size, 0))::BIGINT AS formatted_chars
  FROM allowed LEFT JOIN past USING (conv_id, part) GROUP BY conv_id
), said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS whole,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '') AS loss
  FROM placed GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, len(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM said JOIN sizes USING (conv_id)
"""

OP8 = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) END AS s
  FROM texts
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT g FROM grams GROUP BY g HAVING count(*) > 1),
rare AS (SELECT doc_id, n, g FROM grams SEMI JOIN shared USING (g)),
enough AS (SELECT doc_id FROM rare GROUP BY doc_id, n HAVING 100 * count(*) >= 80 * n),
few AS (SELECT r.doc_id, n, g FROM rare r SEMI JOIN enough USING (doc_id)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM few a JOIN few b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least USING (doc_id)
"""

OP9 = r"""
WITH pay AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages
), best AS (SELECT sha, max(page_id) AS response_id FROM pay GROUP BY sha),
bits AS (
  SELECT DISTINCT sha, array_to_string(list_transform(string_split(sha, ''), lambda c: substr(
    '0000000100100011010001010110011110001001101010111100110111101111',
    4 * (strpos('0123456789abcdef', c) - 1) + 1, 4)), '') AS b
  FROM best
), digests AS (
  SELECT sha, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT
    + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1)), '') AS digest
  FROM bits
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response_id THEN NULL ELSE response_id END AS refers_to
FROM pay JOIN best USING (sha) JOIN digests USING (sha)
"""


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc(names: str) -> str:
    """CTEs ``names(f)``, ``step`` and ``crc(f, crc)``: CRC-32 of every distinct string, a byte of each at a time; to stand
    behind WITH RECURSIVE."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return f"""
names AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM ({names}))),
step(f, h, k, c) AS (
  SELECT f, h, 0, 4294967295::BIGINT FROM names
  UNION ALL
  SELECT f, h, k + 2, xor(c >> 8, {table}[(xor(c, ('0x' || substr(h, k + 1, 2))::BIGINT) & 255) + 1]) FROM step WHERE k < length(h)
),
crc AS (SELECT f, xor(c, 4294967295) AS crc FROM step WHERE k = length(h))"""


OP11 = rf"""
WITH RECURSIVE {_crc("SELECT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS f FROM conversations")},
spoken AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc % 20 AS d
  FROM conversations JOIN crc ON f = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')
), after AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) FROM spoken WHERE d <> 0)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM after
), faulty AS (
  SELECT *, substr(role, 1, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), '[.!?]$') THEN 'truncated' END AS fault
  FROM placed
), sizes AS (SELECT conv_id, count(*) AS n FROM faulty GROUP BY conv_id),
grammar(g, c, h) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(g, h, cost, label) AS (VALUES
  (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (3, 2, 5, 'I'), (2, 3, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')),
-- every path that is the best one to its state so far: labels and the text that it leaves, place by place
walk(conv_id, pos, g, best) AS (
  SELECT conv_id, 0, 0, {{'cost': 0::BIGINT, 'audit': '', 'said': NULL::VARCHAR}} FROM sizes
  UNION ALL
  SELECT conv_id, pos, h, min({{'cost': cost, 'audit': audit, 'said': said}}) FROM (
    SELECT w.conv_id, r.pos, e.h, w.best.cost + i.cost + e.cost AS cost, w.best.audit || i.label || e.label AS audit,
      nullif(concat_ws(chr(10), w.best.said,
        CASE WHEN i.label = '' THEN NULL WHEN i.label = 'II' THEN 'user:' || chr(10) || 'assistant:' WHEN i.h = 2 THEN 'user:' ELSE 'assistant:' END,
        CASE e.label WHEN 'K' THEN r.role || ':' || r.text WHEN 'R' THEN CASE e.h WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text END), '') AS said
    FROM walk w JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1 JOIN inserts i ON i.g = w.g
    JOIN LATERAL (
      SELECT i.h AS h, 2 AS cost, 'D' AS label
      UNION ALL SELECT m.h, CASE WHEN r.fault = 'truncated' THEN 5 ELSE 0 END, 'K' FROM grammar m WHERE m.g = i.h AND m.c = r.c AND coalesce(r.fault, '') NOT IN ('blank', 'duplicate')
      UNION ALL SELECT m.h, CASE WHEN r.fault = 'truncated' THEN 6 ELSE 1 END, 'R' FROM grammar m WHERE m.g = i.h AND m.c <> 's' AND coalesce(r.fault, '') NOT IN ('blank', 'duplicate')
    ) e ON true
  ) GROUP BY conv_id, pos, h
), ends AS (
  SELECT w.conv_id, min({{'cost': w.best.cost + i.cost, 'audit': w.best.audit || i.label, 'said': concat_ws(chr(10), w.best.said,
    CASE WHEN i.label = '' THEN NULL WHEN i.label = 'II' THEN 'user:' || chr(10) || 'assistant:' WHEN i.h = 2 THEN 'user:' ELSE 'assistant:' END)}}) AS best
  FROM walk w JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.pos JOIN inserts i ON i.g = w.g WHERE i.h IN (0, 3) GROUP BY w.conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM faulty) GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(best.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _grams(words: str) -> str:
    """Runs of one and two words of ``texts(id, w)``, one row for each place."""
    return f"""
SELECT id, unnest({words}) AS f FROM texts
UNION ALL SELECT id, unnest(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1])) FROM texts"""


OP12 = rf"""
WITH RECURSIVE own AS (
  SELECT 'd' AS side, row_number() OVER () AS id, doc_id, text FROM documents
  UNION ALL SELECT 't', -row_number() OVER (), NULL, text FROM benchmark
), texts AS (
  SELECT id, side, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM own
), runs AS ({_grams("w")}),
{_crc("SELECT f FROM runs")},
placed AS (SELECT id, crc % 10000 AS bucket FROM runs JOIN crc USING (f)),
sums AS (SELECT bucket, count(*) FILTER (id > 0) AS s, count(*) FILTER (id < 0) AS t FROM placed GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM sums),
gains AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (ss + 10000) / ((s + 1.0::DOUBLE) * (tt + 10000))))::BIGINT AS gain FROM sums, totals),
weighed AS (SELECT id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE id > 0 GROUP BY id),
scored AS (
  SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weighed USING (id) WHERE side = 'd'
), places AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
    count(*) FILTER (words >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM places
"""

OP13 = rf"""
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), texts AS (
  SELECT id, doc_id, text, w, list_transform(w, lambda x: {LOWER.format("x")}) AS low FROM cut
), runs AS ({_grams("low")}),
{_crc("SELECT f FROM runs UNION ALL SELECT doc_id::VARCHAR FROM labels WHERE doc_id IS NOT NULL")},
placed AS (SELECT id, crc % {rules.BUCKETS} AS bucket FROM runs JOIN crc USING (f)),
good AS (
  SELECT doc_id, crc % 2 = 0 AS fits FROM labels JOIN crc ON f = doc_id::VARCHAR GROUP BY doc_id, crc
  HAVING bool_and(coalesce(quality = 1 AND toxic = 0, false)) ORDER BY crc, doc_id LIMIT {rules.TRUSTED}
),
sums AS (
  SELECT bucket, count(*) AS s, count(*) FILTER (fits) AS t FROM placed JOIN texts USING (id) LEFT JOIN good USING (doc_id) GROUP BY bucket
),
totals AS (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM sums),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (ss + {rules.BUCKETS}) / ((s + 1.0::DOUBLE) * (tt + {rules.BUCKETS}))))::BIGINT AS gain FROM sums, totals
),
means AS (SELECT id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS mean FROM placed JOIN gains USING (bucket) GROUP BY id),
windows AS (
  SELECT id, i, array_to_string(w[i:i + {rules.WINDOW - 1}], ' ') AS x
  FROM (SELECT id, w, unnest(range(1, len(w) - {rules.WINDOW - 2})) AS i FROM texts WHERE len(w) >= {rules.WINDOW})
),
again AS (
  SELECT id, count(DISTINCT p) AS n FROM (
    SELECT id, unnest(range(i, i + {rules.WINDOW})) AS p FROM (SELECT *, count(*) OVER (PARTITION BY id, x) AS c FROM windows) WHERE c > 1
  ) GROUP BY id
),
lines AS (
  SELECT id, sum(c - 1) AS n FROM (
    SELECT id, x, count(*) AS c FROM (SELECT id, unnest(string_split(text, chr(10))) AS x FROM texts)
    WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY id, x
  ) GROUP BY id
),
figures AS (
  SELECT t.id, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
    coalesce(again.n, 0)::BIGINT AS n_repeat_words, coalesce(mean, 0) AS score
  FROM texts t LEFT JOIN means USING (id) LEFT JOIN again USING (id) LEFT JOIN lines USING (id)
),
held AS (SELECT list_sort(list(score)) AS s FROM figures JOIN good USING (doc_id) WHERE NOT fits),
bound AS (
  SELECT m - {rules.SPREAD} * (m - l) AS threshold FROM (
    SELECT s[greatest(1, (len(s) * 50 + 99) // 100)] AS m, s[greatest(1, (len(s) * 5 + 99) // 100)] AS l FROM held)
),
judged AS (SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM figures, bound)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (threshold IS NULL OR score >= threshold) AS kept, score, threshold::BIGINT AS threshold
FROM judged
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": _op2(),
        "op3_exact_dedup": OP3,
        "op4_chat_format": OP4,
        "op8_ngram_jaccard_join": OP8,
        "op9_warc_writer": OP9,
        "op11_conversation_repair": OP11,
        "op12_crc_resampling": OP12,
        "op13_quality_rules": OP13,
    }
