"""DuckDB twins of the queries that SQL can express.

The others: op1, op10 and op12 are tested against brute force, op5 and op9 by held-out accuracy, op7 by its properties, and the pipeline
(its quality and surrogate stages have no SQL) by brute force over its stages.
"""

from evlog.llm.codes import ENTRIES, PARTS, ROUNDS, SCALE
from evlog.llm.mixing import DIGITS, MAX_REPEATS, SEED, WEIGHT_DIGITS
from evlog.llm.secrets import ACCESS, ASSIGN, ASSIGN_MIN, DISTINCT, FEW_OWNERS, HEX, TOKEN

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _codes_sql() -> str:
    """Rounds as CTEs: ``near`` has each part's smallest distance and the entry's place behind it, ``book`` the entries by component."""
    steps = [f"""
q AS (SELECT row_number() OVER () AS r, vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
w AS (SELECT len(v) // {PARTS} AS width, i FROM (SELECT v, unnest(range(0, len(v))) AS i FROM (SELECT v FROM q LIMIT 1))),
c AS (SELECT r, i // width AS p, i % width AS k, v[i + 1] AS x FROM q, w),
book0 AS (SELECT p, e, k, x AS y FROM c JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM q) o USING (r) WHERE e < {ENTRIES})"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""
near{i} AS (SELECT r, p, min(d * {ENTRIES} + e) AS m FROM (
    SELECT r, p, e, sum((x - y) * (x - y))::BIGINT AS d FROM c JOIN book{i} USING (p, k) GROUP BY r, p, e) GROUP BY r, p)""")
        if i < ROUNDS:
            steps.append(f"""
mean{i} AS (SELECT p, m % {ENTRIES} AS e, k, sum(x)::BIGINT AS s, count(*) AS n FROM c JOIN near{i} USING (r, p) GROUP BY ALL),
book{i + 1} AS (SELECT b.p, b.e, b.k, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y
    FROM book{i} b LEFT JOIN mean{i} t ON b.p = t.p AND b.e = t.e AND b.k = t.k)""")
    return "WITH " + ",".join(steps) + f""",
coded AS (SELECT r, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY p) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM near{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, k)) FROM book{ROUNDS}) AS codebooks_sha256
FROM q JOIN coded USING (r)
"""


def _secrets_sql() -> str:
    quoted = {k: "'" + p.replace("'", "''") + "'" for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN))}
    parts = []
    for rank, (kind, pattern) in enumerate(quoted.items()):
        value = f"regexp_extract_all(t, {pattern}, 2)" if kind == "assign" else f"regexp_extract_all(t, {pattern})"
        parts.append(f"""SELECT r, {rank} AS rank, '{kind}' AS kind, unnest(range(1, len(whole) + 1)) AS i, unnest(gaps[1:len(whole)]) AS gap,
            unnest(whole) AS w, unnest(value) AS v FROM (
        SELECT r, regexp_split_to_array(t, {pattern}) AS gaps, regexp_extract_all(t, {pattern}) AS whole, {value} AS value
        FROM {"blanked" if kind == "token" else "doc"} WHERE regexp_matches(t, {pattern}))""")
    return f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
pieces AS (SELECT r, unnest(regexp_split_to_array(t, {quoted['assign']})) AS gap,
                  unnest(list_append(regexp_extract_all(t, {quoted['assign']}), '')) AS w,
                  unnest(range(0, len(regexp_extract_all(t, {quoted['assign']})) + 1)) AS i FROM doc),
blanked AS (SELECT r, string_agg(gap || repeat(' ', length(w)), '' ORDER BY i) AS t FROM pieces GROUP BY r),
found AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT *, (sum(length(gap) + length(w)) OVER (PARTITION BY r, rank ORDER BY i))::BIGINT AS e FROM found),
judged AS (
    SELECT *, regexp_matches(v, '[0-9]') AND len(list_distinct(regexp_extract_all(v, '.'))) >= {DISTINCT}
              AND (kind <> 'token' OR (regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]'))) AS live
    FROM placed WHERE kind <> 'assign' OR length(v) >= {ASSIGN_MIN}),
owners AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS n FROM judged JOIN doc USING (r) WHERE kind <> 'token' OR live GROUP BY v),
kept AS (
    SELECT r, kind, rank, e - length(w) AS s, e, CASE WHEN n > {FEW_OWNERS} THEN 'example' WHEN live THEN 'live' ELSE 'unclear' END AS verdict
    FROM judged JOIN owners USING (v) WHERE kind <> 'token' OR (live AND n <= {FEW_OWNERS})),
told AS (
    SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> 'token') AS base,
           string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans,
           count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example
    FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live,
       coalesce(n_example, 0)::BIGINT AS n_example
FROM doc LEFT JOIN told USING (r)
"""


SQL = {
    "op13_secret_ownership": _secrets_sql(),
    "op11_vector_codes": _codes_sql(),
    "op2_temperature_mixing": rf"""
WITH RECURSIVE counted AS (
    SELECT source, doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
totals AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n_rows FROM counted GROUP BY source),
shares AS (SELECT *, tokens / (SELECT sum(tokens) FROM totals)::DOUBLE AS share FROM totals),
ends AS (SELECT max(share) / min(share) AS ratio FROM shares WHERE share > 0),
halved AS (
    SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
    UNION ALL
    SELECT step + 1, CASE WHEN pow(ratio, 1 - (low + high) / 2) <= {MAX_REPEATS} THEN low ELSE (low + high) / 2 END,
           CASE WHEN pow(ratio, 1 - (low + high) / 2) <= {MAX_REPEATS} THEN (low + high) / 2 ELSE high END
    FROM halved, ends WHERE step < 30),
chosen AS (SELECT least(1.0, ceil(high * 1e{DIGITS}) / 1e{DIGITS}) AS t FROM halved WHERE step = 30),
powered AS (SELECT source, tokens, share, CASE WHEN share > 0 THEN pow(share, t) ELSE 0 END AS power FROM shares, chosen),
scaled AS (SELECT sum(power) AS norm, max(CASE WHEN share > 0 THEN share / power END) AS once, sum(tokens)::DOUBLE AS total FROM powered),
plan AS (SELECT source, tokens, power / norm AS weight, round(total * once * norm * (power / norm))::BIGINT AS quota FROM powered, scaled),
passed AS (SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS passes FROM plan),
drawn AS (
    SELECT c.source, c.doc_id, c.n_tokens, p.tokens, p.weight, p.quota, p.passes, e.epoch,
           md5('{SEED}|' || e.epoch || '|' || coalesce(c.doc_id::VARCHAR, '')) AS draw
    FROM counted c JOIN passed p ON c.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(0, p.passes + 1)) AS epoch) e
    WHERE e.epoch < p.passes OR p.quota > p.passes * p.tokens),
placed AS (
    SELECT *, substr(draw, 1, 2) AS block,
           sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY draw, doc_id, n_tokens RANGE UNBOUNDED PRECEDING) AS upto FROM drawn)
SELECT source, doc_id, epoch::BIGINT AS epoch, block, (upto - n_tokens)::BIGINT AS position, n_tokens,
       round(weight, {WEIGHT_DIGITS}) AS weight FROM placed
WHERE epoch < passes OR epoch * tokens + upto <= quota
""",
    "op3_chat_parts": r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
    SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS shown,
           replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&#10;') AS head FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|>' || head || chr(10) || shown || '<|end|>' || chr(10)))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
""",
    "op4_wu_manber": rf"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (
    SELECT DISTINCT item, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram, least(len(w), 10) AS k
    FROM item, LATERAL (SELECT unnest(range(1, greatest(len(w) - 8, 2))) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM grams),
doc_grams AS (
    SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
    FROM doc, sizes, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
hits AS (SELECT d.r, d.i, d.k, g.item FROM doc_grams d JOIN grams g ON d.gram = g.gram AND d.k = g.k),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, k FROM hits), LATERAL (SELECT unnest(range(i, i + k)) AS p) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
""",
    "op6_warc_zstd": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
""",
    "op8_minmax_near_dups": rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
    SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(len(w), 5) - 1], ' ')) AS gram
    FROM doc, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
    SELECT doc_id AS a, doc_id AS b FROM doc
    UNION
    SELECT r.a, l.b FROM reached r JOIN both_ways l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM doc LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) USING (doc_id)
""",
}
