"""Reference SQL for the queries, for DuckDB.

DuckDB's regex engine has ASCII word boundaries and no look-around.  Where a text may hold other
letters, words are marked first or those letters are mapped to a neutral word character.

Patterns, marks and sentences are fixed values that the results depend on.
"""

from __future__ import annotations

from parcelflow.functions.guard import ASK_ID_LINE as ASK_LINE, BLOCKED, REFUSE_LINK_LINE as REFUSAL

from .inputs import COUNTRIES, RAW_ANSWERS, SERVICES, SQL, cte  # noqa: F401
from .queries import CONFIG, QUOTAS, SPLIT_RATIO, SYLLABLES, WIDE, WORDS

ORACLES: dict[str, str] = {}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, '{flags}')"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


# --- text ---------------------------------------------------------------------------------------

WORD = r"[\p{L}\p{N}_]"
ADDR = r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:(?:\+?\d{1,3})?[\s-]?)?(?:\(?\d{2,4}\)?[\s-]?)?\d{3,4}[\s-]?\d{3,4}"


def collapse(x: str) -> str:
    return f"trim({sub(x, chr(92) + 's+', ' ')})"


def norm(x: str) -> str:
    """NFKC matters for the ellipsis only in these texts."""
    return collapse(f"replace({x}, '…', '...')")


def drop_tags(x: str) -> str:
    return sub(sub(sub(x, r"https?://\S+"), rf"@{WORD}+"), r"\^[A-Z]{1,3}\b")


def scrub(x: str) -> str:
    x = sub(x, rf"(^|[^\p{{L}}\p{{N}}_])[A-Za-z0-9_][A-Za-z0-9._%+-]*{ADDR}", r"\1[REDACTED_EMAIL]")
    x = sub(x, rf"([^\x00-\x7F])[.%+-][A-Za-z0-9._%+-]*{ADDR}", r"\1[REDACTED_EMAIL]")
    return drop_tags(sub(x, PHONE, "[REDACTED_PHONE]"))


def alias(x: str, names: list[str], to: str) -> str:
    marked = f"regexp_replace({x}, '({WORD}+)', chr(1) || '\\1' || chr(2), 'g')"
    options = "|".join(n.replace(" ", r"\x02 \x01") for n in names)
    out = sub(marked, rf"(?i)\x01(?:{options})\x02", to)
    return sub(sub(out, r"[\x01\x02]"), r"(?i)shipping_a", "Shipping_A")


STEPS = (
    "Thanks for reaching out. Here's what I'll do:\n1) Check the latest scan and status.\n"
    "2) Confirm delivery address.\n3) Share an ETA or next step.\n\n"
)


def detwitterize(x: str) -> str:
    t = sub(drop_tags(x), rf"#{WORD}+")
    t = sub(sub(t, r"(?i)\bdm\b[^\n]*(\n?)$", r"\1"), r"\b[dD]irect message\b[^\n]*(\n?)$", r"\1")
    return f"replace(replace({collapse(t)}, 'pls', 'please'), 'thx', 'thanks')"


def with_steps(x: str) -> str:
    return (
        f"regexp_replace(CASE WHEN contains({x}, 'Here''s what I''ll do:') "
        f"OR contains({x}, 'Here’s what I’ll do:') THEN {x} ELSE {lit(STEPS)} || {x} END, "
        "'^\\s+|\\s+$', '', 'g')"
    )


def dedup_key(x: str) -> str:
    folded = f"replace(lower({x}), 'ß', 'ss')"
    return collapse(sub(folded, r"[^\p{L}\p{N}_\s]", " "))


def any_word(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w.lower())})" for w in words) + ")"


def count_of(x: str, mark: str) -> str:
    return f"CAST((length({x}) - length(replace({x}, {lit(mark)}, ''))) / {len(mark)} AS BIGINT)"


ORACLES["normalize_text"] = f"SELECT doc_id, md5({norm('text')}) AS text_md5 FROM documents"
ORACLES["scrub_pii"] = f"""
WITH s AS (SELECT doc_id, {scrub(norm('text'))} AS t FROM documents)
SELECT doc_id, {count_of('t', '[REDACTED_EMAIL]')} AS emails, {count_of('t', '[REDACTED_PHONE]')} AS phones,
       {count_of('t', '[REDACTED_ORDER]')} AS orders, md5(t) AS text_md5
FROM s"""
ORACLES["alias_carriers"] = f"""
{cte('messages')}
SELECT kind, id, md5({alias('text', ['dhl', 'ups', 'royal mail', 'the', 'die'], 'Shipping_A')}) AS text_md5
FROM (SELECT 'doc' AS kind, doc_id AS id, text FROM documents
      UNION ALL SELECT 'msg', msg_id, text FROM messages)"""
ORACLES["detwitterize_agent"] = f"""
{cte('raw_answers')}, t AS (SELECT msg_id, {detwitterize('raw')} AS t FROM raw_answers)
SELECT msg_id, {with_steps('t')} AS text FROM t"""
PLAIN = "replace(translate(text, " + lit(WIDE[0]) + ", 'ae1E'), 'ti', 'fi2')"
ORACLES["normalize_wide"] = f"""
SELECT doc_id, md5({norm('wide')}) AS text_md5 FROM (SELECT doc_id, {PLAIN} AS wide FROM documents)"""
ORACLES["enforce_max_tokens"] = """
SELECT doc_id, CAST(least(length(text), 400) AS BIGINT) AS chars, md5(substr(text, 1, 400)) AS text_md5
FROM documents"""
ORACLES["keyword_filter_docs"] = f"SELECT doc_id FROM documents WHERE {any_word('lower(text)', WORDS)}"

# --- pairs --------------------------------------------------------------------------------------

PAIRS = f"""
{cte('tweets', 'instructions')},
reply AS (
  SELECT c.tweet_id AS src_key, c.text AS input_raw, r.text AS assistant_raw
  FROM tweets c JOIN tweets r ON regexp_replace(c.response_tweet_id, '\\.0$', '') = r.tweet_id
  WHERE c.inbound = 'True' AND r.inbound = 'False'),
pairs AS (
  SELECT 'kaggle_twitter' AS source, src_key, CAST(src_key AS HUGEINT) AS ord, input_raw, assistant_raw
  FROM reply
  UNION ALL
  SELECT 'bitext_hf', CAST(o_orderkey AS VARCHAR),
         CAST('100000000000000000000000000000000' AS HUGEINT) + o_orderkey, instruction, response
  FROM instructions)"""
for name in ("reply_pairs_conversations", "tweets_csv", "tweets_csv_splits"):
    ORACLES[name] = f"{PAIRS} SELECT src_key, input_raw, assistant_raw FROM reply"
ORACLES["union_of_sources"] = f"""
{PAIRS} SELECT source, count(*) AS pairs, count(DISTINCT ord) AS orders FROM pairs GROUP BY source"""
KEPT = (
    f"({any_word('lower(input_raw)', CONFIG.keywords)} OR {any_word('lower(assistant_raw)', CONFIG.keywords)})"
)
ORACLES["keyword_filter_pairs"] = f"{PAIRS} SELECT source, src_key FROM pairs WHERE {KEPT}"


def clean(x: str) -> str:
    return alias(scrub(norm(x)), list(CONFIG.carrier_names), CONFIG.carrier_alias)


MAPPED = f"""{PAIRS},
agents AS (
  SELECT source, src_key, ord, input_raw, assistant_raw, {clean('input_raw')} AS user_text,
         {detwitterize(clean('assistant_raw'))} AS agent_text
  FROM pairs),
mapped AS (
  SELECT source, src_key, ord, input_raw, assistant_raw, substr(user_text, 1, 4096) AS input,
         substr({with_steps('agent_text')}, 1, 4096) AS assistant_response
  FROM agents)"""
ORACLES["map_pair"] = f"{MAPPED} SELECT source, src_key, input, assistant_response FROM mapped"
ORACLES["dedup_documents"] = f"""
SELECT min(doc_id) AS doc_id FROM documents GROUP BY {dedup_key('text')}"""
ORACLES["dedup_messages"] = f"""
{cte('instructions')}
SELECT * FROM instructions
QUALIFY row_number() OVER (
  PARTITION BY {dedup_key('instruction')}, {dedup_key('response')} ORDER BY o_orderkey) = 1"""


def seeded(seed: str, key: str) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR)), CAST({key} AS VARCHAR)"


QUOTA_ROWS = ", ".join(f"({lit(k)}, {n})" for k, n in QUOTAS.items())
PICKED = f"""
WITH quota(source, n) AS (VALUES {QUOTA_ROWS}),
ranked AS (
  SELECT doc_id, source,
         row_number() OVER (PARTITION BY source ORDER BY {seeded('42/pick', 'doc_id')}) AS r
  FROM documents),
flagged AS (
  SELECT doc_id, source, coalesce(r <= n, false) AS picked FROM ranked LEFT JOIN quota USING (source))"""
ORACLES["ratio_sample"] = f"{PICKED} SELECT doc_id, source FROM flagged WHERE picked"
ORACLES["topup_sample"] = f"""
{PICKED}, more AS (
  SELECT doc_id, row_number() OVER (ORDER BY {seeded('42/top-up', 'doc_id')}) AS r
  FROM flagged WHERE NOT picked)
SELECT doc_id FROM more
WHERE r <= (SELECT count(*) // 2 - count(*) FILTER (WHERE picked) FROM flagged)"""
ORACLES["train_val_split"] = f"""
SELECT doc_id, CASE WHEN r <= greatest(1, floor(n * {SPLIT_RATIO})) THEN 'val' ELSE 'train' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY {seeded('42/final', 'doc_id')}) AS r,
             count(*) OVER () AS n
      FROM documents)"""

SHARES = ", ".join(f"({lit(k)}, {n})" for k, n in CONFIG.quotas().items())
CURATED = f"""{MAPPED},
deduped AS (
  SELECT * FROM mapped WHERE {KEPT}
  QUALIFY row_number() OVER (
    PARTITION BY {dedup_key('input')}, {dedup_key('assistant_response')} ORDER BY ord) = 1),
quota(source, n) AS (VALUES {SHARES}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY {seeded('42/pick', 'ord')}) AS r
  FROM deduped),
flagged AS (
  SELECT ranked.*, coalesce(r <= n, false) AS picked FROM ranked LEFT JOIN quota USING (source)),
more AS (
  SELECT *, row_number() OVER (ORDER BY {seeded('42/top-up', 'ord')}) AS m FROM flagged WHERE NOT picked),
chosen AS (
  SELECT source, ord, input, assistant_response FROM flagged WHERE picked
  UNION ALL
  SELECT source, ord, input, assistant_response FROM more
  WHERE m <= {CONFIG.mini_size} - (SELECT count(*) FROM flagged WHERE picked)),
curated AS (
  SELECT input, assistant_response, source,
         CASE WHEN row_number() OVER (ORDER BY {seeded('42/final', 'ord')})
                   <= greatest(1, floor((SELECT count(*) FROM chosen) * {CONFIG.val_ratio}))
              THEN 'val' ELSE 'train' END AS split
  FROM chosen)"""
ORACLES["curated_pairs"] = f"{CURATED} SELECT input, assistant_response, source, split FROM curated"
CONTENT = "sha256(CAST(to_json([input, assistant_response]) AS VARCHAR))"
REPEATED = CURATED.replace(SQL["tweets"], SQL["repeated_tweets"]).replace("ORDER BY ord)", f"ORDER BY ord NULLS FIRST, {CONTENT})")
for purpose in ("pick", "top-up", "final"):
    told_apart = f"md5('42/{purpose}:' || coalesce(CAST(ord AS VARCHAR), '')), ord, {CONTENT}"
    REPEATED = REPEATED.replace(seeded(f"42/{purpose}", "ord"), told_apart)
ORACLES["curated_pairs_repeated_ids"] = f"{REPEATED} SELECT input, assistant_response, source, split FROM curated"
ORACLES["reply_pairs_hot"] = f"""
{cte('messages')}
SELECT CAST(msg_id AS VARCHAR) AS src_key, text AS input_raw, 'reply ' || CAST(msg_id % 8 AS VARCHAR) AS assistant_raw
FROM messages WHERE msg_id % 8 < 6"""
ORACLES["pairs_jsonl"] = f"{CURATED} SELECT input, assistant_response, split FROM curated"
RATIO_TEXT = "|".join(f"{k}={v}" for k, v in sorted(CONFIG.ratios.items()))
ORACLES["curated_manifest"] = f"""
{CURATED}
SELECT count(*) AS total_pairs, count(*) FILTER (WHERE split = 'train') AS train_pairs,
       count(*) FILTER (WHERE split = 'val') AS val_pairs, {lit(RATIO_TEXT)} AS ratios
FROM curated"""
ORACLES["pair_json"] = f"""
{PAIRS} SELECT src_key, CAST(to_json({{'input': input_raw, 'assistant_response': assistant_raw}}) AS VARCHAR) AS json
FROM reply"""
SYSTEM = (
    "You are a shipping support assistant. Ask for missing IDs, never include links, never claim "
    "live tracking. Keep answers concise with 2–4 bullet steps and defer facts to retrieval."
)
ORACLES["chat_text"] = f"""
{PAIRS}
SELECT src_key, {lit(f'<|system|>{chr(10)}{SYSTEM}{chr(10)}<|user|>{chr(10)}')} || input_raw ||
       {lit(f'{chr(10)}<|assistant|>{chr(10)}')} || assistant_raw || chr(10) AS text
FROM reply"""

# --- knowledge base -----------------------------------------------------------------------------


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$")


KB_FILES = f"""{cte('kb_files')},
files AS (
  SELECT source, {strip('text')} AS text,
         CASE WHEN contains(lower(source), 'shipping_a') OR contains(lower(source), 'company_a') THEN 'Shipping_A'
              WHEN contains(lower(source), 'shipping_b') OR contains(lower(source), 'company_b') THEN 'Shipping_B'
              WHEN contains(lower(source), 'shipping_c') OR contains(lower(source), 'company_c') THEN 'Shipping_C'
         END AS carrier
  FROM kb_files WHERE lower(source) <> 'readme.md' AND {strip('text')} <> '')"""
ORACLES["kb_file_filter"] = f"{KB_FILES} SELECT source, carrier, md5(text) AS text_md5 FROM files"


def chunked(source: str, key: str, size: int, overlap: int) -> str:
    """Chunks of ``text``: start i is a window if it is first or the window before it stops short."""
    step = size - overlap
    return f"""
  SELECT {key}, i, {strip(f'substr(text, i + 1, {size})')} AS chunk
  FROM (SELECT {key}, text, unnest(range(0, greatest(length(text), 1), {step})) AS i FROM {source})
  WHERE length(text) > 0 AND (i = 0 OR i - {step} + {size} < length(text))"""


ORACLES["chunk_documents"] = f"""
WITH docs AS (SELECT doc_id, {strip('text')} AS text FROM documents), parts AS ({chunked('docs', 'doc_id', 1000, 200)})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS VARCHAR) AS chunk_id,
       md5(chunk) AS text_md5
FROM parts WHERE chunk <> ''"""
ORACLES["chunk_documents_small"] = f"""
WITH parts AS ({chunked('documents', 'doc_id', 100, 70)})
SELECT doc_id, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars
FROM parts WHERE chunk <> '' GROUP BY doc_id"""
ORACLES["ingest_counts"] = f"""
{KB_FILES}, parts AS ({chunked('files', 'source', 1000, 200)})
SELECT source, count(*) AS chunks FROM parts WHERE chunk <> '' GROUP BY ROLLUP (source)"""
SECOND = f"""{KB_FILES},
numbered AS (SELECT *, CAST(nullif(regexp_extract(source, '_([0-9]+)\\.md$', 1), '') AS BIGINT) AS n FROM files),
first_files AS (SELECT source, text, carrier FROM numbered WHERE NOT (carrier = 'Shipping_A' AND n % 50 = 1)),
second_files AS (
  SELECT source, CASE WHEN carrier = 'Shipping_B' AND n % 40 = 2 THEN text || ' changed' ELSE text END AS text, carrier
  FROM numbered WHERE NOT (carrier = 'Shipping_A' AND n % 50 = 11)),
before AS ({chunked('first_files', 'source', 1000, 200)}),
now AS ({chunked('second_files', 'source', 1000, 200)})"""
ORACLES["ingest_changes"] = f"""
{SECOND}
SELECT source, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS chunk_id, carrier, md5(chunk) AS text_md5,
       CAST(length(chunk) AS BIGINT) AS chars, CAST(strlen(chunk) AS BIGINT) AS bytes
FROM now JOIN second_files USING (source) WHERE chunk <> ''"""
ORACLES["ingest_report"] = f"""
{SECOND}
SELECT (SELECT count(*) FROM now WHERE chunk <> '') AS chunks,
       (SELECT count(DISTINCT chunk) FROM now WHERE chunk <> '' AND chunk NOT IN (SELECT chunk FROM before)) AS embedded,
       'Shipping_A|Shipping_B' AS carriers"""
ORACLES["chunk_by_heading"] = rf"""
WITH RECURSIVE kb_markdown AS ({SQL['kb_markdown']}),
lines AS (
  SELECT source, pos - 1 AS pos, l[pos] AS line, pos = len(l) AS last
  FROM (SELECT source, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT source, string_split(text, chr(10)) AS l FROM kb_markdown))),
marked AS (
  SELECT *, length(regexp_extract(line, '(?s)^(#{{1,6}})[ 	]+(\S.*)$', 1)) AS heading,
         regexp_replace(regexp_extract(line, '(?s)^(#{{1,6}})[ 	]+(\S.*)$', 2), '\s+$', '') AS title,
         trim(regexp_replace(line, '[	
]', ' ', 'g')) = '' AS blank
  FROM lines),
stacked AS (
  SELECT *, coalesce(lag(blank) OVER w, false) AS after_blank, last_value(title IGNORE NULLS) OVER w AS any_title,
         {", ".join(f"max(CASE WHEN heading = {n} THEN pos END) OVER w AS p{n}, last_value(CASE WHEN heading = {n} THEN title END IGNORE NULLS) OVER w AS t{n}" for n in range(1, 7))},
         max(CASE WHEN heading > 0 THEN pos END) OVER w AS newest
  FROM marked WINDOW w AS (PARTITION BY source ORDER BY pos)),
asked AS (
  SELECT *, [t FOR t IN [{", ".join(f"CASE WHEN p{n} > greatest(-1, {', '.join(['-1'] + [f'coalesce(p{m}, -1)' for m in range(1, n)])}) THEN t{n} END" for n in range(1, 7))}] IF t IS NOT NULL] AS headings,
         coalesce(regexp_matches(CASE newest {" ".join(f"WHEN p{n} THEN t{n}" for n in range(1, 7))} END, '^Q\d*[:.)]'), false) AS question
  FROM stacked),
units AS (
  SELECT source, topic, unit, string_agg(line || CASE WHEN last THEN '' ELSE chr(10) END, '' ORDER BY pos) AS body,
         min_by(headings, pos) AS headings, bool_or(question) AS whole
  FROM (
    SELECT *, sum(CASE WHEN heading > 0 OR (after_blank AND NOT blank AND NOT question) THEN 1 ELSE 0 END) OVER w AS unit,
           sum(CASE WHEN heading BETWEEN 1 AND 2 THEN 1 ELSE 0 END) OVER w AS topic
    FROM asked WINDOW w AS (PARTITION BY source ORDER BY pos))
  GROUP BY source, topic, unit),
pieces AS (
  SELECT source, topic, unit, headings, unnest(p) AS body, generate_subscripts(p, 1) AS piece
  FROM (SELECT *, CASE WHEN whole THEN [body] ELSE regexp_extract_all(body, '(?s).{{1,600}}') END AS p FROM units)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY source, topic ORDER BY unit, piece) AS k FROM pieces),
packed(source, topic, k, body, headings, chunk, held) AS (
  SELECT source, topic, k, body, headings, 0, length(body) FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.source, o.topic, o.k, o.body, o.headings,
         CASE WHEN held > 0 AND held + length(o.body) > 600 THEN chunk + 1 ELSE chunk END,
         CASE WHEN held > 0 AND held + length(o.body) > 600 THEN 0 ELSE held END + length(o.body)
  FROM packed p JOIN ordered o ON o.source = p.source AND o.topic = p.topic AND o.k = p.k + 1),
chunks AS (
  SELECT source, topic, chunk, string_agg(body, '' ORDER BY k) AS body, array_to_string(min_by(headings, k), ' > ') AS headings
  FROM packed GROUP BY source, topic, chunk),
bared AS (SELECT *, trim(regexp_replace(body, '^\s+|\s+$', '', 'g')) AS bare FROM chunks)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY topic, chunk) - 1 AS chunk_id, headings,
       md5(body) AS body_md5,
       md5(CASE WHEN bare = '' THEN '' ELSE concat_ws(chr(10), nullif(headings, ''), bare) END) AS text_md5
FROM bared"""
ORACLES["chunk_table"] = f"""
{cte('chunks')}
SELECT carrier, source, count(*) AS chunks, min(chunk_id) AS first_id FROM chunks GROUP BY ALL"""

SCORE = "round(list_cosine_similarity(CAST(q.vec AS DOUBLE[]), CAST(c.vec AS DOUBLE[])), 9)"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, chunk_id)"
KNN = f"""
{cte('chunks')}, queries AS (SELECT vec_id AS query_id, embedding AS vec FROM embeddings),
scored AS (SELECT query_id, source, chunk_id, text, {SCORE} AS score FROM queries q, chunks c),
ranked AS (SELECT *, {RANK} AS rank FROM scored)"""
ORACLES["knn_topk"] = f"""
{KNN} SELECT query_id, rank, source, chunk_id, round(score, 4) AS score FROM ranked WHERE rank <= 5"""
ORACLES["vector_index_exact"] = ORACLES["knn_topk"]
ORACLES["vector_index_recall"] = """
SELECT count(*) AS n_queries, 5 * count(*) AS n_wanted, true AS recall_reached
FROM embeddings WHERE vec_id % 10 = 0"""
ORACLES["search_hits"] = f"""
{KNN} SELECT query_id, rank, text, source || '#' || chunk_id AS ref FROM ranked WHERE rank <= 3"""
ORACLES["knn_carrier_fallback"] = f"""
{cte('chunks')}, queries AS (
  SELECT vec_id AS query_id, embedding AS vec,
         CASE vec_id % 4 WHEN 0 THEN 'Shipping_A' WHEN 1 THEN 'Shipping_B' END AS carrier
  FROM embeddings),
scored AS (
  SELECT query_id, source, chunk_id, {SCORE} AS score
  FROM queries q, chunks c WHERE q.carrier IS NULL OR q.carrier = c.carrier),
ranked AS (SELECT *, {RANK} AS rank FROM scored)
SELECT query_id, rank, source, chunk_id FROM ranked WHERE rank <= 4"""
ORACLES["vector_index_carriers"] = ORACLES["knn_carrier_fallback"]
ORACLES["citation_labels"] = f"""
{cte('chunks')}, hits AS (
  SELECT chunk_id AS id, CASE WHEN CAST(chunk_id AS BIGINT) % 3 <> 0 THEN source END AS s,
         CASE WHEN CAST(chunk_id AS BIGINT) % 5 <> 0 THEN chunk_id END AS c
  FROM chunks)
SELECT id, coalesce(s, 'kb') || coalesce('#' || c, '') AS ref,
       CASE WHEN s IS NOT NULL AND c IS NOT NULL THEN s || '#' || c WHEN s IS NOT NULL THEN s
            WHEN c IS NOT NULL THEN 'kb#' || c ELSE 'kb' END AS label
FROM hits"""

# --- triage -------------------------------------------------------------------------------------

CANDIDATE = r"(?i)\b([A-Z0-9]*\d[A-Z0-9]*(?:[-\s][A-Z0-9]*\d[A-Z0-9]*){0,8})\b"
COMPACT = sub("tok", r"[-\s]")


def found_ids(source: str, key: str) -> str:
    """(key, pos, id, raw) of the IDs in ``text``; other letters count as word characters."""
    neutral = sub("text", r"[^\x00-\x7F]", "_")
    return f"""
  SELECT {key}, id, raw, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS pos
  FROM (SELECT {key}, upper({COMPACT}) AS id, min(i) AS i, arg_min(tok, i) AS raw
        FROM (SELECT {key}, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i
              FROM (SELECT {key}, regexp_extract_all({neutral}, {lit(CANDIDATE)}, 1) AS toks FROM {source}))
        WHERE length({COMPACT}) BETWEEN 8 AND 22 AND NOT {matches('tok', r'\b\d{4}-\d{1,2}-\d{1,2}\b')}
          AND NOT {matches('tok', r'(?i)\b(?:INV|ORDER|PO|REF)[-:\s]?\d{3,}\b')}
        GROUP BY ALL)"""


def carrier_of(x: str) -> str:
    whens = " ".join(
        f"WHEN {matches(x, rf'(?i)\bShipping{mark}{c}\b')} THEN 'Shipping_{c}'"
        for mark in ("_", "") for c in "ABC"
    )
    return f"CASE {whens} END"


S = r"\s"
LINK = r"(?i)\b(link|url|website|web\s*site)\b"
INTENTS = [
    ("link_request", LINK),
    ("tracking", r"(?i)\b(track(ing)?|status|where\s+(is|’s|'s)|locate|find|scan(s)?"
                 r"|last\s+(two|2)\s+scans?|update|trace|follow\s*up)\b"),
    ("delivery_issue", r"(?i)\b(delivered|not\s+received|missing|lost|stolen|proof\s+of\s+delivery|pod"
                       r"|misdeliver(ed)?|left\s+at)\b"),
    ("address", r"(?i)\b(address|postcode|zip|postal\s+code|suite|apt|apartment|unit)\b"),
    ("customs", r"(?i)\b(customs|duty|tariff|hs\s*code|clearance|invoice|id|proof\s+of\s+payment"
                r"|declaration)\b"),
]


def intent_of(x: str) -> str:
    # Only ASCII words are looked for, so any other letter may stand as "q".
    neutral = sub(x, r"[^\x00-\x7F]", "q")
    return "CASE " + " ".join(f"WHEN {matches(neutral, p)} THEN '{n}'" for n, p in INTENTS) + " ELSE 'general' END"


def has_id(x: str, provided: str) -> str:
    label = r"(?i)\b(awb|waybill|tracking|order)\s*(no\.?|number|id)?\s*[:#-]?\s*[A-Z0-9\-]{8,}"
    return (
        f"(coalesce(length(trim({provided})) >= 8, false) OR {matches(x, label)} "
        f"OR {matches(x, chr(92) + 'b' + chr(92) + 'd{8,}' + chr(92) + 'b')})"
    )


def missing(intent: str, x: str, provided: str) -> str:
    return f"({intent} IN ('tracking', 'link_request', 'delivery_issue', 'address') AND NOT {has_id(x, provided)})"


def intent_report(rows: str) -> str:
    return f"""
known AS (SELECT text, tracking, {intent_of('text')} AS intent FROM {rows})
SELECT intent, count(*) AS messages, count(*) FILTER (WHERE {missing('intent', 'text', 'tracking')}) AS missing_id,
       count(*) FILTER (WHERE {matches('text', LINK)}) AS wants_link
FROM known GROUP BY intent"""


IDS = f"""{cte('messages')},
found AS ({found_ids('messages', 'msg_id')})"""
ORACLES["parse_tracking"] = f"""
{IDS} SELECT msg_id, pos, id, raw, {carrier_of('text')} AS carrier FROM found JOIN messages USING (msg_id)"""
ORACLES["parse_tracking_documents"] = f"""
WITH docs AS (SELECT doc_id AS msg_id, text FROM documents)
SELECT msg_id, pos, id, raw FROM ({found_ids('docs', 'msg_id')})"""
ORACLES["ids_per_carrier"] = f"""
{IDS}, n AS (SELECT msg_id, count(*) AS n FROM found GROUP BY msg_id)
SELECT coalesce({carrier_of('text')}, 'unknown') AS carrier, count(*) AS messages,
       CAST(sum(coalesce(n, 0)) AS BIGINT) AS ids
FROM messages LEFT JOIN n USING (msg_id) GROUP BY 1"""
ORACLES["intent_counts"] = f"{cte('messages')}, {intent_report('messages')}"
ORACLES["intent_conversations"] = f"""
WITH turns AS (SELECT text, CAST(NULL AS VARCHAR) AS tracking FROM conversations WHERE role = 'user'),
{intent_report('turns')}"""

LOW = "lower(text)"
KNOWN = f"""{IDS},
listed AS (SELECT msg_id, list(id ORDER BY pos) AS parsed FROM found GROUP BY msg_id),
merged AS (
  SELECT m.*, coalesce(m.carrier, {carrier_of('text')}) AS known_carrier,
         {carrier_of('text')} AS parsed_carrier, coalesce(parsed, []) AS parsed,
         CASE WHEN tracking IS NULL THEN coalesce(parsed, [])
              ELSE [tracking] || [x FOR x IN coalesce(parsed, []) IF x <> tracking] END AS ids,
         {intent_of('text')} AS intent
  FROM messages m LEFT JOIN listed USING (msg_id)),
known AS (
  SELECT *, {missing('intent', 'text', 'tracking')} AS missing_id, {matches('text', LINK)} AS wants_link,
         CASE WHEN parsed_carrier IS NULL AND len(parsed) = 0 THEN 'no obvious carrier/ids found' END AS notes,
         {any_word(LOW, ['quote', 'rate', 'price', 'how much', 'shipping cost', 'label price'])} AS n_quote,
         {any_word(LOW, ['track', 'tracking', 'scan', 'status'])} AS n_track,
         {any_word(LOW, ['eta', 'how long', 'when arrive', 'delivery time'])} AS n_eta,
         regexp_extract_all(upper(text), '\\b([A-Z]{{2}})\\b', 1) AS cc,
         CASE WHEN contains({LOW}, 'express') THEN 'express' WHEN contains({LOW}, 'standard') THEN 'standard'
              WHEN contains({LOW}, 'economy') THEN 'economy' ELSE 'standard' END AS service
  FROM merged)"""
ORACLES["message_routing"] = f"""
{KNOWN}
SELECT msg_id, known_carrier AS carrier, intent, missing_id, wants_link, notes,
       NOT {matches(LOW, r'(awb|waybill|tracking|order)\s*(no|number|id)|\b\d{8,}\b')} AS missing_any,
       ids[1] AS first_id, array_to_string(ids, '|') AS ids,
       concat_ws('|', CASE WHEN n_quote THEN 'quote' END, CASE WHEN n_track THEN 'retrieval' END,
                 CASE WHEN n_track AND len(ids) = 0 THEN 'tracking_id' END, CASE WHEN n_eta THEN 'eta' END) AS needs
FROM known"""
STRICT = r"(?i)\b([a-z]{2})\s+to\s+([a-z]{2})\b"


def strict(group: int) -> str:
    return f"nullif(upper(regexp_extract(text, {lit(STRICT)}, {group})), '')"


ORACLES["message_lanes"] = f"""
{KNOWN}
SELECT msg_id, coalesce(cc[1], 'JO') AS origin_cc, coalesce(cc[2], cc[1], 'JO') AS dest_cc,
       coalesce({strict(1)}, 'JO') AS strict_origin, coalesce({strict(2)}, {strict(1)}, 'JO') AS strict_dest,
       service
FROM known"""

REGION = (
    "CASE WHEN {0} IN ('AE','SA','KW','QA','BH','OM','JO') THEN 'GCC' "
    "WHEN {0} IN ('DE','FR','IT','ES','NL','SE','PL','BE','AT','DK','IE','PT','CZ','FI','RO','HU','GR') "
    "THEN 'EU' END"
)


def zone(o: str, d: str) -> str:
    return (
        f"CASE WHEN {o} = {d} THEN 'INTRA_COUNTRY' WHEN {REGION.format(o)} = {REGION.format(d)} "
        "THEN 'INTRA_REGION' ELSE 'INTERCONTINENT' END"
    )


def eta_days(service: str, z: str) -> tuple[str, str]:
    lo = f"(CASE {service} WHEN 'express' THEN 1 WHEN 'economy' THEN 5 ELSE 3 END"
    lo += f" + CASE {z} WHEN 'INTRA_COUNTRY' THEN -1 WHEN 'INTRA_REGION' THEN 0 ELSE 2 END)"
    hi = f"(CASE {service} WHEN 'express' THEN 3 WHEN 'economy' THEN 12 ELSE 7 END"
    hi += f" + CASE {z} WHEN 'INTRA_COUNTRY' THEN 0 WHEN 'INTRA_REGION' THEN 1 ELSE 5 END)"
    return f"greatest(1, {lo})", f"greatest(greatest(1, {lo}), {hi})"


LO, HI = eta_days("service", "eta_zone")
ESTIMATED = f"""{KNOWN},
laned AS (
  SELECT *, coalesce(cc[1], 'JO') AS o, coalesce(cc[2], cc[1], 'JO') AS d FROM known),
zoned AS (SELECT *, {zone('o', 'd')} AS eta_zone FROM laned),
estimated AS (
  SELECT *, CAST({LO} AS BIGINT) AS min_days, CAST({HI} AS BIGINT) AS max_days FROM zoned)"""
ORACLES["message_estimates"] = f"""
{ESTIMATED}
SELECT msg_id, CASE WHEN n_eta THEN o END AS origin_cc, CASE WHEN n_eta THEN d END AS dest_cc,
       CASE WHEN n_eta THEN service END AS eta_service, CASE WHEN n_eta THEN min_days END AS min_days,
       CASE WHEN n_eta THEN max_days END AS max_days, CASE WHEN n_quote THEN 'INTRA_REGION' END AS zone,
       CASE WHEN n_quote THEN CAST(8 AS DOUBLE) END AS price_usd,
       CASE WHEN n_quote THEN CAST(1 AS DOUBLE) END AS billable_kg
FROM estimated WHERE n_eta OR n_quote"""
LAST6 = "ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING"
ORACLES["history_last6"] = f"""
SELECT conv_id, turn, role,
       coalesce(array_to_string(list(role || ': ' || substr(text, 1, 500)) OVER (
         PARTITION BY conv_id ORDER BY turn {LAST6}), chr(10)), '') AS history
FROM conversations WHERE role IN ('user', 'assistant')"""

HITS = f"""
vectors AS (SELECT vec_id, embedding AS vec, count(*) OVER () AS n FROM embeddings),
asking AS (
  SELECT msg_id AS query_id, vec, CASE WHEN known_carrier IN (SELECT carrier FROM chunks) THEN known_carrier END
    AS carrier
  FROM estimated JOIN vectors ON conv_id % n = vec_id WHERE n_track),
scored AS (
  SELECT query_id, source, chunk_id, text, {SCORE} AS score
  FROM asking q JOIN chunks c ON q.carrier IS NULL OR q.carrier = c.carrier),
hits AS (
  SELECT query_id AS msg_id, list(text ORDER BY rank) AS texts,
         list(source || '#' || chunk_id ORDER BY rank) AS refs
  FROM (SELECT *, {RANK} AS rank FROM scored) WHERE rank <= 4 GROUP BY query_id)"""
NOTE = (
    "'ETA handbook estimate: ' || min_days || '–' || max_days || ' business days for ' || service || ' from ' || o "
    "|| ' to ' || d || '. Clarify that this is not live tracking.'"
)


def ascii_of(x: str) -> str:
    x = f"translate({x}, '–—−’‘“”' || chr(160), '---''''\"\" ')"
    return f"replace(replace(replace({x}, '→', '->'), '←', '<-'), '…', '...')"


ID_TEXT = "'Parsed tracking ID: ' || ids[1] || ' (carrier: ' || coalesce(known_carrier, 'unknown') || ').'"
PARTS = f"""nullif(concat_ws(chr(10), CASE WHEN len(ids) > 0 THEN '- ' || {ID_TEXT} END,
      CASE WHEN n_eta THEN '- ETA (handbook): ' || min_days || '–' || max_days || ' business days (' || service
        || ', ' || o || '→' || d || ').' END,
      CASE WHEN n_quote THEN '- Estimated label price: ~$8.0 USD (standard, zone: INTRA_REGION, billable 1.0 kg).'
        || chr(10) || '- Note: This is a non-binding estimate; surcharges and contracts vary.' END), '')"""


def answer_of(n_contexts: str) -> str:
    parts = f"""concat_ws(chr(10), {PARTS},
      '- ' || coalesce({ID_TEXT}, 'Please share a valid tracking ID (and carrier if known).'),
      CASE WHEN {n_contexts} > 0 THEN '- Using ' || {n_contexts} || ' retrieved context chunk(s).' END,
      '- No live tracking is used; info is handbook-based.')"""
    return ascii_of(parts)


ANSWERED = f"""{ESTIMATED.replace('WITH ', f"WITH chunks AS ({SQL['chunks']}), ", 1)}, {HITS},
answered AS (
  SELECT *, (coalesce(texts, []) || CASE WHEN n_eta THEN [{NOTE}] ELSE [] END)[1:4] AS contexts
  FROM estimated LEFT JOIN hits USING (msg_id))"""
ORACLES["triage_answers"] = f"""
{ANSWERED}
SELECT msg_id, {answer_of('len(contexts)')} AS answer, coalesce(array_to_string(refs, '|'), '') AS citations
FROM answered"""
ORACLES["prompts"] = f"""
{ANSWERED}
SELECT msg_id,
  {lit(f'<|system|>{chr(10)}{SYSTEM}{chr(10)}')} ||
  CASE WHEN len(contexts) > 0 THEN {lit(f'<|user|>{chr(10)}(Context — citations):{chr(10)}')} ||
    array_to_string(['- ' || x FOR x IN contexts], chr(10)) || chr(10) ELSE '' END ||
  {lit(f'<|user|>{chr(10)}')} || text || {lit(f'{chr(10)}<|assistant|>{chr(10)}')} AS prompt,
  {lit(f'{SYSTEM}{chr(10)}{chr(10)}[Context]{chr(10)}')} || array_to_string(contexts, chr(10) || chr(10)) ||
  CASE WHEN len(ids) > 0 THEN {lit(f'{chr(10)}{chr(10)}[ParsedTrackingID]: ')} || ids[1] ELSE '' END ||
  {lit(f'{chr(10)}{chr(10)}[User]{chr(10)}')} || text || {lit(f'{chr(10)}{chr(10)}[Assistant]{chr(10)}')} AS sections
FROM answered"""
ORACLES["plain_answers"] = f"""
{IDS}, chunks AS ({SQL['chunks']}),
vectors AS (SELECT vec_id, embedding AS vec, count(*) OVER () AS n FROM embeddings),
queries AS (SELECT msg_id AS query_id, vec FROM messages JOIN vectors ON conv_id % n = vec_id),
one_each AS (SELECT DISTINCT vec FROM queries),
scored AS (SELECT q.vec AS query_id, source, chunk_id, {SCORE} AS score FROM one_each q, chunks c),
best AS (
  SELECT query_id AS vec, list(source || '#' || chunk_id ORDER BY rank) AS refs
  FROM (SELECT *, {RANK} AS rank FROM scored) WHERE rank <= 3 GROUP BY query_id)
SELECT msg_id,
  concat_ws(chr(10),
    CASE WHEN msg_id NOT IN (SELECT msg_id FROM found)
         THEN '- Please share your tracking/waybill ID (and carrier if known).' END,
    '- Using 3 handbook chunk(s) from the knowledge base.',
    '- No live tracking is used; info is handbook-based.') AS answer,
  array_to_string(refs, '|') AS citations
FROM messages JOIN queries ON msg_id = query_id JOIN best USING (vec)"""
MEMORY = f"""
{ESTIMATED},
counted AS (
  SELECT *, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN 0 ELSE 1 END
            + CASE WHEN n_eta THEN 1 ELSE 0 END AS n_contexts
  FROM estimated),
replied AS (SELECT msg_id, conv_id, turn, text, {answer_of('n_contexts')} AS answer FROM counted),
entries AS (
  SELECT msg_id, conv_id, turn, answer, turn * 2 AS place, 'user' AS role, text FROM replied
  UNION ALL SELECT msg_id, conv_id, turn, answer, turn * 2 + 1, 'assistant', answer FROM replied),
remembered AS (
  SELECT *, coalesce(array_to_string(list(role || ': ' || substr(text, 1, 500)) OVER (
              PARTITION BY conv_id ORDER BY place {LAST6}), chr(10)), '') AS history
  FROM entries)
SELECT msg_id, conv_id, turn, answer, history FROM remembered WHERE role = 'user'"""
ORACLES["conversation_answers"] = MEMORY
ORACLES["stream_answers"] = MEMORY
ORACLES["conversation_clear"] = ORACLES["stream_clear"] = (
    MEMORY.replace("PARTITION BY conv_id", "PARTITION BY conv_id, part")
    .replace("conv_id, turn, text,", "conv_id, part, turn, text,").replace("conv_id, turn, answer, turn * 2", "conv_id, part, turn, answer, turn * 2")
    .replace(
        "FROM estimated),",
        "FROM (SELECT *, count(*) FILTER (msg_id % 5 = 0) OVER (PARTITION BY conv_id ORDER BY turn) AS part\n"
        "        FROM estimated)),",
    )
)
ORACLES["conversation_generator"] = ORACLES["stream_handover"] = f"""
{ESTIMATED.replace('WITH ', 'WITH RECURSIVE ', 1)},
ready AS (
  SELECT msg_id, conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, ids[1] AS first_id,
         'user: ' || substr(text, 1, 500) AS said, CASE WHEN n_eta THEN [{NOTE}] ELSE [] END AS notes,
         {ascii_of(PARTS)} AS parts
  FROM estimated),
walk(msg_id, conv_id, turn, i, answer, seen, lines) AS (
  SELECT 0::BIGINT, conv_id, 0::BIGINT, 0::BIGINT, '', []::VARCHAR[], []::VARCHAR[] FROM ready WHERE i = 1
  UNION ALL
  SELECT msg_id, conv_id, turn, i, answer, seen,
         list_concat(seen, [said, 'assistant: ' || substr(answer, 1, 500)])[-6:]
  FROM (
    SELECT *, concat_ws(chr(10), parts, len(contexts) || ' ' || coalesce(substr(md5(contexts[1]), 1, 8), '-') || ' '
                || coalesce(first_id, '-')) AS answer
    FROM (
      SELECT r.*, w.lines AS seen, (CASE WHEN len(w.lines) > 0
               THEN ['Previous turns:' || chr(10) || array_to_string(w.lines, chr(10))] ELSE [] END || notes)[1:4]
               AS contexts
      FROM walk w JOIN ready r ON r.conv_id = w.conv_id AND r.i = w.i + 1)))
SELECT msg_id, conv_id, turn, answer, coalesce(array_to_string(seen, chr(10)), '') AS history FROM walk WHERE i > 0"""
ORACLES["triage_answers_blocks"] = ORACLES["answer_sink"] = ORACLES["triage_answers"]
ORACLES["history_hot"] = ORACLES["history_last6"]
SEARCHED = MEMORY.replace(ESTIMATED, ANSWERED).replace(
    "+ CASE WHEN n_eta THEN 1 ELSE 0 END AS n_contexts\n  FROM estimated",
    "+ coalesce(len(texts), 0) + CASE WHEN n_eta THEN 1 ELSE 0 END AS all_contexts,\n"
    "         least(4, all_contexts) AS n_contexts\n  FROM answered",
).replace(
    "SELECT msg_id, conv_id, turn, answer, history FROM remembered WHERE role = 'user'",
    "SELECT msg_id, r.conv_id, r.turn, answer, history, coalesce(array_to_string(refs, '|'), '') AS citations\n"
    "FROM remembered r JOIN answered USING (msg_id) WHERE role = 'user'",
)
for name in ("conversation_retrieval", "stream_retrieval", "stream_retrieval_blocks"):
    ORACLES[name] = SEARCHED
ORACLES["corpus_splits"] = f"""
{cte('instructions')}
SELECT 'a' AS source, instruction AS input_raw, response AS assistant_raw FROM instructions WHERE o_orderkey % 5 <> 0
UNION ALL
SELECT DISTINCT 'b', instruction, response FROM instructions WHERE o_orderkey % 5 = 0"""
THREADS = f"""
WITH RECURSIVE threaded_tweets AS ({SQL['threaded_tweets']}),
named AS (
  SELECT tweet_id AS up, regexp_replace(unnest(string_split(response_tweet_id, ',')), '\\.0$', '') AS id
  FROM threaded_tweets),
ups AS (
  SELECT id, min_by(up, length(up) * 1000000000000 + CAST(up AS BIGINT)) AS up FROM named
  WHERE id <> up AND id IN (SELECT tweet_id FROM threaded_tweets)
    -- the circles begin with the first turn
    AND NOT (CAST(id AS BIGINT) % 1000 = 0 AND CAST(up AS BIGINT) // 1000 = CAST(id AS BIGINT) // 1000)
  GROUP BY id),
walk(tweet_id, thread, turn) AS (
  SELECT tweet_id, tweet_id, 0::BIGINT FROM threaded_tweets WHERE tweet_id NOT IN (SELECT id FROM ups)
  UNION ALL SELECT ups.id, thread, turn + 1 FROM walk JOIN ups ON ups.up = tweet_id)"""
ORACLES["tweet_threads"] = f"{THREADS} SELECT tweet_id, thread, turn FROM walk"
ORACLES["thread_chat_text"] = f"""
{THREADS}
SELECT thread, count(*) AS tweets,
       md5({lit(f'<|system|>{chr(10)}{SYSTEM}{chr(10)}')} || string_agg(
         CASE WHEN inbound = 'True' THEN '<|user|>' ELSE '<|assistant|>' END || chr(10) || text || chr(10), ''
         ORDER BY turn, length(tweet_id), tweet_id)) AS text_md5
FROM walk JOIN threaded_tweets USING (tweet_id) GROUP BY thread"""
ORACLES["phrases_conversations"] = f"""
WITH syllables AS (SELECT unnest({SYLLABLES}) AS s, unnest(range(0, {len(SYLLABLES)})) AS i),
phrases AS (
  SELECT a.s || b.s || c.s AS phrase, min((a.i * {len(SYLLABLES)} + b.i) * {len(SYLLABLES)} + c.i) AS rank, count(*) AS n
  FROM syllables a, syllables b, syllables c GROUP BY 1),
held AS (
  SELECT conv_id, turn, sum(n) AS phrases, min_by(phrase, rank) AS first
  FROM conversations, phrases WHERE contains(text, phrase) GROUP BY conv_id, turn)
SELECT conv_id, turn, phrases IS NOT NULL AS any, CAST(coalesce(phrases, 0) AS BIGINT) AS phrases, first
FROM conversations LEFT JOIN held USING (conv_id, turn)"""
ORACLES["chat_text_conversation"] = f"""
SELECT conv_id,
       CASE WHEN bool_or(role = 'system') THEN '' ELSE {lit(f'<|system|>{chr(10)}{SYSTEM}{chr(10)}')} END ||
       string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id"""

# --- lanes --------------------------------------------------------------------------------------

LANE_LO, LANE_HI = eta_days("service", "zone")
ORACLES["eta_by_lane"] = f"""
{cte('lane_counts')}, z AS (
  SELECT origin_cc, dest_cc, lower(service) AS service, shipments, {zone('origin_cc', 'dest_cc')} AS zone
  FROM lane_counts)
SELECT origin_cc, dest_cc, service, shipments, CAST({LANE_LO} AS BIGINT) AS min_days,
       CAST({LANE_HI} AS BIGINT) AS max_days
FROM z"""
BILLABLE = (
    "greatest(0.01::DOUBLE, coalesce(weight_kg, 0), "
    "CASE WHEN l_cm > 0 AND w_cm > 0 AND h_cm > 0 THEN l_cm * w_cm * h_cm / 5000.0::DOUBLE ELSE 0 END)"
)


def cents(x: str) -> str:
    """Half-even rounding of the exact binary value: DuckDB has no such function, so the value is
    written out with all its binary digits and rounded as a wide decimal."""
    return f"round_even(CAST(printf('%.34f', {x}) AS DECIMAL(38, 34)), 2)"


LISTED = ", ".join(lit(c) for c in COUNTRIES)
ORACLES["message_quotes"] = f"""
{KNOWN},
rows AS (
  SELECT msg_id, [{LISTED}][1 + conv_id % 25] AS o, [{LISTED}][1 + msg_id % 25] AS d,
         {SERVICES}[1 + msg_id % 3] AS service, greatest(0.01::DOUBLE, (msg_id % 40)::DOUBLE / 8) AS kg
  FROM known WHERE n_quote),
priced AS (
  SELECT *, {zone('o', 'd')} AS zone, greatest(1, CAST(ceil(kg / 0.5::DOUBLE) AS BIGINT)) AS halves FROM rows)
SELECT msg_id, service, zone, CAST({cents('kg')} AS DOUBLE) AS billable_kg,
       CAST(CAST((CAST(CASE zone WHEN 'INTRA_COUNTRY' THEN 3.5 WHEN 'INTRA_REGION' THEN 6 ELSE 12 END AS DECIMAL(6, 2))
         + CAST(CASE zone WHEN 'INTRA_COUNTRY' THEN 1 WHEN 'INTRA_REGION' THEN 2 ELSE 4 END AS DECIMAL(6, 2)) * (halves - 1))
         * CAST(CASE service WHEN 'express' THEN 1.6 WHEN 'economy' THEN 0.8 ELSE 1 END AS DECIMAL(4, 2))
         AS DECIMAL(18, 2)) AS DOUBLE) AS price_usd
FROM priced"""
ORACLES["cosine_columns"] = """
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
ORACLES["stored_hits"] = """
SELECT vec_id,
       CASE WHEN vec_id % 3 <> 0 THEN 'kb' || label WHEN vec_id % 2 <> 0 THEN 'file.md' ELSE 'kb' END AS source,
       CASE WHEN vec_id % 5 <> 0 THEN CAST(vec_id AS VARCHAR) WHEN vec_id % 7 <> 0 THEN CAST(label AS VARCHAR)
            ELSE '' END AS chunk_id,
       CASE WHEN vec_id % 4 <> 0 THEN CAST(embedding[1] AS DOUBLE) ELSE 0 END AS score
FROM embeddings"""
ORACLES["quote_by_zone"] = f"""
{cte('weighed_lanes')}, w AS (
  SELECT {zone('origin_cc', 'dest_cc')} AS zone, lower(service) AS service, shipments, {BILLABLE} AS kg
  FROM weighed_lanes),
p AS (
  SELECT *, greatest(1, CAST(ceil(kg / 0.5::DOUBLE) AS BIGINT)) AS halves,
         CAST(CASE zone WHEN 'INTRA_COUNTRY' THEN 3.5 WHEN 'INTRA_REGION' THEN 6 ELSE 12 END AS DECIMAL(6, 2)) AS base,
         CAST(CASE zone WHEN 'INTRA_COUNTRY' THEN 1 WHEN 'INTRA_REGION' THEN 2 ELSE 4 END AS DECIMAL(6, 2)) AS step,
         CAST(CASE service WHEN 'express' THEN 1.6 WHEN 'economy' THEN 0.8 ELSE 1 END AS DECIMAL(4, 2)) AS mult
  FROM w)
SELECT zone, service, CAST(sum(shipments) AS BIGINT) AS shipments,
       CAST(sum(CAST((base + step * (halves - 1)) * mult AS DECIMAL(18, 2)) * shipments) AS DOUBLE) AS price_usd,
       CAST(sum(CAST({cents('kg')} AS DECIMAL(18, 2)) * shipments) AS DOUBLE) AS billed_kg
FROM p GROUP BY zone, service"""
ORACLES["billable_weight"] = f"""
{cte('line_weights')}
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST({cents(BILLABLE)} AS DOUBLE) AS billable_kg
FROM line_weights"""

# --- guard --------------------------------------------------------------------------------------

ASKS = r"(tracking|waybill|order)\s*(number|id)"


def guarded(rows: str) -> str:
    """CTEs from ``rows`` (msg_id, raw, require_id, refuse_link, ...) to ``guarded`` with answer."""
    t = "raw"
    for p in (
        r"(?i)cutting knowledge date:[^\n]*|today date:[^\n]*",
        r"https?://\S+|www\.\S+|\S+\.(?:com|net|org|io|co|ly)\b",
        rf"(?i)@{WORD}+|dm|direct message",
        r"(?i)(?:thanks for reaching out|we'?re here to help|view it here)[^\n]*",
        r"[*~_]{1,3}",
    ):
        t = sub(t, p)
    bullet = sub(sub("x", r"^\s*\d+[.)]\s*(.+)$", r"- \1", ""), r"\s*[.·•-]+$", "", "")
    first = sub("x", r"^\s*\d+[.)]\s*(.+)$", r"- \1", "")
    sentences = f"string_split({sub('joined', '([.!?])' + chr(92) + 's+', chr(92) + '1' + chr(1))}, chr(1))"
    return f"""
stripped AS (SELECT *, {t} AS t FROM {rows}),
lined AS (
  SELECT *, [trim(x) FOR x IN string_split(t, chr(10)) IF trim(x) <> ''] AS lines FROM stripped),
marked AS (
  SELECT *, [{bullet} FOR x IN lines IF {matches(first, r'^[-*]\s')}] AS bs, array_to_string(lines, ' ') AS joined
  FROM lined),
bulleted AS (
  SELECT *, CASE WHEN len(bs) > 0 THEN bs
                 ELSE ['- ' || trim(x) FOR x IN {sentences} IF trim(x) <> ''][1:4] END AS b0
  FROM marked),
asked AS (
  SELECT *, CASE WHEN require_id AND len([x FOR x IN b0 IF {matches('lower(x)', ASKS)}]) = 0
                 THEN [{lit(ASK_LINE)}] || b0 ELSE b0 END AS b1
  FROM bulleted),
refused AS (
  SELECT *, CASE WHEN refuse_link
                      AND len([x FOR x IN b1 IF {matches('x', "(?i)can('?|no)t share links|cannot share links")}]) = 0
                 THEN [{lit(REFUSAL)}] || b1 ELSE b1 END AS b2
  FROM asked),
guarded AS (
  SELECT *, array_to_string([CASE WHEN starts_with(x, '- ') THEN x ELSE '- ' || trim(ltrim(x, '-* ')) END
                             FOR x IN b2[1:4]], chr(10)) AS answer
  FROM refused)"""


RAW = f"""{cte('raw_answers')},
intents AS (SELECT *, {intent_of('user_msg')} AS intent, {matches('user_msg', LINK)} AS refuse_link FROM raw_answers),
ruled AS (SELECT *, {missing('intent', 'user_msg', 'tracking')} AS require_id FROM intents),
{guarded('ruled')}"""
ORACLES["guard_answers"] = f"{RAW} SELECT msg_id, intent, answer FROM guarded"
ORACLES["guarded_replies"] = f"""
{KNOWN},
said AS (
  SELECT msg_id, '1) See https://track.example.com/x now.' || chr(10) || '2) ' || text || chr(10) || '3. Wait -' AS raw,
         missing_id AS require_id, wants_link AS refuse_link
  FROM known),
{guarded('said')}
SELECT msg_id, answer AS reply FROM guarded"""
ORACLES["ascii_safe"] = f"""
{cte('raw_answers')}, ruled AS (
  SELECT *, false AS require_id, {matches('user_msg', LINK)} AS refuse_link FROM raw_answers),
{guarded('ruled')}
SELECT msg_id, {ascii_of('answer')} AS answer FROM guarded"""
ORACLES["guard_conversations"] = f"""
{PAIRS}, intents AS (
  SELECT CAST(src_key AS BIGINT) AS msg_id, input_raw, assistant_raw AS raw, {intent_of('input_raw')} AS intent,
         {matches('input_raw', LINK)} AS refuse_link
  FROM reply),
ruled AS (SELECT *, {missing('intent', 'input_raw', 'CAST(NULL AS VARCHAR)')} AS require_id FROM intents),
{guarded('ruled')}
SELECT msg_id, answer FROM guarded"""
LINKISH = rf"https?://|www\.|\.com|\.net|\.org|@{WORD}+"
CONCISE = r"len(regexp_extract_all(answer, '(?m)^\s*[-*\d)]')) BETWEEN 2 AND 4"
REPORT = f"""
SELECT intent, count(*) AS answers, count(*) FILTER (WHERE {matches('lower(answer)', ASKS)}) AS ask_ids,
       count(*) FILTER (WHERE NOT {matches('lower(answer)', LINKISH)}) AS no_links,
       count(*) FILTER (WHERE {CONCISE}) AS concise,
       count(*) FILTER (WHERE {' OR '.join(f"contains(answer, {lit(p)})" for p in BLOCKED)}) AS blocked
FROM guarded GROUP BY intent"""
ORACLES["guard_report"] = RAW + REPORT
ORACLES["guard_eval"] = f"""{cte('raw_answers')},
ruled AS (
  SELECT *, {intent_of('user_msg')} AS intent, {matches('user_msg', LINK)} AS refuse_link,
         NOT {matches('lower(user_msg)', r'(awb|waybill|tracking|order)\s*(no|number|id)|\b\d{8,}\b')} AS require_id
  FROM raw_answers),
{guarded('ruled')}
{REPORT}"""
ORACLES["answer_audit"] = f"""
{cte('raw_answers')}, a AS (SELECT msg_id, raw AS answer FROM raw_answers)
SELECT msg_id, {matches('lower(answer)', ASKS)} AS asks_id, NOT {matches('lower(answer)', LINKISH)} AS no_links,
       {CONCISE} AS concise,
       concat_ws('|', {', '.join(f"CASE WHEN contains(answer, {lit(p)}) THEN {lit(p)} END" for p in BLOCKED)}) AS blocked,
       {matches('answer', rf'(?i)https?://|www\.|\.(com|net|org|io|co|ly)\b|@{WORD}+')} AS more_links
FROM a"""
