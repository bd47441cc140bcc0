"""Reference SQL, for DuckDB, of the operators that SQL can express."""

from __future__ import annotations

from .quality_rules import BITS, CURRENT, MEASUREMENTS, POLICIES

ORACLES: dict[str, str] = {}

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
FAILS = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "too_many_words": "n_words > 1000000",
    "short_mean_word": "word_chars < 2 * n_words",
    "long_mean_word": "word_chars > 15 * n_words",
    "symbols": "n_symbols > 0.2::DOUBLE * n_words",
    "duplicate_lines": "n_dup_lines > 0.5::DOUBLE * n_lines",
    "bullet_lines": "n_bullet_lines > 0.9::DOUBLE * n_lines",
    "ellipsis_lines": "n_ellipsis_lines > 0.5::DOUBLE * n_lines",
    "few_letter_words": "n_letter_words < 0.6::DOUBLE * n_words",
    "giant_word": "longest_word > 1000",
}
bits_sql = " + ".join(f"CASE WHEN {FAILS[name]} THEN {bit} ELSE 0 END" for name, bit in BITS.items())
hard, soft = POLICIES[CURRENT].masks()
base, _ = POLICIES["base"].masks()
ORACLES["op10_quality_rules"] = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
split AS (
  SELECT doc_id, x, {WORDS.format('x')} AS ws,
         [l FOR l IN string_split(x, chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines
  FROM docs),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM split),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM places),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY doc_id),
measured AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum([length(w) FOR w IN ws]), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len([l FOR l IN lines IF regexp_matches(trim(l, {BLANKS}), '^[-*•]')]) AS BIGINT) AS n_bullet_lines,
         CAST(len([l FOR l IN lines IF regexp_matches(trim(l, {BLANKS}), '(…|\.\.\.)$')]) AS BIGINT)
           AS n_ellipsis_lines,
         CAST(len([w FOR w IN ws IF regexp_matches(w, '\pL')]) AS BIGINT) AS n_letter_words,
         CAST(coalesce(list_max([length(w) FOR w IN ws]), 0) AS BIGINT) AS longest_word
  FROM split LEFT JOIN covered USING (doc_id)),
ruled AS (SELECT *, CAST({bits_sql} AS BIGINT) AS fail_bits FROM measured)
SELECT doc_id, {', '.join(MEASUREMENTS)}, fail_bits, (fail_bits & {base}) <> 0 AS base_failed,
       (fail_bits & {hard}) = 0 AND bit_count(fail_bits & {soft}) <= {POLICIES[CURRENT].allowed} AS kept
FROM ruled"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op8_minhash"] = f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS.format(LOWER)} AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
           WHEN len(ws) >= 4 THEN [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]
           WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * c >= 80 * (a.n + b.n - c)),
steps AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, steps.b FROM reach JOIN steps ON steps.a = reach.other),
parts AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM parts LEFT JOIN sizes USING (doc_id)"""

# crc32 of a decimal number, by the table of its polynomial.
CRC = """
bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS crcs FROM bits WHERE k = 8)"""


def crc32_sql(number: str) -> str:
    steps = f"[4294967295] || [CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST({number} AS VARCHAR), '')]"
    return f"xor(list_reduce({steps}, lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295)"


def _leaf(text: str) -> str:
    values = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


def _grow(name: str, leaves: str) -> str:
    """All levels of the trees over ``leaves`` (tree, pos, width, hash), and the siblings of every node."""
    run = f"OVER (PARTITION BY lvl, tree, pos // 16 ORDER BY pos ROWS BETWEEN {{}})"
    before, after = run.format("UNBOUNDED PRECEDING AND 1 PRECEDING"), run.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
    return f"""
{name}(lvl, tree, pos, width, hash) AS (
  SELECT 0, tree, pos, width, hash FROM {leaves}
  UNION ALL
  SELECT lvl + 1, tree, pos // 16, (width + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos))
  FROM {name} WHERE width > 1 GROUP BY lvl, tree, pos // 16, width),
{name}_siblings AS (
  SELECT *, coalesce(string_agg(hash, '') {before}, '') AS l, coalesce(string_agg(hash, '') {after}, '') AS r
  FROM {name})"""


ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE {CRC},
docs AS (
  SELECT *, {_leaf('text')} AS leaf, coalesce('.' || source, '') AS tree,
         CASE WHEN {crc32_sql('doc_id')} % 5 = 0
              THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents, crc_table),
leaves AS (
  SELECT doc_id, tree, leaf AS hash, coalesce(changed, leaf) AS start, count(*) OVER (PARTITION BY tree) AS width,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM docs), {_grow('up', 'leaves')},
subroots AS (
  SELECT tree AS source, '' AS tree, hash, count(*) OVER () AS width,
         row_number() OVER (ORDER BY encode(tree)) - 1 AS pos
  FROM up WHERE width = 1), {_grow('above', 'subroots')},
paths AS (
  SELECT doc_id, leaves.hash AS leaf, start, subroots.hash AS subroot,
         list_concat(
           [{{'l': s.l, 'r': s.r}} FOR s IN
            (SELECT list(u ORDER BY u.lvl) FROM up_siblings u
             WHERE u.tree = leaves.tree AND u.width > 1 AND u.pos = leaves.pos // CAST(pow(16, u.lvl) AS BIGINT))],
           [{{'l': s.l, 'r': s.r}} FOR s IN
            (SELECT list(u ORDER BY u.lvl) FROM above_siblings u
             WHERE u.width > 1 AND u.pos = subroots.pos // CAST(pow(16, u.lvl) AS BIGINT))]) AS path
  FROM leaves JOIN subroots ON subroots.source = leaves.tree),
numbered AS (SELECT *, row_number() OVER () AS row FROM paths),
folds(row, k, node) AS (
  SELECT row, 0, start FROM numbered
  UNION ALL SELECT row, k + 1, sha256(path[k + 1].l || node || path[k + 1].r)
  FROM folds JOIN numbered USING (row) WHERE k < len(path))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([s.l || s.r FOR s IN path], '')) AS proof_sha256,
       node AS folded_root, node = root AS verified
FROM numbered JOIN folds ON folds.row = numbered.row AND k = len(path),
     (SELECT hash AS root FROM above WHERE width = 1)"""

ORACLES["op13_prefix_trie"] = f"""
WITH RECURSIVE {CRC},
own AS (
  SELECT conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_id,
         strlen(coalesce(text, '')) AS n_bytes,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1
           AS place
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id),
shares AS (
  SELECT s.conv_id, s.conv_id - s.conv_id % 5 AS base, {crc32_sql('s.conv_id')} % 9 AS h,
         least({crc32_sql('s.conv_id')} % 9, coalesce(b.n, 0)) AS taken
  FROM crc_table, sizes s LEFT JOIN sizes b ON b.conv_id = s.conv_id - s.conv_id % 5),
turns AS (
  SELECT s.conv_id, place + 1 AS depth, turn_id, n_bytes FROM shares s JOIN own ON own.conv_id = base WHERE place < taken
  UNION ALL
  SELECT conv_id, taken + place - h + 1, turn_id, n_bytes FROM shares JOIN own USING (conv_id) WHERE place >= h),
starts AS (
  SELECT conv_id, depth, n_bytes, string_agg(turn_id, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path,
         depth = max(depth) OVER (PARTITION BY conv_id) AS ends
  FROM turns
  UNION ALL
  SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM turns) FROM sizes),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n_bytes) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM starts GROUP BY path, depth),
children AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
family AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
sums AS (
  SELECT s.path, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(f.saved) AS saved_tokens
  FROM family f JOIN starts s ON s.conv_id = f.conv_id AND s.depth <= f.depth GROUP BY s.path)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM family f JOIN sums USING (path)
LEFT JOIN family p ON f.depth > 0 AND p.path = left(f.path, length(f.path) - 32)"""
