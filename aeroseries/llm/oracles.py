"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from aeroseries.llm.queries import RULES, SHARDS
from aeroseries.llm.sharding import TABLE_SIZE

_BLANK = r"[ \x09-\x0D]+"


def words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{_BLANK}'), lambda w: w <> '')"


#: The table is filled claim by claim: shard ``claim % n`` takes the first free slot of its permutation.
SHARDING = f"""
WITH RECURSIVE shards(name, turn) AS (VALUES {", ".join(f"('{name}', {i})" for i, name in enumerate(SHARDS))}),
steps AS (
  SELECT list(('0x' || substr(md5(name || '/offset'), 1, 8))::BIGINT % {TABLE_SIZE} ORDER BY turn) AS offsets,
         list(('0x' || substr(md5(name || '/skip'), 1, 8))::BIGINT % {TABLE_SIZE - 1} + 1 ORDER BY turn) AS skips
  FROM shards),
fill(claim, filled, slot, offsets, skips) AS (
  SELECT 0::BIGINT, list_value()::BIGINT[], NULL::BIGINT, offsets, skips FROM steps
  UNION ALL
  SELECT claim + 1, list_append(filled, free), free, offsets, skips FROM (
    SELECT *, list_filter(list_transform(range({TABLE_SIZE}),
      lambda j: (offsets[1 + claim % {len(SHARDS)}] + j * skips[1 + claim % {len(SHARDS)}]) % {TABLE_SIZE}),
      lambda s: NOT list_contains(filled, s))[1] AS free
    FROM fill WHERE claim < {TABLE_SIZE})),
lookup AS (SELECT slot, (claim - 1) % {len(SHARDS)} AS shard FROM fill WHERE claim > 0),
keyed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {TABLE_SIZE} AS slot
  FROM documents)
SELECT doc_id, slot, shard FROM keyed JOIN lookup USING (slot)
"""

SUBSTRING_DEDUP = f"""
WITH docs AS (SELECT doc_id, {words("text")} AS words FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS gram
  FROM docs, unnest(range(1, greatest(len(words) - 11, 1))) AS u(p)),
first AS (SELECT gram, min(doc_id) AS least FROM windows GROUP BY gram),
gone AS (
  SELECT DISTINCT doc_id, p + k AS pos
  FROM windows JOIN first USING (gram), unnest(range(0, 13)) AS v(k) WHERE least < doc_id),
per_doc AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(words) AS n, CASE WHEN gone IS NULL THEN words
    ELSE list_filter(words, lambda w, i: NOT list_contains(gone, i)) END AS kept
  FROM docs d LEFT JOIN per_doc USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(kept) AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM kept
"""

QUALITY_RULES = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, {words("text")} AS words FROM documents),
figures AS (
  SELECT row, doc_id, CAST(len(words) AS BIGINT) AS n_words, words,
    CAST(list_sum([0] || list_transform(words, lambda w: length(w))) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(text, '\\P{{Lu}}', '', 'g')) AS BIGINT) AS n_capitals,
    list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '') AS lines
  FROM docs),
windows AS (
  SELECT row, p, array_to_string(words[p:p + 4], ' ') AS gram
  FROM figures, unnest(range(1, greatest(len(words) - 3, 1))) AS u(p)),
twice AS (SELECT row, p FROM windows QUALIFY count(*) OVER (PARTITION BY row, gram) > 1),
repeats AS (
  SELECT row, count(DISTINCT p + k) AS n FROM twice, unnest(range(0, 5)) AS v(k) GROUP BY row),
judged AS (
  SELECT f.*, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    n_words < 10 OR 100 * coalesce(n, 0) > 20 * n_words AS base_failed
  FROM figures f LEFT JOIN repeats r USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 100 > len(lines) * 30 OR n_capitals * 2 > word_chars
    OR word_chars > n_words * 25 OR len(list_filter(words, lambda w: regexp_matches(w, '\\p{{L}}'))) * 2 < n_words) AS kept
FROM judged
"""

_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_LONGEST = sorted(RULES, key=lambda rule: (-len(rule[0] + rule[1]), rule[0] + rule[1]))

URL_FILTERS = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_FITS.format(h, p)} THEN '{h}{p}'" for h, p, _ in _LONGEST)} END AS rule,
  CASE {" ".join(f"WHEN {_FITS.format(h, p)} THEN '{v}'" for h, p, v in _LONGEST)} ELSE 'allow' END AS verdict
FROM named
"""


WARC = """
WITH named AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest,
    octet_length(encode(coalesce(html, ''))) AS bytes FROM pages),
first AS (SELECT digest, min(page_id) AS page FROM named WHERE bytes >= 100 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page IS NULL OR page_id = page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> page THEN page END AS refers_to
FROM named LEFT JOIN first USING (digest)
"""


#: CRC-32 of each number from 0 to 255, then of a blob's bytes: the usual table form of the polynomial.
_CRC_TABLE = """crc_table AS (
  SELECT list(value ORDER BY byte) AS crcs FROM (
    SELECT byte, list_reduce([byte] || range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) AS value FROM range(256) AS r(byte)))"""


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes; needs ``crcs`` of ``crc_table``."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    data = f"list_transform(range(octet_length(encode({text}))), lambda i: {byte})"
    return f"xor(4294967295, list_reduce([4294967295::BIGINT] || {data}, lambda c, b: xor(c >> 8, crcs[1 + (xor(c, b) & 255)])))"


_FEATURES = """SELECT {key}, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM {table}"""

IMPORTANCE = f"""
WITH {_CRC_TABLE},
docs AS ({_FEATURES.format(key="row_number() OVER () AS row, doc_id", table="documents")}),
items AS ({_FEATURES.format(key="item_id", table="benchmark")}),
said AS (SELECT row, unnest(words) AS word FROM docs),
asked AS (SELECT unnest(words) AS word FROM items),
vocabulary AS (
  SELECT word, {crc32("word")} % 10000 AS bucket FROM (SELECT word FROM said UNION SELECT word FROM asked), crc_table),
s AS (SELECT bucket, count(*) AS n FROM said JOIN vocabulary USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM asked JOIN vocabulary USING (word) GROUP BY bucket),
gains AS (
  SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM said) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM asked) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) AS b(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weights AS (
  SELECT row, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total
  FROM said JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT row, doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
    CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight,
    CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296))) AS BIGINT) AS noise
  FROM docs LEFT JOIN weights USING (row)),
placed AS (
  SELECT row, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score,
  CASE WHEN rank <= 10 * (SELECT count(*) FROM placed) // 100 THEN rank END AS rank
FROM scored LEFT JOIN placed USING (row)
"""


def _leaf(n_chars: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text"]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v}))::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


#: Both trees level by level; a language's tree has ``name`` 0 or 1 for null or not and the language, the top one has 2.
MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
docs AS (
  SELECT row_number() OVER () AS row, doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN {crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("n_chars + 1")} END AS changed
  FROM documents, crc_table),
leaves AS (
  SELECT *, (lang IS NOT NULL)::INT || coalesce(lang, '') AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs),
nodes(tree, level, size, pos, node) AS (
  SELECT tree, 0, count(*) OVER (PARTITION BY tree), pos, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, (size + 1) // 2, pos // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM nodes WHERE size > 1 GROUP BY tree, level, size, pos // 2),
subroots AS (
  SELECT tree, node, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM nodes WHERE size = 1),
tops(level, size, pos, node) AS (
  SELECT 0, count(*) OVER (), pos, node FROM subroots
  UNION ALL
  SELECT level + 1, (size + 1) // 2, pos // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM tops WHERE size > 1 GROUP BY level, size, pos // 2),
own AS (
  SELECT l.row, n.level, (l.pos >> n.level) % 2 AS odd, s.node AS sibling
  FROM leaves l JOIN (SELECT DISTINCT tree, level FROM nodes WHERE size > 1) n USING (tree)
  LEFT JOIN nodes s ON s.tree = l.tree AND s.level = n.level AND s.pos = xor(l.pos >> n.level, 1)),
upper AS (
  SELECT r.tree, t.level, (r.pos >> t.level) % 2 AS odd, s.node AS sibling
  FROM subroots r, (SELECT DISTINCT level FROM tops WHERE size > 1) t
  LEFT JOIN tops s ON s.level = t.level AND s.pos = xor(r.pos >> t.level, 1)),
ways AS (
  SELECT row, level, odd, sibling FROM own UNION ALL
  SELECT row, 1000 + level, odd, sibling FROM leaves JOIN upper USING (tree)),
paths AS (
  SELECT row, list(struct_pack(odd := odd, sibling := coalesce(sibling, '')) ORDER BY level) AS steps FROM ways GROUP BY row),
folds(row, k, node, steps) AS (
  SELECT row, 0, coalesce(changed, leaf), coalesce(steps, []) FROM leaves LEFT JOIN paths USING (row)
  UNION ALL
  SELECT row, k + 1, sha256(CASE WHEN steps[k + 1].odd = 1 THEN steps[k + 1].sibling || node ELSE node || steps[k + 1].sibling END), steps
  FROM folds WHERE k < len(steps)),
folded AS (SELECT row, node, sha256(array_to_string(list_transform(steps, lambda s: s.sibling), '')) AS proof FROM folds WHERE k = len(steps))
SELECT doc_id, leaf, s.node AS subroot, t.node AS root, proof AS proof_sha256, f.node AS folded_root, f.node = t.node AS verified
FROM leaves JOIN subroots s USING (tree) JOIN folded f USING (row), (SELECT node FROM tops WHERE size = 1) t
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_sharding": SHARDING,
        "op4_substring_dedup": SUBSTRING_DEDUP,
        "op6_quality_rules": QUALITY_RULES,
        "op8_warc": WARC,
        "op10_url_filters": URL_FILTERS,
        "op11_merkle_manifest": MERKLE,
        "op12_importance_resampling": IMPORTANCE,
    }
