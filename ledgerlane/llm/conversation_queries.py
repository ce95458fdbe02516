"""Queries of license scans, conversation tries and repairs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlane.llm import license_scan
from ledgerlane.llm.common import documents
from ledgerlane.llm.conversation_repair import damage_and_repair
from ledgerlane.llm.conversation_trie import prefix_trie

# crc32 of texts of ASCII letters: the usual table of 256 numbers, then byte by byte.
CRC_TABLE = """crc AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM range(256) r(i)))"""


def crc_of(codes: str) -> str:
    """SQL for the checksum of a list of byte values; table ``crc`` is joined."""
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


def _codes(text: str) -> str:
    return f"list_transform(range(1, length({text}) + 1), lambda k: ord(substr({text}, k, 1))::BIGINT)"


# --- licenses ---------------------------------------------------------------
def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SPLIT = "string_split(trim(regexp_replace(translate({0}, '" + license_scan.UPPER + "', '" + license_scan.LOWER + r"'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ')"


def _words(text: str) -> str:
    split = _SPLIT.format(text)
    return f"list_filter({split}, lambda w: w <> '')"


_PLACES = " UNION ALL ".join(
    f"SELECT doc, i, '{label}' AS label FROM spots WHERE " + " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split(), 1))
    for phrase, label in license_scan.PHRASES)

LICENSES = f"""
WITH templates AS (
  SELECT number, label, {_words('body')} AS words
  FROM (VALUES {', '.join(f"({n}, '{label}', {_quoted(body)})" for n, (label, body) in enumerate(license_scan.TEMPLATES))}) v(number, label, body)),
pieces AS (
  SELECT number, label, len(words) AS size, i AS at_, words[i + 1:i + 3] AS gram FROM templates, LATERAL (SELECT unnest(range(0, len(words) - 2)) AS i)),
docs AS (SELECT row_number() OVER () AS doc, doc_id, {_words("coalesce(text, '')")} AS words FROM documents),
spots AS (SELECT doc, words, unnest(range(0, len(words))) AS i FROM docs),
places AS ({_PLACES}),
base AS (SELECT doc, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY doc),
votes AS (
  SELECT DISTINCT doc, number, label, size, at_, i - at_ AS diagonal FROM spots JOIN pieces ON gram = words[i + 1:i + 3] WHERE i + 3 <= len(words)),
opened AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc, number ORDER BY diagonal, at_) <= {license_scan.SLACK} THEN 0 ELSE 1 END AS opens FROM votes),
spanned AS (SELECT *, sum(opens) OVER (PARTITION BY doc, number ORDER BY diagonal, at_ ROWS UNBOUNDED PRECEDING) AS span FROM opened),
covers AS (SELECT DISTINCT doc, number, label, size, span, unnest(range(at_, at_ + 3)) AS place FROM spanned),
sums AS (SELECT doc, number, span, count(*) AS covered FROM covers GROUP BY ALL),
bounds AS (SELECT doc, number, label, size, span, min(diagonal + at_) AS first, max(diagonal + at_) + 2 AS last FROM spanned GROUP BY ALL),
accepted AS (
  SELECT doc, number, label, first, last, covered, covered / size AS share FROM bounds JOIN sums USING (doc, number, span)
  WHERE covered >= {license_scan.COVERED} * size AND last - first + 1 <= {license_scan.LONGEST} * size + {license_scan.SLACK}),
apart AS (
  SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY doc ORDER BY first, last, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM accepted),
regions AS (SELECT *, sum(opens) OVER (PARTITION BY doc ORDER BY first, last, number ROWS UNBOUNDED PRECEDING) AS region FROM apart),
notices AS (SELECT doc, label, share FROM regions QUALIFY rank() OVER (PARTITION BY doc, region ORDER BY share DESC, covered DESC) = 1),
own AS (SELECT doc, list(DISTINCT label) AS labels, max(share) AS score FROM notices GROUP BY doc)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(o.labels, [])))), ','), '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN base b USING (doc) LEFT JOIN own o USING (doc)
"""


# --- trie -------------------------------------------------------------------
TRIE = f"""
WITH {CRC_TABLE},
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(name ORDER BY turn NULLS FIRST, name) AS names, list(octet_length(encode(text))::BIGINT ORDER BY turn NULLS FIRST, name) AS sizes
  FROM turns GROUP BY conv_id),
heads AS (SELECT own.*, {crc_of(_codes("conv_id::VARCHAR"))} % 9 AS h FROM own, crc),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.names[:o.h], []), o.names[o.h + 1:]) AS names, list_concat(coalesce(b.sizes[:o.h], []), o.sizes[o.h + 1:]) AS sizes
  FROM heads o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
starts AS (SELECT conv_id, names, sizes, unnest(range(0, len(names) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT depth, names[:depth] AS node, names[:greatest(depth - 1, 0)] AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
         any_value(CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(names) = depth), '')) AS ends_sha256
  FROM starts GROUP BY 1, 2, 3),
children AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node),
tops AS (SELECT *, unnest(range(0, depth + 1)) AS top FROM counted),
sums AS (SELECT node[:top] AS node, top AS depth, sum((n_convs - 1) * size) AS saved, count(*) FILTER (n_children = 0) AS n_leaves FROM tops GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN sums s ON s.depth = n.depth AND s.node = n.node LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.parent
"""


# --- repair -----------------------------------------------------------------
def _way(cost: str, letter: str, line: str, after: str) -> str:
    """A struct (cost, letters, lines): one edit before the rest."""
    return f"{{'c': {after}.c + {cost}, 'l': '{letter}' || {after}.l, 't': {line} || {after}.t}}"


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


_USER, _ASSISTANT = "'user:' || chr(10)", "'assistant:' || chr(10)"
# Per state: the one insertion (line, state after it), and what a kept role leads to.
_ADDS = ((_USER, 2), (_USER, 2), (_ASSISTANT, 3), (_USER, 2))
_KEEPS = ((("s", 1), ("u", 2)), (("u", 2),), (("a", 3),), (("u", 2),))


def _row(state: int) -> str:
    """Best rest of the conversation from a row, its turn first."""
    ways = [_way("4", "D", "''", f"v{state}")]
    line, after = _ADDS[state]
    role = line.split(":")[0] + ":'"
    ways.append(f"CASE WHEN code <> 'x' THEN {_way('3 + extra', 'R', f'{role} || text || chr(10)', f'v{after}')} END")
    for letter, then in _KEEPS[state]:
        ways.append(f"CASE WHEN code = '{letter}' THEN {_way('extra', 'K', f'line || chr(10)', f'v{then}')} END")
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1] AS v{state}"


def _inserted(source: str) -> str:
    columns = ", ".join(f"{_least(f'v{s}', _way('3', 'I', line, f'v{after}'))} AS v{s}" for s, (line, after) in enumerate(_ADDS))
    return f"(SELECT conv_id, rn, {columns} FROM {source})"


_STEP = "(SELECT r.conv_id, r.rn, " + ", ".join(_row(s) for s in range(4)) + " FROM f JOIN rows_ r ON r.conv_id = f.conv_id AND r.rn = f.rn - 1)"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

REPAIR = f"""
WITH RECURSIVE {CRC_TABLE},
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
faulty AS (SELECT given.*, {crc_of(_codes("key"))} % 20 AS fault FROM given, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM faulty WHERE fault <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS rn,
         rtrim(text, {_SPACE}) AS body, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS letter
  FROM damaged),
told AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
       WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS first_fault,
       lag(letter) OVER (PARTITION BY conv_id ORDER BY rn) || letter AS pair
  FROM placed),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (first_fault = 'blank') AS blank,
         count(*) FILTER (first_fault = 'duplicate') AS duplicate, count(*) FILTER (first_fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM told GROUP BY conv_id),
rows_ AS (
  SELECT conv_id, rn, text, role || ':' || text AS line, CASE WHEN first_fault IN ('blank', 'duplicate') THEN 'x' ELSE letter END AS code,
         CASE WHEN first_fault = 'truncated' THEN 3 ELSE 0 END AS extra
  FROM told),
f AS (
  SELECT conv_id, n + 1 AS rn, {{'c': 0, 'l': '', 't': ''}} AS v0, {{'c': 6, 'l': 'II', 't': {_USER} || {_ASSISTANT}}} AS v1,
         {{'c': 3, 'l': 'I', 't': {_ASSISTANT}}} AS v2, {{'c': 0, 'l': '', 't': ''}} AS v3
  FROM counts
  UNION ALL
  SELECT conv_id, rn, v0, v1, v2, v3 FROM {_inserted(_inserted(_STEP))})
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.l, '') AS audit,
       sha256(coalesce(left(v0.t, length(v0.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
     LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM i.conv_id AND f.rn = 1
"""


def _conversations(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/conversations.parquet")


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases, and notices by three-word runs on diagonals."""
    return license_scan.digest(license_scan.scan(documents(spark, folder)))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(_conversations(spark, folder))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return damage_and_repair(_conversations(spark, folder))


QUERIES = {"op11_license_scan": op11_license_scan, "op12_prefix_trie": op12_prefix_trie, "op13_conversation_repair": op13_conversation_repair}
ORACLES = {"op11_license_scan": LICENSES, "op12_prefix_trie": TRIE, "op13_conversation_repair": REPAIR}
