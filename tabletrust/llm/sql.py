"""DuckDB SQL that the queries must agree with, row for row."""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_TEST_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

DECONTAMINATE = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_TEST_WORDS}') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{_TEST_WORDS}') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size,
    unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
           lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS words
  FROM b WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS start, w FROM d, sizes
  WHERE len(w) >= size
), found AS (
  SELECT doc_id, start, dw.size, item_id
  FROM doc_windows dw JOIN item_windows iw
    ON iw.size = dw.size AND iw.words = array_to_string(w[start:start + dw.size - 1], ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(start, start + size)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM found GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

LINE_DEDUP = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM documents
), k AS (SELECT *, trim({_LOWER.format("line")}, {_BLANKS}) AS key FROM l),
often AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL), ''))
    AS kept_sha256
FROM k LEFT JOIN often o USING (key) GROUP BY doc_id
"""

LINE_RULES = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w
  FROM documents
), l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM l WHERE len({_WORDS.format("line")}) > 0 GROUP BY doc_id
), wins AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), twice AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words) AS n FROM wins) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), k AS (
  SELECT doc_id, source, trim({_LOWER.format("line")}, {_BLANKS}) AS key FROM l
), often AS (
  SELECT source, key FROM k WHERE key <> ''
  GROUP BY source, key HAVING count(DISTINCT doc_id) > 10
), gone AS (
  SELECT doc_id, CAST(sum(len({_WORDS.format("key")})) AS BIGINT) AS n_removed
  FROM k JOIN often USING (source, key) GROUP BY doc_id
), base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_removed, 0) AS n_removed
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_removed * 100 <= n_words * 50
    AS kept
FROM base
"""

TOOL_CALLS = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, 'call_' || conv_id || '_' || turn AS call_id,
    CASE WHEN contains(coalesce(text, ''), chr(10)) THEN 'ask' ELSE 'tell' END AS tool,
    'call_' || conv_id || '_' || (turn - 2) AS uses
  FROM conversations WHERE role = 'user'
), r AS (
  SELECT 'call_' || conv_id || '_' || (turn - 1) AS call_id, count(*) AS n_results,
    min(text) AS content
  FROM conversations WHERE role = 'assistant' GROUP BY ALL
), chain AS (
  SELECT conv_id, turn AS root, turn, 0 AS wave FROM c
  WHERE uses NOT IN (SELECT call_id FROM c)
  UNION ALL
  SELECT c.conv_id, root, c.turn, wave + 1
  FROM chain JOIN c ON c.conv_id = chain.conv_id AND c.turn = chain.turn + 2
), json AS (
  SELECT c.*, n_results, content, wave, root,
    '{"closed":' || ends_with(text, '.') || ',"size":'
      || CASE WHEN len(text) > 400 THEN '"' || len(text) || '"' ELSE len(text)::VARCHAR END
      || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}' AS arguments
  FROM c LEFT JOIN r USING (call_id) JOIN chain USING (conv_id, turn)
)
SELECT conv_id, call_id, turn, tool, CAST(wave AS BIGINT) AS wave,
  CASE WHEN root >= 2 THEN 'missing' ELSE 'ordered' END AS order_state,
  CAST(1 AS BIGINT) AS copies, coalesce(n_results, 0) AS n_results,
  CASE WHEN len(text) > 400 THEN 'type:size' ELSE '' END AS faults,
  '{"arguments":' || CAST(to_json(arguments) AS VARCHAR) || ',"id":"' || call_id || '","name":"'
    || tool || '"'
    || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || CAST(to_json(content) AS VARCHAR) END
    || '}' AS message
FROM json
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)
), least AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
  FROM windows JOIN least USING (w) WHERE first < doc_id
), spans AS (
  SELECT doc_id, count(*) AS n_removed, sum(CAST(NOT before AS INT)) AS n_spans
  FROM (
    SELECT doc_id, coalesce(p = 1 + lag(p) OVER (PARTITION BY doc_id ORDER BY p), false) AS before
    FROM gone)
  GROUP BY doc_id
), bytes AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS b
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS p FROM d)
), kept AS (
  SELECT doc_id, string_agg(b, '' ORDER BY p) AS h FROM bytes ANTI JOIN gone USING (doc_id, p)
  GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id,
    unnest(list_transform(range(1, greatest(len(w) - 5, 0) + 2),
           lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle
  FROM d WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, first AS component_id
FROM d LEFT JOIN n USING (doc_id)
  JOIN (SELECT x AS doc_id, min(y) AS first FROM reach GROUP BY x) USING (doc_id)
"""

HARD_NEGATIVES = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0)
      AS BIGINT) AS score
  FROM e a JOIN e b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score,
    n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score,
  negative_score
FROM ranked WHERE rank <= 5
"""


def _grown(state: int, cost: str, move: str, line: str) -> str:
    """A state's best so far, as (padded cost and audit, lines), with one more edit."""
    key = f"acc[{state}].k"
    more = f"lpad(CAST(CAST(substr({key}, 1, 9) AS INT) + {cost} AS VARCHAR), 9, '0')"
    lines = f"acc[{state}].t || [{line}]" if line else f"acc[{state}].t"
    return f"{{'k': {more} || substr({key}, 10) || '{move}', 't': {lines}}}"


#: States: 1 nothing written, 2 a system turn, 3 ends in user, 4 ends in assistant.
_WRITES = {1: 3, 2: 3, 3: 4, 4: 3}
_ROLE = {3: "user", 4: "assistant"}
_DEAD = "{'k': '900000000', 't': CAST([] AS VARCHAR[])}"


def _read_turn() -> str:
    """The four states after a turn: every edit of it, then up to three insertions."""
    ways: dict[int, list[str]] = {s: [] for s in _WRITES}
    for s, to in _WRITES.items():
        ways[s].append(_grown(s, "4", "D", ""))
        ways[to].append(
            f"CASE WHEN fault < 2 THEN {_grown(s, '3 + 3 * fault', 'R', repr(_ROLE[to] + ':') + ' || text')}"
            f" ELSE {_DEAD} END"
        )
    kept = {"s": [(1, 2)], "u": [(1, 3), (2, 3), (4, 3)], "a": [(3, 4)]}
    for initial, moves in kept.items():
        for s, to in moves:
            best = _grown(s, "3 * fault", "K", "role || ':' || text")
            ways[to].append(f"CASE WHEN fault < 2 AND role[1] = '{initial}' THEN {best} ELSE {_DEAD} END")
    return "[" + ", ".join(f"list_min([{', '.join(w)}])" for w in ways.values()) + "]"


def _inserted(acc: str) -> str:
    """The four states with one insertion more, where that is better."""
    grown: dict[int, list[str]] = {s: [f"acc[{s}]"] for s in _WRITES}
    for s, to in _WRITES.items():
        grown[to].append(_grown(s, "3", "I", repr(_ROLE[to] + ":")))
    new = "[" + ", ".join(f"list_min([{', '.join(w)}])" for w in grown.values()) + "]"
    return f"list_transform([{acc}], lambda acc: {new})[1]"


CHAT_REPAIR = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(
      list_prepend(4294967295, list_transform(
        string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':'
          || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda crc, byte: list_reduce(
        list_prepend(xor(crc, byte), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
        lambda x, ignored: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS damage
  FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN damage = 3 THEN 2 ELSE 1 END)) AS copy
  FROM named WHERE damage <> 0
), placed AS (
  SELECT *, trim(text, {_BLANKS}) AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY
    turn NULLS FIRST, role,
    sha256(coalesce(CAST(conv_id AS VARCHAR), '') || ':' || length(role) || ':' || role || text), copy)
    AS place
  FROM hurt
), faulty AS (
  SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (
      PARTITION BY conv_id, role, text ORDER BY place) > 1 AS duplicate,
    lag(role) OVER (PARTITION BY conv_id ORDER BY place) AS before
  FROM placed
), turns AS (
  SELECT *, CASE WHEN blank OR duplicate THEN 2 WHEN bare[-1] IN ('.', '!', '?') THEN 0 ELSE 1 END
    AS fault
  FROM faulty
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS place,
    {_inserted(_inserted("[{'k': '000000000', 't': CAST([] AS VARCHAR[])}, " + ", ".join([_DEAD] * 3) + "]"))}
    AS states
  FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT conv_id, place, {_inserted(_inserted("states"))} AS states
  FROM (
    SELECT w.conv_id, t.place, {_read_turn()} AS states
    FROM (SELECT conv_id, place, states AS acc FROM walk) w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.place = w.place + 1)
), best AS (
  SELECT conv_id, list_min([states[1], states[4]]) AS b FROM walk
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
    count(*) FILTER (WHERE fault = 1) AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before[1] || role[1] NOT IN ('su', 'ua', 'au'))
      AS illegal
  FROM turns GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(substr(b.k, 1, 9), '0') AS BIGINT) AS cost,
  coalesce(substr(b.k, 10), '') AS audit,
  sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN best t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
