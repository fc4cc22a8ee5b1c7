"""DuckDB SQL for the catalog's queries, written apart from the library it checks."""

from __future__ import annotations

from ledgerloom.plans import expected as words
from ledgerloom.plans.expected import CANDIDATE_PATTERNS, CONSTANTS, FLOAT_LITERAL, PLAIN_NUMBER, PUBLISHED, SPACE_CHARS

_BLANKS = "'" + SPACE_CHARS + "'"
_FLOAT = "'" + FLOAT_LITERAL + "'"
_PLAIN = "'" + PLAIN_NUMBER + "'"
_SIMPLE = r"'-?\d+\.?\d*'"


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


def _drop(x: str, chars: str) -> str:
    return f"regexp_replace({x}, '[{chars}]', '', 'g')"


def _unwrap(x: str) -> str:
    return (
        f"CASE WHEN starts_with({x}, '(') AND ends_with({x}, ')') "
        f"THEN '-' || substr({x}, 2, greatest(length({x}) - 2, 0)) ELSE {x} END"
    )


def _clean(x: str) -> str:
    return _unwrap(_drop(_strip(x), "$,%"))


def _float(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({_strip(x)}, {_FLOAT}) "
        f"THEN TRY_CAST(replace({_strip(x)}, '_', '') AS DOUBLE) END"
    )


def _to_float(x: str) -> str:
    return _float(f"({_clean(x)})")


def _last(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, {pattern})[-1]"


def _last_number(x: str) -> str:
    return _last(_drop(x, "$,"), _SIMPLE)


def _primary(x: str) -> str:
    """Answer lines from the end, else the best-scored candidate in pattern order."""
    t = _strip(x)
    number = r"'^[-+]?\d*\.?\d+$'"
    tail = _strip("string_split(l, ':')[-1]")
    lines = (
        f"list_filter(list_transform(list_transform(string_split({t}, chr(10)), lambda l: {_strip('l')}), "
        f"lambda l: CASE WHEN regexp_matches(l, {number}) THEN l "
        f"WHEN contains(lower(l), 'final_answer') AND contains(l, ':') AND regexp_matches({tail}, {number}) "
        f"THEN {tail} END), lambda l: l IS NOT NULL)"
    )
    found = "list_concat(" * (len(CANDIDATE_PATTERNS) - 1)
    for n, pattern in enumerate(CANDIDATE_PATTERNS):
        found += f"regexp_extract_all({t}, {_q(pattern)}, 1)" + ("" if n == 0 else ")")
        if n < len(CANDIDATE_PATTERNS) - 1:
            found += ", "
    bare = f"list_transform({found}, lambda m: {_unwrap(_drop('m', '$,%'))})"
    numbers = rf"list_filter({bare}, lambda m: regexp_matches(m, '^[+-]?(\d+\.?\d*|\.\d+)$'))"
    scored = (
        f"list_transform({numbers}, lambda m: {{'best': m, "
        f"'score': length({_drop('m', '.-')}) + CASE WHEN contains(m, '.') THEN 10 ELSE 0 END}})"
    )
    year = "NOT contains(m.best, '.') AND abs(CAST(m.best AS DOUBLE)) BETWEEN 1900 AND 2100"
    best = (
        f"list_reduce({scored}, lambda a, m: CASE WHEN a.score = 0 AND {year} THEN a "
        f"WHEN m.score > a.score THEN m ELSE a END, {{'best': CAST(NULL AS VARCHAR), 'score': CAST(0 AS BIGINT)}}).best"
    )
    return rf"CASE WHEN regexp_matches({t}, '\d') THEN coalesce({lines}[-1], {best}) END"


def _near(a: str, b: str) -> str:
    return f"coalesce(abs(({a}) - ({b})) < 1e-6, false)"


def _basic(a: str, b: str) -> str:
    return _near(f"TRY_CAST({_last_number(a)} AS DOUBLE)", f"TRY_CAST({_last_number(b)} AS DOUBLE)")


def _match(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN {a} IS NULL AND {b} IS NULL "
        f"WHEN {_float(a)} IS NOT NULL AND {_float(b)} IS NOT NULL THEN abs({_float(a)} - {_float(b)}) < 1e-6 "
        f"ELSE {a} = {b} END"
    )


def _says(x: str, options: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {_q(w)})" for w in options) + ")"


def _short(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END"


def _change(old: str, new: str, kind: str) -> str:
    return (
        f"CASE WHEN {kind} IN ('auto', 'simple') THEN CASE WHEN {old} < 0 AND {new} < 0 THEN {old} - {new} "
        f"ELSE {new} - {old} END WHEN {kind} = 'cost' THEN {old} - {new} WHEN {kind} = 'percentage' THEN "
        f"CASE WHEN {old} = 0 THEN 0.0 ELSE ({new} - {old}) / nullif({old}, 0) * 100 END ELSE {new} - {old} END"
    )


_TIME_LABEL = (
    r"(regexp_matches(lower({x}), '\b(19|20)[0-9]{{2}}\b') OR regexp_matches(lower({x}), '\b(q[1-4]|quarter)\b')"
)


def _time_label(x: str) -> str:
    return _TIME_LABEL.format(x=x) + f" OR {_says(x, words.TIME_WORDS)})"


# Common table expressions: the derived corpus.
_BASE = """
WITH amt AS (
  SELECT o.o_custkey AS rec_ord, c.c_name AS record_id, o.o_orderpriority AS priority,
         CAST(substr(o.o_orderpriority, 1, 1) AS BIGINT) - 1 AS row_ord, year(o.o_orderdate) AS yr,
         SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS amt
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY ALL),
named AS (
  SELECT rec_ord, record_id, row_ord, yr, amt,
         CASE row_ord WHEN 0 THEN 'total revenue (' || priority || ')' WHEN 1 THEN 'net income (' || priority || ')'
                      WHEN 2 THEN 'operating costs (' || priority || ')' ELSE priority END AS row_name
  FROM amt),
labels_of_rows AS (SELECT DISTINCT rec_ord, record_id, row_ord, row_name FROM named),
cells AS (
  SELECT rec_ord, record_id, row_ord, row_name, yr AS col_ord, CAST(yr AS VARCHAR) AS col_name,
         CASE (yr + rec_ord) % 5 WHEN 0 THEN CAST(amt AS VARCHAR) WHEN 1 THEN '$' || CAST(amt AS VARCHAR)
              WHEN 2 THEN '(' || CAST(amt AS VARCHAR) || ')' WHEN 3 THEN CAST(amt AS VARCHAR) || '%'
              ELSE CASE WHEN row_ord % 2 = 0 THEN CAST(amt AS VARCHAR) ELSE 'n/a' END END AS raw
  FROM named
  UNION ALL
  SELECT rec_ord, record_id, row_ord, row_name, 9998, 'as_of',
         CASE WHEN rec_ord % 3 = 1 THEN '12/31/2001'
              WHEN rec_ord % 3 = 2 AND row_ord % 2 = 1 THEN 'Dec 31, 2001'
              ELSE CAST(row_ord + 2001 AS VARCHAR) || '-12-31' END
  FROM labels_of_rows
  UNION ALL
  SELECT rec_ord, record_id, row_ord, row_name, 9999, 'note', 'see ' || row_name FROM labels_of_rows),
pairs AS (
  SELECT a.rec_ord, a.record_id, a.row_ord, a.row_name, a.yr, a.amt AS old_v, b.amt AS new_v,
         (a.row_ord * 10 + a.yr % 10) * 3 AS place
  FROM named a JOIN named b ON a.rec_ord = b.rec_ord AND a.row_ord = b.row_ord AND b.yr = a.yr + 1),
asked AS (
  SELECT rec_ord, record_id, place + 1 AS turn, 'what was ' || row_name || ' in ' || yr || '?' AS question,
         CAST(old_v AS VARCHAR) AS answer, CAST(old_v AS VARCHAR) AS program FROM pairs
  UNION ALL SELECT rec_ord, record_id, place + 2, 'and what was the change from ' || yr || ' to ' || (yr + 1) || '?',
         CAST(new_v - old_v AS VARCHAR),
         'subtract(' || CAST(new_v AS VARCHAR) || ', ' || CAST(old_v AS VARCHAR) || ')' FROM pairs
  UNION ALL SELECT rec_ord, record_id, place + 3, 'so what was the percentage change?',
         CAST(CAST(round(CAST(new_v - old_v AS DOUBLE) / CAST(old_v AS DOUBLE), 5) AS DECIMAL(18,5)) AS VARCHAR),
         'subtract(' || CAST(new_v AS VARCHAR) || ', ' || CAST(old_v AS VARCHAR) || '), divide(#0, '
         || CAST(old_v AS VARCHAR) || ')' FROM pairs),
turns AS (
  SELECT CASE WHEN rec_ord % 4 = 0 THEN 'dev' ELSE 'train' END AS split, *, answer AS executed_answer,
         rec_ord % 3 = 0 AS is_hybrid FROM asked),
preds AS (
  SELECT record_id, turn, CASE WHEN (turn + rec_ord) % 3 = 0 THEN 'The answer is 1.'
                               ELSE 'In 1998 the answer is $' || answer END AS actual,
         CASE WHEN (turn + rec_ord) % 11 = 0 THEN 'timeout' END AS error
  FROM turns WHERE (turn + rec_ord) % 5 <> 0),
keys AS (
  SELECT CASE WHEN c_custkey % 4 = 0 THEN 'dev' ELSE 'train' END AS split, c_custkey AS rec_ord,
         c_name AS record_id FROM customer),
messy AS (
  SELECT split, rec_ord, CASE WHEN rec_ord % 97 = 5 THEN ''
    WHEN rec_ord % 50 = 7 THEN 'Customer#' || lpad(CAST(rec_ord - 1 AS VARCHAR), 9, '0')
    ELSE record_id END AS record_id FROM keys),
messy_cells AS (
  SELECT * REPLACE (CASE WHEN rec_ord % 17 = 4 AND col_ord = 9999 THEN 'as_of' ELSE col_name END AS col_name)
  FROM cells WHERE rec_ord % 13 <> 3),
results AS (
  SELECT t.rec_ord, t.record_id, t.turn, @SHORT_QUESTION@ AS question, t.answer AS expected,
         coalesce('ERROR: ' || p.error, p.actual, 'ERROR: no prediction') AS actual,
         p.record_id IS NOT NULL AND p.error IS NULL AND @BASIC@ AS is_correct, t.is_hybrid
  FROM turns t LEFT JOIN preds p ON t.record_id = p.record_id AND t.turn = p.turn),
value_requests AS (
  SELECT rec_ord * 100000 + row_ord * 10000 + col_ord AS request_id, record_id,
         CASE (rec_ord + row_ord + col_ord) % 7 WHEN 1 THEN upper(row_name) WHEN 2 THEN substr(row_name, 1, 8)
              WHEN 3 THEN 'the ' || row_name || ' row' WHEN 4 THEN '@@@@'
              WHEN 5 THEN CASE WHEN row_ord = 0 THEN '' ELSE substr(row_name, 1, 3) END
              ELSE row_name END AS row_identifier,
         CASE WHEN (rec_ord + row_ord + col_ord) % 7 = 3 THEN 'fiscal ' || col_name
              WHEN (rec_ord + row_ord + col_ord) % 7 = 0 AND row_ord = 4 THEN '####'
              WHEN (rec_ord + row_ord + col_ord) % 7 = 6 THEN 'note' ELSE col_name END AS column_identifier
  FROM cells WHERE col_ord < 9000),
row_labels AS (SELECT DISTINCT rec_ord, record_id, row_ord, row_name FROM cells),
col_labels AS (SELECT DISTINCT rec_ord, record_id, col_ord, col_name FROM cells),
typing AS (
  SELECT rec_ord, record_id, col_ord, col_name, count(raw) AS value_count,
         bool_and(regexp_matches(raw, @PLAIN@)) AS plain,
         bool_and(regexp_matches(regexp_replace(regexp_replace(raw, '[$,]', '', 'g'),
                  '\\(([0-9.,]+)\\)', '-\\1', 'g'), @PLAIN@)) AS formatted,
         bool_or(contains(raw, '%')) AND bool_and(regexp_matches(replace(raw, '%', ''), @PLAIN@)) AS percent,
         bool_and(try_strptime(raw, '%Y-%m-%d') IS NOT NULL) OR bool_and(try_strptime(raw, '%m/%d/%Y') IS NOT NULL)
           OR bool_and(try_strptime(raw, '%b %d, %Y') IS NOT NULL) AS dated
  FROM cells GROUP BY ALL),
types AS (
  SELECT rec_ord, record_id, col_ord, col_name, value_count,
         CASE WHEN plain OR formatted THEN 'numeric' WHEN percent THEN 'percentage' WHEN dated THEN 'date'
              ELSE 'text' END AS column_type FROM typing),
heights AS (SELECT rec_ord, count(*) AS row_count FROM row_labels GROUP BY rec_ord),
catalog AS (
  SELECT t.rec_ord, t.record_id, col_ord, col_name, column_type, value_count < row_count AS nullable, row_count
  FROM types t JOIN heights h ON t.rec_ord = h.rec_ord),
axes AS (
  SELECT rec_ord, record_id, 'col' AS axis, col_ord AS ord, col_name AS label, @COL_TIME@ AS hit FROM col_labels
  UNION ALL SELECT rec_ord, record_id, 'row', row_ord, row_name, @ROW_METRIC@ FROM row_labels),
shapes AS (
  SELECT rec_ord, record_id, count(*) FILTER (axis = 'row') AS row_count,
         count(*) FILTER (axis = 'col') AS column_count,
         count(*) FILTER (axis = 'col' AND hit) AS time_columns,
         count(*) FILTER (axis = 'row' AND hit) AS metric_rows FROM axes GROUP BY ALL),
structures AS (
  SELECT *, CASE WHEN time_columns >= 2 AND metric_rows >= 1 THEN 'time_series'
                 WHEN row_count > column_count AND metric_rows > time_columns THEN 'metrics_by_categories'
                 WHEN time_columns > 0 OR metric_rows > 0 THEN 'mixed' ELSE 'unknown' END AS structure,
         CASE WHEN time_columns >= 2 AND metric_rows >= 1
              THEN least(0.9::DOUBLE, 0.5::DOUBLE + time_columns * 0.1::DOUBLE + metric_rows * 0.05::DOUBLE)
              WHEN row_count > column_count AND metric_rows > time_columns THEN 0.7
              WHEN time_columns > 0 OR metric_rows > 0 THEN 0.5 ELSE 0.2 END::DOUBLE AS confidence
  FROM shapes),
column_requests AS (
  SELECT rec_ord AS request_id, record_id,
         CASE WHEN rec_ord % 12 = 5 THEN NULL WHEN rec_ord % 12 = 2 THEN CAST([] AS VARCHAR[])
              WHEN rec_ord % 3 = 0 THEN ['1998', '1996', '1997'] WHEN rec_ord % 3 = 1 THEN ['note', '1999', 'none']
              ELSE ['none', 'nothing'] END AS target_columns FROM keys),
wanted AS (
  SELECT request_id, record_id, unnest(target_columns) AS col_name,
         generate_subscripts(target_columns, 1) - 1 AS target_pos FROM column_requests),
text_requests AS (
  SELECT rec_ord AS request_id, k.record_id,
         CASE WHEN rec_ord % 5 = 0 THEN 'what was the Increase in revenue?' WHEN rec_ord % 5 = 1
              THEN 'calculate the average' WHEN rec_ord % 5 = 2 THEN '1997 versus 1998'
              ELSE 'show the latest figures' END AS query,
         CASE WHEN rec_ord % 7 = 0 THEN 'aggregate' END AS operation,
         CASE WHEN rec_ord % 2 = 0 THEN target_columns END AS target_columns
  FROM keys k JOIN column_requests r ON r.request_id = k.rec_ord),
log AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(user_id AS VARCHAR) AS record_id, event_id AS seq,
         'show ' || event_type AS user_message,
         'the ' || event_type || ' Table holds ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS assistant_response,
         ts, CASE WHEN event_id % 9 = 0 THEN [event_type, 'compute'] WHEN event_id % 3 = 0 THEN [event_type] END AS tools,
         CASE WHEN event_id % 5 = 0 THEN [event_type, 'financial_table'] ELSE [event_type] END AS entities,
         CASE WHEN event_id % 4 = 0 THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS computed,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn_no FROM events),
chats AS (
  SELECT CAST(u.conv_id AS VARCHAR) AS session_id, u.turn AS seq, u.text AS user_message,
         a.text AS assistant_response,
         row_number() OVER (PARTITION BY u.conv_id ORDER BY u.turn) AS turn_no
  FROM conversations u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')
"""


def _base() -> str:
    return (
        _BASE.replace("@SHORT_QUESTION@", _short("t.question", 100))
        .replace("@BASIC@", _basic("p.actual", "t.answer"))
        .replace("@PLAIN@", _PLAIN)
        .replace("\\\\", "\\")
        .replace("@COL_TIME@", _time_label("col_name"))
        .replace("@ROW_METRIC@", _says("row_name", words.FINANCIAL_TERMS))
    )


_BREAKDOWN = """, counted AS (
  SELECT 'overall' AS level, 'all' AS name, count(*) FILTER (is_correct) AS correct, count(*) AS total FROM {source}
  UNION ALL SELECT 'turn', CAST(turn AS VARCHAR), count(*) FILTER (is_correct), count(*) FROM {source} GROUP BY turn
  UNION ALL SELECT 'type', 'simple', count(*) FILTER (is_correct AND NOT is_hybrid), count(*) FILTER (NOT is_hybrid) FROM {source}
  UNION ALL SELECT 'type', 'hybrid', count(*) FILTER (is_correct AND is_hybrid), count(*) FILTER (is_hybrid) FROM {source})
SELECT level, name, correct, total, CASE WHEN total > 0 THEN correct / total * 100 ELSE 0.0 END AS accuracy FROM counted"""

_SUMS = """, typed AS (
  SELECT c.*, t.column_type FROM cells c JOIN catalog t USING (rec_ord, col_ord)),
sums AS (
  SELECT record_id, col_ord, col_name, coalesce(sum(CAST(({clean}) AS DECIMAL(38,2))), 0)::DOUBLE AS total
  FROM typed WHERE column_type = 'numeric' GROUP BY ALL)"""


def _column_match() -> str:
    return f""", col_hits AS (
  SELECT q.request_id, c.col_ord, c.col_name,
         CASE WHEN lower(c.col_name) = n.needle THEN 0 ELSE 1 END AS rank
  FROM value_requests q JOIN col_labels c USING (record_id), LATERAL (SELECT lower({_strip('q.column_identifier')}) AS needle) n
  WHERE n.needle <> '' AND (contains(lower(c.col_name), n.needle) OR contains(n.needle, lower(c.col_name)))),
col_best AS (
  SELECT request_id, arg_min(col_ord, (rank, col_ord)) AS col_ord, arg_min(col_name, (rank, col_ord)) AS col_name,
         min(rank) AS rank FROM col_hits GROUP BY request_id)"""


def _row_match() -> str:
    return f""", overlap_hits AS (
  SELECT q.request_id, r.row_ord, r.row_name,
         CASE WHEN lower(r.row_name) = n.needle THEN 2.0
              ELSE least(length(r.row_name), length(n.needle)) / greatest(length(r.row_name), length(n.needle)) END AS score
  FROM value_requests q JOIN row_labels r USING (record_id), LATERAL (SELECT lower(q.row_identifier) AS needle) n
  WHERE n.needle <> '' AND (contains(lower(r.row_name), n.needle) OR contains(n.needle, lower(r.row_name)))),
overlap_best AS (
  SELECT request_id, arg_min(row_ord, (-score, row_ord)) AS row_ord, arg_min(row_name, (-score, row_ord)) AS row_name
  FROM overlap_hits WHERE score > 0.3 GROUP BY request_id),
direct_hits AS (
  SELECT q.request_id, r.row_ord, r.row_name, CASE WHEN lower(r.row_name) = n.needle THEN 0 ELSE 1 END AS rank
  FROM value_requests q JOIN row_labels r USING (record_id), LATERAL (SELECT lower({_strip('q.row_identifier')}) AS needle) n
  WHERE n.needle <> '' AND (contains(lower(r.row_name), n.needle) OR contains(n.needle, lower(r.row_name)))),
direct_best AS (
  SELECT request_id, arg_min(row_ord, (rank, row_ord)) AS row_ord, arg_min(row_name, (rank, row_ord)) AS row_name,
         min(rank) AS rank FROM direct_hits GROUP BY request_id)"""


def _similarity() -> str:
    """Similar rows of misspelt requests: 2 * matched / length, by the longest common block and then left and right of it.

    Labels are shorter than 200 letters, so none of them counts as too frequent. Blocks are looked for once per distinct
    pair of texts: the longest one, of those the first in the wording, of those the first in the label.
    """
    return f""", misspelt AS (
  SELECT rec_ord * 100000 + row_ord * 10000 + col_ord AS request_id, rec_ord, record_id,
         translate(upper(row_name), 'AEO', 'xyz') AS row_identifier FROM cells WHERE col_ord < 9000),
respelt AS (SELECT *, lower({_strip('row_identifier')}) AS a FROM misspelt),
label_tries AS (SELECT w.request_id, w.a, lower(r.row_name) AS b, r.row_ord, r.row_name
          FROM respelt w JOIN row_labels r USING (record_id) WHERE w.a <> ''),
plain_hits AS (SELECT request_id, arg_min(row_name, (CASE WHEN a = b THEN 0 ELSE 1 END, row_ord)) AS row_name, min(CASE WHEN a = b THEN 0 ELSE 1 END) AS rank
           FROM label_tries WHERE contains(a, b) OR contains(b, a) GROUP BY request_id),
text_pairs AS (SELECT DISTINCT a, b FROM label_tries),
blocks AS (
  SELECT a, b, 1 AS alo, length(a) + 1 AS ahi, 1 AS blo, length(b) + 1 AS bhi, 0 AS found, 0 AS level FROM text_pairs
  UNION ALL
  SELECT a, b, part.alo, part.ahi, part.blo, part.bhi, best.k, level + 1 FROM (
    SELECT *, list_extract(list_sort(flatten(list_transform(range(alo, ahi), lambda i: flatten(list_transform(range(blo, bhi), lambda j:
      list_transform(range(1, least(ahi - i, bhi - j) + 1), lambda k: CASE WHEN substr(a, i, k) = substr(b, j, k)
        THEN {{'n': -k, 'i': i, 'j': j, 'k': k}} ELSE {{'n': 0, 'i': i, 'j': j, 'k': 0}} END)))))), 1) AS best
    FROM blocks WHERE alo < ahi AND blo < bhi) x,
  LATERAL (SELECT unnest([{{'alo': alo, 'ahi': best.i, 'blo': blo, 'bhi': best.j, 'n': 0}},
                          {{'alo': best.i + best.k, 'ahi': ahi, 'blo': best.j + best.k, 'bhi': bhi, 'n': 1}}]) AS part) y
  WHERE best.k > 0),
ratios AS (SELECT a, b, 2.0 * sum(found) / 2 / (length(a) + length(b)) AS ratio FROM blocks GROUP BY a, b),
alike AS (SELECT request_id, arg_min(row_name, (-ratio, row_ord)) AS row_name, max(ratio) AS ratio
            FROM label_tries JOIN ratios USING (a, b) WHERE ratio > 0.4 GROUP BY request_id)
SELECT q.request_id, coalesce(d.row_name, s.row_name) AS matched_row,
       CASE WHEN d.rank = 0 THEN 'exact' WHEN d.rank = 1 THEN 'partial' WHEN s.ratio IS NOT NULL THEN 'similar' END AS row_match,
       CASE WHEN d.rank = 0 THEN 1.0 WHEN d.rank = 1 THEN 0.8 ELSE s.ratio END::DOUBLE AS row_score
FROM respelt q LEFT JOIN plain_hits d USING (request_id) LEFT JOIN alike s USING (request_id)"""


def _context(source: str, tools: str, computed: str) -> str:
    """Context of the five turns before, with the state lines in the order they first appeared."""
    before = "OVER (PARTITION BY session_id ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f""", shown AS (
  SELECT session_id, turn_no, 'turn_' || turn_no AS turn_id, {tools} AS called, {computed} AS result,
         'User: ' || user_message || coalesce(chr(10) || 'Assistant: ' || assistant_response, '') AS line FROM {source}
  UNION ALL SELECT session_id, max(turn_no) + 1, 'next', NULL, NULL, NULL FROM {source} GROUP BY session_id),
seen AS (
  SELECT session_id, turn_no, turn_id,
         list(line) OVER (PARTITION BY session_id ORDER BY turn_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS lines,
         last_value(called IGNORE NULLS) {before} AS last_tools,
         bool_or(result IS NOT NULL) {before} AS computed_before,
         min(CASE WHEN called IS NOT NULL THEN turn_no END) OVER (PARTITION BY session_id) AS first_tool,
         min(CASE WHEN result IS NOT NULL THEN turn_no END) OVER (PARTITION BY session_id) AS first_computed
  FROM shown),
state AS (
  SELECT *, CASE WHEN last_tools IS NOT NULL THEN '- Last tool calls: [''' || array_to_string(last_tools, ''', ''') || ''']' END AS a,
         CASE WHEN computed_before THEN '- Recent computations available for reference' END AS b FROM seen)
SELECT session_id, turn_id,
       CASE WHEN turn_no = 1 THEN 'This is the start of a new conversation.'
            ELSE 'Recent conversation history:' || chr(10) || array_to_string(lines, chr(10))
              || CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN chr(10) || chr(10) || 'Current context:' ELSE '' END
              || CASE WHEN first_computed < first_tool
                      THEN coalesce(chr(10) || b, '') || coalesce(chr(10) || a, '')
                      ELSE coalesce(chr(10) || a, '') || coalesce(chr(10) || b, '') END END AS context
FROM state"""


def _spoken() -> str:
    """Values of the demo expressions, each kind written out as what it means."""
    n = f"regexp_extract_all(expression, {_SIMPLE})"
    return f""", said AS (
  SELECT *, CASE request_id % 13 WHEN 0 THEN price + day WHEN 1 THEN price / day WHEN 2 THEN price - day
    WHEN 3 THEN price * day WHEN 6 THEN price WHEN 7 THEN day * -3 WHEN 8 THEN (price - day) / day
    WHEN 9 THEN -(price + day) * 2 WHEN 10 THEN abs(day - price) + 8 WHEN 11 THEN price - day - day * 2
    WHEN 12 THEN price END AS value, len({n}) AS n FROM spoken)"""


def _guide_names(axis: str, count: int | None) -> str:
    limit = f" AND rank <= {count}" if count else ""
    return f"(SELECT string_agg(label, ', ' ORDER BY ord) FROM hits h WHERE h.rec_ord = s.rec_ord AND axis = '{axis}'{limit})"


def oracle_sql() -> dict[str, str]:
    base = _base()
    clean = _clean("raw")
    sums = _SUMS.format(clean=clean)
    breakdown = _BREAKDOWN.format(source="results")
    sql: dict[str, str] = {}

    def add(name: str, query: str) -> None:
        sql[name] = base + query

    add("s1_corpus_scan", """SELECT count(*) FILTER (split = 'train') AS train_records,
        count(*) FILTER (split = 'dev') AS dev_records, count(*) AS total_records FROM keys""")
    add("s1_corpus_fields", """, columns_ AS (
          SELECT rec_ord, col_ord, col_name || '{' || string_agg(row_name || '=' || raw, ';' ORDER BY row_ord) || '}' AS text
          FROM cells GROUP BY rec_ord, col_ord, col_name),
        grids AS (SELECT rec_ord, string_agg(text, ';' ORDER BY col_ord) AS text FROM columns_ GROUP BY rec_ord),
        said AS (
          SELECT rec_ord, string_agg(question, '|' ORDER BY turn) AS conv_questions, string_agg(answer, '|' ORDER BY turn) AS conv_answers,
            string_agg(program, '|' ORDER BY turn) AS turn_program, string_agg(executed_answer, '|' ORDER BY turn) AS executed_answers,
            string_agg(CAST(turn % 2 = 0 AS VARCHAR), '|' ORDER BY turn) AS qa_split FROM turns GROUP BY rec_ord)
        SELECT k.split, k.rec_ord, k.record_id AS id, coalesce(d.text, '') AS pre_text, 'segment ' || c.c_mktsegment AS post_text,
          coalesce(g.text, '') AS table_text, s.conv_questions, s.conv_answers, s.turn_program, s.executed_answers, s.qa_split,
          CASE WHEN k.rec_ord % 3 = 0 THEN 'true' ELSE 'false' END AS has_type2_question
        FROM keys k JOIN customer c ON c.c_custkey = k.rec_ord LEFT JOIN documents d ON d.doc_id = k.rec_ord
        LEFT JOIN grids g ON g.rec_ord = k.rec_ord LEFT JOIN said s ON s.rec_ord = k.rec_ord""")
    add("j5_unequal_turn_lists", """, numbered AS (
          SELECT *, row_number() OVER (PARTITION BY rec_ord ORDER BY turn) AS n, count(*) OVER (PARTITION BY rec_ord) AS total FROM turns)
        SELECT rec_ord, record_id, n AS turn, question, answer, CASE WHEN n <= total - rec_ord % 7 THEN program END AS program,
          executed_answer, CASE WHEN n <= total - rec_ord % 2 THEN turn % 2 = 0 END AS qa_split
        FROM numbered WHERE n <= total - rec_ord % 3 AND n <= total - rec_ord % 5""")
    # Row order: labels in the order they first appear, column by column.
    add("s2_normalize_cells", """, seen AS (
          SELECT rec_ord, row_name, min((col_ord, row_ord)) AS first_seen FROM cells GROUP BY ALL),
        row_order AS (
          SELECT rec_ord, row_name, row_number() OVER (PARTITION BY rec_ord ORDER BY first_seen) - 1 AS row_ord FROM seen),
        col_order AS (
          SELECT rec_ord, col_ord, row_number() OVER (PARTITION BY rec_ord ORDER BY col_ord) - 1 AS new_ord FROM col_labels)
        SELECT k.split, c.rec_ord, c.record_id, o.new_ord AS col_ord, c.col_name, r.row_ord, c.row_name, c.raw
        FROM cells c JOIN keys k USING (rec_ord) JOIN row_order r USING (rec_ord, row_name)
        JOIN col_order o ON o.rec_ord = c.rec_ord AND o.col_ord = c.col_ord""")
    add("s2_normalize_records", """SELECT k.split, k.rec_ord, k.record_id, coalesce(d.text, '') AS pre_text,
        'segment ' || c.c_mktsegment AS post_text, CASE WHEN k.rec_ord % 3 = 0 THEN 'true' ELSE 'false' END AS has_type2_question
        FROM keys k JOIN customer c ON c.c_custkey = k.rec_ord LEFT JOIN documents d ON d.doc_id = k.rec_ord""")
    add("s2_normalize_turns", """SELECT split, rec_ord, record_id,
        row_number() OVER (PARTITION BY rec_ord ORDER BY turn) AS turn, question, answer, program, executed_answer,
        turn % 2 = 0 AS qa_split, is_hybrid FROM turns""")
    add("s3_list_records", """SELECT split, rec_ord, record_id FROM keys WHERE split = 'dev' ORDER BY rec_ord LIMIT 10""")
    add("s3_list_all_records", "SELECT split, rec_ord, record_id FROM keys")
    add("s3_listing_counts", """, c AS (SELECT split, count(*) AS total FROM keys GROUP BY split
        UNION ALL SELECT 'all', count(*) FROM keys)
        SELECT split, total, greatest(total - 10, 0) AS remaining FROM c""")
    add("s4_lookup_records", """, usable AS (
          SELECT m.record_id, arg_max(m.split, m.rec_ord) AS split, max(m.rec_ord) AS rec_ord FROM messy m
          WHERE m.record_id <> '' AND m.rec_ord IN (SELECT rec_ord FROM messy_cells) GROUP BY m.record_id),
        asked_ids AS (
          SELECT c_custkey AS request_id, CASE WHEN c_custkey % 4 = 0 THEN c_name
            WHEN c_custkey % 16 = 1 THEN 'CUSTOMER#00000' WHEN c_custkey % 4 = 1 THEN lower(c_name)
            WHEN c_custkey % 4 = 2 THEN substr(c_name, 13, 6) ELSE 'nobody ' || c_custkey END AS record_id FROM customer),
        misses AS (SELECT DISTINCT record_id FROM asked_ids WHERE record_id NOT IN (SELECT record_id FROM usable)),
        near AS (
          SELECT m.record_id, u.record_id AS other,
                 row_number() OVER (PARTITION BY m.record_id ORDER BY u.split = 'dev', u.rec_ord) AS rank
          FROM misses m JOIN usable u ON contains(lower(u.record_id), lower(m.record_id))),
        top AS (SELECT record_id, string_agg(other, '|' ORDER BY rank) AS names FROM near WHERE rank <= 5 GROUP BY record_id)
        SELECT a.request_id, a.record_id, CASE WHEN u.record_id IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status,
               u.split, u.rec_ord, CASE WHEN u.record_id IS NULL THEN (SELECT count(*) FROM usable) END AS available_count,
               CASE WHEN u.record_id IS NULL THEN coalesce(t.names, '') END AS similar_records
        FROM asked_ids a LEFT JOIN usable u ON u.record_id = a.record_id LEFT JOIN top t ON t.record_id = a.record_id""")
    add("s5_remaining_turns", """, firsts AS (SELECT DISTINCT rec_ord FROM turns ORDER BY rec_ord LIMIT 500)
        SELECT rec_ord, record_id, turn, question FROM turns
        WHERE rec_ord IN (SELECT rec_ord FROM firsts) AND turn <= 9 AND rec_ord % 3 <> 0""")
    add("s5_incremental_ledger", ", ledger AS (SELECT * FROM results WHERE record_id IN (SELECT record_id FROM preds))"
        + _BREAKDOWN.format(source="ledger"))
    add("s6_list_sessions", """SELECT session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created_at,
        arg_min(record_id, seq) AS record_id, count(*) AS turn_count FROM log GROUP BY session_id""")
    add("s6_load_session", "SELECT session_id, seq, user_message, assistant_response FROM log WHERE session_id = '7'")
    add("s6_delete_sessions", """SELECT session_id, count(*) AS turn_count, max(seq) AS last_seq FROM log
        WHERE CAST(session_id AS BIGINT) % 3 <> 0 GROUP BY session_id""")
    add("s7_quality_issues", """SELECT rec_ord, record_id, 'EMPTY_ID' AS issue, CAST(NULL AS VARCHAR) AS detail
        FROM messy WHERE record_id = ''
        UNION ALL SELECT rec_ord, record_id, 'NO_TABLE', NULL FROM messy
          WHERE record_id <> '' AND rec_ord NOT IN (SELECT rec_ord FROM messy_cells)
        UNION ALL SELECT rec_ord, record_id, 'DUPLICATE_COLUMN', col_name
          FROM (SELECT DISTINCT rec_ord, record_id, col_ord, col_name FROM messy_cells)
          GROUP BY rec_ord, record_id, col_name HAVING count(*) > 1""")

    add("s7_malformed_records", """SELECT rec_ord % 11 = 0 AS cut_short, count(*) AS lines FROM keys
        WHERE rec_ord % 11 = 0 OR rec_ord % 13 = 0 OR rec_ord NOT IN (SELECT rec_ord FROM turns) GROUP BY 1""")

    add("p1_select_columns", """, found AS (
          SELECT w.request_id, w.record_id, w.target_pos, w.col_name, c.col_ord FROM wanted w
          JOIN col_labels c ON c.record_id = w.record_id AND c.col_name = w.col_name),
        chosen AS (
          SELECT *, false AS fallback FROM found
          UNION ALL SELECT q.request_id, q.record_id, c.col_ord, c.col_name, c.col_ord, true
          FROM column_requests q JOIN col_labels c USING (record_id)
          WHERE q.request_id NOT IN (SELECT request_id FROM found))
        SELECT h.request_id, h.record_id, h.target_pos, h.col_name, c.row_ord, c.row_name, c.raw, h.fallback
        FROM chosen h JOIN cells c ON c.record_id = h.record_id AND c.col_ord = h.col_ord""")
    add("p2_table_head", """, ranked AS (
          SELECT rec_ord, row_ord, row_number() OVER (PARTITION BY rec_ord ORDER BY row_ord) AS rank FROM row_labels)
        SELECT c.* FROM cells c JOIN ranked r USING (rec_ord, row_ord) WHERE r.rank <= 3""")
    add("p3_list_tables", """SELECT rec_ord, record_id, record_id || '_table' AS table_name, max(row_count) AS row_count,
        count(*) AS column_count, 0 AS part, string_agg(col_name, '|' ORDER BY col_ord) AS column_names
        FROM catalog GROUP BY rec_ord, record_id""")
    add("p3_list_tables_compact", """SELECT record_id || '_table' AS table_name, 0 AS part,
        string_agg(col_name, '|' ORDER BY col_ord) AS column_names FROM catalog GROUP BY record_id""")
    add("p4_compact_cards", """SELECT record_id, 0 AS part,
        (SELECT string_agg(col_name, '|' ORDER BY col_ord) FROM col_labels k WHERE k.rec_ord = c.rec_ord) AS cols,
        (SELECT string_agg(row_name, '|' ORDER BY row_ord) FROM row_labels r WHERE r.rec_ord = c.rec_ord) AS rows,
        string_agg(raw, '|' ORDER BY row_ord, col_ord) AS data FROM cells c GROUP BY rec_ord, record_id""")
    add("p4_table_cards", f""", packed AS (
          SELECT rec_ord, record_id, string_agg(row_name || '/' || col_name || '/' || raw, '|' ORDER BY row_ord, col_ord) AS data
          FROM cells GROUP BY ALL),
        heads AS (
          SELECT rec_ord, max(row_count) AS total_rows, string_agg(col_name || ':' || column_type, '|' ORDER BY col_ord) AS columns
          FROM catalog GROUP BY ALL)
        SELECT p.record_id, p.record_id || '_table' AS table_name, 0 AS part, h.total_rows, h.columns,
               {_short("coalesce(d.text, '')", 500)} AS pre_text, 'segment ' || c.c_mktsegment AS post_text,
               s.structure, p.data
        FROM packed p JOIN heads h USING (rec_ord) JOIN structures s USING (rec_ord)
        JOIN customer c ON c.c_custkey = p.rec_ord LEFT JOIN documents d ON d.doc_id = p.rec_ord""")
    sql["p4_table_cards_json"] = sql["p4_table_cards"]
    add("p5_dialogue_view", f"""SELECT record_id, turn, {_short('question', 80)} AS question,
        {_short('answer', 30)} AS answer, {_short('program', 50)} AS program FROM turns""")

    add("t1_densify", """SELECT r.rec_ord, r.record_id, k.col_ord, k.col_name, r.row_ord, r.row_name, c.raw
        FROM row_labels r JOIN col_labels k ON k.rec_ord = r.rec_ord
        LEFT JOIN cells c ON c.rec_ord = r.rec_ord AND c.row_ord = r.row_ord AND c.col_ord = k.col_ord""")
    add("t2_column_types", "SELECT rec_ord, record_id, col_ord, col_name, column_type, value_count FROM types")
    add("t3_schema", "SELECT * FROM catalog")
    typed = "SELECT c.*, t.column_type, CASE WHEN t.column_type = 'numeric' THEN {num} END AS num FROM cells c JOIN types t USING (rec_ord, col_ord)"
    plain_number = f"CASE WHEN regexp_matches(raw, {_PLAIN}) THEN TRY_CAST(trim(raw) AS DOUBLE) END"
    add("t4_typed_cells", typed.format(num=_to_float("raw")))
    add("t4_typed_cells_faithful", typed.format(num=plain_number))
    add("t4_conversion_warnings", f""", typed AS ({typed.format(num=plain_number)}),
        n AS (SELECT rec_ord, col_ord, count(num) AS read FROM typed GROUP BY ALL)
        SELECT c.rec_ord, c.record_id, c.col_ord, c.col_name, c.row_count - n.read AS null_count, c.row_count
        FROM catalog c JOIN n USING (rec_ord, col_ord)
        WHERE c.column_type = 'numeric' AND (c.row_count - n.read) / c.row_count > 0.5""")
    sql["t5_corpus_counts"] = sql["s1_corpus_scan"]
    add("t5_column_type_histogram", """, firsts AS (SELECT rec_ord FROM keys ORDER BY split = 'dev', rec_ord LIMIT 100)
        SELECT column_type, count(*) AS columns FROM catalog WHERE rec_ord IN (SELECT rec_ord FROM firsts) GROUP BY column_type""")
    add("t5_column_type_histogram_all", "SELECT column_type, count(*) AS columns FROM catalog GROUP BY column_type")
    add("t5_table_shapes", """, firsts AS (SELECT rec_ord FROM keys ORDER BY split = 'dev', rec_ord LIMIT 10)
        SELECT rec_ord, record_id, row_count, column_count FROM shapes WHERE rec_ord IN (SELECT rec_ord FROM firsts)""")
    add("t6_structure", "SELECT * FROM structures")
    add("t7_structure_guide", f""", hits AS (
          SELECT *, row_number() OVER (PARTITION BY rec_ord, axis ORDER BY ord) AS rank FROM axes WHERE hit)
        SELECT record_id, structure,
          CASE structure
            WHEN 'time_series' THEN 'Time series financial data with ' || time_columns || ' time periods and ' || metric_rows || ' identified metrics'
            WHEN 'metrics_by_categories' THEN 'Categorical financial data with ' || column_count || ' categories and ' || row_count || ' data points'
            WHEN 'mixed' THEN 'Mixed structure with both time and categorical elements (' || row_count || 'x' || column_count || ')'
            ELSE 'Table structure not automatically recognized (' || row_count || ' rows, ' || column_count || ' columns)' END AS headline,
          CASE structure
            WHEN 'time_series' THEN 'Columns represent time periods: ' || {_guide_names('col', 3)} || CASE WHEN time_columns > 3 THEN '...' ELSE '' END
            WHEN 'mixed' THEN CASE WHEN time_columns > 0 THEN 'Time-related columns: ' || {_guide_names('col', None)} ELSE 'No clear time columns identified' END END AS times,
          CASE structure
            WHEN 'time_series' THEN 'Rows represent financial metrics: ' || {_guide_names('row', 3)} || CASE WHEN metric_rows > 3 THEN '...' ELSE '' END
            WHEN 'metrics_by_categories' THEN 'Contains ' || metric_rows || ' identified financial metrics'
            WHEN 'mixed' THEN CASE WHEN metric_rows > 0 THEN 'Financial metrics: ' || {_guide_names('row', None)} ELSE 'No clear financial metrics identified' END END AS metrics,
          column_count AS typed_columns
        FROM structures s""")
    roles = """, roles AS (
          SELECT rec_ord, record_id, CASE WHEN rec_ord % 2 = 0 THEN 'time_series' ELSE 'metrics_by_categories' END AS table_type,
            rec_ord % 2 = 0 AS times_in_columns, rec_ord % 3 <> 0 AS metrics_in_rows,
            CASE rec_ord % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence FROM keys WHERE rec_ord % 10 <> 9)"""
    add("t8_axis_roles", roles + """
        SELECT s.rec_ord, s.record_id, coalesce(r.table_type, 'unknown') AS structure,
          CASE WHEN times_in_columns THEN column_count ELSE 0 END AS time_columns,
          CASE WHEN metrics_in_rows THEN row_count ELSE 0 END AS metric_rows, coalesce(r.confidence, 0.3) AS confidence
        FROM shapes s LEFT JOIN roles r ON r.rec_ord = s.rec_ord""")
    add("t8_labelled_guide", roles + """, told AS (
          SELECT s.*, coalesce(r.table_type, 'unknown') AS kind, coalesce(r.times_in_columns, false) AS in_cols,
            coalesce(r.metrics_in_rows, false) AS in_rows,
            (SELECT string_agg(label, ', ' ORDER BY ord) FROM axes a WHERE a.rec_ord = s.rec_ord AND axis = 'col') AS all_cols,
            (SELECT string_agg(label, ', ' ORDER BY ord) FROM (SELECT label, ord, row_number() OVER (ORDER BY ord) AS i FROM axes a
               WHERE a.rec_ord = s.rec_ord AND axis = 'col') WHERE i <= 3) AS three_cols,
            (SELECT string_agg(label, ', ' ORDER BY ord) FROM (SELECT label, ord, row_number() OVER (ORDER BY ord) AS i FROM axes a
               WHERE a.rec_ord = s.rec_ord AND axis = 'row') WHERE i <= 3) AS three_rows,
            (SELECT string_agg(col_name || ':' || column_type, '|' ORDER BY col_ord) FROM catalog t WHERE t.rec_ord = s.rec_ord) AS data_types
          FROM shapes s LEFT JOIN roles r ON r.rec_ord = s.rec_ord),
        sized AS (
          SELECT *, CASE WHEN in_cols THEN column_count ELSE 0 END AS times, CASE WHEN in_rows THEN row_count ELSE 0 END AS metrics FROM told)
        SELECT record_id, kind AS structure,
          CASE kind WHEN 'time_series' THEN 'Time series financial data with ' || times || ' time periods and ' || metrics || ' identified metrics'
            WHEN 'metrics_by_categories' THEN 'Categorical financial data with ' || column_count || ' categories and ' || row_count || ' data points'
            ELSE 'Table structure not automatically recognized (' || row_count || ' rows, ' || column_count || ' columns)' END AS headline,
          CASE kind WHEN 'time_series' THEN 'Columns represent time periods: ' || CASE WHEN in_cols THEN three_cols ELSE '' END
              || CASE WHEN times > 3 THEN '...' ELSE '' END
            WHEN 'metrics_by_categories' THEN 'Data is organized by categories rather than time periods'
            ELSE 'Unable to determine standard financial table patterns' END AS times,
          CASE kind WHEN 'time_series' THEN 'Rows represent financial metrics: ' || CASE WHEN in_rows THEN three_rows ELSE '' END
              || CASE WHEN metrics > 3 THEN '...' ELSE '' END
            WHEN 'metrics_by_categories' THEN CASE WHEN metrics > 0 THEN 'Contains ' || metrics || ' identified financial metrics'
              ELSE 'Contains various data points' END END AS metrics,
          CASE kind WHEN 'time_series' THEN 'Each cell shows the value of a financial metric for a specific time period'
            WHEN 'metrics_by_categories' THEN 'Each cell shows the value of a metric for a specific category'
            ELSE 'Refer to the document context (pre_text and post_text) to understand data organization' END AS reading_guide,
          data_types
        FROM sized""")
    add("t8_labelled_axes", roles + """
        SELECT a.rec_ord, a.record_id, CASE axis WHEN 'col' THEN 'time' ELSE 'metric' END AS role, a.ord, a.label
        FROM axes a JOIN roles r ON r.rec_ord = a.rec_ord
        WHERE (axis = 'col' AND times_in_columns) OR (axis = 'row' AND metrics_in_rows)""")

    add("j1_match_columns", _column_match() + """
        SELECT q.request_id, b.col_name AS matched_column, CASE b.rank WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' END AS column_match
        FROM value_requests q LEFT JOIN col_best b USING (request_id)""")
    add("j1_match_column_lists", """, tries AS (
          SELECT w.request_id, w.target_pos, c.col_name, c.col_ord, 'fiscal ' || lower(w.col_name) AS needle
          FROM wanted w JOIN col_labels c USING (record_id)),
        firsts AS (
          SELECT request_id, target_pos, arg_min(col_name, (CASE WHEN lower(col_name) = needle THEN 0 ELSE 1 END, col_ord)) AS col_name
          FROM tries WHERE contains(needle, lower(col_name)) OR contains(lower(col_name), needle) GROUP BY ALL)
        SELECT q.request_id, q.record_id, coalesce((SELECT string_agg(col_name, '|' ORDER BY target_pos) FROM firsts f
          WHERE f.request_id = q.request_id), '') AS target_columns FROM column_requests q""")
    add("j2_closest_label", _row_match() + """
        SELECT q.request_id, b.row_name AS matched_label, CASE WHEN b.row_name IS NULL THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence
        FROM value_requests q LEFT JOIN overlap_best b USING (request_id)""")
    add("j3_match_rows_direct", _row_match() + """
        SELECT q.request_id, b.row_name AS matched_row, CASE b.rank WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' END AS row_match,
          CASE b.rank WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 END::DOUBLE AS row_score
        FROM value_requests q LEFT JOIN direct_best b USING (request_id)""")
    add("j3_match_rows_similar", _similarity())
    sql["j3_match_rows_similar"] = sql["j3_match_rows_similar"].replace("WITH ", "WITH RECURSIVE ", 1)
    add("j4_get_values", _column_match() + _row_match() + f""", located AS (
          SELECT q.*, c.col_ord, c.col_name, coalesce(o.row_ord, d.row_ord) AS row_ord, coalesce(o.row_name, d.row_name) AS row_name
          FROM value_requests q LEFT JOIN col_best c USING (request_id) LEFT JOIN overlap_best o USING (request_id)
          LEFT JOIN direct_best d USING (request_id)),
        fetched AS (
          SELECT l.*, v.raw, CASE WHEN {_strip('l.row_identifier')} = '' OR {_strip('l.column_identifier')} = '' THEN 'MISSING_IDENTIFIERS'
            WHEN l.col_name IS NULL THEN 'COLUMN_NOT_FOUND' WHEN l.row_name IS NULL THEN 'ROW_NOT_FOUND'
            WHEN v.raw IS NULL THEN 'NULL_VALUE' ELSE 'OK' END AS status
          FROM located l LEFT JOIN cells v ON v.record_id = l.record_id AND v.col_ord = l.col_ord AND v.row_ord = l.row_ord)
        SELECT f.request_id, f.row_name AS matched_row, f.col_name AS matched_column,
          CASE WHEN status = 'OK' THEN {_to_float('f.raw')} END AS value,
          CASE WHEN status = 'OK' THEN {_strip('f.raw')} END AS value_text, status,
          CASE status WHEN 'COLUMN_NOT_FOUND' THEN (SELECT string_agg(col_name, '|' ORDER BY col_ord) FROM col_labels k WHERE k.record_id = f.record_id)
            WHEN 'ROW_NOT_FOUND' THEN (SELECT string_agg(row_name, '|' ORDER BY row_ord) FROM row_labels r WHERE r.record_id = f.record_id) END AS available
        FROM fetched f""")
    add("j6_score_predictions", "SELECT * FROM results")
    add("j6_score_predictions_compat", f"""SELECT t.rec_ord, t.record_id, t.turn, {_short('t.question', 100)} AS question,
        t.answer AS expected, coalesce('ERROR: ' || p.error, p.actual) AS actual,
        p.error IS NULL AND coalesce({_match('n.a', 'n.b')}, false) AS is_correct, false AS is_hybrid
        FROM turns t JOIN preds p ON t.record_id = p.record_id AND t.turn = p.turn,
        LATERAL (SELECT {_primary('p.actual')} AS a, {_primary('t.answer')} AS b) n""")
    index = """, mentioned AS (SELECT session_id, turn_no, unnest(entities) AS entity FROM log),
        idx AS (SELECT session_id, entity, row_number() OVER (PARTITION BY session_id, entity ORDER BY turn_no) AS mention_no,
          turn_no, 'turn_' || turn_no AS turn_id FROM mentioned)"""
    add("j7_entity_index", index + " SELECT * FROM idx")
    add("j7_find_entity", index + " SELECT * FROM idx WHERE entity = 'financial_table'")
    add("j8_change_requests", f""", jobs AS (
          SELECT DISTINCT rec_ord * 10 + row_ord AS request_id, rec_ord, record_id, row_ord,
            ['auto', 'standard', 'cost', 'percentage', 'simple'][row_ord + 1] AS change_type FROM named),
        both_sides AS (
          SELECT j.*, k1.col_ord AS old_col, k2.col_ord AS new_col, {_to_float('a.raw')} AS old_value, {_to_float('b.raw')} AS new_value,
            a.raw AS old_raw, b.raw AS new_raw
          FROM jobs j LEFT JOIN col_labels k1 ON k1.rec_ord = j.rec_ord AND k1.col_name = '1997'
          LEFT JOIN col_labels k2 ON k2.rec_ord = j.rec_ord AND k2.col_name = '1998'
          LEFT JOIN cells a ON a.rec_ord = j.rec_ord AND a.row_ord = j.row_ord AND a.col_name = '1997'
          LEFT JOIN cells b ON b.rec_ord = j.rec_ord AND b.row_ord = j.row_ord AND b.col_name = '1998')
        SELECT request_id, record_id, change_type, old_value, new_value,
          CASE WHEN old_value IS NOT NULL AND new_value IS NOT NULL THEN {_change('old_value', 'new_value', 'change_type')} END AS change,
          CASE WHEN old_col IS NULL THEN 'COLUMN_NOT_FOUND' WHEN old_raw IS NULL THEN 'NULL_VALUE'
            WHEN new_col IS NULL THEN 'COLUMN_NOT_FOUND' WHEN new_raw IS NULL THEN 'NULL_VALUE'
            WHEN old_value IS NULL OR new_value IS NULL THEN 'VALIDATION_ERROR' ELSE 'OK' END AS status
        FROM both_sides""")
    add("j8_period_change", f""", numbers AS (
          SELECT rec_ord, record_id, row_ord, row_name, col_ord, col_name, {_to_float('raw')} AS v FROM cells),
        paired AS (
          SELECT rec_ord, record_id, row_ord, row_name, lag(col_name) OVER w AS old_column, col_name AS new_column,
            lag(v) OVER w AS old_value, v AS new_value FROM numbers WHERE v IS NOT NULL
          WINDOW w AS (PARTITION BY rec_ord, row_ord ORDER BY col_ord))
        SELECT *, {_change('old_value', 'new_value', "'auto'")} AS change,
          {_change('old_value', 'new_value', "'percentage'")} AS percent_change
        FROM paired WHERE old_column IS NOT NULL""")

    add("a1_column_totals", sums + """, hits AS (
          SELECT w.request_id, s.col_name || '_total' AS total_name, s.total FROM wanted w JOIN sums s USING (record_id, col_name))
        SELECT request_id, total_name, total, 'OK' AS status, CAST(NULL AS VARCHAR) AS numeric_columns FROM hits
        UNION ALL SELECT request_id, NULL, NULL, 'NO_NUMERIC_COLUMNS',
          coalesce((SELECT string_agg(col_name, ', ' ORDER BY col_ord) FROM catalog c WHERE c.record_id = q.record_id AND column_type = 'numeric'), '')
        FROM column_requests q WHERE request_id NOT IN (SELECT request_id FROM hits)""")
    add("a2_first_numeric_sum", sums + """, summed AS (
          SELECT *, request_id % 4 = 0 OR target_columns IS NULL OR len(target_columns) = 0 AS open FROM column_requests),
        options AS (
          SELECT w.request_id, w.target_pos AS pos, s.col_name, s.total FROM wanted w JOIN sums s USING (record_id, col_name)
          JOIN summed a ON a.request_id = w.request_id WHERE NOT a.open
          UNION ALL SELECT a.request_id, s.col_ord, s.col_name, s.total FROM summed a JOIN sums s USING (record_id) WHERE a.open)
        SELECT a.request_id, a.record_id, arg_min(o.col_name, pos) AS col_name, arg_min(o.total, pos) AS total,
          CASE WHEN count(o.request_id) = 0 THEN 'NO_NUMERIC_COLUMNS' ELSE 'OK' END AS status
        FROM summed a LEFT JOIN options o ON o.request_id = a.request_id GROUP BY a.request_id, a.record_id""")
    add("a3_accuracy", """SELECT count(*) FILTER (is_correct) AS correct, count(*) AS total,
        coalesce(count(*) FILTER (is_correct) / nullif(count(*), 0) * 100, 0.0) AS accuracy FROM results""")
    add("a4_accuracy_breakdown", breakdown)
    published = " UNION ALL ".join(f"SELECT {_q(m)} AS model, {_q(w)} AS method, {a}::DOUBLE AS accuracy" for m, w, a in PUBLISHED)
    add("a5_baseline_report", f"""{published} UNION ALL SELECT 'This run', 'Predictions',
        coalesce(count(*) FILTER (is_correct) / nullif(count(*), 0) * 100, 0.0) FROM results""")
    add("a6_example_results", """, ranked AS (
          SELECT *, row_number() OVER (PARTITION BY is_correct ORDER BY rec_ord, turn) AS rank FROM results)
        SELECT * FROM ranked WHERE rank <= 3""")
    add("a7_entity_counts", """, mentioned AS (SELECT session_id, unnest(entities) AS entity FROM log)
        SELECT session_id, entity, count(*) AS mentions FROM mentioned GROUP BY session_id, entity
        UNION ALL SELECT NULL, entity, count(*) FROM mentioned GROUP BY entity""")

    add("w1_turn_numbers", "SELECT session_id, seq, turn_no, 'turn_' || turn_no AS turn_id FROM log")
    add("w2_recent_context", _context("log", "tools", "computed"))
    add("w2_recent_context_chats", _context("chats", "CAST(NULL AS VARCHAR[])", "CAST(NULL AS VARCHAR)"))
    add("w3_qa_context", """, open AS (
          SELECT session_id, turn_no, 'turn_' || turn_no AS turn_id, user_message AS u, assistant_response AS a FROM chats
          UNION ALL SELECT session_id, max(turn_no) + 1, 'next', NULL, NULL FROM chats GROUP BY session_id),
        seen AS (
          SELECT session_id, turn_id, list({'u': u, 'a': a})
            OVER (PARTITION BY session_id ORDER BY turn_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS p FROM open)
        SELECT session_id, turn_id, coalesce(array_to_string(list_transform(p, lambda x, i: 'Q' || i || ': ' || x.u
          || coalesce(' | A' || i || ': ' || x.a, '')), ' | '), '') AS context
        FROM seen""")
    add("w4_latest_state", """SELECT session_id, array_to_string(arg_max(tools, seq) FILTER (tools IS NOT NULL), '|') AS last_tools,
        arg_max(computed, seq) FILTER (computed IS NOT NULL) AS last_results,
        strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at,
        count(*) AS turn_count FROM log GROUP BY session_id""")
    add("w5_running_accuracy", """, per AS (
          SELECT rec_ord, record_id, count(*) FILTER (is_correct) AS c, count(*) AS n FROM results GROUP BY ALL),
        run AS (SELECT rec_ord, record_id, CAST(sum(c) OVER w AS BIGINT) AS correct_so_far, CAST(sum(n) OVER w AS BIGINT) AS total_so_far
          FROM per WINDOW w AS (ORDER BY rec_ord))
        SELECT *, correct_so_far / total_so_far * 100 AS accuracy FROM run""")
    dedup = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY rec_ord {way}) AS rank FROM messy)
        SELECT split, rec_ord, record_id FROM ranked WHERE rank = 1"""
    add("w6_dedup_last", dedup.format(way="DESC"))
    add("w6_dedup_first", dedup.format(way="ASC"))
    add("o1_first_records", "SELECT * FROM keys ORDER BY split = 'dev', rec_ord LIMIT 25")
    add("u1_union_splits", "SELECT split, rec_ord, record_id FROM keys")
    add("u2_unprocessed_records", "SELECT * FROM keys WHERE record_id NOT IN (SELECT record_id FROM preds)")

    sql["f1_primary_number"] = f"SELECT doc_id, {_primary('text')} AS number FROM documents"
    add("f1_primary_number_answers", f"SELECT record_id, turn, {_primary('actual')} AS number FROM preds")
    sql["f2_last_number"] = f"SELECT doc_id, {_last_number('text')} AS number FROM documents"
    cell = "SELECT rec_ord, row_ord, col_ord, raw, {more} FROM cells"
    add("f3_safe_float", cell.format(more=f"coalesce({_to_float('raw')}, -1.0) AS number"))
    add("f4_to_float", cell.format(more=f"{_to_float('raw')} AS number, CASE WHEN {_to_float('raw')} IS NULL THEN 'INVALID' ELSE 'OK' END AS status"))
    add("f5_clean_numeric_string", cell.format(more=f"{clean} AS cleaned"))
    bare = _drop(_strip("raw"), "$,%")
    add("f6_display_number", cell.format(more=f"CASE WHEN regexp_matches({_strip(bare)}, {_FLOAT}) THEN {bare} ELSE {_strip('raw')} END AS shown"))
    add("f7_numeric_match", f"""SELECT record_id, turn, {_match('program', 'answer')} AS program_is_answer,
        {_match('half', 'answer')} AS half_null FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN answer END AS half FROM turns)""")
    normal = [f"TRY_CAST(coalesce({_last(x, _SIMPLE)}, '0') AS DOUBLE)" for x in ("actual", "answer")]
    add("f8_match_policies", f"""SELECT t.record_id, t.turn, coalesce({_match('n.a', 'n.b')}, false) AS "primary",
        {_basic('actual', 'answer')} AS basic, {_near(*normal)} AS normalized
        FROM turns t JOIN preds p ON t.record_id = p.record_id AND t.turn = p.turn,
        LATERAL (SELECT {_primary('p.actual')} AS a, {_primary('t.answer')} AS b) n""")
    kinds = ", ".join(f"{_change('old', 'new', _q(k))} AS change_{k}" for k in ("auto", "standard", "cost", "percentage", "other"))
    sql["f9_change"] = f"""WITH items AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey,
        CAST(CAST(l_extendedprice - 40000 AS DECIMAL(18,2)) AS DOUBLE) AS old, l_quantity * 1000 - 30000 AS new FROM lineitem)
        SELECT *, {kinds} FROM items"""
    constants = " ".join(f"WHEN {_q(k)} THEN {float(v)}" for k, v in CONSTANTS.items())
    sql["f10_arithmetic"] = f"""WITH items AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity,
        CAST(floor(l_discount * 100 + 0.5) AS DOUBLE) AS percent FROM lineitem)
        SELECT *, l_quantity - percent AS subtract, l_quantity + percent AS "add", l_quantity * percent AS multiply,
        CASE WHEN l_quantity > percent THEN 1.0 ELSE 0.0 END::DOUBLE AS greater, l_quantity / nullif(percent, 0) AS divide, round(exp(percent), 6) AS exponential,
        CASE WHEN percent = 0 THEN 'DIV_ZERO' ELSE 'OK' END AS divide_status,
        CASE 'const_' || CAST(CAST(percent AS INT) AS VARCHAR) {constants} END::DOUBLE AS constant FROM items"""
    add("f11_programs", r""", parts AS (
          SELECT record_id, turn, program, executed_answer, regexp_extract_all(program, '-?\d+\.\d+') AS n FROM turns),
        run AS (
          SELECT *, CASE WHEN contains(program, 'divide') THEN (CAST(n[1] AS DOUBLE) - CAST(n[2] AS DOUBLE)) / CAST(n[3] AS DOUBLE)
            WHEN contains(program, 'subtract') THEN CAST(n[1] AS DOUBLE) - CAST(n[2] AS DOUBLE) ELSE CAST(n[1] AS DOUBLE) END AS value FROM parts)
        SELECT record_id, turn, program, value, 'OK' AS status, abs(value - CAST(executed_answer AS DOUBLE)) < 1e-6 AS agrees FROM run""")
    price, day, key = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)", "CAST(day(o_orderdate) AS VARCHAR)", "o_orderkey"
    sql["f12_keyword_arithmetic"] = f"""WITH spoken AS (
        SELECT o_orderkey AS request_id, CAST({price} AS DOUBLE) AS price, CAST(day(o_orderdate) AS DOUBLE) AS day,
          CASE {key} % 13 WHEN 0 THEN 'add(' || {price} || ', ' || {day} || ')'
          WHEN 1 THEN {price} || ' / ' || {day} WHEN 2 THEN 'difference of ' || {price} || ' and ' || {day}
          WHEN 3 THEN {price} || ' times ' || {day} WHEN 4 THEN 'divide(' || {price} || ', 0)' WHEN 5 THEN 'nothing to compute'
          WHEN 6 THEN 'only ' || {price} WHEN 7 THEN {day} || ' * -3' WHEN 8 THEN '(' || {price} || ' - ' || {day} || ') / ' || {day}
          WHEN 9 THEN '-(' || {price} || ' + ' || {day} || ') * 2' WHEN 10 THEN 'abs(' || {day} || ' - ' || {price} || ') + 2 ** 3 ** 1'
          WHEN 11 THEN {price} || ' - ' || {day} || ' - ' || {day} || ' * 2' ELSE {price} || ' over ' || {day} END AS expression FROM orders)
        {_spoken()}
        SELECT request_id, expression, value, CASE WHEN n = 0 THEN 'UNABLE_TO_COMPUTE' WHEN n >= 2 AND value IS NULL THEN 'DIV_ZERO' ELSE 'OK' END AS status FROM said"""
    add("f12_compute_requests", sums + """, jobs AS (
          SELECT rec_ord AS request_id, record_id, CASE rec_ord % 3 WHEN 0 THEN 'total of the table'
            WHEN 1 THEN 'add(' || rec_ord || ', 20)' ELSE 'sum 5 and 6' END AS expression FROM keys),
        firsts AS (SELECT record_id, arg_min(total, col_ord) AS total FROM sums GROUP BY record_id),
        done AS (
          SELECT j.*, CASE WHEN request_id % 3 <> 1 AND f.record_id IS NOT NULL THEN f.total
            WHEN request_id % 3 = 1 THEN request_id + 20.0 WHEN request_id % 3 = 2 THEN 11.0 END::DOUBLE AS value
          FROM jobs j LEFT JOIN firsts f USING (record_id))
        SELECT request_id, record_id, expression, value, CASE WHEN value IS NULL THEN 'UNABLE_TO_COMPUTE' ELSE 'OK' END AS status FROM done""")
    op = "CASE " + " ".join(f"WHEN {_says('query', w)} THEN {_q(n)}" for n, w in words.INTENT_WORDS) + " ELSE 'lookup' END"
    kind_of = "CASE {op} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in words.QUERY_TYPES.items()) + " ELSE 'analysis' END"
    add("f13_intents", f"""SELECT request_id, query, {op} AS intent, {kind_of.format(op='(' + op + ')')} AS query_type,
        CASE WHEN {_says('query', ['sum', 'total'])} THEN 'table_operation' ELSE 'mathematical' END AS expression_type,
        CASE WHEN {_says('query', ['sum', 'total'])} THEN 'sum' WHEN {_says('query', ['+', 'add'])} THEN 'add'
          WHEN {_says('query', ['*', 'multiply'])} THEN 'multiply' END AS expression_operation FROM text_requests""")

    def terms(x: str) -> str:
        listed = ", ".join(_q(w) for w in sorted(words.FINANCIAL_TERMS))
        return f"array_to_string(list_filter([{listed}], lambda w: contains(lower({x}), w)), '|')"

    entity = "CASE WHEN contains(lower({x}), 'table') THEN 'financial_table' ELSE '' END"
    add("f14_financial_terms", f"""SELECT rec_ord, axis, ord, label, {terms('label')} AS terms, {terms('label')} <> '' AS financial,
        {_says('label', words.METRIC_TERMS)} AS metric, {_says('label', words.TIME_MARKS)} AS time_mark,
        {_time_label('label')} AS time_label, {entity.format(x='label')} AS entities FROM axes""")
    sql["f14_document_terms"] = f"""SELECT doc_id, {terms('text')} AS terms, {_says('text', words.TIME_MARKS)} AS time_mark,
        {entity.format(x='text')} AS entities FROM documents"""
    add("f15_selection_checks", f""", q AS (
          SELECT record_id, turn, CASE (turn + rec_ord) % 3 WHEN 0 THEN 'change of the Senior Notes debt issuance costs?'
            WHEN 1 THEN 'and that? ' || question ELSE question END AS question,
            CASE WHEN (turn + rec_ord) % 2 = 0 THEN 'the general row' ELSE 'the Senior row' END AS selected FROM turns),
        w AS (
          SELECT *, {_says('question', ['senior notes'])} AND NOT {_says('selected', ['senior'])} AS senior,
            {_says('question', ['debt issuance costs'])} AND {_says('selected', ['general', 'aggregate'])} AS general,
            {_says('question', ['percentage', '%'])} AND {_says('question', ['previous', 'that'])} AS follow FROM q)
        SELECT record_id, turn, CASE WHEN senior OR general THEN 'warnings_found' ELSE 'looks_good' END AS validation_status,
          concat_ws('|', CASE WHEN senior THEN {_q(words.WARN_SENIOR)} END, CASE WHEN general THEN {_q(words.WARN_GENERAL)} END) AS warnings,
          concat_ws('|', CASE WHEN senior THEN {_q(words.HINT_SENIOR)} END, CASE WHEN follow THEN {_q(words.HINT_FOLLOW_UP)} END) AS suggestions,
          CASE WHEN senior OR general THEN {_q(words.REVIEW)} ELSE {_q(words.PROCEED)} END AS recommendation FROM w""")
    a = "lower(" + _strip("raw") + ")"
    add("f16_expected_format", f""", q AS (
          SELECT rec_ord, row_ord, col_ord, {a} AS a, lower(CASE WHEN row_ord % 2 = 0 THEN row_name ELSE 'the percentage rate' END) AS q FROM cells)
        SELECT rec_ord, row_ord, col_ord, CASE
          WHEN ends_with(a, '%') OR contains(a, 'percent') THEN 'percentage as decimal (e.g., 0.1083 for 10.83%)'
          WHEN starts_with(a, '$') OR contains(a, 'dollar') OR contains(a, 'million') THEN 'currency amount as number'
          WHEN contains(a, '.') AND length(string_split(a, '.')[-1]) >= 2 THEN 'decimal number with precision'
          WHEN starts_with(a, '-') THEN 'negative number' WHEN regexp_full_match(a, '[0-9]+') THEN 'whole number'
          WHEN contains(q, 'percent') OR contains(q, 'rate') THEN 'percentage as decimal'
          WHEN {_says('q', ['increase', 'decrease', 'change', 'difference'])} THEN 'change value (can be positive or negative)'
          WHEN {_says('q', ['ratio', 'times', 'multiple'])} THEN 'ratio as decimal' ELSE 'numeric value' END AS expected_format FROM q""")
    add("f17_query_tables", sums + f""", ranked_cols AS (
          SELECT *, row_number() OVER (PARTITION BY rec_ord ORDER BY col_ord) AS rank FROM col_labels),
        firsts AS (SELECT record_id, list(col_name ORDER BY col_ord) AS first_columns FROM ranked_cols WHERE rank <= 3 GROUP BY record_id),
        known AS (
          SELECT request_id, r.record_id, coalesce(operation, {op}) AS operation, coalesce(target_columns, first_columns) AS targets,
            first_columns IS NOT NULL AS has_table
          FROM text_requests r LEFT JOIN firsts f ON f.record_id = r.record_id),
        plans AS (
          SELECT *, CASE WHEN operation = 'aggregate' AND len(targets) = 0 THEN 'lookup' ELSE operation END AS step
          FROM known WHERE has_table),
        want AS (
          SELECT request_id, record_id, step, unnest(targets) AS col_name, generate_subscripts(targets, 1) - 1 AS pos FROM plans),
        tot AS (
          SELECT w.request_id, w.pos AS position, w.col_name || '_total' AS col_name, s.total AS num, CAST(NULL AS VARCHAR) AS note
          FROM want w JOIN sums s USING (record_id, col_name) WHERE step = 'aggregate'),
        untot AS (
          SELECT k.request_id, 0 AS position, CAST(NULL AS VARCHAR) AS col_name, CAST(NULL AS DOUBLE) AS num,
            'Available numeric columns: ' || coalesce((SELECT string_agg(col_name, ', ' ORDER BY col_ord) FROM catalog c
              WHERE c.record_id = k.record_id AND column_type = 'numeric'), '') AS note
          FROM plans k WHERE step = 'aggregate' AND request_id NOT IN (SELECT request_id FROM tot)),
        row_rank AS (SELECT rec_ord, row_ord, row_number() OVER (PARTITION BY rec_ord ORDER BY row_ord) AS rank FROM row_labels),
        found AS (
          SELECT w.request_id, w.record_id, w.pos, c.col_ord FROM want w JOIN col_labels c USING (record_id, col_name) WHERE step = 'lookup'),
        picked AS (
          SELECT *, CAST(NULL AS VARCHAR) AS note FROM found
          UNION ALL SELECT k.request_id, k.record_id, c.col_ord, c.col_ord, 'Columns not found. Showing all data.' FROM plans k
          JOIN col_labels c USING (record_id) WHERE step = 'lookup' AND request_id NOT IN (SELECT request_id FROM found)),
        answers AS (
          SELECT request_id, position, col_name, CAST(NULL AS BIGINT) AS row_ord, CAST(NULL AS VARCHAR) AS row_name,
            CAST(NULL AS VARCHAR) AS raw, num, note FROM (SELECT * FROM tot UNION ALL SELECT * FROM untot)
          UNION ALL SELECT k.request_id, c.col_ord, c.col_name, c.row_ord, c.row_name, c.raw, {_to_float('c.raw')}, 'analysis_required'
            FROM plans k JOIN cells c USING (record_id) JOIN row_rank r ON r.rec_ord = c.rec_ord AND r.row_ord = c.row_ord AND r.rank <= 5
            WHERE operation IN ('calculate', 'analyze_change', 'compare')
          UNION ALL SELECT p.request_id, p.pos, c.col_name, c.row_ord, c.row_name, c.raw, {_to_float('c.raw')}, p.note
            FROM picked p JOIN cells c ON c.record_id = p.record_id AND c.col_ord = p.col_ord
          UNION ALL SELECT request_id, NULL, NULL, NULL, NULL, NULL, NULL, 'No table for this record.' FROM known WHERE NOT has_table)
        SELECT a.request_id, k.record_id, k.operation, {kind_of.format(op='k.operation')} AS query_type, position, col_name, row_ord,
          row_name, raw, num, note FROM answers a JOIN known k USING (request_id)""")
    add("st1_stream_scores", """, given AS (SELECT r.* FROM results r JOIN preds p ON p.record_id = r.record_id AND p.turn = r.turn)"""
        + _BREAKDOWN.format(source="given"))
    add("st2_stream_sessions", """SELECT session_id, count(*) AS turn_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created_at,
        strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM log GROUP BY session_id""")
    add("st2_stream_entities", """, mentioned AS (SELECT session_id, unnest(entities) AS entity FROM log)
        SELECT session_id, entity, count(*) AS mentions FROM mentioned GROUP BY session_id, entity""")
    return sql
