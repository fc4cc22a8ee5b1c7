"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

import re

STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "das dem den der des die ein eine für im ist mit nicht sich und von zu auf auch "
    "au avec dans de du elle en est et la le les ne par pas pour que qui sur un une "
    "al con del el ella es las lo los más no para por se su una y"
)

OP7 = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST,
                                     text NULLS FIRST) AS i FROM conversations),
p AS (SELECT conv_id, i, count(*) OVER (PARTITION BY conv_id) AS n,
             string_agg(md5(role || chr(1) || text), '') OVER (PARTITION BY conv_id ORDER BY i) AS prefix,
             sum(length(role) + length(text) + 6) OVER (PARTITION BY conv_id) AS chars FROM t),
inner_ AS (SELECT DISTINCT i, prefix FROM p WHERE i < n),
f AS (SELECT p.conv_id, n, p.prefix, chars, inner_.i IS NOT NULL AS is_snapshot
      FROM p LEFT JOIN inner_ ON inner_.i = p.n AND inner_.prefix = p.prefix WHERE p.i = p.n),
k AS (SELECT *, NOT is_snapshot AND conv_id IS NOT DISTINCT FROM min(conv_id) OVER (PARTITION BY n, prefix) AS kept
      FROM f)
SELECT conv_id, n AS n_turns, is_snapshot, kept, CASE WHEN kept THEN chars END AS rendered_chars FROM k
"""

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
e AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p AS g
      FROM e WINDOW p AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g WHERE g IS NOT NULL)
      WHERE c > 1),
v AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS x(k) GROUP BY rid),
s AS (SELECT rid, count(*) AS n FROM e
      WHERE list_contains(string_split('{STOP_WORDS}', ' '), CASE WHEN substr(w, 2) = lower(substr(w, 2))
            THEN lower(w) ELSE w END) GROUP BY rid),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words,
             len(ls) AS n_lines, coalesce(s.n, 0) AS n_stop
      FROM w LEFT JOIN v USING (rid) LEFT JOIN s USING (rid)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
             concat_ws(',', CASE WHEN n_words < 50 THEN 'n_words' END,
                 CASE WHEN 2 * n_repeat_words > n_words THEN 'repeat_word_ratio' END,
                 CASE WHEN n_words > 0 AND (word_chars < 2.0 * n_words OR word_chars > 20.0 * n_words)
                      THEN 'mean_word_chars' END,
                 CASE WHEN n_words > 0 AND n_symbols / n_words > 0.4 THEN 'symbol_ratio' END,
                 CASE WHEN n_words > 0 AND n_stop / n_words < 0.02 THEN 'stop_word_ratio' END,
                 CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.5 THEN 'duplicate_line_ratio' END
             ) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM f
"""

OP1 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
f AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS least FROM f)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN least IS NOT NULL AND (page_id IS NULL OR page_id > least) THEN 'revisit' ELSE 'response' END
           AS record_type,
       CASE WHEN page_id IS NULL OR page_id > least THEN least END AS refers_to
FROM g
"""

OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, size, array_to_string(ws[i : i + size - 1], ' ') AS w
       FROM (SELECT item, ws, least(len(ws), 13) AS size, unnest(range(1, greatest(len(ws) - 11, 2))) AS i
             FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT rid, size, i, array_to_string(ws[i : i + size - 1], ' ') AS w
       FROM (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
h AS (SELECT rid, i, dw.size, item FROM dw JOIN bw ON dw.size = bw.size AND dw.w = bw.w),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM h) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""

_GIVEN = r"""[""\x27]?\x20*[:=]\x20*[""\x27]?""".replace('""', '"')


def _either(words: str) -> str:
    """The words of a pattern in any case."""
    return re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", words)


# kind, role, pattern, group, least characters of the group
_SECRETS = (
    (
        "assign",
        "secret",
        "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
        f"|[aA][pP][iI]_?[kK][eE][yY]){_GIVEN}([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    ("access", "identifier", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "secret", "[0-9a-f]+", 0, 24),
    (
        "key_id",
        "identifier",
        f"(?:access|client|account|key)[_-](?:id|name|key_id){_GIVEN}[A-Za-z0-9_.@-]{{4,}}",
        0,
        1,
    ),
    ("opaque", "secret", r"\b[A-Za-z0-9+/]{40}\b", 0, 1),
    (
        "endpoint",
        "endpoint",
        f"(?:{_either('https')}?|{_either('jdbc')}:[A-Za-z]+|{_either('redis|mongodb|postgresql|mysql|amqp|s3')})"
        + r"""://[^\x00-\x20"\x27<>]+""",
        0,
        1,
    ),
)


def _matches(order: int, kind: str, role: str, pattern: str, group: int, least: int) -> str:
    return f"""
SELECT rid, {order} AS o, '{kind}' AS kind, '{role}' AS role, s, s + length(m) AS e FROM (
  SELECT rid, m, g, CAST(sum(length(gap)) OVER (PARTITION BY rid ORDER BY i)
         + coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
                                         AND 1 PRECEDING), 0) AS BIGINT) AS s
  FROM (SELECT rid, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[:len(ms)]) AS gap
        FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS gs,
                     string_split_regex(t, '{pattern}') AS gaps FROM d)))
WHERE length(g) >= {least}"""


OP5 = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), p AS ("
    + " UNION ALL ".join(_matches(i, *k) for i, k in enumerate(_SECRETS))
    + """),
strong AS (SELECT * FROM p WHERE o < 3),
weak AS (SELECT * FROM p w WHERE o >= 3 AND NOT EXISTS (
    SELECT 1 FROM strong x WHERE x.rid = w.rid AND x.s < w.e AND w.s < x.e)),
parts AS (SELECT * FROM strong UNION ALL SELECT * FROM weak),
linked AS (SELECT * FROM weak w WHERE EXISTS (
    SELECT 1 FROM parts x WHERE x.rid = w.rid AND x.s < w.e + 200 AND w.s < x.e + 200
       AND x.role = CASE w.role WHEN 'secret' THEN 'identifier' ELSE 'secret' END)),
base AS (SELECT rid, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access,
                count(*) FILTER (o = 2) AS n_hex,
                string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS listed FROM strong GROUP BY rid),
every AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS listed
          FROM (SELECT * FROM strong UNION ALL SELECT * FROM linked) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base.listed, '')) AS base_sha256, coalesce(every.listed, '') AS spans
FROM d LEFT JOIN base USING (rid) LEFT JOIN every USING (rid)
"""
)


OP12 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x20\x09-\x0D]+') AS ws FROM documents),
e AS (SELECT rid, doc_id, CASE WHEN len(ws) >= 3
          THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))
          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS shs FROM d),
s AS (SELECT rid, unnest(shs) AS s FROM e),
pairs AS (SELECT x.rid AS a, y.rid AS b, count(*) AS n FROM s x JOIN s y ON x.s = y.s AND x.rid < y.rid GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN e x ON x.rid = a JOIN e y ON y.rid = b
          WHERE 100 * n >= 90 * (len(x.shs) + len(y.shs) - n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT rid, rid FROM e UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b)
SELECT x.doc_id, CAST(len(x.shs) AS BIGINT) AS n_shingles, min(y.doc_id) AS component_id
FROM reach JOIN e x ON x.rid = reach.a JOIN e y ON y.rid = reach.b GROUP BY x.rid, x.doc_id, x.shs
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
           FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us,
             CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a,
             greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid,
             array_to_string(us[b + 1:], '') AS suf,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50
                  THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: Levels that the SQL spells out, above the leaves of a group and above the groups.
_LEVELS, _TOP_LEVELS = 6, 3


def _runs(name: str, start: str, levels: int) -> str:
    """Tables of a tree level by level: nodes (tree, i, n, d) and runs (tree, i, n, ds); a lone node stays."""
    out = [f"{name}0 AS ({start})"]
    for k in range(levels):
        out.append(f"{name}r{k} AS (SELECT tree, i // 8 AS i, any_value(n) AS n, list(d ORDER BY i) AS ds FROM {name}{k} GROUP BY tree, i // 8)")
        out.append(
            f"{name}{k + 1} AS (SELECT tree, i, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE 1 END AS n, "
            f"CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM {name}r{k})"
        )
    return ",\n".join(out)


def _path(name: str, place: str, tree: str, levels: int) -> tuple[str, str, str]:
    """Columns of siblings left and right of each level (null where the tree has ended), joins, and their names."""
    columns, joins = [], []
    for k in range(levels):
        run, at = f"{place} // {8 ** (k + 1)}", f"({place} // {8**k}) % 8"
        joins.append(f"JOIN {name}r{k} ON {name}r{k}.tree = {tree} AND {name}r{k}.i = {run}")
        for side, part in (("l", f"ds[1:{at}]"), ("r", f"ds[{at} + 2:]")):
            columns.append(f"CASE WHEN {name}r{k}.n > 1 THEN array_to_string({name}r{k}.{part}, '') END AS {name}{side}{k}")
    return ", ".join(columns), " ".join(joins), ""


def _op11() -> str:
    columns, joins, _ = _path("x", "x.i", "x.tree", _LEVELS)
    top_columns, top_joins, _ = _path("y", "y.i", "''", _TOP_LEVELS)
    pairs = [("x", k) for k in range(_LEVELS)] + [("y", k) for k in range(_TOP_LEVELS)]
    folds, node = [], "now"
    for at, (name, k) in enumerate(pairs):
        folds.append(f"f{at} AS (SELECT *, CASE WHEN {name}l{k} IS NULL THEN {node} ELSE sha256({name}l{k} || {node} || {name}r{k}) END AS node{at} FROM {f'f{at - 1}' if at else 'p'})")
        node = f"node{at}"
    siblings = " || ".join(f"coalesce({name}l{k} || {name}r{k}, '')" for name, k in pairs)
    crc = """list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda x, z: xor(x >> 1, 3988292384 * (x & 1))), 4294967295)"""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH leaves AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {_leaf('text')} AS leaf,
    CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {_leaf(lowered)} ELSE {_leaf('text')} END AS now FROM documents),
x AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{_runs('x', 'SELECT tree, i, n, leaf AS d FROM x', _LEVELS)},
y AS (SELECT tree AS name, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n, d FROM x{_LEVELS}),
{_runs('y', "SELECT '' AS tree, i, n, d FROM y", _TOP_LEVELS)},
top AS (SELECT y.name, y.d AS subroot, z.d AS root, {top_columns} FROM y {top_joins}, y{_TOP_LEVELS} z),
p AS (SELECT x.doc_id, x.leaf, x.now, top.*, {columns} FROM x JOIN top ON top.name = x.tree {joins}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, sha256({siblings}) AS proof_sha256, {node} AS folded_root, {node} = root AS verified
FROM f{len(pairs) - 1}
"""


OP11 = _op11()


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op4_decontamination": OP4, "op5_secrets": OP5, "op7_chat_collapse": OP7, "op8_quality_rules": OP8,
            "op11_merkle_manifest": OP11, "op12_overlap_join": OP12, "op13_fill_middle": OP13}
