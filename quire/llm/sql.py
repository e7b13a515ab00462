"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

from quire.llm.line_quality import BOILERPLATE, SENTENCE, SEPARATORS, Rules

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def line_quality(rules: Rules = Rules(), table: str = "documents") -> str:
    """Base counts and verdict of every row, in blocks of list functions."""
    words = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
    boiler = "|".join(p.replace(" ", r"\x20") for p in BOILERPLATE)
    mark = "[" + SENTENCE.replace("؟", "\\x{61F}") + "]"
    seps = ", ".join(_lit(s) for s in SEPARATORS)
    n = f"len({words.format('l')})"
    # a long line's sentences, each with what phrases hold of it; a character marks
    # where one ends, another lets the next begin with the white space behind it
    low = f"translate(l, '{_UP}', '{_LOW}')"
    space = r"[\x20\x09-\x0D]"
    ends = "|".join("…。！？।") + "|\\x{61F}"
    sentences = (f"string_split(replace(regexp_replace(regexp_replace({low}, '({space})', '\\1' || chr(2), 'g'), "
                 f"'(?s)(.)([.!?]+)({space})|(.)({ends})', '\\1\\2\\4\\5' || chr(1) || '\\3', 'g'), chr(2), ''), chr(1))")
    size = "strlen(regexp_replace({}, '" + space + "', '', 'g'))"
    held = f"coalesce(list_sum(list_transform(regexp_extract_all(s, '{boiler}'), lambda x: {size.format('x')})), 0)"
    framed = (f"list_sum(list_transform({sentences}, lambda s: CASE WHEN {held} > 0 AND (len({words.format('s')}) <= "
              f"{rules.short_line} OR 2 * {held} > {size.format('s')}) THEN {size.format('s')} ELSE 0 END))")
    return fr"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {table}),
w AS (SELECT *, {words.format('t')} AS w FROM d),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d),
lw AS (SELECT rid, l, {n} AS n,
  length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS letters,
  len(regexp_extract_all(l || ' ', '(##|\*\*|\$\$|%%|&&)[\x20\x09-\x0D]')) AS sym,
  len(regexp_extract_all(l || ' ', '!![\x20\x09-\x0D]')) AS shout,
  len(list_filter({words.format('l')}, lambda x: x IN ({seps}))) AS sep,
  regexp_matches(l, '{mark}') AS mark,
  CASE WHEN NOT regexp_matches({low}, '{boiler}') THEN false WHEN {n} <= {rules.short_line} THEN true
    ELSE 2 * {framed} > {size.format(low)} END AS boiler FROM l),
lf AS (SELECT rid, l, n, letters, n > 0 AND (
   (sym >= {rules.min_marked} AND 100 * sym >= {rules.symbol_pct} * n)
   OR (shout >= {rules.min_marked} AND 100 * shout >= {rules.shout_pct} * n)
   OR (n >= {rules.long_line} AND NOT mark)
   OR (sep >= {rules.min_marked} AND 100 * sep >= {rules.separator_pct} * n)
   OR boiler) AS bad FROM lw),
ls AS (SELECT rid, sum(letters)::BIGINT AS word_chars,
   coalesce(sum(letters) FILTER (WHERE bad), 0)::BIGINT AS lost_chars,
   (count(*) FILTER (WHERE n > 0) - count(DISTINCT l) FILTER (WHERE n > 0))::BIGINT AS n_dup_lines
   FROM lf GROUP BY rid),
p AS (SELECT rid, i, w[i:i+2] AS tri FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS c FROM p) WHERE c > 1),
rw AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n_repeat_words
   FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
a AS (SELECT doc_id, len(w)::BIGINT AS n_words, word_chars,
   (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, n_dup_lines,
   coalesce(n_repeat_words, 0) AS n_repeat_words, lost_chars
   FROM w JOIN ls USING (rid) LEFT JOIN rw USING (rid)),
b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_pct} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars,
  NOT base_failed AND 100 * lost_chars <= {rules.lost_pct} * word_chars AS kept FROM b
"""


CONTAMINATION = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS s
    FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT rid, i, k, array_to_string(w[i:i+k-1], ' ') AS s
    FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT rid, i, dw.k, item_id FROM dw JOIN win ON dw.k = win.k AND dw.s = win.s),
hw AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS x FROM hit) GROUP BY rid),
hi AS (SELECT rid, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""


def url_verdicts(rules: list[tuple[str, str]], digits: str) -> str:
    """Rules, then the stand-in list: keys whose md5 begins with one of ``digits``."""
    cases = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        h, slash, p = rule.partition("/")
        cases.append((f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash}{p}')", rule, verdict))
    rule_sql = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in cases)
    verdict_sql = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases)
    return fr"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UP}', '{_LOW}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, CASE {rule_sql} END AS rule,
  CASE {verdict_sql} WHEN contains('{digits}', md5(host || path)[1]) THEN 'block' ELSE 'allow' END AS verdict FROM p
"""


CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) AS r,
  length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) AS t FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + r + 2 + t + 8)::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""


RANKED = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
it AS (SELECT DISTINCT iid, item_id, term FROM (SELECT iid, item_id, unnest(w) AS term FROM i)),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS total FROM d),
tf AS (SELECT rid, doc_id, n, term, count(*) AS tf
    FROM (SELECT rid, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY rid, doc_id, n, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wt AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight FROM df, s),
sc AS (SELECT iid, item_id, rid, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf
    + 8 * (10 + (90 * n * n_docs) // total))))::BIGINT AS score
    FROM it JOIN wt USING (term) JOIN tf USING (term), s GROUP BY iid, item_id, rid, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


SIMILAR = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
link AS MATERIALIZED (SELECT x, y FROM (SELECT a.rid AS x, b.rid AS y, count(*) AS c
    FROM sh a JOIN sh b ON a.s = b.s AND a.rid <> b.rid GROUP BY a.rid, b.rid)
  JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
reach(rid, other) AS (SELECT rid, rid FROM d UNION SELECT r.rid, l.y FROM reach r JOIN link l ON l.x = r.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN reach r ON r.rid = d.rid JOIN d o ON o.rid = r.other LEFT JOIN n ON n.rid = d.rid GROUP BY d.rid, d.doc_id
"""
