"""DuckDB SQL for the queries that SQL can express.

Personal data (context scores), byte-level BPE, SimHash components, lattice scores and page text
are left to brute-force tests.
"""

from __future__ import annotations

from tracklens.llm import chat, fim, quality, secrets

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_HIT_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, {_HIT_WORD}) AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_HIT_WORD}) AS w FROM benchmark),
bn AS (SELECT *, row_number() OVER () AS text_no FROM b),
win AS (SELECT item, text_no, i - 1 AS j, array_to_string(w[i:i + 9], ' ') AS k, least(len(w), 10) AS n
    FROM (SELECT item, text_no, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bn WHERE len(w) > 0) AS x),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n) AS x),
occ AS (SELECT rid, item, text_no, j, spot.n, i FROM spot JOIN win ON spot.k = win.k AND spot.n = win.n),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM occ) AS x GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM occ) AS x GROUP BY rid),
runs AS (SELECT rid, item, min(i) - 1 AS place, min(j) AS item_place, count(*) + any_value(n) - 1 AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, text_no, i - j ORDER BY i) AS run FROM occ) AS x GROUP BY rid, item, text_no, i - j, run),
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY size DESC, place, item NULLS LAST, item_place) = 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
    CAST(coalesce(size, 0) AS BIGINT) AS longest_match, CAST(place AS BIGINT) AS match_word, longest.item AS match_item, CAST(item_place AS BIGINT) AS match_item_word
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid) LEFT JOIN longest USING (rid)"""

_MEASURED = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8) AS x),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM rep) AS x GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(regexp_extract_all(t, '[A-Za-z]')) AS n_letters, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter
    FROM d JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
f AS (SELECT *, CAST(""" + " + ".join(f"CASE WHEN {rule} THEN {quality.BIT[name]} ELSE 0 END" for name, rule in quality.RULES) + """ AS BIGINT) AS failed FROM m)"""

OP3 = f"""{_MEASURED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {quality.POLICIES["base"]} <> 0 AS base_failed, failed & {quality.POLICIES["v1"]} = 0 AS kept, failed FROM f"""

ABLATIONS = f"""{_MEASURED}, r AS (SELECT * FROM (VALUES {", ".join(f"('{n}', CAST({b} AS BIGINT))" for n, b in quality.BIT.items())}) AS v(rule, bit))
SELECT rule, bit, count(*) FILTER (failed & bit <> 0) AS n_rejected, count(*) FILTER (failed = bit) AS n_only_by_it, count(*) FILTER (failed & ~bit = 0) AS n_kept_without, count(*) AS n_docs
FROM f, r GROUP BY rule, bit"""

OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, row_number() OVER (PARTITION BY h ORDER BY page_id) AS n FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - i % 4 * 5 AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
    CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n = 1 THEN NULL ELSE first END AS refers_to
FROM q"""


def _matches(kind: str) -> str:
    pattern, k = secrets.PATTERNS[kind].replace("'", "''"), secrets.KINDS.index(kind)
    value = f"regexp_extract_all(t, '{pattern}', 1)" if kind == "assign" else f"regexp_extract_all(t, '{pattern}')"
    return f"SELECT rid, src, repo, {k} AS kind, regexp_extract_all(t, '{pattern}') AS m, {value} AS v, string_split_regex(t, '{pattern}') AS g FROM d"


_NAMES = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS src, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS t FROM documents),
every AS ({" UNION ALL ".join(_matches(k) for k in secrets.KINDS)}),
each AS (SELECT rid, src, repo, kind, unnest(m) AS x, unnest(v) AS value, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM every WHERE len(m) > 0),
placed AS (SELECT *, sum(length(gap) + length(x)) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM each),
s AS (SELECT rid, src, repo, kind, CAST(e - length(x) AS BIGINT) AS b, CAST(e AS BIGINT) AS e, value FROM placed WHERE kind <> 0 OR length(value) >= {secrets.LEAST_ASSIGNED}),
own AS (SELECT value, count(DISTINCT src) AS owners, count(DISTINCT repo) AS repos FROM s GROUP BY value),
told AS (SELECT s.*, owners, repos, CASE WHEN owners >= {secrets.WIDE_OWNERS} OR repos >= {secrets.WIDE_REPOS} THEN 'copied' WHEN length(value) >= {secrets.LEAST_LIVE} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(value, '{secrets.PLACEHOLDER}') THEN 'live' ELSE 'weak' END AS verdict,
    {_NAMES}[kind + 1] || ':' || b || ':' || e AS span FROM s JOIN own USING (value)),
g AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(secrets.KINDS))}, {", ".join(f"count(*) FILTER (verdict = '{v}') AS n_{v}" for v in ("live", "copied", "weak"))}, max(owners) AS most_owners, max(repos) AS most_repos,
    string_agg(span, ',' ORDER BY b, kind) FILTER (kind < {len(secrets.BASE_KINDS)}) AS base, string_agg(span, ',' ORDER BY b, kind) AS spans FROM told GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in (*secrets.KINDS, "live", "copied", "weak"))}, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""

_ESCAPED = "replace(replace({0}, '&', '&amp;'), '<', '&lt;')"
_LINK = chat.MARKUP.replace("'", "''")
_KIND = " ".join(f"WHEN regexp_matches(lower(ref), '\\.({endings.replace(' ', '|')})([?#].*)?$') THEN '{kind}'" for kind, endings in reversed(chat.ENDINGS.items()))
_ROWS = rf"""c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')"""
OP10 = rf"""
WITH {_ROWS},
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS t FROM c),
f AS (SELECT conv_id, t, unnest(m) AS mark, generate_subscripts(m, 1) AS k FROM (SELECT conv_id, t, regexp_extract_all(text, '{_LINK}') AS m FROM r) AS x WHERE len(m) > 0),
a AS (SELECT conv_id, mark, CASE {_KIND} ELSE 'image' END AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY t, k) - 1 AS number FROM (SELECT *, regexp_extract(mark, '\(([^()]*)\)$', 1) AS ref FROM f) AS x),
b AS (SELECT conv_id, count(*) AS n, CAST(sum(CASE kind {" ".join(f"WHEN '{k}' THEN {n}" for k, n in chat.TOKENS_PER_UNIT.items())} END) AS BIGINT) AS tokens,
    CAST(sum(length(kind) + length(CAST(number AS VARCHAR)) + 4 - length({_ESCAPED.format("mark")})) AS BIGINT) AS longer FROM a GROUP BY conv_id),
s AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY t)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY t) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('<turn></turn>') + 2 + length(replace({_ESCAPED.format("role")}, chr(10), '&nl;')) + length({_ESCAPED.format("text")})) AS BIGINT) AS plain_chars FROM r GROUP BY conv_id)
SELECT s.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, plain_chars + coalesce(longer, 0) AS formatted_chars, coalesce(n, 0) AS n_attachments, coalesce(tokens, 0) AS expanded_tokens
FROM s LEFT JOIN b ON s.conv_id IS NOT DISTINCT FROM b.conv_id"""

OP11 = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, {_TERM}) AS w FROM documents),
d AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM t WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) AS x GROUP BY rid, term),
i AS (SELECT row_number() OVER () AS no, item_id, list_distinct(regexp_extract_all({_LOWER}, {_TERM})) AS w FROM benchmark),
q AS (SELECT no, item_id, unnest(w) AS term FROM i),
v AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, total GROUP BY term, docs),
s AS (SELECT no, item_id, rid, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
    FROM q JOIN v USING (term) JOIN p USING (term) JOIN d USING (rid), total GROUP BY no, item_id, rid, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, rid) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""

_DRAWN = ", ".join(f"CAST('0x' || substr(x, {8 * i - 7}, 8) AS BIGINT) AS h{i}" for i in (1, 2, 3, 4))
OP13 = rf"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{fim.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
l AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, {_DRAWN} FROM h),
c AS (SELECT *, CAST(len(l) AS BIGINT) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b FROM l),
p AS (SELECT doc_id, t, n, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:n], '') AS s,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= {fim.RATE} THEN 'plain' WHEN h4 % 100 < {fim.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""

ORACLES: dict[str, str] = {
    "op2_decontaminate": OP2,
    "op3_quality_rules": OP3,
    "quality_ablations": ABLATIONS,
    "op8_warc": OP8,
    "op9_secrets": OP9,
    "op10_chat": OP10,
    "op11_ranked": OP11,
    "op12_exact_dedup": OP12,
    "op13_fim": OP13,
}
