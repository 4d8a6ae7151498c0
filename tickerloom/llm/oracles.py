"""SQL of the text queries that SQL can express, for DuckDB over the same parquet tables."""

from __future__ import annotations

from tickerloom.llm import fingerprints

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms(text: str, pattern: str) -> str:
    return f"unnest(regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}'))"


_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_LETTERS_DIGITS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SHARE = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({whole} + 2 * v)"
_DISTANCE = "((p - q) * (p - q)) // (p + q)"

_DIVERGENCE = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () id, coalesce(lang, '') lang, coalesce(source, '') source, text FROM documents),
tokens AS (SELECT id, lang, source, {_terms('text', _LETTERS)} term FROM docs),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) n, count(DISTINCT id) held FROM tokens GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) total FROM counts GROUP BY ALL HAVING sum(held) >= 10),
langs AS (SELECT lang, count(*) v, sum(total) whole FROM kept GROUP BY ALL),
cells AS MATERIALIZED (SELECT lang, source, term, n FROM counts JOIN kept USING (lang, term)),
groups AS MATERIALIZED (
    SELECT g.lang, g.source, coalesce(v, 0) v, coalesce(sum(n), 0) whole
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs USING (lang) LEFT JOIN cells USING (lang, source) GROUP BY ALL),
shares AS MATERIALIZED (
    SELECT g.lang, g.source, k.term, coalesce(n, 0) n, {_SHARE.format(n='coalesce(n, 0)', whole='whole')} p
    FROM groups g JOIN kept k USING (lang) LEFT JOIN cells USING (lang, source, term)),
pairs AS (
    SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(d.value, 0) value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source other, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) value
               FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) d
        ON d.lang = a.lang AND d.source = a.source AND d.other = b.source),
terms AS (
    SELECT lang, source, 'term' part, term item, {_DISTANCE} value
    FROM (SELECT s.lang, s.source, s.term, n, p, {_SHARE.format(n='total', whole='whole')} q
          FROM shares s JOIN kept USING (lang, term) JOIN langs USING (lang)) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 10
"""

_SEARCH = f"""
WITH items AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_terms('text', _LETTERS_DIGITS)} term FROM benchmark)),
docs AS MATERIALIZED (SELECT row_number() OVER () id, doc_id, text FROM documents),
counts AS MATERIALIZED (SELECT id, doc_id, term, count(*) tf FROM (SELECT id, doc_id, {_terms('text', _LETTERS_DIGITS)} term FROM docs) GROUP BY ALL),
lengths AS MATERIALIZED (SELECT id, sum(tf)::BIGINT n FROM counts GROUP BY ALL),
whole AS (SELECT count(*) docs, sum(n)::BIGINT words FROM lengths),
weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM whole) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) w
    FROM counts WHERE term IN (SELECT term FROM items) GROUP BY ALL),
found AS (
    SELECT item_id, id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) score
    FROM items JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (id), whole GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) rank FROM found WHERE score > 0) WHERE rank <= 10
"""


def _leaves(text: str) -> str:
    pattern = fingerprints.LEAVES.replace("\\n", "\n")
    return f"""list_transform(list_transform(regexp_extract_all({text}, '{pattern}'),
        lambda x: struct_pack(d := substr(sha256(x), 1, {fingerprints.HEX}), s := length(x), l := contains(x, chr(10)), g := contains(x, chr(10) || chr(10)))),
        lambda x: x.d || lpad(CAST(x.s AS VARCHAR), 3, '0')
            || CASE WHEN NOT x.l THEN ',' WHEN x.g OR x.d[1] IN ('0', '1') THEN '|' ELSE ';' END)"""


def _split(text: str, mark: str) -> str:
    return f"list_filter(string_split({text}, '{mark}'), lambda x: x <> '')"


def _root(leaves: str) -> str:
    return f"""sha256(array_to_string(list_transform({_split(f"array_to_string({leaves}, '')", '|')},
        lambda s: sha256(array_to_string(list_transform({_split('s', ';')}, lambda p: sha256(p)), ''))), ''))"""


def _codes(leaves: str) -> str:
    return f"""list_distinct(list_transform({leaves}, lambda x:
        CAST('0x' || substr(x, 1, 12) AS BIGINT) * 256 + CAST(substr(x, {fingerprints.HEX + 1}, 3) AS BIGINT)))"""


def _likeness(a: str, b: str) -> str:
    def size(codes: str) -> str:
        return f"CAST(coalesce(list_sum(list_transform({codes}, lambda x: x % 256)), 0) AS BIGINT)"

    both = size(f"list_intersect({a}, {b})")
    either = f"({size(a)} + {size(b)} - {both})"
    return f"CASE WHEN {either} = 0 THEN 1.0 ELSE CAST({both} AS DOUBLE) / CAST({either} AS DOUBLE) END"


_FINGERPRINTS = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') t, md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')) k FROM documents),
texts AS (
    SELECT doc_id, t, length(t) n, coalesce(lead(t) OVER w, first_value(t) OVER w) next
    FROM docs WINDOW w AS (ORDER BY doc_id NULLS FIRST, k)),
edited AS (SELECT *, substr(t, 1, n - n // 4) || substr(next, 1, n // 4) e FROM texts),
leaves AS MATERIALIZED (SELECT doc_id, n, e, {_leaves('t')} a, {_leaves('e')} b, {_leaves('next')} c FROM edited),
codes AS MATERIALIZED (SELECT *, {_codes('a')} ca, {_codes('b')} cb, {_codes('c')} cc FROM leaves)
SELECT doc_id, n AS n_chars, sha256(e) AS edited_sha256, {_root('a')} AS fingerprint, {_root('b')} AS edited_fingerprint,
       {_likeness('ca', 'cb')} AS near_edited, {_likeness('ca', 'cc')} AS near_next, CAST(len(a) AS BIGINT) AS n_leaves
FROM codes
"""

ORACLES: dict[str, str] = {
    "op11_divergence": _DIVERGENCE,
    "op12_reversed_search": _SEARCH,
    "op13_merkle": _FINGERPRINTS,
}
