"""DuckDB SQL for the queries of this package that SQL expresses at the speed of a check."""

from __future__ import annotations

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str) -> str:
    """(key, s): the distinct 5-word shingles of each text, or its whole few words."""
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
               FROM (SELECT {key}, regexp_extract_all({_FOLDED}, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM {table})"""


OP2 = f"""
WITH d AS ({_shingles("documents", "doc_id")}), b AS ({_shingles("benchmark", "item_id")}), n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY 1),
     m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 75 * n_item
"""


def _reach(percent: int, more: str = "") -> str:
    """Components of documents whose shingles have a similarity of `percent` or more."""
    return f"""
WITH RECURSIVE d AS ({_shingles("documents", "doc_id")}), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
     m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM d a JOIN d b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     l AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
     reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT a AS doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(b) AS component_id{more} FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY 1
"""


OP3 = _reach(75)
OP12 = _reach(85, ", min(b) = a AS kept")

OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS s FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
     p AS (SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p AS positive_id, row_number() OVER (PARTITION BY p.a, p ORDER BY s DESC, b)::INT AS rank, b AS negative_id, ps AS positive_score, s AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 30 * ps <= 100 * s AND 100 * s <= 90 * ps QUALIFY rank <= 10
"""


def _found(kind: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    value = f"regexp_extract(ms[i], '{pattern}', {group})"
    return f"""SELECT doc_id, source, lang, unnest([{{'kind': {kind}, 'pos': list_sum([length(p) FOR p IN ps[1:i]]) + coalesce(list_sum([length(m) FOR m IN ms[1:i - 1]]), 0),
                      'size': length(ms[i]), 'value': {value}}} FOR i IN range(1, len(ms) + 1) IF length({value}) >= {least}], recursive := true)
               FROM (SELECT doc_id, source, lang, string_split_regex(text, '{pattern}') AS ps, regexp_extract_all(text, '{pattern}', 0) AS ms FROM documents WHERE text IS NOT NULL)"""


def op9() -> str:
    from .secrets import ADDED, BASE, EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, KINDS, LIVE_OWNERS, LIVE_REPOSITORIES

    parts = " UNION ALL ".join(_found(k, *x) for k, x in enumerate({**BASE, **ADDED}.values()))
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    base = f"kind < {len(BASE)}"
    example = f"(owners >= {EXAMPLE_OWNERS} OR repositories >= {EXAMPLE_REPOSITORIES})"
    one = f"{names}[kind + 1] || ':' || pos || ':' || (pos + size)"
    return f"""
WITH f AS (SELECT doc_id, source, lang, kind, CAST(pos AS BIGINT) AS pos, CAST(size AS BIGINT) AS size, value FROM ({parts})),
     o AS (SELECT value, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT (coalesce(source, ''), coalesce(lang, ''))) AS repositories FROM f GROUP BY 1), t AS (SELECT f.*, owners, repositories FROM f JOIN o USING (value)),
     k AS (SELECT * FROM t WHERE {base} OR (NOT {example} AND NOT EXISTS (SELECT 1 FROM f b WHERE b.doc_id = t.doc_id AND b.{base} AND b.pos < t.pos + t.size AND t.pos < b.pos + b.size))),
     s AS (SELECT doc_id, string_agg({one}, ',' ORDER BY pos, kind) AS spans, string_agg(CASE WHEN {base} THEN {one} END, ',' ORDER BY pos, kind) AS bases FROM k GROUP BY 1),
     c AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
                  count(*) FILTER (owners <= {LIVE_OWNERS} AND repositories <= {LIVE_REPOSITORIES}) AS live, count(*) FILTER {example} AS example,
                  max(owners) AS o, max(repositories) AS r FROM t GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(bases, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(live, 0) AS n_live, coalesce(example, 0) AS n_example,
       coalesce(o, 0)::BIGINT AS most_owners, coalesce(r, 0)::BIGINT AS most_repositories
FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
