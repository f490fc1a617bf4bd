"""The registered queries as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from levylens.llm.sharding import SHARDS, SLOTS

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+')"


def _shingles(table: str, key: str, size: int) -> str:
    return f"""
        SELECT DISTINCT {key}, unnest(CASE
            WHEN len(w) >= {size} THEN list_transform(
                range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
        FROM (SELECT {key}, {_WORDS} AS w FROM {table})"""


OP5 = f"""
WITH RECURSIVE shards AS (
    SELECT i, ('0x' || substr(md5('offset:' || name), 1, 15))::BIGINT % {SLOTS} AS start,
           ('0x' || substr(md5('skip:' || name), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS skip, name
    FROM (SELECT unnest(range({len(SHARDS)})) AS i, unnest({list(SHARDS)}) AS name)
),
inverses AS (  -- skip * inverse = 1 modulo the number of slots
    SELECT i, list_filter(range(1, {SLOTS}), lambda x: x * skip % {SLOTS} = 1)[1] AS inverse
    FROM shards
),
turns AS (
    SELECT 0::BIGINT AS turn, -1::BIGINT AS slot, range(0, {SLOTS}) AS free
    UNION ALL
    SELECT turn + 1, claimed, list_filter(free, lambda s: s <> claimed) FROM (
        SELECT turn, free, (SELECT (start + skip * list_min(list_transform(free, lambda s:
            (s - start + {SLOTS}) * inverse % {SLOTS}))) % {SLOTS}
            FROM (SELECT * FROM shards JOIN inverses USING (i)) WHERE i = turn % {len(SHARDS)}
        ) AS claimed FROM turns WHERE turn < {SLOTS}
    )
)
SELECT doc_id, slot, name AS shard FROM (
    SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS}
        AS slot FROM documents
) JOIN turns USING (slot) JOIN shards ON i = (turn - 1) % {len(SHARDS)}
"""

OP6 = f"""
WITH parts AS (
    SELECT page_id,
        coalesce({_LOWER.format("regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)")}, '') AS host,
        coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
),
rules(rule_host, rule_path, action) AS (VALUES
    ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts,
    LATERAL (SELECT max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
        max_by(action, length(rule_host || rule_path)) AS action FROM rules
        WHERE ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path))
"""

OP7 = f"""
WITH RECURSIVE shingles AS ({_shingles('documents', 'doc_id', 4)}),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
),
reached AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) USING (doc_id)
"""

OP8 = f"""
WITH d AS ({_shingles('documents', 'doc_id', 5)}), i AS ({_shingles('benchmark', 'item_id', 5)}),
sizes AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id),
shared AS (
    SELECT doc_id, item_id, count(*) AS shared_shingles FROM d JOIN i USING (shingle) GROUP BY 1, 2
)
SELECT doc_id, item_id, item_shingles, shared_shingles FROM shared JOIN sizes USING (item_id)
WHERE 100 * shared_shingles >= 80 * item_shingles
"""

OP10 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
ranked AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score,
        row_number() OVER (
            PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id
        )::INTEGER AS rank
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_CRC32 = """
    xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len({0}) + 1),
        lambda i: unicode(substr({0}, i, 1))::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
            lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
        4294967295)"""

OP12 = f"""
WITH own AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
            sha256(length(role) || ':' || role || text)) AS place,
        length(role) || ':' || role || text AS said, strlen(text) AS bytes
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL)
),
convs AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32.format("conv_id::VARCHAR")} % 9 AS h
    FROM own GROUP BY conv_id
),
rebuilt AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS place,
        said, bytes
    FROM (
        SELECT convs.conv_id, 0 AS part, place, said, bytes
        FROM convs JOIN own ON own.conv_id = base AND place <= h
        UNION ALL
        SELECT conv_id, 1, place, said, bytes FROM convs JOIN own USING (conv_id) WHERE place > h
    )
),
whole AS (
    SELECT conv_id, list(said ORDER BY place) FILTER (place IS NOT NULL) AS said,
        list(bytes ORDER BY place) FILTER (place IS NOT NULL) AS bytes
    FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
),
begun AS (
    SELECT conv_id, d AS depth, coalesce(said, [])[1:d] AS k, bytes[d] AS bytes,
        d = coalesce(len(said), 0) AS ends
    FROM (SELECT *, unnest(range(coalesce(len(said), 0) + 1)) AS d FROM whole)
),
nodes AS MATERIALIZED (
    SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), ''))
            AS ends_sha256
    FROM begun GROUP BY k, depth
),
children AS (
    SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
),
subtrees AS (
    SELECT k[1:up] AS k, sum((n_children IS NULL)::BIGINT)::BIGINT AS n_leaves,
        sum(CASE WHEN depth > 0 THEN (n_convs - 1) * bytes ELSE 0 END)::BIGINT AS saved_tokens
    FROM (SELECT *, unnest(range(depth + 1)) AS up FROM nodes LEFT JOIN children USING (k))
    GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs,
    coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s ON s.k = n.k LEFT JOIN children c ON c.k = n.k
LEFT JOIN nodes p ON n.depth > 0 AND p.k = n.k[1:n.depth - 1]
"""


def _floor_ratio(a: str, b: str) -> str:
    return f"(({a}) - ((({a}) % ({b})) + ({b})) % ({b})) // ({b})"


def _rounds(rounds: int) -> str:
    """Codebooks b0 (the seeds) to b<rounds>, with the assignments a0 ... of every part between."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""
a{r} AS MATERIALIZED (
    SELECT row, part, arg_min(entry, (distance, entry)) AS entry, min(distance) AS distance FROM (
        SELECT row, p.part, entry, list_sum(list_transform(range(1, len(p.x) + 1),
            lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))::BIGINT AS distance
        FROM parts p JOIN b{r} b ON b.part = p.part
    ) GROUP BY row, part
)""")
        if r < rounds:
            out.append(f"""
b{r + 1} AS MATERIALIZED (
    SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (
        SELECT part, entry, list(x ORDER BY dim) AS x FROM (
            SELECT part, entry, dim,
                ({_floor_ratio("sum(v)::BIGINT", "count(*)")})::BIGINT AS x
            FROM (SELECT p.part, a.entry, unnest(p.x) AS v, unnest(range(len(p.x))) AS dim
                FROM parts p JOIN a{r} a ON a.row = p.row AND a.part = p.part)
            GROUP BY part, entry, dim
        ) GROUP BY part, entry
    ) m ON m.part = b.part AND m.entry = b.entry
)""")
    return ",".join(out)


OP13 = f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS row,
        list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x
    FROM embeddings WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (
    SELECT row, part, x[part * len(x) // 8 + 1:(part + 1) * len(x) // 8] AS x
    FROM (SELECT row, x, unnest(range(8)) AS part FROM kept)
),
b0 AS MATERIALIZED (SELECT part, row AS entry, x FROM parts WHERE row < 16),
{_rounds(6)},
coded AS (
    SELECT row, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code,
        sum(distance)::BIGINT AS error
    FROM a6 GROUP BY row
),
books AS (
    SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS digest FROM b6
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT digest FROM books) AS codebooks_sha256
FROM kept JOIN coded USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_sharding": OP5,
        "op6_url_rules": OP6,
        "op7_near_duplicates": OP7,
        "op8_decontamination": OP8,
        "op10_top_k": OP10,
        "op12_prefix_trie": OP12,
        "op13_vector_codes": OP13,
    }
