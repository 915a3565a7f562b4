"""DuckDB SQL of queries whose steps repeat: the text of a round or level is written once and put together here."""

from __future__ import annotations

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def vector_codes(rounds: int = 4) -> str:
    """Every entry is held against every part; sums of whole numbers below 2**53 are exact as doubles."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        a{r} AS MATERIALIZED (SELECT vec_id, part, min({{'d': (n2 + m2 - 2 * list_inner_product(x, y))::BIGINT, 'e': entry}}) AS best
            FROM p JOIN b{r} USING (part) GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""
        u{r} AS (SELECT part, best.e AS entry, unnest(x) AS c, unnest(range(len(x))) AS pos FROM p JOIN a{r} USING (vec_id, part)),
        s{r} AS (SELECT part, entry, list(c ORDER BY pos) AS y FROM
            (SELECT part, entry, pos, floor(sum(c) / count(*)) AS c FROM u{r} GROUP BY part, entry, pos) GROUP BY part, entry),
        b{r + 1} AS MATERIALIZED (SELECT part, entry, y, list_inner_product(y, y) AS m2 FROM
            (SELECT b.part, b.entry, coalesce(s.y, b.y) AS y FROM b{r} b LEFT JOIN s{r} s ON s.part = b.part AND s.entry = b.entry))""")
    return f"""
        WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE {_FINITE}),
        c AS (SELECT vec_id, label, unnest(range(4)) AS part, v, len(v) // 4 AS w FROM k),
        q AS (SELECT vec_id, label, part, list_slice(v, part * w + 1, part * w + w) AS x FROM c),
        p AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS n2 FROM q),
        b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS y, n2 AS m2 FROM p QUALIFY entry < 256),
        {",".join(steps).strip()},
        f AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
        g AS (SELECT f.*, k.label FROM f JOIN k USING (vec_id)),
        h AS (SELECT part, entry, unnest(y)::BIGINT AS c, unnest(range(len(y))) AS pos FROM b{rounds}),
        z AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS sha FROM h)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, z.sha AS codebooks_sha256 FROM g, z
    """


def periodic_runs(levels: int = 14) -> str:
    """Names of 2**k words by ranks of pairs; equal names at the next place, q words on, for periods of half to all of 2**k.

    A stretch of 2**k >= q words of a run with smallest period q occurs again exactly q words on and not before, so runs are
    the islands of places with the same q. Enough for texts of up to 4 * 2**levels words.
    """
    steps = []
    for k in range(1, levels + 1):
        half = 1 << (k - 1)
        steps.append(f"""
        n{k} AS MATERIALIZED (SELECT doc_id, i, dense_rank() OVER (PARTITION BY doc_id ORDER BY name, other) AS name FROM
            (SELECT doc_id, i, name, lead(name, {half}) OVER (PARTITION BY doc_id ORDER BY i) AS other FROM n{k - 1}) WHERE other IS NOT NULL)""")
    again = " UNION ALL ".join(
        f"SELECT doc_id, i, {1 << k} AS size, {(1 << k) // 2} AS above, lead(i) OVER (PARTITION BY doc_id, name ORDER BY i) - i AS q FROM n{k}" for k in range(levels + 1)
    )
    crc = "list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT), lambda c, x: xor(c >> 8, t.tab[(xor(c, x) & 255)::BIGINT + 1]))"
    return rf"""
        WITH t AS (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce([n::UBIGINT] || list_transform(range(8), lambda x: 0::UBIGINT),
                lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(n))),
        d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, xor(4294967295::UBIGINT, {crc})::BIGINT AS h FROM documents, t),
        e AS (SELECT *, len(ws) AS n, h // 10 AS g, h % 10 = 0 AND len(ws) > 0 AS planted FROM d),
        o AS (SELECT *, CASE WHEN planted THEN g % n END AS a FROM e),
        m AS (SELECT *, CASE WHEN planted THEN 1 + (n - a) // (3 + g % 8) END AS p FROM o),
        w AS MATERIALIZED (SELECT doc_id, CASE WHEN planted
            THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM m),
        l AS MATERIALIZED (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
        n0 AS MATERIALIZED (SELECT doc_id, i, dense_rank() OVER (PARTITION BY doc_id ORDER BY word) AS name FROM l),
        {",".join(steps).strip()},
        c AS (SELECT * FROM ({again}) WHERE q > above AND q <= size),
        s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM c),
        r AS MATERIALIZED (SELECT doc_id, min(i) AS start, max(i) - min(i) + any_value(size) + q AS length, q AS period FROM s
            GROUP BY doc_id, q, island HAVING length >= greatest(6, 4 * q)),
        b AS (SELECT a.doc_id, a.start, a.length, a.period FROM r a LEFT JOIN r b ON b.doc_id = a.doc_id AND b.length * a.period > a.length * b.period
            WHERE b.doc_id IS NULL QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY a.start, a.period) = 1),
        x AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS txt FROM r GROUP BY doc_id),
        v AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
        y AS (SELECT l.doc_id, string_agg(l.word, ' ' ORDER BY l.i) AS kept FROM l ANTI JOIN v ON v.doc_id = l.doc_id AND v.i = l.i GROUP BY l.doc_id)
        SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, (1000 * b.length // b.period) AS exponent_milli,
               sha256(coalesce(x.txt, '')) AS runs_sha256, sha256(coalesce(y.kept, '')) AS collapsed_sha256
        FROM w LEFT JOIN x USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN y USING (doc_id)
    """


def exact_top_k() -> str:
    return f"""
        WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE {_FINITE}),
        s AS (SELECT q.vec_id AS query_id, k.vec_id, list_inner_product(q.v, k.v)::BIGINT AS score
              FROM k q JOIN k ON q.vec_id % 50 = 0 AND q.vec_id <> k.vec_id)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5
    """
