"""SQL (DuckDB) that gives the rows of the registered queries, where SQL can say them."""

from __future__ import annotations

import string


def vector_search_sql(k: int = 10, every: int = 100) -> str:
    """Every inner product of a query's row with another row."""
    return f"""WITH sound AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id,
                   list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))::BIGINT) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        scores AS (
            SELECT q.r, q.vec_id AS query_id, c.r AS other, c.vec_id,
                   coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
            FROM sound q JOIN sound c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % {every} = 0)
        SELECT query_id, rank::INT AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) AS rank FROM scores) WHERE rank <= {k}"""


_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def near_duplicates_sql(width: int = 5, percent: int = 85) -> str:
    """Intersections counted shingle by shingle, links followed until nothing changes. Equal sets
    are one node, so that hot shingles of copies are not paired with one another."""
    return rf"""WITH RECURSIVE words AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^ 	-
]+') AS w FROM documents),
        shingled AS MATERIALIZED (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {width - 1}, 1) + 1),
                   lambda i: array_to_string(w[i:least(i + {width - 1}, len(w))], ' ')))) END AS s FROM words),
        classes AS MATERIALIZED (
            SELECT min(doc_id) AS c, s, len(s) AS n FROM shingled WHERE len(s) > 0 GROUP BY s),
        pieces AS MATERIALIZED (SELECT c, n, unnest(s) AS x FROM classes),
        links AS MATERIALIZED (
            SELECT a.c AS one, b.c AS two FROM pieces a JOIN pieces b ON a.x = b.x AND a.c <> b.c
            GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
        reached(c, root) AS (
            SELECT c, c FROM classes UNION SELECT links.two, reached.root FROM reached JOIN links ON links.one = reached.c),
        roots AS (SELECT c, min(root) AS root FROM reached GROUP BY c),
        joined AS (
            SELECT shingled.doc_id, len(shingled.s)::BIGINT AS n_shingles, coalesce(roots.root, shingled.doc_id) AS component_id
            FROM shingled LEFT JOIN classes ON classes.s = shingled.s LEFT JOIN roots ON roots.c = classes.c)
        SELECT *, component_id = doc_id AS kept FROM joined"""


def repeats_sql(length: int = 200) -> str:
    """Every byte string of the length, by its digest; covered runs are cut out of the text's hexadecimal form."""
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
        strings AS MATERIALIZED (
            SELECT r, p, md5(b[p + 1:p + {length}]) AS h FROM (SELECT r, b, unnest(range(0, octet_length(b) - {length - 1})) AS p FROM docs)),
        again AS (SELECT r, p FROM strings WHERE h IN (SELECT h FROM strings GROUP BY h HAVING count(*) > 1)),
        marked AS (SELECT r, p, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + {length} THEN 1 ELSE 0 END AS fresh FROM again),
        runs AS (
            SELECT r, min(p) AS a, max(p) + {length} AS e
            FROM (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS run FROM marked) GROUP BY r, run),
        cuts AS (
            SELECT r, list_prepend(0, list(e ORDER BY a)) AS starts, list(a ORDER BY a) AS ends, sum(e - a)::BIGINT AS removed, count(*) AS spans
            FROM runs GROUP BY r),
        cut AS (
            SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, b,
                   hex(b) AS x, coalesce(starts, [0]) AS starts, list_append(coalesce(ends, []), octet_length(b)) AS ends
            FROM docs LEFT JOIN cuts USING (r))
        SELECT doc_id, n_bytes, n_removed, n_spans,
               sha256(unhex(array_to_string(list_transform(range(1, len(starts) + 1), lambda i: x[2 * starts[i] + 1:2 * ends[i]]), ''))) AS kept_sha256
        FROM cut"""


def clusters_sql(centroids: int = 16, rounds: int = 3) -> str:
    """Rounds of assignment and means as a chain of tables; every distance is computed."""
    parts = [
        """kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id,
                   list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))::BIGINT) AS v
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v
            FROM kept WHERE vec_id IS NOT NULL ORDER BY sha256('1:' || vec_id), v LIMIT {centroids})""",
    ]
    for k in range(rounds + 1):
        parts.append(
            f"""a{k} AS MATERIALIZED (
            SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, d * 100 + c) AS c, min(d) AS d
            FROM (SELECT r, vec_id, kept.v, c,
                         list_sum(list_transform(range(1, 65), lambda i: (kept.v[i] - c{k}.v[i]) * (kept.v[i] - c{k}.v[i])))::BIGINT AS d
                  FROM kept, c{k}) GROUP BY r)"""
        )
        if k < rounds:
            parts.append(
                f"""c{k + 1} AS MATERIALIZED (
            SELECT c, coalesce(m.v, c{k}.v) AS v FROM c{k} LEFT JOIN (
                SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v
                FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n
                      FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{k}) GROUP BY c, i) GROUP BY c) m USING (c))"""
            )
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
               (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (c)"""


#: crc32 of a decimal number, bit by bit (reversed polynomial of the checksum, a fixed value).
_CRC_EVEN = """(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda c, b: xor(c >> 1, 3988292384 * (c & 1)))) & 1) = 1"""


def manifest_sql(levels: int = 14) -> str:
    """Both trees level by level; a table of a level holds every node's place, digest and run.

    The checksum is complemented at its end, so it is even where the last bit is 1.
    """

    def field(name: str) -> str:
        return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    def trees(name: str, start: str) -> list[str]:
        """Levels of all trees of ``start`` (tree, pos, digest); each node's siblings before and behind it."""
        out, last = [], start
        for k in range(levels):
            out.append(
                f"""{name}{k} AS MATERIALIZED (
                SELECT tree, pos, digest, n, CASE WHEN n = 1 THEN '' ELSE coalesce(string_agg(digest, '') OVER
                           (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS before,
                       CASE WHEN n = 1 THEN '' ELSE coalesce(string_agg(digest, '') OVER
                           (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS behind
                FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {last}))"""
            )
            out.append(
                f"""{name}_up{k} AS MATERIALIZED (
                SELECT tree, pos // 3 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(digest)
                       ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest
                FROM {name}{k} GROUP BY tree, pos // 3)"""
            )
            last = f"{name}_up{k}"
        return out

    def climbed(name: str, rows: str, columns: str, first: str) -> list[str]:
        """Follow every row of ``rows`` (tree, pos, proof, now) up the levels."""
        out, last = [], rows
        for k in range(levels):
            out.append(
                f"""{name}{k} AS MATERIALIZED (
                SELECT {columns}, r.tree, r.pos // 3 AS pos, r.proof || l.before || l.behind AS proof,
                       CASE WHEN l.n = 1 THEN r.now ELSE sha256(l.before || r.now || l.behind) END AS now
                FROM {last} r JOIN {first}{k} l ON l.tree IS NOT DISTINCT FROM r.tree AND l.pos = r.pos)"""
            )
            last = f"{name}{k}"
        return out

    even = _CRC_EVEN.format(text="doc_id::VARCHAR")
    replaced = "replace(text, chr(10), '')"
    parts = [
        f"""leaves AS MATERIALIZED (
            SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {leaf("text")}) - 1 AS pos,
                   doc_id, {leaf("text")} AS digest, CASE WHEN {even} THEN {leaf(replaced)} ELSE {leaf("text")} END AS now
            FROM documents)""",
        "start AS (SELECT tree, pos, digest FROM leaves)",
        *trees("t", "start"),
        f"""tops AS MATERIALIZED (
            SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS pos, digest, tree AS source FROM t_up{levels - 1})""",
        *trees("s", "tops"),
        "leaf_rows AS (SELECT doc_id, digest AS leaf, tree, pos, '' AS proof, now FROM leaves)",
        *climbed("p", "leaf_rows", "r.doc_id, r.leaf", "t"),
        f"""mid AS MATERIALIZED (
            SELECT p.doc_id, p.leaf, p.tree AS source, tops.digest AS subroot, '' AS tree, tops.pos, p.proof, p.now
            FROM p{levels - 1} p JOIN tops ON tops.source IS NOT DISTINCT FROM p.tree)""",
        *climbed("q", "mid", "r.doc_id, r.leaf, r.subroot", "s"),
    ]
    return f"""WITH {", ".join(parts)}
        SELECT doc_id, leaf, subroot, root.digest AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = root.digest AS verified
        FROM q{levels - 1}, (SELECT digest FROM s_up{levels - 1}) root"""
