"""Plain SQL over the raw tables for every query of :mod:`queries`."""

from __future__ import annotations

from sealdex.plans.queries import DEMO, LEVEL_FAN_OUT, ROLL_BYTES

_DIRECTORY = """
  SELECT c_custkey AS custkey, c_name AS name, r_name AS region, c_mktsegment AS segment,
         n_name AS nation, c_acctbal AS acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

_NO_TEXT = "CAST(NULL AS VARCHAR)"
_NO_NUMBER = "CAST(NULL AS DOUBLE)"


def _people(where: str) -> str:
    return f"SELECT * FROM ({_DIRECTORY}) WHERE {where}"


def _opened(where: str, segment="segment", nation="nation", acctbal="acctbal") -> str:
    return (
        f"SELECT custkey, name, region, {segment} AS segment, {nation} AS nation, {acctbal} AS acctbal "
        f"FROM ({_DIRECTORY}) WHERE {where}"
    )


_TERMS = f"""
  SELECT DISTINCT custkey, unnest([lower(nation), lower(segment), 'nation=' || lower(nation),
    'segment=' || lower(segment), 'region=' || lower(region)]) AS term
  FROM ({_DIRECTORY})
"""

_WORDS = r"""
  SELECT * FROM (
    SELECT DISTINCT doc_id, lang, unnest(string_split_regex(lower(text), '\s+')) AS word FROM documents
  ) WHERE word <> ''
"""


def _has(word: str) -> str:
    return rf"list_contains(string_split_regex(lower(text), '\s+'), '{word}')"


# Length of a sealed directory record: four JSON bodies, 28 bytes of cipher
# overhead and 8 bytes of framing each, and 4 bytes for the record.
_SIZED = f"""
  SELECT *, strlen('{{"custkey":"' || custkey || '","name":"' || name || '","region":"' || region || '"}}')
    + strlen('{{"segment":"' || segment || '"}}') + strlen('{{"nation":"' || nation || '"}}')
    + strlen('{{"acctbal":"' || acctbal || '"}}') + 4 * (28 + 8) + 4 AS size
  FROM ({_DIRECTORY})
"""

_OFFSETS = f"""
  SELECT region, custkey, segment, size, CAST(coalesce(sum(size) OVER (PARTITION BY region ORDER BY custkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM ({_SIZED})
"""

_ORDERS = """
  SELECT o_orderkey AS orderkey, o_custkey AS custkey, r_name AS region, o_orderstatus AS status,
         o_orderpriority AS priority, substr(o_orderpriority, 1, 1) AS urgency,
         o_orderdate AS orderdate, o_totalprice AS totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
"""

_EVENTS = "SELECT event_id, ts, user_id, event_type AS type, value FROM events"

_ALL_DEPARTMENTS = "(VALUES ('Marketing'), ('HR'), ('Security'), ('Other')) d(dept)"
_ALL_REGIONS = "(VALUES ('AFRICA'), ('AMERICA'), ('ASIA'), ('EUROPE'), ('MIDDLE EAST')) r(region)"

_ACCESS_MATRIX = f"""
  WITH cells AS (
    SELECT 'super' AS usr, dept, region FROM {_ALL_DEPARTMENTS}, {_ALL_REGIONS}
    UNION ALL VALUES ('asia_marketing', 'Marketing', 'ASIA'), ('europe_hr', 'HR', 'EUROPE')
    UNION ALL SELECT 'security_only', 'Security', region FROM {_ALL_REGIONS}
    UNION ALL SELECT 'hr_and_security', dept, region
      FROM {_ALL_DEPARTMENTS}, {_ALL_REGIONS} WHERE dept IN ('HR', 'Security') AND region IN ('AFRICA', 'ASIA')
    UNION ALL VALUES ('nobody', 'Other', 'AMERICA')
    UNION ALL VALUES ('nested', 'Marketing', 'ASIA'), ('nested', 'Marketing', 'EUROPE'), ('nested', 'HR', 'AFRICA')
  ), audience(part, dept) AS (
    VALUES ('common', 'Marketing'), ('common', 'HR'), ('marketing', 'Marketing'), ('hr', 'HR'),
           ('security', 'Security')
  ), openable AS (SELECT DISTINCT usr, part, region FROM cells JOIN audience USING (dept)),
  visible AS (
    SELECT o.* FROM openable o JOIN openable g ON g.usr = o.usr AND g.region = o.region AND g.part = 'common'
  )
  SELECT usr AS "user", part, region, count(*) AS n FROM visible JOIN ({_DIRECTORY}) USING (region)
  GROUP BY ALL
"""

_CONDITIONAL = f"""
  WITH w AS (SELECT DISTINCT lang, word FROM ({_WORDS})),
  a AS (SELECT word, bool_or(lang = 'en') AS en, bool_or(lang = 'fr') AS fr, bool_or(lang = 'de') AS de
        FROM w GROUP BY word)
  SELECT 'insert english' AS attempt, count(*) AS applied, 0 AS refused FROM a WHERE en
  UNION ALL SELECT 'insert all', count(*) FILTER (NOT en), count(*) FILTER (en) FROM a
  UNION ALL SELECT 'update french', count(*), 0 FROM a WHERE fr
  UNION ALL SELECT 'update french or german', count(*) FILTER (NOT fr), count(*) FILTER (fr) FROM a WHERE fr OR de
  UNION ALL SELECT 'skip a revision', 0, count(*) FROM a
"""

_INDEX_STATE = f"""
  WITH c AS (SELECT term, count(*) AS n FROM ({_TERMS}) GROUP BY term),
  s AS (SELECT count(*) AS entries, CAST(sum((n + 63) // 64) AS BIGINT) AS chain_rows FROM c)
  SELECT 'built' AS step, entries, chain_rows FROM s
  UNION ALL SELECT 'truncated', 0, 0
  UNION ALL SELECT 'rebuilt', entries, chain_rows FROM s
"""

_QUARANTINE = f"""
  SELECT outcome, count(*) AS n FROM (
    SELECT CASE WHEN nation = 'NATION_12' THEN 'malformed' WHEN nation = 'NATION_7' THEN 'missing custkey'
      WHEN nation = 'NATION_3' THEN 'unknown Region ATLANTIS' WHEN segment = 'MACHINERY' THEN 'missing name'
      ELSE 'good' END AS outcome
    FROM ({_DIRECTORY})
  ) GROUP BY outcome
"""

_MULTI_INPUT = """
  SELECT value, count(*) AS n FROM (
    SELECT 'customer ' || c_custkey || ' ' || c_name AS value FROM customer
    UNION ALL SELECT 'supplier ' || s_suppkey || ' ' || s_name FROM supplier
    UNION ALL SELECT 'supplier ' || s_suppkey || ' ' || s_name FROM supplier
  ) GROUP BY value
"""


def _token_dictionary() -> str:
    key = DEMO.reader().token_key()
    inner = (bytes(b ^ 0x36 for b in key) + b"\x36" * 32).hex()
    outer = (bytes(b ^ 0x5C for b in key) + b"\x5c" * 32).hex()
    return f"""
      SELECT base64(unhex(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode(word)))))) AS token,
             count(*) AS n
      FROM ({_WORDS}) GROUP BY word
    """


def oracle_sql() -> dict[str, str]:
    return {
        "index_terms": _TERMS,
        "postings_by_word": f"SELECT term AS word, count(*) AS n FROM ({_TERMS}) GROUP BY term",
        "posting_blocks": f"SELECT word, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc "
        f"FROM ({_WORDS}) GROUP BY word",
        "search_bare": _people("lower(nation) = 'nation_12' OR lower(segment) = 'nation_12'"),
        "search_scoped": _people("lower(nation) = 'nation_7'"),
        "search_and": _people("region = 'ASIA' AND segment = 'BUILDING'"),
        "search_and_none": _people("region = 'ASIA' AND nation = 'NATION_3'"),
        "search_and_unknown": _people("region = 'ASIA' AND nation = 'ATLANTIS'"),
        "search_or": _people("nation IN ('NATION_2', 'NATION_8')"),
        "search_or_overlap": _people("region = 'ASIA' OR segment = 'BUILDING'"),
        "search_or_unknown": _people("nation IN ('NATION_14', 'ATLANTIS')"),
        "doc_search_word": f"SELECT doc_id FROM documents WHERE {_has('the')}",
        "doc_search_and": f"SELECT doc_id FROM documents WHERE {_has('the')} AND {_has('in')} AND {_has('that')}",
        "doc_search_or": f"SELECT doc_id FROM documents WHERE {_has('the,')} OR {_has('with')} OR {_has('des')}",
        "order_search": f"SELECT * FROM ({_ORDERS}) WHERE strftime(orderdate, '%Y-%m') = '1997-05' AND status = 'F'",
        "index_sizes": f"""
          SELECT count(*) AS entries, CAST(sum((n + 63) // 64) AS BIGINT) AS chain_rows,
                 CAST(sum(n) AS BIGINT) AS postings
          FROM (SELECT word, count(*) AS n FROM ({_WORDS}) GROUP BY word)
        """,
        "index_incremental": f"SELECT word, count(*) AS n, CAST(count(DISTINCT lang) - 1 AS INTEGER) AS revision "
        f"FROM ({_WORDS}) GROUP BY word",
        "index_levels": f"""
          WITH w AS (SELECT word, count(*) AS n, CAST(count(DISTINCT source) - 1 AS INTEGER) AS revision
                     FROM (SELECT * FROM ({_WORDS}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id)) GROUP BY word),
               s AS (SELECT count(DISTINCT source) AS n FROM documents)
          SELECT word, n, revision, CAST((SELECT list_sum(list_transform(range(0, 16),
            lambda k: s.n // CAST(pow({LEVEL_FAN_OUT}, k) AS BIGINT) % {LEVEL_FAN_OUT})) FROM s) AS INTEGER) AS runs FROM w
        """,
        "index_lost_block": f"SELECT count(*) AS found, 'refused' AS without_a_block FROM documents WHERE {_has('the')} OR {_has('in')}",
        "replay_snapshot": f"""
          SELECT step, region, count(*) AS n
          FROM ({_DIRECTORY}), (SELECT unnest(['before', 'read late', 'replaced', 'broken off']) AS step)
          WHERE region = 'EUROPE' OR (region = 'ASIA' AND step IN ('before', 'read late')) GROUP BY ALL
        """,
        "entry_conditional_upsert": _CONDITIONAL,
        "index_truncate_rebuild": _INDEX_STATE,
        "token_dictionary": _token_dictionary(),
        "open_all_super": _opened("TRUE"),
        "open_all_marketing": _opened("region = 'ASIA'", nation=_NO_TEXT, acctbal=_NO_NUMBER),
        "open_all_hr": _opened("region = 'EUROPE'", segment=_NO_TEXT, acctbal=_NO_NUMBER),
        "open_hr_and_security": _opened("region IN ('AFRICA', 'ASIA')", segment=_NO_TEXT),
        "open_nested_policy": _opened(
            "region IN ('ASIA', 'EUROPE', 'AFRICA')",
            segment="CASE WHEN region <> 'AFRICA' THEN segment END",
            nation="CASE WHEN region = 'AFRICA' THEN nation END",
            acctbal=_NO_NUMBER,
        ),
        "open_no_access": "SELECT CAST(0 AS BIGINT) AS nobody, CAST(0 AS BIGINT) AS security_only",
        "open_orders": f"""
          SELECT orderkey, CASE WHEN region = 'AFRICA' THEN custkey END AS custkey, region, status,
                 CASE WHEN region <> 'AFRICA' THEN priority END AS priority,
                 CASE WHEN region <> 'AFRICA' THEN urgency END AS urgency,
                 CASE WHEN region = 'AFRICA' THEN orderdate END AS orderdate, {_NO_NUMBER} AS totalprice
          FROM ({_ORDERS}) WHERE region IN ('ASIA', 'EUROPE', 'AFRICA')
        """,
        "search_then_open": _opened("region = 'ASIA' AND segment = 'BUILDING'", nation=_NO_TEXT, acctbal=_NO_NUMBER),
        "search_found_opened": f"""
          WITH d AS ({_DIRECTORY})
          SELECT 'region=asia' AS words, count(*) AS found, count(*) AS opened FROM d WHERE region = 'ASIA'
          UNION ALL SELECT 'region=europe', count(*), 0 FROM d WHERE region = 'EUROPE'
          UNION ALL SELECT 'segment=building', count(*), count(*) FILTER (region = 'ASIA') FROM d
            WHERE segment = 'BUILDING'
        """,
        "tamper_rejected": f"SELECT count(*) AS intact, CAST(0 AS BIGINT) AS moved_opened, "
        f"CAST(0 AS BIGINT) AS swapped_parts_opened FROM ({_DIRECTORY})",
        "access_matrix": _ACCESS_MATRIX,
        "part_attributes": f"""
          WITH audience(part, depts) AS (VALUES ('common', 'Department::Marketing Department::HR'),
            ('marketing', 'Department::Marketing'), ('hr', 'Department::HR'), ('security', 'Department::Security'))
          SELECT part, 'Region::' || region || ' ' || depts AS attributes, count(*) AS n
          FROM ({_DIRECTORY}), audience GROUP BY ALL
        """,
        "axis_usage": f"""
          WITH axes(axis, value) AS (
            SELECT 'Region', region FROM {_ALL_REGIONS} UNION ALL SELECT 'Department', dept FROM {_ALL_DEPARTMENTS})
          SELECT axis, value, count(custkey) AS n FROM axes
          LEFT JOIN ({_DIRECTORY}) ON axis = 'Region' AND value = region GROUP BY ALL
        """,
        "clear_json_lines": _opened("region = 'EUROPE'", segment=_NO_TEXT, acctbal=_NO_NUMBER),
        "uid_codec": """
          SELECT hex(encode(o_orderpriority)) || printf('%016X', o_orderkey) AS uid, o_orderpriority AS file,
                 o_orderkey AS pos, o_orderpriority || ':' || o_orderkey AS text
          FROM orders
        """,
        "positions_per_file": """
          SELECT o_orderpriority AS file, o_orderkey // 4096 AS chunk,
                 string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS positions
          FROM orders GROUP BY ALL
        """,
        "record_offsets": f'SELECT region, custkey, size, "offset" FROM ({_OFFSETS})',
        "roll_buckets": f"""
          SELECT region, "offset" // {ROLL_BYTES} AS bucket, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes,
                 min(custkey) AS first_custkey
          FROM ({_OFFSETS}) GROUP BY ALL
        """,
        "hit_gaps": f"""
          SELECT region, custkey, "offset" - coalesce(lag("offset" + size)
            OVER (PARTITION BY region ORDER BY "offset"), 0) AS gap
          FROM ({_OFFSETS}) WHERE segment = 'BUILDING'
        """,
        "sealed_sizes": f"SELECT region, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM ({_SIZED}) "
        f"GROUP BY region",
        "quarantine_split": _QUARANTINE,
        "ingest_quarantine": _QUARANTINE,
        "reindex_then_replay": _people("region = 'ASIA'"),
        "multi_input_union": _MULTI_INPUT,
        "stream_ingest_equals_batch": _EVENTS,
        "stream_index_search": f"{_EVENTS} WHERE event_type IN ('click', 'purchase')",
        "stream_sentinel": f"{_EVENTS} WHERE event_id < (SELECT (max(event_id) + 1) // 2 FROM events)",
        "index_stale_writer": f"""
          WITH w AS ({_WORDS})
          SELECT (SELECT count(DISTINCT word) FROM w WHERE lang = 'de') AS proposed,
                 (SELECT count(*) FROM (SELECT word FROM w WHERE lang = 'de' INTERSECT SELECT word FROM w WHERE lang = 'fr')) AS refused,
                 (SELECT count(*) FROM w WHERE lang IN ('en', 'fr', 'de')) AS postings
        """,
        "key_lengths": """
          SELECT c_custkey, left(rpad(hex(encode(c_name || repeat(c_mktsegment, CAST(c_custkey % 4 AS BIGINT)))), 64, '0'), 64) AS key FROM customer
        """,
        "stream_restarts": """
          WITH h AS (SELECT (max(event_id) + 1) // 2 AS half FROM events)
          SELECT 1 AS run, count(*) AS records FROM events, h WHERE event_id < half
          UNION ALL SELECT 2, count(*) FROM events, h WHERE event_id >= half UNION ALL SELECT 3, 0
        """,
        "input_reconciliation": """
          SELECT c_mktsegment AS segment, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'vanished' ELSE 'read' END AS outcome,
                 CASE WHEN c_mktsegment = 'FURNITURE' THEN 0 ELSE count(*) END AS lines FROM customer GROUP BY 1
          UNION ALL SELECT 'archive', 'skipped', 0
        """,
        "vault_stages": """
          SELECT unnest(['records', 'index', 'total']) AS stage, 2 AS batches, count(*) AS events, TRUE AS sound FROM events
        """,
        "stream_behind_the_end": f"SELECT *, event_id < (SELECT (max(event_id) + 1) // 2 FROM events) AS early FROM ({_EVENTS})",
        "stage_metrics": """
          WITH s AS (SELECT event_type AS stage, count(*) AS events,
                            CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS micros
                     FROM events GROUP BY 1)
          SELECT stage, events, micros, CAST(round(micros / events) AS BIGINT) AS mean_micros,
                 round(micros * 100 / (SELECT micros FROM s WHERE stage = 'view'), 2) AS share
          FROM s
        """,
    }
