"""SQL twins of those queries on training-data texts that SQL can express on whole tables."""

from __future__ import annotations

from causeway.functions.patterns import SPACES
from causeway.llm import cutoff

_BLANK = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACES) + "]"
_CONTINUED = ", ".join(f"'{a}.'" for a in cutoff.CONTINUED)
_MARKUP = cutoff.MARKUP.replace("'", "''")


def _endings() -> str:
    """Each value with the sort and form of its end."""
    last = "replace(lower(trim(string_split(t, chr(10))[-1], ' ')), '→', '->')"
    item = "regexp_matches(last, '^[-*•]\\s*\\w+\\s*:')"
    return f"""e AS (SELECT lower(label) AS entry FROM concepts WHERE concept_id IS NOT NULL AND label IS NOT NULL),
      b AS (SELECT DISTINCT trim(substring(entry, 1, k), ' ') AS begun FROM (SELECT entry, unnest(generate_series(1, length(entry) - 2)) AS k FROM e) WHERE trim(substring(entry, 1, k), ' ') NOT IN (SELECT entry FROM e)),
      v AS (SELECT row_id, coalesce(lower(regexp_replace(model, '^{_BLANK}+|{_BLANK}+$', '', 'g')), '') AS source_key, regexp_replace(raw_thinking, '{_BLANK}+$', '') AS t,
        length(raw_thinking) AS characters, strlen(raw_thinking) AS bytes FROM pair_results WHERE raw_thinking IS NOT NULL),
      x AS (SELECT *, trim(string_split(last, '->')[-1], ' ') AS rgt, trim(regexp_replace(last, '^[^:]*:', ''), ' ') AS val, {item} AS item FROM (SELECT *, {last} AS last FROM v WHERE t <> '')),
      s AS (SELECT *, CASE WHEN ((length(t) - length(replace(t, '```', ''))) // 3) % 2 <> 0 THEN 'broken'
          WHEN contains(last, '->') THEN CASE WHEN trim(rgt, '{_MARKUP}') = '' OR rgt IN (SELECT begun FROM b) THEN 'broken' WHEN trim(rgt, '{_MARKUP}') IN (SELECT entry FROM e) THEN 'whole' ELSE 'edge' END
          WHEN item THEN CASE WHEN val IN (SELECT entry FROM e) THEN 'line' ELSE 'broken' END
          WHEN last LIKE '%...' OR last LIKE '%…' THEN 'ellipsis'
          WHEN regexp_matches(last, '{cutoff.TERMINAL.replace("'", "''")}') THEN CASE WHEN ltrim(string_split(last, ' ')[-1], '([') IN ({_CONTINUED}) THEN 'broken' ELSE 'whole' END
          ELSE 'line' END AS sort FROM x),
      r AS MATERIALIZED (SELECT row_id, source_key, characters, bytes, sort,
        CASE sort WHEN 'ellipsis' THEN regexp_extract(last, '(\\S*\\s*\\S*?)(?:\\.{{3,}}|…)$', 1) WHEN 'line' THEN CASE WHEN item THEN string_split(last, ':')[1] ELSE last END END AS form FROM s)"""


def _judged() -> str:
    """Each value with its evidence."""
    near = f"ORDER BY length RANGE BETWEEN {cutoff.NEIGHBOURS} PRECEDING AND {cutoff.NEIGHBOURS} FOLLOWING"
    shares = " ".join(f"WHEN '{k}' THEN {v}" for k, v in cutoff.CLOSING_SHARES.items())
    return f"""WITH {_endings()},
      h AS (SELECT source_key, unit, length, count(*) AS n FROM (SELECT source_key, 'characters' AS unit, characters AS length FROM r UNION ALL SELECT source_key, 'bytes', bytes FROM r) GROUP BY ALL),
      w AS (SELECT *, (sum(n) OVER (PARTITION BY source_key, unit {near}) - n) / {2 * cutoff.NEIGHBOURS} AS usual,
        coalesce(sum(n) OVER (PARTITION BY source_key, unit ORDER BY length RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS n_longer FROM h),
      spikes AS MATERIALIZED (SELECT source_key, unit, length FROM w WHERE n >= {cutoff.SPIKE_LEAST} AND n >= {cutoff.SPIKE_TIMES} * usual AND n > n_longer),
      l AS MATERIALIZED (SELECT *, (source_key, 'characters', characters) IN (SELECT source_key, unit, length FROM spikes) OR (source_key, 'bytes', bytes) IN (SELECT source_key, unit, length FROM spikes) AS at_limit FROM r),
      c AS (SELECT sort, form FROM (SELECT sort, form, count(*) AS n, sum(count(*)) OVER (PARTITION BY sort) AS every FROM l WHERE NOT at_limit AND form IS NOT NULL GROUP BY sort, form)
        WHERE n >= {cutoff.CLOSING_LEAST} AND n >= CASE sort {shares} END * every),
      judged AS (SELECT l.*, CASE WHEN l.sort = 'whole' OR c.sort IS NOT NULL THEN NULL WHEN at_limit THEN 'limit' WHEN l.sort <> 'edge' THEN 'context' END AS evidence
        FROM l LEFT JOIN c ON c.sort = l.sort AND c.form = l.form)"""


SQL = {
    "p6_found": f"{_judged()} SELECT DISTINCT row_id FROM judged WHERE evidence IS NOT NULL",
    "p6_sources": f"""{_judged()} SELECT source_key, count(*) AS n_values, count(*) FILTER (WHERE evidence = 'limit') AS n_cut_by_limit, count(*) FILTER (WHERE evidence = 'context') AS n_cut_elsewhere,
      count(evidence) / count(*) AS cut_share, (SELECT string_agg(length || ' ' || unit, '|' ORDER BY length || ' ' || unit) FROM spikes WHERE spikes.source_key = judged.source_key) AS limits
      FROM judged GROUP BY source_key""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
