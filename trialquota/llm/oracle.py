"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from trialquota.llm import decontam, quality

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def contamination_sql() -> str:
    words = (
        f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
items AS (SELECT item_id, {words} AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
  FROM (SELECT item_id, w, least(len(w), {decontam.WIDTH}) AS n, unnest(range(1, len(w) - least(len(w), {decontam.WIDTH}) + 2)) AS s
        FROM items WHERE len(w) > 0)),
runs AS (
  SELECT rid, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS MATERIALIZED (SELECT rid, s, r.n, item_id FROM runs r JOIN windows v ON r.win = v.win AND r.n = v.n),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM found) GROUP BY rid),
named AS (SELECT rid, list_sort(list_distinct(list(item_id::VARCHAR))) AS ids FROM found GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)"""


def quality_sql() -> str:
    measures = quality.MEASURES
    div = lambda expression: expression.replace(" DIV ", " // ")
    long = " UNION ALL ".join(
        f"SELECT lang, source, '{m.name}' AS measure, {div(m.value)} AS value FROM counts WHERE NOT base_failed" for m in measures
    )
    case = lambda field: "CASE measure " + " ".join(f"WHEN '{m.name}' THEN {getattr(m, field)}" for m in measures) + " END"

    def quartiles(groups: str) -> str:
        by = f"{groups}, " if groups else ""
        return (
            f"SELECT {by}measure, size, min(bin) FILTER (WHERE 4 * seen >= size) AS low, "
            f"min(bin) FILTER (WHERE 4 * seen >= 3 * size) AS high FROM "
            f"(SELECT {by}measure, bin, sum(n) OVER (PARTITION BY {by}measure) AS size, "
            f"sum(n) OVER (PARTITION BY {by}measure ORDER BY bin) AS seen FROM "
            f"(SELECT {by}measure, bin, count(*) AS n FROM bins GROUP BY {by}measure, bin)) GROUP BY {by}measure, size"
        )

    pick = lambda c: (
        f"CASE WHEN o.size >= {quality.MIN_GROUP} THEN o.{c} WHEN l.size >= {quality.MIN_GROUP} THEN l.{c} ELSE a.{c} END"
    )
    verdict = " AND ".join(
        f"coalesce(({div(m.value)}) - floor({m.noise} / sqrt(n_words)) <= (SELECT most FROM limits t WHERE t.measure = '{m.name}' "
        "AND t.lang IS NOT DISTINCT FROM c.lang AND t.source IS NOT DISTINCT FROM c.source), true)"
        + (
            f" AND coalesce(({div(m.value)}) + floor({m.noise} / sqrt(n_words)) >= (SELECT least FROM limits t WHERE t.measure = '{m.name}' "
            "AND t.lang IS NOT DISTINCT FROM c.lang AND t.source IS NOT DISTINCT FROM c.source), true)"
            if m.two_sided
            else ""
        )
        for m in measures
    )
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
windows AS MATERIALIZED (
  SELECT rid, s, array_to_string(list_slice(w, s, s + {quality.WINDOW - 1}), ' ') AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS s FROM docs WHERE len(w) >= {quality.WINDOW})),
repeats AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest(range(s, s + {quality.WINDOW})) AS p FROM
      (SELECT rid, s, count(*) OVER (PARTITION BY rid, win) AS c FROM windows) WHERE c > 1) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM
    (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{word}') GROUP BY rid),
measured AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    len(regexp_extract_all(t, '\p{{Lu}}'))::BIGINT AS n_capitals
  FROM docs LEFT JOIN repeats r USING (rid) LEFT JOIN lines USING (rid)),
counts AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
bins AS MATERIALIZED (
  SELECT lang, source, measure, (value >> greatest(length(format('{{:b}}', value)) - {quality.PRECISION}, 0))
    << greatest(length(format('{{:b}}', value)) - {quality.PRECISION}, 0) AS bin FROM ({long})),
limits AS MATERIALIZED (
  SELECT lang, source, measure, low - reach AS least, high + reach AS most FROM (
    SELECT lang, source, measure, low, high, {quality.REACH} * greatest(high - low, {case('spread')}) AS reach FROM (
      SELECT o.lang, o.source, o.measure, {pick('low')} AS low, {pick('high')} AS high
      FROM ({quartiles('lang, source')}) o
      LEFT JOIN ({quartiles('lang')}) l ON o.measure = l.measure AND o.lang IS NOT DISTINCT FROM l.lang
      LEFT JOIN ({quartiles('')}) a ON o.measure = a.measure)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE {verdict} END AS kept, n_lines, n_capitals
FROM counts c"""


def collocations_sql() -> str:
    """Every phrase counted whole, then scored, filtered and ranked as the collocation query defines."""
    from trialquota.llm import phrases

    low, high = phrases.CONTAINED_SHARE
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM p),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
        FROM w, (SELECT unnest(range(1, {phrases.LONGEST + 1})) AS k) ks WHERE len(ws) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM g GROUP BY lang, k, phrase),
cand AS MATERIALIZED (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= {phrases.SHORTEST} AND f >= {phrases.MIN_COUNT}),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, lf.f AS l, rf.f AS r,
         ((CAST({phrases.SCALE} AS HUGEINT) * c.a) // (lf.f + rf.f))::BIGINT AS score
  FROM (SELECT lang, phrase, a, ws, k, unnest(range(1, k)) AS j FROM cand) c
  JOIN f lf ON lf.lang = c.lang AND lf.phrase = array_to_string(list_slice(c.ws, 1, j), ' ')
  JOIN f rf ON rf.lang = c.lang AND rf.phrase = array_to_string(list_slice(c.ws, j + 1, c.k), ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM cuts) WHERE o = 1),
inner_ AS (
  SELECT lang, array_to_string(list_slice(ws, s, s + m - 1), ' ') AS phrase, max(a) AS outer_a
  FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS s
        FROM (SELECT lang, ws, a, k, unnest(range({phrases.SHORTEST}, k)) AS m FROM cand WHERE k > {phrases.SHORTEST}))
  GROUP BY 1, 2),
kept AS (
  SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.outer_a IS NULL OR i.outer_a * {low} < b.a * {high}),
ranked AS (
  SELECT k.*, t.n, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM kept k JOIN totals t ON t.lang = k.lang)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {phrases.TOP}
"""
