"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from raggedlake.llm import quality_rules as R

_SQL_MEASURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "mark_share": "n_stops / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
}


def quality_rules() -> str:
    measures = ", ".join(f"({e})::DOUBLE AS {m}" for m, e in _SQL_MEASURES.items())
    long = " UNION ALL ".join(f"SELECT g1, g2, '{m}' AS measure, {m} AS v, {floor}::DOUBLE AS least, {str(both).lower()} AS two FROM base WHERE NOT base_failed" for m, (_, floor, both) in R.MEASURES.items())

    def points(keys: str, name: str) -> str:
        by = f"{keys}, measure" if keys else "measure"
        value = f"CASE WHEN {{}} = 0 THEN 0.0::DOUBLE ELSE {R.LEAST_VALUE!r}::DOUBLE * pow({R.GAMMA!r}::DOUBLE, ({{}} - 1)::DOUBLE) * 2 / (1 + {R.GAMMA!r}::DOUBLE) END"
        at = lambda p: f"min(CASE WHEN upto >= greatest(ceil(n_docs * {p}::DOUBLE), 1) THEN b END)"
        low, mid = (value.format(at(p), at(p)) for p in (R.QUANTILE, 0.5))
        counted = f"SELECT {by}, b, sum(count(*)) OVER (PARTITION BY {by} ORDER BY b) AS upto, sum(count(*)) OVER (PARTITION BY {by}) AS n_docs FROM sketch GROUP BY {by}, b"
        return f"{name} AS (SELECT {by}, n_docs::DOUBLE AS n, {low} AS low, {mid} AS mid FROM ({counted}) GROUP BY {by}, n_docs)"

    def weighed(c: str) -> str:
        return f"(g.n * g.{c} + {R.WEIGHT} * ((l.n * l.{c} + {R.WEIGHT} * a.{c}) / (l.n + {R.WEIGHT}))) / (g.n + {R.WEIGHT})"

    limits = ", ".join(f"max(lo) FILTER (measure = '{m}') AS lo_{m}, max(hi) FILTER (measure = '{m}') AS hi_{m}" for m in R.MEASURES)
    inside = " AND ".join(f"coalesce({m} BETWEEN lo_{m} AND hi_{m}, false)" for m in R.MEASURES)
    return f"""
WITH w AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g1, coalesce('=' || source, '') AS g2, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), grams AS (
  SELECT doc_id, i, hash(x1, lead(x1, 1) OVER o, lead(x1, 2) OVER o, lead(x1, 3) OVER o) AS h1, hash(lead(x1, 4) OVER o, lead(x1, 5) OVER o, lead(x1, 6) OVER o, lead(x1, 7) OVER o) AS h2, n
  FROM (SELECT doc_id, unnest(ws) AS x1, unnest(range(len(ws))) AS i, len(ws) AS n FROM w) WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i FROM grams WHERE i <= n - 8 QUALIFY count(*) OVER (PARTITION BY doc_id, h1, h2) > 1
), inside AS (
  SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM twice, unnest(range(8)) u(j) GROUP BY 1
), counts AS (
  SELECT doc_id, g1, g2, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits, length(t) - length(regexp_replace(t, '[!?.,;:]', '', 'g')) AS n_stops,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM w
), base AS (
  SELECT *, {measures}, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM (SELECT * EXCLUDE (lines, n_repeat_words), len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM counts LEFT JOIN inside USING (doc_id))
), sketch AS (
  SELECT *, CASE WHEN v < {R.LEAST_VALUE!r}::DOUBLE THEN 0 ELSE ceil(ln(v / {R.LEAST_VALUE!r}::DOUBLE) / ln({R.GAMMA!r}::DOUBLE))::INT + 1 END AS b FROM ({long})
), {points("g1, g2", "fine")}, {points("g1", "wide")}, {points("", "whole")}, spread AS (
  SELECT g.g1, g.g2, measure, {weighed("mid")} AS mid, {weighed("low")} AS low FROM fine g JOIN wide l USING (g1, measure) JOIN whole a USING (measure)
), bounds AS (
  SELECT g1, g2, measure, mid + {R.REACH} * greatest(mid - low, least) AS hi, CASE WHEN two THEN mid - {R.REACH} * greatest(mid - low, least) ELSE -1.0 END AS lo
  FROM spread JOIN (SELECT DISTINCT measure, least, two FROM sketch) USING (measure)
), limits AS (SELECT g1, g2, {limits} FROM bounds GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept, {", ".join(R.MEASURES)}
FROM base LEFT JOIN limits USING (g1, g2)"""
