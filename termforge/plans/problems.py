"""Queries of the general data problems (heavy keys, rows that fail to parse) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termforge.operators import heavy_keys, raw_records
from termforge.session import durable, table

#: SQL of the live index, for the queries that need it.
LIVE_SQL = """
live AS (
  SELECT word, rid, CAST(sum(freq) AS BIGINT) AS freq FROM (
    SELECT lower(trim(word, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS word, rid, flush_id, max(freq) AS freq FROM postings
    WHERE word IS NOT NULL AND rid IS NOT NULL AND freq > 0
      AND rid NOT IN (SELECT rid FROM tombstones WHERE rid IS NOT NULL)
    GROUP BY ALL)
  GROUP BY ALL)"""


def p2_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys.word_stats(table(spark, sf_dir, "postings"), table(spark, sf_dir, "tombstones"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys.frequent_words(durable(p2_stats(spark, sf_dir)), 0.028)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records.split(table(spark, sf_dir, "raw_reviews"))[1].select("rec_id", "reason")


def p4_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records.split(table(spark, sf_dir, "raw_reviews"))[0]


#: One column of a line: quoted, with blanks around, or without any quote.
_COLUMN = r'[ \t\r\n]*"(?:[^"]|"")*"[ \t\r\n]*|[^",]*'
_WS = "' ' || chr(9) || chr(10) || chr(13)"
_VALUE = "CASE WHEN starts_with(trim({0}, {1}), '\"') THEN replace(substr(trim({0}, {1}), 2, length(trim({0}, {1})) - 2), '\"\"', '\"') ELSE trim({0}, {1}) END"


def _parsed_sql() -> str:
    """p (rec_id, reason, pid, h, s, t, n, d): the rules of p4 in regular expressions."""
    line = ", ".join(f"{_VALUE.format(f'c.{k}', _WS)} AS {k}" for k in ("pid", "h", "s", "t"))
    block = ", ".join(f"list_filter(lines, lambda x: split_part(x, ':', 1) = '{f}') AS {k}" for f, k in zip(raw_records.FIELDS, ("pid", "h", "s", "t"), strict=True))
    after = ", ".join(f"trim(substr({k}[1], strpos({k}[1], ':') + 1), {_WS}) AS {k}" for k in ("pid", "h", "s", "t"))
    return rf"""raw AS (SELECT rec_id, coalesce(layout, '') = 'line' AS line, record, record IS NULL OR trim(record, {_WS}) = '' AS empty FROM raw_reviews),
line0 AS (SELECT rec_id, regexp_full_match(record, '(?:{_COLUMN})(?:,(?:{_COLUMN}))*') AS quoted, regexp_replace(record, '"(?:[^"]|"")*"', '', 'g') AS bare, regexp_extract(record, '^({_COLUMN}),({_COLUMN}),({_COLUMN}),({_COLUMN})$', ['pid', 'h', 's', 't']) AS c FROM raw WHERE line AND NOT empty),
line1 AS (SELECT rec_id, CASE WHEN NOT quoted THEN 'quoting' WHEN length(bare) - length(replace(bare, ',', '')) <> 3 THEN 'field_count' END AS reason, {line} FROM line0),
block0 AS (SELECT rec_id, list_filter(string_split(record, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '') AS lines FROM raw WHERE NOT line AND NOT empty),
block1 AS (SELECT rec_id, len(list_filter(lines, lambda x: NOT contains(x, ':'))) > 0 AS bare, {block} FROM block0),
block2 AS (SELECT rec_id, CASE WHEN bare THEN 'no_separator' WHEN len(pid) <> 1 OR len(h) <> 1 OR len(s) <> 1 OR len(t) <> 1 THEN 'field_count' END AS reason, {after} FROM block1),
cut AS (SELECT * FROM line1 UNION ALL SELECT * FROM block2),
num AS (SELECT *, regexp_full_match(h, '[ \t]*[0-9]+[ \t]*/[ \t]*[0-9]+[ \t]*') AS shaped, ltrim(trim(split_part(h, '/', 1), {_WS}), '0') AS n0, ltrim(trim(split_part(h, '/', 2), {_WS}), '0') AS d0 FROM cut),
val AS (SELECT *, CASE WHEN length(n0) > 5 THEN 99999 WHEN n0 = '' THEN 0 ELSE coalesce(TRY_CAST(n0 AS INT), 0) END AS n, CASE WHEN length(d0) > 5 THEN 99999 WHEN d0 = '' THEN 0 ELSE coalesce(TRY_CAST(d0 AS INT), 0) END AS d FROM num),
p AS (SELECT rec_id, 'empty' AS reason, NULL AS pid, NULL AS s, NULL AS t, NULL AS n, NULL AS d FROM raw WHERE empty UNION ALL
SELECT rec_id, CASE WHEN reason IS NOT NULL THEN reason WHEN NOT shaped OR n > d OR d > {raw_records.MAX_DEN} THEN 'helpfulness' WHEN NOT regexp_full_match(s, '[1-5](\.0+)?') THEN 'score' WHEN regexp_matches(t, '[\x{{fffd}}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]') THEN 'text' END, pid, s, t, n, d FROM val)"""


def queries() -> dict:
    return {"p2_found": p2_found, "p2_stats": p2_stats, "p4_found": p4_found, "p4_valid": p4_valid}


def oracle_sql() -> dict[str, str]:
    stats = f"WITH {LIVE_SQL} SELECT word, CAST(count(*) AS BIGINT) AS reviews, CAST(sum(freq) AS BIGINT) AS mentions FROM live GROUP BY word"
    return {
        "p4_found": f"WITH {_parsed_sql()} SELECT rec_id, reason FROM p WHERE reason IS NOT NULL",
        "p4_valid": f"WITH {_parsed_sql()} SELECT rec_id, pid AS product_id, CAST(n AS INT) AS helpfulness_num, CAST(d AS INT) AS helpfulness_den, CAST(substr(s, 1, 1) AS INT) AS score, t AS text FROM p WHERE reason IS NULL",
        "p2_stats": stats,
        "p2_found": f"WITH {LIVE_SQL} SELECT word FROM live GROUP BY word HAVING count(*) >= 0.028 * (SELECT count(*) FROM live)",
    }
