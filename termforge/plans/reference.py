"""Queries of the index engine over the documents table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termforge.functions import codec, tokens
from termforge.index.reader import IndexReader
from termforge.index.writer import LogMergeWriter, SimpleMergeWriter
from termforge.operators import layout, postings
from termforge.operators.numbering import gap_decode, gap_encode
from termforge.plans import workload
from termforge.sources import reviews as source
from termforge.session import durable, sized, spread, table, work_path

#: Rows of a flush, and inserts after the first build, in the lifecycle queries; rids of a block in varint_roundtrip.
CAPACITY, INSERTS, RID_BLOCK = 20_000, 4, 512
#: Inserts and rows of a flush in the workload query.
STEPS, STEP_CAPACITY = 1, 8192


def reviews(spark: SparkSession, d: str) -> DataFrame:
    return source.from_documents(spread(table(spark, d, "documents")))


def rows(spark: SparkSession, d: str) -> DataFrame:
    return postings.build_postings(reviews(spark, d))


def words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_words").select("word_id", F.col("word").alias("term"))


def probes(spark: SparkSession, d: str) -> DataFrame:
    """Rids to look up: those of the metadata and tombstone tables, many of which no review has."""
    return table(spark, d, "review_meta").select("rid").unionByName(table(spark, d, "tombstones").select("rid")).where("rid IS NOT NULL").distinct()


_BUILT: dict[tuple[str, str, str], tuple[str, int]] = {}


def index(spark: SparkSession, d: str, kind: str) -> tuple[str, int]:
    """(folder, version before the last delete) of an index that went through first build, inserts and deletes; built once per session."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _BUILT:
        root = work_path(spark, f"index-{kind}")
        dealt = durable(source.batches(reviews(spark, d), INSERTS))
        # a fifth of all rows: the last but one insert completes the fourth flush, which merges everything
        capacity = postings.build_postings(dealt, unique=True).count() // 5 + 1 if kind == "log-cleared" else CAPACITY
        writer = SimpleMergeWriter(spark, root) if kind == "simple" else LogMergeWriter(spark, root, capacity)
        dead = table(spark, d, "tombstones")
        writer.construct(dealt.where("batch = 0").drop("batch"))
        for k in range(1, INSERTS + 1):
            writer.insert(dealt.where(F.col("batch") == k).drop("batch"))
            if kind in ("log-early", "log-cleared") and k == 2:
                writer.remove(dead)
        version = writer.catalog.versions()[-1]
        if kind != "log-cleared":
            writer.remove(dead)
        _BUILT[key] = (root, version)
    return _BUILT[key]


def reader(spark: SparkSession, d: str, kind: str = "simple", before_delete: bool = False) -> IndexReader:
    root, version = index(spark, d, kind)
    return IndexReader(spark, root, version if before_delete else None)


def index_compacted(spark: SparkSession, d: str) -> IndexReader:
    key = (spark.sparkContext.applicationId, d, "compacted")
    if key not in _BUILT:
        root = work_path(spark, "index-compacted")
        writer = SimpleMergeWriter(spark, root)
        dealt = durable(source.batches(reviews(spark, d), 1))
        writer.construct(dealt.where("batch = 0").drop("batch"))
        writer.insert(dealt.where("batch = 1").drop("batch"))
        writer.remove(table(spark, d, "tombstones"))
        writer.compact()
        _BUILT[key] = (root, 0)
    return IndexReader(spark, _BUILT[key][0])


def _found(spark: SparkSession, d: str, r: IndexReader) -> DataFrame:
    asked = words(spark, d)
    return r.terms(asked).join(sized(asked), "term").select("word_id", "term", "rid", "freq")


def _counted(spark: SparkSession, d: str, name: str) -> DataFrame:
    asked = words(spark, d)
    return asked.join(reader(spark, d).word_counts(asked), "term").select("word_id", "term", name)


def _meta(column: str) -> Callable:
    return lambda s, d: reader(s, d).lookup(probes(s, d)).select("rid", column)


def postings_nested(spark: SparkSession, d: str) -> DataFrame:
    n = postings.nested(rows(spark, d))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return n.select("term", "block", joined("rids").alias("rids"), joined("freqs").alias("freqs"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """(level, start, postings) of each segment of the log-merge index before deletes."""
    r = reader(spark, d, "log", True)
    parts = [r.segment_rows([s]).agg(F.count(F.lit(1)).alias("postings")).select(F.lit(s.level).cast("bigint").alias("level"), F.lit(s.start).cast("bigint").alias("start"), "postings") for s in r.manifest.segments if s.kind == "level"]
    out = spark.createDataFrame([], "level bigint, start bigint, postings bigint")
    for p in parts:
        out = out.unionByName(p)
    return out


def id_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    own = durable(rows(spark, d))
    dictionary = durable(postings.dictionary(own))
    return postings.with_terms(postings.with_ids(own, dictionary), dictionary)


def flushes(spark: SparkSession, d: str) -> DataFrame:
    return layout.flush_numbers(rows(spark, d), CAPACITY)


def logmerge_layout(spark: SparkSession, d: str) -> DataFrame:
    full = durable(flushes(spark, d).groupBy("flush").count().where(F.col("count") == CAPACITY).select("flush"))
    return full.select("flush", layout.level(F.col("flush"), F.lit(full.count()).cast("bigint")).alias("level"))


def varint_encode(spark: SparkSession, d: str) -> DataFrame:
    values = gap_encode(rows(spark, d)).select(F.explode(F.array("gap", "freq")).alias("value")).distinct()
    return values.select("value", F.hex(codec.varint_encode(F.col("value"))).alias("code"))


def varint_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Lists in blocks of RID_BLOCK rids, coded, decoded and summed up again."""
    blocked = rows(spark, d).withColumn("block", F.expr(f"rid div {RID_BLOCK}"))
    gap = F.col("rid") - F.lag("rid", 1, 0).over(Window.partitionBy("term", "block").orderBy("rid"))  # at most RID_BLOCK rows
    coded = blocked.select("term", "block", "rid", F.hex(codec.varint_encode(gap)).alias("code"))
    stream = coded.groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct("rid", "code"))).alias("c")).select("term", "block", F.unhex(F.array_join("c.code", "")).alias("stream"))
    rids = codec.varint_decode_sums("stream")
    return stream.select("term", "block", F.array_join(F.transform(rids, lambda x: x.cast("string")), " ").alias("rids"))


def _dump(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "dump")
    tagged = reviews(spark, d).withColumn("text", F.concat(F.col("rid").cast("string"), F.lit(": "), "text"))
    source.write_dump(tagged, path)
    return source.read_dump(spark, path)


def snap_build(spark: SparkSession, d: str) -> DataFrame:
    """Postings of an index built from dump files, one half with LF, the other with CRLF ends of lines."""
    r = durable(reviews(spark, d))
    half = (r.agg(F.max("rid")).first()[0] or 0) // 2
    writer = SimpleMergeWriter(spark, work_path(spark, "index-dump"))
    paths = work_path(spark, "dump"), work_path(spark, "dump")
    source.write_dump(r.where(F.col("rid") <= half), paths[0])
    source.write_dump(r.where(F.col("rid") > half), paths[1], "\r\n")
    writer.construct(paths[0])
    writer.insert(paths[1])
    return IndexReader(spark, writer.catalog.root).postings()


def snap_parse(spark: SparkSession, d: str) -> DataFrame:
    got = _dump(spark, d)
    return got.select(F.expr("cast(split_part(text, ':', 1) AS bigint)").alias("rid"), "product_id", *(F.col(c).cast("bigint").alias(c) for c in ("helpfulness_num", "helpfulness_den", "score")), F.trim(F.expr("substring(text, instr(text, ':') + 1)"), F.lit(" \t")).alias("text"))


def snap_malformed(spark: SparkSession, d: str) -> DataFrame:
    """Problems of the blocks of the raw table, written as a dump and read again."""
    path = work_path(spark, "dump")
    table(spark, d, "raw_reviews").where("layout = 'block' AND record IS NOT NULL").select(F.regexp_replace("record", "(\r?\n)([ \t]*\r?\n)+", "$1").alias("value")).write.option("lineSep", "\n\n").text(path)
    got = source.read_dump(spark, path)
    return got.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("records"))


def workload_steps(spark: SparkSession, d: str) -> DataFrame:
    """(strategy, step, reviews, segments) of the maintenance workload, from files: what doesn't depend on time."""
    files = workload.prepare(spark, d, STEPS)
    return workload.results(spark, workload.run(spark, *files, [], (STEP_CAPACITY,))).where("metric IN ('reviews', 'segments')").groupBy("strategy", "step").pivot("metric", ["reviews", "segments"]).agg(F.first("value").cast("bigint"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "tokens_sorted": lambda s, d: reviews(s, d).select("rid", F.array_join(tokens.sorted_tokens(F.col("text")), " ").alias("tokens")),
        "token_len_filter": lambda s, d: reviews(s, d).select("rid", F.size(tokens.raw_tokens(F.col("text"))).cast("bigint").alias("raw"), tokens.text_length(F.col("text")).alias("kept")),
        "review_length": lambda s, d: postings.build_meta(reviews(s, d)).select("rid", "review_length"),
        "vocab": lambda s, d: postings.vocabulary(rows(s, d)),
        "postings_build": rows,
        "postings_sorted": lambda s, d: rows(s, d).orderBy("term", "rid"),
        "postings_nested": postings_nested,
        "dict_encode": lambda s, d: postings.dictionary(rows(s, d)).select("term", "tid"),
        "id_encode": lambda s, d: postings.with_ids(rows(s, d), postings.dictionary(rows(s, d))),
        "id_roundtrip": id_roundtrip,
        "term_lookup": lambda s, d: reader(s, d, before_delete=True).term("the"),
        "term_lookup_segments": lambda s, d: _found(s, d, reader(s, d, before_delete=True)),
        "term_lookup_logmerge": lambda s, d: _found(s, d, reader(s, d, "log-early")),
        "term_lookup_after_delete": lambda s, d: _found(s, d, reader(s, d)),
        "term_mentions": lambda s, d: _counted(s, d, "mentions"),
        "term_doc_count": lambda s, d: _counted(s, d, "reviews"),
        "term_with_meta": lambda s, d: reader(s, d).with_meta("the"),
        "meta_product_id": _meta("product_id"),
        "meta_score": _meta("score"),
        "meta_help_num": _meta("helpfulness_num"),
        "meta_help_den": _meta("helpfulness_den"),
        "meta_length": _meta("review_length"),
        "meta_live": lambda s, d: reader(s, d).meta(),
        "total_reviews": lambda s, d: reader(s, d).total_reviews(),
        "total_tokens": lambda s, d: reader(s, d).total_tokens(),
        "total_raw_tokens": lambda s, d: s.createDataFrame([(reader(s, d, before_delete=True).raw_tokens(),)], "tokens bigint"),
        "reviews_indexed": lambda s, d: s.createDataFrame([(reader(s, d).reviews_indexed(),)], "reviews bigint"),
        "delete_append": lambda s, d: reader(s, d).tombstones(),
        "merge_all": lambda s, d: index_compacted(s, d).segment_rows(),
        "meta_compacted": lambda s, d: index_compacted(s, d).meta(),
        "meta_cleared": lambda s, d: reader(s, d, "log-cleared").meta(),
        "merge_partial": segments,
        "logmerge_flush": flushes,
        "logmerge_layout": logmerge_layout,
        "logmerge_segment_count": lambda s, d: s.createDataFrame([(reader(s, d, "log", True).segment_count(),)], "segments bigint"),
        "gap_encode": lambda s, d: gap_encode(rows(s, d)).select("term", "rid", "gap"),
        "gap_roundtrip": lambda s, d: gap_decode(gap_encode(rows(s, d)).drop("rid")),
        "varint_encode": varint_encode,
        "varint_roundtrip": varint_roundtrip,
        "postings_bytes": lambda s, d: postings.encoded_bytes(rows(s, d)),
        "dict_blocks": lambda s, d: postings.dictionary(rows(s, d)).select("term", "block", "pos"),
        "front_code": lambda s, d: postings.front_coded(postings.dictionary(rows(s, d))),
        "front_code_roundtrip": lambda s, d: postings.front_decoded(postings.front_coded(postings.dictionary(rows(s, d)))),
        "dict_pointers": lambda s, d: postings.pointers(rows(s, d)),
        "snap_parse": snap_parse,
        "snap_malformed": snap_malformed,
        "snap_build": snap_build,
        "workload_steps": workload_steps,
    }


def oracle_sql() -> dict[str, str]:
    sep = tokens.TOKEN_SEP
    base = f"""WITH rev AS (SELECT doc_id + 1 AS rid, concat('P', lpad(CAST(doc_id % 997 AS VARCHAR), 9, '0')) AS product_id, doc_id % (coalesce(n_chars, 0) % 20 + 1) AS helpfulness_num, coalesce(n_chars, 0) % 20 AS helpfulness_den, coalesce(n_chars, 0) % 5 + 1 AS score, coalesce(text, '') AS text FROM documents),
toks AS (SELECT rid, list_transform(list_filter(regexp_split_to_array(text, '{sep}'), lambda x: x <> ''), lambda x: lower(x)) AS raw FROM rev),
kept AS (SELECT rid, list_filter(raw, lambda x: length(x) <= {tokens.MAX_TERM}) AS kept FROM toks),
post AS (SELECT term, rid, CAST(count(*) AS BIGINT) AS freq FROM (SELECT rid, unnest(kept) AS term FROM kept) GROUP BY term, rid),
meta AS (SELECT rid, product_id, score, helpfulness_num, helpfulness_den, CAST(len(kept) AS BIGINT) AS review_length FROM rev JOIN kept USING (rid)),
dead AS (SELECT DISTINCT rid FROM tombstones WHERE rid BETWEEN 1 AND (SELECT max(rid) FROM rev)),
live AS (SELECT * FROM post WHERE rid NOT IN (SELECT rid FROM dead)),
live_meta AS (SELECT * FROM meta WHERE rid NOT IN (SELECT rid FROM dead)),
asked AS (SELECT word_id, word AS term FROM query_words),
probe AS (SELECT DISTINCT rid FROM (SELECT rid FROM review_meta UNION ALL SELECT rid FROM tombstones) WHERE rid IS NOT NULL),
dict AS (SELECT term, CAST(row_number() OVER (ORDER BY term) AS BIGINT) AS tid FROM (SELECT DISTINCT term FROM post)),
blocks AS (SELECT term, (tid - 1) // {codec.BLOCK_TERMS} AS block, (tid - 1) % {codec.BLOCK_TERMS} AS pos FROM dict),
front0 AS (SELECT term, block, pos, first_value(term) OVER (PARTITION BY block ORDER BY pos) AS head FROM blocks),
front AS (SELECT term, block, pos, CAST(len(list_filter(range(1, least(length(term), length(head)) + 1), lambda i: substr(term, 1, i) = substr(head, 1, i))) AS BIGINT) AS prefix_len FROM front0),
coded AS (SELECT *, CASE WHEN pos = 0 THEN term ELSE substr(term, prefix_len + 1) END AS suffix FROM front),
gap AS (SELECT term, rid, freq, rid - lag(rid, 1, 0) OVER (PARTITION BY term ORDER BY rid) AS gap FROM post),
bytes AS (SELECT term, CAST(sum(CASE WHEN gap <= 63 THEN 1 WHEN gap <= 16383 THEN 2 WHEN gap <= 4194303 THEN 3 ELSE 4 END) AS BIGINT) AS gap_bytes, CAST(sum(CASE WHEN freq <= 63 THEN 1 WHEN freq <= 16383 THEN 2 WHEN freq <= 4194303 THEN 3 ELSE 4 END) AS BIGINT) AS freq_bytes FROM gap GROUP BY term),
flushed AS (SELECT term, rid, freq, CAST((row_number() OVER (ORDER BY rid, term) - 1) // {CAPACITY} AS BIGINT) AS flush FROM post),
full_flush AS (SELECT flush FROM flushed GROUP BY flush HAVING count(*) = {CAPACITY}),
n AS (SELECT count(*) AS n FROM full_flush),
levels AS (SELECT flush, CAST(length(bin(xor(flush, n))) - 1 AS BIGINT) AS level FROM full_flush, n)
"""
    lookup = lambda c: base + f"SELECT rid, {c if c == 'product_id' else f'coalesce({c}, -1)'} AS {c} FROM probe LEFT JOIN (SELECT * FROM live_meta WHERE rid > 0) USING (rid)"
    found = lambda t: base + f"SELECT word_id, term, rid, freq FROM {t} JOIN asked USING (term)"
    counted = lambda what, name: base + f"SELECT word_id, term, CAST(coalesce({what}, 0) AS BIGINT) AS {name} FROM asked LEFT JOIN live USING (term) GROUP BY word_id, term"
    return {
        "tokens_sorted": base + "SELECT rid, array_to_string(list_sort(raw), ' ') AS tokens FROM toks",
        "token_len_filter": base + "SELECT rid, CAST(len(raw) AS BIGINT) AS raw, CAST(len(kept) AS BIGINT) AS kept FROM toks JOIN kept USING (rid)",
        "review_length": base + "SELECT rid, review_length FROM meta",
        "vocab": base + "SELECT DISTINCT term FROM post",
        "postings_build": base + "SELECT term, rid, freq FROM post",
        "postings_sorted": base + "SELECT term, rid, freq FROM post ORDER BY term, rid",
        "postings_nested": base + f"SELECT term, rid // {postings.NESTED_RIDS} AS block, string_agg(CAST(rid AS VARCHAR), ' ' ORDER BY rid) AS rids, string_agg(CAST(freq AS VARCHAR), ' ' ORDER BY rid) AS freqs FROM post GROUP BY ALL",
        "dict_encode": base + "SELECT term, tid FROM dict",
        "id_encode": base + "SELECT tid, rid, freq FROM post JOIN dict USING (term)",
        "id_roundtrip": base + "SELECT term, rid, freq FROM post",
        "term_lookup": base + "SELECT rid, freq FROM post WHERE term = 'the' ORDER BY rid",
        "term_lookup_segments": found("post"),
        "term_lookup_logmerge": found("live"),
        "term_lookup_after_delete": found("live"),
        "term_mentions": counted("sum(freq)", "mentions"),
        "term_doc_count": counted("count(rid)", "reviews"),
        "term_with_meta": base + "SELECT rid, freq, product_id, score, helpfulness_num, helpfulness_den, review_length FROM live JOIN live_meta USING (rid) WHERE term = 'the'",
        "meta_product_id": lookup("product_id"),
        "meta_score": lookup("score"),
        "meta_help_num": lookup("helpfulness_num"),
        "meta_help_den": lookup("helpfulness_den"),
        "meta_length": lookup("review_length"),
        "meta_live": base + "SELECT * FROM live_meta",
        "total_reviews": base + "SELECT count(*) AS reviews FROM live_meta",
        "total_tokens": base + "SELECT CAST(sum(review_length) AS BIGINT) AS tokens FROM live_meta",
        "total_raw_tokens": base + "SELECT CAST(sum(len(raw)) AS BIGINT) AS tokens FROM toks",
        "meta_compacted": base + "SELECT * FROM live_meta",
        # deleted after the second insert, when reviews up to there were known
        "meta_cleared": base + f", cut AS (SELECT max(rid) FILTER (WHERE rid <= n * 2 // 5 OR (rid - n * 2 // 5 - 1) * {INSERTS} // (n - n * 2 // 5) + 1 <= 2) AS upto FROM rev, (SELECT max(rid) AS n FROM rev)) SELECT * FROM meta WHERE rid NOT IN (SELECT rid FROM dead WHERE rid <= (SELECT upto FROM cut))",
        "snap_build": base + "SELECT term, rid, freq FROM post",
        "snap_malformed": f"WITH l AS (SELECT list_filter(regexp_split_to_array(record, '\r\n|\n|\r'), lambda x: trim(x, ' ' || chr(9)) <> '') AS lines FROM raw_reviews WHERE layout = 'block' AND record IS NOT NULL), f AS (SELECT lines, {', '.join(f"list_filter(lines, lambda x: starts_with(x, '{name}:')) AS f{k}" for k, name in enumerate(source.FIELDS))} FROM l WHERE len(lines) > 0), v AS (SELECT len(list_filter(lines, lambda x: NOT contains(x, ':'))) > 0 AS bare, {', '.join(f"CASE WHEN len(f{k}) = 1 THEN trim(substr(f{k}[1], {len(name) + 2}), ' ' || chr(9) || chr(10) || chr(13)) END AS v{k}" for k, name in enumerate(source.FIELDS))} FROM f), n AS (SELECT *, coalesce(regexp_full_match(trim(split_part(v1, '/', 1), ' ' || chr(9)), '-?[0-9]{{1,9}}'), false) AND coalesce(regexp_full_match(trim(split_part(v1, '/', 2), ' ' || chr(9)), '-?[0-9]{{1,9}}'), false) AS help, coalesce(regexp_full_match(trim(split_part(v2, '.', 1), ' ' || chr(9)), '-?[0-9]{{1,9}}'), false) AS score FROM v) SELECT CASE WHEN bare THEN 'line' WHEN v0 IS NULL THEN '{source.FIELDS[0]}' WHEN NOT help THEN '{source.FIELDS[1]}' WHEN NOT score THEN '{source.FIELDS[2]}' WHEN v3 IS NULL THEN '{source.FIELDS[3]}' ELSE 'none' END AS problem, count(*) AS records FROM n GROUP BY ALL",
        "workload_steps": base + f", b AS (SELECT rid, CASE WHEN rid <= n * 2 // 5 THEN 0 ELSE (rid - n * 2 // 5 - 1) * {STEPS} // (n - n * 2 // 5) + 1 END AS step FROM rev, (SELECT max(rid) AS n FROM rev)), c AS (SELECT step, max(rid) AS reviews FROM b GROUP BY step), p AS (SELECT step, (SELECT count(*) FROM post WHERE rid <= c.reviews) AS n, reviews FROM c) SELECT 'simple' AS strategy, CAST(step AS INT) AS step, CAST(reviews AS BIGINT) AS reviews, CAST(step + 1 AS BIGINT) AS segments FROM p UNION ALL SELECT 'log', CAST(step AS INT), CAST(reviews AS BIGINT), CAST(bit_count(n // {STEP_CAPACITY}) AS BIGINT) FROM p UNION ALL SELECT 'simple', {STEPS + 1}, max(reviews), 1 FROM p",
        "reviews_indexed": base + "SELECT max(rid) AS reviews FROM rev",
        "delete_append": base + "SELECT rid FROM dead",
        "merge_all": base + "SELECT term, rid, freq FROM live",
        "merge_partial": base + f"SELECT level, min(flush) AS start, CAST(count(*) * {CAPACITY} AS BIGINT) AS postings FROM levels GROUP BY level",
        "logmerge_flush": base + "SELECT term, rid, freq, flush FROM flushed",
        "logmerge_layout": base + "SELECT flush, level FROM levels",
        "logmerge_segment_count": base + "SELECT CAST(bit_count(n) AS BIGINT) AS segments FROM n",
        "gap_encode": base + "SELECT term, rid, gap FROM gap",
        "gap_roundtrip": base + "SELECT term, rid, freq FROM post",
        "varint_encode": base + "SELECT value, CASE WHEN value <= 63 THEN printf('%02X', value) WHEN value <= 16383 THEN printf('%04X', value + 16384) WHEN value <= 4194303 THEN printf('%06X', value + 8388608) ELSE printf('%08X', value + 3221225472) END AS code FROM (SELECT DISTINCT gap AS value FROM gap UNION SELECT DISTINCT freq FROM gap)",
        "varint_roundtrip": base + f"SELECT term, rid // {RID_BLOCK} AS block, string_agg(CAST(rid AS VARCHAR), ' ' ORDER BY rid) AS rids FROM post GROUP BY term, rid // {RID_BLOCK}",
        "postings_bytes": base + "SELECT term, gap_bytes, freq_bytes FROM bytes",
        "dict_blocks": base + "SELECT term, block, pos FROM blocks",
        "front_code": base + "SELECT term, block, pos, prefix_len, suffix FROM coded",
        "front_code_roundtrip": base + "SELECT block, pos, term FROM blocks",
        "dict_pointers": base + "SELECT term, block, pos, CAST(coalesce(sum(gap_bytes + freq_bytes) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS postings_ptr, gap_bytes + freq_bytes AS postings_len, CAST(first_value(before) OVER (PARTITION BY block ORDER BY pos) AS BIGINT) AS string_ptr FROM (SELECT *, coalesce(sum(length(suffix)) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM coded) JOIN bytes USING (term)",
        "snap_parse": base + "SELECT rid, product_id, helpfulness_num, helpfulness_den, score, trim(regexp_replace(text, '[\\r\\n]', ' ', 'g'), ' ' || chr(9)) AS text FROM rev",
    }
