"""Queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm import distinctive, format_duplicates, near_duplicates, packing, splitting, suffix_counts, tokenizer
from termforge.llm.canonical import LABEL, NO_LETTER, NOT_BLANK, SECTION_END, WORD, word_runs
from termforge.plans.problems import LIVE_SQL
from termforge.session import stored, table


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "postings"), table(spark, sf_dir, "tombstones")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, words): each review once, with its words in order."""
    texts = table(spark, sf_dir, "reviews").where("review_id IS NOT NULL").select("review_id", "text").distinct()
    return texts.select("review_id", word_runs(F.col("text")).alias("words"))


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.distinctive_words(*_index(spark, sf_dir), best_first=True).select("rid", "word", "degree", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))


def p1_text_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of the words of each review text in their real order."""
    return distinctive.degrees_of_texts(_texts(spark, sf_dir), "review_id", "words")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = distinctive.distinctive_words(*_index(spark, sf_dir), min_freq=4)
    share = F.col("freq") * F.col("all_mentions") >= F.col("length") * F.col("mentions") * 100
    return scored.where((F.col("reviews") >= 2) & share).select("rid", "word")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_duplicates.copies(table(spark, sf_dir, "reviews"))


def p3_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_duplicates.collapse(table(spark, sf_dir, "reviews"))


def p5_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return suffix_counts.marked_words(suffix_counts.word_counts(*index), suffix_counts.live_reviews(*index))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_marks(spark, sf_dir).where("mark IS NOT NULL").select("word", "mark")


def p5_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and reviews of all runs of up to three words of the review texts."""
    return suffix_counts.ngram_counts(_texts(spark, sf_dir), "review_id", "words", 3)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicates.Similar(table(spark, sf_dir, "reviews"), 0.7).pairs()
    return pairs.select(F.col("a").alias("review_id_a"), F.col("b").alias("review_id_b"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.Similar(table(spark, sf_dir, "reviews"), 0.7).groups()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return tokenizer.decode(p7_ids(spark, sf_dir))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokenizer.token_counts(table(spark, sf_dir, "documents")), "doc_id", "tokens", 2048)


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(documents, over, split, gaps): documents placed, containers above capacity, documents split needlessly, documents not placed as a whole."""
    placed = stored(p8_containers(spark, sf_dir), "containers")
    over = placed.groupBy("container").agg(F.sum("tokens").alias("n")).agg(F.count_if(F.col("n") > 2048).alias("over"))
    docs = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("n"), F.max(F.col("start") + F.col("tokens")).alias("end"))
    docs = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") <= 2048) & (F.col("pieces") > 1)).alias("split"), F.count_if(F.col("n") != F.col("end")).alias("gaps"))
    return docs.join(F.broadcast(over)).select("documents", "over", "split", "gaps")  # one row each


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_documents(table(spark, sf_dir, "documents"))


def p9_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, put together from what each of its pieces adds, where it has pieces."""
    lists = p9_pieces(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "text"))).alias("p"))
    added = F.transform("p", lambda x, i: F.substring(x["text"], (F.coalesce(F.get("p", i - 1)["end"], F.lit(0)) - x["begin"] + 1).cast("int"), F.length(x["text"])))
    whole = lists.select("doc_id", F.array_join(added, "").alias("whole"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(whole, "doc_id", "left").select("doc_id", F.coalesce("whole", "text", F.lit("")).alias("text"))


def queries() -> dict:
    own = (p1_found, p1_scores, p1_text_degrees, p3_found, p3_collapsed, p5_found, p5_marks, p5_ngrams, p6_found, p6_groups, p7_ids, p7_decoded, p8_containers, p8_checks, p9_pieces, p9_rejoined)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    texts = f"""WITH t AS (SELECT DISTINCT review_id, text, lower(text) AS x FROM reviews WHERE review_id IS NOT NULL),
s AS (SELECT review_id, x, list_filter(regexp_split_to_array(x, '{SECTION_END}'), lambda y: regexp_matches(y, '{NOT_BLANK}')) AS s FROM t),
k AS (SELECT review_id, x, CASE WHEN contains(x, ':') AND len(s) > 1 AND len(list_filter(s, lambda y: NOT regexp_matches(y, '{LABEL}'))) = 0 THEN array_to_string(list_sort(list_transform(s, lambda y: regexp_replace(y, '{NO_LETTER}', '', 'g'))), '') ELSE regexp_replace(x, '{NO_LETTER}', '', 'g') END AS k FROM s),
g AS (SELECT k, min(review_id) AS a, count(*) AS copies FROM k WHERE k <> '' GROUP BY k),
w AS (SELECT DISTINCT review_id, unnest(regexp_extract_all(x, '{WORD}')) AS word FROM t WHERE x IS NOT NULL),
n AS (SELECT review_id, count(*) AS n FROM w GROUP BY review_id),
c AS (SELECT a.review_id AS a, b.review_id AS b, count(*) AS c FROM w AS a JOIN w AS b USING (word) WHERE a.review_id < b.review_id GROUP BY ALL)
"""
    counts = f"WITH {LIVE_SQL}, n AS (SELECT count(DISTINCT rid) AS n FROM live), c AS (SELECT word, CAST(count(*) AS BIGINT) AS reviews, CAST(sum(freq) AS BIGINT) AS mentions FROM live GROUP BY word), marked AS (SELECT word, mentions, reviews, CASE WHEN reviews <= 2 THEN 'rare' WHEN reviews >= 0.2 * (SELECT n FROM n) THEN 'common' END AS mark FROM c)"
    order = f"""WITH t AS (SELECT DISTINCT review_id, text FROM reviews WHERE review_id IS NOT NULL), l AS (SELECT review_id, regexp_extract_all(lower(text), '{WORD}') AS l FROM t), w AS (SELECT review_id, unnest(l) AS word, generate_subscripts(l, 1) AS at FROM l)"""
    edges = "e AS (SELECT a.{0}, a.word, count(DISTINCT b.word) AS degree FROM m AS a JOIN m AS b ON a.{0} = b.{0} AND b.at BETWEEN a.at - {1} AND a.at + {1} WHERE a.word <> b.word GROUP BY ALL)"
    near = distinctive.WINDOW - 1
    scores = f"""WITH {LIVE_SQL}, l AS (SELECT rid, sum(freq) AS length, count(*) AS n FROM live GROUP BY rid), c AS (SELECT word, count(*) AS reviews FROM live GROUP BY word),
x AS (SELECT rid, word, CASE WHEN length > {distinctive.SCALE} * n THEN greatest(1, CAST(floor(freq * (CAST({distinctive.SCALE} * n AS DOUBLE) / CAST(length AS DOUBLE))) AS BIGINT)) ELSE freq END AS f, CAST((CAST('0x' || substr(md5(word), 1, 5) AS BIGINT) + (rid % {distinctive.PHASES} + {distinctive.PHASES}) % {distinctive.PHASES} * 40503) % {distinctive.PHASES} AS DOUBLE) / CAST({distinctive.PHASES} AS DOUBLE) AS u FROM live JOIN l USING (rid)),
m AS (SELECT rid, word, row_number() OVER (PARTITION BY rid ORDER BY (k + u) / f, word) AS at FROM (SELECT rid, word, f, u, unnest(range(f)) AS k FROM x)), {edges.format('rid', near)}
SELECT rid, word, coalesce(degree, 0) AS degree, floor(coalesce(degree, 0) * ln(1 + (SELECT count(*) FROM l) / reviews) * 1e6 + 0.5) / 1e6 AS score FROM live JOIN c USING (word) LEFT JOIN e USING (rid, word)"""
    grams = " UNION ALL ".join(f"SELECT {n} AS n, w1, {'w2' if n > 1 else 'NULL AS w2'}, {'w3' if n > 2 else 'NULL AS w3'}, review_id FROM g WHERE w{n} IS NOT NULL" for n in (1, 2, 3))
    return {
        "p1_scores": scores,
        "p1_text_degrees": order + ", m AS (FROM w), " + edges.format("review_id", near) + ", f AS (SELECT review_id, word, count(*) AS freq FROM w GROUP BY ALL) SELECT review_id, word, freq, coalesce(degree, 0) AS degree FROM f LEFT JOIN e USING (review_id, word)",
        "p5_ngrams": order + f", g AS (SELECT review_id, word AS w1, lead(word, 1) OVER s AS w2, lead(word, 2) OVER s AS w3 FROM w WINDOW s AS (PARTITION BY review_id ORDER BY w.at)), a AS ({grams}) SELECT CAST(n AS INT) AS n, w1, w2, w3, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT review_id) AS BIGINT) AS records FROM a GROUP BY n, w1, w2, w3",
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p8_checks": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS split, CAST(0 AS BIGINT) AS gaps FROM documents WHERE text <> ''",
        "p9_rejoined": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p1_found": f"WITH {LIVE_SQL}, l AS (SELECT rid, sum(freq) AS length FROM live GROUP BY rid), c AS (SELECT word, count(*) AS reviews, sum(freq) AS mentions FROM live GROUP BY word) SELECT rid, word FROM live JOIN l USING (rid) JOIN c USING (word) WHERE freq >= 4 AND reviews >= 2 AND freq * (SELECT sum(freq) FROM live) >= 100 * length * mentions",
        "p3_found": texts + "SELECT a AS review_id_a, review_id AS review_id_b FROM k JOIN g USING (k) WHERE review_id <> a",
        "p3_collapsed": texts + "SELECT a AS review_id, copies FROM g UNION ALL SELECT review_id, CAST(1 AS BIGINT) FROM k WHERE coalesce(k, '') = ''",
        "p6_found": texts + "SELECT a AS review_id_a, b AS review_id_b FROM c JOIN n AS x ON x.review_id = a JOIN n AS y ON y.review_id = b JOIN k AS i ON i.review_id = a JOIN k AS j ON j.review_id = b WHERE c * 17 >= (x.n + y.n) * 7 AND i.k <> j.k",
        "p6_groups": texts.replace("WITH t", "WITH RECURSIVE t", 1) + """, j AS (SELECT a, b FROM c JOIN n AS x ON x.review_id = a JOIN n AS y ON y.review_id = b WHERE c * 17 >= (x.n + y.n) * 7), h AS (SELECT a, b FROM j UNION SELECT b, a FROM j),
r AS (SELECT review_id AS id, review_id AS root FROM n UNION SELECT h.b, r.root FROM r JOIN h ON h.a = r.id), q AS (SELECT review_id AS id, string_agg(word, ' ' ORDER BY word) AS words FROM w GROUP BY review_id)
SELECT q.id, min(q.id) OVER (PARTITION BY words) AS class, g.grp FROM q JOIN (SELECT id, min(root) AS grp FROM r GROUP BY id) AS g USING (id)""",
        "p5_marks": counts + " SELECT word, mentions, reviews, mark FROM marked",
        "p5_found": counts + " SELECT word, mark FROM marked WHERE mark IS NOT NULL",
    }
