"""The training-data queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import canonical, hdlang, mixing, neardup, packing, termcount, tokens, topn
from tidemark.runtime import spread, table

TOP = 50
STORY_WIDTH, STORY_SIMILARITY = 3, 0.6


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The gazetteer city each free-typed city means, or -1."""
    docs = table(spark, sf, "docs").select("rec_id", "city").where(F.col("city").rlike("\\S"))
    cities = table(spark, sf, "cities")
    typed = docs.join(cities.select("city"), "city", "left_anti")
    return canonical.map_column(typed, "city", cities, "city_id", "city", "country").select("rec_id", "city_id").distinct()


def p1_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Of these, the values that are a city but for capitals and blanks around."""
    cities = table(spark, sf, "cities").select(F.lower("city").alias("low"))
    plain = table(spark, sf, "docs").select("rec_id", F.lower(F.trim("city")).alias("low")).join(cities, "low", "left_semi")
    return p1_found(spark, sf).join(plain, "rec_id", "left_semi")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 best distinct stories of every query."""
    best = topn.best_scores(table(spark, sf, "doc_scores"), "query_id", "doc_id", "score")
    return topn.top_n(best, ["query_id"], [topn.Desc(F.col("score")), F.col("doc_id")], TOP).select("query_id", "rank_no", "doc_id")


def _term_pairs(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "docs").select("doc_id", F.explode("terms_in_doc").alias("t")).select(F.col("t.term").alias("term"), F.col("doc_id").alias("record"), F.col("t.tf").alias("tf"))
    return stored.unionByName(table(spark, sf, "postings").select("term", F.col("doc_id").alias("record"), "tf"))


def p4_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences, stories and mark of every distinct term."""
    stories = table(spark, sf, "docs").select("doc_id").distinct().count()
    return termcount.mark_terms(termcount.term_frequencies(_term_pairs(spark, sf)), stories)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms too rare or too common."""
    return p4_terms(spark, sf).where("mark is not null").select("term_key", "mark")


def _stories(spark: SparkSession, sf: str) -> DataFrame:
    titles = table(spark, sf, "docs").select("doc_id", "title", F.lit(None).cast("string").alias("text"))
    texts = table(spark, sf, "doc_text").where(F.col("text").rlike("\\S")).select("doc_id", F.lit(None).cast("string").alias("title"), "text")
    # Titles and texts meet in one exchange; equal rows collapse before it.
    both = titles.unionByName(texts).where("doc_id is not null").groupBy("doc_id").agg(F.max("title").alias("title"), F.max("text").alias("text"))
    return both.where("text is not null").select("doc_id", F.concat_ws(" ", F.coalesce("title", F.lit("")), "text").alias("story"))


def _similar(spark: SparkSession, sf: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(_stories(spark, sf), "doc_id", "story", STORY_WIDTH, STORY_SIMILARITY)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of stories that are largely the same."""
    return _similar(spark, sf).pairs().select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")).distinct()


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The group of every story, and how many other texts its own is linked to."""
    return _similar(spark, sf).groups().select(F.col("id").alias("doc_id"), "group_id", "n_links")


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_sizes(spread(table(spark, sf, "documents").select("doc_id", "source", "text")), "text").drop("text")


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Containers of each capacity, what they hold and their unused space."""
    return packing.pack(_sized(spark, sf), "doc_id", "n_tokens", table(spark, sf, "pack_specs"))


def p6_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens and unused share per capacity."""
    c = p6_containers(spark, sf)
    return c.groupBy("spec_id", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("used"), F.sum("unused").alias("unused"), (F.sum("unused") / F.sum("capacity")).alias("unused_share"))


def p6_placed(spark: SparkSession, sf: str) -> DataFrame:
    """For each capacity: the documents placed, and the containers and documents that break a rule."""
    c = p6_containers(spark, sf)
    bad = lambda x: F.sum(x.cast("int")).cast("bigint")
    boxes = c.groupBy("spec_id").agg(bad((F.col("used") > F.col("capacity")) | (F.col("used") + F.col("unused") != F.col("capacity")) | (F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x["n_tokens"]) != F.col("used"))).alias("n_overfull"))
    pieces = c.select("spec_id", "capacity", F.explode("items").alias("x")).groupBy("spec_id", "capacity", F.col("x.item").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("x.n_tokens").alias("size"))
    docs = pieces.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_documents"), bad(F.col("n") != F.ceil(F.col("size") / F.col("capacity"))).alias("n_divided"))
    return docs.join(boxes, "spec_id").select("spec_id", "n_documents", "n_divided", "n_overfull")


def _mixture(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    # No source that has documents is passed over, at any size.
    return mixing.mix_and_plan(_sized(spark, sf), "doc_id", "source", "n_tokens", table(spark, sf, "mix_targets"), too_small=0.0)


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The documents chosen for the mixture, in training order."""
    return _mixture(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share of all tokens each source really reached, and whether it was passed over when the total was set."""
    mixed, planned = _mixture(spark, sf)
    return mixing.shares(mixed, "source", table(spark, sf, "mix_targets"), planned)


def p7_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each source kept to its repeats, and whether it had to be passed over."""
    return p7_shares(spark, sf).select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("kept"), "passed_over")


def p8_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Language and confidence of every text, or of each of its stretches."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    prototypes = hdlang.train(docs, "text", "lang")
    found = hdlang.detect(spread(docs.withColumnRenamed("lang", "label")), ["doc_id", "label"], "text", prototypes)
    return found.select("doc_id", "label", "seg_no", "lang", "confidence", "n_sentences", "start", "stop")


def p8_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the stretches of every text with letters are numbered from 1 without a gap, or one with 0, and do not overlap."""
    s = p8_segments(spark, sf).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seg_no", "start", "stop"))).alias("s"))
    numbers = F.transform("s", lambda x: x["seg_no"])
    right = (numbers == F.array(F.lit(0))) | ((F.size("s") > 1) & (numbers == F.sequence(F.lit(1), F.size("s"))))
    apart = F.forall(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (F.get("s", i)["start"] <= F.get("s", i)["stop"]) & ((i == 0) | (F.get("s", F.greatest(i - 1, F.lit(0)))["stop"] <= F.get("s", i)["start"])))
    return s.select("doc_id", (right & apart).alias("numbered"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of texts whose label is missing or wrong, and of all stretches of mixed texts."""
    s = p8_segments(spark, sf)
    right = F.coalesce(hdlang.label_language(F.col("label")) == F.col("lang"), F.lit(False))
    return s.where(((F.col("seg_no") > 0) | ~right) & (F.col("lang") != hdlang.UNDETERMINED)).select("doc_id", "seg_no", "lang").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_exact, p3_found, p4_found, p4_terms, p5_found, p5_groups, p6_containers, p6_summary, p6_placed, p7_mixture, p7_shares, p7_kept, p8_found, p8_segments, p8_numbered)
}

_TERMS = r"""
WITH raw AS (
  SELECT doc_id, t.term AS term, t.tf AS tf FROM (SELECT doc_id, unnest(terms_in_doc) AS t FROM docs)
  UNION ALL SELECT doc_id, term, tf FROM postings),
clean AS (SELECT trim(term) AS t, doc_id, CASE WHEN tf > 0 THEN tf ELSE 1 END AS tf FROM raw WHERE trim(term) <> '' AND doc_id IS NOT NULL),
spelt AS (
  SELECT lower(t) AS term_key, doc_id, max(tf) AS tf,
    CASE WHEN t = lower(t) THEN 0 WHEN t = upper(t) THEN 1 WHEN t[1] = upper(t[1]) AND t[2:] = lower(t[2:]) THEN 2 ELSE 3 END AS form
  FROM clean GROUP BY ALL),
freq AS (
  SELECT term_key, CAST(sum(tf) AS BIGINT) AS occurrences, CAST(count(DISTINCT doc_id) AS BIGINT) AS records FROM spelt GROUP BY term_key),
marked AS (
  SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.155e0 * (SELECT count(DISTINCT doc_id) FROM docs) THEN 'common' END AS mark FROM freq)
"""

_PAIRS = r"""
WITH {} titles AS (SELECT doc_id, max(title) AS title FROM docs GROUP BY doc_id),
texts AS (SELECT doc_id, max(text) AS text FROM doc_text WHERE regexp_matches(text, '\S') GROUP BY doc_id),
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || text), '[\p{{L}}\p{{N}}]+') AS w FROM texts LEFT JOIN titles USING (doc_id)),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS sh FROM w WHERE len(w) >= 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT doc_a, doc_b FROM p JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE c >= 0.6e0 * (x.n + y.n - c)),
e AS (SELECT doc_a AS a, doc_b AS b FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs),
sig AS (SELECT doc_id, md5(string_agg(sh, '|' ORDER BY sh)) AS c FROM s GROUP BY doc_id),
reach(origin, node) AS (SELECT doc_id, doc_id FROM n{})
"""

ORACLE: dict[str, str] = {
    "p3_found": """
SELECT query_id, CAST(rank_no AS INTEGER) AS rank_no, doc_id FROM (
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank_no FROM (
    SELECT query_id, doc_id, max(score) AS score FROM doc_scores WHERE score IS NOT NULL AND isfinite(score) GROUP BY query_id, doc_id))
WHERE rank_no <= 50""",
    "p4_terms": _TERMS + "SELECT term_key, occurrences, records, mark FROM marked",
    "p4_found": _TERMS + "SELECT term_key, mark FROM marked WHERE mark IS NOT NULL",
    "p5_found": _PAIRS.format("", "") + "SELECT doc_a, doc_b FROM pairs",
    "p5_groups": _PAIRS.format("RECURSIVE", " UNION SELECT origin, b FROM reach JOIN e ON a = node") + r"""
SELECT n.doc_id, g.group_id, coalesce(n_links, 0) AS n_links FROM n
JOIN (SELECT origin AS doc_id, min(node) AS group_id FROM reach GROUP BY origin) g USING (doc_id)
LEFT JOIN (SELECT e.a AS doc_id, count(DISTINCT y.c) AS n_links FROM e JOIN sig x ON x.doc_id = e.a JOIN sig y ON y.doc_id = e.b WHERE x.c <> y.c GROUP BY e.a) l USING (doc_id)""",
    "p1_exact": """
SELECT rec_id, city_id FROM docs d JOIN cities c ON lower(trim(d.city)) = lower(c.city) WHERE d.city NOT IN (SELECT city FROM cities)""",
    "p6_placed": r"SELECT spec_id, (SELECT count(*) FROM documents WHERE regexp_matches(text, '\S')) AS n_documents, CAST(0 AS BIGINT) AS n_divided, CAST(0 AS BIGINT) AS n_overfull FROM pack_specs",
    "p7_kept": r"SELECT source, true AS kept, source NOT IN (SELECT source FROM documents WHERE source IS NOT NULL AND regexp_matches(text, '\S')) AS passed_over FROM mix_targets",
    "p8_numbered": r"SELECT doc_id, true AS numbered FROM documents WHERE regexp_matches(text, '\p{L}')",
}
