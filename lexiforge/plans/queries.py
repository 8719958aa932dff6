"""Every query of the engine's own operators on the driver's tables, beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.operators import graph, measures, relational, sampling, sequences, tfidf, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: ASCII words in the SQL of several queries.
_WORDS = "string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"
_USES = f"uses AS (SELECT * FROM (SELECT doc_id, lang, source, unnest({_WORDS}) AS term FROM documents) WHERE term <> '')"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def uses(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return read(spark, sf, "documents").select(*keep, F.explode(T.tokens(F.col("text"))).alias("term"))


def dealt_uses(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, term) for each use, dealt by document: texts are exchanged, once, not their many terms."""
    docs = read(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")
    return docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))


# terms and retrieval


@query(f"""WITH {_USES}, c AS (SELECT doc_id, term, count(*) AS tf FROM uses GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM c GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM c),
r AS (SELECT doc_id, term, (1 + ln(tf)) * (1 + ln((n.n + 1) / (df + 1)::DOUBLE)) AS raw FROM c JOIN d USING (term), n),
w AS (SELECT doc_id, term, raw / sum(raw) OVER (PARTITION BY doc_id) AS weight FROM r)
SELECT doc_id, term, round(weight, 9) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM w) WHERE rank <= 3""")
def tfidf_top_terms(spark, sf):
    w = tfidf.tfidf(dealt_uses(spark, sf), "doc_id", "term").withColumn("weight", F.round("weight", 9))
    return tfidf.top_per_key(w, "doc_id", [F.desc("weight"), "term"], 3)


@query(f"""WITH {_USES}, c AS (SELECT doc_id, term, count(*) AS tf FROM uses GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM c GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM c),
r AS (SELECT doc_id, term, (1 + ln(tf)) * (1 + ln((n.n + 1) / (df + 1)::DOUBLE)) AS raw FROM c JOIN d USING (term), n),
w AS (SELECT doc_id, term, raw / sum(raw) OVER (PARTITION BY doc_id) AS weight FROM r)
SELECT term, doc_id, round(weight, 8) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY round(weight, 8) DESC, doc_id) AS k FROM w WHERE term IN ('the', 'la', 'der', 'que')) WHERE k <= 10""")
def term_lookup(spark, sf):
    """The ten documents a term weighs most in."""
    w = tfidf.tfidf(dealt_uses(spark, sf), "doc_id", "term").withColumn("weight", F.round("weight", 8))
    return tfidf.top_per_key(w.where(F.col("term").isin("the", "la", "der", "que")), "term", [F.desc("weight"), "doc_id"], 10).select("term", "doc_id", "weight")


@query(f"WITH {_USES} SELECT term, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, term) AS id FROM uses GROUP BY term ORDER BY n DESC, term LIMIT 500")
def token_vocabulary(spark, sf):
    top = relational.top_counts(uses(spark, sf), "term", 500)
    from pyspark.sql import Window

    return top.select("term", "n", F.row_number().over(Window.orderBy(F.desc("n"), "term")).alias("id"))


@query(f"""WITH {_USES}, f AS (SELECT term, min(doc_id) AS doc_id FROM uses GROUP BY term), fresh AS (SELECT doc_id, count(*) AS fresh FROM f GROUP BY doc_id),
u AS (SELECT doc_id, count(*) AS n FROM uses GROUP BY doc_id)
SELECT doc_id, sum(n) OVER (ORDER BY doc_id)::BIGINT AS total, sum(coalesce(fresh, 0)) OVER (ORDER BY doc_id)::BIGINT AS distinct_terms,
round(sum(n) OVER (ORDER BY doc_id)::DOUBLE / sum(coalesce(fresh, 0)) OVER (ORDER BY doc_id), 9) AS ratio FROM u LEFT JOIN fresh USING (doc_id)""")
def running_vocab(spark, sf):
    return sequences.running_vocabulary(uses(spark, sf, "doc_id"), "doc_id", "term").withColumn("ratio", F.round("ratio", 9))


@query("""WITH l AS (SELECT string_split(trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
k AS (SELECT row_number() OVER () AS id, w FROM l), e AS (SELECT id, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM k), x AS (SELECT * FROM e WHERE t <> ''),
c AS (SELECT t, count(*) AS c FROM x GROUP BY t), b AS (SELECT a.t AS a, b.t AS b, count(*) AS n FROM x a JOIN x b ON a.id = b.id AND b.i = a.i + 1 GROUP BY ALL HAVING count(*) >= 5)
SELECT a, b, n, round((n - 5)::DOUBLE / ca.c / cb.c * (SELECT sum(c) FROM c), 6) AS score FROM b JOIN c ca ON ca.t = a JOIN c cb ON cb.t = b""")
def phrase_score(spark, sf):
    lines = read(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(T.tokens(F.col("line")).alias("t"))
    return sequences.bigram_scores(lines, "t").withColumn("score", F.round("score", 6))


@query()
def join_phrases(spark, sf):
    """Documents with the word pairs joined that score over 100, the default of phrase learning."""
    lines = read(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    pairs = sequences.bigram_scores(lines, "t").where("score > 100")
    return sequences.join_pairs(lines, "doc_id", "t", pairs).select("doc_id", "joined")


@query(f"""WITH e AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM (SELECT doc_id, {_WORDS} AS w FROM documents)), x AS (SELECT * FROM e WHERE t <> ''),
p AS (SELECT t AS a, unnest([lead(t, 1) OVER (PARTITION BY doc_id ORDER BY i), lead(t, 2) OVER (PARTITION BY doc_id ORDER BY i)]) AS b FROM x)
SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 50""")
def word_cooccurrence(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return sequences.cooccurrence(docs, "doc_id", "t", 2).where("n >= 50")


@query("SELECT len(string_split(trim(p_name), ' '))::INTEGER AS words, count(*) AS n FROM part GROUP BY ALL")
def term_length_dist(spark, sf):
    return read(spark, sf, "part").groupBy(T.word_count(F.col("p_name")).alias("words")).agg(F.count("*").alias("n"))


@query(f"""WITH {_USES}, a AS (SELECT term, count(*) AS n FROM uses WHERE source < 'src5' GROUP BY term), b AS (SELECT term, count(*) AS n FROM uses WHERE source >= 'src5' GROUP BY term)
SELECT term, coalesce(a.n, 0)::BIGINT AS n_left, coalesce(b.n, 0)::BIGINT AS n_right, CASE WHEN b.n IS NULL THEN 'left' WHEN a.n IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b USING (term)""")
def set_compare(spark, sf):
    u = uses(spark, sf, "source")
    count = lambda rows: rows.groupBy("term").agg(F.count("*").alias("n"))
    return relational.set_compare(count(u.where("source < 'src5'")), count(u.where("source >= 'src5'")), "term")


@query(f"""WITH {_USES}, a AS (SELECT term, count(*) AS n FROM uses WHERE source < 'src5' GROUP BY term), b AS (SELECT term, count(*) AS n FROM uses WHERE source >= 'src5' GROUP BY term),
x AS (SELECT term, a.n AS l, b.n AS r FROM a JOIN b USING (term))
SELECT term, round(l / sum(l) OVER ()::DOUBLE + r / sum(r) OVER ()::DOUBLE, 9) AS score FROM x""")
def intersect_relative(spark, sf):
    return relational.relative_scores(set_compare(spark, sf)).select("term", F.round("score", 9).alias("score"))


@query("""WITH v AS (SELECT DISTINCT unnest(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')) AS term FROM benchmark),
u AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')) AS term FROM documents)
SELECT doc_id, count(*) AS n FROM u WHERE term <> '' AND term IN (SELECT term FROM v) GROUP BY doc_id""")
def vocab_semi(spark, sf):
    vocabulary = read(spark, sf, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    return uses(spark, sf, "doc_id").join(vocabulary, "term", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))


# look-ups and joins


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def author_topk(spark, sf):
    return relational.top_counts(read(spark, sf, "orders"), "o_custkey", 10)


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def dup_having(spark, sf):
    return relational.repeated(read(spark, sf, "documents"), "text")


@query("SELECT source, count(*) AS n FROM documents WHERE source LIKE 'src1%' GROUP BY source")
def prefix_count(spark, sf):
    return read(spark, sf, "documents").where(F.col("source").startswith("src1")).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-06-30'")
def manifest_join(spark, sf):
    o = read(spark, sf, "orders").where("o_orderdate between timestamp_ntz'1995-01-01' and timestamp_ntz'1995-06-30'")
    return o.join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def manifest_left(spark, sf):
    counts = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return read(spark, sf, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def todo_anti(spark, sf):
    return relational.missing_from(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels"), "doc_id")


@query("""WITH r AS (SELECT o_orderkey // 64 AS range_id, o_orderkey // 1024 AS block, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY ALL)
SELECT l.l_orderkey, l.l_linenumber, r.range_id FROM lineitem l JOIN r ON l.l_orderkey // 1024 = r.block AND l.l_orderkey BETWEEN r.lo AND r.hi""")
def range_locate(spark, sf):
    ranges = read(spark, sf, "orders").groupBy(F.expr("o_orderkey div 64").alias("range_id"), F.expr("o_orderkey div 1024").alias("block")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    points = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_orderkey div 1024").alias("block"))
    return relational.range_locate(points, ranges, "block", "l_orderkey", "lo", "hi").select("l_orderkey", "l_linenumber", "range_id")


@query("SELECT d.doc_id, coalesce(a.quality, b.quality) AS quality FROM documents d LEFT JOIN labels a ON d.doc_id = a.doc_id LEFT JOIN labels b ON d.doc_id + 1 = b.doc_id")
def fallback_join(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", (F.col("doc_id") + 1).alias("next_id"))
    return relational.with_fallback(docs, read(spark, sf, "labels"), "doc_id", "next_id", "doc_id", "quality").select("doc_id", "quality")


@query("""WITH a AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT doc_id FROM labels WHERE toxic = 0)
SELECT count(a.doc_id) FILTER (WHERE b.doc_id IS NOT NULL) AS n_both, count(*) FILTER (WHERE b.doc_id IS NULL) AS n_left, count(*) FILTER (WHERE a.doc_id IS NULL) AS n_right FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def agreement_join(spark, sf):
    labels = read(spark, sf, "labels")
    return relational.agreement(labels.where("quality = 1").select("doc_id"), labels.where("toxic = 0").select("doc_id"), ["doc_id"])


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations WHERE role = 'user') WHERE k = 1")
def first_match(spark, sf):
    turns = read(spark, sf, "conversations").where("role = 'user'")
    asked = turns.select(F.col("conv_id").alias("asked")).distinct()
    return relational.first_match(asked, turns, F.col("asked") == F.col("conv_id"), "asked", ["turn", "text"]).select("conv_id", "turn", "text")


# measures


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), c AS (SELECT greatest(1, least(8, ceil((value - lo) / ((hi - lo) / 8))))::INTEGER AS bin, count(*) AS n FROM events, e GROUP BY ALL)
SELECT b.bin::INTEGER AS bin, round(lo + (b.bin - 1) * ((hi - lo) / 8), 6) AS low, round(lo + b.bin * ((hi - lo) / 8), 6) AS high, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(1, 9)) AS bin) b CROSS JOIN e LEFT JOIN c ON c.bin = b.bin""")
def hist_equal_width(spark, sf):
    return measures.equal_width_histogram(read(spark, sf, "events"), "value", 8).withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("""WITH m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS m, o_totalprice AS v FROM orders), e AS (SELECT min(m) AS lo, max(m) AS hi FROM m)
SELECT p.period::INTEGER AS period, round(coalesce(sum(v), 0), 2) AS total FROM (SELECT unnest(range(0, (SELECT (hi - lo) // 6 + 1 FROM e))) AS period) p CROSS JOIN e LEFT JOIN m ON (m.m - e.lo) // 6 = p.period GROUP BY p.period""")
def resample_6m(spark, sf):
    return measures.resample_months(read(spark, sf, "orders"), "o_orderdate", "o_totalprice", 6).withColumn("total", F.round("total", 2))


@query("SELECT year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, count(*) AS n FROM orders GROUP BY ALL")
def month_counter(spark, sf):
    return read(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))


_KL = f"""WITH {_USES}, c AS (SELECT term, lang, count(*) AS n FROM uses GROUP BY ALL), b AS (SELECT lang, count(*) AS bn FROM documents GROUP BY lang),
s AS (SELECT term, c.lang, n, n / sum(n) OVER (PARTITION BY term)::DOUBLE AS p, bn / (SELECT sum(bn) FROM b)::DOUBLE AS q FROM c JOIN b USING (lang)),
k AS (SELECT *, p * ln(p / q) AS kl, p / q AS lift FROM s) """


def _contributions(spark, sf):
    counts = measures.category_counts(uses(spark, sf, "lang"), "term", "lang")
    baseline = read(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return measures.kl_contributions(counts, baseline, "term", "lang")


@query(_KL + "SELECT term, lang, n, round(kl, 9) AS kl FROM k WHERE n >= 20")
def lang_kl(spark, sf):
    return _contributions(spark, sf).where("n >= 20").select("term", "lang", "n", F.round("kl", 9).alias("kl"))


@query(_KL + "SELECT term, lang, round(lift, 9) AS lift FROM k WHERE n >= 20 AND lift > 2")
def lang_lift(spark, sf):
    return _contributions(spark, sf).where("n >= 20 and lift > 2").select("term", "lang", F.round("lift", 9).alias("lift"))


@query(_KL + """SELECT term, sum(n)::BIGINT AS total, round(sum(kl), 9) AS divergence, arg_max(lang, kl) AS top_category FROM k GROUP BY term HAVING sum(n) >= 100 ORDER BY round(sum(kl), 9), term LIMIT 100""")
def argmax_category(spark, sf):
    rows = _contributions(spark, sf)
    return measures.argmax_category(rows, "term", "lang", 100, 100, digits=9)


@query("""WITH s AS (SELECT count(*)::DOUBLE AS n, sum((quality = toxic)::INTEGER) AS same, sum(quality) AS a, sum(toxic) AS b FROM labels),
p AS (SELECT n::BIGINT AS n, same / n AS po, (a * b + (n - a) * (n - b)) / (n * n) AS pe FROM s)
SELECT n, round(po, 9) AS observed, round(pe, 9) AS expected, round((po - pe) / (1 - pe), 9) AS kappa FROM p""")
def kappa(spark, sf):
    return measures.kappa(read(spark, sf, "labels"), "quality", "toxic").withColumns({c: F.round(c, 9) for c in ("observed", "expected", "kappa")})


def _scored(spark, sf):
    rows = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.withColumn("score", F.expr("(n_chars % 100) / 100.0D"))


@query("""WITH s AS (SELECT quality, (n_chars % 100) / 100.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id)), t AS (SELECT unnest(range(10, 91)) AS cut),
f AS (SELECT cut, sum(quality) FILTER (WHERE score > cut / 100.0::DOUBLE) AS tp, count(*) FILTER (WHERE score > cut / 100.0::DOUBLE) AS called, sum(quality) AS pos FROM t, s GROUP BY cut)
SELECT cut::INTEGER AS cutoff, round(2 * coalesce(tp, 0) / (called + pos)::DOUBLE, 9) AS f1 FROM f ORDER BY f1 DESC, cut LIMIT 1""")
def best_cutoff(spark, sf):
    return measures.best_cutoff(_scored(spark, sf), "score", "quality").select("cutoff", F.round("f1", 9).alias("f1"))


@query("""WITH c AS (SELECT unnest([0, 1]) AS class), n AS (SELECT class, count(*) FILTER (WHERE quality = class) AS s, count(*) FILTER (WHERE toxic = class) AS k, count(*) FILTER (WHERE quality = class AND toxic = class) AS tp FROM labels, c GROUP BY class)
SELECT class, round(CASE WHEN k > 0 THEN tp / k::DOUBLE ELSE 0 END, 9) AS precision, round(CASE WHEN s > 0 THEN tp / s::DOUBLE ELSE 0 END, 9) AS recall, round(CASE WHEN k + s > 0 THEN 2 * tp / (k + s)::DOUBLE ELSE 0 END, 9) AS f1, s AS support FROM n""")
def class_report(spark, sf):
    return measures.class_report(read(spark, sf, "labels"), "quality", "toxic").withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM events GROUP BY event_type")
def outcome_percent(spark, sf):
    counts = read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all_n"))
    return counts.crossJoin(F.broadcast(total)).select("event_type", "n", measures.share(F.col("n"), F.col("all_n")).alias("percent"))


@query("SELECT user_id, arg_min(event_type, ts) AS first_event, arg_max(event_type, ts) AS last_event FROM events GROUP BY user_id")
def first_last_event(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", "ts").alias("first_event"), F.max_by("event_type", "ts").alias("last_event"))


# sequences


#: Line numbers repeat within an order, so a place is the line number with what tells its rows apart.
_PLACE = "l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + cast(l_quantity as bigint)"
_FLAGS = f"f AS (SELECT l_orderkey, {_PLACE} AS place, l_returnflag AS w, l_quantity > 25 AS flag FROM lineitem)"


@query(f"WITH {_FLAGS} SELECT l_orderkey, place, CASE WHEN NOT flag THEN 'O' WHEN coalesce(lag(flag) OVER (PARTITION BY l_orderkey ORDER BY place), false) THEN 'I' ELSE 'B' END AS bio FROM f")
def bio_tags(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", F.expr(_PLACE).alias("place"), (F.col("l_quantity") > 25).alias("flag"))
    return sequences.bio_tags(rows, "l_orderkey", "place", "flag").select("l_orderkey", "place", "bio")


@query(f"""WITH {_FLAGS}, g AS (SELECT *, sum(CASE WHEN flag AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY place) AS run FROM (SELECT *, lag(flag) OVER (PARTITION BY l_orderkey ORDER BY place) AS p FROM f))
SELECT l_orderkey, min(place) AS start, count(*) AS n, string_agg(w, ' ' ORDER BY place) AS phrase FROM g WHERE flag GROUP BY l_orderkey, run""")
def bio_runs(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", F.expr(_PLACE).alias("place"), F.col("l_returnflag").alias("w"), (F.col("l_quantity") > 25).alias("flag"))
    tagged = sequences.bio_tags(rows, "l_orderkey", "place", "flag")
    return sequences.tag_runs(tagged, "l_orderkey", "place", "w", "bio")


# vectors


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY vec_id),
d AS (SELECT a.vec_id AS query, b.vec_id, sum(a.x * b.x) AS d FROM e a JOIN e b USING (i) WHERE a.vec_id % 100 = 0 GROUP BY ALL),
s AS (SELECT query, d.vec_id, round(d / na.n / nb.n, 7) AS score FROM d JOIN n na ON na.vec_id = query JOIN n nb ON nb.vec_id = d.vec_id)
SELECT query, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def cosine_knn(spark, sf):
    rows = read(spark, sf, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return vectors.cosine_neighbours(rows, "vec_id", "embedding", asked, 10, digits=7).select("query", "vec_id", "score", "rank")


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), q AS (SELECT i, sum(CASE vec_id WHEN 1 THEN -x ELSE x END) AS x FROM e WHERE vec_id IN (1, 2, 3) GROUP BY i),
d AS (SELECT e.vec_id, sum(e.x * q.x) / sqrt(sum(e.x * e.x)) / sqrt(sum(q.x * q.x)) AS s FROM e JOIN q USING (i) GROUP BY e.vec_id)
SELECT vec_id, round(s, 7) AS score FROM d ORDER BY score DESC, vec_id LIMIT 10""")
def analogy(spark, sf):
    rows = read(spark, sf, "embeddings")
    given = rows.where("vec_id in (1, 2, 3)").groupBy().agg(*[F.max_by("embedding", F.col("vec_id") == i).alias(f"v{i}") for i in (1, 2, 3)])
    q = given.select(F.lit(0).alias("query"), F.expr("zip_with(zip_with(v2, v1, (a, b) -> cast(a as double) - b), v3, (a, b) -> a + b)").alias("q"))
    scored = vectors.cosine_neighbours(rows, "vec_id", "embedding", q, 20)
    return scored.select("vec_id", F.round("score", 7).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query("WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, dim::INTEGER AS dim, round(avg(x), 7) AS mean FROM e GROUP BY ALL")
def label_centroids(spark, sf):
    return vectors.centroids(read(spark, sf, "embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 7))


@query("WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, round(sqrt(sum(x * x)) / sum(abs(x)), 7) AS c FROM e GROUP BY vec_id")
def concentration(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.round(vectors.concentration("embedding"), 7).alias("c"))


# graphs


_EDGES = "e AS (SELECT DISTINCT n_nationkey::BIGINT AS src, ((n_nationkey * 7 + 3) % 25)::BIGINT AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + n_regionkey + 1) % 25 FROM nation)"


def _edges(spark, sf):
    n = read(spark, sf, "nation")
    key = F.col("n_nationkey").cast("long")
    return n.select(key.alias("src"), ((key * 7 + 3) % 25).alias("dst")).union(n.select(key, (key + F.col("n_regionkey") + 1) % 25)).distinct()


@query(f"WITH {_EDGES}, x AS (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) SELECT node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out, (sum(o) - sum(i))::BIGINT AS specificity FROM x GROUP BY node")
def graph_degree(spark, sf):
    return graph.degrees(_edges(spark, sf))


@query(f"""WITH RECURSIVE {_EDGES}, r(src, dst, dist) AS (SELECT src, dst, 1 FROM e UNION SELECT r.src, e.dst, r.dist + 1 FROM r JOIN e ON r.dst = e.src WHERE r.dist < 4)
SELECT src, dst, min(dist)::INTEGER AS dist FROM r WHERE src <> dst GROUP BY src, dst""")
def graph_reach(spark, sf):
    return graph.distances(_edges(spark, sf), 4)


@query(f"""WITH RECURSIVE {_EDGES}, r(src, dst, dist) AS (SELECT src, dst, 1 FROM e UNION SELECT r.src, e.dst, r.dist + 1 FROM r JOIN e ON r.dst = e.src WHERE r.dist < 25),
m AS (SELECT src, dst, min(dist) AS dist FROM r WHERE src <> dst GROUP BY src, dst)
SELECT a.n_nationkey::BIGINT AS src, b.n_nationkey::BIGINT AS dst, coalesce(dist, 5)::INTEGER AS dist FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey LEFT JOIN m ON m.src = a.n_nationkey AND m.dst = b.n_nationkey""")
def graph_bounded_dist(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("src"), "n_regionkey")
    pairs = n.join(n.withColumnRenamed("src", "dst"), "n_regionkey").where("src <> dst").select("src", "dst")
    return graph.bounded_distance(pairs, graph.distances(_edges(spark, sf)))


@query("SELECT r_regionkey::BIGINT AS node FROM region WHERE false UNION SELECT DISTINCT o_custkey + 1000000000 FROM orders")
def graph_sinks(spark, sf):
    return graph.sinks(read(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), (F.col("o_custkey") + 1000000000).alias("dst")))


@query(f"""WITH {_EDGES}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst), t AS (SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON y.a = x.b JOIN u z ON z.a = x.a AND z.b = y.b)
SELECT node, count(*) AS triangles FROM (SELECT a AS node FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY node""")
def graph_triangles(spark, sf):
    return graph.clustering(_edges(spark, sf))


@query(f"""WITH RECURSIVE {_EDGES}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
SELECT src, dst FROM e WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM r WHERE r.src = e.dst AND r.dst = e.src)""")
def graph_acyclic(spark, sf):
    return graph.acyclic(_edges(spark, sf))


@query("""WITH t AS (SELECT item_id, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS w FROM benchmark), d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS w FROM documents)
SELECT DISTINCT item_id AS src, doc_id + 1000000 AS dst FROM t JOIN d ON contains(d.w, t.w) WHERE trim(t.w) <> ''""")
def containment_edges(spark, sf):
    terms = read(spark, sf, "benchmark").select(F.col("item_id").alias("term"), T.tokens(F.col("text")).alias("words")).where("size(words) > 0")
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("def_id"), T.tokens(F.col("text")).alias("words"), F.array(F.col("doc_id") + 1000000).alias("defines"))
    return graph.containment_edges(terms, docs)


# samples


_X = "('0x' || substr(md5('s|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"SELECT doc_id, CASE WHEN {_X} < 0.8 THEN 'train' WHEN {_X} < 0.9 THEN 'dev' ELSE 'test' END AS part FROM documents")
def hash_split(spark, sf):
    return read(spark, sf, "documents").select("doc_id", sampling.split_label(F.col("doc_id"), [("train", 0.8), ("dev", 0.1), ("test", 0.1)], "s").alias("part"))


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS c, row_number() OVER (PARTITION BY source ORDER BY {_X}, doc_id) AS k FROM documents) WHERE c >= 5 AND k <= 5")
def sample_neg(spark, sf):
    return sampling.sample_per_group(read(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 5, "s")


# text functions


_SPACED_OUT = """WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '<br\\s*/? ?>', ' ', 'g'), '[0-9]+', ' ', 'g'), '[^\\x00-\\x7f]+', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[''"\\[\\]{}\\\\^]|``', '', 'g'), '[=*|~]', ' ', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([.,;:()!?/\n-])', ' \\1 ', 'g'), '[ \\t]+', ' ', 'g') AS t FROM b)
SELECT doc_id, regexp_replace(lower(t), '^\\s+|\\s+$', '', 'g') AS text FROM c"""


@query(_SPACED_OUT)
def normalize_text(spark, sf):
    """Letters that are not ASCII left out, as SQL has no transliteration; `normalize_text_all` maps them."""
    return read(spark, sf, "documents").select("doc_id", T.normalize_text(F.col("text"), letters="drop").alias("text"))


@query()
def normalize_text_all(spark, sf):
    """With letters mapped to ASCII; tested against brute force."""
    return read(spark, sf, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<br\\s*/? ?>', ' ', 'g'), '[0-9]+', ' ', 'g'), '[^\\x00-\\x7f]+', '', 'g'),
'[''".,()!?^;:=*|/\\\\~<>\\[\\]{}]|``', '', 'g'), '-|[ \\t\n]+', ' ', 'g')), '^\\s+|\\s+$', '', 'g'), '\\s+', '_', 'g') AS phrase FROM documents""")
def normalize_phrase(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.normalize_phrase(F.col("text"), "drop").alias("phrase"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::INTEGER AS words FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 15")
def min_words(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.word_count(F.col("text")).alias("words")).where("words >= 15")


_IDS = ["http://arxiv.org/abs/1708.01234v2", "http://arxiv.org/abs/math/0211159v1", "1703/1703.04567.gz", "math.AG/9912123", "not an id"]


@query("""SELECT * FROM (VALUES ('http://arxiv.org/abs/1708.01234v2', 'new', NULL, '1708', '01234', 2), ('http://arxiv.org/abs/math/0211159v1', 'old', 'math', '0211', '159', 1),
('1703/1703.04567.gz', 'new', NULL, '1703', '04567', NULL), ('math.AG/9912123', 'old', 'math.AG', '9912', '123', NULL), ('not an id', NULL, NULL, NULL, NULL, NULL)) t(name, scheme, category, yymm, number, version)""")
def id_parse(spark, sf):
    return spark.createDataFrame([(i,) for i in _IDS], "name string").withColumn("id", T.article_id(F.col("name"))).select("name", "id.*")


@query("""SELECT * FROM (VALUES (1, 2, 0, 0, 1, 2, 'SUCC', 24), (2, 5, 3, 1, 0, 0, 'FATAL,TIMED', 86424), (3, 0, 0, 0, 0, 0, 'DIED', NULL)) t(run, warnings, errors, fatal, undefined, missing, flags, secs)""")
def log_outcome(spark, sf):
    """Conversion runs: counts, flags and seconds; a run over a day long keeps its days."""
    rows = [(1, "Conversion complete: 2 warnings; 1 undefined macro; 2 missing files", "Thu Aug  1 10:00:00 2019", "Thu Aug  1 10:00:24 2019", False), (2, "Conversion complete: 5 warnings; 3 errors; 1 fatal error", "Thu Aug  1 10:00:00 2019", "Fri Aug  2 10:00:24 2019", True), (3, "", None, None, False)]
    df = spark.createDataFrame(rows, "run int, line string, started string, ended string, timed boolean")
    df = df.withColumn("c", T.conversion_counts(F.col("line"))).withColumn("s", T.log_time(F.col("started"))).withColumn("e", T.log_time(F.col("ended")))
    flags = T.outcome(F.col("s"), F.col("e"), F.col("c.fatal"), F.col("c.errors"), F.col("timed"))
    return df.select("run", "c.*", F.array_join(flags, ",").alias("flags"), F.timestamp_diff("SECOND", "s", "e").cast("int").alias("secs"))
