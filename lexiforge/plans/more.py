"""Queries on term references, tagged sentences, statistics, lists, graphs, and stored tables; importing this registers them beside the others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.operators import graph, measures, ner, references, relational, sampling, sequences, stats, tfidf
from lexiforge.plans import extra, queries
from lexiforge.plans.queries import _USES, _WORDS, ORACLES, QUERIES, dealt_uses, read, uses

_before = set(extra.QUERIES)
query = queries.query
_ALL_TALK = f"talk AS (SELECT conv_id, turn, list_filter({_WORDS}, lambda w: w <> '') AS w FROM conversations)"


def talk(spark, sf):
    """(conv_id, turn, w): the words of each turn."""
    return read(spark, sf, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("w"))


# term references


@query(f"""WITH {_USES}, {_ALL_TALK}, g AS (SELECT DISTINCT w[1] AS term, conv_id AS addr, turn AS p_index FROM talk WHERE len(w) > 0),
k AS (SELECT DISTINCT term FROM g), u AS (SELECT doc_id AS addr, term FROM uses WHERE term IN (SELECT term FROM k)),
c AS (SELECT addr, term, count(*) AS tf FROM u GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM c GROUP BY term), n AS (SELECT count(DISTINCT addr) AS n FROM c),
r AS (SELECT addr, term, (1 + ln(tf)) * (1 + ln((n.n + 1) / (df + 1)::DOUBLE)) AS raw FROM c JOIN d USING (term), n),
x AS (SELECT addr, term, round(raw / sum(raw) OVER (PARTITION BY addr), 9) AS weight FROM r),
l AS (SELECT doc_id AS addr, string_split(text, chr(10)) AS p FROM documents), q AS (SELECT addr, generate_subscripts(p, 1) - 1 AS p_index, unnest(p) AS p_tag FROM l),
t AS (SELECT g.term, g.addr, g.p_index, coalesce(q.p_tag, '') AS p_tag, row_number() OVER (PARTITION BY g.term ORDER BY g.addr, g.p_index) - 1 AS truid FROM g LEFT JOIN q ON q.addr = g.addr AND q.p_index = g.p_index)
SELECT t.term, t.addr, t.p_index, t.truid::INTEGER AS truid, t.p_tag, coalesce(weight, 0) AS weight, (floor(coalesce(weight, 0) * 1e10)::BIGINT + t.p_index)::BIGINT AS sort_key
FROM t LEFT JOIN x ON x.addr = t.addr AND x.term = t.term WHERE length(t.p_tag) < 2000""")
def term_references(spark, sf):
    """The first word of each turn as a term of the document of that number, whose lines are its paragraphs."""
    glossary = talk(spark, sf).where("size(w) > 0").select(F.col("w")[0].alias("term"), F.col("conv_id").alias("addr"), F.col("turn").alias("p_index"))
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("addr"), "text")
    paragraphs = docs.select("addr", F.posexplode(F.split("text", "\n")).alias("p_index", "p_tag")).withColumn("p_index", F.col("p_index").cast("long"))
    found = dealt_uses(spark, sf).withColumnRenamed("doc_id", "addr")
    return references.term_references(glossary, paragraphs, found, most=2000).select("term", "addr", "p_index", "truid", "p_tag", "weight", "sort_key")


@query("SELECT c.conv_id, count(*) AS turns, coalesce(any_value(d.text), '') AS text FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id GROUP BY c.conv_id")
def glossary_corpus(spark, sf):
    """Glossaries with the article's text, '' where the corpus lacks it."""
    per = read(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), "text")
    return per.join(docs, "conv_id", "left").select("conv_id", "turns", F.coalesce("text", F.lit("")).alias("text"))


@query("""WITH q AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p_index, unnest(string_split(text, chr(10))) AS p FROM documents)
SELECT l.doc_id, l.quality AS p_index, p FROM labels l LEFT JOIN q ON q.doc_id = l.doc_id AND q.p_index = l.quality""")
def paragraph_lookup(spark, sf):
    """A paragraph by article and place; null if there is none."""
    lines = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p_index", "p"))
    return read(spark, sf, "labels").select("doc_id", F.col("quality").alias("p_index")).join(lines, ["doc_id", "p_index"], "left")


_PHRASES = "ph AS (SELECT p_brand, regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g') AS phrase FROM part)"
_BLACK = "('small ring', 'of the', 'set of')"


def _phrases(spark, sf):
    phrase = F.replace(T.normalize_phrase(F.col("p_name")), F.lit("_"), F.lit(" "))
    black = spark.createDataFrame([(p,) for p in [*T.PHRASE_BLACKLIST, "small ring"]], "phrase string")
    return relational.missing_from(read(spark, sf, "part").select("p_brand", phrase.alias("phrase")), black, "phrase")


@query(f"WITH {_PHRASES} SELECT p_brand, phrase, count(*) AS n FROM ph WHERE phrase NOT IN {_BLACK} GROUP BY ALL")
def normal_term_counts(spark, sf):
    """Counts of normal forms in each group, without the blacklist."""
    return _phrases(spark, sf).groupBy("p_brand", "phrase").agg(F.count("*").alias("n"))


@query(f"WITH {_PHRASES} SELECT phrase, count(*) AS n FROM ph WHERE phrase NOT IN {_BLACK} AND len(string_split(phrase, ' ')) > 1 GROUP BY phrase ORDER BY n DESC, phrase LIMIT 20")
def multiword_top(spark, sf):
    return relational.top_counts(_phrases(spark, sf).where(F.size(F.split("phrase", " ")) > 1), "phrase", 20)


@query(f"""WITH {_PHRASES}, a AS (SELECT phrase, count(*) AS n FROM ph WHERE p_brand < 'Brand#3' GROUP BY phrase), b AS (SELECT phrase, count(*) AS n FROM ph WHERE p_brand >= 'Brand#3' GROUP BY phrase)
SELECT phrase, a.n + b.n AS score FROM a JOIN b USING (phrase) WHERE phrase NOT IN {_BLACK}""")
def intersect_count(spark, sf):
    count = lambda rows: rows.groupBy("phrase").agg(F.count("*").alias("n"))
    p = _phrases(spark, sf)
    return relational.set_compare(count(p.where("p_brand < 'Brand#3'")), count(p.where("p_brand >= 'Brand#3'")), "phrase").where("side = 'both'").select("phrase", (F.col("n_left") + F.col("n_right")).alias("score"))


# categories and look-ups


@query("SELECT doc_id, lang AS primary_tag FROM documents WHERE (lang = 'en' OR lang IS NULL)")
def language_gate(spark, sf):
    return read(spark, sf, "documents").where("lang = 'en' or lang is null").select("doc_id", F.col("lang").alias("primary_tag"))


@query("SELECT doc_id, source AS primary_tag, source = 'src1' AS exact FROM documents WHERE contains(source, 'c1') OR contains(source, 'src7')")
def category_filter(spark, sf):
    """Articles whose first tag holds any of some terms, and whether it is one exactly."""
    tagged = read(spark, sf, "documents").select("doc_id", F.array("source", "lang").alias("tags")).withColumn("primary_tag", F.get("tags", F.lit(0)))
    wanted = F.array(F.lit("c1"), F.lit("src7"))
    return tagged.where(F.exists(wanted, lambda t: F.contains(F.col("primary_tag"), t))).select("doc_id", "primary_tag", (F.col("primary_tag") == "src1").alias("exact"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://(m|www)\\.')")
def anchored_member(spark, sf):
    return read(spark, sf, "pages").where(F.col("url").rlike(r"^https?://(m|www)\.")).select("page_id", "url")


@query(f"WITH {_ALL_TALK}, e AS (SELECT conv_id, unnest(w) AS term FROM talk) SELECT DISTINCT term, conv_id FROM e WHERE contains(term, 'ung')")
def contains_search(spark, sf):
    return talk(spark, sf).select("conv_id", F.explode("w").alias("term")).where(F.contains("term", F.lit("ung"))).select("term", "conv_id").distinct()


@query(f"WITH {_ALL_TALK}, e AS (SELECT conv_id, turn, unnest(w) AS term FROM talk) SELECT term, count(DISTINCT (conv_id, turn)) AS n, min(conv_id * 1000 + turn) AS first, max(conv_id * 1000 + turn) AS last FROM e GROUP BY term HAVING count(*) >= 5")
def term_index(spark, sf):
    """term -> its places, as their number, first and last."""
    per = talk(spark, sf).select("conv_id", "turn", F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("c"), F.collect_set(F.struct("conv_id", "turn")).alias("places")).where("c >= 5")
    at = F.transform("places", lambda p: p["conv_id"] * 1000 + p["turn"])
    return per.select("term", F.size("places").cast("long").alias("n"), F.array_min(at).alias("first"), F.array_max(at).alias("last"))


@query("SELECT n_name, count(*) AS n, string_agg(s_name, ',' ORDER BY s_name) AS names FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def grouped_lookup(spark, sf):
    s = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy("n_name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("names"))


@query("SELECT p.page_id, d.doc_id FROM pages p JOIN documents d ON regexp_extract(url, '/(\\d+)', 1) = d.doc_id::VARCHAR WHERE url LIKE '%/' || d.doc_id || '%'")
def url_theta_join(spark, sf):
    """Pages whose address holds an article's number, met by the number itself."""
    pages = read(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"/(\d+)", 1).alias("number"))
    return pages.join(read(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("number")), "number").select("page_id", "doc_id")


@query("SELECT l.doc_id, e.vec_id IS NOT NULL AS known, round(coalesce(list_sum(e.embedding::DOUBLE[]), 0), 6) AS total, len(coalesce(e.embedding, [0])) AS dims FROM labels l LEFT JOIN embeddings e ON l.doc_id = e.vec_id")
def embedding_lookup(spark, sf):
    """A vector for each item, zero where it has none."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = read(spark, sf, "labels").select("doc_id").join(e, "doc_id", "left").withColumn("vec", F.coalesce("embedding", F.array(F.lit(0.0).cast("float"))))
    return rows.select("doc_id", F.col("embedding").isNotNull().alias("known"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"), F.size("vec").cast("long").alias("dims"))


@query("""SELECT source AS s, count(*) FILTER (WHERE lang IN ('en', 'de')) AS n_left, count(*) FILTER (WHERE lang IN ('de', 'fr')) AS n_right, count(*) FILTER (WHERE lang = 'de') AS shared
FROM documents WHERE lang IN ('en', 'de', 'fr') GROUP BY source""")
def set_overlap(spark, sf):
    """Two glossaries by article: sizes of both and of what they share."""
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("s"), "lang")
    both = d.select("s", F.coalesce(F.col("lang").isin("en", "de"), F.lit(False)).alias("l"), F.coalesce(F.col("lang").isin("de", "fr"), F.lit(False)).alias("r")).where("l or r")
    return both.groupBy("s").agg(F.count_if("l").alias("n_left"), F.count_if("r").alias("n_right"), F.count_if(F.col("l") & F.col("r")).alias("shared"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE l.doc_id IS NULL) AS no_label, count(*) FILTER (WHERE e.vec_id IS NULL) AS no_vector,
count(*) FILTER (WHERE l.doc_id IS NOT NULL AND e.vec_id IS NOT NULL) AS in_all FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def sync_check(spark, sf):
    """Items of one corpus that two others hold too, by key."""
    d = read(spark, sf, "documents").select("doc_id")
    rows = d.join(read(spark, sf, "labels").select("doc_id", F.lit(True).alias("l")), "doc_id", "left").join(read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("e")), "doc_id", "left")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("l").isNull()).alias("no_label"), F.count_if(F.col("e").isNull()).alias("no_vector"), F.count_if(F.col("l").isNotNull() & F.col("e").isNotNull()).alias("in_all"))


# counters


@query("SELECT CASE WHEN text IS NULL OR trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' WHEN contains(text, '%%%') THEN 'bad' ELSE 'good' END AS status, count(*) AS n FROM documents GROUP BY ALL")
def parse_outcomes(spark, sf):
    text = F.col("text")
    status = F.when(text.isNull() | text.rlike(r"\A[ \t\n\r]*\z"), "empty").when(F.contains(text, F.lit("%%%")), "bad").otherwise("good")
    return read(spark, sf, "documents").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN strlen(text) = length(text) THEN 'us-ascii' WHEN NOT regexp_matches(text, '[^\\x00-\\xff]') THEN 'iso-8859-1' ELSE 'utf-8' END AS encoding, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def encoding_counts(spark, sf):
    """The narrowest encoding that holds each text."""
    text = F.col("text")
    kind = F.when(F.octet_length(text) == F.length(text), "us-ascii").when(~text.rlike(r"[^\x00-\xff]"), "iso-8859-1").otherwise("utf-8")
    return read(spark, sf, "documents").where(text.isNotNull()).groupBy(kind.alias("encoding")).agg(F.count("*").alias("n"))


@query(f"WITH {_ALL_TALK}, e AS (SELECT conv_id, unnest(w) AS term FROM talk) SELECT count(DISTINCT conv_id) AS articles, (SELECT count(*) FROM talk) AS definitions, count(*) AS terms, count(DISTINCT term) AS distinct_terms, round(count(*) / (SELECT count(*) FROM talk)::DOUBLE, 9) AS per_definition FROM e")
def glossary_totals(spark, sf):
    t = talk(spark, sf).withColumn("one", F.lit(1))
    definitions = t.agg(F.count("*").alias("definitions"))
    terms = t.select("conv_id", F.explode("w").alias("term")).agg(F.count_distinct("conv_id").alias("articles"), F.count("*").alias("terms"), F.count_distinct("term").alias("distinct_terms"))
    return definitions.crossJoin(F.broadcast(terms)).select("articles", "definitions", "terms", "distinct_terms", F.round(F.col("terms") / F.col("definitions"), 9).alias("per_definition"))


@query(f"WITH {_USES} SELECT term, count(*) FILTER (WHERE lang = 'en') AS n_a, count(*) FILTER (WHERE lang = 'de') AS n_b FROM uses GROUP BY term HAVING count(*) FILTER (WHERE lang = 'en') > 4 * count(*) FILTER (WHERE lang = 'de') AND count(*) >= 20")
def ratio_filter(spark, sf):
    per = uses(spark, sf, "lang").groupBy("term").agg(F.count_if(F.col("lang") == "en").alias("n_a"), F.count_if(F.col("lang") == "de").alias("n_b"), F.count("*").alias("n"))
    return per.where("n_a > 4 * n_b and n >= 20").select("term", "n_a", "n_b")


@query(f"""WITH {_USES}, b AS (SELECT source, count(*)::DOUBLE / sum(count(*)) OVER () AS base FROM uses WHERE source IN ('src0', 'src1', 'src2', 'src3') GROUP BY source),
t AS (SELECT term, source, count(*) AS n FROM uses WHERE term IN ('the', 'la', 'der') AND source IN ('src0', 'src1', 'src2', 'src3') GROUP BY ALL)
SELECT term, source, round(n / sum(n) OVER (PARTITION BY term)::DOUBLE / base, 9) AS relative FROM t JOIN b USING (source)""")
def radar_frequency(spark, sf):
    """Shares of a few terms over a few categories against the categories' own."""
    rows = uses(spark, sf, "source").where(F.col("source").isin("src0", "src1", "src2", "src3"))
    counts = measures.category_counts(rows.where(F.col("term").isin("the", "la", "der")), "term", "source")
    lifted = measures.kl_contributions(counts, rows.groupBy("source").agg(F.count("*").alias("n")), "term", "source")
    return lifted.select("term", "source", F.round("lift", 9).alias("relative"))


@query("""SELECT average, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (
WITH n AS (SELECT c AS class, count(*) FILTER (WHERE quality = c) AS s, count(*) FILTER (WHERE toxic = c) AS k, count(*) FILTER (WHERE quality = c AND toxic = c) AS tp FROM labels, (SELECT unnest([0, 1]) AS c) GROUP BY c),
m AS (SELECT s, CASE WHEN k > 0 THEN tp / k::DOUBLE ELSE 0 END AS p, CASE WHEN s > 0 THEN tp / s::DOUBLE ELSE 0 END AS r, CASE WHEN k + s > 0 THEN 2 * tp / (k + s)::DOUBLE ELSE 0 END AS f FROM n)
SELECT 'macro' AS average, avg(p) AS precision, avg(r) AS recall, avg(f) AS f1, sum(s)::BIGINT AS support FROM m UNION ALL SELECT 'weighted', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s)::BIGINT FROM m
UNION ALL SELECT 'micro', a, a, a, n FROM (SELECT avg((quality = toxic)::INTEGER) AS a, count(*) AS n FROM labels))""")
def report_averages(spark, sf):
    report = measures.class_report(read(spark, sf, "labels"), "quality", "toxic")
    return measures.report_averages(report).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def confusion_table(spark, sf):
    return read(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("SELECT doc_id, quality, toxic, CASE WHEN quality = 1 THEN 'false negative' ELSE 'false positive' END AS kind FROM labels WHERE quality <> toxic")
def wrong_predictions(spark, sf):
    return read(spark, sf, "labels").where("quality <> toxic").select("doc_id", "quality", "toxic", F.when(F.col("quality") == 1, "false negative").otherwise("false positive").alias("kind"))


@query("""WITH x AS (SELECT n_chars::DOUBLE AS a, length(text) % 97 + n_chars / 50.0 AS b FROM documents WHERE text IS NOT NULL),
ra AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x) SELECT round(corr(ra, rb), 9) AS spearman, count(*) AS n FROM ra""")
def spearman(spark, sf):
    d = read(spark, sf, "documents").where("text is not null").select(F.col("n_chars").cast("double").alias("a"), (F.length("text") % 97 + F.col("n_chars") / F.lit(50.0)).alias("b"))
    return stats.spearman(d, "a", "b").select(F.round("spearman", 9).alias("spearman"), "n")


@query("""WITH x AS (SELECT doc_id, n_chars, quality FROM labels JOIN documents USING (doc_id)), r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS a, row_number() OVER (ORDER BY quality DESC, doc_id) AS b FROM x)
SELECT doc_id, abs(a - b)::INTEGER AS difference FROM r WHERE abs(a - b) > 10""")
def rank_difference(spark, sf):
    """Places of an evaluation set by two scores; the set is small by nature, so one ordered window each."""
    x = read(spark, sf, "labels").join(read(spark, sf, "documents"), "doc_id")
    r = x.select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("a"), F.row_number().over(Window.orderBy(F.desc("quality"), "doc_id")).alias("b"))
    return r.select("doc_id", F.abs(F.col("a") - F.col("b")).alias("difference")).where("difference > 10")


@query("WITH x AS (SELECT n_chars, quality FROM labels JOIN documents USING (doc_id)), m AS (SELECT avg(n_chars) AS m FROM x) SELECT round(max(m), 6) AS mean, round(avg(((n_chars > m) = (quality = 1))::INTEGER), 9) AS accuracy FROM x, m")
def mean_cut_accuracy(spark, sf):
    x = read(spark, sf, "labels").join(read(spark, sf, "documents"), "doc_id")
    return stats.over_mean_accuracy(x, "n_chars", "quality").select(F.round("mean", 6).alias("mean"), F.round("accuracy", 9).alias("accuracy"))


@query("""WITH r AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents), s AS (SELECT source, lang, count(*) AS c FROM r WHERE k > 5 AND k <= 10 GROUP BY ALL),
b AS (SELECT source, sum(c) AS n, first(lang ORDER BY c DESC, lang NULLS FIRST) AS mode FROM s GROUP BY source) SELECT x.source, CASE WHEN n = 5 THEN mode END AS mode FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) x LEFT JOIN b ON x.source = b.source""")
def sampled_language(spark, sf):
    return stats.mode_of_first(read(spark, sf, "documents").where("source is not null"), "source", "doc_id", "lang", 5, 5)


@query("SELECT event_type, date_diff('hour', TIMESTAMP '2024-01-01', ts) % 5 AS level, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS spread FROM events GROUP BY ALL")
def level_statistics(spark, sf):
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', date_trunc('HOUR', ts))")
    return read(spark, sf, "events").groupBy("event_type", (hour % 5).alias("level")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("spread"))


_LISTS = f"ls AS (SELECT doc_id, list_filter(string_split(lower(string_split(text, chr(10))[1]), '. '), lambda x: trim(x) <> '') AS a, list_filter(string_split(lower(string_split(text, chr(10))[2]), '. '), lambda x: trim(x) <> '') AS b FROM documents)"


@query(f"""WITH {_LISTS}, f AS (SELECT list_has_any(a, b) AS e,
list_has_any(list_transform(a, lambda x: list_filter(string_split(x, ' '), lambda w: w <> '')[1]), list_transform(b, lambda x: list_filter(string_split(x, ' '), lambda w: w <> '')[1])) AS f,
list_has_any(list_transform(a, lambda x: list_filter(string_split(x, ' '), lambda w: w <> '')[-1]), list_transform(b, lambda x: list_filter(string_split(x, ' '), lambda w: w <> '')[-1])) AS l,
list_has_any(list_filter(string_split(array_to_string(a, ' '), ' '), lambda w: w <> ''), list_filter(string_split(array_to_string(b, ' '), ' '), lambda w: w <> '')) AS s FROM ls)
SELECT count(*) FILTER (WHERE e) AS exact, count(*) FILTER (WHERE f) AS first_word, count(*) FILTER (WHERE l) AS last_word, count(*) FILTER (WHERE s) AS any_word, count(*) AS n FROM f""")
def match_rates(spark, sf):
    """Sentences of the first two lines as two lists of terms."""
    phrases = lambda i: F.filter(F.split(F.lower(F.get(F.split("text", "\n"), F.lit(i))), r"\. "), lambda x: F.trim(x) != "")
    rows = read(spark, sf, "documents").select(phrases(0).alias("a"), phrases(1).alias("b"))
    rows = rows.select(*[c.alias(k) for k, c in stats.match_rates(F.col("a"), F.col("b")).items()])
    return rows.agg(*[F.count_if(k).alias(k) for k in ("exact", "first_word", "last_word", "any_word")], F.count("*").alias("n"))


@query("SELECT user_id, event_type AS last_event, event_type = 'purchase' AS finished FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def last_line(spark, sf):
    last = read(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"))
    return last.withColumn("finished", F.col("last_event") == "purchase")


@query("SELECT conv_id, turn, round(turn / count(*) OVER (PARTITION BY conv_id)::DOUBLE, 9) AS place FROM conversations")
def relative_place(spark, sf):
    c = read(spark, sf, "conversations")
    return c.join(c.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id").select("conv_id", "turn", F.round(F.col("turn") / F.col("n"), 9).alias("place"))


# lists and samples


@query("SELECT conv_id, list_sort(list_filter(range(0, max(turn) + 3), lambda i: NOT list_contains(list(turn), i))) AS missing FROM conversations GROUP BY conv_id")
def complement_set(spark, sf):
    """Places up to a number that a set lacks."""
    per = read(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("held"), F.max("turn").alias("last"))
    return per.select("conv_id", F.array_except(F.sequence(F.lit(0).cast("long"), F.col("last") + 2), "held").alias("missing"))


@query("SELECT 'documents' AS origin, doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark UNION ALL SELECT 'talk', conv_id, length(text) FROM conversations")
def union_sources(spark, sf):
    """Training texts of three origins in one table."""
    of = lambda t, k: read(spark, sf, t).select(F.lit({"conversations": "talk"}.get(t, t)).alias("origin"), F.col(k).alias("id"), F.length("text").cast("long").alias("n"))
    return of("documents", "doc_id").unionByName(of("benchmark", "item_id")).unionByName(of("conversations", "conv_id"))


@query(f"WITH {_ALL_TALK}, e AS (SELECT conv_id, turn, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM talk), f AS (SELECT conv_id, turn, t, min(i) AS i FROM e GROUP BY ALL) SELECT conv_id, turn, string_agg(t, ' ' ORDER BY i) AS words FROM f GROUP BY ALL")
def distinct_list(spark, sf):
    return talk(spark, sf).where("size(w) > 0").select("conv_id", "turn", F.array_join(F.array_distinct("w"), " ").alias("words"))


@query(f"WITH {_ALL_TALK}, e AS (SELECT conv_id, turn, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM talk), p AS (SELECT t AS word, lead(t) OVER (PARTITION BY conv_id, turn ORDER BY i) AS next FROM e) SELECT word, count(DISTINCT next) AS n_next, min(next) AS least FROM p WHERE next IS NOT NULL GROUP BY word")
def next_word_dict(spark, sf):
    """word -> the words that follow it, as their number and the least."""
    pairs = talk(spark, sf).select(F.explode(T.next_words(F.col("w"))).alias("p")).groupBy("p.word").agg(F.collect_set("p.next").alias("after"))
    return pairs.select("word", F.size("after").cast("long").alias("n_next"), F.array_min("after").alias("least"))


@query("SELECT doc_id, source, row_number() OVER (ORDER BY coalesce(source, ''), doc_id)::INTEGER AS place FROM (SELECT doc_id, source FROM documents ORDER BY coalesce(source, ''), doc_id LIMIT 50)")
def sort_by_field(spark, sf):
    """The first records by a field that may be missing."""
    first = read(spark, sf, "documents").select("doc_id", "source").orderBy(F.coalesce("source", F.lit("")), "doc_id").limit(50)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce("source", F.lit("")), "doc_id")))


@query(f"SELECT doc_id FROM documents WHERE {queries._X} < 0.1")
def reduced_sample(spark, sf):
    return read(spark, sf, "documents").where(sampling.fraction(F.col("doc_id"), "s") < 0.1).select("doc_id")


@query("SELECT count(*) AS words, sum(CASE WHEN n > 50 THEN 1 ELSE 0 END)::BIGINT AS picked FROM (SELECT n, k FROM (SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS k FROM (" + f"WITH {_USES} SELECT term, count(*) AS n FROM uses GROUP BY term" + ")) WHERE k <= 50 OR k <= 500 AND k % 10 = 0)")
def level_words(spark, sf):
    """The first 50 words by count and then every tenth up to 500."""
    top = relational.top_counts(uses(spark, sf), "term", 500).withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "term")))
    return top.where("k <= 50 or k % 10 = 0").agg(F.count("*").alias("words"), F.count_if(F.col("n") > 50).alias("picked"))


# text


@query("SELECT conv_id, turn, regexp_replace(text || ' $x^2$ and $y$', '\\$[^$]*?\\$', '_inline_math_', 'g') AS text FROM conversations")
def math_removed(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", T.remove_math(F.concat("text", F.lit(" $x^2$ and $y$"))).alias("text"))


@query("SELECT page_id, len(regexp_extract_all(html, '\"([^\"]+)\"', 1)) AS n, regexp_extract_all(html, '\"([^\"]+)\"', 1)[1] AS first FROM pages")
def quoted_terms(spark, sf):
    found = T.quoted_terms(F.col("html"))
    return read(spark, sf, "pages").select("page_id", F.size(found).cast("long").alias("n"), F.get(found, F.lit(0)).alias("first"))


@query("""SELECT doc_id, lang, source, n_chars // 1000 AS size FROM documents""")
def planet_metadata(spark, sf):
    """Commands written into a text, then read back as a map of lists."""
    d = read(spark, sf, "documents").withColumn("size", F.expr("n_chars div 1000"))
    entry = F.concat(*[x for k in ("lang", "source", "size") for x in (F.lit("text \\pm" + k + "{"), F.coalesce(F.col(k).cast("string"), F.lit("-")), F.lit("}\n"))])
    m = T.metadata_map(entry)
    value = lambda k: F.nullif(F.get(F.element_at(m, F.lit(f"pm{k}")), F.lit(0)), F.lit("-"))
    return d.select("doc_id", value("lang").alias("lang"), value("source").alias("source"), value("size").cast("long").alias("size"))


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def metadata_types(spark, sf):
    """Counts of a command's value over texts that give it exactly once."""
    text = F.concat(F.lit("\\pmtype{"), F.col("lang"), F.lit("} text"))
    kinds = read(spark, sf, "documents").where("lang is not null").select(F.element_at(T.metadata_map(text), F.lit("pmtype")).alias("k"))
    return kinds.where(F.size("k") == 1).groupBy(F.get("k", F.lit(0)).alias("lang")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, string_split(text, chr(10))[1] AS body FROM documents WHERE string_split(text, chr(10))[1] <> ''")
def definition_sections(spark, sf):
    """A page with a definition section made of each document's first line, read back."""
    first = F.get(F.split("text", "\n"), F.lit(0))
    page = F.concat(F.lit("intro\n\n== Definition ==\n"), first, F.lit("\n\n== History ==\nold"))
    return read(spark, sf, "documents").where(first != "").select("doc_id", F.get(T.definition_section(page), F.lit(0)).alias("body"))


@query(f"WITH {_ALL_TALK} SELECT conv_id, turn, array_to_string(list_filter(w, lambda x: x NOT IN ('the', 'la', 'der', 'de', 'et', 'und', 'and', 'of')), ' ') AS words FROM talk")
def stop_words_removed(spark, sf):
    from pyspark.ml.feature import StopWordsRemover

    out = StopWordsRemover(inputCol="w", outputCol="kept", stopWords=["the", "la", "der", "de", "et", "und", "and", "of"]).transform(talk(spark, sf))
    return out.select("conv_id", "turn", F.array_join("kept", " ").alias("words"))


@query(f"WITH {_ALL_TALK} SELECT conv_id, turn, array_to_string(list_transform(range(1, 21), lambda i: CASE WHEN i <= len(w) THEN length(w[i]) ELSE 0 END), ',') AS ids FROM talk")
def padded_ids(spark, sf):
    """Word numbers (here: lengths) cut or filled to twenty."""
    ids = T.pad_to(F.transform("w", lambda x: F.length(x)), 20, 0)
    return talk(spark, sf).select("conv_id", "turn", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT doc_id, count(*) FILTER (WHERE regexp_matches(w, '^[A-Z]')) AS capitals, count(*) FILTER (WHERE contains(w, '-')) AS dashes FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY doc_id")
def shape_flags(spark, sf):
    words = read(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w")).select("doc_id", T.shape_flags(F.col("w")).alias("f"))
    return words.groupBy("doc_id").agg(F.count_if("f.capital").alias("capitals"), F.count_if("f.dash").alias("dashes"))


@query("SELECT len(string_split(line, ' '))::INTEGER AS words, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY ALL")
def words_per_line(spark, sf):
    lines = read(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(F.size(F.split("line", " ")).alias("words")).agg(F.count("*").alias("n"))


@query("SELECT url, regexp_extract(url, '^(https?)://', 1) AS year, regexp_extract(url, '/([^/?#]+)(?:[?#].*)?$', 1) AS stem FROM pages")
def path_parts(spark, sf):
    url = F.col("url")
    return read(spark, sf, "pages").select("url", F.regexp_extract(url, "^(https?)://", 1).alias("year"), F.regexp_extract(url, r"/([^/?#]+)(?:[?#].*)?$", 1).alias("stem"))


# tagged sentences


def _pieces(spark, sf):
    """Sub-tokens: words of over four letters are cut behind the fourth; the label of a piece is B, I or O by the word's length."""
    label = lambda x: F.when(F.length(x) % 4 == 0, "B").when(F.length(x) % 4 == 1, "I").otherwise("O")
    both = lambda x: F.when(F.length(x) > 4, F.array(F.struct(F.left(x, F.lit(4)).alias("word"), label(x).alias("label")), F.struct(F.concat(F.lit("##"), F.substring(x, 5, 1000)).alias("word"), F.lit("O").alias("label")))).otherwise(F.array(F.struct(x.alias("word"), label(x).alias("label"))))
    special = F.array(F.struct(F.lit("[CLS]").alias("word"), F.lit("O").alias("label")))
    return talk(spark, sf).where("size(w) > 0").select("conv_id", "turn", "w", F.concat(special, F.flatten(F.transform("w", both)), special).alias("pieces"))


@query(f"WITH {_ALL_TALK} SELECT conv_id, turn, array_to_string(list_transform(w, lambda x: x || '/' || CASE length(x) % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'I' ELSE 'O' END), ' ') AS words FROM talk WHERE len(w) > 0")
def merged_subtokens(spark, sf):
    rows = _pieces(spark, sf).select("conv_id", "turn", ner.merge_subtokens(F.col("pieces")).alias("m"))
    return rows.select("conv_id", "turn", F.array_join(F.transform("m", lambda x: F.concat(x["word"], F.lit("/"), x["label"])), " ").alias("words"))


@query(f"""WITH {_ALL_TALK}, e AS (SELECT conv_id, turn, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM talk), l AS (SELECT *, CASE length(t) % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'I' ELSE 'O' END AS g FROM e),
b AS (SELECT *, g = 'B' OR g = 'I' AND coalesce(lag(g) OVER (PARTITION BY conv_id, turn ORDER BY i), 'O') = 'O' AS begins FROM l), r AS (SELECT *, sum(begins::INTEGER) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM b),
p AS (SELECT DISTINCT conv_id, turn, phrase FROM (SELECT conv_id, turn, run, string_agg(t, ' ' ORDER BY i) AS phrase FROM r WHERE g <> 'O' GROUP BY ALL)) SELECT conv_id, turn, phrase FROM p""")
def cropped_terms(spark, sf):
    return _pieces(spark, sf).select("conv_id", "turn", F.explode(ner.cropped_terms(F.col("pieces"))).alias("phrase"))


@query(f"WITH {_ALL_TALK} SELECT conv_id, turn, array_to_string(list_concat(w[1:1], ['_inline_math_'], w[2:]), ' ') AS words FROM talk WHERE len(w) > 0")
def merged_markers(spark, sf):
    """A marker's five parts put behind each turn's first word, joined again."""
    parts = F.array(*map(F.lit, ner.MARKER))
    words = F.concat(F.slice("w", 1, 1), parts, F.slice("w", F.lit(2), F.size("w")))
    rows = talk(spark, sf).where("size(w) > 0").select("conv_id", "turn", F.transform(words, lambda x: F.struct(x.alias("word"), F.lit("O").alias("label"))).alias("p"))
    return rows.select("conv_id", "turn", F.array_join(F.transform(ner.merge_marker(F.col("p")), lambda x: x["word"]), " ").alias("words"))


@query(f"WITH {_ALL_TALK} SELECT conv_id, turn, array_to_string(list_transform(w, lambda x: x || '/' || CASE length(x) % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'I' ELSE 'O' END), ' ') AS words FROM talk WHERE len(w) > 0")
def aligned_to_gold(spark, sf):
    """Pieces without their marks, run together until they are the gold words."""
    rows = _pieces(spark, sf)
    bare = F.transform(F.filter("pieces", lambda p: p["word"] != "[CLS]"), lambda p: F.struct(F.regexp_replace(p["word"], "^##", "").alias("word"), p["label"].alias("label")))
    out = rows.select("conv_id", "turn", ner.align(bare, F.col("w")).alias("m"))
    return out.select("conv_id", "turn", F.array_join(F.transform("m", lambda x: F.concat(x["word"], F.lit("/"), x["label"])), " ").alias("words"))


def _tags_sql(test: str) -> str:
    return f"WITH {_ALL_TALK} SELECT conv_id, turn, array_to_string(list_transform(w, lambda x: CASE WHEN {test} THEN 'B' ELSE 'O' END), '') AS tags FROM talk"


@query(_tags_sql("starts_with(x, 'en')"))
def tagged_by_prefix(spark, sf):
    return talk(spark, sf).select("conv_id", "turn", F.array_join(ner.title_tags(F.col("w"), F.lit("En")), "").alias("tags"))


@query(_tags_sql("x = 'en'"))
def tagged_exactly(spark, sf):
    return talk(spark, sf).select("conv_id", "turn", F.array_join(ner.title_tags(F.col("w"), F.lit("En"), True), "").alias("tags"))


@query("""WITH s AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM conversations),
e AS (SELECT conv_id, turn, generate_subscripts(s, 1) - 1 AS sent_no, unnest(s) AS t FROM s)
SELECT conv_id, turn, sent_no::INTEGER AS sent_no, len(regexp_split_to_array(t, '\\s+'))::INTEGER AS n, array_to_string(list_transform(regexp_split_to_array(t, '\\s+'), lambda x: CASE WHEN starts_with(lower(x), 'la') THEN 'B' ELSE 'O' END), '') AS tags FROM e WHERE contains(lower(t), 'la')""")
def tagged_sentences(spark, sf):
    rows = read(spark, sf, "conversations").withColumn("title", F.lit("La"))
    return ner.tagged_sentences(rows, "text", "title", "conv_id", "turn").select("conv_id", "turn", "sent_no", F.size("words").alias("n"), F.array_join("tags", "").alias("tags"))


_CUTS = f"""WITH {_ALL_TALK}, e AS (SELECT conv_id * 1000 + turn AS s, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM talk),
f AS (SELECT s, i, length(t) >= 6 AS g, (length(t) * 10 + i % 7) / 100.0::DOUBLE AS score FROM e) """


def _gold(spark, sf):
    rows = talk(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("s"), F.posexplode("w").alias("i", "t")).withColumn("i", F.col("i") + 1)
    return rows.select("s", "i", (F.length("t") >= 6).alias("g"), ((F.length("t") * 10 + F.col("i") % 7) / F.lit(100.0)).alias("score"))


def _chunks(rows, flag):
    return ner.spans(sequences.bio_tags(rows.withColumn("flag", flag), "s", "i", "flag"), "s", "i", "bio")


_SPANS = "(SELECT s, min(i) AS start, count(*) AS n FROM (SELECT s, i, i - row_number() OVER (PARTITION BY s ORDER BY i) AS r FROM f WHERE {0}) GROUP BY s, r)"


@query(_CUTS + f""", a AS {_SPANS.format('g')}, b AS {_SPANS.format('score > 0.62')}, m AS (SELECT count(*) FILTER (WHERE a.s IS NOT NULL AND b.s IS NOT NULL) AS n_both, count(*) FILTER (WHERE b.s IS NULL) AS n_left, count(*) FILTER (WHERE a.s IS NULL) AS n_right
FROM a FULL JOIN b ON a.s = b.s AND a.start = b.start AND a.n = b.n) SELECT *, round(n_both / (n_both + n_right)::DOUBLE, 9) AS precision, round(n_both / (n_both + n_left)::DOUBLE, 9) AS recall, round(2 * n_both / (2 * n_both + n_left + n_right)::DOUBLE, 9) AS f1 FROM m""")
def chunk_score(spark, sf):
    rows = _gold(spark, sf)
    out = ner.chunk_score(_chunks(rows, F.col("g")), _chunks(rows, F.col("score") > 0.62), ["s", "start", "n"])
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(_CUTS + """SELECT round(avg((g = (score > 0.62))::INTEGER), 9) AS accuracy, count(*) AS n FROM f WHERE i % 5 <> 0""")
def tag_accuracy(spark, sf):
    """Share of words with the right tag, those with an ignored label left out."""
    rows = _gold(spark, sf).withColumn("label", F.when(F.col("i") % 5 == 0, -100).otherwise(F.col("g").cast("int")))
    return rows.where("label <> -100").agg(F.round(F.avg((F.col("label") == (F.col("score") > 0.62).cast("int")).cast("double")), 9).alias("accuracy"), F.count("*").alias("n"))


@query(_CUTS + ", ".join(["", *(f"p{k} AS (SELECT {k} AS cut, * FROM {_SPANS.format(f'score > {k} / 10.0::DOUBLE')})" for k in range(1, 10))]) + f""", a AS {_SPANS.format('g')}, p AS ({' UNION ALL '.join(f'SELECT * FROM p{k}' for k in range(1, 10))}),
t AS (SELECT cut, count(a.s) AS tp, count(*) AS called FROM p LEFT JOIN a ON a.s = p.s AND a.start = p.start AND a.n = p.n GROUP BY cut)
SELECT cut, round(2 * tp / (called + (SELECT count(*) FROM a))::DOUBLE, 9) AS f1 FROM t ORDER BY round(2 * tp / (called + (SELECT count(*) FROM a))::DOUBLE, 9) DESC, cut LIMIT 1""")
def best_chunk_cut(spark, sf):
    """The tenth above which chunks have the best F1: one pass for all cuts."""
    rows = _gold(spark, sf)
    tried = rows.crossJoin(F.broadcast(spark.range(1, 10).select(F.col("id").cast("int").alias("cut")))).withColumn("k", F.col("s") * 10 + F.col("cut"))
    tagged = sequences.bio_tags(tried.withColumn("flag", F.col("score") > F.col("cut") / F.lit(10.0)), "k", "i", "flag")
    guessed = ner.spans(tagged, "k", "i", "bio").select((F.col("k") % 10).cast("int").alias("cut"), F.expr("k div 10").alias("s"), "start", "n")
    gold = _chunks(rows, F.col("g"))
    met = guessed.join(gold.withColumn("hit", F.lit(1)), ["s", "start", "n"], "left").groupBy("cut").agg(F.count("hit").alias("tp"), F.count("*").alias("called"))
    f1 = F.round(2 * F.col("tp") / (F.col("called") + F.col("all_gold")), 9)
    return met.crossJoin(F.broadcast(gold.agg(F.count("*").alias("all_gold")))).select("cut", f1.alias("f1")).orderBy(F.desc("f1"), "cut").limit(1)


@query(_CUTS + f""", r AS (SELECT s, i, score, i - row_number() OVER (PARTITION BY s ORDER BY i) AS r FROM f WHERE g) SELECT s, min(i)::BIGINT * 10 AS start, max(i)::BIGINT * 10 + 9 AS stop, round(avg(score), 9) AS score FROM r GROUP BY s, r""")
def span_scores(spark, sf):
    rows = _gold(spark, sf).withColumn("word", F.lit("w"))
    tagged = sequences.bio_tags(rows, "s", "i", "g").withColumns({"prob": F.col("score"), "begin": F.col("i").cast("long") * 10, "end": F.col("i").cast("long") * 10 + 9})
    return ner.span_scores(tagged, "s", "i", "bio").select("s", "start", "stop", F.round("score", 9).alias("score"))


@query(f"""WITH {_ALL_TALK} SELECT conv_id, turn, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN length(w[i]) <= 5 THEN 'O' WHEN i > 1 AND length(w[i - 1]) > 5 THEN 'I' ELSE 'B' END), '') AS tags FROM talk""")
def tags_from_scores(spark, sf):
    """Scores padded to a fixed length, made into tags of the sentence's words."""
    scores = T.pad_to(F.transform("w", lambda x: F.length(x) / F.lit(10.0)), 2000, 0.0)
    return talk(spark, sf).select("conv_id", "turn", F.array_join(ner.tagged_by_score(F.col("w"), scores, 0.5), "").alias("tags"))


@query(f"""WITH {_ALL_TALK}, e AS (SELECT conv_id, turn, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS t FROM talk)
SELECT conv_id, turn, i::INTEGER AS i, lag(t, 1) OVER o AS prev_1, lag(t, 3) OVER o AS prev_3, lead(t, 2) OVER o AS next_2, NOT regexp_matches(t, '[^\\x00-\\x7f]') AS ascii FROM e WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i)""")
def chunk_features(spark, sf):
    rows = talk(spark, sf).select("conv_id", "turn", F.posexplode("w").alias("i", "t")).withColumn("s", F.struct("conv_id", "turn"))
    return ner.window_features(rows, "s", "i", "t").select("conv_id", "turn", "i", "prev_1", "prev_3", "next_2", "ascii")


@query(f"""WITH {_ALL_TALK}, e AS (SELECT conv_id, turn, unnest(w) AS t FROM talk) SELECT conv_id, string_agg(DISTINCT t, ',' ORDER BY t) AS terms FROM e WHERE length(t) > 9 GROUP BY conv_id""")
def regrouped_terms(spark, sf):
    """Terms of sentences gathered back under their definition."""
    rows = talk(spark, sf).select("conv_id", F.explode("w").alias("t")).where(F.length("t") > 9)
    return rows.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("terms"))


# graphs


_WALK = f"WITH RECURSIVE {queries._EDGES}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) "


@query(_WALK + "SELECT src, dst FROM r")
def graph_closure(spark, sf):
    return graph.closure(queries._edges(spark, sf))


_TREE = "e AS (SELECT DISTINCT o_custkey AS src, o_custkey // 3 AS dst FROM orders WHERE o_custkey > 0 UNION SELECT o_custkey // 3, o_custkey // 9 FROM orders WHERE o_custkey >= 3 UNION SELECT o_custkey // 9, o_custkey FROM orders WHERE o_custkey % 5 = 0 AND o_custkey >= 9)"


def _tree(spark, sf):
    """Edges that grow with the input: each customer to a third of its number and that to a third of its own, some back."""
    k = read(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()
    one = k.where("k > 0").selectExpr("k AS src", "k div 3 AS dst")
    two = k.where("k >= 3").selectExpr("k div 3 AS src", "k div 9 AS dst")
    return one.union(two).union(k.where("k % 5 = 0 and k >= 9").selectExpr("k div 9 AS src", "k AS dst")).distinct()


@query(f"WITH RECURSIVE {_TREE}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM e WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM r WHERE r.src = e.dst AND r.dst = e.src)")
def graph_dag(spark, sf):
    return graph.acyclic(_tree(spark, sf))


@query(f"WITH RECURSIVE {_TREE}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT node, greatest(node, coalesce((SELECT max(a.dst) FROM r a JOIN r b ON a.dst = b.src AND a.src = b.dst WHERE a.src = node), node)) AS component FROM n")
def graph_components(spark, sf):
    """Customers that reach one another share a component."""
    return graph.strong_components(_tree(spark, sf))


@query(f"WITH RECURSIVE {_TREE}, r(src, dst) AS (SELECT src, dst FROM e WHERE src % 50 = 0 UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src AS node, dst AS descendant FROM r WHERE src <> dst")
def graph_descendants(spark, sf):
    edges = _tree(spark, sf)
    return graph.descendants(edges, edges.select(F.col("src").alias("node")).where("node % 50 = 0"))


@query(f"WITH RECURSIVE {_TREE}, r(dst, src) AS (SELECT dst, src FROM e WHERE dst % 50 = 0 UNION SELECT r.dst, e.src FROM r JOIN e ON r.src = e.dst) SELECT dst AS node, src AS ancestor FROM r WHERE src <> dst")
def graph_ancestors(spark, sf):
    edges = _tree(spark, sf)
    return graph.ancestors(edges, edges.select(F.col("dst").alias("node")).where("node % 50 = 0"))


@query(f"WITH RECURSIVE {_TREE.split(' UNION SELECT o_custkey // 9')[0]}), r(node, level) AS (SELECT src, 0 FROM e UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node WHERE e.src <> e.dst) SELECT node, max(level)::INTEGER AS level FROM r GROUP BY node")
def graph_levels(spark, sf):
    k = read(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()
    edges = k.where("k > 0").selectExpr("k AS src", "k div 3 AS dst").union(k.where("k >= 3").selectExpr("k div 3 AS src", "k div 9 AS dst")).where("src <> dst").distinct()
    return graph.levels(edges)


@query(f"""WITH {_TREE}, u AS (SELECT src, dst FROM e WHERE src <> dst), b AS (SELECT src AS a, dst AS b FROM u UNION ALL SELECT dst, src FROM u), w AS (SELECT a, b, count(*) AS w FROM b GROUP BY ALL),
d AS (SELECT a AS node, sum(w) AS d, count(*) FILTER (WHERE w = 2) AS r FROM w GROUP BY a), t AS (SELECT x.a AS node, sum(x.w * y.w * z.w) / 2.0::DOUBLE AS t FROM w x JOIN w y ON y.a = x.b JOIN w z ON z.a = y.b AND z.b = x.a WHERE y.b <> x.a GROUP BY x.a)
SELECT d.node, round(CASE WHEN d * (d - 1) - 2 * r > 0 THEN coalesce(t, 0) / (d * (d - 1) - 2 * r)::DOUBLE ELSE 0 END, 9) AS coefficient FROM d LEFT JOIN t USING (node)""")
def graph_clustering(spark, sf):
    return graph.clustering_coefficient(_tree(spark, sf)).withColumn("coefficient", F.round("coefficient", 9))


@query(f"""WITH RECURSIVE {queries._EDGES}, r(src, dst, dist) AS (SELECT src, dst, 1 FROM e UNION SELECT r.src, e.dst, r.dist + 1 FROM r JOIN e ON r.dst = e.src WHERE r.dist < 25), m AS (SELECT src, dst, min(dist) AS dist FROM r WHERE src <> dst GROUP BY src, dst),
q AS (SELECT n_nationkey::BIGINT AS a, (n_nationkey + 5) % 25 AS b, (n_nationkey + 11) % 25 AS c, (n_nationkey + 18) % 25 AS d FROM nation),
x AS (SELECT a AS quad, (SELECT coalesce(max(dist), 5) FROM m WHERE src = a AND dst = b) + (SELECT coalesce(max(dist), 5) FROM m WHERE src = c AND dst = d) AS p, (SELECT coalesce(max(dist), 5) FROM m WHERE src = a AND dst = c) + (SELECT coalesce(max(dist), 5) FROM m WHERE src = b AND dst = d) AS q,
(SELECT coalesce(max(dist), 5) FROM m WHERE src = a AND dst = d) + (SELECT coalesce(max(dist), 5) FROM m WHERE src = b AND dst = c) AS r FROM q)
SELECT quad, (list_sort([p, q, r])[3] - list_sort([p, q, r])[2]) / 2.0::DOUBLE AS delta FROM x""")
def graph_hyperbolicity(spark, sf):
    key = F.col("n_nationkey").cast("long")
    quads = read(spark, sf, "nation").select(key.alias("quad"), key.alias("a"), ((key + 5) % 25).alias("b"), ((key + 11) % 25).alias("c"), ((key + 18) % 25).alias("d"))
    return graph.hyperbolicity(quads, graph.distances(queries._edges(spark, sf)))


@query()
def graph_mean_hyperbolicity(spark, sf):
    """The mean over 200 drawn quadruples of the customer graph; the draw has no SQL, a test holds it against plain distances."""
    return graph.mean_hyperbolicity(_tree(spark, sf), 200)


@query(f"""WITH RECURSIVE {_TREE.split(' UNION SELECT o_custkey // 9')[0]}), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
n AS (SELECT DISTINCT src AS a, (src * 7 + 11) % 1000 AS b FROM e) SELECT src, dst, 1 AS label FROM e WHERE src <> dst UNION ALL SELECT a, b, 0 FROM n WHERE a <> b AND NOT EXISTS (SELECT 1 FROM r WHERE r.src = a AND r.dst = b)""")
def pair_samples(spark, sf):
    """Pairs of a hierarchy with label 1, and for each node a drawn one that it doesn't reach with label 0."""
    k = read(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()
    edges = k.where("k > 0").selectExpr("k AS src", "k div 3 AS dst").union(k.where("k >= 3").selectExpr("k div 3 AS src", "k div 9 AS dst")).distinct()
    drawn = edges.select("src", ((F.col("src") * 7 + 11) % 1000).alias("dst")).distinct().where("src <> dst")
    # Only paths from the drawn nodes are followed, along a hierarchy that is a few levels deep.
    none = drawn.join(graph.descendants(edges, drawn.select(F.col("src").alias("node"))).toDF("src", "dst"), ["src", "dst"], "left_anti")
    return edges.where("src <> dst").withColumn("label", F.lit(1)).union(none.withColumn("label", F.lit(0)))


NAMES = [n for n in QUERIES if n not in _before]
