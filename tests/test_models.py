"""Hierarchy scores, kernel and neighbour classifiers against plain versions on small cases."""

import math
import random

from pyspark.sql import functions as F

from lexiforge.operators import hyperbolic as H
from lexiforge.operators import kernels


def complex_pairs(vec):
    return [complex(vec[i], vec[i + 1]) for i in range(0, len(vec) - 1, 2)]


def plain_gaussians(rows, scale):
    """Discs as complex numbers: Moebius addition is (a + b) / (1 + conj(a) b), the half-plane map i (1 + w) / (1 - w) of w = z / i."""
    scaled = {k: ([p if abs(p) == 0 else p / abs(p) * math.tanh(scale * math.atanh(abs(p))) for p in complex_pairs(v)], kind) for k, v, kind in rows}
    chosen = [p for p, kind in scaled.values() if kind]
    mean = [sum(c) / len(chosen) for c in zip(*chosen)]
    centred = {k: [(z - m) / (1 - m.conjugate() * z) for z, m in zip(p, mean)] for k, (p, _) in scaled.items()}
    top = [centred[k] for k, (_, kind) in scaled.items() if kind == "top"]
    turned = {}
    for k, p in centred.items():
        up = [sum(c) for c in zip(*top)]
        # x of the mean is the sine, y the cosine: the mean goes to the positive imaginary axis.
        p = [z * complex(u.imag, u.real) / abs(u) for z, u in zip(p, up)]
        plane = [complex(2 * z.real, 1 - abs(z) ** 2) / (z.real**2 + (1 - z.imag) ** 2) for z in p]
        turned[k] = [(z.real / math.sqrt(2), z.imag) for z in plane]
    return turned


def drawn(n, seed=3):
    rng = random.Random(seed)
    return [(i, [rng.uniform(-0.6, 0.6) for _ in range(6)], ("top", "low", None)[i % 3]) for i in range(n)]


def test_gaussians(spark):
    rows = drawn(20)
    df = spark.createDataFrame(rows, "id int, v array<double>, kind string")
    made = {r["id"]: [(p["x"], p["y"]) for p in r["g"]] for r in H.gaussians(df, "id", "v", F.col("kind") == "top", F.col("kind") == "low", 0.7).collect()}
    want = plain_gaussians(rows, 0.7)
    assert made.keys() == want.keys()
    for k in want:
        assert all(math.isclose(a, b, abs_tol=1e-9) for p, q in zip(made[k], want[k]) for a, b in zip(p, q))


def test_gaussian_scores(spark):
    two = plain_gaussians(drawn(2 * 3), 0.7)
    a, b = two[0], two[1]
    df = spark.createDataFrame([(a, b)], "a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>")
    x, y = F.col("a"), F.col("b")
    got = df.select(H.negative_kl(x, y), H.fisher(x, y), H.log_overlap(x, y, 1.5), H.is_a(x, y), H.negative_kl(x, x), H.fisher(x, x)).first()
    kl = -sum(math.log(t / s) + (s * s + (m - n) ** 2) / (2 * t * t) - 0.5 for (m, s), (n, t) in zip(a, b))
    # Distance in the half-plane by the other closed form: 2 artanh |z - w| / |z - conj w|.
    fisher = math.sqrt(2 * sum((2 * math.atanh(abs(complex(m - n, s - t)) / abs(complex(m - n, s + t)))) ** 2 for (m, s), (n, t) in zip(a, b)))
    overlap = math.prod(max(0, min(m + 1.5 * s, n + 1.5 * t) - max(m - 1.5 * s, n - 1.5 * t)) for (m, s), (n, t) in zip(a, b))
    volume = sum(math.log(t / s) for (_, s), (_, t) in zip(a, b))
    for found, want in zip(got, (kl, fisher, math.log(1e-10 + overlap), volume, 0.0, 0.0)):
        assert math.isclose(found, want, rel_tol=1e-7, abs_tol=1e-6)


def test_discs_edges(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0, 0.3]), (2, None), (3, [])], "id int, v array<double>")
    got = {r["id"]: r["p"] for r in df.select("id", H.mobius_scale(H.points(F.col("v")), 2.0).alias("p")).collect()}
    assert got[2] is None and got[3] == [] and [tuple(p) for p in got[1]] == [(0.0, 0.0)]
    back = spark.createDataFrame([([0.3, -0.2],)], "v array<double>").select(H.flat(H.mobius_add(H.negative(H.points(F.col("v"))), H.points(F.col("v")))).alias("v")).first()["v"]
    assert all(abs(c) < 1e-12 for c in back)
    assert H.gaussians(df, "id", "v", F.col("id") == 9, F.col("id") == 9).count() == 0


def ring(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        r, t = (rng.uniform(0, 0.8), 0) if i % 2 else (rng.uniform(1.2, 2), 1)
        at = rng.uniform(0, 2 * math.pi)
        out.append((i, [r * math.cos(at), r * math.sin(at)], t))
    return out


def test_kernel_on_a_ring(spark):
    df = spark.createDataFrame([*ring(600), (900, None, 1), (901, [1.0], 1), (902, [math.nan, 1.0], 0), (903, [0.0, 0.0], None)], "id int, v array<double>, label int")
    fitted = kernels.KernelClassifier(2, gamma=1.0, width=200).fit(df.where("id % 4 <> 0"), "v", "label")
    out = fitted.scored(df.where("id % 4 = 0 or id > 800"), "v").collect()
    assert {900, 901, 902}.isdisjoint(r["id"] for r in out)
    right = [r["label"] == r["prediction"] for r in out if r["id"] < 600]
    assert len(right) == 150 and sum(right) / len(right) > 0.97
    # A linear one can't do better than the larger class by much.
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    line = df.where("id < 600").withColumn("f", array_to_vector("v"))
    plain = LogisticRegression(featuresCol="f").fit(line.where("id % 4 <> 0")).transform(line.where("id % 4 = 0"))
    assert plain.where("label = prediction").count() / 150 < 0.75


def test_fourier_products_are_the_kernel(spark):
    rows = [(i, v) for i, v, _ in ring(12)]
    df = spark.createDataFrame(rows, "id int, v array<double>").select("id", kernels.fourier(F.col("v"), 2, 0.5, 20000).alias("f"))
    f = {r["id"]: r["f"] for r in df.collect()}
    for i, v in rows:
        for j, w in rows:
            assert abs(sum(a * b for a, b in zip(f[i], f[j])) - math.exp(-0.5 * math.dist(v, w) ** 2)) < 0.05


def test_votes(spark):
    rows = ring(200) + [(1000, None, 1), (1001, [1.0], 1), (1002, [0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "id int, v array<double>, label int")
    asked = df.where("id % 10 = 0 and id < 200").select(F.col("id").alias("query"), F.col("v").alias("q"))
    got = {r["query"]: (r["prediction"], r["votes"]) for r in kernels.neighbour_votes(df.where("id % 10 <> 0 or id > 999"), "id", "v", "label", asked, 4).collect()}
    for q, v, _ in rows[:200:10]:
        near = sorted((math.dist(v, w), i, t) for i, w, t in rows[:200] if i % 10)[:4]
        ones = sum(t for _, _, t in near)
        assert got[q] == ((1, ones) if ones > 2 else (0, 4 - ones))


def test_kernel_features_are_made_once(spark):
    """The condition on the features once made them a second time, in a second Python process of each task."""
    df = spark.createDataFrame(ring(60), "id int, v array<double>, label int")
    fitted = kernels.KernelClassifier(2, gamma=1.0, width=20)
    assert fitted._with(df, "v")._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert fitted._with(df, "v").count() == 60


def test_neighbours_meet_in_blocks(spark, monkeypatch):
    """Blocks smaller than the rows, ties of copies, vectors of two lengths; no row of all pairs is made."""
    from lexiforge.operators import vectors

    rng = random.Random(5)
    vecs = [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(250)]
    rows = [(i, vecs[i % 250], i % 3) for i in range(300)] + [(1000 + i, [rng.uniform(-1, 1), 1.0], 1) for i in range(9)]
    df = spark.createDataFrame(rows, "id int, v array<double>, label int").repartition(3, "id")
    asked = df.where("id % 10 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    monkeypatch.setattr(vectors, "ROWS", 40)
    monkeypatch.setattr(vectors, "ASKED", 7)
    out = vectors.cosine_neighbours(df, "id", "v", asked, 6, digits=7)
    assert "Cartesian" not in out._jdf.queryExecution().optimizedPlan().toString() and out.schema["id"].dataType == df.schema["id"].dataType
    got = {}
    for r in out.collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"], r["score"]))
    votes = {r["query"]: (r["prediction"], r["votes"]) for r in kernels.neighbour_votes(df, "id", "v", "label", asked, 6).collect()}
    for q, v, _ in rows:
        if q % 10:
            continue
        same = [(i, w, t) for i, w, t in rows if len(w) == len(v)]
        want = sorted((-round(sum(a * b for a, b in zip(v, w)) / math.hypot(*v) / math.hypot(*w), 7), i) for i, w, _ in same)[:6]
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, -s) for s, i in want]
        tally = [t for _, _, t in sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i, t) for i, w, t in same)[:6]]
        best = min(set(tally), key=lambda t: (-tally.count(t), t))
        assert votes[q] == (best, tally.count(best))


def test_word_vectors_have_parts_by_words(spark, monkeypatch):
    """A part has at most `share` words, however many lists there are, and never fewer parts are made than asked for."""
    from lexiforge.operators import learning

    parts, plain = [], learning.Word2Vec
    monkeypatch.setattr(learning, "Word2Vec", lambda **given: parts.append(given["numPartitions"]) or plain(**given))
    df = spark.createDataFrame([(["a", "b", "c", "d"],)] * 30 + [(None,), ([],)], "tokens array<string>")
    for share in (1000, 50, 12):
        rows = learning.word_vectors(df, size=4, window=2, least=5, rounds=1, partitions=2, share=share).collect()
        assert {r.word for r in rows} == set("abcd") and all(len(r.vec) == 4 for r in rows)
    assert parts == [2, 3, 10]


def test_tokens_call_no_function_for_each_word(spark):
    from lexiforge.functions import text as T

    df = spark.createDataFrame([(" Ab, c2\u00e9-\u00df. ",), ("",), ("..",), (None,), ("x",)], "t string").select(T.tokens(F.col("t")).alias("w"))
    assert [r.w for r in df.collect()] == [["ab", "c2\u00e9", "\u00df"], [], [], None, ["x"]]
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_the_classifier_are_cut_once(spark, tmp_path, monkeypatch):
    """Only labelled documents are cut into words, once each, for training, scores and measures."""
    from pyspark.sql import functions as F

    from lexiforge.operators import learning
    from lexiforge.plans import extra

    words = ["alpha beta gamma delta", "kappa lambda sigma omega"]
    spark.createDataFrame([(i, f"{words[i % 2]} w{i}") for i in range(300)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    cut, tokens, whole = spark.sparkContext.accumulator(0), extra.T.tokens, learning.text_classifier
    monkeypatch.setattr(extra.T, "tokens", lambda text: tokens(F.udf(lambda x: (cut.add(1), x)[1], "string")(text)))
    monkeypatch.setattr(learning, "text_classifier", lambda: whole(maxIter=2))
    assert extra.clf_auc(spark, str(tmp_path)).first().auc == 1.0
    assert cut.value == 200
