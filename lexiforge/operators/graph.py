"""Directed term graphs: building, degrees, distances, reach, cycles and levels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lexiforge.operators.stored import Rounds


#: Words of a term by which it is first looked up.
ANCHOR = 3


def containment_edges(terms: DataFrame, definitions: DataFrame) -> DataFrame:
    """(src, dst): term src stands in the text of a definition of dst, which does not define src.

    terms (term, words), definitions (def_id, words, defines). The first ANCHOR words of a term, or all
    of a shorter one, meet the runs of as many words of all definitions by their hash; a definition's words
    then meet all that was found in it once, and decide.
    """
    width = F.least(F.size("words"), F.lit(ANCHOR))
    hashed = lambda at, w: F.xxhash64(F.lit(w), *[F.get("words", at + i) for i in range(w)])
    none = F.lit(0)
    heads = terms.where("size(words) > 0").select(F.col("term").alias("src"), F.col("words").alias("held"), F.coalesce(*[F.when(width == w, hashed(none, w)) for w in range(1, ANCHOR + 1)]).alias("h"), width.alias("width"))
    runs = definitions.select("def_id", F.lit(0).alias("at"), F.lit(None).cast("long").alias("h")).where("false")
    for w in sorted(r[0] for r in heads.select("width").distinct().collect()):  # of 1 to ANCHOR
        at = F.explode(F.sequence(F.lit(0), F.size("words") - w)).alias("at")
        runs = runs.union(definitions.where(F.size("words") >= w).select("def_id", "words", at).select("def_id", F.col("at") + 1, hashed(F.col("at"), w)))
    met = runs.join(heads, "h").groupBy("def_id", "src").agg(F.collect_set("at").alias("ats"), F.first("held").alias("held"))
    per = met.groupBy("def_id").agg(F.collect_list(F.struct("src", "held", "ats")).alias("found"))
    real = F.filter("found", lambda f: F.exists(f["ats"], lambda at: F.slice(F.col("words"), at, F.size(f["held"])) == f["held"]) & ~F.array_contains("defines", f["src"]))
    rows = definitions.join(per, "def_id").select("defines", F.explode(real).alias("f"))
    return rows.select(F.col("f.src").alias("src"), F.explode("defines").alias("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out, specificity): specificity is out minus in."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    out = ends.groupBy("x.node").agg(F.sum("x.i").alias("n_in"), F.sum("x.o").alias("n_out"))
    return out.withColumn("specificity", F.col("n_out") - F.col("n_in"))


def distances(edges: DataFrame, most: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst, dist) of all pairs with a path, of at most `most` edges if given, from all nodes or from those of `sources` (node).

    A round goes one edge further from the pairs that are new; each is saved, so none is worked out twice.
    """
    rounds = Rounds(edges.sparkSession, "distances")
    edges = rounds.save(edges.select("src", "dst").where("src <> dst").distinct())
    first = edges if sources is None else edges.join(sources.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    front = rounds.save(first.withColumn("dist", F.lit(1)))
    known, step = front, 1
    while (most is None or step < most) and not front.isEmpty():
        step += 1
        ahead = front.select("src", F.col("dst").alias("mid")).join(edges.withColumnsRenamed({"src": "mid"}), "mid").select("src", "dst").where("src <> dst").distinct()
        front = rounds.save(ahead.join(known, ["src", "dst"], "left_anti").withColumn("dist", F.lit(step)))
        known = known.union(front)
    return known


def bounded_distance(pairs: DataFrame, known: DataFrame, default: int = 5) -> DataFrame:
    return pairs.join(known, ["src", "dst"], "left").withColumn("dist", F.coalesce("dist", F.lit(default)))


def sinks(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def sources(edges: DataFrame) -> DataFrame:
    return sinks(reversed_edges(edges))


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of all pairs with a path, a node's path to itself included; paths double each round, so rounds are few. Every pair is a row: ask `strong_components` or `distances` from some sources where these do."""
    rounds = Rounds(edges.sparkSession, "closure")
    known = rounds.save(edges.select("src", "dst").distinct())
    count, before = known.count(), 0
    while count != before:
        longer = known.select("src", F.col("dst").alias("mid")).join(known.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        known = rounds.save(known.union(longer).distinct())
        rounds.keep(1)
        count, before = known.count(), count
    return known


#: Once no more edges are left, one task ends the search; more go another round.
FINISH = 100_000
#: Paths of two edges, for each edge, up to which cycles of three are looked for.
WEDGES = 20


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges left when nodes that no edge enters, or none leaves, are taken away."""
    edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    return edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def _components_of(edges: pd.DataFrame) -> pd.DataFrame:
    """(node, component) by one depth-first walk over a bounded number of edges; component is any node of it."""
    ahead: dict[int, list[int]] = {}
    for a, b in zip(edges["src"].tolist(), edges["dst"].tolist()):
        ahead.setdefault(a, []).append(b)
    order, low, open_, walk, out = {}, {}, [], [], {}
    for start in ahead:
        if start in order:
            continue
        walk.append((start, iter(ahead[start])))
        order[start] = low[start] = len(order)
        open_.append(start)
        while walk:
            node, rest = walk[-1]
            step = next(rest, None)
            if step is None:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == order[node]:
                    while node not in out:
                        out[open_.pop()] = node
            elif step not in order:
                order[step] = low[step] = len(order)
                open_.append(step)
                walk.append((step, iter(ahead.get(step, ()))))
            elif step not in out:
                low[node] = min(low[node], order[step])
    return pd.DataFrame({"node": list(out), "colour": list(out.values())}, dtype="int64")


def _coloured(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, f, b): the greatest colour of the nodes that reach a node, and of those it reaches, its own included."""
    state = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.xxhash64("node").alias("f"), F.xxhash64("node").alias("b"))
    total = None
    while True:
        on = edges.join(state.select(F.col("node").alias("src"), "f").hint("merge"), "src").select(F.col("dst").alias("node"), "f", F.lit(None).cast("long").alias("b"))
        back = edges.join(state.select(F.col("node").alias("dst"), "b").hint("merge"), "dst").select(F.col("src").alias("node"), F.lit(None).cast("long").alias("f"), "b")
        state = rounds.save(state.union(on).union(back).groupBy("node").agg(F.max("f").alias("f"), F.max("b").alias("b")))
        # Colours only grow, so their sum stands still when all do.
        before, total = total, state.agg(F.sum(F.col("f").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if before == total:
            return state


def _short_cycles(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, colour) of the nodes on cycles of two or three edges, cycles that share a node taken together; colour is a node of them.

    Paths of two edges are made only in graphs where they are no more than WEDGES for each edge.
    """
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    counts = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).agg(F.sum(F.col("o") * F.col("i")), F.sum("o")).first()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    links = edges.join(back.hint("merge"), ["src", "dst"], "left_semi")
    if counts[0] <= WEDGES * counts[1]:
        paths = edges.select(F.col("src").alias("a"), F.col("dst").alias("m")).join(edges.select(F.col("src").alias("m"), F.col("dst").alias("b")).hint("merge"), "m")
        closed = paths.join(edges.select(F.col("src").alias("b"), F.col("dst").alias("a")).hint("merge"), ["a", "b"], "left_semi")
        links = links.union(closed.select(F.col("a").alias("src"), F.col("m").alias("dst")))
    return _linked(rounds.save(links.distinct()), rounds)


def _linked(links: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, colour): the least node that links (src, dst) without direction lead to, by large and small stars, whose rounds are few on long chains too."""

    def downward(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct()

    now, before = rounds.save(downward(links)), None
    while before != (before := tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first())):
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = downward(both.where("dst > src").join(least.hint("merge"), "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")))
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        moved = large.join(least.hint("merge"), "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        now = rounds.save(downward(moved.union(least.select("src", F.col("m").alias("dst")))))
    return now.select(F.col("src").alias("node"), F.col("dst").alias("colour")).union(now.select(F.col("dst").alias("node"), F.col("dst").alias("colour"))).distinct()


def _renamed(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Edges between the colours of (node, colour), which a node without one is itself; those within a colour go."""
    for end in ("src", "dst"):
        edges = edges.join(of.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_c")).hint("merge"), end, "left").withColumn(end, F.coalesce(f"{end}_c", end))
    return edges.select("src", "dst").where("src <> dst").distinct()


def strong_components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """(node, component): nodes that reach one another share a component, the greatest of them; node and component are longs.

    Nodes at the ends, on no cycle, go. Cycles of two and three edges become one node each, as long as that
    takes away a tenth of the edges. What is then left goes by forward-backward colouring: nodes take
    the greatest hash of what reaches them and of what they reach. Where the two are one, that
    node and all of its colour are a component. Of the rest, ends of an edge with unlike colours
    share no component: such edges go, and what is left goes round again. The work of a step is a join on
    the edges left, dealt by node and not sent to the driver to be broadcast; nothing holds all pairs that are
    connected. At most `finish` edges left are ended by one depth-first walk, with the same components.
    """
    rounds = Rounds(edges.sparkSession, "components")
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    left = rounds.save(edges.where("src <> dst").distinct())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    found, drawn, count = None, [], left.count()

    def trimmed(left: DataFrame, count: int) -> tuple[DataFrame, int]:
        before = None
        while count > finish and (before is None or count < 0.9 * before):
            left = rounds.save(_trimmed(left))
            before, count = count, left.count()
        return left, count

    shrinks = True
    while count:
        left, count = trimmed(left, count)
        if shrinks and count > finish:
            drawn.append(rounds.save(_short_cycles(left, rounds)))
            left = rounds.save(_renamed(left, drawn[-1]))
            before, count = count, left.count()
            shrinks = count < 0.9 * before
            continue
        if count <= finish:
            part = rounds.save(left.groupBy().applyInPandas(_components_of, "node long, colour long"))
            found = part if found is None else found.union(part)
            break
        colours = _coloured(left, rounds)
        part = rounds.save(colours.where("f = b").select("node", F.col("f").alias("colour")))
        found = part if found is None else found.union(part)
        rest = colours.where("f <> b")
        left = left.join(rest.select(F.col("node").alias("src"), "f", "b").hint("merge"), "src").join(rest.select(F.col("node").alias("dst"), F.col("f").alias("f2"), F.col("b").alias("b2")).hint("merge"), "dst")
        left = rounds.save(left.where("f = f2 and b = b2").select("src", "dst"))
        count = left.count()
    if found is None and not drawn:
        return nodes.select("node", F.col("node").alias("component"))
    # A node goes by the name of the short cycles it lies on, that by the next ones', and by the walk's or the colours' in the end.
    named = nodes.select("node", F.col("node").alias("name"))
    for step in [*drawn, *([] if found is None else [_first_names(found)])]:
        named = named.join(step.select(F.col("node").alias("name"), "colour").hint("merge"), "name", "left").select("node", F.coalesce("colour", "name").alias("name"))
    named = rounds.save(named)
    most = named.groupBy("name").agg(F.max("node").alias("component"), F.count("*").alias("n")).where("n > 1")
    return named.join(most.hint("merge"), "name", "left").select("node", F.coalesce("component", "node").alias("component"))


def _first_names(found: DataFrame) -> DataFrame:
    """(node, colour) with one of its nodes as each colour, for hashes could meet the numbers of other nodes."""
    least = found.groupBy("colour").agg(F.min("node").alias("first"))
    return found.join(least.hint("merge"), "colour").select("node", F.col("first").alias("colour"))


def acyclic(edges: DataFrame) -> DataFrame:
    """Edges whose ends lie in no common cycle of any length: in different strong components. What is left has no cycle."""
    real = edges.where("src <> dst").distinct()
    of = strong_components(edges)
    real = real.join(of.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    return real.where("a <> b").select("src", "dst")


def levels(edges: DataFrame) -> DataFrame:
    """(node, level) of a graph without cycles: the length of the longest path to each node, so every edge goes up by one or more.

    A round passes on the levels that rose, and saves them. This layering is feasible, though not the one of least total height.
    """
    rounds = Rounds(edges.sparkSession, "levels")
    edges = rounds.save(edges.select("src", "dst").distinct())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.lit(0).alias("level"), F.lit(True).alias("new"))
    while True:
        raised = edges.join(nodes.where("new").select(F.col("node").alias("src"), "level"), "src").groupBy(F.col("dst").alias("node")).agg((F.max("level") + 1).alias("least"))
        both = nodes.join(raised, "node", "left")
        nodes = rounds.save(both.select("node", F.greatest("level", "least").alias("level"), F.coalesce(F.col("least") > F.col("level"), F.lit(False)).alias("new")))
        if nodes.where("new").isEmpty():
            return nodes.select("node", "level")


#: Members of a component that meet a pair in one task, and parts that the pairs of one component are dealt to.
PART, DEALT = 64, 16


def _members(pairs: DataFrame, end: str, of: DataFrame) -> DataFrame:
    """pairs with the components in column `end` each made the nodes of it; `of` (node, component).

    Both the nodes and the pairs of a component of many nodes are dealt to several tasks.
    """
    parts = of.groupBy("component").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts"), F.when(F.count("*") > 1, DEALT).otherwise(1).alias("dealt"))
    sized = of.join(parts.hint("merge"), "component").select(F.col("component").alias(end), F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("dealt") - 1)).alias("lot"), "node")
    asked = pairs.join(parts.withColumnRenamed("component", end), end).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    asked = asked.withColumn("lot", F.pmod(F.xxhash64(*pairs.columns), F.col("dealt")).cast("int")).drop("parts", "dealt")
    return asked.join(sized, [end, "part", "lot"]).drop("part", "lot", end).withColumnRenamed("node", end)


def reached(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(src, dst): all unlike pairs with a path from a node of `of` (node).

    Nodes that are no whole numbers go by `distances`. Of others, paths are followed between strong components, whose nodes all reach the same; only the result has
    a row for each pair of nodes.
    """
    rounds = Rounds(edges.sparkSession, "reached")
    kind = edges.schema["src"].dataType
    if not isinstance(kind, IntegralType):
        return distances(edges, sources=of).select("src", "dst")
    edges = rounds.save(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct())
    known = rounds.save(strong_components(edges))
    asked = rounds.save(known.join(of.select(F.col("node").cast("long").alias("node")).distinct(), "node", "left_semi").select("node", "component"))
    starts = asked.select(F.col("component").alias("node")).distinct()
    between = _renamed(edges, known.select("node", F.col("component").alias("colour")))
    far = distances(between, sources=starts).select("src", "dst").union(starts.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    # The end with more than one node for most pairs comes last; either may be first.
    pairs = _members(_members(rounds.save(far), "src", asked), "dst", known).where("src <> dst")
    return pairs.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"))


def ancestors(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(node, ancestor): all nodes with a path to a node of `of` (node); `descendants` of them along the reversed edges."""
    return reached(reversed_edges(edges), of).select(F.col("src").alias("node"), F.col("dst").alias("ancestor"))


def descendants(edges: DataFrame, of: DataFrame) -> DataFrame:
    return reached(edges, of).select(F.col("src").alias("node"), F.col("dst").alias("descendant"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def drawn_quadruples(nodes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(quad, a, b, c, d): `n` quadruples of nodes (node) drawn by hash, with at most 4 n distinct nodes, so that distances are needed from few sources only."""
    drawn = nodes.select("node", F.xxhash64(F.lit(seed), "node").alias("h")).orderBy("h", "node").limit(4 * n)
    # The 4 n drawn rows are numbered in one small task.
    placed = drawn.withColumn("at", F.row_number().over(Window.orderBy("h", "node")) - 1).withColumn("k", F.floor(F.col("at") / n).cast("int"))
    return placed.groupBy((F.col("at") % n).alias("quad")).pivot("k", [0, 1, 2, 3]).agg(F.first("node")).toDF("quad", "a", "b", "c", "d").where("d is not null")


def mean_hyperbolicity(edges: DataFrame, n: int, seed: int = 0, default: int = 5) -> DataFrame:
    """(quads, mean, most): over `n` drawn quadruples; distances are worked out from the drawn nodes only, to any depth."""
    rounds = Rounds(edges.sparkSession, "quadruples")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    quads = rounds.save(drawn_quadruples(nodes, n, seed))
    drawn = quads.select(F.explode(F.array("a", "b", "c", "d")).alias("node")).distinct()
    return hyperbolicity(quads, distances(edges, sources=drawn), default).agg(F.count("*").alias("quads"), F.avg("delta").alias("mean"), F.max("delta").alias("most"))


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """(node, coefficient) in a directed graph: closed directed triangles through a node by those its degrees allow, 2 (t / (d (d - 1) - 2 r)), r its mutual edges."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    weight = both.groupBy("a", "b").agg(F.count("*").alias("w"))
    degree = weight.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("d"), F.count_if(F.col("w") == 2).alias("r"))
    second = weight.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("w").alias("w2"))
    third = weight.select(F.col("b").alias("c"), "a", F.col("w").alias("w3"))
    closed = weight.join(second, "b").where("a <> c").join(third, ["a", "c"]).groupBy(F.col("a").alias("node")).agg((F.sum(F.col("w") * F.col("w2") * F.col("w3")) / 2).alias("t"))
    room = F.col("d") * (F.col("d") - 1) - 2 * F.col("r")
    return degree.join(closed, "node", "left").select("node", F.when(room > 0, F.coalesce("t", F.lit(0.0)) / room).otherwise(0.0).alias("coefficient"))


def hyperbolicity(quadruples: DataFrame, known: DataFrame, default: int = 5) -> DataFrame:
    """(quad, delta) of quadruples (quad, a, b, c, d): half of the largest less the second largest of the sums of opposite distances; pairs without a path count `default`."""
    pairs = [("a", "b", "c", "d"), ("a", "c", "b", "d"), ("a", "d", "b", "c")]
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(x).alias("src"), F.col(y).alias("dst")) for k, (p, q, r, s) in enumerate(pairs) for x, y in ((p, q), (r, s))]))
    asked = quadruples.select("quad", ends.alias("e")).select("quad", "e.*")
    sums = bounded_distance(asked, known, default).groupBy("quad", "k").agg(F.sum("dist").alias("s"))
    best = sums.groupBy("quad").agg(F.sort_array(F.collect_list("s"), False).alias("s"))
    return best.select("quad", ((F.get("s", F.lit(0)) - F.get("s", F.lit(1))) / 2).alias("delta"))


def clustering(edges: DataFrame) -> DataFrame:
    """(node, triangles): closed triples through each node, directions ignored."""
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    t = e.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").join(e.select("a", F.col("b").alias("c")), ["a", "c"], "left_semi")
    return t.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
