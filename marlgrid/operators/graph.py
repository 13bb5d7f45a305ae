"""Graph operators over an edge table: bounded walks that keep one row a node and hop, breadth-first search, PageRank.

Each hop is one equi-join and one grouped maximum or minimum, so paths never multiply.  Each hop and round is written to the
checkpoint folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from marlgrid.operators.relational import latest_per_key, symmetric
from marlgrid.operators.staging import bucketed, cut, in_bucket_order, numbered


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int = 2) -> DataFrame:
    """Directed search from each seed (seed): (seed, node, depth, predicate, score); the first edge in `ordinal` order that reaches a
    node wins, the score is 1 / depth, and neither the seed nor a node reached before comes again.

    edges: src, dst, predicate, ordinal.
    """
    frontier = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).cast("long").alias("rank"))
    seen, found = frontier.select("seed", "node"), None
    for depth in range(1, max_depth + 1):
        met = frontier.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), "predicate", "rank", "ordinal")
        new = latest_per_key(met.join(seen, ["seed", "node"], "left_anti"), ["seed", "node"], [F.asc("rank"), F.asc("ordinal")])
        if depth < max_depth:  # the order in which nodes were reached is the order in which they are left
            new = numbered(new, ["rank", "ordinal", "seed", "node"]).withColumn("rank", F.col("position").cast("long")).drop("position")
        new = cut(new)
        hop = new.select("seed", "node", F.lit(depth).cast("long").alias("depth"), "predicate", F.lit(1.0 / depth).alias("score"))
        found = hop if found is None else found.unionByName(hop)
        seen = seen.unionByName(new.select("seed", "node"))
        frontier = new.select("seed", "node", "rank")
    return found


def neighbours(edges: DataFrame, node: str, max_depth: int = 4, most: int = 200) -> DataFrame:
    """(node, depth, relation) of the nodes within max_depth undirected steps, at their least depth, the first `most` by depth and node;
    of several relations at that depth the smallest."""
    depth = min(max(1, max_depth), 4)
    both = symmetric(edges.select("src", "dst", "kind"))
    frontier = edges.sparkSession.range(1).select(F.lit(node).alias("node"))
    seen, found = frontier, None
    for d in range(1, depth + 1):
        met = frontier.join(both, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("kind").alias("relation"))
        hop = cut(met.join(seen, "node", "left_anti").select("node", F.lit(d).cast("long").alias("depth"), "relation"))
        found = hop if found is None else found.unionByName(hop)
        frontier = hop.select("node")
        seen = seen.unionByName(frontier)
    return found.orderBy("depth", "node").limit(most)


def decayed_walk(edges: DataFrame, seeds: DataFrame, max_depth: int = 4, decay: float = 0.85, most: int | None = 20) -> DataFrame:
    """(node, score): the best product of decay * weight over undirected walks from any seed (node) of at most max_depth steps; no seeds.

    The maximum over walks is reached hop by hop from each node's maximum, whatever the weights.
    """
    both = symmetric(edges.select("src", "dst", "weight"))
    frontier = seeds.select("node", F.lit(1.0).alias("score")).distinct()
    found = None
    for _ in range(max_depth):
        frontier = frontier.join(both, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max(F.col("score") * decay * F.col("weight")).alias("score"))
        frontier = cut(frontier)
        found = frontier if found is None else found.unionByName(frontier)
    out = found.groupBy("node").agg(F.max("score").alias("score")).join(seeds.select("node"), "node", "left_anti")
    return out if most is None else out.orderBy(F.desc("score"), "node").limit(most)


#: Links of a node that stand together; a node with more is dealt over several parts.
PART = 1 << 16


#: Rounds of PageRank that are kept as parts of a sum, one table each.
LAYERS = 8


def spread(scores: DataFrame, links: DataFrame, values: dict[str, str] | None = None) -> DataFrame:
    """(node, got): what nodes get from the scores (node, score, parts) along links (src, part, dst, share), which lie bucketed by src and part; a row a link.
    With values, a name for what is got of each column.

    Only scores move to the links, one row for each part of a node, and are merged with them in their order (see in_bucket_order()).
    """
    values = values or {"score": "got"}
    sent = scores.where("parts > 0").select("node", *values, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("piece"))
    met = sent.hint("merge").join(links, (F.col("node") == F.col("src")) & (F.col("piece") == F.col("part")))
    return met.select(F.col("dst").alias("node"), *[(F.col(c) * F.col("share")).alias(name) for c, name in values.items()])


def laid_out(edges: DataFrame, weighted: bool = False, totals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, out): links (src, part, dst, share of src's weight), bucketed and sorted by src and part once for all rounds; out: (src, parts).

    totals (src, total): the weights of the sources where edges are only some of theirs."""
    links = edges.select("src", "dst", (F.col("weight") if weighted else F.lit(1.0)).alias("w"))
    # parallel edges are added up before any round
    links = cut(links.groupBy("src", "dst").agg(F.sum("w").alias("w")))
    # a table of its own, so that the links of a hub can be split when it is joined back
    own = links.groupBy("src").agg(F.sum("w").alias("total"), F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    out = cut(own if totals is None else own.drop("total").join(totals, "src").select("src", "total", "parts"))
    parted = links.join(out, "src").select("src", F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part"), "dst", (F.col("w") / F.col("total")).alias("share"))
    return bucketed(parted, ["src", "part"]), out.select("src", "parts")


def _layers(base: DataFrame, links: DataFrame, most: int) -> tuple[list[DataFrame], list[tuple[float, float]], bool]:
    """What one unit on each node (u) and the personalization (v) become in 0, 1, 2, ... steps along links, on base (node, parts, mass) alone; their sums; whether nothing is left."""
    parts = base.select(F.col("node").alias("of"), "parts")
    at, tables, sums = base.select("node", "parts", F.lit(1.0).alias("u"), F.col("mass").alias("v")), [], []
    while True:
        seen = Observation()
        told = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("u", "v")]
        with in_bucket_order(base.sparkSession):
            at = cut(at.observe(seen, F.count("*").alias("n"), *told))
        sums.append((seen.get["u"], seen.get["v"]))
        if not seen.get["n"]:
            return tables, sums, True
        tables.append(at)
        if len(tables) > most:
            return tables, sums, False
        got = spread(at, links, {"u": "u", "v": "v"}).groupBy("node").agg(F.sum("u").alias("u"), F.sum("v").alias("v"))
        at = got.join(parts, F.col("node") == F.col("of")).select("node", "parts", "u", "v")


def ppr(edges: DataFrame, personalization: DataFrame, alpha: float = 0.15, tolerance: float = 1e-6, rounds: int = 100, fixed: bool = False, weighted: bool = False) -> DataFrame:
    """(node, score): personalised PageRank by power iteration, as joins at every size.

    alpha is the teleport share; personalization (node, mass) sums to 1.  All nodes start at 1/N; parallel edges count
    separately, or by weight where `weighted`; the mass of nodes without outgoing edges goes to all nodes alike.  Stops when the
    scores surely move by less than tolerance in total, or after `rounds`; with `fixed` it runs them all without looking.

    Only nodes with outgoing edges take part in the rounds: of the others the rounds need no more than their sum.  They get their scores in the last
    round, which alone goes along all links.  A round's scores are a sum of what a unit on each node and the personalization become in 0, 1, 2, ...
    steps; the first LAYERS of these are tables, and the rounds are then numbers of the driver.  Where nothing is left after so many steps (no walk is longer) that is
    all; a graph with longer walks goes on from there round by round.  The links between nodes that take part are laid out once and stay where they are.
    """
    every = cut(edges.select("src", "dst", (F.col("weight") if weighted else F.lit(1.0)).cast("double").alias("weight")))
    given = cut(personalization.groupBy("node").agg(F.sum("mass").alias("mass")))
    totals = cut(every.groupBy("src").agg(F.sum("weight").alias("total")))
    nodes = every.select(F.col("dst").alias("node")).unionByName(totals.select(F.col("src").alias("node"))).unionByName(given.select("node")).distinct()
    n = nodes.count()
    if not n or rounds < 1:
        return nodes.select("node", F.lit(1.0 / max(n, 1)).alias("score"))
    mass = given.agg(F.coalesce(F.sum("mass"), F.lit(0.0))).first()[0]
    links, out = laid_out(every.join(totals.select(F.col("src").alias("dst")), "dst", "left_semi"), True, totals)
    takes = totals.where("src is not null").select(F.col("src").alias("node"))
    base = takes.join(out, F.col("node") == F.col("src"), "left").join(given, "node", "left")
    base = cut(base.select("node", F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("mass", F.lit(0.0)).alias("mass")))
    keep, most = 1 - alpha, min(LAYERS, rounds - 1)
    tables, sums, whole = _layers(base, links, most)
    # sums over all nodes: a step takes along what lay on nodes with links
    all_u, all_v = [float(n)] + [u for u, _ in sums], [mass] + [v for _, v in sums]
    lost: list[float] = []

    def shares(t: int) -> list[tuple[float, float]]:
        """The factors of u and v of each number of steps in the scores of round t."""
        return [(keep**t / n, 0.0) if j == t else (keep ** (j + 1) * lost[t - 1 - j] / n, alpha * keep**j) for j in range(min(t + 1, len(sums)))]

    last, before, done = 0, [], False
    for t in range((rounds if whole else most) + 1):
        now = shares(t)
        lost.append(sum(c * (all_u[j] - sums[j][0]) + e * (all_v[j] - sums[j][1]) for j, (c, e) in enumerate(now)))
        if t:
            old = before + [(0.0, 0.0)] * (len(now) - len(before))
            moved = sum(abs(c - c0) * all_u[j] + abs(e - e0) * all_v[j] for j, ((c, e), (c0, e0)) in enumerate(zip(now, old, strict=True)))
            last, done = t, t == rounds or (moved < tolerance and not fixed)
        if done:
            break
        before = now
    at = last - 1 if done else last
    own = [x.select("node", (c * F.col("u") + e * F.col("v")).alias("score")) for x, (c, e) in zip(tables, shares(at), strict=False)]
    scores = reduce(DataFrame.unionByName, own).groupBy("node").agg(F.sum("score").alias("score")) if own else base.select("node", F.lit(0.0).alias("score"))
    gone = lost[at]
    if not done and at + 1 < rounds:
        scores, gone = _further(base, links, cut(base.join(scores, "node", "left").select("node", "parts", "mass", F.coalesce("score", F.lit(0.0)).alias("score"))), n, mass, at, lost, alpha, tolerance, rounds, fixed)
    sent = scores.join(totals, F.col("node") == F.col("src")).select(F.col("node").alias("by"), (F.col("score") / F.col("total")).alias("each"))
    got = every.join(sent, F.col("src") == F.col("by")).select(F.col("dst").alias("node"), (F.col("each") * F.col("weight")).alias("got"), F.lit(0.0).alias("mass"))
    nothing = F.lit(0.0)
    rows = got.unionByName(every.where("src is null").select(F.col("dst").alias("node"), nothing.alias("got"), nothing.alias("mass"))).unionByName(totals.select(F.col("src").alias("node"), nothing.alias("got"), nothing.alias("mass"))).unionByName(given.select("node", nothing.alias("got"), "mass"))
    summed = rows.groupBy("node").agg(F.sum("got").alias("got"), F.sum("mass").alias("mass"))
    score = keep * (F.col("got") + gone / n) + alpha * F.col("mass")
    return summed.select("node", score.alias("score"))


def _further(base: DataFrame, links: DataFrame, scores: DataFrame, n: int, mass: float, at: int, lost: list[float], alpha: float, tolerance: float, rounds: int, fixed: bool) -> tuple[DataFrame, float]:
    """The scores of base's nodes one round before the last, and what nodes without links then hold, from those of round `at`, a round at a time."""
    keep, none = 1 - alpha, F.lit(None)
    total, gone, step = keep**at + mass * (1 - keep**at), lost[at], None
    for t in range(at + 1, rounds):
        # each node's own row and what it gets meet in one sum
        got = spread(scores, links).select("node", "got", none.cast("int").alias("parts"), none.cast("double").alias("mass"), none.cast("double").alias("old"))
        rows = scores.select("node", F.lit(0.0).alias("got"), "parts", "mass", F.col("score").alias("old")).unionByName(got)
        summed = rows.groupBy("node").agg(F.sum("got").alias("got"), *[F.max(c).alias(c) for c in ("parts", "mass", "old")])
        score = keep * (F.col("got") + gone / n) + alpha * F.col("mass")
        # two numbers come to the driver each round, with the job that writes the scores
        seen = Observation()
        told = (F.sum(F.abs(F.col("score") - F.col("old"))).alias("moved"), F.sum("score").alias("held"))
        with in_bucket_order(base.sparkSession):
            new = cut(summed.select("node", "parts", "mass", score.alias("score"), "old").observe(seen, *told)).drop("old")
        total = keep * total + alpha * mass
        left, moved = total - seen.get["held"], seen.get["moved"]
        # nodes without links move by no more than what nodes with links and the lost mass did a round before
        if not fixed and step is not None and moved + keep * step < tolerance:
            break
        step = moved + abs(left - gone)
        scores, gone = new, left
    return scores.select("node", "score"), gone


def contracted(edges: DataFrame) -> DataFrame | None:
    """A smaller graph with a cycle if and only if edges (src, dst; distinct, no loops) has one; None where a cycle is certain.

    Nodes that nothing leads to go, with their edges.  A node that one edge leads to is merged into that edge's source: each cycle through one
    runs through the other.  Such nodes form trees under their sources; pointer doubling finds each one's root in as many steps as its
    depth has binary digits.  If every node is led to, or a pointer never comes to a root, there is a cycle; so is a merged edge from a node to itself.
    """
    led = cut(edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("up")))
    begins = cut(edges.join(led, F.col("src") == F.col("node"), "left_anti").select(F.col("src").alias("start")).distinct())
    if not begins.take(1):
        return None
    roots = led.where("n = 1").select("node", "up")
    steps = roots.count().bit_length() + 1
    for step in range(steps + 1):
        above = roots.select(F.col("node").alias("via"), F.col("up").alias("over"))
        seen = Observation()
        roots = cut(roots.join(above, F.col("up") == F.col("via"), "left").select("node", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")).observe(seen, F.count_if("moved").alias("moved"))).drop("moved")
        if not seen.get["moved"]:
            break
    else:
        return None
    # edges into merged nodes go; the others start at their source's root
    rest = edges.join(roots.select(F.col("node").alias("merged")), F.col("dst") == F.col("merged"), "left_anti")
    moved = rest.join(roots, F.col("src") == F.col("node"), "left").select(F.coalesce("up", "src").alias("src"), "dst")
    left = cut(moved.join(begins, F.col("src") == F.col("start"), "left_anti").distinct())
    return None if left.where("src = dst").take(1) else left


def has_cycle(edges: DataFrame) -> bool:
    """Whether a directed graph has a cycle; a loop is one, and edges with a null end count as none.

    The graph and its reverse are contracted in turn, so chains and trees in either direction go in a logarithm of their depth.  A graph in which
    many edges lead to and from every node loses one layer of sources and one of sinks each time.
    """
    left = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    if left.where("src = dst").take(1):
        return True
    # edges into nodes that nothing leaves go first: the leaves of wide trees need no pointers
    left = cut(left.join(left.select(F.col("src").alias("leaves")).distinct(), F.col("dst") == F.col("leaves"), "left_semi"))
    while left is not None and left.take(1):
        left = contracted(left)
        left = left and left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return left is None
