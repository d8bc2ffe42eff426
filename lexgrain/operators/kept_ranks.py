"""PageRank that is kept and refreshed: after edges were added, removed or weighed anew, only what the change reaches is worked on.

PageRank that spreads the ranks of nodes without a way out evenly is proportional to the solution x of
``x = 1 + damping * (shares of the nodes that cite)``, whatever the number of nodes is. Besides its score x a node keeps the residual r
of its equation. A changed source leaves residuals at what it cited and cites; a node whose residual is over the tolerance takes it
into its score and pushes its damped shares on. Ranks are the scores over their sum; each is within tolerance / (1 - damping) before that.

A round joins the nodes that push, and sums residuals by node (combinable). Few of them are broadcast and meet the edges in one scan; where
they are many, the edges are placed once by (source, cell), and sources of many edges have several cells, so no task has all of a hub's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import discard, stored
from ..plans.order import held
from ..plans.sizes import MOST_ROWS, broadcast_if_small
from .graph import DAMPING, nodes

#: Residual that a node may keep; rounds after which what does not settle raises, and rounds stored together; edges of a source in one cell.
TOLERANCE, MOST_ROUNDS, ROUNDS, CELL = 1e-7, 1000, 4, 100_000


@dataclass(frozen=True)
class Kept:
    """``scores`` (id, x, r), ``edges`` (src, dst, weight, share), and how many times a node pushed to get there."""

    scores: DataFrame
    edges: DataFrame
    pushed: int

    def ranks(self) -> DataFrame:
        """(id, pagerank), which sum to 1."""
        total = self.scores.agg(F.sum("x")).first()[0]
        return self.scores.select("id", (F.col("x") / F.lit(total or 1.0)).alias("pagerank"))


def with_shares(edges: DataFrame) -> DataFrame:
    """(src, dst, weight, share) of weighted edges: the share of its source's weight. Repeated edges are one of their summed weight."""
    one = edges.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight"))
    return one.join(one.groupBy("src").agg(F.sum("weight").alias("_out")), "src").select("src", "dst", "weight", (F.col("weight") / F.col("_out")).alias("share"))


def _cells(edges: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """The edges held by (src, at), and (id, cells) of the sources of more than ``cell`` edges."""
    many = stored(edges.groupBy(F.col("src").alias("id")).count().where(F.col("count") > cell).select("id", F.ceil(F.col("count") / cell).cast("int").alias("cells")), "hubs")
    at = F.pmod(F.xxhash64("dst"), F.coalesce("cells", F.lit(1))).cast("int")
    dealt = edges.join(broadcast_if_small(many), F.col("src") == F.col("id"), "left").select("src", at.alias("at"), "dst", "share")
    return held(dealt, "src", "at"), broadcast_if_small(many)


def _settled(touched: DataFrame, edges: DataFrame, total: int, damping: float, tolerance: float, few: int, cell: int) -> tuple[DataFrame, int]:
    """``touched`` (id, base, dr, dx) after all pushes, stored, and their number. A node's residual is base + dr; base is what it kept before.

    ``total`` bounds the number of nodes. Up to ``few`` nodes that push are broadcast; where no later round can have more, ROUNDS
    of them are stored together.
    """
    left, zero = F.col("base") + F.col("dr"), F.lit(0.0)
    active = F.abs(left) > tolerance
    placed = None

    def pushed(now: DataFrame, small: bool) -> DataFrame:
        front = now.where(active).select("id", left.alias("v"))
        if small:
            met = edges.join(F.broadcast(front), F.col("src") == F.col("id"))
        else:
            of, many = placed
            spread = front.join(many, "id", "left").select("id", "v", F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1)).alias("cell"))
            met = of.join(spread, (F.col("src") == F.col("id")) & (F.col("at") == F.col("cell")))
        given = met.select(F.col("dst").alias("id"), zero.alias("base"), (F.col("v") * F.col("share") * damping).alias("dr"), zero.alias("dx"), F.lit(0).alias("n"))
        own = now.select(
            "id", "base", F.when(active, -F.col("base")).otherwise(F.col("dr")).alias("dr"), (F.col("dx") + F.when(active, left).otherwise(zero)).alias("dx"), (F.col("n") + active.cast("int")).alias("n"),
        )
        return own.unionAll(given).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("base", "dr", "dx")], F.sum("n").cast("int").alias("n"))

    now = stored(touched.withColumn("n", F.lit(0)), "touched")
    for _ in range(0, MOST_ROUNDS, ROUNDS):
        n = now.where(active).count()
        if not n:
            if placed is not None:
                placed[0].unpersist()
            return now, now.agg(F.sum("n")).first()[0] or 0
        small = n <= few
        if not small and placed is None:
            placed = _cells(edges, cell)
        new = now
        for _ in range(ROUNDS if total <= few else 1):
            new = pushed(new, small)
        new = stored(new, "touched")
        discard(now)
        now = new
    raise RuntimeError(f"ranks did not settle in {MOST_ROUNDS} rounds")


def solve(edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, few: int = MOST_ROWS, cell: int = CELL) -> Kept:
    """Scores of weighted edges (src, dst, weight) from nothing: all nodes start at the score that makes the residuals sum to 0.

    Edges of null ends, or of null, zero or negative weight are left out; edges from a node to itself count. No edges give no scores."""
    known = stored(with_shares(_sound(edges)), "edges")
    every = stored(nodes(known), "nodes")
    n = every.count()
    ways = known.select("src").distinct().count()
    start = n / (n - damping * ways) if n else 0.0
    got = known.groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("s"))
    first = every.join(got, "id", "left").select("id", F.lit(0.0).alias("base"), (1 - start + damping * start * F.coalesce("s", F.lit(0.0))).alias("dr"), F.lit(start).alias("dx"))
    done, pushed = _settled(first, known, n, damping, tolerance, few, cell)
    return Kept(done.select("id", F.col("dx").alias("x"), F.col("dr").alias("r")), known, pushed)


def _sound(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("weight") > 0)).select("src", "dst", "weight")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src, dst, weight) that lead from some weighted edges to others, each pair there once at most; a removed edge has no weight."""
    both = before.select("src", "dst", F.col("weight").alias("old")).join(after.select("src", "dst", F.col("weight").alias("weight")), ["src", "dst"], "full")
    return both.where(~F.col("old").eqNullSafe(F.col("weight"))).select("src", "dst", "weight")


def refresh(kept: Kept, change: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, few: int = MOST_ROWS, cell: int = CELL) -> Kept:
    """``kept`` after a change (src, dst, weight): the edge has that weight from now on, or is gone if it is null, zero or negative.

    Of a pair that is given more than once the largest weight counts. A node whose last edge goes has no score any more; one that comes starts at none.
    The edges of sources without a change are scanned and not shuffled, unless very many nodes push. A change that removes
    what is not there, or sets what is there already, changes nothing.
    """
    new = stored(change.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.max("weight").cast("double").alias("weight")), "change")
    sources = broadcast_if_small(new.select("src").distinct())
    old_out = stored(kept.edges.join(sources, "src", "left_semi").select("src", "dst", "weight", "share"), "old")
    rest = old_out.select("src", "dst", "weight").join(new, ["src", "dst"], "left_anti")
    new_out = stored(with_shares(_sound(rest.unionByName(new))), "new")
    after = kept.edges.join(sources, "src", "left_anti").select("src", "dst", "weight", "share").unionByName(new_out)
    # what goes: an end of an old edge of these sources that no edge has any more
    lost = stored(nodes(old_out).join(nodes(new_out), "id", "left_anti"), "lost")
    held = nodes(after.join(broadcast_if_small(lost).withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("dst").alias("src"), "dst"))
    gone = stored(lost.join(held, "id", "left_anti"), "gone")
    none = F.lit(0.0)
    x = kept.scores.select(F.col("id").alias("src"), "x").join(sources, "src", "left_semi")
    moved = old_out.select("src", "dst", (-F.col("share")).alias("by")).unionAll(new_out.select("src", "dst", "share")).join(x, "src")
    moved = moved.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("by") * F.col("x") * damping).alias("dr"))
    come = nodes(new_out).join(kept.scores, "id", "left_anti").select("id", F.lit(1.0).alias("dr"))
    delta = moved.unionByName(come).groupBy("id").agg(F.sum("dr").alias("dr")).join(gone, "id", "left_anti")
    own = kept.scores.select("id", "r")
    far = own.where(F.abs("r") > tolerance).select("id", none.alias("dr"))
    first = delta.unionByName(far).groupBy("id").agg(F.sum("dr").alias("dr")).join(own, "id", "left").select("id", F.coalesce("r", none).alias("base"), "dr", none.alias("dx"))
    total = kept.scores.count() + 2 * new.count()
    done, pushed = _settled(first.join(gone, "id", "left_anti"), after, total, damping, tolerance, few, cell)
    both = kept.scores.join(gone, "id", "left_anti").join(done, "id", "full")
    scores = stored(both.select("id", *[(F.coalesce(a, none) + F.coalesce(b, none)).alias(a) for a, b in (("x", "dx"), ("r", "dr"))]), "scores")
    return Kept(scores, after, pushed)
