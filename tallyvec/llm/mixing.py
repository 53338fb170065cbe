"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is ``r`` times its size takes every document ``floor(r)`` times and,
beyond that, each with the inclusion probability ``r - floor(r)``. The flight moves these
probabilities along directions that keep the total of documents and the total of words
(the null space of the two constraints), until each is 0 or 1. It runs in blocks of
documents, each of which leaves two undecided at most; the undecided of many blocks form
the blocks of the next pass. The flight of a source's last block ends with a dozen
undecided: the landing, which tries all ways to decide them and takes the nearest. Where large
documents were among these, it goes on to exchange a document taken for one left out while that brings the words nearer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvec.sources.stage import write_stage

BLOCK = 2000  # documents in a block
EXACT = 1e-9  # probabilities this near to 0 or 1 are decided
LANDING = 12  # undecided documents left to the landing
EXCHANGES = 32  # documents exchanged after the landing at most; each brings the words nearer to the target
MOST = 3  # copies of a document at most


def size_of(text: str = "text"):
    """Number of words: runs without a space or one of the characters 9 to 13."""
    count = F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(count, F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Targets of ``(source, source_size)``, by code point, null last, weighing 1, 2, 3, 1 ...

    All sizes are shared by weight; a share over three times the source's size stops there
    and the rest is shared again among the others, until none is above.
    """
    turn = Window.orderBy(F.col("source").isNull(), F.col("source"))
    known = sizes.withColumn("weight", ((F.row_number().over(turn) - 1) % 3 + 1).cast("double"))
    whole = Window.partitionBy()
    # A source stops if its size per weight is low; so the stopped ones come first in that
    # order, and one pass of running sums finds where the sharing comes to rest.
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "source").rowsBetween(
        Window.unboundedPreceding, -1
    )
    share = (
        (F.sum("source_size").over(whole) - MOST * F.coalesce(F.sum("source_size").over(order), F.lit(0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    )
    known = known.withColumn("share", share)
    stops = F.col("share") * F.col("weight") > MOST * F.col("source_size")
    known = known.withColumn("stops", stops)
    free = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), "source", "share")))
    rate = free.over(whole).getField("share")
    target = F.when(F.col("stops"), MOST * F.col("source_size")).otherwise(rate * F.col("weight"))
    return known.select("source", "source_size", target.cast("double").alias("target"))


def flight(p: np.ndarray, x: np.ndarray, leave: int = 2, seed: int = 0) -> np.ndarray:
    """Move ``p`` until ``leave`` (two at least) are undecided; sums of ``p`` and ``p * x`` stay."""
    p = p.astype(float).copy()
    x = x.astype(float) / max(1.0, float(np.abs(x).max(initial=1)))
    open_ = [i for i in range(len(p)) if EXACT < p[i] < 1 - EXACT]
    draw = np.random.default_rng([seed, len(p)])
    held = open_[:3]
    rest = iter(open_[3:])
    n = len(open_)
    while len(held) == 3 and n > leave:
        i, j, k = held
        u = np.array([x[j] - x[k], x[k] - x[i], x[i] - x[j]])  # sums to 0, and so does u * x
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        q = p[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)))
            down = np.min(np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)))
        q = q + u * up if draw.random() * (up + down) < down else q - u * down
        q[q < EXACT] = 0.0
        q[q > 1 - EXACT] = 1.0
        p[held] = q
        n -= len(held)
        held = [h for h in held if 0 < p[h] < 1]
        n += len(held)
        while len(held) < 3 and (more := next(rest, None)) is not None:
            held.append(more)
    return p


def landing(p: np.ndarray, x: np.ndarray, goal: float, free: np.ndarray) -> np.ndarray:
    """Decide the last few so that words, and then documents, come nearest to their expectation.

    ``goal`` is the words expected of all, ``free`` tells which documents may be exchanged.
    """
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        words = np.abs(ways @ x[left] - p[left] @ x[left]) / max(1.0, float(x[left].mean()))
        p[left] = ways[np.argmin(words + 0.1 * np.abs(ways.sum(1) - p[left].sum()))]
    for _ in range(EXCHANGES):
        over = float(p @ x) - goal
        ins, outs = np.flatnonzero(free & (p == 1)), np.flatnonzero(free & (p == 0))
        outs = outs[np.argsort(x[outs], kind="stable")]
        if not len(ins) or not len(outs) or abs(over) < 0.5:
            break
        # For each document taken, the one left out whose size comes nearest to its own less what is too much.
        at = np.searchsorted(x[outs], x[ins] - over)
        near = np.stack([np.clip(at - 1, 0, len(outs) - 1), np.clip(at, 0, len(outs) - 1)])
        apart = np.abs(over - x[ins] + x[outs[near]])
        best = np.unravel_index(np.argmin(apart), apart.shape)
        if apart[best] >= abs(over):
            break
        p[ins[best[1]]], p[outs[near[best]]] = 0.0, 1.0
    return p


def sample(docs: DataFrame) -> DataFrame:
    """``doc_id, source, turn, nth, size, source_size, target, copies``: a row per row of ``docs``.

    ``copies`` is 0 to 3; ``turn`` and ``nth`` tell rows apart. Other columns of ``docs`` than
    ``doc_id, source, text`` are ignored. Null sources are a source of their own, null texts have size 0 and
    never count; documents of the same id, source and size are interchangeable. Blocks and
    draws follow from a hash of id, source and text, so reruns agree. No rows give none.
    """
    spread = F.xxhash64(F.lit("mix"), "doc_id", "source", "text")
    sized = docs.select("doc_id", "source", size_of().alias("size"), spread.alias("turn"))
    sized = write_stage(sized, "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = write_stage(sources, "mix-sources")
    goal = write_stage(
        targets(sources.select("source", "source_size")).join(
            sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))
        ).drop("s"), "mix-targets",
    )
    ratio = F.least(F.lit(float(MOST)), F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)))
    again = Window.partitionBy("doc_id", "source", "turn", "size").orderBy("size")
    units = sized.withColumn("nth", F.row_number().over(again))
    units = units.join(
        goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")
    base = F.floor(ratio + EXACT).cast("int")
    units = units.select(
        "doc_id", "source", "turn", "nth", "size", "source_size", "target", base.alias("base"),
        F.when((F.col("size") > 0) & (ratio - base > EXACT), ratio - base).otherwise(0.0).alias("p"),
        F.hash("source", "turn", "nth").alias("dealt"), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).alias("blocks"),
    )
    units = write_stage(units, "mix-units")
    decided = []
    layout = "source string, turn long, nth int, size long, p double, blocks long"
    state = units.where("p > 0").select("source", "turn", "nth", "size", "p", "dealt", "blocks")
    block = F.pmod(F.col("dealt"), F.col("blocks")).alias("block")
    state = state.select("source", "turn", "nth", "size", "p", "blocks", block)
    while True:

        def fly(rows: pd.DataFrame) -> pd.DataFrame:
            # Large documents are decided first, so that small ones are left to the landing.
            rows = rows.sort_values(["size", "turn", "nth"], ascending=[False, True, True], kind="stable")
            p, x = rows["p"].to_numpy(), rows["size"].to_numpy()
            last = rows["blocks"].iloc[0] == 1
            goal, free = float(p @ x), (p > EXACT) & (p < 1 - EXACT)
            p = flight(p, x, LANDING if last else 2, int(rows["turn"].iloc[0]) & 0xFFFFFFFF)
            if last:
                p = landing(p, x, goal, free)
            return rows.assign(p=p)[["source", "turn", "nth", "size", "p", "blocks", "block"]]

        flown = state.groupBy("source", "block").applyInPandas(fly, layout + ", block long")
        flown = write_stage(flown, "mix-flight")
        decided.append(flown.where("p in (0.0, 1.0)").select("source", "turn", "nth", F.col("p").cast("int").alias("more")))
        left = flown.where("p not in (0.0, 1.0)")
        if not left.take(1):
            break
        fewer = F.greatest(F.lit(1), F.ceil(F.col("blocks") * 2 / BLOCK)).cast("long")
        state = left.select(
            "source", "turn", "nth", "size", "p", fewer.alias("blocks"), F.pmod(F.col("block"), fewer).alias("block")
        )
    chosen = decided[0]
    for part in decided[1:]:
        chosen = chosen.union(part)
    ours, theirs = units.alias("u"), chosen.alias("c")
    same = (
        (F.col("u.turn") == F.col("c.turn")) & (F.col("u.nth") == F.col("c.nth"))
        & F.col("u.source").eqNullSafe(F.col("c.source"))
    )
    copies = F.col("base") + F.coalesce("more", F.lit(0))
    return ours.join(theirs, same, "left").select(
        "u.doc_id", "u.source", "u.turn", "u.nth", "size", "source_size", "target", copies.alias("copies")
    )


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as ``sample`` takes it; same columns, of any names but two leading underscores."""
    spread = F.xxhash64(F.lit("mix"), "doc_id", "source", "text")
    taken = sample(docs).groupBy(F.col("turn").alias("__of")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    keyed = docs.withColumn("__turn", spread)
    joined = keyed.join(taken, F.col("__turn") == F.col("__of"))
    # Repeated rows share a turn; each takes its part of their copies.
    nth = Window.partitionBy("__turn").orderBy("__turn")
    joined = joined.withColumn("__nth", F.row_number().over(nth) - 1)
    own = F.floor(F.col("__copies") / F.col("__rows")) + (
        F.col("__nth") < F.col("__copies") % F.col("__rows")
    ).cast("int")
    often = joined.withColumn("__own", own).where("__own > 0")
    return often.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__own").cast("int")))).select(*docs.columns)
