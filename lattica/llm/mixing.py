"""Temperature mixing of sources, realised as budgeted block permutations.

Shares. With q the sources' shares of all tokens, weights are q**t / sum(q**t). The
exponent t in [0, 1] is the largest whose entropy reaches ``entropy`` times the
largest possible, and at least the smallest that keeps every source within
``max_epochs`` passes over its tokens. Both searches cut the interval into GRID
parts per round, all evaluated by one aggregate over the table of sources (a
GRID-ary bisection), of which one row per part is read; sources are never collected.

Budgets. A source's budget is its weight times ``budget`` tokens (default: the
corpus): so many full epochs, then a part of one more.

Blocks. Documents are dealt by hash into blocks of about ``block_tokens`` tokens of
one source, and each epoch orders a source's blocks by a fresh hash, and documents
within a block likewise. The last epoch takes blocks in that order while they fit:
first whole cells (1/cells of the order, about as many cells as a cell has blocks),
then blocks of the next cell, then documents of the next block, so each step sorts a
short list per source, not a source. ``position`` in [0, 1) puts the blocks of all sources in proportion.

A hot source meets only aggregates with map-side parts and a join with the table of
sources, which is broadcast while small and else split by adaptive execution.

Defined cases: null text has no tokens; null is a source of its own; a source
without tokens gets nothing, as does a null doc_id's block like any other; repeated
rows are drawn alike; documents that would exceed the rest of a budget stay out, so
a budget is missed by less than one document (and rows that repeat it).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lattica.llm.common import Scratch, guarded

GRID, ROUNDS = 64, 5
TOKEN = r"[^\x20\x09-\x0D]+"


def _unit(*cols):
    """A uniform number in [0, 1) from the columns."""
    return F.xxhash64(*cols).bitwiseAND((1 << 52) - 1).cast("double") / F.lit(float(1 << 52))


def _key(source):
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _at(sources: DataFrame, exponents: list[float]) -> list:
    """For each exponent t: z = sum q^t, s = sum q^t ln q, m = max (t-1) ln q; one row each, with map-side parts."""
    ln, t = F.col("ln"), F.col("t")
    rows = sources.select(F.log("q").alias("ln"), F.posexplode(F.array(*map(F.lit, exponents))).alias("i", "t"))
    return rows.groupBy("i").agg(F.sum(F.exp(ln * t)).alias("z"), F.sum(F.exp(ln * t) * ln).alias("s"), F.max(ln * (t - 1)).alias("m")).orderBy("i").collect()


def _search(sources: DataFrame, good, lo: float, hi: float, largest: bool) -> float:
    """The largest (or smallest) exponent in [lo, hi] with good(z, s, m, t); good is monotone."""
    for _ in range(ROUNDS):
        at = [lo + (hi - lo) * i / GRID for i in range(GRID + 1)]
        ok = [i for i, r in enumerate(_at(sources, at)) if good(r.z, r.s, r.m, at[i])]
        if not ok:
            return lo if largest else hi
        i = max(ok) if largest else min(ok)
        lo, hi = (at[i], at[min(i + 1, GRID)]) if largest else (at[max(i - 1, 0)], at[i])
    return lo if largest else hi


def exponent(sources: DataFrame, entropy: float, max_epochs: float, budget_ratio: float) -> float:
    """From sources (q): shares that add up to 1; budget_ratio: budget over all tokens."""
    n = sources.count()
    target = entropy * math.log(n) if n else 0.0
    slack = 1e-9
    t = _search(sources, lambda z, s, m, t: math.log(z) - t * s / z >= target - slack, 0.0, 1.0, largest=True)
    # a source's epochs: weight * budget / tokens = q^(t-1) / Z * budget_ratio
    within = lambda z, s, m, t: math.exp(m) / z * budget_ratio <= max_epochs + slack
    r = _at(sources, [t])[0]
    return t if within(r.z, r.s, r.m, t) else _search(sources, within, t, 1.0, largest=False)


def plan(docs: DataFrame, scratch: Scratch, entropy: float, max_epochs: float, budget: int | None, block_tokens: int, seed: int) -> DataFrame:
    """Per source: key, n_blocks, full (epochs), part (share of the last), and the last epoch's limits."""
    rows = docs.select("doc_id", _key(F.col("source")).alias("key"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKEN)).cast("long").alias("n")).filter("n > 0")
    rows = scratch.save(rows, "tokens")
    sources = scratch.save(rows.groupBy("key").agg(F.sum("n").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.withColumn("q", F.col("tokens") / F.lit(float(total or 1)))
    wanted = total if budget is None else budget
    t = exponent(shares, entropy, max_epochs, wanted / total) if total else 1.0
    z = shares.agg(F.sum(F.pow("q", F.lit(t)))).first()[0] or 1.0
    want = F.floor(F.pow("q", F.lit(t)) / F.lit(z) * F.lit(float(wanted)) + 0.5).cast("long")
    full = F.floor(F.col("want") / F.col("tokens") + 1e-12).cast("long")
    out = shares.withColumn("want", want).withColumn("full", full).withColumn("rest", F.greatest(F.lit(0), F.col("want") - F.col("full") * F.col("tokens"))).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long"))
    out = scratch.save(out.select("key", "tokens", "want", "full", "rest", "n_blocks"), "budgets")
    # cells and the blocks of a cell are both about the root of the blocks
    cells_n = 1 << max(5, math.ceil(math.log2(out.agg(F.max("n_blocks")).first()[0] or 1) / 2))
    out = out.withColumn("cells", F.lit(cells_n))
    # the last epoch's limits, from coarse to fine
    last = _placed(rows.join(out.filter("rest > 0").select("key", "full", "rest", "n_blocks", "cells"), "key"), F.col("full"), seed)
    cells = last.groupBy("key", "cell").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"))
    edge = _edge(cells, "cell").withColumnRenamed("rest", "rest1")
    inner = last.drop("rest").join(edge, ["key", "cell"]).withColumn("rest", F.col("rest1"))
    blocks = inner.groupBy("key", "u").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"))
    edge2 = _edge(blocks, "u").withColumnRenamed("rest", "rest2")
    tail = inner.drop("rest").join(edge2, ["key", "u"])
    w = Window.partitionBy("key").orderBy("v")
    fits = tail.withColumn("so_far", F.sum("n").over(w)).filter("so_far <= rest2").groupBy("key").agg(F.max("v").alias("v_limit"))
    limits = edge.select("key", F.col("cell").alias("cell_limit")).join(edge2.select("key", F.col("u").alias("u_limit")), "key", "left").join(fits, "key", "left")
    return scratch.save(out.join(limits, "key", "left"), "plan")


def _placed(rows: DataFrame, epoch, seed: int) -> DataFrame:
    """Adds block, and its place u and the document's place v in the epoch's order."""
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("n_blocks"))
    u, v = _unit(F.lit(seed), "key", "block", epoch), _unit(F.lit(seed), epoch, "doc_id")
    return rows.withColumn("block", block).withColumn("u", u).withColumn("v", v).withColumn("cell", F.floor(F.col("u") * F.col("cells")).cast("int"))


def _edge(sums: DataFrame, by: str) -> DataFrame:
    """Per source the first place whose sum no longer fits, with what is left before it."""
    so_far = F.sum("n").over(Window.partitionBy("key").orderBy(by))
    over = sums.withColumn("so_far", so_far).filter("so_far > rest").withColumn("left", F.col("rest") - F.col("so_far") + F.col("n"))
    return over.groupBy("key").agg(F.min(F.struct(by, "left")).alias("e")).select("key", F.col(f"e.{by}").alias(by), F.col("e.left").alias("rest"))


def mix(docs: DataFrame, entropy: float = 0.98, max_epochs: float = 4.0, budget: int | None = None, block_tokens: int = 1 << 16, seed: int = 17) -> DataFrame:
    """docs as drawn: each row once per epoch it is in, with ``__epoch``, ``__block`` and ``__position``."""
    scratch = Scratch(docs.sparkSession, "mixing")
    docs, named = guarded(docs, "doc_id", "text", "source")
    p = plan(docs, scratch, entropy, max_epochs, budget, block_tokens, seed)
    p = p.select(*(F.col(c).alias(f"__{c}") for c in p.columns))
    some = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.filter(some).join(p, _key(F.col("source")) == F.col("__key"))
    cols = docs.columns
    rows = rows.withColumn("__block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("__n_blocks")))
    u = lambda epoch: _unit(F.lit(seed), "__key", "__block", epoch)
    v = lambda epoch: _unit(F.lit(seed), epoch, "doc_id")
    last = F.col("__full")
    cell = F.floor(u(last) * F.col("__cells")).cast("int")
    taken = F.when(F.col("__rest") <= 0, False).when(F.col("__cell_limit").isNull(), True).when(cell != F.col("__cell_limit"), cell < F.col("__cell_limit"))
    taken = taken.when(u(last) != F.col("__u_limit"), u(last) < F.col("__u_limit")).otherwise(F.coalesce(v(last) <= F.col("__v_limit"), F.lit(False)))
    copies = last + F.when(taken, 1).otherwise(0)
    rows = rows.withColumn("__copies", copies).filter("__copies > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
    position = (F.col("__epoch") + u(F.col("__epoch"))) / (F.col("__want") / F.col("__tokens"))
    return named(rows.withColumn("__position", F.least(position, F.lit(1.0 - 2**-53))).select(*cols, "__epoch", "__block", "__position"))


def report(docs: DataFrame, **options) -> DataFrame:
    """The mixture's rows: doc_id, source, epoch, block, position, n_tokens."""
    out = mix(docs.select("doc_id", "source", "text"), **options)
    n = F.regexp_count("text", F.lit(TOKEN)).cast("long")
    return out.select("doc_id", "source", F.col("__epoch").alias("epoch"), F.col("__block").alias("block"), F.col("__position").alias("position"), n.alias("n_tokens"))
