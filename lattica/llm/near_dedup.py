"""Near-duplicate documents: universal hash minima, banding, full verification, components.

A document's set holds its distinct two-word shingles (words split at ASCII white
space, A-Z lower-cased; fewer words: the whole sequence). Documents are linked when
100 * |intersection| >= 80 * |union|.

1. One pass over the texts gives each document its set's size, a 128-bit name of
   the set, and ``bands`` keys of ``rows`` minima each. 36 bands of 5 rows miss a
   pair at similarity 0.8 with probability (1 - 0.8**5)**36 = 6e-7, others less.
2. Equal sets are one class (its smallest doc_id stands for it), so thousands of
   copies cost one row each and no pairs.
3. In a bucket every class is compared with two centres, the bucket's smallest
   class and the one that shares most buckets with others (the text that copies were
   made from), and kept links are joined into components. A bucket whose classes fell
   into different components is looked at again: its pairs across components are
   compared too, if the bitmaps of their sets allow the similarity (the xor of two
   parity bitmaps has no more bits than the sets' symmetric difference, so no link is
   lost). Pairs inside a component can no longer change it.
4. Links are confirmed on the full sets, whose texts are read again only for
   documents in question.
5. Components come from alternating large-star and small-star steps.

Hot buckets: a bucket's smallest member is an aggregate with map-side parts, the
joins that follow are inner or left joins that adaptive execution can split, and no
group is collected. Every loop writes its edges to the shared folder.

Defined cases: no words or null text: empty set, linked with nothing; a null doc_id:
its component is null and it is kept; repeated rows of a doc_id all get its
component, and a doc_id with several texts links what any of them links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, binary, groups, guarded, trimmed
from lattica.llm.hashing import U, mix, words

BANDS, ROWS = 36, 5
SEED = 20_240_229
BLOCK = 4096
BITS = 4096


def shingles(texts: list[bytes], size: int = 2):
    """Each text's sorted distinct shingle hashes; words split at white space."""
    for lo, hi in groups(texts):
        h, ends = words(texts[lo:hi], space_only=True)
        n = len(h)
        s = h.copy()
        for j in range(1, size):
            s[: n - j] = mix(s[: n - j] * U(0x9E3779B97F4A7C15) + h[j:])
        at = 0
        for end in ends:
            if end - at >= size:
                yield np.unique(s[at : end - size + 1])
            elif end > at:
                whole = h[at : at + 1]
                for j in range(at + 1, end):
                    whole = mix(whole * U(0xC2B2AE3D27D4EB4F) + h[j : j + 1])
                yield mix(whole ^ U(0x5851F42D4C957F2D))
            else:
                yield h[:0]
            at = end


def _family() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return r.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each a*x + b modulo 2^32 over the set."""
    x, out = (s >> U(32)).astype(np.uint32), np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), BLOCK):
        y = np.multiply.outer(a, x[i : i + BLOCK])
        y += b[:, None]
        np.minimum(out, y.min(axis=1), out=out)
    return out


def _signatures(size: int):
    a, b = _family()
    index = np.arange(BANDS, dtype=U) * U(0x9FB21C651E98DF25)

    def fn(batches):
        for batch in batches:
            n, one, two, keys, counts, bits = [], [], [], [], [], []
            for s in shingles(binary(batch.column(1)), size):
                n.append(len(s))
                one.append(int(mix(s).sum()) if len(s) else 0)
                two.append(int(mix(s * U(0xD6E8FEB86659FD93) + U(len(s))).sum()) if len(s) else 0)
                if len(s):
                    m = minima(s, a, b).reshape(BANDS, ROWS).astype(U)
                    key = index.copy()
                    for j in range(ROWS):
                        key = mix(key * U(0x9E3779B97F4A7C15) + m[:, j])
                    keys.append(key)
                counts.append(BANDS if len(s) else 0)
                odd = np.bincount((s & U(BITS - 1)).astype(np.int64), minlength=BITS) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64) if len(s) else np.zeros(0, np.int64))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
            as_long = lambda x: pa.array(np.array(x, dtype=U).view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in bits])]).astype(np.int32)
            maps = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), as_long(one), as_long(two), bands, maps], names=["doc_id", "n", "h1", "h2", "bands", "bits"])

    return fn


def _sets(size: int):
    def fn(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingles(binary(batch.column(1)), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "s"])

    return fn


def _similar(percent: int):
    def fn(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return fn


def _confirmed(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi")
    texts = texts.withColumn("th", F.xxhash64("text")).dropDuplicates(["doc_id", "th"])  # repeated rows would multiply every pair
    sets = texts.select("doc_id", "text").mapInArrow(trimmed(_sets(size)), "doc_id long, s binary")
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(trimmed(_similar(percent)), "a long, b long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): root is its component's smallest vertex."""
    now, last, step = scratch.save(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct(), f"{name}0"), None, 0
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return now.select("v", F.col("u").alias("root")).union(now.select(F.col("u").alias("v"), F.col("u").alias("root")).distinct())
        last = state
        # large-star: larger neighbours go to the smallest one
        both = now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small-star: smaller neighbours and the vertex itself go to the smallest one
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u"))).distinct()
        step += 1
        now = scratch.save(small, f"{name}{step}")
        if step > 1:
            scratch.drop(f"{name}{step - 2}")


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, class_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch(docs.sparkSession, "near")
    every = scratch.save(docs.mapInArrow(trimmed(_signatures(size)), "doc_id long, n long, h1 long, h2 long, bands array<long>, bits array<long>"), "signatures")
    sets = every.filter("n > 0 and doc_id is not null")
    classes = scratch.save(sets.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("class")), "classes")
    firsts = sets.join(classes, [sets.n == classes.n, sets.h1 == classes.h1, sets.h2 == classes.h2, sets.doc_id == classes["class"]]).select("doc_id", sets.n.alias("n"), sets.h1.alias("h1"), "bands", "bits")
    keys = firsts.select("doc_id", "n", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("size")).filter("least.doc_id < most")
    members = scratch.save(keys.join(buckets, "key").select("key", "doc_id", "n", "least", "size").distinct(), "members")  # rows of one doc_id and text may repeat
    sized = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    met = members.groupBy("doc_id").agg(F.sum("size").alias("met"))
    hubs = members.join(met, "doc_id").groupBy("key").agg(F.max(F.struct("met", "doc_id", "n")).alias("hub"))
    centred = members.join(hubs, "key").select("doc_id", "n", F.explode(F.array(F.struct("least.doc_id", "least.n"), F.struct("hub.doc_id", "hub.n"))).alias("c"))
    centred = centred.filter((F.col("c.doc_id") != F.col("doc_id")) & sized(F.col("n"), F.col("c.n")))
    pairs = centred.select(F.least("c.doc_id", "doc_id").alias("a"), F.greatest("c.doc_id", "doc_id").alias("b")).distinct()
    same_id = sets.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo < hi").select("doc_id")
    pairs = scratch.save(pairs, "pairs")
    links = _confirmed(docs, pairs, size, percent)
    chained = sets.join(same_id, "doc_id").join(classes, ["n", "h1", "h2"]).select(F.col("class").alias("a"), F.col("doc_id").alias("b"))
    links = scratch.save(links.union(chained), "links")
    roots = scratch.save(components(links, scratch, "first"), "roots")
    # buckets that hold several components: their pairs across components
    placed = members.join(roots.withColumnRenamed("v", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("root", "doc_id").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    placed = placed.join(mixed, "key")
    bits = firsts.join(placed.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "n", "h1"]).select("doc_id", "n", "bits")
    placed = scratch.save(placed.join(bits, ["doc_id", "n"]), "mixed")
    x, y = (placed.select(*(F.col(c).alias(f"{c}_{s}") for c in ("key", "doc_id", "n", "root", "bits"))) for s in "xy")
    apart = F.aggregate(F.zip_with("bits_x", "bits_y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + c)
    near = apart * (100 + percent) <= (F.col("n_x") + F.col("n_y")) * (100 - percent)
    across = x.join(y, (F.col("key_x") == F.col("key_y")) & (F.col("root_x") < F.col("root_y")) & sized(F.col("n_x"), F.col("n_y")) & near)
    across = across.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct()
    across = scratch.save(across.join(pairs, ["a", "b"], "left_anti"), "across")
    more = scratch.save(_confirmed(docs, across, size, percent), "more")
    if more.head(1):
        roots = scratch.save(components(links.union(more), scratch, "second"), "roots2")
    out = every.join(classes, ["n", "h1", "h2"], "left").join(roots.withColumnRenamed("v", "class"), "class", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("root", "class", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), F.col("class").alias("class_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near copies, the one of smallest doc_id."""
    docs, named = guarded(docs, "doc_id", "text")
    found = near_duplicates(docs, size, percent)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return named(docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti").select(docs.columns))
