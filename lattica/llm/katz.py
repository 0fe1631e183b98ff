"""Katz backoff n-gram model: Good-Turing discounts, exactly normalised backoff.

P(w | v) = d_r r / D(v) for an n-gram (v, w) seen r > 0 times, else alpha(v) P(w | v'),
where v are the n - 1 words before (back to the start of the text, which counts as a
word) and v' is v without its first word; the recursion ends at P(w). d_r is
Good-Turing's discount of the n-grams of that order for r up to ``K`` and 1 above (where
counts of counts are too thin for it: 1 - 0.5 / r). P(w) is discounted alike and what is
left goes to the one unknown word. D(v) is v's count, plus one where nothing is
discounted (all its r are above K) or v makes up over 1/HOT of all tokens, so there is
always mass to back off to. alpha(v) shares what is left of v's mass among the words not
seen after v, so each context sums to 1. A text's first words have the contexts they
have: the first word a bigram's, the second a trigram's.

Texts are read once: per batch of about ``BATCH`` bytes, tokens become indices into
the batch's sorted distinct words. All that crosses the network are packed blocks,
with one entry per batch and distinct word or n-gram:

words    blocks are dealt by word hash; each partition counts its words, gives them
         ids (frequent words small ones) and answers each block.
n-grams  for each order from 2, batches, joined with the answers of the order below,
         deal their distinct n-grams by context, so a context's counts and backoff sums
         meet in one partition; contexts over 1/HOT of all tokens (at most HOT of them)
         are dealt by the n-gram instead, and their few sums are put together
         afterwards. Each block is answered by r.
scores   batches, joined with all answers, are evaluated token by token.

Each order's partitioned table of counts and sums, in the form of its answers, is
written to the shared folder; tables of counts are never collected or broadcast, only
counts of counts and the hot contexts' sums.

Defined cases: null text has just the end token; a null doc_id is learnt from;
repeated rows count again; with nothing to learn from every probability is that of
the unknown word, 1.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, binary, groups, n_parts, slabs, trimmed
from lattica.llm.hashing import U, mix, words

K, HOT, BATCH = 5, 1000, 1 << 23
END = U(0xE5D0C1B2A3948576)
START = U((1 << 64) - 1)
ORDER = 3
BATCHES = "bid long, doc_id array<long>, held array<boolean>, ends binary, tokens binary, part binary, vocab binary, seen binary, counts binary, what string"


def _pack(*cols: np.ndarray, level: int = 1) -> bytes:
    """Columns of one length, their bytes by significance and compressed; whole numbers (none below 0) in as many bytes as the largest needs."""
    n, widths, planes = len(cols[0]), [], []
    for c in map(np.ascontiguousarray, cols):
        width = c.itemsize if c.dtype.kind == "f" else max(1, -(-int(c.max()).bit_length() // 8)) if n else 1
        rows = c.view(np.uint8).reshape(n, c.itemsize)
        widths.append(width)
        planes += [rows[:, j].tobytes() for j in range(width)]
    return zstandard.compress(n.to_bytes(8, "little") + bytes(widths) + b"".join(planes), level)


def _unpack(data, kinds: str) -> list[np.ndarray]:
    raw, kinds = zstandard.decompress(data), kinds.split()
    n, at, out = int.from_bytes(raw[:8], "little"), 8 + len(kinds), []
    for width, kind in zip(raw[8:at], map(np.dtype, kinds), strict=True):
        if width == 1 and kind.kind != "f":
            c = np.frombuffer(raw, np.uint8, n, at).astype(kind)
        else:
            c = np.zeros(n, kind)
            rows = c.view(np.uint8).reshape(n, kind.itemsize)
            for j in range(width):
                rows[:, j] = np.frombuffer(raw, np.uint8, n, at + j * n)
        out.append(c)
        at += n * width
    return out


def _by_count(counts: np.ndarray) -> np.ndarray:
    """A batch's words, the most frequent first: small numbers for most tokens."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def _split(parts: int):
    """Batches of rows (doc_id, held, text), as two rows each: ``tokens`` stays, ``words`` is what the word counts ask."""
    names = [x.split()[0] for x in BATCHES.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 6, pa.string()]

    def fn(batches):
        bid = TaskContext.get().partitionId() << 24
        for batch in slabs(batches, BATCH):
            ids, held = batch.column(0), np.asarray(batch.column(1).to_pylist(), bool)
            texts = binary(batch.column(2))
            for lo, hi in groups(texts, BATCH):
                hs, ends = [], []
                for a, b in groups(texts[lo:hi]):
                    h, e = words(texts[lo + a : lo + b], space_only=True)
                    hs.append(np.insert(h, e, END))  # an end after each text
                    ends.append(np.diff(e, prepend=0) + 1)
                vocab, tokens = np.unique(np.concatenate(hs), return_inverse=True)
                sizes = np.concatenate(ends)
                known = np.repeat(~held[lo:hi], sizes)
                seen = np.bincount(tokens[known], minlength=len(vocab))
                counts = np.bincount(tokens, minlength=len(vocab))
                rank = np.empty(len(vocab), "<u4")
                rank[_by_count(counts)] = np.arange(len(vocab), dtype="<u4")
                pack = lambda x: _pack(x.astype("<u4"), level=3)
                keep = [bid, ids.slice(lo, hi - lo).to_pylist(), held[lo:hi].tolist(), pack(np.cumsum(sizes)), pack(rank[tokens]), pack(_part(vocab, parts)), None, None, pack(counts), "tokens"]
                ask = [bid, None, None, None, None, None, _pack(np.diff(vocab, prepend=U(0))), pack(seen), None, "words"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(keep, ask, strict=True), kinds, strict=True)], names=names)
                bid += 1

    return fn


def _part(vocab: np.ndarray, parts: int) -> np.ndarray:
    return mix(vocab) % U(parts)


def _dealt(bid: int, order: np.ndarray, cuts: np.ndarray, cols: list[np.ndarray]):
    """(pid, bid, packed columns) of the entries of each partition, in ``order``; the first column, which rises, as differences."""
    rows = []
    for pid in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[pid] : cuts[pid + 1]]
        first = cols[0][own]
        first[1:] -= first[:-1].copy()
        rows.append((int(pid), _pack(first, *(c[own] for c in cols[1:]))))
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([bid] * len(rows), pa.int64()), pa.array([d for _, d in rows], pa.binary())], names=["pid", "bid", "data"])


def _order(part: np.ndarray, first: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by partition and first column, each partition's cuts in it)."""
    order = np.argsort(first)
    part = part[order].astype(np.uint16 if parts < 1 << 16 else np.int64)  # short numbers sort by counting
    own = np.argsort(part, kind="stable")
    return order[own], np.searchsorted(part[own], np.arange(parts + 1))


def _ask_words(parts: int):
    def fn(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                vocab, seen = (_unpack(batch.column(j)[i].as_buffer(), t)[0] for j, t in ((1, "<u8"), (2, "<u4")))
                vocab = np.cumsum(vocab, dtype=U)
                yield _dealt(batch.column(0)[i].as_py(), *_order(_part(vocab, parts), vocab, parts), [vocab, seen])

    return fn


ASK = "pid int, bid long, data binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
#: kind 0: answers; 1: counts of counts; 2: totals; 3: words and n-grams that may be hot contexts; 4: sums of hot contexts.
ANSWER = "bid long, pid int, data binary, kind int, a long, b long, sums array<double>"


def _answers(rows: list[tuple], pid: int) -> pa.RecordBatch:
    cols = list(zip(*((*r, None)[:6] for r in rows), strict=True))
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
    bid, data, kind, a, b, sums = (pa.array(c, t) for c, t in zip(cols, kinds, strict=True))
    return pa.RecordBatch.from_arrays([bid, pa.array([pid] * len(rows), pa.int32()), data, kind, a, b, sums], names=["bid", "pid", "data", "kind", "a", "b", "sums"])


def _two(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "little") + a + b


def _counts_of(r: np.ndarray) -> list[tuple]:
    n = np.bincount(r[(r > 0) & (r <= K + 1)], minlength=K + 2)
    return [(None, None, 1, i, int(n[i])) for i in range(1, K + 2)]


def _gathered(batches, kinds: str):
    """(partition, batches' numbers, their blocks' sizes, columns of all blocks)."""
    bids, blocks, pid = [], [], 0
    for batch in batches:
        for p, bid, d in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
            pid = p
            bids.append(bid)
            blocks.append(_unpack(d, kinds))
            np.cumsum(blocks[-1][0], out=blocks[-1][0])
    return pid, bids, [len(b[0]) for b in blocks], [np.concatenate(x) for x in zip(*blocks, strict=True)]


def _count_words(parts: int):
    def fn(batches):
        pid, bids, sizes, cols = _gathered(batches, "<u8 <u4")
        if not bids:
            return
        uniq, at = np.unique(cols[0], return_inverse=True)
        c = np.bincount(at, cols[1], len(uniq)).astype(np.int64)
        ids = np.empty(len(uniq), "<u8")
        ids[np.argsort(-c, kind="stable")] = np.arange(len(uniq), dtype="<u8") * U(parts) + U(pid)
        stats = [*_counts_of(c), (None, None, 2, int(c.sum()), int((c > 0).sum()))]
        stats += [(None, ids[i : i + 1].tobytes(), 3, 0, int(c[i])) for i in np.flatnonzero(c * HOT > c.sum())]
        yield _answers(stats, pid)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        for i, bid in enumerate(bids):
            own = at[cuts[i] : cuts[i + 1]]
            yield _answers([(bid, _pack(c[own], ids[own]), 0, 0, 0)], pid)

    return fn


class Discounts:
    """Good-Turing's discounts for r = 1..K from counts of counts n[1..K+1]."""

    def __init__(self, n: dict[int, int]):
        self.d = np.ones(K + 2)
        n1 = n.get(1, 0)
        common = (K + 1) * n.get(K + 1, 0) / n1 if n1 else 1.0
        for r in range(1, K + 1):
            nr, up = n.get(r, 0), n.get(r + 1, 0)
            d = ((r + 1) * up / (r * nr) - common) / (1 - common) if nr and common < 1 else 0.0
            self.d[r] = d if 0.05 < d < 1 else 1 - 0.5 / r

    def mass(self, r: np.ndarray) -> np.ndarray:
        return self.d[np.minimum(r, K + 1)] * r


class Unigrams(Discounts):
    def __init__(self, n: dict[int, int], total: int, distinct: int):
        super().__init__(n)
        self.total, self.distinct = total, distinct
        small = sum(n.get(r, 0) * r * (1 - self.d[r]) for r in range(1, K + 1))
        self.extra = 0 if small > 0 else 1  # keeps something for the unknown word
        self.unknown = (small + self.extra) / (total + self.extra) if total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        """P of words of count c; the unknown word's where c is 0."""
        return np.where(c > 0, self.mass(c) / max(1, self.total + self.extra), self.unknown)

    def logp(self, c: np.ndarray) -> np.ndarray:
        return np.log10(self.p(c))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def _known(part: np.ndarray, answers: list, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and id of each of a batch's words."""
    c, ids = np.zeros(len(part), np.int64), np.zeros(len(part), U)
    order, at = _order(part, np.arange(len(part)), parts)
    for a in answers:
        own = order[at[a["pid"]] : at[a["pid"] + 1]]
        c[own], ids[own] = _unpack(a["data"], "<i8 <u8")
    return c, ids


def _alpha(sums: np.ndarray, d: np.ndarray, hot) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, D) of contexts with sums: counts of r = 1..K, the sum of larger r, the seen words' P."""
    r = np.arange(1, K + 1)
    count = r @ sums[:K] + sums[K]
    big_d = count + (hot | (sums[:K].sum(axis=0) == 0))
    kept = (d[1 : K + 1] * r) @ sums[:K] + sums[K]
    alpha = np.where(count > 0, (1 - kept / np.maximum(big_d, 1)) / np.maximum(1 - sums[K + 1], 1e-300), 1.0)
    return alpha, big_d


def _chain(cols: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of id columns."""
    h = mix(cols[0] + U(0x9E3779B97F4A7C15))
    for c in cols[1:]:
        h = mix(h * U(0xD1342543DE82EF95) + c)
    return h


def _distinct(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct tuple, each row's tuple): by one hash, or by all columns where hashes of different tuples agree."""
    h = _chain(cols)
    by = np.argsort(h)
    h = h[by]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    changed = np.logical_or.reduce([c[by][1:] != c[by][:-1] for c in cols])
    if (changed & ~new[1:]).any():
        by = np.lexsort(cols[::-1])
        new = np.concatenate([[True], np.logical_or.reduce([c[by][1:] != c[by][:-1] for c in cols])])
    at = np.empty(len(by), np.int64)
    at[by] = np.cumsum(new) - 1
    return by[new], at


class Hot:
    """The contexts of one order that are split, by their ids; those whose hashes agree with an earlier one's stay whole."""

    def __init__(self, cols: list[np.ndarray]):
        h = _chain(cols)
        self.h, at = np.unique(h, return_index=True)
        self.cols = [c[at] for c in cols]

    def find(self, cols: list[np.ndarray], h: np.ndarray) -> np.ndarray:
        """Each context's number, or -1."""
        if not len(self.h):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        same = self.h[i] == h
        for own, c in zip(self.cols, cols, strict=True):
            same &= own[i] == c
        return np.where(same, i, -1)


class Level:
    """What is known of one order: its discounts and its hot contexts' alpha and D."""

    def __init__(self, counts: dict[int, int], hot: Hot, sums: np.ndarray):
        self.discounts, self.hot = Discounts(counts), hot
        alpha, d = _alpha(sums, self.discounts.d, True)
        # one more at the end, where -1 points: contexts that are not hot
        self.alpha, self.d = np.append(np.log10(np.maximum(alpha, 1e-300)), 0.0), np.append(d, 0).astype(np.int64)


class Grams:
    """A batch's distinct n-grams of one order: context, last word and lower n-gram by their numbers in the batch, and ids."""

    def __init__(self, at: np.ndarray, ctx: np.ndarray, w: np.ndarray, low: np.ndarray, valid: np.ndarray, ctx_ids: list[np.ndarray], ids: np.ndarray):
        key, inverse = np.unique((ctx[valid] << np.int64(32)) | w[valid], return_inverse=True)
        self.ctx, self.w = key >> np.int64(32), key & np.int64(0xFFFFFFFF)
        if len(inverse) == len(at):
            self.at = inverse
        else:
            self.at = np.full(len(at), -1, np.int64)  # each token's n-gram
            self.at[valid] = inverse
        self.low = np.empty(len(key), np.int64)
        self.low[inverse] = low[valid]
        self.context = [c[self.ctx] for c in ctx_ids]
        self.ids = [*self.context, ids[self.w]]

    def deal(self, hot: Hot, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, cuts of partitions, hot contexts' numbers)."""
        h = _chain(self.context)
        i = hot.find(self.context, h)
        if len(own := np.flatnonzero(i >= 0)):
            h[own] = mix(h[own] ^ mix(self.ids[-1][own]))
        part = h % U(parts)
        return *_order(part, self.ids[0], parts), i


class Batch:
    """A batch with the answers of some orders."""

    def __init__(self, batch, i: int, columns: dict[str, int], uni, levels: list[Level], hot: Hot | None, parts: int, scores: bool):
        unpacked = lambda name: _unpack(batch.column(columns[name])[i].as_buffer(), "<u4")[0]
        self.held = np.asarray(batch.column(columns["held"])[i].as_py(), bool)
        ends, counts, part = unpacked("ends").astype(np.int64), unpacked("counts"), unpacked("part")
        self.tokens, self.starts, self.sizes = _by_count(counts)[unpacked("tokens")], np.concatenate([[0], ends[:-1]]).astype(np.int64), np.diff(ends, prepend=0)
        self.c, ids = _known(part, batch.column(columns["l1"])[i].as_py(), parts)
        n, first = len(self.tokens), np.zeros(len(self.tokens), bool)
        first[self.starts] = True
        at, low_r, ctx_ids = self.tokens, self.c, [np.append(ids, START)]
        self.logp = None
        logp, below = (uni.logp(self.c) if scores else None), None
        self.grams = self.low = None
        for order in range(2, 2 + len(levels) + (hot is not None)):
            ctx = np.empty(n, np.int64)
            ctx[1:] = at[:-1]
            ctx[first] = len(ids) if order == 2 else -1
            g = Grams(at, ctx, self.tokens, at, ctx >= 0, ctx_ids, ids)
            if order - 2 == len(levels):  # still to be asked
                self.grams, self.dealt, self.low = g, g.deal(hot, parts), [low_r[g.low]] if below is None else [low_r[g.low], below[g.low]]
                break
            level = levels[order - 2]
            deal, cuts, hots = g.deal(level.hot, parts)
            r, plain, back = np.zeros(len(g.w), np.int64), np.zeros(len(g.w), np.int64), np.zeros(len(g.w))
            for a in batch.column(columns[f"l{order}"])[i].as_py():
                own = deal[cuts[a["pid"]] : cuts[a["pid"] + 1]]
                size = int.from_bytes(a["data"][:8], "little")
                r[own], plain[own] = got, _ = _unpack(a["data"][8 : 8 + size], "<i8 u1")
                if scores and len(sums := np.stack(_unpack(a["data"][8 + size :], "<f8 " * (K + 2))).T):
                    unseen = own[got == 0]
                    back[unseen[hots[unseen] < 0]] = np.log10(np.maximum(_alpha(sums.T, level.discounts.d, False)[0], 1e-300))
            split = np.flatnonzero(hots >= 0)
            big_d = (np.append(low_r, 0) if order == 2 else low_r)[g.ctx] + plain  # the contexts' counts; the start is hot
            big_d[split] = level.d[hots[split]]
            if scores:
                back[split] = level.alpha[hots[split]]
                unseen = np.flatnonzero(r == 0)
                back[unseen] += logp[g.low[unseen]]
                seen = np.flatnonzero(r)
                many = r[seen]
                back[seen] = np.log10(level.discounts.mass(many) / np.maximum(big_d[seen], 1))
                logp = back
                if order == 2:  # each word has a bigram
                    self.logp = logp[g.at]
                else:
                    there = g.at >= 0
                    self.logp[there] = logp[g.at[there]]
            at, low_r, below, ctx_ids = g.at, r, big_d, g.ids

    def asked(self, bid: int) -> pa.RecordBatch:
        """The blocks that ask for the order that is not known yet."""
        g, (order, cuts, _) = self.grams, self.dealt
        train = (g.at >= 0) & np.repeat(~self.held, self.sizes)
        seen = np.bincount(g.at[train], minlength=len(g.w)).astype("<u4")
        return _dealt(bid, order, cuts, [*g.ids, seen, *self.low])


def _rows(columns: list[str], *args):
    """Each row of the joined table as a Batch."""
    place = {c: j for j, c in enumerate(columns)}

    def fn(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch, i, Batch(batch, i, place, *args)

    return fn


def _ask(columns: list[str], uni, levels: list[Level], hot: Hot, parts: int):
    each = _rows(columns, uni, levels, hot, parts, False)

    def fn(batches):
        for batch, i, b in each(batches):
            yield b.asked(batch.column(columns.index("bid"))[i].as_py())

    return fn


def _count(order: int, uni, below: Discounts | None, hot: Hot, total: int):
    """Counts of one order's n-grams and their contexts' sums; answers to all blocks."""

    def fn(batches):
        pid, bids, sizes, cols = _gathered(batches, "<u8 " * order + "<u4 <i8" + " <i8" * (order > 2))
        if not bids:
            return
        ids, seen, low = cols[:order], cols[order], cols[order + 1 :]
        del cols
        first, at = _distinct(ids)
        grams = [c[first] for c in ids]
        lead, of = _distinct(grams[:-1])
        n = len(lead)
        r = np.bincount(at, seen, len(first)).astype(np.int64)
        p, there = np.zeros(len(first)), r > 0
        own = first[there]
        p[there] = uni.p(low[0][own]) if order == 2 else below.mass(low[0][own]) / np.maximum(low[1][own], 1)
        small = np.bincount(of * (K + 2) + np.minimum(r, K + 1), minlength=n * (K + 2)).reshape(n, K + 2).T
        large = r > K
        sums = np.stack([*small[1 : K + 1].astype(float), np.bincount(of[large], r[large], n), np.bincount(of, p, n)])
        contexts = [c[lead] for c in grams[:-1]]
        hots = hot.find(contexts, _chain(contexts))
        rows = [*_counts_of(r)]
        rows += [(None, None, 4, int(hots[j]), 0, sums[:, j].tolist()) for j in np.flatnonzero(hots >= 0)]
        rows += [(None, b"".join(c[j : j + 1].tobytes() for c in grams), 3, 0, int(r[j])) for j in np.flatnonzero(r * HOT > total)]
        yield _answers(rows, pid)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        plain = (sums[:K].sum(axis=0) == 0) & (hots < 0)
        for i, bid in enumerate(bids):
            own = at[cuts[i] : cuts[i + 1]]
            ctx = of[own]
            # a context that is not hot sends its sums where they are needed: to its unseen words
            none = (r[own] == 0) & (hots[ctx] < 0)
            yield _answers([(bid, _two(_pack(r[own], plain[ctx].astype("u1")), _pack(*sums[:, ctx[none]].astype("<f8"))), 0, 0, 0)], pid)

    return fn


def _evaluate(columns: list[str], uni, levels: list[Level], parts: int):
    each = _rows(columns, uni, levels, None, parts, True)

    def fn(batches):
        for batch, i, b in each(batches):
            add = lambda x: np.add.reduceat(x, b.starts)
            cols = [b.held, b.sizes, add((b.c > 0)[b.tokens].astype(np.int64)), add(uni.base(b.c)[b.tokens]), add(b.logp)]
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(columns.index("doc_id"))[i].as_py(), pa.int64()), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return fn


def _free(spark) -> None:
    """Lets Spark delete the shuffle files of a stage that is written: the driver's references to it go first."""
    gc.collect()
    spark._jvm.System.gc()


def _nothing(spark) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def report(docs: DataFrame, held_out: Column, order: int = ORDER) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; order: the longest n-grams', 2 at least."""
    spark = docs.sparkSession
    scratch, parts = Scratch(spark, "katz"), n_parts(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), "text")
    split = scratch.save_apart(rows.mapInArrow(trimmed(_split(parts)), BATCHES), "what", "batches")
    if not split:
        return _nothing(spark)
    asked = split["words"].select("bid", "vocab", "seen").mapInArrow(trimmed(_ask_words(parts)), ASK).repartitionById(parts, "pid")
    told = scratch.save(asked.mapInArrow(trimmed(_count_words(parts)), ANSWER), "told1")
    del asked
    scratch.drop("batches/what=words")
    _free(spark)

    def counts(df):
        return {r.a: r.n for r in df.filter("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).collect()}

    def hot_ids(df, n):  # at most HOT rows
        found = sorted(bytes(r.data) for r in df.filter(f"kind = 3 and b * {HOT} > {total}").select("data").collect())
        return list(np.frombuffer(b"".join(found), "<u8").reshape(-1, n).T)

    total, distinct = (x or 0 for x in told.filter("kind = 2").agg(F.sum("a"), F.sum("b")).first())
    uni, levels = Unigrams(counts(told), total, distinct), []
    _free(spark)
    names = ["bid", "doc_id", "held", "ends", "tokens", "part", "counts"]
    answers = lambda df, name: df.filter("kind = 0").groupBy("bid").agg(F.collect_list(F.struct("pid", "data")).alias(name))
    batches, last = split["tokens"].select(*names), "batches"
    for n in range(2, order + 1):
        # written once more with the answers of the order below, so the shuffle files go before the next come
        names = [*names, f"l{n - 1}"]
        batches = scratch.save(batches.join(answers(told, names[-1]).hint("shuffle_hash"), "bid").select(*names), f"known{n}")
        hot = hot_ids(told, n - 1)
        hot = Hot([np.append(hot[0], START)] if n == 2 else hot)
        for name in (last, f"told{n - 1}"):
            scratch.drop(name)
        last = f"known{n}"
        _free(spark)
        need = [c for c in names if c != "doc_id"]
        asked = batches.select(*need).mapInArrow(trimmed(_ask(need, uni, levels, hot, parts)), ASK).repartitionById(parts, "pid")
        told = scratch.save(asked.mapInArrow(trimmed(_count(n, uni, levels[-1].discounts if levels else None, hot, total)), ANSWER), f"told{n}")
        del asked
        _free(spark)
        sums = np.zeros((K + 2, len(hot.h)))
        part = told.filter("kind = 4").groupBy("a").agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(K + 2)))
        for r in part.collect():  # a row per hot context
            sums[:, r.a] = r[1:]
        levels.append(Level(counts(told), hot, sums))
        _free(spark)  # what the scheduler still held of the exchange before these small jobs
    names = [*names, f"l{order}"]
    joined = batches.join(answers(told, names[-1]).hint("shuffle_hash"), "bid").select(*names)
    out = joined.mapInArrow(trimmed(_evaluate(names, uni, levels, parts)), SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
