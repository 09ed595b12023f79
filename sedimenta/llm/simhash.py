"""SimHash near-duplicate groups, found by the generalised pigeonhole principle.

Bits that agree together are put in one partition; a threshold for each partition is chosen by dynamic programming
so that the thresholds sum to radius - partitions + 1. Two fingerprints within the radius then agree, in at least one
partition, within that partition's threshold. Candidates are probed by partition values and verified on all bits.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, byte_column, checkpoint, id_text, in_slices
from .graph import components

BITS = 64
#: Rows of one probe bucket that one task compares; larger buckets are cut into pairs of parts of about this size.
BUCKET_ROWS = 20_000


#: A byte's bits as the eight bytes of a word, so that up to 255 words add up without a carry.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


def majorities(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each run of hashes between edges, the bits that are set in over half of it; 0 for an empty run."""
    out, size = np.zeros(len(edges) - 1, np.uint64), np.diff(edges)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    blocks = -(-size[full] // 255)
    first = np.cumsum(blocks) - blocks
    at = np.repeat(edges[:-1][full], blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    lanes = np.empty((len(at), 8), np.uint64)
    rows = np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes[:, k] = np.add.reduceat(_LANES[rows[:, k]], at)
    ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, BITS).astype(np.int64), first, axis=0)
    out[full] = np.packbits(2 * ones > size[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of k words, joined by spaces; of all words where they are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, len(words) - k + 1)


def fingerprints(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (xxhash64 of the text) and the 64-bit fp of k-word shingles, repeats included. One row for each row
    of docs. A text without words has all bits zero."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in in_slices(batch):
                hashes = [shingle_hashes(text, k) for text in byte_column(part.column(1))]
                edges = np.concatenate(([0], np.cumsum([len(h) for h in hashes])))
                yield batch_of(schema, [part.column(0), part.column(2), majorities(np.concatenate([*hashes, np.zeros(0, np.uint64)]), edges).view(np.int64)])

    return id_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text")).mapInArrow(run, "doc_id bigint, h bigint, fp bigint")


@dataclass(frozen=True)
class Plan:
    """Bit positions of each partition, and its threshold (-1: it is not probed)."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float


def agreement(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each pair of bits how many have both set: 64 x 64 sums by partition."""
    schema = pa.schema([("a", pa.int32()), ("sums", pa.list_(pa.int64())), ("n", pa.int64())])

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, n = total + bits.T @ bits, n + len(bits)
        if n:
            yield batch_of(schema, [list(range(BITS)), [r.astype(np.int64).tolist() for r in total], [n] * BITS])

    rows = fps.select("fp").mapInArrow(run, "a int, sums array<bigint>, n bigint").groupBy("a").agg(F.array(*[F.sum(F.col("sums")[b]) for b in range(BITS)]).alias("sums"), F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    for r in rows:
        both[r.a] = r.sums
    return (rows[0].n if rows else 0), both


def correlated_parts(n: int, both: np.ndarray, m: int) -> tuple[tuple[int, ...], ...]:
    """Greedy grouping: each partition takes a free bit, then the free bit most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    free, parts = list(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        part = [free.pop(0)]
        while len(part) < size:
            nxt = max(free, key=lambda b: (round(float(corr[b, part].sum()), 9), -b))
            free.remove(nxt)
            part.append(nxt)
        parts.append(tuple(sorted(part)))
    return tuple(parts)


def _value(part: tuple[int, ...]):
    """A partition's value as a long: its bits side by side."""
    out = F.lit(0).cast("bigint")
    for k, b in enumerate(part):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("bigint")), k))
    return out


def choose_plan(fps: DataFrame, radius: int, sizes: tuple[int, ...], pair_cost: float = 3e-9, key_cost: float = 2e-6) -> Plan:
    """The number of partitions, and by dynamic programming their thresholds, of least estimated cost.

    Pairs that agree in a whole partition are counted over all fingerprints. Those within t bits are estimated from
    these counts and each bit's own rate of agreement."""
    n, both = agreement(fps)
    if n < 2:
        return Plan((tuple(range(BITS)),), (0,), 0.0)
    p = np.diag(both) / n
    match = np.clip(p**2 + (1 - p) ** 2, 1e-3, 1 - 1e-3)
    layouts = {m: correlated_parts(n, both, m) for m in sizes}
    values = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), _value(part).alias("v")) for m, parts in layouts.items() for i, part in enumerate(parts)]
    counted = fps.select(F.explode(F.array(*values)).alias("x")).groupBy("x.m", "x.i", "x.v").count().groupBy("m", "i").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()
    same = {(r.m, r.i): r.pairs for r in counted}
    best = None
    for m, parts in layouts.items():
        cost = []
        for i, part in enumerate(parts):
            odds, poly = [(1 - match[b]) / match[b] for b in part], np.array([1.0])
            for o in odds:
                poly = np.convolve(poly, [1.0, o])
            exact = max(same.get((m, i), 0.0), n * (n - 1) / 2 * float(np.prod(match[list(part)])))
            row = {-1: 0.0}
            for t in range(min(radius, len(part)) + 1):
                keys = sum(comb(len(part), d) for d in range((t + 1) // 2 + 1)) + (t % 2) * sum(comb(len(part), d) for d in range(t // 2 + 1))
                row[t] = n * keys * key_cost + exact * float(poly[: t + 1].sum()) * pair_cost
            cost.append(row)
        goal = radius - m + 1
        states: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for row in cost:
            following: dict[int, tuple[float, tuple[int, ...]]] = {}
            for total, (c, chosen) in states.items():
                for t, extra in row.items():
                    now = (c + extra, (*chosen, t))
                    if total + t not in following or now < following[total + t]:
                        following[total + t] = now
            states = following
        if goal in states and (best is None or states[goal][0] < best.cost):
            best = Plan(parts, states[goal][1], states[goal][0])
    return best


def _masks(width: int, reach: int) -> list[int]:
    return [sum(1 << b for b in bits) for d in range(reach + 1) for bits in combinations(range(width), d)]


def _filed(i: int, value):
    return lambda x: F.struct(F.lit(i).alias("part"), value.bitwiseXOR(x["m"]).alias("value"), x["side"].alias("side"))


def signatures(fps: DataFrame, plan: Plan) -> DataFrame:
    """A row for each fingerprint and value under which it is filed (side 1), looked up (2) or both (3)."""
    each = []
    for i, (part, t) in enumerate(zip(plan.parts, plan.thresholds, strict=True)):
        if t < 0:
            continue
        near, far = _masks(len(part), t // 2), _masks(len(part), (t + 1) // 2)
        pairs = [(m, 3 if k < len(near) else 2) for k, m in enumerate(far)]
        value = _value(part)
        masks = F.array(*[F.struct(F.lit(m).cast("bigint").alias("m"), F.lit(s).cast("int").alias("side")) for m, s in pairs])
        each.append(F.transform(masks, _filed(i, value)))
    return fps.select("*", F.explode(F.concat(*each)).alias("s")).select("*", "s.*").drop("s")


def _forest(node, side, fp, radius):
    """Edges that connect, within one bucket, just what its links connect: blocks of filed rows against looked-up ones."""
    rows, cols = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    label = np.arange(len(node))
    out = []

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for start in range(0, len(rows), 128):
        block = rows[start : start + 128]
        for c0 in range(0, len(cols), 8192):
            chunk = cols[c0 : c0 + 8192]
            near = np.bitwise_count(fp[block][:, None] ^ fp[chunk][None, :]) <= radius
            first, linked = near.argmax(0), near.any(0)
            hit = np.flatnonzero(linked)
            edges = [(block[first[hit]], chunk[hit])]
            for f in np.unique(first[hit]):
                also = np.flatnonzero(near[:, hit[first[hit] == f]].any(1))
                edges.append((np.full(len(also), block[f]), block[also]))
            u, v = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
            differ = label[u] != label[v]
            for x, y in zip(u[differ].tolist(), v[differ].tolist()):
                rx, ry = root(x), root(y)
                if rx != ry:
                    label[max(rx, ry)] = min(rx, ry)
                    out.append((node[x], node[y]))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up
    return out


def _compared(signed: DataFrame, names: tuple[str, ...], found, worth=None, more: tuple[str, ...] = ()) -> DataFrame:
    """Distinct pairs (u, v) that found(node, side, columns of names) gives within buckets of signed(part, value, side,
    node, *names). Buckets over BUCKET_ROWS are cut into parts, and every pair of parts is compared by a task of its own.

    worth(bounds, columns of names) may tell for many buckets at once which of them to look into; more names further
    whole numbers that found gives with each pair."""
    large = signed.groupBy("part", "value").count().where(F.col("count") > BUCKET_ROWS).select("part", "value", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("g"))
    cut = signed.join(large, ["part", "value"], "left").withColumn("g", F.coalesce("g", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("g")).cast("int")
    spread = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    keyed = spread.select(F.xxhash64("part", "value", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "part", "value", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "side", "node", *names)
    schema = pa.schema([(n, pa.int64()) for n in ("u", "v", *more)])

    def run(batches):
        seen: set = set()
        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in cols[:4]], axis=0)) + 1
            last = new[-1] if len(new) else 0
            held = [c[last:] for c in cols]
            yield from emit([c[:last] for c in cols], new, seen)
        if held is not None and len(held[0]):
            yield from emit(held, np.zeros(0, np.int64), seen)

    def emit(cols, new, seen):
        bounds = np.concatenate(([0], new[new < len(cols[0])], [len(cols[0])])).astype(np.int64)
        pairs, words = [], [c.view(np.uint64) for c in cols[6:]]
        for k in np.flatnonzero((np.diff(bounds) > 1) if worth is None else worth(bounds, words)):
            a, b = bounds[k], bounds[k + 1]
            pairs += found(cols[5][a:b], cols[4][a:b], [w[a:b] for w in words])
        fresh = [(int(min(x[:2])), int(max(x[:2])), *x[2:]) for x in pairs]
        fresh = [x for x in dict.fromkeys(fresh) if x not in seen]
        if len(seen) < 200_000:
            seen.update(fresh)
        if fresh:
            yield batch_of(schema, [list(c) for c in zip(*fresh)])

    dealt = keyed.repartition("bucket").sortWithinPartitions("bucket", "part", "value", "lo", "hi")
    return dealt.drop("bucket").mapInArrow(run, ", ".join(f"{n} bigint" for n in schema.names)).distinct()


def links(fps: DataFrame, plan: Plan, radius: int) -> DataFrame:
    """Edges (u, v) between nodes of fps(node, fp) whose transitive closure is that of all links.

    A bucket of any size gives fewer edges than it has rows."""
    return _compared(signatures(fps.select("node", "fp"), plan), ("fp",), lambda node, side, words: _forest(node, side, words[0], radius))


def _classes(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rows(node, ...) with component_id: the least doc_id of nodes(node, least_id) reachable over edges, or none."""
    joined = components(edges)
    classes = nodes.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "least_id")
    least = checkpoint(classes.groupBy("component").agg(F.min("least_id").alias("component_id")))  # so that a hot component can be split
    return rows.join(classes.join(least, "component").select("node", "component", "component_id"), "node")


def group(rows: DataFrame, radius: int, sizes: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """rows(doc_id, h, fp) with component_id: the smallest doc_id reachable over links, itself included.

    Fingerprints link at radius or fewer differing bits. Equal fingerprints are one node, so copies cost one row; an
    empty table gives an empty one; a null doc_id is linked like any other but never is a component_id, unless all ids
    of a group are null."""
    rows = checkpoint(rows.withColumn("node", F.col("fp")))
    fps = checkpoint(rows.groupBy("node", "fp").agg(F.min("doc_id").alias("least_id")))
    plan = choose_plan(fps, radius, sizes)
    return _classes(rows, fps, links(fps, plan, radius)).drop("node", "component")


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs. Null texts have no words."""
    rows = group(fingerprints(docs, k, id_col=id_col, text_col=text_col), radius)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
