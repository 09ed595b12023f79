"""Winnowing fingerprints: rolling k-gram hashes, the least of each window, rightmost on ties, with positions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, id_text, in_slices

#: A shared run of K + WINDOW - 1 code points always gives a shared hash; no shorter than K ever does.
K = 16
WINDOW = 16
BASE = 0x9E3779B97F4A7C15
SEGMENT = 1 << 22
POSITION_BITS = 24
LEAST = -(1 << 63)


#: Ranges of ids at most: what is broadcast of them stays under 2 MB, and a range is sorted on disk and read as a stream.
MAX_RANGES = 1 << 16


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """Karp-Rabin hashes of all k-grams (k a power of two), modulo 2^64, by doubling; fewer than k points: one of all."""
    h = points.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        if len(points) < k:
            value = np.uint64(0)
            for x in h:
                value = value * np.uint64(BASE) + x
            h = np.array([value] if len(points) else [], np.uint64)
        else:
            have, power = 1, BASE
            while have < k:
                h = h[:-have] * np.uint64(power) + h[have:]
                have, power = 2 * have, power * power & (1 << 64) - 1
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def select(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 40-bit hashes chosen: the least of each window, its rightmost place, each place once."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    chosen = []
    for start in range(0, max(1, n - window + 1), SEGMENT):
        part = hashes[start : start + SEGMENT + window - 1]
        key = (part & ~mask) | (mask - np.arange(len(part), dtype=np.uint64))
        width = min(window, len(part))
        have = 1
        while have < width:
            step = min(have, width - have)
            key = np.minimum(key[:-step], key[step:])
            have += step
        keep = np.ones(len(key), bool)
        keep[1:] = key[1:] != key[:-1]
        key = key[keep]
        chosen.append((start + (mask - (key & mask)).astype(np.int64), key >> np.uint64(POSITION_BITS)))
    at = np.concatenate([c[0] for c in chosen])
    values = np.concatenate([c[1] for c in chosen])
    if len(chosen) > 1:
        at, first = np.unique(at, return_index=True)
        values = values[first]
    return at, values


def fingerprint(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return select(gram_hashes(points))


def digest(chosen: tuple[np.ndarray, np.ndarray]) -> str:
    """Lowercase hex over positions and hashes: equal for equal texts."""
    at, values = chosen
    return hashlib.sha256(at.astype("<i8").tobytes() + values.astype("<u8").tobytes()).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the distinct hashes that both have; 1 for two empty sets. a and b are sorted and distinct."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, positions and hashes (40 bits) for each row of docs; both empty for a null or empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("positions", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in in_slices(batch):
                chosen = [fingerprint(code_points(t)) for t in part.column(1).to_pylist()]
                yield batch_of(schema, [part.column(0), [c[0].tolist() for c in chosen], [c[1].astype(np.int64).tolist() for c in chosen]])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, positions array<bigint>, hashes array<bigint>")


class _Doc:
    def __init__(self, doc_id, text: str) -> None:
        self.doc_id, self.text = doc_id, text
        self.points = code_points(text)
        self.chosen = fingerprint(self.points)
        self.distinct = np.unique(self.chosen[1])


def _row(doc: _Doc, after: _Doc) -> tuple:
    n = len(doc.points)
    half = n // 2
    edited = np.concatenate((doc.points[: n - half], after.points[:half]))
    chosen = fingerprint(edited)
    text = edited.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return doc.doc_id, n, hashlib.sha256(text).hexdigest(), digest(doc.chosen), digest(chosen), likeness(doc.distinct, np.unique(chosen[1])), likeness(doc.distinct, after.distinct), len(doc.chosen[0])


class Ranges:
    """Ranges of (key, hash of the text), by ascending cuts of the key. A key that fills several ranges stands in the
    cuts as often, and its rows are dealt to them by the hash."""

    def __init__(self, cuts: list[int]) -> None:
        self.cuts = np.array(sorted(cuts), np.int64)
        self.heads: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def of(self, key: np.ndarray, h: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.cuts, key, "left"), np.searchsorted(self.cuts, key, "right")
        part = ((h.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)).astype(np.int64) * (high - low) >> 32
        return low + np.where(high > low, 1 + part, 0)

    def set_heads(self, rows: list) -> None:
        """rows of (range, key, h): the greatest of each range that is not empty."""
        rows = sorted((r.range, r.head.key, r.head.h) for r in rows)
        self.heads = tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))

    def before(self, where: np.ndarray, key: np.ndarray, h: np.ndarray) -> np.ndarray:
        """For rows that head their range: the range that stands before it (descending, so above; after the lowest
        comes the highest); -1 for others."""
        place, keys, hashes = self.heads
        at = np.searchsorted(place, where)
        head = (keys[at] == key) & (hashes[at] == h)
        return np.where(head, place[(at + 1) % len(place)], -1)


def _ranges(rows: DataFrame, bucket_bytes: int) -> Ranges:
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    n = min(MAX_RANGES, max(1, size // bucket_bytes))
    ranges = Ranges((rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n).alias("c")).first().c or []) if n > 1 else [])
    schema = pa.schema([("range", pa.int32()), ("key", pa.int64()), ("h", pa.int64())])

    def heads(batches):
        for batch in batches:
            key, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            where = ranges.of(key, h)
            order = np.lexsort((h, key, where))
            last = np.flatnonzero(np.append(where[order][1:] != where[order][:-1], True)) if len(order) else order
            yield batch_of(schema, [where[order][last], key[order][last], h[order][last]])

    found = rows.select("key", "h").mapInArrow(heads, "range int, key bigint, h bigint").groupBy("range").agg(F.max(F.struct("key", "h")).alias("head"))
    ranges.set_heads(found.collect())  # one row for each range
    return ranges


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 2 << 20) -> DataFrame:
    """Each document with its edited form (its last half replaced by the beginning of the next) and both fingerprints.

    Documents stand in descending doc_id, null last, rows of one id by a hash of the text, then the text; after the last
    comes the first. Texts are shuffled once, to ranges of that order; the first document of each range also goes to the
    range before it, so that no task needs another's rows. A range of any size is read as a stream: two documents are
    held. A null text is empty; an empty table gives an empty one."""
    rows = id_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(LEAST)).alias("key"), F.xxhash64("text").alias("h"), "doc_id", "text")
    ranges = _ranges(rows, bucket_bytes)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_selected", pa.int64())])

    def deal(batches):
        for batch in batches:
            key, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            where = ranges.of(key, h)
            before = ranges.before(where, key, h)
            for edge, at, place in ((0, None, where), (1, np.flatnonzero(before >= 0), before)):
                part = batch if at is None else batch.take(pa.array(at))
                if part.num_rows:
                    place = place if at is None else place[at]
                    yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(np.full(len(place), edge, np.int32)), *part.columns], names=["b", "edge", "key", "h", "doc_id", "text"])

    def run(batches):
        now, last, done = None, None, True
        for batch in batches:
            for part in in_slices(batch, 4 << 20):
                out = []
                for b, edge, doc_id, text in zip(*(part.column(i).to_pylist() for i in (0, 1, 4, 5))):
                    if b != now:
                        now, last, done = b, None, False
                    if done:
                        continue
                    doc = _Doc(doc_id, text)
                    if last is not None:
                        out.append(_row(last, doc))
                    last, done = doc, bool(edge)
                if out:
                    yield batch_of(schema, [list(c) for c in zip(*out)])

    sent = rows.mapInArrow(deal, "b int, edge int, key bigint, h bigint, doc_id bigint, text string")
    ordered = sent.repartition("b").sortWithinPartitions("b", "edge", F.desc("key"), F.desc("h"), "text")
    return ordered.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_selected bigint")
