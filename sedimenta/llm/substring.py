"""Substring dedup: windows of words, a count-min prefilter, exact groups of what it leaves, and removal.

Documents are dealt by a hash to buckets of about BUCKET_BYTES, so a bucket is a function of the table. Each bucket
sketches the windows that it holds; a sketch row is cut into as many blocks as there are buckets. A block's task adds
up what all buckets sent (sums never count too few) and answers, for each cell a bucket sent, whether it was counted
twice. No task, and never the driver, holds more than one block, so the sketch filters alike at every size. Only windows
counted twice in every row are then sent to be grouped exactly, by 128 bits of hash (two different windows of one group
in 2^64 windows have odds of about 1 in 2); the answer is a bit for each: whether the bucket has the first holder.
The dealt texts are shuffled once: all three passes read the same exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, id_text
from .wordhash import Words, mixed, runs, slices, whole_runs, words_of

WINDOW = 13
DEPTH = 2
#: Text of one bucket, and the cells of each row that stand for as much text: about three for a window.
BUCKET_BYTES = 8 << 20
SPAN = 1 << 22
LAST = (1 << 63) - 1
OWNED = DEPTH  # the kind of answer that follows those of the sketch's rows

SKETCH = "block int, row int, f int, n int, data binary"
ANSWER = "f int, kind int, block int, n int, data binary"
CANDIDATES = "block int, f int, h binary, more binary, ids binary"


def pack(values: np.ndarray) -> bytes:
    """Sorted numbers as gaps of seven bits a byte, lowest first; the high bit says that the gap goes on."""
    gaps = np.diff(values, prepend=values.dtype.type(0)).astype(np.uint64)
    size = np.ones(len(gaps), np.int64)
    for k in range(1, 5):
        size += gaps >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        at = np.flatnonzero(size > k)
        if not len(at):
            break
        goes_on = (size[at] > k + 1).astype(np.uint64) << np.uint64(7)
        out[ends[at] - size[at] + k] = ((gaps[at] >> np.uint64(7 * k)) & np.uint64(127)) | goes_on
    return out.tobytes()


def unpack(data: bytes, counts: np.ndarray) -> np.ndarray:
    """The numbers of several packed lists that stand one after another, counts[i] of them in list i."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    size, gaps = ends - first + 1, np.zeros(len(ends), np.int64)
    for k in range(5):
        at = np.flatnonzero(size > k)
        if not len(at):
            break
        gaps[at] |= (raw[first[at] + k] & 127).astype(np.int64) << 7 * k
    total = np.cumsum(gaps)
    begin = np.cumsum(counts) - counts
    return total - np.repeat(np.concatenate(([0], total))[begin], counts)


def _keys(h: np.ndarray, row: int, blocks: int, span: int) -> np.ndarray:
    """block << 32 | cell of each window in a row of the sketch."""
    x = mixed(h, 4 + row)
    low = np.uint64(0xFFFFFFFF)
    return (((x >> np.uint64(32)) * np.uint64(blocks)) & ~low) | (((x & low) * np.uint64(span)) >> np.uint64(32))


def _entries(keys: np.ndarray) -> np.ndarray:
    """Which of sorted keys are sent: a key's first two."""
    sent = np.ones(len(keys), bool)
    sent[2:] = keys[2:] != keys[:-2]
    return sent


def _block_edges(blocks_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, first = np.unique(blocks_of, return_index=True)
    return found, np.append(first, len(blocks_of))


class _Bucket:
    """The words and windows of a bucket's texts."""

    def __init__(self, column: pa.Array, second: bool) -> None:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        hashes, more, at, edges, n = [], [], [], [np.zeros(1, np.int64)], 0
        for a, b in slices(column) if len(column) else ():
            words: Words = words_of(column.slice(a, b - a))
            inside = whole_runs(words, WINDOW)
            hashes.append(runs(words.hashes, WINDOW)[inside] if len(inside) else np.zeros(0, np.uint64))
            if second:
                more.append(runs(words.hashes, WINDOW, 1)[inside] if len(inside) else np.zeros(0, np.uint64))
            at.append(inside + n)
            edges.append(words.edges[1:] + n)
            n += len(words.hashes)
        none = [np.zeros(0, np.uint64)]
        self.h, self.more = np.concatenate(hashes or none), np.concatenate(more or none)
        self.at = np.concatenate(at or [np.zeros(0, np.int64)])
        self.edges, self.n_words = np.concatenate(edges), n

    def repeated(self, answers: dict, blocks: int, span: int) -> np.ndarray:
        """Places of the windows that every row of the sketch counts twice."""
        out = np.ones(len(self.h), bool)
        for row in range(DEPTH):
            keys = _keys(self.h, row, blocks, span)
            order = np.argsort(keys)
            keys = keys[order]
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            bits = np.concatenate([np.unpackbits(np.frombuffer(d, np.uint8), count=n) for _, n, d in sorted(answers.get(row, ()))] or [np.zeros(0, np.uint8)])
            twice = bits[first[_entries(keys)]].astype(bool)
            out[order] &= twice[np.cumsum(first) - 1]
        return np.flatnonzero(out)


def _groups(h: np.ndarray, more: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal windows together, where each group begins in it, and each group's least id."""
    order = np.argsort(h, kind="stable")
    first = np.ones(len(h), bool)
    first[1:] = h[order][1:] != h[order][:-1]
    second = more[order]
    if ((second[1:] != second[:-1]) & ~first[1:]).any():  # two windows of one 64-bit hash
        order = np.lexsort((more, h))
        first[1:] = (h[order][1:] != h[order][:-1]) | (more[order][1:] != more[order][:-1])
    begin = np.flatnonzero(first)
    return order, begin, np.minimum.reduceat(ids[order], begin) if len(begin) else ids[:0]


class _Passes:
    """What the tasks of each pass do, for a number of buckets (as many blocks) and cells of a block."""

    def __init__(self, blocks: int, span: int, texts: bool) -> None:
        self.blocks, self.span, self.texts = blocks, span, texts
        self.result = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * texts

    def sketch(self, docs: pa.Table) -> pa.Table:
        bucket, f, out = _Bucket(docs["text"], False), docs["f"][0].as_py(), []
        for row in range(DEPTH):
            keys = np.sort(_keys(bucket.h, row, self.blocks, self.span))
            keys = keys[_entries(keys)]
            found, edges = _block_edges((keys >> np.uint64(32)).astype(np.int64))
            cells = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            out += [(b, row, f, y - x, pack(cells[x:y])) for b, x, y in zip(found.tolist(), edges[:-1].tolist(), edges[1:].tolist())]
        return _table(out, [pa.int32()] * 4 + [pa.binary()], ("block", "row", "f", "n", "data"))

    def merge(self, lists: pa.Table) -> pa.Table:
        out = []
        for row in range(DEPTH):
            own = lists.filter(pc.equal(lists["row"], row))
            counts = own["n"].to_numpy().astype(np.int64)
            cells = unpack(b"".join(own["data"].to_pylist()), counts)
            twice = np.bincount(cells, minlength=self.span) > 1 if len(cells) else np.zeros(0, bool)
            bits, ends = twice[cells], np.cumsum(counts)
            block = own["block"].to_pylist()
            out += [(f, row, b, n, np.packbits(bits[e - n : e]).tobytes()) for f, b, n, e in zip(own["f"].to_pylist(), block, counts.tolist(), ends.tolist())]
        return _answers(out)

    def _candidates(self, docs: pa.Table, answers: pa.Table):
        """The bucket, the repeated windows, their ids, and their groups."""
        bucket, held = _Bucket(docs["text"], True), {}
        for kind, block, n, data in zip(*(answers[c].to_pylist() for c in ("kind", "block", "n", "data"))):
            held.setdefault(kind, []).append((block, n, data))
        ids = pc.fill_null(docs["doc_id"], LAST).to_numpy()
        at = bucket.repeated(held, self.blocks, self.span)
        of = np.searchsorted(bucket.edges, bucket.at[at], "right") - 1
        ids = ids[of].astype(np.int64)
        h, more = bucket.h[at], bucket.more[at]
        return bucket, held, at, h, more, ids, _groups(h, more, ids)

    def find(self, docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if len(docs):
            _, _, _, h, more, _, (order, begin, least) = self._candidates(docs, answers)
            h, more, f = h[order][begin], more[order][begin], docs["f"][0].as_py()
            found, edges = _block_edges(self._place(h))
            out = [(b, f, h[x:y].tobytes(), more[x:y].tobytes(), least[x:y].tobytes()) for b, x, y in zip(found.tolist(), edges[:-1].tolist(), edges[1:].tolist())]
        return _table(out, [pa.int32()] * 2 + [pa.binary()] * 3, ("block", "f", "h", "more", "ids"))

    def _place(self, h: np.ndarray) -> np.ndarray:
        return (((h >> np.uint64(32)) * np.uint64(self.blocks)) >> np.uint64(32)).astype(np.int64)

    def decide(self, lists: pa.Table) -> pa.Table:
        """For each window that a bucket sent, whether the bucket's least id is the least of all."""
        parts = [lists[c].to_pylist() for c in ("h", "more", "ids")]
        h, more, ids = (np.frombuffer(b"".join(p), t) for p, t in zip(parts, (np.uint64, np.uint64, np.int64)))
        order, begin, least = _groups(h, more, ids)
        owned = np.zeros(len(h), bool)
        owned[order] = ids[order] == np.repeat(least, np.diff(np.append(begin, len(h))))
        out, at = [], 0
        for block, f, mine in zip(lists["block"].to_pylist(), lists["f"].to_pylist(), parts[0]):
            n = len(mine) // 8
            out.append((f, OWNED, block, n, np.packbits(owned[at : at + n]).tobytes()))
            at += n
        return _answers(out)

    def remove(self, docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if len(docs):
            bucket, held, at, _, _, ids, (order, begin, least) = self._candidates(docs, answers)
            size = np.diff(np.append(begin, len(at)))
            owned = np.concatenate([np.unpackbits(np.frombuffer(d, np.uint8), count=n) for _, n, d in sorted(held.get(OWNED, ()))] or [np.zeros(0, np.uint8)]).astype(bool)
            goes = np.zeros(len(at), bool)
            goes[order] = ~np.repeat(owned, size) | (np.repeat(least, size) < ids[order])
            edge = np.zeros(bucket.n_words + 1, np.int32)
            starts = bucket.at[at[goes]]
            edge[starts] += 1  # a word begins one window at most
            edge[starts + WINDOW] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            before = np.concatenate(([0], np.cumsum(gone)))
            removed = np.diff(before[bucket.edges]).tolist()
            edges = bucket.edges.tolist()
            for k, (doc_id, text) in enumerate(zip(docs["doc_id"].to_pylist(), byte_column(docs["text"]))):
                words = text.split()
                if removed[k]:
                    words = [w for w, g in zip(words, gone[edges[k] : edges[k + 1]].tolist()) if not g]
                kept = b" ".join(words)
                out.append((doc_id, edges[k + 1] - edges[k], removed[k], hashlib.sha256(kept).hexdigest(), *([kept.decode()] if self.texts else [])))
        return _table(out, [pa.int64()] * 3 + [pa.string()] * (1 + self.texts), ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")[: 4 + self.texts])


def _table(rows: list, types: list, names: tuple) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(types)
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=list(names))


def _answers(rows: list) -> pa.Table:
    return _table(rows, [pa.int32()] * 4 + [pa.binary()], ("f", "kind", "block", "n", "data"))


def prefilter(docs: DataFrame, passes: _Passes):
    """(dealt texts, the sketch's answers to each bucket)"""
    f = F.pmod(F.xxhash64("doc_id", "text"), F.lit(passes.blocks)).cast("int")
    dealt = docs.select(f.alias("f"), "doc_id", "text").repartition(passes.blocks, "f")
    sketches = dealt.groupBy("f").applyInArrow(lambda t: passes.sketch(t), SKETCH)
    return dealt, sketches.groupBy("block").applyInArrow(lambda t: passes.merge(t), ANSWER)


def candidates(dealt: DataFrame, answers: DataFrame, passes: _Passes) -> DataFrame:
    """The windows of each bucket that the sketch counts twice, with the least id that has them there."""
    return dealt.groupBy("f").cogroup(answers.groupBy("f")).applyInArrow(lambda a, b: passes.find(a, b), CANDIDATES)


def removed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, bucket_bytes: int = BUCKET_BYTES, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (with texts: kept, the remaining text) for each row of docs.

    A word is removed if a window of 13 words over it also starts in a document of smaller doc_id. A null id counts as
    larger than any; rows of one id don't remove each other's words; null and short texts lose nothing; repeated rows
    come out alike; an empty table gives an empty one. Words are told apart, and compared, by hashes of their bytes."""
    rows = id_text(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    passes = _Passes(int(max(16, size // bucket_bytes)), span, texts)
    dealt, answers = prefilter(rows, passes)
    owners = candidates(dealt, answers, passes).groupBy("block").applyInArrow(lambda t: passes.decide(t), ANSWER)
    return dealt.groupBy("f").cogroup(answers.unionByName(owners).groupBy("f")).applyInArrow(lambda a, b: passes.remove(a, b), passes.result)
