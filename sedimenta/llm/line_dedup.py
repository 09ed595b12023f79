"""Line dedup by pairwise alignment: documents that share the hash of a run of lines are paired, aligned by patience
diff, and the aligned common blocks are deleted from the later document.

Every run shared by several documents pairs each later one with the first that has the run; a run that is not wholly
deleted then meets its next earlier holders, twice as many in each round, until none is left. So a run of any number of
documents gives all pairs only where alignment fails, and the result is that of alignment with all earlier holders.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import all_columns, batch_of, byte_column, checkpoint_few, in_slices, quoted

#: Shorter runs of lines find no partner, and shorter aligned blocks stay: what is that short is common by chance.
MIN_WORDS = 8
LAST = (1 << 63) - 1
#: Parts in which the holders of one run are ranked.
SALTS = 64


def _common_unique(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    at_b = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
    return [(i, at_b[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in at_b]


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    tops, piles, back = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back[k] = piles[p - 1] if p else -1
        if p == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[p], piles[p] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of two sequences: equal ends, then lines unique in both, in longest rising order, and the
    same again between them."""
    matched, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = _longest_rising(_common_unique(a, b, a0, a1, b0, b1))
        if anchors:
            for i, j in [*anchors, (a1, b1)]:
                todo.append((a0, i, b0, j))
                a0, b0 = i, j
    return sorted(set(matched))


def common_blocks(later: list, words: list[int], earlier: list, min_words: int = MIN_WORDS) -> list[int]:
    """Positions in `later` of aligned blocks that have min_words words at least."""
    out, run, before = [], [], None
    for i, j in [*patience(later, earlier), (-5, -5)]:
        if before != (i - 1, j - 1):
            if sum(words[x] for x in run) >= min_words:
                out += run
            run = []
        run.append(i)
        before = (i, j)
    return out


def line_runs(lines: list[bytes], words: list[int], min_words: int = MIN_WORDS) -> list[tuple[bytes, int, int]]:
    """(hash, first, end) of the shortest run of min_words words that begins at each line, and of the one that ends there.

    Two documents with a common block share a run within the block over each of its lines."""
    spans, total, b = set(), 0, 0
    for a, n in enumerate(words):
        while b < len(words) and total < min_words:
            total, b = total + words[b], b + 1
        if total < min_words:
            break
        spans.add((a, b))
        total -= n
    total, a = 0, 0
    for b, n in enumerate(words, 1):
        total += n
        while total - words[a] >= min_words:
            total, a = total - words[a], a + 1
        if total >= min_words:
            spans.add((a, b))
    return [(lines[a] if b - a == 1 else xxhash.xxh3_128_digest(b"".join(lines[a:b])), a, b) for a, b in sorted(spans)]


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k (the id, null last), h (hash of the text) and, of lines with a word, their place, word count and 128-bit hash."""
    rows = docs.select(F.coalesce(F.col(quoted(id_col)), F.lit(LAST)).alias("k"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    schema = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("n", pa.int32()), ("at", pa.list_(pa.int32())), ("words", pa.list_(pa.int32())), ("lines", pa.list_(pa.binary()))])

    def run(batches):
        for batch in batches:
            for part in in_slices(batch):
                out = []
                for text in byte_column(part.column(1)):
                    lines = text.split(b"\n")
                    counts = [len(s.split()) for s in lines]
                    at = [i for i, n in enumerate(counts) if n]
                    out.append((len(lines), at, [counts[i] for i in at], [xxhash.xxh3_128_digest(lines[i]) for i in at]))
                yield batch_of(schema, [part.column(0), part.column(2), *(list(c) for c in zip(*out))])

    return rows.mapInArrow(run, "k bigint, h bigint, n int, at array<int>, words array<int>, lines array<binary>")


def deletions(table: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k, h, gone): one byte for each line of a document, 1 where it is deleted; documents without deletions are absent.

    table has each (k, h) once and is written out: its joins then shuffle both sides, so hot holders can be split."""
    def held(batches):
        for batch in batches:
            for part in in_slices(batch):
                k, h, lines, words = (c.to_pylist() for c in part.columns)
                out = [(x, y, list({r[0] for r in line_runs(a, b, min_words)})) for x, y, a, b in zip(k, h, lines, words)]
                yield batch_of(runs, [list(c) for c in zip(*out)])

    runs = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("runs", pa.list_(pa.binary()))])
    each = table.select("k", "h", "lines", "words").mapInArrow(held, "k bigint, h bigint, runs array<binary>").select("k", "h", F.explode("runs").alias("line"))
    first = each.groupBy("line").agg(F.min(F.struct("k", "h")).alias("first"), F.count("*").alias("df")).where("df > 1").select("line", F.col("first.k").alias("fk"), F.col("first.h").alias("fh"))
    first = checkpoint_few(first)  # read again, it is shuffled like the other side, so the skew join can split a line
    shared = checkpoint_few(each.join(first, "line").select("line", "k", "h", "fk", "fh"))
    earlier = table.select(F.col("k").alias("fk"), F.col("h").alias("fh"), F.col("lines").alias("other"))
    schema = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("gone", pa.binary()), ("open", pa.list_(pa.binary()))])

    def run(batches):
        now = None
        for batch in batches:
            for part in in_slices(batch):
                out = []
                for k, h, n, at, words, lines, before, seeds, other in zip(*(c.to_pylist() for c in part.columns)):
                    if (k, h) != now:
                        if now:
                            out.append((*now, *result(gone, places, asked)))
                        now, gone, asked, places = (k, h), bytearray(before or n), set(), {}
                        for x, a, b in line_runs(lines, words, min_words):
                            places.setdefault(x, []).append(at[a:b])
                    asked.update(seeds)
                    if is_open(seeds, gone, places):
                        for i in common_blocks(lines, words, other, min_words):
                            gone[at[i]] = 1
                if out:
                    yield batch_of(schema, [list(c) for c in zip(*out)])
        if now:
            yield batch_of(schema, [[x] for x in (*now, *result(gone, places, asked))])

    def is_open(seeds, gone, places):
        return any(not gone[i] for x in seeds for p in places[x] for i in p)

    def result(gone, places, asked):
        return bytes(gone), [x for x in sorted(asked) if is_open([x], gone, places)]

    pairs, number, done = shared.where("k > fk").select("line", "k", "h", "fk", "fh"), 0, []
    while True:
        seeded = pairs.groupBy("k", "h", "fk", "fh").agg(F.collect_list("line").alias("seeds"))
        own = table.join(done[-1].select("k", "h", F.col("gone").alias("before")), ["k", "h"]) if done else table.withColumn("before", F.lit(None).cast("binary"))
        both = seeded.join(earlier, ["fk", "fh"]).join(own, ["k", "h"]).select("k", "h", "n", "at", "words", "lines", "before", "seeds", "other")
        found = checkpoint_few(both.repartition("k", "h").sortWithinPartitions("k", "h").mapInArrow(run, "k bigint, h bigint, gone binary, open array<binary>").withColumn("number", F.lit(number)))
        done.append(found)
        left = found.select("k", "h", F.explode("open").alias("line"))
        last = left.groupBy("line").agg(F.max("k").alias("last"))
        # the next 2^number holders of each run, by place after the first
        low, number = 2**number, number + 1
        # a hot run is dealt to parts and ranked in each first, so few of its rows meet
        parts = last.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        salted = shared.withColumn("salt", F.pmod(F.xxhash64("k", "h"), F.lit(SALTS)))
        ranked = salted.join(parts, ["line", "salt"]).where("k < last").select("line", F.col("k").alias("fk"), F.col("h").alias("fh"), "salt")
        for keys in (("line", "salt"), ("line",)):
            ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("fk", "fh"))).where(F.col("place") <= 2 * low)
        holders = checkpoint_few(ranked.where(F.col("place") > low).select("line", "fk", "fh"))
        pairs = checkpoint_few(left.join(holders, "line").where("k > fk").select("line", "k", "h", "fk", "fh"))
        if pairs.isEmpty():
            break
    every = done[0]
    for found in done[1:]:
        every = every.unionByName(found)
    return every.groupBy("k", "h").agg(F.max_by("gone", "number").alias("gone")).where(F.locate("\x01", F.col("gone").cast("string")) > 0)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, added: bool = False) -> DataFrame:
    """The rows of docs with deleted lines gone from the text; with added also __llm_lines and __llm_deleted.

    The later document is that of larger id, null last. Rows repeated in id (and rows of one id with different texts)
    don't delete each other's lines. A null text stays null, an empty table empty; all other columns stay as they are."""
    gone = deletions(checkpoint_few(line_table(docs, id_col, text_col).dropDuplicates(["k", "h"])), min_words).select(F.col("k").alias("__llm_k"), F.col("h").alias("__llm_h"), F.col("gone").alias("__llm_gone"))
    marked = docs.withColumn("__llm_own_k", F.coalesce(F.col(quoted(id_col)), F.lit(LAST))).withColumn("__llm_own_h", F.xxhash64(F.coalesce(F.col(quoted(text_col)), F.lit(""))))
    joined = marked.join(gone, (F.col("__llm_own_k") == F.col("__llm_k")) & (F.col("__llm_own_h") == F.col("__llm_h")), "left")
    lines = F.split(F.col(quoted(text_col)), "\n", -1)
    kept = F.filter(lines, lambda s, i: F.substring(F.col("__llm_gone"), i + 1, F.lit(1)) == F.lit(b"\x00"))
    text = F.when(F.col("__llm_gone").isNull(), F.col(quoted(text_col))).otherwise(F.array_join(kept, "\n"))
    more = [F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("__llm_lines"), F.when(F.col("__llm_gone").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("bigint").alias("__llm_deleted")] if added else []
    return joined.select(*[text.alias(name) if name == text_col else c for name, c in zip(docs.columns, all_columns(docs))], *more)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_deleted and kept_sha256 of what remains, for each row of docs; a null text has no lines."""
    out = dedup_lines(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), added=True)
    return out.select("doc_id", F.col("__llm_lines").alias("n_lines"), F.col("__llm_deleted").alias("n_deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
