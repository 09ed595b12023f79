"""Each llm query against a brute-force version on a small fixture, and the defined results of odd rows."""

import gzip
import hashlib
import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sedimenta.llm import bpe, langid, line_dedup, lm_scoring, mixing, neardup, quality, simhash, substring, warc, winnow

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, h string, bucket string"


def _texts():
    rng = random.Random(5)
    words = ["the", "of", "and", *("".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(150))]
    make = lambda n: " ".join(rng.choices(words, k=n))
    texts = []
    for i in range(36):
        texts.append("\n".join(make(rng.randint(5, 30)) for _ in range(rng.randint(1, 8))))
    copied = texts[3].replace("the", "of", 1)
    passage = make(60)
    texts += [texts[0], texts[0], texts[1] + "\n" + passage, passage + " " + texts[2], copied, "", None, " \n\t ", "x" * 3000, "a", "\n\n", "12 34 !!", make(4000), ("w " * 3000).strip(), "é<|endoftext|> b  c", "A\x1cb\x85c"]
    return texts


@pytest.fixture(scope="module")
def rows():
    out = [(i * 3, t, ["en", "fr", None][i % 3], ["s", "t", None][i % 3], 0, 1, "x", "y") for i, t in enumerate(_texts())]
    return [*out, out[4], out[4], (None, "no id here, but the words of a text and more", "en", "s", 0, 1, "x", "y")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "n_chars")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def multiset(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_bpe(docs, rows):
    t = Tokenizer.from_file(BPE)
    want = Counter()
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert multiset(bpe.digest_documents(docs, BPE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    ids = {r.doc_id: r.ids for r in bpe.encode_documents(docs, BPE).collect()}
    assert ids[0] == t.encode(rows[0][1], add_special_tokens=False).ids


def test_bpe_long_words_merge_alike():
    b = bpe.Bpe(open(BPE, encoding="utf-8").read())
    ids = [b.single[x] for x in b"abracadabra" * 20]
    assert b._merge_long(list(ids)) == b.merge(b"abracadabra" * 20)


def test_substring(docs, rows):
    first = {}
    key = lambda r: math.inf if r[0] is None else r[0]
    for r in rows:
        w = words(r[1])
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, math.inf), key(r))
    want = Counter()
    for r in rows:
        w = words(r[1])
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < key(r):
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    assert multiset(substring.removed_words(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_sketch_lists_round_trip():
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.integers(0, top, n)) for top, n in ((5000, 300), (1, 2), (1 << 31, 40), (200, 0), (1 << 22, 999))]
    got = substring.unpack(b"".join(map(substring.pack, lists)), np.array([len(x) for x in lists]))
    assert (got == np.concatenate(lists)).all()


def test_sketch_filters_alike_at_every_size(spark):
    """Under 30 % of windows that occur once pass, and all that occur twice, whether there are 16 buckets or 90."""
    rng = random.Random(12)
    for n in (300, 1500):
        texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(80)) for _ in range(n)]
        texts += [t.split(" ", 30)[-1] for t in texts[:40]]
        size = sum(map(len, texts))
        passes = substring._Passes(max(16, size // 8192), 4096, False)
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        found = substring.candidates(*substring.prefilter(rows, passes), passes)
        sent = sum(len(r.h) // 8 for r in found.collect())
        windows = sum(len(t.split()) - 12 for t in texts)
        twice = sum(2 * (len(t.split()) - 12) for t in texts[n:])
        assert 0 <= sent - twice + 200 and sent - twice < 0.3 * (windows - twice)


def test_substring_with_small_buckets(docs):
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert multiset(substring.removed_words(docs, bucket_bytes=500, span=64), *columns) == multiset(substring.removed_words(docs), *columns)


def test_word_hashes():
    import pyarrow as pa

    from sedimenta.llm.wordhash import runs, whole_runs, words_of

    texts = ["a b", "", "  ab\tcd ", "b", "é" * 40 + " x" * 5, "A b", "12345678 123456789 1234567\x00 1234567", "b a"]
    got = words_of(pa.array(texts))
    flat = [w for t in texts for w in t.encode().split()]
    assert got.counts().tolist() == [len(t.encode().split()) for t in texts]
    assert [got.hashes[i] == got.hashes[j] for i in range(len(flat)) for j in range(i)] == [flat[i] == flat[j] for i in range(len(flat)) for j in range(i)]
    assert (words_of(pa.array(["A b"]), lower=True).hashes == words_of(pa.array(["a b"])).hashes).all()
    sliced = pa.array(["zz", *texts]).slice(1)
    assert (words_of(sliced).hashes == got.hashes).all()
    for size in (1, 2, 3, 5, 13):
        for k in (0, 1):
            h = runs(got.hashes, size, k)
            n = len(flat) - size + 1
            assert len(h) == max(0, n)
            assert all((h[i] == h[j]) == (flat[i : i + size] == flat[j : j + size]) for i in range(n) for j in range(i))
        first = np.concatenate(([0], np.cumsum(got.counts())))
        assert whole_runs(got, size).tolist() == [i for a, b in zip(first[:-1], first[1:]) for i in range(a, b - size + 1)]


def test_quality(docs, rows):
    want = Counter()
    for r in rows:
        text = r[1] or ""
        w = [x.decode() for x in words(text)]
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [s for s in text.split("\n") if s.encode().split()]
        base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        n = max(1, len(w))
        symbols = sum(text.count(c) for c in "#*$%&|<>")
        dup = len(lines) - len(set(lines))
        kept = not base and 2 <= sum(map(len, w)) / n <= 12 and symbols / n <= 0.1 and sum(x.lower() in quality.STOP_WORDS for x in w) / n >= 0.02 and dup <= 0.4 * len(lines)
        want[r[0], len(w), sum(map(len, w)), symbols, dup, len(covered), base, kept] += 1
    got = quality.judge(docs)
    assert multiset(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == want
    assert multiset(quality.keep_good(docs), "doc_id") == Counter({(k[0],): 0 for k in want}) + Counter(x for k, n in want.items() if k[-1] for x in [(k[0],)] * n)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_mixing(docs, rows, empty):
    got = mixing.mix_table(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    assert sum(sizes.values()) == sum(r["size"] for r in got) and {r.source_size for r in got} == set(sizes.values())
    targets = {r.source_size: r.target for r in got}
    assert sum(targets.values()) == pytest.approx(sum(sizes.values())) and all(t <= 3 * s + 1e-6 for s, t in targets.items())
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert multiset(mixing.mix_table(docs), "doc_id", "taken", "position") == multiset(mixing.mix_table(docs), "doc_id", "taken", "position")
    assert mixing.mixed(docs).count() == sum(r.copies for r in got)
    assert mixing.mix_table(empty).collect() == [] and mixing.mixed(empty).collect() == []


def test_mixing_against_brute_force(spark):
    """Taken words, targets and training times of the caller's weights and schedules, source by source."""
    rng = random.Random(31)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "b", "c", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("a.b", F.lit(1))
    weights, schedules = (2.0, 1.0), (((0.0, 0.0), (1.0, 1.0)), ((0.0, 1.0), (0.5, 0.0), (1.0, 1.0)))
    order = ["a", "b", "c", None]
    sizes = {s: sum(len(words(r[1])) for r in rows if r[2] == s) for s in order}
    total, left, target = sum(sizes.values()), set(order), {}
    while left:
        share = (total - sum(target.values())) / sum(weights[order.index(s) % 2] for s in left)
        over = [s for s in left if share * weights[order.index(s) % 2] > 3 * sizes[s]]
        if not over:
            target |= {s: share * weights[order.index(s) % 2] for s in left}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= set(over)
    got = {r.doc_id: r for r in mixing.mix_table(df, weights=weights, schedules=schedules).collect()}
    plan = {r.doc_id: r for r in mixing.plan_mix(df, weights=weights, schedules=schedules).collect()}
    for k, s in enumerate(order):
        own = [r for r in rows if r[2] == s]
        taken, longest = sum(got[r[0]].taken for r in own), max(len(words(r[1])) for r in own)
        assert abs(taken - target[s]) <= longest / 2 + 1 or taken == 3 * sizes[s]
        stream = sorted((r for r in own), key=lambda r: plan[r[0]].before)
        before, fine = 0, np.linspace(0, 1, 40001)
        density = np.interp(fine, [p[0] for p in schedules[k % 2]], [p[1] for p in schedules[k % 2]])
        done = np.concatenate(([0], np.cumsum((density[1:] + density[:-1]) / 2)))
        done /= done[-1]
        for r in stream:
            row, size = got[r[0]], len(words(r[1]))
            assert row["size"] == size and row.target == pytest.approx(target[s]) and row.taken == row.copies * size <= 3 * size
            if size:
                assert plan[r[0]].before == before
            if row.copies:
                assert row.position == pytest.approx(float(np.interp(min(1, (before + size / 2) / target[s]), done, fine)), abs=2e-3)
            before += size
    stream = mixing.mixed(df, weights=weights, schedules=schedules)
    assert stream.columns == df.columns and Counter(r.doc_id for r in stream.collect()) == Counter({i: r.copies for i, r in got.items() if r.copies})
    nulls = df.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source"))
    assert all(r.taken == 0 for r in mixing.mix_table(nulls).collect()) and mixing.mixed(nulls).collect() == []


def test_water_filling(spark):
    t = {r.source: r.target for r in mixing.targets(spark.createDataFrame([("a", 1000), ("b", 10), ("c", 90), (None, 0)], "source string, source_size long")).collect()}
    # weights 1, 2, 3, 1: b stops at 30 and c at 270, the rest goes to a
    assert t["b"] == 30 and t["c"] == 270 and t[None] == 0 and t["a"] == pytest.approx(800)


def test_schedules_invert(spark):
    for k, points in enumerate(mixing.SCHEDULES):
        fine = np.linspace(0, 1, 20001)
        density = np.interp(fine, [p[0] for p in points], [p[1] for p in points])
        done = np.concatenate(([0], np.cumsum((density[1:] + density[:-1]) / 2)))
        done /= done[-1]
        df = spark.createDataFrame([(float(q),) for q in (0.0, 0.1, 0.5, 0.77, 1.0)], "q double").select("q", mixing.time_at(F.col("q"), F.lit(k)).alias("t"))
        assert all(abs(r.t - np.interp(r.q, done, fine)) < 1e-3 for r in df.collect())


def test_simhash(docs, rows):
    def fingerprint(text):
        w = words((text or "").encode().lower().decode())
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    marks = [fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 2 and label[i] != label[j]:
                old = label[i]
                label = [label[j] if x == old else x for x in label]
    least = {}
    for r, x in zip(rows, label):
        if r[0] is not None:
            least[x] = min(least.get(x, r[0]), r[0])
    want = Counter((r[0], f"{m:016x}", least.get(x)) for r, m, x in zip(rows, marks, label))
    assert multiset(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want


def test_buckets_over_the_limit_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 16)
    rng = random.Random(2)
    base = rng.getrandbits(63)
    marks = sorted({base ^ 1 << rng.randrange(60) ^ 1 << rng.randrange(60) for _ in range(150)} | {rng.getrandbits(63) for _ in range(50)})
    fps = spark.createDataFrame([(m, m) for m in marks], "node long, fp long")
    plan = simhash.choose_plan(fps, 2, (2, 3))
    assert sum(plan.thresholds) == 2 - len(plan.parts) + 1
    got = {r.node: r.component for r in simhash.components(simhash.links(fps, plan, 2)).collect()}
    label = {m: m for m in marks}
    for a in marks:
        for b in marks:
            if (a ^ b).bit_count() <= 2 and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    assert all(got.get(m, m) == label[m] for m in marks)


def shingle_set(text, k=5):
    w = [x.lower() for x in words(text)]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_groups(rows):
    """The number of each row's group: those reachable over links of equal sets, or 0.8 alike."""
    sets, label = [shingle_set(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0):
                old = label[i]
                label = [label[j] if x == old else x for x in label]
    return label


def test_near_groups(spark, rows):
    rng = random.Random(21)
    some = [(r[0], r[1]) for r in rows]
    for i in range(24):
        w = rng.choices([f"w{k}" for k in range(400)], k=rng.choice((3, 6, 30, 120, 400)))
        some.append((1000 + 10 * i, " ".join(w)))
        for j in range(1, rng.randint(1, 8)):
            w = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = "changed" + str(rng.random())
            some.append((1000 + 10 * i + j, " ".join(w).upper() if j == 3 else "  ".join(w)))
    label, want, least = brute_groups(some), Counter(), {}
    for (i, _), x in zip(some, label):
        least[x] = min(least.get(x, math.inf), math.inf if i is None else i)
    for (i, _), x in zip(some, label):
        want[i, None if least[x] == math.inf else least[x]] += 1
    df = spark.createDataFrame(some, "doc_id long, text string")
    assert multiset(neardup.near_groups(df), "doc_id", "component_id") == want
    assert Counter(r.doc_id for r in neardup.keep_one(df).collect()) == Counter(None if x == math.inf else x for x in least.values())


def test_near_groups_of_large_buckets(spark, monkeypatch):
    """Hundreds of near copies of one text, in buckets that are cut: one group, and far fewer pairs than all."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 64)
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = []
    for i in range(250):
        w = list(base)
        w[rng.randrange(300)] = f"own{i}"
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame([*texts, (900, " ".join(f"x{i}" for i in range(300)))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_groups(df).collect()}
    assert set(got.values()) == {0, 900} and sum(x == 0 for x in got.values()) == 250


def test_keep_one(docs, rows, spark):
    kept = neardup.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids))
    same = [r[0] for r in rows if r[1] == rows[0][1]]
    assert same[0] in ids and not set(same[1:]) & set(ids)
    odd = spark.createDataFrame([(1, "a b", "x", "p", 1), (1, "a b", "y", "q", 2), (2, "A  b", "z", None, 3)], "doc_id long, text string, `a.b` string, node string, `c``d` long")
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and len(kept.collect()) == 1 and kept.collect() == kept.collect()


def test_majorities():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    edges = np.array([0, 0, 1, 3, 258, 258, 513, 1300, 2000])
    want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[a:c]) > c - a) for a, c in zip(edges[:-1], edges[1:])]
    assert simhash.majorities(h, edges).tolist() == want


def test_line_dedup(docs, rows):
    first, table = {}, {}
    for r in rows:
        if r[0] is None or r[0] in table:
            continue
        lines = (r[1] or "").encode().split(b"\n")
        table[r[0]] = (lines, [i for i, s in enumerate(lines) if s.split()])
    for k in sorted(table):
        for i in table[k][1]:
            if len(table[k][0][i].split()) >= line_dedup.MIN_WORDS:
                first.setdefault(table[k][0][i], k)
    for r in line_dedup.report(docs).where("doc_id is not null").collect():
        lines, at = table[r.doc_id]
        own = [lines[i] for i in at]
        gone = set()
        for e in {first[s] for s in own if s in first and first[s] < r.doc_id}:
            other = [table[e][0][i] for i in table[e][1]]
            gone |= {at[x] for x in line_dedup.common_blocks(own, [len(s.split()) for s in own], other)}
        kept = b"\n".join(s for i, s in enumerate(lines) if i not in gone)
        assert (r.n_deleted, r.kept_sha256) == (len(gone), hashlib.sha256(kept).hexdigest())
    assert line_dedup.dedup_lines(docs).columns == docs.columns


def test_line_dedup_of_short_lines(spark):
    verse = "one two three\nfour five\nsix\n\nseven eight nine"
    rows = [(1, "a b\n" + verse), (2, verse), (3, "c d e\n" + verse + "\nf g"), (4, "one two three\nx y"), (5, "one two three four five six seven\nz")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "", 3: "c d e\n\nf g", 4: rows[3][1], 5: rows[4][1]}


def test_line_dedup_equals_alignment_with_all_earlier(spark):
    rng = random.Random(9)
    pool = [f"{i} b c d e f g h" if i % 2 else f"{i} x y" for i in range(14)]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 9))) for _ in range(60)]
    p, q = "p b c d e f g h", "q b c d e f g h"
    texts += [f"{p}\n{q}", f"{q}\n{p}", f"{q}\n{p}"]
    want = {}
    for k, text in enumerate(texts):
        own, gone = text.encode().split(b"\n"), set()
        for e in texts[:k]:
            gone |= set(line_dedup.common_blocks(own, [len(s.split()) for s in own], e.encode().split(b"\n")))
        want[k] = "\n".join(s for i, s in enumerate(text.split("\n")) if i not in gone)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want and got[62] == ""


def test_line_runs_cover_every_block():
    rng = random.Random(8)
    for _ in range(200):
        words = [rng.choice((1, 1, 2, 3, 9)) for _ in range(rng.randint(0, 9))]
        spans = {(a, b) for _, a, b in line_dedup.line_runs([bytes([i]) * 16 for i in range(len(words))], words)}
        assert all(sum(words[a:b]) >= 8 for a, b in spans)
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                inside = [s for s in spans if a <= s[0] and s[1] <= b]
                assert sum(words[a:b]) < 8 or {i for s in inside for i in range(*s)} == set(range(a, b))


def test_patience():
    assert line_dedup.patience(list("xabcy"), list("zabcw")) == [(1, 1), (2, 2), (3, 3)]
    assert line_dedup.patience([], list("a")) == [] and line_dedup.patience(list("aa"), list("aa")) == [(0, 0), (1, 1)]


def test_winnowing(docs, rows):
    stand = sorted(rows, key=lambda r: (-(math.inf if r[0] is None else r[0]) if r[0] is not None else math.inf, r[1] or ""))
    want = Counter()
    for i, r in enumerate(stand):
        text, after = r[1] or "", stand[(i + 1) % len(stand)][1] or ""
        half = len(text) // 2
        want[r[0], len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    for size in (2000, 1 << 20):
        got = winnow.edited_likeness(docs, bucket_bytes=size)
        assert multiset(got, "doc_id", "n_chars", "edited_sha256") == want
    marks = {}

    def chosen(text):
        """Winnowing by its definition, over the grams' own hashes."""
        if text not in marks:
            values, places = [int(x) >> 24 for x in winnow.gram_hashes(winnow.code_points(text))], set()
            for i in range(max(1, len(values) - 15) if values else 0):
                part = values[i : i + 16]
                places.add(i + max(j for j, v in enumerate(part) if v == min(part)))
            marks[text] = {values[i] for i in places}
        return marks[text]

    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    near = Counter()
    for i, r in enumerate(stand):
        text, after = r[1] or "", stand[(i + 1) % len(stand)][1] or ""
        half = len(text) // 2
        near[r[0], round(alike(chosen(text), chosen(text[: len(text) - half] + after[:half])), 9), round(alike(chosen(text), chosen(after)), 9)] += 1
    assert Counter((r.doc_id, round(r.near_edited, 9), round(r.near_next, 9)) for r in got.collect()) == near
    by_text = {}
    for r in got.collect():
        by_text.setdefault(r.edited_sha256, set()).add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_winnowing_splits_a_hot_id(spark):
    texts = [f"text number {i} of a row without an id, long enough for a gram or two" for i in range(300)]
    rows = [(None, t) for t in texts] + [(i, t[::-1]) for i, t in enumerate(texts[:60])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = df.select(F.coalesce("doc_id", F.lit(winnow.LEAST)).alias("key"), F.xxhash64("text").alias("h"), "text")
    ranges = winnow._ranges(keyed, 1000)
    got = keyed.collect()
    used = Counter(ranges.of(np.array([r.key for r in got]), np.array([r.h for r in got])).tolist())
    assert max(used.values()) < 60
    order = sorted(got, key=lambda r: (r.key, r.h), reverse=True)
    after = {r.text: order[(i + 1) % len(order)].text for i, r in enumerate(order)}
    want = Counter(hashlib.sha256((t[: len(t) - len(t) // 2] + after[t][: len(t) // 2]).encode()).hexdigest() for t in after)
    assert Counter(r.edited_sha256 for r in winnow.edited_likeness(df, bucket_bytes=1000).collect()) == want


def test_winnowing_rightmost():
    rng = random.Random(3)
    for n in (0, 1, 15, 16, 17, 30, 31, 32, 100, 300):
        hashes = winnow.gram_hashes(winnow.code_points("".join(rng.choices("ab", k=n))))
        values, want = [int(x) >> 24 for x in hashes], {}
        for i in range(max(1, len(values) - 15) if values else 0):
            part = values[i : i + 16]
            want[i + max(j for j, v in enumerate(part) if v == min(part))] = min(part)
        at, chosen = winnow.select(hashes)
        assert dict(zip(at.tolist(), chosen.tolist())) == want


def test_language(spark):
    en, fr = "the and of that with this from are was be".split(), "le la les des que une est pour dans qui".split()
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(en if i % 2 else fr, k=30)), "en" if i % 2 else "fr") for i in range(60)] + [(90, None, "en"), (91, "12 34 !", "fr"), (92, "", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(60))
    assert [got[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)


def test_many_languages_and_repeats(spark):
    """30 languages, one row of the first a thousand times, against centroids and cosines in plain Python."""
    rng = random.Random(8)
    rows = []
    for k in range(30):
        own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 6))) for _ in range(25)]
        rows += [(100 * k + i, " ".join(rng.choices(own, k=25)), f"l{k:02}") for i in range(8)]
    rows += [rows[0]] * 1000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df).distinct().collect()
    assert len(got) == 240 and all(r.lang_pred == f"l{r.doc_id // 100:02}" for r in got)
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    counts = {r: langid.n_gram_counts(r[1]) for r in set(rows)}
    df_of = sum((counts[r] > 0).astype(int) for r in learn)
    idf = np.log((1 + len(learn)) / (1 + df_of)) + 1
    unit = lambda x: x / max(np.linalg.norm(x), 1e-9)
    vectors = {r: unit(np.log1p(counts[r]) * idf) for r in counts}
    model = langid.fit(df.where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1"))
    assert len(set(model["langs"])) == 30
    centroids = [unit(c.astype(float)) for c in model["centroids"]]
    by = {r.doc_id: r for r in got}
    for r, v in vectors.items():
        cos = [float(v @ c) for c in centroids]
        assert by[r[0]].score == pytest.approx(max(cos), abs=1e-4) and by[r[0]].lang_pred == model["langs"][int(np.argmax(cos))]


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    df = spark.createDataFrame([(i, "a b", f"l{i}") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.identify(df)


def test_lm_scoring(docs, rows, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD_TOKENS", 60)
    held = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1
    tokens = lambda r: [*(r[1] or "").encode().lower().split(), b""]
    c = Counter(t for r in rows if not held(r) for t in tokens(r))
    n, v = sum(c.values()), len(c)
    base = {}
    for r in rows:
        base[r[0]] = (held(r), len(tokens(r)), sum(c[t] > 0 for t in tokens(r)), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(r)))
    got = lm_scoring.score_documents(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert r.base_score == pytest.approx(want[4]) and r.score < 0


def _vocabulary(texts):
    c = Counter(t for x in texts for t in lm_scoring.tokens_of((x or "").encode()))
    return lm_scoring.Vocabulary(sorted(c.items(), key=lambda t: (-t[1], t[0])), sum(c.values()), len(c)), c


def test_lm_trains_on_every_token(spark):
    import pyarrow as pa

    rng = random.Random(6)
    texts = sorted(" ".join(rng.choices("abcdefgh", k=n)) for n in (0, 1, 3, 40, 200, 900))
    v, c = _vocabulary(texts)
    learn = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lm_scoring.fit(learn)[2]
    want = lm_scoring.start_weights(v)
    for _ in range(lm_scoring.ROUNDS):
        want, seen = lm_scoring.train(want, v, lm_scoring._model_ids(v, pa.array(texts)))
        assert seen == sum(c.values())
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-5) for k in want)


def test_lm_scores_are_a_function_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", 3000)
    rng = random.Random(16)
    pool = ["".join(rng.choices("abcde", k=3)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 90)))) for i in range(80)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    first, second = (sorted((r.doc_id, r.score) for r in lm_scoring.score_documents(df.repartition(n)).collect()) for n in (1, 16))
    assert [x[0] for x in first] == [x[0] for x in second] and np.allclose([x[1] for x in first], [x[1] for x in second], rtol=1e-6)


def test_lm_scores_whole_documents():
    """Scores against the model's definition, a token at a time in plain Python, over many windows and lanes."""
    import pyarrow as pa

    rng = random.Random(17)
    texts = [" ".join(rng.choices(["a", "B", "cc", "d", "é", "rare"], k=n)) for n in (0, 1, 5, 97, 400)]
    v, _ = _vocabulary(texts)
    w, _ = lm_scoring.train(lm_scoring.start_weights(v), v, lm_scoring._model_ids(v, pa.array(texts)))
    k, sigmoid = lm_scoring.HIDDEN, lambda x: 1 / (1 + math.exp(-x))
    u, classes = w["u"].astype(float), [list(range(v.starts[c], v.starts[c + 1])) for c in range(v.n_cls)]
    want = []
    for text in texts:
        ids = [v.ids[t] for t in lm_scoring.tokens_of(text.encode())]
        h, total = np.zeros(k), 0.0
        for now, nxt in zip([v.ids[b""], *ids], ids):
            a, g = w["x"][now].astype(float) + w["b"], h @ u
            z = [sigmoid(a[i] + g[i]) for i in range(k)]
            r = [sigmoid(a[k + i] + g[k + i]) for i in range(k)]
            n = [math.tanh(a[2 * k + i] + r[i] * g[2 * k + i]) for i in range(k)]
            h = np.array([z[i] * h[i] + (1 - z[i]) * n[i] for i in range(k)])
            own = next(c for c in classes if nxt in c)
            by_class = [math.exp(x) for x in (h @ w["c"] + w["cb"])]
            inner = {t: math.exp(float(h @ w["w"][t] + w["wb"][t])) for t in own}
            total += math.log(by_class[classes.index(own)] / sum(by_class)) + math.log(inner[nxt] / sum(inner.values()))
        want.append(total)
    assert np.allclose(lm_scoring.score_all(w, v, lm_scoring._model_ids(v, pa.array(texts))), want, rtol=1e-4)


def test_lm_gradients_through_time():
    v = lm_scoring.Vocabulary([(b"a", 50), (b"b", 20), (b"", 10), (b"c", 1)], 90, 9)
    rng = np.random.default_rng(2)
    w = {k: x.astype(float) + rng.standard_normal(x.shape) * 0.1 for k, x in lm_scoring.start_weights(v).items()}
    h0 = rng.standard_normal((3, lm_scoring.HIDDEN)) * 0.3
    x, y = rng.integers(0, v.m + 1, (6, 3)), rng.integers(0, v.m + 1, (6, 3))
    real = np.ones(x.shape, bool)
    real[4:, 1] = False
    loss = lambda: -lm_scoring.window_gradients(w, v, h0, x, y, real)[1]
    _, _, grads, flat = lm_scoring.window_gradients(w, v, h0, x, y, real)
    grads["x"] = np.zeros_like(w["x"])
    np.add.at(grads["x"], x[real], flat)
    for name, g in grads.items():
        for at in [tuple(rng.integers(0, n) for n in g.shape) for _ in range(6)]:
            e, old = 1e-6, w[name][at]
            w[name][at] = old + e
            up = loss()
            w[name][at] = old - e
            down = loss()
            w[name][at] = old
            assert g[at] == pytest.approx((up - down) / (2 * e), abs=1e-5), (name, at)


def test_lm_distribution_sums_to_one():
    v = lm_scoring.Vocabulary([(b"a", 50), (b"b", 20), (b"", 10), (b"c", 1)], 90, 9)
    w = {k: x + np.float32(0.1) for k, x in lm_scoring.start_weights(v).items()}
    h = np.random.default_rng(0).standard_normal((3, lm_scoring.HIDDEN)).astype(np.float32)
    total = sum(np.exp(lm_scoring.output(w, v, h, np.full(3, t))) for t in range(v.m + 1))
    assert np.allclose(total, 1, atol=1e-5)


def test_lm_gradients():
    v = lm_scoring.Vocabulary([(b"a", 50), (b"b", 20), (b"", 10), (b"c", 1)], 90, 9)
    w = {k: x.astype(float) for k, x in lm_scoring.start_weights(v).items()}
    h, target = np.random.default_rng(0).standard_normal((5, lm_scoring.HIDDEN)), np.array([0, 1, 2, 3, 4])
    _, dh, grads = lm_scoring.output(w, v, h, target, gradient=True)
    e = 1e-5
    for name, at in (("c", (2, 1)), ("w", (1, 3)), ("wb", (2,))):
        w[name][at] += e
        up = lm_scoring.output(w, v, h, target).sum()
        w[name][at] -= 2 * e
        down = lm_scoring.output(w, v, h, target).sum()
        w[name][at] += e
        assert grads[name][at] == pytest.approx(-(up - down) / (2 * e), abs=1e-3)
    assert dh.shape == h.shape


def test_lm_scoring_keeps_states_only():
    """Scoring takes the states that training takes, without the gates of all steps, which cost it memory and time."""
    v = lm_scoring.Vocabulary([(b"a", 50), (b"b", 20), (b"", 10), (b"c", 1)], 90, 9)
    rng = np.random.default_rng(4)
    w = lm_scoring.start_weights(v)
    x, h0 = rng.integers(0, v.m + 1, (9, 5)), rng.standard_normal((5, lm_scoring.HIDDEN)).astype(np.float32)
    whole, lean = lm_scoring.forward(w, x, h0), lm_scoring.forward(w, x, h0, keep=False)
    assert np.array_equal(whole[0], lean[0]) and [len(part) for part in lean] == [9, 1, 1, 1]


def test_lm_holds_large_logits():
    """Logits over MOST count as MOST, also those whose exps overflow, with finite gradients."""
    v = lm_scoring.Vocabulary([(b"a", 50), (b"b", 20), (b"", 10), (b"c", 1)], 90, 9)
    w = lm_scoring.start_weights(v)
    w["cb"][0], w["wb"][1] = 70, 200
    got, dh, grads = lm_scoring.output(w, v, np.zeros((5, lm_scoring.HIDDEN), np.float32), np.arange(5), gradient=True)
    log = lambda x, at: np.minimum(x, 60)[at] - np.log(np.exp(np.minimum(x, 60)).sum())
    want = []
    for t in range(5):
        c = v.cls[t]
        own = slice(v.starts[c], v.starts[c + 1])
        want.append(log(w["cb"].astype(float), c) + log(w["wb"][own].astype(float), t - v.starts[c]))
    assert np.allclose(got, want, rtol=1e-5, atol=1e-5)
    assert np.isfinite(dh).all() and all(np.isfinite(g).all() for g in grads.values())


def test_warc(spark):
    page = '<html><head><title>T &amp; t</title><script>var x="</p>";</script></head><body><!-- c --><p>One <b>two</b><br>three</p><a href="/l">x &lt; y</a> 1 < 2'
    pages = spark.createDataFrame([(1, "http://e.org/", page), (2, None, None), (1, "http://e.org/", page)], "page_id long, url string, html string")
    source = {r.source_id: r for r in warc.responses(pages).collect()}
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 6
    for r in rows:
        h, own = dict(source[r.source_id].headers), dict(r.headers)
        assert own["WARC-Refers-To"] == h["WARC-Record-ID"] and own["WARC-Source-Payload-Digest"] == h["WARC-Payload-Digest"]
        assert own["WARC-Block-Digest"] == warc.digest(bytes(r.block)) and int(own["Content-Length"]) == len(r.block)
        assert [([tuple(x) for x in r.headers], bytes(r.block))] == list(warc.parse(bytes(r.record)))
    text = next(bytes(r.block).decode() for r in rows if r.source_id == 1 and r.record_type == "conversion")
    assert text == "One two\nthree\nx < y 1 < 2"


def test_warc_report_equals_the_two_steps(spark):
    pages = spark.createDataFrame([(1, "http://e.org/", "<p>a"), (2, None, None), (3, "u", "é" * 9)], "page_id long, url string, html string")
    want = Counter((r.source_id, r.record_type, hashlib.sha256(r.record).hexdigest()) for r in warc.derivatives(warc.responses(pages)).collect())
    assert multiset(warc.report(pages), "page_id", "record_type", "record_sha256") == want
    assert warc.report(pages.limit(0)).collect() == [] and warc.derivatives(warc.responses(pages).limit(0)).collect() == []


def test_warc_tags():
    assert warc.scan_html('<a title="x > y" href="/l">link</a>') == ("link", {"Title": "", "Metas": [], "Links": [{"path": "A@/href", "url": "/l"}]})
    assert warc.scan_html("<p don't>a</p><b x=\"1>b")[0] == "a\nb"


def test_warc_files(spark, tmp_path):
    """Headers without spaces, in other cases, repeated and folded; encodings and charsets; gzip members; a cut tail."""
    page = "<title>é</title><p>naïve"
    chunked = lambda b: b"".join(b"%x;x=1\r\n%s\r\n" % (len(b[i : i + 7]), b[i : i + 7]) for i in range(0, len(b), 7)) + b"0\r\n\r\n"
    bodies = [
        ("Content-Type:text/html; charset=latin-1\r\nSet-Cookie: a\r\nset-cookie: b", page.encode("latin-1")),
        ("content-type: text/html\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip", chunked(gzip.compress(page.encode()))),
        ("Content-Type: text/html\r\nContent-Encoding: deflate", zlib.compress(f"<meta charset=utf-8>{page}".encode())),
        ("Content-Type: image/png", b"\x89PNG"),
        ("Content-Type: text/plain", b"a < b\n"),
    ]
    data = b""
    for i, (head, body) in enumerate(bodies):
        block = f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + body
        record = f"WARC/1.1\r\nwarc-type:response\r\nWARC-Record-ID:<urn:{i}>\r\nWARC-Concurrent-To: <x>\r\nWARC-Concurrent-To: <y>\r\nX-Long: a\r\n b\r\ncontent-length:{len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
        data += gzip.compress(record)
    (tmp_path / "a.warc.gz").write_bytes(data + gzip.compress(record)[:-9])
    records = warc.read_warc(spark, str(tmp_path / "a.warc.gz"))
    rows = warc.derivatives(records).collect()
    of = {(dict(r.headers)["WARC-Refers-To"], r.record_type): bytes(r.block).decode() for r in rows}
    assert sorted(of) == sorted([(f"<urn:{i}>", "metadata") for i in range(5)] + [(f"<urn:{i}>", "conversion") for i in (0, 1, 2, 4)])
    assert [of[f"<urn:{i}>", "conversion"] for i in (0, 1, 2, 4)] == ["naïve"] * 3 + ["a < b\n"]
    meta = json.loads(of["<urn:0>", "metadata"])["Envelope"]
    assert [v for k, v in meta["WARC-Header-Metadata"] if k == "WARC-Concurrent-To"] == ["<x>", "<y>"] and ["X-Long", "a b"] in meta["WARC-Header-Metadata"]
    found = meta["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert [v for k, v in found["Headers"] if k.lower() == "set-cookie"] == ["a", "b"] and found["HTML-Metadata"]["Title"] == "é"


def test_empty_tables(empty):
    for f in (lm_scoring.score_documents, line_dedup.report, quality.judge, quality.keep_good, substring.removed_words, winnow.edited_likeness, simhash.near_duplicates, neardup.keep_one, langid.identify, line_dedup.dedup_lines):
        assert f(empty).collect() == [], f
    assert bpe.digest_documents(empty, BPE).collect() == []


def test_head_tokens_are_whole_bins(spark):
    from sedimenta.llm.lm_scoring import head_tokens

    counts = spark.createDataFrame([(b"a", 9), (b"b", 5), (b"c", 5), (b"d", 1), (b"e", 1), (b"x" * 65, 70)], "token binary, n bigint")
    assert head_tokens(counts) == [(b"a", 9), (b"b", 5), (b"c", 5), (b"d", 1), (b"e", 1)]
    assert head_tokens(counts, 4) == [(b"a", 9), (b"b", 5), (b"c", 5)]
    assert head_tokens(counts, 2) == [(b"a", 9)]
    assert head_tokens(counts, 0) == head_tokens(counts.limit(0)) == []


def test_numbers_that_are_no_letters(spark):
    from sedimenta.llm import langid

    docs = spark.createDataFrame([(k, "the of and to in", "en") for k in range(20)] + [(100, "² ½ Ⅷ 12", "en")], "doc_id bigint, text string, lang string")
    assert langid.identify(docs).where("doc_id = 100").first().lang_pred == "und"
