"""Journal semantics against a sequential interpreter on random journals with ties and recursive deletes."""

import random

import pytest

from sedimenta.operators import journal as J

SCHEMA = "seq long, type int, flags int, path string, mtime_ns long, size long"


def interpret(base, records):
    latest, deletes = {}, {}
    for seq, kind, flags, path, mtime, size in records:
        if kind == 4 and flags & 2:
            deletes[path] = max(deletes.get(path, (-1, -1)), (mtime, seq))
        if kind != 5 and (mtime, seq) > latest.get(path, ((-1, -1),))[0]:
            latest[path] = ((mtime, seq), kind, size)
    out = set()
    for path in set(base) | set(latest):
        above = [v for d, v in deletes.items() if d in ("", path) or path.startswith(d + "/")]
        if path in latest:
            version, kind, size = latest[path]
            if kind != 4 and not any(v > version for v in above):
                out.add((path, kind, size, "journal"))
        elif not above:
            out.add((path, 1, base[path], "base"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_overlay(spark, seed):
    rng = random.Random(seed)
    names = ["a", "a/b", "a/bc", "a/b/c", "d/e", "d", "x"]
    records = []
    for seq in range(60):
        kind = rng.choice([1, 1, 2, 3, 4, 4])
        recursive = kind == 4 and rng.random() < 0.4
        records.append((seq, kind, 2 if recursive else 0, rng.choice([*names, ""]) if recursive else rng.choice(names), rng.randrange(12), rng.randrange(100)))
    base = {n: 7 for n in [*names, "a/z", "y/q"]}
    got = J.overlay(spark.createDataFrame(list(base.items()), "path string, size long"), spark.createDataFrame(records, SCHEMA))
    assert {tuple(r) for r in got.collect()} == interpret(base, records)


def test_empty_journal(spark):
    row = J.stats(spark.createDataFrame([], SCHEMA)).first()
    assert (row.records, row.min_mtime_ns, row.max_mtime_ns, row.last_path) == (0, 0, 0, None)


def test_extents_need_a_commit(spark):
    schema = "path string, type int, mtime_ns long, seq long, size long, file_offset long, raw_len long"
    rows = [("p", 5, 1, 0, 0, 0, 10), ("p", 1, 2, 1, 3, 0, 0), ("p", 5, 3, 2, 0, 0, 10), ("p", 5, 3, 3, 0, 10, 10), ("p", 6, 4, 4, 15, 0, 0), ("p", 5, 5, 5, 0, 0, 9)]
    got = {(r.seq, r.visible_len) for r in J.committed_extents(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(2, 10), (3, 5)}


def test_rename_into_itself():
    with pytest.raises(ValueError):
        J.rename(None, "a", "a/b")
