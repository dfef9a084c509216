"""Product codes: against a plain Lloyd loop in Python integers."""

import hashlib
import math
import random

import duckdb
import pytest

from quarry.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, pos int, entry int, salt int, part string, code string"


def plain(rows, parts, entries, rounds):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    w = len(kept[0][1]) // parts

    def part(v, p):
        return v[p * w:(p + 1) * w]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(part(v, p), books[p])[0], []).append(part(v, p))
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[p])]
    out = []
    for i, v, lab in kept:
        found = [near(part(v, p), books[p]) for p in range(parts)]
        out.append([i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), lab])
    sums = {lab: sum(r[2] for r in out if r[3] == lab) for lab in {r[3] for r in out}}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, d, sums[lab], digest) for i, c, d, lab in out), key=str)


def vectors(seed, n=300, dim=16):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)], rng.choice([0, 1, 1, 1, None])) for i in range(n)]
    hot = rows[40][1]
    rows += [(n + i, hot, 1) for i in range(150)]  # a third of all rows are one vector
    rows += [rows[3]] * 20 + [(rows[5][0], rows[6][1], 7), (None, rows[8][1], 7), (None, None, 7)]
    rows += [(9000, None, 0), (9001, [0.5] * (dim - 1) + [None], 0), (9002, [float("nan")] * dim, 0), (-5, [float("inf")] * dim, 0), (9003, [], 1)]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 2, 3, "p", "c") for i, v, lab in rows], SCHEMA).repartition(6)


def as_floats(spark, rows):
    """The rows as their 32-bit floats."""
    return [(r.vec_id, r.embedding, r.label) for r in table(spark, rows).collect()]


@pytest.mark.parametrize("parts,entries,rounds", [(8, 16, 6), (4, 5, 1), (2, 3, 0)])
def test_codes(spark, parts, entries, rounds):
    rows = vectors(entries)
    got = vector_codes.compress(table(spark, rows), parts=parts, entries=entries, rounds=rounds)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(as_floats(spark, rows), parts, entries, rounds)


def test_few_rows_ties_and_unused_entries(spark):
    rows = [(3, [0.0] * 8, 1), (1, [0.0] * 8, None), (2, [1.0] * 8, None), (4, [0.5] * 8, 1)]
    got = sorted((tuple(r) for r in vector_codes.compress(table(spark, rows)).collect()), key=str)
    assert got == plain(rows, 8, 16, 6)


def test_broadcast_and_joined_labels_agree(spark, monkeypatch):
    rows = vectors(1)
    a = vector_codes.compress(table(spark, rows), rounds=1).collect()
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 0)
    assert sorted(map(str, a)) == sorted(map(str, vector_codes.compress(table(spark, rows), rounds=1).collect()))


def test_only_movers_are_sent(spark):
    v = vector_codes.kept_vectors(table(spark, vectors(2)))
    kept, seen = v.count(), []
    store = vector_codes.store

    def watch(df, name):
        out = store(df, name)
        seen.append((out.filter("not stays").count(), out.filter("stays").count()) if name.startswith("arrivals") else None)
        return out

    vector_codes.store = watch
    try:
        vector_codes.train(store(v, "v"))
    finally:
        vector_codes.store = store
    sent = [x for x in seen if x]
    assert sent[0] == (8 * kept, 0)
    assert all(moved < 4 * kept and sums <= 8 * 16 * 6 for moved, sums in sent[1:]) and sent[-1][0] < sent[1][0]


def test_odd_tables(spark):
    assert vector_codes.compress(table(spark, [(1, None, 1)])).collect() == []
    assert vector_codes.compress(table(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(table(spark, [(1, [0.1] * 7, 1)])).collect()


def test_sql_twin(spark):
    rows = [r for r in vectors(3) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    con = duckdb.connect()
    frame = table(spark, rows).select("vec_id", "embedding", "label").toArrow()  # noqa: F841
    con.execute("CREATE VIEW embeddings AS SELECT * FROM frame")
    assert sorted(con.execute(vector_codes.oracle()).fetchall(), key=str) == plain(as_floats(spark, rows), 8, 16, 6)
