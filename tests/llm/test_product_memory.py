"""A product of sets is bounded by their items, not only by their number."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import links


def copies(n, size, seed=1):
    """Edited copies of one set, some within the threshold."""
    rng = np.random.default_rng(seed)
    base, out = rng.integers(0, 2 ** 64, size, dtype=np.uint64), []
    for _ in range(n):
        s = base.copy()
        k = int(rng.integers(0, size // 5))
        s[rng.integers(0, size, k)] = rng.integers(0, 2 ** 64, k, dtype=np.uint64)
        out.append(np.unique(s))
    return out


def similar(sets, comps, percent):
    found = set()
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            both = len(np.intersect1d(a, b, assume_unique=True))
            if comps[i] != comps[j] and 100 * both >= percent * (len(a) + len(b) - both):
                found.add((i, j))
    return found


def as_table(sets, comps):
    ends = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])], pa.int32())
    return pa.table({"id": np.arange(len(sets)), "component": np.array(comps),
                     "items": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))})


def test_product_of_many_items_takes_little_memory():
    sets = copies(150, 6_000)
    comps = [i % 40 for i in range(len(sets))]
    table = as_table(sets, comps)
    table = pa.concat_tables([table.slice(0, 70), table.slice(70)])  # as it comes in several batches
    tracemalloc.start()
    found = links.product_links(85)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)) == similar(sets, comps, 85)
    assert found.num_rows > 100
    assert peak < 32_000_000  # 7 MB of items


@pytest.mark.parametrize("items", [1_000_000, 900])
def test_parts_in_blocks_find_the_same_links(spark, monkeypatch, items):
    monkeypatch.setattr(links, "ITEMS", items)
    sets = copies(40, 100) + copies(12, 30, 2)
    comps = [i if i % 3 else 0 for i in range(len(sets))]
    part = [int(i >= 40) for i in range(len(sets))]
    parts = spark.createDataFrame([(part[i], i, comps[i]) for i in range(len(sets))], "part long, id long, component long")
    marks = spark.createDataFrame([(i, len(s)) for i, s in enumerate(sets)], "id long, size long")
    held = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in enumerate(sets)], "id long, items array<long>")
    got = [tuple(r) for r in links.products(parts, marks, held, 85).collect()]
    assert set(got) == similar(sets, comps, 85) and len(got) == len(set(got)) > 20
