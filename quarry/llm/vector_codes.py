"""Vector code compression: product codes from codebooks trained by member-resident Lloyd.

Each vector is cut into ``PARTS`` parts of integers.  Training keeps every part
where its entry lives: rows are partitioned by (position, entry, salt), written
there once and never moved while they keep their entry.  In a round

1. each task reads its resident members, finds their nearest entry under the newest
   codebook, sends one sum for each entry of those that stay and the parts of
   those that go;
2. only these travel in the shuffle, to the partition of the entry they come to, which
   is written as the round's arrivals;
3. the owners' new entries follow from the stayers' sums and the arrivals.

A member that arrived in round g lives on while all codebooks since then agree
on its entry, which a task tells from the part and the (small) codebooks; so no departure is
recorded and no file rewritten, and a lost task reads its members again.  The
salt spreads an entry that a third of all parts chose.  Codebooks are the only thing that
reaches the driver: positions x entries x components.  At the end all vectors are
encoded in place with the last codebooks.

Sums, distances and divisions are exact integers.

Cases: rows whose vector is null, empty or holds null, NaN or infinite components
are dropped.  Null vec_ids are kept, but come after all others when the first entries are chosen;
equal vec_ids are ordered by their vectors.  Repeated rows count each.  With fewer kept rows
than entries, the codebooks have as many entries as rows.  Null labels are one group.  Vectors of
different lengths, of a length that the parts don't divide, or with components of 65,536 and more raise an error.  An empty
table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from quarry.llm.common import discard, prepare, shuffle_partitions, store

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components are below this, so that squared distances of whole vectors fit 64 bits.
LIMIT = 65_536
#: Rows of a batch, for parts are short.
BATCH_ROWS = 8_192
#: Label sums up to so many are broadcast.
FEW_LABELS = 100_000

MEMBERS = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("salt", T.IntegerType()),
                        T.StructField("n", T.LongType()), T.StructField("stays", T.BooleanType()),
                        T.StructField("vec_id", T.LongType()), T.StructField("part", T.ArrayType(T.LongType()))])


def kept_vectors(embeddings: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): rows with finite vectors, as integers floor(scale * x)."""
    x = F.col(vector)
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    small = F.forall(x, lambda c: F.abs(c) < LIMIT)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    checked = F.when(small, whole).otherwise(F.raise_error(F.lit(f"a component of {LIMIT} or more")).cast("array<long>"))
    return embeddings.filter(sound).select("vec_id", "label", checked.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column of equal lengths as rows of numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * width:
        raise ValueError(f"vectors of other lengths than {width}")
    return flat.reshape(-1, width)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry, lowest index first."""
    d = np.stack([((parts - e) ** 2).sum(1) for e in entries], 1)
    best = d.argmin(1)
    return best, d[np.arange(len(parts)), best]


def batch_of(pos, entry, salt, n, stays, vec_id, part) -> pa.RecordBatch:
    width = part.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(part.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(pos, pa.int32()), pa.array(entry, pa.int32()), pa.array(salt, pa.int32()), pa.array(n, pa.int64()),
                                       pa.array(stays, pa.bool_()), pa.array(vec_id, pa.int64()), lists], MEMBERS.names)


def first_arrivals(books: np.ndarray):
    """mapInArrow function: (vec_id, salt, v) -> the parts of each vector at their nearest first entry."""
    positions, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(2), positions * width).reshape(-1, positions, width)
            salt = batch.column(1).to_numpy(zero_copy_only=False)
            n = len(v)
            for pos in range(positions):
                entry, _ = nearest(v[:, pos], books[pos])
                yield batch_of(np.full(n, pos), entry, salt, np.ones(n, np.int64), np.zeros(n, bool), batch.column(0), v[:, pos])

    return run


def move(history: list[np.ndarray], salts: int):
    """mapInArrow function: residents (came, members) -> those that leave, at their
    new entry, and a sum of those that stay for each entry.  ``history`` holds the
    codebooks by round, the newest last."""
    positions, _, width = history[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            came, pos, entry, salt = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            part = matrix(batch.column(5), width)
            vec_id = batch.column(4)
            alive, to = np.ones(len(part), bool), entry.copy()
            for p in np.unique(pos):
                here = np.flatnonzero(pos == p)
                for k in range(int(came[here].min()), len(history)):
                    # who came in round k or before was to stay at its entry under each codebook since
                    look = here[alive[here] & (came[here] <= k)]
                    best, _ = nearest(part[look], history[k][p])
                    if k < len(history) - 1:
                        alive[look[best != entry[look]]] = False
                    else:
                        to[look] = best
            stay = alive & (to == entry)
            for p, e in {*zip(pos[stay].tolist(), entry[stay].tolist(), strict=True)}:
                mine = stay & (pos == p) & (entry == e)
                held = sums.setdefault((p, e), [0, np.zeros(width, object)])
                held[0] += int(mine.sum())
                held[1] += part[mine].sum(0)
            go = np.flatnonzero(alive & ~stay)
            if len(go):
                yield batch_of(pos[go], to[go], salt[go], np.ones(len(go), np.int64), np.zeros(len(go), bool), vec_id.take(pa.array(go)), part[go])
        if sums:
            keys = sorted(sums)
            yield batch_of([p for p, _ in keys], [e for _, e in keys], np.arange(len(keys)) % salts, [sums[k][0] for k in keys], np.ones(len(keys), bool),
                           pa.nulls(len(keys), pa.int64()), np.stack([sums[k][1] for k in keys]).astype(np.int64))

    return run


def updated(books: np.ndarray, arrived: DataFrame) -> np.ndarray:
    """The next codebooks: floor(sum / count) of each entry's stayers and arrivals, the
    entry itself where nobody is."""
    big = "decimal(38,0)"
    sums = (arrived.select("pos", "entry", "n", F.posexplode("part").alias("i", "x")).groupBy("pos", "entry", "i")
            .agg(F.sum(F.col("x").cast(big)).alias("x"), F.sum("n").alias("n")).collect())
    out = books.copy()
    for r in sums:
        out[r["pos"], r["entry"], r["i"]] = int(r["x"]) // r["n"]
    return out


def first_books(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """(position, entry, component) of the vectors with the smallest ids."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not rows:
        return None
    sizes = {len(r["v"]) for r in rows}
    if len(sizes) > 1 or next(iter(sizes)) % parts:
        raise ValueError(f"vectors of {sorted(sizes)} components can't be cut into {parts} equal parts")
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks before and after each round, or nothing without vectors.  ``vectors`` is stored."""
    spark = vectors.sparkSession
    books = first_books(vectors, parts, entries)
    if books is None:
        return []
    history, arrivals = [books], []
    salts = max(4, shuffle_partitions(spark))
    owner = ["pos", "entry", "salt"]
    for k in range(rounds):
        if k == 0:
            salted = vectors.select("vec_id", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("salt"), "v")
            sent = salted.mapInArrow(first_arrivals(books), MEMBERS)
        else:
            residents = None
            for came, one in enumerate(arrivals, 1):
                rows = one.filter("not stays").select(F.lit(came).alias("came"), *owner, "vec_id", "part")
                residents = rows if residents is None else residents.union(rows)
            sent = residents.mapInArrow(move(history, salts), MEMBERS)
        arrivals.append(store(sent.repartition(*owner), f"arrivals_{k}"))
        books = updated(books, arrivals[-1])
        history.append(books)
    for one in arrivals:
        discard(one)
    return history


def encoder(books: np.ndarray):
    """mapInArrow function: (vec_id, label, v) -> (vec_id, label, code, error)."""
    positions, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(2), positions * width).reshape(-1, positions, width)
            found = [nearest(v[:, p], books[p]) for p in range(positions)]
            codes = np.stack([best for best, _ in found], 1)
            error = sum(d for _, d in found)
            if books.shape[1] > 256:
                raise ValueError("an index takes two hex digits, so codebooks have 256 entries at most")
            text = codes.astype(np.uint8).tobytes().hex()
            step = 2 * positions
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text[i:i + step] for i in range(0, len(text), step)], pa.string()),
                                              pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    spark = embeddings.sparkSession
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    vectors = store(kept_vectors(embeddings, vector, scale), "vectors")
    history = train(vectors, parts, entries, rounds)
    label = vectors.schema["label"].dataType.simpleString()
    if not history:
        return vectors.selectExpr("vec_id", "cast(null as string) code", "0L error", "0L label_error", "cast(null as string) codebooks_sha256")
    coded = store(vectors.mapInArrow(encoder(history[-1]), f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {label}, code string, error long"), "codes")
    sums = store(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    found = F.broadcast(sums) if sums.count() <= FEW_LABELS else sums
    return (coded.join(found.withColumnRenamed("label", "__label"), F.col("label").eqNullSafe(F.col("__label")))
            .select("vec_id", "code", "error", "label_error", F.lit(books_digest(history[-1])).alias("codebooks_sha256")))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB twin over ``embeddings``."""
    far = "list_sum(list_transform(range(1, len(p.part) + 1), lambda i: (p.part[i] - c.e[i]) * (p.part[i] - c.e[i])))"

    def nearest_sql(k: int) -> str:
        return (f"a{k} AS MATERIALIZED (SELECT p.row, p.pos, p.part, min(struct_pack(d := {far}, entry := c.entry)) AS best "
                f"FROM p JOIN c{k} c USING (pos) GROUP BY p.row, p.pos, p.part)")

    floor = "(CAST(s AS HUGEINT) - ((CAST(s AS HUGEINT) % n) + n) % n) // n"
    steps = []
    for k in range(rounds):
        steps += [nearest_sql(k), f"""
m{k} AS (SELECT pos, best.entry AS entry, i, sum(x) AS s, count(*) AS n
  FROM (SELECT pos, best, unnest(part) AS x, unnest(range(1, len(part) + 1)) AS i FROM a{k}) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.pos, c.entry, coalesce(m.e, c.e) AS e FROM c{k} c LEFT JOIN
  (SELECT pos, entry, list(CAST({floor} AS BIGINT) ORDER BY i) AS e FROM m{k} GROUP BY pos, entry) m ON m.pos = c.pos AND m.entry = c.entry)"""]
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS row, vec_id, label,
        list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, k AS pos, v[k * len(v) // {parts} + 1:(k + 1) * len(v) // {parts}] AS part FROM v, (SELECT unnest(range(0, {parts})) AS k)),
c0 AS MATERIALIZED (SELECT pos, CAST(row - 1 AS BIGINT) AS entry, part AS e FROM p WHERE row <= {entries}),
{", ".join(steps)},
{nearest_sql(rounds)},
o AS (SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY pos) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT v.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h.codebooks_sha256
FROM v JOIN o USING (row), h"""
