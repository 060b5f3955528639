"""Samples whose categories have given proportions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import broadcast_if_small

#: Targets are a parameter of the caller; a table of more cells than this is refused.
MOST_CELLS = 100_000
#: Bits of the hash that make a bucket.
BUCKET_BITS = 12


def label(c: Column) -> Column:
    """A label as labels are compared: trimmed of spaces and tabs, lower-cased."""
    return F.lower(F.regexp_replace(c, r"^[ \t]+|[ \t]+$", ""))


def seats(cells: list[tuple[int, int, float]], size: int) -> list[int]:
    """Seats of every cell (available, floor, target) in a sample of `size`: floors first, then the smallest priorities
    (rank - 1/2) / target over all cells, ties to the earlier cell; cells without rows left give theirs to the others."""
    out = [min(n, floor) for n, floor, _ in cells]
    left = size - sum(out)
    if left <= 0:
        over = -left
        for i in sorted(range(len(out)), key=lambda i: (-(out[i] - 0.5) / cells[i][2] if cells[i][2] else -math.inf, i)):
            cutback = min(over, out[i])
            out[i], over = out[i] - cutback, over - cutback
        return out

    def taken(limit: float) -> list[int]:
        return [min(n, max(s, math.floor(limit * t + 0.5))) for (n, _, t), s in zip(cells, out)]

    most = max([(n - 0.5) / t for n, _, t in cells if t > 0 and n] or [0.0])
    low, high = 0.0, most
    if sum(taken(high)) <= size:
        return taken(high)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(taken(mid)) <= size else (low, mid)
    got = taken(low)
    order = sorted((((g + 0.5) / t, i) for i, ((n, _, t), g) in enumerate(zip(cells, got)) if t > 0 and g < n))
    for _, i in order[: size - sum(got)]:
        got[i] += 1
    return got


class TargetSample:
    """A sample of a pool whose shares of cells follow a target table.

    pool: one record per `key` (of rows with equal keys the one with the smallest labels counts), with the label columns
    `dims`. targets: `dims`, target_permille, min_rows. Labels are compared trimmed and lower-cased. Rows with a null key
    or label are not usable. The sample has `share` of the usable rows, rounded down.

    Divisor method: within its cell every record has a random rank (hash order, the same at each run), and the priority
    (rank - 1/2) / target; the first min_rows of a cell go before all priorities, and the globally smallest priorities
    fill the rest, so that the seats of exhausted cells go to the others. As priorities depend on ranks alone, the
    threshold follows from the counts of the cells, and no row is sorted globally. Ranks are made by hash bucket: bucket
    counts give each bucket's first rank, and rows are sorted within the buckets of a cell that hold one of its seats.

    Repeated target cells add up their permilles and keep the larger minimum. Empty tables give an empty sample.
    """

    def __init__(self, pool: DataFrame, targets: DataFrame, key: str = "sid", dims: tuple[str, ...] = ("dimension", "stance"), share: float = 0.25, seed: str = "sample") -> None:
        self.dims, self.key = dims, key
        names = [f"l{i}" for i in range(len(dims))]
        labels = [label(F.col(d).cast("string")).alias(n) for d, n in zip(dims, names)]
        usable = pool.select(F.col(key).alias("k"), *labels).where(" and ".join(f"{c} is not null" for c in ["k", *names]))
        self.usable = usable.groupBy("k").agg(F.min(F.struct(*names)).alias("s")).select("k", "s.*")
        wanted = targets.select(*(F.col(d).cast("string").alias(f"d{i}") for i, d in enumerate(dims)), *(label(F.col(d).cast("string")).alias(n) for d, n in zip(dims, names)), F.coalesce(F.col("target_permille"), F.lit(0)).alias("p"), F.coalesce(F.col("min_rows"), F.lit(0)).alias("m"))
        wanted = wanted.where(" and ".join(f"{n} is not null" for n in names)).groupBy(*names).agg(F.sum("p").alias("p"), F.max("m").alias("m"), *(F.min(f"d{i}").alias(f"d{i}") for i in range(len(dims))))
        rows = wanted.limit(MOST_CELLS + 1).collect()
        if len(rows) > MOST_CELLS:
            raise ValueError(f"more than {MOST_CELLS} target cells")
        spark = pool.sparkSession
        self._names, self._cells = names, sorted(rows, key=lambda r: tuple(r[n] for n in names))
        cell_rows = [(i, *(r[n] for n in names)) for i, r in enumerate(self._cells)]
        self._cell_table = spark.createDataFrame(cell_rows, "cell int, " + ", ".join(f"{n} string" for n in names))
        counts = self.usable.join(F.broadcast(self._cell_table), names, "left").groupBy("cell").agg(F.count("*").alias("n")).collect()
        available = {r.cell: r.n for r in counts}
        self.usable_rows = sum(available.values())
        self.size = math.floor(self.usable_rows * share)
        self.seats = seats([(available.get(i, 0), r.m, float(r.p)) for i, r in enumerate(self._cells)], self.size)
        self._available, self._seed = available, seed

    def report(self) -> DataFrame:
        """One row per target cell: dims as the targets spell them, target_permille, min_rows, available, required (the larger
        of the minimum and the target share, rounded up), drawn, short, share_permille reached. A cell is short if its seats
        stay below what is required of it in a divisor run that puts the required records first and has seats for them."""
        required = [int(max(r.m, -(-r.p * self.size // 1000))) for r in self._cells]
        reached = seats([(self._available.get(i, 0), q, float(r.p)) for i, (r, q) in enumerate(zip(self._cells, required))], max(self.size, sum(required)))
        rows = []
        for i, (r, s, q, most) in enumerate(zip(self._cells, self.seats, required, reached)):
            rows.append((*(r[f"d{k}"] for k in range(len(self.dims))), int(r.p), int(r.m), self._available.get(i, 0), q, s, most < q, 1000.0 * s / self.size if self.size else 0.0))
        schema = ", ".join(f"{d} string" for d in self.dims) + ", target_permille bigint, min_rows bigint, available bigint, required bigint, drawn bigint, short boolean, share_permille double"
        return self.usable.sparkSession.createDataFrame(rows, schema)

    def rows(self) -> DataFrame:
        """The sample: key, dims as the targets spell them, rank within the cell, and by which rule it is in (floor or priority)."""
        spark = self.usable.sparkSession
        seat_rows = [(i, s, int(r.m), float(r.p), *(r[f"d{k}"] for k in range(len(self.dims)))) for i, (r, s) in enumerate(zip(self._cells, self.seats))]
        seat = F.broadcast(spark.createDataFrame(seat_rows, "cell int, seats bigint, floor bigint, target double, " + ", ".join(f"d{k} string" for k in range(len(self.dims)))))
        u = self.usable.join(F.broadcast(self._cell_table), self._names).select("cell", "k", F.xxhash64(F.lit(self._seed), F.col("k").cast("string")).alias("h"))
        u = u.withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS).cast("int"))
        per = u.groupBy("cell", "bucket").agg(F.count("*").alias("n"))
        before = per.withColumn("before", F.sum("n").over(Window.partitionBy("cell").orderBy("bucket")) - F.col("n"))
        placed = u.join(broadcast_if_small(before.join(seat, "cell").where("before < seats")), ["cell", "bucket"])
        ranked = placed.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("cell", "bucket").orderBy("h", "k")))
        chosen = ranked.where("rank <= seats")
        priority = F.when(F.col("rank") > F.col("floor"), (F.col("rank") - 0.5) / F.col("target"))
        return chosen.select(F.col("k").alias(self.key), *(F.col(f"d{i}").alias(d) for i, d in enumerate(self.dims)), "rank", F.when(F.col("rank") <= F.col("floor"), "floor").otherwise("priority").alias("rule"), priority.alias("priority"))
