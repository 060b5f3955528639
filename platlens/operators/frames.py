"""Frames of a report over positions, topics and scales; each is small, whatever they were made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import broadcast_if_small
from .metrics import finite, pearson


def assert_covered(df: DataFrame, table: DataFrame, key: str, what: str = "rows") -> DataFrame:
    """df, or an error that names some keys which `table` lacks. One anti join; it stops at the first few."""
    some = df.select(key).where(F.col(key).isNotNull()).join(table.select(key), key, "left_anti").limit(5).collect()
    if some:
        raise ValueError(f"{what} without a match: {', '.join(str(r[key]) for r in some)}")
    return df


def bloc(party: Column, score: Column, left_most: float = 4.77) -> Column:
    """left, right or none (no score) by a party's expert score; parties without a name are none as well."""
    return F.when(party.isNull() | score.isNull(), "none").when(score <= left_most, "left").otherwise("right")


def imbalance(df: DataFrame, group: str) -> DataFrame:
    """One row: groups, largest, smallest and their ratio."""
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("groups"), F.max("n").alias("largest"), F.min("n").alias("smallest"), F.round(F.try_divide(F.max("n").cast("double"), F.min("n").cast("double")), 6).alias("ratio"))


def residual_sd_of_square(df: DataFrame, x: str) -> DataFrame:
    """One row: n and the deviation of x squared around its line on x, from the sums of the first four powers."""
    v = F.col(x).cast("double")
    s = df.where(finite(x)).agg(F.count("*").alias("n"), *(F.sum(F.pow(v, k)).alias(f"s{k}") for k in range(1, 5)))
    m = [F.col(f"s{k}") / F.col("n") for k in range(1, 5)]
    sxx, sxq, sqq = m[1] - m[0] * m[0], m[2] - m[0] * m[1], m[3] - m[1] * m[1]
    left = F.when(sxx > 0, sqq - sxq * sxq / sxx).otherwise(sqq)
    return s.select("n", F.sqrt(F.greatest(left, F.lit(0.0))).alias("sd"))


def within_between(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: deviation of values around their group's mean, and of group means weighted by size."""
    v = F.col(value).cast("double")
    g = df.where(finite(value) & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s"))
    n, m = F.col("n").cast("double"), F.col("m")
    total = F.sum(n)
    mean = F.sum(n * m) / total
    return g.agg(F.round(F.sqrt(F.sum(n * F.col("s")) / total), 6).alias("within"), F.round(F.sqrt(F.greatest(F.sum(n * m * m) / total - mean * mean, F.lit(0.0))), 6).alias("between"))


def agreement_matrix(df: DataFrame, scales: list[str], weight: str | None = None) -> DataFrame:
    """a, b, n, r for every pair of scale columns (a before b in the list), over rows where both are finite; with `weight`
    a weighted correlation. Pairs multiply aggregates of one pass, not rows."""
    out = []
    for i, a in enumerate(scales):
        for b in scales[i + 1 :]:
            ok = finite(a) & finite(b)
            w = F.when(ok, F.lit(1.0) if weight is None else F.col(weight).cast("double"))
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            mean = lambda e, w=w: F.sum(w * e) / F.sum(w)
            cov = mean(x * y) - mean(x) * mean(y)
            sd = lambda e, m=mean: F.sqrt(F.greatest(m(e * e) - m(e) * m(e), F.lit(0.0)))
            r = F.when(F.count_if(ok) >= 3, F.try_divide(cov, F.nullif(sd(x) * sd(y), F.lit(0.0))))
            out.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(ok).alias("n"), F.round(r, 6).alias("r")))
    return df.agg(F.array(*out).alias("pairs")).select(F.inline("pairs"))


def notable(df: DataFrame, key: str, value: str, k: int = 3) -> DataFrame:
    """The k rows at either end of a scale, with their place from that end; ties to the smaller key. A top-k report."""
    ends = []
    for name, order in (("low", F.asc(value)), ("high", F.desc(value))):
        top = df.where(finite(value)).select(key, value).orderBy(order, key).limit(k)
        ends.append(top.withColumn("end", F.lit(name)).withColumn("place", F.row_number().over(Window.orderBy(order, key))))
    return ends[0].unionByName(ends[1])


def salience_gap(cells: DataFrame, group: str, a: str, b: str, topic: str = "topic") -> DataFrame:
    """Per topic the difference between two groups in share of chunks and in mean stance; null where a group has none."""
    side = lambda g, c: F.sum(F.when(F.col(group) == g, F.col(c)).otherwise(0))
    per = cells.groupBy(topic).agg(side(a, "y").alias("ya"), side(b, "y").alias("yb"), side(a, "s").alias("sa"), side(b, "s").alias("sb"))
    total = per.agg(F.sum("ya").alias("a"), F.sum("yb").alias("b"))
    d = lambda x, y: F.try_divide(x.cast("double"), y.cast("double"))
    share = d(F.col("ya"), total.select("a").scalar()) - d(F.col("yb"), total.select("b").scalar())
    stance = d(F.col("sa"), F.col("ya")) - d(F.col("sb"), F.col("yb"))
    return per.select(topic, F.round(share, 6).alias("salience_gap"), F.round(stance, 6).alias("stance_gap"))


def expected_stance(items: DataFrame, positions: DataFrame, group: str, topic: str = "topic", theta: str = "theta") -> DataFrame:
    """Per topic and group the stance alpha + beta x mean position, kept within -1 and 1. Groups are few and broadcast."""
    means = positions.where(finite(theta)).groupBy(group).agg(F.avg(theta).alias("__m"))
    x = F.col("alpha") + F.col("beta") * F.col("__m")
    return items.join(broadcast_if_small(means), how="cross").select(topic, group, F.round(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)), 6).alias("expected"))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small frame as a table in Markdown; more than `most` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", r"\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def latex(df: DataFrame, most: int = 1000) -> str:
    """A small frame as the rows of a LaTeX table, with what TeX takes for commands escaped."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    escape = lambda c: "" if c is None else "".join("\\" + x if x in "&%$#_{}" else x for x in str(c).replace("\\", r"\textbackslash "))
    return "\n".join(" & ".join(map(escape, r)) + r" \\" for r in (df.columns, *rows))


def macros(df: DataFrame, name: str, value: str, prefix: str = "") -> str:
    """One LaTeX command a row, for numbers quoted in a text; names keep their letters alone."""
    command = lambda n: prefix + "".join(c for c in str(n).title() if c.isalpha())
    return "\n".join(f"\\newcommand{{\\{command(r[0])}}}{{{r[1]}}}" for r in df.select(name, value).limit(1000).collect())


def traces(runs: dict[str, list[float]]) -> list[tuple[str, int, float]]:
    """(run, step, loss) of fits, from the first step on."""
    return [(name, i, float(x)) for name, losses in sorted(runs.items()) for i, x in enumerate(losses)]


def within_group_r(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"), F.round(pearson(x, y), 6).alias("r"))
