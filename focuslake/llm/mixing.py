"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Everything is DataFrame operations. Documents are summed up to cells, one per combination of values of the
dimensions. Each sweep scales the cells' weights to the target shares of one dimension after the other,
until all margins agree with their targets within TOLERANCE or SWEEPS are done. A cell's documents are then
kept with a probability that gives the cell its weight of the wanted tokens; where that would be more
than all it has, the cell is kept whole and the others make up for it. The choice is a hash of
``doc_id``, so it does not depend on partitions and a repeated task chooses alike.

Null values of a dimension are a value of their own; a value without a target, or with a target of
nothing, is left out; targets are rescaled to the values that occur. Null and empty texts have no tokens
and do not count, and share their cell's probability (a cell without any tokens is kept). Repeated rows are
kept or left out together, and so are all rows without ``doc_id``. An empty table gives an empty result. All
columns are kept whatever their names; ``probability``, ``selected`` and ``mixing_<dimension>`` are added, in
place of columns of these names. Long texts are counted whole. Documents that draw the same number share their fate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shared_folder
from .components import stored
from .names import plain

SWEEPS = 60
TOGETHER = 4    # sweeps in one plan
TOLERANCE = 1e-9
BROADCAST_CELLS = 100_000   # rows of numbers and names; more cells are joined by a shuffle


def tokens(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in 0..1 that depends on the document alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, share): observed token shares to a power below 1, which lifts the small ones."""
    margin = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens"))
    return margin.where("tokens > 0").select("value", F.pow(F.col("tokens").cast("double"), F.lit(power)).alias("share"))


def cells_of(docs: DataFrame, dimensions: list[str], count: Column) -> DataFrame:
    """Tokens of every combination of values."""
    return docs.select(*dimensions, count.alias("tokens")).groupBy(*dimensions).agg(F.sum("tokens").alias("tokens"))


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[f"_{c}"])
    return out


def is_small(cells: DataFrame) -> bool:
    return cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS


def rake(cells: DataFrame, targets: dict[str, DataFrame], folder: str) -> DataFrame:
    """Cells with ``weight``, their share of the target mixture; ``targets`` has (value, share) by dimension.

    Up to BROADCAST_CELLS cells are kept in one partition, where sweeps need no shuffle; more are spread.
    """
    dims, small = list(targets), is_small(cells)

    def cut(rows: DataFrame, name: str) -> DataFrame:
        rows = stored(rows, f"{folder}/{name}")
        return rows.coalesce(1) if small else rows

    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d, target in targets.items():   # only cells whose every value is wanted take part
        wanted = target.where("share > 0").groupBy(F.col("value").alias(f"_{d}")).agg(F.sum("share").alias(f"_share_{d}"))
        now = now.join(wanted, now[d].eqNullSafe(wanted[f"_{d}"]), "left").drop(f"_{d}")
    inside = F.col("weight") > 0
    for d in dims:
        inside = inside & F.col(f"_share_{d}").isNotNull()
    now = cut(now.withColumn("weight", F.when(inside, F.col("weight")).otherwise(0.0)), "sweep-0")
    mass = now.agg(F.sum("weight")).first()[0] or 1.0
    totals = {d: now.where("weight > 0").groupBy(d).agg(F.first(f"_share_{d}").alias("s")).agg(F.sum("s")).first()[0] or 1.0 for d in dims}
    now = now.withColumn("weight", F.col("weight") / mass)
    for sweep in range(1, SWEEPS + 1):
        now = now.withColumn("off", F.lit(0.0))
        for d in dims:
            now = _scale(now, d, totals[d], small)
        if small and sweep % TOGETHER:
            continue
        now = cut(now, f"sweep-{sweep}")
        off = now.agg(F.max("off")).first()[0]
        if off is None or off <= TOLERANCE:
            break
    return now.select(*dims, "tokens", "weight")


def _scale(now: DataFrame, d: str, total: float, small: bool) -> DataFrame:
    """Weights scaled to the targets of one dimension; ``off`` keeps the largest distance seen."""
    if small:   # a window over at most BROADCAST_CELLS rows
        now = now.withColumn("_margin", F.sum("weight").over(Window.partitionBy(d)))
        wanted = F.when(F.col("_margin") > 0, F.col(f"_share_{d}") / total)
        now = now.withColumns({"_factor": wanted / F.col("_margin"), "_off": F.abs(F.col("_margin") - wanted)}).drop("_margin")
    else:
        wanted = F.first(f"_share_{d}") / total
        factor = now.where("weight > 0").groupBy(F.col(d).alias(f"_{d}")).agg(
            (wanted / F.sum("weight")).alias("_factor"), F.abs(F.sum("weight") - wanted).alias("_off"))
        now = now.join(factor, now[d].eqNullSafe(factor[f"_{d}"]), "left").drop(f"_{d}")
    return now.withColumns({"weight": F.col("weight") * F.coalesce("_factor", F.lit(0.0)),
                            "off": F.greatest("off", F.coalesce("_off", F.lit(0.0)))}).drop("_factor", "_off")


def probabilities(cells: DataFrame, share: float, folder: str) -> DataFrame:
    """Cells with ``probability``, so that kept tokens are ``share`` of all and in proportion to ``weight``."""
    cells, scale, whole = stored(cells, f"{folder}/raked"), 0.0, -1
    budget = share * (cells.agg(F.sum("tokens")).first()[0] or 0)
    while True:   # cells that are kept whole only grow in number
        full = (F.col("weight") * scale >= F.col("tokens")) & (F.col("weight") > 0)
        row = cells.agg(F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)).alias("whole"),
                        F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"), F.count(F.when(full, 1)).alias("n")).first()
        if row["n"] == whole or not row["open"]:
            break
        whole, scale = row["n"], max(scale, (budget - row["whole"]) / row["open"])
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(scale) * F.col("weight") / F.col("tokens"))).otherwise(1.0)
    return cells.withColumn("probability", chance)


def mixed(docs: DataFrame, dimensions: dict[str, Column], targets, share: float = 0.5, seed: str = "mix",
          folder: str | None = None) -> DataFrame:
    """``docs`` with ``probability``, and ``selected`` by it.

    ``dimensions`` names columns of a document, ``targets(cells)`` gives (value, share) for each.
    """
    folder = folder or shared_folder(docs.sparkSession, "mixing")
    names = [f"_{k}" for k in range(len(dimensions))]
    results = ["probability", "selected", *[f"mixing_{d}".lower() for d in dimensions]]
    kept = [c for c in docs.columns if c.lower() not in results]
    inner = dict(zip(kept, plain(kept)))
    placed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()], *[v.alias(n) for n, v in zip(names, dimensions.values())])
    cells = stored(cells_of(placed, names, tokens(F.col(inner["text"]))), f"{folder}/cells")
    named = cells.withColumnsRenamed(dict(zip(names, dimensions)))
    goals = targets(named)
    fitted = rake(cells, {n: goals[d] for n, d in zip(names, dimensions)}, folder)
    chances = probabilities(fitted, share, folder).select(*[F.col(n).alias(f"_{n}") for n in names], "probability")
    rows = placed.join(F.broadcast(chances) if is_small(cells) else chances, _same(placed, chances, names), "left")
    columns = [F.col(n).alias(c) for c, n in inner.items()]
    return rows.select(*columns, *[F.col(n).alias(f"mixing_{d}") for n, d in zip(names, dimensions)], "probability",
                       (draw(F.col(inner["doc_id"]), seed) < F.col("probability")).alias("selected"))
