"""Context packages: what fits into a token budget that is divided over sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def package(items: DataFrame, shares: list[tuple[str, float]], budget: int) -> DataFrame:
    """(q_id, section, place, item, tokens, until, room) of the items that a package takes.

    ``items``: (q_id, section, item, tokens), tokens positive, taken in order of item within
    a section; ``shares``: sections in order with their share of the budget. A section has its
    share and what the sections before it left; it takes items until one does not fit, so
    priorities hold and the whole never exceeds the budget. Sections without a share get
    nothing.

    Only items whose running sum is within the budget can be taken, so a section's array of
    sums has at most ``budget`` numbers, however many items there are.
    """
    if sum(s for _, s in shares) > 1 + 1e-9 or any(s < 0 for _, s in shares):
        raise ValueError("shares are parts of one budget")
    order = W.partitionBy("q_id", "section").orderBy("item", "tokens")
    rows = items.filter(F.col("section").isin(*[n for n, _ in shares])).withColumn("until", F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("bigint"))
    rows = rows.withColumn("place", F.row_number().over(order)).filter(F.col("until") <= budget)
    sums = rows.groupBy("q_id", "section").agg(F.collect_list("until").alias("sums"))
    each = sums.groupBy("q_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "sums"))).alias("m"))
    allotted = F.array(*[F.struct(F.lit(n).alias("section"), F.lit(int(budget * s)).cast("bigint").alias("share")) for n, s in shares])
    none = F.expr("CAST(array() AS array<struct<section:string,room:bigint>>)")

    def give(state, section):
        room = state["left"] + section["share"]
        used = F.coalesce(F.array_max(F.filter(F.try_element_at(F.col("m"), section["section"]), lambda x: x <= room)), F.lit(0).cast("bigint"))
        return F.struct((room - used).alias("left"), F.concat(state["out"], F.array(F.struct(section["section"].alias("section"), room.alias("room")))).alias("out"))

    rooms = each.select("q_id", F.explode(F.aggregate(allotted, F.struct(F.lit(0).cast("bigint").alias("left"), none.alias("out")), give, lambda s: s["out"])).alias("r"))
    rooms = rooms.select("q_id", F.col("r.section").alias("section"), F.col("r.room").alias("room"))
    return rows.join(rooms, ["q_id", "section"]).filter("until <= room").select("q_id", "section", "place", "item", "tokens", "until", "room")
