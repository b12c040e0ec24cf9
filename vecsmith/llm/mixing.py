"""Mixing sources to target weights by entropy balancing.

Document rates are tilted exponentially, ``rate = min(cap, exp(lambda * size / mean size))``
with one dual variable for each source's token constraint. Newton steps on the
convex dual run over the exact (source, size) counts in a distributed
aggregation. Rates are then rounded into whole copies by systematic sampling
within size classes, and one more copy is cut where a source would still miss
its target.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecsmith.llm.common import WORD, broadcast_if_small, stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
_UNIT = 1 << 30
#: Running sums go over cells of about so many rows of a source, 256 cells at least.
_CELL_ROWS, _CELLS = 20_000, 256


def shared_targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """``total`` shared by weight; what exceeds ``cap`` times a size goes to the others, again by weight."""
    out, free, rest = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while free:
        unit = rest / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = cap * sizes[i]
            rest -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def _top(cap: float):
    """The most that a document of ``size`` words can be taken: ``cap``, or with a cut copy the whole words of it."""
    return F.lit(cap) if cap == math.floor(cap) else F.when(F.col("size") > 0, F.floor(F.lit(cap) * F.col("size")) / F.col("size")).otherwise(F.lit(cap))


def tilts(histogram: DataFrame, sources: list[dict], cap: float = CAP, tolerance: float = 1e-7, most: int = 200) -> list[float]:
    """The dual variable of each source (infinite if its target takes all at the cap).

    ``histogram`` has (sid, size, n), which is all that the dual depends on; each
    step sums rates and slopes over it on the executors, for all sources at once. Steps that leave a
    variable's bracket halve it; should ``most`` steps not do, that is an error.
    """
    spark = histogram.sparkSession
    found = [math.inf if s["target"] >= s.get("most", cap * s["size"]) * (1 - 1e-12) else 0.0 for s in sources]
    low, high = [-math.inf] * len(sources), [math.inf] * len(sources)
    open_ = [i for i, s in enumerate(sources) if s["size"] and not math.isinf(found[i])]
    for _ in range(most):
        if not open_:
            break
        dual = spark.createDataFrame([(sources[i]["sid"], found[i], sources[i]["size"] / sources[i]["rows"]) for i in open_], "sid int, lam double, mean double")
        z = F.col("size") / F.col("mean")
        rate = F.least(_top(cap), F.exp(F.least(F.col("lam") * z, F.lit(50.0))))
        slope = F.when(rate < _top(cap), rate * z).otherwise(0.0)
        at = {r[0]: r for r in histogram.join(dual, "sid").groupBy("sid").agg(F.sum(F.col("n") * F.col("size") * rate), F.sum(F.col("n") * F.col("size") * slope)).collect()}
        still = []
        for i in open_:
            _, total, grad = at[sources[i]["sid"]]
            miss = total - sources[i]["target"]
            if abs(miss) <= tolerance * max(sources[i]["target"], 1.0):
                continue
            low[i], high[i] = (low[i], found[i]) if miss > 0 else (found[i], high[i])
            step = found[i] - miss / grad if grad > 0 else math.nan
            if not low[i] < step < high[i]:  # outside the bracket: halve or widen it
                step = (low[i] + high[i]) / 2 if math.isfinite(low[i]) and math.isfinite(high[i]) else (2 * found[i] + (1 if miss < 0 else -1))
            found[i] = step
            still.append(i)
        open_ = still
    if open_:
        raise RuntimeError(f"no tilt after {most} steps for sources {[sources[i]['sid'] for i in open_]}")
    return found


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, trim: bool = True) -> DataFrame:
    """One row for each row of ``docs``: id, source, size, source_size, target, copies, part, taken.

    Size is the number of words (null text: 0). Sources in code-point order, null
    last, get ``weights`` in turn and share ``share`` of all words; no target
    exceeds ``cap`` times its source. ``copies`` are whole copies, ``part`` the
    words of cut copies beyond them (negative: the words that these lack), which as many
    documents of a source have as it takes to meet its target to the word, and with a cap that is no whole number also those taken at the cap; ``taken = copies * size + part`` lies within 0 and ``cap`` sizes.
    With ``trim=False`` there are only whole copies, so the cap must be a whole number. Documents without words have
    one copy of nothing. Repeated rows and null ids count as rows of their own; an empty
    table gives an empty result. Ties are ordered by a hash of the id, so reruns
    agree. One row for each source, and no document, comes to the driver.
    """
    whole = math.floor(cap)
    if not trim and cap != whole:
        raise ValueError("whole copies need a cap that is a whole number")
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    slim = stored(docs.select(F.col(id_col).alias(id_col), F.col(source).cast("string").alias("source"), size.alias("size")), "sizes")
    histogram = stored(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    rows = [r.asDict() for r in histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("rows"), F.sum(F.floor(F.lit(cap) * F.col("size")) * F.col("n")).alias("most")).collect()]
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    wanted = shared_targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share * sum(r["size"] for r in rows), cap)
    for i, r in enumerate(rows):
        r |= {"sid": i, "target": wanted[i]}
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r["sid"], r["source"]) for r in rows], "sid int, _source string")
    lam = tilts(histogram.join(ids, F.col("source").eqNullSafe(F.col("_source"))).select("sid", "size", "n"), rows, cap)
    plan = spark.createDataFrame(
        [(r["sid"], r["source"], r["size"], r["target"], lam[i] if math.isfinite(lam[i]) else None, r["size"] / max(r["rows"], 1) or 1.0, max(_CELLS, -(-r["rows"] // _CELL_ROWS))) for i, r in enumerate(rows)],
        "sid int, _source string, source_size long, target double, lam double, mean double, cells int",
    )
    rate = F.least(_top(cap), F.exp(F.least(F.coalesce(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)), F.lit(50.0))))
    if cap != whole:  # one copy more stands for a cut one, up to the cap
        rate = F.when(rate > whole, whole + (rate - whole) / (_top(cap) - whole)).otherwise(rate)
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate)
    order = F.xxhash64(F.col(id_col), F.lit(7))
    rated = slim.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rated = rated.withColumns({
        "rate": F.round(rate * _UNIT).cast("long"),
        "band": F.floor(F.log2(F.col("size") + 1) * 2).cast("int"),
        "cell": F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.col("cells")).cast("int"),
        "order": order,
    })
    # running sums of rates in two levels: within a cell, and over a band's cells
    cells = rated.groupBy("sid", "band", "cell").agg(F.sum("rate").alias("in_cell"))
    before = cells.withColumn("base", F.sum("in_cell").over(Window.partitionBy("sid", "band").orderBy("cell")) - F.col("in_cell")).drop("in_cell")
    run = Window.partitionBy("sid", "band", "cell").orderBy("order", id_col, "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("base") + F.col("run") + F.lit(_UNIT // 2)
    copies = F.floor(upto / _UNIT) - F.floor((upto - F.col("rate")) / _UNIT)
    rounded = rated.withColumns({"run": F.sum("rate").over(run), "nth": F.count(F.lit(1)).over(run)}).join(before, ["sid", "band", "cell"])
    cut = F.when((F.col("size") > 0) & (copies > whole), F.floor(F.lit(cap) * F.col("size")) - whole * F.col("size")).otherwise(0).cast("long")
    rounded = rounded.withColumns({"copies": F.when(F.col("size") == 0, F.lit(1)).otherwise(F.least(F.lit(whole), copies)).cast("int"), "cut": cut})
    out = stored(rounded.select(id_col, "source", "size", "source_size", "target", "copies", "cut", "sid", "band", "cell", "nth", "order"), "rounded")
    if not trim:
        return out.withColumns({"part": F.lit(0).cast("long"), "taken": F.col("copies") * F.col("size")}).select(id_col, "source", "size", "source_size", "target", "copies", "part", "taken")
    # what a source still lacks, or has too much, goes to its documents cell by cell, each as far as it has room
    got = out.groupBy("sid").agg(F.sum(F.col("copies") * F.col("size") + F.col("cut")).alias("got"), F.first("target").alias("_target"))
    miss = broadcast_if_small(stored(got.select("sid", (F.round("_target").cast("long") - F.col("got")).alias("miss")), "miss"))
    room = F.when(F.col("miss") > 0, F.floor(F.lit(cap) * F.col("size")).cast("long") - F.col("copies") * F.col("size") - F.col("cut")).otherwise(F.col("copies") * F.col("size") + F.col("cut"))
    roomy = out.join(miss, "sid").where("miss <> 0").withColumn("room", room).where("room > 0")
    rooms = roomy.groupBy("sid", "cell").agg(F.sum("room").alias("in_cell"), F.first("miss").alias("miss"))
    rooms = rooms.withColumn("base", F.sum("in_cell").over(Window.partitionBy("sid").orderBy("cell")) - F.col("in_cell")).where("base < abs(miss)").drop("miss")
    picked = roomy.join(broadcast_if_small(stored(rooms, "rooms")), ["sid", "cell"])
    sofar = F.sum("room").over(Window.partitionBy("sid", "cell").orderBy("order", "band", "nth").rowsBetween(Window.unboundedPreceding, 0)) - F.col("room")
    part = F.greatest(F.lit(0), F.least(F.col("room"), F.abs(F.col("miss")) - F.col("base") - sofar)) * F.signum("miss").cast("long")
    parts = broadcast_if_small(stored(picked.select("sid", "band", "cell", "nth", part.alias("part")).where("part <> 0"), "parts"))
    out = out.join(parts, ["sid", "band", "cell", "nth"], "left").withColumn("part", (F.coalesce("part", F.lit(0)) + F.col("cut")).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size") + F.col("part")).select(id_col, "source", "size", "source_size", "target", "copies", "part", "taken")
