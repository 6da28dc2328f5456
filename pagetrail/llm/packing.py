"""Packing documents into containers of fixed capacity, tier by tier.

Only sizes matter for packing, and a size is at most the capacity, so the plan is made on the histogram of
sizes (at most ``capacity`` entries, however many documents) and then applied to all documents by rank.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.keys import distributed_rank
from pagetrail.session import cut as checkpointed


def tiers(capacity: int, least: int = 16) -> list[int]:
    """Context sizes of the tiers, longest first: the capacity, halved down to ``least``."""
    out = [capacity]
    while out[-1] // 2 >= least:
        out.append(out[-1] // 2)
    return out


def _greedy(left: dict[int, int], capacity: int, opens_above: int = 0) -> list[tuple[int, list[int]]]:
    """Patterns ``(count, sizes)`` taken from ``left`` until no size above ``opens_above`` is left.

    A pattern is opened by the largest size left and its gap filled with the largest sizes left that fit. Equal
    patterns are made in one go, so the work depends on the number of different sizes, not of items.
    """
    sizes = sorted(left)
    patterns: list[tuple[int, list[int]]] = []
    while sizes and sizes[-1] > opens_above:
        pattern, gap, i = [sizes[-1]], capacity - sizes[-1], len(sizes) - 1
        used = {sizes[-1]: 1}
        while gap and (i := min(i, bisect_right(sizes, gap) - 1)) >= 0:
            s = sizes[i]
            take = min(gap // s, left[s] - used.get(s, 0))
            if take:
                pattern += [s] * take
                used[s] = used.get(s, 0) + take
                gap -= take * s
            i -= 1
        times = min(left[s] // n for s, n in used.items())
        for s, n in used.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
                sizes.remove(s)
        patterns.append((times, pattern))
    return patterns


def plan_windows(histogram: dict[int, int], capacity: int, contexts: Sequence[int] | None = None) -> list[tuple[int, int, list[int]]]:
    """``(count, context, sizes)``: so many windows of a context size hold pieces of these sizes.

    A piece is routed to the shortest context that holds it. Tiers are packed from the longest to the shortest,
    each into windows of its own context size, whose gaps are filled from the shorter tiers.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("sizes must be between 1 and the capacity")
    bounds = sorted(contexts or tiers(capacity), reverse=True)
    windows = []
    for context, shorter in zip(bounds, [*bounds[1:], 0], strict=True):
        windows += [(times, context, sizes) for times, sizes in _greedy(left, context, shorter)]
    return windows


def plan_hierarchy(histogram: dict[int, int], capacity: int, contexts: Sequence[int] | None = None) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """``(count, windows)``: so many containers hold these windows, each ``(context, sizes)``.

    Windows of the tiers (``plan_windows``) are put together by what they hold, so what a window of a shorter
    tier couldn't fill serves its neighbours in the container. The work depends on the number of different
    sizes, not of documents.
    """
    stock: dict[int, deque[tuple[int, int, list[int]]]] = {}
    for times, context, sizes in plan_windows(histogram, capacity, contexts):
        stock.setdefault(sum(sizes), deque()).append((times, context, sizes))
    out: list[tuple[int, list[tuple[int, list[int]]]]] = []
    for times, held in _greedy({used: sum(w[0] for w in ws) for used, ws in stock.items()}, capacity):
        counts = {used: held.count(used) for used in held}
        while times:
            # as many containers as the windows at hand make alike
            now, chosen = times, []
            for used, n in counts.items():
                have, context, sizes = stock[used][0]
                if have < n:  # the last windows of a pattern are topped up with those of the next
                    mixed, need, now = [], n, 1
                    while need:
                        have, context, sizes = stock[used].popleft()
                        take = min(have, need)
                        mixed += [(context, sizes)] * take
                        need -= take
                        if have > take:
                            stock[used].appendleft((have - take, context, sizes))
                    chosen.append((used, 0, mixed))
                else:
                    now = min(now, have // n)
                    chosen.append((used, n, [(context, sizes)] * n))
            for used, n, _ in chosen:
                if n:
                    have, context, sizes = stock[used].popleft()
                    if have > n * now:
                        stock[used].appendleft((have - n * now, context, sizes))
            out.append((now, [w for _, _, ws in chosen for w in ws]))
            times -= now
    return out


def plan_containers(histogram: dict[int, int], capacity: int, contexts: Sequence[int] | None = None) -> list[tuple[int, list[int]]]:
    """``plan_hierarchy`` without its windows: ``(count, sizes)``."""
    return [(times, [s for _, sizes in windows for s in sizes]) for times, windows in plan_hierarchy(histogram, capacity, contexts)]


def pieces(df: DataFrame, doc: str, size: Column, capacity: int) -> DataFrame:
    """``(doc, part, parts, start, size)``: whole documents, or for those above the capacity full parts and a rest."""
    sized = df.select(F.col(doc), size.cast("long").alias("_s")).where("_s > 0")
    parts = F.ceil(F.col("_s") / F.lit(capacity)).cast("long")
    cut = sized.select(doc, "_s", parts.alias("parts"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    start = F.col("part") * capacity
    return cut.select(doc, "part", "parts", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("_s") - start).cast("int").alias("size"))


def pack(df: DataFrame, doc: str, size: Column, capacity: int = 512, group_containers: int = 64, rows_per_bucket: int = 100_000, contexts: Sequence[int] | None = None) -> DataFrame:
    """Containers of ``capacity``: ``(container, slot, window, context, doc, part, parts, start, size, step_group)``.

    Pieces are routed to tiers of context sizes (``contexts``; by default the capacity, halved again and again),
    each tier is packed into windows of its context size, gaps of longer windows are filled from shorter tiers,
    and windows are put together to containers. ``window`` numbers a container's windows; the pieces of one
    together are no longer than its ``context``.

    Every document with a positive size occurs exactly once, in one container, undivided unless its size is
    above the capacity. Documents of null, zero or negative size are in no container; null ids are allowed;
    a repeated id is packed once per row; an empty table gives no rows. ``step_group`` numbers groups of about
    ``group_containers`` containers, dealt in order of their pattern, so each gets the same mix of full and
    less full, long and short containers.

    The driver sees the histogram only: at most ``capacity`` rows.
    """
    cut = checkpointed(pieces(df, doc, size, capacity))  # sizes are counted once, and used three times
    spark = df.sparkSession
    histogram = {r["size"]: r["n"] for r in cut.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = plan_hierarchy(histogram, capacity, contexts)
    slots, first, taken = [], 0, dict.fromkeys(histogram, 0)
    for times, windows in patterns:
        slot0 = 0
        for window, (context, sizes) in enumerate(windows):
            for size_here in sorted(set(sizes), reverse=True):
                n = sizes.count(size_here)
                slots.append((size_here, taken[size_here], taken[size_here] + times * n, first, n, slot0, window, context))
                taken[size_here] += times * n
                slot0 += n
        first += times
    groups = max(1, round(first / group_containers))
    runs = spark.createDataFrame(slots, "size int, from_rank long, to_rank long, first long, per long, slot0 int, window int, context int")
    most = max(histogram.values(), default=1)
    ranked = distributed_rank(cut, ["size"], F.struct(F.col(doc), F.col("part")), max(1, -(-most // rows_per_bucket)), "_rank")
    at = F.col("_rank") - 1
    # every piece falls into exactly one run of its size: the runs of a size are an array, searched by rank
    by_size = runs.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("to_rank", "from_rank", "first", "per", "slot0", "window", "context"))).alias("_runs"))
    run = F.element_at(F.filter("_runs", lambda r: (r["from_rank"] <= at) & (at < r["to_rank"])), 1)
    placed = ranked.join(F.broadcast(by_size), "size").withColumn("_run", run)
    offset = at - F.col("_run.from_rank")
    container = F.col("_run.first") + F.floor(offset / F.col("_run.per"))
    slot = F.col("_run.slot0") + F.pmod(offset, F.col("_run.per"))
    return placed.select(
        container.cast("long").alias("container"), slot.cast("int").alias("slot"), F.col("_run.window").alias("window"), F.col("_run.context").alias("context"), doc, "part", "parts", "start", "size",
        F.pmod(container, F.lit(groups)).cast("long").alias("step_group"),
    )


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, unused tokens, their share, and the least number of containers any packing needs."""
    per = packed.groupBy("container").agg(F.sum("size").alias("used"), F.max("step_group").alias("g"))
    one = per.agg(
        F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.countDistinct("g").alias("step_groups"),
        F.coalesce(F.max("used"), F.lit(0)).alias("fullest"),
    )
    room = F.col("containers") * capacity
    return one.select(
        "containers", "tokens", (room - F.col("tokens")).alias("unused"), F.try_divide(room - F.col("tokens"), room).alias("unused_share"),
        F.ceil(F.col("tokens") / capacity).alias("least_containers"), "step_groups", "fullest",
    )
