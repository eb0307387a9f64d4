"""Ordered-series operators that never hold a whole series in one task.

A clip (or a scene) can own a large share of all frames, so no operator here
windows or collects by clip. Every series has a dense position column and is cut
into chunks of ``CHUNK`` positions. Work inside a chunk is an ordinary window or
fold over at most ``CHUNK`` (plus halo) rows; what crosses a chunk border is

* a *halo*: the last rows of a chunk are copied into the next one (fixed-size
  frames: ``lag``, rolling means, rolling medians);
* a *carry*: one narrow row per chunk, combined over the chunks before it
  (running counts, last known value, exponential averages);
* a *state map*: for folds over a small set of states, one array per chunk that
  says which state each incoming state leads to; maps compose, so chunks are
  folded in parallel and only the composed maps are walked in order.

All results equal the row-by-row definition. Operators read their input more
than once: hand them a staged table (``session.staged``) when it is expensive.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged

CHUNK = 512
SUPER = 1024  # chunks per group in the second level of a state scan
SKETCH_SIZE = 1024  # off by less than half a hundredth of the rows
SPLITTERS = 63
MOST_ORDERED = 1 << 16  # distinct values ordered in one task


def _chunk_of(pos: str, size: int) -> Column:
    return F.floor(F.col(pos) / size).cast("bigint")


def halo_window(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    before: int,
    columns: dict[str, Callable[[object], Column]],
    chunk: int = CHUNK,
) -> DataFrame:
    """Add window columns that look back at most ``before`` rows of a dense series.

    ``columns`` maps a name to a function from an ordered window specification to
    a column. The function sets its own frame.
    """
    size = max(chunk, before)
    home = _chunk_of(pos, size)
    last_rows = (F.col(pos) % size) >= size - before
    copies = F.when(last_rows, F.array(home, home + 1)).otherwise(F.array(home))
    spread = df.withColumn("_home", home).withColumn("_chunk", F.explode(copies))
    window = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    for name, build in columns.items():
        spread = spread.withColumn(name, build(window))
    return spread.where(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home")


def previous_row(
    df: DataFrame, keys: Sequence[str], pos: str, columns: dict[str, str], chunk: int = CHUNK
) -> DataFrame:
    """Values of the row before, in a series whose positions may have gaps.

    ``columns`` maps a source column to the name of its previous value.
    """
    chunked = df.withColumn("_chunk", _chunk_of(pos, chunk))
    window = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    packed = F.struct(*[F.col(source).alias(name) for source, name in columns.items()])
    ends = chunked.groupBy(*keys, "_chunk").agg(F.max_by(packed, F.col(pos)).alias("_end"))
    ends = ends.withColumn("_carry", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk")))
    local = chunked.withColumn("_prev", F.lag(packed).over(window)).join(
        ends.select(*keys, "_chunk", "_carry"), [*keys, "_chunk"], "left"
    )
    picked = local.withColumn("_prev", F.coalesce("_prev", "_carry"))
    for name in columns.values():
        picked = picked.withColumn(name, F.col("_prev")[name])
    return picked.drop("_prev", "_carry", "_chunk")


def running_count(
    df: DataFrame, keys: Sequence[str], pos: str, value: Column, name: str, chunk: int = CHUNK
) -> DataFrame:
    """Inclusive running sum of an integer column."""
    chunked = df.withColumn("_chunk", _chunk_of(pos, chunk)).withColumn("_value", value.cast("bigint"))
    totals = chunked.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return (
        chunked.withColumn(name, F.sum("_value").over(inside))
        .join(offsets.select(*keys, "_chunk", "_offset"), [*keys, "_chunk"])
        .withColumn(name, F.col(name) + F.col("_offset"))
        .drop("_chunk", "_value", "_offset")
    )


def hold_last(
    df: DataFrame, keys: Sequence[str], pos: str, columns: Sequence[str], chunk: int = CHUNK
) -> DataFrame:
    """Replace nulls by the last known value of the same column in the series."""
    chunked = df.withColumn("_chunk", _chunk_of(pos, chunk))
    ends = chunked.groupBy(*keys, "_chunk").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(pos))).alias(f"_end_{c}") for c in columns]
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carries = ends.select(
        *keys, "_chunk", *[F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in columns]
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    held = chunked
    for c in columns:
        held = held.withColumn(c, F.last(c, ignorenulls=True).over(inside))
    held = held.join(carries, [*keys, "_chunk"])
    for c in columns:
        held = held.withColumn(c, F.coalesce(c, f"_carry_{c}"))
    return held.drop("_chunk", *[f"_carry_{c}" for c in columns])


def with_rank(df: DataFrame, keys: Sequence[str], pos: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Add the 0-based number of each row in its series, dense whatever gaps ``pos`` has."""
    counted = running_count(df, keys, pos, F.lit(1), name, chunk)
    return counted.withColumn(name, F.col(name) - 1)


def _ema_chunk(keep: float, chunk: int) -> int:
    """Chunk length for a decay of ``keep`` per row: the in-chunk sum scales a row by
    ``keep ** -k``, and the length keeps that factor below 1e140."""
    return max(1, min(chunk, math.floor(140.0 / -math.log10(keep))))


def fold_carries(ends: DataFrame, keys: Sequence[str], columns: Sequence[str], decay: float, forward: bool = True) -> DataFrame:
    """What reaches each chunk from all chunks before it (after it): ``{column}_in``.

    ``ends`` has one row per chunk (``keys``, ``_chunk``, ``columns``: numbers or arrays). A chunk hands on its own
    end plus ``decay`` times what reached it. One row per chunk is streamed in order with one state per
    series; nothing is cut off and nothing is copied.
    """
    order = F.col("_chunk").asc() if forward else F.col("_chunk").desc()
    rows = ends.select(*keys, "_chunk", *columns).repartition(*keys).sortWithinPartitions(*keys, order)
    step = 1 if forward else -1
    # The carry goes to the next chunk, also if that one has no end of its own.
    fields = [f for f in rows.schema.fields if f.name in keys]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "_chunk BIGINT", *[f"`{c}_in` {kinds[c]}" for c in columns]])
    names = [f.name for f in fields]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                here = tuple(row[n] for n in names)
                if here != series:
                    series, state = here, [0.0] * len(columns)
                state = [decay * s + (np.asarray(row[c]) if isinstance(row[c], (list, np.ndarray)) else row[c]) for s, c in zip(state, columns)]
                out.append((*here, row["_chunk"] + step, *state))
            yield pd.DataFrame(out, columns=[*names, "_chunk", *[f"{c}_in" for c in columns]])

    return rows.mapInPandas(walk, schema)


def ema(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: dict[str, str],
    weight: float,
    start: str = "first",
    chunk: int = CHUNK,
    backward: dict[str, str] | None = None,
    length: str | None = None,
) -> DataFrame:
    """Exponential average ``s = weight * x + (1 - weight) * s`` of dense series from position 0.

    ``start`` is ``"first"`` (the first value is taken as it is) or ``"zero"``.
    ``backward`` maps columns to averages that run from the last row, ``length`` names the
    column with the series length; both directions share one shuffle and one join.

    The recurrence is linear, so a chunk is one windowed sum of scaled values and
    the part that comes from the chunks before (or after) is added as a scaled carry.
    """
    keep = 1.0 - weight
    backward = backward or {}
    if keep <= 0.0:
        for source, name in [*columns.items(), *backward.items()]:
            df = df.withColumn(name, F.col(source))
        return df
    size = _ema_chunk(keep, chunk)
    k = F.col(pos) % size
    # Distance to the chunk's last row; only the last chunk of a series is shorter.
    back = F.least(F.lit(size), F.col(length) - F.col("_chunk") * size) - 1 - k if length else None
    window = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    onward = window.rowsBetween(0, Window.unboundedFollowing)

    def taken(source: str, at_start: Column) -> Column:
        scaled = F.col(source) * F.lit(weight)
        return F.when(at_start, F.col(source)).otherwise(scaled) if start == "first" else scaled

    def power(n: Column) -> Column:
        return F.pow(F.lit(keep), n)

    local = df.withColumn("_chunk", _chunk_of(pos, size))
    sums = {}
    for source, name in columns.items():
        value = taken(source, F.col(pos) == 0)
        sums[f"_f_{name}"] = F.sum(value * power(-k)).over(upto) * power(k)
    for source, name in backward.items():
        value = taken(source, F.col(pos) == F.col(length) - 1)
        sums[f"_b_{name}"] = F.sum(value * power(-back)).over(onward) * power(back)
    local = local.withColumns(sums)
    forward_names = [f"_f_{name}" for name in columns.values()]
    backward_names = [f"_b_{name}" for name in backward.values()]
    # One narrow row per chunk border goes through the fold of the carries.
    joined = local
    if forward_names:
        ends = local.where(k == size - 1).select(*keys, "_chunk", *forward_names)
        joined = joined.join(fold_carries(ends, keys, forward_names, keep**size), [*keys, "_chunk"], "left")
    if backward_names:
        ends = local.where(k == 0).select(*keys, "_chunk", *backward_names)
        joined = joined.join(fold_carries(ends, keys, backward_names, keep**size, forward=False), [*keys, "_chunk"], "left")
    nothing = F.lit(0.0)
    out = {
        name: F.col(f"_f_{name}") + F.coalesce(F.col(f"_f_{name}_in"), nothing) * power(k + 1)
        for name in columns.values()
    }
    for name in backward.values():
        out[name] = F.col(f"_b_{name}") + F.coalesce(F.col(f"_b_{name}_in"), nothing) * power(back + 1)
    helpers = [*forward_names, *backward_names]
    return joined.withColumns(out).drop("_chunk", *helpers, *[f"{c}_in" for c in helpers])


def _look_up(state_map: Column, state: Column) -> Column:
    # A map of length one is constant: every incoming state leads to the same one.
    return F.when(F.size(state_map) == 1, F.get(state_map, F.lit(0))).otherwise(F.get(state_map, state))


def _compose(first: Column, second: Column) -> Column:
    return F.transform(first, lambda state: _look_up(second, state))


def scan_states(maps: DataFrame, keys: Sequence[str], first_state: int = 0) -> DataFrame:
    """State each chunk starts in, from one state map per chunk.

    ``maps`` has ``keys``, ``chunk`` and ``state_map ARRAY<INT>`` (incoming state to
    outgoing state; length one if constant). Chunks are composed in groups of
    ``SUPER``, the groups are walked in order, then every group hands its chunks
    their state. A group collects at most ``SUPER`` maps, the walk one per
    ``SUPER * CHUNK`` rows.
    """

    def ordered(order: str) -> Column:
        packed = F.struct(F.col(order).alias("at"), F.col("state_map").alias("m"))
        return F.sort_array(F.collect_list(packed))

    def walk(entries: Column, state: Column) -> Column:
        """Array of (chunk, incoming state) along an ordered list of maps."""
        empty = F.array().cast("array<struct<at: bigint, state: int>>")
        begin = F.struct(state.cast("int").alias("state"), empty.alias("seen"))
        return F.aggregate(
            entries,
            begin,
            lambda acc, e: F.struct(
                _look_up(e["m"], acc["state"]).alias("state"),
                F.concat(
                    acc["seen"], F.array(F.struct(e["at"].alias("at"), acc["state"].alias("state")))
                ).alias("seen"),
            ),
            lambda acc: acc["seen"],
        )

    grouped = (
        maps.withColumn("_super", F.floor(F.col("chunk") / SUPER).cast("bigint"))
        .groupBy(*keys, "_super")
        .agg(ordered("chunk").alias("_maps"))
    )
    whole = F.aggregate(
        F.slice("_maps", F.lit(2), F.greatest(F.size("_maps") - 1, F.lit(0))),
        F.element_at("_maps", 1)["m"],
        lambda acc, e: _compose(acc, e["m"]),
    )
    tops = (
        grouped.select(*keys, F.col("_super"), whole.alias("state_map"))
        .groupBy(*keys)
        .agg(ordered("_super").alias("_tops"))
        .withColumn("_top", F.explode(walk(F.col("_tops"), F.lit(first_state))))
        .select(*keys, F.col("_top.at").alias("_super"), F.col("_top.state").alias("_state"))
    )
    return (
        grouped.join(tops, [*keys, "_super"])
        .withColumn("_seen", F.explode(walk(F.col("_maps"), F.col("_state"))))
        .select(*keys, F.col("_seen.at").alias("chunk"), F.col("_seen.state").alias("state_in"))
    )


def greedy_cuts(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    candidate: Column,
    min_gap: int,
    chunk: int = CHUNK,
) -> DataFrame:
    """Positions accepted by "candidate and at least ``min_gap`` after the last accepted one".

    The series starts with an accepted position 0. The state at a chunk border is
    the distance to the last accepted position, capped at ``min_gap``.
    """
    size = max(chunk, min_gap)
    found = df.where(candidate).select(*keys, F.col(pos).cast("bigint").alias("_pos"))
    chunks = (
        found.withColumn("chunk", F.floor(F.col("_pos") / size).cast("bigint"))
        .groupBy(*keys, "chunk")
        .agg(F.sort_array(F.collect_list("_pos")).alias("_found"))
        .withColumn("_base", F.col("chunk") * size)
    )

    def last_after(last: Column) -> Column:
        return F.aggregate(
            "_found", last, lambda acc, p: F.when(p - acc >= min_gap, p).otherwise(acc)
        )

    gaps = F.sequence(F.lit(0), F.lit(min_gap))
    # With no candidate in between, the distance is at least one whole chunk.
    state_map = F.transform(
        gaps,
        lambda gap: F.least(F.col("_base") + size - last_after(F.col("_base") - gap), F.lit(min_gap)).cast("int"),
    )
    # A chunk without candidates has no row: whoever comes after it is far enough away.
    skipped = F.col("chunk") - F.lag("chunk", 1, -1).over(Window.partitionBy(*keys).orderBy("chunk")) > 1
    maps = chunks.select(*keys, "chunk", state_map.alias("state_map")).withColumn("_skipped", skipped)
    maps = maps.withColumn(
        "state_map",
        F.when(F.col("_skipped"), F.array(F.get("state_map", F.lit(min_gap)))).otherwise(F.col("state_map")),
    )
    chunks = chunks.withColumn("_skipped", skipped)
    reached = scan_states(maps.drop("_skipped"), keys)
    chunks = (
        chunks.join(reached, [*keys, "chunk"])
        .withColumn("state_in", F.when(F.col("_skipped"), F.lit(min_gap)).otherwise(F.col("state_in")))
    )
    accepted = F.aggregate(
        "_found",
        F.struct(
            (F.col("_base") - F.col("state_in")).alias("last"),
            F.array().cast("array<bigint>").alias("taken"),
        ),
        lambda acc, p: F.when(
            p - acc["last"] >= min_gap,
            F.struct(p.alias("last"), F.concat(acc["taken"], F.array(p)).alias("taken")),
        ).otherwise(acc),
        lambda acc: acc["taken"],
    )
    return chunks.select(*keys, F.explode(accepted).alias(pos)).withColumn(pos, F.col(pos).cast("int"))


def limit_steps(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    name: str,
    max_step: int,
    chunk: int = CHUNK,
    bounds: tuple[int, int] | None = None,
) -> DataFrame:
    """Follow an integer series with at most ``max_step`` per row; the first value is taken as it is.

    States are the whole numbers within ``bounds``; where no bounds are known they are
    measured per key. A value outside given bounds fails the job.
    Returns ``keys``, ``pos`` and ``name``.
    """
    given = F.col(value).cast("int")
    if bounds is not None:
        fine = given.between(*bounds) | given.isNull()
        given = F.when(fine, given).otherwise(F.raise_error(F.lit(f"{value} lies outside {bounds}")).cast("int"))
    row = F.struct(F.col(pos).cast("bigint").alias("at"), given.alias("v"))
    chunks = (
        df.select(*keys, _chunk_of(pos, chunk).alias("chunk"), row.alias("_row"))
        .groupBy(*keys, "chunk")
        .agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    )
    if bounds is None:
        ends = df.groupBy(*keys).agg(F.min(value).cast("int").alias("_lo"), F.max(value).cast("int").alias("_hi"))
        chunks = chunks.join(ends, list(keys))
    else:
        chunks = chunks.withColumn("_lo", F.lit(bounds[0])).withColumn("_hi", F.lit(bounds[1]))

    def follow(p: Column, e: Column) -> Column:
        return F.greatest(p - max_step, F.least(p + max_step, e["v"]))

    def run(state: Column) -> Column:
        return F.aggregate("_rows", state, follow)

    lowest, highest = run(F.col("_lo")), run(F.col("_hi"))
    # The map is monotone: if both ends meet, every state in between leads there too.
    general = F.aggregate(
        "_rows",
        F.sequence(F.col("_lo"), F.col("_hi")),
        lambda states, e: F.transform(states, lambda p: follow(p, e)),
    )
    opening = F.aggregate("_rows", F.element_at("_rows", 1)["v"], follow)
    state_map = (
        F.when(F.col("chunk") == 0, F.array(opening))
        .when(lowest == highest, F.array(lowest))
        .otherwise(general)
    )
    maps = chunks.select(
        *keys, "chunk", F.transform(state_map, lambda p: p - F.col("_lo")).alias("state_map")
    )
    first = F.when(F.col("chunk") == 0, F.element_at("_rows", 1)["v"]).otherwise(
        F.col("_lo") + F.col("state_in")
    )
    out = F.aggregate(
        "_rows",
        F.struct(
            first.alias("p"), F.array().cast("array<struct<at: bigint, p: int>>").alias("seen")
        ),
        lambda acc, e: F.struct(
            follow(acc["p"], e).alias("p"),
            F.concat(
                acc["seen"], F.array(F.struct(e["at"].alias("at"), follow(acc["p"], e).alias("p")))
            ).alias("seen"),
        ),
        lambda acc: acc["seen"],
    )
    return (
        chunks.join(scan_states(maps, keys), [*keys, "chunk"])
        .withColumn("_out", F.explode(out))
        .select(*keys, F.col("_out.at").cast("int").alias(pos), F.col("_out.p").alias(name))
    )


def pick_by_index(
    df: DataFrame, keys: Sequence[str], value: str, picks: dict[str, Callable[[Column], Column]], most: int = MOST_ORDERED
) -> DataFrame:
    """Order statistics by zero-based index, exact, on any distribution of values.

    ``picks`` maps a name to a function from the row count to an index; an index that no row has gives null. A quantile sketch per
    key, merged from the tasks, bounds where each wanted index lies. One pass then counts exactly what is below that range and
    the equal values inside it; only rows inside are shuffled by value. Where the sketch was wrong the
    whole key is taken. As long as a range holds more than ``most`` distinct values it is cut by the splitters
    of a new sketch and counted again, so what one task orders is bounded whatever the values are. Null values don't count.

    The driver sees two numbers per round. ``df`` is read twice.
    """
    keys, names = list(keys), list(picks)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    held = staged(_near_index(rows, keys, picks), "near-index")
    told = _sizes(held, keys).agg(F.max("_distinct"), F.sum((~F.col("_sure")).cast("int"))).first()
    if told[1]:
        lost = _sizes(held, keys).where(~F.col("_sure")).select(*keys, "_pick", "_at")
        whole = rows.join(lost, keys).groupBy(*keys, "_pick", "_at", "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_below", F.lit(0).cast("bigint"))
        held = staged(held.join(lost.drop("_at"), [*keys, "_pick"], "left_anti").unionByName(whole), "whole-keys")
        told = _sizes(held, keys).agg(F.max("_distinct")).first()
    widest = told[0] or 0
    while widest > most:
        held = staged(_narrowed(held, keys), "narrowed")
        before, widest = widest, _sizes(held, keys).agg(F.max("_distinct")).first()[0] or 0
        if widest >= before:  # whole numbers beyond what a double tells apart
            break
    upward = Window.partitionBy(*keys, "_pick").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = held.where("_v IS NOT NULL").withColumn("_end", F.col("_below") + F.sum("_n").over(upward))
    found = ranked.where((F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_n")))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_pick") == i, F.col("_v"))).alias(n) for i, n in enumerate(names)])


def _near_index(rows: DataFrame, keys: list[str], picks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys, _pick, _at, _below, _v, _n): counts of the values near each wanted index. ``_below`` counts what lies under them all."""
    wide = F.col("_v").cast("double")
    finite = F.when(F.abs(wide) < float("inf"), wide)
    facts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_all"), F.count(finite).alias("_finite"), F.kll_sketch_agg_double(finite, SKETCH_SIZE).alias("_sketch")
    )

    def bound(at: Column, step: int) -> Column:
        """The hundredth of the values ``step`` before or after the wanted one, null beyond the ends."""
        mark = F.floor((at + 0.5) * 100 / F.col("_all")).cast("int") + step
        return F.when((F.col("_finite") > 0) & mark.between(1, 99), F.get("_cuts", mark - 1))

    ranges = facts.withColumn("_cuts", F.when(F.col("_finite") > 0, F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(i / 100) for i in range(1, 100)])))).drop("_sketch")
    for i, index in enumerate(picks.values()):
        at = index(F.col("_all")).cast("bigint")
        ranges = ranges.withColumn(f"_at{i}", F.when((at >= 0) & (at < F.col("_all")), at))
        ranges = ranges.withColumn(f"_lo{i}", bound(F.col(f"_at{i}"), -1)).withColumn(f"_hi{i}", bound(F.col(f"_at{i}"), 2))
    n = range(len(picks))
    at = F.array(*[F.col(f"_at{i}") for i in n])
    marked = rows.join(ranges.drop("_all", "_finite", "_cuts"), keys)
    # A row is under, in or over the range of each pick; outside all ranges its value doesn't matter.
    place = [F.when(F.col(f"_at{i}").isNull() | (F.col("_v") > F.col(f"_hi{i}")), 1).when(F.col("_v") < F.col(f"_lo{i}"), -1).otherwise(0) for i in n]
    placed = marked.select(*keys, at.alias("_ats"), F.array(*place).alias("_place"), "_v")
    counted = placed.groupBy(*keys, "_ats", "_place", F.when(F.array_contains("_place", 0), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    each = counted.withColumn("_pick", F.explode(F.array(*[F.lit(i) for i in n]))).withColumn("_side", F.get("_place", F.col("_pick")))
    inside = F.col("_side") == 0
    spread = each.where("_side <= 0").groupBy(*keys, "_pick", F.get("_ats", F.col("_pick")).alias("_at"), F.when(inside, F.col("_v")).alias("_v")).agg(F.sum("_n").alias("_n"))
    below = spread.where("_v IS NULL").select(*keys, "_pick", F.col("_n").alias("_below"))
    return spread.where("_v IS NOT NULL").join(below, [*keys, "_pick"], "left").select(*keys, "_pick", "_at", F.coalesce("_below", F.lit(0)).alias("_below"), "_v", "_n")


def _sizes(held: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values of each range, and whether the wanted index lies in it."""
    sums = held.groupBy(*keys, "_pick", "_at").agg(F.count("_v").alias("_distinct"), F.min("_below").alias("_below"), F.sum("_n").alias("_in"))
    return sums.withColumn("_sure", (F.col("_at") >= F.col("_below")) & (F.col("_at") < F.col("_below") + F.col("_in")))


def _narrowed(held: DataFrame, keys: list[str]) -> DataFrame:
    """The part of each range, between two splitters of its distinct values, that holds the wanted index."""
    group = [*keys, "_pick"]
    wide = F.col("_v").cast("double")
    sketch = F.kll_sketch_agg_double(F.when(F.abs(wide) < float("inf"), wide), SKETCH_SIZE)
    ranks = F.array(*[F.lit((i + 1) / (SPLITTERS + 1)) for i in range(SPLITTERS)])
    some = F.count(F.when(F.abs(wide) < float("inf"), 1))
    cuts = held.groupBy(*group).agg(sketch.alias("_sketch"), some.alias("_some")).select(*group, F.when(F.col("_some") > 0, F.kll_sketch_get_quantile_double("_sketch", ranks)).otherwise(F.array().cast("array<double>")).alias("_cuts"))
    binned = held.join(cuts, group).withColumn("_bin", F.size(F.filter("_cuts", lambda c: c <= wide))).drop("_cuts")
    upward = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = binned.groupBy(*group, "_at", "_below", "_bin").agg(F.sum("_n").alias("_in")).withColumn("_end", F.col("_below") + F.sum("_in").over(upward))
    chosen = bins.where((F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_in"))).select(*group, "_bin", (F.col("_end") - F.col("_in")).alias("_base"))
    return binned.join(chosen, [*group, "_bin"]).select(*group, "_at", F.col("_base").alias("_below"), "_v", "_n")
