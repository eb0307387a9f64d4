"""Finding the active picture area."""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import (
    EDGE_TOLERANCE,
    GRID_STEP,
    MIN_LINE_SHARE,
    area,
    bottom,
    rect,
    rect_matches,
    rect_union,
    right,
)
from ..functions.transfer import is_non_black
from ..session import staged
from .samples import FRAME, first_usable_after, probe_ticks, usable_frames, usable_share

BLOCK = 4  # cells along each edge that are compared in one place


def _even_span(low: Column, high: Column, size: Column) -> tuple[Column, Column]:
    """Even start and length of [low, high], kept inside ``size``."""
    start = low - low % 2
    length = F.greatest(high - start + 1, F.lit(2))
    length = F.when(length <= 2, F.lit(2)).otherwise(length - length % 2)
    fits = start + length <= size
    moved = F.when(fits, start).when(size >= length, size - length).otherwise(F.lit(0))
    kept = F.when(fits | (size >= length), length).otherwise(size - size % 2)
    return moved, kept


def detect_crop(samples: DataFrame, clips: DataFrame) -> DataFrame:
    """Rectangle of the rows and columns with enough non-black samples, per frame.

    Rows are counted on every tenth column and columns on every tenth row, in one
    pass: grouping sets leave one row per line of a frame.
    """
    on_x = F.col("x") % GRID_STEP == 0
    on_y = F.col("y") % GRID_STEP == 0
    lit_samples = samples.where((on_x | on_y) & is_non_black("y_code")).select(
        *FRAME, "x", "y", on_x.cast("int").alias("_on_x"), on_y.cast("int").alias("_on_y")
    )
    lines = lit_samples.groupingSets([[*FRAME, "y"], [*FRAME, "x"]], *FRAME, "x", "y").agg(
        F.sum("_on_x").alias("_row_hits"), F.sum("_on_y").alias("_col_hits")
    )

    def need(size: Column) -> Column:
        return F.ceil(F.greatest(F.ceil(size / GRID_STEP), F.lit(1)) * MIN_LINE_SHARE)

    facts = lines.join(clips.select("clip_id", "width", "height"), "clip_id")
    row_ok = F.col("y").isNotNull() & (F.col("_row_hits") >= need(F.col("width")))
    col_ok = F.col("x").isNotNull() & (F.col("_col_hits") >= need(F.col("height")))
    edges = facts.groupBy(*FRAME).agg(
        F.max("width").alias("width"),
        F.max("height").alias("height"),
        F.min(F.when(row_ok, F.col("y"))).alias("top"),
        F.max(F.when(row_ok, F.col("y"))).alias("bottom"),
        F.min(F.when(col_ok, F.col("x"))).alias("left"),
        F.max(F.when(col_ok, F.col("x"))).alias("right"),
    )
    # Frames without one non-black sample keep the full rectangle.
    all_frames = samples.select(*FRAME).distinct().join(clips.select("clip_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "clip_id")
    known = all_frames.join(edges.drop("width", "height"), FRAME, "left").select(
        *FRAME,
        F.col("_w").alias("width"),
        F.col("_h").alias("height"),
        F.coalesce("top", F.lit(0)).alias("top"),
        F.coalesce("bottom", F.col("_h") - 1).alias("bottom"),
        F.coalesce("left", F.lit(0)).alias("left"),
        F.coalesce("right", F.col("_w") - 1).alias("right"),
    )
    x, w = _even_span(F.col("left"), F.col("right"), F.col("width"))
    y, h = _even_span(F.col("top"), F.col("bottom"), F.col("height"))
    degenerate = (F.col("right") <= F.col("left")) | (F.col("bottom") <= F.col("top"))
    full = rect(F.lit(0), F.lit(0), F.col("width"), F.col("height"))
    return known.select(*FRAME, F.when(degenerate, full).otherwise(rect(x, y, w, h)).alias("rect"))


def vote_crop(candidates: DataFrame, tolerance: int = EDGE_TOLERANCE, rounds: int = 4) -> DataFrame:
    """One committed rectangle per clip from candidate rectangles (columns clip_id, ord, rect).

    Equal rectangles are counted first, so a clip contributes its distinct
    rectangles only, however many probes agree. Clusters are the connected
    components of "edges within tolerance", found over whole cells of near rectangles.
    """
    distinct = candidates.groupBy("clip_id", "rect").agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("label")
    )
    labels = cluster_labels(distinct, tolerance, rounds)
    clusters = labels.groupBy("clip_id", "label").agg(
        F.sum("n").alias("size"), rect_union(F.col("rect")).alias("rect")
    )
    rank = F.struct(F.col("size"), area(F.col("rect")), -F.col("label"))
    return clusters.groupBy("clip_id").agg(
        rect_union(F.col("rect")).alias("rect"),
        F.sum("size").cast("int").alias("candidate_count"),
        F.max_by("size", rank).cast("int").alias("modal_count"),
        F.count(F.lit(1)).cast("int").alias("cluster_count"),
        (F.count(F.lit(1)) > 1).alias("variable_ar"),
    )


def crop_cells(distinct: DataFrame, tolerance: int) -> tuple[DataFrame, DataFrame]:
    """Cells of the grid of edges (left, top, right, bottom), and the pairs of cells with a match across.

    A cell spans ``tolerance + 1`` steps of each edge, so all rectangles in it match each other and the cell is one node,
    named by its least label. Matches across lie between a cell and the 80 around it. Cells are dealt by blocks of
    ``BLOCK`` cells along each edge; a cell on the lower side of a block is in the block before as well (about 2.4 copies where cells lie evenly, at most 16), and a
    pair is looked at in the block of its lower corner only. A cell holds at most ``(tolerance + 1) ** 4`` places and a block ``(BLOCK + 1) ** 4`` cells however
    many rectangles a clip has, so rows grow with the rectangles and not with their pairs.
    """
    side = tolerance + 1
    r = F.col("rect")
    ends = (r["x"], r["y"], right(r), bottom(r))
    cell = [F.floor(e / side).cast("bigint").alias(f"_c{k}") for k, e in enumerate(ends)]
    place = F.struct(*[F.pmod(e, F.lit(side)).alias(f"p{k}") for k, e in enumerate(ends)])
    axes, block = [f"_c{k}" for k in range(4)], [f"_b{k}" for k in range(4)]
    placed = distinct.select("*", *cell)
    cells = staged(placed.groupBy("clip_id", *axes).agg(F.min("label").alias("node"), F.collect_set(place).alias("places")), "crop-cells")

    def block_of(c: Column) -> Column:
        return F.floor(c / BLOCK).cast("bigint")

    lower = [F.pmod(F.col(c), F.lit(BLOCK)) == 0 for c in axes]
    back = [F.when(reduce(and_, [lower[k] for k in range(4) if d[k]], F.lit(True)), F.array(*[F.lit(v) for v in d])) for d in product((0, 1), repeat=4)]
    dealt = cells.withColumn("_d", F.explode(F.array_compact(F.array(*back)))).select(
        "clip_id", *[(block_of(F.col(c)) - F.get("_d", k)).alias(b) for k, (c, b) in enumerate(zip(axes, block))],
        F.struct(F.struct(*axes).alias("at"), "node", "places").alias("cell"),
    )
    blocks = dealt.groupBy("clip_id", *block).agg(F.collect_list("cell").alias("cells")).where(F.size("cells") > 1)

    def match(p: Column, q: Column, i: Column, j: Column) -> Column:
        return reduce(and_, [F.abs(q["at"][c] * side + j[f"p{k}"] - p["at"][c] * side - i[f"p{k}"]) <= tolerance for k, c in enumerate(axes)])

    def touches(p: Column, q: Column) -> Column:
        near = reduce(and_, [F.abs(q["at"][c] - p["at"][c]) <= 1 for c in axes])
        here = reduce(and_, [block_of(F.least(p["at"][c], q["at"][c])) == F.col(b) for c, b in zip(axes, block)])
        return (p["at"] < q["at"]) & near & here & F.exists(p["places"], lambda i: F.exists(q["places"], lambda j: match(p, q, i, j)))

    pairs = F.flatten(F.transform("cells", lambda p: F.transform(F.filter("cells", lambda q: touches(p, q)), lambda q: F.struct(p["node"].alias("node"), q["node"].alias("other")))))
    found = blocks.select("clip_id", F.explode(pairs).alias("_p")).select("clip_id", "_p.node", "_p.other")
    both = F.explode(F.array(F.struct("node", "other"), F.struct(F.col("other").alias("node"), F.col("node").alias("other"))))
    return placed.join(cells.drop("places"), ["clip_id", *axes]).drop(*axes), found.select("clip_id", both.alias("_p")).select("clip_id", "_p.node", "_p.other")


def cluster_labels(distinct: DataFrame, tolerance: int, rounds: int) -> DataFrame:
    """Smallest label reachable over matching rectangles.

    Labels are spread over the cells ``rounds`` times per pass with pointer jumping until a
    pass changes nothing; the driver sees whether a row changed. Cells without a match across keep their own.
    """
    members, pairs = crop_cells(distinct, tolerance)
    edges = staged(pairs, "crop-edges")
    nodes = edges.select("clip_id", "node").distinct()
    current = staged(nodes.withColumn("label", F.col("node")), "crop-labels")
    while True:
        spread = current
        for _ in range(rounds):
            near = edges.join(spread.select("clip_id", F.col("node").alias("other"), "label"), ["clip_id", "other"]).select("clip_id", "node", "label")
            lowest = near.union(spread.select("clip_id", "node", "label")).groupBy("clip_id", "node").agg(F.min("label").alias("label"))
            # A label is itself a node, so jumping to its label halves the distance.
            jump = lowest.select("clip_id", F.col("node").alias("label"), F.col("label").alias("next"))
            spread = lowest.join(jump, ["clip_id", "label"], "left").select(
                "clip_id", "node", F.least("label", F.coalesce("next", "label")).alias("label")
            )
        spread = staged(spread, "crop-labels")
        before = current.select("clip_id", "node", F.col("label").alias("old"))
        changed = spread.join(before, ["clip_id", "node"]).where(F.col("old") != F.col("label"))
        if changed.isEmpty():
            return members.drop("label").join(spread, ["clip_id", "node"], "left").withColumn("label", F.coalesce("label", "node")).drop("node")
        current = spread


def probed_crop(samples: DataFrame, clips: DataFrame, frames: DataFrame, n: int = 7) -> DataFrame:
    """Crop per clip from ``n`` probe positions.

    ``frames`` has ``pts``; ``clips`` has start_tick, duration, width and height. Only the
    samples of the probed frames reach the detector.
    """
    share = usable_share(samples).withColumn("usable", F.col("share") >= 0.05).select(*FRAME, "usable")
    timed = frames.select(*FRAME, "pts").join(share, FRAME, "left").withColumn(
        "usable", F.coalesce("usable", F.lit(False))
    )
    hits = first_usable_after(probe_ticks(clips, n), timed)
    probed = samples.join(hits.select(*FRAME).distinct(), FRAME, "left_semi")
    candidates = detect_crop(probed, clips).join(hits, FRAME).select("clip_id", F.col("probe").alias("ord"), "rect")
    return vote_crop(candidates)


def fallback_crop(samples: DataFrame, clips: DataFrame) -> DataFrame:
    """First usable frame of a clip commits its rectangle; earlier frames use the full frame."""
    first = usable_frames(samples).groupBy("clip_id").agg(F.min("frame_idx").alias("frame_idx"))
    found = detect_crop(samples.join(first, FRAME, "left_semi"), clips).select(
        "clip_id", F.col("frame_idx").alias("from_frame"), "rect"
    )
    full = rect(F.lit(0), F.lit(0), F.col("width"), F.col("height"))
    return (
        clips.join(found, "clip_id", "left")
        .select("clip_id", "from_frame", F.coalesce("rect", full).alias("rect"), full.alias("full_rect"))
    )


def rect_for_frame(frames: DataFrame, fallback: DataFrame) -> DataFrame:
    early = F.col("from_frame").isNull() | (F.col("frame_idx") < F.col("from_frame"))
    return frames.join(fallback, "clip_id").withColumn(
        "rect", F.when(early, F.col("full_rect")).otherwise(F.col("rect"))
    ).drop("full_rect", "from_frame")


def crop_stability(cuts: DataFrame, candidates: DataFrame, crops: DataFrame, clips: DataFrame) -> DataFrame:
    """How well the committed crop held at the scene cuts, per clip.

    ``candidates`` has the detected rectangle of frames that carry enough signal;
    cuts without one count as skipped.
    """
    full = rect(F.lit(0), F.lit(0), F.col("width"), F.col("height"))
    seen = (
        cuts.select(*FRAME)
        .join(candidates.select(*FRAME, F.col("rect").alias("found")), FRAME, "left")
        .join(crops.select("clip_id", "rect"), "clip_id")
        .join(clips.select("clip_id", "width", "height"), "clip_id")
    )
    checked = F.col("found").isNotNull()
    matches = checked & rect_matches(F.col("found"), F.col("rect"))
    is_full = checked & ~matches & rect_matches(F.col("found"), full)

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    report = seen.groupBy("clip_id").agg(
        count(checked).alias("checked"),
        count(matches).alias("matching"),
        count(is_full).alias("full_frame"),
        count(~checked).alias("skipped"),
    )
    return report.withColumn("other", F.col("checked") - F.col("matching") - F.col("full_frame")).withColumn(
        "stability_pct", F.when(F.col("checked") > 0, F.col("matching") * 100.0 / F.col("checked"))
    )
