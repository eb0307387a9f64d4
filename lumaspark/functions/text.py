"""Metadata text and numbers: classification, parsing, repair (expressions only)."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

from .transfer import col, nits_to_pq_code

# Fixed defaults of static metadata in nits.
STATIC_DEFAULTS = {"max_dml": 1000.0, "min_dml": 0.005, "max_cll": 1000.0, "max_fall": 400.0}
# Fixed default chromaticity codes of a mastering display.
PRIMARY_DEFAULTS = {
    "md_gx": 8500, "md_gy": 39850, "md_bx": 6550, "md_by": 2300,
    "md_rx": 35400, "md_ry": 14600, "md_wpx": 15635, "md_wpy": 16450,
}
NEUTRAL_TRIM = 2048
MILLISECONDS_FROM = 86400.0
HDR10PLUS_SOURCES = ("histogram", "histogram99", "max-scl", "max-scl-luminance")


def contains_any(text: Column, *needles: str) -> Column:
    found = text.contains(needles[0])
    for needle in needles[1:]:
        found = found | text.contains(needle)
    return found


def classify_hints(hints, has_measurements) -> Column:
    """Format name from hint text; null if nothing is recognised."""
    text = F.upper(col(hints))
    measured = col(has_measurements)
    return (
        F.when(contains_any(text, "SMPTE ST 2094 APP 4", "HDR10+"), "hdr10plus")
        .when(contains_any(text, "HLG", "ARIB"), "hlg")
        .when(
            contains_any(text, "HDR10", "PQ", "ST 2084", "SMPTE2084"),
            F.when(measured, "hdr10_with_measurements").otherwise("hdr10_unsupported"),
        )
    )


def layer_kind(profile, el_type) -> Column:
    return (
        F.when((col(profile) == 7) & (col(el_type) == "MEL"), "profile7_mel")
        .when(col(profile) == 7, "profile7_fel")
        .when(col(profile) == 8, "profile8")
        .otherwise("other")
    )


def format_of_layer(kind) -> Column:
    value = col(kind)
    return (
        F.when(value == "profile7_mel", "dolby_vision_mel")
        .when(value == "profile7_fel", "dolby_vision_fel")
        .when(value == "profile8", "dolby_vision_p8")
        .when(value.isNotNull(), "unsupported")
    )


def primary_label_index(label) -> Column:
    text = F.upper(col(label))
    return (
        F.when(contains_any(text, "P3", "DCI"), 0).when(text.contains("709"), 1).when(text.contains("2020"), 2)
    )


def primaries_index(mastering, container, default: int | None = 2) -> Column:
    """Mastering display before container; 0 = P3, 1 = BT.709, 2 = BT.2020."""
    found = F.coalesce(primary_label_index(mastering), primary_label_index(container))
    return found if default is None else F.coalesce(found, F.lit(default))


def extract_number(text, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern`` as a number; null without a match or a valid number."""
    return F.regexp_extract(col(text), pattern, group).try_cast("double")


def parse_primaries(text) -> Column:
    """Eight chromaticity codes from ``G(x=0.17, y=0.797)`` or ``G(0.17,0.797)`` text.

    All or nothing: one missing point makes the whole value null.
    """
    number = r"([0-9]*\.?[0-9]+)"
    fields = []
    for label, name in (("G", "g"), ("B", "b"), ("R", "r"), ("WP", "wp")):
        pattern = label + r"\(\s*(?:x=)?" + number + r"\s*,\s*(?:y=)?" + number + r"\s*\)"
        for group, axis in ((1, "x"), (2, "y")):
            value = F.round(extract_number(text, pattern, group) * 50000.0)
            fields.append(F.least(F.greatest(value, F.lit(0.0)), F.lit(50000.0)).cast("int").alias(f"md_{name}{axis}"))
    whole = F.struct(*fields)
    missing = F.lit(False)
    for label in ("G", "B", "R", "WP"):
        pattern = label + r"\(\s*(?:x=)?" + number + r"\s*,\s*(?:y=)?" + number + r"\s*\)"
        missing = missing | (F.regexp_extract(col(text), pattern, 0) == "")
    return F.when(~F.coalesce(missing, F.lit(True)), whole)


def number_after(text, label: str) -> Column:
    """Number that follows the first occurrence of ``label`` (blanks between are skipped)."""
    value = col(text)
    at = F.instr(value, label)
    after = F.trim(F.regexp_replace(F.substring(value, at + len(label), F.length(value)), r"^\s+|\s+$", ""))
    digits = F.regexp_extract(after, r"^([0-9.]*)", 1)
    return F.when(at > 0, digits.try_cast("double"))


def frame_rate(text) -> Column:
    """``STRUCT<num, den>`` of ``num/den`` text; 24000/1001 where missing or unreadable."""
    value = F.coalesce(col(text), F.lit("24000/1001"))
    parts = F.split(value, "/")
    whole = lambda i: F.when(F.get(parts, i).rlike(r"^\+?[0-9]+$"), F.get(parts, i).try_cast("bigint"))
    den = F.when(F.size(parts) > 1, F.coalesce(whole(1), F.lit(1001))).otherwise(F.lit(1))
    return F.struct(
        F.coalesce(whole(0), F.lit(24000)).cast("int").alias("num"), den.cast("int").alias("den")
    )


def duration_seconds(value) -> Column:
    """Number or numeric text; values beyond a day are milliseconds."""
    number = col(value).try_cast("double")
    return F.when(number > MILLISECONDS_FROM, number / 1000.0).otherwise(number)


def frame_count_estimate(nb_frames, duration_ticks, time_base, fps, container_us) -> Column:
    """Stream count, else stream duration, else container duration; truncated."""
    rate = F.when(col(fps) > 0, col(fps))
    by_stream = (col(duration_ticks) * col(time_base) * rate).cast("int")
    by_container = F.when(col(container_us) > 0, (col(container_us) / 1000000.0 * rate).cast("int"))
    return (
        F.when(col(nb_frames) > 0, col(nb_frames).cast("int"))
        .when(F.coalesce(col(duration_ticks) > 0, F.lit(False)), by_stream)
        .otherwise(by_container)
    )


def hdr10plus_peak_nits(scene: Column, source: str) -> Column:
    """Peak of one scene's luminance parameters in nits."""
    luminance = scene["LuminanceParameters"]
    values = luminance["LuminanceDistributions"]["DistributionValues"]
    scl = luminance["MaxScl"]
    if source == "histogram":
        tenths = F.array_max(values).cast("double")
    elif source == "histogram99":
        tenths = F.when(F.size(values) > 0, F.element_at(values, -1)).cast("double")
    elif source == "max-scl":
        tenths = F.array_max(scl).cast("double")
    elif source == "max-scl-luminance":
        weighted = F.lit(0.2627) * F.get(scl, 0) + F.lit(0.678) * F.get(scl, 1) + F.lit(0.0593) * F.get(scl, 2)
        tenths = F.when(F.size(scl) == 3, weighted)
    else:
        raise ValueError(f"unknown peak source {source!r}")
    return tenths / 10.0


def warning_text(reasons) -> Column:
    return F.when(F.size(col(reasons)) > 0, F.array_join(col(reasons), ", "))


def l6_block(max_dml, min_dml, max_cll, max_fall) -> Column:
    return F.struct(
        col(max_dml).cast("int").alias("max_display_mastering_luminance"),
        (col(min_dml) * 10000.0).cast("int").alias("min_display_mastering_luminance"),
        col(max_cll).cast("int").alias("max_content_light_level"),
        col(max_fall).cast("int").alias("max_frame_average_light_level"),
    )


def trim_targets(text) -> Column:
    """Whole numbers of a comma list; anything else is dropped."""
    parts = F.transform(F.split(col(text), ","), lambda part: F.trim(part))
    valid = F.filter(parts, lambda part: part.rlike(r"^\+?[0-9]+$"))
    return F.filter(F.transform(valid, lambda part: part.try_cast("int")), lambda n: n.isNotNull())


def trim_blocks(targets: Column) -> Column:
    """One neutral trim block per target."""
    names = ("trim_slope", "trim_offset", "trim_power", "trim_chroma_weight", "trim_saturation_gain", "ms_weight")
    return F.transform(
        targets,
        lambda nits: F.struct(
            nits_to_pq_code(nits).alias("target_max_pq"), *[F.lit(NEUTRAL_TRIM).alias(n) for n in names]
        ),
    )


def l9_block(primary) -> Column:
    return F.struct(F.lit(1).alias("length"), col(primary).cast("int").alias("source_primary_index"))


def l11_block(content_type: int = 1, reference_mode: bool = False) -> Column:
    return F.struct(
        F.lit(content_type).alias("content_type"),
        F.lit(0).alias("whitepoint"),
        F.lit(reference_mode).alias("reference_mode_flag"),
    )


def l5_block(offsets: Column) -> Column:
    return F.struct(*[offsets[s].cast("int").alias(f"active_area_{s}_offset") for s in ("left", "right", "top", "bottom")])


def mastering_display_text() -> Column:
    """``G(x,y)B(x,y)R(x,y)WP(x,y)L(max,min)`` from the static metadata columns."""
    md = {k: F.coalesce(F.col(k), F.lit(v)).cast("int") for k, v in PRIMARY_DEFAULTS.items()}
    dml = F.coalesce(F.col("max_dml"), F.lit(STATIC_DEFAULTS["max_dml"])).cast("int") * 10000
    low = (F.coalesce(F.col("min_dml"), F.lit(STATIC_DEFAULTS["min_dml"])) * 10000.0).cast("int")
    return F.format_string(
        "G(%d,%d)B(%d,%d)R(%d,%d)WP(%d,%d)L(%d,%d)",
        md["md_gx"], md["md_gy"], md["md_bx"], md["md_by"], md["md_rx"], md["md_ry"], md["md_wpx"], md["md_wpy"],
        dml, low,
    )


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def natural_key(path) -> Column:
    """Text whose plain order is the digit-aware, case-blind order of ``path``.

    A run of digits becomes: a marker that sorts as the digit it starts with would not
    be stable, so the marker is ``0``; then the run's significant length in four digits,
    the significant digits and the full length. Other characters are lower-cased.
    Paths are split with one regular expression and rebuilt with ``transform``.
    """
    lower = ascii_lower(col(path))
    pieces = F.regexp_extract_all(lower, F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def encode(piece: Column) -> Column:
        significant = F.regexp_replace(piece, r"^0+(?=.)", "")
        too_long = F.raise_error(F.concat(F.lit("a run of more than 9999 digits in "), lower)).cast("string")
        number = F.when(F.length(piece) > 9999, too_long).otherwise(F.concat(
            F.lit("0"),
            F.lpad(F.length(significant).cast("string"), 4, "0"),
            significant,
            F.lpad(F.length(piece).cast("string"), 4, "0"),
        ))
        return F.when(piece.rlike("^[0-9]"), number).otherwise(piece)

    return F.array_join(F.transform(pieces, encode), "")

