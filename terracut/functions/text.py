"""Text rules of plan sheets as column expressions: elevations, scales, symbols, anchors, legend rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terracut.params import DEFAULTS, Params

# Patterns and word lists of plan sheets.
DECIMAL_ELEVATION = r"(?i)^(?:EL(?:EV)?\.?\s*)?([+-]?\d{3,4}\.\d{1,3})$"
WHOLE_ELEVATION = r"(?i)^(?:EL(?:EV)?\.?\s*)?([+-]?\d{3,4})$"
ELEVATION_CONTEXT = r"(?i)\b(TC|ME|EL|ELEV|ELEVATION|TOP\s*OF\s*CURB|SPOT|GRADE|FF|FFE)\b"
MATCH_EXISTING = r"(?i)\bME\b"
# The only words of ELEVATION_CONTEXT that may stand in several texts: how a text ends that begins them, and begins that ends them.
CURB_BEGINS = r"(?i)\bTOP\s*(?:OF\s*)?$"
CURB_ENDS = r"(?i)^\s*(?:OF\s*)?CURB\b"
NAMED_SCALE = r"""(?i)scale\s*[:\-]?\s*1\s*["”]?\s*=\s*(\d+(?:\.\d+)?)\s*(?:'|’|ft|feet)"""
BARE_SCALE = r"""(?i)1\s*["”]\s*=\s*(\d+(?:\.\d+)?)\s*(?:'|’|ft|feet)"""
SCALE_HINT = r"""(?i)scale|1\s*["”]\s*="""
LEGEND_HEADER = r"(?i)map\s*legend|^legend$|general notes|keynotes"
BARE_NUMBER = r"^[\d.\-]+$"
DATE = r"^\d{1,2}/\d{1,2}/\d{2,4}$"
CAPITALS = r"^[A-Z0-9][A-Z0-9\s\-/&().%]{2,60}$"
ROOM_NUMBER = r"^\d{3}$"
STATION = r"\d\+\d{2}"


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def elevation(text: Column, context: Column, role: Column, params: Params = DEFAULTS) -> Column:
    """struct(value_ft, kind, confidence) of an elevation callout, or null.

    A decimal number counts on every sheet; out of range it is nothing, and is not read as a whole number. A whole number
    counts on existing sheets, and elsewhere as weak if a word nearby or in the text speaks of elevations. Null context
    is no context.
    """
    context = F.coalesce(context, F.lit(""))
    return elevation_beside(text, context.rlike(ELEVATION_CONTEXT), context.rlike(MATCH_EXISTING), role, params)


def elevation_beside(text: Column, near_speaks: Column, near_match: Column, role: Column, params: Params = DEFAULTS) -> Column:
    """elevation() where it is known whether the context speaks of elevations, and of matching existing ones."""
    clean = F.regexp_replace(stripped(text), ",", "")
    speaks = near_speaks | clean.rlike(ELEVATION_CONTEXT)
    number = lambda pattern: F.regexp_extract(clean, pattern, 1).try_cast("double")
    fits = lambda v: v.between(params.min_elev, params.max_elev)
    made = lambda v, kind, sure: F.struct(v.alias("value_ft"), kind.alias("kind"), sure.cast("double").alias("confidence"))
    existing = role == "existing"
    decimal, whole = number(DECIMAL_ELEVATION), number(WHOLE_ELEVATION)
    return (
        F.when(clean.rlike(DECIMAL_ELEVATION), F.when(fits(decimal), made(decimal, F.when(existing | near_match, "existing_match").otherwise("spot"), F.when(speaks, 0.95).otherwise(0.8))))
        .when(clean.rlike(WHOLE_ELEVATION) & fits(whole) & existing, made(whole, F.lit("existing_match"), F.when(speaks, 0.7).otherwise(0.6)))
        .when(clean.rlike(WHOLE_ELEVATION) & fits(whole) & speaks, made(whole, F.lit("weak"), F.lit(0.55)))
    )


def scale(text: Column, params: Params = DEFAULTS) -> Column:
    """struct(ft_per_inch, confidence) of a scale note, or null. An impossible named scale gives way to a bare one."""
    lo, hi = params.scale_range

    def read(pattern: str) -> Column:
        v = F.regexp_extract(text, pattern, 1).try_cast("double")
        return F.when(v.between(lo, hi), v)

    sure = F.when(F.contains(F.lower(text), F.lit("scale")), 0.95).otherwise(0.85)
    found = F.coalesce(read(NAMED_SCALE), read(BARE_SCALE))
    return F.when(found.isNotNull(), F.struct(found.alias("ft_per_inch"), sure.cast("double").alias("confidence")))


def may_hold_scale(text: Column) -> Column:
    return text.rlike(SCALE_HINT)


# Words of a legend name (all must occur) and the symbol they stand for, first match first.
SYMBOL_HINTS = [
    (["EXISTING CONTOUR"], "dashed contour line"),
    (["PROPOSED CONTOUR"], "solid contour line"),
    (["PROPERTY"], "long-dash / dash-dot line"),
    (["BUILDING LINE"], "building outline line"),
    (["TOP OF CURB"], "spot elevation callout (TC)"),
    (["(TC)"], "spot elevation callout (TC)"),
    (["MATCH EXISTING"], "match-existing marker (ME)"),
    (["(ME)"], "match-existing marker (ME)"),
    (["CURB CUT"], "triangle / taper symbol"),
    (["SIDEWALK"], "stipple / hatch pattern"),
    (["HEAVY", "CONCRETE"], "dense hatch pattern"),
    (["BUILDING"], "diagonal hatch / footprint"),
]
OTHER_SYMBOL = "see legend graphic"

# Labels that a map legend is known to hold, and words that begin title-block rows.
KNOWN_LABELS = ["BUILDING LINE", "PROPERTY LINE", "EXISTING CONTOUR", "PROPOSED CONTOUR", "TOP OF CURB", "MATCH EXISTING", "CURB CUT", "PROPOSED BUILDING", "CONCRETE SIDEWALK", "HEAVY-DUTY CONCRETE", "HEAVY DUTY CONCRETE", "SILT FENCE", "LIMIT OF DISTURBANCE"]
TITLE_BLOCK_WORDS = ["DATE", "PROJECT", "DESIGNED", "DRAWN", "SCALE", "AS NOTED", "NTS", "CONSTRUCTION DOCUMENTS", "REVISION", "SHEET", "PDC"]


def holds_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out |= F.contains(text, F.lit(w))
    return out


def symbol_hint(name_upper: Column) -> Column:
    out = F.lit(OTHER_SYMBOL)
    for words, hint in reversed(SYMBOL_HINTS):
        hit = F.lit(True)
        for w in words:
            hit &= F.contains(name_upper, F.lit(w))
        out = F.when(hit, hint).otherwise(out)
    return out


def legend_name(text: Column) -> Column:
    """A legend row's text with single spaces, without colons, dashes and spaces at its ends."""
    return F.regexp_replace(F.regexp_replace(stripped(F.regexp_replace(text, r"\s+", " ")), r"^[ :\-]+", ""), r"[ :\-]+$", "")


def is_legend_row(name: Column) -> Column:
    """Whether a cleaned name reads like a legend entry: known, or in capitals, and no header, number, date or title block."""
    upper = F.upper(name)
    known = holds_any(upper, KNOWN_LABELS)
    title = upper.rlike("^(" + "|".join(TITLE_BLOCK_WORDS) + ")( |$)")
    other = name.rlike(LEGEND_HEADER) | name.rlike(BARE_NUMBER) | title | name.rlike(DATE)
    return (F.length(name) >= 3) & (F.length(name) <= 80) & ~other & (known | name.rlike(CAPITALS))


# Texts that anchor a building or the site's edge, first match first.
EDGE_WORDS = ["SIDEWALK", "CURB", "LANDSCAPE BUFFER"]
ROOM_WORDS = ["CLASSROOM", "LOBBY", "OFFICE", "TEACHER", "TOILET", "MECHANICAL", "JANITOR", "CORRIDOR"]


def anchor_tag(text: Column) -> Column:
    """room, bl, edge, sta or room_label; null for all other texts."""
    t = stripped(text)
    u = F.upper(t)
    return F.when(t.rlike(ROOM_NUMBER), "room").when(F.contains(u, F.lit("BUILDING LINE")), "bl").when(holds_any(u, EDGE_WORDS), "edge").when(t.rlike(STATION), "sta").when(holds_any(u, ROOM_WORDS), "room_label")
