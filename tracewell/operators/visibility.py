"""Visibility from style facts given as columns: why an element is hidden or nearly so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds below which text is nearly invisible.
SMALL_FONT, FAINT, LOW_CONTRAST, TINY_BOX, INDENT, FAR = 4.0, 0.1, 1.2, 2.0, -999.0, -9999.0


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of an sRGB colour with channels 0 to 255."""
    part = lambda c: F.when(c / 255.0 <= 0.03928, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * part(r) + 0.7152 * part(g) + 0.0722 * part(b)


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def effective_opacity(ancestors: Column) -> Column:
    return F.aggregate(ancestors, F.lit(1.0), lambda a, x: a * x)


def _named(pairs) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]), lambda x: x.isNotNull())


def parse_colour(value: Column) -> Column:
    """Struct r, g, b, a of an rgb() or rgba() colour; null for anything else."""
    inside = F.regexp_extract(value, r"rgba?\(([^)]+)\)", 1)
    parts = F.transform(F.filter(F.split(inside, r"[,\s/]+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    good = (F.size(parts) >= 3) & ~F.exists(parts, lambda x: x.isNull())
    at = lambda k: F.get(parts, F.lit(k))
    return F.when(good, F.struct(at(0).alias("r"), at(1).alias("g"), at(2).alias("b"), F.coalesce(at(3), F.lit(1.0)).alias("a")))


def effective_background(ancestors: Column) -> Column:
    """The first colour of an element's and its ancestors' backgrounds (strings, innermost first) that isn't transparent; else white."""
    white = F.struct(*[F.lit(x).alias(n) for n, x in zip("rgba", (255.0, 255.0, 255.0, 1.0))])
    seen = F.filter(F.transform(ancestors, parse_colour), lambda c: c["a"] > 0)
    return F.coalesce(F.get(seen, F.lit(0)), white)


def style_facts(styles: DataFrame) -> DataFrame:
    """Adds opacity, alpha and contrast from columns opacities and backgrounds (arrays, innermost first) and color."""
    ink, paper = parse_colour(F.col("color")), effective_background(F.col("backgrounds"))
    light = lambda c: luminance(c["r"], c["g"], c["b"])
    return styles.withColumns({"opacity": effective_opacity(F.col("opacities")), "alpha": ink["a"], "contrast": F.when(ink.isNotNull(), contrast(light(ink), light(paper)))})


def _text(number: Column) -> Column:
    """A number with two decimals at most, without trailing zeros."""
    x = F.round(number, 2)
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


# The words of the reasons.
def hidden_reasons() -> Column:
    """Over columns display, visibility, opacity, font_size, alpha, clip, clip_path, width, height, x, y."""
    c = F.col
    empty, past = (c("width") == 0) | (c("height") == 0), (c("x") + c("width") <= 0) | (c("y") + c("height") <= 0)
    return F.array_compact(
        F.array(
            F.when(c("display") == "none", F.lit("display:none")),
            F.when(c("visibility").isin("hidden", "collapse"), F.concat(F.lit("visibility:"), c("visibility"))),
            F.when(c("opacity") == 0, F.lit("effective opacity:0")),
            F.when(c("font_size") == 0, F.lit("font-size:0")),
            F.when(c("alpha") == 0, F.lit("text alpha 0 (fully transparent)")),
            F.when(c("clip").rlike(r"rect\(\s*0(px)?[\s,]+0(px)?[\s,]+0(px)?[\s,]+0(px)?\s*\)"), F.concat(F.lit("clip:"), c("clip"))),
            F.when(c("clip_path").rlike(r"inset\(\s*(100%|50%)"), F.concat(F.lit("clip-path:"), c("clip_path"))),
            F.when(empty, F.lit("zero-size box")).when(past, F.lit("off-screen box")),
        )
    )


def near_invisible_reasons() -> Column:
    """Over the same columns with contrast, text_indent and overflow (of both directions)."""
    c = F.col
    whole = lambda x: F.round(x).cast("long").cast("string")
    empty, past = (c("width") == 0) | (c("height") == 0), (c("x") + c("width") <= 0) | (c("y") + c("height") <= 0)
    far = ~empty & ~past & ((c("x") <= FAR) | (c("y") <= FAR))
    return F.array_compact(
        F.array(
            F.when((c("opacity") > 0) & (c("opacity") < FAINT), F.concat(F.lit("effective opacity "), _text(c("opacity")))),
            F.when((c("font_size") > 0) & (c("font_size") < SMALL_FONT), F.concat(F.lit("font-size "), _text(c("font_size")), F.lit("px"))),
            F.when((c("alpha") > 0) & (c("alpha") < FAINT), F.concat(F.lit("text alpha "), _text(c("alpha")))),
            F.when(c("contrast") < LOW_CONTRAST, F.concat(F.lit("contrast ratio "), _text(c("contrast")))),
            F.when(c("text_indent") <= INDENT, F.concat(F.lit("text-indent "), _text(c("text_indent")), F.lit("px"))),
            F.when((c("overflow") == "hidden") & ((c("width") < TINY_BOX) | (c("height") < TINY_BOX)), F.concat(F.lit("box "), whole(c("width")), F.lit("x"), whole(c("height")), F.lit(" with overflow hidden"))),
            F.when(far, F.concat(F.lit("positioned off-screen at x="), whole(c("x")), F.lit(", y="), whole(c("y")))),
        )
    )


def visible() -> Column:
    return (F.size(hidden_reasons()) == 0) & (F.size(near_invisible_reasons()) == 0)
