"""Column builders for numerals, page ranges, names and other scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roman numerals in descending order.
ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def to_roman(number: Column) -> Column:
    """Lower-case numeral; empty for null and numbers below 1. Each digit is looked up, so the expression stays flat."""
    n = F.coalesce(number.cast("int"), F.lit(0))
    digit = lambda unit: F.floor(n / unit).cast("int") % 10
    table = lambda one, five, ten: F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)])
    pick = lambda array, k: F.get(array, k)
    text = F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), pick(table("c", "d", "m"), digit(100)), pick(table("x", "l", "c"), digit(10)), pick(table("i", "v", "x"), digit(1)))
    return F.when(n >= 1, text).otherwise("")


def from_roman(text: Column) -> Column:
    """Value of a numeral in any case, subtracting a letter below its right neighbour's maximum; null for other letters or zero."""
    low = F.lower(text)
    value = F.create_map(*[x for n, c in ROMAN if len(c) == 1 for x in (F.lit(c), F.lit(n))])
    letters = F.reverse(F.split(low, "(?!^)(?=.)"))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("high"))

    def step(state: Column, letter: Column) -> Column:
        v = F.coalesce(value[letter], F.lit(0))
        below = v < state["high"]
        return F.struct(F.when(below, state["total"] - v).otherwise(state["total"] + v).alias("total"), F.when(below, state["high"]).otherwise(v).alias("high"))

    total = F.aggregate(letters, start, step, lambda s: s["total"])
    return F.when(low.rlike("^[ivxlcdm]+$"), F.nullif(total, F.lit(0)))


def ranges(numbers: Column, show=lambda c: c.cast("string")) -> Column:
    """Array of compact ranges (``1-3``, ``5``) of an array of ints; nulls and repeats are dropped."""
    ordered = F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull())))
    # the i-th element of a run of consecutive numbers differs from i by a constant
    keyed = F.transform(ordered, lambda x, i: F.struct((x - i).alias("run"), x.alias("x")))
    runs = F.array_distinct(F.transform(keyed, lambda k: k["run"]))

    def text(run: Column) -> Column:
        own = F.filter(keyed, lambda k: k["run"] == run)
        low, high = own[0]["x"], F.element_at(own, -1)["x"]
        return F.when(low == high, show(low)).otherwise(F.concat(show(low), F.lit("-"), show(high)))

    return F.transform(runs, text)


def page_range(pages: Column, unnumbered: Column) -> Column:
    """``p. 5``, ``pp. 1-3, 5``, ``pp. 5, unnumbered``, ``unnumbered`` or empty."""
    pages = F.coalesce(pages, F.array().cast("array<int>"))
    odd = F.coalesce(unnumbered, F.lit(False))
    listed = F.array_join(ranges(pages), ", ")
    count = F.size(F.array_distinct(pages))
    tail = F.when(odd, F.lit(", unnumbered")).otherwise("")
    prefix = F.when((count == 1) & ~odd, "p. ").otherwise("pp. ")
    return F.when(count == 0, F.when(odd, "unnumbered").otherwise("")).otherwise(F.concat(prefix, listed, tail))


def structure_range(numbers: Column, kinds_roman: Column) -> Column:
    """Roman ranges (from ``kinds_roman``) first, then arabic ones; ``p.`` for a single page."""
    roman, arabic = ranges(kinds_roman, to_roman), ranges(numbers)
    count = F.size(F.array_distinct(kinds_roman)) + F.size(F.array_distinct(numbers))
    parts = F.array_join(F.concat(roman, arabic), ", ")
    return F.when(count == 0, "").when(count == 1, F.concat(F.lit("p. "), parts)).otherwise(F.concat(F.lit("pp. "), parts))


def natural_key(name: Column) -> Column:
    """Orderable array: digit runs led by their length without zeros, text lower-cased, so that ``p2`` precedes ``p10``."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    digits = lambda x: F.regexp_replace(x, "^0+", "")
    return F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(x)).cast("string"), 10, "0"), digits(x))).otherwise(x))


def sequence_number(stem: Column) -> Column:
    """Last ``_`` token if it is digits, else the last digit run, else 0."""
    last = F.element_at(F.split(stem, "_"), -1)
    runs = F.regexp_extract_all(stem, F.lit(r"(\d+)"), 1)
    return F.coalesce(F.when(last.rlike(r"^\d+$"), last.try_cast("int")), F.try_element_at(runs, F.lit(-1)).try_cast("int"), F.lit(0))


def short_name(name: Column, suffix: str = "", limit: int = 80) -> Column:
    """Stem cut to ``limit``, without trailing separators, a dash and eight digits of its SHA-256, then ``suffix``."""
    stem = F.regexp_replace(F.left(name, F.lit(limit - 9 - len(suffix))), r"[ ._-]+$", "")
    return F.concat(stem, F.lit("-"), F.left(F.sha2(name.cast("binary"), 256), F.lit(8)), F.lit(suffix))


def log_name(name: Column, log_type: str) -> Column:
    return short_name(name, f"_{log_type}_log.json")


def cut_at_word(text: Column, limit: int = 100) -> Column:
    """Text of at most ``limit`` characters, cut back to the last space if there is one, with an ellipsis."""
    head = F.left(text, F.lit(limit))
    back = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when(F.instr(head, " ") > 0, F.left(head, back)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("...")))


def scale_to_box(width: Column, height: Column, box_width: Column, box_height: Column) -> Column:
    return F.least(box_width / width, box_height / height)


def scale_to_side(width: Column, height: Column, side: Column) -> Column:
    """Never enlarges; null or non-positive ``side`` leaves the image as it is."""
    return F.when(F.coalesce(side, F.lit(0)) > 0, F.least(F.lit(1.0), side / F.greatest(width, height))).otherwise(1.0)


def scale_to_pixels(width: Column, height: Column, pixels: Column, side: Column) -> Column:
    """The stricter of a longest side and a pixel budget."""
    budget = F.when(F.coalesce(pixels, F.lit(0)) > 0, F.least(F.lit(1.0), F.sqrt(pixels / (width * height)))).otherwise(1.0)
    return F.least(scale_to_side(width, height, side), budget)


def render_zoom(target_dpi: Column, points_width: Column, points_height: Column, max_pixels: Column) -> Column:
    """Zoom over 72 dpi, reduced so that the raster keeps within ``max_pixels``."""
    zoom = target_dpi / F.lit(72.0)
    area = points_width * points_height * zoom * zoom
    return F.when((F.coalesce(max_pixels, F.lit(0)) > 0) & (area > max_pixels), zoom * F.sqrt(max_pixels / area)).otherwise(zoom)


def guarded_share(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where the whole is 0 or null."""
    return F.coalesce(100.0 * part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))
