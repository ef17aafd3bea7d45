"""Scalar expressions (Column -> Column), all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: the namespaces of stable ids, and the separator of normalisation keys
QUALITY_NAMESPACE = "b3c1e2d45f6a4b8e9c1d2e3f4a5b6c7d"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
SEPARATOR = "␟"
#: fixed values: numerals and units of chapter headings
CJK_DIGITS = "一二三四五六七八九十百"
CJK_UNITS = "章节部分篇"


def strip(c: Column) -> Column:
    """Trim all Unicode white space, as opposed to SQL's trim of spaces."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def uuid5(key: Column, namespace: str = QUALITY_NAMESPACE) -> Column:
    """Version 5 UUID of a key: SHA-1 with the version and variant bits put in."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(key, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63)).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def stable_key(*parts: Column) -> Column:
    """Key of a normalisation id: parts joined by a separator, null as empty."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def occurrences(text: Column, what: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("long")


def heading_text(text: Column, markdown: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, markdown, F.lit("")), r"^\s*#{1,6}\s*", ""))


def numbered_level(text: Column) -> Column:
    """'1.2' has level 2; a Chinese ordinal or chapter has level 1; no number, null."""
    digits = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)*)", 1)
    chinese = text.rlike(rf"^\s*[{CJK_DIGITS}]+[、.．]|^\s*第[{CJK_DIGITS}]+[{CJK_UNITS}]")
    return F.when(digits != "", F.size(F.split(digits, r"\."))).when(chinese, F.lit(1))


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def coordinate_system(c: Column) -> Column:
    n = F.replace(F.replace(F.lower(strip(c)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    return F.when(n.isin("bottomleft", "bottom_left", "bottomleft_absolute", "bottom_left_absolute"), F.lit("bottom_left_absolute")).otherwise(n)


def bbox_valid(bbox: Column, system: Column) -> Column:
    """Four numbers, right beyond left, and the vertical order of the coordinate system."""
    up = F.coalesce(coordinate_system(system) == "bottom_left_absolute", F.lit(False))
    vertical = F.when(up, F.get(bbox, F.lit(1)) > F.get(bbox, F.lit(3))).otherwise(F.get(bbox, F.lit(3)) > F.get(bbox, F.lit(1)))
    return F.coalesce((F.size(bbox) == 4) & (F.get(bbox, F.lit(2)) > F.get(bbox, F.lit(0))) & vertical, F.lit(False))


def bbox_thousandths(bbox: Column, width: Column, height: Column, system: Column) -> Column:
    """A box in thousandths of the page, top-left origin, clipped to 0..1000."""
    up = F.coalesce(coordinate_system(system) == "bottom_left_absolute", F.lit(False))
    x0, y0, x1, y1 = (F.get(bbox, F.lit(i)) for i in range(4))
    top, bottom = F.when(up, height - y0).otherwise(y0), F.when(up, height - y1).otherwise(y1)

    def scaled(v: Column, of: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1000.0), v / of * 1000))

    return F.when((width > 0) & (height > 0), F.array(scaled(x0, width), scaled(top, height), scaled(x1, width), scaled(bottom, height)))


def escape_cell(c: Column, drop_cr: bool = True) -> Column:
    """A cell's text in a pipe table: bars escaped, line ends as breaks; CR dropped or a break of its own."""
    t = F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    if drop_cr:
        return F.replace(F.replace(t, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("<br>"))
    return F.replace(F.replace(F.replace(t, F.lit("\r\n"), F.lit("<br>")), F.lit("\r"), F.lit("<br>")), F.lit("\n"), F.lit("<br>"))


def column_letters(index: Column) -> Column:
    """Spreadsheet letters of a zero-based column up to 18,277 (ZZZ)."""
    letter = lambda n: F.char(n + 65)
    one = index
    two, three = index - 26, index - 702
    d = lambda n, k: F.floor(n / 26**k).cast("int") % 26
    return F.when(index < 26, letter(one)).when(index < 702, F.concat(letter(d(two, 1)), letter(d(two, 0)))).otherwise(F.concat(letter(d(three, 2)), letter(d(three, 1)), letter(d(three, 0))))


def a1(row: Column, col: Column) -> Column:
    return F.concat(column_letters(col), (row + 1).cast("string"))


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def safe_path(c: Column) -> Column:
    """A relative path without empty, '.' or '..' parts, backslashes, or a drive."""
    return F.coalesce((c != "") & ~c.rlike(r"^/|\\|^[A-Za-z]:|(^|/)\.{0,2}(/|$)"), F.lit(False))


def window_name(c: Column) -> Column:
    """The last part of a path of either slash, without trailing dots and spaces, in lower case."""
    return F.lower(F.rtrim(F.element_at(F.split(c, r"[/\\]"), -1), F.lit(". ")))


def expand_marker(inner: Column, most: int = 50) -> Column:
    """'1, 3-5' to [1, 3, 4, 5]: distinct in order; null if a part is no number or rising range of at most `most`."""
    parts = F.transform(F.split(inner, ","), lambda p: strip(p))

    def one(p: Column) -> Column:
        a = F.regexp_extract(p, r"^(\d+)(?:\s*[-–]\s*(\d+))?$", 1)
        b = F.regexp_extract(p, r"^(\d+)(?:\s*[-–]\s*(\d+))?$", 2)
        lo, hi = a.try_cast("long"), F.when(b == "", a).otherwise(b).try_cast("long")
        return F.when((a != "") & (lo <= hi) & (hi - lo <= most), F.sequence(lo, hi))

    lists = F.transform(parts, one)
    return F.when(~F.exists(lists, lambda x: x.isNull()), F.array_distinct(F.flatten(lists)))


def markers(text: Column, pattern: str = r"\[(\d+(?:\s*[,，]\s*\d+|\s*[-–]\s*\d+)*)\]") -> Column:
    """array<struct<i, gap, marker, before, after>>: citation markers with the text around them."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda m, i: F.struct(i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), m.alias("marker"), F.substring(F.get(gaps, i), -1, 1).alias("before"), F.get(gaps, i + 1).alias("after")))


def alnum_key(c: Column) -> Column:
    """Lower case, letters and digits of any script only (NFKC-stable input)."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
