"""Column functions over records; all of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits in seconds, shares and bits that the decisions are defined with.
ONE_CAPTURE, SAME_MOMENT, EXACT_MOMENT, BURST_GAP, WINDOW, SHOOT_GAP = 0.5, 2.0, 0.01, 3.0, 60.0, 5400.0
AGREE_BLOCK, AGREE_RATIO, STRUCTURE_FLOOR = 10.0, 5.0, 0.97
#: File extensions.
RAW_EXTENSIONS = (".arw", ".cr2", ".cr3", ".crw", ".nef", ".nrw", ".dng", ".raf", ".orf", ".rw2", ".pef", ".srw", ".raw", ".3fr", ".erf", ".mrw", ".x3f")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".heic", ".heif", ".webp", ".bmp")
VIDEO_EXTENSIONS = (".mov", ".mp4")
LIBRARY_EXTENSIONS = (".photoslibrary", ".photolibrary", ".aplibrary", ".migratedphotolibrary", ".lrlibrary", ".lrcat")
LOSSLESS_EXTENSIONS = (".png", ".tif", ".tiff", ".bmp")
#: Names that editing software signs with.
EDITORS = (
    "photoshop", "lightroom", "gimp", "photo gallery", "picasa", "snapseed", "pixelmator", "affinity", "luminar", "capture one",
    "acdsee", "corel", "on1", "photos ", "photoscape", "paint.net",
)
#: Marks of the frames that a camera writes in pairs (merged and spare, blurred and its source).
MERGED, SPARE, BLURRED, SOURCE = 3, 4, 8, 9
#: Fixed value: a capture time in a file name, year, month, day, hour, minute, second and perhaps a fraction.
NAME_TIME = r"(\d{4})[.\-_](\d{2})[.\-_](\d{2})\D+(\d{2})[.\-_](\d{2})[.\-_](\d{2})(?:[.\-_](\d{1,3}))?"


def quick_key(content: Column, edge: int = 1 << 20) -> Column:
    """A cheap key: md5 of the size, the first `edge` units and, if there is more than twice that, the last ones too.

    It leaves the middle unread, so it proposes; content_key() proves.
    """
    size = F.length(content)
    tail = F.when(size > 2 * edge, F.substring(content, -edge, edge)).otherwise(F.lit(""))
    return F.md5(F.concat(size.cast("string"), F.substring(content, 1, edge), tail))


def content_key(content: Column) -> Column:
    return F.sha2(content, 256)


def normalised(text: Column) -> Column:
    """Lower case, blanks collapsed, ends trimmed."""
    return F.trim(F.lower(F.regexp_replace(text, r"[ \t\n\r]+", " ")))


def extension(path: Column) -> Column:
    """The last name's extension in lower case with its dot, or nothing."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def seconds(ts: Column) -> Column:
    """Epoch seconds, with a fraction, of a timestamp without zone read as UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def name_time(name: Column) -> Column:
    """Epoch seconds from a file name; null where it has none or an impossible one."""
    part = lambda k: F.regexp_extract(name, NAME_TIME, k)
    whole = F.concat_ws(" ", F.concat_ws("-", part(1), part(2), part(3)), F.concat_ws(":", part(4), part(5), part(6)))
    parsed = F.unix_micros(F.try_to_timestamp(F.when(part(1) != "", whole), F.lit("yyyy-MM-dd HH:mm:ss"))) / F.lit(1e6)
    return parsed + F.coalesce(F.when(part(7) != "", part(7).try_cast("double") / 1000), F.lit(0.0))


def capture_time(recorded: Column, name: Column, modified: Column) -> Column:
    """The recorded time, else that in the name, else the file's."""
    return F.coalesce(recorded, name_time(name), modified)


def compression_tier(mean: Column, lossless: Column) -> Column:
    """Steps of 1.4 in the mean quantizer, halves to even; -1 without loss, 0 without a table."""
    step = F.bround(F.ln(F.greatest(mean, F.lit(1.0))) / F.ln(F.lit(1.4))).cast("int")
    return F.when(lossless, -1).when(mean.isNull(), 0).otherwise(step)


def halvings(width: Column, height: Column, least: int = 2000) -> Column:
    """The largest power of two that leaves the long side at `least`, 1 if none does."""
    longest = F.greatest(width, height)
    power = F.lit(1)
    for k in range(1, 16):
        power = F.when(F.floor(longest / F.lit(1 << k)) >= least, F.lit(1 << k)).otherwise(power)
    return power


def signed_by_editor(software: Column) -> Column:
    return F.coalesce(F.lower(software).rlike("|".join(x.replace(".", "\\.") for x in EDITORS)), F.lit(False))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once; a lambda's body would compute it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def centred_unit(vector: Column) -> Column:
    """The vector less its mean, of length one; a constant vector becomes zeros."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    centred = let(F.struct(wide.alias("v"), (_total(wide) / F.size(vector)).alias("m")), lambda s: F.transform(s.v, lambda x: x - s.m))
    scaled = lambda c: let(F.struct(c.alias("c"), F.sqrt(_total(F.transform(c, lambda x: x * x))).alias("n")), lambda s: F.transform(s.c, lambda x: F.when(s.n > 1e-12, x / s.n).otherwise(0.0)))
    return let(centred, scaled)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def structure_agrees(a: Column, b: Column, floor: float = STRUCTURE_FLOOR) -> Column:
    """Whether two sketches agree with mean and scale set aside. Other sizes, nulls and flat sketches do not."""
    return F.coalesce((F.size(a) == F.size(b)) & (dot(centred_unit(a), centred_unit(b)) >= floor), F.lit(False))


def pictures_agree(verdict: Column) -> Column:
    return F.coalesce(verdict["block"] * 100 <= AGREE_BLOCK, F.lit(False)) | F.coalesce(verdict["ratio"] <= AGREE_RATIO, F.lit(False))


def camera_pair(a_mark: Column, b_mark: Column, apart: Column) -> Column:
    """Whether one capture wrote both frames: marks that belong together, within half a second."""
    both = lambda x, y: (F.least(a_mark, b_mark) == x) & (F.greatest(a_mark, b_mark) == y)
    return F.coalesce((both(MERGED, SPARE) | both(BLURRED, SOURCE)) & (apart < ONE_CAPTURE), F.lit(False))


def margin(block: Column, ratio: Column, block_limit: Column, ratio_limit: Column) -> Column:
    """The larger share of its limit that either number uses; anything over a limit of zero is infinite."""

    def used(value: Column, limit: Column) -> Column:
        over = F.when(value == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
        return F.when(limit != 0, value / F.when(limit != 0, limit)).otherwise(over)

    return F.greatest(used(block, block_limit), used(ratio, ratio_limit))


def size_text(size: Column) -> Column:
    return F.when(size >= 1e9, F.concat(F.format_string("%.2f", size / 1e9), F.lit(" GB"))).otherwise(F.concat(F.format_string("%.1f", size / 1e6), F.lit(" MB")))


def duration_text(total: Column) -> Column:
    whole = F.floor(total).cast("long")
    h, m, s = (F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
    return F.when(whole >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).when(whole >= 60, F.concat(m, F.lit("m "), s, F.lit("s"))).otherwise(F.concat(s, F.lit("s")))


def dimensions_text(width: Column, height: Column, raw: Column) -> Column:
    known = (width > 0) & (height > 0)
    return F.when(known, F.concat(width, F.lit("x"), height)).when(raw, F.lit("raw sensor")).otherwise(F.lit("?"))


def above_median(vector: Column) -> Column:
    """An array of 0 and 1: which entries exceed the vector's median."""

    def marked(v: Column) -> Column:
        ordered, n = F.array_sort(v), F.size(v)
        middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
        return let(F.struct(v.alias("v"), middle.alias("m")), lambda s: F.transform(s.v, lambda x: (x > s.m).cast("int")))

    return let(F.transform(vector, lambda x: x.cast("double")), marked)


def packed(bits: Column) -> Column:
    """Up to 64 bits, the first one highest, as a long."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("long")))
