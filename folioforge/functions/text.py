"""Column functions over strings. Positions and lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits, and the characters beside which short digit runs are set upright.
HALF, FULL = "0123456789", "０１２３４５６７８９"
KANJI_DIGITS = "〇一二三四五六七八九"
JAPANESE = r"[ 　-〿぀-ゟ゠-ヿ一-鿿！-／：-￯]"

# Fixed caption templates (vertical, horizontal); h half-width, f full-width, k kanji numeral, t caption text.
CAPTION_TEMPLATES = [
    ("図{h}: {t}", "図{h}: {t}"),
    ("図{h} : {t}", "図{h} : {t}"),
    ("図{h}.{t}", "図{h}.{t}"),
    ("図{h}. {t}", "図{h}. {t}"),
    ("Figure {h}: {t}", "Figure {h}: {t}"),
    ("Fig. {h}: {t}", "Fig. {h}: {t}"),
    ("図{h} {t}", "図{h} {t}"),
    ("図{f}: {t}", "図{f}: {t}"),
    ("図{f} : {t}", "図{f} : {t}"),
    ("図{f}：{t}", "図{f}：{t}"),
    ("図{f}:{t}", "図{f}.{t}"),
    ("図{f}: {t}", "図{f}. {t}"),
    ("図{f} {t}", "図{f} {t}"),
    ("図{f}　{t}", "図{f}　{t}"),
    ("図{k}: {t}", "図{k}: {t}"),
    ("図{k} : {t}", "図{k} : {t}"),
    ("図{k}：{t}", "図{k}：{t}"),
    ("図{k}:{t}", "図{k}.{t}"),
    ("図{k}: {t}", "図{k}. {t}"),
    ("図{k} {t}", "図{k} {t}"),
    ("図{k}　{t}", "図{k}　{t}"),
    ("▶ {t}", "▲ {t}"),
]


def split_parts(text: Column, delimiter: str) -> Column:
    """Parts between literal delimiters, empty ones included."""
    return F.split(text, r"\Q" + delimiter + r"\E", -1)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def remove_outer_brackets(text: Column, start: str = "「", end: str = "」") -> Column:
    """Drop one outer pair only where it encloses the whole stripped text."""
    t = strip(text)
    inner = F.split(t.substr(F.lit(1), F.length(t) - 1), "")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(False).alias("closed"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == start, 1).when(c == end, -1).otherwise(0)
        return F.struct(depth.alias("depth"), (s["i"] + 1).alias("i"), (s["closed"] | ((depth == 0) & (s["i"] > 0))).alias("closed"))

    closed = F.aggregate(inner, zero, step, lambda s: s["closed"])
    wrapped = t.startswith(start) & t.endswith(end) & (F.length(t) > 1)
    return F.when(wrapped & ~closed, t.substr(F.lit(2), F.length(t) - 2)).otherwise(t)


def strip_figure_prefix(text: Column) -> Column:
    """Without a leading figure word, its number and separators."""
    # fixed pattern
    return F.regexp_replace(text, r"(?U)^図\s*(?:\d+[：:\.\s]*|[：:\.\s]+)", "")


def vertical_digits(text: Column) -> Column:
    """Mark runs of one to three digits between Japanese characters as upright, in half-width digits."""
    marked = F.regexp_replace(text, rf"(?:^|(?<={JAPANESE}))\p{{Nd}}{{1,3}}(?={JAPANESE})", "\u0001$0\u0002")
    parts = F.split(marked, "[\u0001\u0002]", -1)
    upright = lambda p, i: F.when(i % 2 == 1, F.concat(F.lit('<span class="tcy">'), F.translate(p, FULL, HALF), F.lit("</span>"))).otherwise(p)
    return F.array_join(F.transform(parts, upright), "")


def to_fullwidth(number: Column) -> Column:
    return F.translate(number.cast("string"), HALF, FULL)


def to_kanji(number: Column) -> Column:
    """Kanji numeral of 0 to 9999: a power's own digit is written unless it is one."""
    n = number.cast("int")
    out = []
    for power, sign in ((1000, "千"), (100, "百"), (10, "十")):
        digit = F.floor(n / power).cast("int") % 10
        out.append(F.when(digit == 0, "").when(digit == 1, sign).otherwise(F.concat(F.translate(digit.cast("string"), HALF, KANJI_DIGITS), F.lit(sign))))
    last = n % 10
    out.append(F.when((last == 0) & (n > 0), "").otherwise(F.translate(last.cast("string"), HALF, KANJI_DIGITS)))
    return F.concat(*out)


def caption(style: Column, vertical: Column, number: Column, text: Column) -> Column:
    """Caption in one of the fixed styles (0-based)."""
    pick = F.when(vertical, F.get(F.array(*[F.lit(a) for a, _ in CAPTION_TEMPLATES]), style.cast("int"))).otherwise(F.get(F.array(*[F.lit(b) for _, b in CAPTION_TEMPLATES]), style.cast("int")))
    for mark, value in (("{h}", number.cast("string")), ("{f}", to_fullwidth(number)), ("{k}", to_kanji(number)), ("{t}", text)):
        pick = F.replace(pick, F.lit(mark), value)
    return pick


def rstrip_charset(text: Column, characters: str) -> Column:
    """Without trailing characters of a set (not a suffix)."""
    return F.rtrim(text, F.lit(characters))


def remove_suffix(text: Column, suffix: str) -> Column:
    return F.when(text.endswith(suffix), text.substr(F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def zero_pad(number: Column, width: int) -> Column:
    """Like a 0-padded decimal format: longer numbers stay whole."""
    return F.format_string(f"%0{width}d", number.cast("bigint"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def dirname(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), r"(?<=[^/])/+$", "")


def splitext(path: Column) -> tuple[Column, Column]:
    extension = F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1)
    return path.substr(F.lit(1), F.length(path) - F.length(extension)), extension


def mime_of(path: Column) -> Column:
    """Image type by extension; png where unknown."""
    e = F.lower(splitext(path)[1])
    return F.when(e.isin(".jpg", ".jpeg"), "image/jpeg").when(e == ".gif", "image/gif").when(e == ".webp", "image/webp").when(e == ".bmp", "image/bmp").otherwise("image/png")


def data_url(data: Column, mime: Column) -> Column:
    """Line breaks that base64() may insert are removed."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(data), r"\s", ""))


def font_url(name: Column) -> Column:
    return F.concat(F.lit("https://fonts.googleapis.com/css2?family="), F.replace(name, F.lit(" "), F.lit("+")), F.lit(":wght@400&display=swap"))


def drop_last(text: Column, n: int) -> Column:
    """Without the last n characters; shorter texts become empty."""
    return text.substr(F.lit(1), F.greatest(F.length(text) - n, F.lit(0)))


def field(text: Column, delimiter: str, index: int) -> Column:
    """The part of an index (from 0) between delimiters; null beyond the last."""
    return F.get(split_parts(text, delimiter), F.lit(index))
