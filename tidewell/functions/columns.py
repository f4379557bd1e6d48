"""Column expressions shared by the jobs (time context, distance, text and link helpers).

Every function takes and returns a ``Column``; there is no UDF here, so each expression stays
inside whole-stage code generation.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Opening periods: bit, name, first hour, hour after the last (local time, UTC+8).
PERIODS = [(1, "am", 8, 12), (2, "pm", 12, 18), (4, "eve", 18, 22)]
LOCAL_ZONE = "+08:00"
EARTH_RADIUS_KM = 6371.0088
# Characters never allowed in published text: controls, soft hyphen, zero width, bidi marks, BOM, < and >.
UNSAFE_CHARS = (
    r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}\x{00AD}\x{061C}\x{180E}"
    r"\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{206F}\x{FEFF}\x{FFF9}-\x{FFFB}<>]"
)
SPACE_CONTROLS = r"[\t\n\r]"
SPACES = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# Punctuation ignored when search text is compared.
SEARCH_PUNCTUATION = r"[\s　,，、.。·・\-–—_()（）]"
PHONE_WORDS = r"(?i)轉|分機|或|ext\.?"
PHONE_CHARS = r"0-9 +\-()#~,、/"
VIDEO_HOSTS = ["www.youtube.com", "youtu.be"]
# ------------------------------------------------------------------------------


def local_time(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """UTC instant (zone-free timestamp) as wall-clock time in ``zone``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def day_index(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """Weekday with Monday = 0."""
    return F.weekday(local_time(ts, zone).cast("date"))


def period_bit(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """Bit of the opening period that contains the instant, 0 outside all of them."""
    hour = F.hour(local_time(ts, zone))
    out = F.lit(0)
    for bit, _, start, end in PERIODS:
        out = F.when((hour >= start) & (hour < end), F.lit(bit)).otherwise(out)
    return out


def format_local(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """``2026/9/21 11:28`` style local time."""
    return F.date_format(local_time(ts, zone), "y/M/d H:mm")


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat = F.radians(lat2 - lat1) / 2
    dlng = F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def distance_label(km: Column) -> Column:
    """Metres in steps of 10 (at least 10) under 1 km, one decimal under 10 km, whole km above."""
    metres = F.greatest(F.lit(10), (F.floor(km * 100 + F.lit(0.5)) * 10).cast("int"))
    return (
        F.when(km.isNull() | F.isnan(km), F.lit(None).cast("string"))
        .when(km < 1, F.concat(metres.cast("string"), F.lit(" m")))
        .when(km < 10, F.concat(F.format_string("%.1f", km), F.lit(" km")))
        .otherwise(F.concat(F.floor(km + F.lit(0.5)).cast("string"), F.lit(" km")))
    )


def fold_width(c: Column) -> Column:
    """Full-width ASCII forms and the ideographic space to their plain forms."""
    wide = "".join(chr(cp) for cp in range(0xFF01, 0xFF5F)) + "　"
    plain = "".join(chr(cp - 0xFEE0) for cp in range(0xFF01, 0xFF5F)) + " "
    return F.translate(c, wide, plain)


def _accent_tables() -> tuple[str, str]:
    """Accented Latin letters whose decomposition starts with an ASCII letter, and those letters."""
    src, dst = [], []
    for cp in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(cp))[0]
        if base.isascii() and base.isalpha() and base != chr(cp):
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


def fold_accents(c: Column) -> Column:
    src, dst = _accent_tables()
    return F.regexp_replace(F.translate(c, src, dst), r"[\x{0300}-\x{036F}]", "")


def trim_space(c: Column) -> Column:
    """Trim every Unicode space, not only the ASCII blank."""
    return F.regexp_replace(c, f"^{SPACES}+|{SPACES}+$", "")


def normalize_text(c: Column) -> Column:
    """Search form: folded width, lower case, one spelling of 臺, no spaces or punctuation."""
    return F.regexp_replace(F.translate(F.lower(fold_width(F.coalesce(c, F.lit("")))), "台", "臺"), SEARCH_PUNCTUATION, "")


def normalize_latin(c: Column) -> Column:
    """Latin search form: no accents or apostrophes, lower case, other characters become one space."""
    s = F.lower(fold_accents(fold_width(F.coalesce(c, F.lit("")))))
    return F.trim(F.regexp_replace(F.regexp_replace(s, "['’‘`]", ""), "[^a-z0-9]+", " "))


def clean_text(c: Column, max_len: int | None) -> Column:
    """Tabs and line ends to spaces, unsafe characters removed, trimmed, cut to ``max_len`` code points unless that is None."""
    s = trim_space(F.regexp_replace(F.regexp_replace(c, SPACE_CONTROLS, " "), UNSAFE_CHARS, ""))
    if max_len is None:
        return s
    return F.when(F.char_length(s) > max_len, trim_space(F.substring(s, 1, max_len))).otherwise(s)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def squash_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\x{00A0}\x{3000}\x{2002}\x{2003}\x{2009}]+", " "))


def clean_latin(c: Column, max_len: int) -> Column:
    """Cleaned text if it holds only Latin letters, digits and ``' . , - ( )`` and at least one letter."""
    s = clean_text(c, max_len)
    ok = s.rlike(r"^[\p{IsLatin}0-9 '.,\-()]+$") & s.rlike(r"\p{IsLatin}")
    return F.when(ok, F.regexp_replace(s, " {2,}", " "))


def clean_phone(c: Column, max_len: int = 60) -> Column:
    """Digits, dialling punctuation and extension words only; NULL under 3 digits or over ``max_len``."""
    s = clean_text(c, max_len * 4)
    # Group 1 holds what stays; everything else matches the second branch and becomes nothing.
    kept = F.regexp_replace(s, rf"({PHONE_WORDS}|[{PHONE_CHARS}])|[\s\S]", "$1")
    kept = F.trim(F.regexp_replace(kept, " {2,}", " "))
    return F.when((F.regexp_count(kept, F.lit("[0-9]")) >= 3) & (F.char_length(kept) <= max_len), kept)


def url_authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)


def url_host(url: Column) -> Column:
    """Lower-case host without credentials and port, empty if there is none."""
    return F.lower(F.regexp_extract(url_authority(url), r"^(?:.*@)?([^:@]*)", 1))


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def url_fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#([\s\S]*)$", 1)


def has_port(url: Column) -> Column:
    return url_authority(url).rlike(r":\d+$")


def clean_https_url(c: Column, max_len: int = 500) -> Column:
    """The URL unchanged if it is https, has a dotted host, no credentials and no unsafe character."""
    unsafe = c.rlike(r"""[\s"'`]""") | c.rlike(UNSAFE_CHARS)
    ok = (
        (F.char_length(c) <= max_len)
        & c.rlike("^(?i)https://")
        & ~unsafe
        & ~F.contains(url_authority(c), F.lit("@"))
        & F.contains(url_host(c), F.lit("."))
    )
    return F.when(ok, c)


def host_allowed(host: Column, allow: list[str]) -> Column:
    """``host`` equals an entry, or ends with the rest of a ``*.suffix`` entry."""
    h = F.lower(host)
    tests = [F.endswith(h, F.lit(a[1:])) & (F.char_length(h) > len(a) - 1) if a.startswith("*.") else h == a for a in allow]
    return F.coalesce(reduce(lambda x, y: x | y, tests), F.lit(False))


def phone_link(c: Column) -> Column:
    """``tel:`` link of the first number, its extension after a comma; NULL under 3 digits."""
    first = F.element_at(F.split(F.coalesce(c, F.lit("")), "[~～〜或、/]"), 1)
    parts = F.split(first, r"(?i)#|轉|分機|ext\.?")
    main = F.regexp_replace(F.element_at(parts, 1), r"[^\d+]", "")
    main = F.regexp_replace(main, r"(?<!^)\+", "")
    ext = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), r"\D", "")
    link = F.concat(F.lit("tel:"), main, F.when(ext != "", F.concat(F.lit(","), ext)).otherwise(F.lit("")))
    return F.when(F.char_length(F.regexp_replace(main, r"\D", "")) >= 3, link)


def strip_marker(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*[▲△■□◆◇★☆▶►•]\s*", "")


def bare_url(c: Column) -> Column:
    """The trimmed text if all of it is one https URL."""
    s = F.trim(c)
    return F.when(s.rlike(r"^https://\S+$"), clean_https_url(s, 2048))


def no_break_hyphen(c: Column) -> Column:
    return F.regexp_replace(c, r"\b([A-Za-z]{2,})-(\d{1,3})\b", "$1‑$2")


def file_language(c: Column) -> Column:
    return F.when(c.rlike(r"(?i)英文|英語|\bEnglish\b"), "en").when(
        c.rlike(r"(?i)中文版|\(Chinese\)|（Chinese）|\bChinese version\b"), "zh"
    )


def is_video_link(c: Column) -> Column:
    return F.coalesce(url_host(c).isin(VIDEO_HOSTS) & clean_https_url(c, 2048).isNotNull(), F.lit(False))


def open_on(hours: Column, day: Column) -> Column:
    """Period bits of one weekday (Monday = 0) from a seven-element hours array."""
    return F.coalesce(F.try_element_at(hours, (day + 1).cast("int")), F.lit(0))
