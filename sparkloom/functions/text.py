"""Text and regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*parts: Column) -> Column:
    """Skips NULLs."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def substring(s: Column, start: int, length: int | None = None) -> Column:
    """Positions before the text count (start 0 with length 2 gives one character); negative starts count from the end,
    negative lengths take what lies before the start."""
    n = F.length(s)
    first = F.lit(start) if start >= 0 else n + (start + 1)
    if length is None:
        return F.substring(s, F.greatest(first, F.lit(1)), F.greatest(n, F.lit(0)))
    end = first + length
    low, high = (first, end) if length >= 0 else (end, first)
    low_in = F.greatest(low, F.lit(1))
    return F.substring(s, low_in, F.greatest(high - low_in, F.lit(0)))


def left(s: Column, n: int) -> Column:
    """A negative n drops as many from the end."""
    return F.substring(s, F.lit(1), F.lit(n) if n >= 0 else F.greatest(F.length(s) + n, F.lit(0)))


def right(s: Column, n: int) -> Column:
    """A negative n drops as many from the start."""
    if n < 0:
        return F.substring(s, F.lit(1 - n), F.greatest(F.length(s), F.lit(0)))
    return F.substring(s, F.greatest(F.length(s) - n + 1, F.lit(1)), F.lit(n))


def split(s: Column, separator: str) -> Column:
    """The separator is plain text."""
    return F.split(s, re.escape(separator), -1)


def unicode(s: Column) -> Column:
    """-1 for an empty text."""
    return F.when(s == "", F.lit(-1)).otherwise(F.ascii(s))


def regexp_full_match(s: Column, pattern: str) -> Column:
    return s.rlike(rf"^(?:{pattern})\z")


def regexp_extract(s: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(s, pattern, group)


def _java_references(replacement: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))


def regexp_replace(s: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    r"""The first match only, unless flags has g; \1 refers to a group."""
    to = _java_references(replacement)
    head = "(?i)" if "i" in flags else ""
    if "g" in flags:
        return F.regexp_replace(s, head + pattern, to)
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}" if int(m[1]) else "$0", to)
    return F.regexp_replace(s, f"{head}(?s)^(.*?)(?-s:{pattern})", "$1" + shifted)


def regexp_escape(s: Column) -> Column:
    return F.regexp_replace(s, r"([^A-Za-z0-9_])", r"\\$1")


#: strftime specifiers as date_format letters.
SPECIFIERS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%p": "a", "%j": "DDD",
    "%A": "EEEE", "%a": "EEE", "%B": "MMMM", "%b": "MMM", "%f": "SSSSSS", "%g": "SSS", "%-d": "d", "%-m": "M", "%-H": "H", "%-I": "h", "%-M": "m", "%-S": "s", "%-j": "D", "%-y": None,
}


def strftime(ts: Column, form: str) -> Column:
    """Pieces of the format, each a specifier or plain text, put together."""
    parts: list[Column] = []
    for piece in re.findall(r"%-?.|[^%]+", form):
        if piece == "%%":
            parts.append(F.lit("%"))
        elif piece == "%-y":
            parts.append((F.year(ts) % 100).cast("string"))
        elif piece in ("%w", "%u"):
            parts.append(((F.dayofweek(ts) - 1) if piece == "%w" else F.weekday(ts) + 1).cast("string"))
        elif piece.startswith("%"):
            if SPECIFIERS.get(piece) is None:
                raise ValueError(f"unsupported specifier {piece}")
            parts.append(F.date_format(ts, SPECIFIERS[piece]))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.when(ts.isNotNull(), F.lit(""))


def strptime_format(form: str) -> str:
    out = []
    for piece in re.findall(r"%-?.|[^%]+", form):
        out.append(SPECIFIERS[piece] if piece.startswith("%") else "".join(f"'{c}'" if c.isalpha() else c for c in piece))
    return "".join(out)


def strptime(s: Column, form: str, strict: bool = True) -> Column:
    fmt = F.lit(strptime_format(form))
    return F.to_timestamp_ntz(s, fmt) if strict else F.try_to_timestamp(s, fmt).cast("timestamp_ntz")


def format_braces(form: str, *args: Column) -> Column:
    """Each {} takes the next argument's text."""
    pieces = form.split("{}")
    if len(pieces) != len(args) + 1:
        raise ValueError("as many arguments as {} are needed")
    parts: list[Column] = [F.lit(pieces[0])]
    for piece, arg in zip(pieces[1:], args, strict=True):
        parts += [arg.cast("string"), F.lit(piece)]
    return F.concat(*parts)


def url_encode(s: Column) -> Column:
    """A space is %20."""
    return F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))


def hamming(a: Column, b: Column) -> Column:
    """Places at which texts of one length differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda t, x: t + x)).otherwise(F.raise_error(F.lit("texts must be of one length")).cast("int")).cast("bigint")


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of characters."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def strip_accents(s: Column) -> Column:
    """Latin letters without their marks."""
    marked = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    plain = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
    return F.translate(s, marked, plain)


def file_name(s: Column) -> Column:
    return F.element_at(F.split(s, r"[/\\]"), -1)


def format_bytes(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.when(n == 1, F.lit(" byte")).otherwise(F.lit(" bytes")))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        size = float(1024**power)
        out = F.when(n >= size, F.concat(F.format_string("%.1f", F.floor(n / size * 10) / 10), F.lit(f" {unit}"))).otherwise(out)
    return out


def to_base(n: Column, radix: int, least: int = 1) -> Column:
    """Digits of a number that is not negative, with zeros in front up to a least length."""
    digits = F.conv(n.cast("string"), 10, radix)
    return F.when(F.length(digits) >= least, digits).otherwise(F.lpad(digits, least, "0"))


def length_grapheme(s: Column) -> Column:
    """Of characters as a reader sees them, marks and joined emoji included."""
    return F.regexp_count(s, F.lit(r"\X")).cast("bigint")


def left_grapheme(s: Column, n: int) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(s, F.lit(r"(\X)"), F.lit(1)), 1, n), "")


def parse_path(s: Column) -> Column:
    """Parts of a path; a leading separator is the first part."""
    parts = F.filter(F.split(s, r"[/\\]"), lambda p: p != "")
    return F.when(s.rlike(r"^[/\\]"), F.concat(F.array(F.substring(s, 1, 1)), parts)).otherwise(parts)


def dir_name(s: Column) -> Column:
    """The first part of a path; empty for a bare file name."""
    return F.when(s.rlike(r"[/\\]"), F.element_at(parse_path(s), 1)).when(s.isNotNull(), F.lit(""))


def dir_path(s: Column) -> Column:
    """All before the last separator."""
    return F.regexp_extract(s, r"^(.*)[/\\][^/\\]*$", 1)


def bar(x: Column, low: float, high: float, width: int = 80) -> Column:
    """A bar of eighths of blocks, as wide as x's share of the range, filled up with blanks."""
    share = F.least(F.greatest((x.cast("double") - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    eighths = F.floor(share * width * 8 + F.lit(0.0)).cast("int")
    part = F.get(F.array(*[F.lit(p) for p in " ▏▎▍▌▋▊▉"]), eighths % 8)
    drawn = F.concat(F.repeat(F.lit("█"), F.floor(eighths / 8).cast("int")), F.when(eighths % 8 > 0, part).otherwise(F.lit("")))
    return F.rpad(drawn, width, " ")
