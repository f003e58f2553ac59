"""Identifier, text and coercion expressions. All are plain Column compositions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# A walk lists the files of a folder before its subfolders, both by name. Marking every folder
# component with the highest code point and closing it with NUL gives that order to plain strings.
_FOLDER_MARK = chr(0x10FFFF)


def blank(c: Column) -> Column:
    """Missing text counts as the empty string."""
    return F.coalesce(c, F.lit(""))


# The characters that count as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove all white space at both ends (``trim`` alone removes only spaces).

    Few texts have any, and looking for thirty characters is slow: ends between ``!`` and ``~`` are told at once.
    """
    clean = F.left(c, F.lit(1)).between("!", "~") & F.right(c, F.lit(1)).between("!", "~")
    return F.when(clean, c).otherwise(F.btrim(c, F.lit(WHITE_SPACE)))


def hash_prefix(c: Column, length: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def id_hash(c: Column) -> Column:
    return hash_prefix(c, 16)


def site_id(center: Column) -> Column:
    return F.concat(F.lit("site-"), hash_prefix(center, 8))


def file_name(relpath: Column) -> Column:
    return F.substring_index(relpath, "/", -1)


def parent_dir(relpath: Column) -> Column:
    return F.left(relpath, F.length(relpath) - F.length(file_name(relpath)) - F.lit(1))


def walk_order_key(relpath: Column) -> Column:
    """Sort key of a relative path in walk order."""
    folders = F.replace(parent_dir(relpath), F.lit("/"), F.lit("\0" + _FOLDER_MARK))
    return F.when(
        F.contains(relpath, F.lit("/")),
        F.concat(F.lit(_FOLDER_MARK), folders, F.lit("\0"), file_name(relpath)),
    ).otherwise(relpath)


def path_sort_key(relpath: Column) -> Column:
    """Sort key that compares paths component by component."""
    return F.translate(relpath, "/", "\0")


def relative_to(path: Column, root: str) -> Column:
    """``path`` below ``root``; null when it lies elsewhere."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30))


def subject_label(c: Column) -> Column:
    """Lower-case letters and digits without one leading ``sub``; null when nothing is left."""
    kept = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    label = F.when(kept.startswith("sub") & (F.length(kept) > 3), F.substring(kept, 4, 1 << 30)).otherwise(kept)
    return F.when(label != "", label)


def safe_double(c: Column) -> Column:
    return strip(c.cast("string")).try_cast("double")


def safe_int(c: Column) -> Column:
    return strip(c.cast("string")).try_cast("int")


def fixed_vector(v: Column, n: int) -> Column:
    """The array itself when it holds exactly ``n`` numbers, otherwise an empty array."""
    complete = F.size(v) == n
    for i in range(n):
        complete = complete & F.get(v, F.lit(i)).isNotNull()
    return F.when(complete, v).otherwise(F.array().cast("array<double>"))


def text_vector(c: Column, n: int) -> Column:
    """``fixed_vector`` for backslash-separated text."""
    parts = F.split(c, r"\\")
    numbers = F.array(*[safe_double(F.get(parts, F.lit(i))) for i in range(n)])
    return F.when(F.size(parts) == n, fixed_vector(numbers, n)).otherwise(
        F.array().cast("array<double>")
    )


def split_values(c: Column) -> Column:
    """Backslash-separated text to its non-empty parts."""
    return F.filter(F.split(blank(c), r"\\"), lambda p: p != "")


def join_values(a: Column) -> Column:
    return F.array_join(a, "\\")


def normalize_text(*parts: Column) -> Column:
    """Lower-case words separated and surrounded by single spaces."""
    joined = F.concat_ws(" ", *[blank(p) for p in parts])
    words = F.trim(F.regexp_replace(F.lower(joined), "[^a-z0-9]+", " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def has_any_token(text: Column, vocabulary: Iterable[str]) -> Column:
    """Whole-word containment in normalised text, which is made once."""
    return text.rlike(" (" + "|".join(vocabulary) + ") ")


def holds_any_token(text: Column, vocabulary: Iterable[str]) -> Column:
    """``has_any_token`` for a text that is there already: plain searches cost less than a pattern."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(f" {word} ")) for word in vocabulary])


def has_any_word(parts: Iterable[Column], vocabulary: Iterable[str]) -> Column:
    """``has_any_token`` of ``normalize_text``, which is only made for texts that hold the letters of a word. Words are
    single: a space could be any sign before."""
    parts = list(parts)
    lower = F.lower(F.concat_ws(" ", *[blank(p) for p in parts]))
    return lower.rlike("|".join(vocabulary)) & has_any_token(normalize_text(*parts), vocabulary)


def fixed_decimals(c: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, half-way digits up.

    Decimals print it at a fraction of the formatter's cost, and whole numbers at a fraction of theirs; it is left the
    values that they do not print alike: small ones, whose zero keeps its sign, very large ones and those not finite.
    """
    x = c.cast("double")
    usual = (F.abs(x) >= 10.0 ** -(digits - 1)) & (F.abs(x) < 1e9)
    whole = F.concat(x.cast("bigint").cast("string"), F.lit("." + "0" * digits))
    plain = x.cast(f"decimal({16 + digits},{digits})").cast("string")
    return F.when(usual & (F.rint(x) == x), whole).when(usual, plain).otherwise(F.format_string(f"%.{digits}f", c))


@F.pandas_udf(StringType())
def binary_rounded_4(values: pd.Series) -> pd.Series:
    """Four decimals rounded on the exact binary value, for identifiers made outside the JVM."""
    return values.map(lambda x: None if pd.isna(x) else f"{x:.4f}")


def general_8(x: Column) -> Column:
    """Eight significant digits without trailing zeros, scientific below 1e-4 and from 1e8 on."""
    scientific = F.format_string("%.7e", x)
    mantissa = F.regexp_replace(F.substring_index(scientific, "e", 1), r"\.?0+$", "")
    plain = F.regexp_replace(scientific.try_cast("decimal(38,16)").cast("string"), r"\.?0+$", "")
    size = F.abs(x)
    return (
        F.when(x.isNull(), None)
        .when(F.isnan(x), "nan")
        .when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when(x == 0, "0")
        .when((size >= 1e-4) & (size < 1e8), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), F.substring_index(scientific, "e", -1)))
    )


def progress_percent(line: Column) -> Column:
    """First ``NN%`` of a tool's output line, at most 100; null without one."""
    digits = F.regexp_extract(line, r"(?<!\d)(\d{1,3})%", 1)
    return F.when(digits != "", F.least(F.lit(100), digits.try_cast("int")))


def last_output(line: Column) -> Column:
    return F.right(strip(line), F.lit(500))


# Transfer syntaxes by decoder family.
RLE_SYNTAX = "1.2.840.10008.1.2.5"
JPEG_LS_SYNTAXES = ("1.2.840.10008.1.2.4.80", "1.2.840.10008.1.2.4.81")
JPEG_2000_SYNTAXES = (
    "1.2.840.10008.1.2.4.90",
    "1.2.840.10008.1.2.4.91",
    "1.2.840.10008.1.2.4.92",
    "1.2.840.10008.1.2.4.93",
)
JPEG_SYNTAX_PREFIX = "1.2.840.10008.1.2.4."


def decoder_route(syntax: Column) -> Column:
    return (
        F.when(syntax == RLE_SYNTAX, "dcmdrle")
        .when(syntax.isin(*JPEG_LS_SYNTAXES), "dcmdjpls")
        .when(syntax.isin(*JPEG_2000_SYNTAXES), "python-gdcm")
        .when(syntax.startswith(JPEG_SYNTAX_PREFIX), "dcmdjpeg")
        .otherwise("unsupported")
    )


def clean_ascii(c: Column, limit: int) -> Column:
    """ASCII part of the text, stripped and cut; null when nothing is left."""
    kept = strip(F.regexp_replace(c, r"[^\x00-\x7F]", ""))
    return F.nullif(F.substring(kept, 1, limit), F.lit(""))


def valid_uid(c: Column) -> Column:
    text = strip(c)
    return F.coalesce(
        (F.length(text) <= 64) & text.rlike(r"^[0-9]+(\.[0-9]+)*$"), F.lit(False)
    )
