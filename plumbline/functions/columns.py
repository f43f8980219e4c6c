"""Column expressions that several operators share. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}_'-]+"
#: How missing values are written, in lower case.
SENTINELS = ["", "?", "-", "--", "na", "n/a", "n.a.", "n\\a", "nan", "nil", "none", "null", "unk", "unknown", "missing", "void", "undefined", "not available", "not applicable", "#na", "#n/a", "#n/a n/a", "<na>", "<null>", "(null)"]
#: Numbers that often stand for a missing value.
NUMERIC_SENTINELS = [-9999, -999, -99, -9, -1, 9999, 99999]
#: What UTF-8 looks like once it has been read as another encoding, or the other way round.
MOJIBAKE = ["\ufffd", "Ã¢", "Ã©", "Ã¨", "Ã¯", "Ã¼", "Ã¶", "Ã±", "â€™", "â€œ", "â€\x9d", "â€“", "Ð¾", "Ð°", "Ñ\x80", "ï»¿"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value, or null where it is NaN or infinite."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def collapse(c: Column | str) -> Column:
    """All runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def normal_label(c: Column | str) -> Column:
    return F.lower(collapse(c))


def tokens(c: Column | str, lowercase: bool = True) -> Column:
    c = col(c)
    return F.regexp_extract_all(F.lower(c) if lowercase else c, F.lit(f"({WORDS})"), F.lit(1))


def slug(c: Column | str, most: int = 80, otherwise: str = "case") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, most), F.lit("")), F.lit(otherwise))


def is_kebab(c: Column | str, most: int = 64) -> Column:
    c = col(c)
    return F.coalesce(c.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$") & (F.length(c) <= most), F.lit(False))


def multi_value(c: Column | str) -> Column:
    """The items of a list written in a cell: one bracket off each end, parted at ; , or |, trimmed, lower case, none empty. Null gives an empty list."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"^[\(\[\{]", ""), r"[\)\]\}]$", "")
    items = F.transform(F.split(bare, r"[;,|]"), lambda x: F.lower(F.trim(x)))
    return F.coalesce(F.filter(items, lambda x: x != ""), F.array().cast("array<string>"))


def ratio(num: Column | str, den: Column | str, eps: float = 1e-9) -> Column:
    """num / den, with eps for a denominator that is zero or missing."""
    return col(num) / F.coalesce(F.nullif(col(den).cast("double"), F.lit(0.0)), F.lit(eps))


def signed_log(c: Column | str) -> Column:
    c = col(c)
    return F.signum(c) * F.log1p(F.abs(c))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where either vector is zero; an error where their lengths differ."""
    same = F.when(F.size(col(a)) != F.size(col(b)), F.raise_error(F.lit("vectors of different length")).cast("double"))
    n = norm(a) * norm(b)
    return F.coalesce(same, F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def chunk_windows(words: Column | str, size: int, overlap: int) -> Column:
    """Windows of `size` items that share `overlap` with the one before; the last is the first to reach the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the size")
    w, stride = col(words), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - overlap - 1, F.lit(0)), F.lit(stride))
    return F.when(F.size(w) > 0, F.transform(starts, lambda s: F.slice(w, s + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def case_ladder(steps: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds; a null condition doesn't hold."""
    first, *rest = steps
    return reduce(lambda c, s: c.when(s[0], F.lit(s[1])), rest, F.when(first[0], F.lit(first[1]))).otherwise(F.lit(otherwise))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function to 1.2e-7, by a rational approximation of the error function in Horner form."""
    x = F.abs(z) / F.lit(2**0.5)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    for k in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = poly * t + k
    tail = t * F.exp(-x * x - 1.26551223 + t * poly) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def fixed_text(c: Column | str, digits: int) -> Column:
    """A double with so many digits after the point, as C's printf rounds: by the exact binary value, halves to even. Java's formatter rounds halves up, and by the shortest decimal text."""
    x = F.abs(col(c))
    scale = 10**digits
    n = F.floor(x * scale)
    # twice the distance from the middle of n and n + 1: both parts of x have few enough bits for exact products
    high = x.cast("float").cast("double")
    off = (high * (2 * scale) - (n * 2 + 1)) + (x - high) * (2 * scale)
    up = (off > 0) | ((off == 0) & (n % 2 == 1))
    near = F.when(x * scale < 2.0**50, (n + up.cast("long")) / scale).otherwise(x)
    return F.when(x.isNotNull(), F.concat(F.when(col(c) < 0, "-").otherwise(""), F.format_string(f"%.{digits}f", near)))
