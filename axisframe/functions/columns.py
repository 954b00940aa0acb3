"""Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the reference's for right results.
TEXT_TEMPLATE = "an object that is %s"
BASE_TEXT = "an object"
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# ---- keys and labels -------------------------------------------------------

def image_class(image_id: Column | str) -> Column:
    """Folder before the first slash, or the file name without its last extension."""
    path = F.translate(col(image_id), "\\", "/")
    return (F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1))
            .otherwise(F.regexp_replace(path, r"(?s)^(.+)\.[^.]+$", "$1")))


def words_without_number(name: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(name), r"\d+$", ""), "_", " ")


def subject_label(image_id: Column | str, by: str = "class") -> Column:
    """Readable subject of an image: from its class, its parent folder or its file stem."""
    path = F.translate(col(image_id), "\\", "/")
    if by == "class":
        return F.trim(words_without_number(image_class(image_id)))
    if by == "parent":
        folder = F.regexp_extract(path, r"(?s)^(?:.*/)?([^/]*)/[^/]*$", 1)
        return words_without_number(folder)
    if by == "stem":
        return words_without_number(F.regexp_replace(path, r"(?s)^(.*[^/.][^/]*)\.[^./]*$", "$1"))
    raise ValueError(f"unknown subject rule: {by}")


def phrase_text(phrase: Column | str) -> Column:
    return F.format_string(TEXT_TEMPLATE, col(phrase))


def strip_text(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def hash_priority(seed: int | str, *parts: Column | str, sep: str = "|") -> Column:
    """SHA-256 hex of ``seed sep part sep part``; hex order equals byte order."""
    pieces = [F.lit(str(seed))]
    for part in parts:
        pieces += [F.lit(sep), col(part).cast("string")]
    return F.sha2(F.concat(*pieces), 256)


# ---- vectors ---------------------------------------------------------------

def as_doubles(vector: Column | str) -> Column:
    return col(vector).cast("array<double>")


def dot(left: Column | str, right: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(left), col(right), lambda a, b: a * b),
                       F.lit(0.0), lambda total, value: total + value)


def squared_norm(vector: Column | str) -> Column:
    return F.aggregate(col(vector), F.lit(0.0), lambda total, value: total + value * value)


def norm(vector: Column | str) -> Column:
    return F.sqrt(squared_norm(vector))


def scale(vector: Column | str, factor: Column) -> Column:
    # The factor sits in a zipped array so that it is computed once per row, not per element.
    vector = col(vector)
    return F.zip_with(vector, F.array_repeat(factor, F.size(vector)), lambda x, f: x * f)


def l2_normalize(vector: Column | str, eps: float = 1e-8, guard: str = "max") -> Column:
    """Row divided by ``max(norm, eps)``, by ``norm + eps``, or strictly by its norm."""
    length = norm(vector)
    if guard == "max":
        length = F.greatest(length, F.lit(eps))
    elif guard == "add":
        length = length + F.lit(eps)
    elif guard == "strict":
        usable = (length > 0) & (length < F.lit(float("inf"))) & ~F.isnan(length)
        length = F.when(usable, length).otherwise(
            F.raise_error(F.lit("zero-norm or non-finite vector")).cast("double"))
    else:
        raise ValueError(f"unknown norm guard: {guard}")
    vector = col(vector)
    return F.zip_with(vector, F.array_repeat(length, F.size(vector)), lambda x, n: x / n)


def all_finite(vector: Column | str) -> Column:
    limit = F.lit(float("inf"))
    return F.forall(col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))


def clamp(value: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(value)))


# ---- arrays ----------------------------------------------------------------

def literal_array(values) -> Column:
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(value) for value in values])


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)
