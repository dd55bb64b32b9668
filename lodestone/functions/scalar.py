"""Column functions: geometry, units, parsing, labels.  All run inside the JVM."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def once(value: Column) -> Column:
    """``value`` as a column of its own select, computed once a row.

    Filters on a column that is costly to make are else moved below it, and make it
    again for each condition; they do not pass an explode.
    """
    return F.explode(F.array(value))


def vector(prefix: str = "", names: Sequence[str] = ("x", "y", "z")) -> list[Column]:
    return [F.col(prefix + n) for n in names]


def add(a: Vector, b: Vector) -> list[Column]:
    return [p + q for p, q in zip(a, b)]


def sub(a: Vector, b: Vector) -> list[Column]:
    return [p - q for p, q in zip(a, b)]


def scale(a: Vector, k) -> list[Column]:
    return [p * k for p in a]


def midpoint(a: Vector, b: Vector) -> list[Column]:
    return scale(add(a, b), 0.5)


def dot(a: Vector, b: Vector) -> Column:
    first, *rest = [p * q for p, q in zip(a, b)]
    for term in rest:
        first = first + term
    return first


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def magnitude(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> list[Column]:
    """NULL for the zero vector."""
    return [F.try_divide(p, magnitude(a)) for p in a]


def distance(a: Vector, b: Vector) -> Column:
    return magnitude(sub(a, b))


def angle(a: Vector, b: Vector, c: Vector | None = None) -> Column:
    """Degrees between two vectors, or at vertex ``b`` of three points; NULL if a side is zero."""
    u, v = (a, b) if c is None else (sub(a, b), sub(c, b))
    cos = F.try_divide(dot(u, v), magnitude(u) * magnitude(v))
    return F.when(cos.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))


def dihedral(a: Vector, b: Vector, c: Vector, d: Vector) -> Column:
    """Degrees, -180 to 180, about the axis b-c."""
    p, q, r = sub(b, a), sub(c, b), sub(d, c)
    n, m = cross(p, q), cross(q, r)
    return F.degrees(F.atan2(magnitude(q) * dot(p, m), dot(n, m)))


def log10_floor(x: Column, floor: float = 1e-3) -> Column:
    return F.log10(F.greatest(x, F.lit(floor)))


def z_score(mean: Column, native: Column, sd: Column, tiny: float = 1e-9) -> Column:
    """``(mean - native) / sd``, 0 where the deviation vanishes."""
    return F.when(sd < tiny, 0.0).otherwise(F.try_divide(mean - native, sd))


def three_way(x: Column, high: float = 0.78, low: float = -1.0, labels=("minimally_frustrated", "highly_frustrated", "neutral")) -> Column:
    """First label above ``high``, second below ``low``, else the third; NaN is neither."""
    return F.when(F.isnan(x), labels[2]).when(x > high, labels[0]).when(x < low, labels[1]).otherwise(labels[2])


#: Factors to pM (fixed values); both micro signs, since units are not upper-cased.
TO_PICOMOLAR = {"pM": 1.0, "nM": 1e3, "uM": 1e6, "µM": 1e6, "μM": 1e6, "mM": 1e9}


def lookup(key: Column, table: Mapping, default=None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def to_picomolar(value: Column, unit_name: Column, keep_unknown: bool = False) -> Column:
    """Value in pM; an unknown unit gives NULL, or the value as it is."""
    factor = lookup(unit_name, TO_PICOMOLAR)
    return F.when(factor.isNotNull(), value * factor).otherwise(value if keep_unknown else F.lit(None).cast("double"))


def inequality(text: Column) -> tuple[Column, Column]:
    """(relation, value) of texts such as ``>1000``: ``>=``, ``<=`` or ``=``; NULL if not a number."""
    relation = F.when(text.contains(">"), ">=").when(text.contains("<"), "<=").otherwise("=")
    return relation, F.trim(F.regexp_replace(text, "[><~]", "")).try_cast("double")


def slice_text(line: Column, start: int, width: int, kind: str = "string") -> Column:
    """Trimmed fixed-width field (1-based); blanks give NULL for numbers."""
    text = F.trim(F.substring(line, start, width))
    return text if kind == "string" else text.try_cast(kind)


def mutation_label(wild: Column, position: Column, mutant: Column) -> Column:
    """``L858R``, or ``pos<858>`` where a letter is not known."""
    known = wild.isNotNull() & mutant.isNotNull() & (wild != "?") & (mutant != "?")
    return F.when(known, F.concat(wild, position.cast("string"), mutant)).otherwise(F.concat(F.lit("pos<"), position.cast("string"), F.lit(">")))


def letter_at(sequence: Column, position: Column) -> Column:
    return F.when(position.between(1, F.length(sequence)), F.substring(sequence, position, F.lit(1))).otherwise("?")


def has_token(text: Column, token: str) -> Column:
    """Whole-word search that ignores case."""
    return F.upper(text).rlike("(?U)\\b\\Q" + token.upper() + "\\E\\b")


def pad_atom_name(name: Column, element: Column) -> Column:
    """Four characters: a blank before names of one-letter elements, except full-width ones."""
    return F.when((F.length(name) >= 4) | (F.length(element) > 1), F.rpad(name, 4, " ")).otherwise(F.rpad(F.concat(F.lit(" "), name), 4, " "))


def is_hydrogen_name(name: Column) -> Column:
    return F.trim(name).rlike("^[0-9]?H")


def element_of(sybyl: Column) -> Column:
    return F.upper(F.regexp_extract(sybyl, "^[^.]+", 0))


def mean_of_present(*values: Column) -> Column:
    """Mean of the values that are not NULL; NULL if none is."""
    present = F.filter(F.array(*values), lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(present, F.lit(0.0), lambda a, v: a + v), F.size(present))


def uniform_md5(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts, the same in any engine and order."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def notes(*rules: tuple[Column, str], separator: str = " | ") -> Column:
    """Texts of all rules that hold, joined."""
    return F.concat_ws(separator, *[F.when(test, F.lit(text)) for test, text in rules])
