"""Column -> Column functions. Nothing here triggers a job or leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadstats import schema as S

# Blank and every control character below it.
_BLANKS = "".join(chr(i) for i in range(33))

# Day, month, year and, if complete, hour, minute, second, with blanks before
# each. Leading zeros aside, the digits are as many as cannot overflow a
# timestamp together.
_WHEN = (
    r"^\s*(0*\d{1,7}/[ \t]*0*\d{1,5}/[ \t]*0*\d{1,5}(?!\d)"
    r"(?: [ \t]*0*\d{1,9}:[ \t]*0*\d{1,9}:[ \t]*0*\d{1,9}(?!\d))?)"
)

# Signed digits that may be an integer.
_YEAR = r"^[+-]?0*\d{1,10}$"
_INT = 2147483647


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_trim(c: Column | str) -> Column:
    """Strip blanks and control characters on both sides (plain ``trim`` strips blanks only).

    A text that begins and ends with a printable character, nearly every one, is
    left alone after two cheap comparisons.
    """
    text = _col(c)
    padded = (text < F.lit("!")) | (F.right(text, F.lit(1)) < F.lit("!"))
    return F.when(padded, F.btrim(text, F.lit(_BLANKS))).otherwise(text)


def is_filled(c: Column | str) -> Column:
    """True for a value that is neither null nor empty."""
    return _col(c) != F.lit("")


def entity_key(c: Column | str) -> Column:
    """The protocol number as text, whatever type the source stored it in."""
    return _col(c).cast("string")


def birth_year(c: Column | str) -> Column:
    """Birth year as an integer; other text, or one beyond the integers, gives NULL.

    The digits are taken out first, which gives NULL for any other text: a
    failing ``try_cast`` raises and catches an exception for each row, which is
    slow where many are blank.
    """
    digits = F.regexp_extract_all(_col(c), F.lit(_YEAR), F.lit(0))
    year = F.get(digits, F.lit(0)).cast("long")
    return F.when(year.between(-_INT - 1, _INT), year.cast("int"))


def _band(steps: list[Column], labels: list[str]) -> Column:
    """The label after as many ``steps`` as hold. All of them are evaluated, so
    what they have in common is computed once."""
    passed = steps[0].cast("int")
    for step in steps[1:]:
        passed = passed + step.cast("int")
    return F.get(F.array(*[F.lit(label) for label in labels]), passed)


def age_band(year: Column | str, reference_year: int = S.REFERENCE_YEAR) -> Column:
    """Age band of a birth year (integer). Compares years, so no value overflows."""
    steps = [_col(year) <= reference_year - upper for upper, _ in S.AGE_BANDS]
    labels = [label for _, label in S.AGE_BANDS] + [S.AGE_BAND_UNKNOWN]
    return F.coalesce(_band(steps, labels), F.lit(S.AGE_BAND_UNKNOWN))


def driver_age_band(
    person_type: Column | str, year: Column | str, reference_year: int = S.REFERENCE_YEAR
) -> Column:
    """Age band of drivers; everybody else is unidentified."""
    unknown = F.lit(S.AGE_BAND_UNKNOWN)
    # Picked from an array, not by a condition: Spark shares repeated parts of an
    # expression only where they are always evaluated.
    choices = F.array(unknown, age_band(year, reference_year))
    return F.coalesce(F.get(choices, (_col(person_type) == S.DRIVER).cast("int")), unknown)


def parse_when(c: Column | str) -> Column:
    """Lenient ``dd/MM/yyyy[ HH:mm:ss]`` as ``struct(ts timestamp_ntz, has_time boolean)``.

    Fields out of range roll over (32/01 is 1 February, 24:00:00 the next
    midnight) and trailing text is ignored. Unreadable text gives a NULL ``ts``.
    """
    # NULL without a match, so that no empty text is cast. There is no condition
    # in it, hence Spark splits each text once for all fields.
    found = F.get(F.regexp_extract_all(_col(c), F.lit(_WHEN), F.lit(1)), F.lit(0))
    part = F.split(found, r"[/: ][ \t]*")

    def number(i: int) -> Column:
        return F.get(part, F.lit(i)).cast("int")

    def clock(i: int) -> Column:
        return F.coalesce(number(i), F.lit(0))

    ts = (
        F.make_timestamp_ntz(number(2), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        + F.make_ym_interval(F.lit(0), number(1) - 1)
        + F.make_dt_interval(number(0) - 1, clock(3), clock(4), clock(5))
    )
    has_time = F.coalesce(F.size(part) == 6, F.lit(False))
    return F.struct(ts.alias("ts"), has_time.alias("has_time"))


def weekday_label(ts: Column | str) -> Column:
    """Weekday of a timestamp; NULL is unknown."""
    names = F.array(*[F.lit(d) for d in S.WEEKDAYS])
    return F.coalesce(F.get(names, F.dayofweek(_col(ts)) - 1), F.lit(S.WEEKDAY_UNKNOWN))


def time_band(ts: Column | str, has_time: Column | str) -> Column:
    """Time band of a timestamp; without a time part it is unknown."""
    hour = F.when(_col(has_time), F.hour(_col(ts)))
    band = _band([hour >= upper for upper, _ in S.TIME_BANDS], [label for _, label in S.TIME_BANDS])
    return F.coalesce(band, F.lit(S.TIME_BAND_UNKNOWN))


def paving_class(c: Column | str) -> Column:
    """Paving class of a raw label; NULL for any other label."""
    out = None
    for name, labels in S.PAVING_CLASSES.items():
        hit = _col(c).isin(labels)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def paving_class_or_upper(c: Column | str) -> Column:
    """Paving class of a raw label; any other label in upper case."""
    return F.coalesce(paving_class(c), F.upper(_col(c)))
