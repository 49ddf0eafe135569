"""Column functions that repair raw JSON lines and read file names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadstats import schema as S
from roadstats.functions.scalars import java_trim

# Fixed patterns. A value with one or two stray quotes, which may hold commas:
FEW_QUOTES = r':"([^"]*"(?:[^"]*")?[^"]*)"[,}]'
# A value without comma or brace with any number of stray quotes. A quote that is
# not followed by a comma or brace cannot end the value, hence no backtracking.
MANY_QUOTES = r':"([^"},]*+(?:"(?![,}])[^"},]*+)++)"[,}]'

# The first pattern with the pieces between the quotes as groups; it matches the same places.
_FEW_PIECES = r':"([^"]*+)"(?:([^"]*+)")?([^"]*+)"([,}])'

# Values that are each the start of the next one. The first pattern takes such a
# chain in from its end, one value a round; this one takes it at once.
_CHAIN = r':"[^"]*+(?:":"[^"]*+)++"[,}]'

# Up to so many values a line is taken apart one by one, beyond it at once; the result is the same.
_FEW_VALUES = 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_stray_quotes(line: Column | str, pattern: str) -> Column:
    """Delete the quotes inside every value that ``pattern`` finds, until none is left.

    A round takes the line apart at the values found and joins it again; values with
    one or two quotes are replaced by their pieces at once. One round does for nearly
    every line; a line that still matches gets further ones, each of which removes a
    quote, until nothing matches.
    """
    start = F.col(line) if isinstance(line, str) else line
    if pattern == FEW_QUOTES:
        return let(_few_round(start), _few_rest)
    one_round, to_the_end = _rounds(pattern)

    def first(found: Column) -> Column:
        # One search tells whether there is anything to do, and what.
        return F.when(F.size(found) > 0, let(one_round(start, found=found), to_the_end)).otherwise(start)

    return let(F.regexp_extract_all(start, F.lit(pattern), F.lit(0)), first)


def _few_round(x: Column) -> Column:
    return F.regexp_replace(x, _FEW_PIECES, ':"$1$2$3"$4')


def _few_rest(x: Column) -> Column:
    """What the first pattern still finds after one round, which few lines have."""
    one_round, to_the_end = _rounds(FEW_QUOTES)
    return F.when(x.rlike(FEW_QUOTES), let(one_round(x, _CHAIN), to_the_end)).otherwise(x)


def _rounds(pattern: str) -> tuple[Callable[..., Column], Callable[[Column], Column]]:
    """One round of a pattern, and as many as it takes until it finds nothing."""

    def values(x: Column, pattern: str = pattern) -> Column:
        return F.regexp_extract_all(x, F.lit(pattern), F.lit(0))

    def one_round(x: Column, pattern: str = pattern, found: Column | None = None) -> Column:
        def plain(found: Column) -> Column:
            inner = F.substring(found, F.lit(3), F.length(found) - 4)
            return F.concat(F.lit(':"'), F.replace(inner, F.lit('"'), F.lit("")), F.right(found, F.lit(2)))

        def joined(found: Column) -> Column:
            between = F.split(x, pattern)
            none = F.lit("")
            pairs = F.zip_with(
                between,
                F.transform(found, plain),
                lambda a, b: F.concat(F.coalesce(a, none), F.coalesce(b, none)),
            )
            return F.array_join(pairs, "")

        def in_turn(found: Column) -> Column:
            # What was found first is also the first place that holds its text.
            def take(state: Column, value: Column) -> Column:
                def cut(at: Column) -> Column:
                    before = F.left(state["rest"], at - 1)
                    after = F.substring(state["rest"], at + F.length(value), F.length(state["rest"]))
                    return F.struct(F.concat(state["done"], before, plain(value)).alias("done"), after.alias("rest"))

                return let(F.instr(state["rest"], value), cut)

            start = F.struct(F.lit("").alias("done"), x.alias("rest"))
            return F.aggregate(found, start, take, lambda s: F.concat(s["done"], s["rest"]))

        # A split compiles its pattern for every line, so the few values of a usual line are taken one after the other.
        found = values(x, pattern) if found is None else found
        return let(found, lambda v: F.when(F.size(v) <= _FEW_VALUES, in_turn(v)).otherwise(joined(v)))

    def to_the_end(x: Column) -> Column:
        quotes = F.length(x) - F.length(F.replace(x, F.lit('"'), F.lit("")))

        def go_on(state: Column, _: Column) -> Column:
            again = F.struct(one_round(state["x"]).alias("x"))
            more = let(again, lambda s: F.struct(s["x"].alias("x"), s["x"].rlike(pattern).alias("open")))
            return F.when(state["open"], more).otherwise(state)

        start = F.struct(x.alias("x"), x.rlike(pattern).alias("open"))
        ended = F.aggregate(F.sequence(F.lit(1), quotes), start, go_on, lambda s: s["x"])
        return F.when(x.rlike(pattern), ended).otherwise(x)

    return one_round, to_the_end


def normalise_line(line: Column | str) -> Column:
    """Without backslashes and outer blanks, and without the comma that ends an array element."""
    plain = F.replace(F.col(line) if isinstance(line, str) else line, F.lit("\\"), F.lit(""))

    def drop_comma(x: Column) -> Column:
        return F.when(F.endswith(x, F.lit("},")), F.left(x, F.length(x) - 1)).otherwise(x)

    return let(let(plain, java_trim), drop_comma)


def repair_line(line: Column | str) -> Column:
    """Both quote repairs and the normalisation; a valid record line keeps its content."""
    start = F.col(line) if isinstance(line, str) else line

    def both(x: Column) -> Column:
        # One search tells of nearly every line that nothing is left to do.
        left = let(_few_rest(x), lambda y: strip_stray_quotes(y, MANY_QUOTES))
        return F.when(x.rlike(f"{FEW_QUOTES}|{MANY_QUOTES}"), left).otherwise(x)

    return normalise_line(let(_few_round(start), both))


def is_record_line(line: Column | str) -> Column:
    """True for lines that hold a record; array wrappers have no identifier."""
    return F.contains(F.col(line) if isinstance(line, str) else line, F.lit("ID"))


def is_raw_file(path: Column | str) -> Column:
    """True if the text after the last dot of the path contains json or txt."""
    last = F.substring_index(F.col(path) if isinstance(path, str) else path, ".", -1)
    return F.contains(last, F.lit("json")) | F.contains(last, F.lit("txt"))


def file_entity(path: Column | str) -> Column:
    """Entity named in the base name of a file, NULL if there is none."""
    p = F.col(path) if isinstance(path, str) else path
    name = F.lower(F.substring_index(p, "/", -1))
    out = None
    for entity in S.FILE_ENTITIES:
        hit = F.contains(name, F.lit(entity))
        out = F.when(hit, entity) if out is None else out.when(hit, entity)
    return out


def file_period(path: Column | str) -> Column:
    """Parent folder name after its first underscore, NULL if it has none."""
    p = F.col(path) if isinstance(path, str) else path
    # Path functions run on every line: no pattern is searched for in them.
    last = F.substring_index(p, "/", -2)
    folder = F.substring_index(last, "/", 1)
    at = F.instr(folder, "_")
    named = (F.length(last) < F.length(p)) & (at > 0) & (at < F.length(folder))
    return F.when(named, F.substring(folder, at + 1, F.length(folder)))
