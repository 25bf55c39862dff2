"""Dates in free text, as Column expressions.

A text is folded and cut into tokens: numbers, names of months, separators (dot, slash, hyphen) and other words. Commas, filler words and
dots that end an ordinal are dropped, so that "the 12th of May, 2026", "12. května 2026" and "12 may 2026" are the same three tokens. A date is
then told by the kinds of the tokens from a place on and by what their values can mean, not by a pattern over characters.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import unaccent

LANGUAGES = ("cs", "de", "en", "es", "fr", "it", "pl")
#: Words that may stand inside a date and mean nothing there, and endings of ordinals.
FILLERS = ("of", "de", "the", "del", "den", "st", "nd", "rd", "th", "er", "e")
#: Tokens that a date has at most: a span of two full dates.
WIDEST = 11


def month_names(languages: tuple[str, ...] = LANGUAGES) -> dict[str, int]:
    """Folded full names of the months in the given languages, inflected and not, from the JVM's locale data. Names that mean two
    months in two languages (none among LANGUAGES) are left out."""
    jvm = SparkSession.active()._jvm
    accents = str.maketrans(dict(zip(*_folding(), strict=True)))
    names: dict[str, set[int]] = {}
    for language in languages:
        locale = jvm.java.util.Locale.forLanguageTag(language)
        for style in (jvm.java.time.format.TextStyle.FULL, jvm.java.time.format.TextStyle.FULL_STANDALONE):
            for number, month in enumerate(jvm.java.time.Month.values(), 1):
                names.setdefault(month.getDisplayName(style, locale).lower().translate(accents), set()).add(number)
    return {n: m.pop() for n, m in sorted(names.items()) if len(m) == 1}


def _folding() -> tuple[str, str]:
    from larkspur.functions.text import ACCENTS, PLAIN

    return ACCENTS, PLAIN


def _bound(value, use) -> Column:
    """use(value), with the value computed once for each row, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def date_tokens(text, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """(kind, size, value) of each token: n number of `size` digits, m month, the separator itself, or w any other word."""
    names = F.create_map(*(F.lit(x) for pair in month_names(languages).items() for x in pair))
    raw = F.regexp_extract_all(unaccent(text), F.lit("[0-9]+|[a-z]+|[^a-z0-9 ]"), F.lit(0))
    raw = F.filter(raw, lambda x: ~x.isin(",", *FILLERS) & ~F.rlike(x, F.lit(r"^\s$")))
    named = F.transform(raw, lambda x: F.struct(x.alias("x"), F.try_element_at(names, x).alias("month")))

    def token(t: Column) -> Column:
        x, month = t["x"], t["month"]
        kind = F.when(F.rlike(x, F.lit("^[0-9]")), "n").when(month.isNotNull(), "m").when(x.isin(".", "/", "-"), x).when(x == "–", "-").otherwise("w")
        return F.struct(kind.alias("kind"), F.length(x).alias("size"), F.coalesce(month, F.when(F.rlike(x, F.lit("^[0-9]{1,4}$")), x.cast("int"))).alias("value"))

    following = lambda tokens, i: F.try_element_at(tokens, i + F.lit(2))["kind"]
    return _bound(F.transform(named, token), lambda tokens: F.filter(tokens, lambda x, i: ~((x["kind"] == ".") & ~following(tokens, i).eqNullSafe(F.lit("n")))))


#: Letters of a shape and what they match among the codes of tokens (see _codes): d day or month in figures, y year of four digits, x year of two, m month's name, s separator, - hyphen.
CLASSES = {"d": "[12]", "y": "4", "x": "2", "m": "m", "-": "-"}
#: What may follow a span's first day: its shape, what must not follow that, where its year stands, and whether that has two figures.
TAILS = (("dsdsy", "", 4, False), ("dsdsx", "", 4, True), ("dmy", "", 2, False), ("dm", "(?!4)", None, False), ("dtd", r"(?!\{t}[24])", None, False))


def _pattern(shape: str) -> str:
    """A shape as a pattern over codes; of two separators in a row of figures the second is the first again, t is one other than the hyphen."""
    out, groups = "^", 0
    for k, c in enumerate(shape):
        if c in "st":
            again = c == "s" and k > 1 and shape[k - 2] == "s" and shape[k - 1] == "d"
            groups += not again
        out += CLASSES[c] if c in CLASSES else f"\\{groups}" if again else "([./-])" if c == "s" else "([./])"
    return out


def _forms() -> list[tuple[str, int | None, bool, int, int]]:
    """Pattern, and the places of year (None: the given one; whether it has two figures), month and day, in the order in which they are tried."""
    forms = [(_pattern("ysdsd"), 0, False, 2, 4), (_pattern("dsdsy"), 4, False, 2, 0), (_pattern("dsdsx"), 4, True, 2, 0)]
    for head, at, month in (("dsd-", 4, 2), ("dm-", 3, 1), ("d-", 2, None)):  # 30.4.-2.5.2026, 30 April - 2 May 2026, 12-14 May 2026 and 12.-14.5.2026
        for tail, behind, year, short in TAILS:
            own = month if month is not None else at + (1 if tail[1] == "m" else 2)
            forms.append((_pattern(head + tail) + behind.format(t=1 + head.count("s")), None if year is None else at + year, short, own, 0))
    forms += [(_pattern("dmy"), 2, False, 1, 0), (_pattern("md-dy"), 4, False, 0, 1), (_pattern("mdy"), 2, False, 0, 1), (_pattern("dm"), None, False, 1, 0), (_pattern("md"), None, False, 0, 1)]
    return [*forms, (_pattern("dtd") + "(?![./-][0-9])", None, False, 2, 0)]


def _codes(tokens: Column) -> Column:
    """One character for each token: a number's size if it is 1, 2 or 4, else 0; any other token's kind."""
    return F.array_join(F.transform(tokens, lambda t: F.when(t["kind"] != "n", t["kind"]).when(t["size"].isin(1, 2, 4), t["size"].cast("string")).otherwise("0")), "")


def _day(y: Column, m: Column, d: Column) -> Column:
    """A day of the calendar, or null."""
    first = F.make_date(y, m, F.lit(1))
    return F.when(y.between(1800, 2199) & m.between(1, 12) & (d >= 1), F.when(d <= F.dayofmonth(F.last_day(first)), F.date_add(first, d - 1)))


def _at(codes: Column, values: Column, i: Column, year: Column) -> Column:
    """The date that begins at the i-th token (from 1), or null: the longest form whose kinds fit there and that is a day of the calendar."""
    value = lambda k: F.get(values, i + F.lit(k - 1))
    near = lambda k: year + F.pmod(value(k) - year + F.lit(50), F.lit(100)) - F.lit(50)  # noqa: E731  two figures: the year of that ending nearest to the given one

    def read(rest: Column) -> Column:
        read_as = [F.when(F.rlike(rest, F.lit(p)), F.struct((year if y is None else near(y) if short else value(y)).cast("int").alias("y"), value(m).alias("m"), value(d).alias("d"))) for p, y, short, m, d in _forms()]
        days = F.transform(F.filter(F.array(*read_as), lambda x: x.isNotNull()), lambda x: _day(x["y"], x["m"], x["d"]))
        return F.get(F.filter(days, lambda d: d.isNotNull()), F.lit(0))

    return _bound(F.substring(codes, i, F.lit(WIDEST)), read)


def first_date(text, year, languages: tuple[str, ...] = LANGUAGES, reach: int | None = None) -> Column:
    """The first date in a text, of those that begin within its first `reach` tokens; days come before months where both are figures.

    A date without a year is in the given one, a year of two figures is the nearest of that ending, of a span the first day counts. Null where there is
    none. `text` and `year` are columns.
    """
    tokens = date_tokens(text, languages)
    tokens = tokens if reach is None else F.slice(tokens, F.lit(1), F.lit(reach + WIDEST))

    def dates(held: Column) -> Column:
        codes, values = held["codes"], held["values"]
        places = F.length(codes) if reach is None else F.least(F.length(codes), F.lit(reach))
        begins = lambda i: F.rlike(F.substring(codes, i, F.lit(1)), F.lit("[124m]")) & ~((i > 2) & F.rlike(F.substring(codes, i - 2, F.lit(2)), F.lit("^[0-9][./-]")))  # noqa: E731  not the rest of a longer number
        return F.transform(F.filter(F.when(places > 0, F.sequence(F.lit(1), places)), begins), lambda i: _at(codes, values, i, year))

    found = _bound(_bound(tokens, lambda t: F.struct(_codes(t).alias("codes"), F.transform(t, lambda x: x["value"]).alias("values"))), dates)
    return F.get(F.filter(found, lambda d: d.isNotNull()), F.lit(0))


def date_after(text, phrases: list[str], year, reach: int = 8, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """The first date that begins within `reach` tokens behind one of the phrases (folded, whole words), which are tried in their order."""
    folded = F.concat(F.lit(" "), F.regexp_replace(unaccent(text), r"\s+", " "), F.lit(" "))
    behind = _bound(folded, lambda s: F.concat(*(F.filter(F.split(s, rf"(?<![a-z0-9])\Q{p}\E(?![a-z0-9])"), lambda _, i: i > 0) for p in phrases)))
    return F.get(F.filter(F.transform(behind, lambda rest: first_date(rest, year, languages, reach)), lambda d: d.isNotNull()), F.lit(0))
