"""What a record is, settled from several untidy statements of it: lists of kinds, ages, names, states, gates. All are column expressions on the rows as they
are; only groups of siblings need a shuffle."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import fold, unaccent

NO_NAMES = "array<string>"


def names(values) -> Column:
    return F.array(*map(F.lit, values)).cast(NO_NAMES)


def first_of(checks: dict[str, Column], otherwise: str) -> Column:
    """The name of the first condition that holds; an unknown condition doesn't hold."""
    return F.coalesce(*(F.when(c, F.lit(n)) for n, c in checks.items()), F.lit(otherwise))


@dataclass(frozen=True)
class Kinds:
    """A vocabulary of kinds. family: each known kind's family. same: other spellings. doubtful: kinds that a word may have brought in by mistake, each with the
    families beside which it goes and the kinds that keep it. strong: families that lead a mixed list, in this order, each with the kinds that
    make it lead (none: any of its kinds)."""

    family: dict[str, str]
    same: dict[str, str] = field(default_factory=dict)
    doubtful: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict)
    strong: tuple[tuple[str, tuple[str, ...]], ...] = ()


def canonical_kinds(rows: DataFrame, values: str, kinds: Kinds) -> DataFrame:
    """rows with kinds and leading: the known kinds of a list under one spelling each, doubtful ones taken out, those of the leading family first and otherwise in
    the order stated; other spellings must lead to a known kind. The leading family is the only one, else the first strong one, else that of the first kind; null without kinds."""
    spelt = {**{k: k for k in kinds.family}, **kinds.same}
    known = F.create_map(*(x for w, k in spelt.items() for x in (F.lit(w), F.struct(F.lit(k).alias("v"), F.lit(kinds.family[k]).alias("f")))))
    looked_up = F.transform(F.col(values), lambda v: F.try_element_at(known, F.lower(F.trim(v))))
    none = F.array().cast("array<struct<v: string, f: string>>")
    rows = rows.withColumn("_k", F.coalesce(F.array_distinct(F.array_compact(looked_up)), none))
    kept = F.col("_k")
    for kind, (beside, keep) in kinds.doubtful.items():
        void = F.arrays_overlap(F.col("_k.f"), names(beside)) & ~F.arrays_overlap(F.col("_k.v"), names(keep))
        kept = F.when(void & F.array_contains("_k.v", kind), F.array_remove(kept, F.struct(F.lit(kind).alias("v"), F.lit(kinds.family[kind]).alias("f")))).otherwise(kept)
    rows = rows.withColumn("_k", kept)
    strong = [F.when(F.array_contains("_k.f", f) & (F.arrays_overlap(F.col("_k.v"), names(by)) if by else F.lit(True)), F.lit(f)) for f, by in kinds.strong]
    first = F.get("_k.f", F.lit(0))
    rows = rows.withColumn("leading", F.when(F.size(F.array_distinct("_k.f")) == 1, first).otherwise(F.coalesce(*strong, first)))
    of = lambda same: F.filter("_k", lambda k: (k["f"] == F.col("leading")) == F.lit(same))
    mixed = F.size(F.array_distinct("_k.f")) > 1
    ordered = F.when(mixed, F.concat(of(True), of(False))).otherwise(F.col("_k"))
    return rows.withColumn("_k", ordered).withColumn("kinds", F.col("_k.v")).drop("_k")


@dataclass(frozen=True)
class AgeWords:
    """Folded words that a category's text uses around years and ages. Other languages are other instances."""

    older: tuple[str, ...] = ("older", "earlier", "before", "alter", "frueher", "starsi", "starsie", "starszy", "avant")
    younger: tuple[str, ...] = ("younger", "later", "after", "junger", "spater", "mladsi", "mladsie", "mlodszy", "apres")
    most: tuple[str, ...] = ("to", "under", "below", "until", "bis", "unter", "do", "jusqu", "max")
    least: tuple[str, ...] = ("from", "over", "above", "plus", "more", "ab", "uber", "od", "nad", "vice", "des", "min")
    unit: tuple[str, ...] = ("years", "year", "yrs", "jahre", "jahr", "let", "lat", "rokov", "ans")
    group: tuple[str, ...] = ("u", "mu", "wu")


def with_birth_years(rows: DataFrame, text: str, season: str, label: Column | None = None, words: AgeWords = AgeWords()) -> DataFrame:
    """rows with born_from and born_to, the birth years that a category's text admits (null: open; both null: it says nothing, or contradicts itself).

    The text is a row of numbers, words and marks. Years of birth: two are a span, one with a word or mark for older or younger is open on that side,
    one by itself is that year, unless the text is a `label`, where a lone year may be the edition. Ages, counted from the season: two are a span; one is a
    bound with a word or mark for it, or one year with a word for years; U13 is the two years below the number. Years and ages together,
    more than two numbers, numbers of other sizes and ages outside 1 to 99 say nothing.
    """
    parts = F.regexp_extract_all(unaccent(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[a-z]+|[0-9]+|<=|>=|[<>+]"), 0)
    rows = rows.withColumn("_t", parts).withColumn("_n", F.transform(F.filter("_t", lambda x: x.rlike("^[0-9]{1,9}$")), lambda x: x.cast("int")))
    n, t = F.col("_n"), F.col("_t")
    said = lambda *w: F.arrays_overlap(t, names(w))
    year = lambda v: v.between(1900, 2099)
    rows = rows.withColumns({
        "_years": F.forall("_n", year) & (F.size(t) > 0), "_ages": F.forall("_n", lambda v: v.between(1, 99)), "_lo": F.array_min("_n"), "_hi": F.array_max("_n"),
        "_older": said(*words.older, "<", "<="), "_younger": said(*words.younger, ">", ">="), "_most": said(*words.most, "<", "<="), "_least": said(*words.least, ">", ">=", "+"),
        "_unit": said(*words.unit), "_group": said(*words.group), "_count": F.size(F.filter("_t", lambda x: x.rlike("^[0-9]+$"))),
    })
    one, two = F.col("_count") == 1, F.col("_count") == 2
    lo, hi, s = F.col("_lo"), F.col("_hi"), F.col(season)
    edition = F.coalesce(label, F.lit(False)) if label is not None else F.lit(False)
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    open_ = F.lit(None)
    of_years = F.when(two, span(lo, hi)).when(one & F.col("_older") & F.col("_younger"), span(open_, open_)).when(one & F.col("_older"), span(open_, lo)).when(one & F.col("_younger"), span(lo, open_)).when(one & ~edition, span(lo, lo))
    in_order = F.get("_n", F.lit(0)) <= F.get("_n", F.lit(1))
    of_ages = (
        F.when(one & F.col("_group") & (lo > 2), span(s - lo + 1, s - lo + 2)).when(two & ~F.col("_group") & in_order, span(s - hi, s - lo))
        .when(one & F.col("_most") & F.col("_least"), span(open_, open_)).when(one & ~F.col("_group") & F.col("_most"), span(s - lo, open_)).when(one & ~F.col("_group") & F.col("_least"), span(open_, s - lo))
        .when(one & ~F.col("_group") & F.col("_unit"), span(s - lo, s - lo))
    )
    born = F.when(F.col("_years"), of_years).when(F.col("_ages"), of_ages)
    helpers = ["_t", "_n", "_years", "_ages", "_lo", "_hi", "_older", "_younger", "_most", "_least", "_unit", "_group", "_count", "_born"]
    return rows.withColumn("_born", born).withColumns({"born_from": F.col("_born.a"), "born_to": F.col("_born.b")}).drop(*helpers)


def admitted_years(born_from: Column, born_to: Column, first: int = 1900, last: int = 2099) -> Column:
    """Each birth year of an admitted span, open sides up to first and last: riders then meet categories by an equi-join. Empty where nothing is said."""
    a, b = F.greatest(F.coalesce(born_from, F.lit(first)), F.lit(first)), F.least(F.coalesce(born_to, F.lit(last)), F.lit(last))
    return F.when((born_from.isNotNull() | born_to.isNotNull()) & (a <= b), F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def match_rank(stated: Column, confidence: Column, wanted: list[str], wider: dict[str, list[str]]) -> Column:
    """How well a record's stated classes meet those wanted: 0 an explicit statement holds one, 1 the previous edition's does, 2 another statement does or any names a wider
    class, 3 nothing is stated, 4 others are. wider: for each wanted class those that include it."""
    classes = F.coalesce(stated, names(()))
    hit = F.arrays_overlap(classes, names(wanted))
    near = hit | F.arrays_overlap(classes, names(w for k in wanted for w in wider.get(k, ())))
    return F.when(F.size(classes) == 0, 3).when(hit & (confidence == "explicit"), 0).when(hit & (confidence == "previous"), 1).when(near, 2).otherwise(4)


@dataclass(frozen=True)
class Sign:
    """Folded words, beginnings of words and runs of words, any of which is a sign."""

    words: tuple[str, ...] = ()
    stems: tuple[str, ...] = ()
    runs: tuple[str, ...] = ()


def gated_texts(rows: DataFrame, text: str, signs: list[tuple[str, Sign]], otherwise: str, out: str = "gate") -> DataFrame:
    """rows with the answer of the first sign that a text has; a text without any has `otherwise`. Each text is folded once."""
    rows = rows.withColumn("_p", F.concat(F.lit(" "), fold(F.coalesce(F.col(text), F.lit(""))), F.lit(" ")))

    def seen(s: Sign) -> Column:
        ways = [f"(?:{'|'.join(s.stems)})"] if s.stems else []
        ways += [f"(?:{'|'.join((*s.words, *s.runs))}) "] if s.words or s.runs else []
        return F.col("_p").rlike(" (?:" + "|".join(ways) + ")") if ways else F.lit(False)

    answer = F.coalesce(*(F.when(seen(s), F.lit(a)) for a, s in signs), F.lit(otherwise))
    return rows.withColumn(out, answer).drop("_p")


def assessed(rows: DataFrame, checks: dict[str, Column], out_of_scope: tuple[str, ...], tentative: str) -> DataFrame:
    """rows with issues (the checks that hold, in their order), state (out_of_scope, needs_review or, without an issue, ready) and date_status."""
    issues = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))
    rows = rows.withColumn("issues", issues)
    state = F.when(F.arrays_overlap("issues", names(out_of_scope)), "out_of_scope").when(F.size("issues") > 0, "needs_review").otherwise("ready")
    return rows.withColumns({"state": state, "date_status": F.when(F.array_contains("issues", tentative), "tentative").otherwise("requires_verification")})


def source_state(state: Column, error: Column, failing: tuple[str, ...], rules: list[tuple[str, str]], silent: str, otherwise: str = "broken") -> Column:
    """ok unless the state is a failing one; then the outcome of the first pattern found in the error, 'review' where state `silent` comes without one, else `otherwise`."""
    text = F.coalesce(error, F.lit(""))
    found = {outcome: text.rlike(pattern) for outcome, pattern in rules}
    found["review"] = found.get("review", F.lit(False)) | ((state == silent) & error.isNull())
    return F.when(~F.coalesce(state, F.lit("")).isin(*failing), "ok").otherwise(first_of(found, otherwise))


def identity(rows: DataFrame, text: str, aliases: list[tuple[str, str]], dropped: list[str], out: str = "identity") -> DataFrame:
    """rows with a name's identity: the tokens of the aliases it holds, in the aliases' order, then what is left of the lower-cased, unaccented name once these and the dropped
    patterns are gone, each from what the one before left. Null gives an empty one."""
    rows = rows.withColumns({"_s": unaccent(F.coalesce(F.col(text), F.lit(""))), "_a": names(())})
    for pattern, token in aliases:
        rows = rows.withColumns({"_a": F.when(F.col("_s").rlike(pattern), F.array_append("_a", F.lit(token))).otherwise(F.col("_a")), "_s": F.regexp_replace("_s", pattern, " ")})
    left = F.col("_s")
    for pattern in dropped:
        left = F.regexp_replace(left, pattern, " ")
    left = F.trim(F.regexp_replace(left, "[^a-z0-9]+", " "))
    return rows.withColumn(out, F.trim(F.concat_ws(" ", F.array_join("_a", " "), left))).drop("_s", "_a")


def siblings(rows: DataFrame, by: str, key: str, most: int = 20) -> DataFrame:
    """rows whose group has two to `most` rows, with the keys of the others in order. Groups are counted first, so none beyond `most` is ever gathered; null
    is no group."""
    small = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col(by).isNotNull() & F.col("_n").between(2, most)).drop("_n")
    held = rows.join(small, by).groupBy(by).agg(F.array_sort(F.collect_list(key)).alias("_all"))
    return rows.join(held, by).withColumn("others", F.filter("_all", lambda k: k != F.col(key))).drop("_all")
