"""Tasks in notes, and the dates that recurring ones fall on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import kept
from ..functions.text import day_of, iso_date, let, once, without
from .markdown import ANCHOR, KEPT_CODE, LINK, TAG, shown_text, task_items

#: Fields that a task gives a meaning to, and those that no check calls unknown.
KNOWN_FIELDS = ("scheduled", "due", "completed", "depends", "repeat", "repeatFrom", "area", "project")
ALLOWED_FIELDS = (*KNOWN_FIELDS, "person", "source", "priority")
DATE_FIELDS = ("scheduled", "due", "completed")

#: Fixed words of repeats, and the forms that are read: a number or 'other', a unit or days or a month; days of the week, of the month, or an ordinal one; and an end.
DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ORDINALS = {"first": 1, "second": 2, "third": 3, "last": -1}
_AND = r"(?:\s*,\s*(?:and\s+)?|\s+and\s+)"
_DAY = rf"(?:{'|'.join(DAYS)})"
_DAY_LIST = rf"{_DAY}(?:{_AND}{_DAY})*"
_NTH = rf"(?:\d+(?:st|nd|rd|th)|{'|'.join(ORDINALS)})"
_NTH_DAY = rf"({_NTH})(\s+last)?\s+({_DAY})s?"
_ON = rf"(?:the\s+)?(?:{_NTH}(?:\s+last)?\s+{_DAY}s?|{_DAY}s?|{_NTH}(?:\s+last)?(?:\s+days?)?)"
REPEAT = (
    rf"^every\s+(?:(\d+|other|second|third)\s+)?(day|weekday|week|month|year|{_DAY_LIST}|{'|'.join(MONTHS)})s?"
    rf"(?:\s+on\s+({_ON}(?:{_AND}{_ON})*))?(?:\s+for\s+(\d+)(?:\s+times?)?|\s+until\s+(.+))?$"
)
#: How the day is written that a repeat ends on.
UNTIL = ("yyyy-MM-dd", "MMMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy")


@once
def _fields() -> Column:
    """The fields of a task's line: keys and values where they are plain, else by their places."""

    def pair(s, i):
        cut = lambda a, b: F.trim(F.substring("text", s[a] + 1, s[b] - s[a]))
        return F.struct(cut("key_start", "key_end").alias("k"), cut("value_start", "value_end").alias("v"), i.alias("i"))

    def last_of_each(pairs):
        kept_ = F.filter(pairs, lambda p: (p["k"] != "") & ~F.exists(pairs, lambda q: (q["k"] == p["k"]) & (q["i"] > p["i"])))
        return F.map_from_entries(F.transform(kept_, lambda p: F.struct(p["k"], p["v"])))

    pairs = F.transform(F.arrays_zip(F.col("keys").alias("k"), F.col("values").alias("v")), lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i")))
    apart = F.size(F.array_distinct("keys")) == F.size("keys")
    return F.when(F.col("keys").isNull(), let(F.transform("spans", pair), last_of_each)).when(apart, F.map_from_arrays("keys", "values")).otherwise(let(pairs, last_of_each))


def tasks(notes: DataFrame) -> DataFrame:
    """Checkbox items with #task on their line.

    (path, line, done, text, tags, fields, unknown_fields, scheduled, due, completed, depends, repeat, repeatFrom, area,
    project).  Dates are promoted only if they are valid; of repeated fields the last counts.
    """
    d = kept(task_items(notes).withColumnRenamed("source", "text"), fields=_fields()).drop("keys", "values")
    # No fields are left in the bare text, so it shows what its own marks say.  Each step is a column, which goes where no text is asked for.
    d = d.withColumn("bare_", F.coalesce("free", without(F.col("text"), F.col("spans"), lambda s: F.lit(""))))
    marks = rf"(?=[!\[^#])(?:({LINK})|{ANCHOR}|{TAG})"
    clean = F.when(F.contains("bare_", F.lit("`")), F.regexp_replace("bare_", rf"{KEPT_CODE}|{marks}", "$1$3")).when(F.col("bare_").rlike(r"[#^\[]"), F.regexp_replace("bare_", marks, "$1"))
    d = d.withColumn("clean_", clean.otherwise(F.col("bare_")))
    shown = F.when(F.col("clean_").rlike(r"[`*_~\[]"), shown_text(F.col("clean_"), F.lit(""))).otherwise(F.col("clean_"))
    return d.select(
        "path", "line", F.col("checked").alias("done"), F.trim(F.regexp_replace(shown, r"\s+", " ")).alias("text"), "tags", "fields",
        F.map_filter("fields", lambda k, v: ~k.isin(*KNOWN_FIELDS)).alias("unknown_fields"),
        *[iso_date(F.try_element_at("fields", F.lit(k))).alias(k) for k in DATE_FIELDS],
        *[F.try_element_at("fields", F.lit(k)).alias(k) for k in KNOWN_FIELDS if k not in DATE_FIELDS],
    )


def _ordinal(word: Column, last: Column) -> Column:
    """The number of an ordinal; one that counts from the end is negative."""
    n = F.coalesce(*[F.when(word == w, k) for w, k in ORDINALS.items()], F.regexp_extract(word, r"\d+", 0).try_cast("int"))
    return F.when((F.trim(last) == "last") & (n > 0), -n).otherwise(n)


def _end(text: Column) -> Column:
    """The day that a repeat's text names as its end; null where it names none that can be read."""
    written = F.initcap(F.trim(F.regexp_extract(text, REPEAT, 5)))
    return F.when(written != "", F.coalesce(*[F.try_to_date(written, u) for u in UNTIL]))


def _rule(repeat: Column) -> Column:
    """What a repeat says: struct<n, unit, days, nths, month, ordinals, count, end>; unit is empty where it can't be read, month is 0 for none.

    nths are days of the month, negative ones from its end; ordinals are (n, day) of the n-th such day of the month or year.
    """
    text = F.lower(F.trim(repeat))
    number, word, on = (F.regexp_extract(text, REPEAT, k) for k in (1, 2, 3))
    n = F.when(number == "", 1).when(number.isin("other", "second"), 2).when(number == "third", 3).otherwise(F.coalesce(number.try_cast("int"), F.lit(0)))
    named, month = word.rlike(f"^{_DAY_LIST}$"), F.array_position(F.array(*map(F.lit, MONTHS)), word).cast("int")
    unit = F.when(n == 0, "").when(named, "week").when(month > 0, "year").otherwise(word)
    parts = lambda rx, k, x: F.regexp_extract_all(x, F.lit(rx), F.lit(k))
    found = F.arrays_zip(parts(_NTH_DAY, 1, on).alias("word"), parts(_NTH_DAY, 2, on).alias("last"), parts(_NTH_DAY, 3, on).alias("day"))
    # Weekdays count from Monday, 0.
    ordinals = F.transform(found, lambda x: F.struct(_ordinal(x["word"], x["last"]).alias("n"), ((F.array_position(F.array(*map(F.lit, DAYS)), x["day"]) + 5) % 7).cast("int").alias("day")))
    rest = F.regexp_replace(on, _NTH_DAY, "")
    nths = F.transform(F.arrays_zip(parts(rf"({_NTH})(\s+last)?", 1, rest).alias("word"), parts(rf"({_NTH})(\s+last)?", 2, rest).alias("last")), lambda x: _ordinal(x["word"], x["last"]))
    # In units shorter than a month an ordinal day is any such day.
    short = unit.isin("day", "weekday", "week")
    days = F.when(named, F.concat(word, F.lit(" "), rest)).when(short, on).otherwise(rest)
    count = F.regexp_extract(text, REPEAT, 4).try_cast("int")
    return F.struct(
        n.alias("n"), unit.alias("unit"), F.array_join(F.regexp_extract_all(days, F.lit(_DAY), F.lit(0)), " ").alias("days"), nths.alias("nths"), month.alias("month"),
        F.when(short, F.array().cast("array<struct<n:int,day:int>>")).otherwise(ordinals).alias("ordinals"), count.alias("count"), _end(text).alias("end"),
    )


#: Repeats that are a number of days, which need no list of dates to step over.
_PLAIN_STEP = r"^every\s+(?:(\d{1,4}|other|second|third)\s+)?(day|week)s?\z"


def plain_step(repeat: Column) -> Column:
    """How many days lie between the dates of a repeat such as 'every 3 days' or 'every week'; null for all others, those that aren't readable among them."""
    text = F.lower(F.trim(repeat))
    number, unit = F.regexp_extract(text, _PLAIN_STEP, 1), F.regexp_extract(text, _PLAIN_STEP, 2)
    n = F.when(number == "", 1).when(number.isin("other", "second"), 2).when(number == "third", 3).otherwise(number.try_cast("int"))
    return F.when((unit != "") & (n > 0), n * F.when(unit == "week", 7).otherwise(1))


def repeat_status(repeat: Column) -> Column:
    """'none', 'empty', 'unsupported', 'parse-error' or 'supported'."""
    text = F.lower(F.trim(repeat))
    bounded = (F.regexp_extract(text, REPEAT, 5) == "") | _end(text).isNotNull()
    readable = text.rlike(REPEAT) & ~text.rlike(r"^every\s+0+\s") & bounded
    return F.when(repeat.isNull(), "none").when(text == "", "empty").when(text.endswith(" when done"), "unsupported").when(readable, "supported").otherwise("parse-error")


def nth_weekday(first: Column, last: Column, n: Column, day: Column) -> Column:
    """The n-th (from the end, if negative) weekday `day` (Monday is 0) of the days from first to last; null where there is none."""
    forward = F.date_add(first, (day - F.weekday(first) + 7) % 7 + (n - 1) * 7)
    back = F.date_sub(last, (F.weekday(last) - day + 7) % 7 + (-n - 1) * 7)
    found = F.when(n > 0, forward).otherwise(back)
    return F.when((n != 0) & found.between(first, last), found)


def occurrences(repeat: Column, reference: Column, until: Column) -> Column:
    """Dates strictly after reference up to until, on which a supported repeat falls; months and years skip days that they lack.

    Plain intervals are stepped, and ordinal days computed for each month or year.  Repeats that name days of the week or the month, or a month, are days
    of the units that the interval takes.  A count counts from the reference on, and with it where it is such a day itself.
    """
    none = F.array().cast("array<date>")

    def stepped(reference, until, step):
        """The reference and every step-th day after it."""
        times = F.floor(F.datediff(until, reference) / step).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(times, F.lit(0))), lambda k: F.date_add(reference, k * step))

    def dates(r):
        n, unit, days, nths, month, reference = (r[k] for k in ("n", "unit", "days", "nths", "month", "reference"))
        until = F.least(r["until"], r["end"])
        week_of = lambda d: F.date_trunc("week", d).cast("date")
        apart = lambda d: (F.year(d) - F.year(reference)) * 12 + F.month(d) - F.month(reference)
        in_unit = lambda d: (
            F.when(unit == "week", F.floor(F.datediff(week_of(d), week_of(reference)) / 7) % n == 0)
            .when(unit == "month", apart(d) % n == 0).when(unit == "year", (F.year(d) - F.year(reference)) % n == 0).otherwise(F.datediff(d, reference) % n == 0)
        )
        of_month = lambda d: F.array_contains(nths, F.dayofmonth(d)) | F.array_contains(nths, F.dayofmonth(d) - F.dayofmonth(F.last_day(d)) - 1)
        on_day = lambda d: (
            ((days == "") | F.contains(days, F.lower(F.date_format(d, "EEEE")))) & ((F.size(nths) == 0) | of_month(d))
            & ((month == 0) | (F.month(d) == month)) & ((days != "") | (F.size(nths) > 0) | (month == 0) | (F.dayofmonth(d) == F.dayofmonth(reference)))
        )
        months = F.when(unit == "year", n * 12).otherwise(n)
        span = F.greatest(F.floor(F.months_between(until, reference) / months).cast("int") + 1, F.lit(0))
        by_month = F.filter(F.transform(F.sequence(F.lit(0), span), lambda k: F.add_months(reference, k * months)), lambda d: (d <= until) & (F.dayofmonth(d) == F.dayofmonth(reference)))

        # Months, or whole years where none is named, that the interval takes, and their ordinal days.
        start = F.when((unit == "year") & (month == 0), F.trunc(reference, "year")).when(unit == "year", F.make_date(F.year(reference), month, F.lit(1))).otherwise(F.trunc(reference, "month"))
        periods = F.transform(F.sequence(F.lit(0), span + 1), lambda k: F.add_months(start, k * months))
        last = lambda p: F.when((unit == "year") & (month == 0), F.date_sub(F.add_months(p, 12), 1)).otherwise(F.last_day(p))
        every_ = F.concat(r["ordinals"], F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda w: F.contains(days, F.get(F.array(*[F.lit(d) for d in (*DAYS[1:], DAYS[0])]), w))), lambda w: F.transform(F.sequence(F.lit(1), F.lit(53)), lambda k: F.struct(k.alias("n"), w.alias("day"))))))
        ordinal = F.flatten(F.transform(periods, lambda p: F.transform(every_, lambda o: nth_weekday(p, last(p), o["n"], o["day"]))))
        ordinal = F.array_distinct(F.array_sort(F.filter(ordinal, lambda d: d.isNotNull() & d.between(reference, until) & ((F.size(nths) == 0) | of_month(d)))))

        daily = lambda: stepped(reference, until, F.lit(1))
        found = (
            F.when(F.size(r["ordinals"]) > 0, ordinal)
            .when(unit == "weekday", F.filter(daily(), lambda d: F.weekday(d) < 5))
            .when((days != "") | (F.size(nths) > 0) | (month > 0), F.filter(daily(), lambda d: in_unit(d) & on_day(d)))
            .when(unit.isin("month", "year"), by_month)
            .otherwise(stepped(reference, until, n * F.when(unit == "week", 7).otherwise(1)))
        )
        bounded = F.when(r["count"].isNull(), found).otherwise(F.slice(found, F.lit(1), F.coalesce(r["count"], F.lit(0))))
        return F.when(until > reference, F.filter(bounded, lambda d: d > reference)).otherwise(none)

    rule = _rule(repeat)
    whole = F.struct(*[rule[k].alias(k) for k in ("n", "unit", "days", "nths", "month", "ordinals", "count", "end")], reference.alias("reference"), until.alias("until"))
    return F.when((until > reference) & (repeat_status(repeat) == "supported"), F.coalesce(let(whole, dates), none)).otherwise(none)


def _recurring(tasks_df: DataFrame) -> DataFrame:
    """tasks with what expansion needs: whether a row recurs, its reference date, how far scheduled lies from due, and its plain step."""
    due, scheduled = day_of(F.col("due")), day_of(F.col("scheduled"))
    d = kept(tasks_df, due_=due, scheduled_=scheduled, step_=F.when(~F.col("done"), plain_step(F.col("repeat"))))
    reference = F.coalesce("due_", "scheduled_")
    recurs = ~F.col("done") & reference.isNotNull() & (F.col("step_").isNotNull() | (repeat_status(F.col("repeat")) == "supported"))
    return kept(d, reference_=reference, offset_=F.coalesce(F.datediff("scheduled_", "due_"), F.lit(0)), recurs_=recurs)


def _generated(d: DataFrame) -> DataFrame:
    """Rows with a day_ as later occurrences: open, dates moved in columns and fields, completion dropped.  Others stay as they are."""
    text, day, stays = (lambda c: F.date_format(c, "yyyy-MM-dd")), F.col("day_"), F.col("day_").isNull()
    due = F.when(F.col("due").isNotNull(), text(day))
    scheduled = F.when(F.col("scheduled").isNotNull(), text(F.date_add(day, F.col("offset_"))))
    dates = F.filter(F.array(F.struct(F.lit("scheduled").alias("key"), scheduled.alias("value")), F.struct(F.lit("due").alias("key"), due.alias("value"))), lambda x: x["value"].isNotNull())
    fields = F.map_concat(F.map_filter("fields", lambda k, v: ~k.isin(*DATE_FIELDS)), F.map_from_entries(dates))
    new = {"due": due, "scheduled": scheduled, "completed": F.lit(None).cast("string"), "done": F.lit(False), "fields": fields}
    return d.withColumns({name: F.when(stays, F.col(name)).otherwise(to) for name, to in new.items()})


def expand_in_window(tasks_df: DataFrame, start: str, end: str) -> DataFrame:
    """Every row, and one row for each later occurrence that falls in [start, end]; occurrence counts from 1 (0: the row itself).

    A row with both dates takes part by its scheduled date, so the window of due dates is moved by their distance.
    """
    d = _recurring(tasks_df)
    lo, hi = (F.date_add(F.lit(x).cast("date"), -F.col("offset_")) for x in (start, end))
    # Plain steps begin with the first date of the window, so that work doesn't grow with the years since the reference.
    step, reference = F.col("step_"), F.col("reference_")
    first_k, last_k = F.greatest(F.ceil(F.datediff(lo, reference) / step), F.lit(1)).cast("int"), F.floor(F.datediff(hi, reference) / step).cast("int")
    stepped = F.when(first_k <= last_k, F.transform(F.sequence(first_k, F.greatest(first_k, last_k)), lambda k: F.date_add(reference, k * step)))
    listed = let(lo, lambda first: F.filter(occurrences(F.col("repeat"), reference, hi), lambda x: x >= first))
    days = F.when(step.isNotNull(), stepped).otherwise(listed)
    later = F.when(F.col("recurs_"), F.transform(days, lambda x, i: F.struct((i + 1).alias("occurrence"), x.alias("day_"))))
    itself = F.array(F.struct(F.lit(0).alias("occurrence"), F.lit(None).cast("date").alias("day_")))
    d = d.select("*", F.inline(F.concat(itself, F.coalesce(later, F.array().cast("array<struct<occurrence:int,day_:date>>")))))
    return _generated(d).select(*tasks_df.columns, "occurrence")


def latest_on_or_before(tasks_df: DataFrame, cutoff: str) -> DataFrame:
    """Each recurring row replaced by its latest occurrence up to the cutoff, if it has one after its reference; others as they are."""
    d = _recurring(tasks_df)
    step, reference, last = F.col("step_"), F.col("reference_"), F.lit(cutoff).cast("date")
    times = F.floor(F.datediff(last, reference) / step).cast("int")
    stepped = F.when(times > 0, F.date_add(reference, times * step))
    day = F.when(F.col("recurs_"), F.when(step.isNotNull(), stepped).otherwise(F.array_max(occurrences(F.col("repeat"), reference, last))))
    return _generated(kept(d, day_=day)).select(*tasks_df.columns)
