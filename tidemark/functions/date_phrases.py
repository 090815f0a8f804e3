"""Days that a text names ("by Friday", "end of Q1", "in two weeks"), relative to a day.

A text becomes a list of tokens; at each token a small grammar of anchors, periods and offsets
reads as far as it can, and what was read is one mention of a day:

    mention  = iso | slashed | calendar | edge "of" period | shortcut | near | offset | weekday | "the" ordinal
    calendar = [weekday] month ordinal [year] | ["the"] ordinal ["of"] month [year]
    edge     = "start" | "beginning" | "mid" | "middle" | "end"
    period   = ["the" | "this" | "next"] unit | quarter [year] | month [year]
    offset   = ("in" | "within" | ...) count [business] unit | count unit "from" ("now" | "today")

Periods (day, week, month, quarter, year) know their first and last day for any shift, so every
edge of every period comes from one rule.
"""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, StringType, StructField, StructType

# Names and number words.
MONTHS = [name.lower() for name in calendar.month_name]
WEEKDAYS = [name.lower() for name in calendar.day_name]
SHORT_WEEKDAYS = {"mon": 0, "tue": 1, "tues": 1, "wed": 2, "thu": 3, "thur": 3, "thurs": 3, "fri": 4, "sat": 5, "sun": 6}
SMALL_NUMBERS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "fourteen": 14, "fifteen": 15, "twenty": 20, "thirty": 30, "sixty": 60, "ninety": 90,
}
SHORTCUTS = {"eod": "day", "cob": "day", "eow": "week", "eom": "month", "eoq": "quarter", "eoy": "year"}
UNITS = {"day", "week", "month", "quarter", "year"}
EDGES = {"start": "first", "beginning": "first", "mid": "middle", "middle": "middle", "end": "last"}
TIMES_OF_DAY = {"morning", "afternoon", "evening", "night", "eod", "cob"}
FRACTIONS = {"1/2", "1/3", "2/3", "1/4", "3/4"}
#: Nouns that an ordinal counts, so that it is no day of a month.
COUNTED_NOUNS = {
    "century", "percentile", "anniversary", "floor", "time", "place", "round", "edition", "birthday", "annual",
    "largest", "biggest", "patient", "donor", "heart", "site", "of",
}
#: Offsets beyond this are no deadlines.
LONGEST = 400
#: A day of a month that is past may be meant, but one ahead is likelier: each day past counts as so many.
PAST_WEIGHT = 3
#: A quarter without a year that ended so many days ago is the next year's.
QUARTER_GRACE = 92
#: Letters before a mention in which a word makes it firm.
FIRM_REACH = 30

TOKEN = re.compile(r"(?P<iso>\d{4}-\d\d-\d\d(?!\w))|(?P<slash>\d{1,2}/\d{1,2}(?:/\d{4}|/\d\d)?(?![\d/]))|(?P<nth>\d{1,2}(?:st|nd|rd|th))(?!\w)|(?P<number>\d[\d/.,]*\d|\d)(?!\w)|(?P<word>[^\W\d_]+(?:'[^\W\d_]+)?)(?![\d_])|(?P<other>\w+|[^\w\s])", re.I)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


def tokens_of(text: str) -> list[Token]:
    return [Token(m.lastgroup, m[0].lower(), m.start(), m.end()) for m in TOKEN.finditer(text)]


def real_day(year: int, month: int, day: int) -> date | None:
    try:
        return date(year, month, day)
    except ValueError:
        return None


def likeliest(ref: date, month: int, day: int, year: int | None) -> date | None:
    """The day in the year given (two digits: of this century), else in the year that brings it closest."""
    if year is not None:
        return real_day(year + 2000 if year < 100 else year, month, day)
    options = filter(None, (real_day(ref.year + k, month, day) for k in (-1, 0, 1)))
    return min(options, key=lambda d: max((d - ref).days, PAST_WEIGHT * (ref - d).days), default=None)


def month_days(ref: date, shift: int = 0) -> tuple[date, date]:
    year, month = divmod(12 * ref.year + ref.month - 1 + shift, 12)
    return date(year, month + 1, 1), date(year, month + 1, calendar.monthrange(year, month + 1)[1])


def period(unit: str, ref: date, shift: int = 0) -> tuple[date, date]:
    """First and last day of the unit that ref lies in, ``shift`` units on. A week is Monday to Friday."""
    if unit == "day":
        return (ref + timedelta(shift),) * 2
    if unit == "week":
        monday = ref - timedelta(ref.weekday() - 7 * shift)
        return monday, monday + timedelta(4)
    if unit == "month":
        return month_days(ref, shift)
    months = 3 if unit == "quarter" else 12
    opening = month_days(ref, months * shift - (ref.month - 1) % months)[0]
    return opening, month_days(opening, months - 1)[1]


def later(ref: date, count: int, unit: str, workdays: bool) -> date:
    if unit == "month":
        first, last = month_days(ref, count)
        return first + timedelta(min(ref.day, last.day) - 1)
    if workdays and unit == "day":
        weeks, rest = divmod(count, 5)
        start = min(ref.weekday(), 4)
        back = ref - timedelta(ref.weekday() - start)
        return back + timedelta(7 * weeks + rest + (2 if start + rest > 4 else 0)) if count else ref
    return ref + timedelta(count * (7 if unit == "week" else 1))


def month_number(word: str) -> int | None:
    """1 to 12 for a month's name, its first three letters, or "sept"."""
    return next((k for k, m in enumerate(MONTHS) if k and (word == m or word == m[:3] or (word == "sept" and k == 9))), None)


class Reader:
    """Reads one text's tokens. A reading from place i is (day, place after it) or None."""

    def __init__(self, text: str, ref: date):
        self.text, self.ref, self.tokens = text, ref, tokens_of(text)

    def word(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i].kind if 0 <= i < len(self.tokens) else ""

    def joined(self, i: int) -> bool:
        """Whether token i follows the one before it at once."""
        return 0 < i < len(self.tokens) and self.tokens[i - 1].end == self.tokens[i].start

    def is_words(self, i: int, *words: str) -> bool:
        return all(self.word(i + k) == w for k, w in enumerate(words))

    def after_dot(self, i: int) -> int:
        return i + 1 if self.word(i) == "." and self.joined(i) else i

    def number(self, i: int) -> tuple[int, int] | None:
        """A count: digits, a number word, or "a few" and the like."""
        if self.kind(i) == "number" and self.word(i).isdigit() and len(self.word(i)) <= 3:
            return int(self.word(i)), i + 1
        if self.is_words(i, "a", "few"):
            return 3, i + 2
        if self.is_words(i, "a", "couple"):
            return 2, i + 2 + (self.word(i + 2) == "of")
        return (SMALL_NUMBERS[self.word(i)], i + 1) if self.word(i) in SMALL_NUMBERS else None

    def unit(self, i: int) -> str | None:
        word = self.word(i)
        return word if word in UNITS else word[:-1] if word.endswith("s") and word[:-1] in UNITS else None

    def year(self, i: int) -> tuple[int | None, int]:
        at = i + (self.word(i) == ",")
        if self.kind(at) == "number" and re.fullmatch(r"\d{4}", self.word(at)):
            return int(self.word(at)), at + 1
        return None, i

    def month(self, i: int) -> tuple[int, int] | None:
        found = month_number(self.word(i)) if self.kind(i) == "word" else None
        return (found, self.after_dot(i + 1)) if found else None

    def day_number(self, i: int) -> tuple[int, int] | None:
        if self.kind(i) == "nth":
            return int(self.word(i)[:-2]), i + 1
        return (int(self.word(i)), i + 1) if self.kind(i) == "number" and re.fullmatch(r"\d{1,2}", self.word(i)) else None

    def iso(self, i: int):
        if self.kind(i) == "iso" and (d := real_day(*map(int, self.word(i).split("-")))):
            return d, i + 1

    def slashed(self, i: int):
        if self.kind(i) != "slash" or self.word(i) in FRACTIONS or self.word(i + 1) == "of" or (self.joined(i) and self.word(i - 1) in (".", "/")):
            return None
        month, day, *year = map(int, self.word(i).split("/"))
        d = likeliest(self.ref, month, day, *year or [None])
        return (d, i + 1) if d else None

    def calendar(self, i: int):
        """October 14th, 2026; Friday, Oct. 9; the 14th of October."""
        at = i
        if self.word(i) in WEEKDAYS or self.word(i) in SHORT_WEEKDAYS:
            at = self.after_dot(i + 1)
            at += self.word(at) == ","
        if (month := self.month(at)) and (day := self.day_number(month[1])):
            pair, at = (month[0], day[0]), day[1]
        else:
            at = i + (self.word(i) == "the")
            day = self.day_number(at)
            month = self.month(day[1] + (self.word(day[1]) == "of")) if day else None
            if not month:
                return None
            pair, at = (month[0], day[0]), month[1]
        year, at = self.year(at)
        d = likeliest(self.ref, *pair, year)
        return (d, at) if d else None

    def edge(self, i: int):
        """An edge of a period: end of next month, mid-November, end of Q1."""
        at = i + (self.word(i) == "the")
        edge = EDGES.get(self.word(at))
        if edge is None:
            if self.word(at) in UNITS and self.word(at + 1) in ("-", "end"):  # month-end, quarter end
                close = at + 1 + (self.word(at + 1) == "-")
                if self.word(close) == "end" and self.word(at) in ("month", "quarter", "year"):
                    return period(self.word(at), self.ref)[1], close + 1
            return None
        at += 1
        at += self.word(at) in ("of", "-")
        if month := self.month(at):
            year, after = self.year(month[1])
            anchor = likeliest(self.ref, month[0], 15 if edge == "middle" else 1, year)
            return (month_days(anchor)[1] if edge == "last" else anchor, after) if anchor else None
        if edge != "last":
            return None
        if self.word(at) == "today":
            return self.ref, at + 1
        if re.fullmatch(r"q[1-4]", self.word(at)):
            year, after = self.year(at + 1)
            last = month_days(date(year or self.ref.year, 3 * int(self.word(at)[1]), 1))[1]
            if not year and (self.ref - last).days > QUARTER_GRACE:
                last = month_days(last, 12)[1]
            return last, after
        shift = self.word(at) == "next"
        at += self.word(at) in ("the", "this", "next")
        unit = self.word(at)
        if unit not in UNITS or (shift and unit not in ("week", "month")):
            return None
        return self.end_of(unit, int(shift)), at + 1

    def end_of(self, unit: str, shift: int = 0) -> date:
        """The last day of a unit; a week that is over means the next one."""
        last = period(unit, self.ref, shift)[1]
        return last if last >= self.ref else period(unit, self.ref, shift + 1)[1]

    def near(self, i: int):
        """today, tomorrow, this week, next week, and abbreviations such as EOM."""
        at = i + (self.word(i) == "the")
        if self.is_words(at, "day", "after", "tomorrow"):
            return self.ref + timedelta(2), at + 3
        if self.is_words(at, "following", "week") and at > i:
            return period("week", self.ref, 1)[0], at + 2
        if self.word(i) in ("tomorrow", "tmrw"):
            at = i + 1
            at += 3 if self.is_words(at, "end", "of", "day") else self.word(at) in TIMES_OF_DAY
            return self.ref + timedelta(1), at
        if self.word(i) in ("today", "tonight"):
            return self.ref, i + 1
        if self.is_words(i, "close", "of", "business") or self.word(i) in ("eod", "cob"):
            at = i + (3 if self.word(i) == "close" else 1)
            return self.ref, at + (self.word(at) == "today")
        if self.word(i) in SHORTCUTS:
            return self.end_of(SHORTCUTS[self.word(i)]), i + 1
        at = i + (self.word(i) in ("later", "early"))
        if self.word(at) == "this" and self.word(at + 1) in ("morning", "afternoon", "evening") and at == i:
            return self.ref, at + 2
        if self.is_words(at, "this", "week") and self.word(i) != "early":
            return self.end_of("week"), at + 2
        if self.is_words(at, "next", "week") and self.word(i) != "later":
            return period("week", self.ref, 1)[0], at + 2
        return None

    def offset(self, i: int):
        """in two weeks, within 30 days, in the next 5 business days, three days from now."""
        lead = next((n for n, words in ((3, ("over", "the", "next")), (3, ("in", "the", "next")), (1, ("in",)), (1, ("within",))) if self.is_words(i, *words)), 0)
        count = self.number(i + lead)
        if count is None or count[0] > LONGEST:
            return None
        at = count[1]
        workdays = bool(lead) and self.word(at) in ("business", "working")
        unit = self.unit(at + workdays)
        at += workdays + 1
        if unit not in (("day", "week", "month") if lead else ("day", "week")):
            return None
        if not lead:
            if self.word(at) != "from" or self.word(at + 1) not in ("now", "today"):
                return None
            at += 2
        return later(self.ref, count[0], unit, workdays), at

    def weekday(self, i: int):
        """Friday; next Tuesday; Fri. only after "next" or a word such as "by"."""
        at, strictly = i, False
        if self.word(i) in ("next", "coming") or self.is_words(i, "this", "coming"):
            at, strictly = i + 1 + (self.word(i) == "this"), True
        elif self.word(i) == "this":
            at = i + 1
        name = self.word(at)
        if name in WEEKDAYS:
            number, after = WEEKDAYS.index(name), at + 1
        elif name in SHORT_WEEKDAYS and (strictly or (at == i and self.opening(i) is not None)):
            number, after = SHORT_WEEKDAYS[name], self.after_dot(at + 1)
        else:
            return None
        ahead = (number - self.ref.weekday()) % 7
        return self.ref + timedelta(ahead or (7 if strictly else 0)), after

    def ordinal(self, i: int):
        """the 14th: the next such day, unless the ordinal counts something else."""
        if self.word(i) != "the" or self.kind(i + 1) != "nth" or self.word(i + 2) in COUNTED_NOUNS:
            return None
        day = int(self.word(i + 1)[:-2])
        months = (month_days(self.ref, k)[0] for k in range(3))
        return next(((d, i + 2) for m in months if (d := real_day(m.year, m.month, day)) and d >= self.ref), None)

    def read(self, i: int):
        """The reading from place i that goes farthest."""
        rules = (self.iso, self.slashed, self.calendar, self.edge, self.near, self.offset, self.weekday, self.ordinal)
        return max(filter(None, (rule(i) for rule in rules)), key=lambda r: r[1], default=None)

    def opening(self, i: int) -> int | None:
        """The place of the words before token i that say what the day is: by, on, until, due by, deadline is ..."""
        at = i - 1 - (self.word(i - 1) == ":")
        if self.word(at) in ("by", "on", "before", "until", "till", "due", "for"):
            return at - 1 if self.word(at) in ("by", "on") and self.word(at - 1) == "due" else at
        at -= self.word(at) in ("is", "of")
        if self.word(at) == "deadline":
            return at
        if self.word(at) == "than" and self.word(at - 1) == "later" and self.word(at - 2) in ("no", "not"):
            return at - 2
        return None

    def firm(self, first: int, start: int) -> bool:
        """Whether what opens a mention, or stands close before it in its sentence, makes it a deadline."""
        if self.word(first) in ("by", "before", "due", "deadline", "within") or (self.word(first) in ("no", "not") and self.word(first + 1) == "later"):
            return True
        for k in range(start - 1, -1, -1):
            if self.word(k) in (".", "!", "?") or self.tokens[start].start - self.tokens[k].end > FIRM_REACH or "\n" in self.text[self.tokens[k].end : self.tokens[start].start]:
                return False
            if self.word(k) in ("deadline", "due") or any(self.is_words(k, *w) for w in (("no", "later", "than"), ("latest", "by"), ("hard", "stop"))):
                return True
        return False

    def mentions(self) -> list[tuple[date, str, bool]]:
        out, i = [], 0
        while i < len(self.tokens):
            found = self.read(i)
            if found is None:
                i += 1
                continue
            day, after = found
            opening = self.opening(i)
            first = i if opening is None else opening
            phrase = " ".join(self.text[self.tokens[first].start : self.tokens[after - 1].end].split())
            out.append((day, phrase, self.firm(first, i)))
            i = after
        return out


def find_days(text: str | None, ref: date | None) -> list[tuple[date, str, bool]]:
    """(day, phrase, firm) of each mention in reading order.

    The phrase has the word that opens it ("by", "on"); it is firm after by, before, due, deadline
    and the like.
    """
    return Reader(text, ref).mentions() if text and ref is not None else []


@F.pandas_udf(ArrayType(StructType([StructField("day", DateType()), StructField("phrase", StringType()), StructField("firm", BooleanType())])))
def date_phrases(texts: pd.Series, refs: pd.Series) -> pd.Series:
    """find_days of each text relative to each local day (see functions.dates.local_day)."""
    return pd.Series([[{"day": d, "phrase": p, "firm": f} for d, p, f in find_days(t, r)] for t, r in zip(texts, refs, strict=True)])


def deadline(phrases):
    """The first firm day of date_phrases, else the first day."""
    firm = F.filter(phrases, lambda p: p["firm"])
    return F.when(F.size(firm) > 0, firm[0]).when(F.size(phrases) > 0, phrases[0])
