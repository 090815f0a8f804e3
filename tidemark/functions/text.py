"""Normal forms, tokens and similarity of text, as Column expressions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Letters that Unicode decomposition doesn't take apart, and their folds.
FOLDS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ø": "o", "ł": "l", "đ": "d", "ð": "d"}
# Accented Latin letters and the letters below the accents.
ACCENTED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįıñńňòóôõöōőŕřśšťùúûüūůűųýÿźżžğ"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiiinnnooooooorrsstuuuuuuuuyyzzzg"
# Endings of names that say what legal form a company has, and words that say what kind it is of.
LEGAL = (
    "inc incorporated ltd limited llc llp lp gmbh ag sa sas sarl plc corp corporation co nv bv srl spa kk oy ab as pty pte kgaa se"
).split()
GENERIC = (
    "pharma pharmaceutical pharmaceuticals pharmaceutica bio biotech biologics bioscience biosciences biopharma therapeutics sciences science life health healthcare medical oncology "
    "labs laboratories laboratory ventures venture capital partners fund funds investments holdings group global international instruments technologies technology systems solutions "
    "cloud institute university hospital foundation research and company"
).split()
# Titles before a person's name, and what may follow it.
TITLES = "dr prof professor mr mrs ms miss mx sir dame herr frau mme mlle".split()
DEGREES = "phd md mba msc bsc dphil pharmd jr sr ii iii iv esq frcp facc".split()
# Words that carry no action.
STOP = (
    "a an the to for of and or with on in at by from as is are be been being our your my their his her its we i you they he she it me us them "
    "this that these those please pls kindly will would could can should shall must need needs want wants asap re fw fwd about into over also just "
    "all any some so then than do does did have has had get got let know up out back again soon today tomorrow week next by end eod there here "
    "what when which who whom whose how why if not no yes ok okay thanks thank hi hello dear regards best cheers via using"
).split()


def plain_letters(text: Column, without: str = "") -> Column:
    """Lower case without accents and without the letters of ``without``."""
    out = F.translate(F.lower(text), ACCENTED + without, PLAIN)
    for letter, plain in FOLDS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def fold(text: Column) -> Column:
    """Lower case without accents, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(plain_letters(text), r"\s+", " "))


def words(text: Column, longer_than: int = 0) -> Column:
    """Runs of ASCII letters and digits of the folded text, in order."""
    found = F.filter(F.split(F.regexp_replace(fold(text), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > longer_than)
    return found


def without_last(names: Column, dropped: list[str], least: int = 1) -> Column:
    """An array without the words of ``dropped`` that end it; at least ``least`` words stay."""
    last = F.array_max(F.transform(names, lambda w, k: F.when(w.isin(dropped), F.lit(0)).otherwise(k + 1)))
    return F.slice(names, 1, F.greatest(F.coalesce(last, F.lit(0)), F.least(F.size(names), F.lit(least))))


def company_words(name: Column) -> Column:
    """The words of a company's normal form: & and + read as "and", no leading "the", no legal form at the end."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(fold(name), "[&+]", " and "), "['’`]", ""), "[^a-z0-9]+", " ")
    plain = F.regexp_replace(F.regexp_replace(F.trim(plain), "^the ", ""), " a s$", " as")
    each = F.filter(F.split(plain, " "), lambda w: w != "")
    return without_last(each, [*LEGAL, "and"])


def company_normal(name: Column) -> Column:
    return F.array_join(company_words(name), " ")


def company_core(name: Column) -> Column:
    """A company's name without legal form and without the generic words that end it; one word stays at least."""
    return F.array_join(without_last(company_words(name), GENERIC), " ")


def person_words(name: Column) -> Column:
    """The words of a person's name: no address, brackets, titles or degrees; "Last, First" the right way round."""
    bare = fold(F.regexp_replace(name, r"<[^>]*>|\([^)]*\)|[\"“”]", " "))
    bare = F.regexp_replace(bare, rf"(?:[\s,]+(?:{'|'.join(DEGREES)}|ph\.?\s?d|m\.d|m\.sc)\.?)+$", "")
    turned = F.regexp_replace(bare, r"^([^,]+),\s*([^,]+)$", "$2 $1")
    plain = F.regexp_replace(F.regexp_replace(turned, rf"^(?:(?:{'|'.join(TITLES)})\.?\s+)+", ""), "['’`]", "")
    return F.filter(F.split(F.regexp_replace(plain, "[^a-z0-9]+", " "), " "), lambda w: w != "")


def person_normal(name: Column) -> Column:
    return F.array_join(person_words(name), " ")


def light_stem(word: Column) -> Column:
    """Drops verb and plural endings, the first of a list that fits, and then a last e, if enough is left.

    Endings and lengths are compared plainly; one regular expression takes the last e.
    """
    size = F.length(word)
    ends = lambda *endings: reduce(lambda a, b: a | b, [F.endswith(word, F.lit(e)) for e in endings])
    cut = lambda n: F.left(word, size - n)
    stem = (
        F.when((size >= 6) & ends("ing"), cut(3))
        .when((size >= 5) & ends("ied", "ies"), F.concat(cut(3), F.lit("y")))
        .when((size >= 5) & ends("ed"), cut(2))
        .when((size >= 5) & ends("sses", "xes", "ches", "shes"), cut(2))
        .when((size >= 4) & ends("s") & ~ends("ss", "us", "is"), cut(1))
        .otherwise(word)
    )
    return F.regexp_replace(stem, "(?<=...)e$", "")


def action_tokens(text: Column) -> Column:
    """Stems of the words that carry an action, each once, in order; amounts keep their $, % and decimal point."""
    plain = F.regexp_replace(plain_letters(text, "'’`"), "[^a-z0-9$%.]+", " ")
    found = F.transform(F.split(plain, " "), lambda w: F.trim(w, F.lit(".")))
    return F.array_distinct(F.transform(F.filter(found, lambda w: (F.length(w) >= 2) & ~w.isin(STOP)), light_stem))


def token_coverage(needle: Column, haystack: Column) -> Column:
    """The share of needle's tokens that haystack has."""
    return F.when(F.size(needle) > 0, F.size(F.array_intersect(needle, haystack)) / F.size(needle)).otherwise(F.lit(0.0))


def is_duplicate_action(a: Column, b: Column, shared: Column) -> Column:
    """Whether two actions' tokens say the same: 0.6 and up in a shared context, else 0.85."""
    return F.when(shared, contextual_similarity(a, b) >= 0.6).otherwise(jaccard(a, b) >= 0.85)


def action_key(text: Column) -> Column:
    """The first 24 hex digits of SHA-256 over the sorted action tokens: word order doesn't matter."""
    return F.substring(F.sha2(F.array_join(F.array_sort(action_tokens(text)), " "), 256), 1, 24)


def jaccard(a: Column, b: Column) -> Column:
    """Shared in all distinct elements; 0 if there are none."""
    whole = F.size(F.array_union(a, b))
    return F.when(whole > 0, F.size(F.array_intersect(a, b)) / whole).otherwise(F.lit(0.0))


def contextual_similarity(a: Column, b: Column) -> Column:
    """Jaccard, or 0.9 of the share of the shorter set that is in the longer, if it has two elements or more."""
    shared, short = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    return F.greatest(jaccard(a, b), F.when(short >= 2, shared * 0.9 / short).otherwise(F.lit(0.0)))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(1.0))


def token_set_similarity(a: Column, b: Column) -> Column:
    """The best ratio between the sorted shared words and those with each side's rest; 0 without words, and 0.5 at most if all that is shared is generic."""
    both = F.array_sort(F.array_intersect(a, b))
    join = lambda rest: F.trim(F.array_join(F.concat(both, F.array_sort(rest)), " "))
    common, left, right = F.array_join(both, " "), join(F.array_except(a, b)), join(F.array_except(b, a))
    best = F.greatest(levenshtein_ratio(common, left), levenshtein_ratio(common, right), levenshtein_ratio(left, right))
    capped = F.when(F.forall(both, lambda w: w.isin(GENERIC)), F.least(best, F.lit(0.5))).otherwise(best)
    alike = F.when(F.size(both) > 0, capped).otherwise(levenshtein_ratio(left, right))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), alike).otherwise(F.lit(0.0))


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, t in zip(b, taken, strict=True) if t]
    swapped = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler_score(a: str, b: str, weight: float = 0.1, longest: int = 4) -> float:
    score, prefix = jaro(a, b), 0
    while prefix < min(longest, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return score + prefix * weight * (1 - score)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity; null if either is null. For candidate pairs that a join has narrowed down."""
    return pd.Series([None if x is None or y is None else jaro_winkler_score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def like_pattern(text: str) -> str:
    """A LIKE pattern for text that contains the given one, whatever %, _ or \\ it has."""
    return "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def term_score(title: Column, body: Column, terms: list[str]) -> Column:
    """The mean over terms of 1 for a hit in the title, 0.5 for one in the body; short terms must start a word."""

    def has(text: Column, term: str) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        return low.rlike(r"(^|[^\p{L}\p{N}])\Q" + term.lower() + r"\E") if len(term) <= 4 else F.contains(low, F.lit(term.lower()))

    each = [F.when(has(title, t), 1.0).when(has(body, t), 0.5).otherwise(0.0) for t in terms]
    return sum(each[1:], each[0]) / len(each) if each else F.lit(0.0)


def excerpt(text: Column, term: str, before: int = 40, length: int = 120) -> Column:
    """length characters around the first hit of term, without regard to case; the start if there is none."""
    at = F.locate(term.lower(), F.lower(text))
    start = F.greatest(F.lit(1), at - before)
    cut = F.substring(text, start, F.lit(length))
    return F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(F.length(text) >= start + length, "…").otherwise(""))


def evidence_form(text: Column) -> Column:
    """The form in which quotes are compared with their source: letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def decoded(raw: Column) -> Column:
    """Bytes as text: a byte-order mark decides, else UTF-8 if the bytes are that, else Latin-1; the mark goes."""
    start = lambda n: F.hex(F.substring(raw, 1, n))
    marked = F.when(start(3) == "EFBBBF", F.decode(F.substring(raw, 4, 1 << 30), "UTF-8")).when(start(2).isin("FEFF", "FFFE"), F.decode(raw, "UTF-16"))
    return marked.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))


# What a signal is, by the first kind of which its text has a word that begins so, or a phrase.
SIGNALS = [
    ("escalation", ["escalat", "urgent", "unacceptable", "breach"], []),
    ("approval_request", ["approv"], []),
    ("hiring_decision", [], ["offer", "candidate", "competing offer"]),
    ("investor_request", [], ["term sheet", "diligence", "data room", "investment committee"]),
    ("decision_request", [], ["decide", "decision", "go no-go"]),
    ("commitment", [], ["we will", "i will", "i'll", "commit to", "committed to", "by monday", "by tuesday", "by wednesday", "by thursday", "by friday"]),
    ("response_needed", [], ["please reply", "please confirm", "please advise", "can you", "let me know", "need your"]),
    ("risk", ["risk", "delay", "slip", "concern", "churn"], []),
    ("opportunity", ["opportunit"], ["interested in", "would like to partner", "credits"]),
]


def signal_kind(body: Column, otherwise: str = "development") -> Column:
    """The first kind of SIGNALS whose words a text has."""
    said = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.translate(F.lower(body), "/’", " '"), F.lit("([a-z0-9'-]+)"), 1), " "), F.lit(" "))
    any_of = lambda needles: reduce(lambda a, b: a | b, [F.contains(said, F.lit(n)) for n in needles])
    return F.coalesce(*(F.when(any_of([f" {s}" for s in starts] + [f" {p} " for p in phrases]), kind) for kind, starts, phrases in SIGNALS), F.lit(otherwise))


def domain_of(email: Column) -> Column:
    """The part after the @, lower case; null if there is none."""
    return F.when(email.contains("@"), F.lower(F.trim(F.substring_index(email, "@", -1))))


def money_value(text: Column) -> Column:
    """The first amount such as $1.5M, $1,200 or $40k, as a number."""
    shape = r"\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s?([kKmMbB])?\b"
    number = F.regexp_replace(F.regexp_extract(text, shape, 1), ",", "")
    scale = F.lower(F.regexp_extract(text, shape, 2))
    times = F.when(scale == "k", 1e3).when(scale == "m", 1e6).when(scale == "b", 1e9).otherwise(1.0)
    return F.when(number != "", number.try_cast("double") * times)


def parse_amount(text: Column) -> Column:
    """1,234.50 as a number; what isn't one counts as 0."""
    return F.coalesce(F.regexp_replace(text, "[, $]", "").try_cast("double"), F.lit(0.0))
