"""Text of HTML, by built-in expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities and the characters that they stand for, & last; elements without text for a reader; elements that begin a line.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
UNSEEN = ["script", "style", "head", "title", "noscript", "template"]
BLOCKS = "p div ul ol table tr section article header footer main nav aside blockquote pre form h1 h2 h3 h4 h5 h6".split()


def character(number: Column) -> Column:
    """The character of a code point; nothing for what is none."""
    valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(F.lit(""))


def decoded_numbers(text: Column) -> Column:
    """Numeric entities, decimal or hexadecimal, as characters. Each one that a text has is replaced once, wherever it stands."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("&#(x[0-9A-Fa-f]{1,6}|[0-9]{1,7});"), 1))
    value = lambda n: F.when(F.startswith(n, F.lit("x")), F.conv(F.substring(n, 2, 6), 16, 10)).otherwise(n).cast("long")
    return F.aggregate(found, text, lambda t, n: F.replace(t, F.concat(F.lit("&#"), n, F.lit(";")), character(value(n))))


def to_text(html: Column) -> Column:
    """What a reader sees: no comments, scripts, styles, head or templates; blocks have lines of their own, list items a dash, cells a blank between; other tags leave no trace; white space collapsed."""
    out = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, rf"(?is)<({'|'.join(UNSEEN)})\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"\s+", " ")
    out = F.regexp_replace(out, r"(?i)<li\b[^>]*>", "\n- ")
    out = F.regexp_replace(out, rf"(?i)</?(br|{'|'.join(BLOCKS)})\b[^>]*>|</li\s*>", "\n")
    out = F.regexp_replace(out, r"(?i)</?(td|th)\b[^>]*>", " ")
    out = decoded_numbers(F.regexp_replace(out, "<[^>]*>", ""))
    out = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, out)
    out = F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), " ?\n[ \n]*", "\n")
    return F.trim(out, F.lit(" \n"))
