"""Mail and prose cleaned up: new content of a message, headers, sentences, chunks."""

from __future__ import annotations

import email.header
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# How a line begins and ends from which on a message is quoted, by language and program; lines that come
# together in a header block; how signatures, footers and notices begin.
QUOTES = [("on ", " wrote:"), ("am ", ":"), ("le ", " a écrit :"), ("le ", " a écrit:"), ("el ", " escribió:"), ("il ", " ha scritto:"), ("op ", " schreef:"), ("em ", " escreveu:"), ("begin forwarded message", ""), ("anfang der weitergeleiteten", "")]
RULES = ["original message", "ursprüngliche nachricht", "forwarded message", "message d'origine", "mensaje original"]
HEADERS = ["from:", "sent:", "to:", "subject:", "date:", "cc:", "von:", "gesendet:", "an:", "betreff:", "de:", "envoyé:", "à:", "objet:", "para:", "asunto:", "enviado:"]
CLOSINGS = ["best", "best regards", "kind regards", "warm regards", "regards", "thanks", "many thanks", "cheers", "sincerely", "mit freundlichen grüßen", "viele grüße", "cordialement", "saludos"]
FOOTERS = ["sent from my ", "get outlook for ", "von meinem ", "envoyé de mon ", "enviado desde mi "]
NOTICES = ["confidentiality notice", "this email and any attachments", "this e-mail and any attachments", "this message is confidential", "disclaimer", "to unsubscribe", "unsubscribe"]
# Abbreviations after which a sentence goes on.
ABBREVIATIONS = {"mr", "mrs", "ms", "dr", "prof", "inc", "ltd", "co", "corp", "vs", "etc", "e.g", "i.e", "no", "st", "jr", "sr", "approx", "dept"}


def opens_quote(lines: list[str], k: int) -> bool:
    """Whether what follows line k is an earlier message: an introduction, a rule with a name, or a block of two headers or more."""
    line = " ".join(lines[k].lower().split())
    if line.startswith("am ") and "schrieb" not in line:
        return False
    if any(line.startswith(a) and line.endswith(b) for a, b in QUOTES) or (line.strip("-_ ") in RULES and line[:1] in "-_"):
        return True
    if len(line) >= 10 and not line.strip("_"):
        return True
    block = [x for x in lines[k : k + 4] if x.strip().lower().startswith(tuple(HEADERS))]
    return line.startswith(tuple(HEADERS)) and len(block) >= 2


def new_part(text: str | None) -> str | None:
    """A message without what it quotes, its signature, mobile footer and legal notice."""
    if text is None:
        return None
    lines = text.replace("\r\n", "\n").split("\n")
    end = next((k for k in range(len(lines)) if opens_quote(lines, k)), len(lines))
    kept = [x.rstrip() for x in lines[:end] if not x.lstrip().startswith(">")]
    plain = [x.strip().lower() for x in kept]
    foot = next((k for k, x in enumerate(plain) if k and x.startswith(tuple(FOOTERS + NOTICES))), len(kept))
    closing = lambda k: kept[k].strip() == "--" or plain[k].rstrip(",.!") in CLOSINGS and (plain[k].endswith(",") or k + 1 < foot)
    foot = next((k for k in range(max(1, foot - 8), foot) if closing(k)), foot)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept[:foot])).strip()


def split_sentences(text: str | None) -> list[str] | None:
    """Sentences in order; bullets are sentences, abbreviations and initials end none."""
    if text is None:
        return None
    out: list[str] = []
    for block in re.split(r"\n\s*\n|\n(?=\s*(?:[-*•]|\d+[.)])\s)", text):
        block = re.sub(r"^\s*(?:[-*•]|\d+[.)])\s+", "", block.strip())
        start = 0
        for m in re.finditer(r"[.!?]+[\"')\]]*\s+", block):
            word = re.search(r"([\w.]+)[.!?]+[\"')\]]*\s+$", block[start : m.end()])
            if word and block[m.start()] == "." and (word[1].lower() in ABBREVIATIONS or re.fullmatch(r"[A-Z]", word[1])):
                continue
            out.append(block[start : m.end()].strip())
            start = m.end()
        if block[start:].strip():
            out.append(block[start:].strip())
    return [re.sub(r"\s+", " ", s) for s in out]


def chunks(text: str | None, most: int = 50_000) -> list[str] | None:
    """Whole paragraphs together in pieces of at most ``most`` characters; a longer paragraph is cut."""
    if text is None:
        return None
    out, held = [], ""
    for paragraph in re.split(r"\n\s*\n", text):
        while len(paragraph) > most:
            out += [held] * bool(held) + [paragraph[:most]]
            held, paragraph = "", paragraph[most:]
        if held and len(held) + 2 + len(paragraph) > most:
            out.append(held)
            held = paragraph
        else:
            held = f"{held}\n\n{paragraph}" if held else paragraph
    return out + [held] * bool(held)


def decode_words(text: str | None) -> str | None:
    """A header with its encoded words (RFC 2047) decoded."""
    return None if text is None else str(email.header.make_header(email.header.decode_header(text)))


@F.pandas_udf(StringType())
def extract_new_content(texts: pd.Series) -> pd.Series:
    return texts.map(new_part, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def sentences(texts: pd.Series) -> pd.Series:
    return texts.map(split_sentences, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def paragraph_chunks(texts: pd.Series) -> pd.Series:
    return texts.map(chunks, na_action="ignore")


@F.pandas_udf(StringType())
def decode_header(texts: pd.Series) -> pd.Series:
    return texts.map(decode_words, na_action="ignore")


def base_subject(subject: Column) -> Column:
    """A subject without reply and forward marks; "(no subject)" if nothing is left."""
    plain = F.trim(F.regexp_replace(subject, r"(?i)^(\s*(re|r|fwd?|aw|antw|wg|sv|vs|tr)\s*(\[\d+\])?\s*:\s*)+", ""))
    return F.when(plain == "", "(no subject)").otherwise(plain)


# Parts of a sender's name that say that no one reads there.
UNREAD = [
    "no-reply", "noreply", "do-not-reply", "do-notreply", "donot-reply", "donotreply", "notification", "notifications", "notify", "newsletter", "newsletters", "mailer-daemon", "postmaster",
    "bounce", "bounces", "alert", "alerts", "digest", "news", "marketing", "updates", "calendar-notification",
]
# Headers that only bulk mail and answering machines have, and what Precedence says in bulk mail.
BULK_HEADERS = ["list-unsubscribe", "list-id", "x-autoreply", "x-autorespond"]
BULK = ["bulk", "list", "junk", "auto_reply"]


def header(headers: Column, name: str) -> Column:
    """A header's value, trimmed, however its name is written; empty if it isn't there."""
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.coalesce(F.trim(F.get(found, F.lit(0))["value"]), F.lit(""))


def is_automated(sender: Column, headers: Column | None = None) -> Column:
    """Newsletters, bulk mail, answering machines, notifications and bounces: by headers (a map), or by a whole part of the sender's name between ``. _ + -``."""
    name = F.substring_index(F.lower(sender), "@", 1)
    by_name = name.rlike(f"(^|[._+-])({'|'.join(UNREAD)})($|[._+-])")
    if headers is None:
        return by_name
    listed = reduce(lambda a, b: a | b, (header(headers, h) != "" for h in BULK_HEADERS))
    submitted = F.lower(header(headers, "auto-submitted"))
    return F.coalesce(listed | F.lower(header(headers, "precedence")).isin(BULK) | ~submitted.isin("", "no") | by_name, F.lit(False))


def direction(sender: Column, own_domains: list[str], recipients: Column | None = None, own_addresses: list[str] | None = None) -> Column:
    """outbound if sent from an own address, or from an own domain where no addresses are given; internal where recipients (an array) are known and all are, with the sender, at own domains; else inbound."""
    own = lambda c: F.coalesce(F.lower(F.substring_index(c, "@", -1)).isin(own_domains), F.lit(False))
    mine = F.lower(sender).isin(own_addresses) if own_addresses is not None else own(sender)
    inside = own(sender) & F.forall(recipients, own) if recipients is not None else F.lit(False)
    first, then = ((mine, "outbound"), (inside, "internal")) if own_addresses is not None else ((inside & (F.size(recipients) > 0) if recipients is not None else inside, "internal"), (mine, "outbound"))
    return F.when(*first).when(*then).otherwise("inbound")
