"""Text functions as Catalyst expressions. \\s, \\w and word boundaries are ASCII; lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = "A-Za-z0-9_"


WORD_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"


def heuristic_tokens(text: Column) -> Column:
    """Line breaks, blank runs with anything but line breaks, and words by length; empty and null are 0."""
    letter = lambda c: F.instr(F.lit(WORD_LETTERS), c) > 0

    def word(w: Column) -> Column:
        n = F.length(w)
        size = F.when(n <= 4, 1).when(n <= 8, F.ceil(n / 5)).otherwise(F.ceil(n / 4))
        # few words end with a sign or begin with a digit: only those meet a pattern
        tail = F.when(letter(F.substring(w, -1, 1)), 0).otherwise(F.length(F.regexp_extract(w, rf"(?<![^{EDGE}])[^{EDGE}]++\z", 0)))
        digits = (F.instr(F.lit("0123456789"), F.substring(w, 1, 1)) > 0) & w.rlike(r"^[0-9]++\z")
        return F.when(n == 0, 0).when((n == 1) & ~letter(w), 1).when(digits, F.ceil(n / 3)).otherwise(size + tail).cast("long")

    words = F.aggregate(F.split(text, r"\s+"), F.lit(0).cast("long"), lambda a, w: a + word(w))
    blanks = F.regexp_count(text, F.lit(r"\n")) + F.regexp_count(text, F.lit(r"(?<!\s)\n*+[ \t\f\r\x0B]\s*+"))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), words + blanks))


def word_tokens(text: Column) -> Column:
    """1.3 tokens a word."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) * F.lit(1.3)).cast("long"))


def replaced(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, put in steps:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(put))
    return text


# The patterns below give way nowhere (possessive, or bound to the start of a run): Java's engine recurses for each
# repetition of a group that may give way, and looks at a run again from each of its characters.
BULLET = r"(?:[-*•]|(?<![0-9])[0-9]++[.)])"


def minify(text: Column) -> Column:
    return replaced(text, (r"(?dm)(?<![ \t])[ \t]++$", ""), (r"\n{3,}", "\n\n"), (r"([^\n]) {2,}", "$1 "), (rf"({BULLET}\s+.{{1,60}})\n\n({BULLET}\s+)", "$1\n$2"), (r"(?<!\n)\n++\z", "\n"), (r"\A\n+", ""))


def trim_markdown(text: Column) -> Column:
    return replaced(text, (r"(?:(?:-{3,}+|={3,}+)(?:[^\S\n]*+\n)++){2,}+", "---\n"), (r"(?dm)^#{4,}\s", "### "))


def merge_punctuation(text: Column) -> Column:
    """Of two marks in a row the stronger stays, the first of equals; twice."""
    for _ in range(2):
        # a weaker mark before a stronger one goes; otherwise the second does. One alternation keeps the scan in order
        text = F.regexp_replace(text, F.lit(r",\s*([.!?;:])|[;:]\s*([.!?])|([.!?])\s*[.!?;:,]|([;:])\s*[;:,]|(,)\s*,"), F.lit("$1$2$3$4$5"))
    return text


def collapse_repeats(text: Column) -> Column:
    word = "[A-Za-z][A-Za-z']*+"
    return F.regexp_replace(text, F.lit(rf"(?i)(?<![{EDGE}])({word}(?:\s++{word}){{0,3}})(?![{EDGE}])(?:\s*+(?:,\s+)?+(?<=\s)\1(?![{EDGE}]))++"), F.lit("$1"))


def sentences(text: Column) -> Column:
    trimmed = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: replaced(s, (r"\A\s+", ""), (r"(?<!\s)\s++\z", "")))
    return F.filter(trimmed, lambda s: s != "")


def terms(sentence: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(sentence), r"[^\w\s]", " "), r"\s+"), lambda t: F.length(t) > 1)


def density(words: Column) -> Column:
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(words)) / F.size(words))


def subject(sentence: Column) -> Column:
    """Of a trimmed sentence up to four words before the first verb, without their article, if no comma comes first; else null."""
    found = F.regexp_extract(sentence, rf"(?i)^([^,]+?)(?<!\s)\s++(?:is|should|needs|has|will|can|must|does)(?![{EDGE}])", 1)
    found = replaced(found, (r"\A\s+", ""), (r"(?<!\s)\s++\z", ""), (r"(?i)\A(?:the|a|an)\s+", ""))
    return F.when((found != "") & (F.size(F.split(found, " ")) <= 4), found)


def resolved(sentence: Column, subject: Column) -> Column:
    """A pronoun at the sentence's start, before a verb, replaced by a subject with a capital."""
    rest = F.regexp_extract(sentence, rf"(?i)^(?:it|this|that)(\s+(?:is|should|needs|has|will|can|must)(?![{EDGE}])[\s\S]*+)", 1)
    return F.when(rest != "", F.concat(F.upper(F.substring(subject, 1, 1)), F.substring(subject, 2, 1 << 30), rest)).otherwise(sentence)


def constraints_first(text: Column) -> Column:
    """Sentences that state constraints in front under a heading, if there are others too."""
    low = lambda x: F.lower(x)
    first = lambda x: low(x).startswith("must ") | low(x).startswith("never ") | F.contains(low(x), F.lit(" is required"))
    s = sentences(text)
    a, b = F.filter(s, first), F.filter(s, lambda x: ~first(x))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.concat(F.lit("CONSTRAINTS: "), F.array_join(a, " "), F.lit("\n\n"), F.array_join(b, " "))).otherwise(text)


def decision(needs_preview: Column, choice: Column, delivered: Column) -> Column:
    """What became of a shortened text: rejected, failed (not delivered), reverted (the original was chosen) or accepted."""
    return F.when(needs_preview & (choice == "reject"), "rejected").when(~F.coalesce(delivered, F.lit(False)), "failed").when(needs_preview & (choice == "original"), "reverted").otherwise("accepted")


def cache_key(preset: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("::", preset, text), 256)


def whole_percent(part: Column, of: Column) -> Column:
    return F.when(of > 0, F.floor(part * 100 / of + 0.5)).otherwise(0).cast("long")


def error_class(status: Column, code: Column, message: Column) -> Column:
    said = F.lower(F.coalesce(message, F.lit("unknown error")))
    has = lambda *words: said.rlike("|".join(words))
    return (
        F.when(status.isin(400, 404) & has("decommissioned", "does not exist"), "misconfigured")
        .when(status == 429, "rate-limited")
        .when(status.isin(402, 403) | has("quota", "credit", "insufficient"), "exhausted")
        .when(code.isin("ECONNABORTED", "ETIMEDOUT") | has("timeout"), "timeout")
        .otherwise("unknown")
    )


def output_verdict(given: Column, got: Column) -> Column:
    """Is a rewritten text usable?"""
    many = (F.regexp_count(given, F.lit(r"\?")) >= 2) | (F.regexp_count(given, F.lit(rf"(?i)(?<![{EDGE}])(?:also|and|can you also|plus|additionally|moreover)(?![{EDGE}])")) >= 2)
    n, m = F.length(given), F.length(got)
    return F.when(F.coalesce(F.length(F.trim(got)), F.lit(0)) == 0, "empty").when(m > n * 1.1, "expanded").when((m < n * 0.15) & many, "overcompressed").otherwise("ok")


#: Keys and secrets: a design of our own. Boundaries and blanks are RE2's, which has no vertical tab among its blanks;
#: small k and s have two capitals each in it. What begins a match is looked for first: a look behind costs more.
RE2_BLANK = r" \t\n\f\r"
NAMES = rf"(?<![{EDGE}])(?:pa[s\u017f]{{2}}w(?:or)?d|secret|to[k\u212a]en|api[_-]?[k\u212a]ey)|(?<=[{EDGE}])\u017fecret"
SECRETS = {
    "aws_key": rf"(?=AKIA)(?<![{EDGE}])AKIA[0-9A-Z]{{16}}(?![{EDGE}])",
    "assignment": rf"(?i)(?=[apst\u017f][aeop])(?:{NAMES})[{RE2_BLANK}]*[=:][{RE2_BLANK}]*[\"']?[^{RE2_BLANK}\"']{{8,}}",
    "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
}


def secrets(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(k)) for k, p in SECRETS.items())))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
