"""Text expressions: columns in, columns out.  Classes are ASCII on purpose: accented letters separate words."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the analysed domain.
FILLERS = ("um", "uh", "like", "you know", "i mean", "literally", "actually", "basically", "so", "right", "okay", "just")
HYPE = ("unlock", "leverage", "seamless", "elevate", "empower", "delve", "dive", "supercharge", "gamechanger", "insane", "crazy", "wild")
HARD_FILLERS = ("um", "uh", "umm", "uhh", "erm", "er", "hmm", "mm", "ah", "eh")

#: Words that say little by themselves.  Fixed values: what counts as content, and so what repeats, depends on each of them.
STOP = tuple("a an the and or but so of to in on at it is i you we that this for with be was are my me if it's it'll i'm they he she do not there then just".split())

#: What redaction takes out, in this order, so that no rule meets what another one is for: (pattern, placeholder).
PRIVATE = (
    (r"[^\s@<>(),;]+@[^\s@<>(),;]+\.[A-Za-z]{2,}", "<email>"),
    (r"(?i:https?|ftp)://[^\s<>]+", "<link>"),
    (r"\B@[A-Za-z0-9_][A-Za-z0-9_.]+", "@creator"),
    (r"[^\s<>]*/[^\s<>/]+/[^\s<>]*", "<path>"),
    (r"(?i:\b[a-z0-9_-]+\.(?:mp[34]|m4[av]|mov|mkv|web[mp]|wav|flac|png|gif|jpe?g))\b", "<file>"),
    (r"(?i:\b(?:[a-z0-9-]+\.)+(?:com|org|net|edu|info|io|dev|tv))\b", "<domain>"),
)
#: What a sentence is doing, by the first rule that fits: (kind, words or phrases, least matches).
MOTIONS = tuple(
    (kind, r"(?i)\b(?:" + "|".join(words) + r")\b" if words else ",", least)
    for kind, words, least in (
        ("before_after", ("versus", "vs", "used to", "no longer", "compared (?:to|with)", "rather than", "(?:more|less|[a-z]+er) than", "before and after"), 1),
        ("counter", ("[0-9]+(?:[.,][0-9]+)*", "half", "twice", "dozens?", "percent", "hundreds?", "thousands?", "millions?", "billions?"), 1),
        ("list", ("first(?:ly)?", "second(?:ly)?", "third(?:ly)?", "then", "next", "last(?:ly)?", "steps?"), 2),
        ("list", (), 2),
        ("flow", ("(?:goes|moves|flows|leads) (?:in)?to", "(?:sends?|passes|returns) (?:it|a|an|the)", "from [a-z]+ to", "through", "queues?", "pipelines?"), 1),
        ("ui_demo", ("clicks?", "taps?", "types?", "drags?", "drops?", "scrolls?", "opens?", "select(?:s|ed)?", "press(?:es)?", "buttons?"), 1),
    )
)
#: A character that a text must hold for a pattern of PRIVATE to fit anywhere.
NEEDED = ("@", "://", "@", "/", ".", ".")


def norm(text: Column) -> Column:
    """Lower case, % spoken, thousands separators gone before other punctuation becomes a space, trimmed."""
    text = F.regexp_replace(F.lower(text), "%", " percent ")
    text = F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9])", "")
    return F.trim(F.regexp_replace(text, r"[^a-z0-9' ]+", " "))


def tokens(text: Column) -> Column:
    """The words of norm(text)."""
    return F.filter(F.split(norm(text), " +"), lambda w: w != "")


def ends_sentence(word: Column) -> Column:
    return word.rlike(r"[.?!]\s*$")


def ends_clause(word: Column) -> Column:
    return word.rlike(r"[.?!,;:]\s*$")


def plausible_ms(text: Column) -> Column:
    """How long saying this should take: 100 ms, and 65 ms for each letter or digit."""
    return (F.lit(100) + F.length(F.regexp_replace(F.lower(text), "[^a-z0-9]", "")) * 65).cast("long")


def singular(word: Column) -> Column:
    """Possessive and naive plural endings off; the order of the rules matters."""
    word = F.regexp_replace(F.lower(word), r"'s$", "")
    return (
        F.when(word.rlike("ies$") & (F.length(word) > 4), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(s|x|h)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("[^s]s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def stamp(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = seconds.cast("long")
    short = F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    return F.when(s < 3600, short).otherwise(F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm of whole milliseconds."""
    ms = ms.cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def clock_seconds(text: Column) -> Column:
    """h:m:s, m:s or s as whole seconds; null if it is none of these."""
    parts = F.split(text, ":")
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda sum_, x: sum_ * 60 + x.cast("long"))
    return F.when(text.rlike(r"^[0-9]+(:[0-9]+){0,2}$"), total)


def _replaced(pattern: str, word: str, sign: str) -> Callable[[Column], Column]:
    return lambda text: F.when(text.contains(sign), F.regexp_replace(text, pattern, word)).otherwise(text)


def scrub(text: Column, rules: Sequence[tuple[str, str]] = PRIVATE, needed: Sequence[str] = NEEDED) -> Column:
    """text with the rules' placeholders, one rule after the other; the transform keeps each step's text to be used twice without being made twice."""
    found = F.array(text)
    for (pattern, word), sign in zip(rules, needed, strict=True):
        found = F.transform(found, _replaced(ascii_edges(pattern), word, sign))
    return F.element_at(found, 1)


def shingled(words: Column, n: int) -> Column:
    """All n consecutive elements of an array, joined by a space."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda k: F.array_join(F.slice(words, k, n), " "))).otherwise(F.array().cast("array<string>"))


#: A word's edge among ASCII letters; before Java 19 a plain \b counts accented letters as letters, and any Java's (?i) leaves out the two signs beyond ASCII that fold to letters of it.
EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
NO_EDGE = "(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"
FOLDED = {"s": "\u017f", "k": "\u212a"}


def ascii_edges(pattern: str) -> str:
    """A pattern for Java as RE2 takes it: its \\b and \\B, and its case if it begins with (?i)."""
    if pattern.startswith("(?i)"):
        parts = re.split(r"(\\.|\[[^\]]*\])", pattern[4:])
        literal = [re.sub("[sk]", lambda m: f"[{m[0]}{FOLDED[m[0]]}]", part) for part in parts[::2]]
        other = [part.replace("a-z", "a-z" + "".join(FOLDED.values())) for part in parts[1::2]]
        pattern = "(?i)" + "".join(x for both in zip(literal, [*other, ""], strict=True) for x in both)
    return pattern.replace(r"\b", EDGE).replace(r"\B", NO_EDGE)


def classified(text: Column, rules: Sequence[tuple[str, str, int]]) -> Column:
    """The kind of the first rule (kind, pattern, least matches) that fits, null if none does."""
    rules = [(kind, ascii_edges(pattern), least) for kind, pattern, least in rules]
    return F.coalesce(*[F.when(text.rlike(pattern) if least == 1 else F.regexp_count(text, F.lit(pattern)) >= least, F.lit(kind)) for kind, pattern, least in rules])


def motion_kind(text: Column) -> Column:
    return classified(text, MOTIONS)
