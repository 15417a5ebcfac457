"""Column functions over text: words, rules, time codes, colours, names.  All run inside the JVM."""

from __future__ import annotations

import functools
import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import lexicon

# Fixed values.
STOPWORDS = (
    "the a an and or but so then that this these those there here what when where who whom which why how "
    "is are was were be been being am do does did doing have has had having will would can could should "
    "may might must shall i you he she it we they me him her us them my your his its our their "
    "of in on at to for with from by as about into over after before under between out up down off again "
    "not no nor only own same than too very just now also really actually thing things like know think "
    "le la les un une des du de et ou mais donc car ne pas plus moins que qui quoi dont ou est sont etait "
    "etaient avoir etre fait faire dans sur pour avec sans sous chez vers par ce cet cette ces mon ton son "
    "notre votre leur nous vous ils elles je tu il elle on y en au aux se sa ses lui leurs tout tous toute "
    "comme quand meme aussi tres bien alors apres avant encore deja parce"
).split()
FILLER_WORDS = "um umm ummm uh uhh uhm erm hmm hm mhm huh".split()
HALLUCINATIONS = [
    "you", "oh", "thank you", "thanks", "thank you for watching", "thanks for watching", "please subscribe", "subscribe", "bye", "bye bye", "the end",
    "music", "applause", "silence", "outro", "merci", "merci d'avoir regardé", "sous-titres réalisés par la communauté d'amara.org", "abonnez-vous", "au revoir", "à bientôt",
]


#: White space of the column functions, as Java and SQL have it: Python's own has the separators 1C to 1F as well.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class White(NamedTuple):
    """Characters that part words, those that trimming takes, and what an İ is in lower case."""

    parts: str
    trims: str
    dotted: str = "i\u0307"

    def lower(self, text: str) -> str:
        return text.replace("İ", self.dotted).lower()


#: As the reference splits texts, and as SQL does: its \s is ASCII's without U+000B, its trim() takes spaces only.
UNICODE = White(WHITE, WHITE)
SQL = White("\t\n\x0c\r ", " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000", "i")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column, white: White = UNICODE) -> Column:
    """Words split at white space, Unicode's unless told otherwise, as an array without blanks."""
    return F.filter(F.split(text, r"(?U)\s+" if white == UNICODE else f"[{white.parts}]+"), lambda w: w != "")


def word_count(text: Column, white: White = UNICODE) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")), white))


def lower(text: Column, white: White = UNICODE) -> Column:
    """Lower-cased: SQL takes each character by itself, Java İ as two and a Σ by what is beside it."""
    return F.lower(F.translate(text, "İΣ", "iσ") if white == SQL else text)


def topic_tokens(text: Column, white: White = UNICODE) -> Column:
    """Lower-cased runs of three letters or more that are not stop words."""
    found = F.regexp_extract_all(lower(text, white), F.lit(r"\p{L}{3,}"), F.lit(0))
    return F.array_distinct(F.array_except(found, F.array(*[F.lit(w) for w in dict.fromkeys(STOPWORDS)])))


def bare(text: Column) -> Column:
    """Text as SQL's rules read it: marks, joiners, ties, circled letters, numbers and spaces beyond ASCII are not in \\w, \\d, \\s or at \\b, nor U+000B, and ı and ſ are no i and s."""
    return F.regexp_replace(F.translate(text, "ıſ", "__"), r"(?U)[[\w\s]&&[^\p{L}\x00-\x7F]]|\x0B", "\ufffd")


def matches(text: Column, pattern: str) -> Column:
    return text.rlike("(?iuU)" + pattern)


def rule_score(text: Column, rules: list[tuple[str, float]]) -> Column:
    """1 - exp(-sum of the weights of the rules that match).

    exp is the C library's: Java's is a unit off in the last place at some sums, and windows that nearly tie are ordered
    by that place.  So the scores of all sums that the rules can reach are a table; with over 4,096 sums exp is Java's.
    """
    hits, sums = F.lit(0.0), {0.0}
    for pattern, weight in rules:
        hits = hits + F.when(matches(text, pattern), F.lit(float(weight))).otherwise(F.lit(0.0))
        sums = sums if len(sums) > 4096 else sums | {s + float(weight) for s in sums}
    if len(sums) > 4096:
        return F.lit(1.0) - F.exp(-hits)
    sums = sorted(sums)  # small sums are the most frequent
    listed = lambda values: "array(" + ", ".join(f"{v!r}D" for v in values) + ")"
    return F.element_at(F.expr(f"map_from_arrays({listed(sums)}, {listed([1.0 - math.exp(-s) for s in sums])})"), hits)


def profile(text: Column, rules: dict) -> Column:
    """Struct of the seven category scores, weak_start and tags (categories of 0.5 or more)."""
    cats = [*lexicon.CATEGORIES, "weak_start"]
    scores = let(bare(text), lambda t: F.struct(*[rule_score(t, rules[c]).alias(c) for c in cats]))
    return let(scores, lambda s: F.struct(*[s[c].alias(c) for c in cats], F.filter(F.array(*[F.when(s[c] >= 0.5, F.lit(c)) for c in lexicon.CATEGORIES]), lambda t: t.isNotNull()).alias("tags")))


def _any(text: Column, rules: list[tuple[str, float]]) -> Column:
    return let(bare(text), lambda t: functools.reduce(lambda a, b: a | b, [matches(t, pattern) for pattern, _ in rules]))


def is_transition(text: Column) -> Column:
    return _any(text, lexicon.TRANSITION_OUT)


def is_filler(text: Column) -> Column:
    """A line of at most five words that is a bare acknowledgement."""
    return _any(text, lexicon.FILLER_ONLY) & (word_count(text) <= 5)


def is_filler_word(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"^[ .,!?…-]+|[ .,!?…-]+$", "")).isin(FILLER_WORDS)


def normalised(text: Column) -> Column:
    """Lower-cased letters, digits and white space only."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}\s]", ""), r"(?U)^\s+|\s+$", "")


def is_hallucination(text: Column, no_speech: Column, logprob: Column) -> Column:
    """Junk that a recogniser emits over silence: blank; three words at most and unsure twice; a bracketed tag; a stock phrase and unsure."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    n = normalised(t)
    ns, lp = F.coalesce(no_speech, F.lit(0.0)), F.coalesce(logprob, F.lit(0.0))
    return (t == "") | ((ns >= 0.6) & (lp < -0.5) & (word_count(n) <= 3)) | t.rlike(r"(?s)^[\[(♪].*[\])♪]$") | (t == "♪") | ((ns >= 0.5) & n.isin(HALLUCINATIONS))


def fmt_ts(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from one hour; fractions are cut, negatives are zero."""
    s = F.floor(F.greatest(F.lit(0.0), seconds.cast("double"))).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    tail = F.concat(two(m), F.lit(":"), two(r))
    return F.when(h > 0, F.concat(two(h), F.lit(":"), tail)).otherwise(tail)


def hex_to_ass(colour: Column) -> Column:
    """#RRGGBB, #AARRGGBB or #RGB as &HAABBGGRR; anything else is white."""
    c = F.regexp_replace(F.trim(F.coalesce(colour, F.lit(""))), "^#+", "")
    alpha = F.when(F.length(c) == 8, F.substring(c, 1, 2)).otherwise(F.lit("00"))
    c = F.when(F.length(c) == 8, F.substring(c, 3, 6)).otherwise(c)
    c = F.when(F.length(c) == 3, F.regexp_replace(c, "(.)", "$1$1")).otherwise(c)
    c = F.when(F.length(c) == 6, c).otherwise(F.lit("FFFFFF"))
    return F.upper(F.concat(F.lit("&H"), alpha, F.substring(c, 5, 2), F.substring(c, 3, 2), F.substring(c, 1, 2)))


def safe_stem(name: Column, limit: int = 60, white: White = UNICODE) -> Column:
    """Letters, digits and other numbers (x², ½), marks, white space, underscores, dots and dashes only; spaces become underscores; empty: clips."""
    s = F.regexp_replace(name, r"(?U)[^\p{L}\p{N}\p{M}_." + white.parts + "-]", "")  # Java's \w lacks ² and has joiners, ties and circled letters
    s = F.substring(F.replace(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), F.lit(" "), F.lit("_")), 1, limit)
    return F.when(s == "", F.lit("clips")).otherwise(s)


def excerpt(text: Column, limit: int = 620) -> Column:
    """Short texts whole; longer ones as 60 % of the limit from the head and 35 % from the tail, cut at spaces."""
    t = F.array_join(words(F.coalesce(text, F.lit(""))), " ")
    head, tail = F.left(t, F.lit(int(limit * 0.6))), F.right(t, F.lit(int(limit * 0.35)))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit(" […] "), F.regexp_replace(tail, r"^[^ ]* ", "")))


def caption_text(text: Column, uppercase: bool = True, strip_punct: bool = True) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(t, '[,.!?;:"“”«»]+$', "") if strip_punct else t
    return F.translate(F.upper(t) if uppercase else t, "{}", "()")


def chars_per_line(width: Column, font_size: Column, margin: Column) -> Column:
    return F.greatest(F.lit(8), F.floor(F.greatest(F.lit(1), width - 2 * margin) / F.greatest(F.lit(1.0), font_size * 0.58)).cast("int"))


def as_number(value: Column) -> Column:
    """First token, comma as point, other characters dropped; null if nothing is left."""
    return F.regexp_replace(F.replace(F.element_at(F.concat(words(value), F.array(F.lit(""))), 1), F.lit(","), F.lit(".")), r"[^0-9.\-]", "").try_cast("double")


def merge_maps(left: Column, right: Column) -> Column:
    """One map of both; where a key is in both, the right value unless it is null."""
    return F.map_zip_with(left, right, lambda _, a, b: F.coalesce(b, a))
