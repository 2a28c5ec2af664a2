"""String building blocks as column expressions, with Unicode white space throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Openings that mark a short reply as a refusal.
REFUSALS = (
    "i don't know", "i don't have", "i do not have", "i cannot", "i can't", "i'm unable", "i am unable", "i'm not able", "i am not able",
    "sorry", "i'm sorry", "i am sorry", "i apologize", "unfortunately, i", "unfortunately i", "no information", "not sure",
)
#: Latin letters and the Cyrillic ones that look the same.
CONFUSABLE_LATIN = "aceijopsxyABCEHKMOPTX"
CONFUSABLE_CYRILLIC = "асеіјорѕхуАВСЕНКМОРТХ"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Pieces between runs of white space, without empty ones."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def loose(c: Column) -> Column:
    """White-space runs to one space, ends stripped (callers pass NFC text)."""
    return F.array_join(words(c), " ")


def folded(c: Column) -> Column:
    """Lower case with sharp s spelled out, which is full case folding for Latin text."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def alnum_tokens(c: Column) -> Column:
    """Distinct [a-z0-9]+ tokens after folding."""
    return F.array_distinct(F.regexp_extract_all(folded(c), F.lit("[a-z0-9]+"), F.lit(0)))


def set_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def ascii_classes(pattern: str) -> str:
    """A pattern for Java whose word bounds, white space, words and digits are ASCII's, as SQL engines have them."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        step = 2 if pattern[i] == "\\" else 1
        piece = pattern[i : i + step]
        inside = piece == "[" or inside and piece != "]"
        if piece == r"\s":
            piece = r"\t\n\f\r " if inside else r"[\t\n\f\r ]"
        elif piece == r"\b" and not inside:
            piece = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
        out, i = out + piece, i + step
    return out


def verdict(reply: Column, ascii_words: bool = False) -> Column:
    """true, false, or null for unknown: the leading word decides, else the only one of yes and no that occurs.

    Words are Unicode's; with ``ascii_words`` an accented letter ends one, as in SQL.
    """
    low = F.lower(F.coalesce(reply, F.lit("")))
    rule = ascii_classes if ascii_words else lambda p: "(?U)" + p
    lead = F.regexp_extract(low, rule(r"^\W*(yes|no)\b"), 1)
    yes, no = low.rlike(rule(r"\byes\b")), low.rlike(rule(r"\bno\b"))
    return F.when(lead != "", lead == "yes").when(yes & ~no, True).when(no & ~yes, False)


def refusal(reply: Column) -> Column:
    """Short replies that open with a refusal."""
    text = F.lower(strip(F.coalesce(reply, F.lit(""))))
    opening = F.exists(F.array(*[F.lit(p) for p in REFUSALS]), lambda p: F.startswith(text, p))
    return (text != "") & (F.length(text) <= 240) & opening


def homoglyphs(c: Column) -> Column:
    return F.translate(c, CONFUSABLE_LATIN, CONFUSABLE_CYRILLIC)


def zero_width(c: Column) -> Column:
    """A zero-width space between all characters."""
    return F.regexp_replace(c, r"(?s)(.)(?=.)", "$1​")


def right_to_left(c: Column) -> Column:
    return F.concat(F.lit("‮"), c)


def json_path(c: Column, path: str) -> Column:
    """Dotted path with list indexes into a JSON string."""
    steps = "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in path.split(".") if s)
    return F.get_json_object(c, f"${steps}")
