"""Words, tokens and small text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that words for patterns may not hold.
LIKE_SIGNS = "%_\\"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = "[" + "".join("\\" + c for c in PUNCTUATION) + "]"


def edge_words(s: Column) -> Column:
    """Words; space at the string's edges stays with the first and the last one, and is a word of its own if there is no other. Space is the blank and the characters 9 to 13."""
    return F.regexp_extract_all(s, F.lit(r"((?:^\s+)?\S+(?:\s+$)?|^\s+$)"), F.lit(1))


def clean_words(words: Column, shortest: int, longest: int) -> Column:
    """Words without wildcards that aren't punctuation alone, bare of it at the edges, of a length within the bounds."""
    plain = F.filter(words, lambda w: ~w.rlike(r"[%_\\]") & ~w.rlike(f"^{_CLASS}*$"))
    bare = F.transform(plain, lambda w: F.regexp_replace(w, f"^{_CLASS}+|{_CLASS}+$", ""))
    return F.filter(bare, lambda w: F.length(w).between(shortest, longest))


def masked_signs(s: Column) -> Column:
    """Punctuation, wildcards and spaces as underscores."""
    return F.regexp_replace(s, f"{_CLASS}| ", "_")


def split_filled(s: Column, sign: str) -> Column:
    """Parts between a sign, without empty ones."""
    return F.filter(F.split(s, "\\Q" + sign + "\\E"), lambda x: x != "")


def chunks(s: Column, n: int) -> Column:
    """Pieces of n characters, the last one shorter."""
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)), F.lit(n)), lambda i: F.substr(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def alphanumeric(s: Column) -> Column:
    """Letters, digits and spaces of a text; other runs go."""
    return F.regexp_replace(s, "[^A-Za-z0-9 ]+", "")


def alias(table: Column) -> Column:
    """A table's alias: the initials of the words of its name."""
    return F.array_join(F.transform(split_filled(table, "_"), lambda w: F.substring(w, 1, 1)), "")


def readable(n: Column) -> Column:
    """A number of bytes with its unit: powers of 1024, one decimal."""
    out = F.concat(F.format_string("%.1f", n / F.lit(1024.0**4)), F.lit(" TB"))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(F.abs(n) < 1024 ** (k + 1), F.concat(F.format_string("%.1f", n / F.lit(1024.0**k)), F.lit(f" {unit}"))).otherwise(out)
    return out


def normalised_tail(q: Column) -> Column:
    """In the last wildcard run only the last `%` stays."""
    tail = F.regexp_extract(q, "([%_]*)$", 1)
    cut = F.regexp_replace(tail, "%(?=[%_]*%)", "")
    return F.concat(F.regexp_extract(q, "(?s)^(.*?)[%_]*$", 1), cut)


def left_to_place(q: Column) -> Column:
    """For each character of a pattern the number of signs but `%` from there to the end."""
    n = F.length(q)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.length(F.replace(F.substr(q, i), F.lit("%"), F.lit(""))))).otherwise(F.array().cast("array<int>"))


def one_hot(s: Column, letters: str, width: int) -> Column:
    """0/1 of each letter at each of the first `width` places, place by place."""
    at = F.sequence(F.lit(1), F.lit(width))
    return F.flatten(F.transform(at, lambda i: F.transform(F.array(*[F.lit(c) for c in letters]), lambda c: ((F.length(s) >= i) & (F.substr(s, i, F.lit(1)) == c)).cast("int"))))


def hashed(s: Column, buckets: int, width: int) -> Column:
    """Buckets (from 1) of the first `width` characters' code points; 0 fills up."""
    at = F.sequence(F.lit(1), F.lit(width))
    code = lambda i: F.conv(F.hex(F.encode(F.substr(s, i, F.lit(1)), "UTF-32")), 16, 10).cast("int")
    return F.transform(at, lambda i: F.when(i > F.length(s), F.lit(0)).otherwise(code(i) % buckets + 1))
