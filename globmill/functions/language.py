"""Patterns as strings of characters with marks for what stands between them, for models that read one sign at a time.

A plain `%` between two characters is the default and has no mark. START, END and JOINED mark that nothing stands there;
other wildcard runs have a mark each. In the reading form a mark follows the character that it stands before, so that
every prefix is a pattern of its own: a character is first placed anywhere later, then its gap is tightened.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

#: Marks of the start, the end, and of two characters that stand together.
START, END, JOINED = (chr(0xE000 + i) for i in range(3))
#: A wildcard run's mark: the code point of its kind that many underscores on. OPEN: runs with a `%`, SHUT: runs without. All marks are of the private use area, so a run may have MOST underscores.
OPEN, SHUT, MOST = 0xE010, 0xEC80, 3000
_ANY = f"[{START}-{chr(SHUT + MOST)}]"
_NONE = f"[^{START}-{chr(SHUT + MOST)}]"


def _mark(run: Column) -> Column:
    under = F.length(F.replace(run, F.lit("%"), F.lit("")))
    code = under + F.when(F.contains(run, F.lit("%")), OPEN).otherwise(SHUT)
    return F.when(under <= MOST, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _run(mark: Column) -> Column:
    code = F.conv(F.hex(F.encode(mark, "UTF-32")), 16, 10).cast("int")
    return F.when(code >= SHUT, F.repeat(F.lit("_"), code - SHUT)).otherwise(F.concat(F.lit("%"), F.repeat(F.lit("_"), code - OPEN)))


def marked(q: Column) -> Column:
    """The canonical pattern with marks in their own places."""
    spread = lambda r: F.array_join(F.filter(F.split(r, ""), lambda ch: ch != ""), JOINED)
    parts = F.transform(P.runs(q), lambda r: F.when(r == "%", "").when(P.is_wild(r), _mark(r)).otherwise(spread(r)))
    body = F.when(~F.exists(parts, lambda x: x.isNull()), F.array_join(parts, ""))
    whole = F.concat(F.when(q.rlike("^[^%_]"), START).otherwise(""), body, F.when(q.rlike("[^%_]$"), END).otherwise(""))
    return F.when(q == "%", JOINED).when(q != "", whole)


def encode(q: Column) -> Column:
    """form, ends: the reading form and whether its last sign is a mark that nothing follows. Null for the empty pattern and for runs of more than MOST underscores."""
    m = marked(q)
    return F.when(m.isNotNull(), F.struct(F.regexp_replace(m, f"(?s)({_ANY})({_NONE})", "$2$1").alias("form"), m.rlike(f"{_ANY}$").alias("ends")))


def decode(form: Column, ends: Column) -> Column:
    """The pattern again; prefixes of a form (ends false) decode too."""
    body = F.when(ends, F.left(form, F.length(form) - 1)).otherwise(form)
    last = F.when(ends, F.right(form, F.lit(1))).otherwise("")
    m = F.concat(F.regexp_replace(body, f"(?s)({_NONE})({_ANY})", "$2$1"), last)
    q = F.regexp_replace(m, f"(?s)^(?={_NONE})|(?<={_NONE})(?={_NONE})|(?<={_NONE})$", "%")
    plain = F.transform(F.split(q, ""), lambda ch: F.when(ch.isin(START, END, JOINED), "").when(ch.rlike(_ANY), _run(ch)).otherwise(ch))
    return F.when(m == JOINED, "%").otherwise(F.array_join(plain, ""))


def steps(q: Column) -> Column:
    """Patterns of all prefixes of the reading form, the whole last."""
    e = encode(q)
    n = F.length(e["form"])
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: decode(F.left(e["form"], i), e["ends"] & (i == n))))
