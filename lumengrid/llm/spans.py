"""Regular-expression matches with code-point positions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<struct<start:int,end:int,text:string>>"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it appears."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Matches whose positions are summed in one go: long lists are worked in blocks of so many.
BLOCK = 128


def find_spans(text: Column, pattern: str, hint: str | None = None) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, text), end exclusive.

    The pieces between matches and the matches themselves alternate, so
    positions are running sums of their lengths, taken block by block, so that
    time follows the number of matches.  The pattern must not match the empty
    string.  Null text has no matches.  ``hint`` is a cheap pattern that every
    text with a match holds.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))

    def positions(block: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + F.length(x["m"])
            return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text")))).alias("spans"))

        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(EMPTY).alias("spans")), step)["spans"]

    def in_blocks(all_pairs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(all_pairs) - 1) / BLOCK).cast("int"))
        blocks = F.transform(starts, lambda k: F.slice(all_pairs, k * BLOCK + 1, F.lit(BLOCK)))
        length = lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x["gap"] + F.length(x["m"]))
        bases = lambda bs: F.aggregate(F.transform(bs, length), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, F.lit(-1)) + n)))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, F.slice(bases(bs), F.lit(1), F.size(bs)), positions)))

    spans = let(pairs, lambda p: F.when(F.size(p) <= BLOCK, positions(p, F.lit(0))).otherwise(in_blocks(p)))
    some = text.rlike(pattern) if hint is None else F.when(text.rlike(hint), text.rlike(pattern)).otherwise(False)
    return F.when(some, spans).otherwise(F.array().cast(EMPTY))


def clear_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of ``others``, which are sorted by start.

    Others are looked through in blocks, so that most are passed over unseen.
    """
    overlap = lambda s, o: (o["start"] < s["end"]) & (o["end"] > s["start"])

    def in_blocks(os: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(os) - 1) / BLOCK).cast("int"))
        blocks = F.transform(starts, lambda k: F.slice(os, k * BLOCK + 1, F.lit(BLOCK)))
        hulls = F.transform(blocks, lambda b: F.struct(F.element_at(b, F.lit(1))["start"].alias("start"), F.array_max(F.transform(b, lambda o: o["end"])).alias("end"), b.alias("block")))
        return let(hulls, lambda hs: F.filter(spans, lambda s: ~F.exists(hs, lambda h: F.when(overlap(s, h), F.exists(h["block"], lambda o: overlap(s, o))).otherwise(False))))

    return F.when(F.size(spans) == 0, spans).otherwise(let(others, lambda os: F.when(F.size(os) <= BLOCK, F.filter(spans, lambda s: ~F.exists(os, lambda o: overlap(s, o)))).otherwise(in_blocks(os))))


def replace_spans(text: Column, pattern: str, change) -> Column:
    """The text with every match replaced by ``change(match)``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), put_back(text, pattern, F.transform(found, change))).otherwise(text)


def put_back(text: Column, pattern: str, new: Column) -> Column:
    """The text with its matches replaced by the strings of ``new``, in order."""
    pieces = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(pieces, F.concat(new, F.array(F.lit(""))), lambda p, m: F.concat(p, m)), "")
