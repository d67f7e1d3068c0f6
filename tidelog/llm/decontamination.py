"""Benchmark decontamination by template windows, in DataFrame operations only.

Texts become token sequences in which numbers, names (capitalised words within a sentence) and units after a number are typed placeholders; all else is
lower-cased and stripped of punctuation. Windows of WINDOW tokens of each benchmark item are joined by hash to those of all documents. An item
leaks into a document if at least COVER of its windows, or of those that match as templates, occur there. Where an item's windows hold slots, the fillings are compared as well: a
re-parameterised copy replaces each value by one other throughout, so the share of values with a single partner, both ways, must reach CONSISTENT.
A template can occur many times in a document, or within itself. All places where a window occurs count: windows of one copy share the distance
between document and item, so fillings are compared for each distance alone, for each with what lies up to SHIFT tokens beside it (of each window the
nearest: copies with words put in or left out), and for the first places of all windows. The best of these readings decides.

Characters of scripts without spaces between words (Chinese, Japanese, Thai, Lao, Khmer, Burmese) are a token each.

Items of fewer tokens than WINDOW have one window, the whole item. Windows with fewer than half of literal tokens, and items of fewer than LEAST tokens, are too common as
templates; they match the same tokens as they stand only (numbers and names included), by the hash of these. leaks() reports items of any length; cleaned() leaves
those of fewer than LEAST tokens out, as a document that holds two or three common words in a row is no leak.

Defined results: null or empty texts, and items without letters or digits, have no windows. Rows without item_id or doc_id take no part. Repeated rows give one result row;
of several texts of one doc_id each is read by itself, and one that leaks makes the result. Other columns, of whatever name, have no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW, LEAST, COVER, CONSISTENT, SHIFT = 8, 5, 0.5, 0.9, 8
#: So many distinct benchmark windows (8 bytes of hash, two numbers each) are broadcast at most; more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000

NAME, NUMBER, UNIT = "\u0001n", "\u0001d", "\u0001u"
UNITS = "km|cm|mm|nm|m|miles?|mi|feet|foot|ft|inch(?:es)?|yards?|kg|mg|g|lbs?|pounds?|ounces?|oz|tons?|ml|l|lit(?:er|re)s?|gallons?|seconds?|secs?|s|minutes?|mins?|hours?|hrs?|h|days?|weeks?|months?|years?|dollars?|euros?|cents?|usd|eur|percent|%|degrees?|hz|khz|mhz|ghz|kb|mb|gb|tb|w|kw|v|ml"


#: Their characters, digits and marks of other scripts apart.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}&&[^\p{Nd}]]"


def _spaced(text: Column) -> Column:
    # Scripts are looked up only in texts with a character from the first of them (Thai) on: a range is quick to test.
    return F.when(text.rlike(r"[\x{0E00}-\x{10FFFF}]"), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)


def template_tokens(text: Column) -> Column:
    """Tokens with placeholders. Each raw token keeps its place, see raw_tokens."""
    text = _spaced(text)
    named = F.regexp_replace(text, r"(?<=[\p{Ll}\p{Nd},;:)][ \n])\p{Lu}\p{Ll}+", NAME)
    filled = F.regexp_replace(named, r"\p{Nd}+(?:[.,:/]\p{Nd}+)*", NUMBER)
    united = F.regexp_replace(filled, f"(?i)({NUMBER}[ -]?)(?:{UNITS})(?![\\p{{L}}\\p{{N}}])", "$1" + UNIT)
    lower = F.lower(F.when(text.rlike(r"\p{Nd}"), united).otherwise(named))
    return F.filter(F.split(lower, r"[^\p{L}\p{M}\p{N}\u0001]+"), lambda t: t != "")


def raw_tokens(text: Column) -> Column:
    """The same tokens before replacement."""
    whole = F.regexp_replace(_spaced(text), r"(?<=\p{Nd})[.,:/](?=\p{Nd})", "")
    percent = F.regexp_replace(whole, r"(?<=\p{Nd})([ -]?)%", "$1percent")
    return F.filter(F.split(F.lower(percent), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")


def windows(tokens: Column, size: int) -> Column:
    """The hash of the window at each place (empty if tokens are fewer)."""
    starts = F.when(F.size(tokens) >= size, F.sequence(F.lit(1), F.size(tokens) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, size)))


def _slots_in(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t.contains("\u0001")))


def benchmark_windows(benchmark: DataFrame, least: int = 1) -> DataFrame:
    """Rows (item_id, variant, size, place, literal, h, slots, n_windows, n_templates) of the windows; a variant is one of the texts of an item_id. literal: the window matches as it stands
    only. n_windows and n_templates count the windows of the item, and those that match as templates. Items have at least so many tokens."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("t")).distinct().withColumn("variant", F.xxhash64("t"))
    items = items.withColumn("tokens", template_tokens(F.col("t"))).withColumn("raw", raw_tokens(F.col("t"))).where(F.size("tokens") >= least)
    # An item has windows of one size: WINDOW, or all its tokens if they are fewer. Its windows stay together until they are counted.
    items = items.where(F.size("tokens") > 0).withColumn("size", F.least(F.size("tokens"), F.lit(WINDOW)))

    def window(at: Column) -> Column:
        tokens, raw = F.slice("tokens", at + 1, F.col("size")), F.slice("raw", at + 1, F.col("size"))
        literal = (2 * _slots_in(tokens) > F.col("size")) | (F.col("size") < LEAST)
        return F.struct(at.alias("place"), literal.alias("literal"), F.when(literal, F.xxhash64(raw)).otherwise(F.xxhash64(tokens)).alias("h"))

    items = items.withColumn("windows", F.transform(F.sequence(F.lit(0), F.size("tokens") - F.col("size")), window))
    items = items.withColumn("n_windows", F.size("windows").cast("long")).withColumn("n_templates", F.size(F.filter("windows", lambda w: ~w["literal"])).cast("long"))
    found = items.select("item_id", "variant", "tokens", "raw", "size", "n_windows", "n_templates", F.inline("windows"))
    slots = F.filter(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.struct((F.col("place") + i).alias("at"), F.element_at("tokens", F.col("place") + i + 1).alias("kind"), F.element_at("raw", F.col("place") + i + 1).alias("value"))), lambda s: s["kind"].contains("\u0001"))
    # What matches as it stands has no fillings to compare.
    slots = F.when(F.col("literal"), F.slice(slots, 1, 0)).otherwise(slots)
    return found.select("item_id", "variant", "size", "place", "literal", "h", slots.alias("slots"), "n_windows", "n_templates")


def _hits(tokens: DataFrame, bench: DataFrame, sizes: list[tuple[bool, int]], near) -> DataFrame:
    """Rows (doc_id, item_id, variant, at, place, literal, slots, n_windows, n_templates), one for each place at of a document (doc_id, tokens, raw) where an item's window occurs."""

    def sized(literal: bool, size: int) -> Column:
        hashes = F.transform(windows(F.col("raw" if literal else "tokens"), size), lambda h, i: F.struct(F.lit(literal).alias("literal"), F.lit(size).alias("size"), i.alias("at"), h.alias("h")))
        if size < LEAST:
            return hashes
        # The first token of a window can be a name by what stands before it; all others are what they are in the item.
        return F.when(2 * (_slots_in(F.col("tokens")) + 1) > size, hashes).otherwise(F.slice(hashes, 1, 0)) if literal else hashes

    # One expression over all sizes in use, so each text is tokenised once.
    hashes = F.concat(*[sized(*s) for s in sizes]) if sizes else F.array().cast("array<struct<literal:boolean,size:int,at:int,h:bigint>>")
    opened = tokens.select("doc_id", F.explode(hashes).alias("w")).select("doc_id", "w.literal", "w.size", "w.at", "w.h")
    return opened.join(near(bench), ["literal", "size", "h"]).select("doc_id", "item_id", "variant", "at", "place", "literal", "slots", "n_windows", "n_templates")


#: What a hit says besides its copy and place.
HIT = ["at", "literal", "slots", "n_windows", "n_templates"]


def _cover(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, slots, cover) with COVER at least: the share of an item's windows, or of its templates alone if that is more; slots is the most in a window."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~F.col("literal")).alias("t"), F.max("slots").alias("slots"), F.max("n_windows").alias("n_windows"), F.max("n_templates").alias("n_templates"))
    return n.withColumn("cover", F.greatest(F.col("n") / F.col("n_windows"), F.try_divide("t", "n_templates"))).where(F.col("cover") >= COVER).select(*keys, "slots", "cover")


def readings(hits: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, variant, reading, at, place, slots): the ways to read the hits as one copy, each with COVER of the item's windows at least."""
    copy = ["doc_id", "item_id", "variant"]
    hits = hits.withColumn("shift", F.col("at") - F.col("place"))
    first = hits.groupBy(*copy, "place").agg(F.min_by(F.struct(*HIT), "at").alias("hit")).select(*copy, F.lit("first").alias("reading"), "place", "hit")
    alone = hits.select(*copy, F.concat(F.lit("at "), F.col("shift")).alias("reading"), "place", F.struct(*HIT).alias("hit"))
    # Each shift meets those up to SHIFT beside it by way of blocks of that length.
    anchors = hits.select(*copy, F.col("shift").alias("anchor")).distinct().withColumn("block", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda x: F.floor(F.col("anchor") / SHIFT) + x)))
    beside = hits.withColumn("block", F.floor(F.col("shift") / SHIFT)).join(anchors, [*copy, "block"]).withColumn("off", F.abs(F.col("shift") - F.col("anchor"))).where(F.col("off") <= SHIFT)
    beside = beside.groupBy(*copy, "anchor", "place").agg(F.min_by(F.struct(*HIT), F.struct("off", "at")).alias("hit"))
    beside = beside.select(*copy, F.concat(F.lit("near "), F.col("anchor")).alias("reading"), "place", "hit")
    every = stored(first.unionAll(alone).unionAll(beside).select(*copy, "reading", "place", "hit.*"), "readings")
    enough = _cover(every.withColumn("slots", F.size("slots")), [*copy, "reading"])
    return every.join(enough.select(*copy, "reading"), [*copy, "reading"], "left_semi")


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """Rows (doc_id, item_id, cover, consistent), one for each document and item (of least tokens or more) that leaks into it."""
    bench = stored(benchmark_windows(benchmark, least), "benchmark-windows")
    # Two kinds of at most WINDOW sizes.
    n, kinds = bench.agg(F.count("*"), F.collect_set(F.struct("literal", "size"))).first()
    sizes = sorted((r[0], r[1]) for r in kinds)
    near = F.broadcast if n <= BROADCAST_WINDOWS else (lambda df: df)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # From here on doc_id is the id with a hash of the text: texts of one id stay apart.
    texts = texts.select(F.struct("doc_id", F.xxhash64("text").alias("mark")).alias("doc_id"), "text")
    tokens = texts.select("doc_id", template_tokens(F.col("text")).alias("tokens"), raw_tokens(F.col("text")).alias("raw"))
    hits = _hits(tokens, bench, sizes, near)
    # An item's window counts once in a document's cover; a document's rows are combined before they move.
    hits = hits.groupBy("doc_id", "item_id", "variant", "place").agg(F.first("literal").alias("literal"), F.max(F.size("slots")).alias("slots"), F.first("n_windows").alias("n_windows"), F.first("n_templates").alias("n_templates"))
    found = stored(_cover(hits, ["doc_id", "item_id", "variant"]).withColumn("slotted", F.col("slots") > 0), "leaks")
    slotted = found.where("slotted")
    plain = found.where("not slotted").select("doc_id", "item_id", "cover", F.lit(1.0).alias("consistent"))
    best = lambda df: df.groupBy(F.col("doc_id.doc_id").alias("doc_id"), "item_id").agg(F.max("cover").alias("cover"), F.max("consistent").alias("consistent"))
    if slotted.isEmpty():
        return best(plain)
    # Only documents with slots to compare are read again, for all places of their windows.
    copy = ["doc_id", "item_id", "variant"]
    again = texts.join(slotted.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    again = stored(again.select("doc_id", template_tokens(F.col("text")).alias("tokens"), raw_tokens(F.col("text")).alias("raw")), "texts-with-slots")
    places = _hits(again, bench, sizes, near).join(slotted.select(*copy), copy, "left_semi").distinct()
    slots = readings(places).select(*copy, "reading", "at", "place", F.explode_outer("slots").alias("s"))
    filled = slots.join(again.select("doc_id", "raw"), "doc_id").select(*copy, "reading", F.col("s.kind").alias("kind"), F.col("s.value").alias("item_value"), F.try_element_at("raw", F.col("at") - F.col("place") + F.col("s.at") + 1).alias("doc_value"))
    pairs = stored(filled.distinct(), "fillings")
    # A reading without slots stands as it is.
    share = F.coalesce(F.avg(F.when(F.col("kind").isNotNull(), (F.col("partners") == 1).cast("double"))), F.lit(1.0))
    both = None
    for side, other in (("item_value", "doc_value"), ("doc_value", "item_value")):
        one = pairs.groupBy(*copy, "reading", "kind", side).agg(F.count(other).alias("partners")).groupBy(*copy, "reading").agg(share.alias(f"share_{side}"))
        both = one if both is None else both.join(one, [*copy, "reading"])
    share = both.select(*copy, F.least("share_item_value", "share_doc_value").alias("consistent")).where(F.col("consistent") >= CONSISTENT).groupBy(*copy).agg(F.max("consistent").alias("consistent"))
    return best(plain.unionAll(slotted.join(share, copy).select("doc_id", "item_id", "cover", "consistent")))


def cleaned(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """docs without the documents into which an item of least tokens or more leaks; documents without doc_id stay."""
    bad = stored(leaks(docs, benchmark, least).select("doc_id").distinct(), "leaking")
    return docs.join(bad, docs["doc_id"].cast("long") == bad["doc_id"], "left_anti")
