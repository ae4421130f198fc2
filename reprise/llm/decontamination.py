"""Benchmark decontamination by template canonicalisation, in built-in functions only.

Texts are lower-cased and stripped of punctuation; numbers, capitalised words and units behind numbers are marked with a
type. A template is the sequence of words with marked ones reduced to their type, so that a question with other numbers or
names has the same template. Windows of a template are joined by hash with those of the benchmark; a window matches if its
slots are consistent too: equal where the item's are equal, different where they differ.

Whether a capitalised word is a name can't be told where a sentence or line may begin, and case can be lost. So windows are
taken in several forms, on both sides (FORMS): names inside a sentence are slots; all capitalised words are; none are.
Windows of the item need a least number of plain words in a form, so that rows of numbers don't match each other. Where
numbers are too many even if names count as plain, and in items too short, windows are matched with all values kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpoint, let, with_key

WINDOW = 13  #: words; shorter items are matched whole
SHORTEST = 5  #: words of an item that is matched by template; shorter ones are matched with all values
LEAST_PLAIN = 0.5  #: share of a window's words that aren't slots, for a match by template
FEW = 500_000  #: benchmark windows that are broadcast
NUMBER, NAME, UNIT, INITIAL = "\x01", "\x02", "\x03", "\x04"  #: INITIAL: capitalised where a sentence or line may begin
#: How marks are read: from, to. Exact keeps all words.
FORMS = {"inside": (INITIAL, ""), "capitalised": (INITIAL, NAME), "folded": (NAME + INITIAL, ""), "exact": (NUMBER + NAME + UNIT + INITIAL, "")}

# Units that are a slot behind a number.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr hours minutes seconds days weeks years km/h mph percent dollars euros usd eur".split()


def canonical(text: Column) -> Column:
    """The words of a text; slots keep their value behind the mark of their type."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?=\p{Lu}\p{Ll})(?<=(?:^|[\x20\x09-\x0D])[\"'(\[“‘«]?)", INITIAL)
    t = F.regexp_replace(t, rf"{INITIAL}(?<=[\p{{Ll}},;] {INITIAL})", NAME)
    t = F.lower(t)
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    numbers = F.regexp_replace(t, r"(?=\p{N})(?<![\p{L}\p{N}.,])", NUMBER)
    numbers = F.regexp_replace(numbers, rf"({NUMBER}[\p{{N}}.,]+) ?({units})(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    t = F.when(t.rlike(r"\p{N}"), numbers).otherwise(t)
    t = F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}\x20\x09-\x0D{NUMBER}{NAME}{UNIT}{INITIAL}]+", "")
    return F.filter(F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1)), lambda w: (w >= F.lit("\x05")) | ~w.isin(NUMBER, NAME, UNIT, INITIAL))


def _slot(w: Column) -> Column:
    return w < F.lit("\x04")


def read(words: Column, form: str) -> Column:
    """The words with their marks as the form reads them."""
    return F.transform(words, lambda w: F.when(w < F.lit("\x05"), F.translate(w, *FORMS[form])).otherwise(w))


def _hash(w: Column) -> Column:
    return F.xxhash64(F.when(_slot(w), F.substring(w, 1, 1)).otherwise(w))


def _cuts(hashes: Column, widths: list[int], row, kind: str) -> Column:
    """row(hash, at, width) of each window, from the hashes of words. Hashes of 2, 4, 8 words are made of each other; two of them that overlap make those of a width between."""

    def joined(of: Column, n: int) -> Column:
        return F.zip_with(of, F.slice(of, n + 1, F.greatest(F.size(of), F.lit(1))), lambda x, y: F.xxhash64(x, y))

    def grown(powers: list[Column], n: int) -> Column:
        if 2 * n <= max(widths):
            return let(joined(powers[-1], n), lambda x: grown([*powers, x], 2 * n))

        def cut(width: int) -> Column:
            k = width.bit_length() - 1
            whole = powers[k] if width == 1 << k else joined(powers[k], width - (1 << k))
            part = F.slice(whole, F.lit(1), F.greatest(F.size(powers[0]) - (width - 1), F.lit(0)))
            return part if row is None else F.transform(part, lambda h, i: row(h, i + 1, width))

        return F.concat(*map(cut, widths)) if widths else F.array().cast(f"array<{kind}>")

    return let(hashes, lambda hs: grown([hs], 1))


def templates(words: Column, widths: dict[str, list[int]]) -> Column:
    """array of the template hashes of all windows, by form; a form that reads a text like the first is left out."""

    def of(ws: Column, plain: Column) -> Column:
        def cuts(form: str) -> Column:
            hashes = F.zip_with(ws, plain, lambda w, h: F.coalesce(h, let(F.translate(w, *FORMS[form]), _hash)))
            return _cuts(hashes, widths[form], None, "bigint")

        found = []
        for form in widths:
            differs = {"capitalised": (INITIAL,), "folded": (NAME,)}.get(form) if widths.get("inside") == widths[form] else None
            some = F.exists(ws, lambda w: F.substring(w, 1, 1).isin(*differs)) if differs else F.lit(True)
            found.append(F.when(some, cuts(form)).otherwise(F.array().cast("array<bigint>")))
        return F.concat(*found)

    # the hashes of words without a mark are the same in all forms
    return let(words, lambda ws: let(F.transform(ws, lambda w: F.when(w >= F.lit("\x05"), F.xxhash64(w))), lambda plain: of(ws, plain)))


def windows(words: Column, widths: dict[str, list[int]]) -> Column:
    """array of struct(width, at, hash, slots, plain): the template's hash, that of the slots' pattern, and the number of plain words of each window and form."""
    none = F.lit(0).cast("long")

    def pattern(part: Column) -> Column:
        places = F.transform(part, lambda w: F.when(_slot(w), F.array_position(part, w)).otherwise(none))
        return F.when(F.exists(part, _slot), F.xxhash64(places)).otherwise(none)

    def cuts(form: str) -> Column:
        def of(ws: Column) -> Column:
            def row(h: Column, i: Column, width: int) -> Column:
                part = F.slice(ws, i, width)
                return F.struct(F.lit(form).alias("form"), F.lit(width).alias("width"), i.alias("at"), h.alias("hash"), let(part, pattern).alias("slots"), F.size(F.filter(part, lambda w: ~_slot(w))).alias("plain"))

            return _cuts(F.transform(ws, _hash), widths[form], row, "struct<form:string,width:int,at:int,hash:bigint,slots:bigint,plain:int>")

        return let(read(words, form), of)

    return F.concat(*[cuts(form) for form in widths])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, form, width, hash, slots of the windows that are matched: all of WINDOW words, or an item's only one if it is shorter.

    Each window with enough plain words is there by template, in each form; the others, and items under SHORTEST, with all values.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), canonical(F.col("text")).alias("words"))
    found = items.withColumn("w", F.explode(windows(F.col("words"), {form: list(range(1, WINDOW + 1)) for form in FORMS}))).select("item_id", F.size("words").alias("n"), "w.*").where(F.col("width") == F.least("n", F.lit(WINDOW)))
    enough = (F.col("plain") >= F.col("width") * LEAST_PLAIN) & (F.col("width") >= SHORTEST)
    exact = F.col("form") == "exact"
    kept = found.where(~exact & enough).select("item_id", "form", "width", "hash", "slots")
    poor = found.where((F.col("form") == "folded") & ~enough).select("item_id", "width", "at")
    return kept.unionByName(found.where(exact).join(poor, ["item_id", "width", "at"], "left_semi").select(*kept.columns)).distinct()


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, __k1, __k2, row, item_id, n_windows of each row of docs and item that share a window. docs: with keys.

    Templates come first, for all rows; the pattern of slots is looked at in rows that share a template only.
    """
    bench = checkpoint(benchmark_windows(benchmark))
    sizes = bench.groupBy("form", "width").count().collect()  # a row for each form and width
    widths = {form: sorted(r.width for r in sizes if r.form == form) for form in FORMS}
    widths = {form: w for form, w in widths.items() if w} or {"inside": [WINDOW]}
    small = F.broadcast if sum(r["count"] for r in sizes) <= FEW else lambda x: x
    of = docs.select("__k1", "__k2", F.explode(templates(canonical(F.col("text")), widths)).alias("hash"))
    keys = checkpoint(of.join(small(bench.select("hash").distinct()), "hash", "left_semi").select("__k1", "__k2").distinct())
    few = docs.select("doc_id", "text", "__k1", "__k2").join(F.broadcast(keys) if keys.count() <= FEW else keys, ["__k1", "__k2"], "left_semi")
    few = checkpoint(few.select(F.col("doc_id").cast("long").alias("doc_id"), "__k1", "__k2", F.monotonically_increasing_id().alias("row"), canonical(F.col("text")).alias("words")))
    each = few.select("doc_id", "__k1", "__k2", "row", F.explode(windows(F.col("words"), widths)).alias("w")).select("doc_id", "__k1", "__k2", "row", "w.width", "w.at", "w.hash", "w.slots")
    matched = each.join(small(bench.select("item_id", "width", "hash", "slots").distinct()), ["width", "hash", "slots"])
    return matched.select("doc_id", "__k1", "__k2", "row", "item_id", "width", "at").distinct().groupBy("doc_id", "__k1", "__k2", "row", "item_id").agg(F.count("*").alias("n_windows"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows: the windows of the document that match the item, for all pairs that share one.

    Null and empty texts match nothing. Rows that repeat a doc_id add up; a null doc_id is a document like others.
    """
    return _found(with_key(docs.select("doc_id", "text")), benchmark).groupBy("doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that share a window with the benchmark; rows are told apart by doc_id and text."""
    keyed = with_key(docs)
    bad = _found(keyed.select("doc_id", "text", "__k1", "__k2"), benchmark).select("__k1", "__k2").distinct()
    return keyed.join(bad, ["__k1", "__k2"], "left_anti").select(*docs.columns)
