"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

Numbers, names and units become typed placeholders that remember their values. Windows of canonical words are hashed,
at every position of benchmark items and of documents, and meet in a hash join.
A document holds an item if, in one occurrence of it, enough of its windows match and each value in its placeholders
has one value in the document, so a question asked again with other numbers or names is caught too. Capitals tell names; so
windows with names meet folded as well, as plain words in lower case, and a copy in another case is caught.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
MARKS = f"[{NAME}{NUMBER}{UNIT}]"
POINT = "\ue003"  # a point or comma inside a number
WINDOW = 5
#: Units of measure and money that may follow a number (fixed values).
UNITS = "%|percent|mm|cm|m|km|in|inch|inches|ft|foot|feet|yd|yards?|mi|miles?|mg|g|kg|t|tons?|tonnes?|oz|lbs?|pounds?|ml|l|liters?|litres?|gallons?|s|sec|seconds?|min|minutes?|h|hrs?|hours?|days?|weeks?|months?|years?|mph|kph|dollars?|cents?|euros?|usd|eur|gbp|degrees?|c|f|k|w|kw|mw|v|hz|khz|mhz|ghz|kb|mb|gb|tb"
#: More benchmark windows than this are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 500_000


def canonical(text: Column) -> Column:
    """The words in lower case, one space between them; a placeholder is its mark followed by its value. A name is a
    capitalised word after a word or a comma in the same sentence; a unit stands right after a number; a number goes on
    after a point or comma between digits."""
    t = F.regexp_replace(text, r"([\p{Ll},;] )(?=\p{Lu})", "$1" + NAME)
    t = F.lower(t)
    t = F.regexp_replace(t, r"(?<=\d)[.,](?=\d)", POINT)
    t = F.regexp_replace(t, f"\\d[\\d{POINT}]*+", f" {NUMBER}$0 ")
    t = F.regexp_replace(t, f"({NUMBER}[\\d{POINT}]++\\s++)(" + UNITS + r")(?![\p{L}])", "$1" + UNIT + "$2")
    return F.trim(F.regexp_replace(t, f"[^\\p{{L}}\\p{{N}}{NAME}{NUMBER}{UNIT}{POINT}]++", " "))


def runs_of_words(words: Column, n: int) -> Column:
    """Every run of n words of a string with one space between words. One pass: a look ahead takes the run, the match
    itself only its first word."""
    return F.regexp_extract_all(words, F.lit(f"(?=([^ ]++(?: [^ ]++){{{n - 1}}}))[^ ]++ ?"), F.lit(1))


def windows(frame: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, template (hash of the window with values removed), folded and all (the words, with values, as one array), from
    ``words`` (canonical). Texts with names have each window twice: by its template, and folded, with names as plain words. So the same
    text meets itself whatever its capitals tell of names. No row holds a window's text; ``window_at`` gives it."""
    bare = F.regexp_replace("words", f"([{NUMBER}{UNIT}])[^ ]*+", "$1")
    named = F.col("words").contains(NAME)
    texts = frame.select(*keys, "words", bare.alias("bare"), named.alias("named"))
    runs = texts.select(
        *keys, F.split("words", " ").alias("all"),
        runs_of_words(F.when(F.col("named"), F.regexp_replace("bare", f"({NAME})[^ ]*+", "$1")).otherwise(F.col("bare")), WINDOW).alias("t"),
        F.when(F.col("named"), runs_of_words(F.replace("bare", F.lit(NAME), F.lit("")), WINDOW)).otherwise(F.array().cast("array<string>")).alias("f"),
    )
    n = F.size("all") - WINDOW + 1
    rows = runs.select(*keys, "all", F.posexplode(F.concat("t", "f")).alias("at", "run"))
    return rows.select(*keys, F.when(F.col("at") < n, F.col("at")).otherwise(F.col("at") - n).alias("pos"), F.xxhash64("run").alias("template"), (F.col("at") >= n).alias("folded"), "all")


def window_at(words: str, pos: str) -> Column:
    return F.array_join(F.slice(words, F.col(pos) + 1, F.lit(WINDOW)), " ")


def slots_of(window: Column, names: Column) -> Column:
    """The values of a window's placeholders, those of names on request."""
    of = lambda marks: F.regexp_extract_all(window, F.lit(f"({marks}[^ ]*+)"), F.lit(1))
    return F.when(names, of(MARKS)).otherwise(of(f"[{NUMBER}{UNIT}]"))


def n_words(words: Column) -> Column:
    return F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1)


def short_leaks(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """doc_id, item_id where all words of an item of at most WINDOW words, values too, stand in a document in a row,
    whatever their case. None if no item is so short. Both have their words."""
    items, docs = (df.withColumn("words", F.replace("words", F.lit(NAME), F.lit(""))) for df in (items, docs))
    n = n_words(F.col("words"))
    short = items.where(n.between(1, WINDOW)).select("item_id", n.alias("n"), F.xxhash64(n.cast("int"), "words").alias("key")).distinct()
    known = short.agg(F.collect_set("n").alias("sizes"), F.count("*").alias("rows")).first()
    if not known["rows"]:
        return None

    def keyed(n: int) -> Column:
        return F.transform(runs_of_words(F.col("words"), n), lambda w: F.xxhash64(F.lit(n), w))

    hashed = [keyed(n) for n in sorted(known["sizes"])]
    # Hashes are longs, of which array_distinct keeps a hash table; of structs it compares all pairs.
    seen = docs.select("doc_id", F.explode(F.array_distinct(F.concat(*hashed))).alias("key"))
    return seen.join(F.broadcast(short) if known["rows"] <= BROADCAST_ROWS else short, "key").select("doc_id", "item_id").distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.5) -> DataFrame:
    """doc_id, item_id, n_windows (windows of the item that match), share (of those expected), same_values.

    ``share`` is taken of all windows of the item; rows have ``least_share`` or more, two windows at least, and no value of the item with two values in the document (two values may become one), all in one occurrence: windows at one
    distance from their places in the item, or at distances that differ by an eighth of its words or so, or, for copies
    that are spread out, all windows of the document. Items of fewer than six words are one whole window, which must
    match with its values. Null texts hold nothing. Rows of equal id count as one document or item; a null id is an id
    of its own. Extra columns are ignored.
    """
    worded = benchmark.select("item_id", F.coalesce(canonical(F.col("text")), F.lit("")).alias("words"))
    items = worded.where(n_words(F.col("words")) > WINDOW)
    held = windows(items, ["item_id"]).select("item_id", F.col("pos").alias("item_pos"), "template", F.col("folded").alias("item_folded"), F.size("all").alias("item_words"), window_at("all", "pos").alias("item_window"))
    held = materialise(held)
    n_held = held.count()
    texts = docs.select("doc_id", canonical(F.col("text")).alias("words"))
    seen = windows(texts, ["doc_id"])
    if n_held <= BROADCAST_ROWS:  # windows are put together where they have met, in the task that has the words
        met = seen.join(F.broadcast(held), "template").withColumn("window", window_at("all", "pos"))
    else:
        met = seen.withColumn("window", window_at("all", "pos")).drop("all").join(held, "template")
    # Values are read where windows have met, those of names where both sides have the template.
    names = ~(F.col("folded") | F.col("item_folded"))
    met = met.select("doc_id", "item_id", "pos", "item_pos", "item_words", slots_of(F.col("item_window"), names).alias("item_slots"), slots_of(F.col("window"), names).alias("slots"))
    values = F.when(F.size("slots") > 0, F.arrays_zip("item_slots", "slots"))
    # Occurrences: one distance, two neighbouring bins of distances (half an item at most), the whole document.
    distance = F.col("pos") - F.col("item_pos")
    cell = F.floor(distance / F.greatest(F.lit(2), F.floor(F.col("item_words") / 8))).cast("int")
    whole = F.struct(F.lit(2).alias("kind"), F.lit(0).alias("at"))
    spans = F.array(whole, F.struct(F.lit(0).alias("kind"), distance.alias("at")), *[F.struct(F.lit(1).alias("kind"), (cell + i).alias("at")) for i in (0, 1)])
    by_span = met.withColumn("span", F.explode(spans)).groupBy("doc_id", "item_id", "span").agg(
        F.max("item_words").alias("item_words"),
        F.collect_set("item_pos").alias("places"),
        F.array_distinct(F.flatten(F.collect_set(values))).alias("pairs"),
    )
    n = F.size("places")
    expected = F.col("item_words") - WINDOW + 1
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda p: p["item_slots"]))) == F.size("pairs")
    found = (
        by_span.withColumn("share", F.least(n / expected, F.lit(1.0)))
        .where((n >= 2) & (F.col("share") >= least_share) & consistent)
        .groupBy("doc_id", "item_id")
        .agg(F.max(n).cast("long").alias("n_windows"), F.max("share").alias("share"), F.bool_or(F.forall("pairs", lambda p: p["item_slots"] == p["slots"])).alias("same_values"))
    )
    short = short_leaks(texts, worded)
    if short is None:
        return found
    # Items of one id may be short and long.
    rows = found.unionByName(short.select("doc_id", "item_id", F.lit(1).cast("long").alias("n_windows"), F.lit(1.0).alias("share"), F.lit(True).alias("same_values")))
    return rows.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("share").alias("share"), F.bool_or("same_values").alias("same_values"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold an item of the benchmark."""
    bad = find_leaks(docs, benchmark, **options).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
