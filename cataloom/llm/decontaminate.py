"""Benchmark decontamination by templates: typed placeholders, joined windows, consistent slots. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import kept

NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"  # private-use signs, one word each
# fixed values: units that follow a number
UNITS = ("mm cm dm km m mg kg g t ml cl dl l s ms min h hz khz mhz ghz kb mb gb tb w kw mw v kv a ma n j kj pa kpa bar k c f mi yd ft in lb lbs oz mph kmh "
         "meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms kilo kilos ton tons "
         "liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
         "dollar dollars euro euros pound pounds cent cents percent degree degrees watt watts volt volts").split()
_WORD = rf"\p{{N}}+(?:[.,]\p{{N}}+)*|[\p{{L}}\p{{M}}]+|[{NAME}{NUMBER}{UNIT}]"


def template(text: Column) -> Column:
    """The lower-cased text with a placeholder for every number, every unit after a number, and every capitalised
    word that follows a lower-case word, a number, or a comma or colon; word for word the same count."""
    out = F.regexp_replace(text, r"(?<=[\p{Ll}\p{N},;:] )\p{Lu}\p{Ll}+", NAME)
    out = F.lower(F.regexp_replace(out, r"\p{N}+(?:[.,]\p{N}+)*", NUMBER))
    return F.regexp_replace(out, rf"(?<={NUMBER}|{NUMBER} )(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{M}}])", UNIT)


def spaced(text: Column) -> Column:
    """The text with one plain space for every run of white space."""
    return F.regexp_replace(text, r"(?U)[\s&&[^ ]]\s*| \s+", " ")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def _paired(hashes: Column, apart: int) -> Column:
    """Each hash with the one `apart` places on; the array is bound, so that it is not evaluated twice."""
    return let(hashes, lambda x: F.zip_with(x, F.slice(x, F.lit(1 + apart), F.greatest(F.size(x), F.lit(1))), lambda a, b: F.xxhash64(a, b)))


def window_hashes(tokens: Column, doublings: int = 3) -> Column:
    """Hash of the 2 ** doublings tokens from each token on; nothing for the last ones."""
    h = F.transform(tokens, lambda w: F.xxhash64(w))
    for k in range(doublings):
        h = _paired(h, 1 << k)
    return let(h, lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - F.lit((1 << doublings) - 1), F.lit(0))))


def joined_hashes(text: Column, doublings: int) -> Column:
    """For each window of a text the hash of its template and, where that differs, of its own lower-cased tokens."""
    pairs = (window_hashes(words(template(text)), doublings), window_hashes(words(F.lower(text)), doublings))
    return F.zip_with(*pairs, lambda t, p: F.when(t == p, F.array(t)).otherwise(F.array(t, p)))


def windows_with_slots(text: Column, doublings: int) -> Column:
    """For each window of a text its place (at), `hashes` as in `joined_hashes`, and the words that its placeholders stand for."""
    width = 1 << doublings

    def spread(pairs: Column) -> Column:
        return F.transform(joined_hashes(text, doublings), lambda h, i: F.struct(i.alias("at"), h.alias("hashes"), F.transform(
            F.filter(F.slice(pairs, i + 1, width), lambda x: x["t"].isin(NAME, NUMBER, UNIT)), lambda x: x["p"]).alias("slots")))
    return let(F.arrays_zip(words(template(text)).alias("t"), words(F.lower(text)).alias("p")), spread)


def benchmark_windows(benchmark: DataFrame, doublings: int, id_col: str, text_col: str, literal: bool = False) -> DataFrame:
    """(hash, item, item_at, windows, typed, plain, by_template, item_slots): windows of which at least half of the tokens are words, by
    template, `typed` of them in an item; and the literal tokens of the others (`literal`: of all). `plain` tells that a hash
    stands for the tokens themselves; slots are the replaced tokens."""
    width = 1 << doublings
    rows = benchmark.select(F.col(id_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("item", words(template(spaced(F.col("text")))).alias("tokens"), words(F.lower(spaced(F.col("text")))).alias("plain_tokens"))
    held = F.size(F.filter("part", lambda x: x["t"].isin(NAME, NUMBER, UNIT)))
    rows = rows.select("item", F.arrays_zip(F.col("tokens").alias("t"), F.col("plain_tokens").alias("p")).alias("pairs"),
                       F.arrays_zip(window_hashes(F.col("tokens"), doublings).alias("t"), window_hashes(F.col("plain_tokens"), doublings).alias("p")).alias("hashes"))
    parts = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"), F.slice("pairs", i + 1, width).alias("part")))
    count = F.size(F.filter(parts, lambda w: F.size(F.filter(w["part"], lambda x: x["t"].isin(NAME, NUMBER, UNIT))) * 2 <= width))
    rows = rows.select("item", F.size("hashes").alias("windows"), count.alias("typed"), F.explode(parts).alias("w")).select("item", "windows", "typed", "w.h", "w.at", "w.part")
    rows = rows.select("*", (held * 2 <= width).alias("light"), (held == 0).alias("bare"))
    slots = F.transform(F.filter("part", lambda x: x["t"].isin(NAME, NUMBER, UNIT)), lambda x: x["p"])
    place = [F.col("item"), F.col("at").alias("item_at"), F.col("windows"), F.col("typed")]
    by_template = rows.where("light").select(F.col("h.t").alias("hash"), *place, F.col("bare").alias("plain"), F.lit(True).alias("by_template"), slots.alias("item_slots"))
    by_tokens = rows.where(F.lit(literal) | ~F.col("light")).where("NOT bare").select(F.col("h.p").alias("hash"), *place, F.lit(True).alias("plain"), F.lit(False).alias("by_template"), F.array().cast("array<string>").alias("item_slots"))
    return by_template.union(by_tokens)


def contaminated(docs: DataFrame, benchmark: DataFrame, doublings: int = 3, least: int = 6, broadcast_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", literal: bool = False) -> DataFrame:
    """Documents that hold passages of benchmark items, literally or with other numbers, names and units:
    (id, item, n_windows, share, reparameterised), one row per document row and item, and none for clean documents.

    A passage counts if `least` windows of 2 ** doublings tokens (all windows, if the item has fewer) follow each other at
    the same distance in document and item, and if every slot value of the item maps to one value of the document.
    Windows with more placeholders than words are too weak as templates and are looked up by their own tokens; of the others
    `least`, or all that the item has, are enough. `literal` looks up the tokens of every window as well, so that
    `least` windows of equal lower-cased tokens count whatever their capitals, and whatever other places of the document hold.
    White space of any kind and length counts as one space.
    `share` is the part of the item's windows found; `reparameterised` tells whether a slot value differs.
    Benchmark windows are sent to all tasks if they are counted to be `broadcast_rows` or fewer (about 100 bytes each);
    more are joined by shuffle, and then each window of a document is a row with its place, hash and slot values, not the text.
    With a broadcast, windows are made and joined inside one stage: only matches are shuffled.
    Null and empty texts, items of fewer tokens than a window, null ids on either side: texts without windows match
    nothing, null ids are carried along as they are. Repeated rows are reported each, repeated items too. Other columns are left
    aside; empty tables give an empty result.
    """
    width = 1 << doublings
    wanted = kept(benchmark_windows(benchmark, doublings, item_col, item_text, literal), "benchmark_windows")
    small = wanted.count() <= broadcast_rows
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), spaced(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    if small:
        # outer: an inner explode would first test the array's size, and so make it twice
        found = rows.select("id", "row", "text", F.posexplode_outer(joined_hashes(F.col("text"), doublings)).alias("at", "hashes")).select(
            "id", "row", "text", "at", F.explode("hashes").alias("hash")).join(F.broadcast(wanted), "hash")
        slots = F.when(F.size("item_slots") > 0, F.slice(words(F.lower("text")), F.col("at") + 1, width))
        marked = F.when(F.size("item_slots") > 0, F.slice(words(template(F.col("text"))), F.col("at") + 1, width))
        doc_slots = F.transform(F.filter(F.arrays_zip(marked.alias("t"), slots.alias("p")), lambda x: x["t"].isin(NAME, NUMBER, UNIT)), lambda x: x["p"])
    else:  # windows are shuffled: each takes its own slot values along, never the text
        found = rows.select("id", "row", F.explode_outer(windows_with_slots(F.col("text"), doublings)).alias("w")).select(
            "id", "row", "w.at", "w.slots", F.explode("w.hashes").alias("hash")).join(wanted, "hash")
        doc_slots = F.when(F.size("item_slots") > 0, F.col("slots"))
    pairs = F.coalesce(F.arrays_zip(F.col("item_slots").alias("b"), doc_slots.alias("d")), F.array().cast("array<struct<b:string,d:string>>"))
    group = ["id", "row", "item", "windows", "typed"]
    aligned = (found.select(*group, (F.col("at") - F.col("item_at")).alias("shift"), "item_at", "plain", "by_template", pairs.alias("pairs"))
               .groupBy(*group, "shift").agg(F.size(F.collect_set("item_at")).alias("n"),
                                             F.size(F.collect_set(F.when(F.col("by_template"), F.col("item_at")))).alias("n_typed"),
                                             F.size(F.collect_set(F.when(F.col("plain"), F.col("item_at")))).alias("n_plain"),
                                             F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs")))
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["b"])))
    changed = F.exists("pairs", lambda p: p["b"] != p["d"])
    all_ = F.least(F.lit(least), F.col("windows"))
    typed = (F.col("typed") > 0) & (F.col("n_typed") >= F.least(F.lit(least), F.col("typed")))
    good = aligned.where((consistent & (typed | (F.col("n") >= all_))) | (F.lit(literal) & (F.col("n_plain") >= all_)))
    return (good.groupBy("id", "row", "item", "windows").agg(F.sum("n").alias("n_windows"), F.max(changed).alias("reparameterised"))
            .select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_windows", F.least(F.col("n_windows") / F.col("windows"), F.lit(1.0)).alias("share"), "reparameterised"))
