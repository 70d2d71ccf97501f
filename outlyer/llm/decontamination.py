"""Benchmark decontamination by template windows, with a check of the slots.

1. Canonical forms. Numbers, and units after numbers, become typed placeholders, the rest lower case (view 0). In view
   1 every capitalised word is a placeholder too, at the start of a sentence as well, so that names may change; view 0 has
   copies in other case. The tokens stay in step with the raw words. A window of ``WIDTH`` tokens
   with fewer than ``LITERAL`` that are no placeholders stands for its raw words instead.
2. Seeds. Windows of both views are hashed and joined to those of the benchmark. Of
   a document only every ``stride``-th window is taken; the stride is the shortest run of windows
   that an item with the least containment must share, so no such item slips between.
3. Documents with a seed are read again with every window. An item of whose windows a document holds too few
   anywhere, each counted once, goes.
4. Alignment. Each shift between a window's place in the document and in the item has a vote. Of shifts within ``NEAR`` of each
   other the one with most votes is a copy's place, if they have enough. Windows within ``NEAR`` of it, of each of the item's the nearest, are its containment.
5. Slots. On a copy's windows each placeholder's value in the item must stand for one value in the document throughout,
   and each value there for one in the item. A question with other numbers and names is caught;
   a text that only looks alike is not. One steady copy is enough, whatever stands beside it.
6. Items of fewer than ``WIDTH`` tokens are sought whole and word for word, case apart.

All of it is DataFrame expressions. Windows meet the benchmark's by a broadcast whose size is
checked; a window costs a row a document however often the document has it, and counts are combined map-side.

Defined cases: null texts count as empty; items and documents without words match nothing; equal items are all reported;
rows that share an id are judged together and rows without one are never flagged; an empty benchmark flags nothing, an
empty table gives an empty result; a text of any length is read whole; columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlyer.llm.common import only, scratch, text_of

WIDTH, CONTAINMENT = 5, 0.8
NUMBER = r"\d+(?:[.,:/]\d+)*"
TOKEN = NUMBER + r"|[\p{L}\p{M}_]+"
NAME = r"(?<![\p{L}\p{M}_\d])\p{Lu}[\p{L}\p{M}]*(?![\p{L}\p{M}_])"
#: Literal tokens that a window of the canonical form has at least.
LITERAL = 2
#: Words by which the windows of one place may shift.
NEAR = 16
#: Words that measure, when they follow a number.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs pound pounds oz ounce ounces ton tons tonne tonnes "
    "ml cl l litre litres liter liters gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "w kw v a hz khz mhz ghz j kj cal kcal pa kpa bar k c f degree degrees percent dollar dollars euro euros cent cents usd eur"
).split()
SLOTS = ("numberslot", "unitslot", "nameslot")
#: Up to so many benchmark windows are broadcast: their hashes, or hash, item, place and the words at slots, some 200 bytes.
BROADCAST_WINDOWS = 200_000


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def template_tokens(text: Column, names: bool = True) -> Column:
    """The tokens of a canonical form, as many as :func:`raw_tokens` gives."""
    number, unit, name = SLOTS
    text = F.regexp_replace(text, NAME, name) if names else text
    text = F.lower(F.regexp_replace(text, NUMBER, f" {number} "))
    text = F.regexp_replace(text, rf"({number} +)(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{M}}_\d])", f"$1{unit}")
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}_]+"), F.lit(0))


def tokenised(rows: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``key``, raw tokens in lower case, and the views ``v0`` and ``v1``."""
    text = text_of(text_col)
    return rows.select(key, F.transform(raw_tokens(text), lambda t: F.lower(t)).alias("raw"), template_tokens(text, False).alias("v0"), template_tokens(text).alias("v1"))


def window_starts(tokens: str, stride: int = 1, width: int = WIDTH) -> Column:
    """1, 1 + stride, ... as far as a whole window follows; empty for short texts."""
    last = F.size(tokens) - width + 1
    return F.when(last >= 1, F.sequence(F.lit(1), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def window_hash(view: str, i: Column) -> Column:
    part = F.slice(F.col(view), i, WIDTH)
    literal = F.size(F.filter(part, lambda t: ~t.isin(*SLOTS)))
    return F.xxhash64(F.when(literal >= LITERAL, part).otherwise(F.slice(F.col("raw"), i, WIDTH)))


def window_hashes(view: str, stride: int) -> Column:
    return F.transform(window_starts(view, stride), lambda i: window_hash(view, i))


def whole_hashes(width: int) -> Column:
    return F.transform(window_starts("raw", 1, width), lambda i: F.xxhash64(F.slice(F.col("raw"), i, width)))


def windows(rows: DataFrame, key: str) -> DataFrame:
    """Every window of :func:`tokenised` rows: key, view, pos, h and values (raw words at slots, else null).

    Windows are made inside the row, so that no exploded row carries the document.
    """

    def of(view: int) -> Column:
        name = f"v{view}"

        def window(i: Column) -> Column:
            part = F.slice(F.col(name), i, WIDTH)
            values = F.zip_with(part, F.slice(F.col("raw"), i, WIDTH), lambda t, r: F.when(t.isin(*SLOTS), r))
            return F.struct(F.lit(view).alias("view"), i.alias("pos"), window_hash(name, i).alias("h"), F.when(F.exists(part, lambda t: t.isin(*SLOTS)), values).alias("values"))

        return F.transform(window_starts(name), window)

    return rows.select(key, F.explode(F.concat(of(0), of(1))).alias("w")).select(key, "w.*")


def shortest_run(items: DataFrame) -> Column:
    """Least run of consecutive windows in a document that holds an item with the least containment."""
    lost = F.floor((1 - CONTAINMENT) * F.col("n") + F.lit(1e-9))
    return F.ceil((F.col("n") - lost) / (lost + 1))


def whole_items(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """``doc, item, containment`` of items under ``WIDTH`` tokens that a document holds word for word; None without such items."""
    short = items.withColumn("n", F.size("raw")).where(F.col("n").between(1, WIDTH - 1))
    widths = [r.n for r in short.select("n").distinct().collect()]  # WIDTH - 1 at most
    if not widths:
        return None
    short = scratch(short.select("item", F.xxhash64("raw").alias("h")), "short")
    held = docs.select("doc", F.explode(F.array_distinct(F.concat(*map(whole_hashes, sorted(widths))))).alias("h"))
    few = short.count() <= BROADCAST_WINDOWS
    return held.join(F.broadcast(short) if few else short, "h").select("doc", "item", F.lit(1.0).alias("containment")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """``doc, item, containment`` for every item that a document holds."""
    tokens = scratch(tokenised(benchmark.withColumnRenamed(item_col, "item"), "item"), "tokens")
    items = scratch(windows(tokens, "item").withColumnRenamed("pos", "item_pos").withColumnRenamed("values", "item_values"), "items")
    sizes = scratch(items.groupBy("item", "view").agg(F.count(F.lit(1)).alias("n")), "items_sizes")
    summary = sizes.agg(F.min(shortest_run(sizes)).alias("run"), F.sum("n").alias("n")).first()
    stride, small = int(summary["run"] or 1), (summary["n"] or 0) <= BROADCAST_WINDOWS
    sized = F.broadcast if small else (lambda df: df)

    text = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), text_of().alias("text"))
    whole = tokenised(text, "doc")
    hashes = lambda step: F.array_union(window_hashes("v0", step), window_hashes("v1", step))
    seeds = whole.select("doc", F.explode(hashes(stride)).alias("h"))
    found = scratch(seeds.join(sized(items.select("h").distinct()), "h", "left_semi").select("doc").distinct(), "seeded")

    again = scratch(tokenised(only(text, found, "doc"), "doc"), "again", "zstd")
    # a window of an item counts as often as the item has it, and once for each document
    weights = scratch(items.groupBy("h", "item", "view").agg(F.count(F.lit(1)).alias("weight")).join(sized(sizes), ["item", "view"]), "weights")
    held = again.select("doc", F.explode(F.array_distinct(hashes(1))).alias("h")).join(sized(weights), "h")
    pairs = held.groupBy("doc", "item", "view", "n").agg(F.sum("weight").alias("held")).where(F.col("held") >= CONTAINMENT * F.col("n"))
    pairs = scratch(pairs.select("doc", "item", "view", "n"), "pairs")

    own = scratch(windows(only(again, scratch(pairs.select("doc").distinct(), "held"), "doc"), "doc").join(sized(items.select("h", "view").distinct()), ["h", "view"], "left_semi"), "own", "zstd")
    votes = own.select("doc", "view", "h", "pos").join(sized(items.select("item", "view", "h", "item_pos")), ["view", "h"]).join(pairs, ["doc", "item", "view"])
    votes = votes.groupBy("doc", "item", "view", "n", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.count(F.lit(1)).alias("votes"))
    # places of copies: shifts with the most votes around, which are enough; a document has no more than copies fit in
    around = Window.partitionBy("doc", "item", "view").orderBy("shift").rangeBetween(-NEAR, NEAR)
    own_vote = F.struct("votes", (-F.col("shift")).alias("early"))
    placed = votes.withColumn("sum", F.sum("votes").over(around)).withColumn("most", F.max(own_vote).over(around))
    placed = scratch(placed.where((F.col("sum") >= CONTAINMENT * F.col("n")) & (F.col("most") == own_vote)).select("doc", "item", "view", "n", "shift"), "placed")

    off = F.abs(F.col("pos") - F.col("item_pos") - F.col("shift"))
    copy = ["doc", "item", "view", "shift"]
    hits = own.join(placed, ["doc", "view"]).join(sized(items), ["item", "view", "h"]).where(off <= NEAR)
    hits = hits.groupBy(*copy, "n", "item_pos").agg(F.min_by(F.struct("item_values", "values"), F.struct(off, "pos")).alias("hit"))
    hits = scratch(hits.select(*copy, "n", F.col("hit")["item_values"].alias("item_values"), F.col("hit")["values"].alias("values")), "hits")
    good = hits.groupBy(*copy, "n").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= CONTAINMENT * F.col("n"))
    slots = hits.where("item_values is not null").select(*copy, F.explode(F.arrays_zip(F.col("item_values").alias("a"), F.col("values").alias("b"))).alias("s"))
    slots = slots.select(*copy, F.col("s")["a"].alias("a"), F.col("s")["b"].alias("b")).where("a is not null").distinct()
    unsteady = [slots.groupBy(*copy, c).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(*copy) for c in ("a", "b")]
    good = good.join(unsteady[0].unionAll(unsteady[1]).distinct(), copy, "left_anti")
    good = good.groupBy("doc", "item").agg(F.max(F.col("held") / F.col("n")).alias("containment"))
    short = whole_items(whole, tokens)
    return good if short is None else good.unionAll(short)


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """One row per document: id, contaminated, items (sorted) and the largest containment."""
    found = leaks(docs, benchmark, id_col, item_col)
    # a document's items are as many as the benchmark's at most
    found = scratch(found.groupBy("doc").agg(F.sort_array(F.collect_list("item")).alias("items"), F.max("containment").alias("containment")), "leaks")
    kind = benchmark.schema[item_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc")).join(found, "doc", "left").select(
        F.col("doc").alias(id_col), F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast(f"array<{kind}>")).alias("items"), F.coalesce("containment", F.lit(0.0)).alias("containment"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs``, all columns kept, without those that hold an item."""
    bad = scratch(leaks(docs, benchmark, id_col).select(F.col("doc").alias(id_col)).distinct(), "bad")
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_WINDOWS else bad, id_col, "left_anti")
