"""Benchmark decontamination by question templates.

A text becomes a template: numbers, names (capitalised words inside a sentence) and units behind
numbers are typed placeholders, other words are lower case without punctuation. Windows of
template words of the benchmark meet windows of the texts by hash; windows that are mostly
placeholders meet by their values instead. Along each shift between a text
and an item that shares a window, words are compared one by one, and placeholders count only if
their values are consistent along it: one value of the item always stands for one value of the
text. Several parameterisations of one question in a text are several shifts.
Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.session import cut_lineage

# Units that become a placeholder behind a number.
UNITS = (
    "km", "m", "cm", "mm", "miles", "mile", "feet", "foot", "inches", "inch", "yards", "kg", "g", "mg", "pounds", "pound", "tons",
    "l", "ml", "liters", "litres", "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks", "week", "months",
    "month", "years", "year", "dollars", "dollar", "cents", "euros", "euro", "percent", "degrees", "kmh", "mph",
)
NAME, UNIT, NUMBER = "\u0001", "\u0002", "\u0003"
WINDOW = 8  # words
WHOLE = 11  # words; shorter items are looked up whole too
LITERAL = 4  # words of a benchmark window that are no placeholders
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16_000_000  # larger sides are shuffled


def _normal(text: Column, placeholders: bool) -> Column:
    """Template words, or the values at the same places, joined by white space."""
    # each pattern begins with a character that is rare in texts; borders of white space are left to the split
    text = F.regexp_replace(text, r"\d(?=\p{L})", "$0 ")
    if placeholders:
        text = F.regexp_replace(text, r"(?=\p{Lu})(?<=[^.!?:\s]\s)\p{Lu}\p{L}*", NAME)
    text = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}\s\x01]+", "")
    if placeholders:
        text = F.regexp_replace(text, rf"(\d\s)(?:{'|'.join(UNITS)})(?!\S)", "$1" + UNIT)
        text = F.regexp_replace(text, r"(?=\d)(?<!\S)\d\S*", NUMBER)
    return text


def template(text: Column) -> Column:
    """Array of template words; null and empty texts have none."""
    return F.filter(F.split(_normal(text, True), r"\s+"), lambda w: w != "")


def values(text: Column) -> Column:
    """Array of the words that ``template`` was made from, place by place."""
    return F.filter(F.split(_normal(text, False), r"\s+"), lambda w: w != "")


def _templates(text: Column) -> Column:
    """Templates of a text as it stands, at the start of a sentence, inside one and behind a number; only the first word differs."""
    bare = F.regexp_replace(text, r"^[^\p{L}\p{N}]+", "")
    behind = lambda word: F.slice(template(F.concat(F.lit(word + " "), bare)), 2, F.greatest(F.size(template(bare)), F.lit(1)))
    return F.array_distinct(F.array(template(text), template(bare), behind("x"), behind("1")))


def _windows(words: Column, size: int, kind: int = 0) -> Column:
    """(kind, pos, hash) of every window of ``size`` words."""
    last = F.size(words) - size
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), F.xxhash64(F.slice(words, i + 1, size)).alias("hash")))


def without(documents: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``documents`` whose id is not in ``found``; rows without an id stay."""
    return documents.join(_sized(cut_lineage(found.select(id_col).distinct())), id_col, "left_anti")


def _sized(df: DataFrame, text: str | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its rows, and the bytes of its texts, were counted and are few."""
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text) if text else F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if size["rows"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES else df


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    coverage: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """One row (id, item, matched, words, exact) per text and benchmark item that it contains.

    ``matched`` is the number of the item's ``words`` template words that the text has at the
    same shift (the places of all shifts that share a window are united), ``exact`` says that no
    placeholder met along these shifts has another value in the text. A pair is given if
    ``matched >= coverage * words``. Placeholders whose values are inconsistent within a shift
    don't count there.

    Null and empty texts and items contain nothing. Every window of ``WINDOW`` words of a text
    is looked up; items of fewer than ``WHOLE`` words are looked up whole too. Windows without
    ``LITERAL`` plain words (or all words, if they are fewer) are looked up by their values. The
    first word of an item is a plain word, a name or a unit by what stands before it; it is looked
    up as each of them, and counts if the words or the values are the same. Rows without an id are
    not reported; rows that share an id count as one text; repeated items are reported by their id
    once. Columns not named are not read.
    """
    docs = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("item_text"))
    items = items.withColumns({"item_words": template(F.col("item_text")), "item_values": values(F.col("item_text"))}).where("size(item_words) > 0")
    # a first word that is no word by itself in another context would move the others
    fits = lambda t: F.size(t) == F.size("item_words")
    items = items.withColumn("item_templates", F.filter(_templates(F.col("item_text")), fits))
    length = F.size("item_words")
    lengths = [r[0] for r in items.where(length < WHOLE).select(length).distinct().collect()]  # at most WHOLE - 1 values

    # windows of every size, by template words and by values, met in one scan of the texts
    asked, kinds = None, []
    for size, chosen in [(WINDOW, items.where(length >= WINDOW)), *[(n, items.where(length == n)) for n in sorted(lengths) if n != WINDOW]]:
        plain = F.size(F.filter(F.slice("words", F.col("w.pos") + 1, size), lambda w: ~w.isin(NAME, UNIT, NUMBER)))
        each = chosen.select("item", "item_values", F.explode("item_templates").alias("words"))
        each = each.select("item", "item_values", "words", F.explode(_windows(F.col("words"), size)).alias("w")).withColumn("literal", plain >= min(LITERAL, size))
        each = each.select(
            F.when(F.col("literal"), 2 * size).otherwise(2 * size + 1).alias("kind"),
            "item",
            F.col("w.pos").alias("item_pos"),
            F.when(F.col("literal"), F.col("w.hash")).otherwise(F.xxhash64(F.slice("item_values", F.col("w.pos") + 1, size))).alias("hash"),
        )
        asked = each if asked is None else asked.union(each)
    asked = cut_lineage(asked.distinct())
    kinds = sorted(r[0] for r in asked.select("kind").distinct().collect())  # at most two for each size
    windows = [_windows(F.col("vals" if k % 2 else "words"), k // 2, k) for k in kinds]
    given = docs.select("doc", template(F.col("text")).alias("words"), *([values(F.col("text")).alias("vals")] if any(k % 2 for k in kinds) else []))
    windows = F.concat(*windows) if len(windows) > 1 else windows[0] if windows else F.array().cast("array<struct<kind: int, pos: int, hash: bigint>>")
    given = given.select("doc", F.explode(windows).alias("w")).select("doc", "w.kind", "w.pos", "w.hash")
    met = given.join(_sized(asked), ["kind", "hash"]).select("doc", "item", (F.col("pos") - F.col("item_pos")).alias("shift"))
    hits = _sized(cut_lineage(met.distinct()))

    # compare word by word along each shift
    both = docs.join(hits, "doc").join(_sized(items, "item_text"), "item")
    # written, as the words would be made again for every place that is compared
    both = both.select("doc", "item", "shift", "item_words", "item_values", template(F.col("text")).alias("words"), values(F.col("text")).alias("vals"))
    both = cut_lineage(both)
    place = F.sequence(F.lit(0), F.size("item_words") - 1)
    at = lambda i: F.col("shift") + i
    first = lambda i: (i == 0) & (F.get("vals", at(i)) == F.get("item_values", i))
    inside = lambda i: (at(i) >= 0) & ((F.get("words", at(i)) == F.get("item_words", i)) | first(i))
    same = F.transform(
        F.filter(place, inside),
        lambda i: F.struct(
            i.alias("i"), F.get("item_words", i).alias("kind"), F.get("item_values", i).alias("theirs"), F.get("vals", at(i)).alias("ours")
        ),
    )
    shifts = both.select("doc", "item", F.size("item_words").alias("total"), same.alias("same"))
    slots = F.filter("same", lambda s: s["kind"].isin(NAME, UNIT, NUMBER))
    valued = lambda s: F.struct(s["kind"].alias("k"), s["theirs"].alias("t"), s["ours"].alias("o"))
    shifts = shifts.withColumn("maps", F.array_distinct(F.transform(slots, valued)))
    steady = lambda s: F.size(F.filter("maps", lambda m: (m["k"] == s["kind"]) & (m["t"] == s["theirs"]))) == 1
    counted = F.filter("same", lambda s: ~s["kind"].isin(NAME, UNIT, NUMBER) | steady(s))
    places = F.transform(counted, lambda s: s["i"])
    shifts = shifts.select("doc", "item", "total", places.alias("places"), F.forall("maps", lambda m: m["t"] == m["o"]).alias("exact"))
    # one row per place: nothing grows with the shifts of a pair
    united = shifts.select("doc", "item", "total", "exact", F.explode("places").alias("i")).groupBy("doc", "item", "total", "i").agg(F.min("exact").alias("exact"))
    pairs = united.groupBy("doc", "item", "total").agg(F.count(F.lit(1)).cast("int").alias("matched"), F.min("exact").alias("exact"))
    return pairs.where(F.col("matched") >= coverage * F.col("total")).select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), "matched", F.col("total").alias("words"), "exact"
    )
