"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, names and units of a text become typed placeholders, the rest is lower-cased without
punctuation: a template. Windows of template words are hash-joined between documents and items.
Windows of one item that follow each other in a document lie on one diagonal; there the slots'
values must be consistent, one value of the document for each value of the item, and names one to
one. That finds
questions with other numbers, names or units in them. Windows of the plain lower-cased words are
joined as well, so verbatim copies are found whatever their case and however many their numbers.
Words put in or left out shift the diagonal: what neighbouring diagonals cover is summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a window; the shortest item that is looked for; the share of an item that must be found.
WINDOW, SHORTEST, SHARE = 8, 5, 0.5
#: How far diagonals may lie apart to be summed, as a share of the item's words.
DRIFT = 0.5
#: Words of a window that must not be placeholders.
LITERALS = 4
#: Benchmark windows up to this count may be broadcast (about 24 bytes each).
BROADCAST_WINDOWS = 1_000_000
#: Placeholders: characters for private use, which stand for themselves in no text.
NUMBER, NAME, UNIT = "\ue001", "\ue002", "\ue003"
SLOT = "[\ue001-\ue003]"
# Units that may follow a number.
UNITS = "mm|cm|dm|m|km|in|inch|inches|ft|feet|foot|yd|yards|yard|mi|miles|mile|mg|g|kg|t|tons|ton|oz|ounces|ounce|lb|lbs|pounds|pound|ml|cl|l|litres|liters|litre|liter|gal|gallons|gallon|ms|s|sec|secs|seconds|second|min|mins|minutes|minute|h|hr|hrs|hours|hour|days|day|weeks|week|months|month|years|year|km/h|kmh|mph|m/s|hz|khz|mhz|ghz|w|kw|mw|v|kv|a|ma|j|kj|cal|kcal|n|pa|kpa|bar|k|c|f|celsius|fahrenheit|degrees|degree|percent|usd|eur|gbp|dollars|dollar|euros|euro|cents|cent|kb|mb|gb|tb|bytes|bits"


def _marked(text: Column) -> Column:
    """The text, which holds no placeholder yet, with names and numbers as placeholders."""
    # a capitalised word inside a sentence is a name; what stands first is tested first, most places end there
    t = F.regexp_replace(text, r"(?=\p{Lu})(?<=[\p{Ll}\p{N},] )\p{Lu}[\p{L}\p{M}\p{N}'’-]*", NAME)
    return F.regexp_replace(t, r"[+-]?\p{Nd}[\p{Nd}.,:/]*(?<=\p{Nd})", NUMBER)


def _typed(marked: Column) -> Column:
    """The marked text with units as placeholders too, lower-cased."""
    t = F.regexp_replace(marked, rf"{NUMBER}(\s?)(?i:{UNITS}|°[cf]?)(?![\p{{L}}\p{{N}}])", f"{NUMBER}$1{UNIT}")
    return F.lower(t)


def template(text: Column) -> Column:
    """The text, which holds no placeholder yet, with placeholders; white space stays as it is."""
    return _typed(_marked(text))


def _words(text: Column) -> Column:
    """Words of letters, marks, digits and placeholders; the rest falls away and may leave empty words, as runs
    of white space do."""
    text = F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}\s\x{E001}-\x{E003}]+", "")
    for space in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.split(text, " ")


def _shapes(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, words, values): template words and, place by place, the plain words that they stand for.
    Where a text has no placeholder both are the same, and words are left out (null)."""
    texts = texts.select(*keys, F.regexp_replace(F.coalesce("text", F.lit("")), SLOT, " ").alias("text"))
    texts = texts.withColumn("marked", _marked(F.col("text")))
    texts = texts.select(*keys, F.when(F.col("marked") != F.col("text"), _words(_typed(F.col("marked")))).alias("typed"), _words(F.lower("text")).alias("plain"))
    both = F.filter(F.zip_with("typed", "plain", lambda w, v: F.struct(w.alias("word"), v.alias("value"))), lambda t: (t["word"] != "") | (t["value"] != ""))
    texts = texts.select(*keys, F.when(F.col("typed").isNotNull(), both).alias("both"), F.when(F.col("typed").isNull(), F.array_remove("plain", "")).alias("plain"))
    return texts.select(*keys, F.col("both.word").alias("words"), F.coalesce("plain", F.col("both.value")).alias("values"))


def _hashed(words: Column) -> Column:
    """A hash of each word; null for no list."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(rows: DataFrame, width: int, *columns: str) -> DataFrame:
    """``rows`` with the ``columns``, hashes of words, turned into hashes of all windows of ``width`` words, by
    place; none of a shorter text. Two windows with ``shift`` words between their places make one longer by that."""
    held = 1
    while held < width:
        shift = min(held, width - held)
        n = lambda c: F.greatest(F.size(c) - shift, F.lit(0))  # noqa: E731, B023
        longer = {c: F.zip_with(F.slice(c, 1, n(c)), F.slice(c, 1 + shift, n(c)), lambda a, b: F.xxhash64(a, b)) for c in columns}
        rows = rows.select(*[longer[c].alias(c) if c in longer else c for c in rows.columns])
        held += shift
    return rows


def _consistent_sql(told: str) -> str:
    """Whether each value of the item stands for one value of the document, and names for different names:
    two numbers may happen to be equal in another version of a question, two people are not."""
    names = f"filter({told}, t -> t.named)"
    return f"size({told}) = size(array_distinct(transform({told}, t -> t.theirs))) and size({names}) = size(array_distinct(transform({names}, t -> t.ours)))"


def _consistent(told: str) -> Column:
    return F.expr(_consistent_sql(told))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """(doc_id, item_id, found, words, slots, exact) for each item found in a document.

    An item is found where its windows on neighbouring diagonals of a document, consistent in their
    slots, cover at least ``share`` of its words: found of words. slots: placeholders among them;
    exact: whether all slots have the item's own values. The stretch that covers most counts;
    diagonals are taken up by size, one that contradicts those before is left out.

    Cases: null and empty texts hold nothing; items of fewer than SHORTEST words are too common to
    be looked for; items shorter than a window are one window; windows with fewer than LITERALS
    literal words are evidence only if they are the same word for word; rows that share a doc_id are judged together, a null doc_id is
    judged like any other; repeated items are found each; documents of any length are searched
    whole; other columns are not read; empty tables find nothing.
    """
    spark = docs.sparkSession
    items = benchmark.select(benchmark[item_column].cast("long").alias("item_id"), benchmark[item_text_column].cast("string").alias("text"))
    items = _shapes(items, "item_id").withColumn("words", F.coalesce("words", "values")).where(F.size("words") >= SHORTEST).withColumn("item", F.xxhash64("item_id", "values", "words"))
    items = common.written(items.dropDuplicates(["item"]), "items")
    widths = sorted({min(window, r["n"]) for r in items.select(F.least(F.lit(window), F.size("words")).alias("n")).distinct().collect()})  # window numbers at most
    if not widths:
        return spark.createDataFrame([], "doc_id long, item_id long, found int, words int, slots int, exact boolean")
    literal = lambda words: F.size(F.filter(words, lambda w: ~w.rlike(SLOT)))
    sides = []
    for width in widths:
        own = items.where(F.least(F.lit(window), F.size("words")) == width)
        own = _windows(own.select("item", "words", _hashed(F.col("values")).alias("v"), _hashed(F.col("words")).alias("w")), width, "v", "w")
        sides.append(own.select("item", F.posexplode("v").alias("at", "hash")).select("item", "at", "hash", F.lit(width).alias("width")))
        sides.append(own.select("item", F.posexplode("w").alias("at", "hash"), "words").where(literal(F.slice("words", F.col("at") + 1, F.lit(width))) >= min(LITERALS, width)).select("item", "at", "hash", F.lit(width).alias("width")))
    wanted = sides[0]
    for s in sides[1:]:
        wanted = wanted.unionByName(s)
    wanted = common.written(wanted.distinct(), "wanted")
    wanted = common.bounded_broadcast(wanted, wanted.count(), BROADCAST_WINDOWS)

    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    shapes = _shapes(narrow, "doc_id").select("doc_id", _hashed(F.col("words")).alias("words"), _hashed(F.col("values")).alias("values"))
    for w in widths:
        shapes = _windows(shapes.withColumns({f"words{w}": F.col("words"), f"values{w}": F.col("values")}), w, f"words{w}", f"values{w}")
    kinds = [F.struct(F.lit(w).alias("width"), F.col(f"{of}{w}").alias("hashes")) for w in widths for of in ("words", "values")]
    seen = shapes.select("doc_id", F.explode(F.array(*kinds)).alias("s"))
    seen = seen.select("doc_id", F.col("s.width").alias("w"), F.posexplode("s.hashes").alias("place", "h"))
    met = seen.join(wanted, (F.col("h") == F.col("hash")) & (F.col("w") == F.col("width")))
    lines = met.groupBy("doc_id", "item", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.sort_array(F.collect_set(F.struct("at", "width"))).alias("windows"))  # an item's windows at most
    lines = common.written(lines, "lines")

    # the words themselves, for the slots: only of documents and items that met
    pairs = lines.join(items, "item")
    whole = narrow.join(lines.select(F.col("doc_id").alias("of")).distinct(), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    whole = _shapes(whole, "doc_id").select(F.col("doc_id").alias("of"), F.col("values").alias("own"))
    pairs = pairs.join(whole, F.col("doc_id").eqNullSafe(F.col("of")))
    places = F.array_distinct(F.flatten(F.transform("windows", lambda w: F.sequence(w["at"], w["at"] + w["width"] - 1))))
    pairs = pairs.withColumn("places", places)
    cut = f"filter(places, p -> words[p] rlike '{SLOT}' and p + diagonal >= 0 and p + diagonal < size(own))"
    pairs = pairs.withColumn("told", F.expr(f"array_distinct(transform({cut}, p -> struct(values[p] as theirs, own[p + diagonal] as ours, words[p] rlike '{NAME}' as named)))"))
    pairs = pairs.where(_consistent("told"))
    slots = F.expr(f"filter(sequence(0, size(words) - 1), p -> words[p] rlike '{SLOT}')").alias("slots")
    pairs = pairs.select("doc_id", "item", "item_id", F.size("words").alias("words"), slots, (F.col("diagonal") / F.size("words")).alias("shift"), "diagonal", "places", "told")
    # from each diagonal on, as many as an item has words times DRIFT at most
    near = F.expr(f"collect_list(struct(-size(places) as rank, diagonal, places, told)) over (partition by doc_id, item order by shift range between current row and {DRIFT}D following)")
    pairs = pairs.withColumn("near", near).withColumn("near", F.sort_array("near"))
    pairs = pairs.withColumn(
        "sum",
        F.expr(
            f"""aggregate(near, cast(named_struct('places', array(), 'told', array()) as struct<places:array<int>,told:array<struct<theirs:string,ours:string,named:boolean>>>), (sum, line) ->
               if({_consistent_sql("array_union(sum.told, line.told)")},
                  named_struct('places', array_union(sum.places, line.places), 'told', array_union(sum.told, line.told)), sum))"""
        ),
    )
    exact = F.expr("forall(sum.told, t -> t.theirs = t.ours)")
    pairs = pairs.select("doc_id", "item_id", F.size("sum.places").alias("found"), "words", F.size(F.array_intersect("sum.places", "slots")).alias("slots"), exact.alias("exact"))
    pairs = pairs.where(F.col("found") >= F.lit(share) * F.col("words"))
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct("found", "exact", "slots", "words")).alias("b"))
    return best.select("doc_id", "item_id", "b.found", "b.words", "b.slots", "b.exact")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` without those in which an item of ``benchmark`` is found; all columns stay. Each row is
    judged by its own text, also where ids are missing or shared."""
    key = F.xxhash64(docs[id_column], docs[text_column])
    own = docs.select(key.alias("__key"), docs[text_column].alias("__text"))
    hits = contaminated(own, benchmark, id_column="__key", text_column="__text", **options).select(F.col("doc_id").alias("__hit")).distinct()
    hits = common.written(hits, "hits")
    hits = common.bounded_broadcast(hits, hits.count())
    return docs.join(hits, key == hits["__hit"], "left_anti")
