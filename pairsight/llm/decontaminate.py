"""Benchmark decontamination by templates, in DataFrame operations alone.

Texts are canonicalised to tokens: numbers become placeholder n, units after numbers u,
names (capitalised words inside a sentence) p, other words are lower-cased without
punctuation. A placeholder begins with U+0001, which counts as white space in texts, so that
no text holds one. Windows of ``WIDTH`` tokens (whole items where they are shorter) of the
benchmark are joined by hash with the windows of documents. Hits of one document, item
and alignment are consistent when their slots map one to one: equal values of the item to
equal values of the document, different to different. So a question asked again with
other numbers and names is found, a chance likeness of templates is not. A document is
contaminated when the consistent hits of some item reach ``NEED`` windows, or all windows
of an item that has fewer.

Beside the templates, windows of plain words (lower case, no placeholders, no punctuation
at their ends) are joined in the same way, so that verbatim copies are found whatever their
case and spacing; they need no check of slots and are counted by themselves. An item's
n is the larger of the two counts.

Each window of a document holds one piece, about half as long, that begins at a multiple of a
fixed stride (``piece``). Only these pieces are hashed everywhere; a window is hashed where a bit mask of
the benchmark's hashes, of bounded size, may hold its piece, and becomes a row where the mask
may hold itself; the join that follows is exact. The benchmark's windows are broadcast only where their counted number is within
``BROADCAST_WINDOWS``; beyond it the same join shuffles.

Defined results: null text has no tokens; items under ``LEAST`` tokens, and windows less
than half literal, are searched for by plain words alone; items without a word are not
searched for; rows that repeat a doc_id share a verdict; a
null doc_id is never contaminated; items that repeat are one each, different texts under one
item_id are searched for each (the item's hits are those of the text that has most); an empty
benchmark contaminates nothing; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsight.llm.common import cut, forget

WIDTH = 8
NEED = 6
LEAST = 4
BROADCAST_WINDOWS = 200_000
MASK_LONGS = 8192
#: Units that follow a number.
UNITS = "kg|g|mg|km|m|cm|mm|mi|miles?|feet|foot|ft|inch(?:es)?|yards?|lbs?|pounds?|ounces?|oz|tons?|tonnes?|liters?|litres?|l|ml|gallons?|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|dollars?|euros?|cents?|usd|eur|percent|degrees?|mph|kmh|hz|khz|mhz|ghz|kb|mb|gb|tb|watts?|kw|volts?"


#: Begins a placeholder; white space where a text has it.
MARK = "\u0001"


def clean(text: Column) -> Column:
    """The text with one blank for each run of white space; single blanks, the most of it, are not touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\h\v\x01&&[^ ]][\s\h\v\x01]*| [\s\h\v\x01]+", " ")


def plain(cleaned: Column) -> Column:
    """The cleaned text's words without case and without punctuation at their ends; punctuation alone becomes nothing."""
    return F.lower(F.upper(F.regexp_replace(cleaned, r"[^\p{L}\p{N}\s]++(?![\p{L}\p{N}])|(?<!\S)[^\p{L}\p{N}\s]+", "")))


def template(cleaned: Column) -> Column:
    """The cleaned text with one placeholder or plain word for each word; punctuation alone becomes nothing.

    Patterns begin with what is rare (a capital, a digit, a placeholder), so most places fail at once.
    """
    named = F.regexp_replace(cleaned, r"\p{Lu}(?<=[^.!?:\s]\s[^\p{L}\p{N}\s]{0,2}\p{Lu})\p{Ll}[\p{L}'’\-]*", MARK + "p")
    numbered = F.lower(F.regexp_replace(named, r"[+\-]?\p{N}[\p{N}.,:/]*", MARK + "n"))
    unit = F.regexp_replace(numbered, rf"\x01n([^\p{{L}}\p{{N}}\s]{{0,3}}\s)(?:{UNITS})(?![\p{{L}}\p{{N}}])", f"{MARK}n$1{MARK}u")
    return F.regexp_replace(unit, r"[^\p{L}\x01\s]+", "")


def filled(words: Column) -> Column:
    return F.filter(F.split(words, " "), lambda w: w != "")


def tokens(docs: DataFrame, key: str) -> DataFrame:
    """key, tokens, plain: the words of the template and of the plain text that are not empty."""
    cleaned = docs.select(F.col(key).cast("long").alias(key), clean(F.col("text")).alias("c"))
    return cleaned.select(key, filled(template(F.col("c"))).alias("tokens"), filled(plain(F.col("c"))).alias("plain"))


def aligned_words(docs: DataFrame, key: str, *more: str) -> DataFrame:
    """key, words, tokens, plain: the same with the raw word of each token of the template."""
    cleaned = docs.select(F.col(key).cast("long").alias(key), clean(F.col("text")).alias("c"), *more)
    pair = cleaned.select(key, *more, filled(plain(F.col("c"))).alias("plain"), F.arrays_zip(F.split("c", " ").alias("w"), F.split(template(F.col("c")), " ").alias("t")).alias("p"))
    kept = pair.select(key, *more, "plain", F.filter("p", lambda x: x["t"] != "").alias("p"))
    return kept.select(key, *more, F.transform("p", lambda x: x["w"]).alias("words"), F.transform("p", lambda x: x["t"]).alias("tokens"), "plain")


def mask_of(searched: DataFrame, count: int) -> tuple[Column, int]:
    """Bits of which those of the searched windows' hashes and of their pieces' are set, as one array of longs, and their number: MASK_LONGS longs at most, whatever the benchmark's size."""
    longs = 1
    while longs < MASK_LONGS and longs * 64 < count * 16:  # a window brings about one piece of its own
        longs *= 2
    hashes = searched.select(F.explode(F.array_append("pieces", F.col("hash"))).alias("hash"))
    slot = F.col("hash").bitwiseAND(F.lit(64 * longs - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    held = {r["word"]: r["bits"] for r in hashes.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()}
    one = searched.sparkSession.createDataFrame([([held.get(k, 0) for k in range(longs)],)], "bits array<bigint>")
    return one.scalar(), 64 * longs


def piece(width):
    """The size of a window's pieces, and the stride of their places: each window holds one whole piece that begins at a multiple of it."""
    size = (width + 1) // 2 if isinstance(width, int) else F.shiftright(width + 1, 1)
    return size, width - size + 1


def windows(rows: DataFrame, key: str, widths: dict[str, list[int]], mask: tuple[Column, int]) -> DataFrame:
    """key, at (from 1), hash of the windows of these widths of each column (tokens, plain) where the mask may hold both their hash and that of their piece, from one pass over it.

    A token is hashed once; the hash of a window or piece runs over its tokens' hashes and the window's width, which
    is negative for plain words, so that these do not meet templates. Rows are made of what
    the mask lets through alone: making a row costs far more than a hash, and a window's hash more than a piece at every stride.
    """
    bits, n = mask
    hashed = rows.select(key, bits.alias("bits"), *(F.transform(c, lambda t: F.xxhash64(t)).alias(f"h_{c}") for c in widths))

    def may_hold(hash_: Column) -> Column:
        slot = hash_.bitwiseAND(F.lit(n - 1))
        return F.getbit(F.get("bits", F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1

    def hash_at(c: str, width: int, i: Column, size: int) -> Column:
        # single elements are got: a slice would copy the whole array for each window
        return F.xxhash64(F.lit(-width if c == "plain" else width), *(F.get(f"h_{c}", i + k) for k in range(size)))

    def pieces(c: str, width: int) -> Column:
        """The places of pieces that the mask may hold."""
        size, stride = piece(width)
        every = F.sequence(F.lit(0), F.size(f"h_{c}") - size, F.lit(stride))
        return F.when(F.size(f"h_{c}") >= width, F.filter(every, lambda q: may_hold(hash_at(c, width, q, size))))

    def around(c: str, width: int, places: str) -> Column:
        """The windows whose piece begins at these places: no window has two."""
        last, stride = F.size(f"h_{c}") - width, piece(width)[1]
        starts = F.flatten(F.transform(places, lambda q: F.sequence(F.greatest(q - (stride - 1), F.lit(0)), F.least(q, last))))
        made = F.transform(starts, lambda i: F.struct((i + 1).alias("at"), hash_at(c, width, i, width).alias("hash")))
        return F.filter(made, lambda x: may_hold(x["hash"]))

    every = [(c, width, f"p_{c}_{width}") for c in widths for width in widths[c]]
    each = hashed.select("*", *(pieces(c, width).alias(name) for c, width, name in every))
    none = F.array().cast("array<struct<at:int,hash:bigint>>")
    return each.select(key, F.inline(F.concat(*(F.coalesce(around(*x), none) for x in every)) if every else none))


def slots(words: str, toks: str, at: Column, width: Column) -> Column:
    """The raw words of a window, in order, where the token is a slot."""
    part = F.transform(F.sequence(at - 1, at + width - 2), lambda k: F.struct(F.get(words, k).alias("w"), F.get(toks, k).alias("t")))
    return F.transform(F.filter(part, lambda x: x["t"].contains(MARK)), lambda x: F.lower(F.regexp_replace(x["w"], r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))


def bijective(a: str, b: str) -> Column:
    pairs = F.array_distinct(F.arrays_zip(a, b))
    return (F.size(pairs) == F.size(F.array_distinct(a))) & (F.size(pairs) == F.size(F.array_distinct(b)))


def item_windows(items: DataFrame, column: str) -> DataFrame:
    """item_row, item_id, verbatim, width, item_at, hash, pieces (their hashes), theirs (the slots' words) of each window of the items' column; each item by its own width alone. Of templates those half literal or more."""
    verbatim = column == "plain"
    sized = items.where(F.size(column) >= (1 if verbatim else LEAST)).withColumn("width", F.least(F.size(column), F.lit(WIDTH)))
    each = sized.withColumn("item_at", F.explode(F.sequence(F.lit(1), F.size(column) - F.col("width") + 1)))
    part = F.slice(column, F.col("item_at"), F.col("width"))
    kept = each if verbatim else each.where(F.size(F.filter(part, lambda t: ~t.contains(MARK))) * 2 >= F.col("width"))
    theirs = F.array().cast("array<string>") if verbatim else slots("words", "tokens", F.col("item_at"), F.col("width"))
    kind, hashed = -F.col("width") if verbatim else F.col("width"), F.transform(part, lambda t: F.xxhash64(t))
    size, stride = piece(F.col("width"))
    pieces = F.transform(F.sequence(F.lit(1), stride), lambda k: F.xxhash64(kind, F.slice(hashed, k, size)))
    return kept.select("item_row", "item_id", F.lit(verbatim).alias("verbatim"), "width", "item_at", F.xxhash64(kind, hashed).alias("hash"), pieces.alias("pieces"), theirs.alias("theirs"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, n_hits, best_item, contaminated: one row for each row of ``docs``."""
    row = F.xxhash64("item_id", "text")
    items = benchmark.where("item_id is not null").select(row.alias("item_row"), F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates(["item_row"])
    items = cut(aligned_words(items, "item_row").join(items.select("item_row", "item_id"), "item_row"), "bench-items")
    searched = cut(item_windows(items, "tokens").union(item_windows(items, "plain")), "bench-windows")
    forget(items)
    widths = {c: sorted(r[0] for r in searched.where(kind).select("width").distinct().collect()) for c, kind in (("tokens", "not verbatim"), ("plain", "verbatim"))}  # at most WIDTH of each
    everyone = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    nothing = [F.lit(0).cast("long").alias("n_items"), F.lit(0).cast("long").alias("n_hits"), F.lit(None).cast("long").alias("best_item"), F.lit(False).alias("contaminated")]
    if not any(widths.values()):
        return everyone.select("doc_id", *nothing)
    places = searched.drop("theirs", "pieces")
    count = places.count()
    small = count <= BROADCAST_WINDOWS
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = windows(tokens(known, "doc_id"), "doc_id", widths, mask_of(searched, count)).join(F.broadcast(places) if small else places, "hash").select("doc_id", "item_row", "item_id", "verbatim", "width", F.when(~F.col("verbatim"), F.col("at")).alias("at"), "item_at")
    hits = cut(found.distinct(), "bench-hits")
    copied = hits.where("verbatim").groupBy("doc_id", "item_row", "item_id", "verbatim").agg(F.count_distinct("item_at").alias("n"))
    # a document's own words are read beside its hits alone: what leaves the row is the words of slots
    seen = hits.where("not verbatim").groupBy("doc_id").agg(F.collect_set(F.struct("at", "width")).alias("seen"))
    seen = cut(seen, "bench-hit-docs")
    rows = known.join(seen.select("doc_id"), "doc_id", "left_semi").join(seen, "doc_id")
    rows = aligned_words(rows, "doc_id", "seen").select("doc_id", F.inline(F.transform("seen", lambda h: F.struct(h["at"].alias("at"), h["width"].alias("width"), slots("words", "tokens", h["at"], h["width"]).alias("mine")))))
    mine = cut(rows, "bench-slots")
    met = hits.where("not verbatim").join(mine.distinct(), ["doc_id", "at", "width"]).join(searched.where("not verbatim").select("item_row", "item_at", "theirs"), ["item_row", "item_at"])
    aligned = (
        met.groupBy("doc_id", "item_row", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
        .agg(F.collect_set("item_at").alias("places"), F.flatten(F.collect_list("mine")).alias("mine"), F.flatten(F.collect_list("theirs")).alias("theirs"))
        .where(bijective("mine", "theirs"))
        .select("doc_id", "item_row", "item_id", F.explode("places").alias("place"))
        .groupBy("doc_id", "item_row", "item_id", F.lit(False).alias("verbatim"))
        .agg(F.count_distinct("place").alias("n"))
    )
    needed = searched.groupBy("item_row", "verbatim").agg(F.least(F.count_distinct("item_at"), F.lit(NEED)).alias("need"))
    verdict = (
        aligned.union(copied)
        .join(needed, ["item_row", "verbatim"])
        .groupBy("doc_id", "item_id")
        .agg(F.max("n").alias("n"), F.max(F.col("n") >= F.col("need")).alias("enough"))
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("n_items"),
            F.sum("n").cast("long").alias("n_hits"),
            F.min(F.struct((-F.col("n")).alias("n"), "item_id"))["item_id"].alias("best_item"),
            F.max("enough").alias("contaminated"),
        )
    )
    return everyone.join(verdict, "doc_id", "left").select(
        "doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"), "best_item", F.coalesce("contaminated", F.lit(False)).alias("contaminated")
    )
