"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scorewright.functions.text import let
from scorewright.llm.tables import saved

SHINGLE = 5
SIMILAR_PERCENT = 75
BITS = 64
BLOCK_BITS = 8
# 64-bit prints of sets at similarity 0.75 (cosine 6/7, the elements being numbered occurrences) differ in 11 bits, deviation 3: four deviations more
RADIUS = 23
BLOCKS = BITS // BLOCK_BITS
BLOCK_RADIUS = RADIUS // BLOCKS  # some block of two prints within the radius differs in no more bits
BROADCAST_SHINGLES = 1_000_000  # item shingles (16 bytes each) above which the anchors are joined by a shuffle


def _words(text: str) -> Column:
    whole = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Hash of the shingle at each place; fewer words than a shingle make one of the whole sequence."""
    at = lambda i, j: F.get(words, (i + j).cast("int"))
    many = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[at(i, j) for j in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, many).when(F.size(words) > 0, F.array(F.xxhash64(F.concat_ws(" ", words)))).otherwise(F.array().cast("array<long>"))


def _numbered(shingles: Column) -> Column:
    """The shingles with each occurrence after the first told apart, so that weighted similarity is that of plain sets."""
    again = lambda xs: F.transform(xs, lambda s, i: let(i - F.array_position(xs, s) + 1, lambda k: F.when(k > 0, F.xxhash64(s, k)).otherwise(s)))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), shingles).otherwise(let(F.sort_array(shingles), again))


def _simhash(shingles: Column) -> Column:
    """Bit b is set when more than half of the shingles, each occurrence an element of its own, have it set."""
    return let(_numbered(shingles), _majority)


def _majority(shingles: Column) -> Column:
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"),
        lambda acc, b: acc.bitwiseOR(F.when(
            F.aggregate(shingles, F.lit(0), lambda n, s: n + F.getbit(s, b).cast("int")) * 2 > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def _blocks(print_: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(print_, k * BLOCK_BITS).bitwiseAND(F.lit(2**BLOCK_BITS - 1)).cast("int").alias("value")) for k in range(BLOCKS)])


def _near_values(spark) -> DataFrame:
    """(value, near): the block values within BLOCK_RADIUS bits of each, a table of fixed size."""
    a = spark.range(2**BLOCK_BITS).select(F.col("id").cast("int").alias("value"), F.explode(F.sequence(F.lit(0), F.lit(2**BLOCK_BITS - 1))).alias("near"))
    return a.where(F.bit_count(F.col("value").bitwiseXOR(F.col("near"))) <= BLOCK_RADIUS)


def _weighted(a: Column, b: Column) -> tuple[Column, Column]:
    """Sums of the smaller and of the larger weight of each shingle, the weight being how often it occurs."""
    times = lambda xs, s: F.size(F.filter(xs, lambda x: x == s))
    low = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, s: n + F.least(times(a, s), times(b, s)))
    return low, F.size(a) + F.size(b) - low


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _starts(spots: DataFrame) -> DataFrame:
    """(id, key, len, start) of the windows that could be similar to an item of ``len`` words.

    ``spots`` has each place p of a document (n words) whose shingle h occurs in items of that size, at most ``most`` times in one. The place
    counts for the windows that hold it and fewer than ``most`` earlier places of h: a range of starts. The running sum over the ends of all
    ranges is the largest weight a window and an item can share, which must be 3/7 of the weight of both (0.75 of what either has).
    """
    size = F.least("len", "n")
    own, sought = F.greatest(size - (SHINGLE - 1), F.lit(1)), F.greatest(F.col("len") - (SHINGLE - 1), F.lit(1))
    least = F.ceil((own + sought) * SIMILAR_PERCENT / (100 + SIMILAR_PERCENT) - 1e-9).cast("int")
    # equal rows of a document have the same places
    docs = spots.groupBy("id", "key", "n", "len").agg(F.collect_set(F.struct("p", "h", "most")).alias("marks")).where(F.size("marks") >= least)
    marks = docs.select("id", "key", "n", "len", F.explode("marks").alias("m")).select("id", "key", "n", "len", "m.*")
    each = marks.groupBy("id", "key", "n", "len", "h", "most").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    before = lambda i: F.coalesce(F.get("ps", i - F.col("most")) + 1, F.lit(0))
    range_ = lambda p, i: F.struct(F.greatest(F.lit(0), p - own + 1, before(i)).alias("from"), F.least(p, F.col("n") - size).alias("to"))
    ranges = each.select("id", "key", "n", "len", F.explode(F.transform("ps", range_)).alias("r")).where("r.from <= r.to")
    ends = ranges.select("id", "key", "n", "len", F.explode(F.array(F.struct(F.col("r.from").alias("at"), F.lit(1).alias("d")), F.struct((F.col("r.to") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy("id", "key", "n", "len", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    along = Window.partitionBy("id", "key", "n", "len").orderBy("at")
    shared = F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0))
    runs = steps.select("id", "key", "n", "len", "at", shared.alias("shared"), F.lead("at").over(along).alias("next")).where(F.col("shared") >= least)
    return runs.select("id", "key", "len", F.explode(F.sequence("at", F.col("next") - 1)).alias("start"))


def _lined(own: Column, sh: Column, start: Column, last: Column) -> Column:
    """Whether a shingle is at the same place of window and item, or would be but for the beginning or the end (``last`` start) of the document."""
    same = F.coalesce(F.exists(F.zip_with(own, sh, lambda a, b: a == b), lambda x: x), F.lit(False))
    later = F.exists(F.transform(own, lambda h, p: F.array_contains(F.slice(sh, p + 1, F.size(sh)), h)), lambda x: x)
    earlier = F.exists(F.transform(own, lambda h, p: F.array_contains(F.slice(sh, 1, p + 1), h)), lambda x: x)
    return F.when(same, True).when((start == 0) & later, True).otherwise((start == last) & earlier)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_key, item_id, start_word, n_words, hamming, similarity): the best window of each document for each item it contains.

    Words are runs of anything but space and 0x09-0x0D in lower case. A window has as many words as the item (the whole document, if shorter) and
    starts anywhere the document's shingles, in whatever order, could reach the similarity with items of that size: ``_starts`` counts, for every
    start, the shingles within the window that such an item has, each as often as one item has it, and no item shares more. An item of fewer
    words than a shingle is one shingle, and so is such a document: they match when they are equal. Windows and items of one size whose SimHash prints are within ``RADIUS`` bits are found by equal block values after
    each item block is varied by up to ``BLOCK_RADIUS`` bits; their shingles, weighted by how often they occur, must then be similar to 0.75
    or more (smaller weights over larger weights). Ties go to a start at which an equal shingle lines up (``_lined``), then to the smaller start. Null or wordless texts and items match nothing. Rows that
    repeat an id and text give one result; a null id is kept as such. text_key is ``text_key(text)``, which tells rows of one id apart.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).alias("item"), _words(item_text).alias("w")).where(F.size("w") > 0)
    items = items.select("item", F.size("w").alias("len"), _shingles(F.col("w")).alias("sh"))
    # written first: else the optimiser pushes tests on the prints below and computes them again from the text
    items = saved(items.select("*", _simhash(F.col("sh")).alias("item_print")))
    times = lambda h: F.size(F.filter("sh", lambda x: x == h))
    places = items.select("len", F.explode(F.transform(F.array_distinct("sh"), lambda h: F.struct(h.alias("h"), times(h).alias("most")))).alias("x"))
    places = places.groupBy("len", "x.h").agg(F.max("x.most").alias("most"))
    if places.count() <= BROADCAST_SHINGLES:
        places = F.broadcast(places)
    rows = docs.select(F.col(doc_id).alias("id"), text_key(text).alias("key"), F.col(text).cast("string").alias("text"))
    spots = rows.select("id", "key", _words("text").alias("w"))
    spots = spots.select("id", "key", F.size("w").alias("n"), F.posexplode(_shingles(F.col("w"))).alias("p", "h")).join(places, "h")
    spots = _starts(spots).groupBy("id", "key").agg(F.collect_set(F.struct("len", "start")).alias("vs"))
    # only the documents with such a start are cut into windows
    held = rows.withColumnRenamed("id", "row").withColumnRenamed("key", "row_key").join(spots, F.col("row").eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("key")))
    windows = held.select("id", "key", _words("text").alias("w"), "vs").select("id", "key", "w", F.explode("vs").alias("v"))
    windows = windows.select("id", "key", "v.len", "v.start", F.size("w").alias("n"), F.slice("w", F.col("v.start") + 1, F.col("v.len")).alias("w"))
    windows = windows.select("id", "key", "len", "start", "n", _shingles(F.col("w")).alias("own"))
    windows = saved(windows.select("*", _simhash(F.col("own")).alias("print")))
    sought = items.select("item", "len", "sh", "item_print", F.explode(_blocks(F.col("item_print"))).alias("b"))
    sought = sought.join(F.broadcast(_near_values(spark)), F.col("b.value") == F.col("value")).select("item", "len", "sh", "item_print", F.col("b.block").alias("block"), F.col("near").alias("at"))
    probes = windows.select("*", F.explode(_blocks(F.col("print"))).alias("b")).select("id", "key", "len", "start", "n", "own", "print", F.col("b.block").alias("block"), F.col("b.value").alias("at"))
    apart = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    pairs = probes.join(sought, ["len", "block", "at"]).withColumn("hamming", apart).where(F.col("hamming") <= RADIUS)
    low, high = _weighted(F.col("own"), F.col("sh"))
    lined = _lined(F.col("own"), F.col("sh"), F.col("start"), F.col("n") - F.col("len"))
    pairs = pairs.select("id", "key", "item", "start", "len", "hamming", low.alias("low"), high.alias("high"), lined.alias("lined")).where(F.col("low") * 100 >= F.col("high") * SIMILAR_PERCENT)
    best = F.max(F.struct((F.col("low") / F.col("high")).alias("similarity"), "lined", (-F.col("start")).alias("back"), F.col("len"), F.col("hamming")))
    found = pairs.groupBy("id", "key", "item").agg(best.alias("m"))
    found = found.select(F.col("id").alias(doc_id), F.col("key").alias("text_key"), F.col("item").alias(item_id), (-F.col("m.back")).cast("long").alias("start_word"), F.col("m.len").cast("long").alias("n_words"), F.col("m.hamming").alias("hamming"), F.col("m.similarity").alias("similarity"))
    return found.distinct()
