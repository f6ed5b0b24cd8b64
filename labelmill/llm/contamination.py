"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A benchmark item is cut into windows of ten words (a shorter item is one window), a window
into shingles of three words. A document contains a window only if it contains all of its
shingles, so of a window's set the necessary prefix is one shingle; taking the one that is
rarest in the documents leaves the fewest candidates. The join gives alignments (document,
start, window). An alignment must lie inside the document (length bound), and exact
containment holds when the window's shingles stand at their places one by one (position
bound), which is counted on the matches that the first pass has already found.

Documents are read once for the matches; only places whose shingle some item has leave
that pass. Shingles are compared by 64-bit hashes of their words: a match of a window
needs equality of all of its shingle hashes in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelmill.llm.steps import id_key, saved

WINDOW, SHINGLE = 10, 3
#: Runs of digits, letters and bytes beyond ASCII; A-Z count as a-z. Said by what it holds, most
#: frequent first: the complement of the other characters tests each letter against all of them.
WORD = r"[a-z0-9A-Z\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shingles of all items are broadcast up to this many (16 MB of hashes), else shuffled.
BROADCAST_SHINGLES = 1_000_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _shingle_hashes(words: Column, size: int) -> Column:
    """Hash of the ``size`` words from each place; places too near the end are null."""
    def at(_: Column, i: Column) -> Column:
        return F.when(i + size <= F.size(words), F.xxhash64(*[F.get(words, i + k) for k in range(size)], F.lit(size)))

    return F.transform(words, at)


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """win, item_id, size (words), off and h: a row per shingle of each distinct window.

    A window of fewer than ``shingle`` words has one shingle, of all its words.
    """
    words = items.select("item_id", _words(F.col("text").cast("string")).alias("w")).filter("size(w) > 0")
    starts = words.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("s"))
    cut = starts.select("item_id", F.slice("w", F.col("s") + 1, window).alias("w")).withColumn("size", F.size("w")).withColumn("win", F.xxhash64("w")).distinct()
    sets = None
    for k in range(1, shingle + 1):
        part = cut.filter(F.col("size") == k if k < shingle else F.col("size") >= k)
        part = part.select("win", "item_id", "size", F.posexplode(_shingle_hashes(F.col("w"), k)).alias("off", "h"), F.lit(k).alias("k")).filter("h is not null")
        sets = part if sets is None else sets.unionByName(part)
    return sets


def document_matches(docs: DataFrame, shingles: DataFrame, sizes: list[int], broadcast: bool) -> DataFrame:
    """_id, pos and h wherever a document has a shingle of some item."""
    words = docs.select("_id", _words(F.col("text").cast("string")).alias("w"))
    hashes = F.array(*[_shingle_hashes(F.col("w"), k) for k in sizes])
    if len(sizes) == 1:
        places = words.select("_id", F.posexplode(_shingle_hashes(F.col("w"), sizes[0])).alias("pos", "h"))
    else:
        places = words.select("_id", F.explode(hashes).alias("hs")).select("_id", F.posexplode("hs").alias("pos", "h"))
    keys = shingles.select("h").distinct()
    return places.filter("h is not null").join(F.broadcast(keys) if broadcast else keys, "h", "left_semi")


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """_id, pos, size and item_id for each occurrence of an item's window in a document."""
    sets = saved(item_windows(items, window, shingle), "item-windows")
    sizes = sorted(r.k for r in sets.select("k").distinct().collect())  # at most ``shingle`` values
    if not sizes:
        sizes = [shingle]
    small = sets.select("h").distinct().count() <= BROADCAST_SHINGLES
    found = saved(document_matches(docs, sets, sizes, small), "shingle-matches")
    freq = found.groupBy("h").agg(F.count("*").alias("df"))
    ranked = sets.select("win", "size", "k", "off", "h").distinct().join(freq, "h", "left")
    need = ranked.groupBy("win", "size", "k").agg(F.count("*").alias("n"), F.count("df").alias("known"), F.min(F.struct("df", "h", "off")).alias("rare"))
    # a window with a shingle that no document has can't occur
    need = need.filter("n = known").select("win", "size", "k", "n", F.col("rare.h").alias("h"), F.col("rare.off").alias("off"))
    need = saved(need, "necessary")
    lead = need.select("win", "n", "h", "off")
    start = found.join(lead, "h").select("_id", "win", "n", (F.col("pos") - F.col("off")).alias("start")).filter("start >= 0").distinct()
    whole = sets.select("win", "off", "h").distinct()
    expected = start.join(whole, "win").select("_id", "win", "n", "start", (F.col("start") + F.col("off")).alias("pos"), "h")
    full = expected.join(found.distinct(), ["_id", "pos", "h"]).groupBy("_id", "win", "start").agg(F.count("*").alias("got"), F.first("n").alias("n")).filter("got = n")
    owner = sets.select("win", "item_id", "size").distinct()
    return full.join(owner, "win").select("_id", F.col("start").alias("pos"), "size", "item_id")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Documents with n_words, n_hit, n_items, items (sorted item ids as strings),
    items_sha256 and contaminated.

    A document word inside an occurrence of any item window is hit. Null and blank texts
    and items have no words. Every row is judged by its own text, whether doc_ids are null,
    repeated or not. All columns of ``docs`` are kept; columns of these names are replaced.
    """
    own = ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "_id", "_places"]
    docs = docs.drop(*own)
    # Rows that agree in both have the same matches.
    base = docs.withColumn("_id", F.struct(id_key().alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("text")))
    hit = saved(hits(base.select("_id", "text"), items.select("item_id", "text"), window, shingle), "hits")
    spans = hit.select("_id", "pos", "size").distinct()
    places = spans.select("_id", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("size") - 1)).alias("p")).distinct().groupBy("_id").agg(F.count("*").alias("n_hit"))
    owners = hit.select("_id", F.col("item_id").cast("string").alias("i")).distinct().groupBy("_id").agg(F.array_sort(F.collect_list("i")).alias("items"))
    per_doc = saved(places.join(owners, "_id"), "hit-documents")
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    out = base.withColumn("n_words", words).join(per_doc, "_id", "left")
    none = F.array().cast("array<string>")
    return out.select(
        *docs.columns, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"), F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
