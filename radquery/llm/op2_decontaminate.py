"""Benchmark decontamination by spaced seeds, with DataFrame operations only.

Words are runs of letters, marks and digits in lower case. An item is found in a document if, somewhere, 13 successive words
agree but for a fifth (all words of an item that has fewer). A mask keeps five of eight successive words and ignores the others;
the hash of the kept ones is a seed. Seeds of documents and of benchmark items are joined, and each hit fixes how both texts
lie against each other. There the words around the hit are compared one by one. Each of both masks alone has a place in any
13 words, or 12, of which up to two are substituted. An item of fewer words is cut into one block more than it may have
substitutions, one of which is then whole: the hashes of its blocks are its seeds, and documents get those of as many words as
these blocks have, if there are any. Of places with the same seed and the same words around, one in an item is enough (for
``decontaminate`` one in all items), so items that repeat themselves or each other don't multiply hits.

Seeds and words of the benchmark are broadcast while both are below a limit; else Spark chooses how to join the stored tables.

Null texts and wordless items hold nothing and are found nowhere; nor are items under ``least`` words, which are no passage as
it is four, but every item is looked for where it is one. Rows with equal ids but
different texts are separate documents or items; rows with equal texts are found alike. Of further columns nothing is read.
Empty tables: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radquery.llm.shared import small, write_table

#: Fixed masks: the places, among eight words, that are kept.
MASKS = ((0, 1, 4, 6, 7), (0, 1, 3, 6, 7))
PLACES = sorted({x for m in MASKS for x in m})
SPAN, WINDOW, SIMILARITY = 8, 13, 0.8
#: Items under MASKED words have seeds of whole blocks; those under LEAST have none, where no other bound is given.
MASKED, LEAST = 12, 4
#: Words of an item whose hits on one diagonal are verified together.
BLOCK = 64
#: Of a benchmark that may be broadcast: seeds, and words of its items. 32 MB each.
BROADCAST_SEEDS, BROADCAST_WORDS = 1_000_000, 4_000_000


def word_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def with_seeds(df: DataFrame) -> DataFrame:
    """Rows of the columns besides ``words``, a seed, and the place of the word that its mask begins at."""
    keys = [c for c in df.columns if c != "words"]
    n = F.greatest(F.lit(0), F.size("words") - SPAN + 1)  # no filter on words, for which they would be made once more
    kept = F.arrays_zip(*(F.slice("words", x + 1, n).alias(f"w{x}") for x in PLACES))
    each = df.select(*keys, F.posexplode(kept).alias("place", "_w"))
    seeds = F.array(*(F.xxhash64(F.lit(k), *(F.col(f"_w.w{x}") for x in mask)) for k, mask in enumerate(MASKS)))
    return each.select(*keys, F.explode(seeds).alias("seed"), "place")


def _block_seed(words: list[Column]) -> Column:
    return F.xxhash64(F.lit(-len(words)), *words)


def block_seeds(texts: DataFrame, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """(item, seed, item_place, words) of the blocks of items from ``least`` to MASKED - 1 words, from columns item, item_words."""
    out = []
    for n in range(max(1, least), MASKED):
        blocks = n - _least(n, similarity) + 1
        bounds = [n * j // blocks for j in range(blocks + 1)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            seed = F.struct(_block_seed([F.col("item_words")[i] for i in range(a, b)]).alias("seed"), F.lit(a).alias("item_place"), F.lit(b - a).alias("words"))
            out.append(F.when(F.size("item_words") == n, seed))
    return texts.where(F.size("item_words").between(max(1, least), MASKED - 1)).select("item", "item_words", F.explode(F.array_compact(F.array(*out))).alias("_s")).select("item", "item_words", "_s.*")


def _least(n: int, similarity: float) -> int:
    return -int(-n * similarity // 1)


def with_block_seeds(df: DataFrame, lengths: list[int]) -> DataFrame:
    """As ``with_seeds``, for blocks of these numbers of words."""
    keys = [c for c in df.columns if c != "words"]
    most = max(lengths)
    kept = F.arrays_zip(*(F.slice("words", x + 1, F.size("words")).alias(f"w{x}") for x in range(most)))  # null beyond the end
    each = df.select(*keys, F.posexplode(kept).alias("place", "_w"))
    seeds = F.array(*(F.when(F.col(f"_w.w{k - 1}").isNotNull(), _block_seed([F.col(f"_w.w{x}") for x in range(k)])) for k in lengths))
    return each.select(*keys, F.explode(F.array_compact(seeds)).alias("seed"), "place")


def _verified(docs: DataFrame, items: DataFrame, window: int, similarity: float, per_item: bool, least: int) -> DataFrame:
    """doc_id, text_hash, item, start_word, same (by word whether it agrees) and window_matches of hits that are an overlap."""
    texts = items.dropDuplicates(["item"])
    near = window - 1  # a window with the hit reaches so far at most
    masked = with_seeds(texts.where(F.size("item_words") >= MASKED).select("item", "item_words", F.col("item_words").alias("words"))).withColumnRenamed("place", "item_place")
    short = write_table(block_seeds(texts, similarity, least), "block-seeds")
    lengths = sorted(r["words"] for r in short.select("words").distinct().collect())  # MASKED at most
    seeds = masked.select("item", "item_words", "seed", "item_place").unionByName(short.drop("words"))
    before = F.least(F.col("item_place"), F.lit(near))
    around = F.xxhash64(F.slice("item_words", F.col("item_place") - before + 1, before + SPAN + near))
    seeds = seeds.withColumns({"_before": before, "_around": around, "_window": F.least(F.lit(window), F.size("item_words"))})
    seeds = seeds.dropDuplicates(["item"] * per_item + ["seed", "_before", "_around", "_window"])
    seeds = write_table(seeds.select("item", "seed", "item_place"), "seeds")
    n_words = texts.agg(F.sum(F.size("item_words")).alias("n")).first()["n"] or 0
    bounded = F.broadcast if seeds.count() <= BROADCAST_SEEDS and n_words <= BROADCAST_WORDS else lambda df: df

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    split = keyed.select("doc_id", "text_hash", word_hashes(F.col("text")).alias("words"))
    block = F.floor(F.col("item_place") / BLOCK).cast("int").alias("block")

    def met(places: DataFrame) -> DataFrame:
        return places.join(bounded(seeds), "seed").select("doc_id", "text_hash", "item", (F.col("place") - F.col("item_place")).alias("start_word"), block)

    hits = met(with_seeds(split))
    if lengths:
        hits = hits.unionByName(met(with_block_seeds(split, lengths)))
    hits = write_table(hits.distinct(), "hits")

    # Compared at once: a block of the item with what a window can reach on both sides.
    first = F.greatest(F.lit(0), -F.col("start_word"), F.col("block") * BLOCK - near)
    last = F.least(F.size("item_words"), F.size("words") - F.col("start_word"), (F.col("block") + 1) * BLOCK + SPAN + near)
    there = hits.withColumnRenamed("doc_id", "_doc").join(keyed, F.col("_doc").eqNullSafe(F.col("doc_id")) & (hits["text_hash"] == keyed["text_hash"]))
    there = there.select("doc_id", keyed["text_hash"], "item", "start_word", "block", word_hashes(F.col("text")).alias("words"))
    there = there.join(bounded(write_table(texts.select("item", "item_words"), "item-words")), "item")
    pair = F.zip_with(F.slice("item_words", first + 1, last - first), F.slice("words", F.col("start_word") + first + 1, last - first), lambda a, b: (a == b).cast("int"))
    there = there.select("doc_id", "text_hash", "item", "start_word", pair.alias("same"), F.least(F.lit(window), F.size("item_words")).alias("_w"))
    sums = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("same") - F.col("_w") + 1)),
        lambda i: F.aggregate(F.slice("same", i, F.col("_w")), F.lit(0), lambda s, x: s + x),
    )
    return there.withColumn("window_matches", F.array_max(sums)).where(F.col("window_matches") >= F.ceil(F.col("_w") * similarity))


def _items(benchmark: DataFrame) -> DataFrame:
    return write_table(benchmark.select("item_id", F.xxhash64("text").alias("item"), word_hashes(F.col("text")).alias("item_words")), "items")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """doc_id, text_hash, item_id, start_word (the document's word that the item's first lies against; negative if it begins
    before the document), and of the place with most matches: overlap_words, matched_words, and window_matches, the most in
    any window."""
    items = _items(benchmark)
    there = _verified(docs, items, window, similarity, True, least)
    best = F.max(F.struct("window_matches", F.aggregate("same", F.lit(0), lambda s, x: s + x).alias("matched_words"), (-F.col("start_word")).alias("before"), F.size("same").alias("overlap_words"))).alias("b")
    found = write_table(there.groupBy("doc_id", "text_hash", "item").agg(best), "leaks-by-item")
    found = found.join(items.select("item", "item_id"), "item")
    return found.select("doc_id", "text_hash", "item_id", (-F.col("b.before")).alias("start_word"), "b.overlap_words", "b.matched_words", "b.window_matches")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    there = _verified(docs, _items(benchmark), window, similarity, False, least)
    leaks = write_table(there.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct(), "leaks")
    return docs.join(small(leaks), docs["doc_id"].eqNullSafe(leaks["_doc"]) & (F.xxhash64(docs["text"]) == leaks["_hash"]), "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, benchmark).drop("text_hash")
