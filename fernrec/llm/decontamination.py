"""Operator 4: benchmark decontamination with a broadcast set of word n-grams.

Words are runs of ASCII digits, ASCII letters (lower-cased) and characters
beyond ASCII. Every benchmark item gives the windows of ``n`` consecutive
words (a shorter item gives one window, the whole item). The distinct windows
form the build side of a hash join on a 64-bit hash; every window of every
document probes it, and a hit counts only if its words are equal. Everything
is DataFrame functions.

The build side is broadcast while its measured size is under
``broadcast_bytes``. Document rows then stay in the stream through the join
(each row's first probe is kept whether or not it hits), so a text is split
once and only rows with hits and one row per document are shuffled. Above that
the distinct documents are written once, probes of hash and place alone are
shuffled to the windows' hashes, and the words of the places found are fetched
from their documents and compared. Both ways give the same rows.

Edge cases: a null text has no words; an item without words has no window;
repeated rows of documents give one result row each; rows with a null id are
kept; other columns are ignored; empty tables give no rows, or no hits. Items
with equal windows are all reported; ``item_id`` null is left out of the ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, row_key, whole_text, written

WINDOW = 10
BROADCAST_BYTES = 64 << 20

# Fixed value: what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), SEPARATORS), lambda w: w != F.lit(""))


def _windows(words: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` words (none if there are fewer)."""
    return F.when(F.size(words) >= size, F.transform(
        F.sequence(F.lit(1), F.size(words) - F.lit(size - 1)),
        lambda at: F.xxhash64(F.slice(words, at, size), F.lit(size)))).otherwise(
            F.array().cast("array<bigint>"))


def benchmark_windows(items: DataFrame, n: int = WINDOW, id_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """h and grams: the distinct windows by hash; for each window its size, its
    words joined by blanks and the ids (as strings) of the items that have it."""
    words = items.select(F.col(id_col).cast("string").alias("item"),
                         words_of(whole_text(text_col)).alias("w"))
    size = F.least(F.size("w"), F.lit(n))
    grams = (words.filter(F.size("w") > 0)
             .select("item", size.alias("size"), F.explode(F.transform(
                 F.sequence(F.lit(1), F.size("w") - size + 1),
                 lambda at: F.slice("w", at, size))).alias("gram"))
             .groupBy("size", F.xxhash64("gram", "size").alias("h"),
                      F.concat_ws(" ", "gram").alias("gram"))
             .agg(F.collect_set("item").alias("items")))
    return grams.groupBy("h").agg(F.collect_list(F.struct("size", "gram", "items"))
                                  .alias("grams"))


def _build_bytes(windows: DataFrame) -> int:
    """Measured size of the distinct windows."""
    of_gram = lambda a, g: a + F.octet_length(g["gram"]) + 64 + F.aggregate(
        g["items"], F.lit(0).cast("bigint"), lambda b, x: b + F.octet_length(x) + 16)
    return windows.select(F.sum(F.aggregate("grams", F.lit(0).cast("bigint"), of_gram))
                          .alias("b")).first()["b"] or 0


def benchmark_hits(docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id",
                   text_col: str = "text", item_id_col: str = "item_id",
                   item_text_col: str = "text",
                   broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per distinct pair of id and text: _k (row key), doc_id, copies
    (rows with that id and text), n_words, spans (sorted first and last words,
    from 0, of maximal runs of hit words) and items (sorted ids of items with
    hits)."""
    windows = written(benchmark_windows(items, n, item_id_col, item_text_col), "windows")
    # at most n sizes exist
    sizes = sorted(r["s"] for r in windows.select(F.explode("grams.size").alias("s"))
                   .distinct().collect()) or [n]
    texts = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("_k"),
                        whole_text(text_col).alias("text"))
    if _build_bytes(windows) > broadcast_bytes:
        return _hits_by_shuffle(texts, windows, sizes)
    words = texts.select("doc_id", "_k", words_of(F.col("text")).alias("w"))
    probes = words.select("doc_id", "_k", "w", F.posexplode_outer(
        F.concat(*[_windows(F.col("w"), s) for s in sizes])).alias("_i", "_h"))
    # the probes of a row are its windows of the first size, then of the next
    size, at, passed = F.lit(sizes[0]), F.col("_i"), F.lit(0)
    for s, t in zip(sizes, sizes[1:]):
        passed = passed + F.greatest(F.size("w") - (s - 1), F.lit(0))
        size = F.when(F.col("_i") >= passed, F.lit(t)).otherwise(size)
        at = F.when(F.col("_i") >= passed, F.col("_i") - passed).otherwise(at)
    first = F.coalesce("_i", F.lit(0)) == 0
    joined = (probes.join(F.broadcast(windows), F.col("_h") == F.col("h"), "left")
              .filter(F.col("h").isNotNull() | first)
              .select("_k", "doc_id", F.size("w").alias("n_words"), at.alias("at"),
                      size.alias("size"), first.cast("bigint").alias("_rows"),
                      F.concat_ws(" ", F.slice("w", at + 1, size)).alias("_gram"), "grams")
              .withColumn("_real", F.filter("grams", lambda g: (g["gram"] == F.col("_gram"))
                                            & (g["size"] == F.col("size")))))
    hit = F.coalesce(F.size("_real") > 0, F.lit(False))
    span = F.when(hit, F.struct(F.col("at").alias("a"), (F.col("at") + F.col("size")).alias("b")))
    found = joined.groupBy("_k").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.sum("_rows").alias("copies"), F.array_sort(F.collect_set(span)).alias("_hits"),
        F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_set(
            F.when(hit, F.col("_real.items"))))))).alias("items"))
    return found.select("_k", "doc_id", "copies", "n_words", _merged("_hits").alias("spans"),
                        "items")


def _hits_by_shuffle(texts: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """``benchmark_hits`` of texts (doc_id, _k, text) for windows of any number.

    Repeated rows meet under their key after a partial aggregation; a window
    that many documents hold is one row on the other side of an inner join,
    whose skewed partitions are split. What a document's hits need is bounded by
    that document."""
    rows = written(texts.groupBy("_k").agg(
        F.first("doc_id").alias("doc_id"), F.first("text").alias("text"),
        F.count(F.lit(1)).alias("copies")), "distinct_documents")
    words = words_of(F.col("text"))
    split = rows.select("_k", words.alias("w"))

    def placed(size: int) -> Column:
        return F.transform(_windows(F.col("w"), size), lambda h, at: F.struct(
            h.alias("h"), at.alias("at"), F.lit(size).alias("size")))

    probes = split.select("_k", F.explode(F.concat(*map(placed, sizes))).alias("p"))
    hashes = windows.select(F.col("h").alias("_h"))
    places = (probes.join(hashes, F.col("p.h") == F.col("_h")).groupBy("_k")
              .agg(F.collect_set("p").alias("places")))
    gram = lambda p: F.struct(
        p["h"].alias("h"), p["at"].alias("at"), p["size"].alias("size"),
        F.concat_ws(" ", F.slice("w", p["at"] + 1, p["size"])).alias("gram"))
    fetched = (rows.select("_k", "text").join(places, "_k")
               .select("_k", words.alias("w"), "places")
               .select("_k", F.explode(F.transform("places", gram)).alias("p")))
    known = windows.select(F.col("h").alias("_h"), F.explode("grams").alias("g"))
    found = (fetched.join(known, (F.col("p.h") == F.col("_h"))
                          & (F.col("p.size") == F.col("g.size"))
                          & (F.col("p.gram") == F.col("g.gram")))
             .groupBy(F.col("_k").alias("_found")).agg(
                 F.array_sort(F.collect_set(F.struct(
                     F.col("p.at").alias("a"), (F.col("p.at") + F.col("p.size")).alias("b"))))
                 .alias("_hits"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_set("g.items")))).alias("items")))
    empty = F.array().cast("array<struct<a:int,b:int>>")
    return (rows.select("_k", "doc_id", "copies", F.size(words).alias("n_words"))
            .join(found, F.col("_k") == F.col("_found"), "left")
            .select("_k", "doc_id", "copies", "n_words",
                    _merged(F.coalesce("_hits", empty)).alias("spans"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def _merged(hits: str | Column) -> Column:
    """Sorted half-open ranges -> disjoint inclusive ranges."""
    start = F.array().cast("array<struct<a:int,b:int>>")

    def grow(done: Column, hit: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = F.coalesce(hit["a"] <= last["b"], F.lit(False))
        wider = F.struct(last["a"].alias("a"), F.greatest(last["b"], hit["b"]).alias("b"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))
                      ).otherwise(F.concat(done, F.array(hit)))

    return F.transform(F.aggregate(hits, start, grow),
                       lambda s: F.struct(s["a"].alias("a"), (s["b"] - 1).alias("b")))


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = benchmark_hits(docs, items, **options)
    n_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["b"] - s["a"] + 1)
    return (hits.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"),
                        n_hit.cast("bigint").alias("n_hit"),
                        F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
            .drop("_copy").withColumn("contaminated", F.col("n_hit") > 0))


def drop_contaminated(docs: DataFrame, items: DataFrame, max_share: float = 0.0,
                      id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents whose share of hit words is at most ``max_share``, with
    all their columns."""
    hits = benchmark_hits(docs, items, id_col=id_col, text_col=text_col, **options)
    n_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["b"] - s["a"] + 1)
    bad = hits.filter((n_hit > 0) & (n_hit > F.lit(max_share) * F.col("n_words"))).select(
        F.col("_k").alias("_bad_key"))
    return docs.join(bad, row_key(id_col, text_col) == F.col("_bad_key"), "left_anti")
