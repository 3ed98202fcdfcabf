"""Operator 12 [native]: mixing sources to target weights.

The words of a source, its documents one after the other, are packed into
blocks of ``block_words`` (only a source's last block may be shorter). The
output is cut into shards of ``shard_slots`` slots of one block each. Every
slot draws its source with the targets' odds, so a shard's source counts are
multinomial. The k-th draw of a source is its slot k; slots past the source's
quota of blocks go to the sources that drew less than theirs, so that every
source ends at its target exactly. Slot k is mapped through the source's
pseudorandom index permutation (blocks ordered by a hash of seed, pass over the
source, source and block; a second pass starts when all blocks are used), and
the block is joined by its index. The source's last slot takes only the words
missing to the target.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and
share ``share`` times all words; a target stops at ``most`` times its source's
words and the excess is shared again by weight until none is above. A block is
used at most ``most`` times, so no document is taken more often than that.

All steps are DataFrame functions. Running numbers come from range partitions
(``common.running``), never from one window per source, and targets reach the
documents by ``common.join_by_key``, so a source may hold any share of the rows.

Edge cases: null and empty texts, and texts of white space only, have size 0
and nothing is taken; null ids sort first; rows equal in id and text are
documents of their own; sources of size 0 have target 0; an empty table gives
no rows; other columns are ignored. Results depend on the rows alone, not on
how they are partitioned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prepare import rank_rows
from .common import join_by_key, row_key, running, whole_text, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 512
SHARD_SLOTS = 1024
#: The draws' value range is cut into so many equal cells to find the source of
#: a draw by an equal join.
CELLS = 4096


@dataclass
class Mix:
    """The plan of a mix; all frames are backed by written tables."""

    docs: DataFrame     # doc, doc_id, key, g, size, start, source_size, target, quota
    sources: DataFrame  # g, source, size, n_docs, weight, target, quota (words)
    slots: DataFrame    # shard, slot, g, block, n (words used)
    spans: DataFrame    # shard, slot, at, doc, doc_id, key, first, n


def target_words(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (g, size, weight) with target and quota (the target in whole
    words): rounds of sharing by weight, each one aggregate over the sources."""
    size, weight = F.col("size"), F.col("weight")
    cap = size * F.lit(most)
    total = sources.agg(F.sum("size")).first()[0] or 0
    wanted, level, n_capped = share * int(total), None, None
    while True:
        above = F.lit(False) if level is None else cap.cast("double") <= weight * F.lit(level)
        capped, open_weight, n = sources.agg(
            F.sum(F.when(above, cap)), F.sum(F.when(~above, weight)), F.count_if(above)).first()
        if not open_weight or n == n_capped:
            break
        level, n_capped = (wanted - int(capped or 0)) / float(open_weight), n
    target = (cap.cast("double") if level is None
              else F.least(cap.cast("double"), weight * F.lit(level)))
    return (sources.withColumn("target", target)
            .withColumn("quota", F.least(cap, F.floor(F.col("target") + F.lit(0.5)))))


def _draw(quotas: DataFrame, n_slots: int, shard_slots: int, seed: int) -> DataFrame:
    """slot, shard, g, k: the source of every slot and its number within it.
    ``quotas``: g, n_blocks (slots due), written; they add up to ``n_slots``."""
    spark = quotas.sparkSession
    due = running(quotas.withColumn("one", F.lit("")), "one", ["g"], {"due": F.col("n_blocks")})
    width = -(-n_slots // CELLS)
    lo, hi = F.col("before_due"), F.col("before_due") + F.col("n_blocks")
    cells = due.select("g", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(
        F.floor(lo / F.lit(width)), F.floor((hi - 1) / F.lit(width)))).alias("cell"))
    value = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(n_slots))
    draws = (spark.range(n_slots).select(F.col("id").alias("slot"), value.alias("value"))
             .withColumn("cell", F.floor(F.col("value") / F.lit(width)))
             .join(written(cells, "cells"), "cell")
             .filter((F.col("value") >= F.col("lo")) & (F.col("value") < F.col("hi")))
             .select("slot", F.floor(F.col("slot") / F.lit(shard_slots)).alias("shard"), "g"))
    draws = written(draws, "draws")
    # the multinomial counts of every shard, and the draws' numbers from them;
    # a window holds one shard's draws, or one count per shard
    counts = draws.groupBy("shard", "g").agg(F.count(F.lit(1)).alias("n"))
    first = F.sum("n").over(Window.partitionBy("g").orderBy("shard").rowsBetween(
        Window.unboundedPreceding, -1))
    counts = counts.select("shard", "g", F.coalesce(first, F.lit(0)).alias("first"))
    in_shard = F.row_number().over(Window.partitionBy("shard", "g").orderBy("slot")) - 1
    draws = (draws.withColumn("in_shard", in_shard).join(counts, ["shard", "g"])
             .select("slot", "shard", "g", (F.col("first") + F.col("in_shard")).alias("k")))
    draws = written(draws, "numbered")
    # draws past a quota go, in order, to the numbers no draw reached
    drawn = draws.groupBy("g").agg(F.count(F.lit(1)).alias("drawn"))
    less = F.col("n_blocks") - F.coalesce("drawn", F.lit(0))
    gaps = running(quotas.join(drawn, "g", "left").withColumn("one", F.lit("")), "one", ["g"],
                   {"over": F.greatest(-less, F.lit(0)), "under": F.greatest(less, F.lit(0))})
    gaps = written(gaps.select("g", "n_blocks", "before_over", "before_under",
                               F.coalesce("drawn", F.lit(0)).alias("drawn")), "gaps")
    under = (gaps.filter(F.col("drawn") < F.col("n_blocks"))
             .select("g", "drawn", "before_under", F.explode(F.sequence(
                 F.col("drawn"), F.col("n_blocks") - 1)).alias("k"))
             .select("g", "k", (F.col("before_under") + F.col("k") - F.col("drawn")).alias("x")))
    numbered = join_by_key(draws, gaps.filter(F.col("drawn") > 0), "g", "drawn")
    kept = numbered.filter(F.col("k") < F.col("n_blocks"))
    over = numbered.filter(F.col("k") >= F.col("n_blocks")).select(
        "slot", "shard", (F.col("before_over") + F.col("k") - F.col("n_blocks")).alias("x"))
    return kept.select("slot", "shard", "g", "k").unionByName(
        over.join(under, "x").select("slot", "shard", "g", "k"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
                share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS,
                shard_slots: int = SHARD_SLOTS, seed: int = 0) -> Mix:
    """Plan the mix of ``docs``: which words of which document fill which slot."""
    if share > most:
        raise ValueError("share must not exceed most: the sources cannot fill the mix")
    g = F.when(F.col(source_col).isNull(), F.lit("t")).otherwise(
        F.concat(F.lit("s"), F.col(source_col).cast("string")))
    base = written(docs.select(
        F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), g.alias("g"),
        F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("bigint").alias("size")), "mix_docs")
    # the documents' places in their sources' streams
    placed = running(base, "g", ["doc_id", "key"], {"size": F.col("size")})
    placed = written(placed.withColumn("doc", F.monotonically_increasing_id()), "placed")
    sources = base.groupBy("g").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_docs"))
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          (F.pmod("pos", F.lit(len(weights))) + 1).cast("int")).cast("bigint")
    sources = written(rank_rows(sources, ["g"], "pos").select(
        "g", F.when(F.col("g") != "t", F.substring("g", 2, 1 << 30)).alias("source"),
        "size", "n_docs", weight.alias("weight")), "sources")
    sources = written(target_words(sources, share, most), "targets")
    rows = join_by_key(placed, sources.select("g", "target", "quota", "n_docs"), "g", "n_docs")
    rows = written(rows.select("doc", "doc_id", "key", "g", "size", F.col("before_size").alias("start"),
                               F.col("all_size").alias("source_size"), "target", "quota"), "mix_rows")

    size, start, words = F.col("size"), F.col("start"), F.lit(block_words)
    full = rows.filter(size > 0)
    # a block belongs to the document of its first word
    lo, hi = F.ceil(start / words), F.ceil((start + size) / words) - 1
    n_block = F.least(words, F.col("source_size") - F.col("block") * words)
    passes = F.explode(F.array(*map(F.lit, range(most))))
    uses = (full.filter(hi >= lo)
            .select("g", "source_size", "quota", F.explode(F.sequence(lo, hi)).alias("block"))
            .select("g", "quota", "source_size", "block", n_block.alias("n"), passes.alias("turn"))
            .filter(F.col("turn") * F.col("source_size") < F.col("quota"))
            .withColumn("hash", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("turn").cast("string"),
                                                  F.col("g"), F.col("block").cast("string")))))
    uses = running(uses, "g", ["turn", "hash", "block"], {"k": F.lit(1), "n": F.col("n")})
    chosen = written(uses.filter(F.col("before_n") < F.col("quota")).select(
        "g", F.col("before_k").alias("k"), "block",
        F.least("n", F.col("quota") - F.col("before_n")).alias("n")), "chosen")
    quotas = written(chosen.groupBy("g").agg(F.count(F.lit(1)).alias("n_blocks")), "quotas")
    n_slots = int(quotas.agg(F.sum("n_blocks")).first()[0] or 0)
    if n_slots:
        drawn = _draw(quotas, n_slots, shard_slots, seed)
    else:
        drawn = chosen.select(F.col("k").alias("slot"), F.col("k").alias("shard"), "g", "k")
    slots = written(drawn.join(chosen, ["g", "k"]).select("shard", "slot", "g", "block", "n"), "slots")

    pieces = full.select("doc", "doc_id", "key", "g", "size", "start", F.explode(F.sequence(
        F.floor(start / words), F.floor((start + size - 1) / words))).alias("block"))
    begin = F.col("block") * words
    from_ = F.greatest(begin, start)
    pieces = pieces.select("doc", "doc_id", "key", "g", "block", (from_ - begin).alias("at"),
                           (from_ - start).alias("first"),
                           (F.least(begin + words, start + size) - from_).alias("len"))
    spans = (pieces.join(slots, ["g", "block"]).filter(F.col("at") < F.col("n"))
             .select("shard", "slot", "at", "doc", "doc_id", "key", "first",
                     F.least("len", F.col("n") - F.col("at")).alias("n")))
    return Mix(rows, sources, slots, written(spans, "spans"))


def mixed_blocks(docs: DataFrame, mix: Mix, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The mix itself: shard, slot, n_words, text (a block's words, joined by
    one space). A row's spans are at most as many as its words."""
    texts = docs.select(row_key(id_col, text_col).alias("key"), F.regexp_extract_all(
        whole_text(text_col), F.lit(WORD), F.lit(0)).alias("words")).dropDuplicates(["key"])
    part = F.array_join(F.slice("words", (F.col("first") + 1).cast("int"), F.col("n").cast("int")), " ")
    return (mix.spans.join(texts, "key").select("shard", "slot", "at", "n", part.alias("part"))
            .groupBy("shard", "slot").agg(
                F.sum("n").alias("n_words"),
                F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))),
                                         lambda s: s["part"]), " ").alias("text")))


def taken_words(mix: Mix) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken."""
    taken = mix.spans.groupBy("doc").agg(F.sum("n").alias("taken"))
    return mix.docs.join(taken, "doc", "left").select(
        "doc_id", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
