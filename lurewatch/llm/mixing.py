"""Mixing sources to target weights, in fixed-length blocks.

1. ``targets``: how many words each source gives. Sources share a multiple of all words by weight; no target
   exceeds ``max_repeat`` times its source, and what a source cannot give goes to the others by weight.
2. ``segments``: the documents of a source, in a hashed order, are one long run of words that is packed into
   blocks of ``block`` words. A segment is the part of one document in one block.
3. ``slots``: a source owns as many slots as its target needs. The output has as many places, in shards of equal size.
   Each place draws a source with the odds of the slots, so a shard's source counts are a multinomial draw, and they
   decide which of a source's slots the shard holds. A source drawn more often than it has slots gives its last
   places to those drawn less often, so that targets are met. A slot's number goes through a pseudorandom permutation
   of the source's block numbers, one permutation per pass, so no block is taken a second time before all were taken
   once. The last slot of a source may be cut short.
4. Slots and segments join by (source, block).

Everything is a function of hashes, so reruns and retries agree. Nothing is gathered: running totals are taken
per (source, hash bucket) and then over the bucket totals, and the join key holds the block number, so a hot
source spreads over all tasks. Only the table of sources, one row each, is ordered in one task.

Edge cases: a null or empty text has size 0 and is never taken; a null source is a source, the last one; rows
repeated with the same id are documents of their own, of which any may be the one that is taken more often. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lurewatch.llm.common import barrier, ids_of, materialize, spaced, words_of

BLOCK = 64
BUCKETS = 1024
SHARDS = 64
ROUNDS = 24
SEED = 17
#: Places that one row of the plan stands for.
RUN = 16_384


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Position ``x`` of a pseudorandom permutation of 0..n-1 chosen by ``key``.

    Swap-or-not: each round pairs x with (k - x) mod n and swaps the pair when a hash of its larger member says
    so. Each round is a permutation for any n, and so are all of them together.
    """
    def step(position: Column, r: Column) -> Column:
        k = F.pmod(F.xxhash64(F.lit(SEED), *key, r), n)
        other = F.pmod(k - position, n)
        swap = F.pmod(F.xxhash64(F.lit(SEED + 1), *key, r, F.greatest(position, other)), F.lit(2)) == 1
        return F.when(swap, other).otherwise(position)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, txt (a hash of the text), source, size: words per document."""
    out = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("txt"),
                      F.col(f"`{source}`").alias("source"), spaced(F.col(f"`{text}`")).alias("_s"))
    return out.select("doc_id", "txt", "source", F.size(words_of(F.col("_s"))).cast("long").alias("size"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
            max_repeat: int = 2) -> DataFrame:
    """Add ``target`` to a table of (source, source_size).

    Sources by code point, null last, weigh ``weights``, repeating. Ordered by capacity per weight, the sources
    that are full come first; the level of the rest follows from running sums.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    df = sources.withColumn("_w", F.get(F.array(*[F.lit(float(w)) for w in weights]),
                                        F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    df = df.withColumn("_cap", F.col("source_size") * float(max_repeat)).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = W.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    df = df.withColumn("_level", level)
    # The first source, in this order, that the level does not fill fixes the level of all after it.
    found = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", F.col("_level")))).over(every)["_level"]
    return df.withColumn("target", F.least(F.col("_cap"), F.coalesce(found * F.col("_w"), F.col("_cap")))).select(
        *sources.columns, "target")


def placed(sizes: DataFrame) -> DataFrame:
    """Add ``start``: where a document's words begin in the run of its source."""
    df = sizes.withColumn("_h", F.xxhash64(F.lit(SEED), "doc_id")).withColumn("_bucket", F.pmod("_h", F.lit(BUCKETS)))
    totals = df.groupBy("source", "_bucket").agg(F.sum("size").alias("_total"))
    upto = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("source", "_bucket", F.coalesce(F.sum("_total").over(upto), F.lit(0)).alias("_offset"))
    offsets = materialize(offsets, "mix-offsets").toDF("_source", "_b", "_offset")
    inside = W.partitionBy("source", "_bucket").orderBy("_h", "doc_id", "txt", "size").rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = df.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    return joined.select("doc_id", "txt", "source", "size", (F.col("_offset") + F.col("_before")).alias("start"))


def segments(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, txt, source, start, block_no, low, high: a document's words in each block, low and high counted in the block."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    df = docs.where("size > 0").withColumn("block_no", F.explode(F.sequence(first, last)))
    base = F.col("block_no") * block
    return df.select("doc_id", "txt", "source", "start", "block_no",
                     F.greatest(F.col("start") - base, F.lit(0)).cast("long").alias("low"),
                     F.least(F.col("start") + F.col("size") - base, F.lit(block)).cast("long").alias("high"))


def _plan(sources: DataFrame, block: int) -> DataFrame:
    """One row per source that gives words: its number, its slots and how its passes are cut."""
    df = sources.where("source_size > 0").select(
        "source", F.col("source_size").alias("_size"), F.round("target").cast("long").alias("_target"))
    df = df.withColumns({"_full": F.floor(F.col("_size") / block), "_passes": F.floor(F.col("_target") / F.col("_size")),
                         "_per": F.ceil(F.col("_size") / block)})
    df = df.withColumn("_rest", F.col("_target") - F.col("_passes") * F.col("_size"))
    df = df.withColumn("_slots", F.col("_passes") * F.col("_per") + F.ceil(F.col("_rest") / block)).where("_slots > 0")
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    return df.withColumns({"_no": F.row_number().over(by_name) - 1, "_upto": F.sum("_slots").over(by_name)})


def draws(runs: DataFrame, before: Column | None = None) -> DataFrame:
    """_run, place, _no (and _before): every place of the output draws a source's number with the odds of the slots.

    ``runs`` has _run, _n (places in all) and _upto (running sums of the sources' slots).
    """
    places = F.sequence(F.col("_run") * RUN, F.least(F.col("_n"), (F.col("_run") + 1) * RUN) - 1)
    drawn = F.transform(places, lambda g: F.struct(g.alias("place"), F.size(F.filter(
        "_upto", lambda u: u <= F.pmod(F.xxhash64(F.lit(SEED + 2), g), F.col("_n")))).alias("_no")))
    if before is not None:
        drawn = F.transform(drawn, lambda x: F.struct(x["place"].alias("place"), x["_no"].alias("_no"), before[x["_no"]].alias("_before")))
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(parts, "_run").select("_run", F.inline(drawn))


def slots(sources: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """source, slot, pass_no, block_no, words, shard, place: what the mix takes, one row per output place.

    ``sources`` has source, source_size and target. Places are cut into shards of equal size and into runs, so that
    many tasks draw. The n-th place that drew a source holds its slot n; places beyond the source's slots go, in
    order, to the slots of the sources drawn too seldom.
    """
    plan = materialize(_plan(sources, block), "mix-plan")
    every = plan.agg(F.max("_upto").alias("_n"), F.sort_array(F.collect_list("_upto")).alias("_upto")).where("_n > 0")
    runs = every.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN))))
    counts = materialize(draws(runs).groupBy("_run", "_no").agg(F.count(F.lit(1)).alias("_count")), "mix-draws")
    earlier = W.partitionBy("_no").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    begun = counts.withColumn("_before", F.coalesce(F.sum("_count").over(earlier), F.lit(0)))
    # Stored, since the planner would take the few rows of this aggregation, which are to be drawn out, in one task.
    begun = materialize(begun.groupBy("_run").agg(F.map_from_entries(F.collect_list(F.struct("_no", "_before"))).alias("_begun")), "mix-begun")
    drawn = counts.groupBy("_no").agg(F.sum("_count").alias("_drawn"))
    lower = W.orderBy("_no").rowsBetween(W.unboundedPreceding, -1)
    fix = plan.join(drawn, "_no", "left").withColumn("_drawn", F.coalesce("_drawn", F.lit(0)))
    fix = fix.withColumns({"_over": F.greatest(F.col("_drawn") - F.col("_slots"), F.lit(0)),
                           "_under": F.greatest(F.col("_slots") - F.col("_drawn"), F.lit(0))})
    fix = materialize(fix.withColumns({x: F.coalesce(F.sum(c).over(lower), F.lit(0)) for x, c in (("_over0", "_over"), ("_under0", "_under"))}), "mix-counts")
    holes = fix.where("_under > 0").agg(F.sort_array(F.collect_list(F.struct(
        (F.col("_under0") + F.col("_under")).alias("upto"), F.col("_no").alias("no"),
        (F.col("_drawn") - F.col("_under0")).alias("base"))))).scalar()
    fix = materialize(fix.select("_no", "_slots", "_over0", F.when(F.col("_over") > 0, holes).alias("_holes")), "mix-fix")

    rank = F.row_number().over(W.partitionBy("_run", "_no").orderBy("place")) - 1 + F.col("_before")
    df = draws(begun.withColumns({"_n": every.select("_n").scalar(), "_upto": every.select("_upto").scalar()}), F.col("_begun"))
    df = df.withColumn("_rank", rank).join(fix, "_no").withColumn(
        "_at", F.when(F.col("_rank") >= F.col("_slots"), F.col("_over0") + F.col("_rank") - F.col("_slots")))
    hole = F.when(F.col("_at").isNotNull(), F.get(F.filter("_holes", lambda h: h["upto"] > F.col("_at")), 0))
    df = barrier(df.withColumn("_hole", hole).drop("_holes"), _hole=F.col("_hole")).select(
        "place", F.coalesce("_hole.no", "_no").alias("_no"), F.coalesce(F.col("_hole.base") + F.col("_at"), "_rank").alias("slot"))
    df = df.join(plan, "_no")
    df = barrier(df, slot=F.col("slot"), pass_no=F.floor(F.col("slot") / F.col("_per")), _k=F.pmod("slot", "_per"))
    # Full blocks are permuted; the short block at the end of a source keeps the last place of a pass.
    block_no = F.when(F.col("_k") >= F.col("_full"), F.col("_full")).otherwise(
        permuted(F.col("_k"), F.col("_full"), F.col("source"), F.col("pass_no")))
    whole = F.least(F.lit(block), F.col("_size") - F.col("_k") * block)
    left = F.when(F.col("pass_no") < F.col("_passes"), whole).otherwise(F.least(whole, F.col("_rest") - F.col("_k") * block))
    n = every.select("_n").scalar()
    shard = F.floor(F.col("place") * shards / n)
    return df.select("source", "slot", "pass_no", block_no.alias("block_no"), left.cast("long").alias("words"),
                     shard.cast("int").alias("shard"), "place")


def shard_counts(slot_table: DataFrame) -> DataFrame:
    """shard, source, slots, words: the multinomial draw of each output shard."""
    return slot_table.groupBy("shard", "source").agg(F.count(F.lit(1)).alias("slots"), F.sum("words").alias("words"))


class Mix:
    """The tables of one mix: ``sources``, ``docs`` (placed in their source), ``slots`` and ``pieces``.

    ``sizes`` is a table as ``sized`` gives it.
    """

    def __init__(self, sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_repeat: int = 2,
                 block: int = BLOCK, shards: int = SHARDS):
        sizes = materialize(sizes, "mix-sizes")
        self.sources = materialize(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")),
                                           weights, share, max_repeat), "mix-sources")
        self.docs = materialize(placed(sizes), "mix-documents")
        self.slots = slots(self.sources, block, shards)
        cut = segments(self.docs, block)
        picks = self.slots.select(F.col("source").alias("_source"), F.col("block_no").alias("_no"), "shard", "place", "slot", "pass_no", "words")
        # The slots come out of a short table of runs, so the planner takes them for small; they are not.
        joined = cut.join(picks.hint("merge"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("block_no") == F.col("_no")))
        base = F.col("block_no") * block - F.col("start")
        #: Which words of which document a slot holds: doc_id, txt, source, start (of the document in its source),
        #: shard, place, slot, pass_no, from_word, to_word.
        self.pieces = joined.where("low < words").select(
            "doc_id", "txt", "source", "start", "shard", "place", "slot", "pass_no", (base + F.col("low")).alias("from_word"),
            (base + F.least("high", "words")).alias("to_word"))

    def taken(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken, n_pieces, first_shard, first_place: one row per document. The
        first place is null where nothing is taken."""
        counts = self.pieces.groupBy("source", "start").agg(
            F.sum(F.col("to_word") - F.col("from_word")), F.count(F.lit(1)), F.min("shard"), F.min("place"))
        counts = counts.toDF("_source", "_start", "_taken", "_pieces", "first_shard", "first_place")
        per_source = self.sources.toDF("_name", "source_size", "target")
        with_source = self.docs.join(per_source, F.col("source").eqNullSafe(F.col("_name")))
        same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0)
        return with_source.join(counts, same, "left").select(
            "doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"),
            F.coalesce("_pieces", F.lit(0)).alias("n_pieces"), "first_shard", "first_place")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_repeat: int = 2,
                    doc_id: str = "doc_id", text: str = "text", source: str = "source", length: str = "n_chars") -> DataFrame:
    """The documents as the mix takes them, with the columns of ``docs``: one row per document and pass.

    A document that a pass takes whole keeps its text; of one that it takes in part, the taken words remain, joined
    by spaces. ``length``, if ``docs`` has it, is the new text's length. Rows repeated with the same id, source
    and text count as one document here; documents without words are never taken.
    """
    sizes = sized(docs, doc_id, text, source).distinct()
    mix = Mix(sizes, weights, share, max_repeat)
    spans = mix.pieces.groupBy("source", "doc_id", "txt", "pass_no").agg(
        F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("_spans"),
        F.sum(F.col("to_word") - F.col("from_word")).alias("_n"))
    spans = materialize(spans.select(ids_of("doc_id").alias("_id"), F.col("txt").alias("_txt"), F.col("source").alias("_source"),
                                     "pass_no", "_spans", "_n"), "mix-spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), ids_of(f"`{doc_id}`").alias("_id"),
                       F.xxhash64(f"`{text}`").alias("_txt"), F.col(f"`{source}`").alias("_src"))
    one = F.row_number().over(W.partitionBy("_id", "_txt", "_src", "pass_no").orderBy("_n"))
    rows = rows.join(spans.withColumnsRenamed({"_id": "_id2", "_txt": "_txt2"}), (F.col("_id") == F.col("_id2")) & (
        F.col("_txt") == F.col("_txt2")) & F.col("_src").eqNullSafe(F.col("_source"))).withColumn("_copy", one).where("_copy = 1")
    rows = barrier(rows.select("_row", "_spans", "_n"), _w=words_of(spaced(F.col("_row")[text])))
    part = F.array_join(F.flatten(F.transform("_spans", lambda r: F.slice(
        "_w", (r["from_word"] + 1).cast("int"), (r["to_word"] - r["from_word"]).cast("int")))), " ")
    rows = rows.withColumn("_new", F.when(F.col("_n") == F.size("_w"), F.col("_row")[text]).otherwise(part))
    new = {text: F.col("_new"), length: F.length("_new").cast(docs.schema[length].dataType) if length in docs.columns else None}
    return rows.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])
