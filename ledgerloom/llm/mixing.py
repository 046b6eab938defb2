"""Mixing sources to target weights by Sainte-Lague apportionment of words, taken in long runs.

Only DataFrame functions. Text is read once for its sizes. Sources get integer numbers of words by highest quotients
(weight / (2k - 1)); the words of a source are apportioned the same way to its shards, which are hash groups of about
rows_per_shard documents, so a source with a third of all rows is spread over many shards. In each shard the documents lie
end to end in seeded order; they are taken whole as often as the quota allows, and the rest is a systematic pick of runs, one
at the head of each of equal segments, from a seeded start. The runs of a source are as long as its own block, and together hold
the rest to the word. A document's taken words follow in closed form from its position, so no run is ever a row.

Only candidate quotients that can win or lose are ranked: with n rivals, seats stay within n/2 of the proportional share, so
about 3n rows are compared. Sources are one row each in the global ranking (their number is the only thing that task holds). The
shards of a source are dealt to in a tree of bounded fan-out, so the ranking of a source with a third of all rows is spread too.

Defined results: null text has size 0 and nothing is taken of it; a null source is a source of its own, last in order; rows
that repeat a doc_id, or have none, count each and go to shards by their texts too; equal rows lie side by side in one; ties of
quotients go to the lower shard and source; very long texts are only counted, and cut once; an empty table gives no rows; extra
columns, whatever their names, are ignored by mix and kept by mixed_documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import rows
from ledgerloom.llm.scratch import written

WEIGHTS = (3.0, 1.0, 2.0)
MIN_BLOCK = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, n_rows, target): share of all words dealt out by weight, no target above limit times its source.

    Sources in order of limit/weight fill up first, so those above the water level are a suffix of that order.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = per.withColumn("rank", rank).withColumn("weight", cycle).withColumn("cap", F.col("source_size") * F.lit(limit))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", left / weight_left)
    # The level of the first source that isn't full holds for it and all after it.
    first_open = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)
    open_level = first_open["level"]
    target = F.when(open_level.isNull(), F.col("cap")).otherwise(F.least("cap", open_level * F.col("weight")))
    return level.withColumn("target", target).select("source", "source_size", "n_rows", "target")


def apportion(parties: DataFrame, keys: list[str], within: list[str], weight: str, seats: str, most: str, order: list[Column]) -> DataFrame:
    """parties with column quota: the seats of each group of within, dealt to its keys by highest quotients, none over most."""
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    n, total = F.count("*").over(group), F.sum(weight).over(group)
    share = F.col(weight) / F.col("__total")
    low = F.floor(share * (F.col(seats) - F.col("__n") / 2) - 1.5)
    high = F.ceil(share * (F.col(seats) + F.col("__n") / 2) + 1.5)
    bounded = (
        parties.withColumn("__n", n)
        .withColumn("__total", total)
        .withColumn("__low", F.when(F.col("__total") > 0, F.least(F.greatest(low, F.lit(0)), F.col(most))).otherwise(F.lit(0)))
        .withColumn("__high", F.when(F.col("__total") > 0, F.least(F.greatest(high, F.lit(0)), F.col(most))).otherwise(F.lit(0)))
        .withColumn("__open", F.col(seats) - F.sum("__low").over(group))
    )
    rivals = bounded.select("*", F.explode_outer(F.when(F.col("__high") > F.col("__low"), F.sequence(F.col("__low") + 1, F.col("__high")))).alias("__k"))
    by_quotient = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy(
        (F.col(weight) / (2 * F.col("__k") - 1)).desc_nulls_last(), *order
    )
    won = (F.col("__k").isNotNull() & (F.row_number().over(by_quotient) <= F.col("__open"))).cast("long")
    carried = [c for c in parties.columns if c not in keys]
    summed = rivals.withColumn("__won", won).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carried], (F.first("__low") + F.sum("__won")).alias("quota")
    )
    return summed


def _floor_div(a: Column, b: Column) -> Column:
    """Whole-number division; b may be 0 where a is."""
    return F.floor(a / F.greatest(b, F.lit(1)))


_FAN_OUT = 1024


def plan_mix(sizes: DataFrame, seed: int, share: float, limit: float, max_block: int, rows_per_shard: int) -> tuple[DataFrame, DataFrame]:
    """The sources (source, source_size, target, block, shards) and the shards' quotas, as written tables.

    A source's block is 1/256 of its own target, from MIN_BLOCK to max_block words; quotas are words, so no source is short by a cut block.
    """
    targets = source_targets(sizes, share, limit)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    block = F.least(F.lit(max_block), F.greatest(F.lit(MIN_BLOCK), F.floor(F.coalesce("target", F.lit(0.0)) / 256))).cast("long")
    blocked = (
        targets.withColumn("block", block)
        .withColumn("seats", F.round(F.sum("target").over(everything)).cast("long"))
        .withColumn("most", F.ceil(F.col("source_size") * F.lit(limit)))
        .withColumn("shards", F.ceil(F.col("n_rows") / rows_per_shard))
    )
    sources = written(apportion(blocked, ["source"], [], "target", "seats", "most", [F.col("source").asc_nulls_last()]), "sources")
    placed = _in_shards(sizes, sources, seed)
    cells = placed.groupBy("source", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.first("block").alias("block"))
    cells = written(cells.withColumn("most", F.ceil(F.col("words") * F.lit(limit))), "shard-words")
    quotas = shard_quotas(cells, sources.select("source", F.col("quota").alias("seats"), "shards"))
    offset = F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.greatest("words", F.lit(1)))
    rest = F.pmod("quota", F.greatest("words", F.lit(1)))
    runs = F.greatest(F.lit(1), F.least(_floor_div(F.col("rest"), F.col("block")), F.col("words") - F.col("rest")))
    cut = quotas.withColumn("rest", rest).withColumn("runs", runs).withColumn("offset", offset)
    return sources, written(cut.select(F.xxhash64("source").alias("skey"), "shard", "quota", F.col("words").alias("shard_words"), "rest", "runs", "offset"), "quotas")


def shard_quotas(cells: DataFrame, sources: DataFrame, fan_out: int = _FAN_OUT) -> DataFrame:
    """cells (source, shard, words, most, block) with quota: each source's seats dealt down a tree of shards, by highest quotients at each node.

    A node has at most fan_out children, so no group that is ranked grows with a source. Sources of up to fan_out shards are one node.
    """
    largest, height = sources.agg(F.max("shards")).first()[0] or 1, 1
    while fan_out**height < largest:
        height += 1
    seats = sources.select("source", F.lit(0).cast("long").alias("parent"), "seats")
    for level in range(height - 1, -1, -1):
        child, parent = F.floor(F.col("shard") / fan_out**level), F.floor(F.col("shard") / fan_out ** (level + 1))
        summed = cells.groupBy("source", child.alias("child"), parent.alias("parent"))
        nodes = summed.agg(F.sum("words").alias("words"), F.sum("most").alias("most"), F.first("block").alias("block"))
        s = seats.select(F.col("source").alias("s_source"), F.col("parent").alias("s_parent"), "seats")
        met = nodes.join(s, nodes.source.eqNullSafe(s.s_source) & (nodes.parent == s.s_parent)).drop("s_source", "s_parent")
        dealt = written(apportion(met, ["source", "child"], ["source", "parent"], "words", "seats", "most", [F.col("child")]), "dealt")
        seats = dealt.select("source", F.col("child").alias("parent"), F.col("quota").alias("seats"))
    return dealt.select("source", F.col("child").alias("shard"), "words", "block", "quota")


def _in_shards(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    s = sources.select(F.col("source").alias("s_source"), "source_size", "target", "block", "shards")
    placed = sized.join(s, sized.source.eqNullSafe(s.s_source)).drop("s_source")
    return placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), *rows.KEY), F.col("shards")))


def _segment(word: Column) -> Column:
    """The segment of a shard that holds a word; segment k starts at word k * shard_words / runs, rounded down."""
    return _floor_div((word + 1) * F.col("runs") - 1, F.col("shard_words"))


def _run(segment: Column) -> tuple[Column, Column]:
    """The first word of a segment's run and the one after its last. A run never outgrows its segment, as runs <= shard_words - rest."""
    first = _floor_div(segment * F.col("shard_words"), F.col("runs"))
    return first, first + _floor_div((segment + 1) * F.col("rest"), F.col("runs")) - _floor_div(segment * F.col("rest"), F.col("runs"))


def _covered(word: Column) -> Column:
    """How many of the words before this one, counted from the seeded start, lie in runs."""
    segment = _segment(word)
    first, end = _run(segment)
    return _floor_div(segment * F.col("rest"), F.col("runs")) + F.least(word, end) - first


def lay_out(sizes: DataFrame, sources: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """sizes with first_start, the place of the first of its n rows in its shard, and what _taken needs of the shard."""
    line = Window.partitionBy("skey", "shard").orderBy(F.xxhash64(F.lit(seed + 1), *rows.KEY), *rows.KEY).rowsBetween(Window.unboundedPreceding, 0)
    placed = _in_shards(sizes, sources, seed).withColumn("skey", F.xxhash64("source"))
    own = F.col("size") * F.col("n")
    laid = placed.withColumn("first_start", F.sum(own).over(line) - own).join(quotas, ["skey", "shard"])
    return laid.withColumn("rounds", _floor_div(F.col("quota"), F.col("shard_words")))


def _taken(copies: DataFrame) -> DataFrame:
    """Rows with a copy each, and start, end and extra (words taken once more than rounds)."""
    placed = copies.withColumn("start", F.col("first_start") + F.col("copy") * F.col("size")).withColumn("end", F.col("start") + F.col("size"))
    return placed.withColumn("extra", _covered(F.col("end") + F.col("offset")) - _covered(F.col("start") + F.col("offset")))


def _sizes(docs: DataFrame) -> DataFrame:
    """(key, doc_id, source, size, n) of the documents."""
    return rows.narrow(docs, {"size": word_count(F.col("text"))}, "sizes")


def mix(docs: DataFrame, seed: int = 17, share: float = 1.5, limit: float = 2.0, max_block: int = 1024, rows_per_shard: int = 512) -> DataFrame:
    """(doc_id, source, size, source_size, target, shard, quota, block, start, taken) for every document."""
    sizes = _sizes(docs)
    sources, quotas = plan_mix(sizes, seed, share, limit, max_block, rows_per_shard)
    taken = (F.col("size") * F.col("rounds") + F.col("extra")).cast("long").alias("taken")
    laid = _taken(rows.copies(lay_out(sizes, sources, quotas, seed)))
    return laid.select("doc_id", "source", "size", "source_size", "target", "shard", "quota", "block", "start", taken)


def mixed_documents(docs: DataFrame, seed: int = 17, share: float = 1.5, limit: float = 2.0, max_block: int = 1024, rows_per_shard: int = 512) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each whole taking of a document, and one with the words of its runs.

    A cut text starts at a word, keeps the white space inside and none at its end; n_chars, if there, follows the text. Texts are moved
    once, to meet what the mix takes of them.
    """
    sizes = _sizes(docs)
    sources, quotas = plan_mix(sizes, seed, share, limit, max_block, rows_per_shard)
    needed = ["n", "size", "first_start", "rounds", "offset", "shard_words", "runs", "rest"]
    plan = lay_out(sizes, sources, quotas, seed).filter("quota > 0 AND size > 0").select(*rows.KEY, *needed)
    met = _taken(rows.whole(docs, plan)).filter("rounds > 0 OR extra > 0")
    text = F.col("row")["text"]
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    segments = F.sequence(_segment(F.col("start") + F.col("offset")), _segment(F.col("end") + F.col("offset") - 1))

    def span(segment: Column) -> Column:
        first, end = _run(segment)
        low = F.greatest(first - F.col("offset"), F.col("start"))
        high = F.least(end - F.col("offset"), F.col("end"))
        return F.struct((low - F.col("start") + 1).cast("int").alias("at"), (high - low).cast("int").alias("many"))

    chosen = F.filter(F.transform(segments, span), lambda s: s["many"] > 0)

    def words_of(s: Column) -> Column:
        return F.slice("words", s["at"], s["many"])

    cut = F.rtrim(F.array_join(F.flatten(F.transform("chosen", words_of)), ""))
    part = F.when(F.col("extra") == F.col("size"), text).when(F.col("extra") > 0, cut)
    texts = F.filter(F.concat(F.array_repeat(text, F.col("rounds").cast("int")), F.array(part)), lambda t: t.isNotNull())
    some = met.withColumn("words", F.when((F.col("extra") > 0) & (F.col("extra") < F.col("size")), words)).withColumn("chosen", chosen)
    exploded = some.select("row", F.explode(texts).alias("taken_text"))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("taken_text").alias(name)
        if name == "n_chars":
            return F.length("taken_text").cast(docs.schema[name].dataType).alias(name)
        return F.col("row")[name].alias(name)

    return exploded.select(*[column(c) for c in docs.columns])
