"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, op10.

DataFrame and SQL functions only.

* Targets: sources in code-point order (null last) weigh ``weights`` in turn and share all words; a
  target stops at ``cap`` times its source's size and the excess goes to the others by weight. That
  is water-filling: target = least(cap * size, level * weight) with one level for all. The level rises from
  the fair share to its final value in a few sums over all sources; no window holds all of them.
* Blocks: a text is cut into blocks of ``block_words`` words (None: whole texts). Every source has
  a permutation of its blocks, by a keyed hash of the row's values. A source is read in whole epochs and one part of an
  epoch, whose prefix of the permutation comes within half a block of the target. Ranks and running
  sums come from three levels, runs of hash ranges, hash ranges and places inside a range, so no source meets in one task.
* Tree: the exact block quotas of all sources are split in two halves again and again, each split
  drawn from the multivariate hypergeometric distribution, down to output shards. A node's draw goes to groups of
  sources first and to the sources of a group then, so no row holds more than about the square root of their number.
* Shards: what a shard drew of a source is a range of the source's sequence, so shards are disjoint; ranges
  are rows, and a block meets its shard in an equi-join on stretches of the sequence.
* In a shard, blocks are ordered by another keyed hash. ``taken`` is the sum of what the shards hold.

Nulls: a null text has no words and is never taken; null sources are one source of their own. Empty
texts likewise. A very long text is so many blocks. Null or repeated doc_ids are rows like any other, told apart
by their texts. Repeated rows count as rows. An empty table gives an empty result. Other columns are ignored. All
choices hang on the seed and the rows' values alone, so reruns agree, however the rows lie; exact repeats are
interchangeable, and so are two texts of one doc_id and source whose two 64-bit hashes both agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, hub_join, read

_FACTORIAL = "array(" + ",".join(f"{math.lgamma(k + 1)!r}D" for k in range(17)) + ")"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(scratch: Scratch, sizes: DataFrame, weights: tuple[int, ...], cap: float, **sums: Column) -> tuple[DataFrame, DataFrame, float]:
    """source, source_size, source_rank, weight, target of ``sizes(source, size)``, and other sums of a source; the stored table under it; the sum of targets."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), *[F.sum(c).alias(k) for k, c in sums.items()])
    # rank: place in a range of the sorted sources, and how many are in the ranges before; as many rows as ranges
    sorted_ = scratch.save(by_source.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "sources")
    part = F.shiftrightunsigned("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sorted_.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_c")).select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"))
    w = sorted_.withColumn("_part", part).join(F.broadcast(ranges), "_part")
    w = w.withColumn("source_rank", (F.col("_c0") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("source_rank") - 1, F.lit(len(weights))).cast("int") + 1)
    w = scratch.save(w.select("source", *sums, "source_size", "source_rank", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most")), "ranked")
    total = w.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # a source that is full stays full as the level rises; each round fills one more at least
        capped = F.col("most") < level * F.col("weight")
        held, open_, now = w.agg(F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, 1))).first()
        if now == full or not open_:
            break
        level, full = (total - (held or 0.0)) / open_, now
    goal = w.select("source", *sums, "source_size", "source_rank", "weight", F.least("most", F.lit(level) * F.col("weight")).alias("target"))
    return goal, w, (held or 0.0) + level * (open_ or 0.0)


# ---------------------------------------------------------------- hypergeometric draws in SQL


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _log_factorial(x: str) -> str:
    big = f"(({x}) + 0.5D) * ln(({x}) * 1D) - ({x}) + 0.9189385332046727D + 1D / (12D * ({x})) - 1D / (360D * pow({x}, 3))"
    return f"if(({x}) <= 16, element_at({_FACTORIAL}, cast({x} as int) + 1), {big})"


def hypergeometric(good: str, bad: str, sample: str, key: str) -> str:
    """SQL for one draw: how many of ``sample`` drawn of ``good + bad`` are good.

    Ratio of uniforms (Stadlober's HRUA), or one by one for ten or fewer; ``key`` seeds the uniforms.
    """

    def uniform(*more: str) -> str:
        return f"((shiftrightunsigned(xxhash64({', '.join((key, *more))}), 11) + 0.5D) / 9007199254740992D)"

    one_by_one = f"aggregate(sequence(1L, p.n), 0L, (k, t) -> k + if({uniform('t')} * (p.lo + p.hi - t + 1) < p.lo - k, 1L, 0L))"
    weight = lambda k: " + ".join(_log_factorial(x) for x in (k, f"p.lo - {k}", f"p.n - {k}", f"p.hi - p.n + {k}"))
    top = "cast(floor((p.n + 1D) * (p.lo + 1D) / (p.lo + p.hi + 2D)) as bigint)"
    var = "((p.lo + p.hi - p.n) * 1D * p.n * p.lo / (p.lo + p.hi) * p.hi / (p.lo + p.hi) / greatest(1L, p.lo + p.hi - 1))"
    shape = f"named_struct('a', p.n * 1D * p.lo / (p.lo + p.hi) + 0.5D, 'c', sqrt({var} + 0.5D), 'g', {weight(top)})"
    x = f"(q.a + (1.7155277699214135D * q.c + 0.8989161620588988D) * ({uniform('t', '1')} - 0.5D) / {uniform('t', '2')})"
    fits = _let("z", f"cast(floor({x}) as bigint)", f"if(z >= 0 and z < least(least(p.n, p.lo) + 1, floor(q.a + 16D * q.c)) and 2D * ln({uniform('t', '2')}) <= q.g - ({weight('z')}), z, -1L)")
    tries = f"aggregate(sequence(0, 63), -1L, (k, t) -> if(k >= 0, k, {fits}))"  # all 64 fail about once in 10^30 draws
    drawn = f"if(p.n <= 10, {one_by_one}, {_let('q', shape, _let('r', tries, f'if(r >= 0, r, {one_by_one})'))})"
    back = _let("k", drawn, _let("j", f"if(({good}) > ({bad}), p.n - k, k)", f"if(p.n < ({sample}), ({good}) - j, j)"))
    params = f"named_struct('lo', least({good}, {bad}), 'hi', greatest({good}, {bad}), 'n', least({sample}, ({good}) + ({bad}) - ({sample})))"
    return f"case when ({good}) = 0 or ({sample}) = 0 then 0L when ({bad}) = 0 then ({sample}) when ({sample}) = ({good}) + ({bad}) then ({good}) else {_let('p', params, back)} end"


def _draws(q: str, n: str, who: str, key: str) -> str:
    """SQL for an array of draws, ``n`` in all, from an array ``q`` of structs with a quota, one after another; ``who`` names a struct."""
    draw = hypergeometric("x.quota", "s.pop - x.quota", "s.n", f"{key}, x.{who}")
    start = f"named_struct('left', cast(array() as array<bigint>), 'pop', aggregate({q}, 0L, (a, x) -> a + x.quota), 'n', {n})"
    step = f"(s, x) -> {_let('k', draw, 'named_struct(' + repr('left') + ', concat(s.left, array(k)), ' + repr('pop') + ', s.pop - x.quota, ' + repr('n') + ', s.n - k)')}"
    return f"aggregate({q}, {start}, {step}).left"


def _halves(level: DataFrame, seed: int, along: list[str]) -> DataFrame:
    """The children of nodes whose left ones draw ``n`` of a group's blocks."""
    more = "".join(f", '{c}', x.{c}" for c in along)
    split = level.withColumn("left", F.expr(_draws("q", "n", "source_rank", f"{seed}L, node")))
    left = f"named_struct('node', 2 * node, 'q', transform(q, (x, i) -> named_struct('source_rank', x.source_rank, 'quota', left[i]{more})))"
    right = f"named_struct('node', 2 * node + 1, 'q', transform(q, (x, i) -> named_struct('source_rank', x.source_rank, 'quota', x.quota - left[i]{more})))"
    both = split.select("grp", F.inline(F.expr(f"array({left}, {right})")))
    return both.select("node", "grp", F.expr("filter(q, x -> x.quota > 0)").alias("q")).where("size(q) > 0")


def splitting_tree(scratch: Scratch, quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """shard, source_rank, quota: what each of the 2 ** depth shards draws of ``quotas(source_rank, quota, ...)``; other columns of a source go along.

    Every node of the tree gives half of its blocks (the odd one to the right) to its left child.
    """
    sources = quotas.agg(F.max("source_rank")).first()[0] or 0
    width = max(64, math.isqrt(sources))
    along = [c for c in quotas.columns if c not in ("source_rank", "quota")]
    pack = F.array_sort(F.collect_list(F.struct("source_rank", "quota", *along))).alias("q")
    level = quotas.withColumns({"node": F.lit(1).cast("long"), "grp": F.floor(F.col("source_rank") / width)}).groupBy("node", "grp").agg(pack)
    total = "aggregate(q, 0L, (a, x) -> a + x.quota)"
    for d in range(depth):
        level = scratch.save(level, f"tree{d}")
        if sources < width:  # one group, which draws all
            level = _halves(level.withColumn("n", F.expr(f"cast(floor({total} / 2) as bigint)")), seed, along)
            continue
        groups = level.select("node", F.struct("grp", F.expr(total).alias("quota")).alias("g")).groupBy("node").agg(F.array_sort(F.collect_list("g")).alias("gs"))
        n = "cast(floor(aggregate(gs, 0L, (a, x) -> a + x.quota) / 2) as bigint)"
        share = groups.withColumn("left", F.expr(_draws("gs", n, "grp", f"{seed}L, 'groups', node")))
        share = share.select("node", F.inline(F.expr("transform(gs, (x, i) -> named_struct('grp', x.grp, 'n', left[i]))")))
        level = _halves(level.join(share, ["node", "grp"]), seed, along)
    return level.select((F.col("node") - (1 << depth)).alias("shard"), F.inline("q")).where("quota > 0")


# ---------------------------------------------------------------- the operator


def draw(sized: DataFrame, scratch: Scratch, keep: DataFrame | None = None, *, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3, block_words: int | None = 256, shard_words: int = 1 << 22, seed: int = 10, run: int = 256) -> tuple[DataFrame, DataFrame]:
    """Blocks drawn, and the sources with targets, of ``sized(row, doc_id, source, size, content)``; ``keep``: a table of the scratch folder that stays.

    A block drawn: row, block (its place in the text), words, epoch, shard, order_key. content: two hashes of the text.
    """
    width = F.lit(block_words) if block_words else F.greatest(F.col("size"), F.lit(1))
    goal, stored, total = targets(scratch, sized, weights, cap, n=F.ceil(F.col("size") / width))
    goal = goal.withColumn("key", _key("source"))
    depth = max(0, math.ceil(math.log2(max(1, total / shard_words))))
    sourced = hub_join(sized.select("row", "doc_id", "content", "size", _key("source").alias("key")), "key", goal.drop("source"))
    block = sourced.where("size > 0").select("row", "doc_id", "content", "size", "source_rank", "source_size", "target", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / width).cast("int") - 1)).alias("block"))
    values = [F.lit(seed), F.col("source_rank"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("content"), F.col("block")]
    block = block.withColumn("words", F.least(width.cast("long"), F.col("size") - F.col("block") * width)).withColumn("p", F.xxhash64(*values))
    block = scratch.save(block, "blocks")
    ranges = F.ceil(F.col("n") / run)
    part = F.least(F.floor((F.col("p") / F.lit(2.0**64) + 0.5) * ranges), ranges - 1)
    placed = block.withColumn("part", part).withColumn("far", F.floor(F.col("part") / F.lit(run)))
    first = Window.unboundedPreceding
    sums = scratch.save(placed.groupBy("source_rank", "far", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("words").alias("w")), "ranges")
    runs = sums.groupBy("source_rank", "far").agg(F.sum("c").alias("c"), F.sum("w").alias("w"))
    before = Window.partitionBy("source_rank").orderBy("far").rowsBetween(first, -1)
    runs = runs.select("source_rank", "far", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c1"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w1"))
    before = Window.partitionBy("source_rank", "far").orderBy("part").rowsBetween(first, -1)
    sums = sums.select("source_rank", "far", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    sums = scratch.save(sums.join(runs, ["source_rank", "far"]).select("source_rank", "part", (F.col("c0") + F.col("c1")).alias("c0"), (F.col("w0") + F.col("w1")).alias("w0")), "prefix")
    inside = Window.partitionBy("source_rank", "part").orderBy("p", F.col("doc_id").isNull(), "doc_id", "content", "block", "row")
    ranked = placed.withColumns({"r": F.row_number().over(inside) - 1, "w": F.sum("words").over(inside.rowsBetween(first, Window.currentRow)) - F.col("words")})
    ranked = ranked.join(sums, ["source_rank", "part"]).withColumns({"r": F.col("r") + F.col("c0"), "w": F.col("w") + F.col("w0")})
    whole = F.floor(F.col("target") / F.col("source_size") + 1e-9).cast("int")
    rest = F.col("target") - whole * F.col("source_size")
    last = F.when(F.col("w") + F.col("words") / 2 <= rest, 1).otherwise(0)
    # about as many blocks as a shard draws of the source: stretches and shards' ranges overlap by twos
    length = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("target") / F.col("source_size") / F.lit(2**depth))).cast("long")
    drawn = ranked.withColumns({"whole": whole, "length": length}).withColumn("epochs", F.col("whole") + last).where("epochs > 0")
    drawn = drawn.select("row", "doc_id", "content", "block", "words", "source_rank", "n", "r", "whole", "length", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"))
    shift = F.when(F.col("epoch") < F.col("whole"), F.xxhash64(F.lit(seed), "source_rank", "epoch")).otherwise(0)
    place = F.col("epoch") * F.col("n") + F.when(F.col("epoch") < F.col("whole"), F.pmod(F.col("r") + shift, F.col("n"))).otherwise(F.col("r"))
    key = F.xxhash64(F.lit(seed), F.lit("order"), F.col("doc_id").isNull(), "doc_id", "content", "block", "epoch")
    drawn = scratch.save(drawn.select("row", "block", "words", "source_rank", "epoch", key.alias("order_key"), place.alias("at"), "length", F.floor(place / F.col("length")).alias("stretch")), "drawn")

    quotas = scratch.save(drawn.groupBy("source_rank").agg(F.count(F.lit(1)).alias("quota"), F.max("length").alias("length")), "quotas")
    tree = scratch.save(splitting_tree(scratch, quotas, depth, seed), "tree")
    # a shard's range of a source begins where the shards before it end; shards in runs, as parts above
    tree = tree.withColumn("far", F.floor(F.col("shard") / F.lit(run)))
    runs = tree.groupBy("source_rank", "far").agg(F.sum("quota").alias("c"))
    before = Window.partitionBy("source_rank").orderBy("far").rowsBetween(first, -1)
    runs = runs.select("source_rank", "far", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c1"))
    before = Window.partitionBy("source_rank", "far").orderBy("shard").rowsBetween(first, -1)
    own = tree.withColumn("c0", F.coalesce(F.sum("quota").over(before), F.lit(0))).join(runs, ["source_rank", "far"])
    own = own.select("source_rank", "shard", "length", (F.col("c0") + F.col("c1")).alias("begin"), (F.col("c0") + F.col("c1") + F.col("quota")).alias("end"))
    own = own.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("begin") / F.col("length")), F.floor((F.col("end") - 1) / F.col("length"))))).drop("length")
    own = scratch.save(own, "shards-of-sources")
    scratch.drop_but(keep, stored, drawn, own)
    out = drawn.join(own, ["source_rank", "stretch"]).where("at >= begin and at < end")
    return out.select("row", "block", "words", "epoch", "shard", "order_key"), goal


def _dealt(blocks: DataFrame) -> DataFrame:
    """Shard after shard, shuffled inside a shard."""
    return blocks.repartition("shard", F.pmod("order_key", F.lit(16))).sortWithinPartitions("shard", "order_key")


def _key(source: str) -> Column:
    """A source as a key of joins, null and all."""
    return F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source), F.lit("")).alias("name"))


def _content(text: str) -> Column:
    """Two hashes of a text, which tell texts of one doc_id apart."""
    return F.struct(F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text)))


def mix(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """Per row of ``docs(doc_id, text, source)``: doc_id, size, source_size, target, taken, which is counted in the shards as written, and in how many shards (``n_shards``), from which on (``first_shard``)."""
    sized = scratch.save(docs.select("doc_id", "source", word_count("text").alias("size"), _content("text").alias("content")).withColumn("row", F.monotonically_increasing_id()), "sizes")
    drawn, goal = draw(sized, scratch, sized, **options)
    shards = scratch.save(_dealt(drawn), "shards")
    held = shards.groupBy("row", "shard").agg(F.sum("words").alias("words")).groupBy("row").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("n_shards"), F.min("shard").alias("first_shard"))
    out = hub_join(sized.withColumn("key", _key("source")), "key", goal.drop("source")).join(held, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_shards", F.lit(0)).alias("n_shards"), "first_shard")


def mixed_rows(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, whole and as often as it takes them, shard after shard, shuffled inside a shard."""
    kept = scratch.save(docs.select(F.struct("*").alias("doc"), "doc_id", "source", word_count("text").alias("size"), _content("text").alias("content")).withColumn("row", F.monotonically_increasing_id()), "rows")
    drawn, _ = draw(kept.select("row", "doc_id", "source", "size", "content"), scratch, kept, block_words=None, **options)
    out = kept.select("row", "doc").join(drawn.select("row", "shard", "order_key"), "row")
    return _dealt(out).select("doc.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), Scratch(spark, "op10"))
