"""Mixing sources to target weights, by DataFrame functions alone.

The words of a source, in order of its documents, are packed into blocks of ``block`` words. Targets share all words
by weight and stop at ``most`` times a source's own. The run has as many slots as its targets hold blocks, in output
shards of ``SHARD`` slots. Each shard draws how many of its slots every source gets: the whole part of the source's
share for sure, and the slots that are left over by a multinomial draw on the fractions (hashes of shard and slot), so
totals stray from their targets by about the root of the number of shards. A source's slots, numbered through its
shards, go through its blocks in pseudorandom order, a new one for each pass, and are joined to the blocks by index.
Slots beyond ``most`` passes stay empty, so no block, and no document, is used more often.

Places of documents come from sums in three levels, by (source, run of buckets), bucket and within it, so a hot source
isn't gathered; buckets come from id and size, so rows that share an id or have none are spread too. The one-task steps
run over one row for each source.

Cases: null and empty texts have size 0 and take nothing; a null source is a source, the last; documents without an
id come first in their bucket; repeated rows are documents each; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralift.llm.common import materialize

BLOCK = 32
SHARD = 4096
BUCKET_ROWS = 4096
#: Parts of a slot that shares are counted in, and stretches that draws are looked up by.
FINE = 1024
BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space behind it, read without going back.
STEP = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"
#: Multipliers of the pseudorandom permutation, by the number of bits of the range: primes, so coprime to most ranges.
PRIMES = ((31, (2147483629, 2147483587)), (38, (16777213, 16777199)), (45, (131071, 131063, 131059)))


def _long(x: Column) -> Column:
    return F.floor(x).cast("long")


def permutation_columns(rows: DataFrame, n: Column, prefix: str) -> DataFrame:
    """Columns that ``permuted`` needs of each range; added to the few rows of sources, not to every slot."""
    multiplier, m = None, F.col(f"{prefix}n")
    for bits, primes in reversed(PRIMES):
        pick = F.lit(primes[-1])
        for p in reversed(primes[:-1]):
            pick = F.when(m % p != 0, F.lit(p)).otherwise(pick)
        multiplier = pick if multiplier is None else F.when(m < (1 << bits), pick).otherwise(multiplier)
    power = F.floor(F.log2(m.cast("double") + 0.5)).cast("int")
    rows = rows.withColumn(f"{prefix}n", n.cast("long"))
    top = F.call_function("shiftleft", F.lit(1).cast("long"), power)
    return rows.withColumns({f"{prefix}by": multiplier.cast("long"), f"{prefix}top": top, f"{prefix}half": F.greatest(F.lit(1), (power / 2).cast("int"))})


def permuted(rows: DataFrame, name: str, prefix: str, salt: Column, rounds: int = 3) -> DataFrame:
    """Column ``name``, below ``n``, sent through a permutation of 0..n-1 for each ``n`` below 2**45 and salt.

    Rounds are affine steps, each mixed on the largest power of two. Steps are columns of their own, as nested
    expressions would double with each.
    """
    z, n = F.col("__z"), F.col(f"{prefix}n")
    rows = rows.withColumn("__salt", salt.cast("long"))
    for k in range(rounds):
        rows = rows.withColumn("__z", (F.col(name) * F.col(f"{prefix}by") + (F.col("__salt") * 1000003 + (k + 1) * 7919) % n) % n)
        rows = rows.withColumn(name, F.when(z < F.col(f"{prefix}top"), z.bitwiseXOR(F.call_function("shiftright", z, F.col(f"{prefix}half")))).otherwise(z))
    return rows.drop("__salt", "__z")


def targets(sized: DataFrame, most: int = 3) -> DataFrame:
    """``source, rank, source_size, target``: shares by weight 1, 2, 3, repeating, stopped at ``most`` times the size.

    With sources in order of how soon they stop, ``level`` is what a unit of weight gets if all before have stopped;
    the first source that doesn't stop at its own level fixes it for the rest.
    """
    everything = Window.partitionBy()
    totals = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = totals.select("source", "source_size", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long").alias("rank"))
    ranked = ranked.withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("double")).withColumn("stop", (F.col("source_size") * most).cast("double")).withColumn("soon", F.col("stop") / F.col("weight"))
    order = Window.orderBy("soon", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("level", F.max(F.when(F.col("level") <= F.col("soon"), F.col("level"))).over(everything))
    return ranked.select("source", "rank", "source_size", F.least("stop", F.col("weight") * F.coalesce("level", F.lit(float("inf")))).alias("target"))


def _before(rows: DataFrame, keys: list[str], order: str, value: str, name: str, run: int = 4096) -> DataFrame:
    """Adds ``name``, the sum of ``value`` before each row of its key by ``order`` (whole numbers, one row each), in two
    levels: sums of runs of ``run`` numbers, and sums within a run."""
    rows = rows.withColumn("__run", F.expr(f"{order} div {run}"))
    sums = rows.groupBy(*keys, "__run").agg(F.sum(value).alias("__sum"))
    up = Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__run").alias("__of"), F.coalesce(F.sum("__sum").over(up), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*keys, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = F.col("__run") == F.col("__of")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return rows.join(sums, on).withColumn(name, F.col("__base") + F.col("__inside")).drop("__run", "__of", "__base", "__inside", *[f"__{k}" for k in keys])


def _placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document with words, its source's row, and ``at``, the words of its source before it."""
    buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["__source"]), "left").drop("__source").where("size > 0")
    rows = rows.withColumn("bucket", F.pmod(F.coalesce("doc_id", F.lit(0)) + F.col("size"), F.lit(buckets)).cast("long"))
    base = _before(rows.groupBy("rank", "bucket").agg(F.sum("size").alias("words")), ["rank"], "bucket", "words", "base").select(F.col("rank").alias("r"), F.col("bucket").alias("b"), "base")
    inside = Window.partitionBy("rank", "bucket").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(base, (rows["rank"] == base["r"]) & (rows["bucket"] == base["b"])).withColumn("at", F.col("base") + F.col("inside")).drop("base", "inside", "bucket", "r", "b")


def _drawn(parts: DataFrame, shards: DataFrame, number: int, keep: list[str]) -> DataFrame:
    """``*keep, shard, draw``: the source of each of ``number`` draws of every shard, by the fractions ``rem`` of sources.

    A draw is a hash below the sum of fractions; sources stand end to end below it, and both sides meet by ``BINS`` equal
    stretches, so neither is gathered.
    """
    total = parts.agg(F.sum("rem")).first()[0]
    width = -(-total // BINS)
    spans = parts.where("rem > 0").withColumn("__bin", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(low + rem - 1) div {width}"))))
    draws = shards.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    name = F.md5(F.concat_ws(":", "shard", "draw").cast("binary"))
    draws = draws.withColumn("__u", F.conv(F.substring(name, 1, 15), 16, 10).cast("long") % total).withColumn("__at", F.expr(f"__u div {width}"))
    return draws.join(spans, (F.col("__at") == F.col("__bin")) & (F.col("__u") >= F.col("low")) & (F.col("__u") < F.col("low") + F.col("rem"))).select(*keep, "shard", "draw")


def shard_counts(sources: DataFrame, shard: int = SHARD) -> DataFrame:
    """``rank, shard, first, n`` and the columns of ``sources``: slots that each output shard draws of each source, and
    the number of the first of them among the source's slots."""
    keep = sources.columns
    everything = sources.agg(F.sum("weight")).first()[0] or 0
    slots = (everything + FINE // 2) // FINE
    spark, found, floors = sources.sparkSession, [], F.lit(0).cast("long")
    drawn = None
    for size, first, number in ((shard, 0, slots // shard), (slots % shard, slots // shard, 1)):
        if not size or not number:
            continue
        lead = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        parts = sources.withColumns({"whole": F.expr(f"({size} * weight) div {everything}"), "rem": F.expr(f"({size} * weight) % {everything}")}).withColumn("low", F.coalesce(F.sum("rem").over(lead), F.lit(0).cast("long")))
        sure = parts.where("whole > 0").withColumn("shard", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + number - 1).cast("long"))))
        before = F.expr(f"({shard} * weight) div {everything}") * F.col("shard")
        found.append(sure.select(*keep, "shard", before.alias("first"), F.col("whole").alias("n")))
        floors = floors + F.expr(f"({size} * weight) div {everything}") * number
        left = size - (parts.agg(F.sum("whole")).first()[0] or 0)
        if left:
            one = _drawn(parts, spark.range(first, first + number).withColumnRenamed("id", "shard"), left, keep)
            drawn = one if drawn is None else drawn.unionByName(one)
    if drawn is not None:
        by = drawn.groupBy(*keep, "shard").agg(F.count(F.lit(1)).alias("n"))
        numbered = _before(by, ["rank"], "shard", "n", "__before")
        found.append(numbered.select(*keep, "shard", (floors + F.col("__before")).alias("first"), "n"))
    out = found[0] if found else sources.limit(0).select(*keep, *[F.lit(0).cast("long").alias(c) for c in ("shard", "first", "n")])
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def slots(sources: DataFrame, most: int, shard: int = SHARD) -> DataFrame:
    """``rank, block``: every slot of the run with the block it takes.

    Counts of shards become slots in a number of tasks that follows the slots, as the engine sees only the few counts.
    """
    used = permutation_columns(sources.where("weight > 0").select("rank", "weight", "blocks"), F.col("blocks"), "b_")
    counts = shard_counts(used, shard)
    tasks = max(1, (sources.agg(F.sum("weight")).first()[0] or 0) // (FINE * 32 * shard) + 1)
    last = F.least(F.col("first") + F.col("n"), F.col("blocks") * most) - 1
    rows = counts.repartition(tasks, "rank", "shard").where(F.col("first") <= last).withColumn("j", F.explode(F.sequence(F.col("first"), last)))
    rows = rows.select("rank", "b_n", "b_by", "b_top", "b_half", (F.col("j") % F.col("blocks")).alias("block"), F.expr("j div blocks").alias("pass"))
    return permuted(rows, "block", "b_", F.col("rank") * 31 + F.col("pass")).select("rank", "block")


def _uses(docs: DataFrame, keep_text: bool, block: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sized documents, sources, and the pieces of documents with how often the mix uses them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tie = F.xxhash64(text) if keep_text else F.lit(0).cast("long")
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), tie.alias("tie")))
    # one row a source; its weight is the slots it is due, in parts of FINE
    due = F.least(F.col("target") * F.col("blocks") / F.col("source_size"), (F.col("blocks") * most).cast("double"))
    sources = targets(sized, most).withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / block).cast("long")))
    sources = materialize(sources.withColumn("weight", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(_long(due * FINE + 0.5)).cast("long")).withColumnRenamed("source", "__source"))
    placed = _placed(sized, sources)
    last = _long((F.col("at") + F.col("size") - 1) / block)
    pieces = placed.withColumn("block", F.explode(F.sequence(_long(F.col("at") / block), last)))
    begin = F.greatest(F.col("at"), F.col("block") * block)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.select("rank", "block", "at", "doc_id", "tie", "size", "source_size", "target", "source", (begin - F.col("at")).alias("begin"), (end - begin).alias("words"))
    uses = slots(sources, most).groupBy("rank", "block").agg(F.count(F.lit(1)).alias("uses"))
    # the engine takes the slots for as few as the sources they are made of, and would broadcast them
    return sized, sources, pieces.join(uses.hint("merge"), ["rank", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def mix_sizes(docs: DataFrame, block: int = BLOCK, most: int = 3) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document."""
    sized, sources, pieces = _uses(docs, False, block, most)
    taken = pieces.groupBy("rank", "at", "doc_id", "size", "source_size", "target").agg(F.sum(F.col("words") * F.col("uses")).cast("long").alias("taken"))
    names = ["doc_id", "size", "source_size", "target", "taken"]
    empty = sized.where("size = 0").join(sources, sized["source"].eqNullSafe(sources["__source"])).withColumn("taken", F.lit(0).cast("long"))
    return taken.select(*names).unionByName(empty.select(*names))


def mix_documents(docs: DataFrame, block: int = BLOCK, most: int = 3) -> DataFrame:
    """The documents of the mix, in the columns of ``docs``: each text is what the mix takes of it, repeats included.

    A piece keeps the white space behind its words, or gets a blank if it has none and another follows. A document of which nothing is taken is left out; ``n_chars``,
    where there is such a column, is the new length.
    """
    _, _, pieces = _uses(docs, True, block, most)
    key = ["doc_id", "source", "tie"]
    plan = pieces.where("uses > 0").groupBy(*key, "at").agg(F.sort_array(F.collect_list(F.struct("begin", "words", "uses"))).alias("parts"))
    # repeated rows have one key and a plan each
    plan = plan.groupBy(*key).agg(F.collect_list(F.struct("at", "parts")).alias("p")).select(*key, F.col("p.at").alias("ats"), F.col("p.parts").alias("plans"))
    # documents' columns get names of their own, as they may be called like those of the plan
    d = docs.select(*[F.col(f"`{c}`").alias(f"__doc_{c}") for c in docs.columns])
    text = F.coalesce(F.col("__doc_text").cast("string"), F.lit(""))
    d = d.withColumns({"__id": F.col("__doc_doc_id").cast("long"), "__source": F.col("__doc_source").cast("string"), "__tie": F.xxhash64(text)})
    d = d.withColumn("__nth", F.row_number().over(Window.partitionBy("__id", "__source", "__tie").orderBy(F.lit(0))))
    joined = d.join(plan, d["__id"].eqNullSafe(plan["doc_id"]) & d["__source"].eqNullSafe(plan["source"]) & (d["__tie"] == plan["tie"])).where(F.col("__nth") <= F.size("plans"))
    # the text in the pieces that blocks cut it into: one of the first block's rest, then whole blocks
    body = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    joined = joined.withColumn("__body", body).withColumn("__parts", F.element_at("plans", F.col("__nth")))
    joined = joined.withColumn("__at", F.element_at("ats", F.col("__nth")))
    first = F.lit(block) - F.col("__at") % block
    head = F.call_function("regexp_extract", F.col("__body"), F.concat(F.lit("^("), F.lit(f"(?:{STEP})"), F.lit("{1,"), first.cast("string"), F.lit("}+)")), F.lit(1))
    joined = joined.withColumn("__head", head)
    rest = F.substring("__body", F.length("__head") + 1, F.length("__body"))
    joined = joined.withColumn("__pieces", F.concat(F.array("__head"), F.regexp_extract_all(rest, F.lit(f"(?:{STEP}){{1,{block}}}+"), F.lit(0))))
    piece = lambda p: F.element_at(F.col("__pieces"), (F.when(p["begin"] == 0, 0).otherwise(F.floor((p["begin"] - first) / block) + 1) + 1).cast("int"))
    apart = lambda x: F.when(x.rlike(r"[\x20\x09-\x0D]\z"), x).otherwise(F.concat(x, F.lit(" ")))
    made = F.array_join(F.transform("__parts", lambda p: F.repeat(apart(piece(p)), p["uses"].cast("int"))), "")
    joined = joined.withColumn("__text", F.when(F.col("__body").rlike(r"[\x20\x09-\x0D]\z"), made).otherwise(F.rtrim(made)))
    out = [F.col("__text").alias(c) if c == "text" else F.length("__text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`__doc_{c}`").alias(c) for c in docs.columns]
    return joined.select(*out)
