"""Mixing sources to target weights: temperature, then budgeted block permutations.

Source shares of the tokens are raised to an exponent and normalised; the exponent is bisected
until the weights reach a target entropy, or no source is repeated more often than allowed. A
source's weight times the budget is its quota: so many whole passes and a rest. Each pass visits
the source's blocks, groups of documents by hash, in an order of its own; the rest of a quota ends
within one block, whose documents follow in hash order while they fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, table

#: Tokens of a block, about.
BLOCK_TOKENS = 100_000
#: Blocks of one source whose order one task works out, about.
RANGE_BLOCKS = 10_000
#: Binary digits of the exponent, and how many of them one look at the sources settles.
DIGITS, AT_ONCE = 50, 5


def temper(sources: DataFrame, budget: float, lift: float | None = 0.5, most_passes: float | None = 4.0) -> tuple[float, float]:
    """The exponent a in [0, 1] for ``sources(p)``, their shares of all tokens, and the sum of p ** a.

    ``lift`` sets the target entropy between that of the natural shares (0) and the highest (1).
    ``most_passes`` then raises the exponent, up to 1, until no source has a quota of more than so
    many times its own tokens; ``budget`` is in units of all tokens. Both bounds are met from the
    side of the natural shares. Bisection looks at the sources where they are, each time at 31
    exponents that cut the remaining interval evenly, so any number of sources will do.
    """
    p = F.col("p")
    count, natural, least = sources.agg(F.count("*"), -F.sum(p * F.log(p)), F.min(p)).first()
    if count < 2:
        return 1.0, 1.0
    target = natural + (lift if lift is not None else 1.0) * (math.log(count) - natural)

    def good(a: float, total: float, logs: float) -> bool:
        entropy = math.log(total) - a * logs / total
        return entropy <= target and (most_passes is None or least ** (a - 1) / total * budget <= most_passes)

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        got = sources.agg(*[F.sum(x) for a in exponents for x in (F.pow(p, F.lit(a)), F.pow(p, F.lit(a)) * F.log(p))]).first()
        return [*zip(got[::2], got[1::2])]

    low, step = 0.0, 1.0
    for _ in range(DIGITS // AT_ONCE):
        step /= 1 << AT_ONCE
        tried = [low + k * step for k in range(1, 1 << AT_ONCE)]
        low += step * sum(not good(a, *s) for a, s in zip(tried, sums(tried)))
    high = low + step
    return high, sums([high])[0][0]


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x09-\x0D\x20]+")).cast("long")


def keyed(*parts: Column | str) -> Column:
    """32 bits of a hash that any SQL engine can recompute."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def _before(rows: DataFrame, keys: list[str], order: Column, ranges: Column) -> DataFrame:
    """``rows`` with ``before``: the sum of ``size`` over the rows of equal keys that come earlier.

    Rows are dealt by ranges of the order, a 32-bit number, so a source of very many blocks is not
    one window; a range adds the sum of the ranges before it. Equal numbers follow the block.
    """
    dealt = rows.withColumn("order", order).withColumn("range", F.floor(F.col("order") / float(1 << 32) * ranges))
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "range").agg(F.sum("size").alias("in_range")).select(*keys, "range", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*keys, "range").orderBy("order", "mix_block").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, [*keys, "range"])
    return dealt.withColumn("before", F.col("start") + F.col("inside")).drop("order", "range", "start", "inside")


def mix_sources(docs: DataFrame, share_of_tokens: float = 1.0, lift: float = 0.5, most_passes: float = 4.0, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per appearance of a document in the mix: the columns of ``docs`` plus ``mix_pass``, ``mix_block``, ``mix_turn``, ``mix_tokens``.

    The budget is ``share_of_tokens`` of all tokens (words). ``mix_pass`` counts a source's passes
    from 0, ``mix_block`` is the block, ``mix_turn`` in [0, 1) where the block starts in its
    source's sequence: in order of it, every stretch of the mix holds the sources by weight. A null
    source is a source of its own, null and empty texts have no tokens and come along with their
    block (in the rest of a quota: only if the block is taken whole or they come before it ends).
    Repeated rows are documents each. A source without tokens has weight 0. There may be any number
    of sources. Other columns pass through, whatever their names, save for the four new ones and
    those that start with ``__mix``.
    """
    docs = docs.drop("mix_pass", "mix_block", "mix_turn", "mix_tokens")
    columns, key = docs.columns, "__mix_source"
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    number = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    counted = docs.withColumn("mix_tokens", token_count(F.col(text_col))).withColumn(key, source)
    sizes = cut(counted.groupBy(key).agg(F.sum("mix_tokens").alias("n")).where("n > 0"))
    total = sizes.agg(F.sum("n")).first()[0]
    if total is None:
        return docs.where(F.lit(False)).select(*columns, F.lit(0).alias("mix_pass"), F.lit(0).cast("long").alias("mix_block"), F.lit(0.0).alias("mix_turn"), F.lit(0).cast("long").alias("mix_tokens"))
    shares = sizes.withColumn("p", F.col("n") / F.lit(float(total)))
    exponent, all_raised = temper(shares.select("p"), share_of_tokens, lift, most_passes)
    quota = F.rint(F.pow("p", F.lit(exponent)) / all_raised * (share_of_tokens * total)).cast("long")
    plan = shares.withColumn("quota", quota).withColumn("passes", F.floor(F.col("quota") / F.col("n")).cast("int"))
    plan = plan.select(key, "n", "quota", "passes", (F.col("quota") - F.col("passes") * F.col("n")).alias("rest"), F.ceil(F.col("n") / block_tokens).alias("blocks"))
    plan = broadcast_if_small(cut(plan))
    placed = counted.join(plan.select(key, "blocks"), key).withColumn("mix_block", keyed(F.lit("block"), number) % F.col("blocks")).drop("blocks")

    # The schedule: one row per block, its tokens before it in the last pass, and what is left for it.
    order = lambda turn: keyed(F.lit("order"), key, "mix_block", turn)
    ranges = F.ceil(F.col("blocks") / RANGE_BLOCKS)
    blocks = cut(placed.groupBy(key, "mix_block").agg(F.sum("mix_tokens").alias("size"))).join(plan, key)
    blocks = _before(blocks, [key], order("passes"), ranges).withColumn("left", F.col("rest") - F.col("before")).drop("before")
    whole = F.when((F.col("left") >= F.col("size")) & (F.col("rest") > 0), 1).otherwise(0)
    blocks = blocks.withColumn("whole", F.col("passes") + whole).withColumn("partly", F.when((F.col("left") > 0) & (F.col("left") < F.col("size")), F.col("left")))
    turn = lambda number, partly: F.struct(number.cast("int").alias("mix_pass"), partly.cast("long").alias("partly"))
    fully = F.transform(F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.array().cast("array<int>")), lambda k: turn(k, F.lit(None)))
    ends = F.when(F.col("partly").isNotNull(), F.array(turn(F.col("passes"), F.col("partly")))).otherwise(F.array().cast("array<struct<mix_pass:int,partly:bigint>>"))
    each = blocks.select(key, "mix_block", "size", "n", "quota", "blocks", F.explode(F.concat(fully, ends)).alias("turn")).select("*", "turn.mix_pass", "turn.partly").drop("turn")
    each = _before(each, [key, "mix_pass"], order("mix_pass"), ranges)
    each = each.withColumn("mix_turn", F.round((F.col("mix_pass") * F.col("n") + F.col("before")) / F.col("quota"), 6))
    # A block's turns are as many as its source's passes, which most_passes bounds.
    schedule = cut(each.groupBy(key, "mix_block").agg(F.collect_list(F.struct("mix_pass", "mix_turn", "partly")).alias("__mix_turns")))

    seen = placed.join(broadcast_if_small(schedule), [key, "mix_block"])
    wanted = [*columns, F.col("__mix_turn.mix_pass").alias("mix_pass"), "mix_block", F.col("__mix_turn.mix_turn").alias("mix_turn"), "mix_tokens"]
    taken = lambda test: seen.select("*", F.explode(F.filter("__mix_turns", test)).alias("__mix_turn"))
    fully, ended = taken(lambda t: t["partly"].isNull()), taken(lambda t: t["partly"].isNotNull())
    inside = Window.partitionBy(key, "mix_block").orderBy(keyed(F.lit("document"), number), F.col(id_col), F.col(text_col)).rowsBetween(Window.unboundedPreceding, 0)
    partly = ended.withColumn("__mix_so_far", F.sum("mix_tokens").over(inside)).where(F.col("__mix_so_far") <= F.col("__mix_turn.partly"))
    return fully.select(*wanted).union(partly.select(*wanted))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "source", "mix_pass", "mix_block", "mix_turn", "mix_tokens")


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, text, source, coalesce('s' || source, 'n') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+'))::BIGINT AS t FROM documents),
n AS (SELECT s, sum(t)::BIGINT AS n FROM d GROUP BY s HAVING sum(t) > 0),
b AS (SELECT sum(n)::DOUBLE AS budget, count(*) AS k, -sum(n / (SELECT sum(n) FROM n) * ln(n / (SELECT sum(n) FROM n))) AS h FROM n),
a(step, low, high) AS (SELECT 0, 0::DOUBLE, 1::DOUBLE UNION ALL
  SELECT step + 1, CASE WHEN good THEN low ELSE (low + high) / 2 END, CASE WHEN good THEN (low + high) / 2 ELSE high END
  FROM (SELECT step, low, high, (SELECT -sum(w * ln(w)) <= max(h) + 0.5 * (ln(max(k)) - max(h)) AND max(w * budget / n) <= 4
          FROM (SELECT n, budget, h, k, pow(n / budget, (low + high) / 2) / sum(pow(n / budget, (low + high) / 2)) OVER () AS w FROM n, b)) AS good FROM a WHERE step < 50)),
w AS (SELECT s, n, round(budget * pow(n / budget, high) / sum(pow(n / budget, high)) OVER ())::BIGINT AS quota FROM n, b, (SELECT high FROM a WHERE step = 50)),
p AS (SELECT s, n, quota, quota // n AS passes, quota % n AS rest, (n + {BLOCK_TOKENS} - 1) // {BLOCK_TOKENS} AS blocks FROM w),
x AS (SELECT d.*, ('0x' || substr(md5('block:' || doc_id), 1, 8))::BIGINT % blocks AS block FROM d JOIN p USING (s)),
z AS (SELECT s, block, sum(t)::BIGINT AS size FROM x GROUP BY ALL),
e AS (SELECT s, block, size, n, quota, passes, rest, unnest(range(0, passes + 1)) AS pass FROM z JOIN p USING (s)),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY s, pass ORDER BY ('0x' || substr(md5('order:' || s || ':' || block || ':' || pass), 1, 8))::BIGINT, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM e),
g AS (SELECT x.*, o.pass, round((o.pass * o.n + o.before) / o.quota, 6) AS turn, CASE WHEN o.pass < o.passes OR o.rest > 0 AND o.rest - o.before >= o.size THEN NULL ELSE o.rest - o.before END AS room,
        sum(x.t) OVER (PARTITION BY x.s, x.block, o.pass ORDER BY ('0x' || substr(md5('document:' || doc_id), 1, 8))::BIGINT, doc_id) AS so_far FROM x JOIN o ON x.s = o.s AND x.block = o.block)
SELECT doc_id, source, pass::INTEGER AS mix_pass, block AS mix_block, turn AS mix_turn, t AS mix_tokens FROM g WHERE room IS NULL OR room > 0 AND so_far <= room
"""
