"""Jaccard self-join of documents on word n-grams, by grouped prefixes.

A document's set holds 64-bit hashes of its n-grams. All sets are put in one global order, rare
before frequent. Two sets of a Jaccard similarity of at least t share an element of their short
prefixes in this order, so only documents that meet in a prefix are compared. Equal sets form a
class; classes of one size and one prefix form a group, and only its leader posts the prefix.
Group pairs are filtered by size, by position and by how many prefix elements they share; those
left are expanded into their members, whose whole sets are verified.

Links serve to find components, so comparisons whose answer cannot matter are left out, and only
those. Star rounds, linear in the postings, compare every class with one leading class of its
lists; the exact round takes all pairs that still lie in different components, first the most
promising one of each two components and then, once those are joined, the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Remembered, broadcast_if_small, cut, give_back, table
from .components import smallest_of

#: Most elements in the table of frequent n-grams that is sent to the tasks (16 bytes each).
FREQUENT_ROWS = 1 << 19
#: A task's marks for n-grams it has met (a byte each), and how many it meets before it starts anew.
MARKS, MET = 1 << 24, 1 << 22
#: Repeated n-grams that a task counts at a time.
CHUNK = 1 << 20
#: Rows of a list that one task sorts or joins; longer lists are salted.
SPLIT = 4_096
#: Odd multipliers of the n-gram hash, one for each place and one for the length.
PLACES = np.array([xxhash.xxh64_intdigest(b"place", seed=k) | 1 for k in range(64)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 | 1)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of hashed word n-grams. Words are maximal runs without ASCII white space, A-Z in lower case."""

    def __init__(self, words: int):
        self.n = words
        self.hash = Remembered(xxhash.xxh64_intdigest, 100_000)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; a text shorter than n words is one n-gram, an empty one none."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.int64)
        h = np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        total = np.full(len(h) - n + 1, PLACES[-1] * np.uint64(n), np.uint64)
        for k in range(n):
            total += h[k : len(h) - n + 1 + k] * PLACES[k]
        return np.unique(mixed(total).view(np.int64))


def digest(x: np.ndarray) -> bytes:
    return blake2b(x.tobytes(), digest_size=16).digest()


def _measure(words: int):
    """Size and digest of each set, and n-grams that a task meets in at least three documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        shingles, names = Shingler(words), ["doc_id", "n", "sig", "token", "seen"]
        marks, met = np.zeros(MARKS, np.uint8), 0
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            tokens, seen = np.unique(np.concatenate(held) if held else np.empty(0, np.int64), return_counts=True)
            # A mark may be another n-gram's, so a single repeat proves nothing.
            tokens, seen = tokens[seen > 1], seen[seen > 1]
            none = [pa.nulls(len(tokens), t) for t in (pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(tokens), pa.array(seen.astype(np.int64))], names)

        for batch in batches:
            n, sig = [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                n.append(len(s))
                sig.append(digest(s))
                at = s & (MARKS - 1)
                again = s[marks[at] > 0]
                marks[at] = 1
                held.append(again)
                size, met = size + len(again), met + len(s)
                if size >= CHUNK or met >= MET:
                    yield frequent()
                    held, size = [], 0
                if met >= MET:
                    marks[:], met = 0, 0
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), none, none], names)
        yield frequent()

    return run


def _prefixes(words: int, percent: int, tokens: np.ndarray, seen: np.ndarray):
    """The prefix of each set in the global order: frequent n-grams last, others by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        shingles = Shingler(words)
        for batch in batches:
            n, sig, whole, prefix, splits = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                length = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                often = np.zeros(len(s), np.int64)
                if len(tokens) and len(s):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    often = np.where(tokens[at] == s, seen[at], 0)
                order = np.lexsort((s, often))[:length] if often.any() else slice(length)
                n.append(len(s))
                sig.append(digest(s))
                whole.append(digest(s[order]))
                prefix.append(s[order])
                splits.append((1 + often[order] // SPLIT).astype(np.int32))
            columns = {"doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "sig": pa.array(sig, pa.binary()), "phash": pa.array(whole, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns | {"prefix": pa.array(prefix, pa.list_(pa.int64())), "splits": pa.array(splits, pa.list_(pa.int32()))})

    return run


def _whole_sets(words: int):
    """From (a, b, text): the text's set, under the pair it is wanted for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        shingles = Shingler(words)
        for batch in batches:
            last, sets = (None, shingles(None)), []
            for text in batch.column(2).to_pylist():
                if text != last[0]:
                    last = text, shingles(text)
                sets.append(last[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["a", "b", "elements"])

    return run


def frequent_table(counts: DataFrame, rows: int = FREQUENT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams, ``rows`` at most, sorted by hash, with their counts.

    The least count taken is the smallest power of two that keeps the table within its bound. The
    table only shapes the order, so n-grams left out cost time and never a link.
    """
    counts = cut(counts.groupBy("token").agg(F.sum("seen").alias("seen")))
    sizes = {r["k"]: r["n"] for r in counts.groupBy(F.floor(F.log2("seen")).alias("k")).agg(F.count("*").alias("n")).collect()}
    least, total = 64, 0
    while least > 1 and total + sizes.get(least - 1, 0) <= rows:
        least -= 1
        total += sizes.get(least, 0)
    got = counts.where(F.floor(F.log2("seen")) >= least).toArrow()
    tokens, seen = got["token"].to_numpy(), got["seen"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], seen[order]


class Bounds:
    """What sizes and positions alone say about two sets, as columns; ``percent`` is the threshold."""

    def __init__(self, percent: int):
        self.percent = percent

    def near(self, x: Column, y: Column) -> Column:
        return (x * 100 >= y * self.percent) & (y * 100 >= x * self.percent)

    def need(self, x: Column, y: Column) -> Column:
        """The overlap that sets of sizes x and y must reach."""
        return F.ceil((x + y) * self.percent / (100 + self.percent))

    def behind(self, x: Column, y: Column) -> Column:
        """Most shared elements that can stand behind the prefix that ends first."""
        return F.ceil(F.greatest(x, y) * self.percent / 100) - 1

    def least_common(self, n: Column, low: Column, high: Column) -> Column:
        """How many counted postings a set of size n must share with any set of a size from low to high."""
        below = F.greatest(low, F.ceil(n * self.percent / 100))
        above = F.least(high, F.floor(n * 100 / self.percent))
        # Towards larger sets the number falls; there it is more than this quotient.
        falling = F.floor(((n + above) * 100 * self.percent - above * self.percent * (100 + self.percent)) / (100 * (100 + self.percent))) + 1
        return F.greatest(F.lit(1), F.least(self.need(n, below) - self.behind(n, below), falling))

    def worthwhile(self, x: str, y: str) -> Column:
        """Whether rows x and y of a list may link.

        ``open`` elements of a set can be common, and ``m`` of its prefix; ``idx`` of these stand
        before the one that met. Those before can only meet each other, and so can those behind.
        """
        n, m, idx, rest = ([F.col(f"{side}.{c}") for side in (x, y)] for c in ("n", "m", "idx", "open"))
        need = self.need(*n)
        common = F.least(*idx) + 1 + F.least(*(k - i - 1 for k, i in zip(m, idx)))
        return self.near(*n) & (F.least(*rest) >= need) & (common + self.behind(*n) >= need)


def _verified(pairs: DataFrame, named: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the class pairs ``(a, b)`` whose whole sets reach the threshold.

    The set of b travels once for each pair, that of a once for all its pairs.
    """
    of = lambda end: named.select(F.col("id").alias(end), F.col("rep").alias("doc_id"), F.col("sig").alias("own"))
    both = pairs.select("a", "b").join(of("b"), "b").select("doc_id", "own", "a", "b").union(pairs.select("a").distinct().join(of("a"), "a").select("doc_id", "own", "a", F.lit(None).cast("long")))
    wanted = broadcast_if_small(cut(both))
    sets = cut(texts.join(wanted, "doc_id").select("a", "b", "text").mapInArrow(_whole_sets(words), "a long, b long, elements array<long>"))
    x, y = sets.where("b is null").select("a", F.col("elements").alias("x")), sets.where("b is not null").select("a", "b", F.col("elements").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return cut(y.join(x.hint("merge"), "a").where(shared * 100 >= (F.size("x") + F.size("y") - shared) * percent).select("a", "b").distinct())


def _star(placed: DataFrame, bounds: Bounds, turn: int) -> DataFrame:
    """``(a, b)``: for each class b of ``placed`` the leading class a that it meets in most lists.

    A list is led by the class with the largest share of common postings, as the original of many
    edited copies is, and in later turns by a class of a hash's choice.
    """
    lead = F.round(F.col("m") * 1000 / F.col("n")) if turn == 0 else F.xxhash64("id", F.lit(turn)).cast("double")
    heads = placed.groupBy("token").agg(F.max(F.struct(lead.alias("lead"), "id", "n", "m", "idx", "open", "label")).alias("head"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    met = placed.alias("row").join(heads, "token").where((F.col("row.label") != F.col("head.label")) & bounds.worthwhile("row", "head"))
    met = met.groupBy(F.col("row.id").alias("b"), F.col("head.id").alias("a")).agg(F.count("*").alias("lists"))
    return met.groupBy("b").agg(F.max_by("a", F.struct("lists", "a")).alias("a")).select("a", "b")


def _apart(rows: DataFrame, key: str, bounds: Bounds | None = None) -> DataFrame:
    """Rows of the lists ``key`` that hold several labels, with the most frequent one as ``major`` and the number of salts.

    With ``bounds``, only postings that can be the first common one of a pair: behind it, a set
    must have enough counted postings left for the least that it has to share in this list.
    """
    sizes = (F.min("n").alias("low"), F.max("n").alias("high")) if bounds else ()
    per = rows.groupBy(key, "label").agg(F.count("*").alias("k"), *sizes)
    lists = per.groupBy(key).agg(F.max_by("label", F.struct("k", "label")).alias("major"), F.count("*").alias("kinds"), F.sum("k").alias("size"), *((F.min("low").alias("low"), F.max("high").alias("high")) if bounds else ()))
    out = rows.join(lists.where("kinds > 1").withColumn("salts", (F.floor(F.col("size") / SPLIT) + 1).cast("int")), key)
    if bounds:
        out = out.where(F.col("idx") <= F.col("m") - bounds.least_common(F.col("n"), F.col("low"), F.col("high")))
    return cut(out.select(*rows.columns, "major", "salts"))


def _met(rows: DataFrame, key: str) -> DataFrame:
    """Each pair ``(x, y)`` of rows of one list with different labels once; long lists are spread over salts."""
    x = rows.where("label <> major").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).alias("x")
    y = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
    once = (F.col("y.label") == F.col("y.major")) | (F.col("x.id") < F.col("y.id"))
    return x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.label") != F.col("y.label")) & once)


def _common(pairs: DataFrame, shared: DataFrame, bounds: Bounds) -> DataFrame:
    """``(a, b, lists)``: pairs that may still link once all their common counted postings are known.

    Up to the last common one nothing else is shared, so only what stands behind it can add.
    """
    wanted = broadcast_if_small(cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    counted = shared.join(wanted, "id", "left_semi").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("idx", "token", "open"))).alias("c"))
    counted = cut(counted.select("id", "n", F.col("c.token").alias("tokens"), F.transform("c", lambda x: x["open"] - x["idx"]).alias("left")))
    side = lambda end: counted.toDF(end, *(f"{end}_{c}" for c in ("n", "tokens", "left"))).hint("merge")
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").withColumn("both", F.array_intersect("a_tokens", "b_tokens"))
    # A set of n elements with the last common one at position p has n - p - 1 behind it.
    last = F.element_at("both", -1)
    left = [F.element_at(f"{end}_left", F.array_position(f"{end}_tokens", last).cast("int")) - 1 for end in "ab"]
    n = F.col("a_n"), F.col("b_n")
    return both.where((F.size("both") > 0) & (F.size("both") + F.least(*left, bounds.behind(*n)) >= bounds.need(*n))).select("a", "b", F.size("both").alias("lists"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links, where two documents link when the
    Jaccard similarity of their n-gram sets is at least ``percent`` / 100. A null, empty or blank
    text has the empty set, size 0, links with nothing and is its own component. Texts of fewer
    words than n form one n-gram. Rows that repeat an id with different texts are linked, save
    for empty ones; a row with a null id gets the component of equal texts, null if there is
    none. Other columns are not read.
    """
    bounds = Bounds(percent)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    measured = cut(texts.mapInArrow(_measure(words), "doc_id long, n long, sig binary, token long, seen long"))
    sizes = measured.where("n is not null").select("doc_id", "n", "sig")
    tokens, seen = frequent_table(measured.where("n is null").select("token", "seen"))

    # Documents of equal sets are one class, which has a number and one prefix.
    listed = texts.where("doc_id is not null").mapInArrow(_prefixes(words, percent, tokens, seen), "doc_id long, n long, sig binary, phash binary, prefix array<long>, splits array<int>")
    classes = listed.where("n > 0").groupBy("n", "phash", "sig").agg(F.min("doc_id").alias("rep"), F.first(F.struct("prefix", "splits")).alias("posted"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), "n", "phash", "sig", "rep", "posted"))
    named = cut(classes.select("id", "n", "sig", "rep"))
    # Classes of one size and one prefix are one group; its leader posts the prefix.
    groups = classes.groupBy("n", "phash").agg(F.min("id").alias("leader"), F.count("*").alias("members")).where("members > 1")
    members = cut(classes.select("n", "phash", "id").join(groups.select("n", "phash", "leader"), ["n", "phash"]).select("leader", "id"))
    leaders = classes.join(broadcast_if_small(members.where("id <> leader").select("id")), "id", "left_anti")
    postings = leaders.select("id", "n", "posted.splits", F.posexplode("posted.prefix").alias("pos", "token"))
    splits = F.element_at("splits", F.col("pos") + 1)
    postings = postings.select("token", F.when(splits > 1, 1 + F.pmod(F.xxhash64("id"), splits)).otherwise(0).cast("int").alias("salt"), "id", F.col("n").cast("int").alias("n"), "pos")
    # A posting counts if another of its list has a like size. Of one class's postings before a
    # common one, those that do not count are not shared, since the other set would have posted them.
    by_list, by_class = Window.partitionBy("token", "salt").orderBy("n"), Window.partitionBy("id").orderBy("pos")
    counts = (F.col("salt") > 0) | F.coalesce(bounds.near(F.col("n"), F.col("lower")), F.lit(False)) | F.coalesce(bounds.near(F.col("n"), F.col("upper")), F.lit(False))
    met = postings.withColumn("lower", F.lag("n").over(by_list)).withColumn("upper", F.lead("n").over(by_list)).where(counts)
    met = met.withColumn("idx", F.row_number().over(by_class) - 1).withColumn("m", F.count("*").over(Window.partitionBy("id")).cast("int"))
    shared = cut(met.select("token", "id", "n", "m", "idx", (F.col("n") - F.col("pos") + F.col("idx")).alias("open")))

    # Star rounds.
    of_leader = members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    tried = cut(_star(shared.withColumn("label", F.col("id")), bounds, 0).union(of_leader).distinct())
    links = _verified(tried, named, texts, words, percent)

    def placed(components: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings and members with their present component; a group that lies in several has a label of its own."""
        found = broadcast_if_small(components.select(F.col("node").alias("id"), "component"))
        inside = cut(members.join(found, "id", "left").select("leader", "id", F.coalesce("component", "id").alias("label")))
        split = inside.groupBy(F.col("leader").alias("id")).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("id", F.lit(True).alias("split"))
        rows = shared.join(found, "id", "left").join(broadcast_if_small(cut(split)), "id", "left")
        return rows.select(*shared.columns, F.when(F.col("split"), -1 - F.col("id")).otherwise(F.coalesce("component", "id")).alias("label")), inside

    def joined(components: DataFrame, new: DataFrame) -> DataFrame:
        """Components with more links; each old one is a link of its nodes to its name."""
        return components if new.isEmpty() else smallest_of(components.select(F.col("component").alias("a"), F.col("node").alias("b")).union(new))

    parts = smallest_of(links)
    more = cut(_star(placed(parts)[0], bounds, 1).join(tried.hint("merge"), ["a", "b"], "left_anti"))
    tried, parts = cut(tried.union(more)), joined(parts, _verified(more, named, texts, words, percent))

    # The exact round: group pairs that meet in lists of several components, then their members.
    rows, inside = placed(parts)
    first = F.col("x.id") < F.col("y.id")
    pairs = _met(_apart(rows, "token", bounds), "token").where(bounds.worthwhile("x", "y"))
    ends = lambda c: (F.when(first, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(f"a_{c}"), F.when(first, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(f"b_{c}"))
    left = [(F.col(f"{end}_m") - F.col(f"{end}_idx")).alias(f"{end}_most") for end in "ab"]
    pairs = pairs.select(*ends("id"), *ends("n"), *ends("m"), *ends("idx")).select("a_id", "b_id", "a_n", "b_n", *left)
    pairs = pairs.groupBy("a_id", "b_id", "a_n", "b_n").agg(F.max("a_most").alias("a_most"), F.max("b_most").alias("b_most"))
    n = F.col("a_n"), F.col("b_n")
    pairs = cut(pairs.where(F.least("a_most", "b_most") + bounds.behind(*n) >= bounds.need(*n)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    pairs = _common(pairs, shared, bounds)
    member = lambda end: broadcast_if_small(members).select(F.col("leader").alias(end), F.col("id").alias(f"{end}_own"))
    pairs = pairs.join(member("a"), "a", "left").join(member("b"), "b", "left").select(F.coalesce("a_own", "a").alias("a"), F.coalesce("b_own", "b").alias("b"), "lists")
    own = _met(_apart(inside, "leader"), "leader").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(1 << 31).alias("lists"))
    pairs = pairs.union(own).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "lists")
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = cut(pairs.join(done.hint("merge"), ["a", "b"], "left_anti"))
    for best in (True, False):
        found = broadcast_if_small(parts.select("node", "component"))
        at = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))  # noqa: E731, B023
        left = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").select("a", "b", "lists", F.coalesce("a_in", "a").alias("u"), F.coalesce("b_in", "b").alias("v")).where("u <> v")
        if best:
            left = left.groupBy(F.least("u", "v"), F.greatest("u", "v")).agg(F.max(F.struct("lists", "a", "b")).alias("top")).select("top.a", "top.b")
        left = cut(left.select("a", "b").distinct())
        if not left.isEmpty():
            parts = joined(parts, _verified(left, named, texts, words, percent))
        if best:
            pairs = pairs.join(left.hint("merge"), ["a", "b"], "left_anti")

    keyed = cut(sizes.join(named, ["n", "sig"], "left").select("doc_id", F.col("n").alias("n_shingles"), "id", "rep"))
    # Rows of one id with different texts count as linked.
    again = keyed.where("doc_id is not null and id is not null").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("doc_id", "a")
    found = joined(parts, cut(keyed.join(broadcast_if_small(cut(again)), "doc_id").select("a", F.col("id").alias("b")).where("a <> b")))
    smallest = found.join(named, found.node == named.id).groupBy("component").agg(F.min("rep").alias("component_id"))
    placed_ids = broadcast_if_small(cut(found.join(smallest, "component").select(F.col("node").alias("id"), "component_id")))
    return keyed.join(placed_ids, "id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "rep", "doc_id").alias("component_id"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(0, len(ws) - 4), lambda i: array_to_string(ws[i + 1 : i + 5], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS t FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM e x JOIN e y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * i >= 80 * (len(x.sh) + len(y.sh) - i)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(n, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.n)
SELECT doc_id, len(any_value(sh)) AS n_shingles, min(c) AS component_id FROM s JOIN r ON n = doc_id GROUP BY doc_id
"""
