"""Document fingerprints by locally consistent parsing.

A text is cut into phrases by a rule that looks only at a few neighbours, and each phrase gets a
name; the names are cut again, level by level. The rule is deterministic coin tossing: a symbol's
tag says in which lowest bit it differs from its left neighbour, and of what kind that bit is;
tags of neighbours differ again, so after a few rounds they come from a handful of values, and
local maxima of the tags start phrases. Equal substrings are cut equally inside, wherever they
stand. A fingerprint keeps the least hashes of the phrase names of the highest level, and of a
short text those of the lower levels too, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, table

#: Levels of phrases; a phrase of level 3 spans some thirty characters.
LEVELS = 3
#: Phrase names of a level that a fingerprint keeps, 32 bits each.
KEPT = 128
#: Texts of fewer code points keep all levels, and two fingerprints are compared at the highest level
#: of which both have so many names.
SHORT, ENOUGH = 2_000, 12
#: Characters that are parsed at a time.
AT_ONCE = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def lowest_bits() -> tuple[np.uint64, np.ndarray]:
    """A multiplier whose product with any power of two has top six bits of its own, and their meaning."""
    bits, seen = 0, {0}
    word = [0] * 6
    while len(word) < 64 + 5:  # the greedy binary cycle in which each six bits occur once
        for bit in (1, 0):
            code = int("".join(map(str, (*word[-5:], bit))), 2)
            if code not in seen:
                seen.add(code)
                word.append(bit)
                break
        else:
            break
    for bit in word[:64]:
        bits = bits * 2 + bit
    place = np.zeros(64, np.uint8)
    for k in range(64):
        place[(bits << k & (1 << 64) - 1) >> 58] = k
    return np.uint64(bits), place


CYCLE, PLACE = lowest_bits()
#: The second round's tag for each pair of first tags (left, own).
AGAIN = np.array([[0 if x == y else 2 * (((x ^ y) & -(x ^ y)).bit_length() - 1) + (y >> (((x ^ y) & -(x ^ y)).bit_length() - 1) & 1) for y in range(128)] for x in range(128)], np.int8).ravel()


def tags(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coin tossing against the left neighbour, twice; the first of a text has its own bit as tag.

    The tag of a symbol is twice the lowest bit position where it differs from its neighbour, plus
    its own bit there. From 64-bit names one round leaves tags under 128, two leave 14.
    """
    left = np.empty_like(names)
    left[1:], left[0] = names[:-1], ~names[0]
    differ = names ^ left
    place = PLACE[((differ & (~differ + np.uint64(1))) * CYCLE) >> np.uint64(58)]
    tag = place * np.uint8(2) + ((names >> place) & np.uint64(1)).astype(np.uint8)
    tag[first] = (names[first] & np.uint64(1)).astype(np.uint8)
    pair = tag.astype(np.int16)
    pair[1:] += tag[:-1].astype(np.int16) * np.int16(128)
    out = AGAIN[pair]
    out[first] = tag[first]
    return out


def level_up(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and owners of the phrases of a sequence of names; texts stand one after another."""
    if not len(names):
        return names, owner
    # Runs of one name become a name that tells the run's length, so neighbours differ.
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(names))).astype(np.uint64)
    names, owner = mixed(names[at] + length * np.uint64(0x9E3779B97F4A7C15)), owner[at]
    first = np.ones(len(names), bool)
    first[1:] = owner[1:] != owner[:-1]
    t = tags(names, first)
    before, after = np.full(len(t), -1, np.int8), np.full(len(t), -1, np.int8)
    before[1:], after[:-1] = t[:-1], t[1:]
    # Names of a round may coincide by chance at a border only; a plateau's left end counts.
    top = (t > before) & (t >= after)
    top |= first
    at = np.flatnonzero(top)
    place = np.arange(len(names)) - np.repeat(at, np.diff(np.append(at, len(names))))
    # A phrase's name: a polynomial hash of its members by place.
    salt = mixed(np.arange(1, int(place.max()) + 2, dtype=np.uint64))
    return mixed(sums(mixed(names + salt[place]), at)), owner[at]


def parse(texts: list[str], levels: int = LEVELS) -> list[list[np.ndarray]]:
    """For each level, from the first, the phrase names of every text in order."""
    data = "".join(texts).encode("utf-32-le", "surrogatepass")
    names = mixed(np.frombuffer(data, np.uint32).astype(np.uint64) + np.uint64(1))
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    out = []
    for _ in range(levels):
        names, owner = level_up(names, owner)
        out.append(np.split(names, np.searchsorted(owner, np.arange(1, len(texts)))) if texts else [])
    return out


def sketch(names: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """The ``kept`` least distinct hashes of the names."""
    return np.unique((mixed(names) >> np.uint64(32)).astype(np.uint32))[:kept]


def written(sketches: list[np.ndarray]) -> str:
    """The sketches from the highest level down, with a dot between levels."""
    return ".".join(s.astype(">u4").tobytes().hex() for s in sketches)


def read(fingerprint: str) -> list[np.ndarray]:
    return [np.frombuffer(bytes.fromhex(part), ">u4").astype(np.uint32) for part in fingerprint.split(".")]


def likeness(a: list[np.ndarray], b: list[np.ndarray], kept: int = KEPT) -> float:
    """Estimated Jaccard similarity of the phrase sets; 1 for two texts without phrases.

    The highest level counts of which both texts have ENOUGH names, or else the lowest that both keep.
    """
    level = next((k for k, (x, y) in enumerate(zip(a, b)) if min(len(x), len(y)) >= ENOUGH), min(len(a), len(b)) - 1)
    x, y = a[level], b[level]
    if not len(x) and not len(y):
        return 1.0
    both = np.union1d(x, y)
    if max(len(x), len(y)) >= kept:  # beyond the least names a full sketch knows nothing
        both = both[:kept]
    return float(len(np.intersect1d(np.intersect1d(x, y, True), both, True)) / len(both))


def fingerprints(texts: list[str]) -> list[list[np.ndarray]]:
    out: list[list[np.ndarray]] = []

    def add(held: list[str]) -> None:
        levels = parse(held)
        out.extend([sketch(names[k]) for names in levels[:: -1 if len(t) < SHORT else -len(levels)]] for k, t in enumerate(held))

    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= AT_ONCE:
            add(held)
            held, size = [], 0
    add(held)
    return out


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` of every whole text; a null text counts as empty, whose fingerprint has no names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = fingerprints([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(written, got), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, parts: int | None = None) -> tuple[DataFrame, int]:
    """Rows of ``docs(doc_id, text)`` dealt into ranges of falling id, each range with the row after its last.

    Returns ``(part, guest, doc_id, tie, text)`` and the number of ranges. Scans find the borders,
    the count of null ids and the first row of each range; of these the driver holds one a range.
    ``tie`` is a hash of the text and orders rows of one id: an id that fills several ranges by its
    repeats is dealt among them by it, and so are rows without an id, which come last. A range's
    guest is the first row of the next range, the last range's that of the first.
    """
    parts = parts or 4 * shuffle_partitions(docs.sparkSession)
    rows, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    shares = [k / parts for k in range(1, parts)]
    borders = np.array(sorted(int(b) for b in docs.where("doc_id is not null").approxQuantile("doc_id", shares, 0.2 / parts)) if shares else [], np.int64)
    hot = sorted({int(b) for b, n in zip(*np.unique(borders, return_counts=True)) if n > 1})
    null_parts = max(1, -(-nulls * parts // max(1, rows)))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, ties: pd.Series) -> pd.Series:
        own = ids.to_numpy(np.int64)
        right = np.searchsorted(borders, own, "right")
        spread = np.where(np.isin(own, hot), right - np.searchsorted(borders, own, "left") + 1, 1)
        return pd.Series(len(borders) - right + (ties.to_numpy(float) * spread).astype(np.int64))

    placed = docs.withColumn("tie", F.pmod(F.xxhash64("text"), F.lit(1 << 32)) / float(1 << 32))
    at_null = (F.floor(F.col("tie") * null_parts) + len(borders) + 1).cast("int")
    placed = placed.withColumn("part", F.when(F.col("doc_id").isNull(), at_null).otherwise(part_of(F.coalesce("doc_id", F.lit(0)), "tie")))
    heads = placed.groupBy("part").agg(F.max_by(F.struct("doc_id", "tie"), F.struct(F.col("doc_id").isNotNull(), "doc_id", -F.col("tie"))).alias("head")).collect()
    order = sorted(r["part"] for r in heads)
    before = {p: order[k - 1] for k, p in enumerate(order)}  # the range before, in a circle
    seats = docs.sparkSession.createDataFrame([(r["head"]["doc_id"], r["head"]["tie"], r["part"], before[r["part"]]) for r in heads], "doc_id long, tie double, part int, seat int")
    # Of rows that tie for a range's first place the one of the least text is its first row.
    firsts = placed.alias("row").join(F.broadcast(seats.alias("head")), (F.col("row.part") == F.col("head.part")) & F.equal_null(F.col("row.doc_id"), F.col("head.doc_id")) & (F.col("row.tie") == F.col("head.tie")))
    guests = firsts.groupBy(F.col("head.seat").alias("part")).agg(F.min("row.text").alias("text"))
    guests = guests.select("part", F.lit(True).alias("guest"), F.lit(None).cast("long").alias("doc_id"), F.lit(0.0).alias("tie"), "text")
    return placed.select("part", F.lit(False).alias("guest"), "doc_id", "tie", "text").union(guests), len(order)


def edited_pairs(rows: Iterator[tuple[int, bool, int | None, str]]) -> Iterator[tuple[int | None, str, str]]:
    """From rows in order of (part, guest, falling id): each id with its text and its next document's text."""
    held = None
    for part, guest, doc_id, text in rows:
        if held is not None and held[0] == part and not held[3]:
            yield held[1], held[2], text
            held = None if guest else held
        if not guest:
            held = (part, doc_id, text, False)
        elif held is not None:
            held = None


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they and the next text's are.

    The edited text is the text with its last floor(n / 2) code points replaced by the first as
    many (or all) of the next document in order of falling id; the last is followed by the first.
    A null text counts as empty. Rows that repeat an id follow each other by a hash of the text and
    then by the text, and so do rows with a null id, which come last. A single row is its own
    next. Other columns are not read.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    seated, parts = with_next(texts)
    spread = max(parts, shuffle_partitions(docs.sparkSession))
    seated = seated.repartition(spread, "part").sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "tie", "text").drop("tie")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))

        def told(held: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in held]
            own, changed = fingerprints([t for _, t, _ in held]), fingerprints(edited)
            # The next text's fingerprint is the next row's own, except at the end of a stretch.
            after = [own[k + 1] if k + 1 < len(held) and held[k + 1][1] is held[k][2] else fingerprints([held[k][2]])[0] for k in range(len(held))]
            columns = [
                [i for i, _, _ in held], [len(t) for _, t, _ in held], [sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
                [*map(written, own)], [*map(written, changed)], [likeness(a, b) for a, b in zip(own, changed)], [likeness(a, b) for a, b in zip(own, after)],
            ]
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        held, size = [], 0
        for pair in edited_pairs(rows()):
            held.append(pair)
            size += len(pair[1])
            if size >= AT_ONCE:
                yield told(held)
                held, size = [], 0
        if held:
            yield told(held)

    return seated.mapInArrow(run, schema)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
