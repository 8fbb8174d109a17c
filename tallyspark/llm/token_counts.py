"""Token counts of every prefix of a text, by dynamic programming over prefixes.

``PrefixCounts`` holds, for a byte-level BPE vocabulary, the exact count of tokens at every
prefix of a text in two levels: the running count at each piece of the pre-tokenizer, and for
each distinct piece the counts at all its own prefixes. Questions about truncation and budgets
read these tables and never encode again.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import Pieces, classes, merges, shared_prefix
from .common import Remembered, give_back, table

#: Contractions that the pre-tokenizer takes as pieces of their own.
SHORT = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"


PATTERN = "|".join(SHORT) + "| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"


class PrefixCounts:
    """Exact token counts of prefixes under one vocabulary file."""

    def __init__(self, path: str):
        self.merges = merges(path)
        self.find = Pieces(PATTERN)
        self.space = re.compile(rf"[{classes()['S']}]+\Z")
        special = "|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True)))
        self.special = re.compile(f"({special})") if special else None
        self.whole = Remembered(self._count, 150_000)

    def walk(self, pieces: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each piece with the tokens of all its prefixes, by bytes; the DP of this module.

        Pieces come in order, so what one shares with the piece before it is not counted again.
        The list is the next piece's too: read it before going on.
        """
        m = self.merges
        before, nodes, rights, starts, counts = "", [m.root], [{}], [0], [0]
        for word, piece in sorted((m.symbols(p), p) for p in pieces):
            shared = shared_prefix(before, word)
            del nodes[shared + 1 :], rights[shared + 1 :], starts[shared + 1 :], counts[shared + 1 :]
            m.extend(word, nodes, rights, starts)
            for start in starts[shared + 1 :]:
                counts.append(counts[start] + 1)
            before = word
            yield piece, counts

    def byte_counts(self, piece: str) -> list[int]:
        """Tokens of every prefix of one piece, by bytes."""
        return next(self.walk([piece]))[1]

    def _count(self, piece: str) -> int:
        return self.byte_counts(piece)[-1]

    def learn(self, texts: list[list[str]]) -> None:
        """Count the pieces of many texts that are not known yet, together."""
        whole, special = self.whole, self.merges.special
        for piece, counts in self.walk([p for p in set().union(*texts) if p not in whole and p not in whole.old and p not in special]):
            whole.put(piece, counts[-1])

    def char_counts(self, piece: str) -> list[int]:
        """As ``byte_counts``, at the piece's code points."""
        counts = self.byte_counts(piece)
        return [counts[n] for n in accumulate((len(c.encode("utf-8", "surrogatepass")) for c in piece), initial=0)]

    def pieces(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.merges.special):
            return self.find(text)
        return [p for k, part in enumerate(self.special.split(text)) for p in ((part,) if k % 2 else self.find(part))]

    def running(self, pieces: list[str]) -> list[int]:
        """Tokens at the end of each piece."""
        whole, special = self.whole, self.merges.special
        if self.special is not None and not special.keys().isdisjoint(pieces):
            return list(accumulate(1 if p in special else whole[p] for p in pieces))
        return list(accumulate(map(whole.__getitem__, pieces)))

    def prefix(self, text: str) -> list[int]:
        """Tokens of ``text[:k]`` for every k from 0 to the length: the whole table, for one text."""
        out, done, pieces = [0], 0, self.pieces(text)
        at = 0
        for k, piece in enumerate(pieces):
            if piece in self.merges.special:
                out += [self.running(self.pieces(text[: at + i]))[-1] for i in range(1, len(piece))] + [done + 1]
            else:
                inside = self._inside(piece)
                run = self.space.search(pieces[k - 1]) if k and piece[0].isspace() else None
                if run is not None:  # white space so far is one piece at the end of a prefix
                    before = pieces[k - 1][: run.start()]
                    base = done - self.whole[pieces[k - 1]] + (self.whole[before] if before else 0)
                    inside[1] = base + self.whole[run.group() + piece[0]] - done
                out += [done + x for x in inside[1:]]
            done, at = out[-1] if piece in self.merges.special or len(piece) > 1 else done + self.whole[piece], at + len(piece)
        return out

    def _inside(self, piece: str) -> list[int]:
        """Counts within a piece as prefixes of a text see it: a cut contraction is two pieces."""
        counts = self.char_counts(piece)
        if piece in SHORT and len(piece) == 3:
            counts[2] = self.whole[piece[0]] + self.whole[piece[1]]
        return counts

    def fit(self, pieces: list[str], running: list[int], budget: int) -> int:
        """The most leading code points that cost at most ``budget`` tokens, from the stored counts."""
        k = bisect_right(running, budget)
        chars = sum(map(len, pieces[:k]))
        if k == len(pieces):
            return chars
        if pieces[k] in self.merges.special:  # cut short, it is ordinary text
            before, tail = (running[k - 2] if k > 1 else 0), pieces[k - 1] if k else ""
            return chars + max((i for i in range(1, len(pieces[k])) if before + self.running(self.pieces(tail + pieces[k][:i]))[-1] <= budget), default=0)
        done, inside = (running[k - 1] if k else 0), self._inside(pieces[k])
        best = max((i for i, n in enumerate(inside[:-1]) if done + n <= budget), default=0)
        for j, ahead in ((k, 0), (k + 1, len(pieces[k]))):  # white space so far is one piece at the end of a prefix
            if 0 < j < len(pieces) and pieces[j][0].isspace() and (run := self.space.search(pieces[j - 1])) and not run.start():
                before = running[j - 2] if j > 1 else 0
                if before + self.whole[pieces[j - 1] + pieces[j][0]] <= budget:
                    best = max(best, ahead + 1)
        return chars + best


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact tokens of every whole text, and how many leading code points fit ``limit``.

    A null text counts as empty: 0 bytes, 0 tokens, 0 characters. A null id stays null, repeated
    rows give a row each, columns other than the two named are not read. Texts of any length are
    handled whole; memory is bounded by one Arrow batch and by a memo of distinct pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        counter = PrefixCounts(tokenizer)
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            rows = []
            texts = [text or "" for text in batch.column(1).to_pylist()]
            cut = [*map(counter.pieces, texts)]
            counter.learn(cut)
            for text, pieces in zip(texts, cut):
                running = counter.running(pieces)
                n = running[-1] if running else 0
                rows.append((len(text.encode("utf-8", "surrogatepass")), n, n > limit, len(text) if n <= limit else counter.fit(pieces, running, limit)))
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
