"""BPE encoding and decoding through a trie of distinct words.

The distinct words of a batch are visited in the depth-first order of their trie (their sorted
order): a stack keeps the last-token state of every prefix on the path from the root, so a
prefix that several words share is computed once. Decoding maps ids back to the vocabulary.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import END, Pieces, letters, merges, shared_prefix
from .common import Remembered, give_back, table

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Stands between a word's ids and its decoded tokens, which never hold it, in the memo of words.
THEN = "\0"


class TrieEncoder:
    """Encoder of a lower-casing word-level BPE vocabulary with an end-of-word suffix."""

    def __init__(self, path: str):
        self.merges = merges(path)
        self.find = Pieces("'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+")
        special = "|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True)))
        self.special = re.compile(f"({special})") if special else None
        self.names = {v: k.replace(END, self.merges.suffix) for k, v in self.merges.ids.items()} | {v: k for k, v in self.merges.special.items()}
        self.words = Remembered(lambda w: self.told(next(self.walk([w]))[1]), 150_000)

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Ids of each distinct word, in the order of the words' trie."""
        m = self.merges
        ids, before, nodes, rights, starts = m.ids, "", [m.root], [{}], [0]
        for symbols, word in sorted([(m.symbols(w) + END, w) for w in words]):
            shared = shared_prefix(before, symbols)
            del nodes[shared + 1 :], rights[shared + 1 :], starts[shared + 1 :]
            m.extend(symbols, nodes, rights, starts)
            out, at = [], len(symbols)
            while at:
                end, at = at, starts[at]
                out.append(ids[symbols[at:end]])
            before = symbols
            yield word, tuple(out[::-1])

    def split(self, text: str) -> list[str]:
        """Words of a text; a special token in it is a word of its own."""
        if self.special is None or not any(s in text for s in self.merges.special):
            return self.find(self.normal(text))
        return [w for k, part in enumerate(self.special.split(text)) for w in ((part,) if k % 2 else self.find(self.normal(part)))]

    def normal(self, text: str) -> str:
        """NFC, then each code point's own lower case (no context rules)."""
        if text.isascii():
            return text.lower()
        known = letters()
        if known.strange(text):
            return "".join(known.lower.get(c) or c.lower() for c in known.composed(text))
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the words of a batch that are not known yet, over one trie."""
        known, special = self.words, self.merges.special
        for word, ids in self.walk([w for w in set().union(*texts) if w not in known and w not in known.old and w not in special]):
            known.put(word, self.told(ids))

    def told(self, ids: tuple[int, ...]) -> str:
        """The ids, THEN, the decoded tokens."""
        return " ".join(map(str, ids)) + THEN + self.decode(ids)

    def encode(self, text: str) -> list[int]:
        special = self.merges.special
        words = self.split(text)
        known = dict(self.walk({w for w in words if w not in special}))
        return [i for w in words for i in ((special[w],) if w in special else known[w])]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens as the vocabulary writes them, joined by spaces; special tokens are kept."""
        names = self.names
        return " ".join([names[i] for i in ids if i in names])


def encode_documents(docs: DataFrame, tokenizer: str, keep: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: count of ids and digests of both directions.

    With ``keep`` the ids themselves (``ids`` array) and the decoded text come as well. A null
    text counts as empty: no ids, and the digests of the empty string. Null ids stay null,
    repeated rows give a row each, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        coder = TrieEncoder(tokenizer)
        special = {k: coder.told((v,)) for k, v in coder.merges.special.items()}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [coder.split(t or "") for t in batch.column(1).to_pylist()]
                coder.learn(texts)
                counts, ids, plain = [], [], []
                for words in texts:
                    got = [special.get(w) or coder.words[w] for w in words] if not special.keys().isdisjoint(words) else list(map(coder.words.__getitem__, words))
                    cells = THEN.join(got).split(THEN) if got else []
                    ids.append(" ".join(cells[::2]))
                    plain.append(" ".join(cells[1::2]))
                    counts.append(ids[-1].count(" ") + 1 if got else 0)
                digest = lambda xs: pa.array([sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in xs], pa.string())
                columns = {"doc_id": batch.column(0).cast(pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": digest(ids), "decoded_sha256": digest(plain)}
                if keep:
                    columns |= {"ids": pa.array([[int(i) for i in x.split()] for x in ids], pa.list_(pa.int32())), "decoded": pa.array(plain, pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    schema = SCHEMA + (", ids array<int>, decoded string" if keep else "")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def op7_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
