"""License scan, fingerprints, token counts, BPE coding: against plain versions and the libraries."""

import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tallyspark.llm.fingerprints import compare_edited, fingerprint_documents, likeness, parse, read, with_next
from tallyspark.llm.license_scan import Template, scan_licenses, templates
from tallyspark.llm.token_counts import PrefixCounts, count_tokens
from tallyspark.llm.word_bpe import TrieEncoder, encode_documents

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    "", "  a   b \n\n c  ", "aaa aaaa aaaaaaaaaaaaaaaa", "<|endoftext|>hi <|endoftext|>", "we're 'll x'rex 'r", "İstanbul ΑΣ ΑΣΑ ß K", "日本語のテキスト 12³½", "\x1c\x1d a\x85b　c",
    "😀😀👍🏽 x", "éé", "<|startoftext|> a <|endoftext|>b", "!!!!!!!!???///", "\r\n\t  x", "\n\nc",
]
CLASH = "doc_id long, text string, n_tokens string, fingerprint int, words string, row int, labels string, n int, rep int, score int"


def frame(spark, rows):
    """Rows of (id, text) beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "x", 1, "x", 1, 1, 1) for i, t in rows], CLASH)


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("aabbcc  eesstth'\n!?.,é日ß0123-ÀΣ́") for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_token_counts(spark):
    texts = [*ODD, *random_texts(300), "long " * 40_000]
    library = Tokenizer.from_file(BYTE)
    rows = [*enumerate(texts), (None, "a b"), (3, None), (0, texts[0])]
    got = sorted((tuple(r) for r in count_tokens(frame(spark, rows), BYTE, 20).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str)
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == sorted(((i, len((t or "").encode()), k, k > 20) for (i, t), k in zip(rows, n)), key=str)
    assert count_tokens(frame(spark, []), BYTE).count() == 0


def test_every_prefix_has_its_exact_count():
    library, counter = Tokenizer.from_file(BYTE), PrefixCounts(BYTE)
    for text in [*ODD, *random_texts(120, 2)]:
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert counter.prefix(text) == want
        pieces = counter.pieces(text)
        for budget in (1, 3, 7):
            assert counter.fit(pieces, counter.running(pieces), budget) == max(k for k, c in enumerate(want) if c <= budget), (text, budget)


def test_bpe_coding(spark):
    texts = [*ODD, *random_texts(300, 3), "word " * 20_000]
    library = Tokenizer.from_file(WORD)
    rows = [*enumerate(texts), (None, "a b"), (3, None), (0, texts[0])]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    got = encode_documents(frame(spark, rows), WORD)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    kept = encode_documents(frame(spark, [(1, "Hello world")]), WORD, keep=True).first()
    assert kept.ids == library.encode("Hello world", add_special_tokens=False).ids and kept.decoded == "hello</w> world</w>"
    assert encode_documents(frame(spark, []), WORD).count() == 0


def every_code_point():
    """Texts that hold each code point as a letter, before a contraction, and beside marks; of the long runs of one kind every 13th, of empty planes every 211th."""
    same = [range(0x3400, 0x9FC0), range(0xAC00, 0xD7A0), range(0xE000, 0xF900), range(0x17000, 0x18700), range(0x20000, 0x33400)]
    points = [p for p in range(0x33480) if not 0xD800 <= p < 0xE000 and (p % 13 == 0 or not any(p in r for r in same))]
    points += [*range(0x33480, 0x110000, 211), *range(0xE0000, 0xE0200)]
    for at in range(0, len(points), 64):
        cs = [chr(p) for p in points[at : at + 64]]
        yield " ".join(f"{c}'s {c}{c}1 a{c}\u0334b{c}\u0323 c\u0301{c}" for c in cs)


def test_letters_are_those_of_the_library():
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    counter, coder = PrefixCounts(BYTE), TrieEncoder(WORD)
    texts = [*every_code_point(), "\U00011935\U00011930x \U00011938", "\u1c89\ua7cb\U00010d50's \U0001391A's", "\u0301\U00016d63\U00016d67"]
    for at in range(0, len(texts), 400):
        part = texts[at : at + 400]
        pieces = [*map(counter.pieces, part)]
        counter.learn(pieces)
        assert [counter.running(p)[-1] for p in pieces] == [len(e.ids) for e in byte.encode_batch(part, add_special_tokens=False)]
        words = [*map(coder.split, part)]
        known = dict(coder.walk({w for ws in words for w in ws}))
        for text, ws, e in zip(part, words, word.encode_batch(part, add_special_tokens=False)):
            ids = [i for w in ws for i in known[w]]
            assert ids == e.ids, text
            assert coder.decode(ids) == word.decode(e.ids, skip_special_tokens=False)


def test_trie_shares_prefixes():
    coder, asked = TrieEncoder(WORD), []
    last_start = coder.merges.last_start
    coder.merges.last_start = lambda word, end, last, mark="": asked.append(end) or last_start(word, end, last, mark)
    try:
        words = ["internal", "international", "internationals", "interval"]
        got = dict(coder.walk(words))
    finally:
        coder.merges.last_start = last_start
    assert len(asked) < sum(map(len, words))
    assert all(list(ids) == coder.encode(w) for w, ids in got.items())


def plain_scan(text, known, percent=80):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, base, labels, score, blocks = set(), set(), set(), 0.0, 0
    stands = lambda t, i: tuple(words[i : i + len(t.words)]) == t.words
    for t in known:
        if t.base:
            here = {(i, t.words) for i in range(len(words)) if stands(t, i)}
            places |= here
            base |= {t.label} if here else set()
    for s in range(0, len(words), 32):
        block = {*words[s : s + 64]}
        for t in known:
            inside = len({*t.words} & block)
            if inside >= t.need(percent) and (not t.base or any(stands(t, k) for k in range(s, min(s + 64, len(words)) - len(t.words) + 1))):
                labels.add(t.label)
                score, blocks = max(score, inside / len({*t.words})), blocks + 1
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, blocks


def test_license_scan(spark):
    rng, known = random.Random(4), templates()
    texts = ["the MIT license. Under\nthe MIT   License; apache license version 2.0 CC BY-NC under the mit license", "é " * 100 + "Under the MIT license", "x " * 31 + "under the mit license", "", None, "İ under the mit licenseK", "cc by nc " * 3000]
    for t in known:
        words = [w for w in t.words if rng.random() < 0.9]
        rng.shuffle(words)
        texts.append("a b c " * rng.randint(0, 20) + " ".join(words) + " d e" * rng.randint(0, 20))
    rows = [*enumerate(texts), (None, texts[0]), (0, texts[0])]
    got = sorted((tuple(r) for r in scan_licenses(frame(spark, rows)).collect()), key=str)
    assert got == sorted(((i, *plain_scan(t, known)) for i, t in rows), key=str)
    assert sum(bool(r[6]) for r in got) > 15
    assert scan_licenses(frame(spark, [])).count() == 0
    assert scan_licenses(frame(spark, [(1, "q r s")]), known=[Template(("q", "r"), "own", True)]).first().base_labels == "own"
    # A template of any length: the blocks grow with it.
    long = Template(tuple(f"w{k}" for k in range(500)), "long", False)
    texts = [" ".join([*["x"] * 333, *(w for k, w in enumerate(long.words) if k % gap), *["y"] * 99]) for gap in (4, 6)]
    assert [r.labels for r in scan_licenses(frame(spark, [*enumerate(texts)]), known=[long]).orderBy("doc_id").collect()] == ["", "long"]


MASK = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_toss(left, own):
    """Twice the lowest place where two numbers differ, plus the own bit there."""
    k = ((left ^ own) & -(left ^ own)).bit_length() - 1
    return 2 * k + (own >> k & 1) if k >= 0 else 0


def plain_levels(text):
    names, out = [plain_mix(ord(c) + 1) for c in text], []
    for _ in range(3):
        runs = [(k, len([*g])) for k, g in itertools.groupby(names)]
        names = [plain_mix((k + n * 0x9E3779B97F4A7C15) & MASK) for k, n in runs]
        once = [names[0] & 1] + [plain_toss(x, y) for x, y in itertools.pairwise(names)] if names else []
        tags = once[:1] + [plain_toss(x, y) for x, y in itertools.pairwise(once)]
        starts = [k for k, t in enumerate(tags) if k == 0 or (t > tags[k - 1] and (k + 1 == len(tags) or t >= tags[k + 1]))]
        phrases = [names[x:y] for x, y in zip(starts, [*starts[1:], len(names)])]
        names = [plain_mix(sum(plain_mix((n + plain_mix(k + 1)) & MASK) for k, n in enumerate(p)) & MASK) for p in phrases]
        out.append({plain_mix(n) >> 32 for n in names})
    return out[::-1] if len(text) < 2_000 else out[2:]


def plain_likeness(x, y):
    """Exact Jaccard similarity of phrase sets; only for texts whose sketches hold all their phrases."""
    levels = [*zip(plain_levels(x), plain_levels(y))]
    a, b = next((ab for ab in levels if min(map(len, ab)) >= 12), levels[-1])
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_edited(rows):
    tie = lambda i, t: xxhash.xxh64_intdigest((t or "").encode(), 42) % (1 << 32)
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie(*r), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(plain_likeness(t, edited), 9), round(plain_likeness(t, after), 9)))
    return sorted(out, key=str)


SENTENCE = "the quick brown fox jumps over the lazy dog while seventeen other animals look on and say nothing at all about it "
TABLES = [
    [(1, "abc")], [(None, None), (None, "x" * 10), (5, "hello wörld"), (5, "aaa"), (7, ""), (5, "hello wörld")], [], [(3, "q" * 5), (2, "z"), (9, "😀" * 7)],
    [(k, f"text {k} " * k) for k in range(60)], [(k, SENTENCE[k:] + SENTENCE[: k * 3] + str(k)) for k in range(40)],
    [(5, f"{k} {SENTENCE[k % 90 :]}") for k in range(300)] + [(5, SENTENCE)] * 50 + [(k, SENTENCE[:k]) for k in range(40)] + [(None, f"{k} null") for k in range(90)],
]


@pytest.mark.parametrize("rows", TABLES)
def test_edited_texts(spark, rows):
    got = compare_edited(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str) == plain_edited(rows)
    for r in got[:50]:
        assert r.doc_id is None or r.fingerprint in {".".join("".join(f"{h:08x}" for h in sorted(level)) for level in plain_levels(t or "")) for i, t in rows if i == r.doc_id}


def test_hot_ids_are_dealt(spark):
    rows = TABLES[-1]
    placed, parts = with_next(frame(spark, rows).selectExpr("doc_id", "coalesce(text, '') AS text"), 16)
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert parts > 12 and max(sizes) < 130 and placed.where("guest").count() == parts


def test_fingerprints_are_local(spark):
    rng = np.random.default_rng(1)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    a, other = text(4000), text(4000)
    names, shifted = parse([a, "prefix of odd length" + a])[-1]
    assert len({*names} & {*shifted}) >= len({*names}) - 4
    rows = [(1, a), (2, a), (3, a[:2000] + other[:2000]), (4, other), (5, None), (6, ""), (7, "z" * 5000)]
    got = {r.doc_id: r.fingerprint for r in fingerprint_documents(frame(spark, rows)).collect()}
    near = lambda x, y: likeness(read(got[x]), read(got[y]))
    assert got[1] == got[2] and got[5] == got[6] == ".." and near(1, 2) == 1
    assert 0.15 < near(1, 3) < 0.55 and near(1, 4) < 0.1
