"""Surrogates for personal data: keyed replacements of the same type, shape and script.

Entities are compared by a canonical form: an address in lower case, a number's digits, a name
without its title. A surrogate depends on the key and the canonical form alone and is written in
the format that was found, so all spellings of an entity change alike, wherever they stand.
Shaped entities (addresses, numbers, keys) go through a keyed permutation of all strings of their
shape; names get a given name of the same gender and a new surname in the same script, the surname
drawn by the surname and the given name by the given name. A pass over the distinct entities of
all texts checks that no two share a surrogate and that no surrogate is itself an entity of the
texts; those that clash draw again.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import cut, give_back, shuffle_partitions, table

#: Redrawn entities that the driver may hold and send to the tasks; more are joined to their texts.
HELD = 50_000
#: From this draw on a surrogate grows by a character each time, so that small shapes cannot run out.
GROWS = 4
#: Titles by gender; n where a title tells none.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "señor": "m", "señora": "f", "Monsieur": "m", "Madame": "f",
    "господин": "m", "госпожа": "f", "Господин": "m", "Госпожа": "f", "κύριος": "m", "κυρία": "f", "Κύριος": "m", "Κυρία": "f",
}
#: Given names by script and gender, and syllables that surnames are made of.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Max Noah Oscar Paul".split(),
    ("latin", "f"): "Ada Bella Clara Diana Emma Flora Greta Hanna Ida Julia Klara Lena Mia Nora Olga Paula".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия".split(),
    ("greek", "m"): "Αλέξης Βασίλης Γιώργος Δημήτρης Κώστας Λεωνίδας Μιχάλης Νίκος".split(),
    ("greek", "f"): "Άννα Βάσω Γεωργία Δήμητρα Ελένη Κατερίνα Μαρία Σοφία".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са".split(),
    "greek": "βα βε γα γο δα δε κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε".split(),
}
#: Last letters of given names that are made up.
ENDS = {("latin", "m"): "n", ("latin", "f"): "la", ("cyrillic", "m"): "н", ("cyrillic", "f"): "ла", ("greek", "m"): "ν", ("greek", "f"): "λα"}
#: The least octet of so many digits, and how many there are.
OCTETS = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
#: Alphabets that a permutation keeps a character within.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", *("".join(map(chr, r)) for r in ([*range(0xDF, 0xF7), *range(0xF8, 0x100)], [*range(0xC0, 0xD7), *range(0xD8, 0xDF)], range(0x3B1, 0x3C2), range(0x430, 0x450), range(0x410, 0x430)))]
#: Hexadecimal digits of lower case, of upper case, and of both in one value.
HEX = ["0123456789abcdef"], ["0123456789ABCDEF"], ["0123456789", "abcdef", "ABCDEF"]
#: The first digit of a card.
CARD_FIRST = "3456"


def places(alphabets: list[str]) -> dict[str, tuple[int, int]]:
    return {c: (a, i) for a, letters in enumerate(alphabets) for i, c in enumerate(letters)}


PLACE, HEX_PLACE = places(ALPHABETS), [places(h) for h in HEX]
#: Letters of European scripts by case.
UPPER, LOWER = ("".join(c for c in map(chr, range(0x41, 0x530)) if test(c)) for test in (str.isupper, str.islower))
NAME = f"[{UPPER}](?:['’][{UPPER}])?[{LOWER}]+(?:[-'’][{UPPER}]?[{LOWER}]+)*"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What is found, in order of precedence. Each pattern reads a text in linear time.
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]++@[\w-]++(?:\.[\w-]++)+",
    "key": r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)|(?<!\w)[0-9A-Fa-f]{40}(?!\w)|(?<!\w)gh[pousr]_[0-9A-Za-z]{36,255}(?!\w)|(?<![\w-])sk-[0-9A-Za-z_-]{20,200}(?![\w-])",
    "ip": rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\w)|(?<![\w:.])(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}[0-9A-Fa-f]{{0,4}}(?![\w:])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w+-])(?:[3-6]\d{3}(?P<four>[ -]?)\d{4}(?:(?P=four)\d{4}){2}|3[47]\d{2}(?P<six>[ -]?)\d{6}(?P=six)\d{5})(?!-?\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w(+-])(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\w-])|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?![\w-])",
    "name": rf"(?<!\w)(?:{'|'.join(TITLES)})\.? {NAME}(?: (?!(?:{'|'.join(TITLES)})\b){NAME})?",
}
FIND = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items()))
HINT = re.compile(rf"@|\d{{3}}|\d\.\d|AKIA|\+\d|:[0-9A-Fa-f]{{0,4}}:|gh[pousr]_|sk-|(?<!\w)[A-Z]{{2}}\d\d ?[A-Z0-9]|(?<!\w)[0-9A-Fa-f]{{40}}|(?:{'|'.join(TITLES)})\.? \w")
#: What stands before a hexadecimal key: a name, and any spacing, quotes and separator.
NAMED = re.compile(r"(?:token|key|secret)[\w-]*[\\\"'`\])]*\s*(?::=|=>|->|[:=])?\s*[\\\"'`(\[]*\Z", re.IGNORECASE)
#: Accounts in whole groups of four are taken even if their check digits are wrong.
WHOLE_GROUPS = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?!\w)")

NEW_COLUMNS = [StructField("n_entities", LongType()), StructField("kinds", StringType())]


def iban_check(value: str) -> str:
    """The two check digits that an account number should have."""
    bare = value.replace(" ", "")
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{bare[4:]}{bare[:2]}00')) % 97:02d}"


def valid_iban(value: str) -> bool:
    return 15 <= len(value.replace(" ", "")) <= 34 and value[2:4] == iban_check(value)


def ipv6(value: str) -> bool:
    """An address of version 6 with three groups at least and a digit; less may be a name in a program."""
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return len(re.findall(r"\w+", value)) > 2 and re.search(r"\d", value) is not None


def found_end(m: re.Match, kind: str) -> int:
    """Where a match really ends; its start if it is none.

    An account ends where its check digits hold, since words in capitals may follow it. Forty
    hexadecimal digits are a key if a name of one stands before them.
    """
    text, start, end = m.string, m.start(), m.end()
    if kind == "key" and end - start == 40 and "_" not in m.group() and "-" not in m.group():
        return end if NAMED.search(text[max(0, start - 100) : start]) else start
    if kind == "ip" and ":" in m.group():
        return end if ipv6(m.group()) else start
    if kind == "iban":
        at = end
        while at > start:
            if valid_iban(text[start:at]):
                return at
            at = text.rfind(" ", start, at)
        plain = WHOLE_GROUPS.match(text, start)
        return plain.end() if plain else start
    return end


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, value)`` of each entity, left to right."""
    if not text or not HINT.search(text):
        return []
    out, again = [], 0
    while again is not None:
        at, again = again, None
        for m in FIND.finditer(text, at):
            kind = m.lastgroup if m.lastgroup in PATTERNS else "card"
            start, end = m.start(), found_end(m, kind)
            if end > start:
                out.append((start, end, kind, text[start:end]))
            if end < m.end():
                again = max(end, start + 1)
                break
    return out


def named_parts(value: str) -> tuple[str, str, str]:
    """A name's title with the space after it, its given name or nothing, and its surname."""
    title, _, name = value.partition(" ")
    given, _, surname = name.rpartition(" ")
    return title + " ", given, surname


def canonical(kind: str, value: str) -> str:
    """What all spellings of one entity have in common.

    A phone's last ten digits, without a country's that stand apart, are its own, and those before
    them stay; a name has its gender, from the title or a known given name.
    """
    if kind == "email":
        return value.lower()
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "phone":
        return re.sub(r"\D", "", re.sub(r"^\+\d{1,3}(?=\D)", "", value))[-10:]
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "name":
        title, given, surname = named_parts(value)
        if not given:
            return f"||{surname}"
        known = {g for (_, g), names in GIVEN.items() if given in names}
        return f"{known.pop() if len(known) == 1 else TITLES[title.rstrip('. ')]}|{given}|{surname}"
    return value


def written_like(kind: str, value: str, image: str) -> str:
    """The image of an entity's canonical form, in the format of ``value``."""
    if kind == "email":
        grown = len(image) - len(value)
        return image[:grown] + "".join(c.upper() if old.isupper() and len(c.upper()) == 1 else c for c, old in zip(image[grown:], value))
    if kind == "name":
        _, given, surname = image.split("|")
        return named_parts(value)[0] + (f"{given} {surname}" if given else surname)
    if kind not in ("card", "ssn", "phone", "iban"):
        return image
    # Characters of the image take the places of the last ones found; those it has more come first.
    spots = [i for i, c in enumerate(value) if c.isalnum()]
    own = spots[max(0, len(spots) - len(image)) :]
    out = list(value)
    for i, c in zip(own, image[len(image) - len(own) :]):
        out[i] = c
    out.insert(own[0], image[: len(image) - len(own)])
    return "".join(out)


def draw(key: bytes, *parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), key=key, digest_size=32).digest(), "big")


def permuted(number: int, size: int, key: bytes, *parts: str) -> int:
    """A keyed permutation of 0 .. size - 1: four rounds of adding halves, walked until in range.

    The square of halves is at most about four times as large as the range for the smallest
    sizes and hardly larger for others, so walks are short.
    """
    if size < 2:
        return number
    half = isqrt(size - 1) + 1
    while True:
        a, b = divmod(number, half)
        for turn in range(4):
            a, b = b, (a + draw(key, *parts, str(turn), str(b))) % half
        number = a * half + b
        if number < size:
            return number


def luhn(digits: str) -> int:
    return sum((2 * d if d < 5 else 2 * d - 9) if k % 2 else d for k, d in enumerate(int(c) for c in reversed(digits)))


def permuted_in(spots: list[tuple[str, str]], key: bytes, *parts: str) -> list[str]:
    """The image of a string under a permutation of all that have a character of the given alphabet in each spot."""
    number, size = 0, 1
    for c, letters in spots:
        number, size = number * len(letters) + letters.index(c), size * len(letters)
    number, out = permuted(number, size, key, *parts), []
    for _, letters in reversed(spots):
        number, at = divmod(number, len(letters))
        out.append(letters[at])
    return out[::-1]


def reshaped(value: str, key: bytes, kind: str, attempt: int, keep: slice) -> str:
    """The image of ``value`` under the permutation of all strings of its shape, each character in its alphabet; ``keep`` stays."""
    hexed = kind in ("hex", "ipv6")
    case = (0 if value == value.lower() else 1 if value == value.upper() else 2) if hexed else 0
    alphabets, within = (HEX[case], HEX_PLACE[case]) if hexed else (ALPHABETS, PLACE)
    kept = {*range(len(value))[keep]}
    at = [i for i, c in enumerate(value) if c in within and i not in kept]
    shape = "".join(c if i in kept or c not in within else chr(within[c][0]) for i, c in enumerate(value))
    out = list(value)
    for i, c in zip(at, permuted_in([(value[i], alphabets[within[value[i]][0]]) for i in at], key, kind, shape, str(attempt))):
        out[i] = c
    return "".join(out)


def script_of(name: str) -> str:
    return "cyrillic" if re.search("[А-Яа-яЁё]", name) else "greek" if re.search("[Ͱ-Ͽ]", name) else "latin"


def made_up(n: int, script: str, syllables: int) -> str:
    out = ""
    for _ in range(syllables):
        n, k = divmod(n, len(SYLLABLES[script]))
        out += SYLLABLES[script][k]
    return out.capitalize()


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of a canonical form; ``attempt`` counts the clashes it has had."""
    more = max(0, attempt - GROWS + 1)
    grown = lambda letters, label: "".join(letters[draw(key, kind, label, value, str(attempt), str(k)) % len(letters)] for k in range(more))
    if kind == "name":
        gender, given, surname = value.split("|")
        script = script_of(surname)
        # A clash of whole names redraws the given name alone, so the surname stays one.
        again = "0" if given else str(attempt)
        surname = "-".join(made_up(draw(key, "surname", surname, again, str(k)), script, 3 if k else 6) for k in range(surname.count("-") + 1))
        if not given:
            return f"||{surname}"
        script, n = script_of(given), draw(key, "given", given, str(attempt))
        gender_of = gender if gender in "mf" else "mf"[n // 7 % 2]
        pool = GIVEN[script, gender_of]
        # So many clashes mean that the pool is used up for this surname.
        first = pool[n % len(pool)] if attempt < 20 else made_up(n, script, 3 + more // 20) + ENDS[script, gender_of]
        return f"{gender}|{first}|{surname}"
    if kind == "ip" and ":" not in value:
        # Octets keep their digits; where those values run out, all have three.
        octets = [(int(x), *(OCTETS[3] if more else OCTETS[len(x)])) for x in value.split(".")]
        if more:
            return ".".join(str(low + draw(key, kind, value, str(attempt), str(k)) % n) for k, (_, low, n) in enumerate(octets))
        number, size = 0, 1
        for x, low, n in octets:
            number, size = number * n + x - low, size * n
        number, out = permuted(number, size, key, kind, ".".join(str(n) for _, _, n in octets), str(attempt)), []
        for _, low, n in reversed(octets):
            number, x = divmod(number, n)
            out.append(str(low + x))
        return ".".join(reversed(out))
    if kind == "iban":
        # The check digits follow from the rest, so the rest alone is permuted.
        checked = valid_iban(value)
        out = reshaped(f"{value[:2]}00{value[4:]}" if checked else value, key, "iban checked" if checked else kind, attempt, slice(4 if checked else 2))
        return f"{out[:2]}{iban_check(out)}{out[4:]}" if checked else out
    if kind == "card":
        # The last digit follows: it keeps a valid number valid and another one as far from it.
        front = [(value[0], "3"), (value[1], "47")] if len(value) == 15 else [(value[0], CARD_FIRST)]
        spots = [*front, *((c, ALPHABETS[0]) for c in value[len(front) : -1])]
        out = "".join(permuted_in(spots, key, kind, str(len(value)), str(luhn(value) % 10), str(attempt)))
        return out + str((luhn(value) - luhn(out + "0")) % 10)
    if kind == "email":
        return grown(ALPHABETS[1], "front") + reshaped(value, key, kind, attempt, slice(value.rfind("."), None))
    if kind == "ip":
        return reshaped(value, key, "ipv6", attempt, slice(0))
    if kind == "key":
        front = re.match(r"AKIA|gh._|sk-|", value).group()
        return reshaped(value, key, kind if front else "hex", attempt, slice(len(front)))
    return grown(ALPHABETS[0], "front") + reshaped(value, key, kind, attempt, slice(0))


def replacement(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate of an entity in the format that was found."""
    return written_like(kind, value, surrogate(kind, canonical(kind, value), key, attempt))


def _distinct(docs: DataFrame) -> DataFrame:
    """Distinct ``(kind, value)`` of all texts, values in canonical form; each task drops its own repeats first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        seen: set[tuple[str, str]] = set()
        for batch in batches:
            new = {(k, canonical(k, v)) for t in batch.column(0).to_pylist() for _, _, k, v in entities(t)} - seen
            seen = seen | new if len(seen) < 200_000 else new
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in new], pa.string()) for i in (0, 1)], ["kind", "value"])

    return docs.select("text").mapInArrow(run, "kind string, value string").distinct()


def _drawn(rows: DataFrame, key: bytes, attempt: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            kinds, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([surrogate(k, v, key, attempt) for k, v in zip(kinds, values)], pa.string())], ["kind", "value", "surrogate"])

    # Entities are few bytes but much work: a fixed number of partitions is not merged into one.
    dealt = rows.select("kind", "value").repartition(shuffle_partitions(rows.sparkSession), "kind", "value")
    return dealt.mapInArrow(run, "kind string, value string, surrogate string")


def redrawn(docs: DataFrame, key: bytes) -> DataFrame:
    """``(kind, value, surrogate)`` of the entities that cannot have their first surrogate, all in canonical form.

    Names are compared without their gender. Every draw leaves only those that clash again, and
    from draw GROWS on surrogates grow, so draws end.
    """
    bare = lambda c: F.when(F.col("kind") == "name", F.regexp_replace(c, r"^[^|]*\|", "")).otherwise(F.col(c))
    found = cut(_distinct(docs))
    originals = found.select(bare("value").alias("image")).distinct()
    given = cut(_drawn(found, key, 0))
    by_image = Window.partitionBy("image").orderBy("kind", "value")

    def split(rows: DataFrame, taken: DataFrame) -> DataFrame:
        marked = rows.withColumn("image", bare("surrogate")).withColumn("turn", F.row_number().over(by_image))
        return cut(marked.join(taken.distinct().withColumn("used", F.lit(True)), "image", "left").select("kind", "value", "surrogate", ((F.col("turn") > 1) | F.coalesce("used", F.lit(False))).alias("clash")))

    marked = split(given, originals)
    fine, waiting, out, attempt = marked.where("not clash").select(bare("surrogate").alias("image")), marked.where("clash"), None, 0
    while not waiting.isEmpty():
        attempt += 1
        if attempt > 200:
            raise RuntimeError("surrogates keep clashing")
        marked = split(_drawn(waiting, key, attempt), originals.union(fine))
        good = marked.where("not clash").select("kind", "value", "surrogate")
        fine, out = fine.union(good.select(bare("surrogate").alias("image"))), good if out is None else out.union(good)
        waiting = marked.where("clash")
    return out if out is not None else waiting.select("kind", "value", "surrogate")


def replace_entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` rewritten, plus ``n_entities`` and ``kinds`` (distinct, sorted, comma-joined).

    Who has ``key`` can tell which surrogate an entity would get, so it is a secret of the caller.
    Texts without an entity stay as they are, null texts null (no entities). All other columns,
    whatever their names, are passed through; columns named ``n_entities`` or ``kinds`` are
    replaced. Repeated rows and null ids are kept. Spellings of one entity get spellings of one
    surrogate in all texts, different entities different ones, and no surrogate is an entity of
    the texts.
    """
    again = redrawn(docs.select(docs[text_col].alias("text")), key)
    count = again.count()
    known = {(r["kind"], r["value"]): r["surrogate"] for r in again.collect()} if count <= HELD else {}
    docs = docs.drop("n_entities", "kinds")
    names, source = docs.columns, docs
    at = names.index(text_col)
    if count > HELD:
        mark = F.struct(docs[id_col].alias("i"), F.xxhash64(docs[text_col]).alias("h"))
        listed = docs.select(mark.alias("__mark"), docs[text_col].alias("text"))

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(m, k, v) for m, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, v in {(k, canonical(k, v)) for _, _, k, v in entities(t)}]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), *(pa.array([r[i] for r in rows], pa.string()) for i in (1, 2))], ["__mark", "kind", "value"])

        schema = StructType([*listed.select("__mark").schema.fields, StructField("kind", StringType()), StructField("value", StringType())])
        own = listed.mapInArrow(spread, schema).distinct().join(again, ["kind", "value"]).groupBy("__mark").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("__own"))
        source = docs.withColumn("__mark", mark).join(own, "__mark", "left").drop("__mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        first: dict[tuple[str, str], str] = {}
        for batch in batches:
            texts, counts, kinds = [], [], []
            own = batch.column(len(names)).to_pylist() if count > HELD else None
            for row, text in enumerate(batch.column(at).to_pylist()):
                here = {(o["kind"], o["value"]): o["surrogate"] for o in own[row] or ()} if own else known
                found, parts, done = entities(text), [], 0
                for start, end, kind, value in found:
                    plain = canonical(kind, value)
                    new = here.get((kind, plain)) or first.get((kind, plain))
                    if new is None:
                        if len(first) > 200_000:
                            first.clear()
                        new = first[kind, plain] = surrogate(kind, plain, key)
                    parts += [text[done:start], written_like(kind, value, new)]
                    done = end
                texts.append("".join([*parts, text[done:]]) if found else text)
                counts.append(len(found))
                kinds.append(",".join(sorted({k for _, _, k, _ in found})))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], [*names, "n_entities", "kinds"])

    return source.mapInArrow(run, StructType([*docs.schema.fields, *NEW_COLUMNS]))


#: The key of the query and of the pipeline over the test tables; real data need a secret one.
TEST_KEY = b"tallyspark"


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), TEST_KEY)
