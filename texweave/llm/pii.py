"""Surrogates for personal data: keyed replacements of the same type and shape.

Detected: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, card numbers with a valid
check digit, account numbers (IBAN) with a valid checksum, social security numbers, secrets, and
names: after a title, after a common given name, and wherever else in the text such a name's
parts stand. An entity's surrogate hangs on the key, the type and the entity's normal form alone,
so mentions of one entity agree in all documents; given name and surname are entities of their
own, so "Mr. John Smith" and "Dr. Smith" share a surname. Digits become digits, letters letters of
the same case and script, given names names of the same gender and script; separators stay,
numbers keep valid check digits, addresses are reserved ones.

Collisions are checked over the whole corpus: distinct entities that would share a surrogate,
or whose surrogate is a real entity, draw again (smallest first keeps its draw) until none
does. What draws again is a small table; documents are rewritten in place.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_batches

REDRAWN_ROWS = 200_000  # entities with another draw than the first that are broadcast; beyond, they are joined by document
SALTS = 16
_ROUNDS = 40
# Titles by gender, and given names by script and gender, to detect and to draw from.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f",
          "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Господин": "m", "Госпожа": "f", "Dr": "n"}
GIVEN = {
    ("latin", "m"): """Adam Alexander Andrew Anthony Antonio Bruno Carl Carlos Charles Christopher Daniel David Edgar Edward Felix Francisco
        Georg George Hans Hugo Ivan James Jean John Jonas José Joseph Juan Karl Kevin Klaus Leo Luis Manuel Mark Martin Matthew Michael Nils
        Oscar Paul Peter Philippe Pierre Ralph Richard Robert Simon Stefan Steven Theo Thomas Viktor William Wolfgang""".split(),
    ("latin", "f"): """Alma Ana Angela Anna Barbara Berta Camille Carmen Carol Clara Diana Elena Elizabeth Elsa Emily Emma Flora Greta Helen
        Irene Isabel Jennifer Jessica Julia Karin Laura Linda Lisa Lucía Margaret Maria Marie María Mary Monika Nancy Nora Olga Patricia
        Paula Petra Rosa Sandra Sara Sarah Sophie Susan Sylvie Thea Ursula Vera""".split(),
    ("cyrillic", "m"): "Алексей Антон Борис Вадим Глеб Денис Дмитрий Егор Захар Иван Игорь Кирилл Леонид Михаил Николай Сергей".split(),
    ("cyrillic", "f"): "Алла Анна Белла Вера Галина Дарья Ева Елена Зоя Инна Клара Лидия Мария Наталья Ольга Татьяна".split(),
}
GENDER = {name: gender for (_, gender), names in GIVEN.items() for name in names}
# Surnames are made of syllables, more of them with each draw: no list bounds their number.
_SYLLABLES = {"latin": ("bdfghklmnprstvw", "aeiou", ("", "n", "r", "l", "s")), "cyrillic": ("бвгдзклмнпрст", "аеиоу", ("", "н", "р", "л", "с"))}
_END = {"latin": "", "cyrillic": "енко"}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]{2,})?"  # O'Brien, but not the end of Smith's
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]+@(?:[\w-]+\.)+[A-Za-z]{2,}(?![\w-]))"
    r"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{40}|[0-9A-F]{40}|[0-9a-f]{32}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|(?:ghp|sk|xox[bp])[_-](?:(?:live|test)[_-])?[0-9A-Za-z-]{16,})(?![0-9A-Za-z]))"
    rf"|(?P<ip>(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d))"
    r"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{3})(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:.]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?(?!\w))"
    r"|(?P<card>(?<![\d.-])(?:\d{4}(?P<gap>[ -]?)\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}(?P<gap2>[ -])\d{6}(?P=gap2)\d{5})(?![\d-]))"
    r"|(?P<ssn>(?<![\w-])(?!000|666)[0-8]\d{2}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.])\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}(?!\w))"
    rf"|(?P<name>(?<!\w)(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[ ](?P<who>{_NAME}(?:[ ]{_NAME})?))"
)
_KINDS = ("email", "secret", "ip", "ip6", "iban", "card", "ssn", "phone", "name")
# A capitalised word before another: the first is looked up among given names.
_PAIR = re.compile(rf"(?<!\w)([A-ZÀ-ÞА-ЯЁ][^\W\d_]+)[ ](?=([A-ZÀ-ÞА-ЯЁ][^\W\d_]+(?:[-'’][^\W\d_]{2,})?))")
_WORD = re.compile(_NAME)
_PART = re.compile(r"[^\W\d_]+")
_ALONE = re.compile(r"(?<!\w)[^\W\d_]+(?:[-'’][^\W\d_]+)*(?!\w)")
# Leading digits and lengths that issuers of cards have.
_ISSUED = re.compile(r"4\d{12}(?:\d{3}){0,2}|5\d{15}|6\d{15,18}|(?:222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3[47]\d{13}|35\d{14}|3[0689]\d{12}")
_PREFIX = re.compile("(?:AKIA|gh[a-z][_-]|sk[-_](?:live[-_]|test[-_])?|xox[a-z]-?)?")  # what tells the issuer of a secret
# Words that are names only where a title or a given name stands before them: months, days, colours, places, common words.
ORDINARY = frozenset(
    """April May June August Sunday Monday Friday Street Road Lane Avenue Park Hill Lake River Church Bridge Field Wood Woods Stone Forest North South East West
    Young Old Long Short Good Best Rich Strong Wise Early Little Small Large White Black Brown Green Grey Gray Gold Silver Rose Violet Red Blue
    King Queen Prince Bishop Pope Judge Major Page Day Winter Summer Spring Autumn Will Mark Grant Hope Grace Joy Faith Art Frank Bill Price Love Power Case Law
    Baker Cook Smithy Miller Farmer Fisher Hunter Mason Carter The This That There When What Who How And But Not New Her His She They You""".split()
)
_HINT = re.compile("[0-9@]|::")
_MARKS = [t + end for t in TITLES for end in (" ", ". ")] + ["AKIA", "ghp_", "ghp-", "sk_", "sk-", "xoxb", "xoxp"]


def _script(word: str) -> str:
    return "cyrillic" if re.search("[А-яЁё]", word) else "latin"


def normal(kind: str, text: str) -> str:
    """The form in which mentions of one entity agree."""
    if kind in ("card", "phone", "ssn"):
        return "".join(c for c in text if c.isdigit())
    if kind == "ip6":
        return str(ipaddress.IPv6Address(text))
    if kind == "iban":
        return text.replace(" ", "")
    return text.lower() if kind in ("email", "given", "surname") else text


def _remainder(iban: str) -> int:
    """What the checksum of an account number leaves: 1 if it is valid."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _real(kind: str, text: str) -> bool:
    """Whether a match is what it looks like."""
    if kind == "card":
        digits = normal(kind, text)
        return bool(_ISSUED.fullmatch(digits)) and _check_digit(digits[:-1]) == digits[-1]
    if kind == "iban":
        return _remainder(normal(kind, text)) == 1
    if kind == "ip6":
        try:
            return bool(ipaddress.IPv6Address(text))
        except ValueError:
            return False
    return True


def _draws(key: bytes, kind: str, entity: str, draw: int) -> Iterator[int]:
    block = 0
    while True:
        yield from hmac.digest(key, f"{kind}\0{entity}\0{draw}\0{block}".encode("utf-8", "surrogatepass"), "sha256")
        block += 1


def _pick(draws: Iterator[int], n: int) -> int:
    """A number below n; four bytes make the bias negligible."""
    return int.from_bytes(bytes(next(draws) for _ in range(4))) % n


def _check_digit(digits: str) -> str:
    """The Luhn digit that completes ``digits``."""
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 == 0 else int(d) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


def canonical(key: bytes, kind: str, entity: str, draw: int) -> str:
    """The surrogate of an entity, in normal form. The spaces to draw from grow with the draw."""
    draws = _draws(key, kind, entity, draw)
    digits = lambda n: "".join(str(_pick(draws, 10)) for _ in range(n))
    if kind == "email":
        user = "".join("abcdefghijklmnopqrstuvwxyz"[_pick(draws, 26)] if c.isalpha() else str(_pick(draws, 10)) if c.isdigit() else c for c in entity.split("@")[0])
        return f"{user}.{''.join(f'{_pick(draws, 256):02x}' for _ in range(3 + draw))}@example.org"
    if kind == "ip":  # from the block for benchmarks, 198.18.0.0/15; then the reserved 240.0.0.0/4 without its last address; then any
        blocks = ((198 << 24) + (18 << 16), 1 << 17), (240 << 24, (1 << 28) - 1), (0, 1 << 32)
        start, size = blocks[min(draw, 2)]
        return str(ipaddress.IPv4Address(start + int.from_bytes(bytes(next(draws) for _ in range(8))) % size))
    if kind == "ip6":  # from the block for documentation, 2001:db8::/32
        return str(ipaddress.IPv6Address((0x20010DB8 << 96) + int.from_bytes(bytes(next(draws) for _ in range(12)))))
    if kind == "card":
        issuer = entity[: 4 if entity[0] == "2" else 2 if entity[0] in "35" else 1]
        body = issuer + digits(len(entity) - 1 - len(issuer))
        return body + _check_digit(body)
    if kind == "ssn":  # areas from 900 on belong to nobody
        return "9" + digits(8) if not draw else digits(9)  # drawn again, from all
    if kind == "iban":
        body = "".join(str(_pick(draws, 10)) if c.isdigit() else chr(65 + _pick(draws, 26)) for c in entity[4:])
        return f"{entity[:2]}{98 - _remainder(entity[:2] + '00' + body):02d}{body}"
    if kind == "phone":
        kept = entity[:-7] if len(entity) > 7 and not draw else ""  # drawn again, the area goes, too
        return kept + digits(len(entity) - len(kept))
    if kind == "secret":
        kept = len(_PREFIX.match(entity)[0])
        hexadecimal = [x for x in ("0123456789abcdef", "0123456789ABCDEF") if set(entity) <= set(x)]
        kinds = hexadecimal or ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

        def like(c: str) -> str:
            letters = next((x for x in kinds if c in x), "")
            return letters[_pick(draws, len(letters))] if letters else c

        return entity[:kept] + "".join(map(like, entity[kept:]))
    script = _script(entity)
    if kind == "surname":
        first, vowels, last = _SYLLABLES[script]
        return "".join(first[_pick(draws, len(first))] + vowels[_pick(draws, 5)] + last[_pick(draws, 5)] for _ in range(2 + draw)) + _END[script]
    gender = entity.split(":")[0]
    names = GIVEN[script, gender if gender != "n" else "mf"[_pick(draws, 2)]]
    return f"{gender}:" + "-".join(names[_pick(draws, len(names))] for _ in range(1 + draw)).lower()


def _given(word: str, title: str) -> str:
    return f"{GENDER.get(word, GENDER.get(word.capitalize(), title))}:{word.lower()}"


def _lines(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of the lines that can hold an entity of PATTERN: each lies in one line and has a digit, an @, a :: or one of _MARKS."""
    hits = [m.start() for m in _HINT.finditer(text)]
    for mark in _MARKS:
        at = text.find(mark)
        while at >= 0:
            hits.append(at)
            at = text.find(mark, at + 1)
    end = -1
    for hit in sorted(hits):
        if hit > end:
            end = text.find("\n", hit)
            end = len(text) if end < 0 else end
            yield text.rfind("\n", 0, hit) + 1, end


def entities(text: str | None) -> list[tuple[str, str, int, int]]:
    """kind, normal form, and the range to replace, of every entity of a text, in order."""
    text, found = text or "", []
    people: dict[str, tuple[str, str]] = {}  # words of names in this text: kind and entity

    def person(words: list[re.Match], title: str, at: int) -> None:
        *first, last = words
        for m, kind, entity in [(m, "given", _given(m[0], title)) for m in first] + [(last, "surname", last[0].lower())]:
            found.append((kind, entity, at + m.start(), at + m.end()))
            if len(m[0]) > 2 and m[0].capitalize() not in ORDINARY:
                for word in {m[0], m[0].upper(), m[0].capitalize() if m[0].isupper() else m[0]}:
                    people.setdefault(word, (kind, entity))

    for m in (m for a, b in _lines(text) for m in PATTERN.finditer(text, a, b)):
        kind = next(k for k in _KINDS if m[k])
        if kind != "name":
            if _real(kind, m[kind]):
                found.append((kind, normal(kind, m[kind]), m.start(), m.end()))
            continue
        words = list(_WORD.finditer(m["who"]))
        words = words[: 1 + (len(words) > 1 and words[1][0][0].isupper())]
        if words[0][0][0].isupper():
            person(words, TITLES[m["title"]], m.start("who"))
    for m in _PAIR.finditer(text):
        given = m[1].capitalize() if m[1].isupper() and m[2].isupper() and m[1].capitalize() not in ORDINARY else m[1]
        if given in GENDER and m[1] != m[2]:  # a word repeated is no name
            person(list(_WORD.finditer(f"{m[1]} {m[2]}")), GENDER[given], m.start())
    if people:  # the same person once more, without a title
        for m in _ALONE.finditer(text):
            spans = [m.span()] if m[0] in people else [p.span() for p in _PART.finditer(text, *m.span()) if p[0] in people]
            found += [(*people[text[x:y]], x, y) for x, y in spans]
    out, end = [], 0
    for entity in sorted(dict.fromkeys(found), key=lambda x: (x[2], -x[3])):
        if entity[2] >= end:
            out.append(entity)
            end = entity[3]
    return out


def shaped(kind: str, surrogate: str, mention: str) -> str:
    """A surrogate in normal form, put into the shape of a mention: its separators and case."""
    if kind in ("card", "phone", "ssn", "iban"):
        letters = iter(surrogate)
        return "".join(next(letters) if c.isdigit() or kind == "iban" and c != " " else c for c in mention)
    if kind in ("given", "surname"):
        name = re.sub(r"[^\W\d_]+", lambda m: m[0].capitalize(), surrogate.split(":")[-1])
        return name.upper() if mention.isupper() and len(mention) > 1 else name
    return surrogate


def _entity_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {(k, e) for text in batch.column(0) for k, e, _, _ in entities(text.as_py())}
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["kind", "entity"])


def _with_surrogates(rows: DataFrame, key: bytes) -> DataFrame:
    """``rows`` (kind, entity, draw) with the surrogate of that draw."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [canonical(key, k, e, d) for k, e, d in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "entity", "draw", "surrogate"])

    return map_batches(rows.select("kind", "entity", "draw"), each, "kind string, entity string, draw int, surrogate string")


def surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, draw and surrogate of every distinct entity of the corpus; no two of a kind share a surrogate."""
    if not key:
        raise ValueError("a key is needed: without one, anybody can compute the surrogates")
    found = map_batches(docs.select(F.col("text").cast("string")), _entity_batches, "kind string, entity string").distinct()
    table = checkpoint(_with_surrogates(found.withColumn("draw", F.lit(0)), key))
    for _ in range(_ROUNDS):
        kept = table.groupBy("kind", "surrogate").agg(F.min(F.struct("draw", "entity")).alias("first"), F.count("*").alias("n"))
        shared = table.join(kept.where("n > 1"), ["kind", "surrogate"])
        shared = shared.where((F.col("draw") != F.col("first.draw")) | (F.col("entity") != F.col("first.entity"))).select("kind", "entity")
        real = table.join(table.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "entity")
        again = checkpoint(shared.union(real).distinct())
        if not again.count():
            return table
        redrawn = table.join(again, ["kind", "entity"], "left_semi").withColumn("draw", F.col("draw") + 1)
        table = checkpoint(table.join(again, ["kind", "entity"], "left_anti").unionByName(_with_surrogates(redrawn, key)))
    raise ValueError("entities still collide: the space of surrogates is too small for them")


def _rewrite(rows: DataFrame, key: bytes, redrawn: dict[tuple[str, str], int], column: str | None) -> DataFrame:
    """``rows`` with text rewritten and n_entities; draws come from ``redrawn`` or from the map column."""
    shared = rows.sparkSession.sparkContext.broadcast(redrawn)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            own = batch.column(column).to_pylist() if column else [None] * len(batch)
            for value, draws in zip(batch.column("text"), own, strict=True):
                text, at, parts = value.as_py(), 0, []
                known = {(d["kind"], d["entity"]): d["draw"] for d in draws} if draws else shared.value
                found = entities(text)
                for kind, entity, a, b in found:
                    made = canonical(key, kind, entity, known.get((kind, entity), 0))
                    parts += [text[at:a], shaped(kind, made, text[a:b])]
                    at = b
                texts.append(text if text is None else "".join([*parts, text[at:]]))
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "text", "n_entities"])

    return map_batches(rows, each, "doc_id long, text string, n_entities long")


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with surrogates and n_entities of every row of ``docs``.

    ``key`` is the secret that surrogates hang on; who lacks it cannot compute them. Null texts stay
    null, empty and long ones are rewritten whole like any. Repeated rows repeat, other columns of
    ``docs`` stay out, and an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    redrawn = checkpoint(surrogates(docs, key).where("draw > 0").select("kind", "entity", "draw"))
    if redrawn.count() <= REDRAWN_ROWS:
        return _rewrite(rows, key, {(r.kind, r.entity): r.draw for r in redrawn.collect()}, None)

    def mentioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(i, k, e) for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for k, e in {(k, e) for k, e, _, _ in entities(text.as_py())}]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), *(pa.array([p[i] for p in pairs], pa.string()) for i in (1, 2))], ["h", "kind", "entity"])

    keyed = rows.withColumn("h", F.xxhash64("text"))
    each = map_batches(keyed.where("text is not null").select("h", "text"), mentioned, "h long, kind string, entity string").distinct()
    draws = each.join(redrawn, ["kind", "entity"]).groupBy("h").agg(F.collect_list(F.struct("kind", "entity", "draw")).alias("draws"))
    # Copies of a text share a hash: the join takes them salted, so that they do not meet in one task.
    salted = keyed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    draws = draws.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return _rewrite(salted.join(draws, ["h", "salt"], "left").select("doc_id", "text", "draws"), key, {}, "draws")
