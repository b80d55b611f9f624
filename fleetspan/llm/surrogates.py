"""Keyed surrogates for personal data in customer and driver records."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored, unused

# letters with the marks that many scripts write on or after them
_MARKS = "".join(c for c in map(chr, range(0x300, 0x1E95B)) if unicodedata.category(c) in ("Mn", "Mc") and not 0xFE00 <= ord(c) <= 0xFE0F)
_WORD = rf"(?:[^\W\d_]|[{_MARKS}])+"
# fixed values: how each kind of personal data is written
PATTERNS = (
    ("email", r"(?<![\w.%+-])[\w.%+-]++@(?:[^\W_](?:[^\W_]|-){0,62}\.)+[^\W\d_]{2,24}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9])[2-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"),
    ("name", r"(?<![^\W\d_])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?|Г-н|Г-жа)\.? +" + rf"(?:[^\W\d_a-z]{_WORD}(?:[-'’]{_WORD})?)(?: [^\W\d_a-z]{_WORD}(?:[-'’]{_WORD})?){{0,2}}"),
)
_ALL = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS))
_MARK = re.compile(r"@|[0-9][0-9 .()-]{5}|\+[0-9]|[A-Z]{2}[0-9]{2}|(?:M[rs]|Miss|Dr|Prof|Herr|Frau|Mon|Mad|Mme|Se|Sr|Г)")
KINDS = tuple(kind for kind, _ in PATTERNS)
# fixed values: letters whose exchange keeps a name speakable and its gendered ending, by script
_LETTERS = {"LATIN": ("aeiou", "bcdfghjklmnpqrstvwxyz"), "CYRILLIC": ("аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"), "GREEK": ("αεηιουω", "βγδζθκλμνξπρστφχψ")}
_LARGE = ((0xAC00, 0xD7A4), (0x4E00, 0x9FA6))  # fixed values: code points of Hangul syllables and of the common ideographs
IN_SHAPE, DRAWS = 128, 64  # candidates within an entity's shape before longer ones; candidates drawn at once at most
_CLASS = {letter: (group, group.index(letter)) for groups in _LETTERS.values() for group in groups for letter in group}


def _remembered(f):
    """``f`` with its latest results kept in a plain dict, which travels to tasks with the function."""
    held: dict = {}

    def kept(*args):
        if args not in held:
            if len(held) >= 1 << 16:
                held.clear()
            held[args] = f(*args)
        return held[args]

    return kept


def luhn_digit(body: str) -> int:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _permuted(values: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of all value lists with these radices: ten Feistel rounds by modular addition on two halves."""
    half = (len(values) + 1) // 2
    left, right, lr, rr = values[:half], values[half:], radices[:half], radices[half:]
    if not right:  # a single symbol is shifted; for one symbol that is a permutation already
        shift = hashlib.blake2b(repr((tweak, radices)).encode(), key=key).digest()
        return [(v + int.from_bytes(shift[:8], "big") % max(1, r - 1) + 1) % r if r > 1 else v for v, r in zip(left, lr)]
    for turn in range(10):
        a, b, radix = (left, right, lr) if turn % 2 == 0 else (right, left, rr)
        stream = hashlib.shake_256(key + repr((turn, tweak, radices, b)).encode()).digest(4 * len(a))
        new = [(v + int.from_bytes(stream[4 * i : 4 * i + 4], "big")) % r for i, (v, r) in enumerate(zip(a, radix))]
        left, right = (new, right) if turn % 2 == 0 else (left, new)
    return left + right


def _plain(c: str) -> bool:
    return c.lower() in _CLASS and c in (c.lower(), c.lower().upper())


@_remembered
def _letter(c: str) -> tuple[str, int] | None:
    """The alphabet in which a letter may change, and its place there; None for all that is no letter.

    Letters of every script have one: Hangul syllables and common ideographs as a whole, others the letters of their
    script and case within 128 code points.
    """
    if _plain(c):
        group, at = _CLASS[c.lower()]
        return (group.upper() if c != c.lower() else group), at
    if not c.isalpha():
        return None
    for start, end in _LARGE:
        if start <= ord(c) < end:
            return _alphabet(start, end, "", ""), ord(c) - start
    start = ord(c) & ~127
    letters = _alphabet(start, start + 128, unicodedata.category(c), unicodedata.name(c, "").split(" ")[0])
    return letters, letters.index(c)


@_remembered
def _alphabet(start: int, end: int, category: str, script: str) -> str:
    letters = map(chr, range(start, end))
    if not category:
        return "".join(letters)
    return "".join(c for c in letters if unicodedata.category(c) == category and unicodedata.name(c, "").split(" ")[0] == script and not _plain(c))


def _symbols(text: str, keep: set[int], letters: bool = True) -> list[tuple[int, str, int]]:
    """(position, alphabet, value) of the characters that may change."""
    out = []
    for i, c in enumerate(text):
        if i in keep:
            continue
        if c in "0123456789":
            out.append((i, "0123456789", int(c)))
        elif letters and (found := _letter(c)):
            out.append((i, *found))
    return out


def _rewrite(text: str, found: list[tuple[int, str, int]], key: bytes, tweak: str, radices: dict[int, tuple[int, int]] | None = None) -> str:
    radices = radices or {}
    low = [radices.get(i, (0, 0))[0] for i, _, _ in found]
    size = [radices[i][1] if i in radices else len(a) for i, a, _ in found]
    new = _permuted([v - b for (_, _, v), b in zip(found, low)], size, key, tweak)
    out = list(text)
    for (i, alphabet, _), v, b in zip(found, new, low):
        out[i] = alphabet[v + b]
    return "".join(out)


def _once(kind: str, text: str, key: bytes) -> str:
    shape = re.sub("[0-9]", "0", text)
    if kind == "ip":  # octets keep their number of digits
        octets = [int(x) for x in text.split(".")]
        base = [0 if o < 10 else 10 if o < 100 else 100 for o in octets]
        size = [10 if o < 10 else 90 if o < 100 else 156 for o in octets]
        return ".".join(str(v + b) for v, b in zip(_permuted([o - b for o, b in zip(octets, base)], size, key, f"ip{base}"), base))
    if kind == "card":  # network digit and validity stay
        places = [i for i, c in enumerate(text) if c.isdigit()]
        digits = "".join(text[i] for i in places)
        valid = luhn_digit(digits[:-1]) == int(digits[-1])
        keep = {places[0]} | ({places[-1]} if valid else set())
        while True:
            text = _rewrite(text, _symbols(text, keep, letters=False), key, f"card{valid}{text[0]}{shape}")
            digits = "".join(c for c in text if c.isdigit())
            if valid:
                return text[: places[-1]] + str(luhn_digit(digits[:-1])) + text[places[-1] + 1 :]
            if luhn_digit(digits[:-1]) != int(digits[-1]):
                return text
    if kind == "phone":  # country code stays; area and exchange codes begin as before, with 2 to 9 or not
        keep = set(range(re.match(r"\+[0-9]{1,3}(?=[ .(-])", text).end())) if re.match(r"\+[0-9]{1,3}(?=[ .(-])", text) else set()
        found = _symbols(text, keep, letters=False)
        lead = {i: (2, 8) for i, _, v in found if v >= 2 and not text[i - 1 : i].isdigit()}
        return _rewrite(text, found, key, f"phone{text[: len(keep)]}{shape}{sorted(lead)}", lead)
    if kind == "email":  # the provider's last two labels stay
        at = text.index("@")
        labels = [m.start() for m in re.finditer(r"\.", text[at:])]
        last = at + (labels[-2] if len(labels) > 1 else 0)
        return _rewrite(text, _symbols(text, set(range(last, len(text))) | {at}), key, "email" + _shape(text) + text[last:])
    if kind == "iban":
        return _rewrite(text, _symbols(text, {0, 1}), key, "iban" + text[:2] + _shape(text))
    if kind == "name":  # title, and with it the gender; ending letter, which often marks it, stay
        start = re.match(r"\S+ +", text).end()
        keep = set(range(start)) | {m.end() - 1 for m in re.finditer(r"[^\W\d_]+", text) if m.end() > start and m.end() - m.start() > 2}
        return _rewrite(text, _symbols(text, keep), key, "name" + text[:start] + _shape(text))
    return _rewrite(text, _symbols(text, set(), letters=False), key, kind + shape)


def _shape(text: str) -> str:
    """What a surrogate keeps of a text: each letter's alphabet, case, and all else."""
    return "".join("0" if c in "0123456789" else f"<{found[0][0]}>" if (found := _letter(c)) else c for c in text)


def _widened(kind: str, text: str, extra: int) -> str:
    """A longer text for an entity whose shape has no room, with ``extra`` symbols more; distinct texts of a shape stay distinct."""
    if kind == "email":
        return "a" * extra + text
    if kind == "name":  # before the ending letter
        return text[:-1] + "a" * extra + text[-1:]
    return text + "0" * extra


def _draw(kind: str, text: str, key: bytes, step: int) -> str:
    key = key if step == 1 else hashlib.sha256(key + b" %d" % step).digest()
    extra = 1 + (step - IN_SHAPE - 1) // DRAWS if step > IN_SHAPE else 0
    made = _once(kind, text, key)
    if not extra and step > 1 and made == text and all(_once(kind, text, b"%d" % i) == text for i in range(8)):
        extra = 1 + step // DRAWS  # a shape without choices
    if not extra or kind in ("card", "iban"):  # their shapes, of 10^11 values or more, always have room
        return made
    if kind == "ip":
        return ".".join(map(str, _permuted([int(x) for x in text.split(".")], [256] * 4, key, "ip")))
    return _once(kind, _widened(kind, text, extra), key)


@_remembered
def surrogate(kind: str, text: str, key: str, steps: int = 1) -> str:
    """The ``steps``-th candidate for the keyed surrogate of an entity.

    Up to ``IN_SHAPE`` each number has its own keyed permutation of all texts of a shape, so candidates of one number are
    distinct; later ones are of ever longer shapes.
    """
    return _draw(kind, text, key.encode(), steps)


def entities(text: str | None):
    """(start, end, kind) of personal data in a text, leftmost and not overlapping."""
    if not text or not _MARK.search(text):
        return []
    return [(m.start(), m.end(), m.lastgroup) for m in _ALL.finditer(text)]


def entities_of(text: Column) -> Column:
    @F.pandas_udf("array<struct<kind:string,entity:string>>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": k, "entity": t[a:b]} for a, b, k in entities(t)])

    return of(text)


def _replacer(key: str):
    @F.pandas_udf("text string, " + ", ".join(f"n_{k} long" for k in KINDS))
    def replace(text: pd.Series, again: pd.Series) -> pd.DataFrame:
        rows = []
        for t, more in zip(text, again):
            steps = {(x["kind"], x["entity"]): x["steps"] for x in more}
            pieces, at, counts = [], 0, dict.fromkeys(KINDS, 0)
            for a, b, kind in entities(t):
                pieces += [t[at:a], surrogate(kind, t[a:b], key, steps.get((kind, t[a:b]), 1))]
                at = b
                counts[kind] += 1
            rows.append((t if not pieces else "".join([*pieces, t[at:]]), *counts.values()))
        return pd.DataFrame(rows, columns=["text", *(f"n_{k}" for k in KINDS)])

    return replace


def _steps(key: str):
    @F.pandas_udf("string")
    def of(kind: pd.Series, entity: pd.Series, steps: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, e, key, s) for k, e, s in zip(kind, entity, steps)])

    return of


def surrogate_map(customers: DataFrame, text: str | Column = "address", key: str = "fleet") -> DataFrame:
    """(kind, entity, steps, surrogate) for every distinct entity, with collisions resolved.

    The first candidate is a keyed permutation of the entity within its shape, so distinct entities never share one. An entity
    whose candidate is real draws further ones by other permutations, until one is neither a real entity nor given already;
    of entities that draw the same, the least has it. Where a shape has no room, candidates become longer.
    """
    col = F.col(text) if isinstance(text, str) else text
    found = customers.select(F.explode(entities_of(col)).alias("e")).select("e.kind", "e.entity").distinct()
    known = stored(found, "entities")
    real = known.select("kind", F.col("entity").alias("surrogate"))
    drawn = lambda rows: rows.withColumn("surrogate", _steps(key)("kind", "entity", "steps"))
    made = stored(drawn(known.withColumn("steps", F.lit(1))).join(real.withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left"), "surrogates")
    done = made.where("taken is null").select("kind", "entity", "steps", "surrogate")
    todo, first, width = made.where("taken").select("kind", "entity"), 2, 1
    while not todo.isEmpty():
        draws = drawn(todo.withColumn("steps", F.explode(F.sequence(F.lit(first), F.lit(first + width - 1)))))
        free = draws.join(real, ["kind", "surrogate"], "left_anti").join(done, ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min(F.struct("entity", "steps")).alias("w")).select("kind", "w.*", "surrogate")
        given = won.groupBy("kind", "entity").agg(F.min(F.struct("steps", "surrogate")).alias("g")).select("kind", "entity", "g.*")
        given = stored(given, "surrogates")
        done = done.unionByName(given)
        todo = stored(todo.join(given, ["kind", "entity"], "left_anti"), "entities")
        first, width = first + width, min(2 * width, DRAWS)
    return done


def replace_entities(customers: DataFrame, address: str = "address", key: str = "fleet", as_column: str = "surrogates") -> DataFrame:
    """Replace personal data in the ``address`` texts of customers (or any text of a table) by surrogates.

    Kinds: e-mail, phone, IP address, payment card, IBAN, SSN, and titled names. A surrogate keeps kind and format: digits
    stay digits, letters keep script, case and vowel or consonant, names their title and ending (their gender), cards their
    network and check digit, IP octets their width, e-mails their provider. The same entity has the same surrogate wherever
    it occurs, distinct ones stay distinct, and none is another entity of the table. All columns stay; the struct
    ``as_column`` is added (a column of that name is replaced): the new text and a count per kind. Null and empty texts stay
    as they are; repeated rows are treated alike; a text without personal data is unchanged to the character.
    """
    row, again = unused(customers.columns, f"_{as_column}_row", f"_{as_column}_again")
    special = surrogate_map(customers, address, key).where("steps > 1").select("kind", "entity", "steps")
    none = F.array().cast("array<struct<kind:string,entity:string,steps:int>>")
    if special.isEmpty():
        out = customers.withColumn(again, none)
    else:
        # the few entities that needed more steps reach their texts by a join on the texts' digest
        texts = customers.where(F.col(address).isNotNull()).select(F.col(address).alias("t")).withColumn("d", F.sha2("t", 256))
        held = texts.select("d", F.explode(entities_of(F.col("t"))).alias("e")).select("d", "e.kind", "e.entity").join(special, ["kind", "entity"]).distinct()
        per = held.groupBy("d").agg(F.collect_list(F.struct("kind", "entity", "steps")).alias(again)).withColumnRenamed("d", row)
        out = customers.withColumn(row, F.sha2(F.col(address), 256)).join(per, row, "left").drop(row).withColumn(again, F.coalesce(again, none))
    return out.withColumn(as_column, _replacer(key)(F.col(address), F.col(again))).drop(again)
