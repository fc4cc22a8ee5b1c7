"""Surrogates for personal data: keyed, type-consistent replacements, in built-in expressions only.

E-mail addresses, IPv4 addresses, phone numbers, card numbers, social security numbers and person names are found by
one pattern, leftmost first. Each gets a replacement of the same kind and format:

* digits, plain letters, accented letters and Cyrillic letters are each permuted as a sequence of their own and put
  back in place, in the case they had, so length, punctuation, case and script stay; every other letter and number of
  Unicode is permuted among those of its own script, category and range of code points (``_ranges``);
* the four numbers of an IPv4 address are permuted as numbers below 256;
* a card number keeps the relation of its last digit to the Luhn check digit, so valid ones stay valid;
* a phone number keeps its country code; an e-mail address ends in the reserved domain ``example``;
* a first name moves to another one of its gender and script; names after a title are permuted in their letters.

The permutations are keyed Feistel networks: a value always gets the same replacement (coreference) and two values
never share one (distinctness), without a table of all values. ``collisions`` checks that over a corpus.

Defined results: a null text counts as empty and stays null; a text without personal data stays as it is; repeated
rows are rewritten alike; an empty table gives no rows. Only the columns kept and the text are read.
"""

from __future__ import annotations

import unicodedata
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL, IP, PHONE, CARD, SSN, NAME = "email", "ip", "phone", "card", "ssn", "name"
KINDS = (EMAIL, IP, PHONE, CARD, SSN, NAME)

# First names by gender and script, in alphabetical order.
FIRST_NAMES = {
    ("female", "latin"): "Alice Anna Carmen Clara Elena Emma Hannah Julia Laura Lucia Maria Marie Mary Nora Paula Sarah Sofia Susan".split(),
    ("male", "latin"): "Adam Carlos David Diego Hans Hugo James Jean John Juan Karl Louis Luis Michael Paul Peter Pierre Thomas".split(),
    ("female", "cyrillic"): "Алина Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана".split(),
    ("male", "cyrillic"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
}
# Titles before a surname.
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora".split()

_WORD = r"\p{Lu}[\p{L}'-]{0,60}\p{L}"
_FIRST = "|".join(n for names in FIRST_NAMES.values() for n in names)
PATTERNS = {
    EMAIL: r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,255}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,63}",
    IP: r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    PHONE: (
        r"(?<!\p{N})\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[.-][0-9]{2,5}|\x20[0-9]{2,5}(?![.0-9])){1,4}(?![0-9])"
        r"|(?<![0-9+(.-])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"
    ),
    CARD: r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
    SSN: r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    NAME: rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{'|'.join(TITLES)})\.?\x20(?:(?:{_FIRST})\x20)?|(?:{_FIRST})\x20){_WORD}(?!\p{{L}})",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

# The alphabets whose letters are permuted among themselves.
ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
)
ROUNDS = 6
#: Letters of fewer than these in their script, category and range are permuted with those of other scripts.
LEAST_LETTERS = 16
_PLAIN = "".join(sorted({x for a in ALPHABETS for c in a for x in (c, c.upper())}))
#: A letter or number outside the alphabets.
_OTHER = rf"[\p{{L}}\p{{N}}&&[^{_PLAIN}]]"


def _ranges() -> tuple[list[int], list[tuple[int, int, int]]]:
    """(starts, runs): the letters and numbers outside ``ALPHABETS``, numbered group by group.

    ``starts`` are the numbers at which groups start, and the end; a run (code point, length, number) holds code points
    in a row with numbers in a row.
    """
    known = set("".join(ALPHABETS))
    groups: dict[tuple, list[int]] = {}
    for point in range(0x80, 0x110000):
        c = chr(point)
        kind = unicodedata.category(c)
        if kind[0] in "LN" and c.lower() not in known:
            script = unicodedata.name(c, "UNNAMED").split()[0].split("-")[0]
            groups.setdefault((script, kind, point >> (16 if script in ("CJK", "HANGUL") else 8)), []).append(point)
    for width in (lambda k: ("", k[1]), lambda k: ("", k[1][0])):
        for key in [k for k, points in groups.items() if len(points) < LEAST_LETTERS]:
            groups.setdefault(width(key), []).extend(groups.pop(key))
    starts, runs, number = [], [], 0
    for points in groups.values():
        starts.append(number)
        for _, row in groupby(enumerate(sorted(points)), lambda x: x[1] - x[0]):
            row = [point for _, point in row]
            runs.append((row[0], len(row), number))
            number += len(row)
    return [*starts, number], runs


_STARTS, _RUNS = _ranges()


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once for use in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def permuted(numbers: Column, base: int | Column, key: Column) -> Column:
    """A keyed permutation of the sequences of numbers below ``base`` that have the same length."""

    def turn(pair: Column, round_: Column) -> Column:
        mask = F.sha2(F.concat_ws("|", key, round_.cast("string"), F.array_join(pair["b"].cast("array<string>"), ",")), 256)
        shifted = _let(
            mask,
            lambda m: F.transform(
                pair["a"],
                lambda x, i: F.pmod(
                    x + F.conv(F.substr(m, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int"), base
                ),
            ),
        )
        return F.struct(pair["b"].alias("a"), shifted.alias("b"))

    base = base if isinstance(base, Column) else F.lit(base)
    half = F.ceil(F.size(numbers) / 2).cast("int")
    ends = F.struct(
        F.slice(numbers, F.lit(1), half).alias("a"), F.slice(numbers, half + 1, F.size(numbers) - half).alias("b")
    )
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, ends, turn, lambda pair: F.concat(pair["a"], pair["b"]))


def _letters(value: Column, key: Column) -> Column:
    """Permute the letters and numbers of each alphabet and range among themselves; others, and the case, stay."""
    for order, alphabet in enumerate(ALPHABETS):
        value = _one_alphabet(value, alphabet, F.concat(key, F.lit(f"|{order}")))
    return _let(value, lambda v: F.when(v.rlike(_OTHER), _other_letters(v, key)).otherwise(v))


def _listed(numbers) -> Column:
    """Numbers as one constant, instead of one expression each."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")


def _last(numbers: Column, most: Column) -> Column:
    """The place, from 0, of the last of ascending numbers that is not above ``most``."""
    return F.size(F.filter(numbers, lambda x: x <= most)) - 1


def _other_letters(value: Column, key: Column) -> Column:
    starts, by_point = _listed(_STARTS), sorted(_RUNS)
    points, lengths, numbers = (_listed(r[i] for r in by_point) for i in range(3))
    numbers_in_order, points_in_order = (_listed(r[i] for r in _RUNS) for i in (2, 0))

    def number(c: Column) -> Column:
        """Of a letter; -1 for what is no letter outside the alphabets."""
        of = lambda p, r: F.when(
            (r >= 0) & (p < F.get(points, r) + F.get(lengths, r)), F.get(numbers, r) + p - F.get(points, r)
        ).otherwise(F.lit(-1))
        return _let(F.ascii(c), lambda p: _let(_last(points, p), lambda r: of(p, r)))

    def letter(n: Column) -> Column:
        point = _let(_last(numbers_in_order, n), lambda r: F.get(points_in_order, r) + n - F.get(numbers_in_order, r))
        return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")

    def one_group(found: Column, group: Column) -> Column:
        start, end = F.get(starts, group), F.get(starts, group + 1)
        inside = lambda x: (x >= start) & (x < end)
        new = permuted(F.transform(F.filter(found, inside), lambda x: x - start), end - start, F.concat_ws("|", key, F.lit("other"), group.cast("string")))

        def placed(new: Column) -> Column:
            def at(x: Column, i: Column) -> Column:
                rank = F.size(F.filter(F.slice(found, F.lit(1), i + 1), inside))
                return F.when(inside(x), (F.get(new, rank - 1) + start).cast("int")).otherwise(x)

            return F.transform(found, at)

        return _let(new, placed)

    def all_groups(found: Column) -> Column:
        groups = F.array_distinct(F.transform(F.filter(found, lambda x: x >= 0), lambda x: _last(starts, x)))
        return F.aggregate(groups, found, one_group)

    def joined(chars: Column, found: Column) -> Column:
        return F.array_join(F.transform(chars, lambda c, i: F.when(F.get(found, i) < 0, c).otherwise(letter(F.get(found, i)))), "")

    return _let(
        F.split(value, ""),
        lambda chars: _let(
            F.transform(chars, number), lambda found: _let(all_groups(found), lambda new: joined(chars, new))
        ),
    )


def _one_alphabet(value: Column, alphabet: str, key: Column) -> Column:
    letters = F.lit(alphabet)

    def placed(chars: Column, found: Column, new: Column) -> Column:
        def at(c: Column, i: Column) -> Column:
            rank = F.size(F.filter(F.slice(found, F.lit(1), i + 1), lambda x: x > 0))
            letter = F.substr(letters, F.get(new, rank - 1) + 1, F.lit(1))
            cased = F.when(c == F.lower(c), letter).otherwise(F.upper(letter))
            return F.when(F.get(found, i) == 0, c).otherwise(cased)

        return F.array_join(F.transform(chars, at), "")

    def renumbered(found: Column) -> Column:
        return permuted(F.transform(F.filter(found, lambda x: x > 0), lambda x: x - 1), len(alphabet), key)

    return _let(
        F.split(value, ""),
        lambda chars: _let(
            F.transform(chars, lambda c: F.instr(letters, F.lower(c))),
            lambda found: _let(renumbered(found), lambda new: placed(chars, found, new)),
        ),
    )


def _luhn(digits: Column) -> Column:
    """The check digit of a text of digits."""
    doubled = F.transform(
        F.reverse(F.split(digits, "")),
        lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(
            F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10
        ),
    )
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, x: a + x), F.lit(10))


def _email(value: Column, key: Column) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    return F.concat(_letters(local, key), F.lit("@"), _letters(domain, key), F.lit(".example"))


def _ip(value: Column, key: Column) -> Column:
    numbers = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    return F.array_join(permuted(numbers, 256, key).cast("array<string>"), ".")


def _phone(value: Column, key: Column) -> Column:
    country = F.regexp_extract(value, r"^\+[0-9]{1,3}", 0)
    return F.concat(country, _one_alphabet(F.substr(value, F.length(country) + 1), ALPHABETS[0], key))


def _digits(value: Column, key: Column) -> Column:
    return _one_alphabet(value, ALPHABETS[0], key)


def _card(value: Column, key: Column) -> Column:
    def checked(front: Column, last: Column) -> Column:
        def finished(new: Column) -> Column:
            plain = lambda x: F.regexp_replace(x, "[^0-9]", "")
            kept = F.pmod(last - _luhn(plain(front)) + _luhn(plain(new)), F.lit(10))
            return F.concat(new, kept.cast("string"))

        return _let(_one_alphabet(front, ALPHABETS[0], key), finished)

    front = F.substr(value, F.lit(1), F.length(value) - 1)
    return _let(front, lambda f: checked(f, F.right(value, F.lit(1)).cast("int")))


def _name(value: Column, key: Column) -> Column:
    titles, firsts = "|".join(TITLES), _FIRST
    layout = rf"^((?:(?:{titles})\.?\x20)?)((?:(?:{firsts})(?=\x20))?)(.*)$"
    title, first, rest = (F.regexp_extract(value, layout, g) for g in (1, 2, 3))
    moved = F.lit("")
    for (gender, script), names in FIRST_NAMES.items():
        drawn = F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(gender), F.lit(script)), 256), 1, 12), 16, 10)
        step = F.pmod(drawn.cast("long"), F.lit(len(names) - 1)).cast("int") + 1
        listed = F.array(*[F.lit(n) for n in names])
        place = F.array_position(listed, first).cast("int")
        moved = F.when(place > 0, F.get(listed, F.pmod(place - 1 + step, F.lit(len(names))))).otherwise(moved)
    return F.concat(title, moved, _letters(rest, key))


def kind_of(match: Column) -> Column:
    return (
        F.when(match.contains("@"), EMAIL)
        .when(match.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}\z"), IP)
        .when(match.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}\z"), SSN)
        .when(match.rlike(r"^(?:[+(]|[0-9]{3}[.-][0-9]{3}[.-])"), PHONE)
        .when(match.rlike("^[0-9]"), CARD)
        .otherwise(NAME)
    )


def surrogate(kind: Column, value: Column, key: Column) -> Column:
    """The replacement of a value; the key of each kind is its own."""
    make = {EMAIL: _email, IP: _ip, PHONE: _phone, CARD: _card, SSN: _digits, NAME: _name}
    out = F.lit(None).cast("string")
    for name, of in make.items():
        out = F.when(kind == name, of(value, F.concat(key, F.lit(f"|{name}")))).otherwise(out)
    return out


def replace_personal_data(docs: DataFrame, key: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, the rewritten ``text``, and ``entities``: array of (kind, value, surrogate) in order of place.

    ``entities`` holds the personal data; it is for checks and must not be published.
    """
    df = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    some = F.coalesce(F.col("_text").rlike(_ANY), F.lit(False))
    none = F.array().cast("array<string>")
    df = df.withColumn("_some", some)
    df = df.withColumn("_found", F.when(F.col("_some"), F.regexp_extract_all("_text", F.lit(_ANY), 0)).otherwise(none))
    df = df.withColumn("_gaps", F.when(F.col("_some"), F.split("_text", _ANY, -1)).otherwise(none))
    df = df.withColumn("_kinds", F.transform("_found", kind_of))
    df = df.withColumn(
        "entities",
        F.transform(
            "_found",
            lambda m, i: F.struct(
                F.get("_kinds", i).alias("kind"),
                m.alias("value"),
                surrogate(F.get("_kinds", i), m, F.lit(key)).alias("surrogate"),
            ),
        ),
    )
    pieces = F.transform(
        "_gaps", lambda g, i: F.concat(g, F.coalesce(F.get("entities", i)["surrogate"], F.lit("")))
    )
    rewritten = F.when(F.col("_some"), F.array_join(pieces, "")).otherwise(F.col("_text"))
    return df.select(*keep, rewritten.alias("text"), "entities")


def count(kind: str) -> Column:
    return F.size(F.filter("entities", lambda e: e["kind"] == kind)).cast("long")


def unchanged(entity: Column) -> Column:
    """Whether a value came out as it went in; the reserved domain alone does not change an address."""
    return entity["surrogate"].isin(entity["value"], F.concat(entity["value"], F.lit(".example")))


def collisions(replaced: DataFrame) -> DataFrame:
    """(kind, surrogate, n) of surrogates that stand for more than one value, or values with more than one."""
    pairs = replaced.select(F.explode("entities").alias("e")).select("e.*").distinct()
    shared = pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    split = pairs.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), F.min("surrogate").alias("surrogate"))
    return shared.unionByName(split.filter("n > 1").select("kind", "surrogate", "n"))
