"""Quality rules, surrogates and conversations on small tables."""

import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chatcollapse, quality_rules, surrogates

TEXTS = ["", None, " \t\n", "a b c a b c a b c x", "one\ntwo\none\n \n\none", "# * $ % & | < > w", "é " * 60, "a b c\x0bd\x0ce " * 500]


def direct_counts(text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    judged = quality_rules.judge(quality_rules.measure(docs.drop("n_words"), ["doc_id"])).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in quality_rules.COUNTS) for r in judged] == [direct_counts(t) for t in TEXTS]
    assert judged[0].failed_rules == "n_words" and not judged[0].kept
    assert "repeat_word_ratio" in judged[7].failed_rules
    assert quality_rules.measure(docs.limit(0), ["doc_id"]).count() == 0


def test_rules_are_one_projection(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = quality_rules.judge(quality_rules.measure(docs, ["doc_id"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


PERSONAL = [
    "",
    None,
    "Mail Bob.Smith+x@mail6.Example.com or ..68@mail7.example.com, +1 (017) 555-7713 at 169.122.221.182",
    "cards 4111111111111111, 4111-1111-1111-1111 and 9807915762804490; 9807915762804490 again",
    "Mrs Anna Müller met John O'Brien and Иван Петров; Herr Schmidt too. John O'Brien left.",
    "no data: 1.2.3, version 3. 2.0. 999.1.1.1",
    "+1 (826) 555-4081 190.137.223.204 and +1 (826) 555-4081",
    "call (212) 555-0123 or 212.555.0123, number 078-05-1120; parts 12-34-5678 and 1-2-3",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed([int(d) for d in digits if d.isdigit()])):
        total += c if i % 2 == 0 else sum(divmod(2 * c, 10))
    return total % 10


@pytest.fixture(scope="module")
def replaced(spark):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(PERSONAL)], "doc_id long, text string, entities string")
    return surrogates.replace_personal_data(docs, "key", ["doc_id"]).orderBy("doc_id").collect()


def test_surrogates_keep_kind_and_format(replaced):
    assert replaced[0].text == "" and replaced[1].text is None and replaced[5].text == PERSONAL[5]
    shape = lambda s: "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in s)
    for row in replaced:
        for e in row.entities:
            assert e.value != e.surrogate
            if e.kind == "email":
                assert shape(e.surrogate) == shape(e.value) + ".aaaaaaa"
            elif e.kind == "ip":
                assert all(0 <= int(x) <= 255 for x in e.surrogate.split("."))
            elif e.kind in ("phone", "card", "ssn"):
                assert shape(e.surrogate) == shape(e.value)
            if e.kind == "card":
                assert luhn(e.surrogate) == luhn(e.value)
            if e.kind == "phone" and e.value[0] == "+":
                assert e.surrogate.startswith("+1 ")
    assert [e.kind for e in replaced[2].entities] == ["email", "email", "phone", "ip"]
    assert [e.kind for e in replaced[6].entities] == ["phone", "ip", "phone"]
    assert [e.kind for e in replaced[7].entities] == ["phone", "phone", "ssn"]


def test_surrogates_keep_identity_gender_and_script(replaced):
    cards = [e.surrogate for e in replaced[3].entities]
    assert cards[2] == cards[3] and cards[0] == cards[1].replace("-", "")
    names = {e.value: e.surrogate for e in replaced[4].entities}
    assert len(names) == 4 and replaced[4].text.count(names["John O'Brien"]) == 2
    first = lambda value: names[value].removeprefix("Mrs ").split()[0]
    lists = surrogates.FIRST_NAMES
    assert first("Mrs Anna Müller") in lists["female", "latin"] and first("John O'Brien") in lists["male", "latin"]
    assert first("Иван Петров") in lists["male", "cyrillic"] and names["Herr Schmidt"].startswith("Herr ")


def test_surrogates_never_meet(spark):
    phones = spark.range(3000).select(F.format_string("+1 (%03d) 555-%04d", F.col("id") % 10, F.col("id")).alias("text"), "id")
    addresses = spark.range(3000).select(F.expr("concat('10.0.', id div 256, '.', id % 256)").alias("text"), "id")
    mails = spark.range(500).select(F.format_string("a%d@x.org", "id").alias("text"), "id")
    every = phones.unionAll(addresses).unionAll(mails)
    found = surrogates.replace_personal_data(every, "key", ["id"])
    assert found.filter(F.size("entities") != 1).count() == 0
    assert surrogates.collisions(found).count() == 0
    other = surrogates.replace_personal_data(mails, "other key", ["id"])
    assert other.join(found.filter("text LIKE '%@%'"), "text", "left_semi").count() < 20


FOREIGN = ["Παπαδόπουλος", "Łęckiżść", "Čapková", "Ґжицькїєв", "Ğüneşoğlu"]
LOCALS = ["γιώργος", "محمدعلي", "ישראלה", "王小明李", "김철수박", "žofiečš", "たなかさん", "𠀋𠀌𠀍𠀎", "७८९४२"]


def test_surrogates_leave_no_letter_as_it_was(spark):
    texts = [f"Dr. {n}" for n in FOREIGN] + [f"{n}@x.org" for n in LOCALS]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = surrogates.replace_personal_data(docs, "key", ["id"])
    rows = found.orderBy("id").collect()
    for text, row in zip(texts, rows):
        (e,) = row.entities
        old, new = (x.removeprefix("Dr. ").split("@")[0] for x in (e.value, e.surrogate))
        assert text == e.value and row.text == e.surrogate and old != new and len(old) == len(new)
        assert [unicodedata.category(c) for c in old] == [unicodedata.category(c) for c in new]
    assert surrogates.collisions(found).count() == 0
    assert found.filter(F.exists("entities", surrogates.unchanged)).count() == 0
    singles = spark.createDataFrame([(chr(c) + "@x.org",) for c in range(0x4E00, 0x4E00 + 600)], "text string")
    assert surrogates.collisions(surrogates.replace_personal_data(singles, "key", [])).count() == 0


TURNS = [
    (1, 0, "user", "hello"),
    (1, 1, "assistant", "hi"),
    (2, 0, "user", "hello"),
    (2, 1, "assistant", "hi"),
    (2, 2, "user", "more"),
    (3, 0, "user", "hello"),
    (3, 1, "assistant", "hi"),
    (3, 2, "user", "more"),
    (4, 0, "user", "hello"),
    (4, 1, "assistant", "other"),
    (5, None, None, None),
    (None, 0, "user", "hello"),
    (None, 7, "user", "x"),
    (6, 3, "b", "tie"),
    (6, 3, "a", "tie"),
    (6, 3, "a", "tie"),
    *[(7, i, "user", "hello" if i == 0 else "again") for i in range(40)],
    *[(8, i, "user", "hello" if i == 0 else "again") for i in range(15)],
]


@pytest.mark.parametrize("turns_per_slice", [3, 4096])
def test_snapshots(spark, monkeypatch, turns_per_slice):
    monkeypatch.setattr(chatcollapse, "SLICE_TURNS", turns_per_slice)
    rows = spark.createDataFrame([(*t, "c") for t in TURNS], "conv_id long, turn long, role string, text string, slice string").repartition(4)
    placed = chatcollapse.positions(rows, "conv_id", "turn", "role", "text")
    found = chatcollapse.collapse(chatcollapse.prefixes(placed))
    talks = {}
    low = lambda x: (x is not None, x)
    for c, t, r, x in sorted(TURNS, key=lambda t: (low(t[0]), low(t[1]), low(t[2]), low(t[3]))):
        talks.setdefault(c, []).append((r or "", x or ""))
    expected = {}
    for c, talk in talks.items():
        snapshot = any(len(o) > len(talk) and o[: len(talk)] == talk for o in talks.values())
        equals = [k for k, o in talks.items() if o == talk and k is not None]
        expected[c] = (len(talk), snapshot, not snapshot and c == min(equals, default=None))
    assert {r.conv: (r.n_turns, r.is_snapshot, r.kept) for r in found.collect()} == expected
    shown = chatcollapse.render(placed, found).orderBy("conv", "position").collect()
    kept = {c for c, e in expected.items() if e[2]}
    assert {(r.conv, r.position, r.rendered) for r in shown} == {
        (c, i, f"<|{r}|>\n{x}\n") for c in kept for i, (r, x) in enumerate(talks[c], 1)
    }
    assert len(shown) == sum(len(talks[c]) for c in kept)


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    placed = chatcollapse.positions(none, "conv_id", "turn", "role", "text")
    assert chatcollapse.collapse(chatcollapse.prefixes(placed)).count() == 0
