"""Surrogates and benchmark leaks."""

import ipaddress
import itertools
import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from lamina.llm import leaks, pii, queries

KEY = pii.Surrogates(b"k")
ODD = [
    None,
    "",
    "Mail ann.lee+x@mail1.example.com or call +1 (509) 555-6973, 10.1.2.3 and 238.200.65.89.",
    "Card 4111 1111 1111 1111, again 4111 1111 1111 1111, other 4026083977531332; ann.lee+x@mail1.example.com",
    "Frau Müller met Mr. Smith and Señora García. Mr. Smith left. 1.2.3 is no address, 12345 no card",
    "x.92@mail6.example.com " * 500,
]


def test_pii_odd(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)] + [(2, ODD[2], "x", 1), (None, "a@b.cc", "y", 2)], "doc_id long, text string, kind string, entities int")
    out = pii.pseudonymise(df, b"k")
    by = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(ODD) + 2 and by[0]["text"] is None and by[1]["text"] == ""
    assert [e["kind"] for e in by[2]["entities"]] == ["email", "phone", "ip", "ip"]
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4}, 10\.", by[2]["text"])
    assert [e["kind"] for e in by[3]["entities"]] == ["card", "card", "card", "email"]
    a, b, c, mail = (e["surrogate"] for e in by[3]["entities"])
    assert a == b != c and mail == by[2]["entities"][0]["surrogate"] and pii.check_digit([int(x) for x in a if x != " "][:-1]) == int(a[-1])
    names = [e["surrogate"] for e in by[4]["entities"]]
    assert names[1] == names[3] and names[0].startswith("Frau ") and names[2].startswith("Señora ") and names[2].endswith("a")
    assert pii.collisions(out).count() == 0 and pii.pseudonymise(df.limit(0), b"k").count() == 0


def test_pii_table(spark, sf):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_pii_surrogates(spark, sf).collect()
    assert len(rows) == len(text)
    pattern = re.compile(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b")
    for r in rows:
        for x in pattern.findall(text[r["doc_id"]]):
            assert x not in r["text"]
        if not pattern.search(text[r["doc_id"]]):
            assert r["text"] == text[r["doc_id"]]


def test_permutation_is_one():
    for sizes in ([3, 4, 2], [10, 10], [5, 6], [7]):
        seen = {tuple(KEY.permuted(list(v), sizes, "t")) for v in itertools.product(*map(range, sizes))}
        assert len(seen) == len(list(itertools.product(*map(range, sizes))))


@given(st.from_regex(r"[a-zA-Zé0-9._-]{1,20}", fullmatch=True), st.from_regex(r"[a-zA-Zé0-9._-]{1,20}", fullmatch=True))
def test_distinct_values_stay_distinct(a, b):
    assert (KEY.letters(a, "l") == KEY.letters(b, "l")) == (a == b)


ITEM = "What is the total distance that Anna drives when the car covers 60 km each hour during 3 hours of the trip"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (ITEM, "verbatim"),
        (f"Some words before. {ITEM.upper()} and after", "verbatim"),
        (ITEM.replace("60", "75").replace("3 hours", "8 hours").replace("Anna", "Boris"), "changed"),
        (ITEM.replace("is the total", "is total"), "verbatim"),
        ("What is this. The car drives each hour of a trip that is long and has no end in view at all", None),
        (None, None),
        ("", None),
        ("words " * 50, None),
    ],
)
def test_leak(spark, text, kind):
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, ITEM, 0), (8, None, 0), (9, "", 0), (10, "short item of five words", 0)], "item_id long, text string, kind int")
    got = [(r["doc_id"], r["item_id"], r["kind"]) for r in leaks.find_leaks(docs, bench).collect()]
    assert got == ([(1, 7, kind)] * 2 if kind else [])
    assert leaks.drop_leaks(docs, bench).count() == (0 if kind else 2)


def test_inconsistent_slots_are_no_leak():
    index = leaks.Index([(1, "Add 5 apples and 5 pears to 7 plums then count all the fruit in the bowl")])
    words = leaks.Words()
    assert index.matches(words("Add 6 apples and 6 pears to 9 plums then count all the fruit in the bowl"))[0][-1]
    assert not index.matches(words("Add 6 apples and 4 pears to 9 plums then count all the fruit in the bowl"))[0][-1]


def test_leaks_table(spark):
    """Every item that a document holds word for word is found, and nothing where no run of its words occurs."""
    sf = "/root/testdata/sf0.01"
    norm = lambda t: f" {' '.join(t.lower().split())} "
    docs = {r["doc_id"]: norm(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: norm(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op10_benchmark_decontamination(spark, sf).collect()}
    assert {(d, i) for d, t in docs.items() for i, x in items.items() if x in t} <= got
    for d, i in got:
        w = items[i].split()
        assert any(" ".join(w[k : k + 6]) in docs[d] for k in range(len(w) - 5))


def plain_windows(t):
    """What a window of a text can be compared by: kind and width, and its codes or words, by place."""
    n, out = len(t.code), {}
    for width in range(1, min(leaks.WINDOW, n) + 1):
        for k in range(n - width + 1):
            out.setdefault((False, width, tuple(t.code[k : k + width].tolist())), []).append(k)
    for width in range(1, min(leaks.WINDOW, len(t.raw)) + 1):
        for k in range(len(t.raw) - width + 1):
            out.setdefault((True, width, tuple(t.raw[k : k + width].tolist())), []).append(k)
    return out


def plain_leaks(docs, items):
    """Every document against every item, windows compared as they are."""
    words, out = leaks.Words(), []
    texts = {i: words(t or "") for i, t in items}
    for d, text in docs:
        doc = words(text or "")
        have = plain_windows(doc)
        for i, item in texts.items():
            hits = []
            for _, at, tells, width in item.entries():
                of = item.raw if tells == leaks.WORDS else item.code
                hits += [(k, at, tells) for k in have.get((tells == leaks.WORDS, width, tuple(of[at : at + width].tolist())), ())]
            found = leaks.judged(item, doc, hits) if hits else None
            if found and found[0]:
                out.append((d, i, found[1], len(item.code), found[2], found[3], "changed" if found[3] else "verbatim"))
    return sorted(out)


def test_templates_by_brute_force(spark):
    """The filter, the join and the comparison against all pairs, on items with other names, numbers and words."""
    r = random.Random(3)
    items = [(row["item_id"], row["text"]) for row in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(40).collect()]
    items += [(900 + k, x) for k, x in enumerate([ITEM, ITEM, "What is 12 + 7", "short item of five words", None, "", "Mary gave Tom 5 km of rope and 7 kg of flour for 9 usd"])]
    docs = []
    for k in range(150):
        parts = [f"Words {r.randint(1, 99)} before it."]
        for _ in range(r.randint(0, 3)):
            words = (r.choice(items)[1] or "").split()
            for _ in range(r.randint(0, 4)):
                if words:
                    at = r.randrange(len(words))
                    words[at : at + r.randint(0, 1)] = [r.choice(["17", "Boris", "plainly", "4 km", ""])]
            parts.append(" ".join(words))
        docs.append((k, " ".join(parts)))
    docs += [(500, None), (501, ""), (502, ITEM.replace("60", "75").replace("Anna", "Mary Ann"))]
    df = spark.createDataFrame(docs + [(502, docs[-1][1])], "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(x) for x in leaks.find_leaks(df, bench).collect())
    want = plain_leaks(docs + [(502, docs[-1][1])], items)
    assert got == want and any(x[-1] == "changed" for x in want)
    clean = {x["doc_id"] for x in leaks.drop_leaks(df, bench).collect()}
    assert clean == {d for d, _ in docs} - {x[0] for x in want}


def test_drop_leaks_keeps_any_columns(spark):
    df = spark.createDataFrame([(1, ITEM, 2, [3], "k"), (2, "clean text of its own", None, None, None)], "doc_id long, text string, `a.b` int, uid array<int>, passes string")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    out = leaks.drop_leaks(df, bench)
    assert out.columns == df.columns and [tuple(x) for x in out.collect()] == [(2, "clean text of its own", None, None, None)]
    assert leaks.drop_leaks(df, bench.limit(0)).count() == 2 and leaks.find_leaks(df.limit(0), bench).count() == 0


LONG = "There is much to say before and a great deal of it has been said. {} And there is as much to say after it, if not more"


@pytest.mark.parametrize(
    ("item", "inside", "found"),
    [
        ("short item of five words", "short item of five words", True),
        ("capital of which country", "Capital of which country?", True),
        ("Paris is no large town", "so Paris is no large town", True),
        ("add 12 to twenty and halve", "add 15 to twenty and halve", True),
        ("short item of five words", "short item of six words", False),
        ("12 + 7 = 19", "we know 12 + 7 = 19 well", True),
        ("12 + 7 = 19", "we know 13 + 8 = 21 well", False),
        ("sum 3 4 5 6 7 8 9 and 10 11 12 13", "sum 3 4 5 6 7 8 9 and 10 11 12 13", True),
        ("sum 3 4 5 6 7 8 9 and 10 11 12 13", "sum 5 4 3 6 7 8 9 and 10 11 12 14", True),
        ("sum 3 4 5 6 7 8 9 and 10 11 12 13", "sum 5 4 3 6 7 8 9 or 10 11 12 14", False),
        ("sum 3 4 5 6 7 8 9 and 10 11 12 13", "sum 5 4 5 6 7 8 9 and 10 11 12 14", False),
        ("3 4 5 6 7 8 9 10 11", "x 3 4 5 6 7 8 9 10 11", True),
        ("3 4 5 6 7 8 9 10 11", "x 4 5 6 7 8 9 10 11 12", False),
    ],
)
def test_short_and_dense_items_in_long_documents(item, inside, found):
    got = leaks.Index([(1, item), (2, "words of another item that is long enough for a window")]).matches(leaks.Words()(LONG.format(inside)))
    assert [m[0] for m in got if m[-1]] == [1] * found


TWO = "How many more coins than her friend has Anna left when Boris gives 12 coins to Anna and she then loses 5 coins on the way home"
FAR = "The number 12 and 5 are here. " * 3
PIECES = TWO.split()


@pytest.mark.parametrize(
    ("item", "text", "found"),
    [
        (TWO, TWO.replace("Anna", "Mary Ann").replace("Boris", "Peter Paul").replace("12", "31"), True),
        (TWO, " ".join([*PIECES[:8], "over", *PIECES[8:17], "just", *PIECES[17:]]), True),
        (TWO, " ".join([*PIECES[:8], *PIECES[9:16], *PIECES[17:]]), True),
        (TWO + " and now a word of another kind that makes the whole of it a very long item of a great many words" * 2, "I heard: " + " ".join(PIECES[4:18]) + " at last", True),
        (TWO, f"{' '.join(PIECES[:14])} marbles for Carl at noon", True),
        (TWO, "How many more coins than her friend has Anna left at the end of a day in the town", False),
        (TWO, "All the same there are many more coins in the bank. " * 4, False),
    ],
)
def test_matches_in_pieces(item, text, found):
    got = leaks.Index([(1, item)]).matches(leaks.Words()(f"{FAR}{text}. {FAR}"))
    assert [m[0] for m in got if m[-1]] == [1] * found


def test_no_value_stands_for_itself():
    for sizes in ([20, 6], [3, 4, 2], [10, 10], [7], [2]):
        for v in itertools.product(*map(range, sizes)):
            assert tuple(KEY.permuted(list(v), sizes, "t")) != v
    for name in map("".join, itertools.product("BCDFGHJKLMNPQRSTVWXZ", "aeiouy", "mnt")):
        assert KEY.name(name, "") != name
    assert KEY.name("øe", "") != "øe" and KEY.name("山田", "") != "山田"


def test_no_surrogate_is_another_original_of_the_document():
    value = KEY.name("tom", "").capitalize()
    text = f"Mr. Tom met Mr. {value} and Mr. Bob"
    new, made = pii.replace(text, KEY)
    assert not {"Tom", value, "Bob"} & set(new.replace(".", "").split())
    assert len({s for _, _, s in made}) == 3


def test_later_mentions_of_a_name_are_replaced():
    new, made = pii.replace("Dr. Anna Lopez came. Then Lopez spoke, Anna's friend Lopezia left and mail to Lopez@mail1.example.com went", KEY)
    name = made[0][2].removeprefix("Dr. ").split()
    assert f"Then {name[1]} spoke, {name[0]}'s friend Lopezia" in new and "Lopez@" not in new
    assert [k for k, _, _ in made] == ["name", "name", "name", "email"]


def test_one_value_has_one_surrogate_however_written():
    text = "Call +1 555-123-4567, (555) 123-4567, +15551234567 or 555.123.4567; John.Doe@Mail1.com, john.doe@mail1.com; +44 20 7946 0958 and +442079460958; 07700 900123"
    new, made = pii.replace(text, KEY)
    digits = lambda x: "".join(c for c in x if c.isdigit())
    phones = [s for k, _, s in made if k == "phone"]
    assert len({digits(p)[-10:] for p in phones[:4]}) == 1 and digits(phones[0])[0] == "1" and re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", phones[1])
    assert digits(phones[4]) == digits(phones[5]) and digits(phones[4]).startswith("44") and phones[6].startswith("0")
    mails = [s for k, _, s in made if k == "email"]
    assert mails[0].lower() == mails[1] and mails[0][0].isupper() and len({x for k, x, _ in made}) == 4
    assert not set(re.findall(r"\d{4,}", text)) & set(re.findall(r"\d{4,}", new))


def test_numbers_of_other_forms():
    text = "SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not XX12 ABCD EFGH; 2001:db8::8a2e:370:7334 and fe80::1, at 12:34:56"
    new, made = pii.replace(text, KEY)
    assert [k for k, _, _ in made] == ["ssn", "iban", "iban", "ip", "ip"]
    ssn, german, british, six, local = (s for _, _, s in made)
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn) and ssn != "123-45-6789"
    for iban, like in ((german, r"DE\d\d( \d{4}){4} \d\d"), (british, r"GB\d\d[A-Z]{4}\d{14}")):
        x = iban.replace(" ", "")
        assert re.fullmatch(like, iban) and pii.remainder(x[4:] + x[:4]) == 1
    assert ipaddress.ip_address(six).exploded.startswith("2001:") and local.startswith("fe80:") and "12:34:56" in new and "not XX12 ABCD EFGH" in new


def test_given_names_keep_their_gender():
    for gender, names in pii.GIVEN.items():
        assert len({KEY.name(n, "") for n in names}) == len(names) and all(KEY.name(n, "") in names and KEY.name(n, "") != n for n in names)
    others = {KEY.name(n, "") for n in ("tamsin", "borek", "annette", "müller", "zoë")}
    assert len(others) == 5 and not others & set(pii.GIVEN_PLACE)
    new, made = pii.replace("Mrs. Alice Brown met ALICE and Brown. Herr Groß-Müller", KEY)
    first = made[0][2].split()[1]
    assert first.lower() in pii.GIVEN["female"] and first.upper() in new and new.count(made[0][2].split()[2]) == 2


def test_nothing_is_raised_where_values_run_out():
    text = " ".join(f"Mr. {c}{d}" for c in "AEIOUY" for d in "aeiouy")  # as many values as the format has
    new, made = pii.replace(text, KEY)
    assert len(made) == 36 and all(len(s) == 6 for _, _, s in made)


def plain_entities(text):
    """Spans by the same patterns, one after another, each on what the earlier left."""
    taken, out = [False] * len(text), []
    found = sorted((m.start(), -m.end(), k) for k, kind in enumerate(("email", "phone", "card", "ip")) for m in getattr(pii, kind.upper()).finditer(text))
    for s, e, k in found:
        if not any(taken[s:-e]):
            taken[s:-e] = [True] * (-e - s)
            out.append((s, -e, pii.KINDS[k]))
    return out


def test_table_by_brute_force(spark, sf):
    """Every entity that the patterns find, and nothing else, is replaced; one value by one surrogate, two by two."""
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    surrogate, owner = {}, {}
    for r in queries.op7_pii_surrogates(spark, sf).collect():
        text, got = rows[r["doc_id"]], list(r["surrogates"] or [])
        if any(pii.NAME.search(text) or p.search(text) for p in (pii.SSN, pii.IBAN, pii.IPV6)):
            continue
        want, at, parts = plain_entities(text), 0, []
        assert len(want) == len(got)
        for (s, e, kind), new in zip(want, got, strict=True):
            value = pii.one_form(kind, text[s:e])
            plain = new.lower() if kind == "email" else pii.one_form(kind, new)
            assert surrogate.setdefault((kind, value), plain) == plain and owner.setdefault((kind, plain), value) == value and plain != value
            parts += [text[at:s], new]
            at = e
        assert "".join([*parts, text[at:]]) == (r["text"] or "")
    assert len(surrogate) > 10
