import datetime
import random
import re

from docquarry.llm.private import CALLING_CODE, QUERY_KEY, mask_private, op1_pseudonyms, pseudonymise
from tests.llm.data import odd, store, table, with_extra


def luhn(n):
    d = [int(c) for c in re.sub(r"\D", "", n)][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def card(prefix, length=16):
    body = prefix + "".join(random.choice("0123456789") for _ in range(length - 1 - len(prefix)))
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def iban(country, account):
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{country}{98 - int(number) % 97:02d}{account}"


def masked(spark, texts):
    return [r["text"] for r in mask_private(table(spark, texts), "key").orderBy("doc_id").collect()]


def shape(value):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", value)))


def test_formats_stay_valid_and_one_to_one(spark):
    random.seed(5)
    cards = [card("4") for _ in range(40)] + [card("37", 15), card("62", 19)]
    spaced = [" ".join(re.findall("....", card("5"))) for _ in range(5)]
    dates = [(datetime.date(1900, 1, 1) + datetime.timedelta(days=random.randrange(70_000))) for _ in range(40)]
    ips = [".".join(str(random.randrange(256)) for _ in range(4)) for _ in range(40)]
    ssns = [f"{random.choice([1, 123, 665, 667, 899]):03d}-{random.randrange(1, 100):02d}-{random.randrange(1, 10000):04d}" for _ in range(40)]
    phones = ["+1 (988) 555-2485", "+49 30 1234567", "(415) 555-0134", "415-555-0134", "+442071838750"]
    mails = ["bosbt.42@mail8.example.com", "Anna.Lee+x@a-b.co.uk", "q_1@x.org"]
    ibans = [iban("DE", "370400440532013000"), iban("GB", "WEST12345698765432")]
    iso, dotted, slashed = [d.isoformat() for d in dates], [d.strftime("%d.%m.%Y") for d in dates[:9]], [d.strftime("%m/%d/%Y") for d in dates[:9]]
    values = [*dict.fromkeys([*cards, *spaced, *iso, *dotted, *slashed, *ips, *ssns, *phones, *mails, *ibans])]
    new = masked(spark, [f"see {v}, ok" for v in values])
    new = [t.removeprefix("see ").removesuffix(", ok") for t in new]
    pairs = dict(zip(values, new))
    assert len(set(new)) == len(set(values))
    for old, got in pairs.items():
        if old not in ips:
            assert shape(old) == shape(got), (old, got)
    assert sum(a == b for a, b in pairs.items()) <= 1
    assert all(luhn(pairs[c]) for c in cards + spaced)
    assert all(datetime.date.fromisoformat(pairs[d]) for d in iso)
    # one value in three ways of writing stays one value
    for a, b, c in zip(iso[:9], dotted, slashed):
        assert datetime.datetime.strptime(pairs[b], "%d.%m.%Y").date().isoformat() == pairs[a]
        assert datetime.datetime.strptime(pairs[c], "%m/%d/%Y").date().isoformat() == pairs[a]
    assert all(all(0 <= int(o) < 256 for o in pairs[i].split(".")) for i in ips)
    for s in ssns:
        area, group, serial = pairs[s].split("-")
        assert area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    for i in ibans:
        assert iban(pairs[i][:2], pairs[i][4:]) == pairs[i]
    assert pairs[phones[0]].startswith("+1 (") and pairs[mails[0]].endswith("@mail8.example.com")


def test_invalid_values_stay(spark):
    texts = ["card 4041894974608796", "ip 300.1.2.3", "date 2023-02-30", "ssn 666-12-1234", "DE00370400440532013000", "v 1.2.3", "0000000000000000", "1234567"]
    assert masked(spark, texts) == texts


def test_equal_values_stay_linked(spark):
    a, b = masked(spark, ["x bosbt.42@mail8.example.com and 42.144.35.254 y", "42.144.35.254 | bosbt.42@mail8.example.com"])
    mail = re.search(r"\S+@\S+", a)[0]
    ip = re.search(r"\d+\.\d+\.\d+\.\d+", a)[0]
    assert b == f"{ip} | {mail}" and "bosbt" not in a


def test_neighbours_are_told_apart(spark):
    random.seed(6)
    a, b = card("4"), card("5")
    values = [
        ["+1 (826) 555-4081", "190.137.223.204"], [a, "42"], [a, b], ["+49 30 1234567", "10.1.2.3"], ["+44 20 7183 8750", a],
        ["42.1.2.3", "+1 (988) 555-2485"], [" ".join(re.findall("....", a)), "7"], ["a.b@x.org", a], ["2024-01-31", "12:30"],
    ]
    for row, new in zip(values, masked(spark, [" ".join(v) for v in values])):
        for v in row:
            assert (v in new) == (len(v) < 6), (v, new)


def test_what_is_refused_hides_nothing(spark):
    random.seed(7)
    be, es, no, de = iban("BE", "539007547034"), iban("ES", "21000418450200051332"), iban("NO", "86011117947"), iban("DE", "370400440532013000")
    spaced = lambda v: " ".join(re.findall(".{1,4}", v))
    a, b = card("4"), card("5")
    wrong = next(f"{n} {spaced(a)}" for n in range(1000, 9999) if not luhn(f"{n}{a[:12]}"))
    # text, and the values in it that must go; all else must stay
    rows = [
        (f"{be} EUR", [be]), (f"{spaced(es)} BIC", [spaced(es)]), (f"{spaced(be)} 12 2024", [spaced(be)]), (f"{spaced(no)} 12", [spaced(no)]),
        (f"{spaced(de)} {spaced(es)} 7", [spaced(de), spaced(es)]), (f"DE00 {spaced(a)} 12 x", [spaced(a)]), (wrong, [spaced(a)]),
        (f"{wrong} {spaced(b)} 1", [spaced(a), spaced(b)]), ("1234 5678 9012 2024-01-15", ["2024-01-15"]), (f"BE00 {spaced(be)} X", [spaced(be)]),
        ("+49 30 1234567 2024-01-15", ["+49 30 1234567", "2024-01-15"]), ("+44 20 7183 8750 12", ["+44 20 7183 8750"]),
        ("+49 30 1234567 20240115", ["+49 30 1234567"]), (f"+49 30 1234567 {spaced(a)}", ["+49 30 1234567", spaced(a)]),
        ("+49 30 1234567 (415) 555-0134", ["+49 30 1234567", "(415) 555-0134"]), ("+33 1 23 45 67 89 31.01.2024", ["+33 1 23 45 67 89", "31.01.2024"]),
        ("x 31/01/2024 y 13/40/2024", ["31/01/2024"]), ("+44 (0)20 7183 8750.", ["+44 (0)20 7183 8750"]),
        (f"a-{a}@x.org 2024-01-15", [f"a-{a}", "2024-01-15"]),
    ]
    for (text, values), found in zip(rows, [r["_found"] for r in pseudonymise(table(spark, [t for t, _ in rows]), QUERY_KEY).orderBy("doc_id").collect()]):
        assert [f["value"].removesuffix("@x.org") for f in found] == values, (text, found)
    for (text, values), new in zip(rows, masked(spark, [t for t, _ in rows])):
        assert "@" in text or shape(new) == shape(text), (text, new)
        for v in values:
            assert v not in new, (text, new)
            text = text.replace(v, "\n", 1)
        kept = [part for part in text.split("\n") if part.strip()]
        assert all(part in new for part in kept), (kept, new)


def test_the_same_number_before_a_number_stays_linked(spark):
    a, b = masked(spark, ["+44 20 7183 8750 12", "+44 20 7183 8750"])
    assert a == f"{b} 12"


def test_day_first_dates_are_one_to_one(spark):
    days = [datetime.date(1999, 1, 1) + datetime.timedelta(days=i) for i in range(0, 4000, 3)]
    late = [d.strftime("%d/%m/%Y") for d in days if d.day > 12]
    new = [t.split()[1] for t in masked(spark, [f"on {v} x" for v in late])]
    assert len(set(new)) == len(late) and sum(a == b for a, b in zip(late, new)) <= 1
    assert all(datetime.datetime.strptime(t, "%d/%m/%Y").day > 12 and 1600 <= int(t[-4:]) < 2000 or 2000 <= int(t[-4:]) < 2400 for t in new)


def test_a_long_run_of_refused_cards(spark):
    random.seed(8)
    a = " ".join(re.findall("....", card("4")))
    text = " ".join(["1000"] * 60_000) + " x " + a
    row = pseudonymise(table(spark, [text]), QUERY_KEY).collect()[0]
    assert not luhn("1000" * 4) and [f["value"] for f in row["_found"]] == [a]


def test_odd_rows(spark):
    df = with_extra(odd(spark))
    got = mask_private(df, "key")
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert mask_private(table(spark, []), "key").count() == 0


def test_counts_in_a_long_text(spark):
    text = " ".join(f"word{i} 42.144.35.{i % 250}" for i in range(3000))
    row = pseudonymise(table(spark, [text]), QUERY_KEY).collect()[0]
    assert len(row["_found"]) == 3000 and all(f["new"] for f in row["_found"])
    assert re.sub(r"\d+\.\d+\.\d+\.\d+", "", row["text"]) == re.sub(r"\d+\.\d+\.\d+\.\d+", "", text)


def test_query_against_plain_search(spark, sf, tmp_path):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op1_pseudonyms(spark, sf).collect():
        t = docs[r["doc_id"]]
        assert r["n_email"] == len(re.findall(r"[\w.]+@[\w.]+\.com", t))
        assert r["n_card"] == len([c for c in re.findall(r"(?<!\d)\d{16}(?!\d)", t) if luhn(c)])
        assert r["n_phone"] == len(re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", t))
        for v in re.findall(r"[\w.]+@[\w.]+\.com|(?<!\d)\d{16}(?!\d)|\+1 \(\d{3}\) \d{3}-\d{4}", t):
            assert v not in r["text"] or (v.isdigit() and not luhn(v))
        if not r["n_replaced"]:
            assert r["text"] == t
    assert op1_pseudonyms(spark, store(odd(spark), tmp_path)).count() == 25


def test_a_phone_number_in_any_spelling_is_one(spark):
    """No digit after the calling code stays by rule, and another key gives other values."""
    groups = [
        ["+49 30 1234567", "+49301234567", "+49 (0)30 1234567", "+49-30-123-4567", "+49 30 123 45 67"],
        ["+1 (212) 555-0100", "+12125550100", "(212) 555-0100", "212-555-0100", "+1 212.555.0100"],
        ["+358 40 1234567", "+358401234567"],
    ]
    codes = ["49", "1", "358"]
    plain = lambda t: re.sub(r"\D", "", t.replace("(0)", "").removeprefix("call "))
    for spellings, code in zip(groups, codes):
        new = masked(spark, [f"call {s}" for s in spellings])
        own = {plain(t).removeprefix(code) if "+" in t else plain(t) for t in new}
        assert len(own) == 1 and own != {plain(spellings[0]).removeprefix(code)}
        assert all(shape(a) == shape(f"call {b}") for a, b in zip(new, spellings))
    df = table(spark, [f"call {s}" for g in groups for s in g])
    other = [r["text"] for r in mask_private(df, "another").orderBy("doc_id").collect()]
    assert not set(other) & set(masked(spark, [f"call {s}" for g in groups for s in g]))
    firsts = {(re.match(r"\+49 (\d\d)", t) or [0, ""])[1] for t in masked(spark, [f"+49 30 12345{i:02d}" for i in range(40)])}
    assert len(firsts) > 10


def test_calling_codes():
    """Each digit string begins with one code; some known ones."""
    for number, code in {"12125550100": "1", "74951234567": "7", "49301234567": "49", "358401234": "358", "35312345": "353", "442071838750": "44", "8801234": "880", "2021234": "20", "2121234": "212"}.items():
        assert re.match(CALLING_CODE, number)[1] == code
