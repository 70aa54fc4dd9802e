"""Personal numbers, dates and addresses replaced by keyed pseudonyms of the same format.

Each kind has a pattern, a test, and a Feistel permutation over its own format, so a value keeps its
length, separators and validity, two different values never become equal, and equal values get equal
pseudonyms in whatever document they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import bind, feistel, free_name

#: The key of the query, whose results are compared; a user gives a secret one.
QUERY_KEY = "pseudonyms-1"
ROUNDS = 8

#: Calling codes by their first digits (E.164): 1, 7, these of two digits, all others of three.
CALLING_CODE = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

#: Length of an IBAN by country (the registry of ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Digits after the calling code, fewest and most, where a country's numbers hardly differ in length.
PHONE_LENGTHS = {
    (7, 7): "354", (8, 8): "45 47 65 852", (8, 9): "32 36 51 66 886 971 972", (7, 9): "46 353",
    (9, 9): "27 31 33 34 40 41 48 56 61 351 380 420 421 966", (9, 10): "44 81 84 92", (10, 10): "7 30 52 57 58 90 91 98",
    (10, 11): "54 55 86",
}
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_IP = rf"{_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
_M, _D = "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"
_DATE = rf"(?:[0-9]{{4}}-{_M}-{_D}|{_D}\.{_M}\.[0-9]{{4}}|{_M}/{_D}/[0-9]{{4}}|{_D}/{_M}/[0-9]{{4}})(?![0-9/-])"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_LOCAL = r"(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9-])"
_CARD = (
    rf"(?:[0-9]{{13,19}}|[0-9]{{4}}(?:(?: (?!{_DATE})[0-9]{{4}}){{3}}|(?:-[0-9]{{4}}){{3}}| [0-9]{{6}} [0-9]{{5}}|-[0-9]{{6}}-[0-9]{{5}}))(?![0-9])"
)
#: What begins after a blank is not part of a phone number; a local number only after eight digits.
_OTHER = f"{_DATE}|{_IP}|{_SSN}|{_CARD}"
_NEAR, _FAR = (rf"(?:(?: (?!{other})|[.-])?\(?[0-9]\)?)" for other in (_OTHER, f"{_OTHER}|{_LOCAL}"))


def _ibans() -> str:
    forms = []
    for n, countries in IBAN_LENGTHS.items():
        tail = f"(?: ?[A-Z0-9]{{{n % 4}}})" if n % 4 else ""
        forms.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}{tail}")
    return f"(?<![A-Za-z0-9])(?:{'|'.join(forms)})(?![A-Za-z0-9])"


def _phones() -> str:
    """North American, by the country's length, any other of 8 to 15 digits (E.164), local."""
    forms = [r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"]
    for (least, most), codes in PHONE_LENGTHS.items():
        forms.append(rf"\+(?:{codes.replace(' ', '|')})(?:[ .-]?\(0\))?{_NEAR}{{{min(least, 6)}}}{_FAR}{{{least - min(least, 6)},{most - min(least, 6)}}}(?![0-9])")
    forms.append(rf"\+[0-9]{_NEAR}{{7}}{_FAR}{{0,7}}(?![0-9])")
    forms += [r"(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])", r"(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])"]
    return "|".join(forms)


#: Kind and pattern (fixed values of the formats). At one place each has one match at most, which is the whole value.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": _ibans(),
    "date": rf"(?<![0-9./-]){_DATE}",
    "ip": rf"(?<![0-9.]){_IP}",
    "ssn": rf"(?<![0-9-]){_SSN}",
    "card": rf"(?<![0-9]){_CARD}",
    "phone": _phones(),
}
KINDS = list(PATTERNS)
#: Where a value other than an address may begin: more places than there are values.
START = (
    r"(?=(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4} ?[A-Z0-9]{4}|(?<![0-9])(?:[0-9]{13}|[0-9]{4}[ -][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"|[0-9]{2}([./])[0-9]{2}\1[0-9]{4}|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]|[0-9]{3}-[0-9]{2,3}-[0-9]{4}|\([0-9]{3}\) ?[0-9]{3}-)"
    r"|\+[0-9](?:[ .-]?\(?[0-9]\)?){7})"
)
#: Characters that no value but an address goes beyond, with what its pattern looks ahead at; pieces that hold as many.
REACH, PIECES = 120, 40
#: Text without one of these holds no value of any kind, and isn't looked at further.
HINT = r"@|[0-9][0-9 ()./-]{4}|[0-9]\.[0-9]|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"

#: The days of 1600-01-01 to 1999-12-31, and those of any 400 years after: 189 * 773.
ERA_DAYS, ERA_LEFT, ERA_RIGHT = 146_097, 189, 773
#: Those of them after the twelfth of a month: 9 * 9,833. Only they are written day first between slashes.
LATE_DAYS, LATE_LEFT, LATE_RIGHT = 88_497, 9, 9_833
ERA_START = "date '1600-01-01'"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(number: Column) -> Column:
    """The sum that is divisible by ten for a valid number (digits only)."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        doubled = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add)


def mod_97(value: Column) -> Column:
    """The remainder of a number that may have letters (A is 10) by 97, character by character."""

    def add(rest: Column, c: Column) -> Column:
        letter = (rest * 100 + F.ascii(c) - 55) % 97
        return F.when(c.rlike("[0-9]"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise(letter).cast("int")

    return F.aggregate(F.split(value, ""), F.lit(0), add)


def _plain_iban(value: Column) -> Column:
    return F.replace(value, F.lit(" "), F.lit(""))


def _day_first(value: Column) -> Column:
    """Whether a date with slashes can only be read day first: 31/01/2024. 05/03/2024 is the third of May."""
    return (F.substring(value, 3, 1) == "/") & (F.substring(value, 1, 2) > "12")


def _day(value: Column) -> Column:
    """The date written as 2024-01-31, 31.01.2024, 01/31/2024 or 31/01/2024; null if there is no such day."""
    part = lambda a, n: F.substring(value, a, n)
    month_first = (part(3, 1) == "/") & (part(1, 2) <= "12")
    iso = (
        F.when(part(5, 1) == "-", value)
        .when(month_first, F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2)))
        .otherwise(F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2)))
    )
    return F.call_function("try_to_date", iso, F.lit("yyyy-MM-dd"))


def is_valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern is a value: check digits, calendar, ranges."""
    plain = _plain_iban(value)
    area, day = F.substring(value, 1, 3), _day(value)
    tests = {
        "iban": lambda: mod_97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1,
        "card": lambda: (luhn_sum(digits(value)) % 10 == 0) & value.rlike("[1-9]"),
        "date": lambda: F.coalesce(F.year(day).between(1600, 2399), F.lit(False)),
        "ssn": lambda: ~area.isin("000", "666") & (area < "900") & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000"),
    }
    return tests.get(kind, lambda: F.lit(True))()


def permute_text(value: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the texts of one pattern of digits, capitals and small letters.

    The text is halved; in turns the digits and letters of one half move within their own kind by a
    hash of the other. All else stays. Equal lengths and patterns make this one to one.
    """
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("u"), F.substring(value, half + 1, F.length(value)).alias("v"))

    def turn(pair: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), pair["v"]), 256)

        def moved(hexed: Column) -> Column:
            def one(c: Column, at: Column) -> Column:
                by = F.conv(F.substring(hexed, (at % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
                ring = lambda first, n: F.char(first + (F.ascii(c) - first + by) % n)
                return (
                    F.when(c.between("0", "9"), ring(48, 10)).when(c.between("a", "z"), ring(97, 26))
                    .when(c.between("A", "Z"), ring(65, 26)).otherwise(c)
                )

            return F.concat_ws("", F.transform(F.split(pair["u"], ""), one))

        return F.struct(pair["v"].alias("u"), bind(digest, moved).alias("v"))

    return bind(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn), lambda p: F.concat(p["u"], p["v"]))


def _refill(pattern: Column, new: Column) -> Column:
    """``pattern`` with its digits replaced, in order, by the digits ``new``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda s, c: F.struct(
        F.concat(s["out"], F.when(c.between("0", "9"), F.substring(new, s["at"], F.lit(1))).otherwise(c)).alias("out"),
        (s["at"] + c.between("0", "9").cast("int")).alias("at"),
    )
    return F.aggregate(F.split(pattern, ""), start, step, lambda s: s["out"])


def _number(value: Column, left: int, right: int, key: str) -> Column:
    return feistel(value.cast("long"), left, right, key, ROUNDS)


def _late_day(day: Column, key: str) -> Column:
    """The pseudonym of a day after the twelfth of its month, among such days of the same 400 years."""
    start = F.expr(ERA_START)
    month = lambda m: F.add_months(start, m.cast("int"))
    # how many such days lie before month m
    before = lambda m: F.datediff(month(m), start) - 12 * m
    months = (F.year(day) - 1600) * 12 + F.month(day) - 1

    def write(n: Column) -> Column:
        era = F.floor(n / LATE_DAYS)
        new = era * LATE_DAYS + _number(n - era * LATE_DAYS, LATE_LEFT, LATE_RIGHT, f"{key}|late")

        def dated(r: Column) -> Column:
            guess = F.floor(r * 4800 / LATE_DAYS)
            at = bind(guess, lambda g: g - 1 + (before(g) <= r).cast("int") + (before(g + 1) <= r).cast("int"))
            return bind(at, lambda m: F.date_add(month(m), (r - before(m) + 12).cast("int")))

        return bind(new, dated)

    return bind(before(months) + F.dayofmonth(day) - 13, write)


def pseudonym(kind: Column, value: Column, key: str) -> Column:
    """The pseudonym of a valid value. Of an address the name changes, of a phone number all but the calling code."""
    number = digits(value)
    padded = lambda n, width: F.lpad(n.cast("string"), width, "0")

    def card(n: Column) -> Column:
        payload = permute_text(F.substring(n, F.lit(1), F.length(n) - 1), key, F.lit("card"))
        with_check = lambda p: F.concat(p, ((10 - luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10).cast("string"))
        return _refill(value, bind(payload, with_check))

    def ip(v: Column) -> Column:
        start = F.lit(0).cast("long")
        whole = F.aggregate(F.split(v, "\\."), start, lambda t, o: t * 256 + o.cast("long"))
        byte = lambda n, k: F.shiftright(n, k).bitwiseAND(F.lit(255)).cast("string")
        new = _number(whole, 65_536, 65_536, f"{key}|ip")
        return bind(new, lambda n: F.concat_ws(".", byte(n, 24), byte(n, 16), byte(n, 8), byte(n, 0)))

    def date(v: Column) -> Column:
        since = F.datediff(_day(v), F.expr(ERA_START))
        start = F.expr(ERA_START)

        def write(n: Column) -> Column:
            era = F.floor(n / ERA_DAYS)
            return F.date_add(start, (era * ERA_DAYS + _number(n - era * ERA_DAYS, ERA_LEFT, ERA_RIGHT, f"{key}|date")).cast("int"))

        new = bind(since, write)
        month_first = bind(new, lambda d: F.when(F.substring(v, 5, 1) == "-", F.date_format(d, "yyyy-MM-dd"))
                           .when(F.substring(v, 3, 1) == ".", F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")))
        return F.when(_day_first(v), F.date_format(_late_day(_day(v), key), "dd/MM/yyyy")).otherwise(month_first)

    def ssn(n: Column) -> Column:
        # 898 areas, 99 groups and 9,999 serial numbers, each counted without those that are never given out
        area = F.substring(n, 1, 3).cast("long")
        rank = F.when(area > 666, area - 2).otherwise(area - 1)
        low = (F.substring(n, 4, 2).cast("long") - 1) * 9_999 + F.substring(n, 6, 4).cast("long") - 1
        new = _number(rank * 989_901 + low, 898, 989_901, f"{key}|ssn")

        def write(x: Column) -> Column:
            a, rest = F.floor(x / 989_901), x % 989_901
            return F.concat_ws(
                "-", padded(F.when(a >= 665, a + 2).otherwise(a + 1), 3),
                padded(F.floor(rest / 9_999) + 1, 2), padded(rest % 9_999 + 1, 4),
            )

        return bind(new, write)

    def iban(v: Column) -> Column:
        country, account = F.substring(v, 1, 2), F.substring(v, F.lit(5), F.length(v))
        spelt = F.regexp_replace(value, "[A-Z0-9]", "0")

        def write(a: Column) -> Column:
            check = F.lit(98) - mod_97(F.concat(a, country, F.lit("00")))
            return _refill(spelt, F.concat(country, padded(check, 2), a))

        return bind(permute_text(account, key, F.concat(F.lit("iban"), country)), write)

    def phone(v: Column) -> Column:
        # the zero in brackets is no part of the number; one without a calling code is North American
        spelt = F.replace(v, F.lit("(0)"), F.lit("(~)"))
        code = F.when(v.startswith("+"), F.regexp_extract(digits(spelt), CALLING_CODE, 1)).otherwise("")

        def write(c: Column) -> Column:
            own = F.substring(digits(spelt), F.length(c) + 1, F.length(v))
            tweak = F.concat(F.lit("phone"), F.when(c == "", "1").otherwise(c))
            return F.replace(_refill(spelt, F.concat(c, permute_text(own, key, tweak))), F.lit("(~)"), F.lit("(0)"))

        return bind(code, write)

    def email(v: Column) -> Column:
        return F.concat(
            permute_text(F.substring_index(v, "@", 1), key, F.concat(F.lit("email"), F.lower(F.substring_index(v, "@", -1)))),
            F.lit("@"), F.substring_index(v, "@", -1),
        )

    return (
        F.when(kind == "email", email(value)).when(kind == "card", bind(number, card)).when(kind == "ip", ip(value))
        .when(kind == "date", date(value)).when(kind == "ssn", bind(number, ssn))
        .when(kind == "iban", bind(_plain_iban(value), iban)).when(kind == "phone", phone(value)).otherwise(value)
    )


def _candidates(pieces: Column) -> Column:
    """For each piece the value (kind, value) that begins with it, or null. The first piece may begin anywhere."""

    def at(heads: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            # one character from before the piece, for the patterns to look back at
            last = F.when(i > 0, F.right(F.get(pieces, i - 1), F.lit(1))).otherwise(F.lit("\n"))
            seen = F.concat(last, F.substring(F.concat_ws("", F.slice(heads, i + 1, F.lit(PIECES))), 1, REACH))

            def first(window: Column) -> Column:
                def valid(kind: str) -> Column:
                    match = F.regexp_extract(window, f"(?s)^.({PATTERNS[kind]})", 1)
                    return bind(match, lambda v: F.when((v != "") & is_valid(kind, v), F.struct(F.lit(kind).alias("kind"), v.alias("value"))))

                return F.coalesce(*[valid(kind) for kind in KINDS if kind != "email"])

            return bind(seen, first)

        return F.transform(heads, one)

    return bind(F.transform(pieces, lambda p: F.substring(p, 1, REACH)), at)


def _covered(pieces: Column, values: Column) -> Column:
    """For each piece how many of its characters, and of those after it, belong to a value that began before it.

    A value that begins where another still goes on is none. The pieces are gone through in blocks of
    about the root of their number, so that a long text's list isn't copied at each of them.
    """
    n = F.size(pieces)
    width = F.ceil(F.sqrt(n)).cast("int")

    def blocks(by: Column) -> Column:
        def block(state: Column, b: Column) -> Column:
            inner = F.struct(state["left"].alias("left"), F.array().cast("array<int>").alias("out"))

            def step(s: Column, i: Column) -> Column:
                value = F.length(F.get(values, i)["value"])
                here = F.when(s["left"] > 0, s["left"]).otherwise(F.coalesce(value, F.lit(0)))
                return F.struct(
                    F.greatest(here - F.length(F.get(pieces, i)), F.lit(0)).alias("left"),
                    F.array_append(s["out"], s["left"]).alias("out"),
                )

            done = F.aggregate(F.sequence(b * by, F.least((b + 1) * by, n) - 1), inner, step)
            return bind(done, lambda d: F.struct(d["left"].alias("left"), F.array_append(state["out"], d["out"]).alias("out")))

        start = F.struct(F.lit(0).alias("left"), F.array().cast("array<array<int>>").alias("out"))
        last = F.ceil(n / by).cast("int") - 1
        return F.aggregate(F.sequence(F.lit(0), last), start, block, lambda s: F.flatten(s["out"]))

    return bind(width, blocks)


def _scanned(text: Column, key: str) -> Column:
    """array<struct<kind, value, new, after>> of a text without addresses: its values, each with the text after it.

    The first has no value (null) and the text before all others. The text is cut wherever a value may
    begin and each place is tested by itself, so what looks like a value and isn't hides none that
    begins within it. Of values that overlap the first stays.
    """

    def taken(pieces: Column, values: Column, covered: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            value = F.when(F.get(covered, i) == 0, F.get(values, i))
            cut = F.coalesce(F.length(value["value"]), F.get(covered, i))
            return F.struct(
                value["kind"].alias("kind"), value["value"].alias("value"),
                F.when(value.isNotNull(), pseudonym(value["kind"], value["value"], key)).alias("new"),
                F.substring(piece, cut + 1, F.length(piece)).alias("after"),
            )

        return F.transform(pieces, one)

    cut = F.split(text, START, -1)
    return bind(cut, lambda p: bind(_candidates(p), lambda v: bind(_covered(p, v), lambda c: taken(p, v, c))))


SCANNED = "array<struct<kind:string,value:string,new:string,after:string>>"


def found_values(text: Column, key: str) -> Column:
    """array<struct<kind, value, new, after>>: the values of a text in order, and all text between them as ``after``.

    Addresses are found first, the others in what lies between them.
    """
    none = F.lit(None).cast("string")
    mails = F.regexp_extract_all(text, F.lit(f"({PATTERNS['email']})"), F.lit(1))
    plain = lambda t: F.array(F.struct(none.alias("kind"), none.alias("value"), none.alias("new"), t.alias("after"))).cast(SCANNED)
    scanned = lambda t: F.when(t.rlike(START), _scanned(t, key).cast(SCANNED)).otherwise(plain(t))
    mail = lambda v: F.when(v.isNotNull(), F.array(F.struct(
        F.lit("email").alias("kind"), v.alias("value"), pseudonym(F.lit("email"), v, key).alias("new"), F.lit("").alias("after")
    ))).otherwise(F.array()).cast(SCANNED)
    between = F.split(text, PATTERNS["email"], -1)
    return F.flatten(F.zip_with(between, mails, lambda t, v: F.concat(scanned(t), mail(v))))


def pseudonymise(documents: DataFrame, key: str, found: str = "_found") -> DataFrame:
    """All columns and rows, the values in ``text`` replaced, with ``found``: array<struct<kind, value, new>>, in order.

    Each row by itself, no shuffle. Null texts stay null and have found nothing; a text without a valid
    value is unchanged. Values that overlap are taken from the left, after the addresses. Where a phone
    number's country has no one length, a separate number behind it that fits counts as part of it.
    Whoever has ``key`` can undo the pseudonyms, and another key gives others. A column that has the name ``found`` is replaced; any other may occur.
    """
    text = F.col("text")
    parts = documents.withColumn(found, F.when(text.rlike(HINT), found_values(text, key)).otherwise(F.array().cast(SCANNED)))
    woven = F.concat_ws("", F.flatten(F.transform(found, lambda m: F.array(F.coalesce(m["new"], m["value"], F.lit("")), m["after"]))))
    values = F.transform(F.filter(found, lambda m: m["new"].isNotNull()), lambda m: F.struct(*[m[c].alias(c) for c in ("kind", "value", "new")]))
    changed = F.exists(F.col(found), lambda m: m["new"].isNotNull())
    return parts.withColumns({"text": F.when(changed, woven).otherwise(text), found: values})


def mask_private(documents: DataFrame, key: str) -> DataFrame:
    """The documents with pseudonyms in their texts, in the columns they came with."""
    return pseudonymise(documents, key, free_name(documents, "_found")).select(*documents.columns)


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms, the number of values replaced, and how many of each kind."""
    rows = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_KEY)
    count = lambda kind: F.size(F.filter(F.col("_found"), lambda m: m["kind"] == kind))
    replaced = F.size("_found")
    return rows.select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"),
        replaced.cast("long").alias("n_replaced"), *[count(k).cast("long").alias(f"n_{k}") for k in KINDS],
    )
