"""Personal data under format-preserving Feistel pseudonyms, in SQL expressions only.

E-mail addresses, phone numbers, IPv4 addresses, card numbers (Luhn), US social-security numbers, IBANs and ISO dates
are found, validated, and replaced by a keyed permutation of their own format. Equal values get equal pseudonyms in
every document; the permutation can be undone with the key only. Numbers that fail validation stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshelf.llm.spans import replaced, spans

ROUNDS = 8
#: In order of precedence at one place; all start at a word's edge, so a text is passed over once.
PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)+",
    "phone": r"(?<![\w+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.]*\d)",
    "date": r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?!\w)",
    "card": r"(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w|-\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Days of the 400-year cycle of the calendar from 1800 on: 189 x 773 of them.
FIRST_DAY, DAYS_LEFT, DAYS_RIGHT = "1800-01-01", 189, 773


def keyed(key: str, tag: str, value: Column) -> Column:
    """60 bits of a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|{tag}|"), value).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tag: str, beside: Column | None = None) -> Column:
    """struct<l, r>: a keyed permutation of [0, left_size) x [0, right_size), another for each text beside; its halves take turns."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(state: Column, k: Column) -> Column:
        even, named = k % 2 == 0, F.concat(k.cast("string"), F.lit("|"), left_size.cast("string"), F.lit("|"), right_size.cast("string"), F.lit("|"), beside if beside is not None else F.lit(""))
        moved = keyed(key, tag, F.concat(named, F.when(even, state["r"]).otherwise(state["l"]).cast("string")))
        return F.struct(
            F.when(even, F.pmod(state["l"] + F.pmod(moved, left_size), left_size)).otherwise(state["l"]).cast("long").alias("l"),
            F.when(even, state["r"]).otherwise(F.pmod(state["r"] + F.pmod(moved, right_size), right_size)).cast("long").alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def power_of_ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("long")


def permuted_digits(digits: Column, key: str, tag: str) -> Column:
    """Another digit string of the same length (2 to 36)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    left, right = digits.substr(F.lit(1), half), digits.substr(half + 1, n - half)
    new = feistel(left, right, power_of_ten(half), power_of_ten(n - half), key, tag)
    whole = F.transform(F.array(new), lambda x: F.concat(F.lpad(x["l"].cast("string"), half, "0"), F.lpad(x["r"].cast("string"), (n - half).cast("int"), "0")))
    return F.element_at(whole, 1)


def filled(number: Column, length: int) -> Column:
    return F.lpad(number.cast("string"), length, "0")


def permuted_ssn(digits: Column, key: str) -> Column:
    """Another valid number: areas 001 to 899 but 666, groups from 01 and serials from 0001 on are numbered through and permuted."""
    area, group, serial = (digits.substr(a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    new = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    return F.element_at(F.transform(F.array(new), lambda x: F.concat(filled(x["l"] + F.when(x["l"] >= 665, 2).otherwise(1), 3), filled(F.floor(x["r"] / 9999) + 1, 2), filled(x["r"] % 9999 + 1, 4))), 1)


def permuted_phone(digits: Column, key: str) -> Column:
    """Another number of ten digits: area and exchange from 200 on stay so; of other numbers their first digits stay."""
    area, exchange, line = (digits.substr(a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
    usual = feistel(area - 200, (exchange - 200) * 10_000 + line, F.lit(800), F.lit(8_000_000), key, "phone")
    first = F.concat(digits.substr(1, 1), digits.substr(4, 1))
    other = feistel(area % 100, exchange % 100 * 10_000 + line, F.lit(100), F.lit(1_000_000), key, "phone", first)

    def shown(x: Column, base: Column, more: Column) -> Column:
        return F.concat(filled(x["l"] + base, 3), filled(F.floor(x["r"] / 10_000) + more, 3), filled(x["r"] % 10_000, 4))

    return F.when((area >= 200) & (exchange >= 200), F.element_at(F.transform(F.array(usual), lambda x: shown(x, F.lit(200), F.lit(200))), 1)).otherwise(
        F.element_at(F.transform(F.array(other), lambda x: shown(x, area - area % 100, exchange - exchange % 100)), 1)
    )


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def refilled(value: Column, digits: Column) -> Column:
    """value with its digits in turn replaced by the given ones; letters and signs stay."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def step(state: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(
            (state["i"] + is_digit.cast("int")).alias("i"),
            F.concat(state["out"], F.when(is_digit, digits.substr(state["i"] + 1, F.lit(1))).otherwise(c)).alias("out"),
        )

    return F.aggregate(F.split(value, ""), start, step, lambda state: state["out"])


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum modulo 10: every second digit from the right is doubled."""
    backwards = F.split(F.reverse(digits), "")
    value = F.transform(backwards, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.pmod(F.aggregate(value, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(10))


def with_check_digit(body: Column) -> Column:
    return F.concat(body, F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))


def mod97(text: Column) -> Column:
    """The remainder of an IBAN's rearranged digits; letters count as 10 to 35."""
    number = F.transform(F.split(text, ""), lambda c: F.when(c.between("0", "9"), c).otherwise((F.ascii(c) - 55).cast("string")))
    return F.aggregate(F.split(F.array_join(number, ""), ""), F.lit(0), lambda a, c: F.pmod(a * 10 + F.coalesce(c.cast("int"), F.lit(0)), F.lit(97)))


def kind_of(value: Column) -> Column:
    """The kind of a match of ANY, null where it fails validation."""

    def whole(name: str) -> Column:
        return value.rlike(rf"\A(?:{PATTERNS[name]})\z")

    octets = F.forall(F.split(value, r"\."), lambda x: x.cast("int") <= 255)
    ssn_parts = ~value.substr(1, 3).isin("000", "666") & (value.substr(1, 1) != "9") & (value.substr(5, 2) != "00") & (value.substr(8, 4) != "0000")
    iban = mod97(F.concat(value.substr(F.lit(5), F.length(value)), value.substr(1, 4))) == 1
    return (
        F.when(value.contains("@"), "email")
        .when(whole("phone"), "phone")
        .when(whole("ip"), F.when(octets, "ip"))
        .when(whole("date"), F.when(F.try_to_date(value, "yyyy-MM-dd").between("1800-01-01", "2199-12-31"), "date"))
        .when(whole("ssn"), F.when(ssn_parts, "ssn"))
        .when(whole("iban"), F.when(iban, "iban"))
        .when(whole("card"), F.when(luhn_sum(digits_of(value)) == 0, "card"))
    )


def pseudonym(value: Column, key: str) -> Column:
    """The replacement of a match: of the same format, the same for equal values; the value itself if it isn't valid."""
    digits = digits_of(value)
    last10 = digits.substr(F.length(digits) - 9, F.lit(10))
    phone = refilled(value, F.concat(digits.substr(F.lit(1), F.length(digits) - 10), permuted_phone(last10, key)))
    octet = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    address = feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536), F.lit(65536), key, "ip")
    ip = F.element_at(F.transform(F.array(address), lambda x: F.concat_ws(".", F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256)), 1)
    day = F.datediff(F.try_to_date(value, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    new_day = feistel(F.floor(day / DAYS_RIGHT), day % DAYS_RIGHT, F.lit(DAYS_LEFT), F.lit(DAYS_RIGHT), key, "date")
    date = F.element_at(F.transform(F.array(new_day), lambda x: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (x["l"] * DAYS_RIGHT + x["r"]).cast("int")), "yyyy-MM-dd")), 1)
    card_body = digits.substr(F.lit(1), F.length(digits) - 1)
    card = refilled(value, with_check_digit(permuted_digits(card_body, key, "card")))
    inner_digits = digits_of(value.substr(F.lit(5), F.length(value)))
    inner = F.when(F.length(inner_digits) >= 2, refilled(value.substr(F.lit(5), F.length(value)), permuted_digits(inner_digits, key, "iban"))).otherwise(value.substr(F.lit(5), F.length(value)))
    iban = F.concat(value.substr(1, 2), F.lpad((98 - mod97(F.concat(inner, value.substr(1, 2), F.lit("00")))).cast("string"), 2, "0"), inner)
    name = F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(value)).cast("binary"), 256)
    email = F.concat(F.lit("p"), F.substring(name, 1, 16), F.lit("@mail.example"))
    kind = kind_of(value)
    return (
        F.when(kind == "email", email)
        .when(kind == "phone", phone)
        .when(kind == "ip", ip)
        .when(kind == "date", date)
        .when(kind == "ssn", refilled(value, permuted_ssn(digits, key)))
        .when(kind == "iban", iban)
        .when(kind == "card", card)
        .otherwise(value)
    )


def pseudonymised(text: Column, key: str) -> Column:
    """The text with every valid match under its pseudonym; null stays null."""
    return F.when(_some(text), replaced(text, ANY, lambda m: pseudonym(m, key))).otherwise(text)


def _some(text: Column) -> Column:
    return text.rlike(r"[@\d]") & text.rlike(ANY)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text (pseudonymised; null stays null), n_found, found array<struct<kind, start, end, value>>.

    start and end are code points in the original text, end exclusive; value is the original. Matches are leftmost and
    non-overlapping over the whole text; those that fail their check stay and aren't counted. Empty texts stay empty,
    repeated rows each get their row, an empty table gives none, and only the id and text columns are read. Different
    kinds have different permutations, under which valid numbers and dates stay valid. E-mail names have no fixed format
    to permute and get a keyed hash; the letters of an IBAN stay. Of matches at one place the first kind of PATTERNS is
    taken. A very long text is scanned whole, in one row.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = F.filter(
        F.transform(spans(text, ANY), lambda m: F.struct(kind_of(m["value"]).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))),
        lambda m: m["kind"].isNotNull(),
    )
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    return rows.select(
        "doc_id",
        pseudonymised(text, key).alias("text"),
        F.when(_some(text), found).otherwise(none).alias("found"),
    ).select("doc_id", "text", F.size("found").cast("long").alias("n_found"), "found")
