"""Format-preserving pseudonyms for personal data, in Spark expressions only.

Mail addresses, IPv4 addresses, calendar dates, social security numbers, phone numbers and payment
card numbers are found by one pattern and validated (octets, calendar, area and group, number of
digits, check digit). What is valid is permuted within its format by a keyed Feistel network: both
halves of the value are turned in alternation by a keyed hash of the other half, modulo the size
of the half. That is a permutation of all values of the format, so equal values get equal
pseudonyms in all documents, different values of one format stay different, and the key reverses
it. Punctuation, the country code of a phone number, the century of a date, the first
digit of a card number and a mail address's domain stay; a card number's check digit is computed
anew. Text around the findings is not touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
# Each alternative starts where a run of its characters starts, so that the search takes time in
# proportion to the text. The numeric ones are tried only at a digit, a plus sign or a bracket.
_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,8}"
_IPV4 = r"(?<![.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
_ISO_DATE = r"(?<!-)[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z]|-[0-9])"
_DAY_DATE = r"(?<![./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9A-Za-z])"
_SSN = r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
_NANP = (
    r"(?<![+])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
)
_WORLD = (
    r"(?<![+])\+[0-9]{1,3}(?:[ .-][0-9])?(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})){2,5}"
    r"(?![0-9A-Za-z])"
)
_CARD = (
    r"(?:[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"
    r"|[0-9]{13,19})(?![0-9A-Za-z])"
)
_NUMERIC = "|".join([_IPV4, _ISO_DATE, _DAY_DATE, _SSN, _NANP, _WORLD, _CARD])
# A number in front of an @ belongs to a mail address.
PATTERN = rf"(?<![0-9A-Za-z])(?:(?=[0-9+(])(?>{_NUMERIC})(?![A-Za-z0-9._%+-]*+@[A-Za-z0-9])|{_MAIL})"
# --- fixed values: country codes. Those that begin with 1 or 7 have one digit, these two, others three.
TWO_DIGIT_CODES = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48",
    "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81",
    "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)
KINDS = ("mail", "ipv4", "date", "ssn", "phone", "card")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hash(key: str, kind: Column, turn: Column, value: Column) -> Column:
    text = F.concat_ws("|", F.lit(key), kind, turn.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def _feistel(
    key: str, kind: Column, left: Column, right: Column, a: Column, b: Column
) -> Column:
    """A keyed permutation of the pairs (struct) of left < a and right < b."""

    def turned(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        moved_left = F.pmod(s["left"] + _hash(key, kind, i, s["right"]), a)
        moved_right = F.pmod(s["right"] + _hash(key, kind, i, s["left"]), b)
        return F.struct(
            F.when(odd, moved_left).otherwise(s["left"]).alias("left"),
            F.when(odd, s["right"]).otherwise(moved_right).alias("right"),
        )

    start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turned)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """A digit string of the same length (2 to 18)."""
    n = F.length(digits)
    cut = F.ceil(n / 2).cast("int")
    halves = F.substr(digits, F.lit(1), cut), F.substr(digits, cut + 1, n)
    sizes = [F.pow(F.lit(10.0), x).cast("long") for x in (cut, n - cut)]
    named = F.concat(F.lit(kind), n.cast("string"))

    def written(pair: Column) -> Column:
        left, right = pair["left"].cast("string"), pair["right"].cast("string")
        return F.concat(F.lpad(left, cut, F.lit("0")), F.lpad(right, n - cut, F.lit("0")))

    return _let(_feistel(key, named, *halves, *sizes), written)


def _refilled(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced, in order."""

    def filled(digits: Column) -> Column:
        def at(i: Column) -> Column:
            char = F.substr(shape, i, F.lit(1))
            nth = F.length(_digits(F.substr(shape, F.lit(1), i)))
            return F.when(char.between("0", "9"), F.substr(digits, nth, F.lit(1))).otherwise(char)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), at), "")

    return _let(digits, filled)


def _check_digit(payload: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substr(payload, F.length(payload) - i + 1, F.lit(1)).cast("int")
        double = 2 * digit - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, double).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), add)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _card(key: str, found: Column) -> Column:
    def moved(digits: Column) -> Column:
        n = F.length(digits)
        valid = _check_digit(F.substr(digits, F.lit(1), n - 1)) == F.right(digits, F.lit(1))
        middle = _permuted_digits(key, "card", F.substr(digits, F.lit(2), n - 2))
        payload = F.concat(F.left(digits, F.lit(1)), middle)
        checked = _let(payload, lambda x: F.concat(x, _check_digit(x)))
        return F.when(valid, _refilled(found, checked))

    return _let(_digits(found), moved)


def _ssn(key: str, found: Column) -> Column:
    area, group, serial = (F.substring(found, at, n) for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")
    # The valid numbers are counted off, areas without 000, 666 and those from 900 on, groups and
    # serial numbers from 1, and permuted among themselves.
    number = area.cast("long")
    place = number - 1 - F.when(number > 666, 1).otherwise(0)
    rest = (group.cast("long") - 1) * 9999 + serial.cast("long") - 1
    pair = _feistel(key, F.lit("ssn"), place, rest, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"))

    def written(p: Column) -> Column:
        new = p["left"] + 1 + F.when(p["left"] + 1 >= 666, 1).otherwise(0)
        parts = new, F.floor(p["right"] / 9999) + 1, p["right"] % 9999 + 1
        return F.format_string("%03d-%02d-%04d", *parts)

    return F.when(valid, _let(pair, written))


def _phone(key: str, found: Column) -> Column:
    def moved(digits: Column) -> Column:
        size = F.when(F.left(digits, F.lit(1)).isin("1", "7"), 1)
        size = size.when(F.left(digits, F.lit(2)).isin(*TWO_DIGIT_CODES), 2).otherwise(3)
        code = F.when(found.startswith("+"), F.left(digits, size)).otherwise("")
        rest = F.substr(digits, F.length(code) + 1, F.length(digits))
        made = F.concat(code, _let(rest, lambda x: _permuted_digits(key, "phone", x)))
        return F.when(F.length(digits).between(7, 15), _refilled(found, made))

    return _let(_digits(found), moved)


def _ipv4(key: str, found: Column) -> Column:
    def moved(octets: Column) -> Column:
        one, two, three, four = (octets[i] for i in range(4))
        size = F.lit(65536).cast("long")
        pair = _feistel(key, F.lit("ipv4"), one * 256 + two, three * 256 + four, size, size)
        return F.when(F.forall(octets, lambda x: x < 256), _let(pair, written))

    def written(pair: Column) -> Column:
        halves = pair["left"], pair["right"]
        parts = [p.cast("string") for x in halves for p in (F.floor(x / 256), x % 256)]
        return F.concat_ws(".", *parts)

    return _let(F.transform(F.split(found, r"\."), lambda x: x.cast("int")), moved)


def _date(key: str, day: Column, form: str) -> Column:
    """The day moved within its century and written as `form`; null for a null day."""

    def moved(day: Column) -> Column:
        century = F.floor(F.year(day) / 100)
        start = F.make_date(F.greatest(century * 100, F.lit(1)).cast("int"), F.lit(1), F.lit(1))
        end = F.make_date((century * 100 + 100).cast("int"), F.lit(1), F.lit(1))
        days = F.datediff(end, start).cast("long")
        # days = a * b, by the two numbers of days that a whole century can have
        a = F.when(days == 36524, 92).when(days == 36525, 75).otherwise(1).cast("long")
        b = F.floor(days / a)
        offset = F.datediff(day, start).cast("long")
        pair = _feistel(key, F.lit("date"), F.floor(offset / b), F.pmod(offset, b), a, b)
        to = _let(pair, lambda p: F.date_add(start, (p["left"] * b + p["right"]).cast("int")))
        return F.when(day.isNotNull(), F.date_format(to, form))

    return _let(day, moved)


def _day(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, month, day)
    return F.when(year != "0000", F.try_to_date(text, "yyyy-MM-dd"))


def _dates(key: str, found: Column) -> Column:
    """The first reading of year-month-day, day.month.year, day/month/year, month/day/year that
    is a day of the calendar."""
    iso = _day(*(F.substring(found, at, n) for at, n in ((1, 4), (6, 2), (9, 2))))
    a, b, year = (F.substring(found, at, n) for at, n in ((1, 2), (4, 2), (7, 4)))
    slash = F.substring(found, 3, 1) == "/"
    swapped = F.when(slash & _day(year, b, a).isNull(), _day(year, a, b))
    return F.when(F.substring(found, 5, 1) == "-", _date(key, iso, "yyyy-MM-dd")).otherwise(
        F.coalesce(
            F.when(slash, _date(key, _day(year, b, a), "dd/MM/yyyy")).otherwise(
                _date(key, _day(year, b, a), "dd.MM.yyyy")
            ),
            _date(key, swapped, "MM/dd/yyyy"),
        )
    )


def _shifted(text: Column, stream: Column) -> Column:
    """Each letter and digit moved within its kind by two hexadecimal digits of `stream`."""

    def at(i: Column) -> Column:
        char = F.substr(text, i, F.lit(1))
        by = F.conv(F.substr(stream, 2 * ((i - 1) % 64) + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(char)

        def within(first: int, n: int) -> Column:
            return F.char(F.pmod(code - first + by, F.lit(n)) + first)

        lower, upper = char.between("a", "z"), char.between("A", "Z")
        out = F.when(lower, within(97, 26)).when(upper, within(65, 26))
        return out.when(char.between("0", "9"), within(48, 10)).otherwise(char)

    moved = F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), at), "")
    return F.when(F.length(text) > 0, moved).otherwise("")


def _mail(key: str, found: Column) -> Column:
    name = F.substring_index(found, "@", 1)
    cut = F.floor(F.length(name) / 2).cast("int")

    def turned(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        other = F.when(odd, s["right"]).otherwise(s["left"])
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), i.cast("string"), other), 512)
        return F.struct(
            F.when(odd, _let(stream, lambda x: _shifted(s["left"], x)))
            .otherwise(s["left"])
            .alias("left"),
            F.when(odd, s["right"])
            .otherwise(_let(stream, lambda x: _shifted(s["right"], x)))
            .alias("right"),
        )

    start = F.struct(
        F.left(name, cut).alias("left"), F.substr(name, cut + 1, F.length(name)).alias("right")
    )
    out = F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, turned)
    moved = _let(out, lambda p: F.concat(p["left"], p["right"]))
    return F.concat(moved, F.substr(found, F.length(name) + 1, F.length(found)))


def _kind(found: Column) -> Column:
    return (
        F.when(found.contains("@"), "mail")
        .when(found.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), "ipv4")
        .when(found.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date")
        .when(found.rlike(r"^[0-9]{2}[./][0-9]{2}[./][0-9]{4}$"), "date")
        .when(found.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(found.rlike(r"^[+(]|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$"), "phone")
        .otherwise("card")
    )


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of one finding; null where it is not valid."""
    kind = _kind(found)
    return (
        F.when(kind == "mail", _mail(key, found))
        .when(kind == "ipv4", _ipv4(key, found))
        .when(kind == "date", _dates(key, found))
        .when(kind == "ssn", _ssn(key, found))
        .when(kind == "phone", _phone(key, found))
        .otherwise(_card(key, found))
    )


def pseudonymised(
    docs: DataFrame, key: str, text_col: str = "text", findings_col: str | None = None
) -> DataFrame:
    """`docs` with the personal data in `text_col` replaced; rows and other columns stay.

    `findings_col` names a further column: an array of (kind, old, new) of what was replaced, in
    the order of the text; an existing column of that name is replaced. A null text stays null and
    has no findings, an empty text stays empty. What looks like personal data but is not valid
    stays. A permutation may map a value to itself, once in as many cases as its format has values.
    """
    taken = {c.lower() for c in docs.columns}
    names = (f"found{'_' * i}" for i in range(len(taken) + 2))
    found, made = [n for n in names if n not in taken][:2]
    text = F.col(f"`{text_col}`")
    search = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    out = docs.withColumn(found, F.when(text.rlike("[0-9@]"), search))
    each = F.transform(
        found,
        lambda x: F.struct(_kind(x).alias("kind"), x.alias("old"), pseudonym(x, key).alias("new")),
    )
    out = out.withColumn(made, F.when(F.size(found) > 0, each))
    new = F.transform(made, lambda x: F.coalesce(x["new"], x["old"]))
    woven = F.zip_with(
        F.split(text, PATTERN, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))
    )
    replaced = F.when(F.size(found) > 0, F.array_join(woven, "")).otherwise(text)
    out = out.withColumn(text_col, replaced)
    if findings_col:
        valid = F.filter(made, lambda x: x["new"].isNotNull())
        out = out.withColumn(findings_col, F.coalesce(valid, F.filter(made, lambda x: F.lit(False))))
        empty = F.array().cast("array<struct<kind:string,old:string,new:string>>")
        out = out.withColumn(findings_col, F.coalesce(F.col(f"`{findings_col}`"), empty))
    return out.drop(found, made)
