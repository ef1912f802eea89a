"""Format-preserving pseudonyms for personal values: keyed Feistel permutations inside each value's format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# What counts as a candidate of a kind. The first alternative that matches a place wins.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
# An account number as one word, or printed in groups of four with a shorter last one.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
# Phone numbers: three, three and four digits after a plus and a country, other numbers after a plus (8 to 15 digits), three,
# three and four digits divided or in brackets, and ten digits in a row where area and exchange start with 2 to 9.
BARE = r"(?<![0-9A-Za-z+.-])(?:1[ .-]?)?"
PHONE = "|".join(
    (
        r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
        r"(?<![0-9A-Za-z+])\+[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9])",
        BARE + r"(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-]|\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-])[0-9]{4}(?![0-9])",
        BARE + r"[2-9][0-9]{2}[ .-]?[2-9][0-9]{6}(?![0-9A-Za-z_])",
    )
)
# Country codes of one and two digits; all others have three.
COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9]|[/.-][0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
HARDWARE = r"(?<![0-9A-Za-z:-])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Za-z:-])|(?<![0-9A-Za-z:-])[0-9A-Fa-f]{2}(?:-[0-9A-Fa-f]{2}){5}(?![0-9A-Za-z:-])"
ADDRESS6 = r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:.])"
# Card numbers in their printed layouts: groups of four (any number of them: the first four that are valid count), four, six and
# five digits, four, six and four, or 13 to 19 digits unbroken. Other spacings join numbers that only stand side by side.
GROUPS = r"(?<![0-9-])[0-9]{4}(?: [0-9]{4}){3,}(?![0-9-])|(?<![0-9-])[0-9]{4}(?:-[0-9]{4}){3,}(?![0-9-])"
CARD = GROUPS + r"|(?<![0-9-])[0-9]{4}(?: [0-9]{6} |-[0-9]{6}-)[0-9]{4,5}(?![0-9-])|(?<![0-9-])[0-9]{13,19}(?![0-9-])"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, IBAN, SOCIAL, DATE, HARDWARE, ADDRESS6, CARD, PHONE, ADDRESS))
CUT = "\x01"  # divides values from the text around them; texts that hold it take a second search

FIRST_DAY = -25567  # 1900-01-01
DAYS = 270  # dates are permuted among 270 * 270 days from then on


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _draw(key: str, kind: Column, round_: Column, half: Column) -> Column:
    """A keyed number below 2^60 of a round and of the other half."""
    salted = F.concat_ws(":", F.lit(key), kind, round_.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(salted, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, kind: Column, key: str) -> Column:
    """A keyed permutation of the pairs (left < left_size, right < right_size), as struct(left, right).

    The halves are moved in turn by a number drawn from the other one; every step can be undone, so two
    values never share a pseudonym.
    """

    def step(s: Column, i: Column) -> Column:
        a = F.when(i % 2 == 1, F.pmod(s["left"] + F.pmod(_draw(key, kind, i, s["right"]), left_size), left_size)).otherwise(s["left"])
        b = F.when(i % 2 == 0, F.pmod(s["right"] + F.pmod(_draw(key, kind, i, s["left"]), right_size), right_size)).otherwise(s["right"])
        return F.struct(a.alias("left"), b.alias("right"))

    start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(digits: Column, kind: str, key: str) -> Column:
    """A string of 2 to 36 digits permuted among those of its length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    tag = F.concat(F.lit(f"{kind}-"), F.length(digits).cast("string"))
    moved = feistel(F.substr(digits, F.lit(1), half).cast("long"), F.substr(digits, half + 1, rest).cast("long"), _power(half), _power(rest), tag, key)
    return _let(moved, lambda m: F.concat(F.lpad(m["left"].cast("string"), half, "0"), F.lpad(m["right"].cast("string"), rest, "0")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _into(shape: Column, digits: Column) -> Column:
    """The digits put in place of the shape's digits, in order; all other characters stay."""
    slots = F.split(shape, "")
    seen = F.aggregate(
        slots,
        F.struct(F.lit("").alias("text"), F.lit(1).alias("at")),
        lambda s, c: F.when(
            c.rlike("[0-9]"), F.struct(F.concat(s["text"], F.substr(digits, s["at"], F.lit(1))).alias("text"), (s["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(s["text"], c).alias("text"), s["at"].alias("at"))),
    )
    return seen["text"]


def luhn(digits: Column) -> Column:
    """The weighted digit sum of a card number; a valid one's is divisible by ten."""
    places = F.sequence(F.lit(1), F.length(digits))

    def weigh(i: Column) -> Column:
        d = F.substr(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(places, weigh), F.lit(0), lambda s, x: s + x)


def mod97(iban: Column) -> Column:
    """The remainder of an IBAN with its first four characters moved to the end and letters as numbers."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda s, c: F.pmod(s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)).cast("int")
    )


def _card(v: Column, key: str) -> Column:
    d = _digits(v)
    inner = F.substr(d, F.lit(2), F.length(d) - 2)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_digits(inner, "card", key), F.lit("0"))
    new = _let(body, lambda b: F.concat(F.substr(b, F.lit(1), F.length(b) - 1), F.pmod(10 - luhn(b), F.lit(10)).cast("string")))
    return F.when(luhn(d) % 10 == 0, _into(v, new)).otherwise(v)


def _groups(v: Column, key: str) -> Column:
    """Groups of four digits: the first four groups in a row that are a valid card number are replaced."""
    groups = F.split(v, "[ -]")
    starts = F.filter(F.sequence(F.lit(1), F.size(groups) - 3), lambda i: luhn(F.array_join(F.slice(groups, i, F.lit(4)), "")) % 10 == 0)

    def replaced(at: Column) -> Column:
        card = F.array_join(F.slice(groups, at, F.lit(4)), " ")
        parts = F.concat(F.slice(groups, F.lit(1), at - 1), F.split(_card(card, key), " "), F.slice(groups, at + 4, F.size(groups)))
        return F.when(at.isNull(), v).otherwise(_into(v, F.array_join(parts, "")))

    return _let(F.get(starts, F.lit(0)), replaced)


def _hardware(v: Column, key: str) -> Column:
    """48 bits, in the letters' case of the value."""
    hexes = F.lower(F.regexp_replace(v, "[:-]", ""))
    half = lambda at: F.conv(F.substr(hexes, F.lit(at), F.lit(6)), 16, 10).cast("long")
    moved = feistel(half(1), half(7), F.lit(1 << 24), F.lit(1 << 24), F.lit("hardware"), key)
    plain = _let(moved, lambda m: F.lower(F.concat(F.lpad(F.hex(m["left"]), 6, "0"), F.lpad(F.hex(m["right"]), 6, "0"))))
    shown = _let(plain, lambda p: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(11), F.lit(2)), lambda i: F.substr(p, i, F.lit(2))), ":"))
    shown = F.replace(shown, F.lit(":"), F.substr(v, F.lit(3), F.lit(1)))
    return F.when(F.upper(v) == v, F.upper(shown)).otherwise(shown)


def _address6(v: Column, key: str) -> Column:
    """Both halves of 64 bits are permuted on their own, so addresses of one network stay together."""
    groups = F.transform(F.split(F.lower(v), ":"), lambda g: F.conv(g, 16, 10).cast("long"))
    halves = []
    for tag, at in (("network", 0), ("interface", 4)):
        moved = feistel(groups[at] * 65_536 + groups[at + 1], groups[at + 2] * 65_536 + groups[at + 3], F.lit(1 << 32), F.lit(1 << 32), F.lit(tag), key)
        numbers = _let(moved, lambda m: F.array(F.floor(m["left"] / 65_536), m["left"] % 65_536, F.floor(m["right"] / 65_536), m["right"] % 65_536))
        halves.append(F.transform(numbers, lambda n: F.lower(F.hex(n.cast("long")))))
    return F.array_join(F.concat(*halves), ":")


def _national(digits: Column, key: str) -> Column:
    """Ten digits: an area and an exchange that start with 2 to 9 stay so, and so do those that start with 0 or 1."""

    def part(at: int) -> tuple[Column, Column, Column]:
        number = F.substr(digits, F.lit(at), F.lit(3)).cast("int")
        low = number < 200
        return number, F.when(low, 0).otherwise(200), F.when(low, 200).otherwise(800)

    (area, area_from, areas), (office, office_from, offices) = part(1), part(4)
    moved = feistel((area - area_from) * offices + office - office_from, F.substr(digits, F.lit(7)).cast("int"), areas * offices, F.lit(10_000), F.lit("phone"), key)
    return _let(
        moved,
        lambda m: F.concat(
            F.lpad((F.floor(m["left"] / offices) + area_from).cast("string"), 3, "0"),
            F.lpad((m["left"] % offices + office_from).cast("string"), 3, "0"),
            F.lpad(m["right"].cast("string"), 4, "0"),
        ),
    )


def _phone(v: Column, key: str) -> Column:
    """The country stays; the digits after it are permuted, ten of them as with no country."""

    def new(d: Column) -> Column:
        lead = F.when(v.startswith("+"), F.regexp_extract(d, COUNTRY, 0)).otherwise(F.substr(d, F.lit(1), F.length(d) - 10))
        rest = F.substr(d, F.length(lead) + 1)
        return F.concat(lead, _let(rest, lambda r: F.when(F.length(r) == 10, _national(r, key)).otherwise(permute_digits(r, "phone", key))))

    return _into(v, _let(_digits(v), new))


def _address(v: Column, key: str) -> Column:
    p = F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
    moved = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65_536), F.lit(65_536), F.lit("address"), key)
    new = _let(
        moved,
        lambda m: F.concat_ws(
            ".", F.floor(m["left"] / 256).cast("string"), (m["left"] % 256).cast("string"), F.floor(m["right"] / 256).cast("string"), (m["right"] % 256).cast("string")
        ),
    )
    return F.when(F.array_max(p) <= 255, new).otherwise(v)


def _date(v: Column, key: str) -> Column:
    iso = F.substr(v, F.lit(5), F.lit(1)) == "-"
    # Day first; a date that is only valid with the month first is read and shown so.
    plain = F.regexp_replace(v, "[.]", "/")
    first = F.coalesce(F.when(iso, F.try_to_date(v, "yyyy-MM-dd")), F.try_to_date(plain, "dd/MM/yyyy"))
    day = F.coalesce(first, F.try_to_date(plain, "MM/dd/yyyy"))
    number = F.datediff(day, F.lit("1970-01-01").cast("date")) - FIRST_DAY

    def moved(n: Column) -> Column:
        pair = feistel(F.floor(n / DAYS), n % DAYS, F.lit(DAYS), F.lit(DAYS), F.lit("date"), key)
        new = _let(pair, lambda m: F.date_from_unix_date((m["left"] * DAYS + m["right"] + FIRST_DAY).cast("int")))
        mark = F.substr(v, F.lit(3), F.lit(1))
        divided = F.when(first.isNull(), F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd/MM/yyyy"))
        shown = F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.regexp_replace(divided, "/", mark))
        return F.when(n.between(0, DAYS * DAYS - 1), shown).otherwise(v)

    return F.when(number.isNull(), v).otherwise(_let(number, moved))


def _social(v: Column, key: str) -> Column:
    area, group, serial = F.substr(v, F.lit(1), F.lit(3)).cast("int"), F.substr(v, F.lit(5), F.lit(2)).cast("int"), F.substr(v, F.lit(8)).cast("int")
    # Areas 001 to 899 without 666.
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    moved = feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9_999), F.lit("social"), key)

    def shown(m: Column) -> Column:
        at = F.floor(m["left"] / 99)
        return F.concat_ws(
            "-",
            F.lpad(F.when(at >= 665, at + 2).otherwise(at + 1).cast("string"), 3, "0"),
            F.lpad((m["left"] % 99 + 1).cast("string"), 2, "0"),
            F.lpad((m["right"] + 1).cast("string"), 4, "0"),
        )

    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, _let(moved, shown)).otherwise(v)


def _iban(v: Column, key: str) -> Column:
    """An account number with its check digits anew. Printed in groups it may be followed by words that look like
    groups: the longest valid beginning that ends with a group counts."""

    def checked(part: Column) -> Column:
        plain = F.replace(part, F.lit(" "), F.lit(""))
        account = F.substr(plain, F.lit(5))
        new = F.concat(F.substr(plain, F.lit(1), F.lit(2)), F.lit("00"), _into(account, permute_digits(_digits(account), "iban", key)))
        digits = _let(new, lambda n: F.concat(F.lpad((98 - mod97(n)).cast("string"), 2, "0"), _digits(F.substr(n, F.lit(5)))))
        return _into(part, digits)

    groups = F.split(v, " ")
    lengths = F.when(F.size(groups) == 1, F.array(F.lit(1))).otherwise(F.sequence(F.size(groups), F.lit(3), F.lit(-1)))
    part = lambda n: F.array_join(F.slice(groups, F.lit(1), n), " ")
    plain = lambda n: F.replace(part(n), F.lit(" "), F.lit(""))
    fits = F.filter(lengths, lambda n: (F.length(plain(n)) >= 15) & (mod97(plain(n)) == 1) & (F.length(_digits(F.substr(plain(n), F.lit(5)))) >= 2))

    def shown(n: Column) -> Column:
        return F.when(n.isNull(), v).otherwise(F.concat(checked(part(n)), F.substr(v, F.length(part(n)) + 1)))

    return _let(F.get(fits, F.lit(0)), shown)


def _email(v: Column, key: str) -> Column:
    """Mail names have no fixed format to permute in: a keyed digest takes the name's place."""
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}:email:"), F.lower(v)), 256), 1, 16), F.lit("@pseudonym.invalid"))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a candidate; a value that is not valid for its kind stays."""

    def is_a(pattern: str) -> Column:
        return value.rlike(f"^(?:{pattern})$")

    return (
        F.when(value.contains("@"), _email(value, key))
        .when(is_a("[A-Z]{2}.*"), _iban(value, key))
        .when(is_a("[0-9]{3}-[0-9]{2}-[0-9]{4}"), _social(value, key))
        .when(is_a("[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}"), _date(value, key))
        .when(is_a("[0-9]{1,3}([.][0-9]{1,3}){3}"), _address(value, key))
        .when(is_a(HARDWARE), _hardware(value, key))
        .when(is_a(ADDRESS6), _address6(value, key))
        .when(is_a(GROUPS), _groups(value, key))
        .when(is_a(CARD), _card(value, key))
        .when(is_a(PHONE), _phone(value, key))
        .otherwise(_card(value, key))
    )


def pseudonymise(docs: DataFrame, *, key: str) -> DataFrame:
    """All rows as ``row`` with the text in which valid personal values are replaced, n_values and n_replaced.

    Kinds: card numbers (Luhn), IBANs (mod 97), phone numbers, US social security numbers, IPv4 and full IPv6 addresses, hardware
    addresses, dates from 1900-01-01 to 2099-08-04 (day first, else month first), and mail addresses. Numbers and dates are permuted within their format by the key: the
    pseudonym is valid too, keeps its separators, differs for different values, and is the same for equal ones
    in all documents. Formats that fail validation stay as they are. The work is row by row, so nothing is
    shuffled and no value can be hot. Null stays null with no values; empty texts, repeated rows and empty tables
    are handled as any other; input columns stay inside ``row`` and cannot clash.
    """
    text = F.col("text").cast("string")
    # One search marks the values; then texts are cut at the marks. A text that holds the mark itself is searched twice.
    cut = F.split(F.regexp_replace(text, ANY, f"{CUT}$0{CUT}"), CUT)
    marked = docs.select(F.struct("*").alias("row"), text.alias("body"), F.contains(text, F.lit(CUT)).alias("held"), F.inline(F.array(F.struct(cut.alias("cut")))))
    turn = lambda odd: F.filter("cut", lambda x, i: i % 2 == odd)
    parts = marked.select(
        "row", "body",
        F.when(F.col("held"), F.regexp_extract_all("body", F.lit(ANY), F.lit(0))).otherwise(turn(1)).alias("values"),
        F.when(F.col("held"), F.split("body", ANY)).otherwise(turn(0)).alias("gaps"),
    )
    # The generator keeps the optimizer from repeating the work for each use below.
    changed = parts.select("row", "body", F.inline(F.array(F.struct("values", "gaps", F.transform("values", lambda v: pseudonym(v, key)).alias("names")))))
    woven = F.array_join(F.zip_with("gaps", F.concat("names", F.array(F.lit(""))), lambda gap, name: F.concat(gap, name)), "")
    differ = F.filter(F.arrays_zip("values", "names"), lambda p: p["values"] != p["names"])
    return changed.select(
        "row",
        F.when(F.size("values") > 0, woven).otherwise(F.col("body")).alias("text"),
        F.coalesce(F.size("values"), F.lit(0)).cast("long").alias("n_values"),
        F.coalesce(F.size(differ), F.lit(0)).cast("long").alias("n_replaced"),
    )
