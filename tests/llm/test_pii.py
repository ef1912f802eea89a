"""Pseudonyms: validity, links, invertibility on small domains, untouched rest."""

import datetime
import re

from pyspark.sql import functions as F

from tidewire.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_ok(v):
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def changed(spark, texts, key="secret"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(docs, key=key).orderBy("row.doc_id").collect()]


def test_kinds(spark):
    values = {
        "4111 1111 1111 1111": lambda v: luhn(v.replace(" ", "")) and v[4] == " " and v[0] == "4",
        "378282246310005": lambda v: luhn(v) and len(v) == 15,
        "DE89370400440532013000": lambda v: iban_ok(v) and v[:2] == "DE",
        "GB29NWBK60161331926819": lambda v: iban_ok(v) and v[4:8] == "NWBK",
        "+1 (386) 555-3733": lambda v: re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", v),
        "123-45-6789": lambda v: re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", v),
        "25.86.162.211": lambda v: len(v.split(".")) == 4 and all(0 <= int(x) <= 255 for x in v.split(".")),
        "2024-02-29": lambda v: datetime.date.fromisoformat(v).year in range(1900, 2100),
        "31/12/1999": lambda v: datetime.datetime.strptime(v, "%d/%m/%Y"),
        "bob.42@mail6.example.com": lambda v: v.endswith("@pseudonym.invalid"),
    }
    texts = [f"see {v}, then é {v}." for v in values]
    out = changed(spark, texts)
    for (value, valid), text in zip(values.items(), out, strict=True):
        one, two = re.fullmatch(r"see (.*), then é (.*)\.", text).groups()
        assert one == two != value and valid(one), (value, text)
    assert changed(spark, texts) == out and changed(spark, texts, key="other") != out


def test_left_alone(spark):
    texts = [
        None, "", "plain words", "4111 1111 1111 1112", "2023-02-29 and 45/45/2000", "999.1.1.1", "000-12-3456 666-12-3456", "DE88370400440532013000",
        "version 1.2.3 of 12 things", "x " * 50000, 'token = "392c32d5b55f97ff33fc3fc853cf31109db4ef39"',
    ]
    assert changed(spark, texts) == texts


def test_permutations(spark):
    pairs = spark.range(30 * 7).select((F.col("id") / 7).cast("long").alias("a"), (F.col("id") % 7).alias("b"))
    moved = pairs.select(pii.feistel(F.col("a"), F.col("b"), F.lit(30), F.lit(7), F.lit("k"), "key").alias("m")).select("m.*")
    assert moved.distinct().count() == 210 and moved.where("left < 0 OR left >= 30 OR right < 0 OR right >= 7").isEmpty()
    digits = spark.range(1000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "key").alias("d"))
    assert digits.distinct().count() == 1000


def test_rows(spark):
    docs = spark.createDataFrame([(1, "on 2020-01-01", "r"), (1, "on 2020-01-01", "r"), (None, None, None)], "doc_id long, text string, row string")
    rows = pii.pseudonymise(docs, key="k")
    assert rows.count() == 3 and {r.n_replaced for r in rows.collect()} == {0, 1}
    assert pii.pseudonymise(docs.limit(0), key="k").collect() == []


def test_phones(spark):
    values = [
        "+1 (017) 555-7713", "+1 (132) 555-1352", "+1 (386) 055-3733", "(017) 555-7713", "017-555-7713", "3865553733", "(386)5553733", "+13865553733",
        "+44 20 7946 0958", "+442079460958", "+49 (0)30 1234567", "+358 9 123456", "+7 (495) 123-45-67",
    ]
    for value, text in zip(values, changed(spark, [f"call {v}, or ({v}) é" for v in values]), strict=True):
        one, two = re.fullmatch(r"call (.*), or \((.*)\) é", text).groups()
        assert one == two != value and re.sub("[0-9]", "0", one) == re.sub("[0-9]", "0", value), (value, text)
        assert value[0] != "+" or one.startswith(re.match(r"\+(1|7|44|49|358)", value)[0])
        digits, new = (re.sub("[^0-9]", "", x)[-10:] for x in (value, one))
        assert value[:2] != "+1" or all((digits[i] < "2") == (new[i] < "2") for i in (0, 3)), (value, text)
    # One number in several forms stays one number.
    forms = changed(spark, ["+1 (017) 555-7713", "(017) 555-7713", "017.555.7713"])
    assert len({re.sub("[^0-9]", "", x)[-10:] for x in forms}) == 1
    quiet = ["1700000000 and 100000 2020", "a 3865553733abc", "x+13865553733", "+1234567"]
    assert changed(spark, quiet) == quiet


def test_phone_permutation(spark):
    for low, high in ((0, 200), (200, 1000)):
        ids = spark.range(low, high).select(F.concat(F.lit("017"), F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("0042")).alias("d"))
        moved = ids.select(pii._national(F.col("d"), "key").alias("d"))
        assert moved.distinct().count() == high - low and moved.where(f"length(d) <> 10 OR d >= '2' OR substr(d, 4, 3) < {low} OR substr(d, 4, 3) >= {high}").isEmpty()


def test_numbers_side_by_side(spark):
    """A value keeps its pseudonym whatever numbers stand beside it."""
    card, iban = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
    alone, alone_iban = changed(spark, [card, iban])
    assert luhn(alone.replace(" ", "")) and alone != card and iban_ok(alone_iban.replace(" ", "")) and alone_iban != iban
    bare, dashed = alone.replace(" ", ""), alone.replace(" ", "-")
    cases = {
        "pay 4111111111111111 12 now": f"pay {bare} 12 now", f"42 {card}": f"42 {alone}", f"{card} 42": f"{alone} 42", f"1234 {card}": f"1234 {alone}",
        f"{card} 5678 9012": f"{alone} 5678 9012", "x 4111-1111-1111-1111, 7": f"x {dashed}, 7", f"{card} 123": f"{alone} 123", f"20 {iban} 12": f"20 {alone_iban} 12",
        f"{iban} MORE WORD": f"{alone_iban} MORE WORD", f"to {iban.replace(' ', '')} on": f"to {alone_iban.replace(' ', '')} on", f"{iban}\x01{card}": f"{alone_iban}\x01{alone}",
    }
    assert dict(zip(cases, changed(spark, list(cases)), strict=True)) == cases
    amex = changed(spark, ["3782 822463 10005 and 378282246310005 9"])[0]
    assert amex[:17].replace(" ", "") == amex[22:37] and luhn(amex[22:37]) and amex[4] == amex[11] == " "


def test_dates_and_addresses(spark):
    one, two, three = changed(spark, ["12/31/2024", "31/12/2024", "2024-12-31"])
    assert datetime.datetime.strptime(one, "%m/%d/%Y") == datetime.datetime.strptime(two, "%d/%m/%Y") == datetime.datetime.fromisoformat(three) != datetime.datetime(2024, 12, 31)
    low, high, dashed = changed(spark, ["at 02:1a:ff:00:00:07.", "at 02:1A:FF:00:00:07.", "at 02-1a-ff-00-00-07."])
    assert re.fullmatch(r"at ([0-9a-f]{2}:){5}[0-9a-f]{2}\.", low) and high == low.upper().replace("AT", "at") and dashed == low.replace(":", "-") and "02:1a:ff" not in low
    six, other = changed(spark, ["2001:db8:0:0:0:0:0:1 x", "2001:db8:0:0:0:0:0:2 x"])
    assert re.fullmatch(r"([0-9a-f]{1,4}:){7}[0-9a-f]{1,4} x", six) and six != other and six.split(":")[:4] == other.split(":")[:4]
    quiet = ["12:30:45:10", "02:1a:ff:00:00:07:aa", "13/32/2024", "a::b"]
    assert changed(spark, quiet) == quiet


def feistel(left, right, sizes, kind, key):
    """The same steps on plain numbers."""
    import hashlib

    for i in range(1, pii.ROUNDS + 1):
        draw = int(hashlib.sha256(f"{key}:{kind}:{i}:{right if i % 2 else left}".encode()).hexdigest()[:15], 16)
        if i % 2:
            left = (left + draw % sizes[0]) % sizes[0]
        else:
            right = (right + draw % sizes[1]) % sizes[1]
    return left, right


def by_hand(value, key):
    """Pseudonyms of card, address and date by hand."""
    if re.fullmatch(r"[0-9]{16}", value):
        inner = value[1:-1]
        a, b = feistel(int(inner[:7]), int(inner[7:]), (10**7, 10**7), "card-14", key)
        body = f"{value[0]}{a:07d}{b:07d}"
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))
    if "." in value:
        p = list(map(int, value.split(".")))
        a, b = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], (65536, 65536), "address", key)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    number = (datetime.date.fromisoformat(value) - datetime.date(1970, 1, 1)).days - pii.FIRST_DAY
    a, b = feistel(number // pii.DAYS, number % pii.DAYS, (pii.DAYS, pii.DAYS), "date", key)
    return (datetime.date(1970, 1, 1) + datetime.timedelta(a * pii.DAYS + b + pii.FIRST_DAY)).isoformat()


def test_steps_by_hand(spark):
    values = ["4111111111111111", "5500005555555559", "10.0.0.1", "255.1.2.3", "2024-02-29", "1900-01-01"]
    for key in ("one", "two"):
        assert changed(spark, values, key=key) == [by_hand(v, key) for v in values]
