import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from textlens.llm import pseudonyms, queries

KEY = queries.KEY


def feistel(kind, left, right, a, b):
    def f(i, side, x, m):
        return int(hashlib.sha256(f"{KEY}|{kind}{side}|{a}|{b}|{i}|{x}".encode()).hexdigest()[:15], 16) % m

    for i in range(1, 6):
        left = (left + f(i, "l", right, a)) % a
        right = (right + f(i, "r", left, b)) % b
    return left, right


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def permuted(kind, d):
    if len(d) < 2:
        return d
    h = len(d) // 2
    a, b = feistel(kind, int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h))
    return f"{a:0{h}d}{b:0{len(d) - h}d}"


def refill(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def plain(kind, x):
    d = re.sub("[^0-9]", "", x)
    sha = lambda *p: hashlib.sha256("|".join((KEY, *p)).encode()).hexdigest()
    if kind == "card":
        if len(d) <= 19 and luhn(d):
            body = permuted("card", d[:-1])
            return refill(x, next(body + c for c in "0123456789" if luhn(body + c)))
    elif kind == "ip":
        o = [*map(int, x.split("."))]
        a, b = feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    elif kind == "phone":
        if 7 <= len(d) <= 15:
            keep = max(0, len(d) - 10)
            return refill(x, d[:keep] + permuted("phone", d[keep:]))
    elif kind == "email":
        h = sha("email", x.lower())
        return f"user{h[:12]}@mail{h[12:18]}.example"
    elif kind == "secret":
        if re.search("[0-9]", x) and re.search("[A-Fa-f]", x):
            h = (sha("secret", x.lower()) + sha("secret2", x.lower()))[: len(x)]
            return h.upper() if re.search("[A-F]", x) else h
    return None


def apply(text):
    """For texts without dates, IBANs and social numbers."""
    import regex

    kinds = []

    def whole(x, patterns):
        return next(((kind, v) for kind, p in patterns.items() if re.fullmatch(p, x) and (v := plain(kind, x)) is not None), None)

    def take(found):
        kinds.append(found[0])
        return found[1]

    def inner(m):
        found = whole(m[0], pseudonyms.PATTERNS)
        return take(found) if found else m[0]

    def one(m):
        x = m[0]
        if found := whole(x, pseudonyms.PATTERNS):
            return take(found)
        groups = re.split("(?<=[ .-])", x)
        for s in range(len(groups)):
            for e in range(len(groups), s, -1):
                bare = re.sub("[ .-]$", "", "".join(groups[s:e]))
                if 8 <= len(bare) <= 42 and (found := whole(bare, {"phone": pseudonyms.PATTERNS["phone"], "card": pseudonyms.GROUPED_CARD})):
                    before = regex.sub(pseudonyms.INNER, inner, "".join(groups[:s]))
                    value = take(found)
                    return before + value + regex.sub(pseudonyms.INNER, inner, "".join(groups[s:])[len(bare) :])
        return x

    return regex.sub(pseudonyms.ANY, one, text), kinds


def test_all_documents(spark, sf):
    out = {r.doc_id: r for r in queries.op4_pseudonyms(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(out) == len(docs)
    found = 0
    for d in docs:
        text, kinds = apply(d.text)
        assert (out[d.doc_id].text, out[d.doc_id].kinds) == (text, ",".join(kinds))
        found += len(kinds)
    assert found > 50


def run(spark, values, key=KEY):
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id int, text string").withColumn("Pseudonyms", F.lit("clash")).withColumn("_pseudonyms", F.lit("clash"))
    out = pseudonyms.pseudonymise(docs, key, kinds_col="kinds").orderBy("doc_id").collect()
    assert [(r.Pseudonyms, r._pseudonyms) for r in out] == [("clash", "clash")] * len(values)
    with pytest.raises(ValueError):
        pseudonyms.pseudonymise(docs, key, kinds_col="PSEUDONYMS")
    return [(r.text, r.kinds) for r in out]


def test_values_stay_valid_and_linked(spark):
    values = [
        "card 4111-1111-1111-1111.", "4111111111111111", "4111111111111112", "IBAN DE89 3704 0044 0532 0130 00!", "DE89370400440532013000", "DE88370400440532013000",
        "born 1984-02-29", "29.02.1984", "29/02/1984", "1985-02-29", "07/25/2031", "078-05-1120", "666-05-1120", "+1 (017) 555-7713", "(017) 555-7713", "017-555-7713", "+49 30 1234567",
        "10.0.0.1", "10.0.0.256", "v1.2.3.4.5", "A@b.example.com, a@B.example.com", "token = \"57f17a56c90cac3e893f4491169557bdc83d8148\"", "x" * 50, "1" * 40, None, "", "no data 12 34", "a@b", "12345678901234567890",
    ]
    got = run(spark, values)
    text = {v: t for v, (t, _) in zip(values, got, strict=True)}
    kinds = {v: k for v, (_, k) in zip(values, got, strict=True)}
    untouched = ["4111111111111112", "DE88370400440532013000", "1985-02-29", "666-05-1120", "10.0.0.256", "v1.2.3.4.5", "x" * 50, "1" * 40, None, "", "no data 12 34", "a@b", "12345678901234567890"]
    for v in untouched:
        assert text[v] == v and not kinds[v], v
    for v in values:
        assert v in untouched or (text[v] != v and kinds[v]), v
    digits = lambda v: re.sub(r"\D", "", text[v])
    card = values[0]
    assert re.fullmatch(r"card \d{4}-\d{4}-\d{4}-\d{4}\.", text[card]) and luhn(digits(card)) and digits(card) == text["4111111111111111"]
    iban = text["DE89370400440532013000"]
    assert iban == re.sub("IBAN|[ !]", "", text[values[3]]) and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    iso = datetime.date.fromisoformat(text["born 1984-02-29"][5:])
    assert iso.year // 100 == 19 and text["29.02.1984"] == iso.strftime("%d.%m.%Y") and text["29/02/1984"] == iso.strftime("%d/%m/%Y")
    assert datetime.datetime.strptime(text["07/25/2031"], "%m/%d/%Y").year // 100 == 20
    assert digits("+1 (017) 555-7713")[1:] == digits("(017) 555-7713") == digits("017-555-7713") and text["+1 (017) 555-7713"].startswith("+1 (")
    a, b = text[values[20]].split(", ")
    assert a == b and kinds[values[20]] == ["email", "email"]
    assert run(spark, values) == got and run(spark, values, "other")[0] != got[0]


def test_permutations_are_one_to_one(spark):
    for kind, a, b in (("x", 7, 5), ("y", 1, 9), ("date19", 92, 397)):
        rows = spark.range(a * b).select(pseudonyms.feistel(F.lit("k"), kind, F.struct(F.floor(F.col("id") / b).alias("l"), (F.col("id") % b).alias("r")), a, b).alias("s")).collect()
        assert len({(r.s.l, r.s.r) for r in rows}) == a * b and all(0 <= r.s.l < a and 0 <= r.s.r < b for r in rows)


def test_slash_dates_are_one_to_one(spark):
    """Every text of both forms in both centuries."""
    ok = lambda d, m, y: 1 <= m <= 12 and 1 <= d <= (29 if m == 2 and y % 4 == 0 and y != 1900 else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1])
    texts = [f"{a:02d}/{b:02d}/{y}" for y in range(1900, 2100) for a in range(1, 32) for b in range(1, 32) if ok(a, b, y) or ok(b, a, y)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).select("t", pseudonyms._date(F.lit("k"), F.col("t")).alias("p")).collect()
    assert len({r.p for r in rows}) == len(texts) and {r.p for r in rows} == set(texts)
    assert all(r.p[6:8] == r.t[6:8] for r in rows) and sum(r.p == r.t for r in rows) < 50


#: Looser than the module's and written apart from them: nothing of these may stay.
LOOSE = {
    "email": r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+", "card": r"(?<![\w.-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w]|[.-]\d)", "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w]|[./-]\d)", "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)",
    "phone": r"(?<![\w.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) |\d{3}[.-])\d{3}[ .-]\d{4}(?![\w]|[.-]\d)", "secret": r"\b(?:[0-9a-f]{32,}|[0-9A-F]{32,})\b",
}


def holds(kind, v):
    """Whether a value is valid, by other means than the module's."""
    d = re.sub(r"\D", "", v)
    if kind == "card":
        return luhn(d)
    if kind == "iban":
        b = v.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in b[4:] + b[:4])) % 97 == 1
    if kind == "ip":
        return all(x == str(int(x)) and int(x) < 256 for x in v.split("."))
    if kind == "ssn":
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    if kind == "secret":
        return bool(re.search("[0-9]", v) and re.search("[A-Fa-f]", v)) and len(v) <= 128
    if kind == "date":
        for form in ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d.%m.%Y"):
            try:
                return 1900 <= datetime.datetime.strptime(v, form).year < 2100
            except ValueError:
                pass
        return False
    return True


def test_no_valid_value_stays_in_any_document(spark, sf):
    """By patterns and checks of this file only, over all kinds; equal values of a kind get equal, different ones different pseudonyms."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = {kind: {} for kind in LOOSE}
    for r in queries.op4_pseudonyms(spark, sf).collect():
        for kind, pattern in LOOSE.items():
            before = [m[0] for m in re.finditer(pattern, docs[r.doc_id]) if holds(kind, m[0])]
            after = [m[0] for m in re.finditer(pattern, r.text) if holds(kind, m[0])]
            assert not set(before) & set(after), (kind, r.doc_id)
            if len(before) == len(after):
                for b, a in zip(before, after, strict=True):
                    assert seen[kind].setdefault(b.lower() if kind == "email" else b, a) == a
    assert sum(map(len, seen.values())) > 50
    for kind, found in seen.items():
        assert len(set(found.values())) == len(found), kind


def test_long_and_repeated_texts(spark):
    long = ("word " * 500 + "1.2.3.4 ") * 300
    got = run(spark, [long, long])
    assert got[0] == got[1] and got[0][1] == ["ip"] * 300 and "1.2.3.4" not in got[0][0]
    assert pseudonyms.pseudonymise(spark.createDataFrame([], "doc_id int, text string"), KEY).count() == 0


def test_values_next_to_digits_and_separators(spark):
    cases = {
        "3,john@example.com,berlin": ["email"], "id:3:john@example.com": ["email"], "7,4111111111111111,2026": ["card"], "10.0.0.1:8080": ["ip"], "10.0.0.1/24": ["ip"],
        "1984-02-29T10:00:00Z": ["date"], "3,1984-02-29,4": ["date"], "1984-02-29/1985-03-01": ["date", "date"], "29.02.1984-01.03.1985": ["date", "date"], "邮箱john@example.com邮箱": ["email"],
        "sha256:57f17a56c90cac3e893f4491169557bdc83d8148": ["secret"], "2:078-05-1120,5": ["ssn"], "1,017-555-7713,2": ["phone"], "4111111111111111/12/27": ["card"], "root@10.0.0.1,10.0.0.2:22": ["ip", "ip"],
        "BE68 5390 0754 7034 EUR": ["iban"], "BE68539007547034 EUR 5": ["iban"], "REF AB12 BE68 5390 0754 7034 EUR": ["iban"], "3,BE68 5390 0754 7034,4": ["iban"],
        "BE68 5390 0754 7034 4111 1111 1111 1111": ["iban", "card"], "ID42 4111 1111 1111 1111": ["card"], "4111 1111 1111 1111 123": ["card"], "4111 1111 1111 1111 12/27 123": ["card"],
        "order 1234 4111 1111 1111 1111": ["card"], "4111-1111-1111-1111 4111 1111 1111 1111": ["card", "card"], "3782 822463 10005 1234": ["card"], "+44 20 7946 0958 2023": ["phone"], "555 017-555-7713": ["phone"],
        "1234 1984-02-29 13": ["date"], "key aabbccddeeffaabbccddeeffaabbcc12": ["secret"], "AABBCCDDEEFFAABBCCDDEEFFAABBCCD1": ["secret"],
    }
    stay = ["1.2.3.4.5", "v1.2.3.4", "0.4111111111111111", "4111111111111111.5", "1984-02-29-1", "1984-02-29Tx", "078-05-1120-3", "BE68 5390 0754 7035 EUR", "10.0.0.1x", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 1 2 3 4", "12 345 6789 1234 567 89 1234 5678", "4111111111111111123"]
    for v, (text, kinds) in zip([*cases, *stay], run(spark, [*cases, *stay]), strict=True):
        assert kinds == cases.get(v, []), v
        assert (text == v) == (v in stay), v
    [iban] = [t for t, _ in run(spark, ["BE68 5390 0754 7034 EUR"])]
    assert re.fullmatch(r"BE\d\d \d{4} \d{4} \d{4} EUR", iban) and int("".join(str(int(c, 36)) for c in (iban[4:-4] + iban[:4]).replace(" ", ""))) % 97 == 1
    assert re.fullmatch(r"3,user\w+@mail\w+\.example,berlin", run(spark, ["3,john@example.com,berlin"])[0][0])


def test_mail_addresses_of_many_forms(spark):
    """Accents, apostrophes, underscores and names of other scripts belong to the address; what stands around it doesn't."""
    mails = ["müller@example.de", "o'brien@example.com", "o’brien@example.com", "josé.garcia@example.com", "a@bücher.de", "john_@example.com", "_x@example.com", "x+@example.com", "иван@почта.рф", "γιώργος@example.gr", "a@xn--bcher-kva.xn--p1ai", "é@é.eu"]
    around = [("", ""), ("<", ">"), ("'", "'"), ("mailto:", "?x=1"), ("email=", "&b"), ("邮箱", "邮箱"), ("1,", ",2"), ("see ", ".")]
    for (a, z), row in zip([x for x in around for _ in mails], zip(mails * len(around), run(spark, [a + m + z for a, z in around for m in mails]), strict=True), strict=True):
        mail, (text, kinds) = row
        assert kinds == ["email"] and re.fullmatch(re.escape(a) + r"user[0-9a-f]{12}@mail[0-9a-f]{6}\.example" + re.escape(z), text), (a, mail, z, text)
