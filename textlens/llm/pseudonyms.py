"""Format-preserving pseudonyms for personal data. DataFrame functions only.

Values are found by pattern, then validated (Luhn, mod 97, calendar, ranges); what doesn't hold is left as it is.
A validated number or date is a point of ``Z_a x Z_b`` for its format, and a keyed Feistel network permutes that set:
``l += F(r) mod a; r += F(l) mod b``, each step invertible for any a and b. So a card stays a valid card with its
separators, a date a valid date of the same century, and equal values get equal pseudonyms in every document.
Mail addresses and hex secrets have no small domain; they get a keyed hash in the same form.
Each kind has its own bounds, so values in rows, logs and timestamps are found. What looks like a long number but isn't
valid as a whole is searched again by its groups, so a code behind a card or a currency behind an IBAN doesn't hide it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let

ROUNDS = 5  # each of two half rounds

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Letters of mail addresses: Latin with its accents, Greek and Cyrillic.
_L = "A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ӿ"
#: Patterns of whole values, in the order in which they are tried at a place.
PATTERNS = {
    "email": rf"[{_L}0-9_](?:[{_L}0-9._%+'’-]{{0,62}}[{_L}0-9_+-])?@(?:[{_L}0-9](?:[{_L}0-9-]{{0,61}}[{_L}0-9])?\.){{1,8}}(?:xn--[a-z0-9-]{{1,59}}|[{_L}]{{2,24}})",
    "secret": r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "ip": rf"{_OCTET}(?:\.{_OCTET}){{3}}",
    "date": r"(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2})",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5})",
    "card": r"[0-9](?:[ -]?[0-9]){12,38}",
}
#: A card inside a longer number: as cards are grouped, so that columns of numbers don't turn into cards.
GROUPED_CARD = r"(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}|[0-9]{13,19})"
#: What must not stand before and behind a value of each kind, besides an ASCII letter or digit: a digit behind a separator
#: that the kind itself has, as this makes a longer number. Other separators (those of rows, ports, paths, times) may.
BOUNDS = {
    "email": ("", ""), "secret": ("", ""), "iban": ("", ""), "ip": (r"(?<![0-9]\.)", r"(?!\.[0-9])"), "ssn": ("(?<![0-9]-)", "(?!-[0-9])"),
    "phone": ("(?<![0-9][.-])", "(?![.-][0-9])"), "card": ("(?<![0-9][.-])", "(?![.-][0-9])"),
}
_END = "(?![A-Za-z0-9])"


def _bounded(kind: str) -> str:
    if kind != "date":
        return BOUNDS[kind][0] + f"(?:{PATTERNS[kind]})" + _END + BOUNDS[kind][1]
    forms = zip("-/.", PATTERNS["date"][3:-1].replace("|[0-9]", "\n[0-9]").split("\n"), strict=True)
    return "|".join(rf"(?<![0-9][{c}]){form}(?:{_END}|(?=[Tt][0-9]))(?![{c}][0-9])" for c, form in forms)


def _any(kinds: list[str]) -> str:
    return f"(?<![A-Za-z0-9])(?=[{_L}0-9_+(])(?:" + "|".join(map(_bounded, kinds)) + ")"


KINDS = [*PATTERNS]
ANY = _any(KINDS)
#: For what stands beside a value that was found by groups.
INNER = _any([k for k in KINDS if k != "iban"])
#: Kinds whose matches may hold a shorter value, and what every value has: a mail sign, seven characters of a number, a run of hex digits or an IBAN's head.
LONG = [k for k in KINDS if k in ("iban", "phone", "card")]
SOME = r"@|[0-9][0-9 .()/+-]{5}|[0-9a-f]{32}|[0-9A-F]{32}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"

#: First day and the two factors of the number of days of each century.
CENTURIES = {"19": ("1900-01-01", 92, 397), "20": ("2000-01-01", 75, 487)}


def feistel(key: Column, kind: str, value: Column, a: Column | int, b: Column | int) -> Column:
    """A keyed permutation of ``struct(l, r)`` over ``Z_a x Z_b`` (both up to 10**18)."""
    a, b = (m if isinstance(m, Column) else F.lit(m).cast("bigint") for m in (a, b))

    def f(i: Column, side: str, x: Column, m: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", key, F.lit(kind + side), a.cast("string"), b.cast("string"), i.cast("string"), x.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % m

    def both(s: Column, i: Column) -> Column:
        left = (s["l"] + f(i, "l", s["r"], a)) % a
        return let(left, lambda x: F.struct(x.alias("l"), ((s["r"] + f(i, "r", x, b)) % b).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), value, both)


def _pair(left: Column, right: Column) -> Column:
    return F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _permuted(key: Column, kind: str, digits: Column) -> Column:
    """The digit string permuted among those of its length (2 to 30; shorter ones stay)."""

    def of(h: Column) -> Column:
        rest = F.length(digits) - h
        ten = lambda n: F.pow(F.lit(10.0), n).cast("bigint")  # noqa: E731  exact up to 10**15
        halves = _pair(F.substr(digits, F.lit(1), h), F.substr(digits, h + 1, rest))
        return let(feistel(key, kind, halves, ten(h), ten(rest)), lambda s: F.concat(F.lpad(s["l"].cast("string"), h, F.lit("0")), F.lpad(s["r"].cast("string"), rest, F.lit("0"))))

    return F.when(F.length(digits).between(2, 30), let((F.length(digits) / 2).cast("int"), of)).otherwise(digits)


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in order."""
    at = lambda i: F.length(digits_of(F.substr(shape, F.lit(1), i)))
    char = lambda i: F.substr(shape, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(char(i).rlike("[0-9]"), F.substr(digits, at(i), F.lit(1))).otherwise(char(i))), "")


def luhn_sum(digits: Column) -> Column:
    n = F.length(digits)
    digit = lambda i: F.substr(digits, n + 1 - i, F.lit(1)).cast("int")  # noqa: E731  i-th from the right
    value = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    """The number that the text spells (A is 10 to Z is 35) modulo 97."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))


def _card(key: Column, x: Column) -> Column:
    d = digits_of(x)
    body = lambda d: F.substr(d, F.lit(1), F.length(d) - 1)
    checked = lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))
    new = let(_permuted(key, "card", body(d)), checked)
    return F.when(F.length(d) <= 19, F.when(luhn_sum(d) % 10 == 0, let(new, lambda n: _refill(x, n))))


def _iban(key: Column, x: Column) -> Column:
    bare = F.replace(x, F.lit(" "), F.lit(""))
    country, rest = F.substring(bare, 1, 2), F.substr(bare, F.lit(5))
    new = let(_refill(rest, _permuted(key, "iban", digits_of(rest))), lambda r: F.concat(F.lpad((98 - mod97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0"), r))
    # letters stay where they are, so the digits of check and account refill the value
    return F.when((F.length(bare).between(15, 34)) & (mod97(F.concat(rest, F.substring(bare, 1, 4))) == 1), let(new, lambda n: _refill(x, digits_of(n))))


def _ip(key: Column, x: Column) -> Column:
    def of(p: Column) -> Column:
        n = lambda i: p[i].cast("bigint")
        new = feistel(key, "ip", _pair(n(0) * 256 + n(1), n(2) * 256 + n(3)), 65536, 65536)
        return let(new, lambda s: F.concat_ws(".", *[v.cast("string") for v in (F.shiftright(s["l"], 8), s["l"] % 256, F.shiftright(s["r"], 8), s["r"] % 256)]))

    return let(F.split(x, r"\."), of)


def _ssn(key: Column, x: Column) -> Column:
    d = digits_of(x)
    area, group, serial = (F.substring(d, i, n).cast("bigint") for i, n in ((1, 3), (4, 2), (6, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    new = feistel(key, "ssn", _pair(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1), 898, 99 * 9999)
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
    put = lambda s: F.concat(pad(s["l"] + 1 + F.when(s["l"] >= 665, 1).otherwise(0), 3), F.lit("-"), pad(F.floor(s["r"] / 9999) + 1, 2), F.lit("-"), pad(s["r"] % 9999 + 1, 4))
    return F.when(valid, let(new, put))


#: Days from the 13th of each month of a common year: how many come before the month.
_LATE = [sum((31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[:m]) - 12 * m for m in range(12)]


def _late(key: Column, x: Column, century: str) -> Column:
    """A month-first date whose day is no month, among those of its century: leap days apart, others by year and day."""
    month, day, year = (F.substring(x, i, n).cast("bigint") for i, n in ((1, 2), (4, 2), (9, 2)))
    put = lambda m, d, y: F.concat(F.lpad(m.cast("string"), 2, "0"), F.lit("/"), F.lpad(d.cast("string"), 2, "0"), F.lit("/" + century), F.lpad(y.cast("string"), 2, "0"))
    before = F.array(*[F.lit(n).cast("bigint") for n in _LATE])
    at = _pair(year, F.element_at(before, month.cast("int")) + day - 13)
    of = lambda s: let(F.size(F.filter(before, lambda n: n <= s["r"])), lambda m: put(m, s["r"] - F.element_at(before, m) + 13, s["l"]))
    leaps = 24 if century == "19" else 25  # 1900 is no leap year
    first = 1 if century == "19" else 0
    leap = let(feistel(key, f"leap{century}", _pair((year / 4).cast("bigint") - first, F.lit(0)), leaps, 1), lambda s: put(F.lit(2), F.lit(29), (s["l"] + first) * 4))
    return F.when((month == 2) & (day == 29), leap).otherwise(let(feistel(key, f"late{century}", at, 100, _LATE[-1] + 19), of))


def _date(key: Column, x: Column) -> Column:
    """Permuted among the days of its century; day before month, unless only the other order is a day.

    Forms that share a separator have disjoint sets of texts, each permuted in itself, so that no two dates of one form meet.
    """
    out = F.lit(None).cast("string")
    forms = (("yyyy-MM-dd", r"^[0-9]{4}-", 1), ("dd/MM/yyyy", "/", 7), ("MM/dd/yyyy", "/", 7), ("dd.MM.yyyy", r"^[0-9]{2}\.", 7))
    for form, like, year in reversed(forms):
        day = F.try_to_timestamp(x, F.lit(form)).cast("date")
        for century, (start, a, b) in CENTURIES.items():
            at = F.datediff(day, F.lit(start).cast("date")).cast("bigint")
            new = let(feistel(key, f"date{century}", _pair(F.floor(at / b), at % b), a, b), lambda s, b=b, start=start, form=form: F.date_format(F.date_add(F.lit(start).cast("date"), (s["l"] * b + s["r"]).cast("int")), form))
            out = F.when(x.rlike(like) & day.isNotNull() & (F.substring(x, year, 2) == century), _late(key, x, century) if form == "MM/dd/yyyy" else new).otherwise(out)
    return out


def _phone(key: Column, x: Column) -> Column:
    """The last ten digits (all, if there are fewer) are permuted, so a country code stays."""

    def of(d: Column) -> Column:
        keep = F.greatest(F.length(d) - 10, F.lit(0))
        return _refill(x, F.concat(F.substr(d, F.lit(1), keep), _permuted(key, "phone", F.substr(d, keep + 1))))

    return let(digits_of(x), lambda d: F.when(F.length(d).between(7, 15), of(d)))


def _email(key: Column, x: Column) -> Column:
    h = F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(x)), 256)
    return let(h, lambda h: F.concat(F.lit("user"), F.substring(h, 1, 12), F.lit("@mail"), F.substring(h, 13, 6), F.lit(".example")))


def _secret(key: Column, x: Column) -> Column:
    h = F.substr(F.concat(F.sha2(F.concat_ws("|", key, F.lit("secret"), F.lower(x)), 256), F.sha2(F.concat_ws("|", key, F.lit("secret2"), F.lower(x)), 256)), F.lit(1), F.length(x))
    # a run of one kind of character is no secret
    return F.when(x.rlike("[0-9]") & x.rlike("[A-Fa-f]"), F.when(x.rlike("[A-F]"), F.upper(h)).otherwise(h))


MAKERS: dict[str, Callable[[Column, Column], Column]] = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(key: Column, x: Column, patterns: dict[str, str] = PATTERNS) -> Column:
    """``struct(kind, value)`` for a found value; null if it doesn't hold for any kind whose pattern it has."""
    tried = [F.when(x.rlike(f"^(?:{pattern})$"), F.struct(F.lit(kind).alias("kind"), MAKERS[kind](key, x).alias("value"))) for kind, pattern in patterns.items()]
    return F.get(F.filter(F.array(*tried), lambda p: p["value"].isNotNull()), 0)


def _piece(text: Column | str, kind: Column | None = None, again: bool = False) -> Column:
    """A piece of the new text: its kind, if it is a pseudonym, and whether values are to be looked for in it once more."""
    return F.struct((text if isinstance(text, Column) else F.lit(text)).alias("text"), (F.lit(None).cast("string") if kind is None else kind).alias("kind"), F.lit(again).alias("again"))


def _pieces(t: Column, pattern: str, of: Callable[[Column], Column]) -> Column:
    """``t`` as pieces, each match of the pattern as ``of`` it."""

    def put(hits: Column) -> Column:
        return F.flatten(F.transform(F.split(t, pattern, -1), lambda s, i: F.concat(F.array(_piece(s)), F.coalesce(F.get(hits, i), F.array().cast("array<struct<text:string,kind:string,again:boolean>>")))))  # no hit after the last

    return let(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), of), put)


def _whole(key: Column, x: Column, otherwise: Column) -> Column:
    """Pieces of a found value."""
    return let(pseudonym(key, x), lambda p: F.when(p.isNotNull(), F.array(_piece(p["value"], p["kind"]))).otherwise(otherwise))


def _parted(key: Column, x: Column) -> Column:
    """Pieces of what has the pattern of a long number but isn't valid: the first, longest run of its groups that is, and what stands beside it."""
    inside = {k: GROUPED_CARD if k == "card" else PATTERNS[k] for k in ("iban", "date", "ssn", "phone", "card")}

    def of(groups: Column) -> Column:
        n = F.size(groups)
        run = lambda s, e: F.array_join(F.slice(groups, s + 1, e - s), "")
        bare = lambda s, e: F.regexp_replace(run(s, e), "[ .-]$", "")  # noqa: E731  each group ends with its separator
        at = lambda s, e: F.struct(s.alias("s"), e.alias("e"), let(bare(s, e), lambda t: F.struct(F.length(t).alias("n"), F.when(F.length(t).between(8, 42), pseudonym(key, t, inside)).alias("p"))).alias("v"))
        runs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.transform(F.sequence(n, s + 1, F.lit(-1)), lambda e: at(s, e))))
        put = lambda r: F.array(_piece(run(F.lit(0), r["s"]), again=True), _piece(r["v"]["p"]["value"], r["v"]["p"]["kind"]), _piece(F.substr(run(r["s"] + 0, n), r["v"]["n"] + 1), again=True))
        return let(F.get(F.filter(runs, lambda r: r["v"]["p"].isNotNull()), F.lit(0)), lambda r: F.when(r.isNotNull(), put(r)).otherwise(F.array(_piece(x))))

    return let(F.split(x, "(?<=[ .-])", -1), of)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", kinds_col: str | None = None) -> DataFrame:
    """``docs`` with the personal data of ``text_col`` replaced; ``kinds_col`` gets the kinds of the replaced values in text order.

    Null texts stay null and texts without a value stay byte for byte; ``n_chars``, where there is one, is not touched
    (see the pipeline). Rows are independent: repeated rows agree, no row gives none, other columns pass whatever their
    names. ``kinds_col`` has to be a new name, in any letter case.
    """
    if kinds_col and kinds_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError("the new column's name is taken")
    k = F.lit(key)

    def first(t: Column) -> Column:
        long = lambda x: x.rlike("^(?:" + "|".join(PATTERNS[kind] for kind in LONG) + ")$")
        return _pieces(t, ANY, lambda x: _whole(k, x, F.when(long(x), _parted(k, x)).otherwise(F.array(_piece(x)))))

    def second(t: Column) -> Column:
        return _pieces(t, INNER, lambda x: _whole(k, x, F.array(_piece(x))))

    def done(pieces: Column) -> Column:
        return F.flatten(F.transform(pieces, lambda p: F.when(p["again"], second(p["text"])).otherwise(F.array(p))))

    text = F.col(text_col)
    name = free_name([*docs.columns, *([kinds_col] if kinds_col else [])], "pseudonyms")
    out = docs.withColumn(name, F.when(text.rlike(SOME), let(text, first)))
    # in two steps, as the analyzer takes a round for each lambda inside another
    out = out.withColumn(name, let(F.col(name), done))
    found = F.col(name).isNotNull()
    if kinds_col:
        kinds = F.transform(F.filter(F.col(name), lambda p: p["kind"].isNotNull()), lambda p: p["kind"])
        out = out.withColumn(kinds_col, F.when(found, kinds).otherwise(F.array().cast("array<string>")))
    return out.withColumn(text_col, F.when(found, F.array_join(F.col(name)["text"], "")).otherwise(F.col(text_col))).drop(name)
