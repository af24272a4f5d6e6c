"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Values are found by pattern, checked (calendar dates, card checksums, octets, number ranges) and
replaced by a value of the same format: a Feistel network, keyed and with the kind as its tweak,
permutes exactly the values that are valid in the format. So equal values get equal pseudonyms
in every document, different values different ones, a pseudonym passes the same check, and who
holds the key can turn it back (``restore``).

| kind | valid | what is permuted |
|---|---|---|
| card | 13 to 19 digits, Luhn checksum, grouped by spaces or hyphens or not; numbers in further groups before or behind stay | all digits but the last, which is the new checksum |
| phone | +country and 8 to 15 digits in all, or without country area 3-4 or 10 to 11 digits from a 0; set apart by spaces, dots, hyphens, parentheses | the digits after the country code, 1 or 0 in front |
| ssn | 3-2-4 digits, in issued ranges | the three numbers within those ranges |
| ip | four octets up to 255 | the 32 bits |
| date | year-month-day (a T may follow), day.month.year, month/day/year or else day/month/year that exists, parts of one or two digits, 1900-01-01 to 2102-07-23 | the day number, among dates with parts of the same width |
| email | name at domain | the name's letters and digits together, each in its places, by domain and layout |
| key | 32 to 64 hexadecimal digits after a name such as api_key | the digits |

Keys are strings; every round takes a SHA-256 of the key and the message, nested as in HMAC.

Defined cases: null stays null, texts without a valid value stay as they are; values that fail
their check are left alone; rows are independent. Phone numbers without a country code or a
separator are digits like any others and stay; one in groups takes in a further group that
follows after a space, up to 15 digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, packed, unpacked

ROUNDS = 8
#: Rounds for each part of a value of many digits, and how many digits of a base one part holds.
PART_ROUNDS, WIDE = 4, {10: 15, 16: 12, 26: 10}
#: Characters of an e-mail name that are permuted together; longer ones, which mail does not allow, in blocks.
NAME_BLOCK = 64
#: Values tried for one that fits its layout.
TRIES = 6000
#: Days from 1900-01-01 that dates are permuted among: 272 * 272.
DAYS, FIRST_DAY = 272, "1900-01-01"

#: +country and 8 to 15 digits in all, in groups; the North American and the area (3) 3-4 layouts end after their last group.
PHONE = (r"\+(?:1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|[1-9][0-9]{0,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])"
         r"|[1-9](?:\)?[ .-]?\(?[0-9]){7,14}(?![0-9]|[/:.-][0-9]))")
#: Without a country: area 3-4, or 10 to 11 digits from a 0, the area set apart.
AREA = r"(?:1[ .-])?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
TRUNK = "|".join(rf"(?:\(0[0-9]{{{n - 1}}}\)[ .-]?|0[0-9]{{{n - 1}}}[ .-])[0-9](?:[ .-]?[0-9]){{{9 - n},{10 - n}}}" for n in (2, 3, 4, 5))
#: Country codes, which no other begins with, where nothing sets them apart.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[1-9][0-9]{2}"
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
#: Dates by the calendar but for leap years, in the years that are permuted; numbers in issued ranges. What is none of these may be part of a card.
YEAR = "(?:19[0-9]{2}|20[0-9]{2}|210[0-2])"
MONTHS = {"(?:0?[13578]|1[02])": "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[469]|11)": "(?:0?[1-9]|[12][0-9]|30)", "0?2": "(?:0?[1-9]|[12][0-9])"}
ISO = YEAR + "-(?:" + "|".join(f"{m}-{d}" for m, d in MONTHS.items()) + ")"
DOTTED = "(?:" + "|".join(rf"{d}\.{m}" for m, d in MONTHS.items()) + rf")\.{YEAR}"
SLASHED = "(?:" + "|".join(f"{m}/{d}|{d}/{m}" for m, d in MONTHS.items()) + f")/{YEAR}"
SSN = r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"
#: Usual groupings of cards, or none; three to one digits behind may be the card's or another number.
GROUPED = "|".join(rf"[0-9]{{4}}{p}[0-9]{{4}}{p}[0-9]{{4}}{p}[0-9]{{4}}(?:{p}(?!DATES)[0-9]{{1,3}})?(?![0-9A-Za-z])|[0-9]{{4}}{p}[0-9]{{6}}{p}[0-9]{{4,5}}(?![0-9A-Za-z])" for p in " -") \
    .replace("DATES", f"(?:{ISO}|{DOTTED}|{SLASHED}|{SSN})(?![0-9A-Za-z])") + "|[0-9]{13,19}(?![0-9A-Za-z])"
KEY = r"(?i:api_?key|secret|token|password)[\"']?[ ]?[=:][ ]?[\"']?[0-9A-Fa-f]{32,64}"
#: Where one value starts and ends: not within a longer number or word.
END = r"(?![0-9A-Za-z]|[.-][0-9])"
PLAIN = rf"{IP}{END}|{ISO}(?:(?=T[0-9])|{END})|(?:{DOTTED}|{SLASHED}|{SSN}){END}|{GROUPED}|(?:{AREA}|{TRUNK}){END}"
#: Any other grouping of 13 to 19 digits, up to where another value starts; none starts behind a hyphen.
CARD = rf"[0-9](?:[0-9]|-[0-9]| (?!{PLAIN})[0-9]){{12,18}}"
ANY = (rf"{KEY}(?![0-9A-Za-z])|(?<![0-9A-Za-z._%+-]){EMAIL}|(?<![0-9A-Za-z]){PHONE}"
       rf"|(?<![0-9A-Za-z.-])(?:{IP}{END}|{ISO}(?:(?=T[0-9])|{END})|(?:{DOTTED}|{SLASHED}|{SSN}){END}|{GROUPED})"
       rf"|(?<![0-9A-Za-z.+-])(?:{AREA}|{TRUNK}){END}|(?<![0-9A-Za-z.-]){CARD}(?![0-9A-Za-z])")
#: Numbers of digits of a card, in the order in which they are tried.
CARD_SIZES = (16, 15, 19, 14, 18, 17, 13)
#: What every match has: texts without it are not searched. A key may be letters a to f alone.
HINT = r"[0-9@]|[A-Fa-f]{32}"


class Cipher:
    """Keyed permutations as column expressions; ``inverse`` turns them back."""

    def __init__(self, key: str, inverse: bool = False) -> None:
        self.key, self.inverse = key, inverse

    def _round(self, kind: str, number: Column, half: Column, size: Column) -> Column:
        inner = F.sha2(F.concat(F.lit(f"{self.key}|i|{kind}|"), number.cast("string"), F.lit("|"), half.cast("string"), F.lit("|"), size.cast("string")), 256)
        return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{self.key}|o|"), inner), 256), 1, 15), 16, 10).cast("long")

    def pair(self, kind: str, a: Column, b: Column, ra: Column, rb: Column) -> Column:
        """A struct of a' < ra and b' < rb: a permutation of all such pairs."""
        order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if self.inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        sign = -1 if self.inverse else 1

        def step(s, i):
            odd = i % 2 == 1
            fixed, moved = F.when(odd, s["a"]).otherwise(s["b"]), F.when(odd, s["b"]).otherwise(s["a"])
            size = F.when(odd, rb).otherwise(ra)
            new = F.pmod(moved + sign * (self._round(kind, i, fixed, size) % size), size)
            return F.struct(F.when(odd, s["a"]).otherwise(new).alias("a"), F.when(odd, new).otherwise(s["b"]).alias("b"))

        return F.aggregate(order, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)

    def permute(self, kind: str, tweak: Column, values: Column, sizes: Column) -> Column:
        """A permutation of all arrays of longs below ``sizes``, chosen by ``tweak``: each round moves one part by what the others say."""
        m, sign = F.size(values), -1 if self.inverse else 1
        last = PART_ROUNDS * m - 1
        order = F.sequence(last, F.lit(0)) if self.inverse else F.sequence(F.lit(0), last)

        def step(s, i):
            j = F.pmod(i, m)
            others = F.concat_ws("|", tweak, F.transform(s, lambda v, k: F.when(k == j, F.lit("")).otherwise(v.cast("string"))))
            size = F.get(sizes, j)
            move = F.pmod(F.get(s, j) + sign * (self._round(kind, i, others, size) % size), size)
            return let(move, lambda x: F.transform(s, lambda v, k: F.when(k == j, x).otherwise(v)))

        return F.aggregate(order, values, step)

    def texts(self, kind: str, tweak: Column, texts: list[tuple[Column, int]]) -> Column:
        """Strings of digits of their bases, permuted together as one value; the array of new strings, lower case."""
        parts = let(F.concat(*[_parts(text, base, k) for k, (text, base) in enumerate(texts)]), lambda p: let(
            self.permute(kind, tweak, F.transform(p, lambda x: x["value"]), F.transform(p, lambda x: x["size"])),
            lambda new: F.transform(p, lambda x, k: F.struct(x["own"].alias("own"), _written(F.get(new, k), x).alias("t")))))
        of = lambda p, k: F.array_join(F.transform(F.filter(p, lambda x: x["own"] == k), lambda x: x["t"]), "")
        return let(parts, lambda p: F.array(*[of(p, k) for k in range(len(texts))]))

    def digits(self, kind: str, text: Column, base: int = 10) -> Column:
        """A permutation of the strings of one length in the digits of ``base``; lower case. Decimal ones have up to 30 digits:
        two halves, each moved by all of the other."""
        if base != 10:
            return self.texts(kind, F.lit(""), [(text, base)])[0]
        left = F.floor(F.length(text) / 2).cast("int")
        right = F.length(text) - left
        powers = F.array(*[F.lit(10**i).cast("long") for i in range(WIDE[10] + 1)])
        number = lambda t: F.coalesce(t.cast("long"), F.lit(0).cast("long"))
        word = lambda n, width: F.when(width > 0, F.lpad(n.cast("string"), width, "0")).otherwise(F.lit(""))
        new = self.pair(kind, number(F.nullif(F.substring(text, F.lit(1), left), F.lit(""))), number(F.substring(text, left + 1, right)),
                        F.get(powers, left), F.get(powers, right))
        return let(new, lambda s: F.concat(word(s["a"], left), word(s["b"], right)))


def _parts(text: Column, base: int, own: int) -> Column:
    """At least two pieces of a string, as numbers below ``size``; ``width`` digits each."""
    n, powers = F.length(text), F.array(*[F.lit(base**i).cast("long") for i in range(WIDE[base] + 1)])
    count = F.greatest(F.lit(2), F.ceil(n / WIDE[base]).cast("int"))
    at = lambda i: F.floor(i * n / count).cast("int")

    def part(i):
        width = at(i + 1) - at(i)
        return F.struct(F.lit(own).alias("own"), F.lit(base).alias("base"), width.alias("width"), F.get(powers, width).alias("size"),
                        F.coalesce(F.conv(F.substring(text, at(i) + 1, width), base, 10).cast("long"), F.lit(0).cast("long")).alias("value"))

    return F.transform(F.sequence(F.lit(0), count - 1), part)


def _written(value: Column, part: Column) -> Column:
    text = lambda base: F.lpad(F.lower(F.conv(value.cast("string"), 10, base)), part["width"], "0")
    bases = list(WIDE)
    out = F.when(part["width"] == 0, F.lit(""))
    for base in bases:
        out = out.when(part["base"] == base, text(base))
    return out


def _spread(pattern: Column, digits: Column) -> Column:
    """The digits put in the places of the pattern's digits, all else kept."""
    chars = F.split(pattern, "")
    out = F.aggregate(chars, F.struct(F.lit("").alias("t"), F.lit(1).alias("i")), lambda s, c: F.when(
        c.rlike("[0-9]"), F.struct(F.concat(s["t"], F.substring(digits, s["i"], F.lit(1))).alias("t"), (s["i"] + 1).alias("i"))).otherwise(
        F.struct(F.concat(s["t"], c).alias("t"), s["i"].alias("i"))))
    return out["t"]


def _only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def checksum(body: Column) -> Column:
    """The Luhn digit that completes a string of digits."""
    total = F.aggregate(F.split(F.reverse(body), ""), F.struct(F.lit(0).alias("n"), F.lit(True).alias("twice")), lambda s, c: let(
        c.cast("int") * F.when(s["twice"], 2).otherwise(1),
        lambda d: F.struct((s["n"] + d - F.when(d > 9, 9).otherwise(0)).alias("n"), (~s["twice"]).alias("twice"))))
    return F.pmod(-total["n"], F.lit(10)).cast("string")


def _walk(start: Column, step, fits) -> Column:
    """The first of step(start), step(step(start)), ... that fits: so a permutation of all values is one of those that fit.

    One try in twelve or more fits, so ``TRIES`` leave a value without one less often than 1 in 10^200; it takes its first step then and
    never stays. Steps after the first that fits cost next to nothing.
    """
    first = F.struct(start.alias("v"), F.lit(False).alias("done"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES) + F.length(start.cast("string")) * 0), first, lambda s, _: F.when(s["done"], s).otherwise(
        let(step(s["v"]), lambda v: F.struct(v.alias("v"), fits(v).alias("done")))))
    return let(out, lambda s: F.when(s["done"], s["v"]).otherwise(step(start)))


def _valid_card(d: Column) -> Column:
    return checksum(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, -1, 1)


def _card_place(m: Column) -> Column:
    """(start, rank, size): which of a candidate's whole groups are the card; the first start, sizes in the order of CARD_SIZES. Null if none."""
    def of(at):
        single = lambda i: F.substring(m, i, F.lit(1)).rlike("[0-9]")
        starts = F.filter(at, lambda i: single(i) & ((i == 1) | ~single(i - 1)))
        ends = F.filter(at, lambda i: single(i) & ((i == F.length(m)) | ~single(i + 1)))
        each = F.flatten(F.transform(starts, lambda a: F.transform(ends, lambda b: let(_only_digits(F.substring(m, a, b - a + 1)), lambda d: F.struct(
            a.alias("start"), F.array_position(F.array(*map(F.lit, CARD_SIZES)), F.length(d)).cast("int").alias("rank"), (b - a + 1).alias("size"), d.alias("d"))))))
        good = F.filter(each, lambda w: F.when((w["size"] > 0) & (w["rank"] > 0), _valid_card(w["d"])).otherwise(False))
        return let(F.array_min(good), lambda w: F.when(w.isNotNull(), F.struct(w["start"].alias("start"), w["rank"].alias("rank"), w["size"].alias("size"))))

    return let(F.sequence(F.lit(1), F.length(m)), of)


def _card(m: Column, place: Column, c: Cipher) -> Column:
    """The card alone. New digits are those that make the same choice of groups, so that it can be turned back."""
    core = F.substring(m, place["start"], place["size"])
    step = lambda d: let(c.digits("card", F.substring(d, F.lit(1), F.length(d) - 1)), lambda b: F.concat(b, checksum(b)))

    def fits(d):
        whole = F.concat(F.substring(m, F.lit(1), place["start"] - 1), _spread(core, d), F.substring(m, place["start"] + place["size"], F.length(m)))
        # Other groupings may read as a phone number or a date in parts.
        return let(whole, lambda w: _card_place(w).eqNullSafe(place) & (m.rlike(f"^(?:{GROUPED})$") | (F.regexp_extract(w, f"({ANY})", 1) == w)))

    def new(d):
        alone = m.rlike("^[0-9]+$")
        return F.when(alone, step(d)).otherwise(_walk(d, step, fits))

    return let(let(_only_digits(core), new), lambda d: _spread(core, d))


def _phone(m: Column, c: Cipher) -> Column:
    """Country code, 1 or 0 in front stay. The same number after them has the same digits in every layout."""
    front = F.when(m.rlike(r"^\+[1-9][0-9]{0,2}[ .(-]"), F.regexp_extract(m, r"^(\+[0-9]+[ .-]?)", 1)) \
        .when(m.startswith("+"), F.regexp_extract(m, rf"^(\+(?:{COUNTRY}))", 1)) \
        .when(m.rlike(rf"^(?:{AREA})$"), F.regexp_extract(m, r"^((?:1[ .-])?)", 1)).otherwise(F.regexp_extract(m, r"^(\(?0)", 1))
    return let(front, lambda f: let(F.substring(m, F.length(f) + 1, F.length(m)), lambda r: F.concat(f, _spread(r, c.digits("phone", _only_digits(r))))))


def _ip(m: Column, c: Cipher) -> Column:
    def of(o):
        n = [F.get(o, i).cast("int") for i in range(4)]
        valid = (n[0] < 256) & (n[1] < 256) & (n[2] < 256) & (n[3] < 256)
        half = F.lit(65536).cast("long")
        new = c.pair("ip", n[0] * 256 + n[1], n[2] * 256 + n[3], half, half)
        return F.when(valid, let(new, lambda s: F.concat_ws(".", *(F.floor(s[h] / 256).cast("string") if k == 0 else (s[h] % 256).cast("string")
                                                                   for h in "ab" for k in (0, 1)))))

    # Octets with leading zeros are not the usual writing and stay.
    return F.when(~m.rlike(r"(^|\.)0[0-9]"), let(F.split(m, r"\."), of))


def _date(m: Column, c: Cipher) -> Column:
    """Order and width of the parts stay: of dates that can be written so, and are read in the same order. Slashed ones are day first if the first is above 12."""
    side, first = F.lit(DAYS).cast("long"), F.lit(FIRST_DAY).cast("date")

    def of(p):
        slashed = m.contains("/")
        turned = slashed & (F.get(p, 0).cast("int") > 12)
        year = F.when(m.contains("-"), F.get(p, 0)).otherwise(F.get(p, 2))
        month = F.when(slashed & ~turned, F.get(p, 0)).otherwise(F.get(p, 1))
        day = F.when(m.contains("-"), F.get(p, 2)).when(slashed & ~turned, F.get(p, 1)).otherwise(F.get(p, 0))
        iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))

        def moved(n):
            step = lambda v: let(c.pair("date", F.floor(v / DAYS), v % DAYS, side, side), lambda s: s["a"] * DAYS + s["b"])
            on = lambda v: F.date_add(first, v.cast("int"))
            fits = lambda v: ((F.length(month) == 2) | (F.month(on(v)) < 10)) & ((F.length(day) == 2) | (F.dayofmonth(on(v)) < 10)) \
                & (~turned | (F.dayofmonth(on(v)) > 12))
            free = (F.length(month) == 2) & (F.length(day) == 2) & ~turned
            return F.when(free, step(n)).otherwise(_walk(n, step, fits))

        def written(d):
            part = lambda form, old: F.lpad(F.date_format(d, form), F.length(old), "0")
            y, mm, dd = F.date_format(d, "yyyy"), part("M", month), part("d", day)
            return F.when(m.contains("-"), F.concat_ws("-", y, mm, dd)).when(m.contains("."), F.concat_ws(".", dd, mm, y)) \
                .when(turned, F.concat_ws("/", dd, mm, y)).otherwise(F.concat_ws("/", mm, dd, y))

        def day_number(d):
            n = F.datediff(d, first).cast("long")
            return F.when((n >= 0) & (n < DAYS * DAYS) & (F.date_format(d, "yyyy-MM-dd") == iso), n)

        return let(let(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), day_number), lambda n: F.when(
            n.isNotNull(), let(F.date_add(first, moved(n).cast("int")), written)))

    return let(F.split(m, "[-./]"), of)


def _ssn(m: Column, c: Cipher) -> Column:
    def of(p):
        area, group, serial = (F.get(p, i).cast("int") for i in range(3))
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        place = area - F.when(area > 666, 2).otherwise(1)
        new = c.pair("ssn", place, (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"))
        return F.when(valid, let(new, lambda s: F.concat_ws(
            "-", F.lpad((s["a"] + F.when(s["a"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
            F.lpad((F.floor(s["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0"))))

    return let(F.split(m, "-"), of)


def _spread_name(pattern: Column, letters: Column, digits: Column) -> Column:
    """The letters and the digits put in the places of the pattern's, all else kept."""
    at = lambda text, i: F.substring(text, i, F.lit(1))
    put = lambda s, t, i, j: F.struct(F.concat(s["t"], t).alias("t"), i.alias("i"), j.alias("j"))
    out = F.aggregate(F.split(pattern, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("i"), F.lit(1).alias("j")), lambda s, c: F.when(
        c.rlike("[A-Za-z]"), put(s, at(letters, s["i"]), s["i"] + 1, s["j"])).when(
        c.rlike("[0-9]"), put(s, at(digits, s["j"]), s["i"], s["j"] + 1)).otherwise(put(s, c, s["i"], s["j"])))
    return out["t"]


def _email(m: Column, c: Cipher) -> Column:
    """Letters, as lower case, and digits of the name are permuted together, each in its places, by the whole address's layout; the domain stays."""
    name = F.substring_index(m, "@", 1)
    domain = F.substring(m, F.length(name) + 1, F.length(m))

    def block(at):
        own = F.substring(name, at, F.lit(NAME_BLOCK))
        # Letters as digits of base 26: a-j to 0-9, k-z to a-p.
        coded = F.translate(F.regexp_replace(F.lower(own), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop")
        layout = F.regexp_replace(F.regexp_replace(own, "[A-Za-z]", "a"), "[0-9]", "0")
        tweak = F.concat_ws("|", F.lower(domain), at.cast("string"), layout)
        return let(c.texts("email", tweak, [(coded, 26), (_only_digits(own), 10)]), lambda new: _spread_name(
            own, F.translate(new[0], "0123456789abcdefghijklmnop", "abcdefghijklmnopqrstuvwxyz"), new[1]))

    return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(name), F.lit(NAME_BLOCK)), block), ""), domain)


def _key(m: Column, c: Cipher) -> Column:
    value = F.regexp_extract(m, r"([0-9A-Fa-f]{32,64})$", 1)
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), let(c.digits("key", F.lower(value), 16), lambda v: F.when(
        value == F.upper(value), F.upper(v)).otherwise(v)))


KINDS = ["key", "email", "phone", "ip", "date", "ssn", "card"]


def _kind(m: Column) -> Column:
    full = lambda p: m.rlike(f"^(?:{p})$")
    return F.when(m.contains("@"), "email").when(full(KEY), "key").when(m.startswith("+"), "phone").when(full(IP), "ip") \
        .when(full(f"{ISO}|{DOTTED}|{SLASHED}"), "date").when(full(SSN), "ssn").when(full(GROUPED), "card").when(full(f"{AREA}|{TRUNK}"), "phone").otherwise("card")


def _replace(m: Column, kind: Column, place: Column, c: Cipher) -> Column:
    """The new value, or null where the check fails."""
    return F.when(kind == "email", _email(m, c)).when(kind == "key", _key(m, c)).when(kind == "phone", _phone(m, c)).when(kind == "ip", _ip(m, c)) \
        .when(kind == "date", _date(m, c)) \
        .when(kind == "ssn", _ssn(m, c)).when(kind == "card", F.when(place.isNotNull(), _card(m, place, c)))


def pseudonymise(docs: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """``docs`` with ``text`` rewritten and ``replaced`` (in place of such a column): an array of (kind, new) in order."""
    cipher = Cipher(key, inverse)
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1)))
    out = packed(docs, apart="text").withColumn("_found", F.when(F.array_size(found) > 0, found))

    def value(m):
        def of(k):
            return let(F.when(k == "card", _card_place(m)), lambda p: let(_replace(m, k, p, cipher), lambda v: F.struct(
                k.alias("kind"), v.alias("new"), F.when(v.isNull(), m).when(k != "card", v).otherwise(F.concat(
                    F.substring(m, F.lit(1), p["start"] - 1), v, F.substring(m, p["start"] + p["size"], F.length(m)))).alias("whole"))))

        return let(_kind(m), of)

    out = out.withColumn("_values", F.transform("_found", value))
    joined = let(F.split("text", ANY), lambda gaps: F.array_join(F.transform(gaps, lambda g, i: F.concat(
        g, F.coalesce(F.get("_values", i)["whole"], F.lit("")))), ""))
    text = F.when(F.col("_found").isNull(), F.col("text")).otherwise(joined)
    replaced = F.transform(F.filter("_values", lambda v: v["new"].isNotNull()), lambda v: F.struct(v["kind"].alias("kind"), v["new"].alias("new")))
    empty = F.array().cast("array<struct<kind:string,new:string>>")
    return unpacked(out, docs.columns, text=text, replaced=F.coalesce(replaced, empty))


def count_of(kind: str) -> Column:
    """How many values of a kind a row of ``pseudonymise`` has."""
    return F.size(F.filter("replaced", lambda v: v["kind"] == kind)).cast("long")


def restore(docs: DataFrame, key: str) -> DataFrame:
    """The texts as they were before ``pseudonymise`` with the same key (letters of names and keys in lower case)."""
    return pseudonymise(docs, key, inverse=True)
