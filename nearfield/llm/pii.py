"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Validated numbers and dates in a text are replaced by a keyed permutation of their own format: a Feistel network with a
SHA-256 round function over a pair of residues (left mod A, right mod B), so each value has one pseudonym and no two share
one, in all documents. A pseudonym is a value that the format's validator accepts. The formats and their domains:

- payment cards of 13 to 19 digits of an issuer's range that pass the Luhn check, unbroken or in groups of 3 to 6: all digits
  but the last, walked until the number is of an issuer's range again, and the new check digit;
- telephone numbers with a country code, or in the form 3-3-4: the digits after the country code, alike with and without it;
- social security numbers in the form 3-2-4 with a possible area, group and number: 898 areas x 99 groups x 9,999;
- IPv4 addresses with octets up to 255 that aren't versions (`v1.2.3.4`): the 32 bits;
- dates of the years from 400 on that the calendar has, year first, day first or (where that fails) month first: the day in its
  Gregorian cycle of 400 years (146,097 days = 189 x 773). Days up to the 12th and later ones are permuted apart, by walking
  the cycle of the permutation until the kind fits again, so a date has one pseudonym in all forms and each form is a
  permutation, also `03/04/2021`, which is read day first;
- IBANs with right check digits: the digits and the capitals after them, and new check digits;
- mail addresses: the letters, and the digits, of all but the last label;
- hexadecimal secrets of 16 to 64 digits given to a token, key, secret or password, in any case: all digits in halves of up to 12;
- other secrets given to a password (6 to 64 characters) or a token, secret or API key (8 to 64) that have letters and digits:
  small letters, capitals and digits apart; `ghp_`-like prefixes stay;
- access keys of AKIA and 16 capitals or digits: the 16.

A walk has up to 128 steps; a value that needs more, for which the chance is under 10^-27, stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, WALK = 8, 128
#: Fixed patterns of the formats, the more special first. Quantifiers are bounded, so a long text costs a bounded look ahead, and
#: what a match begins with is looked at before what stands before it, so that most places of a text fail at once.
MAIL_BODY = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
MAIL = rf"(?=[A-Za-z0-9])(?<![A-Za-z0-9._%+-]){MAIL_BODY}"
GIVEN = r" ?[=:] ?[\x22']?"
SECRET = rf"(?<hexto>(?i:token|key|secret|password|passwd|pwd|passphrase){GIVEN})(?<hex>[0-9a-fA-F]{{16,64}})(?![0-9a-zA-Z])"
ACCESS = r"(?=A)(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
PREFIXES = r"(?:gh[pousr]_|github_pat_|sk-|xox[abprs]-)"
PREFIXED = rf"(?=[gsx])(?<![A-Za-z0-9]){PREFIXES}[A-Za-z0-9_-]{{16,120}}(?![A-Za-z0-9])"
WORDLIKE = r"A-Za-z0-9_!@#$%^&*+/=~?"
MIXED = rf"(?=[{WORDLIKE}.-]{{0,63}}\d)(?=[{WORDLIKE}.-]{{0,63}}[A-Za-z])"
OTHERS = rf"(?!{MAIL_BODY}|AKIA[A-Z0-9]{{16}}(?![A-Za-z0-9])|{PREFIXES}[A-Za-z0-9_-]{{16}})"
ASSIGNED = rf"(?<passto>(?i:password|passwd|pwd|passphrase){GIVEN}){OTHERS}{MIXED}(?<pass>[{WORDLIKE}.-]{{5,63}}[{WORDLIKE}-])(?![{WORDLIKE}-])|(?<keyto>(?i:token|secret|api[_ -]?key|access[_ -]?key|auth[_ -]?key){GIVEN}){OTHERS}{MIXED}(?<key>[{WORDLIKE}.-]{{7,63}}[{WORDLIKE}-])(?![{WORDLIKE}-])"
IBAN = r"(?=[A-Z]{2}\d)(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}| [A-Z0-9]{4}(?: (?=[A-Z]{0,3}\d)[A-Z0-9]{4}){1,6}(?: (?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
IP = r"(?=\d)(?<![\d.vV])(?<!(?i:version|release|build|ver\.?)[ :])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?![\d]|\.\d)"
DATE = r"(?=\d\d)(?<![\d./-])(?:\d{4}(?<ds>[-/.])(?:0[1-9]|1[0-2])\k<ds>(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])(?<dt>[-/.])(?:0[1-9]|[12]\d|3[01])\k<dt>\d{4})(?![\d]|[./-]\d)"
SSN = r"(?=\d)(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"
PHONE = r"(?=[+(\d])(?:(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+(?=(?:\d[ .-]?){7,15}(?![ .-]?\d))[1-9]\d{0,2}(?:[ .-]\d{1,4}){3,6}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))"
GROUPED = r"(?=\d{3})(?<![\d-])(?=(?:\d[ -]?){13,19}(?![ -]?\d))\d{3,6}(?<cs>[ -])\d{3,6}(?:\k<cs>\d{3,6}){1,4}(?![\d-])"
NUMBER = r"(?=\d{13})(?<![\dA-Za-z.,])\d{13,19}(?![\dA-Za-z]|[.,]\d)"
#: The words that secrets are given to are part of a match but not of what is replaced.
FOUND = "|".join((SECRET, ASSIGNED, "(?<rest>" + "|".join((MAIL, ACCESS, PREFIXED, IBAN, IP, DATE, SSN, PHONE, GROUPED, NUMBER)) + ")"))
#: Country codes (fixed values) are 1, 7, the two-digit ones here, and else of three digits.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Card issuers' ranges (fixed values) by the first digits.
ISSUER = r"^(?:4|5[0-8]|3[04-9]|6|81|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720))"
#: Stand around what is found, before the word that a secret is given to, and before their own stand-ins in texts that have them.
EDGE, TAG, ESCAPE = "\x01", "\x03", "\x02"
STAND_INS = {ESCAPE: ESCAPE + "\ue002", EDGE: ESCAPE + "\ue001", TAG: ESCAPE + "\ue003"}


def feistel(left: Column, right: Column, a: Column, b: Column, tweak: Column, key: str) -> Column:
    """struct(l, r): a permutation of [0, a) x [0, b) for each tweak, both at most 10^18."""

    def f(i: Column, v: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), v.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(s["l"] + F.pmod(f(i, s["r"]), a), a)).otherwise(s["l"]).alias("l"),
            F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(f(i, s["l"]), b), b)).alias("r"),
        )

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def power(base: int, n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1).cast("bigint"), lambda s, i: F.when(n >= 1, s * base).otherwise(s))


def digits(d: Column, tweak: str, key: str) -> Column:
    """Permutes a string of 1 to 36 decimal digits within its length."""
    n = F.length(d)
    half = F.floor(n / 2).cast("int")
    low = n - half
    num = lambda s: F.coalesce(F.when(F.length(s) > 0, s).otherwise("0"), F.lit("0")).cast("bigint")
    moved = feistel(num(F.substr(d, F.lit(1), half)), num(F.substr(d, half + 1, low)), power(10, half), power(10, low), F.concat(F.lit(tweak), n.cast("string")), key)
    return let(moved, lambda s: F.concat(F.when(half > 0, F.lpad(s["l"].cast("string"), half, "0")).otherwise(""), F.lpad(s["r"].cast("string"), low, "0")))


def symbols(s: Column, base: int, width: int, tweak: str, key: str) -> Column:
    """Permutes a string over the digits of `base` (0-9, a-z) within its length, in stretches of 2 * width. A stretch's
    place is part of its tweak."""

    def stretch(i: Column) -> Column:
        part = F.substr(s, i * (2 * width) + 1, F.lit(2 * width))
        n = F.length(part)
        half = F.floor(n / 2).cast("int")
        low = n - half
        num = lambda x: F.conv(F.concat(F.lit("0"), x), base, 10).cast("bigint")
        moved = feistel(num(F.substr(part, F.lit(1), half)), num(F.substr(part, half + 1, low)), power(base, half), power(base, low), F.concat(F.lit(tweak), F.length(s).cast("string"), F.lit("."), i.cast("string")), key)
        text = lambda v, k: F.when(k > 0, F.lpad(F.lower(F.conv(v.cast("string"), 10, base)), k, "0")).otherwise("")
        return let(moved, lambda m: F.concat(text(m["l"], half), text(m["r"], low)))

    last = F.floor((F.length(s) - 1) / (2 * width)).cast("int")
    return F.when(F.length(s) == 0, s).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), stretch), ""))


def walked(start: Column, step: Callable[[Column], Column], ok: Callable[[Column], Column]) -> Column:
    """The next value of the permutation's cycle that is ok, which makes step a permutation of the values that are."""
    state = lambda x, done: F.struct(x.alias("v"), done.alias("done"))
    turn = lambda s, _: F.when(s["done"], s).otherwise(let(step(s["v"]), lambda x: state(x, ok(x))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), state(start, F.lit(False)), turn, lambda s: F.when(s["done"], s["v"]).otherwise(start))


def refill(form: Column, new: Column, kind: str) -> Column:
    """form with its characters of the class `kind` replaced by those of new, in order."""

    def step(s: Column, c: Column) -> Column:
        hit = c.rlike(kind)
        return F.struct(F.concat(s["t"], F.when(hit, F.substr(new, s["n"], F.lit(1))).otherwise(c)).alias("t"), F.when(hit, s["n"] + 1).otherwise(s["n"]).alias("n"))

    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("n")), step, lambda s: s["t"])


def luhn(d: Column, doubled: int) -> Column:
    """Sum of the Luhn check over a string of digits; `doubled` is 1 where the last digit is doubled."""
    each = F.transform(F.reverse(F.split(d, "")), lambda c, i: let(c.cast("int") * F.when((i + doubled) % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0), lambda s, v: s + v)


def _number(m: Column, key: str) -> Column:
    """Cards keep a right check digit, in whatever groups they are written; a number that fails the check, or that no issuer
    gives out, stays."""

    def whole(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        card = F.length(d).between(13, 19) & d.rlike(ISSUER) & (luhn(d, 0) % 10 == 0)
        new = let(walked(body, lambda b: digits(b, "card", key), lambda b: b.rlike(ISSUER)), lambda b: F.concat(b, F.pmod(F.lit(10) - luhn(b, 1) % 10, F.lit(10)).cast("string")))
        return F.when(card, new).otherwise(d)

    return refill(m, let(F.regexp_replace(m, r"\D", ""), whole), "[0-9]")


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, COUNTRY, 0)
    rest = F.substr(m, F.length(code) + 1, F.length(m))
    return F.concat(code, refill(rest, let(F.regexp_replace(rest, r"\D", ""), lambda d: digits(d, "phone", key)), "[0-9]"))


def _ssn(m: Column, key: str) -> Column:
    n = lambda at, length: F.substr(m, F.lit(at), F.lit(length)).cast("bigint")
    area = n(1, 3)
    left = (area - F.when(area > 666, 2).otherwise(1)) * 99 + n(5, 2) - 1
    pad = lambda v, width: F.lpad(v.cast("string"), width, "0")

    def text(s: Column) -> Column:
        place = F.floor(s["l"] / 99)
        return F.concat_ws("-", pad(place + F.when(place >= 665, 2).otherwise(1), 3), pad(s["l"] % 99 + 1, 2), pad(s["r"] + 1, 4))

    return let(feistel(left, n(8, 4) - 1, F.lit(898 * 99).cast("bigint"), F.lit(9999).cast("bigint"), F.lit("ssn"), key), text)


def _ip(m: Column, key: str) -> Column:
    o = F.split(m, r"\.")
    n = lambda k: F.element_at(o, k).cast("int")
    wide = F.lit(65536).cast("bigint")
    out = feistel(n(1) * 256 + n(2), n(3) * 256 + n(4), wide, wide, F.lit("ip"), key)
    return let(out, lambda s: F.concat_ws(".", *[F.pmod(F.floor(s[h] / d), F.lit(256)).cast("string") for h in ("l", "r") for d in (256, 1)]))


def _date(m: Column, key: str) -> Column:
    """A date that isn't year first is day first where the calendar allows it. What the calendar hasn't stays."""
    first = m.rlike(r"^\d{4}")
    sep = F.when(first, F.substr(m, F.lit(5), F.lit(1))).otherwise(F.substr(m, F.lit(3), F.lit(1)))
    p = lambda a, n: F.substr(m, F.lit(a), F.lit(n))
    day = lambda y, mo, d: F.when(y >= "0400", F.concat_ws("-", y, mo, d).try_cast("date"))
    forms = F.array(
        F.struct(F.lit("ymd").alias("f"), F.when(first, day(p(1, 4), p(6, 2), p(9, 2))).alias("d")),
        F.struct(F.lit("dmy").alias("f"), F.when(~first, day(p(7, 4), p(4, 2), p(1, 2))).alias("d")),
        F.struct(F.lit("mdy").alias("f"), F.when(~first, day(p(7, 4), p(1, 2), p(4, 2))).alias("d")),
    )
    start = F.lit("2000-01-01").cast("date")
    early = lambda v: F.dayofmonth(F.date_add(start, v.cast("int"))) <= 12

    def step(v: Column) -> Column:
        return let(feistel(F.floor(v / 773), F.pmod(v, F.lit(773)), F.lit(189).cast("bigint"), F.lit(773).cast("bigint"), F.lit("date"), key), lambda r: (r["l"] * 773 + r["r"]).cast("bigint"))

    def shift(s: Column) -> Column:
        at = F.datediff(s["d"], start).cast("bigint")
        inner = F.pmod(at, F.lit(146097))
        new = let(let(inner, lambda i: walked(i, step, lambda v: early(v) == early(i))), lambda v: F.date_add(start, (at - inner + v).cast("int")))
        part = F.date_format
        return let(new, lambda d: F.when(s["f"] == "ymd", F.concat(part(d, "yyyy"), sep, part(d, "MM"), sep, part(d, "dd"))).when(s["f"] == "dmy", F.concat(part(d, "dd"), sep, part(d, "MM"), sep, part(d, "yyyy"))).otherwise(F.concat(part(d, "MM"), sep, part(d, "dd"), sep, part(d, "yyyy"))))

    return F.coalesce(F.get(F.transform(F.filter(forms, lambda s: s["d"].isNotNull()), shift), F.lit(0)), m)


ALPHABET, BASE26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"


def _letters(s: Column, tweak: str, key: str) -> Column:
    """Permutes a string of small letters within its length."""
    return F.translate(symbols(F.translate(s, ALPHABET, BASE26), 26, 12, tweak, key), BASE26, ALPHABET)


def _mail(m: Column, key: str) -> Column:
    """Case is lost, as mail addresses have none."""
    low = F.lower(m)
    end = F.regexp_extract(low, r"\.[a-z]{2,24}$", 0)
    body = F.substr(low, F.lit(1), F.length(low) - F.length(end))
    new_letters = _letters(F.regexp_replace(body, "[^a-z]", ""), "mail", key)
    new_digits = let(F.regexp_replace(body, "[^0-9]", ""), lambda d: symbols(d, 10, 12, "mail-digits", key))
    return F.concat(refill(refill(body, new_letters, "[a-z]"), new_digits, "[0-9]"), end)


def _secret(m: Column, key: str) -> Column:
    """One pseudonym for all spellings of the digits: capitals where the letters are all capitals, else small letters."""
    return let(symbols(F.lower(m), 16, 12, "secret", key), lambda s: F.when(m.rlike("[A-F]") & ~m.rlike("[a-f]"), F.upper(s)).otherwise(s))


def _mixed(m: Column, tweak: str, key: str) -> Column:
    """Small letters, capitals and digits permuted among themselves; what is none of these stays."""
    kind = lambda c: F.regexp_replace(m, f"[^{c}]", "")
    out = refill(m, _letters(kind("a-z"), tweak, key), "[a-z]")
    out = refill(out, F.upper(_letters(F.lower(kind("A-Z")), f"{tweak}-capitals", key)), "[A-Z]")
    return refill(out, symbols(kind("0-9"), 10, 12, f"{tweak}-digits", key), "[0-9]")


def _iban(m: Column, key: str) -> Column:
    """Right ones only; the letters after the check digits are permuted, and so are the digits."""
    plain = F.regexp_replace(m, " ", "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    rest = lambda t: F.aggregate(F.split(t, ""), F.lit(0), lambda s, c: ((s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97).cast("int"))
    right = F.length(plain).between(15, 34) & (rest(F.concat(F.substr(plain, F.lit(5), F.lit(30)), F.substr(plain, F.lit(1), F.lit(4)))) == 1)
    new = _mixed(F.substr(plain, F.lit(5), F.lit(30)), "iban", key)
    country = F.substr(plain, F.lit(1), F.lit(2))
    check = lambda b: F.lpad((98 - rest(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(right, refill(m, let(new, lambda b: F.concat(country, check(b), b)), "[A-Z0-9]")).otherwise(m)


def pseudonym(m: Column, given: Column, key: str) -> Column:
    """given: the word that a secret is given to, or an empty string."""
    is_ = lambda p: m.rlike(f"^(?:{p})$")
    prefix = F.regexp_extract(m, "^(?:gh[pousr]_|github_pat_|sk-|xox[abprs]-)", 0)
    return (
        F.when(m.contains("@") & is_(MAIL), _mail(m, key))
        .when((given != "") & m.rlike("^[0-9a-fA-F]{16,64}$"), _secret(m, key))
        .when(is_(ACCESS), F.concat(F.lit("AKIA"), F.upper(symbols(F.lower(F.substr(m, F.lit(5), F.lit(16))), 36, 11, "access", key))))
        .when(is_(PREFIXED), F.concat(prefix, _mixed(F.substr(m, F.length(prefix) + 1, F.length(m)), "prefixed", key)))
        .when((given != "") & m.rlike(f"^{MIXED}[{WORDLIKE}.-]{{6,64}}$"), _mixed(m, "given", key))
        .when(is_(IBAN), _iban(m, key))
        .when(is_(IP), _ip(m, key))
        .when(is_(DATE), _date(m, key))
        .when(is_(SSN), _ssn(m, key))
        .when(is_(PHONE), _phone(m, key))
        .otherwise(_number(m, key))
    )


def looks(text: Column) -> Column:
    """Whether a text has what some format needs: a few cheap scans, so that most texts aren't searched."""
    numbers = text.rlike(r"[0-9](?:[0-9][0-9]|\.[0-9]|[-/.][0-9][0-9])|\+[0-9]")
    given = (text.contains("=") | text.contains(":")) & text.rlike(r"[=:](?<=(?i:token|key|secret|password|passwd|pwd|passphrase) ?[=:])")
    prefixed = (text.contains("_") & text.rlike("_(?<=gh[pousr]_|github_pat_)")) | text.contains("sk-") | text.contains("xox")
    return numbers | text.contains("@") | text.contains("AKIA") | given | prefixed


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with pseudonyms in `text` and, if `count` names a column, how many values were replaced. An empty key is an
    error. Null and empty texts stay; a text without such values stays as it is, byte for byte; rows are kept one to one, in
    any number and with any other columns. A text is searched once, row by row, so nothing is shuffled and no group is gathered."""
    if not key:
        raise ValueError("pseudonyms need a key")
    parts, made = f"parts-{uuid.uuid4().hex}", f"made-{uuid.uuid4().hex}"
    body = F.col(f"`{text}`")
    safe = body
    for mark, stand_in in STAND_INS.items():
        safe = F.replace(safe, F.lit(mark), F.lit(stand_in))
    given = "${hexto}${passto}${keyto}"
    marked = F.regexp_replace(safe, FOUND, f"{given}{EDGE}${{hex}}${{pass}}${{key}}${{rest}}{TAG}{given}{EDGE}")
    cut = F.when(looks(body), F.split(marked, EDGE, -1))  # found values have the odd places

    def one(p: Column, i: Column) -> Column:
        hit = let(F.split(p, TAG, -1), lambda s: let(F.get(s, F.lit(0)), lambda m: F.struct(m.alias("old"), pseudonym(m, F.get(s, F.lit(1)), key).alias("new"))))
        return F.when(i % 2 == 1, hit).otherwise(F.struct(p.alias("old"), p.alias("new")))

    rows = docs.withColumn(parts, cut).withColumn(made, F.when(F.size(parts) > 1, F.transform(parts, one)))
    joined = F.array_join(F.transform(made, lambda s: s["new"]), "")
    for mark, stand_in in reversed(STAND_INS.items()):
        joined = F.replace(joined, F.lit(stand_in), F.lit(mark))
    new = F.when(F.col(made).isNotNull(), joined).otherwise(body).alias(text)
    out = [new if c == text else F.col(f"`{c}`") for c in docs.columns if c != count]
    if count is not None:
        changed = F.size(F.filter(made, lambda s: s["old"] != s["new"])).cast("long")
        out.append(F.when(F.col(made).isNotNull(), changed).otherwise(F.lit(0)).alias(count))
    return rows.select(*out)
