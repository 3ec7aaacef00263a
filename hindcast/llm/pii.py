"""Format-preserving pseudonyms with built-in functions only.

Numbers and dates that pass their own check are permuted inside their format by a keyed Feistel network: the pseudonym of a
valid card number is a valid card number, of a date a date. The permutation is one to one on the valid values of the format, so equal
values stay equal in every document and different ones stay different.

  card    13-19 digits, plain or in groups, Luhn-valid: all digits but the first and the check digit; the check digit is renewed.
          In a longer run of groups the first valid stretch from border to border, and what is valid behind it, see `_cards`
  phone   North American numbers in ten digits: all but the digits that may not be 0 or 1
  ssn     area, group and serial of an assignable number
  ip      IPv4 address
  date    a real day of 1900-2099 as Y-M-D, D/M/Y, M/D/Y or D.M.Y
  email   not a number: the name becomes letters of a keyed digest, of the same length; the host stays

A network works on a pair (a, b) of integers below moduli m and n: in turn a += F(b) mod m and b += F(a) mod n, with F from
SHA-256 of key, kind, round and value. Values are found and replaced inside the row: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm.columns import pack, packed, unpack

ROUNDS = 8
STRETCH = 256
KINDS = ("email", "ip", "date", "ssn", "phone", "card")
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?:(?<=\d{4}-\d{2}-\d{2})(?=T\d)|(?![\w/-]|\.\d))",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])",
}
# Chunks of digits and hyphens with single spaces between, 13 digits or more in sight; a date, SSN or phone number is no part of it.
_PHONE = r"(?:1[ -])?\d{3}[ -]\d{3}[ -]\d{4}(?![\w-])"  # not with the country code joined on: "1486 123 4539" goes on a card
_CHUNK = r"\d++(?:-\d++)*+(?![\w-])"
PATTERNS["card"] = (
    rf"(?<![\w-])(?=\d(?:[ -]?\d){{12}}){_CHUNK}(?: (?!{PATTERNS['date']}|{PATTERNS['ssn']}|{_PHONE}){_CHUNK})*+")
ANY = "|".join(PATTERNS[k] for k in KINDS)
FIRST_DAY, DAYS = "1900-01-01", 319 * 229  # 1900-01-01 .. 2099-12-31


def _function(key: str, kind: str, turn: Column, value: Column, modulus: Column | int) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long") % modulus


def feistel(key: str, kind: str, a: Column, b: Column, m: Column | int, n: Column | int) -> Column:
    """struct(a, b): the pair permuted among all pairs below (m, n)."""
    m, n = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (m, n))

    def turn(state: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0, F.struct(((state["a"] + _function(key, kind, i, state["b"], m)) % m).alias("a"), state["b"].alias("b"))
        ).otherwise(F.struct(state["a"].alias("a"), ((state["b"] + _function(key, kind, i, state["a"], n)) % n).alias("b")))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _padded(value: Column, width: Column | int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """A digit string (2 to 34 digits) permuted among those of its length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    pair = feistel(
        key, kind, F.substr(digits, F.lit(1), half), F.substr(digits, half + 1, rest),
        F.pow(F.lit(10.0), half).cast("long"), F.pow(F.lit(10.0), rest).cast("long"))
    return _with(pair, lambda p: F.concat(_padded(p["a"], half), _padded(p["b"], rest)))


def _with(value: Column, body) -> Column:
    """`body(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def refill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced in turn."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def put(state: Column, char: Column) -> Column:
        return F.when(
            char.between("0", "9"),
            F.struct((state["at"] + 1).alias("at"), F.concat(state["out"], F.substr(digits, state["at"], F.lit(1))).alias("out"))
        ).otherwise(F.struct(state["at"].alias("at"), F.concat(state["out"], char).alias("out")))

    return F.aggregate(F.split(template, ""), start, put, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number with its check digit last."""
    places = F.split(F.reverse(digits), "")

    def worth(char: Column, i: Column) -> Column:
        d = F.when(char == "", 0).otherwise(F.ascii(char) - 48)
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda t, d: t + d)


def _card(key: str, match: Column) -> Column:
    """One card number, known to be valid."""
    def renewed(digits: Column) -> Column:
        n = F.length(digits)
        body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), permuted_digits(key, "card", F.substr(digits, F.lit(2), n - 2)))
        return _with(body, lambda b: refill(match, F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))))

    return _with(_digits(match), renewed)


def _cards(key: str, match: Column) -> Column:
    """array of struct(kind, value): the run of digit groups cut into card numbers and, with null kind, what lies between.

    From the left, each group starts a number if some run of whole groups from there has 13-19 digits and is Luhn-valid. Of several,
    16 digits go first, then 15, then the others from the shortest: a code of three digits behind a number may fit the check by
    chance. A group in no number stays as it is.

    The scan keeps group numbers only, in stretches of STRETCH groups that are joined once at the end; the pieces are cut afterwards. So
    the time follows the length of the run.
    """
    def scan(parts: Column, digits: Column) -> Column:
        def best(i: Column) -> Column:
            """Groups of the best valid run that starts at group i; null if there is none."""
            lengths = F.sequence(F.lit(1), F.least(F.size(parts) - i, F.lit(19)))
            tried = F.transform(lengths, lambda n: F.struct(n.alias("n"), F.array_join(F.slice(digits, i + 1, n), "").alias("d")))
            valid = F.filter(tried, lambda r: F.length(r["d"]).between(13, 19) & F.call_function("luhn_check", r["d"]))
            rank = lambda d: F.when(F.length(d) == 16, 0).when(F.length(d) == 15, 1).otherwise(F.length(d))
            return F.array_min(F.transform(valid, lambda r: F.struct(rank(r["d"]).alias("rank"), r["n"].alias("n"))))["n"]

        def stretch(state: Column, k: Column) -> Column:
            def step(inner: Column, i: Column) -> Column:
                def found(n: Column) -> Column:
                    run = F.struct(i.alias("at"), (i + n).alias("end"))
                    return F.when(n.isNotNull(), F.struct((i + n).alias("next"), F.array_append(inner["runs"], run).alias("runs"))).otherwise(inner)

                return F.when(i < inner["next"], inner).otherwise(_with(best(i), found))

            last = F.least((k + 1) * STRETCH, F.size(parts)) - 1
            start = F.struct(state["next"].alias("next"), F.array().cast("array<struct<at: int, end: int>>").alias("runs"))
            done = F.aggregate(F.sequence(k * STRETCH, last), start, step)
            return _with(done, lambda x: F.struct(x["next"].alias("next"), F.array_append(state["runs"], x["runs"]).alias("runs")))

        none = F.array().cast("array<array<struct<at: int, end: int>>>")
        stretches = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / STRETCH).cast("int"))
        found = F.aggregate(stretches, F.struct(F.lit(0).alias("next"), none.alias("runs")), stretch, lambda s: F.flatten(s["runs"]))
        return _with(found, lambda runs: pieces(parts, runs))

    def piece(kind: str | None, value: Column) -> Column:
        return F.struct(F.lit(kind).cast("string").alias("kind"), value.alias("value"))

    def pieces(parts: Column, runs: Column) -> Column:
        def cut(run: Column, j: Column) -> Column:
            """The number and what lies between it and the next."""
            until = F.coalesce(F.get(runs, j + 1)["at"], F.size(parts))
            raw = F.array_join(F.slice(parts, run["at"] + 1, run["end"] - run["at"]), "")
            behind = F.array_join(F.slice(parts, run["end"] + 1, until - run["end"]), "")
            return _with(raw, lambda r: F.array(
                piece("card", _card(key, F.regexp_replace(r, "[ -]$", ""))), piece(None, F.concat(F.regexp_extract(r, "[ -]$", 0), behind))))

        front = F.array_join(F.slice(parts, F.lit(1), F.coalesce(F.get(runs, F.lit(0))["at"], F.size(parts))), "")
        return F.concat(F.array(piece(None, front)), F.flatten(F.transform(runs, cut)))

    groups = F.regexp_extract_all(match, F.lit(r"\d+[ -]?"), F.lit(0))
    return _with(groups, lambda parts: _with(F.transform(parts, _digits), lambda digits: scan(parts, digits)))


def _phone(key: str, match: Column) -> Column:
    def renewed(all_digits: Column) -> Column:
        front = F.substr(all_digits, F.lit(1), F.length(all_digits) - 10)
        d = F.substr(all_digits, F.length(all_digits) - 9, F.lit(10))
        free = permuted_digits(
            key, "phone", F.concat(F.substring(d, 2, 2), F.substring(d, 5, 2), F.substring(d, 7, 4)))
        return _with(free, lambda f: refill(match, F.concat(
            front, F.substring(d, 1, 1), F.substring(f, 1, 2), F.substring(d, 4, 1), F.substring(f, 3, 2), F.substring(f, 5, 4))))

    return _with(_digits(match), renewed)


def _ssn(key: str, match: Column) -> Column:
    def renewed(d: Column) -> Column:
        area, group, serial = (F.substring(d, a, n).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
        rank = area - 1 - F.when(area > 666, 1).otherwise(0)
        pair = feistel(key, "ssn", rank * 99 + group - 1, serial - 1, 898 * 99, 9999)

        def back(p: Column) -> Column:
            at = F.floor(p["a"] / 99)
            return F.concat(
                _padded(at + 1 + F.when(at >= 665, 1).otherwise(0), 3), _padded(p["a"] % 99 + 1, 2), _padded(p["b"] + 1, 4))

        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        return F.when(valid, refill(match, _with(pair, back)))

    return _with(_digits(match), renewed)


def _ip(key: str, match: Column) -> Column:
    def renewed(part: Column) -> Column:
        o = [F.get(part, F.lit(i)).cast("int") for i in range(4)]
        pair = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        text = lambda p: F.concat_ws(".", *[x.cast("string") for x in (
            F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)])
        return F.when(F.greatest(*o) < 256, _with(pair, text))

    return _with(F.split(match, r"\."), renewed)


def _date(key: str, match: Column) -> Column:
    def day(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd")

    def renewed(d: Column) -> Column:
        iso = match.contains("-")
        two = [F.substring(d, 1, 2), F.substring(d, 3, 2)]
        year = F.substring(d, 5, 4)
        read = F.array(
            F.when(iso, day(F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))),
            F.when(~iso, day(year, two[1], two[0])), F.when(~iso & match.contains("/"), day(year, two[0], two[1])))
        shape = F.when(F.get(read, F.lit(0)).isNotNull(), "yyyyMMdd").when(F.get(read, F.lit(1)).isNotNull(), "ddMMyyyy").otherwise("MMddyyyy")
        number = F.date_diff(F.coalesce(*[F.get(read, F.lit(i)) for i in range(3)]), F.lit(FIRST_DAY).cast("date"))

        def back(p: Column) -> Column:
            then = F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * 229 + p["b"]).cast("int"))
            return refill(match, F.when(shape == "yyyyMMdd", F.date_format(then, "yyyyMMdd")).when(
                shape == "ddMMyyyy", F.date_format(then, "ddMMyyyy")).otherwise(F.date_format(then, "MMddyyyy")))

        pair = feistel(key, "date", F.floor(number / 229), number % 229, 319, 229)
        return F.when((number >= 0) & (number < DAYS), _with(pair, back))

    return _with(_digits(match), renewed)


def _email(key: str, match: Column) -> Column:
    at = F.instr(match, "@")
    name = F.lower(F.substr(match, F.lit(1), at - 1))
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), name, F.lower(F.substr(match, at, F.length(match)))), 256)
    letters = F.translate(F.concat(digest, F.sha2(digest, 256)), "0123456789", "ghijklmnop")
    return F.concat(F.rpad(F.substr(letters, F.lit(1), F.least(at - 1, F.lit(128))), at - 1, "x"), F.substr(match, at, F.length(match)))


MAKERS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone}


def pseudonym(key: str, match: Column) -> Column:
    """array of struct(kind, value): the pieces that replace one match; kind is null for a piece that stays as it is."""
    out = None
    for kind in KINDS:
        if kind == "card":
            made = _cards(key, match)
        else:
            value = MAKERS[kind](key, match)
            made = F.array(F.struct(F.when(value.isNotNull(), kind).alias("kind"), F.coalesce(value, match).alias("value")))
        hit = F.regexp_like(match, F.lit(f"^(?:{PATTERNS[kind]})$"))
        out = F.when(hit, made) if out is None else out.when(hit, made)
    return out.otherwise(F.array(F.struct(F.lit(None).cast("string").alias("kind"), match.alias("value"))))


def pseudonymise(df: DataFrame, *, text: str = "text", key: str, result: str = "private") -> DataFrame:
    """Every row of `df` with `result`: struct(text, found: array of struct(kind, value)), values being the pseudonyms.

    What fails its check (a card number against Luhn, the 30th of February) stays as it is. Null text stays null, with nothing
    found. Rows are independent: ties, repeats and empty tables need no rule. A column named like `result` is replaced.
    """
    body = packed(text)
    matches = F.when(F.regexp_like(body, F.lit("[0-9@]")), F.regexp_extract_all(body, F.lit(ANY), F.lit(0)))
    staged = pack(df).withColumn("_matches", matches)
    staged = staged.withColumn(
        "_made", F.when(F.size("_matches") > 0, F.transform("_matches", lambda m: pseudonym(key, m))))
    replaced = F.concat(
        F.zip_with("_matches", "_made", lambda m, p: F.coalesce(F.array_join(F.transform(p, lambda x: x["value"]), ""), m)), F.array(F.lit("")))
    pieces = F.split(body, ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(pieces, replaced, lambda a, b: F.array(a, b))), "")
    pieces_made = F.coalesce(F.flatten("_made"), F.array().cast("array<struct<kind: string, value: string>>"))
    found = F.filter(pieces_made, lambda p: p["kind"].isNotNull())
    made = F.struct(F.when(F.col("_made").isNotNull(), joined).otherwise(body).alias("text"), found.alias("found"))
    return unpack(staged, df.columns, **{result: made})
