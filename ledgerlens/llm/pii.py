"""PII: personal numbers, dates and addresses become keyed pseudonyms of the same format.

Each value that is found and valid is replaced by the image of a keyed permutation of its format, so equal
values have equal pseudonyms in every document (numbers also where they are grouped differently), different values have different ones, and nobody without
the key can go back. The permutation is an unbalanced Feistel network over mixed radices: the value's
characters (an IPv4 address's octets, the two coordinates of a day) are split in two parts, and in turn
each part is added, digit by digit and modulo each digit's radix, to a keyed SHA-256 of the other part.

What is found, and what is left as it is within it:

* e-mail addresses: the local part is permuted, each letter within its alphabet, or its row of code points in scripts
  that have none here; the domain stays;
* telephone numbers: after a ``+`` 8 to 15 digits in any grouping, else an area code in parentheses with 8 to 13
  digits in all, or 3-3-4 digits with a separator; the country code stays;
* payment card numbers of 13 to 19 digits that pass the Luhn check, plain or in any grouping by single spaces or
  hyphens; where other numbers adjoin, groups as cards have them. The last digit is computed anew, so the
  pseudonym passes the check too;
* social security numbers ``ddd-dd-dddd`` outside the ranges that are never issued: the permutation is applied until it
  gives such a number again;
* IBANs that pass their check, plain or in groups of four: the country stays, the check digits are computed anew;
* IPv4 addresses with octets up to 255;
* IPv6 addresses of eight groups, or of two or more around one ``::``, with a digit: digits and letters a to f are permuted
  each among their like, so two ways to write an address have two pseudonyms;
* days ``yyyy-mm-dd``, ``mm/dd/yyyy`` or else ``dd/mm/yyyy`` that exist, from 1900 to 2099: the pseudonym is
  a day in that range, written alike. A day that is written before its month, which only a day above the 12th shows,
  becomes such a day, so different dates never have one pseudonym;
* 32 to 64 hexadecimal digits that are assigned to a token, key, secret or password, in any case, with or without quotes.

Numbers that fail their check are text and stay. It is all column expressions: a text without a digit or an ``@`` is
passed on after one scan, and no row is moved. The key is a column of one row that the plan reads, so no plan shows it.

Defined results: a null text stays null, an empty one empty, each with no finds; an empty table gives an empty one. Rows
that repeat get equal results. Other columns pass through; a column that is named as a result gives way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import let

ROUNDS = 8
#: Fixed: the days from 1900-01-01 to 2099-12-31 are 17 * 4297.
FIRST_DAY, DAY_RADICES = "1900-01-01", (17, 4297)
#: Fixed: first code point and size of each alphabet a character is permuted in: digits, Latin letters small and large,
#: Latin letters beyond these, Cyrillic ones, Chinese signs, Hangul.
ALPHABETS = (
    (48, 10), (97, 26), (65, 26), (0xE0, 23), (0xF8, 8), (0xC0, 23), (0xD8, 8), (0x100, 128), (0x180, 208),
    (0x400, 16), (0x410, 32), (0x430, 32), (0x450, 16), (0x4E00, 0x5200), (0xAC00, 0x2BA0),
)
#: Characters from here on without an alphabet are permuted among the ``ROW`` code points of their row.
ROWS_FROM, ROW = 0x250, 16
#: Characters of a local part that are permuted together.
CHUNK = 64
#: Steps of the walk that looks for a day above the 12th, or a number that is issued; each fails with a probability of 0.4
#: or 0.11.
WALK = 64

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Country codes have one digit, two or else three.
_COUNTRY = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: How cards are grouped, longest first: these are also found beside other numbers.
_CARD_GROUPS = [
    r"\d{13,19}",
    *(f.replace("_", sign) for f in (r"\d{4}_\d{4}_\d{4}_\d{4}_\d{1,3}", r"\d{4}_\d{4}_\d{4}_\d{4}") for sign in " -"),
    *(f.replace("_", r"[ \-]") for f in (r"\d{4}_\d{6}_\d{5}", r"\d{4}_\d{6}_\d{4}", r"\d{4}_\d{4}_\d{5}", r"\d{4}_\d{3}_\d{3}_\d{3}")),
]
#: A whole run of digits and single separators: no digit goes on before or after it.
_CARD_RUNS = [rf"(?<!\d[ .\-/])\d(?:{sign}?\d){{12,18}}(?![\p{{L}}\p{{N}}]|[ .\-/]\d)" for sign in " -"]
PATTERNS = {
    # a local part begins where the run of its characters does, so that runs without an @ are looked at once
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63}){0,8}\.\p{L}{2,24}",
    "secret": r"(?<=(?i:token|key|secret|password)[\"']? ?[=:] ?[\"']?)[0-9a-fA-F]{32,64}(?![\p{L}\p{N}])",
    "phone": _BEFORE + r"(?:(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[ .\-]\d{4}" + _AFTER
    + r"|\+[1-9](?=(?:[ .\-()]{0,2}\d){7,14}(?![\p{L}\p{N}]))\d{0,2}(?:[ .\-]?\(\d{1,5}\))?(?:[ .\-]?\d){4,14}" + _AFTER
    + r"|\((?=\d{2,5}\)(?:[ .\-]?\d){3,11}(?![\p{L}\p{N}]))\d{2,5}\)(?:[ .\-]?\d){6,8}" + _AFTER + ")",
    "ip": r"(?<![\p{L}\p{N}.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?![\p{L}\p{N}]|\.\d)",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?=[0-9a-fA-F:]{0,39}\d)(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
    + r"|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "date": _BEFORE + r"(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})" + _AFTER,
    "iban": _BEFORE + r"(?![0-9A-F]{32})[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _AFTER,
    "ssn": _BEFORE + r"\d{3}-\d{2}-\d{4}" + _AFTER,
    "card": _BEFORE + "(?:" + "|".join([*_CARD_RUNS, *(g + _AFTER for g in _CARD_GROUPS)]) + ")",
}
#: Fixed: social security numbers of these areas, groups and serials are never issued.
_NOT_ISSUED = r"^(?:000|666|9)|^\d{3}-?00|0000$"
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def feistel(values: Column, radices: Column, key: Column | str, kind: Column, rounds: int = ROUNDS) -> Column:
    """The image of ``values`` (``array<bigint>``) under the keyed permutation for ``radices`` and ``kind``."""

    def network(s: Column) -> Column:
        half = F.floor(F.size(s["v"]) / 2).cast("int")

        def one_round(v: Column, r: Column) -> Column:
            left = r % 2 == 0  # the part that changes
            other = F.when(left, F.slice(v, half + 1, F.size(v))).otherwise(F.slice(v, 1, half))
            seed = F.concat_ws("|", F.lit(key), s["kind"], F.array_join(s["m"].cast("array<string>"), ","), r.cast("string"))

            def moved(said: Column) -> Column:
                def digit(x: Column, i: Column) -> Column:
                    drawn = F.conv(F.substring(F.sha2(F.concat_ws("|", said, i.cast("string")), 256), 1, 12), 16, 10)
                    changes = ((i < half) == left) & (F.get(s["m"], i) > 1)
                    return F.when(changes, (x + drawn.cast("long")) % F.get(s["m"], i)).otherwise(x)

                return F.transform(v, digit)

            return let(F.concat_ws("|", seed, F.array_join(other.cast("array<string>"), ",")), moved)

        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), s["v"], one_round)

    return let(F.struct(values.alias("v"), radices.alias("m"), kind.alias("kind")), network)


def _alphabet(code: Column, hexadecimal: Column) -> Column:
    """(first code point, size) of a character's alphabet; size 1 where it has none."""
    row = F.when((code >= ROWS_FROM) & ~hexadecimal, ROW).otherwise(1)
    other = F.struct((code - code % row).cast("int").alias("base"), F.lit(None).cast("int").alias("hex"), row.alias("size"))
    found = reduce(
        lambda rest, a: F.when(
            code.between(a[0], a[0] + a[1] - 1),
            F.struct(F.lit(a[0]).alias("base"), (F.when(hexadecimal, 6) if a[1] == 26 else F.lit(None).cast("int")).alias("hex"), F.lit(a[1]).alias("size")),
        ).otherwise(rest),
        reversed(ALPHABETS),
        other,
    )
    return let(found, lambda a: F.struct(a["base"].alias("base"), F.coalesce(a["hex"], a["size"]).alias("size")))


def _sign(code: Column) -> Column:
    """The character of a code point."""
    wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code < 256, F.char(code)).otherwise(wide)  # `char` goes up to there


def _permuted(text: Column, first: Column, last: Column, key: Column, kind: Column) -> Column:
    """``text`` with its characters from ``first`` to before ``last`` (from 0) permuted in their alphabets."""
    codes = F.transform(F.sequence(F.lit(1), F.char_length(text)), lambda i: F.ascii(F.substr(text, i, F.lit(1))))

    def image(codes: Column) -> Column:
        signs = F.transform(
            codes,
            lambda c, i: F.when((i >= first) & (i < last), _alphabet(c, kind.isin("secret", "ipv6"))).otherwise(
                F.struct(c.alias("base"), F.lit(1).alias("size"))
            ),
        )

        def written(signs: Column) -> Column:
            values = F.zip_with(codes, signs, lambda c, a: (c - a["base"]).cast("long"))
            radices = F.transform(signs, lambda a: a["size"])
            moved = feistel(values, radices, key, kind)
            letters = F.zip_with(moved, signs, lambda v, a: F.when(a["size"] > 1, _sign(v + a["base"])))
            kept = F.transform(letters, lambda c, i: F.coalesce(c, F.substr(text, i + 1, F.lit(1))))
            return F.array_join(kept, "")

        return let(signs, written)

    return let(codes, image)


def _mod_97(iban: Column) -> Column:
    """An IBAN without spaces, its first four signs put last and letters as numbers from 10, modulo 97."""
    turned = F.concat(F.substr(iban, F.lit(5), F.char_length(iban)), F.substr(iban, F.lit(1), F.lit(4)))
    codes = F.transform(F.sequence(F.lit(1), F.char_length(turned)), lambda i: F.ascii(F.substr(turned, i, F.lit(1))))
    return F.aggregate(codes, F.lit(0), lambda acc, c: F.when(c < 65, acc * 10 + c - 48).otherwise(acc * 100 + c - 55) % 97)


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum of a string of digits; of each two, counted from the right, number ``doubled`` counts twice."""
    values = F.transform(
        F.sequence(F.lit(0), F.char_length(digits) - 1),
        lambda i: F.ascii(F.substr(digits, F.char_length(digits) - i, F.lit(1))) - 48,
    )
    parts = F.transform(values, lambda d, i: F.when(i % 2 == doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(parts, F.lit(0), lambda acc, d: acc + d)


def _refilled(match: Column, signs: Column, kept: str = "[^0-9]") -> Column:
    """``match`` with what isn't ``kept`` of it replaced by ``signs``, in order."""
    sign = lambda i: F.substr(match, i, F.lit(1))
    rank = lambda i: F.char_length(F.regexp_replace(F.substr(match, F.lit(1), i), kept, ""))
    signs = F.transform(
        F.sequence(F.lit(1), F.char_length(match)),
        lambda i: F.when(sign(i).rlike(kept), sign(i)).otherwise(F.substr(signs, rank(i), F.lit(1))),
    )
    return F.array_join(signs, "")


def _day(match: Column) -> Column:
    """The day that a match stands for and how it is written; a null day if there is none in range."""
    iso = F.when(match.substr(5, 1) == "-", F.try_to_timestamp(match, F.lit("yyyy-MM-dd")))
    us = F.when(match.substr(3, 1) == "/", F.try_to_timestamp(match, F.lit("MM/dd/yyyy")))
    eu = F.when(match.substr(3, 1) == "/", F.try_to_timestamp(match, F.lit("dd/MM/yyyy")))
    day = F.coalesce(iso, us, eu).cast("date")
    form = F.when(iso.isNotNull(), "yyyy-MM-dd").when(us.isNotNull(), "MM/dd/yyyy").otherwise("dd/MM/yyyy")
    return F.struct(F.when(F.year(day).between(1900, 2099), day).alias("day"), form.alias("form"))


def _kind(match: Column) -> Column:
    return (
        F.when(match.contains("@"), "email")
        .when(match.rlike(r"^[0-9a-fA-F]{32,}$"), "secret")
        .when(match.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]+$"), "iban")
        .when(match.rlike(r"^[0-9a-fA-F]+:[0-9a-fA-F:]+$"), "ipv6")
        .when(match.rlike(r"^\d+\.\d+\.\d+\.\d+$") & match.rlike(r"^" + PATTERNS["ip"] + "$"), "ip")
        .when(match.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})$"), "date")
        .when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(match.rlike(r"^\d(?:[ \-]?\d){12,18}$"), "card")
        .otherwise("phone")
    )


def pseudonym(match: Column, key: Column | str) -> Column:
    """(kind, text) for a match: what takes its place, and a null kind where it isn't valid."""

    def of(s: Column) -> Column:
        m, kind = s["m"], s["kind"]
        size = F.char_length(m)
        code = F.char_length(F.regexp_extract(m, "^" + _COUNTRY, 0))
        octets = F.split(m, r"\.").cast("array<bigint>")
        ip = F.array_join(feistel(octets, F.array_repeat(F.lit(256), 4), key, kind).cast("array<string>"), ".")

        def date(d: Column) -> Column:
            def moved(day: Column) -> Column:
                number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
                parts = F.array(F.floor(number / DAY_RADICES[1]), (number % DAY_RADICES[1]).cast("long"))
                image = feistel(parts, F.array(*map(F.lit, DAY_RADICES)), key, kind)
                to = let(image, lambda v: (F.get(v, F.lit(0)) * DAY_RADICES[1] + F.get(v, F.lit(1))).cast("int"))
                return F.date_add(F.lit(FIRST_DAY).cast("date"), to)

            # A day written first is above the 12th, or it would be a month; the walk ends on such a day, so that no
            # two ways to write a day ever meet in one pseudonym.
            started = F.struct(moved(d["day"]).alias("day"))
            walked = F.aggregate(
                F.sequence(F.lit(1), F.lit(WALK)),
                started,
                lambda at, _: F.when(F.dayofmonth(at["day"]) > 12, at).otherwise(F.struct(moved(at["day"]).alias("day"))),
                lambda at: F.when(F.dayofmonth(at["day"]) > 12, F.date_format(at["day"], "dd/MM/yyyy")),
            )
            text = (
                F.when(d["form"] == "yyyy-MM-dd", F.date_format(moved(d["day"]), "yyyy-MM-dd"))
                .when(d["form"] == "MM/dd/yyyy", F.date_format(moved(d["day"]), "MM/dd/yyyy"))
                .otherwise(walked)
            )
            return F.when(d["day"].isNotNull(), text)

        def iban(plain: Column) -> Column:
            def checked(body: Column) -> Column:
                country = F.substr(plain, F.lit(1), F.lit(2))
                check = F.lpad((98 - _mod_97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
                return _refilled(m, F.concat(country, check, body), " ")

            body = F.substr(plain, F.lit(5), F.char_length(plain))
            return F.when(_mod_97(plain) == 1, let(_permuted(body, zero, F.char_length(body), key, kind), checked))

        def email(local: Column) -> Column:
            chunks = F.sequence(F.lit(1), F.char_length(local), F.lit(CHUNK))
            each = F.transform(chunks, lambda i: let(F.substr(local, i, F.lit(CHUNK)), lambda c: _permuted(c, zero, size, key, kind)))
            return F.concat(F.array_join(each, ""), F.substr(m, F.char_length(local) + 1, size))

        digits = F.regexp_replace(m, r"[^0-9]", "")
        zero, n = F.lit(0), F.char_length(digits)

        def card(number: Column) -> Column:
            plain = F.regexp_replace(number, r"[^0-9]", "")
            n = F.char_length(plain)

            def checked(moved: Column) -> Column:
                body = F.substr(moved, F.lit(1), n - 1)
                check = F.pmod(10 - _luhn_sum(body, 0) % 10, F.lit(10))
                return _refilled(number, F.concat(body, check.cast("string")))

            before = F.instr(m, number) - 1
            image = let(_permuted(plain, zero, n - 1, key, kind), checked)
            parts = (F.substr(m, F.lit(1), before), image, F.substr(m, before + F.char_length(number) + 1, size))
            return F.when(number.isNotNull(), F.concat(*parts))

        # The whole match, or else the first usual grouping within it, that passes the check.
        shorter = (F.regexp_extract(m, _BEFORE + g + _AFTER, 0) for g in _CARD_GROUPS)
        passes = lambda c: (c != "") & (_luhn_sum(F.regexp_replace(c, r"[^0-9]", ""), 1) % 10 == 0)
        number = F.get(F.filter(F.array(m, *shorter), passes), F.lit(0))
        national = let(F.substr(m, code + 1, size), lambda x: F.struct(x.alias("m"), F.regexp_replace(x, r"[^0-9]", "").alias("d")))
        phone = let(
            national,
            lambda x: F.concat(F.substr(m, F.lit(1), code), _refilled(x["m"], _permuted(x["d"], zero, size, key, kind))),
        )
        issued = ~m.rlike(_NOT_ISSUED)

        def ssn(digits: Column) -> Column:
            moved = lambda d: F.struct(_permuted(d, zero, F.lit(9), key, kind).alias("d"))
            out = lambda at: at["d"].rlike(_NOT_ISSUED)
            walk = F.sequence(F.lit(1), F.lit(WALK))
            return F.aggregate(walk, moved(digits), lambda at, _: F.when(out(at), moved(at["d"])).otherwise(at), lambda at: F.when(~out(at), _refilled(m, at["d"])))

        text = (
            F.when(kind == "email", let(F.substring_index(m, "@", 1), email))
            .when(kind == "iban", let(F.replace(m, F.lit(" ")), iban))
            .when(kind == "ip", ip)
            .when(kind == "date", let(_day(m), date))
            .when((kind == "ssn") & issued, let(digits, ssn))
            .when(kind == "card", let(number, card))
            .when(kind == "phone", phone)
            .when((kind == "secret") | ((kind == "ipv6") & (F.regexp_count(m, F.lit(":")) <= 7)), _permuted(m, zero, size, key, kind))
        )
        return let(text, lambda t: F.struct(F.when(t.isNotNull(), kind).alias("kind"), F.coalesce(t, m).alias("text")))

    return let(F.struct(match.alias("m"), _kind(match).alias("kind")), of)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` pseudonymised and ``pii``, the kinds of what was replaced, in order."""
    rest = [c for c in docs.columns if c not in (text, "pii")]
    order = [c for c in docs.columns if c != "pii"]
    secret = docs.sparkSession.createDataFrame([(key,)], "key string").scalar()
    found = docs.select(
        *rest,
        text,
        secret.alias("_key"),
        F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(_ANY), 0)).alias("_found"),
    )
    # Only texts with a match are taken apart; `_said` is named twice so that it is computed once.
    said = found.withColumn(
        "_said", F.when(F.size("_found") > 0, F.transform("_found", lambda m: pseudonym(m, F.col("_key"))))
    )
    gaps = F.split(text, _ANY, -1)
    joined = F.concat(
        F.get(gaps, F.lit(0)),
        F.array_join(
            F.zip_with("_said", F.slice(gaps, 2, F.size(gaps)), lambda s, gap: F.concat(s["text"], gap)), ""
        ),
    )
    kinds = F.coalesce(F.array_compact(F.transform("_said", lambda s: s["kind"])), F.array().cast("array<string>"))
    out = said.select(*rest, F.when(F.col("_said").isNull(), F.col(text)).otherwise(joined).alias(text), kinds.alias("pii"))
    return out.select(*order, "pii")
