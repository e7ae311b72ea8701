"""Personal data replaced by format-preserving Feistel pseudonyms, with SQL functions only.

One pattern finds candidates; each is validated (Luhn and issuer ranges of cards,
mod 97 of IBANs, ranges of social security numbers and addresses, the calendar for
dates) and, where valid, permuted under a key within its own format. The Feistel
networks work on Z_a x Z_b with a * b the exact size of the format, so there is no
cycle walking, a pseudonym is valid again, and equal values get equal pseudonyms in
every document. Check digits are computed anew. It is one projection: no shuffle,
and each text is handled where it is read.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.shared import quoted

ROUNDS = 10
#: Setting of the session that holds the key; without it the example key is taken, which anyone can read here.
KEY_SETTING = "spark.quillspark.pii.key"
KEY = "quillspark-example-key"

#: Lengths of IBANs by country.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Country codes of phone numbers of one and of two places; all others have three.
_CODE_1, _CODE_2 = "^[17]", "^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Letters as (first code, number of codes) that change among themselves, beyond ASCII.
_LETTERS = ((224, 23), (192, 23), (256, 128), (945, 17), (963, 7), (913, 17), (931, 7), (1072, 32), (1040, 32), (1104, 16), (1024, 16), (1488, 27), (1569, 26), (1601, 10), (2309, 49), (3585, 46), (12353, 86), (12449, 90), (19968, 20989), (44032, 11172))

_NOT_INSIDE = r"(?<![\p{L}\p{N}_.%+-])"
_EMAIL = r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
_PHONE = r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\d{3}([.-])\d{3}\1\d{4}(?![\d.-]*\d)"
_DATE = r"\d{4}-\d{2}-\d{2}(?![\d-])|\d{1,2}([/.])\d{1,2}\2\d{4}(?!\d)"
_SSN = r"\d{3}-\d{2}-\d{4}(?![\d-])"
_ADDRESS = r"\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
_CARD = r"\d{13,19}(?![\p{L}\p{N}])|\d{4}([ -])\d{4}\3\d{4}\3\d{1,7}(?!\d)|\d{4}([ -])\d{6}\4\d{5}(?!\d)"
_IBAN = "(?:" + "|".join(rf"(?:{'|'.join(c.split())})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN_LENGTHS.items()) + r")(?![\p{L}\p{N}])"
_ADDRESS_6 = r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])"
PATTERN = f"{_NOT_INSIDE}(?:{_EMAIL}|{_PHONE}|{_DATE}|{_SSN}|{_ADDRESS}|{_ADDRESS_6}|{_CARD}|{_IBAN})"

#: 270 * 271 days from 1900-01-01, to 2100-05-01.
_DAYS = (270, 271)
#: Issuer ranges of cards, by their first digits.
_ISSUERS = "^(?:4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|6011|64[4-9]|65|35(?:2[89]|[3-8])|30[0-5]|3[68])"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Pseudonyms:
    """SQL expressions that give the pseudonym of a match, under one key."""

    def __init__(self, key: str = KEY):
        self.key = _quoted(key)

    @staticmethod
    def let(name: str, value: str, body: str) -> str:
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    def _network(self, kind: str, left: str, right: str, a: str, b: str) -> str:
        """Struct (l, r): the image of (left, right) in Z_a x Z_b."""
        prf = f"CAST(conv(substr(sha2(concat_ws('|', {self.key}, '{kind}', i, s.r), 256), 1, 13), 16, 10) AS BIGINT)"
        return f"aggregate(sequence(1, {ROUNDS}), named_struct('l', CAST({left} AS BIGINT), 'r', CAST({right} AS BIGINT)), (s, i) -> named_struct('l', s.r, 'r', pmod(s.l + {prf}, IF(i % 2 = 1, CAST({a} AS BIGINT), CAST({b} AS BIGINT)))))"

    def digits(self, kind: str, d: str) -> str:
        """A digit string (a lambda variable or column) of 2 to 30 places, permuted among those of its length."""
        a, b = f"((length({d}) + 1) DIV 2)", f"(length({d}) DIV 2)"
        power = "CAST(concat('1', repeat('0', {})) AS BIGINT)"
        net = self._network(kind, f"substr({d}, 1, {a})", f"substr({d}, {a} + 1)", power.format(a), power.format(b))
        return self.let("z", net, f"concat(lpad(CAST(z.l AS STRING), {a}, '0'), lpad(CAST(z.r AS STRING), {b}, '0'))")

    def letters(self, kind: str, t: str) -> str:
        """A string permuted among those with the same kinds of characters in the same places.

        Each round shifts the characters of one half, each within its own range, by a keyed function of the other half.
        """
        a = f"((length({t}) + 1) DIV 2)"
        code = "ascii(substr(s.l, CAST(j AS INT), 1))"
        shift = "CAST(conv(substr(h, CAST((j % 16) * 4 + 1 AS INT), 4), 16, 10) AS INT)"

        def within(base: int, size: int) -> str:
            code = f"{base} + pmod(c - {base} + {shift}, {size})"
            sign = f"chr({code})" if base < 256 else f"decode(unhex(lpad(hex({code}), 4, '0')), 'UTF-16BE')"
            return f"WHEN c BETWEEN {base} AND {base + size - 1} THEN {sign}"

        moved = f"CASE {within(48, 10)} {within(97, 26)} {within(65, 26)} WHEN c < 192 THEN substr(s.l, CAST(j AS INT), 1) {' '.join(within(*x) for x in _LETTERS)} ELSE substr(s.l, CAST(j AS INT), 1) END"
        moved = self.let("c", code, moved)
        half = f"IF(length(s.l) = 0, '', array_join(transform(sequence(1, greatest(1, length(s.l))), j -> {moved}), ''))"
        half = self.let("h", f"sha2(concat_ws('|', {self.key}, '{kind}', i, s.r), 256)", half)
        net = f"aggregate(sequence(1, {ROUNDS}), named_struct('l', substr({t}, 1, {a}), 'r', substr({t}, {a} + 1)), (s, i) -> named_struct('l', s.r, 'r', {half}))"
        return self.let("z", net, "concat(z.l, z.r)")

    @staticmethod
    def bare(m: str) -> str:
        return f"regexp_replace({m}, '[^0-9]', '')"

    @staticmethod
    def refilled(m: str, d: str) -> str:
        """`m` with its digits replaced, in order, by those of `d`."""
        at = f"length(regexp_replace(substr({m}, 1, CAST(k AS INT)), '[^0-9]', ''))"
        own = f"substr({m}, CAST(k AS INT), 1)"
        return f"array_join(transform(sequence(1, length({m})), k -> IF({own} RLIKE '[0-9]', substr({d}, {at}, 1), {own})), '')"

    @staticmethod
    def luhn_sum(d: str, last: int) -> str:
        """Sum of the digits of `d`, every second one doubled, counted so that the last place weighs `last` (1 or 2)."""
        digit = f"CAST(substr({d}, CAST(length({d}) + 1 - k AS INT), 1) AS INT)"
        doubled = f"IF({digit} > 4, 2 * {digit} - 9, 2 * {digit})"
        return f"aggregate(sequence(1, length({d})), 0, (t, k) -> t + IF(k % 2 = {1 if last == 2 else 0}, {doubled}, {digit}))"

    def card(self, m: str) -> str:
        """Keeps the first four digits, which name the issuer; the last one is the check digit."""
        middle = self.digits("card", "y")
        body = self.let("y", "substr(d, 5, length(d) - 5)", middle)
        checked = self.let("q", f"concat(substr(d, 1, 4), {body})", f"concat(q, CAST(pmod(10 - {self.luhn_sum('q', 2)} % 10, 10) AS STRING))")
        valid = f"length(d) BETWEEN 13 AND 19 AND d RLIKE '{_ISSUERS}' AND {self.luhn_sum('d', 1)} % 10 = 0"
        return self.let("d", self.bare(m), f"IF({valid}, {self.let('w', checked, self.refilled(m, 'w'))}, {m})")

    def ssn(self, m: str) -> str:
        """898 areas, 99 groups, 9999 serials."""
        area, group, serial = (f"CAST(substr({m}, {p}, {n}) AS INT)" for p, n in ((1, 3), (5, 2), (8, 4)))
        rank = f"(IF({area} > 666, {area} - 2, {area} - 1) * 99 + {group} - 1)"
        back = "(z.l DIV 99)"
        out = f"concat_ws('-', lpad(CAST(IF({back} >= 665, {back} + 2, {back} + 1) AS STRING), 3, '0'), lpad(CAST(z.l % 99 + 1 AS STRING), 2, '0'), lpad(CAST(z.r + 1 AS STRING), 4, '0'))"
        valid = f"{area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0"
        return f"IF({valid}, {self.let('z', self._network('ssn', rank, f'{serial} - 1', str(898 * 99), '9999'), out)}, {m})"

    def address(self, m: str) -> str:
        """IPv4: two halves of 16 bits."""
        part = [f"CAST(split_part({m}, '.', {k}) AS INT)" for k in (1, 2, 3, 4)]
        out = "concat_ws('.', z.l DIV 256, z.l % 256, z.r DIV 256, z.r % 256)"
        net = self._network("ipv4", f"{part[0]} * 256 + {part[1]}", f"{part[2]} * 256 + {part[3]}", "65536", "65536")
        return f"IF({' AND '.join(f'{p} < 256' for p in part)}, {self.let('z', net, out)}, {m})"

    def address_6(self, m: str) -> str:
        """IPv6, the halves of network and interface each by themselves, so that one network stays one; written in full, so that all spellings of an address agree."""
        left, right = f"split(substring_index({m}, '::', 1), ':')", f"IF(contains({m}, '::'), split(substring_index({m}, '::', -1), ':'), CAST(array() AS ARRAY<STRING>))"
        full = self.let("a", left, self.let("b", right, "IF(size(a) + size(b) BETWEEN 3 AND 8, concat(a, array_repeat('0', 8 - size(a) - size(b)), b), NULL)"))

        def number(k: int) -> str:
            return f"CAST(conv(concat(lpad(element_at(v, {k}), 4, '0'), lpad(element_at(v, {k + 1}), 4, '0')), 16, 10) AS BIGINT)"

        def half(k: int) -> str:
            net = self._network(f"ipv6-{k}", number(k), number(k + 2), "4294967296", "4294967296")
            return self.let("z", net, "concat_ws(':', " + ", ".join(f"lower(hex(z.{c} {op}))" for c in "lr" for op in ("DIV 65536", "% 65536")) + ")")

        return self.let("v", full, f"IF(v IS NULL, {m}, concat({half(1)}, ':', {half(5)}))")

    def date(self, m: str) -> str:
        """Days of 1900-01-01 to 2100-05-01; day first before month first where both can be."""

        def of(y: str, mo: str, d: str) -> str:
            good = f"{y} BETWEEN 1900 AND 2100 AND {mo} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31"
            day = f"datediff(date_add(make_date({y}, {mo}, 1), {d} - 1), DATE'1900-01-01')"
            return f"(CASE WHEN {good} THEN IF({d} <= day(last_day(make_date({y}, {mo}, 1))) AND {day} < {_DAYS[0] * _DAYS[1]}, {day}, NULL) END)"

        def moved(rank: str, layout: str) -> str:
            net = self._network("date", f"x DIV {_DAYS[1]}", f"x % {_DAYS[1]}", str(_DAYS[0]), str(_DAYS[1]))
            return self.let("x", rank, f"IF(x IS NULL, NULL, {self.let('z', net, self.let('o', f'date_add(DATE_FROM_UNIX_DATE(-25567), CAST(z.l * {_DAYS[1]} + z.r AS INT))', layout))})")

        p = [f"CAST(split_part(n, '/', {k}) AS INT)" for k in (1, 2, 3)]

        def padded(part: str, place: int) -> str:
            return f"IF(length(split_part(n, '/', {place})) = 2, lpad({part}, 2, '0'), {part})"

        sign = f"substr(regexp_extract({m}, '[/.]', 0), 1, 1)"
        day, month = "CAST(day(o) AS STRING)", "CAST(month(o) AS STRING)"
        day_first = f"concat({padded(day, 1)}, {sign}, {padded(month, 2)}, {sign}, year(o))"
        month_first = f"concat({padded(month, 1)}, {sign}, {padded(day, 2)}, {sign}, year(o))"
        iso = moved(of(p[0], p[1], p[2]), "date_format(o, 'yyyy-MM-dd')")
        other = f"coalesce({moved(of(p[2], p[1], p[0]), day_first)}, {moved(of(p[2], p[0], p[1]), month_first)})"
        return self.let("n", f"translate({m}, '-.', '//')", f"coalesce(IF({m} RLIKE '^[0-9]{{4}}-', {iso}, {other}), {m})")

    def iban(self, m: str) -> str:
        """The country stays, letters and digits of the account are permuted among themselves, the check digits are new."""

        def remainder(t: str) -> str:
            c = f"ascii(substr({t}, CAST(k AS INT), 1))"
            return f"aggregate(sequence(1, length({t})), 0, (r, k) -> IF({c} >= 65, (r * 100 + {c} - 55) % 97, (r * 10 + {c} - 48) % 97))"

        account = self.let("y", "substr(d, 5)", self.letters("iban", "y"))
        fresh = self.let("w", account, self.let("q", "concat(w, substr(d, 1, 2), '00')", f"concat(substr(d, 1, 2), lpad(CAST(98 - {remainder('q')} AS STRING), 2, '0'), w)"))
        at = f"length(replace(substr({m}, 1, CAST(k AS INT)), ' ', ''))"
        spaced = f"array_join(transform(sequence(1, length({m})), k -> IF(substr({m}, CAST(k AS INT), 1) = ' ', ' ', substr(g, {at}, 1))), '')"
        valid = self.let("u", "concat(substr(d, 5), substr(d, 1, 4))", f"{remainder('u')} = 1")
        return self.let("d", f"replace({m}, ' ', '')", f"IF(length(d) BETWEEN 15 AND 34 AND {valid}, {self.let('g', fresh, spaced)}, {m})")

    def email(self, m: str) -> str:
        """The name is permuted, the domain stays."""
        return f"concat({self.let('y', f'substring_index({m}, chr(64), 1)', self.letters('email', 'y'))}, '@', substring_index({m}, chr(64), -1))"

    def phone(self, m: str) -> str:
        """The country code stays; the other digits are permuted, whatever stands between them, and alike with the code +1 and without one."""
        code = f"CASE WHEN NOT startswith({m}, '+') THEN 0 WHEN d RLIKE '{_CODE_1}' THEN 1 WHEN d RLIKE '{_CODE_2}' THEN 2 ELSE 3 END"
        body = self.let("y", "substr(d, cc + 1)", f"IF(length(y) < 6, y, {self.digits('phone', 'y')})")
        return self.let("d", self.bare(m), self.let("cc", code, self.let("w", f"concat(substr(d, 1, cc), {body})", self.refilled(m, "w"))))

    def of(self, m: str) -> str:
        """The pseudonym of a match, or the match where it is not valid."""
        return (
            f"CASE WHEN contains({m}, '@') THEN {self.email(m)} WHEN contains({m}, ':') THEN {self.address_6(m)} WHEN {m} RLIKE '^[A-Z]' THEN {self.iban(m)} "
            f"WHEN {m} RLIKE '^[+(]|^[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}$' THEN {self.phone(m)} "
            f"WHEN {m} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN {self.ssn(m)} "
            f"WHEN {m} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$|^[0-9]{{1,2}}[/.][0-9]{{1,2}}[/.][0-9]{{4}}$' THEN {self.date(m)} "
            f"WHEN {m} RLIKE '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' THEN {self.address(m)} ELSE {self.card(m)} END"
        )


def session_key(spark: SparkSession) -> str:
    """The key set for the session; the example key, with a warning, where none is."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms under the example key can be undone by anyone", stacklevel=2)
    return key or KEY


def replaced(docs: DataFrame, key: str | None = None) -> DataFrame:
    """`docs` with `text` pseudonymized and a struct column `_pii` (text, n) beside it; rows without candidates are passed by."""
    name = Pseudonyms(key or session_key(docs.sparkSession))
    pattern = _quoted(PATTERN)
    found = f"regexp_extract_all(text, {pattern}, 0)"
    gaps = f"split(text, {pattern}, -1)"
    woven = "concat(element_at(g, 1), array_join(zip_with(p, slice(g, 2, greatest(0, size(g) - 1)), (a, b) -> concat(a, b)), ''))"
    changed = "CAST(size(filter(zip_with(f, p, (a, b) -> a <> b), x -> x)) AS BIGINT)"
    both = Pseudonyms.let("f", found, Pseudonyms.let("p", "transform(f, m -> " + name.of("m") + ")", Pseudonyms.let("g", gaps, f"named_struct('text', {woven}, 'n', {changed})")))
    plain = "named_struct('text', text, 'n', CAST(0 AS BIGINT))"
    return docs.withColumn("_pii", F.expr(f"CASE WHEN text RLIKE {pattern} THEN {both} ELSE {plain} END"))


def pseudonymize(docs: DataFrame, key: str | None = None) -> DataFrame:
    """Per row: doc_id, text with pseudonyms, n_replaced. Without `key`, that of the session (`KEY_SETTING`).

    A null text stays null and an empty one empty, with nothing replaced. Values
    that fail validation (a number with a wrong check digit, the 31st of June)
    stay as they are. Repeated rows give repeated rows, a null doc_id stays null,
    other columns are ignored, no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return replaced(rows, key).select("doc_id", F.col("_pii.text").alias("text"), F.col("_pii.n").alias("n_replaced"))


def with_pseudonyms(docs: DataFrame, key: str | None = None) -> DataFrame:
    """`docs` with all its columns, `text` pseudonymized, and `n_chars`, if there is one, following it.

    Null and empty texts stay as they are, with their `n_chars`; repeated rows stay
    repeated, columns of any name pass through, no rows give no rows.
    """
    rows = replaced(docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.col("text").cast("string").alias("text")), key)
    fresh = {"text": F.col("_pii.text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col("_pii.n") > 0, F.char_length("_pii.text")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
