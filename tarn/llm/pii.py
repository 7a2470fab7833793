"""Format-preserving Feistel pseudonyms for personal data in texts.

Candidates are found by patterns and validated by kind: card numbers (Luhn),
IBANs (ISO 7064 mod 97), social security numbers, IPv4 addresses (octets),
phone numbers, calendar dates of 1900 to 2099, e-mail addresses, and the values
of passwords and tokens.  A validated value is taken apart into symbols, each a
number below a radix of its own (a digit, a letter, an octet, a month ...), and
the symbols go through ``ROUNDS`` rounds of a Feistel network: in turn one half
is shifted, modulo the radices, by a keyed SHA-256 of the other half.  That is
a permutation within the format: the outcome is a valid value of the same
shape, check digits are made anew, separators stay, and equal values have equal
pseudonyms in all documents, whatever separators or order of a date's parts they
are written with.  Whoever holds the key can reverse it.

Kept as they are: a card's first digit, country codes, e-mail domains, whether
a year is a leap year, and whether a day is above 12 (or, with its month, above
28), since those decide what is valid.

All of it is SQL expressions over the row itself; texts without a digit, ``@``
or ``=`` are only looked at.

A run of numbers or upper-case words that is not valid as a whole is searched at
its separators: for IBANs, for cards in usual and then in any groups of three or
more digits (the last may be shorter), and for dates and phones between them.

Defined cases: null text stays null with no finds; candidates that fail their
validation stay; repeated rows get equal results; an empty table gives an empty
table; all other columns are kept, but columns of the input that are named like
a result (``n_pii``, ``pii_kinds``, in any case) give way to it.  Texts may be of
any length: repetitions in the patterns are of single characters, possessive or
bounded, so matching neither recurses nor is tried anew from within a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without
from .native import let, quoted

ROUNDS = 10

_SECRET_NAME = r"(?i:passw(?:or)?d|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?|(?:AKIA|ghp_|sk-)"

#: A run of words or numbers does not take the beginning of a date, address, number with points, e-mail or secret behind it.
_NOT_OF_NEXT = r"(?!(?<=[ -][0-9]{1,2})/[0-9])(?!(?<=[ -][0-9]{1,3})\.[0-9])(?!(?<= [0-9]{3,4})-[0-9])(?![A-Za-z0-9_.%+-]{0,64}+@)(?!(?<=PASSWORD|PASSWD|PWD|TOKEN|SECRET|KEY)[\"']?\s{0,2}[=:])"

#: Patterns of candidates, tried in this order at each place.
PATTERNS = [
    rf"(?<![A-Za-z0-9_])(?:{_SECRET_NAME})[A-Za-z0-9+/_=.-]{{6,}}+",
    r"(?<![A-Za-z0-9_.%+-])[A-Za-z0-9_.%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![A-Za-z0-9_.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9_]|\.[0-9])",
    r"(?<![A-Za-z0-9_-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![A-Za-z0-9_-])",
    r"(?<![A-Za-z0-9_/.])[0-9]{1,2}([/.])[0-9]{1,2}\1[0-9]{4}(?![A-Za-z0-9_/])",
    r"(?<![A-Za-z0-9_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_-])",
    rf"(?<![A-Za-z0-9_])[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2}}[A-Z0-9 ]*(?<! )(?![A-Za-z0-9_]){_NOT_OF_NEXT}",
    rf"(?<![A-Za-z0-9_+-])(?=(?:[0-9][ -]?){{12}}[0-9])[0-9][0-9 -]*(?<=[0-9])(?![A-Za-z0-9_-]){_NOT_OF_NEXT}",
    r"(?<![A-Za-z0-9_+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9_-])",
    r"(?<![A-Za-z0-9_+])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?![A-Za-z0-9_-])",
]
CANDIDATE = "|".join(PATTERNS)
#: What a run of numbers may hold besides cards: dates, social security numbers, phones.
WITHIN = "|".join([PATTERNS[3], PATTERNS[5], PATTERNS[8]])
#: Groups of numbers inside a longer run that may be a card, the usual ones first.
CARDS = [
    r"^[2-6](?:[0-9]{12,18}|[0-9]{3}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{3}([ -])[0-9]{6}\2[0-9]{4,5}|[0-9]{3}([ -])[0-9]{3}\3[0-9]{3}\3[0-9]{3})$",
    r"^(?:[0-9]{3,}[ -])*[0-9]+$",
]
#: Most groups of an IBAN (34 letters and digits by fours) or of such a card.
MOST_GROUPS = 9


def _like(text: str, pattern: str) -> str:
    return f"{text} rlike {quoted(pattern)}"


_DIGITS = "regexp_replace(m, '[^0-9]', '')"


def _luhn_sum(digits: str, first_doubled: int) -> str:
    """Luhn sum of a string of digits, counted from its right end; doubling starts at that place."""
    return f"aggregate(transform(reverse(split({digits}, '')), (d, i) -> IF(i % 2 = {first_doubled}, IF(2 * cast(d as int) > 9, 2 * cast(d as int) - 9, 2 * cast(d as int)), cast(d as int))), 0, (s, x) -> s + x)"


def _mod97(text: str) -> str:
    """Of letters and digits, letters read as 10 to 35."""
    return f"aggregate(split({text}, ''), 0, (s, c) -> IF(c between '0' AND '9', (s * 10 + cast(c as int)) % 97, (s * 100 + ascii(c) - 55) % 97))"


def _date_parts() -> str:
    """``struct(y, m, d, order)`` of a candidate date; order names how they stand."""
    p = "regexp_extract_all(m, '[0-9]+', 0)"
    part = lambda y, mo, d, order: f"named_struct('y', cast(p[{y}] as int), 'mo', cast(p[{mo}] as int), 'd', cast(p[{d}] as int), 'ord', '{order}')"
    return let("p", p, f"CASE WHEN length(p[0]) = 4 THEN {part(0, 1, 2, 'ymd')} WHEN contains(m, '/') AND cast(p[0] as int) <= 12 THEN {part(2, 0, 1, 'mdy')} ELSE {part(2, 1, 0, 'dmy')} END")


def kind_sql() -> str:
    """The kind of a candidate ``m``, or null if it is not valid."""
    date = let("t", _date_parts(), "t.y between 1900 AND 2099 AND t.mo between 1 AND 12 AND t.d >= 1 AND IF(t.mo between 1 AND 12 AND t.y between 1900 AND 2099, t.d <= day(last_day(make_date(t.y, t.mo, 1))), false)")
    return f"""CASE
        WHEN {_like("m", f"^(?:{_SECRET_NAME})")} THEN 'secret'
        WHEN contains(m, '@') THEN 'email'
        WHEN {_like("m", r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$")} THEN IF(forall(split(m, '[.]'), o -> cast(o as int) <= 255), 'ip', NULL)
        WHEN {_like("m", "^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4})$")} THEN IF({date}, 'date', NULL)
        WHEN {_like("m", "^[0-9]{3}-[0-9]{2}-[0-9]{4}$")} THEN IF({_like("m", "^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")}, 'ssn', NULL)
        WHEN {_like("m", "^[A-Z]{2}[0-9]{2}")} THEN IF({_mod97("concat(substring(replace(m, ' ', ''), 5), substring(m, 1, 4))")} = 1, 'iban', NULL)
        WHEN {_like("m", r"^(?:\+|.*[().]|1?[ .-]?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$)")} AND length({_DIGITS}) between 7 AND 15 THEN 'phone'
        WHEN length({_DIGITS}) between 13 AND 19 THEN IF({_luhn_sum(_DIGITS, 1)} % 10 = 0, 'card', NULL)
        END"""


def _symbol(pre: str, k: int, radix: str, value: str, a: str = "0", b: str = "0") -> str:
    return f"named_struct('pre', {pre}, 'k', {k}, 'r', cast({radix} as int), 'v', cast({value} as int), 'a', cast({a} as int), 'b', cast({b} as int))"


def symbols_sql() -> str:
    """The symbols of a valid candidate ``m`` of kind ``kind``.

    ``pre`` stands before the symbol; ``k`` says how value ``v`` (below radix
    ``r``) is written: 0 as the character ``a + v``, 1 as a hexadecimal digit,
    2 as the number ``a + v`` in ``b`` places, 3 and 4 as a leap and a common
    year, 5 as an area of a social security number, -1 not at all.  Symbols with
    a radix above 1 come first.
    """
    digit = _symbol("pre", 0, "10", "ascii(c) - 48", "48")
    split_digit = f"CASE WHEN c between '0' AND '1' THEN {_symbol('pre', 0, '2', 'ascii(c) - 48', '48')} ELSE {_symbol('pre', 0, '8', 'ascii(c) - 50', '50')} END"
    lower = _symbol("pre", 0, "26", "ascii(c) - 97", "97")
    upper = _symbol("pre", 0, "26", "ascii(c) - 65", "65")
    hexed = _symbol("pre", 1, "16", "instr('0123456789abcdef', c) - 1")
    any_char = f"CASE WHEN c between '0' AND '9' THEN {digit} WHEN c between 'a' AND 'z' THEN {lower} ELSE {upper} END"

    def from_to(lo: str, hi: str, moving: str, inner: str) -> str:
        """A symbol for each ``moving`` character from ``lo`` to ``hi``, with what stands before it, and one for the rest."""
        body = "substring(m, lo + 1, hi - lo)"
        each = f"transform(regexp_extract_all({body}, '{moving}', 0), (c, i) -> {let('pre', "IF(i = 0, concat(substring(m, 1, lo), gaps[i]), gaps[i])", inner)})"
        last = _symbol("IF(size(gaps) = 1, m, concat(element_at(gaps, -1), substring(m, hi + 1)))", -1, "1", "0")
        return let("lo", lo, let("hi", hi, let("gaps", f"split({body}, '{moving}', -1)", f"concat({each}, array({last}))")))

    letters = "[0-9A-Za-z]"
    name = f"length(regexp_extract(m, {quoted(f'^(?:{_SECRET_NAME})')}, 0))"
    secret = f"IF({_like(f'substring(m, {name} + 1)', '^[0-9a-f]+$')}, {from_to(name, 'length(m)', '[0-9a-f]', hexed)}, {from_to(name, 'length(m)', letters, any_char)})"
    phone_start = "IF(startswith(m, '+'), length(regexp_extract(m, '^[+](?:1|[0-9]{1,3}(?=[^0-9])|[0-9]{2})', 0)), IF(m rlike '^1[ .-]', 1, 0))"
    phone = from_to(phone_start, "length(m)", "[0-9]", split_digit)
    card = from_to("1", "length(m) - 1", "[0-9]", digit)
    ip = f"transform(split(m, '[.]'), (o, i) -> {_symbol("IF(i = 0, '', '.')", 2, '256', 'o', '0', '1')})"
    parts = "split(m, '-')"
    ssn = f"array({_symbol("''", 5, '898', f'{parts}[0] - IF({parts}[0] > 666, 2, 1)')}, {_symbol(quoted('-'), 2, '99', f'{parts}[1] - 1', '1', '2')}, {_symbol(quoted('-'), 2, '9999', f'{parts}[2] - 1', '1', '4')})"
    leap = "(t.y % 4 = 0 AND t.y <> 1900)"
    year = lambda pre: f"IF({leap}, {_symbol(pre, 3, '49', '(t.y - 1904) div 4')}, {_symbol(pre, 4, '151', 'IF(t.y = 1900, 0, 1 + ((t.y - 1901) div 4) * 3 + (t.y - 1901) % 4)')})"
    place = lambda part: f"CASE t.ord WHEN 'ymd' THEN {1 + part} WHEN 'mdy' THEN {part} ELSE {1 - part} END"
    month = _symbol("mark", 2, "IF(t.d > 28, 1, 12)", "IF(t.d > 28, 0, t.mo - 1)", "IF(t.d > 28, t.mo, 1)", f"length(p[{place(0)}])")
    day = _symbol("mark", 2, "CASE WHEN t.d > 28 THEN 1 WHEN t.d > 12 THEN 16 ELSE 12 END", "CASE WHEN t.d > 28 THEN 0 WHEN t.d > 12 THEN t.d - 13 ELSE t.d - 1 END", "CASE WHEN t.d > 28 THEN t.d WHEN t.d > 12 THEN 13 ELSE 1 END", f"length(p[{place(1)}])")
    parts_of = "regexp_extract_all(m, '[0-9]+', 0)"
    date = let("t", _date_parts(), let("p", parts_of, let("mark", "regexp_extract(m, '[-/.]', 0)", f"array({year(quoted(''))}, {month}, {day})")))
    return f"""CASE kind
        WHEN 'secret' THEN {secret}
        WHEN 'email' THEN {from_to("0", "instr(m, '@') - 1", letters, any_char)}
        WHEN 'ip' THEN {ip}
        WHEN 'date' THEN {date}
        WHEN 'ssn' THEN {ssn}
        WHEN 'iban' THEN {from_to("4", "length(m)", letters, any_char)}
        WHEN 'phone' THEN {phone}
        ELSE {card} END"""


def feistel_sql(values: str, radices: str, tweak: str, key: str) -> str:
    """``values``, each below its radix, permuted under the key."""
    moved = "((j < size(vs) div 2) = (t % 2 = 0))"
    other = f"array_join(transform(vs, (v, j) -> IF({moved}, '', cast(v as string))), ',')"
    keyed = f"sha2(concat_ws('|', {quoted(key)}, {tweak}, array_join({radices}, ','), t, {other}), 256)"
    step = let("h", keyed, f"transform(vs, (v, j) -> IF({moved}, cast(pmod(v + pmod(xxhash64(h, j), {radices}[j]), {radices}[j]) as int), v))")
    return f"aggregate(sequence(0, {ROUNDS - 1}), {values}, (vs, t) -> {step})"


def pseudonym_sql(key: str) -> str:
    """``struct(kind, out)`` of a candidate ``m``; a null kind leaves it as it is."""
    common = "IF(x = 0, 1900, 1901 + ((x - 1) div 3) * 4 + (x - 1) % 3)"
    number = "IF(s.b <= 1, cast(s.a + x as string), lpad(cast(s.a + x as string), s.b, '0'))"
    written = f"CASE s.k WHEN 0 THEN char(s.a + x) WHEN 1 THEN substring('0123456789abcdef', x + 1, 1) WHEN 2 THEN {number} WHEN 3 THEN cast(1904 + 4 * x as string) WHEN 4 THEN cast({common} as string) WHEN 5 THEN lpad(cast(x + IF(x < 665, 1, 2) as string), 3, '0') ELSE '' END"
    one = let("x", "IF(s.r > 1, vals[i], s.v)", written)
    rendered = f"array_join(transform(syms, (s, i) -> concat(s.pre, {one})), '')"
    body = let("n", _DIGITS.replace("(m,", "(made,"), f"cast((10 - {_luhn_sum('substring(n, 1, length(n) - 1)', 0)} % 10) % 10 as string)")
    card = f"concat(substring(made, 1, length(made) - 1), {body})"
    check = _mod97("concat(substring(replace(made, ' ', ''), 5), substring(made, 1, 2), '00')")
    iban = f"concat(substring(made, 1, 2), lpad(cast(98 - {check} as string), 2, '0'), substring(made, 5))"
    # year, month and day go through the rounds in that order and are put back as they stood
    ordered = let("w", "regexp_extract_all(made, '[0-9]+', 0)", "CASE WHEN m rlike '^[0-9]{4}' THEN made WHEN contains(m, '/') AND cast(regexp_extract(m, '^[0-9]+', 0) as int) <= 12 THEN concat(w[1], '/', w[2], '/', w[0]) ELSE concat_ws(regexp_extract(m, '[/.]', 0), w[2], w[1], w[0]) END")
    fixed = let("made", rendered, f"CASE kind WHEN 'card' THEN {card} WHEN 'iban' THEN {iban} WHEN 'date' THEN {ordered} ELSE made END")
    active = "filter(syms, s -> s.r > 1)"
    permuted = let("rs", f"transform({active}, s -> s.r)", feistel_sql(f"transform({active}, s -> s.v)", "rs", "kind", key))
    whole = let("syms", symbols_sql(), let("vals", permuted, fixed))
    return let("kind", kind_sql(), f"named_struct('kind', kind, 'out', IF(kind IS NULL, m, {whole}))")


def _parted(text: str, unit: str, valid: str) -> str:
    """``text`` as ``array<struct(t, f)>``: what is ``valid`` (of ``g``, units with single separators between) is marked ``f``.

    Of what begins at one place the longest counts, of what overlaps the first.
    """
    # (a slice would copy all of u)
    joined = "IF({1} > {0}, array_join(transform(sequence({0}, {1} - 1), z -> u[z]), ''), '')"
    some = f"filter(sequence(i + 1, least(size(u), i + {MOST_GROUPS})), j -> {let('g', f"regexp_replace({joined.format('i', 'j')}, '[ -]+$', '')", valid)})"
    best = f"filter(transform(sequence(0, size(u) - 1), i -> named_struct('i', i, 'j', coalesce(array_max({some}), 0))), b -> b.j > 0)"
    # chosen in order, gathered by 256 so that nothing long is copied for each
    pairs = "array<struct<i: int, j: int>>"
    start = f"named_struct('done', cast(array() as array<{pairs}>), 'own', cast(array() as {pairs}), 'upto', 0)"
    moved = "IF(size(a.own) < 256, named_struct('done', a.done, 'own', concat(a.own, array(b)), 'upto', b.j), named_struct('done', concat(a.done, array(a.own)), 'own', array(b), 'upto', b.j))"
    picked = f"aggregate({best}, {start}, (a, b) -> IF(b.i < a.upto, a, {moved}), a -> flatten(concat(a.done, array(a.own))))"
    part = lambda t, f: f"named_struct('t', {t}, 'f', {f})"
    plain = let("lo", "IF(k = 0, 0, coalesce(get(p, k - 1).j, 0))", let("hi", "IF(k < size(p), get(p, k).i, size(u))", joined.format("lo", "hi")))
    held = joined.format("get(p, k).i", "get(p, k).j")
    found = let("h", held, f"array({part("regexp_replace(h, '[ -]+$', '')", 'true')}, {part("regexp_extract(h, '[ -]*$', 0)", 'false')})")
    none = f"array({part(text, 'false')})"
    parts = f"flatten(transform(sequence(0, size(p)), k -> concat(array({part(plain, 'false')}), IF(k < size(p), {found}, cast(array() as array<struct<t: string, f: boolean>>)))))"
    return let("u", f"regexp_extract_all({text}, {quoted(unit)}, 0)", f"IF(size(u) = 0, {none}, {let('p', picked, f'IF(size(p) = 0, {none}, {parts})')})")


def parts_sql() -> str:
    """A candidate ``m`` as ``array<struct(t, f)>``; parts marked ``f`` are candidates of their own."""
    whole = "array(named_struct('t', m, 'f', true))"
    iban = f"g rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9 ]+$' AND length(replace(g, ' ', '')) between 15 AND 34 AND {_mod97("concat(substring(replace(g, ' ', ''), 5), substring(g, 1, 4))")} = 1"
    digits = _DIGITS.replace("(m,", "(g,")
    card = lambda groups: f"{_like('g', groups)} AND length({digits}) between 13 AND 19 AND {_luhn_sum(digits, 1)} % 10 = 0"

    def then(parts: str, split: str) -> str:
        return f"flatten(transform({parts}, q -> IF(q.f OR q.t = '', array(q), {split})))"

    parts = f"IF(m rlike '^[A-Z]', {_parted('m', '[A-Z0-9]+ *', iban)}, array(named_struct('t', m, 'f', false)))"
    for groups in CARDS:
        parts = then(parts, _parted("q.t", "[ -]*[A-Z0-9]+[ -]*", card(groups)))
    rest = f"flatten(zip_with(split(q.t, {quoted(f'(?:{WITHIN})')}, -1), regexp_extract_all(q.t, {quoted(f'(?:{WITHIN})')}, 0), (a, b) -> array(named_struct('t', coalesce(a, ''), 'f', false), named_struct('t', coalesce(b, ''), 'f', b IS NOT NULL))))"
    run = _like("m", "^(?:[A-Z]{2}[0-9]{2}[A-Z0-9 ]+|[0-9][0-9 -]*)$") + f" AND length(m) > 12 AND ({kind_sql()}) IS NULL"
    return f"IF({run}, {then(parts, rest)}, {whole})"


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``, and ``n_pii`` and ``pii_kinds`` behind its columns.

    No shuffle; a row is worked off where it is read.
    """
    docs = without(docs, ["n_pii", "pii_kinds"], text_col)
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = f"c{columns.index(text_col)}"
    candidates = F.when(F.col(at).rlike("[0-9@=]"), F.regexp_extract_all(F.col(at), F.lit(f"(?:{CANDIDATE})"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = plain.withColumn("finds", candidates).withColumn("finds", F.expr(f"IF(size(finds) > 0, transform(finds, m -> {parts_sql()}), NULL)"))
    made = f"transform(ps, q -> IF(q.f, {let('m', 'q.t', pseudonym_sql(key))}, named_struct('kind', cast(NULL as string), 'out', q.t)))"
    found = found.withColumn("finds", F.expr(f"IF(finds IS NULL, NULL, transform(finds, ps -> {made}))"))
    pieces = f"split({at}, {quoted(f'(?:{CANDIDATE})')}, -1)"
    # pieces and finds alternate, a piece first and last
    joined = f"IF(finds IS NULL, {at}, array_join(zip_with({pieces}, finds, (p, f) -> concat(p, coalesce(array_join(transform(f, x -> x.out), ''), ''))), ''))"
    valid = "filter(flatten(coalesce(finds, array())), f -> f.kind IS NOT NULL)"
    out = [F.expr(joined).alias(c) if c == at else F.col(c) for c in plain.columns]
    counted = F.expr(f"cast(size({valid}) as bigint)").alias("n_pii"), F.expr(f"array_join(array_sort(array_distinct(transform({valid}, f -> f.kind))), ',')").alias("pii_kinds")
    return found.select(*out, *counted).toDF(*columns, "n_pii", "pii_kinds")
