"""Scalar functions over Columns: sizes, times, names, identifiers, bits."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB, MIB = 1 << 10, 1 << 20
SECTOR = 32 * KIB
PIB, EIB = 1 << 50, 1 << 60
#: Size units, fixed values: lower case in powers of 1000, upper case of 1024; b and c bytes, s sectors, u and w discs of either kind.
UNITS = {
    "b": 1, "c": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12, "p": 10**15, "e": 10**18,
    "K": KIB, "M": MIB, "G": KIB**3, "T": KIB**4, "P": PIB, "E": EIB,
    "s": SECTOR, "S": SECTOR, "u": 1459978240, "U": 1459978240, "w": 143432 * SECTOR, "W": 143432 * SECTOR,
}
#: Date formats in the order tried, fixed values.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HHmmss", "yyyy-MM-dd HHmm", "yyyy-MM-dd HH", "yyyy-MM-dd",
    "yyyyMMdd HHmmss", "yyyyMMdd HHmm", "yyyyMMdd HH", "yyyyMMdd",
)
TIME_FORMATS = {"date": "yyyy-MM-dd", "minute": "yyyy-MM-dd HH:mm", "second": "yyyy-MM-dd HH:mm:ss"}
#: Region codes, fixed values: name and four letters.
REGIONS = {
    "A": ("All", "ALL"), "B": ("-?-", "-?-"), "C": ("Chinese", "CHIN"), "D": ("German", "GERM"), "E": ("NTSC/USA", "USA"), "F": ("French", "FREN"),
    "G": ("-?-", "-?-"), "H": ("Netherlands", "NL"), "I": ("Italian", "ITAL"), "J": ("Japan", "JAPA"), "K": ("Korea", "KORE"), "L": ("Japan->PAL", "J>PL"),
    "M": ("America->PAL", "A>PL"), "N": ("Japan->NTSC", "J>US"), "O": ("-?-", "-?-"), "P": ("PAL", "PAL"), "Q": ("Korea (japanese)", "KO/J"), "R": ("Russia", "RUS"),
    "S": ("Spanish", "SPAN"), "T": ("Korea (english)", "KO/E"), "U": ("Australia", "AUS"), "V": ("Scandinavian", "SCAN"), "W": ("Taiwan", "TAIW"), "X": ("Almost Europe", "EURO"),
    "Y": ("Almost Europe", "EURO"), "Z": ("PAL or US", "ANY"),
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is computed once a row, however often then has it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def half_up(value: Column, unit: int) -> Column:
    """value in units, rounded half up, in whole numbers."""
    return F.floor((value + unit // 2) / unit).cast("long")


def parse_size(text: Column, first: int = 1, later: int = 1) -> Column:
    """Bytes of a text of terms `number[/number][unit]` joined by + or -, cut to a whole number; null if negative or not such a text.

    first and later are the factors of terms without a unit. A sign at the end adds, or takes off, later.
    """
    number = r"[0-9]+(?:\.[0-9]*)?|\.[0-9]+"
    term = rf"(?:{number})(?:/(?:{number}))?[{''.join(UNITS)}]?"
    fits = text.rlike(rf"^{term}(?:\s*[+-]\s*{term})*(?:\s*[+-])?\s*$")
    terms = F.regexp_extract_all(text, F.lit(rf"(?:^|[+-])\s*(?:{term})|[+-]\s*$"), F.lit(0))
    unit = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, float(v))])

    def amount(term: Column, pattern: str, group: int) -> Column:
        text = F.regexp_extract(term, pattern, group)
        return _once(text, lambda x: F.when(x != "", x.try_cast("double")))  # a failed cast is dear

    def value(term: Column, at: Column) -> Column:
        factor = F.coalesce(F.try_element_at(unit, F.substring(term, -1, 1)), F.when(at == 0, float(first)).otherwise(float(later)))
        share = _once(F.when(term.contains("/"), amount(term, rf"/({number})", 1)), lambda x: F.when(x > 0, x).otherwise(1.0))
        return F.coalesce(amount(term, number, 0) / share, F.lit(1.0)) * factor * F.when(term.startswith("-"), -1.0).otherwise(1.0)

    whole = lambda total: F.when(total >= 0, F.floor(total).cast("long"))
    return F.when(fits, F.aggregate(F.transform(terms, value), F.lit(0.0), lambda a, x: a + x, whole))


def print_size(size: Column, base: int = 1024) -> Column:
    """A size in units of base 1024 or 1000: bytes while under 10 of the next unit, then the least unit with at most four digits.

    A multiple of the base is given in the next unit. Giga and peta are used for what rounds to under 10, or over 9999, of the next and last.
    """
    names = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB") if base == 1024 else ("B", "kB", "MB", "GB", "TB", "PB", "EB")
    units = lambda value, unit: F.call_function("div", value, F.lit(unit))
    whole = lambda value, unit: units(value, unit) + (value % unit >= unit // 2).cast("long")
    rounds_under = lambda value, n, unit: value < n * unit - unit // 2
    down = units(size, base**2)  # larger sizes are rounded from whole megas

    def text(n: Column, u: int) -> Column:
        same = F.concat(n.cast("string"), F.lit(f" {names[u]}"))
        return F.when((n > 0) & (n % base == 0), F.concat(units(n, base).cast("string"), F.lit(f" {names[u + 1]}"))).otherwise(same) if u < 6 else same

    return (
        F.when(rounds_under(size, 10, base), text(size, 0))
        .when(rounds_under(size, 10_000, base), text(whole(size, base), 1))
        .when(rounds_under(size, 10_000, base**2), text(whole(size, base**2), 2))
        .when(rounds_under(down, 10, base**2), text(whole(down, base), 3))
        .when(rounds_under(down, 10_000, base**2), text(whole(down, base**2), 4))
        .when(rounds_under(down, 10_000, base**3), text(whole(down, base**3), 5))
        .otherwise(text(whole(down, base**4), 6))
    )


def parse_time(text: Column) -> Column:
    """The first of DATE_FORMATS that fits, else seconds since 1970, else null; blanks at the end don't count."""

    def read(text: Column, shape: Column) -> Column:
        tried = {f: F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS}
        date = F.when(text.rlike("^[+-]"), F.coalesce(*tried.values()))  # years with a sign have any length
        for f, time in tried.items():  # a failed try is dear, so others are read by the format that looks like them
            date = date.when(shape == re.sub("[A-Za-z]", "0", f), time)
        return F.coalesce(date, F.when(text.rlike("^[0-9]{1,15}$"), F.timestamp_seconds(text.try_cast("long"))))

    return _once(F.regexp_replace(text, r"[ \t]+$", ""), lambda text: _once(F.translate(text, "123456789", "0" * 9), lambda shape: read(text, shape)))


def print_time(time: Column, precision: str = "second") -> Column:
    """A time by precision; dashes for an unknown one."""
    dashes = "".join(c if c in " :-" else "-" for c in TIME_FORMATS[precision])
    return F.coalesce(F.date_format(time, TIME_FORMATS[precision]), F.lit(dashes))


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    """%x replaced by fields['x']; %a-bx takes characters a to b, %ux upper and %lx lower case; %% is a percent sign."""
    parts, last = [], 0
    for m in re.finditer(r"%(?:(\d+)-(\d+))?([ul]?)([a-z%])", template):
        parts.append(F.lit(template[last : m.start()]))
        last = m.end()
        value = F.lit("%") if m[4] == "%" else fields[m[4]]
        if m[1]:
            value = F.substring(value, int(m[1]), int(m[2]) - int(m[1]) + 1)
        parts.append({"u": F.upper, "l": F.lower}.get(m[3], lambda x: x)(value))
    return F.concat(*parts, F.lit(template[last:]))


def clean_name(name: Column, slash: bool = False) -> Column:
    """A file name: a colon becomes a dash between single spaces, each run of characters that names don't hold one space, none at the start."""
    kept = r"A-Za-z0-9\x{80}-\x{10FFFF}_+\-=%'\"$&,.!()\[\]{}<>" + "/" * slash
    plain = F.ltrim(F.regexp_replace(name, rf"[^{kept}:]+", " "))
    dashed = F.regexp_replace(F.regexp_replace(plain, r" *: *", " - "), r"  +", " ")
    return F.regexp_replace(F.regexp_replace(dashed, r"^ +", ""), r" $", "")


def find_id(text: Column) -> Column:
    """An identifier in a text: of 4 characters if it is all of the text, of 6 if it is that or stands before `=`, else the last `[ID]` of 6, else a first word of 6; or null."""
    one = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.coalesce(one(r"^\s*([A-Z0-9_]{4})\s*$"), one(r"^\s*([A-Z0-9_]{6})\s*(?:=|$)"), one(r"(?s)^.*\[([A-Z0-9_]{6})\]"), one(r"^\s*([A-Z0-9_]{6})(?![A-Z0-9_])"))


def patch_id(ident: Column, patch: str) -> Column:
    """ident with the characters of patch put in; its dots keep the old ones."""
    return F.concat(*[F.substring(ident, i + 1, 1) if c == "." else F.lit(c.upper()) for i, c in enumerate(patch)], F.substring(ident, len(patch) + 1, ID_REST))


ID_REST = 1 << 20


def region(ident: Column, at: int = 4, short: bool = False) -> Column:
    """Region by the character at a place, in either case: its name, or its four letters; unknown ones share a name."""
    table = F.create_map(*[F.lit(x) for code, names in REGIONS.items() for x in (code, names[short])])
    return F.coalesce(F.try_element_at(table, F.upper(F.substring(ident, at, 1))), F.lit("-?-"))


def align_up(value: Column, unit: int) -> Column:
    return (F.ceil(value / unit) * unit).cast("long")


def low_bit(value: Column) -> Column:
    """The lowest set bit: what a set of offsets or-ed together is aligned to."""
    return value.bitwiseAND(-value)


def version_pair(value: Column) -> Column:
    """A 64-bit version as HIGH:LOW in 32-bit halves."""
    return F.concat_ws(":", F.shiftright(value, 32).cast("string"), value.bitwiseAND(F.lit(0xFFFFFFFF)).cast("string"))


def parse_version(text: Column) -> Column:
    """A 64-bit version from `HIGH:LOW`, `HIGH-LOW` or `LOW` alone, whose high half is 1; numbers decimal or 0x; null for others."""
    part = lambda g: F.regexp_extract(text, r"^\s*(0[xX][0-9a-fA-F]{1,8}|[0-9]{1,10})(?:[:-](0[xX][0-9a-fA-F]{1,8}|[0-9]{1,10}))?$", g)
    number = lambda t: F.when(F.lower(t).startswith("0x"), F.conv(F.substring(t, 3, 8), 16, 10)).otherwise(t).try_cast("long")
    single = part(2) == ""
    high, low = F.when(single, F.lit(1).cast("long")).otherwise(number(part(1))), number(F.when(single, part(1)).otherwise(part(2)))
    return F.when((part(1) != "") & (high < 1 << 31) & (low < 1 << 32), F.shiftleft(high, 32) + low)


def hex_id(text: Column) -> Column:
    """The four characters that the last eight hex digits spell, or the text if it is short."""
    return F.when(F.length(text) <= 6, F.upper(text)).otherwise(F.decode(F.unhex(F.substring(text, -8, 8)), "UTF-8"))


def is_id(text: Column, lengths: Sequence[int] = (4, 6)) -> Column:
    """Whether a text is an identifier: capitals, digits and underscores, one of these many."""
    return text.rlike("^(" + "|".join(f"[A-Z0-9_]{{{n}}}" for n in lengths) + ")$")


def big_endian(data: Column, at: int, width: int) -> Column:
    """An unsigned big-endian number of up to 7 bytes in binary data, from offset at."""
    return F.conv(F.hex(F.substring(data, at + 1, width)), 16, 10).cast("long")


def little_endian(data: Column, at: int, width: int) -> Column:
    """As big_endian, with the lowest byte first."""
    bytes_ = [F.conv(F.hex(F.substring(data, at + i + 1, 1)), 16, 10).cast("long") for i in range(width)]
    return sum((F.shiftleft(b, 8 * i) for i, b in enumerate(bytes_) if i), bytes_[0])


def _components(path: Column, plain) -> Column:
    """Path components in turn, each as plain has it, then as it is."""
    return F.transform(F.regexp_extract_all(path, F.lit("[^/]*/|[^/]+"), F.lit(0)), lambda c: F.struct(plain(c).alias("a"), c.alias("b")))


def path_key(path: Column) -> Column:
    """Sort key: path components in turn, each without regard to case first; a folder's files before the file of its name."""
    ends = lambda c: F.when(c.endswith("/"), F.translate(c, "/" + UPPER, "\x01" + LOWER)).otherwise(F.concat(F.translate(c, UPPER, LOWER), F.lit("\x02")))
    return _components(path, ends)


def upper_path_key(path: Column) -> Column:
    """The other collation: full stops next to slashes before all else, letters in capitals, a name before what is longer."""
    return _components(path, lambda c: F.translate(c, "/." + LOWER, "\x01\x02" + UPPER))


def status_text(bits: Column, names: Sequence[str]) -> Column:
    """Names of the set bits, joined by a bar."""
    return F.concat_ws("|", *[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)])


#: Names of the first partition types, fixed values.
PART_NAMES = ("DATA", "UPDATE", "CHANNEL")


def part_name(kind: Column) -> Column:
    """A partition type's name; of others the four letters or digits that its 32 bits spell, else the number in hex."""
    spelled = F.lpad(F.hex(kind), 8, "0")
    text = F.when(spelled.rlike("^((3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A])){4}$"), F.decode(F.unhex(spelled), "US-ASCII"))
    return F.when(kind < len(PART_NAMES), F.get(F.array(*map(F.lit, PART_NAMES)), kind.cast("int"))).otherwise(F.coalesce(text, F.lower(F.hex(kind))))


def keyword(text: Column, names: Sequence[str]) -> Column:
    """The one of names that a text is, or abbreviates alone, in either case; null if there is none or are several."""
    low = F.lower(text)
    exact = F.coalesce(*[F.when(low == n.lower(), n) for n in names])
    fits = F.array_compact(F.array(*[F.when((low != "") & F.startswith(F.lit(n.lower()), low), n) for n in names]))
    return F.coalesce(exact, F.when(F.size(fits) == 1, F.get(fits, F.lit(0))))
