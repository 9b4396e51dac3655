"""Text functions as column expressions."""

from __future__ import annotations

from ipaddress import ip_address

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ACCENTED = {
    "A": "ÀÁÂÃÄÅ", "a": "àáâãäå", "C": "ÇČ", "c": "çč", "D": "Ď", "d": "ď", "E": "ÈÉÊËĚ", "e": "èéêëě", "I": "ÌÍÎÏ", "i": "ìíîï",
    "L": "Ľ", "l": "ľ", "N": "ŇÑ", "n": "ňñ", "O": "ÒÓÔÕÖØ", "o": "òóôõöø", "R": "Ř", "r": "ř", "S": "Š", "s": "š", "T": "Ť", "t": "ť",
    "U": "ÙÚÛÜŮ", "u": "ùúûüů", "Y": "Ý", "y": "ýÿ", "Z": "Ž", "z": "ž",
}
PLAIN_FROM = "".join(_ACCENTED.values())
PLAIN_TO = "".join(k * len(v) for k, v in _ACCENTED.items())
PAIRS = {"Æ": "AE", "æ": "ae", "Þ": "TH", "þ": "th", "Ð": "TH", "ð": "th", "ß": "ss"}
#: A word of letters and digits, or one other printing character.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[\p{P}\p{S}]"
WORD_PATTERN = r"[\p{L}\p{N}]+"


#: What a broadcast side may have in bytes, by its strings' lengths and 64 a row.
BROADCAST_BYTES = 64 << 20


def fits_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    text = [F.octet_length(F.col(f"`{c}`")) for c, kind in df.dtypes if kind == "string"]
    size = F.lit(64) + sum((F.coalesce(x, F.lit(0)) for x in text), F.lit(0))
    return (df.agg(F.sum(size)).first()[0] or 0) <= most


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, broadcast if its measured size is at most `most` bytes; else the join shuffles."""
    return F.broadcast(df) if fits_broadcast(df, most) else df


def unaccent(text: Column) -> Column:
    out = F.translate(text, PLAIN_FROM, PLAIN_TO)
    for a, b in PAIRS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def is_accented(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def tokens(text: Column) -> Column:
    """Forms by pattern alone; operators.tokenizer has the full state machine."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def full_match(text: Column, pattern: str) -> Column:
    return text.rlike(f"\\A(?:{pattern})\\z")


def parse_label(text: Column) -> Column:
    """An identifier at the start of the text, or null."""
    found = F.regexp_extract(F.trim(text), r"^([A-Za-z_][A-Za-z0-9_]*)", 1)
    return F.when(found != "", found)


def parse_long(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), r"^([+-]?[0-9]+)", 1).try_cast("long")


def ip_to_long(ip: Column) -> Column:
    """IPv4 as a number; null for anything else."""
    part = [F.regexp_extract(ip, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k).try_cast("long") for k in range(1, 5)]
    return F.when((part[0] < 256) & (part[1] < 256) & (part[2] < 256) & (part[3] < 256), ((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3])


def ip_in_prefix(ip: Column, network: str, bits: int) -> Column:
    """Whether an IPv4 lies in network/bits."""
    a, b, c, d = (int(x) for x in network.split("."))
    base = ((a * 256 + b) * 256 + c) * 256 + d
    return F.shiftright(ip_to_long(ip), 32 - bits) == F.lit(base >> (32 - bits))


def ip6_digits(ip: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address; null for anything else."""
    low = F.lower(ip)
    some = lambda x: F.filter(F.split(x, ":"), lambda p: p != "")
    head, tail = some(F.substring_index(low, "::", 1)), some(F.substring_index(low, "::", -1))
    gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(head) - F.size(tail)))
    parts = F.when(low.contains("::"), F.concat(head, gap, tail)).otherwise(F.split(low, ":", -1))
    ok = (F.size(parts) == 8) & F.forall(parts, lambda p: p.rlike("^[0-9a-f]{1,4}$")) & ~low.rlike("::.*::|:::|^:[^:]|[^:]:$")
    return F.when(ok, F.array_join(F.transform(parts, lambda p: F.lpad(p, 4, "0")), ""))


def ip6_in_prefix(ip: Column, network: str, bits: int) -> Column:
    """Whether an IPv6 lies in network/bits."""
    base, n, rest = f"{int(ip_address(network)):032x}", bits // 4, bits % 4
    digits = ip6_digits(ip)
    same = F.substring(digits, 1, n) == F.lit(base[:n])
    if rest:
        same = same & (F.shiftright(F.conv(F.substring(digits, n + 1, 1), 16, 10).cast("int"), 4 - rest) == int(base[n], 16) >> (4 - rest))
    return same


def array_get(values: Column, at: Column | int, default: Column | str | int | None = None) -> Column:
    """The element at a place from 0, or the default beyond the end."""
    return F.when((F.lit(at) >= 0) & (F.lit(at) < F.size(values)), F.get(values, F.lit(at).cast("int"))).otherwise(F.lit(default))


def array_set(values: Column, at: Column | int, value: Column | str | int, default: Column | str | int | None = None) -> Column:
    """The array with an element set; places between its end and the new one are padded with the default."""
    at, value = F.lit(at).cast("int"), F.lit(value)
    pad = F.array_repeat(F.lit(default), F.greatest(F.lit(0), at - F.size(values)))
    return F.when(at < F.size(values), F.transform(values, lambda x, i: F.when(i == at, value).otherwise(x))).otherwise(F.concat(values, pad, F.array(value)))


def array_add(values: Column, value: Column | str | int) -> Column:
    """The array, or an empty one where it is null, with an element at its end."""
    return F.concat(F.coalesce(values, F.slice(F.array(F.lit(value)), 1, 0)), F.array(F.lit(value)))


CSTS = {"&": "&amp;", "<": "&lt;", ">": "&gt;", "%": "&percnt;", "#": "&num;", "$": "&dollar;", "*": "&ast;", "[": "&lsqb;", "]": "&rsqb;", "_": "&lowbar;", "|": "&verbar;", "^": "&circ;", "`": "&grave;", "{": "&lcub;", "}": "&rcub;", "\\": "&bsol;", "~": "&tilde;", "@": "&commat;"}


def csts_encode(text: Column) -> Column:
    out = text
    for a, b in CSTS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def csts_decode(text: Column) -> Column:
    out = text
    for a, b in reversed(CSTS.items()):
        out = F.replace(out, F.lit(b), F.lit(a))
    return out


def coarse_time(seconds: Column) -> Column:
    """Units of 1000 s."""
    return F.floor(seconds / 1000)


def from_coarse_time(units: Column) -> Column:
    return F.from_unixtime(units * 1000)


def expired(expires: Column, now: Column | int) -> Column:
    return F.coalesce(expires < now, F.lit(True))
