"""Scalar functions on columns: target names, paths, errors, messages and record fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesselake import schema as S

#: Characters that integer parsing skips in front of a number.
_SKIP = r"[ \t\n\x0B\f\r]*"


def _integer(digits: Column, base: int, most: int) -> Column:
    """Index of a digit text that may have skipped white space, a sign, and in base 16 a further 0x; else -1."""
    pattern = rf"(?s)^{_SKIP}([+-]?)(?:0[xX])?0*([0-9A-Fa-f]*?)(?:_UUID)?\z" if base == 16 else rf"(?s)^{_SKIP}([+-]?)0*([0-9]*?)(?:_UUID)?\z"
    some = rf"(?s)^{_SKIP}[+-]?(?:0[xX])?[0-9A-Fa-f]+(?:_UUID)?\z" if base == 16 else rf"(?s)^{_SKIP}[+-]?[0-9]+(?:_UUID)?\z"
    sign, body = F.regexp_extract(digits, pattern, 1), F.regexp_extract(digits, pattern, 2)
    short = F.length(body) <= 9
    value = F.when(body == "", F.lit(0)).when(short, F.conv(F.when(short, body).otherwise("0"), base, 10).cast("bigint")).otherwise(F.lit(most + 1))
    return F.when(~digits.rlike(some), -1).when((sign == "-") & (value > 0), -1).when(value > most, -1).otherwise(value).cast("int")


def parse_ost(text: Column, fsname: Column | str | None = None) -> Column:
    """Index of a target's spelling: 14, 0x14, OST0014, fs-OST0014[_UUID]; -1 malformed, -2 of another file system. Null is malformed."""
    marker = F.instr(text, "-OST")
    tail = F.substring(text, marker + 4, F.length(text))
    foreign = F.lit(False) if fsname is None else F.substring(text, F.lit(1), marker - 1) != (F.lit(fsname) if isinstance(fsname, str) else fsname)
    return (
        F.when(text.isNull() | (text == "") | text.startswith(" ") | text.startswith("\t"), -1)
        .when((marker > 0) & foreign, -2)
        .when(marker > 0, _integer(tail, 16, S.MAX_OST_INDEX))
        .when(text.startswith("OST"), _integer(F.substring(text, F.lit(4), F.length(text)), 16, S.MAX_OST_INDEX))
        .when(text.startswith("0x") | text.startswith("0X"), _integer(F.substring(text, F.lit(3), F.length(text)), 16, S.MAX_OST_INDEX))
        .when(text.startswith("0") & (F.length(text) > 1), -1)
        .otherwise(_integer(text, 10, S.MAX_OST_INDEX))
        .cast("int")
    )


def ost_name(fsname: str, index: Column) -> Column:
    return F.format_string("%s-OST%04x_UUID", F.lit(fsname), index)


def file_id_text(seq: Column, oid: Column, ver: Column) -> Column:
    return F.format_string("[0x%x:0x%x:0x%x]", seq, oid, ver)


def normal_pool(pool: Column, fsname: str) -> Column:
    """The pool without the file system's prefix; null where it isn't 1 to 15 characters long."""
    short = F.when(pool.startswith(f"{fsname}."), F.substring(pool, F.lit(len(fsname) + 2), F.length(pool))).otherwise(pool)
    return F.when(F.length(short).between(1, S.POOL_NAME_MAX), short)


def relative_path(path: Column, root: str) -> Column:
    """What stands below the root, without leading slashes; null if the path is absolute and not below the root."""
    base = root.rstrip("/")
    below = F.lit(True) if not base else (path == base) | path.startswith(f"{base}/")
    rest = F.when(~path.startswith("/"), path).when(below, F.substring(path, F.lit(len(base) + 1), F.length(path)))
    return F.regexp_replace(rest, "^/+", "")


def path_verdict(path: Column, root: str) -> Column:
    """The lexical half of path resolution: ok, outside root, root itself, rejected component or directory; the first fault counts."""
    rel = relative_path(path, root)
    parts = F.split(F.regexp_replace(rel, "/$", ""), "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", "..") | (F.octet_length(p) > S.NAME_MAX))
    return F.when(rel.isNull(), "outside root").when(rel == "", "root itself").when(bad, "rejected component").when(rel.endswith("/"), "directory").otherwise("ok")


def pick_osts(allowed: Column, identity: Column, attempt: Column, stripes: int) -> Column:
    """The targets of a new mirror: a run of the allowed list from a place that the file and the attempt decide."""
    n = F.size(allowed)
    start = F.pmod(identity + attempt, n)
    return F.transform(F.sequence(F.lit(0), F.lit(stripes - 1)), lambda i: F.element_at(allowed, (F.pmod(start + i, n) + 1).cast("int")))


def is_transient(errno: Column) -> Column:
    return errno.isin(*S.TRANSIENT)


def exit_code(errno: Column) -> Column:
    """0 without an error, 3 for one that a retry may cure, else 1."""
    return F.when(F.coalesce(errno, F.lit(0)) == 0, 0).when(is_transient(errno), 3).otherwise(1).cast("int")


def errno_of(rc: Column) -> Column:
    return F.when(rc < 0, -rc).otherwise(S.EIO).cast("int")


def target_text(osts: Column) -> Column:
    """Target indexes with commas between them, as many as the fixed room of a description holds."""
    full = F.lit(S.TARGET_TEXT - 8)
    return F.aggregate(osts, F.lit(""), lambda text, x: F.when(F.length(text) >= full, text).when(text == "", x.cast("string")).otherwise(F.concat(text, F.lit(","), x.cast("string"))))


def first_bytes(text: Column, n: int) -> Column:
    """At most n bytes of a text, as bytes: a cut may fall inside a character."""
    return F.substring(text.cast("binary"), 1, n)


def delete_reason(reason: Column) -> Column:
    return F.when(reason == "BANNED", "banned").when(reason == "ROLLBACK", "rollback of the mirror just added").when(reason == "SURPLUS", "surplus").otherwise("unknown")


def known_count(value: Column) -> Column:
    """A count that was never determined is null, not a negative sentinel."""
    return F.when(value >= 0, value)


def base64_text(data: Column) -> Column:
    """Base 64 without line breaks whatever the session says."""
    return F.regexp_replace(F.base64(data.cast("binary")), r"\r?\n", "")


def json_escaped(text: Column) -> Column:
    """Quotes and backslashes by a backslash, control characters and every byte from 0x7f as \\u00xx.

    Bytes are taken one by one from the hexadecimal form, so invalid UTF-8 (a binary column) works as well; a text
    that has nothing to escape is left alone.
    """
    plain = text.cast("string")
    pairs = F.regexp_extract_all(F.hex(text.cast("binary")), F.lit("(..)"), 1)
    one = F.transform(pairs, lambda h: F.when(h.isin("22", "5C"), F.concat(F.lit("\\"), F.unhex(h).cast("string"))).when((h < "20") | (h >= "7F"), F.concat(F.lit("\\u00"), F.lower(h))).otherwise(F.unhex(h).cast("string")))
    return F.when(plain.rlike(r'[^\x20-\x7E]|["\\]'), F.array_join(one, "")).otherwise(plain)


def copy_buffer(stripe_size: Column) -> Column:
    return F.when(stripe_size.between(S.PAGE, S.LARGEST_BUFFER), stripe_size).otherwise(S.COPY_BUFFER).cast("long")


def plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def option_integer(text: Column, low: int, high: int) -> Column:
    """A whole-text integer option within bounds, else null."""
    value = F.when(text.rlike(rf"^{_SKIP}[+-]?0*[0-9]{{1,18}}\z"), F.trim(text)).try_cast("bigint")
    return F.when(value.between(low, high), value)
