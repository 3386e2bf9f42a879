"""File names, identifiers and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes that are stripped, in this order.
STRIPPED = (".gz", ".fasta", ".fa", ".fna", ".ffn", ".frn", ".fastq", ".fq")


def strip_suffixes(name: Column) -> Column:
    for s in STRIPPED:
        name = F.regexp_replace(name, rf"(?i)\{s}$", "")
    return name


def sample_id(name: Column) -> Column:
    """Sample of a file name: suffixes go, and for reads the sequencer's or the mate's tail."""
    base = strip_suffixes(name)
    reads = name.rlike(r"(?i)\.(fastq|fq)(\.gz)?$")
    tail, mate = r"(?i)^(.+)_S\d+(_L\d{3})?(_R[12])?(_\d{3})?$", r"(?i)^(.+?)[_.]R[12]([_.]\d{3})?$"
    return F.when(reads & base.rlike(tail), F.regexp_extract(base, tail, 1)).when(reads & base.rlike(mate), F.regexp_extract(base, mate, 1)).otherwise(base)


def mate_of(name: Column) -> tuple[Column, Column]:
    """(pair key, mate 1 or 2), null for unpaired names."""
    base = strip_suffixes(name)
    long, short = r"(?i)^(.*?)[_.]R([12])([_.]\d{3})?$", r"(?i)^(.*?)[_.]([12])([_.]\d{3})?$"
    pick = lambda g: F.when(base.rlike(long), F.regexp_extract(base, long, g)).when(base.rlike(short), F.regexp_extract(base, short, g))
    return pick(1), pick(2).cast("int")


def is_identifier(name: Column) -> Column:
    """A safe scheme name: no path parts, no NUL."""
    return name.rlike(r"^[A-Za-z0-9_][A-Za-z0-9_.-]*$") & ~name.contains("..")


#: First and last IPv4 address of ranges that aren't public (private, loopback, link-local, reserved, multicast, unspecified).
PRIVATE_RANGES = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("224.0.0.0", "255.255.255.255"),
)
_QUAD = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"


def _number(quad: str) -> int:
    a, b, c, d = map(int, quad.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def is_private_ipv4(quad: Column) -> Column:
    """Of dotted quads: is the address in a range that isn't public?"""
    p = F.split(quad, r"\.")
    part = lambda i: F.get(p, F.lit(i)).try_cast("long")
    n = ((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3)
    found = F.lit(False)
    for first, last in PRIVATE_RANGES:
        found = found | n.between(_number(first), _number(last))
    return found


def is_private_ipv6(address: Column) -> Column:
    """Of lower-case IPv6 literals: only global unicast 2000::/3 (without its special blocks) and site-local are let through; an
    IPv4-mapped address counts as its quad, and what cannot be parsed as private."""
    mapped = F.regexp_extract(address, r"^(?:0{0,4}:){0,5}:?ffff:([0-9.]+)$", 1)
    group = lambda i: F.conv(F.regexp_extract(address, r"^([0-9a-f]{1,4}):([0-9a-f]{1,4})?", i), 16, 10).cast("long")
    first, second = group(1), F.coalesce(group(2), F.lit(0))
    special = (first == 0x2001) & ((second < 0x200) & ~((second >= 0x20) & (second < 0x40)) & (second != 3) | (second == 0xDB8)) | (first == 0x2002) | ((first == 0x3FFF) & (second < 0x1000))
    open_ = (first.between(0x2000, 0x3FFF) & ~special) | first.between(0xFEC0, 0xFEFF)
    shaped = address.rlike(r"^[0-9a-f:.]+(%.*)?$") & (F.size(F.split(address, ":")) <= 9)
    return F.when(mapped.rlike(_QUAD), is_private_ipv4(mapped)).otherwise(~F.coalesce(open_ & shaped, F.lit(False)))


def is_public_url(url: Column, allow: tuple[str, ...] = ()) -> Column:
    """http(s) with a host that isn't an address out of the public ranges. Allowed hosts always pass.

    Names are not resolved here (localhost apart); numeric hosts that are no dotted quad (127.1, 0x7f000001) may stand for any
    address and fail.
    """
    host = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#\[\]]*)(?::[0-9]*)?(?:[/?#]|$)", 1))
    literal = F.regexp_extract(host, r"^\[(.*)\]$", 1)
    private = F.when(host.startswith("["), is_private_ipv6(literal)).when(host.rlike(_QUAD), is_private_ipv4(host)).otherwise(host.rlike(r"^(0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]+))*\.?$") | host.isin("localhost", "localhost."))
    named = host.isin(*[a.lower() for a in allow]) | literal.isin(*[a.lower() for a in allow]) if allow else F.lit(False)
    return F.coalesce(url.rlike(r"^(?i:https?)://") & (host != "") & (named | ~private), F.lit(False))
