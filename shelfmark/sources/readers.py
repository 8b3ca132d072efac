"""Where texts come from: kinds, URL and path policy, size caps, readers, page text, hashes."""

from __future__ import annotations

import ipaddress
import os
import socket
import struct
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CAP = 50 * 1024 * 1024
#: Networks that pages may not be fetched from.
BLOCKED_V4 = ["127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "100.64.0.0/10"]
BLOCKED_V6 = ["::1/128", "fc00::/7", "fe80::/10"]
#: Addresses that reach this machine by other spellings.
UNSPECIFIED = ["0.0.0.0/8", "::/128"]
#: IPv6 networks that hold IPv4 addresses in their last 32 bits.
CARRIERS = ["::ffff:0:0/96", "::/96", "64:ff9b::/96"]
NETWORKS = [ipaddress.ip_network(n) for n in BLOCKED_V4 + BLOCKED_V6 + UNSPECIFIED]


def source_kind(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.rlike("^https?://"), "web").when(low.endswith(".pdf"), "pdf").when(low.endswith(".txt") | low.endswith(".md"), "text").otherwise("unsupported")
    )


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _v4_number(host: Column) -> Column:
    """The 32-bit number of an IPv4 address in any spelling that resolvers take (one to four parts, decimal, octal or
    hexadecimal, the last of which fills the rest), -1 if it is out of range, null if the host is none."""

    def part(p: Column) -> Column:
        digits = F.when(p.startswith("0x"), F.conv(F.concat(F.lit("0"), F.substr(p, F.lit(3))), 16, 10)).when(p.rlike("^0[0-7]+$"), F.conv(p, 8, 10)).when(p.rlike("^(0|[1-9][0-9]*)$"), p)
        return digits.try_cast("bigint")

    def number(p: Column) -> Column:
        n, last = F.size(p), F.element_at(p, -1)
        bad = F.exists(p, lambda x: x.isNull()) | F.exists(F.slice(p, 1, n - 1), lambda x: x > 255) | (last >= F.pow(F.lit(256.0), 5 - n))
        head = F.aggregate(F.transform(F.slice(p, 1, n - 1), lambda x, i: x * F.pow(F.lit(256.0), 3 - i).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
        return F.when(bad, F.lit(-1).cast("bigint")).otherwise(head + last)

    numeric = host.rlike(r"^(0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]+)){0,3}$")
    return F.when(numeric, _let(F.transform(F.split(host, r"\."), part), number))


def _v6_groups(host: Column) -> Column:
    """The eight numbers of an IPv6 address; null if it is none."""
    hexed = lambda n: F.lower(F.hex(n))
    groups = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")

    def expanded(plain: Column) -> Column:
        short = plain.contains("::")
        left, right = groups(F.substring_index(plain, "::", 1)), F.when(short, groups(F.substring_index(plain, "::", -1))).otherwise(F.array().cast("array<string>"))
        sides = F.struct(left.alias("left"), right.alias("right"), (8 - F.size(left) - F.size(right)).alias("missing"))

        def whole(s: Column) -> Column:
            full = F.concat(s["left"], F.array_repeat(F.lit("0"), F.greatest(s["missing"], F.lit(0))), s["right"])
            ok = plain.rlike("^[0-9a-f:]+$") & F.when(short, s["missing"] >= 1).otherwise(s["missing"] == 0)
            return F.when(ok & ~F.exists(full, lambda g: F.length(g) > 4), F.transform(full, lambda g: F.conv(g, 16, 10).cast("bigint")))

        return _let(sides, whole)

    tail = F.regexp_extract(host, r":(\d+\.\d+\.\d+\.\d+)$", 1)
    as_groups = lambda v4: F.concat(F.regexp_replace(host, r"\d+\.\d+\.\d+\.\d+$", ""), hexed(F.shiftright(v4, 16)), F.lit(":"), hexed(v4.bitwiseAND(F.lit(65535))))
    return _let(F.when(tail != "", _let(_v4_number(tail), as_groups)).otherwise(host), expanded)


def _in_v4(n: Column) -> Column:
    found = F.lit(False)
    for net in map(ipaddress.ip_network, BLOCKED_V4 + UNSPECIFIED):
        if net.version == 4:
            found = found | n.between(int(net.network_address), int(net.broadcast_address))
    return found


def _in_v6(groups: Column) -> Column:
    same = lambda of, n: F.slice(groups, 1, n) == F.array(*[F.lit(x).cast("bigint") for x in of[:n]])
    found = F.lit(False)
    for net in map(ipaddress.ip_network, BLOCKED_V6 + UNSPECIFIED):
        if net.version == 6:
            # whole groups of the prefix, then the bits of the next one
            (whole, bits), of = divmod(net.prefixlen, 16), struct.unpack(">8H", net.network_address.packed)
            inside = same(of, whole) if whole else F.lit(True)
            found = found | (inside & (F.shiftright(F.get(groups, whole), 16 - bits) == of[whole] >> (16 - bits)) if bits else inside)
    carried = F.lit(False)
    for net in map(ipaddress.ip_network, CARRIERS):
        carried = carried | same(struct.unpack(">8H", net.network_address.packed), 6)
    return found | (carried & _let(F.get(groups, 6) * 65536 + F.get(groups, 7), _in_v4))


def url_problem(url: Column) -> Column:
    """Null if the URL may be fetched as far as its text tells, else why not.  Addresses are understood in every spelling;
    names are not resolved, since executors make no network calls: :func:`check_url` does that on the driver."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    bracketed = authority.startswith("[")
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^\[|(%[^\]]*)?\]$", ""), r"\.$", ""))

    def of_name(host: Column) -> Column:
        named = (host == "localhost") | host.endswith(".localhost")
        return _let(_v4_number(host), lambda n: F.when(n == -1, "bad host").when(named | _in_v4(n), "private host"))

    of_v6 = lambda groups: F.when(groups.isNull(), "bad host").when(_in_v6(groups), "private host")
    return (
        F.when(~scheme.isin("http", "https"), F.lit("scheme"))
        .when(host == "", F.lit("no host"))
        .when(url.rlike(r"[\\\s\p{Cntrl}]"), F.lit("bad host"))
        .when(bracketed, _let(_v6_groups(host), of_v6))
        .otherwise(_let(host, of_name))
    )


def _blocked(address: str) -> bool:
    ip = ipaddress.ip_address(address.split("%")[0])
    if ip.version == 6 and any(ip in ipaddress.ip_network(c) for c in CARRIERS) and int(ip) > 1:
        return _blocked(str(ipaddress.IPv4Address(int(ip) & 0xFFFFFFFF)))
    return any(ip in net for net in NETWORKS if net.version == ip.version)


def check_url(url: str, resolve=socket.getaddrinfo) -> None:
    """Raises if the URL may not be fetched now: every address that its host has is checked, of either family.  To be called
    just before a request, and again for every redirect.  A name that does not resolve is left to the request."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https"):
        raise ValueError(f"{url}: the scheme is not allowed")
    host = (parts.hostname or "").rstrip(".")
    if not host:
        raise ValueError(f"{url} has no host")
    if host == "localhost" or host.endswith(".localhost"):
        raise ValueError(f"{url}: private hosts are not allowed")
    try:
        addresses = {str(found[4][0]) for found in resolve(host, None)}
    except (OSError, UnicodeError):
        return
    if any(_blocked(a) for a in addresses):
        raise ValueError(f"{url}: private hosts are not allowed")


def over_cap(text: Column, cap: int = DEFAULT_CAP) -> Column:
    """True if the raw bytes exceed the cap; a cap of 0 is none."""
    return (F.octet_length(text) > cap) if cap > 0 else F.lit(False)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def checked_path(path: str, root: str | None = None) -> str:
    """The resolved path; an error if it leaves ``root``."""
    full = os.path.realpath(path)
    base = os.path.realpath(root) if root else None
    if base and full != base and not full.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"{path} is outside {root}")
    return full


def read_texts(spark: SparkSession, path: str, root: str | None = None, cap: int = DEFAULT_CAP) -> DataFrame:
    """(path, text) of text files under a path; files beyond the cap are an error when read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md,TXT,MD}").option("recursiveFileLookup", "true").load(checked_path(path, root))
    text = F.col("content").cast("string")
    too_big = F.raise_error(F.concat(F.lit("file beyond the size cap: "), F.col("path"))).cast("string")
    return files.select("path", (F.when(F.col("length") > cap, too_big).otherwise(text) if cap else text).alias("text"))


def read_pdfs(spark: SparkSession, path: str, extract, root: str | None = None, cap: int = DEFAULT_CAP) -> DataFrame:
    """(path, text) of PDF files; ``extract(bytes) -> list of page texts`` is injected, since no PDF
    library can be assumed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").option("recursiveFileLookup", "true").load(checked_path(path, root))

    def run(batches):
        for pdf in batches:
            for p, data, size in zip(pdf["path"], pdf["content"], pdf["length"], strict=True):
                if cap and size > cap:
                    raise ValueError(f"file beyond the size cap: {p}")
            yield pdf.assign(text=["\n".join(extract(d)) for d in pdf["content"]])[["path", "text"]]

    return files.select("path", "content", "length").mapInPandas(run, "path string, text string")


#: Elements whose content is not main text, and elements that end a line.
SILENT = ["script", "style", "head", "nav", "footer", "header", "aside", "form"]
BLOCKS = "p|div|br|li|ul|ol|h[1-6]|article|section|table|tr|td|blockquote"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def page_text(html: Column) -> Column:
    """Visible text of a page by pattern rules, one block a line."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in SILENT:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    out = F.regexp_replace(out, r'(?is)<div class="ad">.*?</div>', " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for code, char in ENTITIES:
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")
