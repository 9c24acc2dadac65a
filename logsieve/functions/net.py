"""Addresses, URLs, mail addresses, ports and TCP flags as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsieve.functions.rows import bind

IPV4 = r"^((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
IPV6 = r"^[0-9a-fA-F:]*:[0-9a-fA-F:]*:[0-9a-fA-F:.]*$"


def is_ipv4(col: Column) -> Column:
    return F.coalesce(col.rlike(IPV4), F.lit(False))


def ipv4_to_long(col: Column) -> Column:
    """Address as a number; null when it is not an IPv4 address."""

    def number(octets):
        value = F.lit(0).cast("long")
        for i in range(4):
            value = value * 256 + F.get(octets, F.lit(i)).try_cast("long")
        return value

    return F.when(is_ipv4(col), bind(F.split(col, r"\."), number))


def _cidr_bounds(cidr: str) -> tuple[int, int]:
    base, bits = cidr.split("/")
    number = 0
    for part in base.split("."):
        number = number * 256 + int(part)
    size = 1 << (32 - int(bits))
    low = number - number % size
    return low, low + size - 1


def in_cidr(col: Column, cidr: str) -> Column:
    low, high = _cidr_bounds(cidr)
    return F.coalesce(ipv4_to_long(col).between(low, high), F.lit(False))


# fixed values: private, loopback, link-local and reserved networks
PRIVATE_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)


def is_private_ip(col: Column) -> Column:
    def inside(number):
        hit = F.lit(False)
        for network in PRIVATE_NETWORKS:
            low, high = _cidr_bounds(network)
            hit = hit | number.between(low, high)
        return F.coalesce(hit, F.lit(False))

    v6 = F.lower(col).rlike(r"^(::1$|::$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)")
    return F.when(is_ipv4(col), bind(ipv4_to_long(col), inside)).otherwise(F.coalesce(v6, F.lit(False)))


def is_ip(col: Column) -> Column:
    return is_ipv4(col) | F.coalesce(col.rlike(IPV6), F.lit(False))


def is_public_ip(col: Column) -> Column:
    return is_ip(col) & ~is_private_ip(col)


def is_multicast_ip(col: Column) -> Column:
    return in_cidr(col, "224.0.0.0/4") | F.coalesce(F.lower(col).startswith("ff") & ~is_ipv4(col) & is_ip(col), F.lit(False))


def ip_version(col: Column) -> Column:
    return F.when(is_ipv4(col), 4).when(is_ip(col), 6)


def is_external(dst: Column) -> Column:
    """Present and outside 10/8, 172.16/12 and 192.168/16."""
    inside = dst.rlike(r"^10\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.")
    return F.coalesce((dst != "") & ~inside, F.lit(False))


SUSPICIOUS_TLDS = ("tk", "ml", "ga", "cf")


def tld(domain: Column) -> Column:
    return F.lower(F.try_element_at(F.split(domain, r"\."), F.lit(-1)))


def subdomain_levels(domain: Column) -> Column:
    return F.size(F.split(domain, r"\.")) - 2


def has_suspicious_tld(domain: Column) -> Column:
    return tld(domain).isin(*SUSPICIOUS_TLDS)


def has_excessive_subdomains(domain: Column) -> Column:
    return subdomain_levels(domain) > 3


def registered_domain(domain: Column) -> Column:
    """Last two labels; a public-suffix table can be joined in instead."""
    parts = F.split(F.lower(domain), r"\.")
    return F.when(F.size(parts) >= 2, F.concat_ws(".", F.slice(parts, -2, 2))).otherwise(F.lower(domain))


# fixed values: ports of command-and-control servers and paths of web shells
C2_PORTS = (4444, 8080, 8443, 9001, 9002, 12345, 31337)
WEBSHELL_PATHS = ("/shell.php", "/c99.php", "/r57.php", "/upload.php", "/cmd.php")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def url_port(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?[^/:?#]+:(\d{1,5})", 1).try_cast("int")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def has_c2_port(url: Column) -> Column:
    return F.coalesce(url_port(url).isin(*C2_PORTS), F.lit(False))


def has_webshell_path(url: Column) -> Column:
    path = F.lower(url_path(url))
    hit = F.lit(False)
    for shell in WEBSHELL_PATHS:
        hit = hit | path.contains(shell)
    return hit


def email_address(col: Column) -> Column:
    bracketed = F.regexp_extract(col, r"<([^>]+)>", 1)
    plain = F.regexp_extract(col, r"[\w.\-]+@[\w.\-]+", 0)
    return F.lower(F.when(bracketed != "", bracketed).when(plain != "", plain).otherwise(col))


def email_display_name(col: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_extract(col, r"^([^<]+)<", 1)), r'^"+|"+$', "")


def email_domain(col: Column) -> Column:
    return F.lower(F.split_part(col, F.lit("@"), F.lit(2)))


def same_domain(left: Column, right: Column) -> Column:
    """Equal domains, or one a sub-domain of the other."""
    a, b = email_domain(left), email_domain(right)
    related = (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))
    return F.coalesce(left.contains("@") & right.contains("@") & related, F.lit(False))


TCP_FLAGS = ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR")


def tcp_flag_names(flags: Column) -> Column:
    return F.array_compact(
        F.array(*[F.when(flags.bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(TCP_FLAGS)])
    )


def has_suspicious_flags(flags: Column) -> Column:
    return (flags == 0) | (flags.bitwiseAND(0x29) == 0x29) | (flags.bitwiseAND(0x03) == 0x03)


def tcp_flag_tags(flags: Column) -> Column:
    syn = (flags.bitwiseAND(0x02) != 0) & (flags.bitwiseAND(0x10) == 0)
    return F.array_compact(
        F.array(
            F.when(syn, F.lit("syn_packet")),
            F.when(flags == 0, F.lit("null_scan")),
            F.when(flags.bitwiseAND(0x29) == 0x29, F.lit("xmas_scan")),
            F.when(flags.bitwiseAND(0x03) == 0x03, F.lit("syn_fin")),
        )
    )


# fixed values: IP protocol numbers, services by port, ports seen in attacks
PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP", 47: "GRE", 50: "ESP", 51: "AH", 88: "EIGRP", 89: "OSPF"}
SERVICES = {
    20: "FTP-DATA", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 69: "TFTP", 80: "HTTP", 110: "POP3",
    135: "RPC", 139: "NetBIOS", 143: "IMAP", 161: "SNMP", 162: "SNMP-Trap", 389: "LDAP", 443: "HTTPS", 445: "SMB",
    512: "rexec", 513: "rlogin", 514: "rsh", 1433: "MSSQL", 1521: "Oracle", 3306: "MySQL", 3389: "RDP",
    5432: "PostgreSQL", 5900: "VNC", 6379: "Redis", 8080: "HTTP-Alt", 8443: "HTTPS-Alt", 9200: "Elasticsearch",
    27017: "MongoDB",
}
RISKY_PORTS = (135, 139, 445, 1433, 3306, 5432, 3389, 4444, 5555, 6666, 7777, 8888, 9999, 6379, 9200, 27017)
ATTACKED_PORTS = (135, 139, 445, 3389)
BACKDOOR_PORTS = (4444, 5555, 6666, 7777, 8888, 9999)
SENSOR_PORTS = (4444, 31337, 12345, 54321, 1337, 666, 999, 8888, 9999, 6666, 6667, 6668, 6669)
PACKET_PORTS = (20, 21, 22, 23, 25, 135, 139, 445, 1433, 3306, 3389, 5900)
ORDINARY_PORTS = (80, 443, 22, 25, 53)


def lookup(col: Column, table: dict, default: Column | str | None = None) -> Column:
    """Value of a small fixed table."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), col)
    if default is None:
        return found
    return F.coalesce(found, F.lit(default) if isinstance(default, str) else default)
