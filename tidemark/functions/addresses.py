"""IPv4 addresses and networks as bigint column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
ADDRESS = rf"^{_OCTET}(?:[.]{_OCTET}){{3}}\z"
NETWORK = rf"^{_OCTET}(?:[.]{_OCTET}){{3}}/(?:3[0-2]|[12]?[0-9])\z"


def is_address(ip: Column) -> Column:
    return ip.rlike(ADDRESS)


def is_network(cidr: Column) -> Column:
    return cidr.rlike(NETWORK)


def address_number(ip: Column) -> Column:
    """``192.168.0.1`` -> 3232235521, for text that ``is_address``."""
    number = F.lit(0).cast("bigint")
    for i in range(4):
        octet = F.substring_index(F.substring_index(ip, ".", i + 1), ".", -1)
        number = number * 256 + octet.cast("bigint")
    return number


def network_base(number: Column, length: Column) -> Column:
    """The address with all bits after the first ``length`` cleared."""
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(32) - length)
    return number - F.pmod(number, size)


def network_parts(cidr: Column) -> tuple[Column, Column]:
    """(number, prefix length) of ``a.b.c.d/n``, for text that ``is_network``."""
    return address_number(F.substring_index(cidr, "/", 1)), F.substring_index(cidr, "/", -1).cast("int")
