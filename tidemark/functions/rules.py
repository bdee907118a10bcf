"""Named format rules for ``rule_check``: a dict of rule name -> boolean column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.addresses import is_network

# fixed value: longest host label
HOST_LABEL_MAX = 63


def host_label_rules(name: Column) -> dict[str, Column]:
    return {
        "not_empty": name != "",
        "first_is_alphanumeric": name.rlike("^[a-zA-Z0-9]"),
        "only_alphanumeric_or_hyphen": name.rlike(r"^[a-zA-Z0-9-]*\z"),
        "last_is_alphanumeric": name.rlike(r"[a-zA-Z0-9]\z"),
        "length_within_limit": F.length(name) <= HOST_LABEL_MAX,
    }


def version_rules(version: Column, parts: int) -> dict[str, Column]:
    """``parts`` dotted numbers and nothing else: 2 for 3.11, 3 for 3.5.7."""
    return {f"has_{parts}_numbers": version.rlike("^[0-9]+" + "[.][0-9]+" * (parts - 1) + r"\z")}


def network_rules(cidr: Column) -> dict[str, Column]:
    return {"has_prefix_length": cidr.contains("/"), "is_ipv4_network": is_network(cidr)}
