"""Deterministic ids."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def derived_id(*parts: Column | str) -> Column:
    """Id of a thing named by ``parts``: md5 of the parts joined with a colon.

    Null if a part is null, as things without a full name are not one thing.
    """
    joined: list[Column | str] = []
    for part in parts:
        joined += [F.lit(":"), part] if joined else [part]
    return F.md5(F.concat(*joined).cast("binary"))


def address_key(address: Column | str) -> Column:
    """One canonical spelling per account or contract address."""
    return F.lower(address)


def space_id(network: Column | str, dao_address: Column | str) -> Column:
    return derived_id(network, address_key(dao_address))


def account_id(address: Column | str) -> Column:
    return derived_id(address_key(address))


def proposal_id(plugin_address: Column | str, onchain_id: Column | str) -> Column:
    return derived_id(address_key(plugin_address), onchain_id)


def edit_id(content_uri: Column | str) -> Column:
    return derived_id(content_uri)


def version_id(space: Column | str, proposal_or_block: Column | str) -> Column:
    return derived_id(space, proposal_or_block)


def merged_version_id(version_ids: Column | str) -> Column:
    """Id of a version merged from an array of version ids."""
    return F.md5(F.array_join(version_ids, ",").cast("binary"))
