"""IPv4 and safe-number expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4_MAX = 4294967295

# The routable range 1.0.0.0 - 223.255.255.255 and the shape of
# an anonymous user id.
ROUTABLE_MIN = 16777216
ROUTABLE_MAX = 3758096383
ANONYMOUS_IPV4 = r"^ip:[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"
DOTTED_QUAD = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"


def is_anonymous_ipv4(user_id: Column) -> Column:
    """True for ``ip:`` followed by a dotted quad (host names do not match)."""
    return user_id.rlike(ANONYMOUS_IPV4)


def address_of(user_id: Column) -> Column:
    """The dotted quad behind the ``ip:`` prefix."""
    return F.substring_index(user_id, ":", -1)


def quad_to_long(dotted: Column, lo: int = 0, hi: int = IPV4_MAX) -> Column:
    """Integer value of a well-formed dotted quad; null outside ``lo`` to ``hi`` or
    when an octet is above 255.

    Names its argument once: when a filter on the result is pushed below the
    projection, whatever computes the address is repeated once, not per octet.
    """

    def shift_in(value: Column, octet: Column) -> Column:
        return value * 256 + F.when(octet.try_cast("int") <= 255, octet.try_cast("int"))

    def limited(value: Column) -> Column:
        return F.when(value.between(lo, hi), value)

    return F.aggregate(F.split(dotted, r"\."), F.lit(0).cast("bigint"), shift_in, limited)


def ipv4_to_long(dotted: Column) -> Column:
    """Dotted IPv4 to its integer value; null if it is none."""
    return F.when(dotted.rlike(DOTTED_QUAD), quad_to_long(dotted))


def is_routable(long_ip: Column) -> Column:
    return long_ip.between(ROUTABLE_MIN, ROUTABLE_MAX)


def is_digits(text: Column) -> Column:
    return F.trim(text).rlike("^[0-9]+$")


def safe_long(text: Column) -> Column:
    """Trimmed all-digit text as bigint, anything else 0."""
    parsed = F.trim(text).try_cast("bigint")
    return F.when(is_digits(text), F.coalesce(parsed, F.lit(0))).otherwise(F.lit(0)).cast("bigint")


def digits_to_long(text: Column) -> Column:
    """Everything but digits and dots removed, then bigint; null if that fails."""
    return F.regexp_replace(text, "[^0-9.]", "").try_cast("bigint")
