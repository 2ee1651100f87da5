"""Addresses and the names derived from them."""

from pyspark.sql import Column, functions as F

IPV4 = r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})"
IPV4_STRICT = (
    r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    r"\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
)
# eight groups, or fewer with one '::'; an IPv4 tail is accepted
IPV6 = (
    r"^(([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
    r"|(?=[^:]*(:[^:]+)*::)(?!.*::.*::)(([0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4}){0,6})?::"
    r"(([0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}|([0-9a-fA-F]{1,4}:){0,5}(\d{1,3}\.){3}\d{1,3})?))$"
)


def octets(ip: Column) -> Column:
    """Numeric IPv4 sort key; NULL when there is no IPv4 address in the text."""
    parts = [F.regexp_extract(ip, IPV4, i) for i in (1, 2, 3, 4)]
    nums = [p.cast("bigint") for p in parts]
    key = ((nums[0] * 1000 + nums[1]) * 1000 + nums[2]) * 1000 + nums[3]
    return F.when(parts[0] != "", key)


# valid and not unspecified, loopback, multicast, link-local or broadcast; {ip} is the address
_V4_OTHER = r"^(127\.|169\.254\.|22[4-9]\.|23\d\.|0\.0\.0\.0$|255\.255\.255\.255$)"
_V6_OTHER = r"(?i)^((0{0,4}:)+0{0,3}[01]?$|ff|fe[89ab])"
GLOBAL_UNICAST_SQL = (
    "(CASE WHEN coalesce({ip}, '') = '' THEN false"
    " WHEN contains({ip}, ':') THEN {ip} RLIKE r'" + IPV6.replace("{", "{{").replace("}", "}}") + "'"
    " AND NOT {ip} RLIKE r'" + _V6_OTHER.replace("{", "{{").replace("}", "}}") + "'"
    " ELSE {ip} RLIKE r'" + IPV4_STRICT + "' AND NOT {ip} RLIKE r'" + _V4_OTHER + "' END)"
)


def is_global_unicast(name: str) -> Column:
    """Whether the named column holds an address that can be given to an instance."""
    return F.expr(GLOBAL_UNICAST_SQL.format(ip=name))


def instance_name(cluster: Column, ip: Column) -> Column:
    return F.concat(F.lit("og-"), cluster.cast("string"), F.lit("-pod-"), F.replace(ip, F.lit("."), F.lit("x")))


def ip_of_instance_name(name: Column) -> Column:
    return F.replace(F.substring_index(name, "-pod-", -1), F.lit("x"), F.lit("."))


def application_name(ip: Column) -> Column:
    return F.concat(F.lit("og_"), F.replace(ip, F.lit("."), F.lit("_")))
