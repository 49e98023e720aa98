"""Service, severity and volume classes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trapline.schema import SERVICES

# --- fixed values -----------------------------------------------------------
# Severity given by the forwarder; everything else is medium.
FORWARDER_HIGH = [
    "cowrie.login.success", "cowrie.session.file_download", "cowrie.session.file_upload",
    "http.login.attempt", "http.admin.probe",
    "ftp.login.success", "ftp.file.download", "ftp.file.upload",
    "mysql.login.success", "mysql.query",
    "smtp.login.attempt", "smtp.message.received",
    "redis.rce.attempt", "redis.slaveof.attempt", "redis.replicaof.attempt",
    "redis.debug.attempt", "redis.flush.attempt",
]
FORWARDER_LOW = [
    "cowrie.session.connect", "ftp.session.connect", "ftp.session.disconnect",
    "smtp.session.connect", "smtp.session.disconnect", "smtp.ehlo",
    "http.page.visit", "http.api.probe", "http.scan.probe",
    "redis.session.connect", "redis.session.disconnect", "mysql.session.connect",
]

# Severity given by the sensors themselves; everything else is low.
SENSOR_SEVERITY = {
    "high": [
        "http.login.attempt", "ftp.login.success", "ftp.file.download", "ftp.file.upload",
        "mysql.login.success", "mysql.query", "smtp.login.attempt", "smtp.message.received",
        "redis.rce.attempt", "redis.slaveof.attempt", "redis.replicaof.attempt"],
    "medium": [
        "http.admin.probe", "http.file.probe", "ftp.login.failed", "mysql.login.attempt",
        "smtp.relay.attempt", "redis.auth.attempt", "redis.flush.attempt",
        "redis.debug.attempt"],
}

# Severity shown on the map: the first matching text fragment decides.
MAP_SEVERITY = {
    "high": ["login.success", "command", "upload"],
    "med": ["login.failed", "login.attempt", "auth"],
}
SEVERITY_RANK = {"low": 1, "med": 2, "high": 3}

# Display name and pattern of each service; the first match decides.
SERVICE_PATTERNS = [
    ("SSH", "(?i)ssh|cowrie|telnet"),
    ("HTTP", r"(?i)http|\bweb\b"),
    ("Redis", "(?i)redis"),
    ("MySQL", "(?i)mysql"),
    ("FTP", "(?i)ftp"),
    ("SMTP", "(?i)smtp"),
]

# Lower bound of each attack volume band.
VOLUME_BANDS = {"100+": 100, "20-99": 20, "5-19": 5}

PRIVATE_SOURCE = r"^(127\.0\.0\.1$|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"
LOCAL_SOURCES = ["127.0.0.1", "::1"]
# --- end of fixed values ----------------------------------------------------


def resolve_service(honeypot_type: Column, event_type: Column) -> Column:
    """Explicit type, else the event type's prefix; NULL if not a known service."""
    prefix = F.split_part(event_type, F.lit("."), F.lit(1))
    explicit = F.when(F.length(honeypot_type) > 0, honeypot_type)
    candidate = F.lower(F.trim(F.coalesce(explicit, prefix)))
    return F.when(candidate.isin(SERVICES), candidate)


def display_service(*candidates: Column) -> Column:
    """Service display name from the first candidate that matches any pattern."""
    def match(text: Column) -> Column:
        chain = F.when(text.rlike(SERVICE_PATTERNS[0][1]), SERVICE_PATTERNS[0][0])
        for name, pattern in SERVICE_PATTERNS[1:]:
            chain = chain.when(text.rlike(pattern), name)
        return chain

    return F.coalesce(*[match(c) for c in candidates], F.lit("Other"))


def forwarder_severity(event_type: Column) -> Column:
    return (F.when(event_type.isin(FORWARDER_HIGH), "high")
            .when(event_type.isin(FORWARDER_LOW), "low").otherwise("medium"))


def sensor_severity(event_type: Column) -> Column:
    return (F.when(event_type.isin(SENSOR_SEVERITY["high"]), "high")
            .when(event_type.isin(SENSOR_SEVERITY["medium"]), "medium").otherwise("low"))


def map_severity(event_type: Column) -> Column:
    def any_of(parts: list[str]) -> Column:
        return event_type.rlike("|".join(p.replace(".", r"\.") for p in parts))

    return (F.when(any_of(MAP_SEVERITY["high"]), "high")
            .when(any_of(MAP_SEVERITY["med"]), "med").otherwise("low"))


def severity_rank(severity: Column) -> Column:
    return (F.when(severity == "high", SEVERITY_RANK["high"])
            .when(severity == "med", SEVERITY_RANK["med"]).otherwise(SEVERITY_RANK["low"]))


def volume_band(count: Column) -> Column:
    chain = None
    for name, low in VOLUME_BANDS.items():
        chain = F.when(count >= low, name) if chain is None else chain.when(count >= low, name)
    return chain.otherwise("1-4")


def is_public_source(ip: Column) -> Column:
    return F.coalesce((F.length(ip) > 0) & ~ip.rlike(PRIVATE_SOURCE), F.lit(False))


def is_local_source(ip: Column) -> Column:
    return F.coalesce(ip.isin(LOCAL_SOURCES), F.lit(False)).cast("int")


def ipv4_number(ip: Column) -> Column:
    """Dotted address as a number; NULL when it is not an IPv4 address."""
    parts = F.split(ip, r"\.")

    def octet(i: int) -> Column:
        return F.get(parts, F.lit(i)).cast("bigint")

    number = octet(0) * 16777216 + octet(1) * 65536 + octet(2) * 256 + octet(3)
    return F.when(ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), number)
