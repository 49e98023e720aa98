"""Attacker profiles: weighted evidence per session, as one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Signal:
    """Evidence for one profile.

    Earns ``weight * min(value / full, 1)``; ``value=None`` earns the weight
    outright. A signal whose condition fails counts neither way.
    """

    profile: str
    reason: str
    value: str | None = None
    full: float = 1.0
    weight: float = 1.0
    when: str | None = None


# --- fixed values: the evidence table, in tie-breaking order ------------------
NO_COMMANDS = "ssh_events > 0 AND cmd_count = 0"
SIGNALS = [
    Signal("Brute Force Attack", "Many failed logins", "login_fail", 20),
    Signal("Brute Force Attack", "Many unique passwords", "unique_pass", 20),
    Signal("Brute Force Attack", "High failed-login rate", "fails_per_min", 20),
    Signal("Credential Stuffing", "Many unique usernames", "unique_users", 10),
    Signal("Credential Stuffing", "Many unique passwords", "unique_pass", 10),
    Signal("Credential Stuffing", "Repeated failed logins", "login_fail", 20),
    Signal("Interactive Attacker", "High command activity", "cmd_count", 10),
    Signal("Interactive Attacker", "Multiple unique commands", "unique_cmds", 5),
    Signal("Interactive Attacker", "Longer session duration", "duration", 300),
    Signal("Interactive Attacker", "Successful authentication", "login_success"),
    Signal("Interactive Attacker", "Anomalous interactive session", weight=0.25,
           when="is_anomaly AND (cmd_count > 0 OR login_success > 0)"),
    Signal("Recon Scanner", "Multiple services touched", "services_touched", 4),
    Signal("Recon Scanner", "Elevated event count", "event_count", 20),
    Signal("Recon Scanner", "Recon command observed", when="contains_recon_cmds <> 0"),
    Signal("Recon Scanner", "Network probing command observed", weight=0.5,
           when="contains_network_terms <> 0"),
    Signal("Recon Scanner", "Filesystem navigation command observed", weight=0.25,
           when="contains_nav_cmds <> 0"),
    Signal("Web Scanner", "HTTP activity", "http_events", 10),
    Signal("Web Scanner", "HTTP page visits", "http_page_visits", 10),
    Signal("Web Scanner", "HTTP login attempts", "http_login_attempts", 10),
    Signal("Malware Downloader", "File download observed", "downloads"),
    Signal("Malware Downloader", "Download-heavy session", "download_ratio"),
    Signal("Malware Downloader", "Install/download command observed",
           when="contains_install_cmds <> 0"),
    Signal("Malware Downloader", "Downloaded file may have been executed", weight=0.5,
           when="contains_exec_terms <> 0 AND downloads > 0"),
    Signal("File Exfiltration", "File upload observed", "uploads"),
    Signal("File Exfiltration", "Upload-heavy session", "upload_ratio"),
    Signal("File Exfiltration", "High file-transfer share", "file_transfer_ratio", 0.5, 0.5),
    Signal("FTP Abuse", "FTP activity", "ftp_events", 5),
    Signal("FTP Abuse", "FTP-dominant session", "ftp_ratio"),
    Signal("FTP Abuse", "FTP connection attempts", "ftp_connects", 5),
    Signal("FTP Abuse", "High FTP connection churn", "ftp_connects / greatest(ftp_disconnects, 1)",
           5, 0.5, "ftp_connects > 0 AND ftp_disconnects > 0"),
    Signal("Email Abuse", "SMTP activity", "smtp_events", 5),
    Signal("Email Abuse", "SMTP-dominant session", "smtp_ratio"),
    Signal("Email Abuse", "SMTP connection attempts", "smtp_connects", 5),
    Signal("Email Abuse", "SMTP EHLO probing", "smtp_ehlo_count", 5),
    Signal("Database Recon", "MySQL activity", "mysql_events", 5),
    Signal("Database Attack", "MySQL queries", "mysql_queries", 10),
    Signal("Database Attack", "Anomalous MySQL activity", weight=0.5,
           when="is_anomaly AND mysql_queries > 0"),
    Signal("Redis Attack", "Redis activity", "redis_events", 5),
    Signal("Redis Attack", "Redis commands", "redis_commands", 10),
    Signal("Redis Attack", "Redis-dominant session", "redis_ratio"),
    Signal("Redis Attack", "Anomalous Redis activity", weight=0.5,
           when="is_anomaly AND redis_commands > 0"),
    Signal("Automated Bot", "High event rate", "events_per_min", 100, when="event_count >= 10"),
    Signal("Automated Bot", "High command rate", "cmds_per_min", 20, when="cmd_count >= 5"),
    Signal("Low-Interaction SSH Probe", "SSH-dominant session", "ssh_ratio", when="ssh_events > 0"),
    Signal("Low-Interaction SSH Probe", "Successful login without commands", weight=0.75,
           when=f"{NO_COMMANDS} AND login_success > 0"),
    Signal("Low-Interaction SSH Probe", "Short low-activity session", weight=0.5,
           when=f"{NO_COMMANDS} AND event_count <= 5"),
    Signal("Low-Interaction SSH Probe", "Few event types", weight=0.25,
           when=f"{NO_COMMANDS} AND unique_event_types <= 4"),
]
DEFAULT_REASON = "Low-confidence evidence"
UNKNOWN_PROFILE = "Unknown"
MAX_REASONS = 3
# --- end of fixed values ----------------------------------------------------

PROFILES = list(dict.fromkeys(s.profile for s in SIGNALS))

# Columns the table reads; a missing one reads as 0.
INPUTS = [
    "login_fail", "unique_users", "unique_pass", "event_count", "cmd_count", "unique_cmds",
    "fails_per_min", "duration", "login_success", "services_touched", "contains_recon_cmds",
    "contains_network_terms", "contains_nav_cmds", "contains_install_cmds",
    "contains_exec_terms", "http_events", "http_page_visits", "http_login_attempts",
    "downloads", "download_ratio", "uploads", "upload_ratio", "file_transfer_ratio",
    "ftp_events", "ftp_ratio", "ftp_connects", "ftp_disconnects", "smtp_events", "smtp_ratio",
    "smtp_connects", "smtp_ehlo_count", "mysql_events", "mysql_queries", "redis_events",
    "redis_commands", "redis_ratio", "events_per_min", "cmds_per_min", "ssh_events",
    "ssh_ratio", "unique_event_types",
]


def _evidence(rank: int, profile: str) -> str:
    """SQL for confidence, rank and reasons of one profile."""
    score, most, reasons = [], [], []
    for s in (s for s in SIGNALS if s.profile == profile):
        applies = s.when or "true"
        share = f"least(double({s.value}) / {float(s.full)}D, 1D)" if s.value else "1D"
        amount = f"if({applies}, {share} * {s.weight}D, 0D)"
        score.append(f"greatest({amount}, 0D)")
        most.append(f"if({applies}, {s.weight}D, 0D)")
        reasons.append(f"if({amount} > 0, '{s.reason}', null)")
    total, full = " + ".join(score), " + ".join(most)
    return (f"named_struct('confidence', nvl(bround(try_divide({total}, {full}), 3), 0D), "
            f"'rank', -{rank}, 'profile', '{profile}', "
            f"'reasons', filter(array({', '.join(reasons)}), r -> r is not null))")


def score_profiles(features: DataFrame) -> DataFrame:
    """Add ``evidence``: confidence, rank and reasons of every profile."""
    missing = {c: F.lit(0) for c in INPUTS if c not in features.columns}
    if "is_anomaly" not in features.columns:
        missing["is_anomaly"] = F.lit(False)
    ready = features.withColumns(missing) if missing else features
    entries = [_evidence(i, p) for i, p in enumerate(PROFILES)]
    scored = ready.withColumn("evidence", F.expr(f"array({', '.join(entries)})"))
    return scored.drop(*[c for c in missing if c != "is_anomaly"])


def label_profiles(features: DataFrame) -> DataFrame:
    """Best profile, confidence, all scores and up to three reasons."""
    top = F.array_max("evidence")
    names = F.array(*[F.lit(p) for p in [*PROFILES, UNKNOWN_PROFILE]])
    scores = F.map_from_arrays(names, F.concat(
        F.transform("evidence", lambda e: e["confidence"]),
        F.array(F.bround(1.0 - top["confidence"], 3))))
    reasons = F.when(F.size(top["reasons"]) > 0, F.slice(top["reasons"], 1, MAX_REASONS))
    return score_profiles(features).withColumns({
        "profile": top["profile"],
        "profile_confidence": top["confidence"],
        "profile_reasons": F.coalesce(reasons, F.array(F.lit(DEFAULT_REASON))),
        "profile_scores": scores,
    }).drop("evidence")
