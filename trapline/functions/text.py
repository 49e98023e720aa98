"""Text measures as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: command term families ------------------------------------
COMMAND_TERMS = {
    "contains_recon_cmds": ["ls", "pwd", "whoami", "uname", "id", "ifconfig"],
    "contains_install_cmds": ["wget", "curl", "apt", "yum", "pip", "scp"],
    "contains_nav_cmds": ["cd", "mkdir", "rm", "mv", "cp", "touch"],
    "contains_exit_cmd": ["exit", "logout", "quit"],
    "contains_persist_terms": ["crontab", "systemctl", "nohup"],
    "contains_exec_terms": ["./", "sh", "bash", "python"],
    "contains_kill_terms": ["kill", "killall", "pkill"],
    "contains_network_terms": ["ssh", "telnet", "nc", "nmap", "ping"],
}
EXPLORATORY_TERMS = {
    "contains_recon_cmds": [
        "ls", "pwd", "whoami", "uname", "id", "cat /etc/passwd", "hostname", "ifconfig",
        "ip a", "ip addr", "ip route", "netstat", "ss", "ps", "ps aux", "top", "free",
        "df", "uptime", "w", "last", "env", "printenv", "history", "cat /proc/cpuinfo",
        "cat /proc/meminfo"],
    "contains_install_cmds": [
        "wget", "curl", "apt", "apt-get", "yum", "pip", "scp", "ftp", "tftp", "dnf",
        "pip3", "git clone", "chmod +x", "tar", "unzip", "gunzip", "gzip"],
    "contains_nav_cmds": [
        "cd", "mkdir", "rm", "mv", "cp", "touch", "find", "locate", "tree", "du", "stat"],
    "contains_exit_cmd": ["exit", "logout", "quit"],
    "contains_persist_terms": [
        "crontab", "crontab -e", "systemctl", "service", "nohup", "screen", "tmux"],
    "contains_exec_terms": [
        "./bot", "./a.out", "sh", "bash", "python", "python3", "perl", "php", "node"],
    "contains_kill_terms": ["kill", "killall", "pkill"],
    "contains_network_terms": ["ssh", "telnet", "nc", "netcat", "nmap", "ping"],
}
# --- end of fixed values ----------------------------------------------------


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def shannon_entropy(text: Column) -> Column:
    """Bits per character over the whole text; 0 for NULL and empty text.

    A character is taken out of what the ones before it have left, so the text gets shorter with every pass.
    """
    zero = F.struct(text.alias("rest"), F.length(text).alias("left"), F.length(text).cast("double").alias("n"), F.lit(0.0).alias("bits"))

    def count(acc: Column, rest: Column) -> Column:
        left = F.length(rest)
        p = (acc["left"] - left) / acc["n"]
        return F.struct(rest.alias("rest"), left.alias("left"), acc["n"].alias("n"), (acc["bits"] - p * F.log2(p)).alias("bits"))

    def step(acc: Column, char: Column) -> Column:
        # The array holds what is left, so that it is made once.
        return F.transform(F.array(F.replace(acc["rest"], char, F.lit(""))), lambda rest: count(acc, rest))[0]

    bits = F.aggregate(F.array_distinct(F.split(text, "")), zero, step, lambda acc: acc["bits"])
    return F.when(F.length(text) > 0, bits).otherwise(0.0)


def password_metrics(password: Column) -> Column:
    """Six strength measures of the stripped password; all 0 when blank."""
    text = strip(password)
    filled = F.length(text) > 0
    per_char = shannon_entropy(text)
    length = F.when(filled, F.length(text)).otherwise(0).cast("double")
    unique = F.when(filled, F.size(F.array_distinct(F.split(text, "")))).otherwise(0).cast("double")
    total = per_char * length
    return F.struct(
        per_char.alias("entropy_per_char"),
        total.alias("entropy_total"),
        F.when(unique > 1, per_char / F.log2(unique)).otherwise(0.0).alias("normalized_entropy"),
        length.alias("length"),
        unique.alias("unique_chars"),
        (total + unique + length * 0.5).alias("total_strength"),
    )


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether any term occurs anywhere in the lower-cased text."""
    return F.lower(text).rlike("|".join(re.escape(t) for t in terms))


def command_text(*candidates: Column) -> Column:
    """First candidate that is not blank, trimmed.

    Pass arrays through ``joined`` first.
    """
    return F.coalesce(*[F.when(F.length(strip(c)) > 0, strip(c)) for c in candidates])


def joined(values: Column) -> Column:
    """Array as one text; NULL when empty. Missing items show as a dash."""
    shown = F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit("—")))
    return F.when(F.size(values) > 0, F.array_join(shown, ", "))


def control_share(text: Column) -> Column:
    """Share of control characters other than tab, LF and CR."""
    bad = F.length(F.array_join(F.regexp_extract_all(text, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]+"), F.lit(0)), ""))
    return F.when(F.length(text) > 0, bad / F.length(text)).otherwise(0.0)


def clean_label(label: Column) -> Column:
    """Repair mis-decoded dashes and doubled blanks in class labels."""
    dashed = F.replace(label, F.lit("�"), F.lit("-"))
    return F.replace(dashed, F.lit("  "), F.lit(" "))
