"""Placement plans: from labelled sessions to sensors per service.

Every function takes many plans at once, one per ``plan_id``. The six services
of a plan stay together in one row as arrays in a fixed order, so apportioning
needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.operators.lookup import latest_at, lookup_join
from trapline.schema import PLAN_SERVICES, SERVICES

# --- fixed values -----------------------------------------------------------
MIN_SESSIONS = 100
SESSION_WINDOW = 100
MIN_CONFIDENCE = 0.30
TOTAL_SENSORS = 12
BASE_PER_SERVICE = 1
FLEXIBLE_SLOTS = 6
SINGLE_INSTANCE = "ftp"

# Service that answers each profile; all others go to the shell sensors.
PROFILE_SERVICE = {
    "Brute Force Attack": "ssh",
    "Credential Stuffing": "ssh",
    "Low-Interaction SSH Probe": "ssh",
    "Interactive Attacker": "ssh",
    "Recon Scanner": "ssh",
    "Malware Downloader": "ssh",
    "File Exfiltration": "ssh",
    "Automated Bot": "ssh",
    "Web Scanner": "http",
    "FTP Abuse": "ftp",
    "Email Abuse": "smtp",
    "Database Recon": "mysql",
    "Database Attack": "mysql",
    "Redis Attack": "redis",
}
# --- end of fixed values ----------------------------------------------------


def profile_services(sessions: DataFrame) -> DataFrame:
    """Add the service of each profile; unmapped profiles drop out."""
    mapping = sessions.sparkSession.createDataFrame(
        list(PROFILE_SERVICE.items()), "profile string, service string")
    return sessions.join(F.broadcast(mapping), "profile", "inner")


def trusted(sessions: DataFrame, threshold: float = MIN_CONFIDENCE) -> DataFrame:
    """Sessions with enough confidence."""
    return sessions.filter(F.col("profile_confidence") >= threshold)


def latest_sessions(sessions: DataFrame, limit: int = SESSION_WINDOW) -> DataFrame:
    """Newest sessions of each plan (O05); an unknown start counts as newest.

    Spark keeps only the first rows per plan before it shuffles, so a plan
    with very many sessions stays cheap.
    """
    order = Window.partitionBy("plan_id").orderBy(
        F.desc_nulls_first("session_start"), "session_id")
    return (sessions.withColumn("_rn", F.row_number().over(order))
            .filter(F.col("_rn") <= limit).drop("_rn"))


def current_counts() -> list[Column]:
    """Mean running sensors per service, rounded half to even, at least 1."""
    return [
        F.greatest(F.coalesce(F.bround(F.avg(f"{s}_honeypot_count")), F.lit(1.0)), F.lit(1.0))
         .cast("int").alias(s)
        for s in PLAN_SERVICES
    ]


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def largest_remainder(weights: Column, slots: Column | int) -> Column:
    """Split slots by weight: floors first, leftovers to the largest fractions.

    Equal fractions go to the earlier service. All-zero weights leave nothing
    but leftovers, which the first services get.
    """
    slots = slots if isinstance(slots, Column) else F.lit(slots)
    raw = F.transform(weights, lambda w: w * slots)
    # -index breaks ties, so each entry is unique.
    fractions = F.transform(raw, lambda r, i: F.struct((r - F.floor(r)).alias("f"), (-i).alias("i")))
    left = slots - F.aggregate(
        raw, F.lit(0).cast("bigint"), lambda acc, r: acc + F.floor(r))

    def count(r: Column, i: Column) -> Column:
        mine = F.get(fractions, i)
        ahead = F.size(F.filter(fractions, lambda o: o > mine))
        return (F.floor(r) + F.when(ahead < left, 1).otherwise(0)).cast("int")

    return F.transform(raw, count)


def flexible_slots(demand: Column, slots: int = FLEXIBLE_SLOTS) -> Column:
    """Split the flexible slots by demand; without demand, evenly."""
    total = array_sum(demand)
    even, extra = divmod(slots, len(PLAN_SERVICES))
    share = F.transform(demand, lambda d: d / F.when(total > 0, total))
    uniform = F.transform(demand, lambda _, i: even + (i < extra).cast("int"))
    return F.when(total > 0, largest_remainder(share, slots)).otherwise(uniform)


def plan_headers(sessions: DataFrame, limit: int = SESSION_WINDOW) -> DataFrame:
    """One row per plan: sessions seen, selected, trusted, counts per service.

    Reads ``sessions`` twice, so pass a stored table.
    """
    totals = sessions.groupBy("plan_id").agg(F.count("*").alias("total_sessions"))
    mapping = F.create_map(*[F.lit(x) for kv in PROFILE_SERVICE.items() for x in kv])
    service = F.when(
        F.col("profile_confidence") >= MIN_CONFIDENCE, F.try_element_at(mapping, F.col("profile")))
    picked = latest_sessions(sessions, limit).withColumn("service", service)
    counted = picked.groupBy("plan_id").agg(
        F.count("*").alias("selected_sessions"),
        F.count("service").alias("trusted_sessions"),
        F.array(*[F.count_if(F.col("service") == s) for s in PLAN_SERVICES]).alias("raw"),
        F.array(*current_counts()).alias("current"))
    return counted.join(totals, "plan_id")


def with_demand(headers: DataFrame) -> DataFrame:
    """Sessions per running sensor of each service."""
    return headers.withColumn("demand", F.transform(
        "raw", lambda r, i: r / F.greatest(F.get("current", i), F.lit(1))))


def build_plans(sessions: DataFrame, limit: int = SESSION_WINDOW) -> DataFrame:
    """Recommended sensors per service and plan (D03 to D07), one row per plan.

    A plan on hold, for lack of sessions or of trusted ones, has zeros.
    """
    few = F.col("selected_sessions") < MIN_SESSIONS
    hold = few | (F.col("trusted_sessions") == 0)
    zeros = F.array(*[F.lit(0)] * len(PLAN_SERVICES))
    mapped = F.aggregate("raw", F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    plans = with_demand(plan_headers(sessions, limit)).withColumns({
        "hold": hold,
        "mapped_sessions": F.when(~hold, mapped),
        "counts": F.when(~hold, F.transform(
            flexible_slots(F.col("demand")), lambda n: n + BASE_PER_SERVICE)),
    })
    reason = (F.when(few, F.concat(
        F.lit("Only "), F.col("selected_sessions"), F.lit(" sessions selected; need at least "),
        F.lit(MIN_SESSIONS), F.lit(" before scaling.")))
        .when(hold, F.lit(f"No sessions met the minimum confidence threshold of {MIN_CONFIDENCE}.")))
    names = F.array(*[F.lit(f"{s}_honeypot") for s in PLAN_SERVICES])

    def line(name: Column, i: Column) -> Column:
        text = F.format_string(
            "%s: %d sessions / %d current honeypot = %.2f normalized demand ->%d honeypots",
            name, F.get("raw", i), F.get("current", i), F.get("demand", i), F.get("counts", i))
        return F.when(F.get("demand", i) > 0, text)

    lines = F.filter(F.transform(names, line), lambda r: r.isNotNull())
    return plans.select(
        "plan_id", F.when(hold, "hold").otherwise("recommend").alias("action"),
        "total_sessions", "selected_sessions", "trusted_sessions", "mapped_sessions", "current",
        F.when(hold, zeros.cast("array<bigint>")).otherwise(F.col("raw")).alias("raw"),
        F.when(hold, zeros.cast("array<double>")).otherwise(F.col("demand")).alias("demand"),
        F.coalesce("counts", zeros).alias("recommended"),
        F.when(hold, zeros.cast("array<double>")).otherwise(
            F.transform("raw", lambda r: F.bround(r / F.col("mapped_sessions"), 3))
        ).alias("distribution"),
        F.when(hold, 0).otherwise(TOTAL_SENSORS).alias("total_recommended"),
        F.when(hold, F.array(reason)).otherwise(lines).alias("reasons"))


def plan_table(plans: DataFrame) -> DataFrame:
    """Plans in long form: one row per plan and service, with demand share."""
    total = array_sum(F.col("demand"))
    rows = F.transform(
        F.array(*map(F.lit, PLAN_SERVICES)),
        lambda s, i: F.struct(
            s.alias("service"), F.get("raw", i).alias("raw"), F.get("current", i).alias("current"),
            F.get("demand", i).alias("demand"), F.get("recommended", i).alias("recommended"),
            F.get("distribution", i).alias("distribution"),
            F.when(total > 0, F.get("demand", i) / total).otherwise(0.0).alias("demand_share")))
    return plans.select("plan_id", "action", F.inline(rows))


def adapt_distribution(plans: DataFrame) -> DataFrame:
    """Plan weights for scaling: the single-instance share is spread evenly.

    Input ``weights`` is a map of service, with or without suffix, to weight;
    output ``weights`` an array in service order that sums to 1, or all 0.
    """
    def weight(service: str) -> Column:
        return F.coalesce(
            F.try_element_at("weights", F.lit(f"{service}_honeypot")),
            F.try_element_at("weights", F.lit(service)), F.lit(0.0))

    share = weight(SINGLE_INSTANCE) / (len(SERVICES) - 1)
    spread = F.array(*[
        F.lit(0.0) if s == SINGLE_INSTANCE else weight(s) + share for s in SERVICES])
    plans = plans.withColumn("weights", spread)
    total = array_sum(F.col("weights"))
    return plans.withColumn("weights", F.when(
        total > 0, F.transform("weights", lambda w: w / total)).otherwise(F.col("weights")))


def plan_weights(plans: DataFrame) -> DataFrame:
    """The distribution of each plan as a map of service to weight."""
    names = F.array(*[F.lit(f"{s}_honeypot") for s in PLAN_SERVICES])
    return plans.select("plan_id", F.map_from_arrays(names, "distribution").alias("weights"))


def allocate(
    plans: DataFrame, total: int | Column = TOTAL_SENSORS, base: int = BASE_PER_SERVICE
) -> tuple[DataFrame, DataFrame]:
    """Sensors per service from weights (D09): allocated plans, and impossible ones."""
    total = total if isinstance(total, Column) else F.lit(total)
    spare = total - base * len(SERVICES)
    marked = plans.withColumn("spare", spare)
    target = F.transform(largest_remainder(F.col("weights"), F.col("spare")), lambda n: n + base)
    good = marked.filter("spare >= 0").withColumn("target", target).drop("spare")
    bad = marked.filter("spare < 0").select(
        *plans.columns, F.lit("total is smaller than the base allocation").alias("error"))
    return good, bad


def target_table(allocated: DataFrame) -> DataFrame:
    """Allocated sensors in long form, single-instance services capped at one."""
    rows = F.transform(F.array(*map(F.lit, SERVICES)), lambda s, i: F.struct(
        s.alias("service"), F.get("target", i).alias("target"),
        F.when(s == SINGLE_INSTANCE, F.least(F.get("target", i), F.lit(1)))
         .otherwise(F.get("target", i)).alias("replicas")))
    return allocated.select("plan_id", F.inline(rows))


def redistribute(targets: DataFrame, state: DataFrame) -> DataFrame:
    """Sensors to start or stop per plan and service."""
    now = latest_state(state).select(
        F.col("honeypot_type").alias("service"), F.col("cnt").alias("running"))
    joined = lookup_join(targets, now, ["service"])
    running = F.coalesce("running", F.lit(0))
    return joined.select(
        "plan_id", "service", running.alias("current"), "target",
        (F.col("target") - running).alias("delta"))


def check_state(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable state reports, and rejected ones with the reason."""
    reason = (F.when(~F.coalesce(F.col("honeypot_type").isin(SERVICES), F.lit(False)), "unknown type")
              .when(F.coalesce(F.col("cnt"), F.lit(-1)) < 0, "negative count"))
    marked = reports.withColumn("reject_reason", reason)
    return (marked.filter("reject_reason IS NULL").drop("reject_reason"),
            marked.filter("reject_reason IS NOT NULL"))


def latest_state(reports: DataFrame) -> DataFrame:
    """Latest valid count of each service."""
    good, _ = check_state(reports)
    return good.groupBy("honeypot_type").agg(
        F.max(F.struct("updated_at", "cnt"))["cnt"].alias("cnt"),
        F.max("updated_at").alias("updated_at"))


def check_overrides(overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable overrides, and rejected ones with the reason.

    ``overrides`` has ``set_at, expires_at, weights`` (map of service to weight).
    A row without weights is a clear event: it ends the override before it.
    """
    known = F.array(*map(F.lit, SERVICES))
    reason = (F.when(F.exists(F.map_keys("weights"), lambda k: ~F.array_contains(known, k)), "unknown type")
              .when(F.exists(F.map_values("weights"), lambda v: v < 0), "negative weight")
              .when(array_sum(F.map_values("weights")) <= 0, "no positive total"))
    marked = overrides.withColumn("reject_reason", reason)
    return (marked.filter("reject_reason IS NULL").drop("reject_reason"),
            marked.filter("reject_reason IS NOT NULL"))


def effective_weights(moments: DataFrame, plans: DataFrame, overrides: DataFrame) -> DataFrame:
    """Weights in force at each moment (J12): override, else plan, else uniform.

    ``moments`` has ``moment, plan_id``; ``plans`` has adapted ``weights``. A
    new override replaces an earlier one for good, even if that would still
    hold when the new one ends; a clear event ends it without another.
    """
    good, _ = check_overrides(overrides)
    known = adapt_distribution(good.filter("weights IS NOT NULL")).select("set_at", "expires_at", F.col("weights").alias("override_weights"))
    cleared = good.filter("weights IS NULL").select("set_at", "expires_at")
    events = known.unionByName(cleared, allowMissingColumns=True)
    planned = plans.select("plan_id", F.col("weights").alias("plan_weights"))
    out = latest_at(moments, events, [], "moment", "set_at", ["expires_at", "override_weights"])
    over = F.coalesce(F.col("moment") >= F.col("expires_at"), F.lit(False))
    out = out.withColumn("override_weights", F.when(~over, F.col("override_weights")))
    out = lookup_join(out, planned, ["plan_id"])
    uniform = F.array(*[F.lit(1.0 / len(SERVICES))] * len(SERVICES))
    source = (F.when(F.col("override_weights").isNotNull(), "override")
              .when(F.col("plan_weights").isNotNull(), "plan").otherwise("uniform"))
    return out.select(
        "moment", "plan_id", source.alias("origin"),
        F.coalesce("override_weights", "plan_weights", uniform).alias("weights"))


def refresh_plans(sessions: DataFrame, asof: Column, overrides: DataFrame | None = None) -> DataFrame:
    """Plans from the sessions known at ``asof``.

    Running it again for the same moment gives the same plans. While an
    override holds, it gives none.
    """
    known = sessions.filter(F.col("session_start") <= asof)
    if overrides is not None:
        good, _ = check_overrides(overrides)
        # A new override replaces the one before; one without an end holds until it is replaced or cleared.
        state = F.struct("expires_at", F.col("weights").isNotNull().alias("set"))
        newest = good.filter(F.col("set_at") <= asof).agg(F.max_by(state, "set_at").alias("o"))
        holds = F.coalesce("o.set", F.lit(False)) & F.coalesce(F.col("o.expires_at") > asof, F.lit(True))
        held = newest.select(holds).scalar()
        known = known.filter(~held)
    return build_plans(known).withColumn("asof", asof)
