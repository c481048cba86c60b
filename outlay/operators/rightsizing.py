"""Container request recommendations from usage percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay import fixed
from outlay.functions.money import fmt_percent, price, round_up, rounded
from outlay.functions.template import fill

CPU_STEP_M = 50
MEM_STEP_MI = 32
KEYS = ["namespace", "workload", "container"]


def monthly_cost(cpu_m: Column, mem_mi: Column, replicas: Column, prices: dict) -> Column:
    cpu = cpu_m / 1000.0 * price(prices, "kubernetes", "vcpu_hour")
    mem = mem_mi / 1024.0 * price(prices, "kubernetes", "gb_hour")
    return (cpu + mem) * replicas * fixed.HOURS_PER_MONTH


def _change(rec: Column, cur: Column) -> Column:
    """Relative change; a container without a request changes by 100 %."""
    return F.when(cur == 0, 1.0).otherwise(F.try_divide((rec - cur).cast("double"), cur.cast("double")))


def recommend(
    usage: DataFrame,
    prices: dict,
    cpu_headroom: float = 0.30,
    mem_headroom: float = 0.20,
    cpu_limits: str = "none",
    min_change_pct: float = 0.15,
    veto_downward: bool = False,
) -> DataFrame:
    """One recommendation per usage row; a narrow projection without shuffle.

    OOM kills or throttling switch the basis to the tail percentiles.  ``veto_downward`` also
    keeps such containers from shrinking.
    """
    oom = F.coalesce("oom_kills_14d", F.lit(0))
    throttled = F.coalesce("throttled_ratio_p95", F.lit(0.0))
    mem_max = F.coalesce("mem_max_mi", "mem_p99_mi")
    df = usage.select(
        "*",
        oom.alias("_oom"),
        throttled.alias("_throttled"),
        ((oom > 0) | (throttled > 0.25)).alias("_unsafe"),
        F.col("cpu_request_m").cast("int").alias("_cpu"),
        F.col("mem_request_mi").cast("int").alias("_mem"),
    )
    unsafe, cur_cpu, cur_mem = F.col("_unsafe"), F.col("_cpu"), F.col("_mem")
    cpu_basis = F.when(unsafe, F.greatest("cpu_p99_m", "cpu_p95_m")).otherwise(F.col("cpu_p95_m"))
    mem_basis = F.when(unsafe, F.greatest(mem_max, F.col("mem_p99_mi"))).otherwise(F.col("mem_p99_mi"))
    sized_cpu = round_up(cpu_basis * (1 + cpu_headroom), CPU_STEP_M)
    sized_mem = round_up(mem_basis * (1 + mem_headroom), MEM_STEP_MI)
    if veto_downward:
        sized_cpu = F.when(unsafe, F.greatest(sized_cpu, cur_cpu)).otherwise(sized_cpu)
        sized_mem = F.when(unsafe, F.greatest(sized_mem, cur_mem)).otherwise(sized_mem)
    df = df.withColumns({"_rc": sized_cpu, "_rm": sized_mem})
    rc, rm, replicas = F.col("_rc"), F.col("_rm"), F.col("replicas")
    within = (F.abs(_change(rc, cur_cpu)) < min_change_pct) & (F.abs(_change(rm, cur_mem)) < min_change_pct)
    cheaper = monthly_cost(rc, rm, replicas, prices) < monthly_cost(cur_cpu, cur_mem, replicas, prices)
    limit = F.lit(None).cast("int")
    if cpu_limits != "none":
        limit = round_up(F.greatest(F.col("cpu_p99_m") * 2, (rc * 2).cast("double")), CPU_STEP_M)
    df = df.withColumns(
        {
            "status": F.when(unsafe, "under").when(within, "ok").when(cheaper, "over").otherwise("under"),
            "rec_cpu_limit_m": limit,
            "_mixed": ~unsafe & ~within & ((rc > cur_cpu) != (rm > cur_mem)),
        }
    )
    ok = F.col("status") == "ok"
    kind = F.coalesce("kind", F.lit("Deployment"))
    df = df.withColumns(
        {
            "rec_cpu_request_m": F.when(ok, cur_cpu).otherwise(rc),
            "rec_mem_request_mi": F.when(ok, cur_mem).otherwise(rm),
            "rec_mem_limit_mi": F.when(ok, F.coalesce(F.col("mem_limit_mi").cast("int"), cur_mem)).otherwise(rm),
            "kind": kind,
        }
    )
    rec_cpu, rec_mem = F.col("rec_cpu_request_m"), F.col("rec_mem_request_mi")
    delta = monthly_cost(rec_cpu, rec_mem, replicas, prices) - monthly_cost(cur_cpu, cur_mem, replicas, prices)
    notes = F.array_compact(
        F.array(
            F.when(F.col("_oom") > 0, fill(fixed.NOTE_OOM, n=F.col("_oom").cast("int"))),
            F.when(F.col("_throttled") > 0.25, fill(fixed.NOTE_THROTTLED, pct=fmt_percent(F.col("_throttled")))),
            F.when(ok, F.lit(fixed.NOTE_WITHIN)),
            F.when(F.col("_mixed"), F.lit(fixed.NOTE_MIXED)),
            F.when(F.col("kind") == "CronJob", F.lit(fixed.NOTE_BATCH)),
            F.when(F.col("kind") == "DaemonSet", F.lit(fixed.NOTE_DAEMON)),
        )
    )
    return df.select(
        "namespace",
        "workload",
        "kind",
        "container",
        replicas.cast("int").alias("replicas"),
        cur_cpu.alias("current_cpu_request_m"),
        cur_mem.alias("current_mem_request_mi"),
        "cpu_p95_m",
        "cpu_p99_m",
        "mem_p99_mi",
        "rec_cpu_request_m",
        "rec_cpu_limit_m",
        "rec_mem_request_mi",
        "rec_mem_limit_mi",
        "status",
        rounded(delta).alias("monthly_delta_estimate"),
        notes.alias("notes"),
    )


def with_deltas(recs: DataFrame) -> DataFrame:
    """Requested cores and GiB that a recommendation adds or releases over all replicas."""
    return recs.withColumns(
        {
            "cpu_delta_cores": (F.col("rec_cpu_request_m") - F.col("current_cpu_request_m")) * F.col("replicas") / 1000.0,
            "mem_delta_gib": (F.col("rec_mem_request_mi") - F.col("current_mem_request_mi")) * F.col("replicas") / 1024.0,
        }
    )


def attach_vpa(recs: DataFrame, vpa: DataFrame) -> DataFrame:
    """Autoscaler targets next to the recommendations, with a note on large CPU gaps.

    Of several targets for one container the one with the largest ``seq`` counts.
    """
    latest = vpa.groupBy(*KEYS).agg(
        F.max_by("target_cpu_m", "seq").cast("int").alias("vpa_target_cpu_m"),
        F.max_by("target_mem_mi", "seq").cast("int").alias("vpa_target_mem_mi"),
    )
    joined = recs.join(latest, KEYS, "left")
    target = F.col("vpa_target_cpu_m")
    gap = F.abs(F.col("rec_cpu_request_m") - target) / F.greatest(target, F.lit(1)).cast("double")
    note = fill(fixed.NOTE_VPA, pct=fmt_percent(gap))
    return joined.withColumn("notes", F.when(gap > 0.5, F.array_append("notes", note)).otherwise(F.col("notes")))


def status_rank(status: Column) -> Column:
    return F.when(status == "under", 0).when(status == "over", 1).otherwise(2)


def sort_recommendations(recs: DataFrame) -> DataFrame:
    return recs.orderBy(status_rank(F.col("status")), F.col("monthly_delta_estimate"))


def summary(recs: DataFrame) -> DataFrame:
    """Counts by status, releasable requests and the cost of both directions."""
    cores_m = (F.col("rec_cpu_request_m") - F.col("current_cpu_request_m")).cast("bigint") * F.col("replicas")
    mem_mi = (F.col("rec_mem_request_mi") - F.col("current_mem_request_mi")).cast("bigint") * F.col("replicas")
    cents = F.col("monthly_delta_estimate").cast("decimal(18,2)")

    def total(cond: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(0))

    return recs.agg(
        F.count(F.lit(1)).alias("containers"),
        F.count_if(F.col("status") == "over").alias("over"),
        F.count_if(F.col("status") == "under").alias("under"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        rounded(total(cores_m < 0, -cores_m) / 1000.0).alias("releasable_cores"),
        rounded(total(mem_mi < 0, -mem_mi) / 1024.0).alias("releasable_gib"),
        total(cents < 0, -cents).cast("double").alias("monthly_reduction"),
        total(cents > 0, cents).cast("double").alias("monthly_increase"),
    )


def patch_docs(recs: DataFrame) -> DataFrame:
    """One merge-patch document per workload with containers to change, as JSON text."""
    resources = F.struct(
        F.struct(
            F.concat("rec_cpu_request_m", F.lit("m")).alias("cpu"), F.concat("rec_mem_request_mi", F.lit("Mi")).alias("memory")
        ).alias("requests"),
        F.struct(
            F.concat("rec_mem_limit_mi", F.lit("Mi")).alias("memory"), F.concat("rec_cpu_limit_m", F.lit("m")).alias("cpu")
        ).alias("limits"),
    )
    grouped = (
        recs.filter(F.col("status") != "ok")
        .groupBy("namespace", "workload")
        .agg(
            F.min("kind").alias("kind"),
            # A workload has a handful of containers.
            F.sort_array(F.collect_list(F.struct(F.col("container").alias("name"), resources.alias("resources")))).alias("containers"),
        )
    )
    cron = F.col("kind") == "CronJob"
    template = F.struct(F.struct(F.col("containers")).alias("spec"))
    spec = F.struct(
        F.when(cron, F.struct(F.struct(template.alias("template")).alias("spec"))).alias("jobTemplate"),
        F.when(~cron, template).alias("template"),
    )
    doc = F.struct(
        F.when(cron, "batch/v1").otherwise("apps/v1").alias("apiVersion"),
        "kind",
        F.struct(F.col("workload").alias("name"), F.col("namespace").alias("namespace")).alias("metadata"),
        spec.alias("spec"),
    )
    return grouped.select("namespace", "workload", F.to_json(doc).alias("patch"))


def quota_sizing(recs: DataFrame, quotas: DataFrame | None = None, headroom: float = 0.30) -> DataFrame:
    """Namespace quota from recommended requests plus headroom, with breaches of the current one."""
    replicas = F.col("replicas").cast("bigint")
    sized = recs.groupBy("namespace").agg(
        F.sum(F.col("rec_cpu_request_m") * replicas).alias("recommended_cpu_m"),
        F.sum(F.col("rec_mem_request_mi") * replicas).alias("recommended_mem_mi"),
    )
    for name in ("cpu_m", "mem_mi"):
        need = F.col(f"recommended_{name}") * (1 + headroom)
        sized = sized.withColumn(f"sized_{name}", F.ceil(F.round(need.cast("decimal(38,6)"), 6)).cast("bigint"))
    if quotas is None:
        return sized
    joined = sized.join(quotas, "namespace", "left")
    return joined.withColumn(
        "breach",
        F.coalesce(
            (F.col("sized_cpu_m") > F.col("quota_cpu_m")) | (F.col("sized_mem_mi") > F.col("quota_mem_mi")), F.lit(False)
        ),
    )


def conformance(specs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Declared container resources against the default, minimum and maximum of the namespace."""
    joined = specs.join(ranges, "namespace", "left")
    cpu = F.coalesce("cpu_request_m", "default_cpu_m")
    mem = F.coalesce("mem_request_mi", "default_mem_mi")
    limit = F.coalesce("mem_limit_mi", "default_limit_mem_mi")

    def known(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False))

    return joined.select(
        *KEYS,
        cpu.alias("effective_cpu_m"),
        mem.alias("effective_mem_mi"),
        limit.alias("effective_limit_mem_mi"),
        known(cpu < F.col("min_cpu_m")).alias("cpu_below_min"),
        known(cpu > F.col("max_cpu_m")).alias("cpu_above_max"),
        known(mem < F.col("min_mem_mi")).alias("mem_below_min"),
        known(limit > F.col("max_mem_mi")).alias("mem_above_max"),
        known(F.try_divide(limit.cast("double"), mem.cast("double")) > F.col("max_mem_limit_ratio")).alias("ratio_exceeded"),
    )
