"""Relations of the cost domain as projections of the stored tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay import fixed

AS_OF = dt.date(2000, 6, 24)
NOW = dt.datetime(2000, 6, 24, 2, 0, 0)
NOW_SQL = "timestamp_ntz'2000-06-24 02:00:00'"
# The metric, cache and log tables come from `events`, which covers January 2024.
METRIC_NOW = dt.datetime(2024, 1, 31, 0, 0, 0)


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ billing
_SERVICE = """case when l_partkey % 6 <= 1 then 'Compute Engine'
    when l_partkey % 6 = 2 then 'Kubernetes Engine'
    when l_partkey % 6 = 3 then 'Cloud Storage'
    when l_partkey % 6 = 4 then 'BigQuery'
    else 'Networking' end"""

_COMPUTE_SKUS = [
    "N2 Instance Core running in Americas",
    "N2 Instance Ram running in Americas",
    "Spot Preemptible N2 Instance Core",
    "Commitment v1: Cpu in Americas for 1 Year",
    "Storage PD Capacity",
    "Hyperdisk Balanced Capacity",
    "Network Internet Egress from Americas to EMEA",
    "SSD backed PD Capacity",
]
_NETWORK_SKUS = [
    "Network Internet Egress to China",
    "Network Inter-Region Egress",
    "Network Inter Zone Egress",
    "Cloud CDN Cache Egress",
    "Hybrid Interconnect Egress",
    "VPN Tunnel Egress",
    "Generic Egress",
    "External IP Charge",
]


def _pick(index: str, names: list[str]) -> str:
    return "element_at(array(" + ",".join(f"'{n}'" for n in names) + f"), cast({index} as int) + 1)"


_SKU = f"""case when l_partkey % 6 <= 1 then {_pick('(l_partkey div 6) % 8', _COMPUTE_SKUS)}
    when l_partkey % 6 = 2 then if((l_partkey div 6) % 2 = 0, 'Autopilot Pod mCPU Requests', 'Autopilot Spot Pod Memory Requests')
    when l_partkey % 6 = 3 then if((l_partkey div 6) % 2 = 0, 'Standard Storage Asia', 'Download Egress to Australia')
    when l_partkey % 6 = 4 then if((l_partkey div 6) % 2 = 0, 'Analysis', 'Active Logical Storage')
    else {_pick('(l_partkey div 6) % 8', _NETWORK_SKUS)} end"""

_REGION = _pick("l_suppkey % 3", ["us-east1", "asia-south1", "europe-west1"])
_CREDIT_TYPE = _pick(
    "l_partkey % 5",
    ["COMMITTED_USAGE_DISCOUNT", "COMMITTED_USAGE_DISCOUNT_DOLLAR_BASE", "PROMOTION", "FREE_TIER", "COMMITTED_USAGE_DISCOUNT"],
)
_TAX_CREDIT_TYPE = _pick(
    "l_linenumber % 4",
    ["SUSTAINED_USAGE_DISCOUNT", "SPENDING_BASED_DISCOUNT", "SUSTAINED_USAGE_DISCOUNT", "RESELLER_MARGIN"],
)


def _labels(*entries: tuple[str, str, str]) -> str:
    """Array of the label structs whose condition holds.

    ``array_compact`` keeps the projection out of whole-stage code, whose single method would be too long to be compiled.
    """
    structs = [f"if({cond}, named_struct('key','{key}','value',{value}), null)" for key, value, cond in entries]
    return f"array_compact(array({','.join(structs)}))"


# Prices with a tail far below a hundredth, as a detailed export has them.
_COST = "cast(cast(l_extendedprice as decimal(18,4)) + (l_orderkey % 9) * 0.0000137BD as decimal(28,10))"


def _credit(name: str) -> str:
    """Credit struct over the columns ``<name>_type`` and ``<name>_amount``."""
    kind = f"{name}_type"
    return f"named_struct('name', {kind}, 'full_name', {kind}, 'id', {kind}, 'type', {kind}, 'amount', {name}_amount)"


def _amount(rate: str) -> str:
    return f"cast(-(list_cost * cast({rate} as decimal(4,2))) as decimal(28,10))"


# Every fourth order has its first credit split into five entries of one type, four of them tiny.
_SPLIT = "cud_amount is not null and l_orderkey % 4 = 0"
_TINY = _credit("cud").replace("cud_amount)", "cast(-0.00004 as decimal(28,10)))")


def billing_lines(lineitem: DataFrame, hourly: bool = False) -> DataFrame:
    """One billing line per stored line.

    ``hourly`` spreads the lines over the hours of their day; without it the usage start is the
    stored day itself and date bounds become Parquet filters.
    """
    start = "l_shipdate"
    if hourly:
        start = "l_shipdate + make_dt_interval(0, cast(l_orderkey % 24 as int))"
    on_cluster = "l_partkey % 6 <= 2 and l_orderkey % 3 <> 0"
    # Scalars first, then single credits: the JVM compiles no method beyond 8000 bytes of code, so nothing is spelled out twice.
    scalars = lineitem.selectExpr(
        "*",
        f"{_SERVICE} as service_name",
        f"{_SKU} as sku_name",
        f"{_REGION} as region_name",
        f"{_COST} as list_cost",
        f"{_CREDIT_TYPE} as cud_type",
        f"{_TAX_CREDIT_TYPE} as sud_type",
    )
    scalars = scalars.selectExpr(
        "*",
        f"if(l_discount > 0, {_amount('l_discount')}, null) as cud_amount",
        f"if(l_tax > 0, {_amount('l_tax')}, null) as sud_amount",
    )
    scalars = scalars.withColumn("cud_amount_left", F.expr(f"if({_SPLIT}, cast(cud_amount + 0.00016BD as decimal(28,10)), cud_amount)"))
    entries = scalars.selectExpr(
        "*",
        f"{_TINY} as tiny",
        f"{_credit('cud').replace('cud_amount)', 'cud_amount_left)')} as cud",
        f"{_credit('sud')} as sud",
    )
    return entries.selectExpr(
        "cast(date_add(to_date(l_shipdate), l_linenumber % 4) as date) as ingest_date",
        f"{start} as usage_start_time",
        f"{start} + interval 1 hour as usage_end_time",
        f"{start} + make_dt_interval(l_linenumber % 4, 6) as export_time",
        "named_struct('month', date_format(l_shipdate, 'yyyyMM')) as invoice",
        "named_struct('id', if(l_suppkey % 20 = 0, null, concat('proj-', l_suppkey % 20)),"
        " 'name', concat('Project ', l_suppkey % 20), 'number', cast(l_suppkey % 20 as string), 'labels', "
        + _labels(
            ("env", _pick("l_suppkey % 4", ["none", "prod", "uat", "dev"]), "l_suppkey % 4 > 0"),
            ("team", "concat('team-', l_suppkey % 5)", "l_suppkey % 5 > 0"),
            ("cost-center", "concat('cc-100', l_suppkey % 3)", "l_suppkey % 3 > 0"),
        )
        + ") as project",
        _labels(
            ("env", "'dev'", "l_partkey % 3 = 0"),
            ("team", "'team-shared'", "l_partkey % 4 = 0"),
            ("team", "'team-second'", "l_partkey % 4 = 0"),
            ("app", "concat('app-', l_partkey % 7)", "l_partkey % 2 = 0"),
            ("goog-k8s-cluster-name", "concat('gke-', l_suppkey % 4)", on_cluster),
            ("k8s-namespace", "concat('ns-', l_orderkey % 6)", f"{on_cluster} and l_orderkey % 5 <> 0"),
        )
        + " as labels",
        _labels(
            (
                "compute.googleapis.com/machine_spec",
                "element_at(array('n2-standard-4','e2-standard-2','c2-standard-8'), cast(l_partkey % 3 as int) + 1)",
                "l_partkey % 6 <= 1 and l_linenumber % 4 <> 0",
            ),
        )
        + " as system_labels",
        "named_struct('name', concat(if((l_partkey div 6) % 8 in (4,5,7), 'disk-', 'vm-'), l_partkey),"
        " 'global_name', concat('//compute.googleapis.com/projects/p/zones/z/',"
        " if((l_partkey div 6) % 8 in (4,5,7), 'disks/disk-', 'instances/vm-'), l_partkey)) as resource",
        "named_struct('description', service_name) as service",
        "named_struct('id', concat(l_partkey % 6, '-', (l_partkey div 6) % 8), 'description', sku_name) as sku",
        "named_struct('region', region_name, 'zone', concat(region_name, if(l_partkey % 2 = 0, '-a', '-b'))) as location",
        "list_cost as cost",
        # Up to six credits.
        f"case when {_SPLIT} then if(sud_amount is not null, array(tiny, tiny, tiny, tiny, cud, sud), array(tiny, tiny, tiny, tiny, cud))"
        " when cud_amount is not null and sud_amount is not null then array(cud, sud)"
        " when cud_amount is not null then array(cud) when sud_amount is not null then array(sud) end as credits",
        "if(l_linenumber = 7, 'tax', 'regular') as cost_type",
        "named_struct('amount', l_quantity * 3600, 'unit', 'seconds', 'amount_in_pricing_units', l_quantity,"
        " 'pricing_unit', if(l_partkey % 6 = 5 or (l_partkey div 6) % 8 = 6, 'gibibyte', 'hour')) as usage",
        "'USD' as currency",
        "1.0D as currency_conversion_rate",
        "list_cost as cost_at_list",
        "named_struct('effective_price', l_extendedprice) as price",
    )


def billing(spark: SparkSession, sf_dir: str, hourly: bool = False) -> DataFrame:
    return billing_lines(stored(spark, sf_dir, "lineitem"), hourly)


def disk_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of asset documents: one per stored line, disks and instances.

    The payload is JSON text; `users` is present only on versions returned with flag A.
    """
    return (
        stored(spark, sf_dir, "lineitem")
        .selectExpr(
            "concat('//compute.googleapis.com/projects/p/zones/z/',"
            " if((l_partkey div 6) % 8 in (4,5,7), 'disks/disk-', 'instances/vm-'), l_partkey) as name",
            # A whole number of seconds per version keeps the update times of one disk apart.
            "l_shipdate + make_dt_interval(0, 0, 0, cast((l_orderkey * 8 + l_linenumber) % 86400 as int)) as update_time",
            "named_struct('data', concat('{',"
            " if(l_returnflag = 'A', '\"users\":[\"vm-1\",\"vm-2\"],', if(l_returnflag = 'N', '\"users\":[],', '')),"
            " '\"labels\":{', if(l_linenumber = 1, '\"keep\":\"true\"', if(l_linenumber = 2, '\"keep\":\"no\"', '')), '}',"
            " if(l_linenumber = 3, '', concat(',\"lastDetachTimestamp\":\"', date_format(l_shipdate, 'yyyy-MM-dd'), 'T06:30:00Z\"')),"
            " '}')) as resource",
        )
    )


# ------------------------------------------------------------------ inventory
def _keep(key: str, other: str = "") -> str:
    parts = [f"if({key} % 11 = 0, map('keep', if({key} % 2 = 0, 'true', 'True')), map())", f"map('team', concat('t', {key} % 5))"]
    if other:
        parts.append(other)
    return "cast(map_concat(" + ",".join(parts) + ") as map<string,string>)"


def disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "part").selectExpr(
        "concat('disk-', p_partkey) as name",
        "concat('zone-', p_partkey % 3) as zone",
        _pick("p_partkey % 4", ["pd-standard", "pd-balanced", "pd-ssd", "pd-extreme"]) + " as type",
        "p_size * 10 as size_gb",
        "case when p_partkey % 3 = 0 then array('vm-1') when p_partkey % 3 = 1 then cast(array() as array<string>) end as users",
        _keep("p_partkey") + " as labels",
        f"if(p_partkey % 2 = 0, null, {NOW_SQL} - make_dt_interval(cast(p_partkey % 90 as int), 5)) as last_attach_timestamp",
        f"if(p_partkey % 5 < 2, null, {NOW_SQL} - make_dt_interval(cast(p_partkey % 80 as int), 7)) as last_detach_timestamp",
        f"{NOW_SQL} - make_dt_interval(cast(p_partkey % 200 as int), 1) as creation_timestamp",
    )


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "supplier").selectExpr(
        "concat('addr-', s_suppkey) as name",
        "if(s_suppkey % 6 = 0, 'global', concat('region-', s_nationkey % 5)) as region",
        "concat('10.0.', (s_suppkey div 256) % 256, '.', s_suppkey % 256) as address",
        "if(s_suppkey % 3 = 0, 'IN_USE', 'RESERVED') as status",
        "'EXTERNAL' as address_type",
        "if(s_suppkey % 5 = 0, array('fr-1'), cast(array() as array<string>)) as users",
        f"{NOW_SQL} - make_dt_interval(cast(s_suppkey % 100 as int), 3) as creation_timestamp",
        _keep("s_suppkey") + " as labels",
    )


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk = "named_struct('name', concat('d', {i}), 'size_gb', cast((o_orderkey + {i}) % 50 as int) * 10, 'type', " + _pick(
        "(o_orderkey + {i}) % 3", ["pd-standard", "pd-ssd", "pd-unknown"]
    ) + ")"
    return stored(spark, sf_dir, "orders").selectExpr(
        "concat('vm-', o_orderkey) as name",
        "concat('zone-', o_custkey % 3) as zone",
        "concat('n2-standard-', o_custkey % 8) as machine_type",
        "if(o_orderstatus = 'F', 'TERMINATED', 'RUNNING') as status",
        _keep("o_orderkey") + " as labels",
        "if(o_orderkey % 5 = 0, null, o_orderdate) as last_stop_timestamp",
        "slice(array(" + ",".join(disk.format(i=i) for i in (0, 1, 2)) + "), 1, cast(o_orderkey % 4 as int)) as disks",
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "customer").selectExpr(
        "concat('snap-', c_custkey) as name",
        "concat('disk-', c_custkey % 100) as source_disk",
        "(c_custkey * 37 % 5000) * 268435456 as storage_bytes",
        f"{NOW_SQL} - make_dt_interval(cast(c_custkey % 400 as int), 2) as creation_timestamp",
        _keep("c_custkey", "if(c_custkey % 7 = 0, map('source', 'cleanup'), map())") + " as labels",
    )


def node_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "customer").selectExpr(
        "concat('gke-', c_nationkey) as cluster",
        "concat('region-', c_nationkey % 4) as location",
        "concat('pool-', c_custkey) as name",
        _pick("c_custkey % 4", ["e2-standard-4", "n2-highmem-16", "custom", "e2-medium"]) + " as machine_type",
        "cast(c_custkey % 5 as int) as node_count",
        "named_struct('enabled', c_custkey % 2 = 0, 'min', 0, 'max', cast(c_custkey % 9 as int)) as autoscaling",
        "c_custkey % 6 = 0 as spot",
        "case when c_custkey % 3 = 0 then 0 when c_custkey % 3 = 1 then 4 end as running_pods_excluding_daemonsets",
    )


def forwarding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "supplier").selectExpr(
        "concat('fr-', s_suppkey) as name",
        "concat('region-', s_nationkey % 5) as region",
        "if(s_suppkey % 2 = 0, 'EXTERNAL', 'INTERNAL') as load_balancing_scheme",
        "concat('target-', s_suppkey % 13) as target",
        "case when s_suppkey % 4 = 0 then 2 when s_suppkey % 4 in (1, 2) then 0 end as backend_service_healthy_backends",
        "case when s_suppkey % 5 = 0 then 3 when s_suppkey % 5 in (1, 2) then 0 end as backends_total",
    )


def cloudsql_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "customer").selectExpr(
        "concat('sql-', c_custkey) as name",
        "concat('region-', c_nationkey % 4) as region",
        _pick("c_custkey % 4", ["db-custom-4-16384", "db-custom-2-7680", "db-f1-micro", "db-custom-x-1024"]) + " as tier",
        "if(c_custkey % 9 = 0, 'STOPPED', 'RUNNABLE') as state",
        "cast(c_custkey % 500 as int) as storage_gb",
        "case when c_custkey % 4 = 3 then null else cast(c_custkey % 5 as int) end as connections_p95_14d",
        "cast(c_custkey % 100 as double) / 100 as cpu_utilization_avg_14d",
        _keep("c_custkey") + " as labels",
    )


def inventory(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "disks": disks(spark, sf_dir),
        "addresses": addresses(spark, sf_dir),
        "instances": instances(spark, sf_dir),
        "snapshots": snapshots(spark, sf_dir),
        "node_pools": node_pools(spark, sf_dir),
        "forwarding_rules": forwarding_rules(spark, sf_dir),
        "cloudsql_instances": cloudsql_instances(spark, sf_dir),
    }


def pool_config_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedule config text, one line per row, with comments and blank lines among them."""
    return stored(spark, sf_dir, "supplier").selectExpr(
        "case when s_suppkey % 10 = 8 then '# comment' when s_suppkey % 10 = 9 then '   '"
        " else concat(if(s_suppkey % 2 = 0, '  ', ''), if(s_suppkey % 4 = 0, 'example-prod-', 'example-dev-'), s_suppkey,"
        " '   ', if(s_suppkey % 7 = 0, 'prod-gke', 'dev-gke'), '\\t', 'region-', s_nationkey,"
        # Pool names repeat between clusters.
        " ' pool-', s_suppkey % 5, '  ', s_suppkey % 4) end as value"
    )


def pool_autoscaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pools are autoscaled; of some it is not known."""
    return stored(spark, sf_dir, "supplier").selectExpr(
        "concat(if(s_suppkey % 4 = 0, 'example-prod-', 'example-dev-'), s_suppkey) as project",
        "if(s_suppkey % 7 = 0, 'prod-gke', 'dev-gke') as cluster",
        "concat('region-', s_nationkey) as location",
        "concat('pool-', s_suppkey % 5) as pool",
        "if(s_suppkey % 3 = 0, null, s_suppkey % 3 = 1) as autoscaling_enabled"
    )


# ------------------------------------------------------------------ workload usage
def container_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-container usage summary, one row per stored part."""
    return stored(spark, sf_dir, "part").selectExpr(
        "concat('ns-', p_partkey div 50) as namespace",
        "concat('wl-', p_partkey div 2) as workload",
        _pick("(p_partkey div 2) % 4", ["Deployment", "CronJob", "DaemonSet", "StatefulSet"]) + " as kind",
        "concat('c', p_partkey % 2) as container",
        "cast(p_partkey % 9 + 1 as int) as replicas",
        "cast(p_size * 20 as int) as cpu_request_m",
        "cast(0 as int) as cpu_limit_m",
        "cast((p_partkey % 40) * 64 as int) as mem_request_mi",
        "cast((p_partkey % 40) * 64 as int) as mem_limit_mi",
        "cast((p_partkey * 3) % 700 as double) as cpu_p50_m",
        "cast((p_partkey * 7) % 900 as double) as cpu_p95_m",
        "cast((p_partkey * 7) % 900 + p_partkey % 50 as double) as cpu_p99_m",
        "cast((p_partkey * 7) % 900 + 100 as double) as cpu_max_m",
        "cast((p_partkey * 13) % 2300 as double) as mem_p95_mi",
        "cast((p_partkey * 13) % 2500 as double) as mem_p99_mi",
        "if(p_partkey % 6 = 0, null, cast((p_partkey * 13) % 2500 + p_partkey % 64 as double)) as mem_max_mi",
        "if(p_partkey % 10 = 0, cast(p_partkey % 3 as int), 0) as oom_kills_14d",
        "cast(p_partkey % 40 as double) / 100 as throttled_ratio_p95",
    )


def vpa_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened autoscaler targets.

    Some belong to other namespaces, and some keys occur twice (the larger sequence wins).
    """
    first = "named_struct('target_cpu_m', cast((p_partkey * 11) % 800 as int), 'target_mem_mi', cast((p_partkey * 5) % 2000 as int), 'seq', 1L)"
    again = "named_struct('target_cpu_m', 77, 'target_mem_mi', 177, 'seq', 2L)"
    return stored(spark, sf_dir, "part").selectExpr(
        "if(p_partkey % 3 = 0, 'elsewhere', concat('ns-', p_partkey div 50)) as namespace",
        "concat('wl-', p_partkey div 2) as workload",
        "concat('c', p_partkey % 2) as container",
        f"inline(if(p_partkey % 4 = 0, array({first}, {again}), array({first})))",
    )


def vpa_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autoscaler list documents as JSON text, two containers per item."""
    rec = (
        "named_struct('containerName', 'c{i}', 'target', named_struct('cpu', concat((p_partkey * 11 + {i}) % 800, {cpu}),"
        " 'memory', concat((p_partkey * 5 + {i}) % 2000, {mem})))"
    )
    recs = ",".join(
        rec.format(i=i, cpu="if(p_partkey % 5 = 0, '', 'm')", mem="if(p_partkey % 7 = 0, 'Gi', 'Mi')") for i in (0, 1)
    )
    return stored(spark, sf_dir, "part").selectExpr(
        "to_json(named_struct('items', array(named_struct("
        "'metadata', named_struct('namespace', concat('ns-', p_partkey % 12), 'name', concat('vpa-', p_partkey)),"
        "'spec', named_struct('targetRef', named_struct('name', concat('wl-', p_partkey))),"
        f"'status', if(p_partkey % 10 = 0, null, named_struct('recommendation', named_struct('containerRecommendations', array({recs})))))))) as value"
    )


def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource quota per namespace; some namespaces have none."""
    sizes = stored(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 50").alias("ns")).agg(F.sum("p_size").alias("size"))
    return sizes.selectExpr(
        "concat('ns-', ns) as namespace",
        "if(ns % 4 = 3, null, size * 160) as quota_cpu_m",
        "if(ns % 4 = 3, null, size * 400) as quota_mem_mi",
    )


def limit_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource ranges per namespace; some namespaces set none."""
    values = {
        "default_cpu_m": "100", "default_mem_mi": "256", "default_limit_mem_mi": "512", "min_cpu_m": "10",
        "max_cpu_m": "600", "min_mem_mi": "32", "max_mem_mi": "1600", "max_mem_limit_ratio": "1.0D",
    }
    return (
        stored(spark, sf_dir, "part")
        .select(F.expr("p_partkey div 50").alias("ns"))
        .distinct()
        .selectExpr("concat('ns-', ns) as namespace", *[f"if(ns % 4 = 2, null, {v}) as {k}" for k, v in values.items()])
    )


def container_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared container resources, partly missing."""
    return stored(spark, sf_dir, "part").selectExpr(
        "concat('ns-', p_partkey div 50) as namespace",
        "concat('wl-', p_partkey div 2) as workload",
        "concat('c', p_partkey % 2) as container",
        "if(p_partkey % 5 = 0, null, cast(p_size * 20 as int)) as cpu_request_m",
        "if(p_partkey % 6 = 0, null, cast((p_partkey % 40) * 64 as int)) as mem_request_mi",
        "if(p_partkey % 7 = 0, null, cast((p_partkey % 40) * 64 + (p_partkey % 3) * 16 as int)) as mem_limit_mi",
    )


# ------------------------------------------------------------------ metric samples
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long metric table.  One projection per metric, so a metric filter drops the others.

    Counter metrics carry a value that also falls, which is a counter reset.
    """
    events = stored(spark, sf_dir, "events")
    series = [
        "'main' as cluster",
        "event_type as namespace",
        "concat('svc', user_id % 10, '-rs', user_id % 3, '-p', user_id) as pod",
        "case when user_id % 25 = 24 then 'POD' when user_id % 25 = 23 then '' else 'app' end as container",
        "concat('node-', user_id div 7) as node",
    ]
    spec = [
        (fixed.M_CPU_USAGE, "value"),
        (fixed.M_MEM_WORKING_SET, "floor(value) * 1048576.0D"),
        (fixed.M_CPU_REQUEST, "(user_id % 8 + 1) * 0.25D"),
        (fixed.M_MEM_REQUEST, "(user_id % 4 + 1) * 268435456.0D"),
        (fixed.M_THROTTLED, "floor(value / 3)"),
        (fixed.M_PERIODS, "value"),
        (fixed.M_OOM_EVENTS, "floor(value / 20)"),
        (fixed.M_OOM_TERMINATED, "floor(value / 10)"),
        (fixed.M_ALLOC_CPU, "((user_id div 7) % 5 + 1) * 24.0D"),
        (fixed.M_ALLOC_MEM, "((user_id div 7) % 5 + 1) * 17179869184.0D"),
    ]
    out = None
    for metric, value in spec:
        part = events.selectExpr(f"'{metric}' as metric", *series, "ts", f"cast({value} as double) as value")
        out = part if out is None else out.unionByName(part)
    return out


def node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node label series: latest state of one row per event user."""
    return stored(spark, sf_dir, "events").selectExpr(
        "'main' as cluster",
        "concat('node-', user_id) as node",
        "case when user_id % 4 = 0 then 'true' when user_id % 4 = 1 then 'false' end as spot",
        "ts",
    )


def disruption_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "events").selectExpr(
        "'main' as cluster",
        "event_type as namespace",
        "concat('pdb-', user_id) as pdb",
        "ts",
        "cast(event_id % 3 as double) as value",
    )


def monitoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic monitoring series for align/reduce: series labels, timestamp, value."""
    return stored(spark, sf_dir, "events").selectExpr(
        "concat('series-', user_id) as series",
        "concat('instance-', user_id % 40) as instance",
        "concat('cluster-', user_id % 3) as cluster",
        "event_type as namespace",
        "concat('db-', user_id % 12) as database",
        _pick("user_id % 4", list(fixed.STORAGE_CLASSES)) + " as storage_class",
        "ts",
        "value",
    )


# ------------------------------------------------------------------ warehouse
def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw query log: one job per document, the text is the query."""
    return stored(spark, sf_dir, "documents").selectExpr(
        "doc_id as job_id",
        "text as query",
        "concat(source, '@example.com') as user_email",
        "array(named_struct('key', 'team', 'value', lang), named_struct('key', 'team', 'value', 'later')) as labels",
        f"{NOW_SQL} - make_dt_interval(cast(doc_id % 40 as int), 1) as creation_time",
        f"{NOW_SQL} - make_dt_interval(cast(doc_id % 40 as int), 1) as start_time",
        f"{NOW_SQL} - make_dt_interval(cast(doc_id % 40 as int), 1) + make_dt_interval(0, 0, 0, n_chars % 300) as end_time",
        "if(doc_id % 10 = 9, 'LOAD', 'QUERY') as job_type",
        "if(doc_id % 23 = 22, 'RUNNING', 'DONE') as state",
        "if(doc_id % 17 = 16, 'invalid', null) as error_result",
        "n_chars * 1000000000 as total_bytes_billed",
        "n_chars * 500000 as total_slot_ms",
    )


def query_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs already rolled up by query, with the tables they read (some read none)."""
    return stored(spark, sf_dir, "documents").selectExpr(
        "concat('q', doc_id) as query_hash",
        "concat(source, '@example.com') as user_email",
        "lang as label_team",
        "cast(doc_id % 1500 + 1 as bigint) as run_count",
        "n_chars * 2000000000 as total_bytes_billed",
        "n_chars * 9000000 as total_slot_ms",
        "cast(n_chars % 300 as double) as avg_duration_s",
        "case when doc_id % 8 = 0 then cast(array() as array<string>)"
        " when doc_id % 3 = 0 then array(concat('ds.t', doc_id % 150))"
        " else array(concat('ds.t', doc_id % 150), concat('ds.t', (doc_id % 150) + 1)) end as referenced_tables",
        "if(doc_id % 4 = 0, concat('select * from x where ', text), text) as sample_sql",
    )


def warehouse_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = [
        "array('customer_id', 'event_date', 'region')",
        "array('tenant_id', 'region')",
        "array('candidate_id')",
        "cast(array() as array<string>)",
        "cast(null as array<string>)",
    ]
    pick = " ".join(f"when p_partkey % 5 = {i} then {f}" for i, f in enumerate(filters))
    total = "cast(p_size as bigint) * 400000000000"
    return stored(spark, sf_dir, "part").selectExpr(
        "concat('ds', p_partkey % 6) as dataset",
        "concat('ds.t', p_partkey) as table",
        f"if(p_partkey % 13 = 0, 5000000000, {total}) as total_logical_bytes",
        f"cast({total} * 3 div 4 as bigint) as active_logical_bytes",
        f"cast({total} div 4 as bigint) as long_term_logical_bytes",
        f"cast({total} div (p_partkey % 5 + 1) as bigint) as total_physical_bytes",
        "if(p_partkey % 3 = 0, 'DAY', null) as partitioning",
        "if(p_partkey % 4 = 0, array('region'), cast(array() as array<string>)) as clustering",
        "if(p_partkey % 9 = 0, 180, null) as partition_expiration_days",
        "cast(p_partkey % 120 as int) as last_modified_days_ago",
        f"case {pick} end as typical_filter_columns",
        "p_partkey % 6 = 0 as require_partition_filter",
    )


# ------------------------------------------------------------------ storage
def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "customer").selectExpr(
        "concat('bucket-', c_custkey) as name",
        "concat('loc-', c_nationkey) as location",
        _pick("if(c_custkey % 5 < 2, 0, c_custkey % 4)", list(fixed.STORAGE_CLASSES)) + " as storage_class",
        "c_custkey % 2 = 0 as versioning",
        "if(c_custkey % 6 = 0, array(named_struct('action', 'Delete', 'storage_class', cast(null as string),"
        " 'condition', map('age', '365'))), array()) as lifecycle_rules",
        "cast(case when c_custkey % 3 = 0 then map('env', 'dev', 'team', 'core')"
        " when c_custkey % 3 = 1 then map('env', 'dev', 'team', '') else map() end as map<string,string>) as labels",
        "named_struct('class_a_ops_30d', if(c_custkey % 7 = 0, null, c_custkey * 1000),"
        " 'class_b_ops_30d', if(c_custkey % 8 = 0, 20000000L, c_custkey * 100),"
        " 'egress_gb_30d', if(c_custkey % 9 = 0, null, cast(c_custkey % 120 * 10 as double)),"
        " 'last_read_age_days_p50', if(c_custkey % 10 = 0, null, cast(c_custkey % 90 as int))) as access_pattern",
        "map('0-30', c_custkey * 1000000000, '30-90', (c_custkey % 100) * 7000000000,"
        " '90-365', (c_custkey % 50) * 11000000000, '365+', (c_custkey % 30) * 13000000000) as age_distribution_bytes",
        "if(c_custkey % 5 = 0, 0L, c_custkey % 20 * 3000000000) as noncurrent_bytes",
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object listing with its storage class and creation day."""
    return stored(spark, sf_dir, "lineitem").selectExpr(
        "concat('bucket-', l_suppkey) as bucket",
        "concat('obj-', l_orderkey, '-', l_linenumber, '-', l_partkey) as object",
        _pick("l_partkey % 4", list(fixed.STORAGE_CLASSES)) + " as storage_class",
        "cast(l_quantity as bigint) * 1000000 as size_bytes",
        "to_date(l_shipdate) as created",
    )


# ------------------------------------------------------------------ cache
def cache_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cache instance per event user."""
    keys = (
        "filter(array(named_struct('key_pattern', concat('sess:', user_id), 'count', user_id * 1000, 'avg_bytes', 1048576L, 'ttl_set', user_id % 2 = 0),"
        " named_struct('key_pattern', 'board', 'count', 1L, 'avg_bytes', if(user_id % 9 = 0, 400000000L, 1000L), 'ttl_set', false),"
        " named_struct('key_pattern', 'feed', 'count', 400L, 'avg_bytes', 500000L, 'ttl_set', false)), k -> user_id % 4 <> 0)"
    )
    return (
        stored(spark, sf_dir, "events")
        .select("user_id")
        .distinct()
        .selectExpr(
            "concat('cache-', user_id) as instance",
            "'memorystore' as provider",
            "if(user_id % 3 = 0, 'BASIC', 'standard_ha') as tier",
            "cast(user_id % 150 + 1 as int) as provisioned_memory_gb",
            "(user_id % 150 + 1) * 858993459 as maxmemory_bytes",
            "if(user_id % 2 = 0, 'noeviction', 'allkeys-lru') as maxmemory_policy",
            "cast(user_id * 700 % 200000 as int) as ops_per_sec_p95",
            "cast(user_id % 101 as double) / 100 as ttl_coverage_ratio",
            f"{keys} as big_keys",
        )
    )


def cache_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily statistics per instance."""
    return (
        stored(spark, sf_dir, "events")
        .groupBy(F.expr("concat('cache-', user_id)").alias("instance"), F.to_date("ts").alias("date"))
        .agg(
            F.expr("sum(cast(value * 100 as bigint)) * 1000000").alias("used_memory"),
            F.expr("sum(cast(value * 120 as bigint)) * 1000000").alias("used_memory_rss"),
            F.expr("sum(event_id % 100)").alias("keyspace_hits"),
            F.expr("sum(event_id % 17)").alias("keyspace_misses"),
            F.expr("sum(event_id % 5)").alias("evicted_keys"),
            F.expr("sum(event_id % 9)").alias("expired_keys"),
        )
    )


# ------------------------------------------------------------------ business tables
def business_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders served per app and day."""
    return (
        stored(spark, sf_dir, "orders")
        .groupBy(F.expr("concat('app-', o_custkey % 7)").alias("app"), F.to_date("o_orderdate").alias("date"))
        .agg(F.count(F.lit(1)).alias("units"))
    )


def namespace_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespace to team mapping; ns-5 has none."""
    return stored(spark, sf_dir, "region").selectExpr(
        "concat('ns-', r_regionkey) as namespace", "concat('team-', r_regionkey % 3) as team"
    )
