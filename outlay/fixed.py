"""Fixed values.

Everything in this module is a value that results depend on: unit prices, thresholds of the
report texts, regular expressions, label names and category names.  They are data, not logic,
and are listed in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------- units
GIB = 1024**3
TIB = 1024**4
GB = 1_000_000_000  # decimal gigabyte: warehouse and object storage
HOURS_PER_MONTH = 730.0

# ---------------------------------------------------------------- billing texts
NO_PROJECT = "(account)"
UNLABELLED = "(unlabelled)"
UNALLOCATED = "(unallocated)"
CLUSTER_LABEL = "goog-k8s-cluster-name"
NAMESPACE_LABEL = "k8s-namespace"
MACHINE_SPEC_LABEL = "compute.googleapis.com/machine_spec"
COMPUTE_SERVICE = "Compute Engine"
KUBERNETES_SERVICE = "Kubernetes Engine"
CUD_CREDIT_TYPES = ("COMMITTED_USAGE_DISCOUNT", "COMMITTED_USAGE_DISCOUNT_DOLLAR_BASE")
SUD_CREDIT_TYPE = "SUSTAINED_USAGE_DISCOUNT"
EGRESS_UNITS = ("gibibyte", "gigabyte")
DISK_NAME_LIKE = "//compute.googleapis.com/projects/%/disks/%"

RE_EGRESS = r"(?i)egress|network.*(internet|inter)"
# Ordered: the first pattern that matches names the class.
EGRESS_CLASSES = (
    (r"(?i)internet|to (china|australia|americas|emea|apac)", "internet"),
    (r"(?i)inter-?region|inter region", "inter-region"),
    (r"(?i)inter-?zone|inter zone", "inter-zone"),
    (r"(?i)cdn", "cdn-cache-egress"),
    (r"(?i)interconnect|vpn", "hybrid"),
)
EGRESS_OTHER = "other-network"
RE_SPOT = r"(?i)spot|preemptible"
RE_DISK_SKU = r"(?i)PD Capacity|Hyperdisk|SSD backed PD"
RE_COMMITMENT_FEE = r"^Commitment v\d+:"
RE_ELIGIBLE = r"(?i)(core|ram|instance)"
RE_NOT_ELIGIBLE = r"(?i)spot|preemptible|commitment"

CREDIT_MEANINGS = {
    "COMMITTED_USAGE_DISCOUNT": "CUD - resource based; check coverage query",
    "COMMITTED_USAGE_DISCOUNT_DOLLAR_BASE": "CUD - spend based (Cloud SQL, GKE Autopilot, etc.)",
    "SUSTAINED_USAGE_DISCOUNT": "SUD - automatic; disappears when VMs move to CUD or E2/T2D",
    "PROMOTION": "Promotional credit; confirm expiry date with account team",
    "FREE_TIER": "Always-free allowance",
    "SPENDING_BASED_DISCOUNT": "Negotiated volume discount",
    "DISCOUNT": "Contractual discount",
}
CREDIT_MEANING_OTHER = "n/a"

# ---------------------------------------------------------------- default unit prices (USD)
DEFAULT_PRICES = {
    "compute": {
        "pd_standard_gb_month": 0.048,
        "pd_balanced_gb_month": 0.120,
        "pd_ssd_gb_month": 0.204,
        "snapshot_gb_month": 0.032,
        "static_ip_idle_hour": 0.012,
        "forwarding_rule_hour": 0.030,
        "e2_vcpu_hour": 0.0242,
        "e2_gb_hour": 0.0032,
        "spot_discount_fraction": 0.65,
        "cud_1y_discount_fraction": 0.37,
        "cud_3y_discount_fraction": 0.55,
    },
    "cloudsql": {
        "db_custom_vcpu_hour": 0.0475,
        "db_custom_gb_hour": 0.0080,
        "storage_ssd_gb_month": 0.204,
    },
    "gcs": {
        "standard_gb_month": 0.023,
        "nearline_gb_month": 0.013,
        "coldline_gb_month": 0.006,
        "archive_gb_month": 0.0025,
        "nearline_retrieval_gb": 0.01,
        "coldline_retrieval_gb": 0.02,
        "archive_retrieval_gb": 0.05,
        "class_a_ops_per_10k": 0.05,
        "class_b_ops_per_10k": 0.004,
    },
    "bigquery": {
        "on_demand_per_tib": 6.25,
        "active_storage_gb_month": 0.023,
        "long_term_storage_gb_month": 0.016,
        "slot_hour_standard_edition": 0.048,
        "slot_hour_enterprise_edition": 0.072,
        "slot_hour_enterprise_1y_commit": 0.058,
    },
    "redis": {
        "memorystore_basic_gb_hour_m2": 0.026,
        "memorystore_standard_gb_hour_m2": 0.043,
        "memorystore_standard_gb_hour_m4": 0.035,
        "memorystore_standard_gb_hour_m5": 0.030,
    },
    "kubernetes": {
        "vcpu_hour": 0.0242,
        "gb_hour": 0.0032,
    },
}

# ---------------------------------------------------------------- object storage
STORAGE_CLASSES = ("STANDARD", "NEARLINE", "COLDLINE", "ARCHIVE")
STORAGE_MIN_DAYS = {"STANDARD": 0, "NEARLINE": 30, "COLDLINE": 90, "ARCHIVE": 365}
AGE_BANDS = ("0-30", "30-90", "90-365", "365+")
AGE_BAND_START = {"0-30": 0, "30-90": 30, "90-365": 90, "365+": 365}
BAND_CLASSES_HOT = ("STANDARD", "STANDARD", "STANDARD", "STANDARD")
BAND_CLASSES_WARM = ("STANDARD", "STANDARD", "NEARLINE", "COLDLINE")
BAND_CLASSES_COLD = ("STANDARD", "NEARLINE", "COLDLINE", "ARCHIVE")

# ---------------------------------------------------------------- warehouse
TEMPORAL_TOKENS = ("date", "time", "_ts", "ts_", "day", "created", "updated", "timestamp")
TEMPORAL_NAMES = ("ts", "dt")

# ---------------------------------------------------------------- cache
CACHE_SIZES_GB = (
    1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 40, 48, 64, 80, 96, 128, 160, 192, 256, 300,
)
SHARD_MAX_GB = 13.0
SHARD_MAX_OPS = 25_000

# ---------------------------------------------------------------- budgets and alerts
BUDGET_THRESHOLDS = (0.5, 0.8, 0.9, 1.0)
FORECAST_THRESHOLDS = (1.0, 1.2)
DAILY_SPEND_ALERT = 500.0
SCORECARD_YELLOW = 500.0
SCORECARD_RED = 800.0
UNLABELLED_TARGET_PCT = 2.0

# ---------------------------------------------------------------- metric names
M_CPU_USAGE = "container_cpu_usage_seconds_total"
M_MEM_WORKING_SET = "container_memory_working_set_bytes"
M_CPU_REQUEST = "kube_pod_container_resource_requests_cpu"
M_MEM_REQUEST = "kube_pod_container_resource_requests_memory"
M_THROTTLED = "container_cpu_cfs_throttled_periods_total"
M_PERIODS = "container_cpu_cfs_periods_total"
M_OOM_EVENTS = "container_oom_events_total"
M_OOM_TERMINATED = "kube_pod_container_status_last_terminated_reason"
M_ALLOC_CPU = "kube_node_status_allocatable_cpu"
M_ALLOC_MEM = "kube_node_status_allocatable_memory"

# ---------------------------------------------------------------- report texts
# Texts of findings, notes and actions.  Names in braces are filled from columns.
EXCLUDED_DISK = "Excluded by label keep=true; review owner"
EXCLUDED = "Excluded by label keep=true"
EXCLUDED_SNAPSHOT = "Excluded by label keep=true (retention hold)"
DISK_TEXT = "Snapshot then delete (unattached {days}d). Snapshot cost ~{cost}/mo"
ADDRESS_TEXT = "Release reserved IP {address} (unused {days}d)"
STOPPED_TEXT = "Stopped {days}d; create machine image and delete, or confirm restart plan"
SNAPSHOT_TEXT = "{days}d old ({size}); delete or move to a snapshot schedule with retention"
POOL_TEXT = "No workload pods for 14d; enable autoscaling with min 0 or delete the pool"
LB_TEXT = "Forwarding rule has zero backends; delete rule, target and any reserved IP"
SQL_TEXT = "p95 connections={connections} over 14d; export, stop (activation policy NEVER) for 30d, then delete"

NOTE_OOM = "{n} OOMKills in window; memory raised to max+headroom"
NOTE_THROTTLED = "CPU throttled {pct} of periods at p95; raise request/relax limit"
NOTE_WITHIN = "Within tolerance; no change"
NOTE_MIXED = "Mixed change: one resource rises while the other falls"
NOTE_BATCH = "Batch workload: sized to p99; consider spot node pool + toleration"
NOTE_DAEMON = "DaemonSet: replicas = node count; savings scale with cluster size"
NOTE_VPA = "Diverges from VPA target by {pct} on CPU; inspect before applying"

HINT_STAR = "avoid SELECT *"
HINT_RUNS = "runs {n}x/day: materialise into a scheduled table or BI Engine"
HINT_SCAN = "{n} TiB per run: add partition filter / require_partition_filter"
HINT_NONE = "Review query plan for pruning opportunities"
PARTITION_TEXT = "Partition by DATE({column}) and set require_partition_filter=true; estimated 80% scan reduction"
CLUSTER_ONLY_TEXT = "No date column to partition on; cluster by ({columns}) or use integer-range partitioning"
CLUSTER_TEXT = "Add clustering on ({columns}) to cut block scans within partitions"
STALE_TEXT = "Not modified for {days}d; set partition_expiration_days (e.g. 180) or drop"
RETENTION_TEXT = "{pct} of partitions are long-term; agree a retention window with owners and set partition expiration"
LONG_TERM_TEXT = (
    "Unpartitioned table is rewritten on every load so nothing ages into long-term storage; "
    "partition it so untouched partitions convert after 90 days"
)
SLOTS_MOVE = "Move to a {n}-slot reservation (autoscale above baseline); on-demand exceeds slot pricing by {pct}"
SLOTS_STAY = "Stay on-demand; utilisation too bursty/low for a reservation baseline"
SLOTS_NEAR = "Near break-even; reduce bytes scanned first (partition pruning), then re-evaluate"
DDL_HEAD = "CREATE TABLE `{table}_partitioned`\nPARTITION BY DATE({column})\n"
DDL_CLUSTER = "CLUSTER BY {columns}\n"
DDL_TAIL = "OPTIONS (require_partition_filter = TRUE)\nAS SELECT * FROM `{table}`;"
DDL_EXPIRE = "ALTER TABLE `{table}` SET OPTIONS (partition_expiration_days = 180);"

NOTE_RULES = "{n} lifecycle rule(s) already present; proposal replaces them"
NOTE_VERSIONS = "{size} of noncurrent versions; ~80% assumed deletable after {days}d/keep {keep}"
NOTE_RETRIEVAL = "Retrieval fees modelled at {cost}/mo from {gb} GB reads"
NOTE_HOT = "Hot serving bucket: no class transitions recommended; consider Cloud CDN to reduce egress"
NOTE_UNLABELLED = "Missing required labels (env/team); showback attribution incomplete"
RULES_TEXT = "Apply {n} lifecycle rule(s)"
RULES_NONE = "No change"

ACTION_GROWTH = (
    "At current growth ({rate} MiB/day) maxmemory is reached in ~{days} days; resize or add eviction before then"
)
ACTION_NOEVICTION = (
    "maxmemory-policy is noeviction while {pct} of keys lack TTL: writes will fail at maxmemory. "
    "Switch to allkeys-lru or volatile-lru"
)
ACTION_HITS = "Hit ratio {pct} is low for a cache; review TTLs and key design before adding memory"
ACTION_KEYS = "Key pattern `{pattern}` holds {size} GiB with no TTL; add TTL or move to a persistent store"
ACTION_BIG_KEY = (
    "Big key detected (>100 MiB); a single sorted set blocks the event loop on range queries and cannot be sharded"
)
ACTION_SHARDS = (
    "Throughput/memory need {n} shards ({memory} by memory, {ops} by ops); "
    "consider Memorystore for Redis Cluster or Redis Enterprise with hash-tagged keys"
)
