"""Every bound, weight and limit a rule or report compares against.

They are part of the contract (the same telemetry must give the same findings), so
they live in one place and nothing else in the package hard-codes them.
"""

KIB = 1024
MIB = 1024**2
GIB = 1024**3

# Executor rules
GC_WARN = 0.05
GC_CRIT = 0.10
SKEW_WARN = 3.0
SKEW_CRIT = 5.0
TASK_COV_WARN = 0.5
TASK_COV_CRIT = 1.0
UTIL_WARN_PCT = 70.0
UTIL_CRIT_PCT = 30.0
FAIL_MIN_TASKS = 10
FAIL_WARN = 0.01
FAIL_CRIT = 0.05
FAIL_HOTSPOT_SHARE = 0.5
MEM_WARN_PCT = 80.0
MEM_CRIT_PCT = 95.0
HEAP_WARN_PCT = 85.0
HEAP_CRIT_PCT = 95.0
SIZING_HEAP_BYTES = 64 * GIB
SIZING_CORES = 8
SIZING_BYTES_PER_CORE = 2 * GIB
DRIVER_GC_FACTOR = 2.0
DRIVER_GC_MIN = 0.05
DRIVER_MEM_PCT = 95.0
COUNT_COV_WARN = 0.3
COUNT_COV_MIN_POINTS = 3

# Stage rules
SPILL_DISK_BYTES = GIB
SPILL_INPUT_RATIO = 1.0
SHUFFLE_WARN = 0.5
SHUFFLE_CRIT = 2.0
PARTITION_LARGE = 256 * MIB
PARTITION_SMALL = MIB
STRAGGLER_PROGRESS = 0.95
STRAGGLER_REMAINING = 3
STRAGGLER_MIN_DONE = 10
SMALL_FILE_BYTES = MIB
SMALL_FILE_TASKS = 100
CPU_LOW = 0.3
CPU_HIGH = 0.7
RETRY_WARN_ATTEMPT = 1
RETRY_CRIT_ATTEMPT = 3
JOIN_SHUFFLE_RATIO = 5.0
JOIN_SMALL_INPUT = 100 * MIB
KILLED_WARN_PCT = 10.0
REASON_CHARS = 200

# SQL, storage and configuration rules
SQL_LONG_MS = 600_000
SQL_MIN_MS = 60_000
SQL_WARN = 5.0
SQL_CRIT = 10.0
CACHE_PARTIAL = 0.5
CACHE_MEM_PCT = 60.0
SERIALIZER_SHUFFLE_BYTES = 10 * GIB
ADVISORY_MIN_BYTES = 32 * MIB
PARTITIONS_PER_CORE = 10
MEMORY_FRACTION_LOW = 0.4
MEMORY_FRACTION_HIGH = 0.8
MEMORY_FRACTION_DEFAULT = 0.6
STORAGE_FRACTION_HIGH = 0.7
STORAGE_FRACTION_DEFAULT = 0.5
SHUFFLE_PARTITIONS_DEFAULT = 200
VECTOR_MANY_QUERIES = 20
VECTOR_MEAN_SECONDS = 60.0
VECTOR_SOME_QUERIES = 5
IDLE_TIMEOUT_MINUTES = 120

# Health score: component weights, in the order they are added up
HEALTH_WEIGHTS = {
    "gc": 0.18,
    "spill": 0.15,
    "skew": 0.15,
    "utilization": 0.12,
    "shuffle": 0.08,
    "task_failures": 0.08,
    "config": 0.08,
    "driver": 0.06,
    "io_efficiency": 0.05,
    "stability": 0.05,
}
PENALTY_CRITICAL = 30
PENALTY_WARNING = 15
PENALTY_CATEGORIES = {
    "config": ("AQE_CONFIG", "SERIALIZATION", "CONFIG_ANTI_PATTERN", "PHOTON_OPPORTUNITY"),
    "driver": ("DRIVER_BOTTLENECK",),
    "io_efficiency": ("IO_PATTERN", "CPU_IO_BOUND"),
    "stability": ("STAGE_RETRY", "DYNAMIC_ALLOCATION"),
}

# Ladder of (lower bound, label, colour) for the score
SCORE_LADDER = (
    (90, "Excellent", "green"),
    (70, "Good", "blue"),
    (50, "Fair", "yellow"),
    (30, "Poor", "#ff8c00"),
)
SCORE_FLOOR = ("Critical", "red")
COMPONENT_LADDER = ((70, "green"), (40, "yellow"))
COMPONENT_FLOOR = "red"

# Severity order and recommendation priority
SEVERITIES = ("CRITICAL", "WARNING", "INFO")
PRIORITY = {"CRITICAL": 1, "WARNING": 3, "INFO": 5}
TOP_RECOMMENDATIONS = 5

# Histories and limits
RING_SIZE = 60
SPARK_POINTS = 8
FLEET_POINTS = 20
HISTORY_CAP = 2000
SNAPSHOT_GAP_S = 30
ANALYSIS_GAP_S = 5
TOP_ACTIVE = 10
TOP_RESOLVED = 5
EVENTS_FETCHED = 50
EVENTS_SHOWN = 20
JOB_RUNS_FETCHED = 20
DIFF_INSIGHTS = 10
DIFF_CONF = 20
STALE_FACTOR = 2
FAST_POLL_S = 3
SLOW_POLL_S = 15
TASK_PAGE = 100

# Share of the JVM heap that the storage limit stands for
STORAGE_SHARE_OF_HEAP = 0.3
GC_BAND_HIGH_PCT = 10.0
GC_BAND_MID_PCT = 5.0

# Task-level bounds
TASK_SKEW_RATIO = 10.0
TASK_GC_RATIO = 0.10
QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
