"""What to do about a finding, by advice key. Wording is ours; keys are stable."""

ADVICE = {
    "gc_pressure": "Give executors more heap, switch to Kryo, or lower the share of heap reserved by spark.memory.fraction.",
    "memory_spill": "Use more shuffle partitions or larger executors so that a partition fits in memory.",
    "data_skew": "Turn on adaptive skew-join handling, or salt the heavy keys before the shuffle.",
    "task_skew": "Repartition so that executors receive similar numbers of tasks; check adaptive skew handling.",
    "shuffle_bottleneck": "Broadcast the small side, filter before shuffling, or store the data partitioned by the join key.",
    "cluster_utilization": "Use fewer workers, or more partitions so that every slot has work.",
    "partition_large": "Raise the number of partitions until each one holds less than 256 MB.",
    "partition_small": "Lower the number of partitions, or let adaptive execution coalesce them.",
    "partition_few": "Raise the number of partitions to at least the number of cores.",
    "straggler_tasks": "Enable speculation and look for skewed input in the last tasks of the stage.",
    "task_failures": "Read the executor logs; look for memory errors, bad records and lost nodes.",
    "failure_hotspot": "One executor fails most tasks: inspect its host and consider excluding it.",
    "memory_pressure": "Add executor memory or cache less on the executors near their limit.",
    "aqe_off": "Set spark.sql.adaptive.enabled=true.",
    "aqe_coalesce_off": "Set spark.sql.adaptive.coalescePartitions.enabled=true.",
    "aqe_skew_off": "Set spark.sql.adaptive.skewJoin.enabled=true.",
    "aqe_advisory_small": "Raise spark.sql.adaptive.advisoryPartitionSizeInBytes to 32 MB or more.",
    "serialization": "Set spark.serializer to org.apache.spark.serializer.KryoSerializer and register hot classes.",
    "sizing_heap": "Prefer more executors with 16 to 32 GB of heap over a few very large ones.",
    "sizing_cores": "Use four or five cores per executor and more executors.",
    "sizing_per_core": "Give every core at least 2 GB of executor memory.",
    "driver_gc": "Raise spark.driver.memory; collect less to the driver and broadcast smaller tables.",
    "driver_memory": "Raise spark.driver.memory and write results to storage instead of collecting them.",
    "conf_partitions": "Set shuffle partitions to two or three per core, or turn on partition coalescing.",
    "conf_memory_fraction": "Go back to spark.memory.fraction=0.6 unless there is a measured reason.",
    "conf_storage_fraction": "Lower spark.memory.storageFraction to 0.5 to leave room for execution.",
    "conf_broadcast_off": "Restore spark.sql.autoBroadcastJoinThreshold (10485760 by default).",
    "photon_opportunity": "Try the vectorised runtime for this SQL workload.",
    "io_small_files": "Compact the input files, or coalesce partitions before processing.",
    "io_bound": "Cache hot input, use columnar files, and check the latency of remote storage.",
    "cpu_bound_workload": "Add cores, and replace user-defined functions by built-in ones.",
    "io_bound_workload": "Cache hot data, compact files, or use faster storage.",
    "stage_retries": "Look up why earlier attempts failed: memory, fetch failures or lost nodes.",
    "stage_retries_many": "Several stages were retried: check node stability, memory and network.",
    "sql_long": "Check the plan for missing partition pruning, full scans and costly joins.",
    "sql_outlier_critical": "This query is far slower than its peers: check its plan, skew and statistics first.",
    "sql_outlier_warning": "This query is slower than its peers: check its plan, skew and statistics.",
    "sql_failed_jobs": "Open the failed jobs of this query and read their errors.",
    "join_strategy": "Hint a broadcast join, or raise spark.sql.autoBroadcastJoinThreshold above the table size.",
    "cache_partial": "Free memory or use MEMORY_AND_DISK so that the dataset stays fully cached.",
    "cache_memory": "Unpersist datasets that are no longer read, or let them spill to disk.",
    "idle_no_timeout": "The cluster is idle: set an auto-termination of 30 to 60 minutes.",
    "no_timeout": "Set an auto-termination of 30 to 120 minutes.",
    "long_timeout": "Shorten the auto-termination timeout.",
    "dynamic_allocation": "Raise the idle timeout or the minimum number of executors to stop the swings.",
    "stage_failure.OOM": "Raise executor memory or overhead, or make partitions smaller.",
    "stage_failure.SHUFFLE_FETCH": "Check the network between executors; raise shuffle retry counts and waits.",
    "stage_failure.CONTAINER_KILLED": "Raise spark.executor.memoryOverhead or use larger nodes.",
    "stage_failure.SERIALIZATION": "Make sure closures hold only serialisable objects.",
    "stage_failure.TIMEOUT": "Raise network and heartbeat timeouts; look for long collections.",
    "stage_failure.UNKNOWN": "Read the full failure reason of the stage.",
    "removal.OOM": "Raise executor memory or overhead, or use larger nodes.",
    "removal.CONTAINER_KILLED": "Raise spark.executor.memoryOverhead or node memory: containers exceed their limit.",
    "removal.TIMEOUT": "Read the removal reasons of the lost executors.",
    "removal.SHUFFLE_FETCH": "Read the removal reasons of the lost executors.",
    "excluded": "Find out why tasks kept failing on the excluded executors.",
    "killed_tasks": "A few speculative kills are normal; many mean stragglers, so tune the speculation settings.",
}
