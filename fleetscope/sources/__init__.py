"""Where telemetry comes from: landed REST documents, event logs, run stores, and views over the sample tables."""
