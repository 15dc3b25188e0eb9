"""Sources and sinks: DDL, rule files, datasets, warehouse folders, artifacts."""
