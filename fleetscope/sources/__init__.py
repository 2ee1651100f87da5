"""Reading fleet snapshots, probe output, reports, logs and backups; writing logs and alerts."""
