"""DataFrame operators over items, fetch logs and request logs."""
