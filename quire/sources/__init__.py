"""Sources and sinks: landed payloads, CSV drops, ledger, stored tables."""
