"""Files in and out: scans, manifests, ledgers, sinks."""
