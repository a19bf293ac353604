"""Change logs: capture, batches, mapping, conflicts, application, hashes, clients and subscriptions."""
