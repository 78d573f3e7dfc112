"""Reading and writing event logs, labels and stage tables."""
