"""Plan-shaping helpers shared by the operators: distributed ordering, size-checked small tables, lineage cuts."""
