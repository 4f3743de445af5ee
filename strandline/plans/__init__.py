"""How order-dependent work is laid out over Spark partitions, and the composite deliverables."""
