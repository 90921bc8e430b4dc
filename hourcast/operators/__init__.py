"""DataFrame operators of the hours-estimation workload."""
