"""End-to-end plans (upload -> train, batch and single scoring) and the query catalog."""
