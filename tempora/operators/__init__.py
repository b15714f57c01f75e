"""DataFrame operators on event, cohort and sequence tables."""
