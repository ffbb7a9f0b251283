"""Driver-side plans: model specs, jobs, estimates, stages, verdicts."""
