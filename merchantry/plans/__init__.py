"""The analytical jobs: summaries, reports, checks and logs."""
