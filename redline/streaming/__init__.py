"""Progress, review and cost events as streams."""
