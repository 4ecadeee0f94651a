"""feedweave: DataFrame operators that keep destination tables in step with change feeds."""
