"""packaudit: audit printed package labels at scale with Spark."""
