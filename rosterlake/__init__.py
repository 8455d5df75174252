"""Contact rosters of organisations as Spark DataFrame jobs."""
