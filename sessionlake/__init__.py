"""Analytics over coding-agent session logs, written as Spark jobs."""
