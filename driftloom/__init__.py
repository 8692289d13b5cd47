"""driftloom: drift analytics for labelled tables and event streams, as Spark DataFrame jobs."""
