"""The interpreter of page programs: plain Python without Spark, run inside Arrow map tasks."""
