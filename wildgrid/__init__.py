"""wildgrid: species-distribution analytics written as Spark DataFrame jobs."""
