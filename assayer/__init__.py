"""Result-set grading, score roll-ups, table audits and warehouse queries as Spark jobs."""
