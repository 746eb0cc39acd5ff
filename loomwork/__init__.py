"""loomwork: deterministic entity-triage analytics and corpus operators on PySpark."""
