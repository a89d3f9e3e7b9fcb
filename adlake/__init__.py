"""Table operators for job advertisements and resumes, written on PySpark."""
