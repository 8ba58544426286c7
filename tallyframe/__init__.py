"""Cost, revenue and workforce reporting on Spark DataFrames."""
