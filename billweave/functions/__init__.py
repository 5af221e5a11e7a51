"""Column functions: money, percentages, text pieces. All JVM-side, none of them a Python UDF."""
