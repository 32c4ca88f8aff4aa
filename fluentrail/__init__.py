"""Speech-fluency analytics as Spark DataFrame jobs.

Every function takes DataFrames (or columns) and returns DataFrames (or
columns); nothing runs until the caller asks for a result, save for the size
checks of the vector search and the centroid fit of its list index.
"""
