"""Usage measurement of software tools as Spark jobs: DataFrame in, DataFrame out."""
