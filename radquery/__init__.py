"""Classification decision pipelines as Spark DataFrames."""
