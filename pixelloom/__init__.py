"""pixelloom: lazy image pipelines on Spark DataFrames."""
