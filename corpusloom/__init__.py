"""corpusloom: corpus analytics and predictive-text tables on Spark DataFrames."""
