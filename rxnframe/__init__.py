"""rxnframe: molecular and reaction graph collections as Spark DataFrames."""
