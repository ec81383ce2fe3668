"""Tables with contracts out of landed JSON API responses, on Spark DataFrames."""
