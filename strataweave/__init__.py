"""Analytics on provenance-carrying property graphs and append-only event ledgers, on Spark DataFrames."""
