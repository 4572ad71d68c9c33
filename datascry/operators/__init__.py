"""Statistics of one wide table, each a function from DataFrames to DataFrames."""
