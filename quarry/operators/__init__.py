"""Changes to tables, and the relational operators on DataFrames."""
