"""Tables, session logs and document folders as DataFrames."""
