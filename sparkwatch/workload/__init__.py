"""The registered queries: operators applied to the given tables, with the SQL they must agree with."""
