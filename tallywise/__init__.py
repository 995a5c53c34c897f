"""Account-ledger analytics on Spark: read, normalise, match, balance and check.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns.  Nothing is collected to the driver and nothing is cached implicitly.
"""
