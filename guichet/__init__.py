"""Analytics over wide declaration tables, written as Spark DataFrame operators."""
