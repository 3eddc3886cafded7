"""Tables published and kept in order, as Spark plans."""
