"""Documents as a stream, checked against the ledger so far."""
